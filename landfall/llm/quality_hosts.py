"""Quality rules with host verdicts.

Each document is measured where it is read (one pass, no shuffle) and the measures are
stored. Failures of each rule, and of any, are summed per host in one grouping (map-side
first). A host's failure rate by each rule is shrunk towards the mean of all hosts by that
rule's own beta prior, whose mean and strength come from the hosts themselves (method of
moments), so small hosts are not judged by a few documents. A host is condemned if any of
its shrunk rates is too high: by one rule that it always breaks, or by mixed failures.
Host verdicts are joined back to the stored measures; the join is left to
Spark, which broadcasts the hosts only below its size threshold and otherwise splits a
skewed host.

Defined cases: null text has no words and fails; documents with null host are one host;
repeated rows count and are returned like any others; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfall.llm.text import WORD, store

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    words: int = 50                  # fewer fail
    repeat_share: float = 0.5        # share of words in repeated 3-word windows
    symbol_rate: float = 0.2         # symbols a word
    dup_line_share: float = 0.5      # repeated lines of all lines with a word
    short_word: float = 2.0          # mean letters a word
    long_word: float = 15.0
    host_rate: float = 0.8           # shrunk share of documents failing a rule, or any, that condemns a host


def measure(text: str | None) -> tuple[int, ...]:
    """The six counts of one text."""
    text = text or ""
    words = re.findall(WORD, text)
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) < n - 2:
            covered = 0              # words before this one are counted
            for at, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += at + 3 - max(at, covered)
                    covered = at + 3
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the measures of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_py()) for t in b.column(2)]
            cols = list(zip(*rows)) if rows else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(x, pa.int64()) for x in cols]],
                names=["doc_id", "host", *MEASURES])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    return d.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def failures(limits: Limits) -> dict[str, F.Column]:
    n, at_least = F.col("n_words"), lambda c: F.greatest(F.col(c), F.lit(1))
    mean = F.col("word_chars") / at_least("n_words")
    return {
        "few_words": n < limits.words,
        "repeats": F.col("n_repeat_words") > limits.repeat_share * n,
        "symbols": F.col("n_symbols") > limits.symbol_rate * n,
        "dup_lines": F.col("n_dup_lines") > limits.dup_line_share * F.col("n_lines"),
        "word_length": (mean < limits.short_word) | (mean > limits.long_word),
    }


def host_rates(m: DataFrame, rules: list[str]) -> DataFrame:
    """host, its documents ``n``, and by rule (a boolean column of ``m``) its failures and its
    shrunk rate ``rate_...``."""
    per = store(m.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(r)).alias(r) for r in rules]), "hosts")
    a = per.agg(F.sum("n").alias("n"), F.avg(1 / F.col("n")).alias("inv"), *[F.sum(r).alias(r) for r in rules],
                *[F.var_samp(F.col(r) / F.col("n")).alias(f"var_{r}") for r in rules]).first()
    for r in rules:
        mean = (a[r] or 0) / a["n"] if a["n"] else 0.0
        noise = mean * (1 - mean) * (a["inv"] or 0.0)     # spread that equal hosts would show
        between = max((a[f"var_{r}"] or 0.0) - noise, 1e-9)
        strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
        per = per.withColumn(f"rate_{r}", (F.col(r) + F.lit(strength * mean)) / (F.col("n") + F.lit(strength)))
    return per


def judge(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """Measures of every document with base_failed, fails (any rule), host_rate (the highest
    shrunk rate of its host) and host_rule (whose rate that is), host_condemned and kept."""
    rules = {f"fails_{k}": v for k, v in failures(limits).items()}
    m = measured(docs, host).withColumns(rules)
    any_rule = F.greatest(*[F.col(k).cast("int") for k in rules]) == 1
    m = store(m.withColumn("fails", any_rule).withColumn(
        "base_failed", F.col("fails_few_words") | F.col("fails_repeats")), "quality-measures")
    rates = host_rates(m, [*rules, "fails"])
    worst = F.array_max(F.array(*[F.struct(F.col(f"rate_{r}").alias("rate"), F.lit(r).alias("rule")) for r in (*rules, "fails")]))
    hosts = store(rates.select(F.col("host").alias("_host"), worst.alias("_worst")), "host-rates").select(
        "_host", F.col("_worst.rate").alias("host_rate"), F.col("_worst.rule").alias("host_rule"))
    j = m.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    return j.withColumn("host_condemned", F.col("host_rate") > limits.host_rate).withColumn(
        "kept", ~F.col("fails") & ~F.col("host_condemned"))
