"""Secret scan over a trigram inverted index (native).

From each rule's pattern a Boolean trigram query is derived: an OR of clauses, each an
AND of the trigrams of letters that a match must hold. Postings (trigram, document) are
made for the trigrams in those queries, clauses are intersected by counting a
document's distinct trigrams, and only documents that satisfy a rule's query are
verified with its pattern. Rules without mandatory trigrams (runs of a character class)
verify every document. The index folds A-Z to a-z, so it never misses a match.

Postings stay rows, never lists, so a trigram found in every document is no hot group:
they are counted per document. Equal rows are merged with a count before their text is
shuffled (map-side, too) and multiplied again at the end.

Places of matches are running sums of the lengths between and of matches, taken by a
window inside one document and rule.

Defined cases: null text is empty; repeated rows each give a row; rows of one id with
other texts are scanned apart; no span gives the hash of the empty text and an empty
span string; columns other than doc_id and text are ignored by :func:`scan` and kept by
:func:`drop_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as c
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landfall.llm.text import distinct_rows, lower_ascii, repeated, row_keys


@dataclass(frozen=True)
class Rule:
    """A pattern in syntax that Java and Python share; matches shorter than ``least``
    or whose group 2 is shorter than ``least_value`` are dropped after matching."""
    kind: str
    pattern: str
    least: int = 0
    least_value: int = 0
    base: bool = False


# The contract's three patterns, then public token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         least_value=8, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, base=True),
    Rule("hex", r"[0-9a-f]+", least=32, base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def trigram_query(pattern: str, widest: int = 16) -> list[frozenset[str]]:
    """Clauses (an OR) of trigrams (an AND) that any match of ``pattern`` holds, letters
    folded to lower case; an empty list if some match needs none.

    Runs of literals are followed through groups, alternatives, optional parts and small
    classes; anything else ends a run. A part that would give more than ``widest``
    alternatives asks for nothing and ends the runs before it, which are kept.
    """
    def add(ways, letters):
        return [(runs, run + letters) for runs, run in ways]

    def end(ways):
        return list(dict.fromkeys((runs + (run,), "") for runs, run in ways))

    def follow(tokens, ways):
        for op, arg in tokens:
            before = ways
            if op is c.LITERAL:
                ways = add(ways, chr(arg).lower() if arg < 128 else chr(arg))
            elif op is c.SUBPATTERN:
                ways = follow(arg[3], ways)
            elif op is c.BRANCH:
                ways = [w for branch in arg[1] for w in follow(branch, ways)]
            elif op is c.IN and len(arg) <= 6 and all(o is c.LITERAL for o, _ in arg):
                ways = [w for _, a in arg for w in add(ways, chr(a).lower())]
            elif op is c.MAX_REPEAT and arg[:2] == (0, 1):
                ways = ways + follow(arg[2], ways)
            elif op is c.MAX_REPEAT and arg[0] > 0:
                ways = end(follow(arg[2], ways))
            else:
                ways = end(ways)
            ways = list(dict.fromkeys(ways))
            if len(ways) > widest:
                ways = end(before)
        return ways

    clauses = [frozenset(run[i:i + 3] for run in (*runs, last) for i in range(len(run) - 2))
               for runs, last in follow(_parser.parse(pattern), [((), "")])]
    if not all(clauses):
        return []
    return [x for x in dict.fromkeys(clauses) if not any(y < x for y in clauses)]


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """(key, trigram) rows of the wanted trigrams."""
    low = keyed.select("_llm_k1", "_llm_k2", lower_ascii(F.col("text")).alias("low"))
    has = F.filter(F.array(*[F.struct(F.lit(t).alias("t"), F.contains("low", F.lit(t)).alias("has"))
                             for t in trigrams]), lambda x: x["has"])
    return low.select("_llm_k1", "_llm_k2", F.explode(has).alias("p")).select("_llm_k1", "_llm_k2", F.col("p.t").alias("trigram"))


def candidates(keyed: DataFrame, rules) -> DataFrame:
    """Per key the kinds whose trigram query holds."""
    spark: SparkSession = keyed.sparkSession
    need = [(r.kind, i, t, len(clause)) for r in rules for i, clause in enumerate(trigram_query(r.pattern))
            for t in sorted(clause)]
    trigrams = sorted({n[2] for n in need})
    clauses = spark.range(1).select(F.explode(F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in zip(("kind", "clause", "trigram", "n"), row)])
        for row in need])).alias("x")).select("x.*")
    met = postings(keyed, trigrams).join(F.broadcast(clauses), "trigram").groupBy("_llm_k1", "_llm_k2", "kind", "clause", "n").agg(
        F.size(F.collect_set("trigram")).alias("got")).where("got = n")
    return met.groupBy("_llm_k1", "_llm_k2").agg(F.collect_set("kind").alias("kinds"))


def matches(text: Column, rule: Rule, number: int, asked: Column) -> Column:
    """Array of kind, place in order, length before and of each match, whether it holds."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(2)) if rule.least_value else whole
    found = F.transform(F.arrays_zip(whole.alias("m"), F.slice(between, 1, F.size(whole)).alias("b"), value.alias("v")),
                        lambda x, i: F.struct(
                            F.lit(number).alias("kind"), i.alias("nth"), F.length(x["b"]).alias("gap"),
                            F.length(x["m"]).alias("len"), ((F.length(x["m"]) >= rule.least)
                                                            & (F.length(x["v"]) >= rule.least_value)).alias("holds")))
    empty = F.array().cast("array<struct<kind:int,nth:int,gap:int,len:int,holds:boolean>>")
    return F.when(asked & text.rlike(strict(rule)), found).otherwise(empty)


def strict(rule: Rule) -> str:
    """A pattern that a text with a holding match must match: quick rejection."""
    if rule.pattern.endswith("+") and rule.least:
        return rule.pattern[:-1] + "{%d,}" % (rule.least - fixed_length(rule.pattern))
    return rule.pattern


def fixed_length(pattern: str) -> int:
    """Characters before the last, repeated class of a pattern."""
    tokens = list(_parser.parse(pattern))
    return sum(c.MAX_REPEAT is not op for op, _ in tokens[:-1])


def verified(docs: DataFrame, rules=RULES) -> DataFrame:
    """Distinct rows (as ``row``) with their number and the matches of all rules."""
    keyed = row_keys(docs)
    got = distinct_rows(keyed, docs.columns).join(candidates(keyed, rules), ["_llm_k1", "_llm_k2"], "left")
    text = F.coalesce(F.col("row")["text"], F.lit(""))
    every = [matches(text, r, i, F.lit(True) if not trigram_query(r.pattern)
                     else F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)))
             for i, r in enumerate(rules)]
    return got.select("_llm_k1", "_llm_k2", "row", "copies", F.concat(*every).alias("matches"))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, a count per base kind, spans (kind, start,
    end, base) in order of start and kind."""
    v = verified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules)
    nothing = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("nth"), F.lit(0).alias("gap"),
                               F.lit(0).alias("len"), F.lit(False).alias("holds")))
    m = v.select("_llm_k1", "_llm_k2", F.col("row.doc_id").alias("doc_id"), "copies",
                 F.explode(F.concat(nothing, "matches")).alias("m")).select("_llm_k1", "_llm_k2", "doc_id", "copies", "m.*")
    along = Window.partitionBy("_llm_k1", "_llm_k2", "kind").orderBy("nth")
    m = m.withColumn("end", F.sum((F.col("gap") + F.col("len")).cast("long")).over(along))
    name = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind") + 1)
    base = sum(r.base for r in rules)
    if not all(r.base for r in rules[:base]):
        raise ValueError("base rules come first")
    span = F.when(F.col("holds"), F.struct((F.col("end") - F.col("len")).alias("start"), "kind", "end",
                                           F.when(F.col("kind") >= 0, name).alias("name")))
    per = m.groupBy("_llm_k1", "_llm_k2", "doc_id", "copies").agg(
        F.array_sort(F.collect_list(span)).alias("spans"),
        *[F.count_if(F.col("holds") & (F.col("kind") == i)).alias(f"n_{r.kind}")
          for i, r in enumerate(rules) if r.base])
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(
        ":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    per = per.withColumn("spans_text", said(F.col("spans"))).withColumn(
        "base_text", said(F.filter("spans", lambda x: x["kind"] < base)))
    return repeated(per).drop("_llm_k1", "_llm_k2")


def drop_documents(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` without any span, with all their columns."""
    v = verified(docs, rules).where(~F.exists("matches", lambda m: m["holds"]))
    return repeated(v.select("row", "copies")).select("row.*")
