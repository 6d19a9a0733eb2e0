"""Mixing sources to target weights by weighted fair queueing (native).

Every document of a source waits twice in the source's queue, in an order shuffled
by a hash of its id and text. Rows equal in both are counted first and stand one after
another as copies 1, 2, ..., so a repeated or null id has a place for every text, and the
cut may fall between copies. An entry's virtual finish time is the source's tokens up to and
including it, divided by the source's target. Entries of all sources are served in
order of finish time until the budget is used: each source has then got close to its
target, whatever the other sources' document lengths.

Running sums never put a source into one task: a source is cut into hash ranges of
about ``rows_per_range`` documents, ranges are summed first (partial aggregation),
and a window runs inside one range only. The same holds for the global cut: served
tokens are summed by slices of virtual time and only the slice in which the budget
ends is sorted. The sources themselves must be few enough for one sorted task.

Defined cases: null text has size 0; null source is a source of its own, sorted last;
rows of one id, or without one, are served one by one as others are; equal rows are
interchangeable; documents of size 0 are never taken; an empty table gives an empty result; other columns of the
input are ignored by :func:`mix` and kept by :func:`apply_mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landfall.llm.text import WORD, distinct_rows, row_keys, store

WEIGHTS = (5.0, 2.0, 1.0)
CHUNK = 10_000                       # copies of one row that a task writes out


def queue_key(doc_id: Column, text: Column) -> Column:
    """Shuffled place of a document: 60 bits of the md5 of its id and its text's md5."""
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size (words), shuffled place and copies (rows equal in these)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        queue_key(F.col("doc_id"), F.col(text)).alias("place")).groupBy("doc_id", "source", "size", "place").agg(
        F.count(F.lit(1)).alias("copies"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, rank and target: ``share`` of all sizes split by weight,
    no source above ``most`` times its size, the excess given to the others by weight.

    A target is min(most * size, level * weight). Sources sorted by most * size / weight
    reach their limit in that order, so the level follows from running sums.
    """
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    per = per.withColumn("rank", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % n + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    full = Window.orderBy(F.col("limit") / F.col("w"), "rank")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    # the level if the sources before this one are at their limits and this one is not
    per = per.withColumn("level", (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                         / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source whose limit is not reached fixes the level
    fits = F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level"))
    per = per.withColumn("first_fit", F.first(fits, ignorenulls=True).over(
        full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return per.select("source", "source_size", "rank", F.least(
        "limit", F.coalesce(F.col("first_fit") * F.col("w"), F.col("limit"))).alias("target"))


def each_copy(rows: DataFrame, most: int) -> DataFrame:
    """Every row as often as its ``copies``, numbered ``copy``. If a row has more than CHUNK
    copies (``most`` is the largest number), they are dealt over tasks in chunks."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK)))
    r = rows.withColumn("_chunk", chunk)
    if most > CHUNK:
        r = r.repartition("place", "_chunk")
    first = F.col("_chunk") * CHUNK
    return r.withColumn("copy", F.explode(F.sequence(first + 1, F.least(F.col("copies"), first + CHUNK)))).drop("_chunk", "copies")


def queue(sized: DataFrame, goal: DataFrame, rows: int, most: int, rows_per_range: int) -> DataFrame:
    """Each document with its source's target and the finish times of its two entries."""
    ranges = max(1, -(-rows // rows_per_range))
    width = (1 << 60) // ranges + 1
    d = sized.withColumn("range", F.floor(F.col("place") / F.lit(width)).cast("long"))
    whole = F.col("size") * F.col("copies")
    sums = d.groupBy("source", "range").agg(F.sum(whole).alias("in_range"))
    running = Window.partitionBy("source").orderBy("range")
    sums = sums.withColumn("before", F.sum("in_range").over(running) - F.col("in_range"))
    sums = sums.withColumnsRenamed({"source": "s", "range": "r"}).join(
        goal, F.col("s").eqNullSafe(F.col("source"))).select(
        "s", "r", "before", "source_size", "rank", "target")
    inside = Window.partitionBy("source", "range").orderBy("place", "doc_id")
    d = d.withColumn("cum", F.sum(whole).over(inside) - whole)
    d = d.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    d = each_copy(d, most)
    served = F.col("before") + F.col("cum") + F.col("copy") * F.col("size")
    finish = lambda tokens: F.when(F.col("target") > 0, tokens / F.col("target"))
    return d.select("doc_id", "source", "place", "copy", "rank", "size", "source_size", "target",
                    finish(served).alias("first"), finish(F.col("source_size") + served).alias("second"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0,
        rows_per_range: int = 20_000) -> DataFrame:
    """doc_id, source, place, copy, size, source_size, target and taken (tokens that the
    mix takes of the document, repeats counted) of every row of ``docs``."""
    sized = store(sizes(docs), "mix-sizes")
    total = sized.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("size"),
                      F.max("copies").alias("most")).first()
    goal = store(targets(sized, weights, share, most), "mix-targets")
    q = store(queue(sized, goal, total["rows"], total["most"] or 0, rows_per_range), "mix-queue")
    budget = float(total["size"] or 0) * share

    slices = max(1, -(-2 * total["rows"] // rows_per_range))
    entry = F.explode(F.array(*[F.struct(F.col(c).alias("finish"), F.lit(i).alias("turn"))
                                for i, c in enumerate(("first", "second"))])).alias("e")
    order = ("finish", "rank", "place", "id", "copy", "turn")
    entries = q.where("size > 0").select(
        entry, "size", "rank", "place", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "copy",
    ).select("e.finish", "rank", "place", "id", "copy", "e.turn", "size").where("finish is not null").withColumn(
        "slice", F.floor(F.least("finish", F.lit(2.0)) * F.lit(slices)).cast("long"))
    per_slice = entries.groupBy("slice").agg(F.sum("size").alias("n"))
    running = per_slice.withColumn("upto", F.sum("n").over(Window.orderBy("slice")))
    cut_slice = running.where(F.col("upto") > budget).orderBy("slice").first()
    if cut_slice is None:                       # the budget holds every entry
        taken = lambda c, turn: F.col(c).isNotNull()
    else:
        before = cut_slice["upto"] - cut_slice["n"]
        last = entries.where(F.col("slice") == cut_slice["slice"]).withColumn(
            "upto", F.sum("size").over(Window.orderBy(*order)) + F.lit(before)).where(
            F.col("upto") <= budget).agg(F.max(F.struct(*order)).alias("last")).first()["last"]

        def taken(c, turn):
            now = F.floor(F.least(c, F.lit(2.0)) * F.lit(slices))
            if last is None:                    # nothing of that slice fits
                return now < cut_slice["slice"]
            here = F.struct(F.col(c).alias("finish"), "rank", "place",
                            F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "copy", F.lit(turn).alias("turn"))
            end = F.struct(*[F.lit(last[k]).cast(t).alias(k) for k, t in zip(
                order, ("double", "int", "long", "long", "long", "int"))])
            return (now < cut_slice["slice"]) | ((now == cut_slice["slice"]) & (here <= end))
    n = sum((F.coalesce(taken(c, i), F.lit(False)).cast("long") for i, c in enumerate(("first", "second"))),
            F.lit(0).cast("long"))
    return q.select("doc_id", "source", "place", "copy", "size", "source_size",
                    F.coalesce("target", F.lit(0.0)).alias("target"), (n * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` as often as the mix takes them, with their own columns.

    A source's queue is served from the front, so what it has got is told by its last
    first turn and its last second turn: one row per source joins the documents, and no
    text is moved unless the sources are too many to broadcast. Only of the rows at a
    queue's two ends, which may have copies on both sides of the cut, equal ones are counted.
    """
    at = F.struct("place", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "copy")
    ends = mixed.where("taken > 0").groupBy("source").agg(
        F.max(at).alias("_llm_end1"), F.max(F.when(F.col("taken") > F.col("size"), at)).alias("_llm_end2"))
    ends = store(ends, "mix-ends").withColumnRenamed("source", "_llm_source")
    here = F.struct(queue_key(F.col("doc_id"), F.col("text")).alias("place"),
                    F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"))
    end = lambda n: F.struct(F.col(f"_llm_end{n}.place").alias("place"), F.col(f"_llm_end{n}.id").alias("id"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    has_word = sure(F.col("text").rlike(WORD))
    kept = docs.join(ends, F.col("source").cast("string").eqNullSafe(F.col("_llm_source"))).where(has_word).withColumn("_llm_here", here)
    here = F.col("_llm_here")
    full = sure(here < end(1)).cast("long") + sure(here < end(2)).cast("long")
    last = [F.when(sure(here == end(n)), F.col(f"_llm_end{n}.copy")) for n in (1, 2)]
    inside = kept.where(last[0].isNull() & last[1].isNull() & (full > 0))
    inside = inside.withColumn("_llm_turn", F.explode(F.sequence(F.lit(1).cast("long"), full)))
    columns = [f"`{c}`" for c in docs.columns]

    edge = kept.where(last[0].isNotNull() | last[1].isNotNull()).select(
        *columns, "_llm_here", full.alias("_llm_full"), last[0].alias("_llm_c1"), last[1].alias("_llm_c2"), "_llm_source")
    rows = distinct_rows(row_keys(edge), edge.columns).select("row", "copies", "_llm_k1", "_llm_k2", *[
        F.col(f"row._llm_{c}").alias(c) for c in ("here", "full", "c1", "c2", "source")])
    before = F.sum("copies").over(Window.partitionBy("source", "here").orderBy("_llm_k1", "_llm_k2")) - F.col("copies")
    part = lambda c: F.coalesce(F.least(F.greatest(F.col(c) - before, F.lit(0)), F.col("copies")), F.lit(0))
    rows = rows.withColumn("times", F.col("full") * F.col("copies") + part("c1") + part("c2")).where("times > 0")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / CHUNK)))
    rows = rows.select("row", "times", chunk.alias("chunk")).repartition("chunk").withColumn("turn", F.explode(F.sequence(
        F.col("chunk") * CHUNK + 1, F.least(F.col("times"), F.col("chunk") * CHUNK + CHUNK))))
    return inside.select(*columns).unionByName(rows.select("row.*").select(*columns))
