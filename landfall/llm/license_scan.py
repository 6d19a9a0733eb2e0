"""License scan by diagonal voting (native).

Every rolling word k-gram of a text is joined by hash to the places where it stands in
license templates. A hit at word p of the text and word q of a template votes for the
diagonal p - q. Votes are summed per document, template and diagonal; neighbouring
diagonals (words added or left out) are merged, and a merged span is verified: its
words have to cover enough of the template within a bounded length.

Short phrases are templates of 2-grams that must be covered wholly on one diagonal, so
a verified span is exactly a place of the phrase. Longer notices are templates of
5-grams (the shortest notices of 3- or 4-grams, so that two edits anywhere leave a gram
whole) and are verified by words: of a hit's diagonal and the ``slack`` places on both
sides, the words that stand in the template's order (longest common subsequence,
bit-parallel) are ``coverage`` of the template's words or more. A notice's share is
these words over the template's and the words added between the first and last hit.
The templates are a fixed list, so they are broadcast; hits also compare the words, so
equal hashes of other words never count.

Defined cases: null text is empty and has no words; repeated rows each give a row;
rows of one id with different texts are scanned apart; nothing found gives empty label
strings, null places and score 0; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landfall.llm.text import lower_ascii, repeated, store

# Phrases and their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# Sentences of the public license notices.
NOTICES = (
    ("apache-notice", "licensed under the apache license version 2 0 the license you may not use "
                      "this file except in compliance with the license"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification "
                   "are permitted provided that the following conditions are met"),
    ("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the "
                   "terms of the gnu general public license as published by the free software foundation"),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with "
                   "or without fee is hereby granted provided that the above copyright notice and this "
                   "permission notice appear in all copies"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this "
                   "software and associated documentation files the software to deal in the software "
                   "without restriction"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain-notice", "this is free and unencumbered software released into the public domain"),
)

NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"   # after lower-casing A-Z
PHRASE_K, NOTICE_K = 2, 5
SLACK = 4


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_A_WORD, -1), "")


def template_words(text: str) -> list[str]:
    return [x for x in re.split(NOT_A_WORD, text.lower()) if x]


def notice_k(text: str) -> int:
    """Two edits leave three runs of a notice's words; the longest has so many at least."""
    return min(NOTICE_K, max(1, -(-(len(template_words(text)) - 2) // 3)))


def template_grams(spark: SparkSession, templates, k: int) -> DataFrame:
    """One row per template gram: template, its numbers of grams and words, place, hash,
    words, and the places of each of the template's words as bits."""
    rows = []
    for label, text in templates:
        w = template_words(text)
        if len(w) < k:
            raise ValueError(f"template {label} has fewer than {k} words")
        if len(w) > 60:
            raise ValueError(f"template {label} has more than 60 words")
        bits = {x: sum(1 << i for i, y in enumerate(w) if x == y) for x in w}
        places = F.create_map(*[y for x, n in bits.items() for y in (F.lit(x), F.lit(n).cast("long"))])
        rows += [F.struct(F.lit(label).alias("label"), F.lit(len(w) - k + 1).alias("n_grams"),
                          F.lit(len(w)).alias("t_words_n"), F.lit(k).alias("k"), places.alias("places"),
                          F.lit(at).alias("t_at"), F.array(*map(F.lit, w[at:at + k])).alias("t_words"))
                 for at in range(len(w) - k + 1)]
    one = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    return one.withColumn("h", F.xxhash64(*[F.col("t_words")[i] for i in range(k)]))


def words_in_order(w: Column, at: Column, t: Column, slack: int) -> Column:
    """Length of the longest common subsequence of template ``t`` and the text's words
    around the diagonal of a hit at word ``at`` (place 0 of ``w`` is no word): the state has
    a bit per template word, which is 0 where the length grows."""
    start = F.greatest(at - t["t_at"] - slack, F.lit(0))
    window = F.slice(w, (start + 2).cast("int"), (at - t["t_at"] + t["t_words_n"] + slack - start).cast("int"))
    full = F.call_function("shiftleft", F.lit(1).cast("long"), t["t_words_n"]) - F.lit(1).cast("long")

    def step(state, word):
        both = state["v"].bitwiseAND(F.coalesce(F.try_element_at(t["places"], word), F.lit(0).cast("long")))
        return F.struct((state["v"] + both).bitwiseOR(state["v"] - both).bitwiseAND(state["full"]).alias("v"),
                        state["full"].alias("full"))
    left = F.aggregate(window, F.struct(full.alias("v"), full.alias("full")), step, lambda state: state["v"])
    return t["t_words_n"] - F.bit_count(left)


def votes(docs: DataFrame, phrases=PHRASES, notices=NOTICES, slack: int = SLACK) -> DataFrame:
    """doc_id, text_key, n_words, label, n_grams, t_words_n, k, is_phrase, at, t_at and met (the
    notice's words in order around the diagonal) of every hit, and a row with null label for
    each document."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                    license_words(F.col("text")).alias("w"))
    # place 0 is a word that no template has: the row that keeps the document
    d = d.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"),
                 F.concat(F.array(F.lit("")), "w").alias("w")).select("*", F.posexplode("w").alias("p", "x"))
    gram = lambda k: F.xxhash64("x", *[F.get("w", F.col("p") + i) for i in range(1, k)])
    by_k = {k: [n for n in notices if notice_k(n[1]) == k] for k in sorted({notice_k(n[1]) for n in notices})}
    kinds = [("phrase", phrases, PHRASE_K), *[(f"notice{k}", some, k) for k, some in by_k.items()]]
    for name, templates, k in kinds:
        t = template_grams(spark, templates, k).select(
            F.struct("label", "n_grams", "t_words_n", "k", "places", "t_at").alias(name), F.col("h").alias(f"{name}_h"),
            F.col("t_words").alias(f"{name}_words"))
        d = d.join(F.broadcast(t), (gram(k) == F.col(f"{name}_h"))
                   & (F.slice("w", F.col("p") + 1, k) == F.col(f"{name}_words")), "left")
    d = d.where(reduce(Column.__or__, [F.col("p") == 0, *[F.col(name).isNotNull() for name, *_ in kinds]]))
    hits = F.filter(F.array(*[F.struct(F.col(name).alias("t"), F.lit(name == "phrase").alias("is_phrase"))
                              for name, *_ in kinds]), lambda h: h["t"].isNotNull())
    d = d.select("doc_id", "text_key", "n_words", "w", (F.col("p") - 1).alias("at"), F.explode_outer(hits).alias("h"))
    met = F.when(~F.col("h.is_phrase"), words_in_order(F.col("w"), F.col("at"), F.col("h.t"), slack))
    return d.select("doc_id", "text_key", "n_words", "at", "h.t.label", "h.t.n_grams", "h.t.t_words_n", "h.t.k",
                    "h.t.t_at", "h.is_phrase", met.alias("met"))


def spans(v: DataFrame, slack: int = SLACK, coverage: float = 0.8, stretch: float = 1.5) -> DataFrame:
    """Verified spans per document: label, is_phrase, first and last word, share of the
    template covered; documents keep a row with null label and their number of copies."""
    key = ["doc_id", "text_key", "n_words"]
    template = ["label", "is_phrase", "n_grams", "t_words_n", "k"]
    diagonal = v.groupBy(*key, *template, (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.collect_set("t_at").alias("places"), F.min("at").alias("lo"), F.max("at").alias("hi"),
        F.max("met").alias("met"), F.count_if(F.col("label").isNull()).alias("copies"))
    along = Window.partitionBy(*key, "label", "is_phrase").orderBy("diagonal")
    gap = F.when(F.col("is_phrase"), 0).otherwise(slack)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > gap, F.lit(True))
    merged = diagonal.withColumn("span", F.sum(apart.cast("int")).over(along)).groupBy(
        *key, *template, "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"), F.max("met").alias("met"),
        (F.max_by("diagonal", F.struct("hi", "diagonal")) - F.min_by("diagonal", F.struct("lo", "diagonal"))).alias("added"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("copies").alias("copies"))
    share = F.when(F.col("is_phrase"), F.col("n") / F.col("n_grams")).otherwise(
        F.col("met") / (F.col("t_words_n") + F.greatest("added", F.lit(0))))
    fits = F.when(F.col("is_phrase"), share == 1).otherwise(
        (F.col("met") >= coverage * F.col("t_words_n"))
        & (F.col("hi") - F.col("lo") < F.col("n_grams") * stretch + slack))
    return merged.where(F.col("label").isNull() | fits).select(
        *key, "label", "is_phrase", F.col("lo").alias("first"), (F.col("hi") + F.col("k") - 1).alias("last"),
        share.alias("share"), "copies")


def scan(docs: DataFrame, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base (places of the phrases),
    first_word, last_word (smallest and largest start of a phrase), base_labels, labels
    (the notices' too), score (largest verified share of a template) and the spans."""
    found = F.when(F.col("label").isNotNull(), F.struct("first", "last", "label"))
    phrase = F.when(F.col("is_phrase"), F.col("first").cast("long"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = spans(votes(docs, slack=how.get("slack", SLACK)), **how).groupBy("doc_id", "text_key", "n_words").agg(
        F.count(phrase).alias("n_base"), F.min(phrase).alias("first_word"), F.max(phrase).alias("last_word"),
        joined(F.when(F.col("is_phrase"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"), F.coalesce(F.max(F.when(
            F.col("label").isNotNull(), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(found)).alias("spans"), F.sum("copies").alias("copies"))
    # Stored first: the rows that stand very often are a branch of their own below.
    return repeated(store(per, "licenses")).drop("text_key")
