"""License scans by diagonal voting, in DataFrame functions only.

Every rolling pair of words of every text is joined, by hash, to the positions of the same pair in
the license templates. Hits on one diagonal (word position minus template position) support the same
alignment. Votes are summed by diagonal; diagonals of a template that lie within GAP words are
merged, so inserted or missing words do not break a match; a merged span, or one diagonal of it, is
accepted if its pairs, in the template's order and each counted once, cover a share of the template.
A base phrase is a template that needs every pair on one diagonal.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recoup.llm.rows import named, own_rows

#: Phrases whose places are counted word by word, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Sentences of well-known licenses, and notices, with the labels that the voting adds.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("creative commons attribution", "cc-by"),
    ("released under the mit license", "mit"),
    ("all rights reserved", "all-rights-reserved"),
]
#: Words by which diagonals of one match may differ, and the share of a template's pairs it needs.
GAP = 2
SHARE = 0.85

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_array(text: Column) -> Column:
    """Words of a text, A-Z lower-cased, with an empty string before the first word if other
    characters come first, and one after the last if others come last; null is empty."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template_pairs(spark: SparkSession, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """``template, label, base, need, span, at, pair, first, second`` for every pair of words of every template."""
    rows = []
    for number, (words, label) in enumerate([*phrases, *templates]):
        w = words.split()
        base = number < len(phrases)
        need = len(w) - 1 if base else max(1, -int(-(len(w) - 1) * SHARE // 1))
        rows += [(number, label, base, need, len(w), at, w[at], w[at + 1]) for at in range(len(w) - 1)]
    names = ["template", "label", "base", "need", "span", "at", "a", "b"]
    df = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))
    return df.select("template", "label", "base", "need", "span", "at", F.xxhash64("a", "b").alias("pair"), F.col("a").alias("first"), F.col("b").alias("second"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    n_base counts the places of the phrases; first_word and last_word are the smallest and largest
    word at which one starts, else null. labels joins the phrases' labels and those of accepted
    spans. score is the share of its pairs that the best accepted span has, 0 without one. Null and
    empty texts have no words. Rows that share an id (or a null id) are scanned each by its own text.
    Other columns are not read.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    docs = docs.select(own_rows(docs, id_col, text_col).alias("doc"), word_array(F.col(text_col)).alias("w"))
    lead = (F.element_at("w", 1) == "").cast("int")
    sized = docs.select("doc", (F.size("w") - lead - F.when(F.size("w") > lead, (F.element_at("w", -1) == "").cast("int")).otherwise(0)).cast("long").alias("n_words"))
    # the following word is looked up in the array beside it, so no row of a pair is built before the join
    pairs = docs.select("doc", "w", lead.alias("lead"), F.posexplode_outer("w").alias("at_", "a")).select(
        "doc", (F.col("at_") - F.col("lead")).alias("pos"), "a", F.try_element_at("w", F.col("at_") + 2).alias("b"))
    known = template_pairs(spark, phrases, templates)
    # the templates are a literal of some hundred rows; the words are compared besides the hash
    hits = (pairs.withColumn("pair", F.xxhash64("a", "b")).join(F.broadcast(known), "pair")
            .select("doc", "template", "label", "base", "need", "span", "pos", "at", (F.col("pos") - F.col("at")).alias("diagonal"),
                    ((F.col("a") == F.col("first")) & (F.col("b") == F.col("second"))).alias("same")))
    # votes by diagonal: the template's pairs that it holds
    votes = hits.groupBy("doc", "template", "label", "base", "need", "span", "diagonal").agg(
        F.collect_set(F.when(F.col("same"), F.struct("pos", "at"))).alias("held"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    # neighbouring diagonals of a template are one alignment; a base phrase keeps each on its own
    order = Window.partitionBy("doc", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > GAP), F.lit(True))
    chained = votes.withColumn("match", F.sum(fresh.cast("int")).over(order))
    merged = (chained.groupBy("doc", "template", "label", "base", "need", "span", "match")
              .agg(F.flatten(F.collect_list("held")).alias("held"), F.min("low").alias("low"), F.max("high").alias("high"),
                   F.min("diagonal").cast("long").alias("start"), F.count(F.lit(1)).alias("n")))
    # a diagonal of a longer chain is a candidate of its own
    single = chained.where(~F.col("base")).select("doc", "template", "label", "base", "need", "span", "held", "low", "high", F.col("diagonal").cast("long").alias("start"))
    both = merged.drop("match", "n").unionByName(single)
    # a span is verified by its length against the template's, and by the pairs that follow each other
    # in the template's order: no pair of the template counts twice
    rising = F.aggregate(F.array_sort("held"), F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n")), lambda s, x: F.when(
        x["at"] > s["last"], F.struct(x["at"].alias("last"), (s["n"] + 1).alias("n"))).otherwise(s))["n"]
    found = both.withColumn("votes", rising).where(f"votes >= need and high - low + 2 <= span + {2 * GAP}")
    own = F.col("base")
    matches = found.groupBy(F.col("doc").alias("d")).agg(
        F.count(F.when(own, F.col("start"))).alias("n_base"), F.min(F.when(own, F.col("start"))).alias("first_word"),
        F.max(F.when(own, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(own, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(F.least(F.lit(1.0), F.col("votes") / (F.col("span") - 1))).alias("score"))
    joined = sized.join(matches, sized["doc"].eqNullSafe(matches["d"]), "left")
    return joined.select(
        named(joined, "doc", id_type).alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
