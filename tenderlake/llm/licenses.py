"""License texts by diagonal voting. DataFrame operations only.

All rolling word pairs of a text are joined with the places of the same pairs in the templates. A
hit at text word p and template word q votes for the diagonal p - q. Neighbouring diagonals, which a
few inserted or missing words part, are merged, and the words under a diagonal are compared with the
template's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlake.llm.store import id_column, plain_text

# The phrases that make a base label.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Sentences of public license notices and the label they add.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "all rights reserved"),
]
# Diagonals this close in one template are one match.
NEIGHBOURS = 3
# Share of a notice's word pairs that a merged match must hold.
COVERED = 0.7
# Bytes that part words: the complement of a-z, 0-9 and all characters beyond ASCII.
PARTING = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Words of a text whose ASCII letters are in lower case."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.split(F.regexp_replace(lowered, f"^{PARTING}|{PARTING}\\z", ""), PARTING, -1)
    return F.when(parts[0] == "", F.array().cast("array<string>")).otherwise(parts)


def pairs(list_of_words: Column) -> Column:
    """Rolling hashes of two consecutive words."""
    n = F.size(list_of_words)
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(
        F.zip_with(F.slice(list_of_words, 1, n - 1), F.slice(list_of_words, 2, n - 1), lambda a, b: F.xxhash64(a, b))
    )


def template_places(spark: SparkSession, templates: list[tuple[bool, str, str]]) -> DataFrame:
    """One row per word pair of each template (base, label, text). As many rows as templates have words."""
    rows = [(i, base, label, text.split()) for i, (base, label, text) in enumerate(templates)]
    frame = spark.createDataFrame(rows, "template int, base boolean, label string, template_words array<string>")
    return frame.select("*", F.posexplode(pairs(F.col("template_words"))).alias("q", "pair"))


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans.

    A base place is a start where a phrase's words stand consecutively; n_base counts them all,
    first_word and last_word are the smallest and largest start or null. labels adds those of
    notices of which a merged diagonal holds at least COVERED of the word pairs; score is the
    largest share of a notice's or phrase's pairs found, counting verified words only. spans lists
    the matches behind labels as structs (label, first word, last word). A null or empty text has
    no words, no labels and score 0. Rows that repeat are scored each on its own. Columns other than
    doc_id and text are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    templates = [(True, *p) for p in phrases] + [(False, *p) for p in notices]
    # One row per template word: a fixed, small table whatever the documents are.
    places = F.broadcast(template_places(spark, templates))
    own = docs.select(id_column(docs), F.monotonically_increasing_id().alias("row"), words(plain_text()).alias("w"))
    own = own.select("doc_id", "row", "w", F.size("w").cast("bigint").alias("n_words"))
    # A pair of no template, at place -1, keeps each row in the result.
    found = own.select("doc_id", "row", "n_words", "w", F.posexplode(F.concat(F.array(F.lit(None).cast("bigint")), pairs(F.col("w")))).alias("p", "pair"))
    found = found.join(places.withColumnRenamed("pair", "template_pair"), F.col("pair") == F.col("template_pair"), "left")
    found = found.filter((F.col("p") == 0) | F.col("template").isNotNull()).withColumn("p", F.col("p") - 1)
    length = F.size("template_words")
    diagonal = F.col("p") - F.col("q")
    same = lambda k: F.element_at("w", F.col("p") + k) == F.element_at("template_words", F.col("q") + k)
    # The two words behind a hash are compared; a whole phrase is verified under its first pair.
    whole = F.when(
        F.col("base") & (F.col("q") == 0) & (F.col("p") + length <= F.col("n_words")),
        F.slice("w", F.col("p") + 1, length) == F.col("template_words"),
    )
    hits = found.select(
        "doc_id", "row", "n_words", "p", "q", "template", "base", "label", length.alias("length"), diagonal.alias("diagonal"),
        F.when(F.col("template").isNotNull(), F.coalesce(same(1) & same(2), F.lit(False))).alias("verified"),
        F.coalesce(whole, F.lit(False)).alias("whole"),
    ).filter("template is null or verified")
    # Votes per diagonal. A diagonal may pass the same place of a template once only, so votes are distinct pairs.
    voted = hits.groupBy("doc_id", "row", "n_words", "template", "base", "label", "length", "diagonal").agg(
        F.count("template").alias("votes"), F.min("p").alias("low"), F.max("p").alias("high"), F.bool_or("whole").alias("whole")
    )
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    voted = voted.withColumn("fresh", (F.col("diagonal") - F.lag("diagonal").over(line) > NEIGHBOURS).cast("int"))
    voted = voted.withColumn("merged", F.sum(F.coalesce("fresh", F.lit(0))).over(line))
    matches = voted.groupBy("doc_id", "row", "n_words", "template", "base", "label", "length", "merged").agg(
        F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.count_if("whole").alias("places"), F.min(F.when(F.col("whole"), F.col("diagonal"))).alias("first"), F.max(F.when(F.col("whole"), F.col("diagonal"))).alias("last"),
    )
    share = F.when(F.col("template").isNotNull(), F.least(F.lit(1.0), F.col("votes") / (F.col("length") - 1)))
    named = (F.col("places") > 0) | (~F.col("base") & (share >= COVERED))
    distinct = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return matches.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(F.col("base"), F.col("places"))), F.lit(0)).cast("bigint").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("last"))).cast("bigint").alias("last_word"),
        distinct(F.when(F.col("base") & (F.col("places") > 0), F.col("label"))).alias("base_labels"),
        distinct(F.when(named, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(named, share)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(named, F.struct("label", "low", (F.col("high") + 1).alias("high"))))).alias("spans"),
    ).drop("row")
