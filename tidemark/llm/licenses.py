"""Operator 8: license texts found by diagonal voting.

All rolling word 2-grams of a text meet the positions of the same 2-grams in the
license templates (a small fixed table).  A hit votes for the diagonal text
position - template position; neighbouring diagonals, which small insertions and
deletions make, are merged, and parts that a larger one cuts apart add up; what is left is verified by the share of the template
that it covers and by the length of its span.  Phrases vote the same way, and a
diagonal that holds all of a phrase's 2-grams is a place where it stands.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_words, table

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Wordings of licenses and their notices, and the labels they give.
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
        "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses "
        "license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "licensed under cc by sa 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Diagonals this near are merged; share of a template's votes that a match covers at least; words
#: of its span for each word of the template at most; parts of a match, cut apart by inserted or
#: removed passages, whose votes add up when each covers this share at least.
MERGE, COVER, STRETCH, PART = 4, 0.6, 1.6, 0.1


def template_table(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row for each 2-gram: (a, b, template, base, label, pos, votes, words).

    As many rows as the templates have words, a few hundred; a row without a
    template (-1) meets the mark of each text."""
    texts = [(True, label, phrase) for phrase, label in phrases] + [(False, label, text) for label, text in templates]
    given = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(b).alias("base"), F.lit(x).alias("label"), F.split(F.lit(t), " ").alias("w")) for n, (b, x, t) in enumerate(texts)])
    rows = spark.range(1).select(F.explode(given).alias("t")).select("t.*").select("*", F.posexplode("w").alias("pos", "a"))
    rows = rows.withColumn("b", F.get(F.col("w"), F.col("pos") + 1))
    rows = rows.where(F.col("b").isNotNull())
    votes = rows.groupBy("template").agg(F.count("*").cast("int").alias("votes"))
    rows = rows.join(F.broadcast(votes), "template").select("a", "b", "template", "base", "label", "pos", "votes", F.size("w").alias("words"))
    mark = spark.range(1).select(
        F.lit("").alias("a"), F.lit("").alias("b"), F.lit(-1).alias("template"), F.lit(True).alias("base"), F.lit("").alias("label"),
        F.lit(0).alias("pos"), F.lit(0).alias("votes"), F.lit(0).alias("words"),
    )
    return rows.unionByName(mark)


def scan_licenses(df: DataFrame, id_columns: list[str], templates: DataFrame | None = None) -> DataFrame:
    """License findings of every row of ``df`` (``text`` and ``id_columns``).

    Gives ``id_columns``, ``n_words``, ``n_base``, ``first_word``, ``last_word`` long,
    ``base_labels``, ``labels`` string, ``score`` double (the best share of a template
    that is covered) and ``spans`` array<struct<label, first_word, end_word, cover>>.
    Null and empty texts have no words, no labels and the score 0.  Rows with equal ids
    and texts vote together and come out as often as they went in; rows that differ in
    either count one by one, also where ids repeat or are null.  Other columns are dropped.
    """
    templates = F.broadcast(template_table(df.sparkSession)) if templates is None else templates  # a fixed table
    templates = templates.withColumn("gram", F.when(F.col("template") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("a", "b")))
    text = F.coalesce(F.col("text"), F.lit(""))
    # a key of the row's content: the same when a lost task runs again
    ids = {f"_id{i}": F.col(c) for i, c in enumerate(id_columns)}
    read = df.select(*[c.alias(name) for name, c in ids.items()], F.xxhash64(text).alias("_th"), F.crc32(text.cast("binary")).alias("_tc"), ascii_words(F.col("text")).alias("_words"))
    row = [*ids, "_th", "_tc", "n_words"]

    # each word with its successor; after the last word comes an empty one, which no template holds
    after = F.slice(F.concat("_words", F.array(F.lit(""))), 2, F.greatest(F.size("_words"), F.lit(1)))
    pair = F.zip_with("_words", after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    mark = F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b")))  # keeps texts without hits, and counts equal rows
    read = read.withColumn("n_words", F.size("_words").cast("long"))
    grams = read.select(*row, F.posexplode_outer(F.concat(mark, pair)).alias("_at", "_g"))
    grams = grams.select(*row, (F.col("_at") - 1).alias("_i"), F.col("_g.a").alias("_a"), F.col("_g.b").alias("_b"))
    grams = grams.withColumn("_gram", F.when(F.col("_i") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("_a", "_b")))
    hits = grams.join(templates, F.col("_gram") == F.col("gram")).where((F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")))
    kind = ["template", "base", "label", "votes", "words"]
    diagonals = hits.groupBy(*row, *kind, (F.col("_i") - F.col("pos")).alias("diagonal")).agg(
        F.count("*").alias("n"), F.min("_i").alias("low"), (F.max("_i") + 2).alias("high")
    )
    whole = Window.partitionBy(*row)
    diagonals = diagonals.withColumn("_times", F.max(F.when(F.col("template") < 0, F.col("n"))).over(whole))
    diagonals = diagonals.withColumn("n", F.expr("n div _times"))
    along = Window.partitionBy(*row, "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > MERGE, F.lit(True)) | F.col("base")
    merged = diagonals.withColumn("cluster", F.sum(fresh.cast("int")).over(along))
    merged = merged.groupBy(*row, "_times", *kind, "cluster").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("diagonal")
    )
    # a passage inserted into a license or removed from it cuts its diagonal: parts that follow each other add up
    part = ~F.col("base") & (F.col("template") >= 0) & (F.col("n") >= PART * F.col("votes")) & (F.col("high") - F.col("low") <= STRETCH * F.col("words"))
    follows = Window.partitionBy(*row, "template", part).orderBy("low", "high", "cluster")
    near = (F.col("low") - F.lag("high").over(follows) <= F.col("words")) & (F.lag("n").over(follows) < F.col("votes") * COVER) & (F.col("n") < F.col("votes") * COVER)
    near = part & F.coalesce(near, F.lit(False))
    merged = merged.withColumn("_chain", F.sum((~near).cast("int")).over(follows)).withColumn("_part", part)
    merged = merged.groupBy(*row, "_times", *kind, "_part", "_chain").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("diagonal"), F.count("*").alias("parts")
    )
    cover = F.least(F.lit(1.0), F.col("n") / F.col("votes"))
    good = F.when(F.col("template") < 0, False).when(F.col("base"), F.col("n") == F.col("votes"))
    good = good.otherwise((cover >= COVER) & (F.col("high") - F.col("low") <= (STRETCH + F.when(F.col("parts") > 1, 1.0).otherwise(0.0)) * F.col("words")))
    found = merged.withColumn("cover", F.when(F.col("template") >= 0, F.when(good, cover).otherwise(cover * 0.5))).withColumn("good", good)
    place = F.when(F.col("good") & F.col("base"), F.col("diagonal").cast("long"))
    span = F.when(F.col("good"), F.struct("label", F.col("low").alias("first_word"), F.col("high").alias("end_word"), "cover"))
    out = found.groupBy(*row, "_times").agg(
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("good") & F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("good"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    )
    given = [F.col(name).alias(c) for name, c in zip(ids, id_columns, strict=True)]
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    return out.select(*given, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License findings of every document."""
    out = scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
