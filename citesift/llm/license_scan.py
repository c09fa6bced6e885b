"""License passages: exact phrases, and templates found by diagonal voting.

Each text's words are rolled into k-grams, hashed and joined to the positions of
the same grams in the templates. A meeting votes for its diagonal, the offset
between document and template. Neighbouring diagonals (words added or left out)
are merged per document and template; of what they reach, the window of the
template's length at the strongest diagonal is verified: the share of distinct
template grams in it, against the longer of template and window, must reach
``MIN_COVER``, so echoes of its phrases elsewhere don't hide a notice. Where spans of several templates lie on the same words, the
one with the best cover is taken: one notice has one licence.

The templates are a fixed list of short notices, so their grams are broadcast.
Only matching grams are shuffled.

Null and empty texts have no words, places or labels. Documents are told apart
by id and text, null ids too; repeated rows each get their result; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citesift.llm.common import ROW_KEY, keyed, words
from citesift.session import durable

GRAM = 3
# Diagonals this close belong to one span.
NEIGHBOURS = 4
MIN_COVER = 0.6

# Fixed by the contract: phrase and label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Label and words of well-known public notices.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files the software to deal in the software without restriction including without limitation the"
     " rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial"
     " portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in"
     " compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
     " the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
     " granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
     " public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser"
     " general public license as published by the free software foundation"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero"
     " general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was"
     " not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify"
     " publish use compile sell or distribute this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held"
     " liable for any damages arising from the use of this software"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international"
     " license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0"
     " international license"),
)


def _gram(array: str, at: Column, k: int = GRAM) -> Column:
    return F.xxhash64(*(F.get(F.col(array), at + j) for j in range(k)))


def _listed(spark: SparkSession, texts) -> DataFrame:
    """``label, ws`` of a fixed list of texts, each with its number."""
    rows = F.array(*(F.struct(F.lit(i).alias("no"), F.lit(a).alias("label"), F.lit(b).alias("t")) for i, (a, b) in enumerate(texts)))
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.no", "r.label", words(F.col("r.t")).alias("tw"))


def template_grams(spark: SparkSession, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """``gram, no, label, at, size, phrase``: template grams, and each phrase by its first gram."""
    rows = _listed(spark, templates)
    rows = rows.select("no", "label", "tw", F.posexplode(F.slice("tw", 1, F.size("tw") - GRAM + 1)).alias("at", "w"))
    grams = rows.select(
        _gram("tw", F.col("at")).alias("gram"),
        "no",
        "label",
        "at",
        (F.size("tw") - GRAM + 1).alias("size"),
        F.lit(None).cast("array<string>").alias("phrase"),
    )
    first = _listed(spark, [(label, phrase) for phrase, label in phrases]).select(
        _gram("tw", F.lit(0)).alias("gram"),
        (-1 - F.col("no")).alias("no"),
        "label",
        F.lit(0).alias("at"),
        F.lit(1).alias("size"),
        F.col("tw").alias("phrase"),
    )
    return grams.unionAll(first)


def meetings(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """``_id, _tk, pos, no, label, at, size, is_phrase``: document positions that meet a gram."""
    rows = keyed(docs, words(F.col("text")).alias("ws")).select(*ROW_KEY, "ws", F.posexplode("ws").alias("pos", "w"))
    rows = rows.filter(F.col("pos") <= F.size("ws") - GRAM).withColumn("gram", _gram("ws", F.col("pos")))
    # The lists are arguments of this function, a few hundred grams.
    found = rows.join(F.broadcast(template_grams(docs.sparkSession, templates, phrases)), "gram")
    exact = F.slice("ws", F.col("pos") + 1, F.size("phrase")) == F.col("phrase")
    return found.filter(F.col("phrase").isNull() | exact).select(
        *ROW_KEY, "pos", "no", "label", "at", "size", F.col("phrase").isNotNull().alias("is_phrase")
    )


def spans(met: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """``_id, _tk, no, label, first, last, found, cover`` of the verified template spans."""
    votes = met.filter(~F.col("is_phrase")).withColumn("diagonal", F.col("pos") - F.col("at"))
    diagonals = votes.groupBy(*ROW_KEY, "no", "label", "size", "diagonal").agg(F.collect_set("at").alias("ats"))
    # Within one document and template, so a window holds no more than a document's words.
    along = Window.partitionBy(*ROW_KEY, "no").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    starts = diagonals.withColumn("new", F.when(gap <= NEIGHBOURS, 0).otherwise(1))
    votes_of = F.struct(F.size("ats").alias("n"), (-F.col("diagonal")).alias("earlier"))
    merged = (
        starts.withColumn("span", F.sum("new").over(along))
        .groupBy(*ROW_KEY, "no", "label", "size", "span")
        .agg(F.max_by("diagonal", votes_of).alias("best"), F.collect_list(F.struct("diagonal", "ats")).alias("voters"))
    )
    # Echoes of a template's phrases can chain many diagonals: what counts is the window of
    # the template's length where the strongest one lies, not all that the chain reaches.
    low, high = F.col("best") - NEIGHBOURS, F.col("best") + F.col("size") - 1 + NEIGHBOURS
    met_inside = F.flatten(
        F.transform(
            "voters",
            lambda v: F.filter(
                F.transform(v["ats"], lambda at: F.struct((v["diagonal"] + at).alias("pos"), at.alias("at"))),
                lambda m: (m["pos"] >= low) & (m["pos"] <= high),
            ),
        )
    )
    windows = merged.withColumn("inside", met_inside).select(
        *ROW_KEY,
        "no",
        "label",
        "size",
        "span",
        F.array_min(F.transform("inside", lambda m: m["pos"])).alias("first"),
        F.array_max(F.transform("inside", lambda m: m["pos"])).alias("last"),
        F.size(F.array_distinct(F.transform("inside", lambda m: m["at"]))).alias("found"),
    )
    length = F.greatest("size", F.col("last") - F.col("first") + 1)
    return windows.withColumn("cover", F.col("found") / length).filter(F.col("cover") >= min_cover)


def best_spans(found: DataFrame) -> DataFrame:
    """``_id, _tk, label, cover``: ``spans`` from the best on, without those that mostly lie on a taken one."""
    # Runs of spans that touch; within one document.
    along = Window.partitionBy(*ROW_KEY).orderBy("first", "last", "no", "span")
    before = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    starts = found.withColumn("new", F.when(before >= F.col("first"), 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("cover")).alias("worse"), (-F.col("found")).alias("fewer"), "no", "first", "last", "label", "cover"))
    )
    length = lambda x: x["last"] - x["first"] + 1
    common = lambda x, y: F.least(x["last"], y["last"]) - F.greatest(x["first"], y["first"]) + 1
    covered = lambda x, taken: F.exists(taken, lambda y: 2 * common(x, y) > F.least(length(x), length(y)))
    taken = F.aggregate(
        "ordered",
        F.slice("ordered", 1, 0),
        lambda taken, x: F.when(covered(x, taken), taken).otherwise(F.concat(taken, F.array(x))),
    )
    runs = runs.groupBy(*ROW_KEY, "run").agg(ordered.alias("ordered"))
    return runs.select(*ROW_KEY, F.explode(taken).alias("s")).select(*ROW_KEY, "s.label", "s.cover")


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """``_id, _tk, n_base, first_word, last_word, base_labels, labels, score`` of documents with any label."""
    # Read twice; only matching grams are in it.
    met = durable(meetings(docs, templates, phrases), "license-meetings")
    base = met.filter("is_phrase").select(*ROW_KEY, "label", "pos", F.lit(1.0).alias("cover"), F.lit(1).alias("base"))
    # A repeated row meets everything again.
    base = base.distinct()
    more = best_spans(spans(met)).select(*ROW_KEY, "label", F.lit(None).cast("int").alias("pos"), "cover", F.lit(0).alias("base"))
    is_base = F.col("base") == 1
    return base.unionAll(more).groupBy(*ROW_KEY).agg(
        F.sum("base").alias("n_base"),
        F.min("pos").cast("long").alias("first_word"),
        F.max("pos").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
