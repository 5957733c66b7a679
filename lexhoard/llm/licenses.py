"""License scans by diagonal voting, in DataFrame operations only.

Every rolling 3-word hash of a text is joined to the positions of the same hash in the license templates. A match at word p of
the text and word t of a template votes for the diagonal p - t. A template that stands in the text whole and unchanged puts
all its votes on one diagonal; words put in or left out spread them over neighbouring diagonals, which are merged. Merged spans are verified: their hashes must follow the template in order.
The templates are a table of fixed size shipped with the code, so that table is the broadcast side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexhoard.llm.base import NOT_WORD, documents, keyed

#: Words in a rolling hash; the shortest template has as many.
K = 3
#: Diagonals at most this far apart belong to one occurrence.
MERGE_GAP = 3
#: Share of a long template's hashes that must be found, each once and in the template's order.
MIN_COVERAGE = 0.6
#: Words that tell a notice from a like one, and must be among the words found.
KEY_WORDS = {"lgpl": "lesser", "cc-by-nc": "noncommercial", "cc-by-sa": "sharealike"}

#: Phrases that must stand word by word, and their labels.
BASE_PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Opening sentences of public license notices, found with small changes too.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]


def template_grams(spark: SparkSession, base=BASE_PHRASES, notices=NOTICES) -> DataFrame:
    """(h, w0, w1, w2, tid, tpos): every 3-word hash of every template."""
    rows = []
    for tid, (_, phrase) in enumerate([*base, *notices]):
        words = phrase.split()
        rows += [(tid, i, *words[i : i + K]) for i in range(len(words) - K + 1)]
    values = ", ".join(f"({t}, {i}, '{a}', '{b}', '{c}')" for t, i, a, b, c in rows)
    return spark.sql(f"SELECT xxhash64(w0, w1, w2) AS th, tid, tpos FROM VALUES {values} AS t(tid, tpos, w0, w1, w2)")


def words_of(text: Column) -> Column:
    """Words in lower case. Lower-casing the kelvin sign would make an ASCII k of it, so another letter stands in for it:
    template words are ASCII, and a word with a letter from beyond ASCII equals none of them."""
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")))
    return F.array_remove(F.split(lower, NOT_WORD), "")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE_PHRASES, notices=NOTICES) -> DataFrame:
    """(doc_id, n_words, spans): one row per input row.

    spans: array of (label, base, first_word, coverage), sorted; base spans are places where a phrase of `base` stands word by
    word, the others are verified: merged diagonals that hold, in the template's order and each counted once, at least
    MIN_COVERAGE of the hashes of a notice and its key word. Of overlapping ones only the best stays (by key word, then by hashes
    found, then by coverage); equally good ones stay together. Null and empty texts have no
    words and no spans. Repeated rows come out as often as they came in.
    Hashes have 64 bits: over 10**12 words the chance of any false vote is about 1 in 10**5, and a span needs all or most of its votes.
    """
    spark = docs.sparkSession
    templates = [*base, *notices]
    label = F.element_at(F.array(*[F.lit(x) for x, _ in templates]), F.col("tid") + 1)
    grams = F.element_at(F.array(*[F.lit(len(p.split()) - K + 1) for _, p in templates]), F.col("tid") + 1)

    texts = keyed(docs, id_col, text_col).select("doc_id", "k", words_of(F.col("text")).alias("words"))
    hashes = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    # Place 0 stands for the document itself, so that documents without a match stay; word i is at place i + 1.
    texts = texts.select("doc_id", "k", F.size("words").cast("long").alias("n_words"), F.concat(F.array(F.lit(0).cast("long")), hashes).alias("hashes"))
    # The outer form, though hashes are never empty: for the other one Spark infers a filter on their number and computes them twice.
    places = texts.select("doc_id", "k", "n_words", F.posexplode_outer("hashes").alias("p", "h"))
    votes = (
        places.join(F.broadcast(template_grams(spark, base, notices)), (F.col("h") == F.col("th")) & (F.col("p") > 0), "left")
        .where("p = 0 or tid is not null")
        .select("doc_id", "k", "n_words", "tid", "tpos", (F.col("p") - 1 - F.col("tpos")).alias("diagonal"))
    )
    # One exchange by document serves the count of votes, the merging and the collection.
    by_doc = Window.partitionBy("doc_id", "k")
    line = Window.partitionBy("doc_id", "k", "tid").orderBy("diagonal")
    diagonals = (
        votes.repartition("doc_id", "k")
        .groupBy("doc_id", "k", "tid", "diagonal")
        .agg(F.count("*").alias("votes"), F.max("n_words").alias("n_words"), F.collect_set("tpos").alias("places"))
        .withColumn("copies", F.max(F.when(F.col("tid").isNull(), F.col("votes"))).over(by_doc))
        .withColumn("votes", F.col("votes") / F.col("copies"))
        .withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= MERGE_GAP, 0).otherwise(1))
        .withColumn("run", F.when(F.col("tid") < len(base), F.col("diagonal")).otherwise(F.sum("new").over(line)))
    )
    # Where the hashes of a run stand: by place in the text, and at one place the later template place first, so that no two
    # hashes at one place follow each other.
    hits = F.flatten(F.collect_list(F.transform("places", lambda t: F.struct((F.col("diagonal") + t).alias("p"), (-t).alias("t")))))
    spans = diagonals.groupBy("doc_id", "k", "tid", "run").agg(
        F.least(F.sum("votes") / F.max(grams), F.lit(1.0)).alias("coverage"),
        F.min("diagonal").alias("first_word"),
        F.max("n_words").alias("n_words"),
        F.max("copies").alias("copies"),
        F.array_sort(hits).alias("hits"),
    )
    is_base = F.col("tid") < len(base)
    keys = [KEY_WORDS.get(x) if i >= len(base) else None for i, (x, _) in enumerate(templates)]
    key_at = F.element_at(F.array(*[F.lit(p.split().index(w) if w in p.split() else None).cast("int") for (_, p), w in zip(templates, keys, strict=True)]), F.col("tid") + 1)
    # longest[t]: hashes of the longest row of template places that rises with the text and ends at t.
    none = F.array_repeat(F.lit(0), grams)
    longest = F.aggregate("hits", none, lambda rows, x: F.transform(rows, lambda n, i: F.when(i == -x["t"], F.greatest(n, 1 + F.coalesce(F.array_max(F.slice(rows, 1, i)), F.lit(0)))).otherwise(n)))
    distinct = F.size(F.array_distinct(F.transform("hits", lambda x: x["t"])))
    # Few runs hold enough places, and only those are compared in order.
    in_order = F.when(~is_base & (distinct >= MIN_COVERAGE * grams), F.array_max(longest)).otherwise(F.lit(0))
    keyed_ = key_at.isNull() | F.exists("hits", lambda x: (-x["t"] <= key_at) & (key_at < K - x["t"]))
    spans = spans.withColumn("in_order", in_order).withColumn("coverage", F.when(is_base, F.col("coverage")).otherwise(F.col("in_order") / grams))
    found = F.when(
        F.when(is_base, F.col("coverage") >= 1).otherwise((F.col("coverage") >= MIN_COVERAGE) & keyed_),
        F.struct(
            F.struct(key_at.isNotNull().alias("key"), "in_order", "coverage").alias("rank"),
            F.struct(label.alias("label"), is_base.alias("base"), F.greatest("first_word", F.lit(0)).cast("long").alias("first_word"), "coverage").alias("span"),
            F.element_at("hits", 1)["p"].alias("start"),
            (F.element_at("hits", -1)["p"] + K).alias("end"),
        ),
    )
    given = F.filter("found", lambda x: x["span"]["base"])
    best_first = F.reverse(F.array_sort(F.filter("found", lambda x: ~x["span"]["base"])))
    beaten = lambda x, kept: F.exists(kept, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & (y["rank"] > x["rank"]))
    kept = F.aggregate(best_first, F.slice("found", 1, 0), lambda kept, x: F.when(beaten(x, kept), kept).otherwise(F.concat(kept, F.array(x))))
    return (
        spans.groupBy("doc_id", "k")
        .agg(F.max("n_words").alias("n_words"), F.collect_list(found).alias("found"), F.max("copies").alias("copies"))
        .withColumn("spans", F.array_sort(F.transform(F.concat(given, kept), lambda x: x["span"])))
        .select("doc_id", "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .drop("copy")
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all `documents`."""
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scan_licenses(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
