"""License scans by diagonal voting: word-gram hits of fixed statements, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediasift.llm.common import LICENSE_GAP, non_empty


@dataclass(frozen=True)
class Template:
    """A statement; ``exact`` ones count every place where all words stand consecutively."""

    label: str
    words: str
    exact: bool = False


# Base phrases, and opening statements of well-known public licenses.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("mit", "released under the mit license"),
    Template("mit", "licensed under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def license_scan(df: DataFrame, ident: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, slack: int = 2, cover: float = 0.8) -> DataFrame:
    """One row per row of ``df``: ``ident, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    All rolling word 2-gram hashes of all texts are joined to the template positions (a fixed
    table of a few hundred rows). Hits vote for their diagonal (place in the text minus place in
    the template); a diagonal keeps a bit per template place, so votes are idempotent and
    combine before the shuffle. Neighbouring diagonals at most ``slack`` apart merge, which
    bridges inserted or missing words. Spans are verified: an exact template needs every bit of
    one diagonal; another needs ``cover`` of its grams inside a span of at most 1.5 times its
    length. ``score`` is the best verified coverage, 0 without one. Hashes have 64 bits.

    Null and empty texts have zero words, empty labels and null places. Repeated rows come back
    as often as they went in; overlapping places all count; other columns are ignored; an empty
    table gives an empty table.
    """
    rows, lengths = [], {}
    for k, t in enumerate(templates):
        w = t.words.split()
        if not 2 <= len(w) <= 64:
            raise ValueError("a template has 2 to 64 words")
        lengths[k] = len(w)
        rows += [(k, i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    spark = df.sparkSession
    grams = spark.createDataFrame(rows, "k int, at int, a string, b string").select(F.xxhash64("a", "b").alias("_g"), F.struct("k", "at").alias("_hit"))
    facts = spark.createDataFrame([(k, t.label, t.exact, lengths[k]) for k, t in enumerate(templates)], "k int, label string, exact boolean, len int")

    c = F.col
    low = F.lower(F.coalesce(c(text), F.lit("")))
    d = df.select(c(ident).alias("_id"), F.xxhash64(F.coalesce(c(text), F.lit(""))).alias("_h"), non_empty(F.split(low, LICENSE_GAP)).alias("_w"))
    d = d.select("_id", "_h", "_w", F.size("_w").alias("_n"))
    hashes = F.when(c("_n") >= 2, F.expr("transform(sequence(0, _n - 2), i -> xxhash64(_w[i], _w[i + 1]))")).otherwise(F.array().cast("array<bigint>"))
    d = d.select("_id", "_h", "_n", F.concat(F.array(F.lit(None).cast("bigint")), hashes).alias("_gs"))
    # outer: the optimizer then adds no size filter that would split the text again; place 0 is a row without a gram that stands for the text itself
    d = d.select("_id", "_h", "_n", F.posexplode_outer("_gs").alias("_i", "_g"))
    hit = d.join(F.broadcast(grams), "_g", "left").filter(c("_hit").isNotNull() | (c("_i") == 0))
    hit = hit.select("_id", "_h", "_n", (c("_i") - 1).alias("_i"), c("_hit.k").alias("k"), c("_hit.at").alias("at"))

    diag = hit.groupBy("_id", "_h", "k", (c("_i") - c("at")).alias("_d")).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("_bits"), F.min("_i").alias("_lo"), F.max("_i").alias("_hi"),
        F.max("_n").alias("_n"), F.sum(c("k").isNull().cast("int")).alias("_copies"))
    diag = diag.repartition("_id", "_h").join(F.broadcast(facts), "k", "left")
    by = Window.partitionBy("_id", "_h", "k").orderBy("_d")
    diag = diag.withColumn("_new", F.coalesce(c("_d") - F.lag("_d").over(by) > slack, F.lit(True)).cast("int"))
    diag = diag.withColumn("_run", F.sum("_new").over(by))
    full = c("exact") & (F.bit_count("_bits") == c("len") - 1)
    run = diag.groupBy("_id", "_h", "k", "_run", "label", "exact", "len").agg(
        F.bit_count(F.bit_or("_bits")).alias("_votes"), F.max(F.bit_count("_bits")).alias("_one"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
        F.sum(F.when(full, 1).otherwise(0)).alias("_places"), F.min(F.when(full, c("_d"))).alias("_first"), F.max(F.when(full, c("_d"))).alias("_last"),
        F.max("_n").alias("_n"), F.sum("_copies").alias("_copies"))
    merged = F.when(c("_hi") - c("_lo") + 2 <= 1.5 * c("len"), c("_votes")).otherwise(c("_one")) / (c("len") - 1)
    got = F.when(c("exact"), F.when(c("_places") > 0, F.lit(1.0))).otherwise(F.when(merged >= cover, merged))
    run = run.withColumn("_score", got)
    out = run.groupBy("_id", "_h").agg(
        F.max(F.when(c("k").isNull(), c("_n"))).alias("n_words"), F.max("_copies").alias("_copies"), F.sum("_places").alias("n_base"), F.min("_first").alias("first_word"), F.max("_last").alias("last_word"),
        F.collect_set(F.when(c("_places") > 0, c("label"))).alias("_base"), F.collect_set(F.when(c("_score").isNotNull(), c("label"))).alias("_all"), F.coalesce(F.max("_score"), F.lit(0.0)).alias("score"))
    out = out.select("*", F.explode(F.array_repeat(F.lit(1), c("_copies").cast("int"))).alias("_copy"))
    joined = lambda x: F.array_join(F.sort_array(x), ",")
    return out.select(c("_id").alias(ident), c("n_words").cast("long").alias("n_words"), "n_base", c("first_word").cast("long").alias("first_word"), c("last_word").cast("long").alias("last_word"), joined("_base").alias("base_labels"), joined("_all").alias("labels"), "score")
