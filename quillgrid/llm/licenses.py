"""License scan by diagonal voting.

Words are runs of digits, letters and characters beyond ASCII, ASCII letters lower-cased. Every rolling word k-gram of
every text is hashed, with k the smaller of ``K`` and a template's words, and joined to the positions of the
same hash in the templates. A match votes for a diagonal: word position less template position. Votes are summed by
diagonal; neighbouring diagonals, at most ``MERGE`` apart, are merged, so that inserted or missing words do not break a
span; a merged span is verified by the share of the template's positions that it holds and by its length.

The phrase templates are the base: they are a single k-gram each, so every vote is one exact place. Longer templates add
labels of their own, or confirm base labels in edited notices.

Null texts count as empty: no words, places or labels, score 0. Repeated rows are scanned alike; a row keeps its own
number, so equal keys do not mix. An empty table gives no rows. The template list is a parameter; its size does not
depend on the data. Map tasks drop hashes that no template has, before the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.textbatch import ALNUM_LOWER, Words, slices, text_of
from quillgrid.session import stored

K = 4
MERGE = 3
COVERAGE = 0.5

#: Phrases of the base with their labels; fixed values.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Opening words of public licenses and their usual notices; fixed values.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights", "cc0"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("all rights reserved", "all-rights-reserved"),
]

_FILTER_BITS = 20
_HITS = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("at", T.ArrayType(T.LongType())),
        T.StructField("gram", T.ArrayType(T.LongType())),
    ]
)


def template_grams(templates: list[tuple[str, str, bool]]) -> list[tuple[int, int, int, str, bool, int]]:
    """A row per template position: hash, template, position, label, base, number of positions."""
    rows = []
    for number, (text, label, base) in enumerate(templates):
        data = np.frombuffer(text.encode(), np.uint8)
        w = Words(data, np.array([0, len(data)]), ALNUM_LOWER, lower=True)
        grams, _ = w.grams(min(K, len(w.hash)))
        rows += [(int(h), number, at, label, base, len(grams)) for at, h in enumerate(grams.view(np.int64).tolist())]
    return rows


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per document: key, counts, first and last base place, base labels, all labels, and the best coverage."""
    spark = docs.sparkSession
    rows = template_grams([*[(t, x, True) for t, x in phrases], *[(t, x, False) for t, x in notices]])
    lengths = sorted({min(K, len(t.split())) for t, _ in [*phrases, *notices]})
    known = np.unique(np.array([r[0] for r in rows], np.int64).view(np.uint64))

    def find(batches):
        part, number = TaskContext.get().partitionId(), 0
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[(known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        for s in slices(batches, "text"):
            w = Words(*text_of(s.column("text")), ALNUM_LOWER, lower=True)
            places, hashes = [], []
            for k in lengths:
                h, at = w.grams(k)
                hit = np.flatnonzero(maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                hit = hit[np.isin(h[hit], known)]
                places.append(at[hit])
                hashes.append(h[hit])
            at, h = np.concatenate(places), np.concatenate(hashes).view(np.int64)
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
            cut = np.searchsorted(w.row[at], np.arange(s.num_rows + 1)).astype(np.int32)
            first = np.searchsorted(w.row, np.arange(s.num_rows))
            inside = at - first[w.row[at]]
            ids = pa.array((np.int64(part) << 33) + number + np.arange(s.num_rows))
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x, pa.int64())) for x in (inside, h)]
            yield pa.RecordBatch.from_arrays([ids, s.column("key"), pa.array(w.count.astype(np.int64)), *lists], _HITS.names)
            number += s.num_rows

    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    # Stored: the rows are needed for the votes and again for the result, and their numbers must not change between.
    found = stored(plain.mapInArrow(find, _HITS))
    grams = F.broadcast(spark.createDataFrame(rows, "gram bigint, template int, position int, label string, base boolean, positions int"))
    hits = found.where(F.size("at") > 0).select("row", F.explode(F.arrays_zip("at", "gram")).alias("hit")).select("row", "hit.at", "hit.gram").join(grams, "gram")
    votes = hits.groupBy("row", "template", "label", "base", "positions", (F.col("at") - F.col("position")).alias("diagonal")).agg(
        F.collect_set("position").alias("held"), F.min("at").alias("low"), F.max("at").alias("high")
    )
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    # A phrase of one k-gram has no neighbours: each of its diagonals is a place.
    opens = (F.col("positions") == 1) | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > MERGE, F.lit(True))
    votes = votes.withColumn("span", F.sum(opens.cast("int")).over(by_diagonal))
    spans = votes.groupBy("row", "template", "label", "base", "positions", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    share = F.col("held") / F.col("positions")
    tight = F.col("high") - F.col("low") < 1.5 * F.col("positions") + MERGE
    verified = spans.withColumn("share", share).where((F.col("share") >= COVERAGE) & tight)
    place = F.when(F.col("base"), F.col("low"))
    result = verified.groupBy("row").agg(
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    whole = found.select("row", "key", "n_words").join(result, "row", "left")
    return whole.select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"),
        F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
