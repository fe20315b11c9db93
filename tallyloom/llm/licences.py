"""Licence scan by diagonal voting: which notices a text carries, word for word or nearly so.

Templates are short texts with a label.  The hashes of all rolling word K-grams of all texts are joined to the templates'
(those of fewer words vote with all their words at once).  A hit at place p of a text and q of a template votes for diagonal
p - q; votes are counted by (text, template, diagonal), and diagonals that differ by at most the edits allowed are one span.
Spans that have the votes which so many edits must leave (each takes K grams at most) are verified on the words themselves:
edit distance in words between the template and the best part of the text, at most a fifth of the template's words, and the words
that tell a licence from its like (between asterisks) unchanged.  Of spans that overlap the best one stays: higher score, longer,
then by template and place.  Phrases must stand word for word, and each of their places counts.

Words are runs of ASCII digits, letters (A-Z lower-cased) and all characters beyond ASCII.  Null and blank texts have no words.
Equal texts share their votes; null and repeated ids are kept row by row.  Other columns aren't read.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, slices, small, stash, table, text_bytes, text_key

K, SHARE = 3, 0.2
#: Grams of a row that is sent to the join, and bytes that are hashed at a time.
GRAMS, PIECE = 1 << 16, 1 << 20

# Phrases and labels of the contract.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices as the licences' stewards word them, with SPDX names; what is between asterisks must stand.
NOTICES = (
    ("MIT", "Released under the *MIT* *License*."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the *Apache* License, Version *2.0*."),
    ("Apache-2.0", "Licensed under the *Apache* License, Version *2.0* (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU *General* Public License, version *2*."),
    ("GPL-3.0", "This work is licensed under the GNU *General* Public License, version *3*."),
    ("LGPL-2.1", "This work is licensed under the GNU *Lesser* General Public License, version *2.1*."),
    ("LGPL-3.0", "This work is licensed under the GNU *Lesser* General Public License, version *3*."),
    ("AGPL-3.0", "This work is licensed under the GNU *Affero* General Public License, version *3*."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU *General* Public License as published by the Free Software Foundation; either version *2* of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU *General* Public License as published by the Free Software Foundation, either version *3* of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the *Mozilla* Public License, v. *2.0*. If a copy of the *MPL* was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY", "Licensed under *CC* *BY* 4.0."),
    ("CC-BY-SA", "Licensed under *CC* *BY*-*SA* 4.0."),
    ("CC-BY-ND", "Licensed under *CC* *BY*-*ND* 4.0."),
    ("CC-BY-NC", "Licensed under *CC* *BY*-*NC* 4.0."),
    ("CC-BY-NC-SA", "Licensed under *CC* *BY*-*NC*-*SA* 4.0."),
    ("CC-BY-NC-ND", "Licensed under *CC* *BY*-*NC*-*ND* 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons *Attribution* 4.0 International License."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons *Attribution*-*ShareAlike* 4.0 International License."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons *Attribution*-*NonCommercial* 4.0 International License."),
)

_WORD = bytes(i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256))
_ODD, _MIX, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of an odd number, and of its inverse."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((int(_ODD), pow(int(_ODD), -1, 1 << 64))):
            steps = np.full(max(n, PIECE + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word; a long text goes piece by piece, cut between words."""
    plain, out, at = text.translate(_WORD), [], 0
    while at < len(plain):
        end = len(plain) if at + PIECE >= len(plain) else plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        data = np.frombuffer(plain, np.uint8, end - at, at)
        edges = np.flatnonzero(np.diff((data != 0x20).astype(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        out.append((h ^ (h >> np.uint64(31))) * _MIX)
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words; other sizes have other hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = (h ^ words[j : j + n]) * _GRAM
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


class Template:
    """Words of a phrase (whole) or a notice, which of them must stand, the edits allowed and the votes they leave."""

    def __init__(self, label: str, text: str, whole: bool):
        marked = text.encode().translate(bytes(0x2A if i == 0x2A else _WORD[i] for i in range(256))).replace(b"*", b" * ").split()
        self.label, self.whole, self.words, self.must = label, whole, [], []
        inside = False
        for w in marked:
            if w == b"*":
                inside = not inside
                continue
            self.words.append(w)
            self.must.append(inside)
        n = len(self.words)
        self.size = min(K, n)
        self.edits = 0 if whole else int(SHARE * n + 1e-9)
        self.votes = max(1, n - self.size + 1 - self.size * self.edits)


def templates(phrases: tuple = PHRASES, notices: tuple = NOTICES) -> list[Template]:
    return [Template(label, phrase, True) for phrase, label in phrases] + [Template(label, text, False) for label, text in notices]


def gram_rows(docs: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """(k1, k2, p, gram): every rolling gram of every text and its place."""
    k1, k2 = text_key(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            rows, firsts, held = [], [], []
            for i, body in enumerate(text_bytes(batch.column("text"))):
                words = word_hashes(body)
                for size in sizes:
                    grams = gram_hashes(words, size)
                    for a in range(0, len(grams), GRAMS):
                        rows.append(i)
                        firsts.append(a)
                        held.append(grams[a : a + GRAMS])
            at = pa.array(rows, pa.int64())
            ends = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held) if held else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(at), batch.column("k2").take(at), pa.array(firsts, pa.int32()), grams], names=["k1", "k2", "first", "grams"])

    cut = docs.select(k1, k2, F.col(text).alias("text")).mapInArrow(run, "k1 long, k2 long, first int, grams array<long>")
    return cut.select("k1", "k2", "first", F.posexplode("grams").alias("i", "gram")).select("k1", "k2", (F.col("first") + F.col("i")).alias("p"), "gram")


def positions(spark: SparkSession, known: list[Template]) -> DataFrame:
    """(gram, template, q): where each gram stands in the templates."""
    rows = [(int(g), t, q) for t, x in enumerate(known) for q, g in enumerate(gram_hashes(word_hashes(b" ".join(x.words)), x.size))]
    return spark.createDataFrame(rows, "gram long, template int, q int")


def spans_of(docs: DataFrame, text: str, known: list[Template]) -> DataFrame:
    """(k1, k2, template, lo, hi): runs of neighbouring diagonals with enough votes."""
    spark = docs.sparkSession
    hits = gram_rows(docs, text, sorted({t.size for t in known})).join(small(positions(spark, known)), "gram")
    votes = hits.groupBy("k1", "k2", "template", (F.col("p") - F.col("q")).alias("d")).agg(F.collect_set("q").alias("q"))  # a template's places
    rules = small(spark.createDataFrame([(i, t.edits, t.votes) for i, t in enumerate(known)], "template int, edits int, votes int"))
    by = Window.partitionBy("k1", "k2", "template").orderBy("d")
    step = votes.join(rules, "template").withColumn("new", F.coalesce((F.col("d") - F.lag("d").over(by) > F.col("edits")).cast("int"), F.lit(1)))
    runs = step.withColumn("run", F.sum("new").over(by)).withColumn("q", F.explode("q"))
    spans = runs.groupBy("k1", "k2", "template", "run", "votes").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count_distinct("q").alias("n"))
    return spans.where("n >= votes").select("k1", "k2", "template", "lo", "hi")


def best_part(wanted: list[bytes], words: list[bytes]) -> tuple[int, int, int, list[bool]]:
    """(edits, start, end, which wanted words stand) of the part of `words` nearest to `wanted`; ties: the first to end, then the longest."""
    n, m = len(wanted), len(words)
    number = {w: i for i, w in enumerate(dict.fromkeys(wanted))}
    own = np.array([number[w] for w in wanted])
    there = np.array([number.get(w, -1) for w in words], dtype=np.int64)
    rows = np.zeros((n + 1, m + 1), np.int32)
    along = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.empty(m + 1, np.int32)
        row[0] = i
        row[1:] = np.minimum(rows[i - 1, :-1] + (there != own[i - 1]), rows[i - 1, 1:] + 1)
        rows[i] = np.minimum.accumulate(row - along) + along
    j = end = int(rows[n].argmin())
    i, stands = n, [False] * n
    while i:
        if j and rows[i, j] == rows[i - 1, j - 1] + (there[j - 1] != own[i - 1]):
            i, j = i - 1, j - 1
            stands[i] = bool(there[j] == own[i])
        elif rows[i, j] == rows[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return int(rows[n, end]), j, end, stands


def verified(words: list[bytes], spans: list[dict], known: list[Template]) -> list[tuple]:
    """(template, start, end, score) of what a text's spans hold: all places of phrases, the best of notices that overlap."""
    places, notices = [], []
    for s in spans:
        t, lo, hi = known[s["template"]], s["lo"], s["hi"]
        n = len(t.words)
        if t.whole:
            if words[lo : lo + n] == t.words:
                places.append((s["template"], lo, lo + n, 1.0))
            continue
        a = max(0, lo - t.edits)
        edits, start, end, stands = best_part(t.words, words[a : hi + n + t.edits])
        if edits <= t.edits and all(x or not y for x, y in zip(stands, t.must, strict=True)):
            notices.append((s["template"], a + start, a + end, 1 - edits / n))
    taken: list[tuple] = []
    for x in sorted(notices, key=lambda x: (-x[3], x[1] - x[2], x[0], x[1])):
        if all(x[2] <= y[1] or y[2] <= x[1] for y in taken):
            taken.append(x)
    return sorted(places + taken, key=lambda x: (x[1], x[0]))


SPAN = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("whole", T.BooleanType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("whole", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", known: list[Template] | None = None) -> DataFrame:
    """(id, n_words, spans) of every row; spans: label, whole (of a phrase), start and end in words, score."""
    known = templates() if known is None else known
    with scratch():
        found = spans_of(docs, text, known)
        lists = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "lo", "hi")).alias("places"))  # a text's own
        lists = stash(lists, "licence-places", keep=True)
    k1, k2 = text_key(text)
    state = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), k1, k2).join(small(lists), ["k1", "k2"], "left")
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, out = [], []
            for body, places in zip(text_bytes(batch.column("text")), batch.column("places").to_pylist(), strict=True):
                words = words_of(body)
                counts.append(len(words))
                own = verified(words, places, known) if places else ()
                out.append([{"label": known[t].label, "whole": known[t].whole, "start": a, "end": b, "score": s} for t, a, b, s in own])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(out, _SPAN)], names=["id", "n_words", "spans"])

    return state.select("id", "text", "places").mapInArrow(run, schema)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's phrases and the licences that its notices name."""
    rows = scan(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["whole"]))
    said = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        said("base").alias("base_labels"), said("spans").alias("labels"), F.coalesce(F.array_max("spans.score"), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op11_license_scan": (op11_license_scan, None)}
