"""Licence scan against plain word-by-word search, and notices with edits."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import licences

SCHEMA = "doc_id long, text string, k1 string, spans string, template string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    words, places, labels = plain_words(text), [], set()
    for phrase, label in licences.PHRASES:
        own = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def filler(rnd, n):
    return " ".join(rnd.choice(["the", "of", "License", "cc", "by", "é", "this", "software", "under", "MIT", "42", "GNU", "General"]) for _ in range(n))


def texts():
    rnd = random.Random(8)
    out = [None, "", " \n", "cc by", "CC-BY", "cc_by", "ccby", "Mit License", "MIT licence", "İcc by", "cc by cc by mit license apache license GNU general\npublic-license"]
    out += [filler(rnd, n) for n in (5, 50, 400, 30_000)]
    out += ["cc by " * 3000, "x" * 2_200_000 + " cc by", ("word " * 250_000 + "MIT License ") * 2]
    return out + out[3:6] + [out[10]] * 50


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 9 else None, t, "clash", "clash", "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_base_places(docs):
    rows = licences.scan(docs).withColumn("base", F.filter("spans", lambda s: s["whole"]))
    got = Counter()
    for r in rows.collect():
        starts = [s["start"] for s in r["base"]]
        got[r["id"], r["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({s["label"] for s in r["base"]}))] += 1
    assert got == Counter((i if i % 9 else None, *plain_base(t)) for i, t in enumerate(texts()))


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(filler(random.Random(3), 400).split()).encode()
    whole = licences.word_hashes(text)
    assert len(whole) == len(licences.words_of(text)) and len(set(whole.tolist())) == len(set(licences.words_of(text)))
    monkeypatch.setattr(licences, "PIECE", 50)
    assert (licences.word_hashes(text) == whole).all()
    assert (licences.gram_hashes(whole, 2)[:100] != licences.gram_hashes(whole[:101], 3)[:99][0]).all()


def plain_edits(wanted, words):
    """Least edits between the wanted words and any part of the words."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(wanted, 1):
        new = [i]
        for j, v in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rnd.randrange(len(words))
        words[i : i + 1] = rnd.choice([[], ["changed"], [words[i], "put"]])
    return words


def test_notices_with_edits(spark):
    """What lies within the edits allowed is found, and only that: every template, several edits, between other words."""
    rnd, known, rows, want = random.Random(6), licences.templates(), [], {}
    notices = [t for t in known if not t.whole]
    for t in notices:
        for edits in range(t.edits + 3):
            words = [w.decode() for w in t.words]
            body = words[:]
            while True:
                body = edited(rnd, words, edits)
                if all(m.decode() in body for m, x in zip(t.words, t.must, strict=True) if x):
                    break
            text = ["zz"] * rnd.randrange(30) + body + ["yy"] * rnd.randrange(30)
            want[len(rows)] = (t.label, t, text)
            rows.append((len(rows), " ".join(text)))
    found = {r["id"]: r["spans"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, (label, t, text) in want.items():
        least = plain_edits([w.decode() for w in t.words], text)
        own = [s for s in found[i] if not s["whole"]]
        for s in own:
            near = [x for x in notices if x.label == s["label"] and round(1 - plain_edits([w.decode() for w in x.words], text[s["start"] : s["end"]]) / len(x.words), 9) >= round(s["score"], 9) >= 1 - licences.SHARE]
            assert near, (text, s)
        if least == 0 or (least <= t.edits and not any(t.must)):
            assert label in {s["label"] for s in own}, (text, own)


def test_best_part():
    rnd = np.random.default_rng(4)
    for _ in range(200):
        wanted = [b"%d" % x for x in rnd.integers(0, 5, rnd.integers(1, 9))]
        words = [b"%d" % x for x in rnd.integers(0, 5, rnd.integers(0, 20))]
        edits, start, end, stands = licences.best_part(wanted, words)
        assert edits == plain_edits(wanted, words) == plain_edits(wanted, words[start:end])
        assert sum(stands) >= len(wanted) - edits


def test_like_licences_are_told_apart(spark):
    cases = [("Licensed under CC BY-NC 4.0.", "CC-BY-NC,cc-by"), ("Licensed under CC BY-NC-SA 4.0!", "CC-BY-NC-SA,cc-by"), ("licensed under CC BY 3.0", "CC-BY,cc-by"), ("Released under the BSD License.", ""),
             ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0,gpl"), ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"), ("Used under the Apache License, version 2.0", "Apache-2.0,apache"), ("released under the MIT license", "MIT,mit")]
    docs = spark.createDataFrame(list(enumerate("so " * i + c[0] + " so" * i for i, c in enumerate(cases))), "doc_id long, text string")
    got = {r["id"]: ",".join(sorted({s["label"] for s in r["spans"]})) for r in licences.scan(docs).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_empty_and_given_tables(spark, docs):
    assert licences.scan(docs.limit(0)).count() == 0
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = licences.op11_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((r["doc_id"], *plain_base(r["text"])) for r in rows)
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and (r["score"] == 0) == (r["labels"] == "") for r in got)
    assert {r["labels"] for r in got} == {"", "CC-BY-NC,cc-by", "MIT,mit", "Apache-2.0,apache", "GPL-3.0,gpl"}
