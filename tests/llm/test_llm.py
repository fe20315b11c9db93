"""Operators of the training-data pipeline against brute force, on small tables with nulls, empties, ties, repeats and long texts."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyloom.llm import decontaminate, lines, lm, mixing, phrases, quality, simhash, suffixes, tokens, warc, windows
from tallyloom.llm.common import connected_components, new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "Zeta", "eta,", "théta", "iota.", "kappa", "x|y"]


def prose(rnd, n, per_line=9):
    return "\n".join(" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 60)) * (rnd.random() < 0.4) for _ in range(min(per_line, n - i))) for i in range(0, n, per_line))


def corpus():
    rnd = random.Random(5)
    passage, block = prose(rnd, 70), prose(rnd, 40, 5)
    texts = [None, "", " \t\n", "word", "a b", "\n\nline\n\n"]
    texts += [prose(rnd, n) for n in (5, 34, 35, 36, 120, 300)]
    texts += [prose(rnd, 50) + "\n" + passage + "\n" + prose(rnd, 50) for _ in range(4)]
    texts += [prose(rnd, 8) + "\n" + block + "\n" + prose(rnd, 20) for _ in range(3)]
    texts += [texts[11], texts[11], texts[12], "ab " * 700, "q" * 1500, prose(rnd, 12_000)]
    near = texts[11].split(" ")
    near[7] = "other"
    texts.append(" ".join(near))
    rows = [(i, t, "en", ["s1", "s2", "s3", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[10], (None, texts[10], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# ---- repeated windows


def without(units, size):
    """Whether each unit is covered by a window that starts elsewhere too, over all texts."""
    seen = Counter(tuple(u[i : i + size]) for u in units for i in range(len(u) - size + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - size + 1):
            if seen[tuple(u[i : i + size])] > 1:
                gone[i : i + size] = True
        out.append(gone)
    return out


def test_phrases(docs, empty):
    rows = docs.collect()
    words = [(r["text"] or "").encode().split() for r in rows]
    want = Counter()
    for r, w, g in zip(rows, words, without(words, 35), strict=True):
        rest = b" ".join(x for x, y in zip(w, g, strict=True) if not y)
        want[r["doc_id"], len(w), int(g.sum()), hashlib.sha256(rest).hexdigest()] += 1
    assert bag(phrases.remove_phrases(docs), "id", "n_words", "n_removed", "kept_sha256") == want
    assert phrases.remove_phrases(empty).count() == 0


@pytest.mark.parametrize("batches", [1, 3])
def test_suffixes(docs, batches):
    rows = [r for r in docs.collect() if len(r["text"] or "") < 20_000]
    few = docs.where("text IS NULL OR length(text) < 20000")
    texts = [(r["text"] or "").encode() for r in rows]
    want = Counter()
    for r, t, g in zip(rows, texts, without(texts, 60), strict=True):
        spans = int(g[0:1].sum()) + int((g[1:] & ~g[:-1]).sum())
        want[r["doc_id"], len(t), int(g.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~g])).hexdigest()] += 1
    assert bag(suffixes.remove_repeats(few, window=60, gram=30, batches=batches), "id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    rnd = np.random.default_rng(1)
    units = windows.BYTES[rnd.integers(0, 4, 3000)]
    whole = windows.runs(units, 50, 20)
    assert (whole[1] >= whole[0]).all() and whole[0][0] == 0 and whole[1][-1] == 2950
    monkeypatch.setattr(windows, "PIECE", 100)
    parts = windows.runs(units, 50, 20)
    spread = lambda r: np.repeat(r[3], r[1] - r[0] + 1)
    assert (spread(whole) == spread(parts)).all()


def test_long_texts_and_repeated_rows(spark, empty):
    """The real window, a text over a piece's size with the repeat across its border, many equal rows, null ids, empty table."""
    rnd = np.random.default_rng(3)
    long = bytes(rnd.integers(97, 123, windows.PIECE + 3000, dtype=np.uint8)).decode()
    block = long[windows.PIECE - 250 : windows.PIECE + 250]
    rows = [(1, long), (2, "x" * 399), (3, "head " + block + " tail"), (4, None), (4, ""), (None, block), *[(5, "s" + block[:410])] * 300, *[(10 + i % 3, "t" * 405) for i in range(300)]]
    docs = spark.createDataFrame([(*r, "n_bytes") for r in rows], "doc_id long, text string, n_bytes string").repartition(4)
    got = bag(suffixes.remove_repeats(docs), "id", "n_bytes", "n_removed", "n_spans")
    want = Counter({(1, len(long), 500, 1): 1, (2, 399, 0, 0): 1, (3, 510, 500, 1): 1, (4, 0, 0, 0): 2, (None, 500, 500, 1): 1, (5, 411, 411, 1): 300} | {(10 + i, 405, 405, 1): 100 for i in range(3)})
    assert got == want
    assert suffixes.remove_repeats(empty).count() == 0
    words = " ".join(f"w{i % 50}x{i % 31}" for i in range(40))
    many = spark.createDataFrame([(7, words)] * 10_000 + [(8, words + " more"), (9, "other " * 3)], "doc_id long, text string").repartition(4)
    assert bag(phrases.remove_phrases(many), "id", "n_words", "n_removed") == Counter({(7, 40, 40): 10_000, (8, 41, 40): 1, (9, 3, 0): 1})


def test_phrases_of_hot_anchors(docs):
    """Salted shards find what one shard finds, and nothing is found without automata."""
    assert bag(phrases.remove_phrases(docs, hot=1), "id", "n_removed", "kept_sha256") == bag(phrases.remove_phrases(docs), "id", "n_removed", "kept_sha256")
    shard = phrases.Shard([(1, b"a b c"), (2, b"b c"), (3, b"z")])
    assert sorted(shard.locate(b"b c x a b c")) == [(0, 2, 2), (3, 3, 1), (4, 2, 2)]
    assert phrases.Shard([]).locate(b"a b c") == []


def test_family_lasts(spark):
    """Levels are folders: a second family at the same place knows what the first took in; equal ranks have merged."""
    folder = new_path(spark, "test-family")
    rows = lambda xs: spark.createDataFrame([(x.encode(), hash(x) % 1000, 1) for x in xs], "suffix binary, fp long, m long")
    first = suffixes.IndexFamily(spark, folder)
    assert [first.add(rows([c + str(i) for i in range(20)])).count() for c in "abc"] == [0, 0, 0]
    assert [r for r, _ in first.levels()] == [0, 1]
    again = suffixes.IndexFamily(spark, folder)
    assert {r["fp"] for r in again.add(rows(["a3", "c7", "new", "new2"])).collect()} == {hash("a3") % 1000, hash("c7") % 1000}
    assert [r for r, _ in again.levels()] == [2] and again.add(rows(["new", "new", "x", "x"])).count() == 2
    level = [bytes(r["suffix"]) for r in again.read(again.levels()[-1][1]).coalesce(1).collect()]
    assert len(level) == len(set(level)) == 62
    again.drop()
    assert again.levels() == []


# ---- lines


def in_order(rows):
    """Distinct (id, text) in the order in which what stands first stays; the least id of a text has it."""
    return sorted({(r["doc_id"], r["text"]) for r in rows if r["text"] is not None}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def shared_lines(rows, size):
    """(id, text) -> numbers of lines that lie in a run of `size` lines, two of them with words, which stands elsewhere before."""
    seen, out = set(), {}
    for i, t in in_order(rows):
        ls, gone = t.split("\n"), set()
        for a in range(len(ls) - size + 1):
            run = tuple(ls[a : a + size])
            if sum(1 for x in run if x.encode().split()) > 1:
                if run in seen:
                    gone |= set(range(a, a + size))
                seen.add(run)
        out[i, t] = gone
    return out


def removed_lines(before, after):
    """Numbers of lines that are gone, of a text and what is left of it; equal neighbours: the later ones."""
    if before == after:
        return set()
    ls, left, out = before.split("\n"), after.split("\n") if after else [], set()
    if before and not after:
        return set(range(len(ls)))
    j = 0
    for i, x in enumerate(ls):
        if j < len(left) and x == left[j]:
            j += 1
        else:
            out.add(i)
    assert j == len(left)
    return out


def test_lines(docs, empty):
    """Nothing is lost, nothing goes that doesn't repeat, rows and columns stay, whole repeated runs of three lines with words go."""
    out = lines.dedup(docs)
    assert out.columns == docs.columns and lines.dedup(empty).count() == 0
    rows, got = docs.collect(), out.collect()
    key = lambda r: tuple(r[c] for c in r.__fields__ if c != "text")
    assert Counter(map(key, rows)) == Counter(map(key, got))
    assert {x for r in rows for x in (r["text"] or "").split("\n")} == {x for r in got for x in (r["text"] or "").split("\n")} | {""}
    assert sum(r["text"] is None for r in rows) == sum(r["text"] is None for r in got)
    left = {(r["doc_id"], r["n_chars"]): r["text"] for r in got}
    two, three = shared_lines(rows, 2), shared_lines(rows, 3)
    for r in rows:
        if r["text"] is not None and len([k for k in rows if k["doc_id"] == r["doc_id"] and k["n_chars"] == r["n_chars"]]) == 1:
            gone = removed_lines(r["text"], left[r["doc_id"], r["n_chars"]])
            first = min((x["doc_id"] is None, x["doc_id"] or 0) for x in rows if x["text"] == r["text"])
            if first == (r["doc_id"] is None, r["doc_id"] or 0):
                assert len(three[r["doc_id"], r["text"]] - gone) == 0 and len(gone - two[r["doc_id"], r["text"]]) <= len(gone) / 5


def test_repeated_runs_of_the_given_table(spark):
    """Of the lines of runs that stand in an earlier text at least nine in ten go, for runs of 3, 4 and 6 lines."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows, left = docs.collect(), {r["doc_id"]: r["text"] for r in lines.dedup(docs).collect()}
    texts = {r["text"]: r["doc_id"] for r in sorted(rows, key=lambda r: -r["doc_id"])}
    for size in (3, 4, 6):
        want = {k: v for k, v in shared_lines(rows, size).items() if v and texts[k[1]] == k[0]}
        gone = sum(len(v & removed_lines(t, left[i])) for (i, t), v in want.items())
        assert gone >= 0.9 * sum(map(len, want.values())), (size, gone, sum(map(len, want.values())))


def test_chunks_resist_shifts():
    rnd = random.Random(3)
    ls = [prose(rnd, 6).encode() for _ in range(200)]
    a = {b"\n".join(ls[x:y]) for x, y in lines.chunks(ls)}
    moved = [b"new one", b"new two", *ls]
    b = {b"\n".join(moved[x:y]) for x, y in lines.chunks(moved)}
    assert len(a & b) >= len(a) - 3


def test_lines_of_repeated_rows(spark):
    """Ten thousand equal rows are one; copies by other ids lose all; the cost is that of one text and its keys."""
    t = "\n".join(f"line {i} of the text" for i in range(200))
    rows = spark.createDataFrame([(5, t)] * 10_000 + [(6, t)] * 50 + [(None, t), (7, "a\nb")], "doc_id long, text string").repartition(4)
    out = lines.dedup(rows, counts=True).groupBy("doc_id", "__line_gone").count().collect()
    assert {(r["doc_id"], r["__line_gone"], r["count"]) for r in out} == {(5, 0, 10_000), (6, 200, 50), (None, 200, 1), (7, 0, 1)}


def test_lines_with_equal_hashes(spark, docs, monkeypatch):
    monkeypatch.setattr(lines.xxhash, "xxh3_64_intdigest", lambda b: 7)
    rows = spark.createDataFrame([(1, "a\nb"), (2, "c\nd"), (3, "a\nb"), (4, "c\nd")], "doc_id long, text string").coalesce(1)
    from pyspark.sql import functions as own_f

    own = lines.chunk_rows  # workers don't see the patch: give them the rows
    monkeypatch.setattr(lines, "chunk_rows", lambda r: own(r).withColumn("h", own_f.lit(7).cast("long")))
    assert {r["doc_id"]: r["text"] for r in lines.dedup(rows).collect()} == {1: "a\nb", 2: "c\nd", 3: "", 4: ""}


# ---- quality


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    ls = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered)


def test_quality(docs, empty, spark):
    from pyspark.sql import functions as F

    got = quality.with_counts(docs.withColumn("n_words", F.lit("clash")))
    names = [quality.OWN + k for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    want = Counter((r["doc_id"], *brute_counts(r["text"])) for r in docs.collect())
    assert bag(got, "doc_id", *names) == want
    out = quality.judge(docs)
    assert out.columns == docs.columns and not [r for r in out.collect() if brute_counts(r["text"])[0] < 50]
    assert quality.judge(empty).count() == 0
    theta = quality.fit(spark.createDataFrame([([1, 1, 0], 90), ([-1, -1, 1], 8), ([1, 1, -1], 6), ([1, -1, 1], 2)], "v array<int>, n long"), 3)
    good, bad = theta[1:4], theta[4:]
    assert theta[0] > 0.8 and good[0] > 0.9 > bad[0] and all(quality.LOW <= b <= g <= quality.HIGH for g, b in zip(good, bad, strict=True))


def test_quality_agrees_with_labels(spark):
    """Of documents of the table with labels that pass the base check: the bad ones go, the good ones stay."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL").collect()}
    kept = {r["doc_id"] for r in quality.judge(docs).select("doc_id").collect()}
    known = [(labels[r["doc_id"]], r["doc_id"] in kept) for r in docs.collect() if r["doc_id"] in labels and brute_counts(r["text"])[0] >= 50 and 2 * brute_counts(r["text"])[4] <= brute_counts(r["text"])[0]]
    good, bad = [k for q, k in known if q == 1], [k for q, k in known if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


# ---- tokens


def test_tokens(docs, empty, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    odd = [(100 + i, t) for i, t in enumerate(["don't I'LL 's''s", "ΑΣ Σ İ ﬁ 日本語テキスト", "x<|endoftext|>y <|startoftext|", "a\x85b\xa0c\x1cd", "é é", "aaaa" * 40_000, "1234 5 ١٢", "!?" * 300])]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows.collect())
    assert bag(tokens.token_counts(rows), "doc_id", "n_bytes", "n_tokens") == want
    assert tokens.token_counts(empty.select("doc_id", "text")).count() == 0
    c = tokens.Counter(public_tokenizers.path(tokens.VOCABULARY))
    text = "it's 12 o'clock, they'll go!?'s " * 5
    for n in (1, 3, 7):
        parts = [c.chunk(text[i : i + n]) for i in range(0, len(text), n)]
        left = parts[0]
        for p in parts[1:]:
            left = c.compose(left, p)
        assert c.run(left[0]) + (left[1] or 0) + c.run(left[2]) == c.run(text)


# ---- mixing


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    level, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:  # by hand: cap, deal again, until none is above
        each = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * each > 2 * sizes[s] + 1e-9]
        if not over:
            level |= {s: weight[s] * each for s in open_}
            break
        for s in over:
            level[s] = 2.0 * sizes[s]
            left -= level[s]
            open_.discard(s)
    largest = defaultdict(int)
    for r in rows:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in order:
        assert abs(target[s] - level[s]) < 1e-6 * max(1, level[s])
        assert abs(taken[s] - target[s]) <= largest[s]
    assert bag(mixing.mix(docs), "id", "copies", "tie") == Counter((r["id"], r["copies"], r["tie"]) for r in rows)
    out = mixing.take(docs)
    assert set(docs.columns) | {"copies"} == set(out.columns) and out.where("copies < 1").count() == 0
    assert mixing.mix(empty).count() == 0


def test_long_documents_are_likelier(spark):
    rows = spark.createDataFrame([(i, "w " * (10 if i % 2 else 200), "a" if i < 2000 else "b") for i in range(6000)], "doc_id long, text string, source string")
    got = mixing.mix(rows).where("source = 'b'").groupBy("size").avg("copies").collect()  # b is owed less than a second copy of all
    share = {r["size"]: r[1] % 1 for r in got}
    assert share[200] > 1.5 * share[10] > 0


def test_mixing_prefers_no_source_within_its_share(spark):
    rows = spark.createDataFrame([(i, "w " * (i % 17 + 1), "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.mix(rows).groupBy("source").agg({"target": "max", "source_size": "max"}).collect()
    taken = {r["source"]: r[1] for r in mixing.mix(rows).selectExpr("source", "size * copies AS t").groupBy("source").sum("t").collect()}
    assert all(abs(taken[r["source"]] - r["max(target)"]) <= 17 for r in got)


# ---- language models


@pytest.mark.parametrize(("vocabulary", "slice_bytes"), [(lm.VOCABULARY, lm.SLICE), (20, 2000)])
def test_lm(docs, empty, spark, vocabulary, slice_bytes):
    """Against plain counts of words and pairs, for whole texts of any length, with and without other words and several slices."""
    from math import log

    from math import floor, log2

    labels = spark.createDataFrame([(10, 1, 0), (10, 1, 0), (11, 0, 0), (9, 1, 1), (None, 1, 0), (999, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    rows = docs.collect()
    words = lambda r: (r["text"] or "").encode().lower().split()
    seen = Counter(w for r in rows for w in words(r))
    level = {w: floor(log2(n) * 16) for w, n in seen.items()}
    least = min((x for x in level.values() if sum(y >= x for y in level.values()) <= vocabulary), default=99)
    known = {w for w in seen if level[w] >= least}

    def model(texts):
        texts = [[w if w in known else None for w in t] for t in texts]
        one = Counter(w for t in texts for w in t)
        pairs = Counter(p for t in texts if t for p in zip(["<s>", *t], t, strict=False))
        before = Counter()
        for (v, _), n in pairs.items():
            before[v] += n
        total, m = sum(one.values()), lm.MASS
        return lambda v, w: (pairs[v, w] + m * (one[w] + 1) / (total + len(known) + 1)) / (before[v] + m)

    models = model([words(r) for r in rows if r["doc_id"] == 10]), model([words(r) for r in rows])
    want = []
    for r in rows:
        t = [w if w in known else None for w in words(r)]
        loss = [sum(-log(p(v, w)) for v, w in zip(["<s>", *t], t, strict=False)) / max(1, len(t)) for p in models]
        want.append((-1 if r["doc_id"] is None else r["doc_id"], len(t), *loss))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["target_loss"], r["background_loss"]) for r in lm.score(docs, labels, vocabulary=vocabulary, slice_bytes=slice_bytes).collect()]
    assert np.allclose(sorted(got), sorted(want), atol=1e-9)
    assert lm.score(empty, labels).count() == 0
    scores = {r["doc_id"]: r["score"] for r in lm.score(docs, labels).collect()}
    assert scores[10] < scores[11]  # nearer to the target


def test_lm_tells_documents_that_occur_twice(spark):
    """The background of the whole corpus knows pairs of words of texts that it has twice."""
    rnd = random.Random(8)
    word = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rnd.choice(word) for _ in range(120)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(50)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["background_loss"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), none).collect()}
    assert max(got[i] for i in range(50)) < min(got[i] for i in range(50, 200))


# ---- decontamination


def test_decontamination(docs, empty, spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("bcdfgklmnp") + rnd.choice("aeiou") for _ in range(3))
    items = [(i, ". ".join(" ".join(word() for _ in range(8)) for _ in range(2 + i % 3)) + ".") for i in range(30)] + [(30, None), (31, ""), (32, "...")]
    leak = [(200 + i, "intro of words\n" + items[i][1].upper().replace(" ", "\n", 3) + "\nmore text " * 20) for i in range(0, 30, 3)]
    half = [(300 + i, " ".join(items[i][1].split()[:8])) for i in range(0, 30, 3)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(leak + half, "doc_id long, text string"))
    found = decontaminate.find(rows, spark.createDataFrame(items, "item_id long, text string"))
    assert bag(found, "doc_id", "item_id") == Counter((200 + i, i) for i in range(0, 30, 3))
    kept = decontaminate.clean(rows, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.count() == rows.count() - len(leak) and kept.columns == rows.columns
    assert decontaminate.find(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.find(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_wand_finds_what_full_scoring_finds():
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(4, 20)))) for i in range(120)]
    df = Counter(t for _, x in items for t in set(decontaminate.terms(x)))
    index = decontaminate.Index(items, len(items), df, 12.0)
    for least in (0.2, 0.5, 0.8):
        for _ in range(60):
            query = {rnd.randint(1, 16) for _ in range(rnd.randint(1, 10))}
            for shelf in index.shelves:
                own = query & shelf.lists.keys()
                full = Counter()
                for t in own:
                    for d, w in zip(*shelf.lists[t][:2], strict=True):
                        full[shelf.items[d]] += w
                assert sorted(i for i, _ in shelf.search(own, least)) == sorted(i for i, s in full.items() if s >= least)


# ---- SimHash


def brute_simhash(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(values, radius):
    """Smallest member of each value's component."""
    left, out = set(values), {}
    while left:
        group, edge = set(), [left.pop()]
        while edge:
            x = edge.pop()
            group.add(x)
            close = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= close
            edge += close
        out |= dict.fromkeys(group, min(group))
    return out


def test_simhash_rows(docs, empty):
    rows = docs.collect()
    prints = [brute_simhash(r["text"]) for r in rows]
    groups, least = linked(prints, 2), {}
    for r, p in zip(rows, prints, strict=True):
        if r["doc_id"] is not None:
            least[groups[p]] = min(r["doc_id"], least.get(groups[p], 1 << 60))
    want = Counter((r["doc_id"], p - (1 << 64) if p >> 63 else p, least.get(groups[p])) for r, p in zip(rows, prints, strict=True))
    assert bag(simhash.components(simhash.fingerprints(docs.select("doc_id", "text"))), "doc_id", "fp", "component") == want
    assert simhash.components(simhash.fingerprints(empty.select("doc_id", "text"))).count() == 0


def test_simhash_links(spark):
    rnd = random.Random(4)
    values = {rnd.getrandbits(64) for _ in range(40)}
    for v in list(values)[:12]:
        for _ in range(rnd.randint(1, 9)):  # chains of close ones
            v ^= 1 << rnd.randint(0, 63)
            v ^= (1 << rnd.randint(0, 63)) * (rnd.random() < 0.5)
            values.add(v)
    want = linked(values, 2)
    s = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(s(v),) for v in values], "fp long")
    got = {r["node"]: r["component"] for r in connected_components(simhash.links(df)).collect()}
    together = defaultdict(set)
    for v in values:
        together[got.get(s(v), s(v))].add(v)
    brute = defaultdict(set)
    for v in values:
        brute[want[v]].add(v)
    assert sorted(map(sorted, together.values())) == sorted(map(sorted, brute.values()))


@pytest.mark.parametrize("radius", [1, 2, 3, 6])
def test_masks_cover(radius):
    rnd, masks = random.Random(radius), simhash.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(500):
        bits = sum(1 << b for b in rnd.sample(range(64), radius))
        assert any(bits & m == 0 for m in masks)


def test_near_copies_leave_one(docs, empty):
    out = simhash.keep_one(docs)
    kept = [r["text"] for r in out.collect()]
    assert out.columns == docs.columns and len(kept) == len(set(kept))
    texts = {r["text"] or "" for r in docs.collect()}
    for t in texts:  # a text goes only for one like it
        assert t in kept or any(simhash.similar(t.encode(), (k or "").encode()) >= 0.8 for k in kept)
    assert sum(1 for t in kept if t and "alpha" in t and len(t.split()) == 300) == 1  # three copies and a near one
    assert simhash.keep_one(empty).count() == 0


def test_near_groups_are_those_of_all_pairs(spark):
    rnd = random.Random(11)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(400)]

    def copy(of, share):
        return [f"z{rnd.randint(0, 10**6)}" if rnd.random() < share else w for w in of]

    texts = [" ".join(copy(base, 0.022)) for _ in range(300)]  # a large family in which few pairs are similar
    for k in range(40):  # pairs close to the threshold
        one = [f"p{k}x{rnd.randint(0, 900)}" for _ in range(60 + 5 * k)]
        texts += [" ".join(one), " ".join(copy(one, 0.018)), " ".join(one[: len(one) * 5 // 6])]
    texts += ["", " \n", "a b", "A  b", "a b c d e", "a b c d f"]
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted({find(i) for i in range(len(texts))})
    assert len(want) < len(texts) - 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == want


def test_near_copies_of_the_given_table(spark):
    """Every pair of Jaccard 0.8 or more among whole texts of the table, by counting shared shingles: recall 1 in each band."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    least, has = {}, defaultdict(list)
    for r in docs.collect():
        least[r["text"] or ""] = min(r["doc_id"], least.get(r["text"] or "", 1 << 60))
    texts = list(least)
    sets = [simhash.shingle_set(t.encode()).tolist() for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in enumerate(sets):
        for j, k in Counter(j for x in own for j in has[x]).items():
            if 5 * k >= 4 * (len(own) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in own:
            has[x].append(i)
    first = {}
    for i, t in enumerate(texts):
        first[find(i)] = min(least[t], first.get(find(i), 1 << 60))
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()) == sorted(first.values())


# ---- archives


def test_warc(spark, tmp_path):
    body = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "http://a.example.com/x?q=1", body), (1, "https://b.example.com:8080/", body), (2, None, body + "é"), (4, "not a url\r\nX: y", "short"), (5, "http://a.example.com/x?q=1", "short"), (6, "http://c.org", None), (None, "http://d.org/", body), (7, "http://e.org/", "y\r\n\r\nz" * 40), (7, "http://e.org/", "y\r\n\r\nz" * 40)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    directory = warc.write_archives(pages, new_path(spark, "test-warc"))
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    want = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        to = first.get(h) if first.get(h) != p else None
        want[p, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to] += 1
    out = warc.read_records(directory)
    assert bag(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert bag(warc.lookup_all(directory, pages.select(warc.url_key(pages.url).alias("key"))), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert {bytes(r["payload"]).decode() for r in out.where("record_type = 'response'").collect()} == {h or "" for _, _, h in rows}
    assert sorted(x["page_id"] for x in warc.lookup(directory, "http://A.example.com/x?q=1")) == [3, 5]
    assert warc.lookup(directory, "http://none.org/") == []
    assert warc.read_records(warc.write_archives(pages.limit(0), new_path(spark, "none"))).count() == 0


@pytest.mark.parametrize("segment", [1, 2, 512])
def test_many_keys_are_looked_up(spark, monkeypatch, segment):
    """Keys of many pages, of none, one key over several blocks; segments of any size."""
    monkeypatch.setattr(warc, "SEGMENT", segment)
    pages = spark.range(1500).selectExpr("id AS page_id", "CASE WHEN id % 3 = 0 THEN 'http://same.org/' ELSE concat('http://h', id % 7, '.org/p', id) END AS url", "repeat(cast(id AS string), 50) AS html")
    directory = warc.write_archives(pages, new_path(spark, "many")).cache()
    keys = pages.where("page_id % 6 < 4").select(warc.url_key(pages.url).alias("key")).union(spark.createDataFrame([("none",), ("zzz",), ("",)], "key string"))
    got = Counter(r["page_id"] for r in warc.lookup_all(directory, keys, payload=False).collect())
    assert got == Counter(i for i in range(1500) if i % 3 == 0 or i % 6 < 4)


def test_blocks_are_searched(spark):
    pages = spark.range(1000).selectExpr("id AS page_id", "concat('http://h', id % 7, '.org/p', id) AS url", "repeat(cast(id AS string), 50) AS html")
    directory = warc.write_archives(pages, new_path(spark, "blocks"))
    assert directory.count() >= 4 and directory.agg({"n": "sum"}).first()[0] == 1000
    assert [x["page_id"] for x in warc.lookup(directory, "http://h3.org/p500")] == [500]


# ---- all together


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "decontamination", "source mix"]
    assert out.columns == [*docs.columns, "copies"] and 0 < out.count() < docs.count()
    assert not json.dumps([r["copies"] for r in out.collect()]).count("null")


def plain_lines(rows):
    """Line dedup of (id, text) with ids of their own, one chunk after the other in the order of ids."""
    texts, first, out = {}, {}, {}
    for i, t in sorted(rows):
        ls = t.encode().split(b"\n")
        gone = set()
        if texts.setdefault(t, i) != i:
            out[i] = "" if lines.chunks(ls) else t
            continue
        for a, b in lines.chunks(ls):
            (j, other, c) = first.setdefault(b"\n".join(ls[a:b]), (i, ls, a))
            if (j, c) == (i, a):
                continue
            d, x, y = c + b - a, 0, 0
            while x < lines.REACH and a - x > 0 and c - x > 0 and ls[a - x - 1] == other[c - x - 1]:
                x += 1
            while y < lines.REACH and b + y < len(ls) and d + y < len(other) and ls[b + y] == other[d + y]:
                y += 1
            gone |= set(range(a - x, b + y))
        out[i] = b"\n".join(x for n, x in enumerate(ls) if n not in gone).decode()
    return out


def plain_near(rows):
    """Ids that stay of (id, text): the least of each group of texts that all pairs connect."""
    ids = sorted(rows)
    sets = {i: set(simhash.shingle_set(rows[i].encode()).tolist()) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in ids}


def plain_leaks(text, items):
    """Whether a text has 0.8 of the shingles of both parts of any item."""
    words = decontaminate.terms(text)
    for item in items:
        shares = []
        for part in decontaminate.parts(item):
            width = min(decontaminate.SHINGLE, len(part))
            own = decontaminate.shingles(part, width) if part else set()
            have = decontaminate.shingles(words, width) if part and len(words) >= width else set()
            shares.append(len(own & have) / len(own) if own else 1.0)
        if decontaminate.terms(item) and min(shares) >= decontaminate.OVERLAP:
            return True
    return False


def test_pipeline_against_plain_versions(spark, tmp_path):
    """Every stage's rows on the given table: SQL for the rules and the mix, plain loops for the three between."""
    import corpus_pipeline
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, text FROM documents JOIN (SELECT doc_id FROM ({quality.OP2_SQL}) WHERE kept) USING (doc_id)").fetchall()}
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), [r["text"] or "" for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {r["doc_id"]: tuple(r) for r in docs.collect()}

    def step(n):
        nonlocal docs
        out = corpus_pipeline.STAGES[n][1](spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
        return {r["doc_id"]: r["text"] for r in docs.collect()}

    assert step(0) == want
    want = plain_lines(want.items())
    assert step(1) == want
    want = {i: want[i] for i in plain_near(want)}
    assert step(2) == want
    want = {i: t for i, t in want.items() if not plain_leaks(t, items)}
    assert step(3) == want
    docs.toPandas().to_parquet(tmp_path / "left.parquet")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/left.parquet'")
    copies = {r[0]: r[1] // r[2] for r in con.execute(f"SELECT doc_id, taken, size FROM ({mixing.OP4_SQL}) WHERE taken > 0").fetchall()}
    assert step(4).keys() == copies.keys() and {r["doc_id"]: r["copies"] for r in docs.collect()} == copies
    assert all(tuple(r)[2:-1] == whole[r["doc_id"]][2:] for r in docs.collect())


def test_near_dedup_proposes_by_fingerprints(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {1: " ".join(words), 2: " ".join(words).upper(), 3: " ".join([*words[:-1], "x"]), 4: " ".join(reversed(words)), 5: "", 6: " "}
    prints = {u: simhash.fingerprint(t.encode(), simhash.SHINGLE) for u, t in texts.items()}
    with simhash.scratch():
        pairs = {(r["u"], r["v"]) for r in simhash.print_pairs(spark.createDataFrame(list(texts.items()), "u long, text string")).collect()}
    assert (2, 1) in pairs and (6, 5) in pairs
    assert all((prints[u] ^ prints[v]).bit_count() <= 2 for u, v in pairs) and not any(4 in p for p in pairs)
    docs = spark.createDataFrame([(u, t) for u, t in texts.items()], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 4, 5]
