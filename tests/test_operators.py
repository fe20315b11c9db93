"""Operators on small literal tables, and BM25 against SQLite's full-text index."""

import sqlite3

from pyspark.sql import functions as F

from tallyloom.operators import evaluation as E
from tallyloom.operators import ranking as R
from tallyloom.operators import relational as O
from tallyloom.operators import vectors as V

DOCS = [(1, "the quick brown fox"), (2, "quick quick dog"), (3, "lazy dog and fox and hen"), (4, "nothing at all"), (5, "brown hen"), (6, "blue sky over hills"), (7, "green grass grows")]


def fts(query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text)")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", DOCS)
    return {r[0]: round(-r[1], 6) for r in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (query,))}


def scores(spark, words):
    docs = spark.createDataFrame(DOCS, "id int, text string")
    return R.term_scores(docs, "id", "text", spark.createDataFrame([(1, w) for w in words], "q int, term string"))


def as_dict(df):
    return {r["doc"]: round(r["score"], 6) for r in df.collect()}


def test_bm25_matches_sqlite(spark):
    assert as_dict(R.any_word(scores(spark, ["quick", "fox"]))) == fts("quick OR fox")
    weighted = R.top_scores(spark.createDataFrame(DOCS, "id int, text string"), "id", {"text": 1.0}, spark.createDataFrame([(1, "quick"), (1, "fox")], "q int, term string"), 9)
    assert {r["doc"]: r["score"] for r in weighted.collect()} == fts("quick OR fox")
    three = ["quick", "brown", "fox"]
    assert as_dict(R.two_of(scores(spark, three))) == fts("(quick AND brown) OR (quick AND fox) OR (brown AND fox)")
    terms = spark.createDataFrame([(1, "brown"), (1, "fox")], "q int, term string")
    assert as_dict(R.every_word(scores(spark, ["brown", "fox"]), terms)) == fts("brown AND fox")


def test_fuse_keeps_first_seen_on_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, id int, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "q int, id int, rank int")
    out = [r["id"] for r in R.fuse((a, 1.0), (b, 1.0)).orderBy("rank").collect()]
    assert out == [11, 10, 12]


def test_gate_lets_unknown_vectors_pass(spark):
    words = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "q int, id int, rank int")
    near = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.9), (1, 20, 0.8)], "q int, id int, cosine double")
    assert [r["id"] for r in R.gate_and_fill(words, near, 0.5, 0.5, 3).orderBy("rank").collect()] == [11, 12, 20]


def test_quantise_zero_and_ties(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, -0.5],)], "v array<double>").withColumn("z", V.quantise(F.col("v")))
    assert [list(r["z"]["q"]) for r in df.collect()] == [[0, 0], [127, -64]]


def test_islands_fill_and_as_of(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 3, 7, 8)], "s string, n int")
    assert sorted((r["start"], r["end"]) for r in O.islands(df, ["s"], "n").collect()) == [(1, 3), (7, 8)]
    f = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 3, "x"), ("a", 5, None), ("a", 6, "y")], "s string, n int, v string")
    assert [r["filled"] for r in O.fill_between(f, ["s"], "n", "v").orderBy("n").collect()] == ["x", "x", "x", None, "y"]
    e = spark.createDataFrame([("a", 2, 2), ("a", 5, 5)], "s string, t int, p int")
    r = spark.createDataFrame([("a", 1), ("a", 5), ("a", 6), ("b", 9)], "s string, t int")
    assert [x["got"] for x in O.as_of(r, e, "s", "t", "p", "got").orderBy("t").collect()] == [None, 2, 5, None]


def test_page_share_and_lifecycle(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    page = O.page_after(df, "k", 3, 4).collect()
    assert [r["k"] for r in page] == [4, 5, 6, 7] and page[0]["next"] == 7
    assert O.page_after(df, "k", 7, 4).first()["next"] is None
    sizes = spark.createDataFrame([("a", 2), ("b", 50), ("c", 60)], "g string, n long")
    assert {r["g"]: r["take"] for r in O.fair_share(sizes, 20).collect()} == {"a": 2, "b": 9, "c": 9}
    old = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    new = spark.createDataFrame([(1, "y"), (2, None), (3, "z")], "id int, t string")
    assert {r["id"]: r["change"] for r in O.upsert_changes(old, new, "id", ["t"]).collect()} == {1: "changed", 2: "same", 3: "added"}


def test_statistics(spark):
    s = spark.createDataFrame([(1, True), (2, False), (2, True), (3, True)], "s int, g boolean")
    assert E.auc(s, "s", "g").first()["auc"] == 0.5
    w = spark.createDataFrame([(0, 0), (5, 10)], "k int, n int").select(E.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert tuple(w[0]["w"]) == (0.0, 0.0) and round(w[1]["w"]["low"], 3) == 0.237
    k = E.kappa(spark.createDataFrame([(1, True), (2, True)], "i int, v boolean"), spark.createDataFrame([(1, True), (2, True)], "i int, v boolean"), "i", "v").first()
    assert k["kappa"] == 1.0


def test_auc_over_ranges_and_neighbours_in_blocks(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    rows = [(rnd.choice([rnd.random() * 1e6, float(rnd.randint(0, 5))]), rnd.random() < 0.4) for _ in range(500)]
    pos, neg = [x for x, g in rows if g], [x for x, g in rows if not g]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(E.auc(spark.createDataFrame(rows, "s double, g boolean"), "s", "g").first()["auc"] - want) < 1e-6
    v = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(60)], "id int, v array<double>")
    q = v.selectExpr("id AS q", "v")
    one = sorted(map(tuple, V.nearest(v, q, 3).collect()))
    monkeypatch.setattr(V, "QUERIES", 7)
    assert sorted(map(tuple, V.nearest(v, q, 3).collect())) == one


def test_session_folds(spark, tmp_path):
    from tallyloom.operators import sessions as S

    turns = spark.createDataFrame([("a", 1, 10), ("a", 2, 8), ("a", 3, 5), ("a", 4, 40), ("a", 5, 1)], "s string, t int, n int")
    assert [r["chunk"] for r in S.chunk_turns(turns, "s", "t", "n", 18).orderBy("t").collect()] == [0, 0, 1, 2, 3]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate("xyxzx")], "s string, t int, v string")
    assert [r["t"] for r in S.ring_dedupe(rows, "s", "t", "v", 2).orderBy("t").collect()] == [0, 1, 3, 4]
    import random

    rnd = random.Random(3)
    for top in (3, 9, 40):
        sizes = [(f"k{i:03d}", rnd.randrange(top)) for i in range(120)]
        halves, want = [0, 0], {}
        for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
            want[name] = int(halves[1] < halves[0])
            halves[want[name]] += n
        assert {r["k"]: r["half"] for r in S.balanced(spark.createDataFrame(sizes, "k string, n long"), "k", "n").collect()} == want
    long = spark.range(300_000).selectExpr("'one' AS s", "id AS t", "id % 7 AS n")
    assert S.chunk_turns(long, "s", "t", "n", 50).agg(F.max("chunk")).first()[0] == S.chunk_turns(long.where("t < 0").unionByName(long), "s", "t", "n", 50).agg(F.count_distinct("chunk")).first()[0] - 1
    cut = S.shrink({"o": ["x" * 10] * 40, "t": ["y" * 10] * 5}, ["o", "t"], 120)
    assert len(cut["o"]) == 10 and len(cut["t"]) == 2
    bad = spark.createDataFrame([("s", "not json"), ("t", '{"observations": [{"type": "new", "title": "x"}]}')], "session_id string, reply string")
    assert [(r["session_id"], r["type"]) for r in S.apply_replies(bad).collect()] == [("t", "discovery")]
    folder = str(tmp_path / "snap")
    S.write_snapshot({"rows": rows}, folder)
    assert S.read_snapshot(spark, folder)["rows"].count() == 5
    rows.limit(1).write.mode("append").parquet(f"{folder}/rows")
    try:
        S.read_snapshot(spark, folder)
        raise AssertionError("a changed table was accepted")
    except ValueError:
        pass


def test_traces_hold_all_lines(spark):
    import json

    from tallyloom.operators import sessions as S

    rows = [("f", i, "ab"[i // 3 % 2] if i % 7 else None) for i in range(1, 40)]
    got = {(x["session_id"], i) for r in S.trace(spark.createDataFrame(rows, "path string, line int, session_id string")).collect() for x in json.loads(r["trace"]) for y in x["ranges"] for i in range(y["start"], y["end"] + 1)}
    assert got == {(s, i) for _, i, s in rows if s}


def test_scope_of_a_question():
    import pytest

    from tallyloom.operators import asking as A

    now, known = 1_710_500_000_000, ["/w/garden", "x/alpha", "y/alpha", "/w/code"]
    assert A.resolve("how is garden doing", now, known, here="h") == A.Scope("/w/garden")
    assert A.resolve("how is alpha doing in code", now, known, here="h").project == "h"
    assert A.resolve("what happened yesterday", now, known, here="h").project is None
    assert A.resolve("garden", now, known, project="p").project == "p" and A.resolve("garden", now, known, everywhere=True).project is None
    w = A.resolve("x", now, known, since="2024-03-01", until="2024-03-02", offset_min=60).window
    assert w.end - w.start == 2 * A.DAY and w.start % A.DAY == A.DAY - 3_600_000
    early = A.resolve("today", now, known, as_of="2024-01-05T10:00:00")
    assert early.before == early.window.end == 1_704_448_800_000
    for bad in ({"since": "soon"}, {"since": "2024-03-02", "until": "2024-03-01"}):
        with pytest.raises(ValueError):
            A.resolve("x", now, known, **bad)
    assert A.reports_on("Daily update for yesterday, 13 march", now) == A.when.window("13 march", now).start
    assert A.reports_on("recap of yesterday", now) == A.when.window("yesterday", now).start
    assert A.reports_on("yesterday was fine", now) is None and A.reports_on("x" * 300 + "update yesterday", now) is None


def test_limits_of_models():
    from tallyloom.operators import recall as C

    assert (C.limits("all-MiniLM-L6").relevance, C.limits("potion-8M").fill, C.limits("other", fill=0.9).fill) == (0.30, 0.55, 0.9)


def test_hashed_vectors(spark):
    from tallyloom.operators import recall as C

    rows = spark.createDataFrame([(1, "red fox"), (2, "fox red"), (3, ""), (4, "blue sky")], "id int, t string").withColumn("v", C.hashed_vector(F.col("t")))
    v = {r["id"]: r["v"] for r in rows.collect()}
    assert v[1] == v[2] and abs(sum(x * x for x in v[1]) - 1) < 1e-9 and not any(v[3]) and v[4] != v[1]


def test_edit_lines_of_three_formats(spark):
    import json

    from tallyloom.operators import files as P

    calls = [{"old_string": "short\nthe old line here", "new_string": "the new line here"}, {"edits": [{"oldText": "one old line more", "newText": "one new line more"}]}, {"diff": "--- a/x\n+++ b/x\n-gone for ever now\n+here for ever now\n same"}, {"content": "a whole new file\nx"}, {}]
    got = {r["id"]: (r["old"], r["new"]) for r in P.edit_lines(spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(calls)], "id int, input string")).collect()}
    assert got == {0: (["the old line here"], ["the new line here"]), 1: (["one old line more"], ["one new line more"]), 2: (["gone for ever now"], ["here for ever now"]), 3: ([], ["a whole new file"]), 4: ([], [])}


def test_numbers_without_one_task(spark):
    from tallyloom.operators import lifecycle as L

    ids = [3, 9, 10, 11, 500, 501, 7000, 7]
    out = {r["id"]: r["n"] for r in L.numbered(spark.createDataFrame([(i,) for i in ids], "id long").repartition(3), "id", 100, "n", width=8).collect()}
    assert out == {i: 100 + k for k, i in enumerate(sorted(ids))}


def test_snapshots_rotate_and_come_back(spark, tmp_path):
    import pytest

    from tallyloom.operators import lifecycle as L

    t = {"rows": spark.range(5)}
    for i in range(4):
        last = L.snapshot(t, str(tmp_path / "snaps"), keep=2, stamp=f"2025010{i}")
    assert sorted(p.name for p in (tmp_path / "snaps").iterdir()) == ["snapshot-20250102", "snapshot-20250103"]
    home = str(tmp_path / "home")
    L.restore(spark, last, home, lambda tables: tables["rows"].count() == 5)
    first = (tmp_path / "home/CURRENT").read_text()
    with pytest.raises(ValueError):
        L.restore(spark, last, home, lambda tables: False)
    assert (tmp_path / "home/CURRENT").read_text() == first and L.current(spark, home)["rows"].count() == 5


def test_bootstrap_draws(spark):
    """Each round draws as many groups as there are; all groups are as likely; the interval is that of a plain resampling of the same draws."""
    import hashlib

    draw = lambda r, i, n: int(hashlib.md5(f"7:{r}:{i}".encode()).hexdigest()[:12], 16) % n
    rows = [(g, float((g * 37 + c * 5) % 23), float((g * 11 + c * 7) % 19), (g + c) % 3 == 0) for g in range(12) for c in range(3)]

    def area(rows, at):
        pos, neg = [r[at] for r in rows if r[3]], [r[at] for r in rows if not r[3]]
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))

    diffs = []
    for r in range(60):
        picked = [x for i in range(12) for x in rows if x[0] == draw(r, i, 12)]
        diffs.append(round(area(picked, 1) - area(picked, 2), 9))
    diffs.sort()
    got = E.bootstrap_auc(spark.createDataFrame(rows, "g long, a double, b double, good boolean").repartition(3), "g", "a", "b", "good", rounds=60).first()
    want = (sum(diffs) / 60, diffs[int(59 * 0.025)], diffs[int(59 * 0.975)], sum(d > 0 for d in diffs) / 60)
    assert all(abs(x - y) < 1e-5 for x, y in zip(got, want, strict=True))


def test_contexts_are_cut_step_by_step(spark):
    import random

    from tallyloom.operators import sessions as S

    rnd, rows, want = random.Random(8), [], []
    for i in range(60):
        obs, own, most = [rnd.randrange(60) for _ in range(rnd.choice([0, 3, 10, 11, 45, 90]))], [(rnd.randrange(30), [rnd.randrange(200) for _ in range(rnd.randrange(5))]) for _ in range(rnd.randrange(6))], 900
        rows.append((i, obs, own))
        size = lambda o, t, k: 50 + sum(obs[:o]) + sum(h + sum(x[:t]) for h, x in own[:k])  # noqa: B023, E731
        o, t, k = len(obs), 4, len(own)
        while size(o, t, k) > most and not (o == 0 and t <= 1 and k <= 1):
            if o > 10:
                o //= 2
            elif t > 1:
                t -= 1
            elif k > 1:
                k -= 1
            else:
                o = 0
        want.append((o, t, k, size(o, t, k)))
    d = spark.createDataFrame(rows, "i int, o array<long>, s array<struct<head long, turns array<long>>>")
    got = d.withColumn("c", S.fitted(F.lit(50).cast("long"), F.col("o"), F.col("s"), 4, 900)).orderBy("i").select("c.*").collect()
    assert [tuple(r) for r in got] == want


def test_git_as_tables(spark, tmp_path):
    import subprocess

    from tallyloom.operators import files as P
    from tallyloom.sources import git as G

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.txt").write_text("one line of text\ntwo lines of text\n++ odd one here\n")
    run("add", "."), run("commit", "-qm", "x")
    (tmp_path / "a.txt").write_text("one line of text\nput between them\ntwo lines of text\n++ odd one here\nand at the end\n")
    (tmp_path / "b.txt").write_text("another file's line\n")
    run("add", "."), run("commit", "-qm", "y")
    (tmp_path / "c.txt").write_text("new")
    root = str(tmp_path)
    show = G.said(spark, root, *G.SHOW)
    added = G.added_lines(show).collect()
    second = {r["commit"] for r in added if r["path"] == "b.txt"}
    assert sorted((r["path"], r["line"], r["text"]) for r in added if r["commit"] in second) == [("a.txt", 2, "put between them"), ("a.txt", 5, "and at the end"), ("b.txt", 1, "another file's line")]
    assert sorted((r["line"], r["text"]) for r in added if r["commit"] not in second) == [(1, "one line of text"), (2, "two lines of text"), (3, "++ odd one here")]
    log = G.said(spark, root, *G.LOG)
    assert G.commits(log).count() == 2 and {r["parent"] for r in G.commits(log).collect()} - {None} <= {r["commit"] for r in G.commits(log).collect()}
    assert sorted((r["path"], r["added"], r["removed"]) for r in G.changes(log).collect()) == [("a.txt", 2, 0), ("a.txt", 3, 0), ("b.txt", 1, 0)]
    assert [(r["path"], r["how"]) for r in G.state(G.said(spark, root, "status", "--porcelain")).collect()] == [("c.txt", "unknown")]
    assert G.said(spark, str(tmp_path / "none"), *G.LOG).count() == 0
    at = next(r["authored"] for r in added)
    wrote = spark.createDataFrame([("b.txt", "another file's line", at * 1000 - 5, "s1")], "path string, text string, ts long, session_id string")
    got = P.attribute(G.added_lines(show).drop("root"), wrote).where("session_id IS NOT NULL").collect()
    assert [(r["path"], r["line"], r["session_id"]) for r in got] == [("b.txt", 1, "s1")]


def test_stemmed_bm25_matches_sqlite(spark):
    docs = [(1, "Running runners ran"), (2, "a run of café houses"), (3, "housing the cafe"), (4, "nothing"), (5, "more of nothing"), (6, "hopping along")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, more, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, text, more) VALUES (?, ?, ?)", [(i, t, t[:9]) for i, t in docs])
    rows = spark.createDataFrame([(i, t, t[:9]) for i, t in docs], "id int, text string, more string")
    for query in ("run OR house", "cafés", "hops OR running"):
        want = {r[0]: round(-r[1], 6) for r in con.execute("SELECT rowid, bm25(t, 5.0, 2.0) FROM t WHERE t MATCH ?", (query.replace("é", "e"),))}
        words = spark.createDataFrame([(1, w) for w in query.split(" OR ")], "q int, w string")
        terms = R.stemmed(words, ["w"]).select("q", F.explode("w").alias("term"))
        got = R.top_scores(R.stemmed(rows, ["text", "more"]), "id", {"text": 5.0, "more": 2.0}, terms, 9)
        assert {r["doc"]: r["score"] for r in got.collect()} == want


def test_pooled_vectors(spark):
    docs = spark.createDataFrame([(1, "Red red blue"), (2, "green?"), (3, None), (4, "blue red")], "id int, text string")
    tokens = spark.createDataFrame([("red", [1.0, 0.0]), ("blue", [0.0, 2.0]), ("other", [5.0, 5.0])], "term string, v array<double>")
    got = {r["id"]: (r["known"], [round(x, 6) for x in r["v"]]) for r in V.pooled(docs, "id", "text", tokens, 2).collect()}
    half, fifth = round(0.5**0.5, 6), round(0.2**0.5, 6)
    assert got == {1: (3, [half, half]), 2: (0, [0.0, 0.0]), 3: (0, [0.0, 0.0]), 4: (2, [fifth, round(2 * 0.2**0.5, 6)])}
    assert {r["id"]: r["known"] for r in V.pooled(docs, "id", "text", tokens, 2, most=1).collect()} == {1: 1, 2: 0, 3: 0, 4: 1}


def test_import_leaves_ids_of_both_alone(spark):
    from tallyloom.operators import lifecycle as L

    mine = spark.createDataFrame([(5, None)], "id long, origin string")
    rows = lambda *ids: spark.createDataFrame([(i, "s", "p", "t") for i in ids], "id long, session_id string, project string, title string")
    none = spark.createDataFrame([], "id long, session_id string, text string, kind string")
    new, _ = L.import_foreign(mine, rows(5, 101), rows(7), none.drop("kind"), none, base=100)
    assert sorted((r["id"], r["kind"]) for r in new.collect()) == [(101, "observation"), (102, "observation"), (103, "summary")]
