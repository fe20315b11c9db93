"""What is known of files: where a recorded path lies, who wrote a line, what is left of an edit, memories of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import records as P
from ..functions import text as X
from . import relational as O

LOOKBACK = 14 * 86_400_000
LEAST = 12  # characters of a line that can be told from others


def _under(path: Column, root: Column) -> Column:
    """Parts of a path below a root; null elsewhere."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", "")
    rest = F.substring(p, F.length(r) + 1, F.length(p))
    return F.when(p.startswith(r) & ((F.length(p) == F.length(r)) | rest.startswith("/")), X.clean_parts(rest))


def placement(recorded: Column, cwd: Column, root: Column, rel: Column, names: Column) -> Column:
    """exact, ending or no: whether a recorded path means the file `rel` (below the root) of a repository known by `names`.

    An absolute path inside the root must be the file; one elsewhere must end like it and name the repository before that end.
    A relative path counts from the session's folder if that is inside the root; else it may be a shorter ending of more than
    one part."""
    want, got = X.clean_parts(rel), X.clean_parts(recorded)
    n, m = F.size(got), F.size(want)
    tail = lambda a, k: F.slice(a, F.greatest(F.size(a) - k + 1, F.lit(1)), F.greatest(k, F.lit(0)))
    absolute = recorded.rlike(r"^(/|\\|~|[A-Za-z]:)")
    inside, sub = _under(recorded, root), _under(cwd, root)
    before = F.transform(F.slice(got, F.lit(1), F.greatest(n - m, F.lit(0))), F.lower)
    say = lambda c: F.when(c, "exact").otherwise("no")
    joined = X.clean_parts(F.concat_ws("/", F.array_join(sub, "/"), recorded))
    return (
        F.when((n == 0) | (m == 0), "no")
        .when(absolute & inside.isNotNull(), say(inside == want))
        .when(absolute, say((n >= m) & (tail(got, m) == want) & F.arrays_overlap(before, names)))
        .when(sub.isNotNull(), say(joined == want))
        .when((n == 1) | (m == 1) | (n == m), say(got == want))
        .when((n < m) & (tail(want, n) == got), "ending")
        .otherwise("no")
    )


def files_of(memories: DataFrame, paths: DataFrame, files: DataFrame) -> DataFrame:
    """(rel, id, how, role): memories of the asked files, one row for each.

    memories: (id, cwd); paths: (id, path, role: modified or read); files: (rel, root, names).  Only equal base names meet.  An
    ending counts if no other asked file of that name has it."""
    p = paths.withColumn("base", X.base_name(F.col("path"))).join(memories.select("id", "cwd"), "id")
    f = files.withColumn("base", X.base_name(F.col("rel")))
    met = p.join(f, "base").withColumn("how", placement(F.col("path"), F.col("cwd"), F.col("root"), F.col("rel"), F.col("names"))).where("how <> 'no'")
    alone = F.size(F.collect_set("rel").over(W.partitionBy("id", "path", "how")))  # asked files only
    met = met.withColumn("n", alone).where("how = 'exact' OR n = 1")
    return O.first_per_key(met, ["rel", "id"], F.col("role") != "modified", F.col("how") != "exact", "path").select("rel", "id", "how", "role")


def file_recall(found: DataFrame, memories: DataFrame, edits: DataFrame, most: int = 10) -> DataFrame:
    """(rel, id, rank, note): memories of a file, those that changed it first, then the newest; the note says what has happened to
    it since.  edits: (rel, at): times of its changes."""
    later = found.join(memories.select("id", "created_at"), "id").join(edits, "rel", "left").groupBy("rel", "id", "role", "created_at").agg(F.count_if(F.col("at") > F.col("created_at")).alias("n"), F.max("at").alias("at"))
    note = F.when(F.col("n") == 0, "unchanged since").when(F.col("n") == 1, "changed once since").otherwise(F.concat(F.lit("changed "), F.col("n").cast("string"), F.lit(" times since")))
    order = W.partitionBy("rel").orderBy(F.col("role") != "modified", F.col("created_at").desc(), "id")
    return later.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("rel", "id", "rank", note.alias("note"))


def local_path(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, rel): the longest ending, of two parts or more, of a recorded path that is in a listing (rel)."""
    parts = X.clean_parts(F.col("path"))
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))
    t = paths.select("path").distinct().withColumn("p", parts).where("size(p) >= 2").select("path", F.posexplode(tails).alias("cut", "rel"))
    return t.join(listing.select("rel").distinct(), "rel").groupBy("path").agg(F.min_by("rel", "cut").alias("rel"))


def attribute(added: DataFrame, written: DataFrame) -> DataFrame:
    """added (commit, path, line, text, authored, committed: s) with session_id and ts of the latest edit that wrote the line.

    The edit lies within 14 days before the commit was authored and its later time.  One sort of the union, so a line that is
    everywhere costs no pairs.  Shorter lines take the session of both neighbours in their block.  written: (path, text, ts, session_id)."""
    t = F.trim("text")
    rows = added.withColumns({"_t": t, "_to": F.greatest("authored", "committed") * 1000 + 1, "_k": F.sha2(F.concat_ws("\x00", "path", t), 256)})
    events = written.withColumn("_t", t).where(F.length("_t") >= LEAST).select(F.sha2(F.concat_ws("\x00", "path", "_t"), 256).alias("_k"), F.col("ts").alias("_to"), F.struct("ts", "session_id").alias("_w"))
    events = events.groupBy("_k", "_to").agg(F.max("_w").alias("_w"))
    got = O.as_of(rows.where(F.length("_t") >= LEAST), events, "_k", "_to", "_w", "_g").withColumn("_g", F.when(F.col("_g.ts") >= F.col("authored") * 1000 - LOOKBACK, F.col("_g")))
    short = rows.where(F.length("_t") < LEAST).withColumn("_g", F.lit(None).cast("struct<ts:bigint,session_id:string>"))
    both = got.unionByName(short).withColumns({"session_id": F.col("_g.session_id"), "ts": F.col("_g.ts")})
    filled = O.fill_between(both, ["commit", "path"], "line", "session_id")
    own = F.when(F.length("_t") < LEAST, F.col("filled")).otherwise(F.col("session_id"))
    return filled.withColumn("session_id", own).select(*added.columns, "session_id", "ts")


def totals(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count_distinct("commit").alias("commits"), F.count(F.lit(1)).alias("added"), F.count("session_id").alias("attributed"))


def traces(lines: DataFrame) -> DataFrame:
    """(commit, record_id, trace): for each commit, by path, the line ranges that each session wrote, as JSON."""
    spans = O.islands(lines.where("session_id IS NOT NULL"), ["commit", "path", "session_id"], "line")
    by = spans.groupBy("commit", "path", "session_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    files = by.groupBy("commit", "path").agg(F.array_sort(F.collect_list(F.struct("session_id", "ranges"))).alias("conversations"))
    out = files.groupBy("commit").agg(F.to_json(F.array_sort(F.collect_list(F.struct("path", "conversations")))).alias("trace"))
    return out.select("commit", P.record_id(F.col("commit")).alias("record_id"), "trace")


def edit_lines(calls: DataFrame) -> DataFrame:
    """(id, old, new): lines of at least LEAST characters that a tool call (id, input: JSON) took away and put in.

    Reads a pair of strings, a list of pairs under either spelling, a whole content, and a diff's - and + lines."""
    pair = "struct<old_string: string, new_string: string, oldText: string, newText: string>"
    j = F.from_json("input", f"old_string string, new_string string, content string, diff string, patch string, edits array<{pair}>")
    r = calls.select("id", j.alias("j"))
    olds = F.concat(F.array("j.old_string"), F.transform(F.coalesce("j.edits", F.array().cast(f"array<{pair}>")), lambda e: F.coalesce(e["old_string"], e["oldText"])))
    news = F.concat(F.array(F.coalesce("j.new_string", "j.content")), F.transform(F.coalesce("j.edits", F.array().cast(f"array<{pair}>")), lambda e: F.coalesce(e["new_string"], e["newText"])))
    diff = F.split(F.coalesce("j.diff", "j.patch", F.lit("")), "\n")
    side = lambda mark: F.transform(F.filter(diff, lambda x: x.startswith(mark) & ~x.startswith(mark * 3)), lambda x: F.substring(x, 2, 1 << 20))
    lines = lambda texts, mark: F.filter(F.transform(F.concat(F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.split(t, "\n"))), side(mark)), lambda x: F.trim(x)), lambda x: F.length(x) >= LEAST)
    return r.select("id", lines(olds, "-").alias("old"), lines(news, "+").alias("new"))


def edits_kept(edits: DataFrame, files: DataFrame, most_lines: int = 400, most_edits: int = 20) -> DataFrame:
    """(key, kept, of, left): how much of what a memory's edits (key, edit, path, lines) wrote is still in the files (path, line).

    Lines that a file has more than once prove nothing.  No row for a key of over `most_edits` edits or with a file that isn't there."""
    there = files.select("path").distinct().withColumn("here", F.lit(True))
    fit = edits.join(there, "path", "left").groupBy("key").agg(F.count_distinct("edit").alias("n"), F.bool_and(F.coalesce("here", F.lit(False))).alias("all")).where(F.col("all") & (F.col("n") <= most_edits)).select("key")
    one = edits.join(fit, "key").select("key", "path", F.explode(F.slice("lines", 1, most_lines)).alias("line")).distinct()
    now = files.select("path", F.trim("line").alias("line")).groupBy("path", "line").agg(F.count(F.lit(1)).alias("times"))
    got = one.join(now, ["path", "line"], "left").where("coalesce(times, 0) <= 1").groupBy("key").agg(F.count("times").alias("kept"), F.count(F.lit(1)).alias("of"))
    return got.withColumn("left", P.survival(F.col("kept"), F.col("of")))


def edit_samples(events: DataFrame, n: int, seed: str) -> DataFrame:
    """(id, session_id, path, prompt_id): up to n file edits with the prompt of at least 20 characters before them; 4 n are drawn,
    each file of a session counts once, and paths are relative to the session's folder (cwd)."""
    e = O.sample(events.where("kind = 'file_edit'"), "id", seed, 4 * n)
    p = events.where("kind = 'prompt' AND length(text) >= 20").select("session_id", "id", F.col("id").alias("prompt_id"))
    got = O.as_of(e, p, "session_id", "id", "prompt_id", "prompt_id").where("prompt_id IS NOT NULL")
    cwd = F.concat(F.regexp_replace("cwd", "/+$", ""), F.lit("/"))
    rel = F.when(F.col("path").startswith(cwd), F.substring("path", F.length(cwd) + 1, F.length("path"))).otherwise(F.col("path"))
    return O.first_per_key(got.withColumn("path", rel), ["session_id", "path"], "id").orderBy("id").limit(n).select("id", "session_id", "path", "prompt_id")


def project_of(origin: Column, root: Column, cwd: Column) -> Column:
    """A session's project: its git remote, with #folder where the checkout's name isn't the repository's; else the git root's path,
    else the folder."""
    repo, folder = X.remote_id(origin), X.base_name(F.regexp_replace(F.coalesce(root, cwd), "/+$", ""))
    named = F.when(F.lower(folder) == X.base_name(repo), repo).otherwise(F.concat(repo, F.lit("#"), folder))
    return F.when(F.coalesce(origin, F.lit("")) != "", named).otherwise(F.coalesce(root, cwd))

