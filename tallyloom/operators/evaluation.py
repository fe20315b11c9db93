"""Retrieval quality: ranks, AUC, intervals, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lifecycle import numbered

BUCKETS = 1024


def recall_metrics(ranks: DataFrame) -> DataFrame:
    """One row from (q, rank): rank of the target, null if it isn't found."""
    hit = lambda k: F.round(F.avg((F.coalesce(F.col("rank"), F.lit(1 << 30)) <= k).cast("double")), 6)
    return ranks.agg(F.count(F.lit(1)).alias("cases"), hit(1).alias("hit1"), hit(5).alias("hit5"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def auc(scores: DataFrame, score: str, positive: str) -> DataFrame:
    """(pos, neg, auc): the chance that a positive scores above a negative, ties half, by average ranks.

    Scores are counted first, then summed by BUCKETS ranges of equal width: a window runs over the ranges, and one over the distinct
    scores of each."""
    n = scores.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("m"))
    ends = scores.agg(F.min(score).cast("double").alias("a"), F.max(score).cast("double").alias("z")).first()
    wide = ((ends["z"] or 0.0) - (ends["a"] or 0.0)) or 1.0
    n = n.withColumn("_b", F.floor((F.col(score).cast("double") - (ends["a"] or 0.0)) / wide * BUCKETS))
    first = n.groupBy("_b").agg(F.sum("m").alias("_m")).withColumn("_f", F.coalesce(F.sum("_m").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    n = n.join(F.broadcast(first), "_b")  # BUCKETS rows
    below = F.col("_f") + F.coalesce(F.sum("m").over(W.partitionBy("_b").orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = n.withColumn("w", F.col("p") * (below + F.col("m") / 2.0))
    return won.agg(F.sum("p").alias("pos"), F.sum("m").alias("neg"), F.round(F.sum("w") / (F.sum("p") * F.sum("m")), 6).alias("auc"))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high); (0, 0) for no trials."""
    p, zz = k / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    low, high = F.when(n == 0, 0.0).otherwise(mid - half), F.when(n == 0, 0.0).otherwise(mid + half)
    return F.struct(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def kappa(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(shared, agreed, kappa) of two judges' booleans on the keys that both judged."""
    j = a.select(key, F.col(value).cast("double").alias("a")).join(b.select(key, F.col(value).cast("double").alias("b")), key)
    m = j.agg(F.count(F.lit(1)).alias("shared"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("agreed"), F.avg("a").alias("pa"), F.avg("b").alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return m.select("shared", "agreed", F.round(F.when(pe >= 1, 1.0).otherwise((F.col("agreed") / F.col("shared") - pe) / (1 - pe)), 6).alias("kappa"))


def sweep(candidates: DataFrame, first: int = 5, steps: int = 20) -> DataFrame:
    """(t, helpful, unhelpful, prompts) for thresholds 0, 0.05, ...: the first candidates of each q by rank whose score passes (null passes)."""
    t = candidates.withColumn("t", F.explode(F.array(*(F.lit(round(i * 0.05, 2)) for i in range(steps)))))
    kept = t.where(F.col("score").isNull() | (F.col("score") >= F.col("t"))).withColumn("_n", F.row_number().over(W.partitionBy("t", "q").orderBy("rank"))).where(F.col("_n") <= first)
    return kept.groupBy("t").agg(F.count_if("helpful").alias("helpful"), F.count_if(~F.col("helpful")).alias("unhelpful"), F.count_distinct(F.when(F.col("helpful"), F.col("q"))).alias("prompts"))


def draws(groups: int, rounds: int, seed: int) -> Column:
    """The group, from 0, that a draw falls on: `id` counts draws, `groups` of them for each round; 48 bits of a hash of seed, round
    and place, so a draw is the same wherever it is made."""
    place = F.concat_ws(":", F.lit(seed), F.floor(F.col("id") / groups).cast("long"), F.col("id") % groups)
    return F.conv(F.substring(F.md5(place.cast("binary")), 1, 12), 16, 10).cast("long") % groups


def bootstrap_auc(scores: DataFrame, group: str, a: str, b: str, positive: str, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """(mean, low, high, share): of the difference of two scores' AUC over resampled groups the mean, the 95 % interval and the share
    above 0.

    Each round draws as many groups as there are, with replacement, from counter-based random numbers: a plan of any partitions
    draws the same.  Bounds are elements floor((n - 1) p) of the sorted differences; rounds that lack either kind don't count.
    group: a whole number."""
    known = numbered(scores.select(group).distinct(), group, 0, "_g")
    n = known.count()
    if not n:
        return scores.sparkSession.createDataFrame([(None,) * 4], "mean double, low double, high double, share double")
    spark = scores.sparkSession
    picked = spark.range(n * rounds).select(F.floor(F.col("id") / n).alias("round"), draws(n, rounds, seed).alias("_g")).groupBy("round", "_g").agg(F.count(F.lit(1)).alias("w"))
    rows = picked.join(scores.join(known, group), "_g")

    def one(score: str) -> DataFrame:
        n = rows.groupBy("round", score).agg(F.sum(F.col("w") * F.col(positive).cast("int")).alias("p"), F.sum(F.col("w") * (~F.col(positive)).cast("int")).alias("m"))
        below = F.coalesce(F.sum("m").over(W.partitionBy("round").orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        won = n.withColumn("x", F.col("p") * (below + F.col("m") / 2.0)).groupBy("round").agg(F.sum("x").alias("x"), F.sum("p").alias("p"), F.sum("m").alias("m"))
        return won.where("p > 0 AND m > 0").select("round", (F.col("x") / (F.col("p") * F.col("m"))).alias(f"auc_{score}"))

    d = one(a).join(one(b), "round").select(F.round(F.col(f"auc_{a}") - F.col(f"auc_{b}"), 9).alias("d"))
    d = d.withColumns({"i": F.row_number().over(W.orderBy("d")) - 1, "n": F.count(F.lit(1)).over(W.partitionBy())})  # a row for each round
    at = lambda p: F.max(F.when(F.col("i") == F.floor((F.col("n") - 1) * p), F.col("d")))
    return d.agg(F.round(F.avg("d"), 6).alias("mean"), F.round(at(0.025), 6).alias("low"), F.round(at(0.975), 6).alias("high"), F.round(F.avg((F.col("d") > 0).cast("double")), 6).alias("share"))


def percentile_by_counts(df: DataFrame, keys: list[str], value: str, p: float, rule: str, name: str = "value") -> DataFrame:
    """(keys, name, n): an element of each group's sorted values; see the rules below.  Values are counted first, and no group is held
    as a list: rounded (half away from zero) or floor of (n - 1) p, nearest rank of n p, or half (n // 2)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    rows = counts.join(n, keys).withColumn("_to", F.sum("_c").over(W.partitionBy(*keys).orderBy(value)))
    at = {"rounded": F.round((F.col("n") - 1) * p), "floor": F.floor((F.col("n") - 1) * p), "nearest": F.least(F.greatest(F.ceil(F.col("n") * p), F.lit(1)), F.col("n")) - 1, "half": F.floor(F.col("n") / 2)}[rule]
    return rows.where(F.col("_to") > at).groupBy(*keys, "n").agg(F.min(value).alias(name))


def recall_report(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row from cases (q, targets: ids, empty where nothing should come) and ranked (q, id, rank): cases, hit1, hit5, mrr, precision5
    over cases with results, silent, negatives, false_alarms."""
    hits = ranked.join(cases.select("q", "targets"), "q").withColumn("hit", F.array_contains("targets", F.col("id")))
    g = hits.groupBy("q").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.avg(F.when(F.col("rank") <= 5, F.col("hit").cast("double"))).alias("precision"), F.count(F.lit(1)).alias("n"))
    r = cases.join(g, "q", "left").withColumn("positive", F.size("targets") > 0)
    yes = lambda c: F.when(F.col("positive"), c)
    share = lambda c: F.round(F.coalesce(F.avg(yes(c)), F.lit(0.0)), 6)
    first = F.coalesce("first", F.lit(1 << 30))
    return r.agg(
        F.count_if("positive").alias("cases"), F.count_if(F.col("positive") & (first <= 1)).alias("hit1"), F.count_if(F.col("positive") & (first <= 5)).alias("hit5"), share(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        share(F.col("precision")).alias("precision5"), F.count_if(F.col("positive") & F.col("n").isNull()).alias("silent"), F.count_if(~F.col("positive")).alias("negatives"), F.count_if(~F.col("positive") & F.col("n").isNotNull()).alias("false_alarms"),
    )


def judged_report(ranked: DataFrame, judgments: DataFrame, other: DataFrame, first: int = 5) -> DataFrame:
    """One row from ranked (q, id, rank), judgments (q, id, relevant) and another ranking: shown, right, prompts with a right one, shown
    ones without a judgment, and those that the other ranking shows, too."""
    top = ranked.where(F.col("rank") <= first)
    j = top.join(judgments, ["q", "id"], "left").join(other.where(F.col("rank") <= first).select("q", "id", F.lit(True).alias("_o")), ["q", "id"], "left")
    return j.agg(F.count(F.lit(1)).alias("shown"), F.count_if("relevant").alias("right"), F.count_distinct(F.when(F.col("relevant"), F.col("q"))).alias("helped"), F.count_if(F.col("relevant").isNull()).alias("unjudged"), F.count_if(F.coalesce("_o", F.lit(False))).alias("overlap"))


def target_cosines(near: DataFrame, targets: DataFrame, pool: int = 500) -> DataFrame:
    """(q, target, wrong): cosine of each question's own memory (targets: q, id) and of the best other one, both among the first `pool`."""
    rows = near.where(F.col("rank") <= pool).join(targets.select("q", F.col("id").alias("_t")), "q")
    return rows.groupBy("q").agg(F.max(F.when(F.col("id") == F.col("_t"), F.col("cosine"))).alias("target"), F.max(F.when(F.col("id") != F.col("_t"), F.col("cosine"))).alias("wrong"))


def majority(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, passed, pass, points, worst, ms) of repeated runs (keys, run, pass, points, ms): passed if most did; points and run of the
    worst one (failed before passed, then fewest points); the middle time."""
    g = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("pass").alias("passed"), F.min(F.struct("pass", "points", "run")).alias("w"))
    ms = percentile_by_counts(runs, keys, "ms", 0.5, "half", "ms").drop("n")
    return g.join(ms, keys, "left").select(*keys, "n", "passed", (F.col("passed") * 2 > F.col("n")).alias("pass"), F.col("w.points").alias("points"), F.col("w.run").alias("worst"), "ms")


def class_report(cases: DataFrame, without_answer: tuple[str, ...] = ("neg", "control")) -> DataFrame:
    """(part, class, total, passed) of cases (class, pass): by class, and all that have an answer against all that have none."""
    one = lambda part, by: cases.groupBy(by.alias("class")).agg(F.count(F.lit(1)).alias("total"), F.count_if("pass").alias("passed")).select(F.lit(part).alias("part"), "class", "total", "passed")
    return one("class", F.col("class")).unionByName(one("kind", F.when(F.col("class").isin(*without_answer), "neg").otherwise("answerable")))


#: Rules of a release: (metric, how, slack).  drop: at most so much below the baseline; rise: at most so much above; least and most:
#: fixed limits, whatever the baseline has.
RULES: tuple[tuple[str, str, float], ...] = (
    ("cases", "least", 1), ("hit1", "drop", 0.026), ("hit5", "drop", 0.026), ("mrr", "drop", 0.02), ("precision5", "drop", 0.03), ("silent", "rise", 2), ("false_alarms", "rise", 1), ("vague_hit5", "drop", 0.05),
    ("vague_silent", "rise", 2), ("real_right", "drop", 3), ("real_helped", "drop", 3), ("real_shown", "rise", 30), ("real_unjudged", "most", 25), ("recent_hit5", "drop", 0.05), ("files_right", "drop", 3),
    ("files_shown", "rise", 20), ("search_hit1", "drop", 0.026), ("search_hit5", "drop", 0.026), ("search_mrr", "drop", 0.02), ("leaks", "most", 0), ("before_leaks", "most", 0), ("p50_ms", "rise", 20), ("p95_ms", "most", 300),
    ("hook_failures", "most", 0), ("history_passed", "drop", 1),
)


def gate(baseline: DataFrame, candidate: DataFrame, rules: tuple[tuple[str, str, float], ...] = RULES) -> DataFrame:
    """(metric, baseline, candidate, limit, pass) of two tables (metric, value); a metric that the candidate lacks fails, one that the
    baseline lacks is held to fixed limits only."""
    r = baseline.sparkSession.createDataFrame([(m, h, float(x)) for m, h, x in rules], "metric string, how string, slack double")
    j = r.join(baseline.select("metric", F.col("value").alias("b")), "metric", "left").join(candidate.select("metric", F.col("value").alias("c")), "metric", "left")
    limit = F.when(F.col("how") == "drop", F.col("b") - F.col("slack")).when(F.col("how") == "rise", F.col("b") + F.col("slack")).otherwise(F.col("slack"))
    good = F.when(F.col("how").isin("drop", "least"), F.col("c") >= limit - 1e-9).otherwise(F.col("c") <= limit + 1e-9)
    return j.select("metric", F.round("b", 6).alias("baseline"), F.round("c", 6).alias("candidate"), F.round(limit, 6).alias("limit"), F.when(F.col("c").isNull(), False).when(limit.isNull(), True).otherwise(good).alias("pass"))


def as_metrics(row: DataFrame, prefix: str = "") -> DataFrame:
    """(metric, value) of a table of one row."""
    return row.select(F.explode(F.array(*(F.struct(F.lit(prefix + c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns))).alias("x")).select("x.*")


def history_pass(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(case, class, points, pass) of answers (case, text, abstained) to cases (case, class, expect, must_not, abstain): a case that has no
    answer passes if the reply abstains; others if all expected words come, none that must not, and the reply doesn't abstain."""
    a = cases.join(answers, "case", "left").withColumn("t", F.lower(F.coalesce("text", F.lit(""))))
    found = F.size(F.filter("expect", lambda w: F.contains(F.col("t"), F.lower(w))))
    bad = F.size(F.filter("must_not", lambda w: F.contains(F.col("t"), F.lower(w))))
    quiet = F.coalesce("abstained", F.lit(True))
    return a.select("case", "class", found.alias("points"), F.when(F.col("abstain"), quiet).otherwise(~quiet & (found == F.size("expect")) & (bad == 0)).alias("pass"))


def arms(cases: DataFrame, ranks: DataFrame) -> DataFrame:
    """(arm, cases, opened, top5) of a trial: ranks (case, arm, rank: of the target, opened)."""
    r = cases.select("case").join(ranks, "case")
    return r.groupBy("arm").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.coalesce("opened", F.lit(False))).alias("opened"), F.count_if(F.coalesce(F.col("rank") <= 5, F.lit(False))).alias("top5"))


def alerts(facts: DataFrame, limits: dict[str, tuple[str, float, str]]) -> DataFrame:
    """(alert, value, severity) of facts (fact, value) beyond their limits (fact -> over or under, limit, severity); a missing fact is one, too."""
    l = facts.sparkSession.createDataFrame([(k, *v) for k, v in limits.items()], "fact string, how string, bound double, severity string")
    j = l.join(facts, "fact", "left")
    return j.where(F.col("value").isNull() | F.when(F.col("how") == "over", F.col("value") > F.col("bound")).otherwise(F.col("value") < F.col("bound"))).select(F.col("fact").alias("alert"), "value", F.when(F.col("value").isNull(), "missing").otherwise(F.col("severity")).alias("severity"))


#: Parts of names of models that don't write text, and words of names of the cheaper ones.
NOT_TEXT = ("image", "embedding", "tts", "whisper", "review", "realtime", "audio")
CHEAP = ("lite", "flash", "haiku", "luna", "mini", "nano", "small")


def http_failure(code: Column) -> Column:
    """struct(action, wait_min): what a call's HTTP status asks for; a rejected key is the endpoint's fault and no model's."""
    wait = F.when(code.isin(402, 429), 30).when(code.isin(403, 404), 360).when(code != 401, 5)
    return F.struct(F.when(code == 401, "endpoint").otherwise("next_model").alias("action"), wait.alias("wait_min"))


def looks_cheap(model: Column) -> Column:
    """Whether one of a name's words, not only a part of one, marks a cheaper model."""
    return F.arrays_overlap(F.split(F.lower(model), "[^a-z0-9]"), F.array(*map(F.lit, CHEAP)))


def model_order(models: DataFrame, group: str, order: str, now: Column, auto: bool = True) -> DataFrame:
    """models (group, order, model, place, available, until) with `rank`, the order in which a group tries them: the chain by its places,
    then, with auto, other models of text, the cheaper first; not those unavailable or cooling down until later than now."""
    told = F.lower("model")
    text = ~F.array_contains(F.transform(F.array(*map(F.lit, NOT_TEXT)), lambda x: F.contains(told, x)), True)
    open_ = F.col("available") & (F.coalesce(F.col("until"), now) <= now)
    kept = models.where(open_ & (F.col("place").isNotNull() | (F.lit(auto) & text)))
    cheap = F.when(F.col("place").isNull(), ~looks_cheap(F.col("model")))
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.col("place").isNull(), "place", cheap, order)))
