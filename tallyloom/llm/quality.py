"""Quality rules by weak supervision, in DataFrame functions only.

Rules vote 1 (good), -1 (bad) or 0 (abstain) on each document.  Expectation-maximisation over the counts of vote
patterns (3^rules rows at most, however large the corpus) estimates the share of good documents and two accuracies of each
rule: how often its vote is right on good documents and how often on bad ones.  A rule that seldom votes against a good
document weighs much when it does.  A document's posterior probability of being good replaces "all rules must pass".

Nulls and blank texts have no words: all counts are 0, the base check fails and they aren't kept.  Repeated rows are
judged one by one and alike.  An empty table gives an empty result.  A posterior of exactly `least` is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, stash, table

#: Frequent function words of the four languages; their share of a text is a rule.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "de", "la", "le", "les", "des", "et", "que", "en", "el", "los", "por", "para", "der", "die", "das", "und", "den", "von")
ROUNDS, LEAST, SMOOTH = 40, 0.5, 2.0
LOW, HIGH = 0.02, 0.98  # bounds of what is estimated, so that no rule decides alone
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_stops", "n_ends")
OWN = "__quality_"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds COUNTS, each named with the prefix OWN.

    n_repeat_words compares 64-bit hashes of a text's three-word windows (chained over the three words)."""
    o = lambda n: f"`{OWN}{n}`"
    c = lambda n: F.col(o(n))
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(BLANKS))
    out = docs.withColumn(f"{OWN}words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN)))
    n, w = F.size(c("words")), c("words")
    spans = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))))
    out = out.withColumns({
        f"{OWN}spans": F.coalesce(spans, F.array().cast("array<bigint>")),
        f"{OWN}lines": F.filter(F.split(body, "\n"), lambda x: F.translate(x, BLANKS, "") != ""),
    })
    repeated = F.size(F.array_distinct(c("spans"))) < F.size(c("spans"))
    out = out.withColumn(f"{OWN}sorted", F.when(repeated, F.sort_array(F.transform(c("spans"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = c("sorted")
    at = lambda i: F.get(s, i)["x"]
    twice = F.filter(s, lambda e, i: F.coalesce(at(i - 1) == e["x"], F.lit(False)) | F.coalesce(at(i + 1) == e["x"], F.lit(False)))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(F.sort_array(F.transform(twice, lambda e: e["i"])), start, lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])
    out = out.withColumns({
        f"{OWN}{k}": v.cast("long")
        for k, v in {
            "n_words": n,
            "word_chars": F.length(F.translate(body, BLANKS, "")),
            "n_symbols": F.length(body) - F.length(F.translate(body, "#*$%&|<>", "")),
            "n_lines": F.size(c("lines")),
            "n_dup_lines": F.size(c("lines")) - F.size(F.array_distinct(c("lines"))),
            "n_repeat_words": F.coalesce(covered, F.lit(0)),
            "n_letters": F.length(F.regexp_replace(body, r"[^\p{L}]+", "")),
            "n_stops": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))),
            "n_ends": F.length(body) - F.length(F.translate(body, ".!?", "")),
        }.items()
    })
    return out.drop(*(f"{OWN}{k}" for k in ("words", "spans", "lines", "sorted")))


#: Rules as (name, good if, bad if) over COUNTS, in SQL that Spark and DuckDB read alike; neither: abstain.
RULES = (
    ("length", "n_words >= 80", "n_words < 50"),
    ("word_length", "word_chars >= 3 * n_words AND word_chars <= 9 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    ("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("lines", "n_lines >= 3 AND n_dup_lines = 0", "4 * n_dup_lines > n_lines"),
    ("repeats", "20 * n_repeat_words <= n_words", "4 * n_repeat_words > n_words"),
    ("letters", "10 * n_letters >= 9 * word_chars", "10 * n_letters < 7 * word_chars"),
    ("stops", "100 * n_stops >= 12 * n_words", "100 * n_stops < 6 * n_words"),
    ("ends", "30 * n_ends >= n_words", "80 * n_ends < n_words"),
)


def base_failed(prefix: str = "") -> str:
    return f"(`{prefix}n_words` < 50 OR 100 * `{prefix}n_repeat_words` > 50 * `{prefix}n_words`)"


def votes(rules=RULES) -> list[Column]:
    def own(sql: str) -> str:
        for k in COUNTS:
            sql = sql.replace(k, f"`{OWN}{k}`")
        return sql

    return [F.expr(f"CASE WHEN {own(good)} THEN 1 WHEN {own(bad)} THEN -1 ELSE 0 END") for _, good, bad in rules]


def fit(patterns: DataFrame, k: int, rounds: int = ROUNDS) -> list[float]:
    """[share of good documents, each rule's share of good votes on good documents, the same on bad ones] from (v: array<int>, n: long),
    one row for each pattern.

    All rounds are one SQL expression over the bounded list of patterns; only the 2 k + 1 estimates reach the driver.  A rule
    votes for bad documents at most as often as for good ones, so that it can't turn into its opposite."""
    rows = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"))
    p = F.col("p")
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    bound = lambda x: F.least(F.greatest(x, F.lit(LOW)), F.lit(HIGH))

    def step(theta: Column, _: Column) -> Column:
        g, b = F.slice(theta, 2, k), F.slice(theta, 2 + k, k)
        weights = F.zip_with(g, b, lambda x, y: F.struct(F.log(x / y).alias("for"), F.log((1 - x) / (1 - y)).alias("against")))
        share = F.element_at(theta, 1)

        def of(x: Column) -> Column:
            said = F.zip_with(x["v"], weights, lambda v, w: F.when(v == 1, w["for"]).when(v == -1, w["against"]).otherwise(0.0))
            vote = F.aggregate(said, F.lit(0.0), lambda s, y: s + y)
            return F.struct(x["v"].alias("v"), x["n"].cast("double").alias("n"), (1 / (1 + F.exp(-(F.log(share / (1 - share)) + vote)))).alias("q"))

        def renew(post: Column) -> Column:
            new = bound((total(post, lambda x: x["n"] * x["q"]) + SMOOTH / 2) / (total(post, lambda x: x["n"]) + SMOOTH))

            def rate(i: Column, side) -> tuple[Column, Column]:
                good = total(post, lambda x: x["n"] * side(x["q"]) * (F.element_at(x["v"], i) == 1).cast("double"))
                return good, total(post, lambda x: x["n"] * side(x["q"]) * F.abs(F.element_at(x["v"], i)))

            def on_good(i: Column) -> Column:
                right, voted = rate(i, lambda q: q)
                return bound((right + SMOOTH * 0.8) / (voted + SMOOTH))

            def on_bad(i: Column) -> Column:
                wrong, voted = rate(i, lambda q: 1 - q)
                return F.least(bound((wrong + SMOOTH * 0.2) / (voted + SMOOTH)), on_good(i))

            each = F.sequence(F.lit(1), F.lit(k))
            return F.concat(F.array(new), F.transform(each, on_good), F.transform(each, on_bad))

        return _let(F.transform(p, of), renew)

    theta = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(F.lit(0.8), *[F.lit(0.8)] * k, *[F.lit(0.2)] * k), step)
    return list(rows.select(theta.alias("t")).first()["t"])


def posterior(theta: list[float], rules=RULES) -> Column:
    import math

    k = len(rules)
    score = F.lit(math.log(theta[0] / (1 - theta[0])))
    for v, g, b in zip(votes(rules), theta[1 : 1 + k], theta[1 + k :], strict=True):
        score = score + F.when(v == 1, math.log(g / b)).when(v == -1, math.log((1 - g) / (1 - b))).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def passing(rows: DataFrame, more: Column | None = None) -> DataFrame:
    """Rows (with counts) that pass the base check, and `more`.

    The row number is there so that the filter isn't moved below the counts, which would work them out once for each mention."""
    rows = rows.withColumn(f"{OWN}row", F.monotonically_increasing_id())
    keep = F.expr(f"`{OWN}row` >= 0 AND NOT {base_failed(OWN)}")
    return rows.where(keep if more is None else keep & more)


def learn(docs: DataFrame, text: str = "text", counted: bool = False) -> list[float]:
    """The estimates from all documents that pass the base check."""
    rows = docs if counted else with_counts(docs.select(text), text)
    patterns = passing(rows).groupBy(F.array(*votes()).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return fit(patterns, len(RULES))


def judge(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with all their columns and quality_prob; rows below `least` or failing the base check go.

    The texts are read twice (estimates, verdicts) rather than stored or joined; no text is shuffled."""
    theta = learn(docs, text)
    out = passing(with_counts(docs, text), posterior(theta) >= least)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base check and verdict for every document."""
    rows = stash(with_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality")
    theta = learn(rows, counted=True)
    failed = F.expr(base_failed(OWN))
    prob = posterior(theta)
    return rows.select(
        "doc_id", *(F.col(f"{OWN}{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"), (~failed & (prob >= LEAST)).alias("kept"), F.round(prob, 4).alias("quality_prob"),
    )


_K = len(RULES)
_SCORE = "ln(t[1] / (1 - t[1]))" + "".join(f" + CASE v[{k}] WHEN 1 THEN ln(t[{k + 1}] / t[{k + 1 + _K}]) WHEN -1 THEN ln((1 - t[{k + 1}]) / (1 - t[{k + 1 + _K}])) ELSE 0 END" for k in range(1, _K + 1))
OP2_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), spans AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM spans) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), f AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters,
    len(list_filter(w, lambda x: x IN ({", ".join(f"'{s}'" for s in STOP_WORDS)}))) AS n_stops,
    length(text) - length(regexp_replace(text, '[.!?]+', '', 'g')) AS n_ends
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), v AS (
  SELECT *, [{", ".join(f"CASE WHEN {g} THEN 1 WHEN {b} THEN -1 ELSE 0 END" for _, g, b in RULES)}] AS v,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM f
), p AS (
  SELECT v, count(*)::DOUBLE AS n FROM v WHERE NOT base_failed GROUP BY v
), em AS (
  SELECT 0 AS it, [0.8::DOUBLE, {", ".join(["0.8::DOUBLE"] * _K + ["0.2::DOUBLE"] * _K)}] AS t
  UNION ALL
  SELECT it + 1, (
    SELECT list_concat([share], list_concat(g, list_transform(list_zip(g, b), lambda x: least(x[1], x[2])))) FROM (
      SELECT least(greatest((sum(n * q) + {SMOOTH / 2}) / (sum(n) + {SMOOTH}), {LOW}::DOUBLE), {HIGH}::DOUBLE) AS share,
        [{", ".join(f"least(greatest((sum(CASE v[{k}] WHEN 1 THEN n * q ELSE 0 END) + {SMOOTH * 0.8}) / (sum(n * q * abs(v[{k}])) + {SMOOTH}), {LOW}::DOUBLE), {HIGH}::DOUBLE)" for k in range(1, _K + 1))}] AS g,
        [{", ".join(f"least(greatest((sum(CASE v[{k}] WHEN 1 THEN n * (1 - q) ELSE 0 END) + {SMOOTH * 0.2}) / (sum(n * (1 - q) * abs(v[{k}])) + {SMOOTH}), {LOW}::DOUBLE), {HIGH}::DOUBLE)" for k in range(1, _K + 1))}] AS b
      FROM (SELECT v, n, 1 / (1 + exp(-({_SCORE}))) AS q FROM p))
  ) FROM em WHERE it < {ROUNDS}
), best AS (SELECT t FROM em WHERE it = {ROUNDS}
), r AS (
  SELECT v.*, 1 / (1 + exp(-({_SCORE}))) AS q FROM v, best
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND q >= {LEAST} AS kept, round(q, 4) AS quality_prob
FROM r
"""

QUERIES = {"op2_quality_rules": (op2_quality_rules, OP2_SQL)}
