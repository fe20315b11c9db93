"""Column functions on records: names of models, ids, failures, prefixes, excerpts, pasted blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import head

PASTED = r"(?s)<pasted_content[^>]*>(.*?)</pasted_content[^>]*>"
PASTED_OPEN = r"(?s)<pasted_content[^>]*>(.*)$"

#: Beginnings of model names by provider.
PROVIDERS = (("anthropic", "^claude"), ("openai", "^(gpt|codex|o[0-9])"), ("google", "^gemini"))

#: Words of failure messages, and the wait they ask for in minutes.
SIGN_IN = ("not logged in", "please log in", "/login", "authentication", "authenticate", "unauthorized", "invalid api key", "session expired", "token expired", "could not be refreshed", "codex login")
QUOTA = ("usage limit", "rate limit", "quota", "limit reached", "too many requests", "429")
MODEL = ("model", "not found", "not available", "does not exist", "unsupported")


def model_id(name: Column) -> Column:
    """provider/name for known makers, without routing prefixes; other names as they are."""
    base = F.element_at(F.split(name, "/"), -1)
    out = None
    for provider, pattern in PROVIDERS:
        hit, value = base.rlike(pattern), F.concat(F.lit(provider + "/"), base)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(name)


def record_id(commit: Column, seed: str = "tallyloom-record:") -> Column:
    """A UUID (version 5 shape) that a commit always gets again."""
    h = F.sha2(F.concat(F.lit(seed), commit), 256)
    nibble = lambda at, keep, add: F.lower(F.hex(F.conv(F.substring(h, at, 1), 16, 10).cast("int").bitwiseAND(keep).bitwiseOR(add)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(nibble(13, 0, 5), F.substring(h, 14, 3)), F.concat(nibble(17, 3, 8), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def failure(message: Column) -> Column:
    """struct(action, wait_min): what to do after a failed call."""
    low = F.lower(message)

    def has(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    action = F.when(has(SIGN_IN), "sign_in").otherwise("next_model")
    wait = F.when(has(SIGN_IN), F.lit(None).cast("int")).when(has(QUOTA), 30).when(has(MODEL), 360).otherwise(5)
    return F.struct(action.alias("action"), wait.alias("wait_min"))


def merge_prefix(prefix: Column) -> Column:
    """A usable prefix, trimmed of blanks and slashes; null if it isn't 1 to 40 letters, digits, dots, underscores or hyphens."""
    p = F.regexp_replace(F.trim(prefix), "^/+|/+$", "")
    return F.when(p.rlike("^[A-Za-z0-9._-]{1,40}$"), p)


def default_prefix(host: Column) -> Column:
    p = F.substring(F.regexp_replace(F.coalesce(host, F.lit("")), "[^A-Za-z0-9._-]", ""), 1, 40)
    return F.when(p == "", "team").otherwise(p)


def survival(kept: Column, of: Column) -> Column:
    """How much of an edit is left: intact from four in five lines, partly from one in five, else gone."""
    return F.when(kept * 5 >= of * 4, "intact").when(kept * 5 >= of, F.concat_ws(" of ", kept.cast("string"), of.cast("string"))).otherwise("gone")


def excerpt(text: Column, most: int) -> Column:
    """At most `most` characters: to the last end of a sentence in the second half, else the last blank there, else a hard cut."""
    cut = F.substring(text, 1, most)
    half = most // 2
    sentence = F.regexp_extract(cut, r"(?s)^(.{%d,}[.!?;])\s" % max(half - 1, 0), 1)
    word = F.regexp_extract(cut, r"(?s)^(.{%d,})\s" % half, 1)
    best = F.when(sentence != "", sentence).when(word != "", word).otherwise(cut)
    return F.when(F.length(text) > most, F.concat(F.rtrim(best), F.lit("…"))).otherwise(text)


def brief(json: Column) -> Column:
    """k=v of a JSON object's plain fields, each value's first 80 characters; a JSON string's first 200; else empty."""
    fields = F.filter(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: e["value"].isNotNull() & ~e["value"].startswith("{") & ~e["value"].startswith("["))
    shown = F.array_join(F.transform(fields, lambda e: F.concat(e["key"], F.lit("="), head(e["value"], 80))), " ")
    quoted = F.from_json(F.concat(F.lit('{"s":'), json, F.lit("}")), "s string")["s"]
    return F.when(F.ltrim(json).startswith("{"), F.coalesce(shown, F.lit(""))).when(F.ltrim(json).startswith('"'), F.coalesce(head(quoted, 200), F.lit(""))).otherwise(F.lit(""))


def strip_pasted(text: Column) -> Column:
    """Pasted blocks as a mark with their size in bytes; one that doesn't end takes the rest, its size with a plus."""

    def swap(t: Column, pattern: str, mark: str) -> Column:
        between = F.split(t, pattern)
        marks = F.transform(F.regexp_extract_all(t, F.lit(pattern), 1), lambda x: F.concat(F.lit("[pasted "), F.octet_length(x).cast("string"), F.lit(mark)))
        return F.array_join(F.zip_with(between, marks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return swap(swap(text, PASTED, " chars]"), PASTED_OPEN, "+ chars]")


def shown_citations(text: Column, shown: Column) -> Column:
    """Numbers cited as E12 in a text that are among those shown, ascending."""
    cited = F.transform(F.regexp_extract_all(text, F.lit(r"\bE(\d{1,18})\b"), 1), lambda x: x.cast("long"))
    return F.array_sort(F.array_distinct(F.array_intersect(cited, shown)))
