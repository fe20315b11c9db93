"""Token counts by a tokenizer compiled to finite-state transducers.

A byte-level BPE vocabulary with word ends is compiled, state by state as texts need it, into a deterministic
transducer over the bytes of a word.  A state holds, for each start from which a token may still be growing: its place
in the trie of tokens, the last token before it, and the number of tokens so far above the least one.  Transitions carry
the number of tokens that are then certain; the last byte of a word carries the rest.  This is exact, because a
sequence of tokens is what the merges give just if each pair of neighbours is (checked by running the merges on the pair).

A second transducer cuts a text into words; it is the library's own pattern.  Long texts go through it in chunks.  A
chunk's state map has two parts: the bytes before its first certain cut, which wait for the entry state, and a count
with an open end after its last one, which don't depend on it.  Maps compose associatively, so a prefix scan (here a
balanced fold) joins them.

Null and empty texts have no tokens.  Strings of special tokens count as one token each, as is the library's default.
Repeated rows are counted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, text_bytes

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Compiled transitions and remembered words that a worker keeps at most; beyond them it starts anew.
STATES, WORDS = 600_000, 200_000
NEVER = 1 << 30
#: Characters of a chunk.
CHUNK = 1 << 16


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by the published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTransducer:
    """Counts the tokens of one word (bytes, not empty)."""

    def __init__(self, vocab: Iterable[str], merges: Iterable[tuple[str, str]], end: str = "</w>"):
        as_byte = byte_symbols()

        def units(token: str) -> tuple[int, ...]:
            """Bytes of a token; 256 more for the one that ends a word."""
            last = token.endswith(end) and token != end
            out = [as_byte[c] for c in (token[: -len(end)] if last else token)]
            return (*out[:-1], out[-1] + 256 * last)

        ids: dict[tuple[int, ...], int] = {}
        number = lambda t: ids.setdefault(t, len(ids))
        self.rank: dict[tuple[int, int], int] = {}  # of a pair of tokens
        self.parts: dict[int, tuple[int, int]] = {}  # the pair that a token is merged from
        for i, (a, b) in enumerate(merges):
            a, b = units(a), units(b)
            pair = number(a), number(b)
            if self.rank.setdefault(pair, i) == i:
                self.parts.setdefault(number(a + b), pair)
        self.kids: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        for token in {units(v) for v in vocab}:
            at = 0
            for u in token:
                nxt = self.kids[at].get(u)
                if nxt is None:
                    nxt = self.kids[at][u] = len(self.kids)
                    self.kids.append({})
                    self.token.append(None)
                at = nxt
            n = number(token)
            if len(token) == 1 or n in self.parts:
                self.token[at] = n
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.whole: dict[int, bool] = {}
        self.fits: dict[tuple, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((0, None, 0),)]
        self.ids: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, int] = {}  # state << 8 | byte -> state << 16 | tokens
        self.ends: dict[int, int] = {}  # state << 8 | byte -> tokens
        self.fits.clear()

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one edge (0: left, 1: right) while a token grows, each with the rank of the merge that ends it."""
        found = self.spines.get((token, side))
        if found is None:
            found, end, at = [], NEVER, token
            while True:
                found.append((at, end))
                if at not in self.parts:
                    break
                end = self.rank[self.parts[at]]
                at = self.parts[at][side]
            found.reverse()
            self.spines[token, side] = found
        return found

    def meets(self, a: int, b: int) -> bool:
        """Whether a merge crosses the border between a and b while they grow; of equal ranks the left one comes first."""
        left, right = self.spine(a, 1), self.spine(b, 0)
        i = j = 0
        while True:
            (x, until), (y, other) = left[i], right[j]
            r = self.rank.get((x, y))
            if r is not None and r < until and r <= other:
                return True
            if until == other == NEVER:
                return False
            if until <= other:
                i += 1
            else:
                j += 1

    def sound(self, token: int) -> bool:
        """Whether the merges make a token of its own bytes."""
        found = self.whole.get(token)
        if found is None:
            pair = self.parts.get(token)
            found = self.whole[token] = pair is None or self.sound(pair[0]) and self.sound(pair[1]) and self.meets_last(*pair)
        return found

    def meets_last(self, a: int, b: int) -> bool:
        """Whether a and b first grow whole and then merge."""
        left, right = self.spine(a, 1), self.spine(b, 0)
        i = j = 0
        while (left[i], right[j]) != (left[-1], right[-1]):
            (x, until), (y, other) = left[i], right[j]
            r = self.rank.get((x, y))
            if r is not None and r < until and r <= other:
                return False
            if until <= other:
                i += 1
            else:
                j += 1
        return True

    def fit(self, a: int | None, b: int) -> bool:
        """Whether the merges leave token b after token a as it is."""
        found = self.fits.get((a, b))
        if found is None:
            found = self.fits[a, b] = self.sound(b) and (a is None or not self.meets(a, b))
        return found

    def _next(self, key: int) -> int:
        state, byte = self.states[key >> 8], key & 255
        grown, last, best = [], None, 0
        for node, before, n in state:
            to = self.kids[node].get(byte)
            if to is None:
                continue
            if self.kids[to]:
                grown.append((to, before, n))
            token = self.token[to]
            if token is not None and last is None and self.fit(before, token):
                last, best = token, n + 1
        if last is None:
            raise ValueError("the vocabulary has no token for a byte")
        grown.append((0, last, best))
        least = min(n for _, _, n in grown)
        new = tuple((node, before, n - least) for node, before, n in grown)
        to = self.ids.get(new)
        if to is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
        out = self.moves[key] = to << 16 | least
        return out

    def _end(self, key: int) -> int:
        for node, before, n in self.states[key >> 8]:
            to = self.kids[node].get((key & 255) + 256)
            token = None if to is None else self.token[to]
            if token is not None and self.fit(before, token):
                self.ends[key] = n + 1
                return n + 1
        raise ValueError("the vocabulary has no token for the end of a word")

    def count(self, word: bytes) -> int:
        if len(self.moves) + len(self.ends) > STATES:
            self.reset()
        state = total = 0
        move, nxt = self.moves.get, self._next
        for b in word[:-1]:
            key = state << 8 | b
            m = move(key)
            if m is None:
                m = nxt(key)
            state = m >> 16
            total += m & 0xFFFF
        key = state << 8 | word[-1]
        n = self.ends.get(key)
        return total + (self._end(key) if n is None else n)


class _Words(dict):
    """Counts of frequent words; a missing one runs through the transducer."""

    def __init__(self, transducer: WordTransducer):
        super().__init__()
        self.run = transducer.count

    def __missing__(self, word: str) -> int:
        n = self.run(word.encode())
        if len(self) >= WORDS:
            self.clear()
        if len(word) <= 24:
            self[word] = n
        return n


PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Behind one of these a new word begins, whatever stood before.
CUT = regex.compile(r"[\s\p{N}]")


class Counter:
    """Tokens of whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.words = _Words(WordTransducer(model["vocab"], merges, model["end_of_word_suffix"]))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = tuple({s[:2] for s in special})

    def run(self, part: str) -> int:
        return sum(map(self.words.__getitem__, PATTERN.findall(part)))

    # a chunk's state map: (head, None, "") without a certain cut, else (head, count, tail)
    def chunk(self, part: str) -> tuple[str, int | None, str]:
        first = CUT.search(part)
        if first is None:
            return part, None, ""
        back = next(i for i in range(len(part), first.end() - 1, -1) if i == first.end() or CUT.match(part[i - 1]))
        return part[: first.end()], self.run(part[first.end() : back]), part[back:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + self.run(a[2] + b[0]) + b[1], b[2])

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library lowers by character, without final forms
        text = text.lower()
        if len(text) <= CHUNK:
            return self.run(text)
        maps = [self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # one round of the scan
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.run(head) + (n or 0) + self.run(tail)

    def count(self, text: str) -> int:
        if self.special is None or not any(m in text for m in self.marks):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs' other columns, n_bytes and n_tokens; columns of docs with one of these two names are left out.

    path: the vocabulary file, in the same place on all executors."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    keep = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in slices(batches, text):
            texts = text_bytes(batch.column(text))
            own = [pa.array([len(x) for x in texts], pa.int64()), pa.array([of.count(x.decode()) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + own, names=[*keep, "n_bytes", "n_tokens"])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text)).mapInArrow(run, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op3_token_counts": (op3_token_counts, None)}
