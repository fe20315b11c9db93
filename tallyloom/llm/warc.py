"""WARC archives with a two-level capture index.

Pages are written in order of their reversed-host URL key: one gzip member per record, archives of about ARCHIVE_MB.
The same task cuts the index lines of its records into blocks of BLOCK lines, compresses each and appends it to an index
file; the sparse directory keeps one row per block (first key, file, offset, length).  A lookup finds the last
directory row not after its key, reads that block's range, searches it, and range-reads the records.  Many keys are looked
up at once, segment by segment of the directory.

Of records with equal payloads of at least LEAST bytes, that with the smallest page id is a response and the others
revisit it.  Rows that share the smallest id are all responses; a null id is never the smallest one unless all are null,
and then all are responses.  Null html is an empty payload; a null or unusable URL is its own key.  Repeated rows give
repeated records.  An empty table gives no archives and an empty result.

Files go to a new folder below spark.checkpoint.dir, by a name that no other attempt has; only those that a finished task
reports are ever read, so lost executors and repeated attempts leave nothing wrong.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small, stash, table

LEAST, BLOCK, ARCHIVE_MB, LEVEL = 100, 256, 32, 5
READ, SEGMENT = 4 << 20, 512  # bytes of a read, blocks of a segment of the directory
DATE = "2024-01-01T00:00:00Z"
DIRECTORY = "first_key string, last_key string, file string, offset long, length long, n int"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
SPLIT = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^#]*)"


def url_key(url):
    """The host's parts reversed, then path and query: http://a.b.c/d?e -> c,b,a)/d?e."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, SPLIT, 1))
    turned = F.concat_ws(")", F.array_join(F.reverse(F.split(host, r"\.")), ","), F.regexp_replace(F.regexp_extract(url, SPLIT, 2), "^$", "/"))
    return F.when(host == "", url).otherwise(turned)


def record_urn(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, kind: str) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_urn(page)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {json.dumps(page)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_urn(refers)}", f"X-Refers-To-Page-Id: {json.dumps(refers)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; the payload's digest and size are worked out anew where the record has the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    out = {"page_id": json.loads(fields["X-Page-Id"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": json.loads(fields.get("X-Refers-To-Page-Id", "null")), "payload": payload}
    if kind == "revisit":
        size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
        return out | {"payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload": None}
    digest = hashlib.sha256(payload).hexdigest()
    if fields["WARC-Payload-Digest"] != f"sha256:{digest}":
        raise ValueError(f"the payload of page {out['page_id']} differs from its digest")
    return out | {"payload_bytes": len(payload), "payload_digest": digest}


def packed(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives and index blocks; the directory, one row per block (DIRECTORY)."""
    rows = pages.select(F.col(id).cast("long").alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumns({"key": url_key(F.col("url")), "digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    meta = stash(rows.select("page", "digest", "size"), "warc-meta")
    groups = meta.where(f"size >= {LEAST}").groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = small(stash(groups, "warc-first"))
    total = meta.agg(F.sum("size")).first()[0] or 0
    revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("page") == F.col("first"), F.lit(False))
    typed = rows.join(firsts, "digest", "left").withColumn("refers", F.when(revisit, F.col("first"))).drop("first")
    parts = max(1, -(-total // (ARCHIVE_MB << 20)))
    ordered = typed.repartitionByRange(max(parts, rows.sparkSession.sparkContext.defaultParallelism), "key", "page").sortWithinPartitions("key", "page")
    columns = ["page", "url", "html", "digest", "refers", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, blocks, at, index_at = None, [], [], 0, 0
        name = uuid.uuid4().hex

        def flush() -> None:
            nonlocal index_at, lines
            data = packed(b"".join(x for _, x in lines))
            index.write(data)
            blocks.append((lines[0][0], lines[-1][0], f"{folder}/{name}.idx.gz", index_at, len(data), len(lines)))
            index_at, lines = index_at + len(data), []

        for batch in batches:
            for i in range(batch.num_rows):
                page, url_, html_, digest, refers, key = (batch.column(c)[i].as_py() for c in columns)
                if out is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    out, index = store.open_output_stream(f"{base}/{name}.warc.gz", compression=None), store.open_output_stream(f"{base}/{name}.idx.gz", compression=None)
                data = packed(record(page, url_, html_.encode(), digest, refers, "response" if refers is None else "revisit"))
                out.write(data)
                lines.append((key, json.dumps([key, page, digest, f"{name}.warc.gz", at, len(data)]).encode() + b"\n"))
                at += len(data)
                if len(lines) == BLOCK:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["first_key", "last_key", "file", "offset", "length", "n"])

    return stash(ordered.select(*columns).mapInArrow(run, DIRECTORY), "warc-directory")


def ranged(path: str, offset: int, length: int) -> bytes:
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_file(base) as f:
        return f.read_at(length, offset)


def block_lines(file: str, offset: int, length: int) -> list[list]:
    """[key, page, digest, archive, offset, length] of a block."""
    return [json.loads(x) for x in zlib.decompress(ranged(file, offset, length), 31).splitlines()]


def records_of(folder: str, lines: list[list]) -> Iterator[dict]:
    """The records of index lines, neighbours by one read of up to READ bytes."""
    held: tuple = ()
    for i, (_, _, _, name, at, n) in enumerate(lines):
        if not held or held[0] != name or at < held[1] or at + n > held[1] + len(held[2]):
            end = at + n
            for other in lines[i + 1 :]:
                if other[3] != name or other[4] != end or other[4] + other[5] - at > READ:
                    break
                end += other[5]
            held = (name, at, ranged(f"{folder}/{name}", at, end - at))
        yield parse(zlib.decompress(held[2][at - held[1] : at - held[1] + n], 31))


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def batched(records: Iterator[dict], payload: bool) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for r in records:
        out.append(r if payload else r | {"payload": None})
        size += len(out[-1]["payload"] or b"") + 1000
        if size > READ:
            yield pa.RecordBatch.from_pylist(out, _RECORDS)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, _RECORDS)


def read_records(directory: DataFrame, payload: bool = True) -> DataFrame:
    """All records (RECORDS), block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = block_lines(row["file"], row["offset"], row["length"])
                yield from batched(records_of(row["file"].rpartition("/")[0], lines), payload)

    spread = directory.repartition(max(directory.sparkSession.sparkContext.defaultParallelism, directory.count() // 16), "file", "offset")
    return spread.mapInArrow(run, RECORDS)


def blocks_of(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """(file, offset, length, key): the index blocks that can hold each of the keys (key), by binary search.

    The directory is cut into segments at the first keys of about one block in SEGMENT, all that the driver and each task hold of
    it; keys and blocks meet in their segment, where the keys are searched.  A block that reaches into the next segments is in
    these, too."""
    cuts = sorted({r["first_key"] for r in directory.where(F.pmod(F.xxhash64("file", "offset"), F.lit(SEGMENT)) == 0).select("first_key").collect()})
    top = directory.sparkSession.sparkContext.broadcast(cuts)
    asked = keys.select(F.lit(1).alias("kind"), F.col("key").alias("first_key"), F.col("key").alias("last_key"), F.lit("").alias("file"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length")).distinct()
    both = directory.select(F.lit(0).alias("kind"), "first_key", "last_key", "file", "offset", "length").unionByName(asked)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [bisect.bisect_right(top.value, x) for x in batch.column("first_key").to_pylist()]
            high = [bisect.bisect_right(top.value, x) for x in batch.column("last_key").to_pylist()]
            at = [i for i, (a, b) in enumerate(zip(low, high, strict=True)) for _ in range(a, b + 1)]
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([k for a, b in zip(low, high, strict=True) for k in range(a, b + 1)], pa.int32()), *own.columns], names=["segment", *own.schema.names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, firsts, lasts = None, [], [], []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["segment"] != now:
                    now, blocks, firsts, lasts = r["segment"], [], [], []
                if r["kind"] == 0:  # in order of first keys, and so of last ones
                    blocks.append((r["file"], r["offset"], r["length"]))
                    firsts.append(r["first_key"])
                    lasts.append(r["last_key"])
                else:
                    out += [(*blocks[i], r["first_key"]) for i in range(bisect.bisect_left(lasts, r["first_key"]), bisect.bisect_right(firsts, r["first_key"]))]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "offset", "length", "key"])

    parts = max(directory.sparkSession.sparkContext.defaultParallelism, len(cuts) + 1)
    dealt = both.mapInArrow(deal, "segment int, kind int, first_key string, last_key string, file string, offset long, length long")
    return dealt.repartition(parts, "segment").sortWithinPartitions("segment", "kind", "first_key", "last_key", "file", "offset").mapInArrow(search, "file string, offset long, length long, key string")


def lookup_all(directory: DataFrame, keys: DataFrame, payload: bool = True) -> DataFrame:
    """The records (RECORDS) of all keys (key): directory, then blocks, then records, by binary searches and range reads."""
    found = blocks_of(directory, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            held, lines, names, hits = None, [], [], []
            for batch in batches:
                for r in batch.to_pylist():
                    place = (r["file"], r["offset"])
                    if place != held:
                        if hits:
                            yield from records_of(held[0].rpartition("/")[0], hits)
                        held, hits = place, []
                        lines = block_lines(r["file"], r["offset"], r["length"])
                        names = [x[0] for x in lines]
                    hits += lines[bisect.bisect_left(names, r["key"]) : bisect.bisect_right(names, r["key"])]
            if hits:
                yield from records_of(held[0].rpartition("/")[0], hits)

        yield from batched(records(), payload)

    parts = max(directory.sparkSession.sparkContext.defaultParallelism, directory.count() // 16)
    return found.repartition(parts, "file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(run, RECORDS)


def lookup(directory: DataFrame, url: str) -> list[dict]:
    """All records of a URL's key: sparse directory, block, then records; revisits are given with their response's id."""
    spark = directory.sparkSession
    key = spark.range(1).select(url_key(F.lit(url)).alias("k")).first()["k"]
    out = []
    for row in directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("first_key", "file", "offset").toLocalIterator():
        lines = block_lines(row["file"], row["offset"], row["length"])
        low, high = 0, len(lines)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if lines[mid][0] < key else (low, mid)
        folder = row["file"].rpartition("/")[0]
        while low < len(lines) and lines[low][0] == key:
            _, _, _, name, at, n = lines[low]
            out.append(parse(zlib.decompress(ranged(f"{folder}/{name}", at, n), 31)))
            low += 1
    return out


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes an archive of all pages and looks all of their URLs up in it."""
    pages = table(spark, sf_dir, "pages")
    directory = write_archives(pages, new_path(spark, "warc"))
    return lookup_all(directory, pages.select(url_key(F.col("url")).alias("key")), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {LEAST} GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

QUERIES = {"op9_warc": (op9_warc, OP9_SQL)}
