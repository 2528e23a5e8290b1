"""WARC archives and a two-level capture index.

Archives: each partition of pages becomes one file with a gzip member per record. Of records with equal payloads of at
least LEAST bytes that with the smallest page_id is a response with the payload, the others are revisits that name it.

Index: captures are sorted by reversed-host key and page_id and range-partitioned; a partition becomes one index file of
compressed blocks of ENTRIES captures, followed by its sparse directory: each block's first key and place. The upper
level is the files' table with their first and last keys. A lookup finds the files of a key by binary search in the
upper level, the blocks by binary search in a file's directory, reads these blocks alone, and then reads each capture's
record from its archive by range.

Defined results: a null html is an empty payload; a null url has the empty key and no target URI. Rows that repeat a
page_id are records each; those with the smallest page_id of a payload are all responses. Records without a page_id are
responses, or revisits of the smallest id that there is. Ids are cast to long; one that is no number is an error. Payloads
of any length are one record. An empty table gives no files and an empty result. Other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import store
from pairloom.llm.common import bounded_broadcast, materialize, shared_path, ship

LEAST = 100
ENTRIES = 512
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_FILES = "shard long, path string, first string, last string, n long"


def surt(url: str | None) -> str:
    """The sort key: host labels reversed, then the rest; com,example,www)/path?query."""
    if not url or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    return ",".join(reversed(host.split("."))) + ")" + (tail if tail.startswith("/") else "/" + tail)


def _uri(url: str) -> str:
    """No white space or control characters in a header line."""
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in url.encode()) if any(ord(c) <= 32 or ord(c) == 127 for c in url) else url


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; refers_to None: a response."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    http = f"{_HTTP}Content-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers (lower-case names), its payload, and the payload's length as its HTTP headers give it."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    return {"headers": headers, "payload": payload, "length": length}


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn != "<urn:page:>" else None


def _write_archive(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    uri = f"{folder}/part-{TaskContext.get().partitionId():08d}.warc.gz"
    entries: list[tuple] = []

    def members() -> Iterator[bytes]:
        at = 0
        for rows in batches:
            for page, has_page, url, payload, digest, first, is_revisit in zip(*(rows[c] for c in ("page_id", "has_page", "url", "payload", "digest", "first", "revisit")), strict=True):
                page = int(page) if has_page else None
                own = record(page, url, payload, digest, int(first) if is_revisit else None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = pack.compress(own) + pack.flush()
                entries.append((surt(url), page, uri, at, len(data)))
                at += len(data)
                yield data

    chunks = members()
    head = next(chunks, None)
    if head is None:
        return

    def all_() -> Iterator[bytes]:
        yield head
        yield from chunks

    store.write_file(uri, all_())
    for i in range(0, len(entries), 10_000):
        out = pd.DataFrame(entries[i : i + 10_000], columns=["key", "page_id", "path", "offset", "length"])
        out["page_id"] = out["page_id"].astype("Int64")
        yield out


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """The captures: key, page_id, path, offset, length. The payloads themselves are shuffled only if very many repeat."""
    ship(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    hashed = rows.withColumn("digest", F.sha2("payload", 256))
    same = hashed.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = materialize(same.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "same_payloads")
    joined = hashed.join(bounded_broadcast(same, 120), "digest", "left")
    # A payload of less than LEAST bytes has no such row, as length follows from content.
    ready = joined.select(
        F.coalesce("page_id", F.lit(-1)).alias("page_id"), F.col("page_id").isNotNull().alias("has_page"), "url", "payload", "digest",
        F.coalesce("first", F.lit(-1)).alias("first"), (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"),
    )
    return materialize(ready.mapInPandas(lambda it: _write_archive(it, folder), "key string, page_id long, path string, offset long, length long"), "captures")


def _block(entries: list[tuple]) -> bytes:
    return zlib.compress(json.dumps(entries, ensure_ascii=False).encode())


def _write_index(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    uri = f"{folder}/part-{part:08d}.cdx"
    directory: list[tuple[str, int, int]] = []
    said = {"first": None, "last": None, "n": 0}

    def chunks(first_rows: pd.DataFrame) -> Iterator[bytes]:
        at, held = 0, []

        def flush() -> bytes:
            nonlocal at
            data = _block(held)
            directory.append((held[0][0], at, len(data)))
            at += len(data)
            held.clear()
            return data

        rows = first_rows
        while rows is not None:
            for key, page, path, offset, length in zip(rows["key"], rows["page_id"], rows["path"], rows["offset"], rows["length"], strict=True):
                said["first"] = key if said["first"] is None else said["first"]
                said["last"] = key
                said["n"] += 1
                held.append((key, None if pd.isna(page) else int(page), path, int(offset), int(length)))
                if len(held) == ENTRIES:
                    yield flush()
            rows = next(batches, None)
        if held:
            yield flush()
        data = _block(directory)
        yield data + struct.pack("<QQ", at, len(data))

    first = next((b for b in batches if len(b)), None)
    if first is None:
        return
    store.write_file(uri, chunks(first))
    yield pd.DataFrame({"shard": [part], "path": [uri], "first": [said["first"]], "last": [said["last"]], "n": [said["n"]]})


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """The index files' table: shard, path, first, last, n."""
    spark = captures.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = captures.repartitionByRange(parts, "key", "page_id", "path", "offset").sortWithinPartitions("key", "page_id", "path", "offset")
    return materialize(order.mapInPandas(lambda it: _write_index(it, folder), _FILES), "index_files")


class IndexFile:
    """One index file: its directory is read, blocks are read as asked for."""

    def __init__(self, uri: str):
        self.reader = store.Reader(uri)
        at, size = struct.unpack("<QQ", self.reader.read(self.reader.size - 16, 16))
        self.directory = json.loads(zlib.decompress(self.reader.read(at, size)))
        self.firsts = [d[0] for d in self.directory]
        self.held: tuple[int, list] = (-1, [])

    def block(self, i: int) -> list:
        if self.held[0] != i:
            _, at, size = self.directory[i]
            self.held = (i, json.loads(zlib.decompress(self.reader.read(at, size))))
        return self.held[1]

    def find(self, key: str) -> Iterator[list]:
        """The captures of a key: from the last block that begins below it."""
        i = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        while i < len(self.directory) and self.firsts[i] <= key:
            entries = self.block(i)
            at = bisect.bisect_left(entries, key, key=lambda e: e[0])
            while at < len(entries) and entries[at][0] == key:
                yield entries[at]
                at += 1
            i += 1


def lookup(files: DataFrame, keys: DataFrame) -> DataFrame:
    """The captures of keys (column key, each once): key, page_id, path, offset, length. The upper level, a row per index file, goes to every task."""
    spark = keys.sparkSession
    ship(spark)
    level = sorted((r["first"], r["last"], r["shard"], r["path"]) for r in files.collect())
    lasts = [x[1] for x in level]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key in rows["key"]:
                i = bisect.bisect_left(lasts, key)
                while i < len(level) and level[i][0] <= key:
                    out.append((level[i][2], level[i][3], key))
                    i += 1
            yield pd.DataFrame(out, columns=["shard", "file", "key"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file = None, None
        for rows in batches:
            out = []
            for path, key in zip(rows["file"], rows["key"], strict=True):
                if path != name:
                    name, file = path, IndexFile(path)
                out += file.find(key)
                if len(out) >= 10_000:
                    yield _captures(out)
                    out = []
            yield _captures(out)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.select("key").mapInPandas(place, "shard long, file string, key string")
    dealt = placed.repartition(parts, "shard").sortWithinPartitions("shard", "key")
    return dealt.select("file", "key").mapInPandas(search, "key string, page_id long, path string, offset long, length long")


def _captures(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "page_id", "path", "offset", "length"])
    out["page_id"] = out["page_id"].astype("Int64")
    return out


def fetch(captures: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest: each capture's record, read by range and checked."""
    ship(captures.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, reader = None, None
        for rows in batches:
            for start in range(0, len(rows), 500):
                out = []
                for path, offset, length in zip(*(rows[c].iloc[start : start + 500] for c in ("path", "offset", "length")), strict=True):
                    if path != name:
                        name, reader = path, store.Reader(path)
                    got = parse(zlib.decompress(reader.read(int(offset), int(length)), 31))
                    h, revisit = got["headers"], got["headers"]["warc-type"] == "revisit"
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(got["payload"]).hexdigest() != digest:
                        raise ValueError(f"damaged record at {path}:{offset}")
                    out.append((_page(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], _page(h.get("warc-refers-to")), None if revisit else got["payload"], got["length"], digest))
                done = pd.DataFrame(out, columns=["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])
                yield done.astype({"page_id": "Int64", "refers_to": "Int64"})

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = captures.repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset")
    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    return order.select("path", "offset", "length").mapInPandas(run, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives and their index, looks every key up and reads the records back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = shared_path(spark, "warc")
    captures = write_archives(pages, f"{folder}/archives")
    files = write_index(captures, f"{folder}/index")
    found = materialize(lookup(files, captures.select("key").distinct()), "found")
    return fetch(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
