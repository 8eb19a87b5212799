"""WARC archives with a two-level capture index.

Writing: each task writes archives of single-record gzip members into a shared
folder and returns one index row per record. File names hold the attempt, and
only rows of attempts that succeed are kept, so a task that runs again leaves
nothing wrong behind.

Index: rows are sorted by reversed-host key over a range partitioning (page and
row follow the key, so that one URL with many captures is split too), cut into
gzip blocks of BLOCK_LINES lines; the directory keeps the first key and the place
of each block. A look-up, of one URL or of a table of them, bisects the directory,
reads one or more block ranges, bisects their lines, and then reads the records'
ranges, file by file.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import new_path
from .common import mapped, materialize, row_key

BLOCK_LINES = 2_000
FILE_BYTES = 256 << 20
LEVEL = 3
JOIN_GAP = 1 << 16
READ_ROWS = 500
PART_BLOCKS = 500_000
_BLOCK = "key string, file string, at long, size long"
_ROUTE = "key string, file string, part long"
_FOUND = "key string, page_id long, record_type string, file string, at long, size long"
_ENTRY = "key string, rid long, page_id long, url string, record_type string, file string, at long, size long"
_DIRECTORY = "first_key string, file string, at long, size long, lines long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: str | None) -> str:
    """Reversed-host key: lower-case host without www, user and default port; path and query as they are; no fragment.

    A null or empty URL has the key "-"; one without a host keeps its text.
    """
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(url, safe="/:?&=%+,;@~-._")
    if not host:
        return quote(url, safe="/:?&=%+,;@~-._")
    host = re.sub(r"^www\d*\.", "", host)
    head = quote(host if re.fullmatch(r"[0-9.]+|.*:.*", host) else ",".join(reversed(host.split("."))), safe=",:.-_")  # no space or line end is in a key
    if port and port != {"http": 80, "https": 443}.get(parts.scheme.lower()):
        head += f":{port}"
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{head}){quote(tail, safe='/:?&=%+,;@~-._')}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url: str | None, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """One record as one gzip member. A revisit has no payload; its headers tell length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    where = quote(url, safe="/:?#[]@!$&'()*+,;=%~-._") if url else "urn:page"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Target-URI: {where}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Key, page_id, url, html and, for what revisits another record, refers_to and is_revisit.

    Of rows with equal payloads of least_bytes or more the one with the largest
    page_id (then by key) is the response; rows that are equal in all are so alike. Only hashes meet by payload,
    and only rows of repeated payloads get a partner; html moves by its row's key.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumns(row_key("page_id", "url", "html"))
    small = rows.select("_k1", "_k2", "page_id", F.sha1(F.encode("html", "UTF-8")).alias("sha"), F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes)
    heads = small.groupBy("sha", "n").agg(F.max(F.struct("page_id", "_k1", "_k2")).alias("head"), F.count("*").alias("of")).where("of > 1").select("sha", "n", "head")
    revisits = small.join(heads, ["sha", "n"]).where("_k1 <> head._k1 or _k2 <> head._k2").select("_k1", "_k2", F.col("head.page_id").alias("refers_to"), F.lit(True).alias("is_revisit")).distinct()
    return rows.join(revisits, ["_k1", "_k2"], "left").withColumn("is_revisit", F.coalesce("is_revisit", F.lit(False)))


@dataclass
class Archive:
    """Where things are: entries and directory are tables; the rest are files in the folder."""

    spark: SparkSession
    folder: str
    directory: DataFrame
    part_blocks: int = PART_BLOCKS

    def lookup(self, url: str | None) -> list[tuple[dict[str, str], bytes]]:
        """All captures of a URL, by bisecting the directory, then blocks; reads ranges only."""
        out = []
        for row in self.find(self.spark.createDataFrame([(url,)], "url string")).toLocalIterator():
            fs, path = _open(row["file"])
            with fs.open_input_file(path) as file:
                out.append(parse_record(file.read_at(row["size"], row["at"])))
        return out

    def find(self, urls: DataFrame) -> DataFrame:
        """(key, page_id, record_type, file, at, size): all captures of urls(url), each once; nulls and empty ones have a key too.

        The directory, a line for block_lines captures, lies in runs of at most part_blocks lines of
        an index file. Only the runs' first keys are sent: keys are routed to the runs that
        may have them, and a task bisects each run for its keys, which gives the blocks to read. Those
        are dealt over tasks, so that a URL of very many captures is too, and each is
        read once, as a range, and bisected for its keys.
        """
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        place = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
        runs = self.directory.withColumn("part", F.floor(place / self.part_blocks))
        fences = [tuple(r) for r in runs.groupBy("file", "part").agg(F.min("first_key").alias("first")).select("first", "file", "part").orderBy("first", "file", "part").collect()]
        if not fences:
            return self.spark.createDataFrame([], _FOUND)
        sent = self.spark.sparkContext.broadcast(fences)

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = [f[0] for f in sent.value]
            for batch in batches:
                keys = sorted({surt(u) for u in batch.column(0).to_pylist()})
                out = [(key, *sent.value[i][1:]) for key in keys for i in _may_have(first, key)]
                if out:
                    yield _batch(out, _ROUTE)

        keys = urls.select("url").transform(mapped, routed, _ROUTE).distinct()
        asked = runs.groupBy("file", "part").cogroup(keys.groupBy("file", "part")).applyInArrow(_bisected, _BLOCK)
        return asked.repartition(n, "file", "at").sortWithinPartitions("file", "at", "key").transform(mapped, _in_blocks, _FOUND)

    def read(self, urls: DataFrame) -> DataFrame:
        """One row per record of urls(url), see RECORD: found through the index, read in ranges, in the order of the archives."""
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, READ_ROWS):
                    got = [_checked(*parse_record(member)) for member in _ranges(batch.slice(lo, READ_ROWS).to_pylist())]
                    columns = list(zip(*got, strict=True))
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        found = self.find(urls).select("file", "at", "size")
        return found.repartition(n, "file", F.shiftright("at", 26)).sortWithinPartitions("file", "at").transform(mapped, run, RECORD)


def _may_have(first: list[str], key: str) -> range:
    """Of runs of lines in order, by their first keys, those that may have key: where it begins one, and the last that begins before it."""
    return range(max(bisect.bisect_left(first, key) - 1, 0), bisect.bisect_right(first, key))


def _bisected(_, run: pa.Table, keys: pa.Table) -> pa.Table:
    """The blocks of a run of the directory that may have each key routed to it."""
    run = run.sort_by("at")
    first = run["first_key"].to_pylist()
    out = [(i, key) for key in keys["key"].to_pylist() for i in _may_have(first, key)]
    places = run.select(["file", "at", "size"]).take(pa.array([i for i, _ in out], pa.int64()))
    return pa.table([pa.array([key for _, key in out], pa.string()), *places.columns], names=["key", "file", "at", "size"])


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the keys asked of each block; rows come block by block."""
    place, lines, keys = None, [], []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if place != (row["file"], row["at"]):
                place = row["file"], row["at"]
                lines = _block_lines(row["file"], row["at"], row["size"])
                keys = [x.partition(" ")[0] for x in lines]
            for line in lines[bisect.bisect_left(keys, row["key"]) : bisect.bisect_right(keys, row["key"])]:
                entry = json.loads(line.partition(" ")[2])
                out.append((row["key"], entry["page_id"], entry["record_type"], entry["file"], entry["at"], entry["size"]))
            if len(out) >= 10_000:
                yield _batch(out, _FOUND)
                out = []
        if out:
            yield _batch(out, _FOUND)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if kind == "string" else pa.int64()) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _block_lines(file_uri: str, at: int, size: int) -> list[str]:
    fs, path = _open(file_uri)
    with fs.open_input_file(path) as file:
        return zlib.decompress(file.read_at(size, at), 31).decode().split("\n")


def _ranges(entries: list[dict]) -> Iterator[bytes]:
    """Members of entries, file by file; near ranges are read at once."""
    entries = sorted(entries, key=lambda e: (e["file"], e["at"]))
    i = 0
    while i < len(entries):
        j = i
        while j + 1 < len(entries) and entries[j + 1]["file"] == entries[i]["file"]:
            j += 1
        fs, path = _open(entries[i]["file"])
        with fs.open_input_file(path) as file:
            k = i
            while k <= j:
                end, last = entries[k]["at"] + entries[k]["size"], k
                while last < j and entries[last + 1]["at"] - end <= JOIN_GAP and end - entries[k]["at"] < 8 << 20:
                    last += 1
                    end = entries[last]["at"] + entries[last]["size"]
                raw = file.read_at(end - entries[k]["at"], entries[k]["at"])
                for e in entries[k : last + 1]:
                    begin = e["at"] - entries[k]["at"]
                    yield raw[begin : begin + e["size"]]
                k = last + 1
        i = j + 1


def _checked(headers: dict[str, str], payload: bytes) -> tuple:
    """A record's row; of a response the payload itself is measured."""
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(headers["X-Payload-Length"])
    if kind == "response":
        if digest_of(payload) != digest or len(payload) != size:
            raise ValueError(f"record of page {headers['X-Page-ID']} is damaged")
    to = headers.get("X-Refers-To-Page-ID")
    return (int(headers["X-Page-ID"]) if headers["X-Page-ID"] else None), size, digest, kind, int(to) if to and to != "None" else None


def write(pages: DataFrame, *, least_bytes: int = 0, block_lines: int = BLOCK_LINES) -> Archive:
    """Write archives and their index into the shared folder.

    Null html is an empty payload; null ids and URLs are kept as such; repeated
    rows are records each; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        file, uri, at, n = None, "", 0, 0
        for batch in batches:
            out = []
            for rid, page_id, url, html, refers_to, is_revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = _record(page_id, url, html.encode(), refers_to, is_revisit)
                if file is None or at + len(member) > FILE_BYTES:
                    if file is not None:
                        file.close()
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{n}-{uuid.uuid4().hex[:8]}.warc.gz"
                    file, uri, at, n = fs.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0, n + 1
                file.write(member)
                out.append((surt(url), rid, page_id, url, "revisit" if is_revisit else "response", uri, at, len(member)))
                at += len(member)
            if out:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _ENTRY.split(", ")])
        if file is not None:
            file.close()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.cdx.gz"
        waiting: list[tuple[str, str]] = []
        file, at = None, 0
        rows: list[tuple] = []

        def flush(take: list[tuple[str, str]]) -> None:
            nonlocal file, at
            if file is None:
                file = fs.open_output_stream(f"{root}/{name}", compression=None)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = packer.compress("\n".join(f"{k} {v}" for k, v in take).encode()) + packer.flush()
            file.write(raw)
            rows.append((take[0][0], f"{folder}/{name}", at, len(raw), len(take)))
            at += len(raw)

        for batch in batches:
            for row in batch.to_pylist():
                waiting.append((row["key"], json.dumps({k: row[k] for k in ("file", "at", "size", "page_id", "record_type")})))
                if len(waiting) == block_lines:
                    flush(waiting)
                    waiting = []
        if waiting:
            flush(waiting)
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in _DIRECTORY.split(", ")])

    planned = plan(pages, least_bytes).select(F.col("_k1").alias("rid"), "page_id", "url", "html", "refers_to", "is_revisit")
    # written once, as the range partitioner reads its input twice
    entries = materialize(planned.transform(mapped, archive, _ENTRY), "warc-entries")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    directory = entries.repartitionByRange(n, "key", "page_id", "rid").sortWithinPartitions("key", "page_id", "rid").transform(mapped, index, _DIRECTORY)
    return Archive(spark, folder, materialize(directory, "warc-directory"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html,'')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
d AS (SELECT page_id, n, x, (SELECT string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 15) & 31 AS BIGINT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 10) & 31 AS BIGINT) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 5) & 31 AS BIGINT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v & 31 AS BIGINT) + 1, 1), '' ORDER BY i)
    FROM (SELECT i, CAST('0x' || substr(x, i*5+1, 5) AS BIGINT) AS v FROM range(8) t(i))) AS digest FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY x, n) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY x, n) THEN NULL ELSE max(page_id) OVER (PARTITION BY x, n) END AS refers_to FROM d
"""
