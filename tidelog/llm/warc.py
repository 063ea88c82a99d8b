"""Web archives: pages written as WARC records, repeats as revisits, and one capture index merged from sorted runs.

Each task sorts its captures by URL key and time and writes them as a gzipped
WARC file, which is one sorted run. Tasks that each own a key range then merge
the runs' slices with a loser tree, which gives one global order of captures.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import filesystem, shared_path, table

MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 20_000
INDEX_ROWS_PER_TASK = 200_000

INDEX_SCHEMA = "run string, position long, url_key string, captured_at long, page_id long"
RECORD_SCHEMA = "run string, position long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url):
    """The sort key of a URL: host labels reversed, then the rest, lower case (``com,example)/path``)."""
    whole = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(whole, "^[^:/?#]*://", "")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.substring(rest, F.length(host) + 1, F.length(rest)))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}').urn}>"


def record_bytes(row: dict[str, Any]) -> bytes:
    """One gzip member holding one record."""
    payload, digest = row["payload"], row["digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(row['page_id'], digest)}",
        f"WARC-Date: {row['date']}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + row["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    block = http
    if row["refers_to"] is None:
        block += payload
    else:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'], digest)}", f"X-Refers-To-Page: {row['refers_to']}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def read_records(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records of one file: position, headers, block. Holds one record at a time."""
    position, left = 0, b""
    while True:
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            chunk = left or stream.read(1 << 20)
            left = b""
            if not chunk:
                if parts or used:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(unpacker.decompress(chunk))
            left = unpacker.unused_data
            used += len(chunk) - len(left)
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield position, headers, body[: int(headers["Content-Length"])]
        position += used


def number(text: str | None) -> int | None:
    return None if text is None else int(text)


def writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Write sorted captures to files of this task attempt alone and return their index.

    A lost or repeated attempt leaves a file that no index row names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["run", "position", "url_key", "captured_at", "page_id"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, rows, run, at = None, [], "", 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in columns.items()}
                if out is None:
                    run, at, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out = fs.open_output_stream(f"{root}/{run}", compression=None)
                data = record_bytes(row)
                out.write(data)
                rows.append((run, at, row["url_key"], row["captured_at"], row["page_id"]))
                at += len(data)
                if len(rows) >= RECORDS_PER_FILE:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return write


def reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["run", "position", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        fs, root = filesystem(folder)
        for batch in batches:
            for run in batch.column("run").to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{run}", compression=None) as stream:
                    for position, head, block in read_records(stream):
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                                raise ValueError(f"{run} at {position}: the payload differs from its digest")
                        rows.append((run, position, number(head.get("X-Page-Id")), size, digest, head["WARC-Type"], number(head.get("X-Refers-To-Page"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return read


class LoserTree:
    """Merges ``k`` sorted lists. Inner nodes keep the loser of their match, so each step replays one path."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.k = len(runs)
        self.losers = [-1] * max(1, self.k)
        for run in range(self.k):
            self.play(run)

    def beats(self, a: int, b: int) -> bool:
        """Whether the head of ``a`` goes first; an empty run never does, ties go to the lower run."""
        if self.at[b] >= len(self.runs[b]):
            return True
        if self.at[a] >= len(self.runs[a]):
            return False
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def play(self, run: int) -> None:
        winner, node = run, (run + self.k) // 2
        while node > 0:
            if self.losers[node] == -1:  # the first to arrive waits for its match
                self.losers[node] = winner
                return
            if self.beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.at[winner := self.losers[0]] < len(self.runs[winner]):
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            self.play(winner)


def merge_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range: the runs' slices, each in order, merged; numbered within the range."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for run, position, key, at, page in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(run, []).append((key, at, page is not None, page or 0, run, position))
    merged = list(LoserTree(list(runs.values())))
    for start in range(0, len(merged), 10_000):
        rows = merged[start : start + 10_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part] * len(rows), pa.int32()),
                pa.array(range(start, start + len(rows)), pa.int64()),
                pa.array([r[4] for r in rows], pa.string()),
                pa.array([r[5] for r in rows], pa.int64()),
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.int64()),
            ],
            ["part", "place", "run", "position", "url_key", "captured_at"],
        )


def capture_index(index: DataFrame) -> DataFrame:
    """Merge the runs' indexes (a stored table of :data:`INDEX_SCHEMA`, each run in order) into one.

    Ranges are cut on (URL key, time, page), so the captures of one hot URL
    spread over several tasks. Adds ``capture_order``, the place in the whole
    index, from 0.
    """
    parts = max(1, -(-index.count() // INDEX_ROWS_PER_TASK))
    sliced = index.repartitionByRange(parts, "url_key", "captured_at", "page_id", "run", "position")
    merged = table(
        sliced.sortWithinPartitions("run", "url_key", "captured_at", "page_id", "position").mapInArrow(merge_slices, "part int, place long, run string, position long, url_key string, captured_at long"),
        "captures",
    )
    # One row per range: small by construction.
    sizes = merged.groupBy("part").count().orderBy("part").collect()
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    before = F.broadcast(index.sparkSession.createDataFrame(starts, "part int, start long"))
    return merged.join(before, "part").withColumn("capture_order", F.col("start") + F.col("place")).drop("part", "place", "start")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record per page (``page_id``, ``url``, ``html``, optional ``captured_at`` seconds); returns the runs' index.

    Of pages with equal payloads of ``min_bytes`` or more, each with the least
    page id is a response and the others revisit it. Equal rows are equal
    records. A null page id counts as larger than any other; a group that has
    no page id is all responses. Without ``captured_at`` the page id serves.
    """
    at = F.col("captured_at").cast("long") if "captured_at" in pages.columns else F.col("page_id")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
        F.coalesce(at, F.lit(0)).cast("long").alias("captured_at"),
    ).withColumn("digest", F.sha2("payload", 256))
    repeated = (
        rows.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    ready = (
        rows.join(repeated, "digest", "left")
        .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
        .withColumn("url_key", url_key(F.col("url")))
        .withColumn("date", F.date_format(F.timestamp_seconds(F.pmod("captured_at", F.lit(4102444800))), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .select("url_key", "captured_at", "page_id", "url", "payload", "digest", "refers_to", "date")
    )
    return ready.sortWithinPartitions("url_key", "captured_at", "page_id").mapInArrow(writer(folder), INDEX_SCHEMA)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Read the files that ``index`` names, a task each, record by record; payloads are checked against their digests."""
    runs = index.select("run").distinct()
    return runs.repartition(max(1, runs.count())).mapInArrow(reader(folder), RECORD_SCHEMA)


def archive(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder, merge their index, read them back: one row per page."""
    folder = shared_path(pages.sparkSession, "warc")
    index = table(write_archives(pages, folder), "index")
    records = read_archives(index, folder)
    # The planner takes what a file's reader returns to be as small as the list of files: rule out a broadcast.
    return records.hint("shuffle_merge").join(capture_index(index).drop("url_key"), ["run", "position"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_order"
    )
