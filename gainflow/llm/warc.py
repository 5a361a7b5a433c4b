"""WARC archives with an index first: write, index, and read back by coalesced byte ranges.

Each task writes its records, each a gzip member of its own, into archives of its own name and
returns one index row per record (file, offset, length, URL, digest, ...). Only the index is
shuffled afterwards: the selected rows are ordered by file and offset over the cluster, and ranges
that lie close together are fetched with one read. A task that runs again writes other files; the
index, committed by Spark, names only those of the attempt that counts.

Defined results: a null payload is empty; payloads of any length are one record each; other columns,
whatever their names, are neither read nor written; a null URL is left out of the record; line ends in a URL
are percent-encoded; rows that repeat the smallest id of their payload are all responses; a null id
is later than any other; an empty table gives an empty index.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut

#: Bytes after which a task begins another archive; a gap and a span up to which ranges are read at once; bytes per reading task.
ARCHIVE, GAP, SPAN, PER_TASK = 256 << 20, 64 << 10, 8 << 20, 32 << 20
#: Digests that repeat (some 150 bytes each) that are broadcast.
SENT = 500_000
#: Payloads below this many bytes are never revisits.
LEAST = 100
INDEX = "file string, offset long, length long, record_id long, url string, payload_digest string, record_type string, refers_to long"
RECORD = "record_id long, url string, record_type string, refers_to long, header_digest string, payload binary"
#: Fixed by the WARC 1.1 standard.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
URN = "urn:gainflow:record:"


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``record_id, url, payload, payload_digest, record_type, refers_to``: what to write for each row.

    The first of each payload is found by a grouping that aggregates before its shuffle. Only digests
    that repeat are joined back: sent to the payloads where there are at most SENT of them, so no
    payload is shuffled; beyond, AQE splits one that is very frequent.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    large = F.octet_length("payload") >= LEAST
    firsts = cut(rows.filter(large).groupBy("payload_digest").agg(F.min("record_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("payload_digest").alias("d"), "first"))
    rows = rows.join(F.broadcast(firsts) if firsts.count() <= SENT else firsts, (F.col("payload_digest") == F.col("d")) & large, "left")
    again = F.col("first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first"))
    return rows.select("record_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _name(i) -> str:
    return "null" if pd.isna(i) else str(int(i))


def record(record_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    block = HTTP if kind == "revisit" else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{_name(record_id)}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if isinstance(url, str):
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{URN}{_name(refers_to)}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda k: None if (n := fields.get(k, "null>")[len(URN) + 1 : -1]) in ("", "null") else int(n)
    return {
        "record_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
        "header_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload": block.partition(b"\r\n\r\n")[2],
    }


def _frame(rows: list[dict], columns: str) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in columns.split(", ")])
    return df.astype({c.split(" ")[0]: "Int64" for c in columns.split(", ") if c.endswith(" long")})


def write(planned: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write archives below ``folder`` (a URI that all executors share); the index, itself kept as Parquet in ``folder/index``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(f"{root}/archives", recursive=True)
        out, name, at = None, "", 0
        try:
            for part in batches:
                rows = []
                for r in part.itertuples(index=False):
                    if out is None or at > ARCHIVE:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = where.open_output_stream(f"{root}/archives/{name}", compression=None)
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = member.compress(record(r.record_id, r.url, bytes(r.payload), r.payload_digest, r.record_type, r.refers_to, date)) + member.flush()
                    out.write(data)
                    rows.append({"file": name, "offset": at, "length": len(data), "record_id": r.record_id, "url": r.url, "payload_digest": r.payload_digest, "record_type": r.record_type, "refers_to": r.refers_to})
                    at += len(data)
                yield _frame(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    planned.mapInPandas(run, INDEX).write.parquet(f"{folder}/index")
    return planned.sparkSession.read.parquet(f"{folder}/index")


def members(stream, step: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of an open file, read in steps."""
    at, held = 0, b""
    while True:
        one, data, used = zlib.decompressobj(31), [], 0
        while not one.eof:
            if not held and not (held := stream.read(step)):
                return
            data.append(one.decompress(held))
            used += len(held) - len(one.unused_data)
            held = one.unused_data
        yield at, used, b"".join(data)
        at += used


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of archives already in ``folder``, one task per few archives, each read as a stream."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/archives").select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = fs.FileSystem.from_uri(folder)
        for part in batches:
            for path in part["path"]:
                name, rows = path.rpartition("/")[2], []
                with where.open_input_stream(f"{root}/archives/{name}", compression=None) as f:
                    for at, length, data in members(f):
                        r = parse(data)
                        rows.append({"file": name, "offset": at, "length": length, "payload_digest": r["header_digest"]} | {k: r[k] for k in ("record_id", "url", "record_type", "refers_to")})
                        if len(rows) == 5000:
                            yield _frame(rows, INDEX)
                            rows = []
                yield _frame(rows, INDEX)

    return files.mapInPandas(run, INDEX)


def coalesced(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) as reads: file, start, end and the ranges inside."""
    out: list = []
    for file, at, length in rows:
        if out and out[-1][0] == file and at - out[-1][2] <= GAP and at + length - out[-1][1] <= SPAN:
            out[-1][2] = max(out[-1][2], at + length)
            out[-1][3].append((at, length))
        else:
            out.append([file, at, at + length, [(at, length)]])
    return [tuple(x) for x in out]


def read(selected: DataFrame, folder: str) -> DataFrame:
    """The records of the selected index rows, as RECORD."""
    size = selected.agg(F.sum("length").alias("b")).first()["b"] or 0
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, -(-size // PER_TASK))
    ordered = selected.select("file", "offset", "length").repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = fs.FileSystem.from_uri(folder)
        name, f = None, None
        for part in batches:
            for file, start, end, ranges in coalesced(list(part.itertuples(index=False, name=None))):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, where.open_input_file(f"{root}/archives/{file}")
                data = f.read_at(end - start, start)
                yield _frame([parse(zlib.decompress(data[a - start : a - start + n], 31)) for a, n in ranges], RECORD)
        if f is not None:
            f.close()

    return ordered.mapInPandas(run, RECORD)
