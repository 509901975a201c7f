"""WARC archives with identical-payload revisits, and their index by external merge.

write_archives() writes one record a page as WARC/1.1 files, each gzipped as a whole, through Spark's text writer (any
file system Spark knows). read_archives() reads them back whole file by whole file, so that payloads may hold anything, and cuts every
batch of files into a locally sorted run of captures. Runs are sliced at key borders, and each key range is merged from
its slices by a k-way loser tree on (URL key, timestamp, page id): range after range, the output is in global order.

Defined results: a null html is an empty payload; a null url is about:blank; of equal payloads of at least smallest
bytes the smallest page id is the response (rows repeating that id are responses, too; null ids come last and are never
referred to unless all are null); a file's RECORDS_A_FILE records are held whole while it is read; an empty table gives an empty index; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.scratch import shared_folder

RANGE_ROWS = 200_000
#: Rows looked at for the borders of the ranges, and for each range at least; any borders give right results.
BORDER_SAMPLE, RANGE_SAMPLE = 20_000, 8
RECORDS_A_FILE = 2_000
_LAST = (1 << 63) - 1
_CAPTURE = pa.schema(
    [("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())]
)


def url_key(url: Column) -> Column:
    """Sort-friendly key: the host's labels from the last one, then path and query; scheme, port, www and fragment go."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r":\d*$", ""), r"^www\d*\.", "")
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), F.regexp_replace(rest, "^[^/?]*", ""))


def captures(pages: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """page_id, url, timestamp, html; without a timestamp column, page n counts as captured n seconds into 2024."""
    when = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(1 << 31))) if timestamp is None else timestamp
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\r\n]", " ")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.coalesce("html", F.lit("")).alias("html"))


def payload_digests(found: DataFrame) -> DataFrame:
    """Adds the bare base32 SHA-1 of the UTF-8 payload."""

    def digest(parts):
        for batch in parts:
            html = batch.column("html").cast(pa.large_binary())
            own = [base64.b32encode(hashlib.sha1(x.as_buffer()).digest()).decode() for x in html]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], names=[*batch.schema.names, "digest"])

    return found.mapInArrow(digest, "page_id long, url string, timestamp string, html string, digest string")


def write_archives(pages: DataFrame, path: str, timestamp: Column | None = None, smallest: int = 0) -> None:
    """One response or revisit record a page. Only ids and digests are shuffled to find copies; html moves once."""
    full = payload_digests(captures(pages, timestamp)).withColumn("k", F.coalesce("page_id", F.lit(_LAST)))
    slim = full.where(F.octet_length("html") >= smallest).select("k", "digest")
    owners = slim.groupBy("digest").agg(F.min("k").alias("owner"), F.max("k").alias("last")).where("last > owner")
    revisits = slim.join(owners, "digest").where("k > owner").select("k", "digest", "owner").distinct()
    every = full.join(revisits, ["k", "digest"], "left")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("owner").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:x-page:"),
        name,
        F.lit(">\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Date: "),
        F.col("timestamp"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:x-page:"), F.col("owner").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    # The writer's line end closes the record.
    every.select(F.concat(head, block, F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_A_FILE).option("compression", "gzip").text(path)


def records(body: bytes):
    """(offset, headers, block) of each record of an unpacked WARC file."""
    at = 0
    while at < len(body):
        end = body.index(b"\r\n\r\n", at)
        lines = body[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(headers["content-length"])
        yield at, headers, body[end + 4 : end + 4 + n]
        if body[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is not closed")
        at = end + 8 + n


def _capture(file: str, offset: int, headers: dict, block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{file}, {offset}: the payload does not match its headers")
    page = lambda x: None if (k := x.removeprefix("<urn:x-page:").removesuffix(">")) == "none" else int(k)
    refers = page(headers["warc-refers-to"]) if kind == "revisit" else None
    return headers["warc-target-uri"], headers["warc-date"], page(headers["warc-record-id"]), size, digest, kind, refers, file, offset


class LoserTree:
    """Merges k sorted lists: every inner node keeps the loser of its match, so a pop replays one path of log2 k matches."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = k = max(1, len(runs))
        self.losers = [-1] * k
        winners = [-1] * k + list(range(len(runs)))
        winners += [-1] * (2 * k - len(winners))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else (0 if runs else -1)

    def _head(self, run: int):
        return self.runs[run][self.at[run]] if run >= 0 and self.at[run] < len(self.runs[run]) else None

    def _before(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return x is not None and (y is None or x <= y)

    def __iter__(self):
        while (head := self._head(self.winner)) is not None:
            yield head
            run = self.winner
            self.at[run] += 1
            node = (run + self.k) // 2
            while node:
                if not self._before(run, self.losers[node]):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def _order(row: tuple) -> tuple:
    """URL key, timestamp, page id (null last), then what makes the order total."""
    return row[0], row[1], row[2] is None, row[2] or 0, row[4], row[7], row[8]


def borders(pages: DataFrame, ranges: int, timestamp: Column | None = None) -> list[tuple]:
    """ranges - 1 (URL key, timestamp, page id) from a sample that grows with the ranges."""
    if ranges < 2:
        return []
    keys = captures(pages, timestamp).select(url_key(F.col("url")).alias("k"), "timestamp", "page_id")
    found = sorted((r.k, r.timestamp, r.page_id is None, r.page_id or 0) for r in keys.orderBy(F.xxhash64("page_id", "k")).limit(max(BORDER_SAMPLE, RANGE_SAMPLE * ranges)).collect())
    return [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []


def read_archives(spark: SparkSession, path: str, at: list[tuple]) -> DataFrame:
    """The captures of all files below path, with merge_range and merge_pos, which give the global order."""
    from bisect import bisect_right

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")

    def parse(parts):
        for batch in parts:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name, found = file.as_py(), []
                for offset, headers, block in records(gzip.decompress(content.as_py())):
                    found.append(_capture(name, offset, headers, block))
                if not found:  # a writer without rows leaves an empty archive
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), _CAPTURE.types, strict=True)], names=_CAPTURE.names)

    def run(parts):
        for batch in parts:
            found = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=_order)
            place = [bisect_right(at, _order(x)[:4]) for x in found]
            rows = []
            for r in sorted(set(place)):
                own = found[bisect_right(place, r - 1) : bisect_right(place, r)]
                table = pa.table([pa.array(x, kind) for x, kind in zip(zip(*own, strict=True), _CAPTURE.types, strict=True)], names=_CAPTURE.names)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                rows.append((r, sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["merge_range", "slice"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        runs = []
        for body in table.column("slice").to_pylist():
            rows = zip(*(c.to_pylist() for c in pa.ipc.open_stream(body).read_all().columns), strict=True)
            runs.append([(_order(x), x) for x in rows])
        merged = [x for _, x in LoserTree(runs)]
        columns = [pa.array(x, kind) for x, kind in zip(zip(*merged, strict=True), _CAPTURE.types, strict=True)]
        return pa.table([pa.array([key[0].as_py()] * len(merged), pa.int32()), pa.array(range(len(merged)), pa.int64()), *columns], names=["merge_range", "merge_pos", *_CAPTURE.names])

    capture = "url_key string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"
    index = files.mapInArrow(parse, capture).withColumn("url_key", url_key(F.col("url_key")))
    return index.mapInArrow(run, "merge_range int, slice binary").groupBy("merge_range").applyInArrow(merge, f"merge_range int, merge_pos long, {capture}")


def archive(pages: DataFrame, timestamp: Column | None = None, smallest: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives (into the shared folder unless a path is given) and returns their merged index."""
    spark = pages.sparkSession
    if path is None:
        path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, timestamp, smallest)
    ranges = max(1, -(-pages.count() // RANGE_ROWS))
    return read_archives(spark, path, borders(pages, ranges, timestamp))
