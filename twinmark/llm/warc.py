"""Operator 5: WARC archives and their index, merged from sorted runs.

Pages become WARC/1.1 records: the first page of each payload a response, later ones revisits of it. Spark's text
writer puts the records into archives, so any file system that Spark knows will do. Each archive, read back, gives a run of captures sorted by
URL key and time. Runs are cut by key ranges; each range's task merges its runs with a loser tree, which
together gives one globally ordered capture history.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import folder
from .shared import materialize, shards, spread_join, table

#: Records in an archive at most, by the largest payload's bytes (None: larger ones), so that one has about 64 MB or one record; captures that a task
#: merges, about; the second of the first capture.
ARCHIVES, RANGE_ROWS, FIRST_SECOND = ((1 << 16, 1000), (1 << 22, 16), (None, 1)), 100_000, 1704067200

# Record syntax and the profile of revisits.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    fives = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest and refers_to, which is null for responses."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    own = own.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": sha1_base32(F.col("html").cast("binary"))})
    seen = own.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = materialize(seen.filter("n > 1").withColumnRenamed("n", "rows"), "again")
    joined = spread_join(own, again, ["payload_digest"], pages.count(), how="left").drop("rows")
    return joined.withColumn("refers_to", F.when((F.col("payload_bytes") >= min_bytes) & (F.col("page_id") > F.col("first")), F.col("first"))).drop("first")


def record(page_id: Column, url: Column, html: Column, payload_bytes: Column, payload_digest: Column, refers_to: Column) -> Column:
    """A record without the two line ends that close it. Line ends in a url are percent-encoded."""
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:sha1:"), sha1_base32(F.concat(F.lit("page "), c.cast("string")).cast("binary")), F.lit(">"))
    revisit = refers_to.isNotNull()
    head = F.concat(F.lit(HTTP), payload_bytes.cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, head).otherwise(F.concat(head, html))
    at = F.date_format(F.timestamp_seconds(FIRST_SECOND + F.coalesce(F.pmod(page_id, F.lit(1 << 30)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(F.coalesce(page_id.cast("string"), F.lit("null"))), F.lit("\r\nWARC-Date: "), at, F.lit("\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), payload_digest,
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: " + PROFILE + "\r\nWARC-Refers-To: "), name(refers_to.cast("string")), F.lit("\r\nX-Refers-To-Page: "), refers_to.cast("string"))).otherwise(F.lit("")),
        F.when(page_id.isNotNull(), F.concat(F.lit("\r\nX-Page-Id: "), page_id.cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nX-Payload-Length: "), payload_bytes.cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write pages (page_id, url, html) as archives under path; long payloads have archives of few records or one."""
    df = with_revisits(pages, min_bytes)
    line = record(*(F.col(c) for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")))
    largest, least = df.agg(F.max("payload_bytes")).first()[0] or 0, -1
    for most, records in ARCHIVES:
        some = F.col("payload_bytes") > least if most is None else F.col("payload_bytes").between(least + 1, most)
        if largest > least:
            df.filter(some).select(line.alias("value")).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records).text(path)
        least = most


def url_key(url: str) -> str:
    """Host labels in reverse order, then the path and the query, in lower case: org,example,www)/path?query."""
    rest = url.partition("://")[2] or url
    host = rest
    for end in "/?#":
        host = host.partition(end)[0]
    tail = rest[len(host) :].partition("#")[0] or "/"
    return (",".join(reversed(host.partition(":")[0].split("."))) + ")" + tail).lower()


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(header, payload, offset, length) of each record; raises if the archive is cut off or a payload doesn't have its digest."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        header = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start, size = stop + 4, int(header["content-length"])
        block = data[start : start + size]
        if len(block) < size or data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut off")
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if header["warc-type"] == "response" and "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != header["warc-payload-digest"]:
            raise ValueError(f"the payload at {at} doesn't have its digest")
        yield header, payload, at, start + size + 4 - at
        at = start + size + 4


_CAPTURE = "url_key string, stamp string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, run string, offset long, length long"
_COLUMNS = [x.split()[0] for x in _CAPTURE.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS)], _COLUMNS)


def _order(row: tuple) -> tuple:
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) of archives -> each archive's captures, sorted."""
    for batch in batches:
        for i in range(batch.num_rows):
            path, rows = batch.column(0)[i].as_py(), []
            for h, _, offset, length in parse_archive(batch.column(1)[i].as_py()):
                number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                stamp = "".join(c for c in h["warc-date"] if c.isdigit())
                rows.append((url_key(h["warc-target-uri"]), stamp, number("x-page-id"), h["warc-type"], number("x-refers-to-page"), int(h["x-payload-length"]), h["warc-payload-digest"][5:], path, offset, length))
            yield _batch(sorted(rows, key=_order))


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers, so the next winner needs one comparison a level."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key = [iter(r) for r in runs], key
        k = len(runs)
        self.heads = [self._next(i) for i in range(k)]
        self.tree = [-1] * max(k, 1)
        for i in range(k):
            self._up(i)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _beats(self, a: int, b: int) -> bool:
        if b < 0 or self.heads[b] is None:
            return a >= 0 and b >= 0 and (self.heads[a] is not None or a < b)
        if a < 0 or self.heads[a] is None:
            return a < 0
        return (self.heads[a][0], a) < (self.heads[b][0], b)

    def _up(self, i: int) -> None:
        """Play run i's head up to the root; a run of -1 (not yet come) stops where it meets an empty node."""
        node = (i + len(self.heads)) // 2
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node], i = i, -1
                break
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        if i >= 0:
            self.tree[0] = i

    def __iter__(self):
        while self.heads and self.heads[i := self.tree[0]] is not None:
            yield self.heads[i][1]
            self.heads[i] = self._next(i)
            self._up(i)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key range's rows, sorted by run and then as runs are -> in order."""
    runs: list[list[tuple]] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if not runs or runs[-1][-1][7] != row[7]:
                runs.append([])
            runs[-1].append(row)
    out = []
    for row in LoserTree(runs, _order):
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def capture_history(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the archives under path: partitions in the order of keys, rows ordered by URL key, time and page.

    A table of captures is written first: range bounds are drawn from it, and lost tasks read it again. The number of ranges follows from the captures', so
    that a task merges about RANGE_ROWS of them, however many there are; a key's captures may fall into several ranges.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = materialize(files.mapInArrow(_runs, _CAPTURE), "runs")
    ranges = max(shards(runs), -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, "url_key", "stamp", "page_id", "run", "offset")
    return dealt.sortWithinPartitions("run", "url_key", "stamp", F.col("page_id").asc_nulls_first(), "offset").mapInArrow(_merge, _CAPTURE)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as WARC, read them back and return the capture history.

    Null html counts as empty, null urls as "". Rows with a null id are responses and no revisit refers to them, unless all of a payload's rows have
    none. Rows that repeat an id and payload are equal records. A payload is held whole, and must stay below Spark's 2 GB. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    path = f"{folder(spark)}/warc"
    write_archives(pages, path, min_bytes)
    return capture_history(spark, path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i: list_reduce(list_transform(range(4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (list_reduce(list_transform(range(5), lambda k:
        instr('0123456789abcdef', substr(hex, CAST(5 * i + k + 1 AS BIGINT), 1)) - 1), lambda x, y: x * 16 + y) // [32768, 1024, 32, 1][j + 1]) % 32 AS BIGINT), 1)),
      lambda x, y: x || y)), '') AS payload_digest
  FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""
