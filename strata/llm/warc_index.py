"""WARC archives and their index, merged from sorted runs.

``write_archives`` makes a record of each page: its HTTP header and the html in
UTF-8 as a response, or, if an equal payload of at least ``MIN_REVISIT`` bytes
has a smaller page_id, a revisit record that refers to it. Each task sorts its
captures by URL key and time and writes them with Spark's text writer, whose line
end is the end of a record (two CR LF), gzipped. A file is a sorted run.

``read_archives`` reads the files back whole (their size is bounded by the number
of files), parses the records by their lengths and hashes their payloads; that gives
each file's index, written to the shared folder. ``merged_index`` deals the
runs into ranges of (URL key, time, page) and merges the slices of each range by
a k-way loser tree: ranges and rows come out in global order. A URL with a
third of all captures is split by time, so no range grows with it.

Null html is an empty payload; a null url has no target line, null page_ids
become null again. Small or unequal payloads are all responses. Rows that repeat a
page_id and payload are each a response if that page_id is the smallest (or
null in all of them). Control characters of a URL are percent-encoded in the record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import staged
from strata.session import scratch_dir

MIN_REVISIT = 100
# Payload bytes of a file and index rows of a merged range, about.
FILE_BYTES = 24 << 20
RANGE_ROWS = 50_000
END = "\r\n\r\n"
# Captures are dated a second apart by page_id from this day on.
FIRST_DAY = "2024-01-01"


def url_key(url: Column) -> Column:
    """A URL in index order: host labels from the last to the first, then the rest."""
    rest = F.coalesce(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), F.lit(""))
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", ""))


def records(pages: DataFrame, files: int) -> DataFrame:
    """(page_id, url_key, date, record): one WARC record as text for each page, dealt over ``files`` partitions.

    Which pages are revisits is found on ids and digests alone, so payloads are dealt once.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("bigint").alias("size"),
    )
    first = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    first = first.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("_digest"), "first")
    capture = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("digest"))
    rows = rows.withColumn("capture", capture)
    later = rows.select("capture", "page_id", "digest").join(first, F.col("digest") == F.col("_digest"))
    later = later.where(~F.col("page_id").eqNullSafe(F.col("first"))).groupBy(F.col("capture").alias("_capture"))
    later = later.agg(F.min("first").alias("first"))
    rows = rows.repartition(files, "capture").join(later, F.col("capture") == F.col("_capture"), "left")
    again = F.col("first").isNotNull()
    spent = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**10))
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_DAY), "yyyy-MM-dd") + spent), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"), F.lit(END),
    )
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    target = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first")))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select("page_id", url_key(F.col("url")).alias("url_key"), date.alias("date"), F.concat(lines, F.lit(END), block).alias("record"))


def write_archives(pages: DataFrame) -> str:
    """Writes the archives to a fresh shared folder; its path."""
    path = scratch_dir(pages.sparkSession, "warc")
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files = 1 + total // FILE_BYTES
    rows = records(pages, files).sortWithinPartitions("url_key", "date", "page_id")
    rows.select("record").write.option("lineSep", END).option("compression", "gzip").text(path)
    return path


def _parse(content: bytes) -> Iterator[tuple]:
    """(offset, length, headers, block) of each record of a gzipped file."""
    data = zlib.decompress(content, 31)
    at, end = 0, END.encode()
    while at < len(data):
        top = data.index(end, at)
        head = {}
        for line in data[at:top].split(b"\r\n")[1:]:
            name, _, value = line.partition(b": ")
            head[name.decode()] = value.decode()
        stop = top + 4 + int(head["Content-Length"])
        if data[stop : stop + 4] != end:
            raise ValueError(f"a record at {at} does not end where its length says")
        yield at, stop + 4 - at, head, data[top + 4 : stop]
        at = stop + 4


_INDEX = (
    "url_key string, date string, page_id bigint, run string, offset bigint, length bigint, "
    "record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
)
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_SCHEMA = pa.schema([pa.field(c.split()[0], t) for c, t in zip(_INDEX.split(", "), _TYPES, strict=True)])


def _page(urn: str | None) -> int | None:
    number = (urn or "<urn:page:null>")[10:-1]
    return None if number == "null" else int(number)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = []
            for offset, length, head, block in _parse(content.as_py()):
                http, _, payload = block.partition(END.encode())
                size = int(http.rpartition(b"Content-Length: ")[2])
                kind = head["WARC-Type"]
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response":
                    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{run}: the payload at {offset} is not what its header says")
                rows.append((
                    head.get("WARC-Target-URI"), head["WARC-Date"], _page(head["WARC-Record-ID"]), run.as_py(), offset,
                    length, kind, size, digest, _page(head.get("WARC-Refers-To")),
                ))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], schema=_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index of all records in the archives: one sorted run for each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    found = files.mapInArrow(_index, _INDEX)
    return staged(found.withColumn("url_key", url_key(F.col("url_key"))), "warc-runs")


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, heads: list):
        """``heads``: the first key of each sequence, None where it is empty."""
        self.keys = list(heads)
        self.size = len(heads)
        self.losers = [-1] * self.size
        for leaf in range(self.size):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None if x is None or y is None else (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        winner, at = leaf, (leaf + self.size) // 2
        while at:
            other = self.losers[at]
            if other < 0:
                self.losers[at] = winner
                return
            if self._beats(other, winner):
                self.losers[at], winner = winner, other
            at //= 2
        self.losers[0] = winner

    @property
    def winner(self) -> int:
        return self.losers[0] if self.size > 1 else 0

    def replace(self, key) -> None:
        """The winner's sequence goes on with ``key`` (None: it has ended)."""
        leaf = self.winner
        self.keys[leaf] = key
        winner, at = leaf, (leaf + self.size) // 2
        while at:
            other = self.losers[at]
            if self._beats(other, winner):
                self.losers[at], winner = winner, other
            at //= 2
        if self.size:
            self.losers[0] = winner


def merge(runs: list[list]) -> Iterator[tuple[int, int]]:
    """(run, place) of all items of the sorted ``runs`` in global order."""
    runs = [r for r in runs]
    tree = LoserTree([r[0] if r else None for r in runs])
    at = [0] * len(runs)
    for _ in range(sum(map(len, runs))):
        run = tree.winner
        yield run, at[run]
        at[run] += 1
        tree.replace(runs[run][at[run]] if at[run] < len(runs[run]) else None)


def _merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), schema=_SCHEMA).combine_chunks()
    if not len(table):
        return
    keys = list(zip(
        table["url_key"].to_pylist(), table["date"].to_pylist(), [(p is not None, p or 0) for p in table["page_id"].to_pylist()], strict=True
    ))
    # The rows come run after run, each run in its own order.
    names = table["run"].to_pylist()
    starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
    ends = [*starts[1:], len(names)]
    order = [starts[r] + i for r, i in merge([keys[s:e] for s, e in zip(starts, ends, strict=True)])]
    yield from table.take(pa.array(order)).to_batches(max_chunksize=8192)


def merged_index(runs: DataFrame) -> DataFrame:
    """The captures of all runs in the global order of URL key, time and page."""
    ranges = 1 + runs.count() // RANGE_ROWS
    dealt = runs.repartitionByRange(ranges, "url_key", "date", "page_id").sortWithinPartitions("run", "offset")
    return dealt.mapInArrow(_merge_range, _INDEX)


def captures(pages: DataFrame) -> DataFrame:
    """Pages through archives and back: the merged index."""
    return merged_index(read_archives(pages.sparkSession, write_archives(pages)))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first IS DISTINCT FROM d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100"""
