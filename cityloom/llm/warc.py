"""WARC archives: writing pages, reading them back, and merging their capture indexes.

* Every page becomes one record of an archive in the shared folder. Of records whose payloads are equal
  (length, SHA-1 and a second hash) and have at least ``LEAST_REVISIT`` bytes, the one with the largest page_id is a
  response; the others are revisits, which carry its id and no payload.
* Archives are written by Spark's text writer, whose line separator is the blank line that ends a record,
  so they may lie in any store that Spark writes to, and a lost task leaves no half record.
* Reading takes an archive at a time, follows the records by their lengths, and checks each payload
  against its digest. An archive holds at most ``FILE_RECORDS`` records, so a task's memory is bounded.
* Each archive gives a run of index entries sorted by URL key and timestamp. Entries are dealt out by
  ranges of (URL key, timestamp, page_id), so a host or URL of any size spans several ranges; in each range
  the runs are merged by a tournament tree of losers. Partitions in order are the global history.

Defined cases: a null html counts as an empty payload. A null url leaves out the target and has an empty
key; line breaks and other controls in a url are percent-encoded. Rows that repeat the response's page_id are
responses too; a null page_id is never preferred. Capture times follow page_id modulo ``CAPTURE_SPAN`` seconds, in UTC. Pages with smaller payloads are responses whatever repeats.
Other columns, of any name, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, cut, frugal, join_small, partitions, shared_folder, written

LEAST_REVISIT = 1000
FILE_RECORDS = 10_000
FIRST_CAPTURE = 1_700_000_000   # capture time of page 0; page n was captured n seconds later,
CAPTURE_SPAN = 3_000_000_000    # modulo this span, so that every id has a year of four digits
_CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(key: Column) -> Column:
    h = F.md5(key)
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                           for x in ((F.lit("-"),) if i else ()) + (F.substring(h, a, n),)], F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)), F.lit(""))


def records(pages: DataFrame) -> DataFrame:
    """``value``: the record of each page, without the blank line that ends it."""
    body = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
                        body.alias("body"), F.octet_length(body).cast("long").alias("size"),
                        F.sha1(body.cast("binary")).alias("sha1"), F.xxhash64(body).alias("other"))
    same = cut(rows.where(F.col("size") >= LEAST_REVISIT).groupBy("sha1", "size", "other").agg(
        F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    rows = join_small(rows, same, ["sha1", "size", "other"], "left")
    again = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]+", "%20")
    # Without a time zone, so that stamps are UTC in every session.
    second = F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0).cast("long")), F.lit(CAPTURE_SPAN))
    stamp = (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
             + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))).cast("string")
    stamp = F.concat(F.substring(stamp, 1, 10), F.lit("T"), F.substring(stamp, 12, 8), F.lit("Z"))
    inner = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
                     F.col("size").cast("string"), F.lit(_CRLF * 2), F.when(again, "").otherwise(F.col("body")))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"), _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _uuid(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "sha1", "url"))),
        _line("WARC-Date", stamp), _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("X-Payload-Length", F.col("size").cast("string")), _line("X-Page-ID", F.col("page_id").cast("string")),
        F.when(again, F.concat(_line("WARC-Profile", F.lit(_PROFILE)),
                               _line("X-Refers-To-Page-ID", F.col("keep").cast("string")))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}"))
    return rows.withColumn("inner", inner).select(F.concat(
        head, _line("Content-Length", F.octet_length("inner").cast("string")), F.lit(_CRLF), "inner").alias("value"))


def write_archives(pages: DataFrame, folder: str | None = None) -> str:
    """Write the pages as WARC archives; returns the folder."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    (records(pages).write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", FILE_RECORDS)
     .mode("errorifexists").text(folder))
    return folder


# ------------------------------------------------------------------ reading
def parse(archive: bytes | memoryview) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, headers, payload) of each record; wrong lengths or digests raise."""
    data, at = memoryview(archive), 0
    whole = bytes(archive) if not isinstance(archive, bytes) else archive
    while at < len(whole):
        end = whole.index(b"\r\n\r\n", at)
        first, *lines = whole[at:end].decode().split(_CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        head = dict(line.split(": ", 1) for line in lines)
        begin, stop = end + 4, end + 4 + int(head["Content-Length"])
        if whole[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it should")
        payload = data[whole.index(b"\r\n\r\n", begin, stop) + 4:stop]
        if head["WARC-Type"] == "response":
            digest = hashlib.sha1(payload).hexdigest()
            if f"sha1:{digest}" != head["WARC-Payload-Digest"] or len(payload) != int(head["X-Payload-Length"]):
                raise ValueError(f"the payload at byte {at} is not what its header says")
        yield at, stop + 4 - at, head, payload
        at = stop + 4


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then path and query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    tail = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{tail}){parts.path or '/'}{query}".lower()


ENTRY = pa.schema([("url_key", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()), ("run", pa.string()),
                   ("pos", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("at", pa.int64()), ("length", pa.int64())])
ENTRY_SQL = ("url_key string, stamp string, page_id long, run string, pos long, record_type string, payload_bytes long, "
             "payload_digest string, refers_to long, at long, length long")


def _key(url: str, stamp: str, page: int | None) -> tuple:
    return url, stamp, page is not None, page or 0


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            rows = []
            for at, length, head, _ in parse(content.as_py()):
                page, other = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                rows.append((url_key(head.get("WARC-Target-URI")), head["WARC-Date"], int(page) if page else None, path, 0,
                             head["WARC-Type"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"),
                             int(other) if other else None, at, length))
            rows.sort(key=lambda r: _key(*r[:3]))
            for lo in range(0, len(rows), 5000):
                part = [(*r[:4], lo + i, *r[5:]) for i, r in enumerate(rows[lo:lo + 5000])]
                yield as_batch(dict(zip(ENTRY.names, zip(*part, strict=True), strict=True)), ENTRY)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted runs of index entries, one run for each archive."""
    return (spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(frugal(_index), ENTRY_SQL))


# ------------------------------------------------------------------ merging
class LoserTree:
    """Merge of sorted runs: each inner node keeps the loser of its match, so a new head is compared only
    along one path to the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.tree = [0] * max(self.k, 1)
        winner = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.tree[node] = (a, b) if self._wins(a, b) else (b, a)
        self.tree[0] = winner[1] if self.k > 1 else 0

    def _wins(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        return (self.runs[a][self.at[a]][0], a) < (self.runs[b][self.at[b]][0], b)

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            run = self.tree[0]
            if self.at[run] >= len(self.runs[run]):
                return
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            node = (run + self.k) // 2
            while node:
                if self._wins(self.tree[node], run):
                    run, self.tree[node] = self.tree[node], run
                node //= 2
            self.tree[0] = run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for b in batches:
        columns = [b.column(n).to_pylist() for n in ENTRY.names]
        for row in zip(*columns, strict=True):
            runs.setdefault(row[3], []).append((_key(*row[:3]), row))
    for run in runs.values():  # a run's pieces may arrive in any order
        if any(x[1][4] > y[1][4] for x, y in zip(run, run[1:], strict=False)):
            run.sort(key=lambda x: x[1][4])
    part: list[tuple] = []
    for _, row in LoserTree([runs[r] for r in sorted(runs)]):
        part.append(row)
        if len(part) == 5000:
            yield as_batch(dict(zip(ENTRY.names, zip(*part, strict=True), strict=True)), ENTRY)
            part = []
    if part:
        yield as_batch(dict(zip(ENTRY.names, zip(*part, strict=True), strict=True)), ENTRY)


def merge_index(runs: DataFrame) -> DataFrame:
    """All entries in the order of URL key, timestamp and page_id, over the partitions in order."""
    ranges = runs.repartitionByRange(partitions(runs), "url_key", "stamp", "page_id")
    return ranges.mapInArrow(frugal(_merge), ENTRY_SQL).drop("pos")


def capture_histories(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back, and merge their indexes."""
    folder = write_archives(pages)
    return merge_index(written(read_index(pages.sparkSession, folder)))
