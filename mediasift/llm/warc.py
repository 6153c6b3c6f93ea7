"""WARC archives of pages, read back through a globally ordered capture index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.llm.common import shared_path, written
from mediasift.llm.decontamination import small

# Fixed value: revisit profile of the WARC 1.1 specification.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
CAPTURE_SCHEMA = "url_key string, ts string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path: captures of a site and a page are neighbours."""
    m = re.match(r"(?is)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)(:\d+)?([^#]*)", url or "")
    if not m:
        return (url or "").lower()
    host = [x for x in m[1].lower().split(".") if x]
    if host[:1] == ["www"]:
        host = host[1:]
    return ",".join(reversed(host)) + (m[2] or "") + ")" + (m[3] or "/").lower()


def _record(page: int | None, url: str | None, date: str, payload: str, digest: str, first: int | None) -> str:
    revisit = first is not None and first != page
    body = payload.encode("utf-8")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}{END}"
    size = len(http) + (0 if revisit else len(body))
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
    return "\r\n".join(head) + END + http + ("" if revisit else payload)


def write_warc(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", payload: str = "html", date: str = "captured_at", min_revisit_bytes: int = 0, max_records: int = 5000) -> None:
    """Write one record per row to gzipped archives under ``path`` (any store Spark can write).

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the smallest ``page`` is
    the response and the others refer to it. Payloads are grouped by digest with partial
    minima; only digests that occur twice are joined back. Null payloads are empty, null urls
    have no target header; rows that repeat the smallest page are all responses; other columns
    are ignored; an empty table writes no record. An archive has at most ``max_records`` records.
    """
    c = F.col
    p = pages.select(c(page).cast("long").alias("page"), c(url).alias("url"), F.coalesce(c(payload), F.lit("")).alias("body"), F.date_format(c(date), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    p = p.withColumn("hex", F.sha1("body"))
    long_enough = F.octet_length("body") >= min_revisit_bytes
    same = p.filter(long_enough).groupBy("hex").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    p = p.join(small(written(same, "payloads")), "hex", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = lambda v: None if pd.isna(v) else int(v)
        for f in frames:
            yield pd.DataFrame({"value": [
                _record(none(g), None if u is None else u, d or "1970-01-01T00:00:00Z", b, base64.b32encode(bytes.fromhex(h)).decode(), none(x))
                for g, u, d, b, h, x in zip(f["page"], f["url"], f["date"], f["body"], f["hex"], f["first"])]})

    out = p.select("page", "url", "date", "body", "hex", "first").mapInPandas(run, "value string")
    # a record ends with two line breaks, which is the separator the text writer puts after each row
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record of an unpacked archive."""
    at = 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            at += len(line)
            k, _, v = line.decode("utf-8").partition(":")
            head[k.strip().lower()] = v.strip()
        n = int(head["content-length"])
        block, tail = stream.read(n), stream.read(4)
        if len(block) != n or tail != END.encode():
            raise ValueError("broken WARC record")
        at += len(line) + n + 4
        yield head, block, start, at - start


def _capture(head: dict[str, str], block: bytes, file: str, at: int, length: int) -> tuple:
    http, _, body = block.partition(END.encode())
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    if head["warc-type"] == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
        raise ValueError("payload and digest differ")
    number = lambda v: int(m[1]) if v and (m := re.search(r"(-?\d+)>", v)) else None
    url = head.get("warc-target-uri")
    return (url_key(url), head["warc-date"], number(head["warc-record-id"]), url, head["warc-type"], number(head.get("warc-refers-to")), size, digest, file, at, length)


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives; those of one archive are a run: sorted, and numbered by ``pos``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CAPTURE_SCHEMA.split(", ")]
        for f in frames:
            for file, content in zip(f["path"], f["content"]):
                with gzip.GzipFile(fileobj=io.BytesIO(content)) as s:
                    rows = [_capture(h, b, file, at, n) for h, b, at, n in parse_warc(s)]
                rows.sort(key=_order)
                out = pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                out["pos"] = range(len(out))
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInPandas(run, CAPTURE_SCHEMA + ", pos long")


def _order(r: tuple) -> tuple:
    return (r[0].encode("utf-8"), r[1], -(2**63) if r[2] is None else r[2])


class LoserTree:
    """k-way merge of sorted iterators: inner nodes keep the losers, the winner is replayed."""

    def __init__(self, runs: Iterable[Iterator], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.head = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.head]
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        if b < 0 or a < 0:
            return a < 0 <= b  # an open place wins while the tree is built
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self._less(self.loser[node], i):
                i, self.loser[node] = self.loser[node], i
            node //= 2
        self.loser[0] = i

    def __iter__(self):
        while self.k and self.head[w := self.loser[0]] is not None:
            yield self.head[w]
            self.head[w] = next(self.runs[w], None)
            self.keys[w] = None if self.head[w] is None else self.key(self.head[w])
            self._play(w)


def merge_runs(runs: DataFrame, rows_per_range: int = 100_000) -> DataFrame:
    """Captures in global order of (url_key, ts, page_id): ``range_no`` and ``range_pos`` number them.

    The written runs are parted by range of the whole key, so one url with a third of all
    captures still spreads over ranges, and a range holds about ``rows_per_range`` captures.
    Each range merges its slices of the k runs with a loser tree. Equal keys keep every row.
    """
    spark = runs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // rows_per_range))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices: dict[str, list[tuple]] = {}
        names = None
        for f in frames:
            names = list(f.columns)
            f = f.astype(object).where(f.notna(), None)
            for r in f.itertuples(index=False, name=None):
                slices.setdefault(r[8], []).append(r)
        if names is None:
            return
        for rows in slices.values():
            rows.sort(key=lambda r: r[11])  # blocks of a run can arrive in any order
        merged = pd.DataFrame(LoserTree(slices.values(), _order), columns=names).astype({"page_id": "Int64", "refers_to": "Int64"}).drop(columns="pos")
        merged["range_no"], merged["range_pos"] = TaskContext.get().partitionId(), range(len(merged))
        yield merged

    ranged = runs.repartitionByRange(n, "url_key", "ts", "page_id")
    return ranged.mapInPandas(run, CAPTURE_SCHEMA + ", range_no long, range_pos long")


def archive(pages: DataFrame, path: str | None = None, rows_per_range: int = 100_000, **kw) -> DataFrame:
    """Write ``pages`` as WARC, read the archives back and return the ordered capture index.

    One row per page: ``url_key, ts, page_id, url, record_type, refers_to, payload_bytes,
    payload_digest`` (both of the full payload), place of the record (``file, offset, length``
    in the unpacked archive) and place in the order. Cases as in ``write_warc``.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_warc(pages, path, **kw)
    return merge_runs(written(sorted_runs(spark, path), "runs"), rows_per_range)
