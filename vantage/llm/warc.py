"""WARC archives: write captures with revisits, read them back, merge sorted runs into a global capture index."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import by_bytes

END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "url_key string, captured_at timestamp_ltz, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
EPOCH = "2020-01-01 00:00:00"


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then path and query, lower-cased; without scheme, port, user,
    fragment and a leading www."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return f")/{(url or '').strip().lower()}"
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){tail}".lower()


def payload_digests(pages: DataFrame, id_col: str, url_col: str, payload_col: str, batch_bytes: int) -> DataFrame:
    """page_id, url, payload, payload_bytes, SHA-1 in base32 and SHA-256 of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "payload", batch_bytes):
            payloads = batch.column("payload").to_pylist()
            sha1 = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(p) for p in payloads], pa.int64()), pa.array(sha1), pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary())],
                names=[*batch.schema.names, "payload_bytes", "payload_digest", "strong_digest"],
            )

    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")
    )
    return rows.mapInArrow(run, "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, strong_digest binary")


def mark_revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """Adds first_id: the smallest page_id with an equal payload (its length and two digests). Only digests are
    grouped, with partial sums; the join back is one that Spark can split where a payload is very frequent."""
    key = ["payload_bytes", "payload_digest", "strong_digest"]
    first = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy(*key).agg(F.min("page_id").alias("first_id"), F.count("page_id").alias("n")).filter("n > 1").drop("n")
    return rows.join(first, key, "left").withColumn("first_id", F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")))


def _line(value: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", value or "")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, first_id: int | None, seconds: int) -> bytes:
    """One WARC/1.1 record without the blank lines that end it; the body of a revisit stays with its first capture."""
    import datetime

    when = (datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if first_id is None else b"")
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first_id is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Date: {when}",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if first_id is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{first_id}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass") + END + block


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", seconds: Column | None = None, min_bytes: int = 0, records_per_file: int = 20_000, batch_bytes: int = 8 << 20) -> None:
    """Write one record for each row of pages as gzipped WARC files, by Spark's own committed text writer: rows are
    raw bytes and the line end is the blank lines that end a WARC record.

    Of rows with equal payloads of at least min_bytes the one with the smallest page_id is a response and the others
    are revisits of it; null payloads count as empty, null ids are always responses, and so are repeated rows of one id
    and payload. A null URL is written as an empty one. An empty table gives an archive without records. Other columns
    are not looked at. A file is one gzip stream, as Spark's writer makes it. seconds (from the start of 2020)
    gives the capture date; by default it is the page_id, reduced to fit into 50 years."""
    at = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(1_500_000_000)) if seconds is None else seconds
    rows = mark_revisits(payload_digests(pages, id_col, url_col, payload_col, batch_bytes), min_bytes)
    rows = rows.select("page_id", "url", F.when(F.col("first_id").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "payload_bytes", "payload_digest", "first_id", at.alias("seconds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "payload", batch_bytes):
            made = [record(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    raw = rows.mapInArrow(run, "value binary")
    writer = raw.select(F.col("value").cast("string").alias("value")).write
    writer.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)


def whole_records(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Records from a file's pieces between blank lines: a head, then as many bytes as it tells. Holds one record.

    A block that ends in a line feed is followed by more than two of them, and the pieces are cut at the first two: the
    rest comes with the next head. So the pieces are joined again and the told length alone says where a block ends."""
    head: bytes | None = None
    body: list[bytes] = []
    need = have = 0
    for piece in pieces:
        if head is not None:
            body.append(piece)
            have += len(piece) + len(END)
            if have < need:
                continue
            whole = END.join(body)
            if not whole.startswith(END, need) and len(whole) > need:
                raise ValueError(f"a record of {need} bytes has {len(whole)}")
            yield head + END + whole[:need]
            head, piece = None, whole[need:]
        piece = piece.lstrip(b"\r\n")
        if piece:
            head, body, have = piece, [], -len(END)
            need = int(re.search(rb"\r\nContent-Length: (\d+)", piece)[1])
    if head is not None:
        raise ValueError("the last record is cut off")


def parse(raw: bytes) -> tuple:
    """The index entry of a record; digest and length of a response are taken from its payload and must agree."""
    import datetime

    head, _, block = raw.partition(END)
    named = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = block.partition(END)
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda x: int(n) if (n := x.removeprefix("<urn:x-page:").rstrip(">")) else None
    if named["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged payload in {named['WARC-Record-ID']}")
    when = datetime.datetime.strptime(named["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=datetime.timezone.utc)
    refers = named.get("WARC-Refers-To")
    return url_key(named["WARC-Target-URI"]), when, number(named["WARC-Record-ID"]), size, digest, named["WARC-Type"], number(refers) if refers else None


def read_archives(spark: SparkSession, folder: str, chunk: int = 1024) -> DataFrame:
    """Index entries of all records of gzipped WARC files, streamed record by record: a row for each record, repeated
    ones too; a null id stays null. A folder without records gives no rows; a damaged or cut off record is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (x for batch in batches for x in batch.column("value").to_pylist())
        rows: list[tuple] = []
        for raw in whole_records(pieces):
            rows.append(parse(raw))
            if len(rows) == chunk:
                yield _entries(rows)
                rows = []
        if rows:
            yield _entries(rows)

    lines = spark.read.option("lineSep", END.decode()).text(folder)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, ENTRY)


_TYPES = pa.schema([("url_key", pa.string()), ("captured_at", pa.timestamp("us", tz="UTC")), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES.types, strict=True)], schema=_TYPES)


def loser_tree_merge(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs: each inner node keeps the loser of its match, so a step replays one path to the root."""
    k = len(runs)
    if k == 1:
        yield from runs[0]
        return
    at = [0] * k
    losers = [-1] * k

    def beats(a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; ended runs go last, ties to the earlier run."""
        if at[a] >= len(runs[a]) or at[b] >= len(runs[b]):
            return at[a] < len(runs[a]) or (at[b] >= len(runs[b]) and a < b)
        x, y = runs[a][at[a]], runs[b][at[b]]
        return x < y or (x == y and a < b)

    def build(node: int) -> int:
        if node >= k:
            return node - k
        left, right = build(2 * node), build(2 * node + 1)
        winner, losers[node] = (left, right) if beats(left, right) else (right, left)
        return winner

    winner = build(1)
    for _ in range(sum(map(len, runs))):
        yield runs[winner][at[winner]]
        at[winner] += 1
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2


def capture_index(entries: DataFrame, *, rows_per_range: int = 200_000) -> DataFrame:
    """The entries in global order of (url_key, captured_at, page_id), null ids first, with each one's place in its range.
    Repeated entries stay, next to each other; no entries give none.

    Each task sorts what it has read (a run). The runs are dealt out by ranges of the whole key, so that a host or
    URL with very many captures spreads over ranges; a range's task finds the ascending runs in what arrives and
    merges them with a loser tree. Ranges have about rows_per_range entries, whatever the number of rows. Column
    range_id is ascending in key order and range_place counts within, so sorting by both gives the global order;
    key_place numbers the captures of a key within the range, from 1."""
    order = ["url_key", "captured_at", "page_id"]
    runs = entries.sortWithinPartitions(*order)
    ranges = int(entries.count() // rows_per_range) + 1
    names = [x.split()[0] for x in ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs: list[list[tuple]] = []
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (row[0], row[1], row[2] is not None, row[2] or 0, row)
                if not runs or key[:4] < runs[-1][-1][:4]:
                    runs.append([])
                runs[-1].append(key)
        part = TaskContext.get().partitionId()
        merged = loser_tree_merge(runs) if runs else iter(())
        place, last, nth = 0, None, 0
        while held := [x for _, x in zip(range(4096), merged)]:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*(x[4] for x in held), strict=True), _TYPES.types, strict=True)]
            numbers = []
            for key in held:
                nth = nth + 1 if key[0] == last else 1
                last = key[0]
                numbers.append(nth)
            spot = [pa.array([part] * len(held), pa.int64()), pa.array(range(place, place + len(held)), pa.int64()), pa.array(numbers, pa.int64())]
            place += len(held)
            yield pa.RecordBatch.from_arrays([*columns, *spot], names=[*names, "range_id", "range_place", "key_place"])

    return runs.repartitionByRange(ranges, *order).mapInArrow(run, f"{ENTRY}, range_id bigint, range_place bigint, key_place bigint")


def capture_histories(index: DataFrame) -> DataFrame:
    """The entries of a written capture_index() with place, their number in the whole order from 0, and capture_no, their
    number among the captures of their url_key from 1. What a range starts with, its first key's captures in the ranges
    before included, comes from one row for each range."""
    ends = index.groupBy("range_id").agg(
        F.count("*").alias("n"), F.min_by("url_key", "range_place").alias("first"), F.max_by(F.struct("url_key", "key_place"), "range_place").alias("last")
    )
    rows, total, key, carried = [], 0, None, 0
    for r in sorted(ends.collect(), key=lambda r: r["range_id"]):
        before = carried if r["first"] == key else 0
        rows.append((r["range_id"], total, r["first"], before))
        total += r["n"]
        carried = r["last"]["key_place"] + (before if r["last"]["url_key"] == r["first"] else 0)
        key = r["last"]["url_key"]
    starts = index.sparkSession.createDataFrame(rows, "range_id bigint, __total bigint, __first string, __before bigint")
    joined = index.join(F.broadcast(starts), "range_id")  # a row for each range
    more = F.when(F.col("url_key") == F.col("__first"), F.col("__before")).otherwise(F.lit(0))
    return joined.withColumns({"place": F.col("__total") + F.col("range_place"), "capture_no": F.col("key_place") + more}).drop("__total", "__first", "__before", "key_place")
