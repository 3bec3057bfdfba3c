"""Reading parquet, delimited text and workbooks into tables; writing previews and delimited text."""

from __future__ import annotations

import csv
import datetime
import io
import json
import math
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import MISSING_TOKENS, col, none_missing, quoted
from ..scratch import Written
from ..table import ROW, Table

#: What is accepted.
MAX_BYTES = 100 << 20
MAX_COLUMNS = 1000
MAX_WORKBOOK_BYTES = 128 << 20
SNIFF_BYTES = 4096
DELIMITERS = ",;\t|:"
PREVIEW_ROWS = 200
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class Unreadable(ValueError):
    """The input can't be taken; the message says why."""


def with_rows(frame: DataFrame, from_files: bool) -> DataFrame:
    """Adds the hidden place of each row: its file and its number there, which stay whatever the splits."""
    if from_files:
        return frame.select(*(col(c) for c in frame.columns), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(ROW))
    return frame.select(*(col(c) for c in frame.columns), F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at")).alias(ROW))


def of_frame(frame: DataFrame, from_files: bool = False) -> Table:
    """A table over a DataFrame: NaN becomes null, columns of arrays, maps, structs and bytes are left out. A column ROW
    tells the rows' places if there is one."""
    plain = [f.name for f in frame.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    rows = frame if ROW in frame.columns else with_rows(frame, from_files)
    # A scan can't look through the change of NaN to null, so filters also see the doubles as they are stored.
    raw = {c: f"__raw{k}" for k, c in enumerate(plain) if isinstance(frame.schema[c].dataType, T.DoubleType)} if from_files else {}
    made = (none_missing(col(c), frame.schema[c].dataType).alias(c) for c in plain)
    return Table(rows.select(*made, *(col(c).alias(h) for c, h in raw.items()), ROW), raw=raw)


def read_parquet(spark: SparkSession, path: str) -> Table:
    return of_frame(spark.read.parquet(path), from_files=True)


def _content(spark: SparkSession, path: str, most: int | None = None) -> bytes:
    """The file's bytes (at most so many), through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = system.open(where)
    try:
        return bytes(stream.readNBytes(system.getFileStatus(where).getLen() if most is None else most))
    finally:
        stream.close()


def _exact(path: str) -> str:
    """The path as a pattern that means it alone."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def file_size(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()


def check_upload(name: str, size: int, max_bytes: int | None = MAX_BYTES) -> str:
    """The extension, if name and size are acceptable."""
    extension = posixpath.splitext(name.lower())[1]
    if extension not in (".csv", ".xlsx"):
        raise Unreadable("Only CSV and XLSX files can be read.")
    if not size:
        raise Unreadable("The file is empty.")
    if max_bytes is not None and size > max_bytes:
        raise Unreadable(f"The file is larger than {max_bytes >> 20} MB.")
    return extension


def check_table(table: Table) -> Table:
    if not table.names:
        raise Unreadable("The file has no columns.")
    if len(table.names) > MAX_COLUMNS:
        raise Unreadable(f"The file has more than {MAX_COLUMNS} columns.")
    if table.frame.isEmpty():
        raise Unreadable("The file has no rows.")
    return table


def read_dataset(spark: SparkSession, path: str, *, max_bytes: int | None = MAX_BYTES) -> Table:
    """A table from a CSV or XLSX file, checked; a parquet path is read as it is."""
    if path.rstrip("/").lower().endswith(".parquet"):
        return check_table(read_parquet(spark, path))
    extension = check_upload(path, file_size(spark, path), max_bytes)
    return check_table(read_csv(spark, path) if extension == ".csv" else read_xlsx(spark, path, max_bytes=max_bytes))


def sniff_delimiter(head: bytes) -> str:
    """The delimiter of the first line of at most 4 KiB; a comma where none is found."""
    first = head[:SNIFF_BYTES].removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace").splitlines()
    try:
        return csv.Sniffer().sniff(first[0], DELIMITERS).delimiter if first else ","
    except csv.Error:
        return ","


def unique_names(names: list[object]) -> list[str]:
    """Header cells as texts; blanks are Unnamed: position, repeats get .1, .2 and so on."""
    out: list[str] = []
    taken: set[str] = set()
    for place, name in enumerate(names):
        plain = f"Unnamed: {place}" if name is None or name == "" else str(name)
        text, n = plain, 0
        while text in taken:
            n += 1
            text = f"{plain}.{n}"
        taken.add(text)
        out.append(text)
    return out


def _form(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether all of the file is UTF-8, and whether a quoted value holds a line break (a line with an odd number of
    quotes); looked at on the executors, line by line."""
    lines = spark.read.text(_exact(path)).select(F.col("value").cast("binary").alias("v"))
    odd = F.length(F.regexp_replace(F.col("v").cast("string"), '[^"]', "")) % 2 == 1
    valid = F.is_valid_utf8(F.col("v").cast("string"))
    told = lines.agg(F.coalesce(F.every(valid), F.lit(True)), F.coalesce(F.some(odd), F.lit(False))).first()
    return told[0], told[1]


def read_csv(spark: SparkSession, path: str) -> Table:
    """A delimited file with a header: delimiter sniffed, UTF-8 or else Latin-1, every standard token for no value read
    as a gap, and each column promoted to whole numbers, numbers or booleans only if all its values can be. The file is
    split among tasks; only one with line breaks within quotes and stray quotes besides is read by a single one."""
    head = _content(spark, path, 1 << 20)
    sep = sniff_delimiter(head)
    text_head = head.removeprefix(b"\xef\xbb\xbf")
    first = re.split(rb"\r\n|\n|\r", text_head, maxsplit=1)[0]
    if first.count(sep.encode()) + 1 > MAX_COLUMNS:
        raise Unreadable(f"The file has more than {MAX_COLUMNS} columns.")
    utf8, broken = _form(spark, path)
    encoding = "UTF-8" if utf8 else "ISO-8859-1"
    rows = csv.reader(io.StringIO(text_head.decode(encoding, "replace"), newline=""), delimiter=sep)
    header = next(rows, None)
    if not header:
        raise Unreadable("The file has no columns.")
    if len(next(rows, header)) > len(header):
        raise Unreadable("Its rows have more fields than its header.")
    names = unique_names(header)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {"header": True, "sep": sep, "encoding": encoding, "escape": '"', "multiLine": broken, "enforceSchema": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "mode": "PERMISSIVE", "maxColumns": MAX_COLUMNS + 1, "emptyValue": "", "nullValue": ""}
    frame = _by_parity(spark, path, sep, encoding, schema, options) if broken else None
    if frame is None:
        frame = spark.read.options(**options).schema(schema).csv(_exact(path))
    gaps = frame.select(*(F.when(~col(n).isin(*MISSING_TOKENS), col(n)).alias(n) for n in names), *(x for x in [ROW] if x in frame.columns))
    return of_frame(promoted(gaps))


def _by_parity(spark: SparkSession, path: str, sep: str, encoding: str, schema: T.StructType, options: dict) -> DataFrame | None:
    """The records of a file whose quoted values hold line breaks, read by several tasks; None where that can't be told
    for sure, as a quote stands within a value that is not quoted.

    Each split counts the quotes of its lines. An odd number before it tells that it starts inside a value, so a running
    sum over the splits (a row for each) settles where every line starts; lines that start inside a value belong to the
    record before, if need be of a split before."""
    lines = spark.read.option("lineSep", "\n").text(_exact(path)).select(F.decode(F.col("value").cast("binary"), encoding).alias("line"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"))
    lines = lines.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'))))
    before = Window.partitionBy("split").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    odd, starts = False, {}
    for r in sorted(lines.groupBy("split").agg((F.sum("quotes") % 2 == 1).alias("odd")).collect()):
        starts[r["split"]] = odd
        odd ^= r["odd"]
    if odd or not starts:
        return None
    inside = F.element_at(F.create_map(*(F.lit(x) for s in starts.items() for x in s)), F.col("split"))
    opened = (F.coalesce(F.sum("quotes").over(before), F.lit(0)) + inside.cast("int")) % 2 == 0
    placed = lines.withColumn("fresh", opened.cast("int"))
    placed = placed.withColumn("record", F.sum("fresh").over(Window.partitionBy("split").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)))
    ends, last = {}, None
    counts = {r["split"]: r["n"] for r in placed.groupBy("split").agg(F.sum("fresh").alias("n")).collect()}
    for split in sorted(counts):
        ends[split] = split - 1 if last is None else last
        last = split + counts[split] if counts[split] else last
    carried = F.element_at(F.create_map(*(F.lit(x) for s in ends.items() for x in s)), F.col("split"))
    # A record's place: its split's first byte and its number there, which is less than the split's bytes.
    at = F.when(F.col("record") > 0, F.col("split") + F.col("record")).otherwise(carried)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "nth", "line"))), lambda x: x["line"]), "\n")
    records = placed.withColumn("at", at).groupBy("at").agg(F.regexp_replace(joined, "\r$", "").alias("record")).filter("record <> ''")
    edge = f"(^|{re.escape(sep)})\\s*"
    stray = F.regexp_replace(F.replace("record", F.lit('""'), F.lit("")), f'{edge}"[^"]*"', "$1").contains('"')
    if records.filter(stray).limit(1).count():
        return None
    first = records.agg(F.min("at")).first()[0]
    parsed = F.from_csv("record", _ddl(schema), {k: str(v) for k, v in options.items() if k in ("sep", "escape", "emptyValue", "nullValue", "maxColumns", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace", "mode")} | {"multiLine": "true"})
    rows = records.filter(F.col("at") > first).select(parsed.alias("made"), F.struct(F.lit("").alias("file"), F.col("at")).alias(ROW))
    return rows.select("made.*", ROW)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{quoted(f.name)} string" for f in schema)


_WHOLE = r"^\s*[+-]?\d{1,18}\s*$"
_REAL = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def promoted(frame: DataFrame) -> DataFrame:
    """Texts as the narrowest of whole number, number, boolean that all values of the column fit; one pass decides."""
    names = [n for n in frame.columns if n != ROW]
    seen = frame.agg(*(
        F.struct(F.count(col(n)).alias("n"), F.count_if(col(n).isNull()).alias("gaps"), F.count_if(col(n).rlike(_WHOLE)).alias("whole"), F.count_if(col(n).rlike(_REAL)).alias("real"), F.count_if(col(n).isin("True", "False", "TRUE", "FALSE", "true", "false")).alias("truth")).alias(f"c{i}")
        for i, n in enumerate(names)
    )).first()
    out = [F.col(ROW)] if ROW in frame.columns else []
    for i, n in enumerate(names):
        told = seen[f"c{i}"]
        if told["n"] and told["whole"] == told["n"]:
            kind = "double" if told["gaps"] else "bigint"
        elif told["n"] and told["real"] == told["n"]:
            kind = "double"
        else:
            kind = "boolean" if told["n"] and told["truth"] == told["n"] and not told["gaps"] else None
        out.append((F.trim(col(n)).cast(kind) if kind else col(n)).alias(n))
    return frame.select(*out)


def check_workbook(content: bytes, most: int = MAX_WORKBOOK_BYTES) -> zipfile.ZipFile:
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise Unreadable("The file is not an XLSX workbook.") from None
    if sum(x.file_size for x in book.infolist()) > most:
        raise Unreadable(f"The workbook is larger than {most >> 20} MB when unpacked.")
    return book


def _pulled(book: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of that tag one after the other; none is kept."""
    with book.open(part) as stream:
        parents: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if element.tag == f"{_SHEET}{tag}":
                yield element
                if parents:
                    parents[-1].clear()


def _cells(row: ElementTree.Element, shared: list[str], dated: set[int]) -> dict[int, object]:
    out: dict[int, object] = {}
    for place, cell in enumerate(row.iter(f"{_SHEET}c")):
        letters = re.match(r"[A-Z]+", cell.get("r", ""))
        at = sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters[0]))) - 1 if letters else place
        kind, value = cell.get("t"), cell.find(f"{_SHEET}v")
        text = _text(cell) if kind == "inlineStr" else value.text if value is not None else None
        if text is None:
            continue
        if kind == "s":
            out[at] = shared[int(text)]
        elif kind == "b":
            out[at] = text == "1"
        elif kind in ("str", "inlineStr", "e"):
            out[at] = text
        else:
            number = float(text)
            whole = number.is_integer() and "." not in text and abs(number) < 2**63
            out[at] = _day(number) if int(cell.get("s", -1)) in dated else int(number) if whole else number
    return out


def _text(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_SHEET}t"))


def _day(serial: float) -> datetime.datetime:
    return datetime.datetime(1899, 12, 30) + datetime.timedelta(days=serial)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in root.iter(f"{_SHEET}numFmt")}
    formats = root.find(f"{_SHEET}cellXfs")
    is_date = lambda n: n in range(14, 23) or bool(re.search(r"[dmyh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")).lower()))
    return {k for k, x in enumerate(formats if formats is not None else ()) if is_date(int(x.get("numFmtId", 0)))}


#: What a sheet's rows are written as: their number from 0 (the header) and the texts of their cells. Two more rows tell
#: of the sheet: TOLD holds for each column its number of gaps and the types of its cells, FAULT why it can't be read.
_SHEET_ROWS = "at bigint, cells array<string>"
_TOLD, _FAULT = -1, -2
_BATCH_CELLS = 50_000


def _sheet_rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """The rows of the first sheet, read as they are asked for; only the shared strings are held."""
    try:
        book = check_workbook(content)
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        first = next(root.iter(f"{_SHEET}sheet")).get(_RELATION)
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheet = "xl/" + targets[first].removeprefix("/xl/")
        strings = "xl/sharedStrings.xml"
        shared = [_text(x) for x in _pulled(book, strings, "si")] if strings in book.namelist() else []
        dated = _date_styles(book)
        kinds: list[set[str]] | None = None
        counts, n = [], 0
        for at, row in enumerate(_pulled(book, sheet, "row")):
            cells = _cells(row, shared, dated)
            if kinds is None:
                names = unique_names([cells.get(k) for k in range(max(cells, default=-1) + 1)])
                kinds, counts = [set() for _ in names], [0] * len(names)
                yield at, names
                continue
            n += 1
            texts: list[str | None] = [None] * len(kinds)
            for k, value in cells.items():
                if k < len(kinds) and not (isinstance(value, str) and value in MISSING_TOKENS):
                    texts[k] = str(value)
                    kinds[k].add(type(value).__name__)
                    counts[k] += 1
            yield at, texts
        if kinds is None:
            raise Unreadable("The file has no columns.")
        yield _TOLD, [f"{n - has} {' '.join(sorted(of))}" for has, of in zip(counts, kinds, strict=True)]
    except Unreadable as fault:
        yield _FAULT, [str(fault)]
    except (KeyError, IndexError, ValueError, StopIteration, ElementTree.ParseError, zipfile.BadZipFile, zlib.error):
        yield _FAULT, ["The workbook has no sheet that can be read."]


def _sheet_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("at", pa.int64()), ("cells", pa.list_(pa.string()))])
    for batch in batches:
        for content in batch.column("content"):
            places, rows, size = [], [], 0
            for at, cells in _sheet_rows(content.as_py()):
                places.append(at)
                rows.append(cells)
                size += len(cells) + 1
                if size >= _BATCH_CELLS:
                    yield pa.record_batch([places, rows], schema=schema)
                    places, rows, size = [], [], 0
            yield pa.record_batch([pa.array(places, schema.types[0]), pa.array(rows, schema.types[1])], schema=schema)


def read_xlsx(spark: SparkSession, path: str, max_bytes: int | None = MAX_BYTES) -> Table:
    """The first sheet of a workbook of at most max_bytes. A task pulls its rows out one by one and writes them to the
    shared folder, where they stay until the session ends; the driver sees the header and each column's types.

    Columns of one type keep it (whole numbers with gaps become numbers); mixed ones become text."""
    files = spark.read.format("binaryFile").load(_exact(path))
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)  # a larger file is not opened
    kept = Written(spark, "workbook")
    rows = kept.put("rows", files.select("content").mapInArrow(_sheet_batches, _SHEET_ROWS))
    told = {r["at"]: r["cells"] for r in rows.filter(F.col("at") <= 0).collect()}
    if _TOLD not in told:
        kept.only()
        raise Unreadable(told[_FAULT][0] if told else f"The file is larger than {(max_bytes or 0) >> 20} MB.")
    made = [_typed(k, facts).alias(name) for k, (name, facts) in enumerate(zip(told[0], told[_TOLD], strict=True))]
    return of_frame(rows.filter(F.col("at") > 0).select(*made, F.struct(F.lit("").alias("file"), "at").alias(ROW)))


def _typed(k: int, facts: str) -> Column:
    """The k-th cell of a sheet's row as what its column is, by the gaps of the column and the types of its cells."""
    gaps, *kinds = facts.split()
    cell, whole = F.get(F.col("cells"), F.lit(k)), gaps == "0"
    if kinds == ["bool"] and whole:
        return cell.cast("boolean")
    if kinds == ["int"] and whole:
        return cell.cast("bigint")
    if kinds and set(kinds) <= {"int", "float"}:
        return cell.cast("double")
    return cell.cast("timestamp_ntz") if kinds == ["datetime"] else cell


def preview(table: Table, limit: int = 20) -> dict:
    """The first rows as JSON records: gaps and infinities are null, numbers have 10 decimals, moments ISO form."""

    def plain(x: object) -> object:
        if isinstance(x, float):
            return round(x, 10) if math.isfinite(x) else None
        return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x

    n = max(1, min(limit, PREVIEW_ROWS))
    rows = table.ordered().limit(n).collect()
    records = [dict(zip(table.names, map(plain, r), strict=True)) for r in rows]
    return {"columns": table.names, "rows": json.loads(json.dumps(records, default=str))}


def _csv_texts(rows: Iterable[Iterable[object]]) -> list[str]:
    """Each row as delimited text with its line end."""
    out, texts = io.StringIO(), []
    writer = csv.writer(out, lineterminator="\n")
    for row in rows:
        writer.writerow(["" if x is None else x for x in row])
        texts.append(out.getvalue())
        out.seek(0)
        out.truncate()
    return texts


def _csv_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _csv_texts(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.record_batch([pa.array([texts], pa.list_(pa.string()))], names=["texts"])


def csv_chunks(table: Table) -> Iterator[list[str]]:
    """Delimited texts of the rows in row order, header first. Tasks make them, a chunk for each batch of rows, and they
    are handed out one partition after the other, the next one being made meanwhile."""
    yield _csv_texts([table.names])
    zoned = {f.name for f in table.frame.schema if isinstance(f.dataType, T.TimestampType)}
    rows = table.ordered().select(*(col(n).cast("timestamp_ntz").alias(n) if n in zoned else col(n) for n in table.names))
    for chunk in rows.mapInArrow(_csv_batches, "texts array<string>").toLocalIterator(prefetchPartitions=True):
        yield chunk["texts"]


def csv_lines(table: Table) -> Iterator[str]:
    """Header and rows of a delimited text, in row order."""
    for chunk in csv_chunks(table):
        yield from chunk


def write_csv(table: Table, path: str) -> None:
    """The table as delimited part files in row order, from all executors: quotes within values are doubled, as in
    csv_lines(), and blanks around them stay."""
    options = {"header": True, "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table.ordered().write.options(**options).csv(path)


def export_name(file_name: str, n_steps: int) -> str:
    stem = posixpath.splitext(posixpath.basename(file_name))[0]
    return f"{stem} ({n_steps} step{'' if n_steps == 1 else 's'}).csv"


__all__ = ["Unreadable", "check_table", "check_upload", "csv_chunks", "csv_lines", "export_name", "of_frame", "preview", "quoted", "read_csv", "read_dataset", "read_parquet", "read_xlsx", "sniff_delimiter", "unique_names", "write_csv"]
