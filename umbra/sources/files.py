"""Whole files as rows: text with its bytes' particulars, CSV cells, OOXML segments.

Containers are opened in Python workers, one file at a time; everything else is
built-in expressions.
"""

from __future__ import annotations

import csv
import io
import os
import re
import uuid
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What can be restored, what can't, what isn't read.
REVERSIBLE = (".txt", ".md", ".csv", ".docx", ".xlsx")
IRREVERSIBLE = (".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".pptx", ".html")
UNSUPPORTED = (".doc", ".xls", ".wps", ".et", ".dps", ".pages", ".numbers", ".key")
BOM = b"\xef\xbb\xbf"


def route(path: Column) -> Column:
    """A reversible, B irreversible, C unsupported, else unknown."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext.isin(*REVERSIBLE), "A").when(ext.isin(*IRREVERSIBLE), "B").when(ext.isin(*UNSUPPORTED), "C").otherwise("unknown")


def discover(spark: SparkSession, path: str) -> DataFrame:
    """path, content and route of every file below ``path`` whose name begins with no dot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.where(~F.rlike("path", F.lit(r"/\.[^/]*$"))).withColumn("route", route(F.col("path")))


def as_text(files: DataFrame) -> DataFrame:
    """Adds text, has_bom, newline, has_trailing_newline, sha256. Bytes that aren't UTF-8 are an error."""
    bom = F.col("content").substr(1, 3) == F.lit(BOM)
    body = F.when(bom, F.col("content").substr(F.lit(4), F.length("content"))).otherwise(F.col("content"))
    out = files.withColumns({"has_bom": F.coalesce(bom, F.lit(False)), "text": F.decode(body, "UTF-8"), "sha256": F.sha2("content", 256)})
    newline = F.when(F.contains("text", F.lit("\r\n")), "\r\n").otherwise("\n")
    return out.withColumns({"newline": newline, "has_trailing_newline": F.endswith("text", F.lit("\n"))})


def to_bytes(text: Column, has_bom: Column) -> Column:
    return F.when(has_bom, F.concat(F.lit(BOM), F.encode(text, "UTF-8"))).otherwise(F.encode(text, "UTF-8"))


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Each row as a file below ``folder`` by its relative name, whole or not at all; their number.

    Names that clash, or lead out of the folder, are an error before anything is
    written. ``folder`` is one that all executors share.
    """
    outside = F.rlike(name, F.lit(r"(^|/)\.\.(/|$)")) | F.startswith(name, F.lit("/"))
    bad = rows.select(name).groupBy(name).count().where((F.col("count") > 1) | outside).limit(1).collect()
    if bad:
        raise ValueError(f"two files of one name, or a name outside the folder: {bad[0][name]}")

    def put(batches):
        n = 0
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = os.path.join(folder, at)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                tmp = os.path.join(os.path.dirname(to), f".{uuid.uuid4().hex}")
                with open(tmp, "wb") as f:
                    f.write(data)
                os.replace(tmp, to)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.select(name, content).mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


# ---- CSV ---------------------------------------------------------------------------------------


def dialect(text: str):
    try:
        return csv.Sniffer().sniff(text[:1024])
    except csv.Error:
        return csv.excel


def parse_line(line: str, delimiter: str = ",", quote: str = '"') -> list[tuple[str, bool]]:
    """Fields and whether each was quoted; doubled quotes inside quoted ones are one."""
    if not line:
        return []
    field = re.compile(f"{re.escape(quote)}((?:[^{re.escape(quote)}]|{re.escape(quote * 2)})*){re.escape(quote)}(?={re.escape(delimiter)}|$)|([^{re.escape(delimiter)}]*)")
    out, at = [], 0
    while True:
        m = field.match(line, at)
        quoted = m[1] is not None
        out.append((m[1].replace(quote * 2, quote) if quoted else m[2], quoted))
        at = m.end()
        if at >= len(line):
            return out
        at += len(delimiter)
        if at == len(line):
            return [*out, ("", False)]


def join_line(fields: list[tuple[str, bool]], delimiter: str = ",", quote: str = '"') -> str:
    """A line; a field keeps its quotes, and gets them if it now needs them."""
    need = lambda x: any(c in x for c in (delimiter, quote, "\n", "\r"))
    return delimiter.join(quote + x.replace(quote, quote * 2) + quote if q or need(x) else x for x, q in fields)


def csv_cells(texts: DataFrame) -> DataFrame:
    """path, row, col, cell, quoted, delimiter: lines are rows, as no field spans two."""

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d = dialect(text or "")
                for i, line in enumerate((text or "").splitlines()):
                    rows += [(path, i, j, x, q, d.delimiter) for j, (x, q) in enumerate(parse_line(line, d.delimiter, d.quotechar or '"'))]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "row", "col", "cell", "quoted", "delimiter"])

    return texts.select("path", "text").mapInArrow(run, "path string, row int, col int, cell string, quoted boolean, delimiter string")


def csv_text(cells: DataFrame, texts: DataFrame, cell: str = "cell") -> DataFrame:
    """path, text: the files of ``texts`` with these cells; blank lines and line ends stay."""
    x, d = F.col(cell), F.col("delimiter")
    need = F.col("quoted") | F.contains(x, d) | F.contains(x, F.lit('"')) | F.contains(x, F.lit("\n")) | F.contains(x, F.lit("\r"))
    field = F.when(need, F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col", field.alias("f")))), lambda c: c["f"])
    lines = cells.groupBy("path", "row").agg(F.call_function("array_join", ordered, F.first("delimiter")).alias("line"))
    by_row = lines.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("row", "line"))).alias("m"))
    body = F.regexp_replace("text", r"\r?\n$", "")
    n = F.when(F.col("text") == "", 0).otherwise(F.size(F.split(body, r"\r?\n")))
    j = texts.join(by_row, "path", "left").withColumn("n", n)
    joined = F.call_function("array_join", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.col("m")[i], F.lit(""))), F.col("newline"))
    end = F.when(F.col("has_trailing_newline"), F.col("newline")).otherwise("")
    return j.select("path", F.when(F.col("n") == 0, "").otherwise(F.concat(joined, end)).alias("text"), "has_bom")


# ---- OOXML -------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_PART = re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$")
_SHEET = re.compile(r"xl/worksheets/(.+)\.xml$")


def cell_ref(ref: str) -> tuple[int, int]:
    """A1 -> (row, column), from 0."""
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def ref_of(row: int, col: int) -> str:
    name, n = "", col + 1
    while n:
        n, r = divmod(n - 1, 26)
        name = chr(65 + r) + name
    return f"{name}{row + 1}"


def _paragraph(p) -> str:
    return "".join(t.text or "" for r in p.iter(f"{_W}r") for t in r.findall(f"{_W}t")[:1])


def docx_paragraphs(content: bytes):
    """(part, paragraph number, text) of every text part."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if _PART.match(name):
                for i, p in enumerate(ET.fromstring(z.read(name)).iter(f"{_W}p")):
                    yield name, i, _paragraph(p)


def _repacked(content: bytes, change) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for info in z.infolist():
            w.writestr(info, change(info.filename, z.read(info.filename)))
    return out.getvalue()


def spread(runs: list[str], edits: list[tuple[int, int, str]]) -> list[str]:
    """The runs' texts after the edits (ascending, apart, in the runs' joined text).

    What an edit puts in is dealt over the runs that it covers in proportion to
    what it takes from each; what is left goes to the largest fractions, earlier
    runs first. So every run keeps its format and what isn't edited stays put.
    """
    ends = []
    for r in runs:
        ends.append((ends[-1] if ends else 0) + len(r))
    out = [list(r) for r in runs]
    for start, end, new in reversed(edits):
        over = [(k, max(start, e - len(runs[k])), min(end, e)) for k, e in enumerate(ends) if e - len(runs[k]) < end and start < e]
        total = sum(b - a for _, a, b in over)
        exact = [len(new) * (b - a) / total for _, a, b in over]
        size = [int(x) for x in exact]
        for k in sorted(range(len(over)), key=lambda k: (size[k] - exact[k], k))[: len(new) - sum(size)]:
            size[k] += 1
        at = len(new)
        for (k, a, b), n in zip(reversed(over), reversed(size), strict=True):
            first = ends[k] - len(runs[k])
            out[k][a - first : b - first] = list(new[at - n : at])
            at -= n
    return ["".join(r) for r in out]


def _edited(data: bytes, change) -> bytes:
    """A part after ``change`` of its tree; its namespaces keep their prefixes."""
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=("start-ns",)):
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    root = ET.fromstring(data)
    change(root)
    return ET.tostring(root, "utf-8", xml_declaration=True)


def docx_with(content: bytes, edits: dict[tuple[str, int], list[tuple[int, int, str]]]) -> bytes:
    """The document with these edits of its paragraphs; formats stay, other parts and paragraphs are as they were."""

    def change(name: str, data: bytes) -> bytes:
        if not any(part == name for part, _ in edits):
            return data

        def paragraphs(root):
            for i, p in enumerate(root.iter(f"{_W}p")):
                if (name, i) in edits:
                    nodes = [t for r in p.iter(f"{_W}r") for t in r.findall(f"{_W}t")[:1]]
                    for t, text in zip(nodes, spread([t.text or "" for t in nodes], edits[name, i]), strict=True):
                        if text != (t.text or ""):
                            t.text = text
                            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")

        return _edited(data, paragraphs)

    return _repacked(content, change)


def xlsx_cells(content: bytes):
    """(sheet, row, column, text or None for a formula, is_formula)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_X}si")]
        for name in names:
            if m := _SHEET.match(name):
                for c in ET.fromstring(z.read(name)).iter(f"{_X}c"):
                    row, col = cell_ref(c.get("r"))
                    if c.find(f"{_X}f") is not None:
                        yield m[1], row, col, None, True
                        continue
                    v = c.find(f"{_X}v")
                    if c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_X}t"))
                    else:
                        text = None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                    if text is not None:
                        yield m[1], row, col, text, False


def xlsx_with(content: bytes, texts: dict[tuple[str, int, int], str]) -> bytes:
    """The workbook with these cells as inline strings; shared strings stay as they are."""

    def change(name: str, data: bytes) -> bytes:
        m = _SHEET.match(name)
        if not m or not any(s == m[1] for s, _, _ in texts):
            return data

        def cells(root):
            for c in root.iter(f"{_X}c"):
                at = (m[1], *cell_ref(c.get("r")))
                if at in texts and c.find(f"{_X}f") is None:
                    for child in list(c):
                        c.remove(child)
                    c.set("t", "inlineStr")
                    ET.SubElement(ET.SubElement(c, f"{_X}is"), f"{_X}t").text = texts[at]

        return _edited(data, cells)

    return _repacked(content, change)


def ooxml_segments(files: DataFrame) -> DataFrame:
    """path, part, row, col, text, is_formula: paragraphs (col null) and cells."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path.endswith(".docx"):
                    rows += [(path, part, i, None, text, False) for part, i, text in docx_paragraphs(content)]
                elif path.endswith(".xlsx"):
                    rows += [(path, *c) for c in xlsx_cells(content)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "part", "row", "col", "text", "is_formula"])

    return files.select("path", "content").mapInArrow(run, "path string, part string, row int, col int, text string, is_formula boolean")


def ooxml_with(files: DataFrame, segments: DataFrame, restored: bool = False) -> DataFrame:
    """path, content: the files with their segments redacted, or restored by the same map.

    segments: text, redacted_text and occurrences of ``redact``. Only what differs
    is written; files and cells without a finding are byte for byte as they were.
    """
    cols = ["redacted_start", "redacted_end", "original"] if restored else ["original_start", "original_end", "replacement"]
    edits = F.array_sort(F.transform("occurrences", lambda o: F.struct(*(o[c].alias(n) for c, n in zip(cols, ("a", "b", "new"), strict=True)))))
    changed = segments.where(~F.col("is_formula") & (F.col("redacted_text") != F.col("text")))
    new = changed.groupBy("path").agg(F.collect_list(F.struct("part", "row", "col", F.col("text" if restored else "redacted_text").alias("text"), edits.alias("edits"))).alias("s"))

    def run(batches):
        for b in batches:
            out = []
            for path, content, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if s and path.endswith(".docx"):
                    content = docx_with(content, {(x["part"], x["row"]): [(e["a"], e["b"], e["new"]) for e in x["edits"]] for x in s})
                elif s:
                    content = xlsx_with(content, {(x["part"], x["row"], x["col"]): x["text"] for x in s})
                out.append(content)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    return files.select("path", "content").join(new, "path", "left").mapInArrow(run, "path string, content binary")
