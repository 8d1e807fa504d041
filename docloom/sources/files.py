"""Files as documents: tolerant decoding, one parser per format, one bad file never fails the rest."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T

MOST_BYTES = 50 * 1024 * 1024


def decode(raw: bytes) -> str:
    """UTF-8 with or without BOM, UTF-16 only with a BOM, then Windows-1252, then UTF-8 with replacement."""
    tries = ["utf-8-sig", *(["utf-16"] if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else []), "cp1252"]
    for encoding in tries:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", errors="replace")


def csv_text(raw: bytes) -> str:
    """Each row as ``column: value`` pairs, so that a passage keeps the meaning of its values; cells beyond the header get numbered names."""
    text = decode(raw)
    try:
        dialect = csv.Sniffer().sniff(text[:4096])
    except csv.Error:
        dialect = csv.excel
    cells = pd.DataFrame(csv.reader(io.StringIO(text), dialect)).map(lambda c: c.strip() if isinstance(c, str) else "")
    if cells.empty:
        return ""
    width = next(csv.reader(io.StringIO(text), dialect), [])
    given = cells.iloc[0]
    names = given.where(given != "", [f"column_{n}" for n in range(1, len(given) + 1)])
    body = cells.iloc[1:]
    pairs = (names + ": " + body).where(body != "")
    rows = pairs.apply(lambda row: "; ".join(row.dropna()), axis=1) if len(body) else pd.Series(dtype=str)
    shown = [f"Row {number}: {row}" for number, row in enumerate(rows, 1) if row]
    return "\n".join(["Columns: " + ", ".join(names.iloc[: len(width)]), "", *shown])


def json_text(raw: bytes) -> str:
    text = decode(raw)
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return text


class _Page(HTMLParser):
    """HTML as plain lines: headings with ``#``, items with ``-``, table rows with bars; scripts and site furniture left out."""

    DROPPED = frozenset("script style nav header footer noscript svg form aside".split())
    BLOCKS = frozenset("p div section article blockquote pre".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: list[str] = []
        self.dropped = 0
        self.in_title = False
        self.heading: list[str] | None = None
        self.table = 0
        self.row: list[list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in self.DROPPED:
            self.dropped += 1
        if self.dropped:
            return
        if tag == "title":
            self.in_title = True
        elif re.fullmatch("h[1-6]", tag):
            self.heading = []
        elif tag == "table":
            self.table += 1
            self.out.append("\n\n")
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append([])
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.DROPPED:
            self.dropped = max(0, self.dropped - 1)
            return
        if self.dropped:
            return
        if tag == "title":
            self.in_title = False
        elif re.fullmatch("h[1-6]", tag) and self.heading is not None:
            words = " ".join(" ".join(self.heading).split())
            self.heading = None
            self.out.append(f"\n\n{'#' * int(tag[1])} {words}\n\n" if words else "")
        elif tag == "tr" and self.row is not None:
            cells = [" ".join(" ".join(c).split()) for c in self.row]
            self.row = None
            if any(cells):
                self.out.append(" | ".join(cells) + "\n")
        elif tag == "table":
            self.table = max(0, self.table - 1)
            self.out.append("\n")
        elif tag in self.BLOCKS and not self.table:
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.dropped:
            return
        if self.in_title:
            self.title.append(data)
        elif self.heading is not None:
            self.heading.append(data)
        elif self.row is not None:
            if self.row:
                self.row[-1].append(data)
        elif not self.table:
            self.out.append(data)


def html_text(raw: bytes) -> str:
    page = _Page()
    page.feed(decode(raw))
    page.close()
    title = "".join(page.title).strip()
    return (f"# {title}\n\n" if title else "") + "".join(page.out)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(raw: bytes) -> str:
    """Paragraphs and tables of a DOCX file in reading order; headings and list items marked."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    out: list[str] = []

    def words(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()

    for node in body if body is not None else ():
        if node.tag == f"{_W}p" and (line := words(node)):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") if style is not None else "") or ""
            if name == "Title":
                line = "# " + line
            elif name.startswith("Heading"):
                digits = re.search(r"\d", name)
                line = "#" * min(6, max(1, int(digits[0]) if digits else 2)) + " " + line
            elif name.startswith("List"):
                line = "- " + line
            out.append(line)
        elif node.tag == f"{_W}tbl":
            rows = []
            for row in node.iter(f"{_W}tr"):
                cells = [words(c) for c in row.findall(f"{_W}tc")]
                merged = [c for n, c in enumerate(cells) if not n or c != cells[n - 1]]
                if any(merged):
                    rows.append(" | ".join(merged))
            out.append("\n".join(rows))
    return "\n\n".join(out)


class PluginMissing(RuntimeError):
    """A format that needs a reader this installation doesn't have."""


#: Plug-ins for PDF files: ``pages`` turns bytes and a password into pages, each a text and the images on it; ``ocr`` an image into text.
PDF = {"pages": None, "ocr": None}
#: Fixed value: a page with fewer characters than this is read from its images, if it has any.
LEAST_PAGE_CHARS = 20


def pdf_pages(raw: bytes) -> list[str]:
    """The text of each page, lines joined; pages without text go to OCR, which gives an empty text where it fails or isn't there."""
    if PDF["pages"] is None:
        raise PluginMissing("reading PDF needs a plug-in: set docloom.sources.files.PDF['pages'] to a function of bytes and a password")
    out = []
    for text, images in PDF["pages"](raw, ""):
        joined = joined_lines(text or "")
        if len(joined.strip()) < LEAST_PAGE_CHARS and images:
            joined = "\n".join(filter(None, map(image_text, images))) or joined
        out.append(joined)
    return out


def image_text(image) -> str:
    try:
        return PDF["ocr"](image) or ""
    except Exception:  # noqa: BLE001 - one page that can't be read doesn't fail its file
        return ""


def joined_lines(text: str) -> str:
    """Words divided at line ends and softly wrapped lines put together, as ``functions.text.join_wrapped_lines`` does on columns."""
    return re.sub(r"([A-Za-z0-9,'\")])[ \t]*\n(?=[a-z(])", r"\1 ", re.sub("([a-z])-\n([a-z])", r"\1\2", text))


def pdf_text(raw: bytes) -> str:
    return "\n\n".join(pdf_pages(raw))


#: Readers by parser name; replace or add entries to plug in others.
READERS = {"txt": decode, "csv": csv_text, "json": json_text, "html": html_text, "docx": docx_text, "pdf": pdf_text}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, errors = [], [], []
        for kind, raw in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            ids.append(hashlib.sha256(raw or b"").hexdigest()[:16])
            try:
                texts.append(READERS[kind](raw or b""))
                errors.append(None)
            except Exception as problem:  # noqa: BLE001 - the status of this file, not of the job
                texts.append(None)
                errors.append(f"{type(problem).__name__}: {problem}"[:300])
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "filename", "size_bytes", "file_type", "doc_id", "raw", "error"])


def parsed(files: DataFrame) -> DataFrame:
    """(path, filename, doc_id, file_type, size_bytes, text, status) of ``binaryFile`` rows, each file read once and none joined.

    Oversized and unsupported files are told by name and length; their content isn't read, so they have no doc_id.
    """
    name = F.element_at(F.split("path", "[/\\\\]"), -1)
    known = F.col("path"), name.alias("filename"), F.col("length").alias("size_bytes"), T.file_type(name).alias("file_type")
    readable = T.is_supported(name) & (F.col("length") <= MOST_BYTES)
    columns = "path string, filename string, size_bytes bigint, file_type string, doc_id string, raw string, error string"
    fit = files.where(readable).select(*known, "content").mapInArrow(_parse, columns)
    text = T.clean(F.col("raw"))
    status = F.when(F.col("error").isNotNull(), F.col("error")).when(~text.rlike(r"\S"), "empty").otherwise("parsed")
    done = fit.select("path", "filename", "doc_id", "file_type", "size_bytes", text.alias("text"), status.alias("status"))
    none = F.lit(None).cast("string")
    left = files.where(~readable).select(known[0], known[1], none.alias("doc_id"), known[3], known[2], none.alias("text"), F.when(~T.is_supported(name), "unsupported").otherwise("too large").alias("status"))
    return done.unionByName(left)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a folder as documents."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of the ``.txt`` files of a folder; the id is the file's name without its extension."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("doc_id"), T.clean(F.col("value")).alias("text"))


def rows_as_text(table: DataFrame) -> DataFrame:
    """Any flat table's rows as ``column: value`` lines, empty cells skipped."""
    cells = [F.when(F.col(c).cast("string").rlike(r"\S"), F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in table.columns]
    return table.select("*", F.concat_ws("; ", *cells).alias("row_text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with evidence from JSON lines; evidence and its mode have defaults."""
    schema = "id string, question string, type string, evidence array<struct<doc string, text string>>, evidence_mode string, reference_answer string"
    rows = spark.read.schema(schema).json(path).where("id is not null")
    return rows.withColumns({"evidence": F.coalesce("evidence", F.expr("cast(array() as array<struct<doc:string,text:string>>)")), "evidence_mode": F.coalesce("evidence_mode", F.lit("all"))})


#: Heading levels by the sign a title is underlined with; titles with a line above and below are of level 1.
RST_LEVELS = {"=": 1, "-": 2, "*": 3, "~": 3, "'": 3, "^": 3, '"': 3}
_RST_SIGN = r"[=\-~'^\"*]"
_RST = re.compile(
    rf"^(?P<a>{_RST_SIGN})(?P=a){{2,}}[ \t]*\n(?P<named>[^\n]*\S[^\n]*)\n(?P<b>{_RST_SIGN})(?P=b){{2,}}[ \t]*$"
    rf"|^(?P<title>(?! )[^\n]*\S[^\n]*)\n(?P<under>(?P<c>{_RST_SIGN})(?P=c){{2,}}[ \t]*)$"
    r"|^[ \t]*\.\.\s+(?:_[\w -]+:|\w[\w-]*::)[ \t]*\S*[ \t]*$\n?",
    re.M,
)


def rst_headings(text: str) -> str:
    """Underlined titles as ``#`` lines; directives without prose are left out, but for code."""

    def shown(found: re.Match) -> str:
        if found["named"] is not None:
            return "# " + found["named"].strip()
        if found["title"] is None:
            return found[0] if "code" in found[0] else ""
        title, under = found["title"].strip(), found["under"].strip()
        return "#" * RST_LEVELS[under[0]] + " " + title if len(under) >= len(title) - 2 else found[0]

    return re.sub(r"\n{3,}", "\n\n", _RST.sub(shown, text)).strip() + "\n"
