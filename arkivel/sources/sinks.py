"""Rows as CSV, VOTable, FITS and JSON; packages read back."""

from __future__ import annotations

import csv
import hashlib
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_LIMIT = 8 << 20
_LISTING = "package string, path string, size long, sha256 string, md5 string, text string"


def csv_lines(df: DataFrame, quote_all: bool = False) -> DataFrame:
    """(value): RFC 4180 lines without line ends, quotes only where needed or everywhere; null is empty."""
    def cell(c: str):
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return quoted if quote_all else F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)

    return df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("value"))


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """Distributed parts with header and CRLF."""
    df.write.option("header", True).option("lineSep", "\r\n").option("quoteAll", quote_all).option("escape", '"').csv(path)


_VO = {"int": "int", "bigint": "long", "smallint": "short", "tinyint": "unsignedByte", "float": "float", "double": "double", "boolean": "boolean"}


def votable(df: DataFrame, name: str, units: dict[str, str] | None = None) -> DataFrame:
    """(part, value): head, one line per row, foot: written in the order of part they are a VOTable."""
    spark, units = df.sparkSession, units or {}
    fields = "".join(f"<FIELD name={quoteattr(c)} datatype={quoteattr(_VO.get(t, 'char'))}{'' if t in _VO else ' arraysize=' + quoteattr('*')}{' unit=' + quoteattr(units[c]) if c in units else ''}/>" for c, t in df.dtypes)
    head = f'<?xml version="1.0"?><VOTABLE version="1.4"><RESOURCE><TABLE name={quoteattr(name)}>{fields}<DATA><TABLEDATA>'
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit("<TR>"), *[F.concat(F.lit("<TD>"), safe(c), F.lit("</TD>")) for c in df.columns], F.lit("</TR>"))
    edge = lambda part, text: spark.createDataFrame([(part, text)], "part int, value string")
    return edge(0, head).union(df.select(F.lit(1).alias("part"), row.alias("value"))).union(edge(2, "</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"))


def fits_image(pixels: np.ndarray, bits: int, zero: int = 0) -> bytes:
    """A FITS file of one image; NaN marks a missing pixel, which whole-number storage keeps as BLANK."""
    blank = None
    if bits > 0:
        stored = pixels - zero
        if np.isnan(stored).any():
            blank = {8: 255, 16: -(1 << 15), 32: -(1 << 31)}[bits]
            stored = np.where(np.isnan(stored), blank, stored)
        data = stored.astype({8: ">u1", 16: ">i2", 32: ">i4"}[bits])
    else:
        data = pixels.astype({-32: ">f4", -64: ">f8"}[bits])
    cards = [("SIMPLE", "T"), ("BITPIX", str(bits)), ("NAXIS", "2"), ("NAXIS1", str(pixels.shape[1])), ("NAXIS2", str(pixels.shape[0]))]
    if zero:
        cards += [("BZERO", str(zero)), ("BSCALE", "1")]
    if blank is not None:
        cards.append(("BLANK", str(blank)))
    head = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards) + "END".ljust(80)
    raw = data.tobytes()
    return head.ljust(-(-len(head) // 2880) * 2880).encode() + raw.ljust(-(-len(raw) // 2880) * 2880, b"\0")


def fits_headers(data: bytes, most: int = 1000) -> list[list[tuple[str, str, str]]]:
    """[(keyword, value, comment)] of each HDU; the data between are skipped by their size."""
    out, at = [], 0
    while at + 2880 <= len(data) and len(out) < most:
        cards: list[tuple[str, str, str]] = []
        ended = False
        while not ended and at + 2880 <= len(data):
            block = data[at : at + 2880].decode("latin-1")
            at += 2880
            for k in range(0, 2880, 80):
                card = block[k : k + 80]
                key = card[:8].strip()
                if key == "END":
                    ended = True
                    break
                if card[8:10] == "= ":
                    m = re.match(r"\s*'((?:[^']|'')*)'\s*(?:/(.*))?$", card[10:]) or re.match(r"\s*([^/]*?)\s*(?:/(.*))?$", card[10:])
                    cards.append((key, m[1].replace("''", "'").rstrip(), (m[2] or "").strip()))
        out.append(cards)
        v = {k: x for k, x, _ in cards}
        n = int(v.get("NAXIS", "0"))
        if n:
            size = 1
            for i in range(1, n + 1):
                size *= int(v[f"NAXIS{i}"])
            size = abs(int(v["BITPIX"])) // 8 * int(v.get("GCOUNT", "1")) * (int(v.get("PCOUNT", "0")) + size)
            at += -(-size // 2880) * 2880
    return out


def _entries(name: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
    elif name.endswith((".tar", ".tar.gz", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())
    else:
        yield name.rsplit("/", 1)[-1], raw


def package_listing(files: DataFrame) -> DataFrame:
    """Entries of zip, tar and tar.gz packages (path, content) with digests; small ones that are text with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for path, body in _entries(name, raw):
                    text = None
                    if len(body) <= TEXT_LIMIT and b"\0" not in body:
                        try:
                            text = body.decode()
                        except UnicodeDecodeError:
                            pass  # not text
                    rows.append((name, path, len(body), hashlib.sha256(body).hexdigest(), hashlib.md5(body, usedforsecurity=False).hexdigest(), text))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], ["package", "path", "size", "sha256", "md5", "text"])

    return files.select("path", "content").mapInArrow(run, _LISTING)


def read_catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", quote: str = '"', encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    return spark.read.csv(path, sep=sep, quote=quote, escape=quote, encoding=encoding, header=header, multiLine=True)


def rows_by_header(text: str) -> list[dict[str, str]]:
    """RFC 4180 rows as maps; values of one header that occurs twice are joined by `; `."""
    head, *rest = list(csv.reader(io.StringIO(text))) or [[]]
    out = []
    for row in rest:
        made: dict[str, str] = {}
        for k, v in zip(head, row, strict=False):
            made[k] = f"{made[k]}; {v}" if made.get(k) and v else made.get(k) or v
        out.append(made)
    return out


def workbook(raw: bytes) -> dict[str, list[list[str]]]:
    """Sheets of an XLSX file as text, cached results of formulas; with the standard library only."""
    from xml.etree import ElementTree as X

    n = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rid = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter("{%s}t" % n["m"])) for s in X.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", n)] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in X.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in X.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", n):
            rows = []
            for row in X.fromstring(z.read("xl/" + targets[sheet.get(rid)].removeprefix("/xl/"))).findall("m:sheetData/m:row", n):
                cells: list[str] = []
                for c in row.findall("m:c", n):
                    at = 0
                    for ch in re.match("[A-Z]+", c.get("r", "A"))[0]:
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                    v = c.find("m:v", n)
                    inline = "".join(t.text or "" for t in c.iter("{%s}t" % n["m"]))
                    cells.append(inline if c.get("t") == "inlineStr" else shared[int(v.text)] if v is not None and c.get("t") == "s" else (v.text or "") if v is not None else "")
                rows.append(cells)
            out[sheet.get("name")] = rows
    return out


def page_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def bits_of(raw: bytes, offset: int, length: int) -> int:
    return int.from_bytes(raw, "big") >> (8 * len(raw) - offset - length) & ((1 << length) - 1)


