"""Office formats as parsed blocks: an adapter from the bytes of a file to an array of blocks.

The formats are zipped XML; each file is read once in the task that holds it.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "array<struct<kind:string,content:string,level:int,table_rows:array<array<string>>,unit:int>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _block(kind, content=None, level=None, rows=None, unit=None) -> dict:
    return {"kind": kind, "content": content, "level": level, "table_rows": rows, "unit": unit}


def _text(node, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag)).strip()


def docx_blocks(z: zipfile.ZipFile) -> list[dict]:
    """Paragraphs and headings in order, then the tables."""
    body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out, tables = [], []
    for node in body:
        if node.tag == f"{_W}p" and _text(node, f"{_W}t"):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            m = re.fullmatch(r"(?:Heading|heading |Заголовок)\s*(\d)", style.get(f"{_W}val", "") if style is not None else "")
            out.append(_block("heading" if m else "text", _text(node, f"{_W}t"), int(m[1]) if m else 0))
        elif node.tag == f"{_W}tbl":
            tables.append(_block("table", rows=[[_text(c, f"{_W}t") for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]))
    return out + tables


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[tuple[int, str]]:
    return sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n)))


def pptx_blocks(z: zipfile.ZipFile) -> list[dict]:
    """Of each slide its title as a heading of level 2, then its texts and tables."""
    out = []
    for number, name in _numbered(z, r"ppt/slides/slide(\d+)\.xml"):
        root = ET.fromstring(z.read(name))
        for shape in root.iter(f"{_P}sp"):
            kind = shape.find(f".//{_P}nvPr/{_P}ph")
            text = "\n".join(x for x in (_text(p, f"{_A}t") for p in shape.iter(f"{_A}p")) if x)
            if text:
                title = kind is not None and kind.get("type") in ("title", "ctrTitle")
                out.append(_block("heading" if title else "text", text, 2 if title else 0, unit=number))
        for t in root.iter(f"{_A}tbl"):
            out.append(_block("table", rows=[[_text(c, f"{_A}t") for c in r.iter(f"{_A}tc")] for r in t.iter(f"{_A}tr")], unit=number))
    return out


def xlsx_blocks(z: zipfile.ZipFile) -> list[dict]:
    """Of each sheet its name as a heading of level 2 and its cells as one table."""
    names = z.namelist()
    shared = [_text(x, f"{_S}t") for x in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    out = []
    for number, name in _numbered(z, r"xl/worksheets/sheet(\d+)\.xml"):
        rows = []
        for r in ET.fromstring(z.read(name)).iter(f"{_S}row"):
            cells = []
            for c in r.iter(f"{_S}c"):
                v, kind = c.find(f"{_S}v"), c.get("t")
                raw = v.text or "" if v is not None else _text(c, f"{_S}t")
                if kind == "s" and raw.isdigit():
                    raw = shared[int(raw)]
                elif kind == "b":
                    raw = "TRUE" if raw == "1" else "FALSE"
                elif kind == "e":
                    raw = f"#ERR:{raw}"
                elif kind in (None, "n") and re.fullmatch(r"-?\d+\.0+", raw):
                    raw = raw.split(".")[0]
                cells.append(raw)
            rows.append(cells)
        out += [_block("heading", titles[number - 1] if number <= len(titles) else f"sheet{number}", 2, unit=number), _block("table", rows=rows, unit=number)]
    return out


_PARSERS = {"docx": docx_blocks, "docm": docx_blocks, "pptx": pptx_blocks, "xlsx": xlsx_blocks}


def blocks_of(content: bytes | None, extension: str | None) -> list[dict] | None:
    """Blocks of one file; null for other formats and for broken files."""
    parser = _PARSERS.get((extension or "").lower())
    if not parser or not content:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return parser(z)
    except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError, IndexError):
        return None


def parsed_blocks(content: Column | str, extension: Column | str) -> Column:
    """Blocks of each file of a binary column."""

    @F.pandas_udf(BLOCKS)
    def parse(data: pd.Series, ext: pd.Series) -> pd.Series:
        return pd.Series([blocks_of(c, e) for c, e in zip(data, ext, strict=True)])

    return parse(content, extension)


def read_office(files: DataFrame) -> DataFrame:
    """(path, block_no, kind, content, level, table_rows, unit) of binary files (path, content); unreadable files give no rows."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    rows = files.select("path", F.posexplode(parsed_blocks(F.col("content"), ext)).alias("block_no", "b"))
    return rows.select("path", "block_no", "b.*")
