"""Bytes to text, by format. A reader that fails, or whose library is absent, gives no text and status `failed`."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_VOID = {"script", "style", "noscript"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.node: list[str] = []
        self.skip: list[str] = []

    def flush(self) -> None:
        if (t := "".join(self.node).strip()) and not self.skip:
            self.parts.append(t)
        self.node = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        if tag in _VOID:
            self.skip.append(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if tag in self.skip:
            self.skip.remove(tag)

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_data(self, data: str) -> None:
        self.node.append(data)


def from_text(raw: bytes) -> str:
    return raw.decode("utf-8", "ignore")


def html_text(markup: str) -> str:
    """Each text node stripped, empty ones left out, one a line; no scripts or styles; the title stays."""
    parser = _Text()
    parser.feed(markup)
    parser.close()
    parser.flush()
    return "\n".join(parser.parts)


def from_html(raw: bytes) -> str:
    return html_text(raw.decode("utf-8", "ignore"))


def from_csv(raw: bytes) -> str:
    return "\n".join("\t".join(row) for row in csv.reader(io.StringIO(raw.decode("utf-8", "ignore"), newline="")))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _runs(node: ElementTree.Element) -> str:
    put = {"t": lambda x: x.text or "", "tab": lambda x: "\t", "br": lambda x: "\n", "cr": lambda x: "\n"}
    return "".join(put[_local(x.tag)](x) for x in node.iter() if _local(x.tag) in put)


def from_docx(raw: bytes) -> str:
    """Paragraphs of the body, then the rows of its tables, cells joined by tabs."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    out = [_runs(x) for x in body if _local(x.tag) == "p"]
    for table in (x for x in body if _local(x.tag) == "tbl"):
        for row in (x for x in table if _local(x.tag) == "tr"):
            cells = [x for x in row if _local(x.tag) == "tc"]
            out.append("\t".join("\n".join(_runs(p) for p in c if _local(p.tag) == "p") for c in cells))
    return "\n".join(out)


def from_xlsx(raw: bytes) -> str:
    """For each sheet a head line, then its rows from the first to the last cell, joined by tabs; stored values."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = [_runs(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in (x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"):
            out.append(f"# Sheet: {sheet.get('name')}")
            target = links[next(v for k, v in sheet.attrib.items() if _local(k) == "id")].lstrip("/")
            tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for row in (x for x in tree.iter() if _local(x.tag) == "row"):
                cells: dict[int, str] = {}
                for at, c in enumerate(x for x in row if _local(x.tag) == "c"):
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    column = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(letters[0]))) - 1 if letters else at
                    value = next((x.text or "" for x in c if _local(x.tag) == "v"), _runs(c))
                    cells[column] = shared[int(value)] if c.get("t") == "s" else value
                out.append("\t".join(cells.get(i, "") for i in range(max(cells, default=-1) + 1)))
    return "\n".join(out)


def from_rtf(raw: bytes) -> str:
    """The text of an RTF file: groups that hold no text are left out, escapes resolved."""
    hidden = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "generator", "themedata", "listtable", "header", "footer"}
    out, stack, skip, after = [], [], False, 0
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\([a-z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}\r\n]+)", raw.decode("latin-1")):
        code, word, number, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif word in hidden or sign == "*":
            skip = True
        elif not skip:
            if word in ("par", "line"):
                out.append("\n")
            elif word == "tab":
                out.append("\t")
            elif word == "u" and number:
                out.append(chr(int(number) % 65536))
                after = 1
            elif code or plain or sign:
                text = bytes.fromhex(code).decode("cp1252", "ignore") if code else plain or (sign if sign in "\\{}" else " " if sign == "~" else "")
                out.append(text[after:])
                after = 0
    return "".join(out)


def from_pdf(raw: bytes) -> str:
    from pdfminer.high_level import extract_text

    return extract_text(io.BytesIO(raw))


def from_image(raw: bytes) -> str:
    """Text in an image, if the optional libraries are there; none otherwise."""
    try:
        import pytesseract
        from PIL import Image

        return pytesseract.image_to_string(Image.open(io.BytesIO(raw)))
    except Exception:
        return ""


READERS: dict[str, Callable[[bytes], str]] = {".txt": from_text, ".md": from_text, ".markdown": from_text, ".pdf": from_pdf, ".docx": from_docx, ".rtf": from_rtf, ".html": from_html, ".htm": from_html, ".csv": from_csv, ".xlsx": from_xlsx}
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")


def extractor(readers: dict[str, Callable[[bytes], str]]):
    """A column function (suffix, content) to (text, status)."""

    @F.pandas_udf(StructType([StructField("text", StringType()), StructField("status", StringType())]))
    def run(suffix: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for kind, raw in zip(suffix, content):
            try:
                rows.append((readers[kind](bytes(raw or b"")), "ok"))
            except Exception:
                rows.append(("", "failed"))
        return pd.DataFrame(rows, columns=["text", "status"])

    return run


@F.pandas_udf(StringType())
def html_to_text(markup: pd.Series) -> pd.Series:
    return markup.map(lambda m: None if m is None else html_text(m))
