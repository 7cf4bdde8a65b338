"""Documents from files: text, workbooks, office files, HTML, images, PDFs by an engine.

Files are scanned as ``binaryFile``; each loader is a function (path, content) -> pages that runs in Python workers, a
batch at a time. A file that a loader cannot read gives a row with ``error_class`` instead of an exception. Spark's file
scan passes over files of no bytes; rows that come with empty content from elsewhere are loaded as they are.
"""

from __future__ import annotations

import html.parser
import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.errors import UnreadableDocument
from leafmill.model import DOCUMENT

#: Extension to MIME type; the reverse look-up serves paths without a suffix.
_MIME = {
    "html": "text/html", "tiff": "image/tiff", "bmp": "image/bmp", "webp": "image/webp", "gif": "image/gif", "jpg": "image/jpeg", "png": "image/png", "pdf": "application/pdf",
    **{ext: f"application/vnd.openxmlformats-officedocument.{kind}" for ext, kind in (("pptx", "presentationml.presentation"), ("docx", "wordprocessingml.document"), ("xlsx", "spreadsheetml.sheet"))},
}
EXTENSION_OF_MIME = {m: f".{e}" for e, m in _MIME.items()}

Page = dict
Loader = Callable[[str, bytes], list[Page]]


class PdfEngine(Protocol):
    """What a PDF library must offer to be plugged in."""

    def load_pages(self, content: bytes) -> list[Page]: ...

    def extract_images(self, content: bytes) -> list[dict]: ...


def page(index: int, text: str = "", blocks: list[dict] | None = None, image_ref: str | None = None) -> Page:
    return {"index": index, "text": text, "blocks": blocks or [], "image_ref": image_ref}


def block(text: str, bbox: tuple | None = None, **meta: str) -> dict:
    box = dict(zip(("x0", "y0", "x1", "y1"), map(float, bbox))) if bbox else None
    return {"text": text, "bbox": box, "meta": meta}


def load_text(path: str, content: bytes) -> list[Page]:
    return [page(0, content.decode("utf-8", "replace"))]


# --- images


def image_size(content: bytes) -> tuple[str, int, int]:
    """(format, width, height) from the file's header; raises for what is no image."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and content[12:16] == b"IHDR":
        return ("png", *struct.unpack(">II", content[16:24]))
    if content[:3] == b"GIF":
        return ("gif", *struct.unpack("<HH", content[6:10]))
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return "bmp", w, abs(h)
    if content[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(content):
            if content[i] != 0xFF:
                i += 1
                continue
            kind = content[i + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[i + 5 : i + 9])
                return "jpeg", w, h
            i += 2 + (struct.unpack(">H", content[i + 2 : i + 4])[0] if not 0xD0 <= kind <= 0xD9 else 0)
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        if content[12:16] == b"VP8X":
            return "webp", 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
        if content[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", content[26:30])
            return "webp", w & 0x3FFF, h & 0x3FFF
        if content[12:16] == b"VP8L":
            n = int.from_bytes(content[21:25], "little")
            return "webp", (n & 0x3FFF) + 1, (n >> 14 & 0x3FFF) + 1
    if content[:4] in (b"II*\x00", b"MM\x00*"):
        e = "<" if content[:2] == b"II" else ">"
        at = struct.unpack(e + "I", content[4:8])[0]
        dims = {}
        for k in range(struct.unpack(e + "H", content[at : at + 2])[0]):
            tag, kind = struct.unpack(e + "HH", content[at + 2 + 12 * k : at + 6 + 12 * k])
            raw = content[at + 10 + 12 * k : at + 14 + 12 * k]
            dims[tag] = struct.unpack(e + "H", raw[:2])[0] if kind == 3 else struct.unpack(e + "I", raw)[0]
        return "tiff", dims[256], dims[257]
    raise UnreadableDocument("no image")


def load_image(path: str, content: bytes) -> list[Page]:
    """One page without text that refers to the image; the header must be that of an image."""
    image_size(content)
    return [page(0, "", image_ref=path)]


# --- office files, by their XML


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    out = {}
    for r in ET.fromstring(z.read(path)):
        target = r.get("Target", "")
        full = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
        while "/../" in full:
            full = re.sub(r"[^/]+/\.\./", "", full, count=1)
        out[r.get("Id")] = full
    return out


def _cell(c, shared: list[str]) -> str:
    kind = c.get("t", "n")
    raw = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
    if kind == "s":
        return shared[int(raw)] if raw else ""
    if kind == "inlineStr":
        return "".join(x.text or "" for x in c.iter() if _local(x.tag) == "t")
    if kind == "b":
        return {"1": "True", "0": "False"}.get(raw, "")
    return raw


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def load_xlsx(path: str, content: bytes) -> list[Page]:
    """A page a worksheet: cells joined by tabs, rows by newlines, empty cells ''; the sheet's name is a block."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if _local(t.tag) == "t"))
        rels = _rels(z, "xl/workbook.xml")
        out = []
        for s in (x for x in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"):
            rid = next(v for k, v in s.attrib.items() if _local(k) == "id")
            grid: list[list[str]] = []
            for row in (x for x in ET.fromstring(z.read(rels[rid])).iter() if _local(x.tag) == "row"):
                at = int(row.get("r", len(grid) + 1)) - 1
                while len(grid) <= at:
                    grid.append([])
                for k, c in enumerate(x for x in row if _local(x.tag) == "c"):
                    col = _column(c.get("r")) if c.get("r") else k
                    grid[at] += [""] * (col + 1 - len(grid[at]))
                    grid[at][col] = _cell(c, shared)
            wide = max(map(len, grid), default=0)
            text = "\n".join("\t".join(r + [""] * (wide - len(r))) for r in grid)
            out.append(page(len(out), text, [block(s.get("name"), kind="sheet_name")]))
        return out


class _Html(html.parser.HTMLParser):
    """Markdown of an HTML page: headings, paragraphs, list items, tables, image markers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.now: list[str] = []
        self.skip = 0
        self.prefix = ""
        self.rows: list[list[str]] | None = None

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.now)).strip()
        self.now = []
        if text:
            self.out.append(self.prefix + text)
        self.prefix = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "noscript", "script", "style"):
            self.skip += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.flush()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag in ("p", "div", "br", "section", "article", "ul", "ol"):
            self.flush()
        elif tag == "li":
            self.flush()
            self.prefix = "- "
        elif tag == "img":
            self.flush()
            self.out.append("<!-- image -->")
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th"):
            self.now = []

    def handle_endtag(self, tag):
        if tag in ("head", "noscript", "script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.now)).strip())
            self.now = []
        elif tag == "table" and self.rows is not None:
            rows = [r for r in self.rows if r]
            if rows:
                n = len(rows[0])
                line = lambda r: "| " + " | ".join((r + [""] * n)[:n]) + " |"
                self.out.append("\n".join([line(rows[0]), line(["---"] * n), *map(line, rows[1:])]))
            self.rows = None
        elif re.fullmatch(r"h[1-6]|p|div|li|section|article", tag):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)


def load_html(path: str, content: bytes) -> list[Page]:
    p = _Html()
    p.feed(content.decode("utf-8", "replace"))
    p.close()
    p.flush()
    return [page(0, "\n\n".join(p.out))]


def load_docx(path: str, content: bytes) -> list[Page]:
    """One page: paragraphs, headings by style, tables, and a marker where a picture stands."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(x for x in ET.fromstring(z.read("word/document.xml")) if _local(x.tag) == "body")
    out = []

    def para(p) -> str:
        text = "".join((x.text or "") if _local(x.tag) == "t" else "\t" if _local(x.tag) == "tab" else "" for x in p.iter())
        style = next((v for x in p.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
        m = re.fullmatch(r"Heading(\d)", style)
        marks = sum(_local(x.tag) == "blip" for x in p.iter())
        return "\n\n".join([*([("#" * int(m[1]) + " " if m else "") + text] if text.strip() else []), *["<!-- image -->"] * marks])

    for x in body:
        if _local(x.tag) == "p":
            out.append(para(x))
        elif _local(x.tag) == "tbl":
            rows = [[" ".join("".join(t.text or "" for t in c.iter() if _local(t.tag) == "t").split()) for c in r if _local(c.tag) == "tc"] for r in x if _local(r.tag) == "tr"]
            if rows:
                n = len(rows[0])
                line = lambda r, n=n: "| " + " | ".join((r + [""] * n)[:n]) + " |"
                out.append("\n".join([line(rows[0]), line(["---"] * n), *map(line, rows[1:])]))
    return [page(0, "\n\n".join(x for x in out if x))]


def _slides(z: zipfile.ZipFile) -> list[str]:
    rels = _rels(z, "ppt/presentation.xml")
    ids = [next(v for k, v in x.attrib.items() if _local(k) == "id" and k.startswith("{")) for x in ET.fromstring(z.read("ppt/presentation.xml")).iter() if _local(x.tag) == "sldId"]
    return [rels[i] for i in ids]


def load_pptx(path: str, content: bytes) -> list[Page]:
    """One page: the slides' paragraphs in order, and a marker for each picture."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in _slides(z):
            for x in ET.fromstring(z.read(name)).iter():
                if _local(x.tag) == "p":
                    t = "".join(r.text or "" for r in x.iter() if _local(r.tag) == "t").strip()
                    if t:
                        out.append(t)
                elif _local(x.tag) == "pic":
                    out.append("<!-- image -->")
    return [page(0, "\n\n".join(out))]


EMU = 12700.0
MIN_POINTS = 12.0


def pptx_images(content: bytes) -> list[dict]:
    """Pictures of slides in order, groups included, layouts and masters not; those under 12 points are left out."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for at, name in enumerate(_slides(z)):
            rels = _rels(z, name)
            for pic in (x for x in ET.fromstring(z.read(name)).iter() if _local(x.tag) == "pic"):
                rid = next((v for x in pic.iter() if _local(x.tag) == "blip" for k, v in x.attrib.items() if _local(k) == "embed"), None)
                off = next((x for x in pic.iter() if _local(x.tag) == "off"), None)
                ext = next((x for x in pic.iter() if _local(x.tag) == "ext" and x.get("cx")), None)
                if rid not in rels or ext is None:
                    continue
                w, h = int(ext.get("cx")) / EMU, int(ext.get("cy")) / EMU
                if min(w, h) < MIN_POINTS:
                    continue
                x0, y0 = (int(off.get("x")) / EMU, int(off.get("y")) / EMU) if off is not None else (0.0, 0.0)
                out.append(_image(z.read(rels[rid]), at, (x0, y0, x0 + w, y0 + h)))
    return out


def docx_images(content: bytes) -> list[dict]:
    """Pictures of the body, inline and anchored, in order, all on page 0."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        rels = _rels(z, "word/document.xml")
        for x in ET.fromstring(z.read("word/document.xml")).iter():
            if _local(x.tag) == "blip":
                rid = next((v for k, v in x.attrib.items() if _local(k) == "embed"), None)
                if rid in rels and rels[rid] in z.namelist():
                    out.append(_image(z.read(rels[rid]), 0, None))
    return out


def _image(data: bytes, at: int, bbox: tuple | None) -> dict:
    try:
        kind, w, h = image_size(data)
    except Exception:  # an embedded picture of another kind still is a figure
        kind, w, h = "octet-stream", None, None
    return {"page": at, "bbox": dict(zip(("x0", "y0", "x1", "y1"), bbox)) if bbox else None, "width": w, "height": h, "mime": f"image/{kind}", "data": data}


# --- dispatch


def pdf_loader(engine: PdfEngine | None) -> Loader:
    def load(path: str, content: bytes) -> list[Page]:
        if engine is None:
            raise UnreadableDocument("no PDF engine is registered; pass one that offers load_pages(content)")
        return engine.load_pages(content)

    return load


@dataclass(frozen=True)
class Loaders:
    """Loader for each extension; a later registration of an extension wins."""

    table: dict[str, Loader] = field(default_factory=dict)

    @staticmethod
    def default(pdf: PdfEngine | None = None) -> "Loaders":
        t: dict[str, Loader] = {".pdf": pdf_loader(pdf), ".xlsx": load_xlsx, ".docx": load_docx, ".pptx": load_pptx}
        t |= dict.fromkeys((".htm", ".html"), load_html) | dict.fromkeys((".txt", ".md"), load_text)
        return Loaders(t | {f".{e}": load_image for e in "bmp gif jpeg jpg png tif tiff webp".split()})

    def with_(self, extensions: tuple[str, ...], loader: Loader) -> "Loaders":
        return Loaders({**self.table, **dict.fromkeys(extensions, loader)})

    def key(self, path: str, mime: str | None) -> str | None:
        """The extension that chooses the loader: the path's suffix, or without one the MIME type's."""
        m = re.search(r"[^/\\](\.[^./\\]+)$", path)
        ext = m[1].lower() if m else EXTENSION_OF_MIME.get((mime or "").lower())
        return ext if ext in self.table else None


def _error(e: Exception) -> str:
    said = f"{type(e).__name__} {e}".lower()
    return "encrypted or password-protected" if "password" in said or "encrypt" in said else f"cannot be read: {e}"


def ingest(files: DataFrame, loaders: Loaders | None = None, max_pages: int | None = None) -> DataFrame:
    """DOCUMENT rows from (path, content[, mime]): pages, or an error_class of unknown_type, unreadable or input_too_large."""
    loaders = loaders or Loaders.default()
    given = files.select("path", F.col("mime").alias("mime") if "mime" in files.columns else F.lit(None).cast("string").alias("mime"), "content")

    def run(it: Iterator[pd.DataFrame]):
        for part in it:
            rows = []
            for path, mime, content in zip(part["path"], part["mime"], part["content"]):
                pages, kind, text = [], None, None
                key = loaders.key(path, mime)
                if key is None:
                    kind, text = "unknown_type", "no loader for this type"
                else:
                    try:
                        pages = loaders.table[key](path, bytes(content))
                    except Exception as e:
                        kind, text = "unreadable", _error(e)
                if max_pages is not None and len(pages) > max_pages:
                    kind, text, pages = "input_too_large", f"{len(pages)} pages, {max_pages} allowed", []
                rows.append((path, path, mime, pages, None, kind, text))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "mime", "pages", "markdown", "error_class", "error"])

    return given.mapInPandas(run, DOCUMENT).withColumn("doc_id", F.sha2("path", 256))


def read_documents(spark: SparkSession, path: str, loaders: Loaders | None = None, max_pages: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """``ingest`` of a folder or glob; files over ``max_bytes`` are rejected by their listing, unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return _bounded(files, loaders, max_pages, max_bytes)


def _bounded(files: DataFrame, loaders: Loaders | None, max_pages: int | None, max_bytes: int | None) -> DataFrame:
    if max_bytes is None:
        return ingest(files, loaders, max_pages)
    good = ingest(files.where(F.col("length") <= max_bytes), loaders, max_pages)
    empty = F.array().cast(good.schema["pages"].dataType)
    bad = files.where(F.col("length") > max_bytes).select(
        F.sha2("path", 256).alias("doc_id"), "path", F.lit(None).cast("string").alias("mime"), empty.alias("pages"), F.lit(None).cast("string").alias("markdown"),
        F.lit("input_too_large").alias("error_class"), F.concat(F.col("length").cast("string"), F.lit(f" bytes, {max_bytes} allowed")).alias("error"),
    )
    return good.unionByName(bad)


def figures_of(files: DataFrame, pdf: PdfEngine | None = None) -> DataFrame:
    """(doc_id, seq, page, bbox, width, height, mime, data) of the pictures in office files and, with an engine, PDFs."""
    kind = "doc_id string, seq int, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, width int, height int, mime string, data binary"

    def run(it: Iterator[pd.DataFrame]):
        for part in it:
            rows = []
            for path, content in zip(part["path"], part["content"]):
                low = path.lower()
                get = pptx_images if low.endswith(".pptx") else docx_images if low.endswith(".docx") else pdf.extract_images if pdf and low.endswith(".pdf") else None
                found = get(bytes(content)) if get else []
                rows += [(path, i, f["page"], f["bbox"], f["width"], f["height"], f["mime"], f["data"]) for i, f in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "page", "bbox", "width", "height", "mime", "data"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, kind).withColumn("doc_id", F.sha2("doc_id", 256))


def fail_fast(docs: DataFrame) -> DataFrame:
    """Raise at the first row that carries an error."""
    check = F.when(F.col("error_class").isNotNull(), F.raise_error(F.concat("error_class", F.lit(": "), "error")))
    return docs.withColumn("error_class", F.coalesce(check.cast("string"), "error_class"))


# --- evaluation inputs


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(input_path, key_field, expected array of maps) of an evaluation set in JSON."""
    kind = "key_field string, config string, cases array<struct<input_path:string,input:string,expected:array<map<string,string>>,expected_records:array<map<string,string>>>>"
    d = spark.read.schema(kind).json(path, multiLine=True).select("key_field", F.explode("cases").alias("c"))
    return d.select(F.coalesce("c.input_path", "c.input").alias("input_path"), "key_field", F.coalesce("c.expected", "c.expected_records").alias("expected"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(image, fields) of an OCR manifest; relative paths start at the manifest's folder."""
    d = spark.read.schema("image string, fields map<string,string>").json(path, multiLine=True)
    folder = path.rpartition("/")[0]
    absolute = F.regexp_like("image", F.lit(r"\A(/|[A-Za-z][A-Za-z0-9+.-]*://)"))
    return d.select(F.when(absolute, F.col("image")).otherwise(F.concat(F.lit(folder + "/" if folder else ""), "image")).alias("image"), "fields")


def load_spec(path: str) -> dict:
    """A benchmark file: mappings ``schema``, list ``pipeline`` and ``dataset`` must be there."""
    import yaml

    with open(path, encoding="utf-8") as f:
        spec = yaml.safe_load(f)
    lacking = [k for k in ("name", "pipeline", "schema", "dataset") if not isinstance(spec, dict) or k not in spec]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    return spec


def ocr_text(reply: Column) -> Column:
    """LINE texts of an OCR reply in JSON, joined by blanks."""
    line = "array<struct<BlockType:string,Text:string>>"
    blocks = F.coalesce(F.from_json(F.get_json_object(reply, "$.Blocks"), line), F.from_json(reply, line))
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b["BlockType"] == "LINE") & b["Text"].isNotNull()), lambda b: b["Text"]), " ")


def sample_catalogue(spark: SparkSession) -> DataFrame:
    """A small catalogue with stray blanks, as tab-separated text of one page."""
    rows = ["name\tSKU\tPrice\tcurrency", " Desk lamp \tDL-1\t24.50\tEUR", "Pencil\tP-07\t0.90\tEUR", "Notebook \tN-12\t3.10\tEUR", "Stapler\tS-3\t 7.00 \tEUR", "Shelf\tSH-9\t59\tEUR"]
    return spark.createDataFrame([("catalogue", "catalogue.txt", None, [page(0, "\n".join(rows))], None, None, None)], DOCUMENT)
