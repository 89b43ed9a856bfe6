"""Readers: tables, files as bytes, heartbeats, and page scans where a PDF library is installed."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the first bytes of a PDF file.
PDF_MAGIC = "255044462D"
_AT = "x0:double, y0:double, x1:double, y1:double"
PAGE_SCHEMA = f"""path string, page_no int, backend string, text_coverage double, error string, raw_text string, width double, height double,
  blocks array<struct<content:string, {_AT}, font_size:double>>, tables array<struct<rows:array<array<string>>>>,
  images array<struct<image:string, width:int, height:int, hash:string, {_AT}>>"""


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table, read in ranges of a numeric key if its bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def pdf_objects(content: Column) -> Column:
    """The number of objects that a PDF file's trailer states, from the file's last bytes.  The pattern is held
    to their start, as without a trailer it would be tried from each of them, to the end every time."""
    tail = F.decode(F.substring(content, F.greatest(F.lit(1), F.octet_length(content) - 2047), F.lit(2048)), "ISO-8859-1")
    return F.regexp_extract(tail, r"(?s)\A.*/Size\s+(\d+)", 1).try_cast("long")


def file_issues(content: Column, pages: Column, encrypted: Column | None = None, objects: Column | None = None, most_objects: int = 500_000) -> Column:
    """What speaks against a file, as an array; empty means it is accepted.  ``objects``: the parser's
    count; without, the trailer's."""
    has = lambda word: F.contains(content, F.lit(bytearray(word.encode())))
    head = F.hex(F.substring(content, 1, 5))
    found = [
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty_file"),
        F.when(F.coalesce(head, F.lit("")) != PDF_MAGIC, "not_pdf"),
        F.when(pages < 1, "no_pages"),
        F.when(pages > 1000, "too_many_pages"),
    ]
    if encrypted is not None:
        found.append(F.when(encrypted, "encrypted_pdf"))
    found.append(F.when(has("/JS") | has("/JavaScript"), "javascript_embedded"))
    found.append(F.when((objects if objects is not None else pdf_objects(content)) > most_objects, "object_count_exceeded"))
    return F.array_compact(F.array(*found))


def alive_workers(beats: DataFrame, as_of: str, seconds: int = 90) -> DataFrame:
    """Workers whose last heartbeat is recent."""
    last = beats.groupBy("worker").agg(F.max("ts").alias("last"))
    return last.where(F.col("last") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {seconds} SECONDS")).select("worker")


def _box(values: tuple) -> dict:
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, values), strict=True))


def _digest(data: bytes) -> str:
    return hashlib.md5(data[:2048]).hexdigest()[:12] if data else ""


def _pictures(content: bytes, page_no: int) -> list[dict]:
    """A page's embedded images by the span parser: size, bytes and place."""
    import fitz

    found = []
    with fitz.open(stream=content, filetype="pdf") as doc:
        page = doc[page_no - 1]
        for n, (xref, *_) in enumerate(page.get_images(full=True)):
            image = doc.extract_image(xref)
            if not image:
                continue
            at = next(iter(page.get_image_rects(xref)), None)
            found.append({"image": f"p{page_no}_img{n}", "width": image["width"], "height": image["height"], "hash": _digest(image["image"]), **_box((at.x0, at.y0, at.x1, at.y1) if at else (0, 0, 0, 0))})
    return found


def _by_words(content: bytes, page_no: int) -> dict:
    """Words, tables and images of a page by the layout parser; the images' files come from the span
    parser in the same order, where it is installed."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as doc:
        page = doc.pages[page_no - 1]
        blocks = [{"content": w["text"], **_box((w["x0"], w["top"], w["x1"], w["bottom"])), "font_size": 0.0} for w in page.extract_words() or []]
        tables = [{"rows": [[str(c or "") for c in row] for row in t]} for t in page.extract_tables() or [] if t]
        images = [{"image": f"p{page_no}_img{n}", "width": int(i["x1"] - i["x0"]), "height": int(i["bottom"] - i["top"]), "hash": "", **_box((i["x0"], i["top"], i["x1"], i["bottom"]))} for n, i in enumerate(page.images)]
        got = {"raw_text": page.extract_text() or "", "width": float(page.width), "height": float(page.height), "blocks": blocks, "tables": tables, "images": images}
    if images:
        try:
            files = _pictures(content, page_no)
        except ImportError:
            files = []
        for image, file in zip(images, files, strict=False):
            image.update({k: file[k] for k in ("width", "height", "hash")})
    return got


def _by_spans(content: bytes, page_no: int) -> dict:
    """Text spans with their fonts, and images, by the span parser."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        page = doc[page_no - 1]
        lines = [line for block in page.get_text("dict")["blocks"] if block.get("type") == 0 for line in block.get("lines", [])]
        blocks = [{"content": s.get("text", ""), **_box(s["bbox"]), "font_size": float(s.get("size", 0))} for line in lines for s in line.get("spans", [])]
        return {"raw_text": page.get_text("text") or "", "width": float(page.rect.width), "height": float(page.rect.height), "blocks": blocks, "tables": [], "images": _pictures(content, page_no)}


def _as_one_block(content: bytes, page_no: int) -> dict:
    """The last resort: the page's text as one block of its size."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        page = doc[page_no - 1]
        text, w, h = page.get_text("text") or "", float(page.rect.width), float(page.rect.height)
    return {"raw_text": text, "width": w, "height": h, "blocks": [{"content": text, **_box((0, 0, w, h)), "font_size": 0.0}], "tables": [], "images": []}


BACKENDS = {"words": _by_words, "spans": _by_spans, "text": _as_one_block}


def scan_page(content: bytes, page_no: int, least: float = 0.1) -> dict:
    """A page by the first backend whose answer is good enough: over ``least`` characters per square
    point, or an image; the last one's answer is taken as it is.  ``error`` tells if none could read it."""
    failed = "no backend is installed"
    for name, backend in BACKENDS.items():
        try:
            got = backend(content, page_no)
        except Exception as e:  # a page that one parser cannot read is the next one's
            failed = f"{type(e).__name__}: {e}"
            continue
        cover = len(got["raw_text"]) / max(1.0, got["width"] * got["height"])
        if name == "text" or cover > least or got["images"]:
            return {"page_no": page_no, "backend": name, "text_coverage": cover, "error": None, **got}
    return {"page_no": page_no, "backend": None, "text_coverage": 0.0, "error": failed, "raw_text": "", "width": 0.0, "height": 0.0, "blocks": [], "tables": [], "images": []}


def _page_count(content: bytes) -> int:
    try:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            return doc.page_count
    except ImportError:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as doc:
            return len(doc.pages)


def scan_pdf(pdfs: DataFrame) -> DataFrame:
    """Pages of PDF files (``path``, ``content``) with their blocks, tables and images, a row per page
    (:func:`scan_page`); a file that cannot be opened gives one row with its error.  Needs a PDF library
    on the executors."""

    def pages(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    count = _page_count(content)
                except Exception as e:
                    bad = scan_page(b"", 0) | {"error": f"{type(e).__name__}: {e}"}
                    yield pd.DataFrame([{"path": path, **bad}])
                    continue
                for n in range(1, count + 1):
                    yield pd.DataFrame([{"path": path, **scan_page(content, n)}])

    return pdfs.select("path", "content").mapInPandas(pages, PAGE_SCHEMA)
