"""Where page text, characters and pictures come from, and how files become source text.

A ``PageProvider`` wraps a PDF library (none is needed here: ``JsonPages`` reads pages
described in JSON); a vision model is any ``ModelProvider``. Both run on the executors.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliospark.config import DEFAULT, Config
from foliospark.operators import geometry
from foliospark.operators.repair import Keep
from foliospark.sources.providers import ERROR_CHARS, ModelProvider, Reply

_BOX = "x0:double,top:double,x1:double,bottom:double"
PAGES = f"doc_id long, page_no int, width double, height double, text string, chars array<struct<ch:string,{_BOX}>>, words array<struct<text:string,{_BOX}>>, images array<struct<{_BOX}>>, error string"
TRANSCRIBE = "Write down all text of this picture, line by line, and nothing else."
_MARGIN = r"(?U)^\s+|\s+$"


class PageProvider(ABC):
    """Opens a file's bytes."""

    @abstractmethod
    def pages(self, content: bytes) -> list[dict]:
        """For each page ``width, height, text``, ``chars`` and ``words`` (text and box) and ``images`` (boxes)."""

    @abstractmethod
    def render(self, content: bytes, page_no: int, box: tuple[float, ...] | None) -> bytes:
        """A picture of a page or of a box on it."""

    def read(self, files: DataFrame) -> DataFrame:
        """``files`` (``doc_id, content``) to their pages. A file that cannot be opened is one row with ``error``."""
        provider, schema = self, to_arrow_schema(T.StructType.fromDDL(PAGES))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for doc_id, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                    try:
                        found = provider.pages(content)
                        rows = [{"doc_id": doc_id, "page_no": n, **p, "error": None} for n, p in enumerate(found)]
                    except Exception as e:  # noqa: BLE001  a file fails for itself alone
                        rows = [{"doc_id": doc_id, "page_no": 0, "error": f"{type(e).__name__}: {e}"[:ERROR_CHARS]}]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

        return files.select("doc_id", "content").mapInArrow(run, PAGES)

    def pictures(self, regions: DataFrame, files: DataFrame) -> DataFrame:
        """``region, image`` of ``regions`` (``region, doc_id, page_no`` and box, null for the whole page)."""
        provider = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    box = None if r["x0"] is None else tuple(r[k] for k in geometry.BOX)
                    yield pa.record_batch([pa.array([r["region"]], pa.int64()), pa.array([provider.render(r["content"], r["page_no"], box)], pa.binary())], names=["region", "image"])

        return regions.join(files.select("doc_id", "content"), "doc_id").select("region", "page_no", *geometry.BOX, "content").mapInArrow(run, "region long, image binary")


@dataclass(frozen=True)
class JsonPages(PageProvider):
    """Pages described in JSON: a list of ``{"width", "height", "text", "chars": [[ch, x0, top, x1, bottom]], "words": [...], "images": [[x0, top, x1, bottom, text]], "seen": text}``."""

    def pages(self, content: bytes) -> list[dict]:
        keys = ("x0", "top", "x1", "bottom")
        out = []
        for p in json.loads(content):
            named = lambda rows, first: [{first: r[0], **dict(zip(keys, map(float, r[1:5]), strict=True))} for r in rows]
            out.append({
                "width": float(p["width"]), "height": float(p["height"]), "text": p.get("text", ""), "chars": named(p.get("chars", []), "ch"), "words": named(p.get("words", []), "text"),
                "images": [dict(zip(keys, map(float, r[:4]), strict=True)) for r in p.get("images", [])],
            })
        return out

    def render(self, content: bytes, page_no: int, box: tuple[float, ...] | None) -> bytes:
        page = json.loads(content)[page_no]
        if box is None:
            return page.get("seen", "").encode()
        inside = [r[4] for r in page.get("images", []) if len(r) > 4 and box[0] <= r[0] and box[1] <= r[1] and r[2] <= box[2] and r[3] <= box[3]]
        return "\n".join(inside).encode()


@dataclass(frozen=True)
class PlumberPages(PageProvider):
    """PDF files by the pdfplumber library, where it is installed."""

    dpi: int = DEFAULT.render_dpi

    def pages(self, content: bytes) -> list[dict]:
        import io

        import pdfplumber

        box = lambda r: {k: float(r[k]) for k in geometry.BOX}
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return [
                {
                    "width": float(p.width), "height": float(p.height), "text": p.extract_text() or "", "chars": [{"ch": c["text"], **box(c)} for c in p.chars],
                    "words": [{"text": w["text"], **box(w)} for w in p.extract_words()], "images": [box(i) for i in p.images],
                }
                for p in pdf.pages
            ]

    def render(self, content: bytes, page_no: int, box: tuple[float, ...] | None) -> bytes:
        import io

        import pdfplumber

        out = io.BytesIO()
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            page = pdf.pages[page_no] if box is None else pdf.pages[page_no].crop(box)
            page.to_image(resolution=self.dpi).original.save(out, "PNG")
        return out.getvalue()


@dataclass(frozen=True)
class ReplayVision(ModelProvider):
    """Takes a picture for its own transcript, as ``JsonPages`` renders it."""

    model: str = "replay-vision"

    def answer(self, prompt: str, image: bytes | None = None) -> Reply:
        return Reply((image or b"").decode(), None, self.model)


def ingest(files: DataFrame, pages: PageProvider, vision: ModelProvider, keep: Keep, config: Config = DEFAULT) -> DataFrame:
    """``files`` (``doc_id, path, content``) as ``doc_id, source_path, source_text, classification, low_confidence, read_error, vision_calls``.

    A text document is its pages' text; of a mixed one the vision model reads the bands
    of rasterised text, which join the body where they stand; of a scanned one it reads whole pages, and the document is of low
    confidence. A file that cannot be opened has ``read_error`` and no text.
    """
    read = keep(pages.read(files))
    fine = read.where("error is null")
    own = fine.select("doc_id", "page_no", "width", "height", "text")
    images = fine.select("doc_id", "page_no", F.inline("images"))
    chars = fine.select("doc_id", "page_no", F.inline("chars"))
    classes = keep(geometry.classify(own, images, chars, config))
    mixed, scanned = (classes.where(F.col("class") == c).select("doc_id") for c in ("mixed", "scanned"))
    bands = geometry.text_bands(own, images, chars, config).join(mixed, "doc_id").select("doc_id", "page_no", *geometry.BOX)
    whole = own.join(scanned, "doc_id").select("doc_id", "page_no", *(F.lit(None).cast("double").alias(k) for k in geometry.BOX))
    regions = keep(bands.unionByName(whole).withColumn("region", F.monotonically_increasing_id()))
    seen = vision.run(pages.pictures(regions, files).select(F.col("region").alias("doc_id"), F.lit(TRANSCRIBE).alias("prompt"), "image"))
    seen = keep(seen.withColumnRenamed("doc_id", "region"))
    text_of = regions.join(seen.select("region", F.regexp_replace(F.coalesce("reply", F.lit("")), _MARGIN, "").alias("band_text"), "error"), "region")
    spliced = geometry.splice(own.join(mixed, "doc_id"), text_of.where("x0 is not null"), chars)
    scans = geometry.join_parts(text_of.where("x0 is null").select("doc_id", "page_no", F.col("band_text").alias("part")), ["page_no"])
    plain = own.join(classes.where(F.col("class") == "text").select("doc_id"), "doc_id").select("doc_id", "page_no", F.regexp_replace(F.coalesce("text", F.lit("")), _MARGIN, "").alias("part"))
    texts = spliced.unionByName(scans).unionByName(geometry.join_parts(plain, ["page_no"]))
    calls = text_of.groupBy("doc_id").agg(F.count("*").alias("vision_calls"), F.max("error").alias("vision_error"))
    broken = read.where("error is not null").groupBy("doc_id").agg(F.first("error").alias("file_error"))
    named = files.select("doc_id", F.col("path").alias("source_path")).join(classes, "doc_id", "left").join(texts, "doc_id", "left").join(calls, "doc_id", "left").join(broken, "doc_id", "left")
    return named.select(
        "doc_id", "source_path", F.col("text").alias("source_text"), F.col("class").alias("classification"), F.coalesce(F.col("class") == "scanned", F.lit(False)).alias("low_confidence"),
        F.coalesce("file_error", "vision_error").alias("read_error"), F.coalesce("vision_calls", F.lit(0)).alias("vision_calls"),
    )
