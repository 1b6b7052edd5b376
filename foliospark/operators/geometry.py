"""Page geometry: which image regions hold text, how a document is to be read, and how recognised bands join the body text."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.config import DEFAULT, Config

#: Pairs of boxes and characters on a page, up to which it is not worth an index.
FEW_PAIRS = 4096
BOX = ("x0", "top", "x1", "bottom")


def area(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), bottom - top)


def touch(a: tuple[float, ...], b: tuple[float, ...], pad: float = 2.0) -> bool:
    """Whether two boxes overlap or come within ``pad`` of each other."""
    return a[0] <= b[2] + pad and b[0] <= a[2] + pad and a[1] <= b[3] + pad and b[1] <= a[3] + pad


def _sweep(boxes: list[tuple[float, ...]], pad: float) -> list[tuple[float, ...]]:
    """One pass from left to right: every box joins the boxes that it touches among those not yet passed.

    Boxes that are open at one place of the sweep and do not touch lie apart from top to bottom, so they form
    a sorted list, and those that a new box meets are neighbours in it.
    """
    done: list[tuple[float, ...]] = []
    tops: list[float] = []
    ends: list[float] = []
    open_: list[tuple[float, ...]] = []
    for box in sorted(boxes):
        while True:
            lo, hi = bisect_left(ends, box[1] - pad), bisect_right(tops, box[3] + pad)
            # the two bounds are subtracted and added in turn, so each neighbour is asked once more by the rule itself
            lo, hi = max(0, lo - 1), min(len(open_), hi + 1)
            met = [o for o in open_[lo:hi] if touch(box, o, pad)]
            if not met:
                break
            kept = [o for o in open_[lo:hi] if not touch(box, o, pad)]
            open_[lo:hi], tops[lo:hi], ends[lo:hi] = kept, [o[1] for o in kept], [o[3] for o in kept]
            box = (min(box[0], *(o[0] for o in met)), min(box[1], *(o[1] for o in met)), max(box[2], *(o[2] for o in met)), max(box[3], *(o[3] for o in met)))
        # what overlaps from top to bottom without touching has been passed
        lo, hi = bisect_left(ends, box[1] - pad), bisect_right(tops, box[3] + pad)
        lo, hi = min(lo, hi), max(lo, hi)
        done += open_[lo:hi]
        open_[lo:hi], tops[lo:hi], ends[lo:hi] = [box], [box[1]], [box[3]]
    return done + open_


def merge_boxes(boxes: list[tuple[float, ...]], pad: float = 2.0) -> list[tuple[float, ...]]:
    """Join touching boxes into their bounding boxes until none touch.

    A bounding box can touch what none of its members did. Whatever the order of
    joining, the outcome is the least family of boxes that contains the input and in
    which no two touch, so sweeps are repeated over what the last one left until one changes nothing.
    """
    while True:
        fewer = _sweep(boxes, pad)
        if len(fewer) == len(boxes):
            return sorted(fewer, key=lambda b: (b[1], b[0], b[2], b[3]))
        boxes = fewer


def merge_regions(boxes: DataFrame, pad: float = 2.0) -> DataFrame:
    """``doc_id, page_no, x0, top, x1, bottom`` of the merged boxes of each page; a page is one row for the worker, which sweeps it in a time little over its number of boxes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, page_no, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "page_no", "boxes")), strict=True):
                rows += [(doc_id, page_no, *box) for box in merge_boxes([tuple(x[k] for k in BOX) for x in found], pad)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), *[pa.float64()] * 4)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "page_no", *BOX])

    pages = boxes.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct(*BOX))).alias("boxes"))
    return pages.mapInArrow(run, "doc_id long, page_no int, x0 double, top double, x1 double, bottom double")


class Dominance:
    """Counts points below and left of a corner: per level of a binary division of the points by x, their y in sorted blocks."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.argsort(x, kind="stable")
        self.x, self.levels, y = x[order], [], np.sort(y)[:0] if len(y) == 0 else y[order]
        self.ys, rank = np.unique(y, return_inverse=True)
        self.wide, block = len(self.ys) + 1, 1
        while block <= len(y):
            self.levels.append((block, np.sort(np.arange(len(y)) // block * self.wide + rank)))
            block *= 2

    def below(self, x: np.ndarray, y: np.ndarray, x_side: str = "left", y_side: str = "left") -> np.ndarray:
        """Points with coordinates smaller than the corners' (with side ``right`` also equal ones)."""
        upto, limit = np.searchsorted(self.x, x, x_side), np.searchsorted(self.ys, y, y_side)
        out, start = np.zeros(len(upto), np.int64), np.zeros(len(upto), np.int64)
        for block, keys in reversed(self.levels):
            has = upto & block > 0
            at = start[has] // block * self.wide
            out[has] += np.searchsorted(keys, at + limit[has]) - np.searchsorted(keys, at)
            start[has] += block
        return out


def inside_counts(boxes: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """How many rectangles of ``chars`` lie wholly inside each of ``boxes``, edges included (rows of x0, top, x1, bottom).

    A rectangle is outside if it begins before or ends after the box on an axis. Of one no larger than the box only one of the two can
    hold on each axis, so the number of those outside is a sum of counts of one and of two conditions. Boxes
    that are smaller than some rectangle of the page are counted directly.
    """
    n = len(chars)
    if not n:
        return np.zeros(len(boxes), np.int64)
    x0, top, x1, bottom = chars.T
    large = ((boxes[:, 2] - boxes[:, 0]) >= (x1 - x0).max()) & ((boxes[:, 3] - boxes[:, 1]) >= (bottom - top).max()) & ((x1 - x0).min() >= 0) & ((bottom - top).min() >= 0)
    out = np.zeros(len(boxes), np.int64)
    if large.any():
        b = boxes[large]
        before = {0: np.searchsorted(np.sort(x0), b[:, 0]), 1: np.searchsorted(np.sort(top), b[:, 1])}
        after = {0: n - np.searchsorted(np.sort(x1), b[:, 2], "right"), 1: n - np.searchsorted(np.sort(bottom), b[:, 3], "right")}
        both = Dominance(x0, top).below(b[:, 0], b[:, 1]) + Dominance(x0, -bottom).below(b[:, 0], -b[:, 3]) + Dominance(-x1, top).below(-b[:, 2], b[:, 1]) + Dominance(-x1, -bottom).below(-b[:, 2], -b[:, 3])
        out[large] = n - before[0] - before[1] - after[0] - after[1] + both
    for i in np.flatnonzero(~large):
        out[i] = ((x0 >= boxes[i, 0]) & (top >= boxes[i, 1]) & (x1 <= boxes[i, 2]) & (bottom <= boxes[i, 3])).sum()
    return out


def count_chars(boxes: DataFrame, chars: DataFrame, pad: float = 1.5) -> DataFrame:
    """``boxes`` with ``n_chars``: characters that lie inside the padded box, edges included. A page's boxes and characters are one row each; no box meets a character as a row.

    Boxes with a null edge hold none, characters with one are in none; equal boxes are one row.
    """
    key = ["doc_id", "page_no"]
    own = boxes.groupBy(*key).agg(F.collect_set(F.struct(*boxes.columns)).alias("_rows"))
    whole = chars.where(" and ".join(f"{k} is not null" for k in BOX)).groupBy(*key).agg(F.collect_list(F.struct(*(F.col(k).cast("double").alias(k) for k in BOX))).alias("_chars"))

    def edges(col: pa.Array) -> np.ndarray:
        return np.column_stack([col.field(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in BOX])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("_rows").flatten()
            box, held = edges(rows) + np.array([-pad, -pad, pad, pad]), edges(b.column("_chars").flatten())
            n_box, n_char = (pc.fill_null(pc.list_value_length(b.column(c)), 0).to_numpy().astype(np.int64) for c in ("_rows", "_chars"))
            at_box, at_char, out = np.cumsum(n_box) - n_box, np.cumsum(n_char) - n_char, np.zeros(len(box), np.int64)
            page = np.repeat(np.arange(len(n_box)), n_box)
            few = np.flatnonzero((n_box * n_char)[page] <= FEW_PAIRS)  # boxes of small pages are held against their page's characters, many pages at a time
            reach = np.cumsum(n_char[page[few]])
            for some in np.split(few, np.searchsorted(reach, np.arange(1 << 20, reach[-1], 1 << 20)) if len(few) else []):
                n = n_char[page[some]]
                own, char = np.repeat(some, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - at_char[page[some]], n)
                fits = (held[char, :2] >= box[own, :2]).all(axis=1) & (held[char, 2:] <= box[own, 2:]).all(axis=1)
                out += np.bincount(own[fits], minlength=len(out))
            for p in np.flatnonzero(n_box * n_char > FEW_PAIRS):
                a, c = slice(at_box[p], at_box[p] + n_box[p]), slice(at_char[p], at_char[p] + n_char[p])
                known = ~np.isnan(box[a]).any(axis=1)
                out[a][known] = inside_counts(box[a][known], held[c])
            yield pa.record_batch([*rows.flatten(), pa.array(out)], names=[*(f.name for f in rows.type), "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema)
    return own.join(whole, key, "left").select("_rows", "_chars").mapInArrow(run, f"{kinds}, n_chars long")


def text_bands(pages: DataFrame, images: DataFrame, chars: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Merged image regions that look like rasterised text: neither the whole page nor a small logo, and without text on them."""
    size = pages.where("width * height > 0").select("doc_id", "page_no", "width", "height")
    share = area(*(F.col(k) for k in BOX)) / (F.col("width") * F.col("height"))
    kept = images.join(size, ["doc_id", "page_no"]).where(share <= config.region_max_area)
    merged = merge_regions(kept).join(size, ["doc_id", "page_no"])
    wide = (F.col("x1") - F.col("x0")) / F.col("width")
    bands = merged.where((share <= config.region_max_area) & ((share >= config.region_min_area) | (wide >= config.region_min_width))).select("doc_id", "page_no", *BOX)
    return count_chars(bands, chars).where(F.col("n_chars") <= config.max_chars_over_region).drop("n_chars")


def classify(pages: DataFrame, images: DataFrame, chars: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``doc_id, class``: scanned if there is hardly any text; else the first page that decides: a full-page image under text (scanned) or a band (mixed); else text."""
    per_page = chars.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))
    totals = per_page.groupBy("doc_id").agg(F.sum("n").alias("total"))
    share = area(*(F.col(k) for k in BOX)) / (F.col("width") * F.col("height"))
    full = images.join(pages.where("width * height > 0").select("doc_id", "page_no", "width", "height"), ["doc_id", "page_no"]).where(share >= config.full_page_image)
    scans = full.select("doc_id", "page_no").distinct().join(per_page, ["doc_id", "page_no"], "left_semi").withColumn("verdict", F.lit("scanned"))
    mixed = text_bands(pages, images, chars, config).select("doc_id", "page_no").distinct().withColumn("verdict", F.lit("mixed"))
    rank = F.struct("page_no", F.when(F.col("verdict") == "scanned", 0).otherwise(1).alias("rank"))
    first = scans.unionByName(mixed).groupBy("doc_id").agg(F.min_by("verdict", rank).alias("verdict"))
    named = pages.select("doc_id").distinct().join(totals, "doc_id", "left").join(first, "doc_id", "left")
    few = F.coalesce(F.col("total"), F.lit(0)) < config.scanned_char_threshold
    return named.select("doc_id", F.when(few, F.lit("scanned")).otherwise(F.coalesce("verdict", F.lit("text"))).alias("class"))


def splice(pages: DataFrame, bands: DataFrame, chars: DataFrame) -> DataFrame:
    """``doc_id, text``: each page's body text with its recognised bands (``band_text``) above, on or below it, pages in order.

    Pages without any text are left out; a band over the body follows it under a marker.
    """
    body = chars.groupBy("doc_id", "page_no").agg(F.min("top").alias("body_top"), F.max("bottom").alias("body_bottom"))
    slot = F.when(F.col("body_top").isNull() | (F.col("bottom") <= F.col("body_top")), 0).when(F.col("top") >= F.col("body_bottom"), 3).otherwise(2)
    marked = F.when(slot == 2, F.concat(F.lit("[over the text]\n"), F.col("band_text"))).otherwise(F.col("band_text"))
    parts = bands.where("band_text <> ''").join(body, ["doc_id", "page_no"], "left").select("doc_id", "page_no", slot.alias("slot"), "top", "x0", marked.alias("part"))
    own = pages.select("doc_id", "page_no", F.lit(1).alias("slot"), F.lit(0.0).alias("top"), F.lit(0.0).alias("x0"), F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "").alias("part")).where("part <> ''")
    return join_parts(parts.unionByName(own), ["page_no", "slot", "top", "x0"])


def join_parts(parts: DataFrame, order: list[str], separator: str = "\n") -> DataFrame:
    """``doc_id, text``: the parts of each document in order, empty ones dropped."""
    kept = parts.where("part <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, "part"))).alias("parts"))
    return kept.select("doc_id", F.array_join(F.transform("parts", lambda p: p["part"]), separator).alias("text"))


