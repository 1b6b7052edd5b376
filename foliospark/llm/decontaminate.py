"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel edit distance.

An item of ``m`` characters may differ from a passage by ``k = rate * m`` edits. Cut into
``k + 1`` pieces, one piece at least survives unchanged, so an Aho-Corasick pass for all
pieces finds every passage within the budget; the text around a hit is then verified
with Myers' algorithm, whose bit vectors are whole integers. Items and texts are
lower-cased and their white space is folded to single blanks first.

The items are a stated query set: they are sent out in blocks of bounded size, each
of which is held against all documents in one scan without a shuffle.

Null or blank items and texts match nothing. Repeated rows of documents are reported
once each; items of equal text each count. Without documents or without items there is no row. A text is searched
whole, in memory that grows with its length; the number of scans grows with the items, one for each block of them.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm._common import chunks, doc_text, freed, table

RATE = 0.08
#: Characters of benchmark text that one scan takes along.
BLOCK_CHARS = 4_000_000


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` nearly equal pieces with their offsets."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def peq(item: str) -> dict[str, int]:
    """For each character the bit mask of its places in the item."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance between the item and any substring, and the first end at which it is reached."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, at = full, 0, m, m, 0
    get = masks.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, i
        ph = (ph << 1) & full
        plus = ((mh << 1) & full) | (full & ~(xv | ph))
        minus = ph & xv
    return best, at


class Matcher:
    """All items of a block, ready to be looked for in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, int(rate * len(t)), peq(t)) for i, t in ((i, normalise(t)) for i, t in items) if t]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k, _) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                found.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, distance, budget, end)`` of each item that the text contains within its budget."""
        if not self.items:
            return []
        text = normalise(text)
        spans: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                start, k = end + 1 - size - offset, self.items[n][2]
                a, b = start - k, start + len(self.items[n][1]) + k
                mine = spans.setdefault(n, [])
                if mine and a <= mine[-1][1] and a >= mine[-1][0]:
                    mine[-1][1] = max(mine[-1][1], b)
                else:
                    mine.append([a, b])
        out = []
        for n, windows in spans.items():
            item_id, item, k, masks = self.items[n]
            best = min(((d, max(a, 0) + at) for a, b in windows for d, at in [myers(masks, len(item), text[max(a, 0) : b])]), default=(k + 1, 0))
            if best[0] <= k:
                out.append((item_id, best[0], k, best[1]))
        return out


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; one block is on the driver at a time."""
    block, held = [], 0
    for r in items.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        block.append((int(r.item_id), r.text))
        held += len(r.text)
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, budget, stop`` for each document and each item it contains; stop counts characters of the normalised text."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, distance int, budget int, stop long"
    out = None
    for block in item_blocks(items, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for b in chunks(batches):
                rows = [(i, *hit) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for hit in matcher.find(t)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "distance", "budget", "stop"])

        part = doc_text(docs).mapInArrow(freed(run), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean_documents(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns, that contain no item."""
    spark, names = docs.sparkSession, docs.columns
    out = docs
    for block in item_blocks(items, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for b in chunks(batches):
                yield b.filter(pa.array([not (t and matcher.find(t)) for t in b.column("text").to_pylist()], pa.bool_()))

        out = out.mapInArrow(freed(run), docs.schema)
    return out.select(*names)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("stop")


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE: dict[str, str] = {}
