"""Line dedup by pairwise alignment.

Lines are compared by hash after trimming; blank lines are ignored. From every line
the shortest run of lines that reaches ``min_words`` is taken, forwards and backwards;
such runs cover every block of that many words. Every run names its first holder (the
smallest ``doc_id``), so a run held by a third of all documents costs a row a document
and no pair among the holders, and every repeated block leads to earlier documents
that hold each of its runs. A later document is aligned with each of these first holders by
patience diff over line hashes (anchors: lines that occur once on either side,
longest increasing run of them, then matches grown outwards from the anchors and the
ends), and aligned blocks of at least ``min_words`` words go from the later document.
So do the runs that no alignment in order reaches, because either side repeats
them or has them elsewhere. A line's first holder never loses it. Texts meet their deletions only at the end.

Null and empty texts have no line and stay as they are. Rows that share a ``doc_id``
count as one document, are never held against each other, and lose only what
their own text has of the deleted lines; rows without one are left as they are. An empty table stays empty. A
text's lines are held in memory whole, as hashes. All other columns are kept; a column
``lines_removed`` that is there already is replaced.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm._common import Scratch, checked_side, chunks, doc_text, freed, table

MIN_WORDS = 20
#: Holders of one run, and later documents of one first holder, that are joined in one place; more are dealt over several.
SPREAD = 1000


def line_hashes(text: str) -> tuple[list[int], list[int], list[int]]:
    """Signed hashes, word counts and places of the lines that aren't blank."""
    hashes, words, at = [], [], []
    for i, line in enumerate(text.split("\n")):
        if n := len(line.split()):
            hashes.append(int.from_bytes(xxhash.xxh3_64_digest(line.strip().encode()), "big", signed=True))
            words.append(n)
            at.append(i)
    return hashes, words, at


def runs(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """The shortest runs (first line, line after the last) of ``min_words`` words from each line on and up to each line."""
    found, i, total = [], 0, 0
    for j, w in enumerate(words):
        first = i + (total >= min_words)  # runs from earlier lines have ended
        total += w
        while total - words[i] >= min_words:
            total -= words[i]
            i += 1
        if total >= min_words:
            found += [(k, j + 1) for k in (*range(first, i), i)]
    return found


def run_hashes(hashes: list[int], words: list[int], min_words: int) -> list[int]:
    """Signed hashes of the distinct ``runs`` of a text."""
    raw = array("q", hashes).tobytes()
    return list({int.from_bytes(xxhash.xxh3_64_digest(raw[8 * i : 8 * j]), "big", signed=True) for i, j in runs(words, min_words)})


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned common blocks ``(start in a, start in b, length)`` in order."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            pairs.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            pairs.append((j, m))
        if i == j or k == m:
            continue
        left, right = Counter(a[i:j]), Counter(b[k:m])
        where = {h: p for p, h in enumerate(b[k:m], k) if right[h] == 1}
        anchors = [(p, where[h]) for p, h in enumerate(a[i:j], i) if left[h] == 1 and h in where]
        if not anchors:
            continue
        tails: list[int] = []  # longest increasing run of the places in b
        last: list[int] = []
        back = [-1] * len(anchors)
        for n, (_, q) in enumerate(anchors):
            at = bisect_left(tails, q)
            tails[at : at + 1], last[at : at + 1] = [q], [n]
            back[n] = last[at - 1] if at else -1
        n, chain = last[-1], []
        while n >= 0:
            chain.append(anchors[n])
            n = back[n]
        pi, pk = i, k
        for p, q in reversed(chain):
            todo.append((pi, p, pk, q))
            pairs.append((p, q))
            pi, pk = p + 1, q + 1
        todo.append((pi, j, pk, m))
    blocks: list[tuple[int, int, int]] = []
    for p, q in sorted(pairs):
        if blocks and blocks[-1][0] + blocks[-1][2] == p and blocks[-1][1] + blocks[-1][2] == q:
            blocks[-1] = (blocks[-1][0], blocks[-1][1], blocks[-1][2] + 1)
        else:
            blocks.append((p, q, 1))
    return blocks


def repeats(a: list[int], words: list[int], b: list[int], min_words: int) -> set[int]:
    """Lines of ``a`` (with their word counts) that are in a block of ``min_words`` words that ``b`` holds too, anywhere."""
    gone = {i for p, _, n in patience(a, b) if sum(words[p : p + n]) >= min_words for i in range(p, p + n)}
    if len(gone) == len(a):
        return gone
    mine, theirs = array("q", a).tobytes(), array("q", b).tobytes()
    size, held, start = dict(zip(a, words, strict=True)), set(), 0
    for stop in [*(i for i, h in enumerate(b) if h not in size), len(b)]:  # no common block goes past a foreign line
        held.update(theirs[8 * (start + i) : 8 * (start + j)] for i, j in runs([size[h] for h in b[start:stop]], min_words))
        start = stop + 1
    for i, j in runs(words, min_words):
        if mine[8 * i : 8 * j] in held:
            gone.update(range(i, j))
    return gone


def spread_join(many: DataFrame, few: DataFrame, sizes: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``many`` (with ``doc_id``) joined on ``key`` to ``few``; ``n``, in ``few`` and in the written table ``sizes``, is the key's number of rows in ``many``.

    A key of more than ``SPREAD`` rows, such as a line that a third of all documents hold, is dealt by
    document over as many copies of its row in ``few`` as it takes, so that no task gets all of it.
    """
    copies = F.floor((F.col("n") - 1) / SPREAD).cast("int")
    hot = scratch.write(sizes.where(F.col("n") > SPREAD).select(key, copies.alias("copies")), "hot")
    dealt = many.join(checked_side(hot), key, "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("copies") + 1), F.lit(0)).cast("int"))
    copied = few.withColumn("copy", F.explode(F.sequence(F.lit(0), copies))).drop("n")
    return dealt.drop("copies").join(copied, [key, "copy"]).drop("copy")


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, gone``: hashes of the lines to delete, with their places, for each document that has any."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            cols = list(zip(*((h, w, at, run_hashes(h, w, min_words)) for h, w, at in map(line_hashes, b.column("text").to_pylist())), strict=True))
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "hashes", "words", "at", "runs"])

    scratch = Scratch(docs.sparkSession, "line-dedup")
    lines = scratch.write(doc_text(docs).where("doc_id is not null").mapInArrow(freed(split), "doc_id long, hashes array<long>, words array<int>, at array<int>, runs array<long>"), "lines")
    each = lines.select("doc_id", F.explode("runs").alias("h"))
    first = each.groupBy("h").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    first = scratch.write(first.where("owner < last").select("h", "owner", "n"), "first")
    found = spread_join(each, first, first, "h", scratch)
    pairs = scratch.write(found.where("owner < doc_id").select("doc_id", "owner").distinct(), "pairs")
    scratch.drop(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, a, words, at, theirs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "hashes", "words", "at", "theirs")), strict=True):
                out += [(doc_id, at[i], a[i]) for i in repeats(a, words, theirs, min_words)]
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "at", "h"])

    followers = scratch.write(pairs.groupBy("owner").agg(F.count("*").alias("n")), "followers")
    owners = lines.select(F.col("doc_id").alias("owner"), F.col("hashes").alias("theirs")).join(followers, "owner")
    aligned = spread_join(pairs, owners, followers, "owner", scratch).join(lines.drop("runs"), "doc_id").select("doc_id", "hashes", "words", "at", "theirs").mapInArrow(freed(run), "doc_id long, at int, h long")
    return scratch.write(aligned.groupBy("doc_id").agg(F.collect_set(F.struct("at", "h")).alias("gone")), "gone")


def scratch_name() -> str:
    """A column suffix that clashes with nothing."""
    return uuid.uuid4().hex


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs``, the text without its repeated blocks, and ``lines_removed``."""
    gone, names = find_repeats(docs, min_words), [c for c in docs.columns if c != "lines_removed"]
    rows = docs.select(*names)
    key, marks_of = f"_id_{scratch_name()}", f"_gone_{scratch_name()}"
    gone = checked_side(gone.select(F.col("doc_id").alias(key), F.col("gone").alias(marks_of)), f"size({marks_of})")
    marked = rows.withColumn(key, F.col("doc_id").cast("long")).join(gone, key, "left").drop(key)
    place = names.index("text")
    schema = T.StructType([*rows.schema.fields, T.StructField("lines_removed", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            texts, removed = b.column("text").to_pylist(), [0] * b.num_rows
            for i, marks in enumerate(b.column(marks_of).to_pylist()):
                if marks and texts[i]:
                    lines, mine = texts[i].split("\n"), dict(zip(*line_hashes(texts[i])[::-2], strict=True))
                    drop = {m["at"] for m in marks if mine.get(m["at"]) == m["h"]}
                    removed[i] = len(drop)
                    texts[i] = "\n".join(x for n, x in enumerate(lines) if n not in drop)
            cols = [b.column(c) for c in names]
            cols[place] = pa.array(texts, b.column("text").type)
            yield pa.record_batch([*cols, pa.array(removed, pa.int32())], names=[*names, "lines_removed"])

    return marked.mapInArrow(freed(run), schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "lines_removed", F.octet_length("text").cast("long").alias("n_bytes"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE: dict[str, str] = {}
