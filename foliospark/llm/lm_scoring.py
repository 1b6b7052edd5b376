"""Cross-entropy difference: loss under a target model minus loss under a background model, per token.

Both models are interpolated modified Kneser-Ney models of word bigrams over one
shared vocabulary: words (A-Z lower-cased, split at ASCII white space, told apart by 64-bit hashes), the most
frequent exactly and no two as one. Words too rare for the ``MOST_WORDS`` places, with all of equal frequency, are one
unknown word, and one more word that never occurs has a share, in
both models alike. The target is trained on the given documents, the background on every
document, and each document is scored by both without its own counts (leave one
out), so a document that nothing else resembles cannot look familiar and no
target document vouches for itself. Discounts are those of the whole models.
A low score means text more like the target; a low background loss means wording that the corpus repeats.

Steps: (0) words are counted, by block and then by word; the places go to the most frequent. (1) One pass over the texts writes blocks: a bounded number of tokens with the
block's distinct bigrams and a sparse document-by-bigram matrix. (2) Every block
sends each of its bigrams once, already counted, to the partition that its hash names;
partitions add up and answer each block with the counts of both models, so a bigram that stands in every
document is one entry a block and no key's rows meet in a task. (3) What the models
need of single words (totals, numbers of continuations) is an array over the
vocabulary, whose size is fixed, summed by ranges of it and broadcast. (4) Blocks and answers
are joined and documents scored.

Null and empty texts consist of the end token alone. Without target documents target losses and
scores are null. Rows that share a ``doc_id`` are documents of their own, in the target if
their id is listed, and repeated rows know each other's counts. An empty table gives no row. Memory
grows with the block and the longest text. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm._common import Scratch, byte_list, checked_side, chunks, doc_text, shuffle_partitions, table
from foliospark.llm.quality_lm import trusted_ids
from foliospark.llm.shingle_join import word_hashes
from foliospark.llm.token_counts import pack_ints, unpack_ints

BITS = 18
VOCABULARY, UNKNOWN, BEGIN, END = 1 << BITS, 1, 2, 3
#: Words with a number of their own.
MOST_WORDS = VOCABULARY - 4
MASK = VOCABULARY - 1
BLOCK_TOKENS = 400_000
#: Bigrams of blocks that one partition adds up, at most about.
PART_KEYS = 2_000_000
#: Words of the vocabulary whose statistics are summed in one task.
RANGE = 4096
#: What the models keep of a word: continuations, total as a context, and bigrams seen once, twice and more in it, for both models.
FACTS = tuple(f"{fact}_{model}" for model in ("all", "target") for fact in ("continuations", "total", "once", "twice", "more"))
_BLOCKS = "block long, ids array<long>, target array<boolean>, n array<int>, lengths array<int>, index binary, freq binary, keys binary, n_keys long"


def pack_longs(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_longs(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack_longs(np.diff(values, prepend=0))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_longs(blob))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a bounded number of tokens, counted."""
    held: list[np.ndarray] = []
    for b in chain(chunks(batches, 1 << 20), [None]):
        if b is not None:
            held.append(word_hashes(byte_list(b.column("text")))[0])
        if held and (b is None or sum(map(len, held)) > BLOCK_TOKENS):
            word, n = np.unique(np.concatenate(held), return_counts=True)
            held = []
            yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame, scratch: Scratch) -> np.ndarray:
    """Sorted hashes of the most frequent words, ``MOST_WORDS`` at most; of words of equal frequency all are in or none."""
    counts = scratch.write(doc_text(docs).select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    least, places = 0, MOST_WORDS
    for n, words in counts.groupBy("n").count().orderBy(F.desc("n")).limit(MOST_WORDS + 1).toArrow().select(["n", "count"]).to_pandas().itertuples(index=False):
        if words > places:
            least = n + 1
            break
        places -= words
    found = counts.where(F.col("n") >= least).select("word").toArrow().column("word")  # MOST_WORDS numbers at most
    scratch.drop(counts)
    return np.sort(found.to_numpy().view(np.uint64))


def bigrams(texts: list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Packed bigrams of all texts one after another, and how many each text has: one for each word and the end. ``known``: sorted hashes of the words with numbers, or else all of these texts."""
    hashes, counts = word_hashes(texts)
    known = np.unique(hashes) if known is None else known
    place = np.searchsorted(known, hashes)
    numbers = np.where(np.append(known, np.uint64(0))[place] == hashes, place + 4, UNKNOWN) if len(known) else np.full(len(hashes), UNKNOWN)
    numbers[place == len(known)] = UNKNOWN
    tokens = np.insert(numbers.astype(np.int64), np.cumsum(counts), END)
    lengths = counts + 1
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = BEGIN
    return before << BITS | tokens, lengths


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return ((mixed * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _by_doc(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)


def _make_blocks(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, seq, held, ids, target, n, entries, counts = TaskContext.get().partitionId(), 0, 0, [], [], [], [], []
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.list_(pa.int32())] * 2, *[pa.binary()] * 3, pa.int64()]
    for b in chain(chunks(batches, 1 << 20), [None]):
        if b is not None:
            keys, lengths = bigrams(byte_list(b.column("text")), known)
            each, times = np.unique((_by_doc(lengths) + len(n)) << 2 * BITS | keys, return_counts=True)
            entries.append(each)
            counts.append(times)
            ids += b.column("doc_id").to_pylist()
            target += b.column("target").to_pylist()
            n += lengths.tolist()
            held += len(keys)
        if n and (b is None or held > BLOCK_TOKENS):
            every = np.concatenate(entries)
            keys, index = np.unique(every & ((1 << 2 * BITS) - 1), return_inverse=True)
            lengths = np.bincount(every >> 2 * BITS, minlength=len(n))
            steps = np.diff(index, prepend=0)  # a document's bigrams are in order
            first = np.cumsum(lengths) - lengths
            steps[first] = index[first]
            row = [task << 32 | seq, ids, target, n, lengths, pack_ints(steps), pack_ints(np.concatenate(counts)), pack_sorted(keys), len(keys)]
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[f.split(" ")[0] for f in _BLOCKS.split(", ")])
            seq, held, ids, target, n, entries, counts = seq + 1, 0, [], [], [], [], []


class Block:
    """A block's row as arrays: bigrams ``keys``, and entries (``doc``, ``index`` of the bigram, ``freq``) in order of document and bigram."""

    def __init__(self, row: dict):
        self.keys = unpack_sorted(row["keys"].as_py())
        self.lengths = row["lengths"].values.to_numpy().astype(np.int64)
        self.target = row["target"].values.to_numpy(zero_copy_only=False).astype(bool)
        self.doc, self.freq = _by_doc(self.lengths), unpack_ints(row["freq"].as_py()).astype(np.int64)
        steps = np.cumsum(unpack_ints(row["index"].as_py()).astype(np.int64))
        first = np.cumsum(self.lengths) - self.lengths
        before = np.concatenate(([0], steps))[first]
        self.index = steps - np.repeat(before, self.lengths)

    def count(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.freq * weight, len(self.keys)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i] for c in b.schema.names}


def _facts(keys: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
    """The FACTS of every word of the vocabulary over these bigrams."""
    before, word, out = keys >> BITS, keys & MASK, []
    for c in counts:
        for at, weight in ((word, c > 0), (before, c), (before, c == 1), (before, c == 2), (before, c > 2)):
            out.append(np.bincount(at, weight, VOCABULARY).astype(np.int64))
    return np.stack(out)


def _exchange(blocks: DataFrame, parts: int) -> DataFrame:
    """``block, part, everything, chosen``: for each block and part the counts of its bigrams in all documents and in the target; for blocks below 0 sums of facts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        for row in _rows(batches):
            b = Block(row)
            counts = [b.count(np.ones(len(b.doc))), b.count(b.target[b.doc])]
            where = part_of(b.keys, parts)
            order = np.argsort(where, kind="stable")
            keys, counts = b.keys[order], [c[order] for c in counts]
            cuts = np.searchsorted(where[order], np.arange(parts + 1))
            used = np.flatnonzero(np.diff(cuts)).tolist()
            for at in range(0, len(used), 64):
                some = [(p, slice(cuts[p], cuts[p + 1])) for p in used[at : at + 64]]
                cols = [[row["block"].as_py()] * len(some), [p for p, _ in some], [pack_sorted(keys[s]) for _, s in some], *([pack_ints(c[s]) for _, s in some] for c in counts)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["block", "part", "keys", "everything", "chosen"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["block", "part", "everything", "chosen"], (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        sent = [(r["block"].as_py(), unpack_sorted(r["keys"].as_py()), r["part"].as_py(), unpack_ints(r["everything"].as_py()), unpack_ints(r["chosen"].as_py())) for r in _rows(batches)]
        if not sent:
            return
        keys, inverse = np.unique(np.concatenate([s[1] for s in sent]), return_inverse=True)
        counts = [np.bincount(inverse, np.concatenate([s[i] for s in sent]), len(keys)).astype(np.int64) for i in (3, 4)]
        at = 0
        for block, mine, part, _, _ in sent:
            places = inverse[at : at + len(mine)]
            at += len(mine)
            row = [block, part, *(pack_ints(c[places]) for c in counts)]
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)
        facts = _facts(keys, counts)
        seen = np.array([[(c == i).sum() for i in (1, 2, 3, 4)] for c in counts])
        for r in range(VOCABULARY // RANGE):
            some = facts[:, r * RANGE : (r + 1) * RANGE]
            if some.any():
                row = [-1 - r, sent[0][2], pack_longs(some.ravel()), b""]
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)
        row = [-1 - VOCABULARY // RANGE, sent[0][2], pack_longs(seen.ravel()), b""]
        yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

    sent = blocks.drop("ids").mapInArrow(send, "block long, part int, keys binary, everything binary, chosen binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(add_up, "block long, part int, everything binary, chosen binary")


def discounts(seen: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more, from the numbers of things seen once to four times; plain absolute discounting where those are degenerate."""
    if not all(seen):
        return np.array([0, 0.5, 0.5, 0.5])
    n1, n2, n3, n4 = seen
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *(min(max(d, 0.05), j - 0.05) for j, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))])


class Model:
    """One model's statistics of single words; scores documents without their own counts."""

    def __init__(self, facts: dict[str, np.ndarray], name: str, seen: list[int], words: int):
        self.continuations, self.total = facts[f"continuations_{name}"], facts[f"total_{name}"]
        self.cut2 = discounts(seen)
        self.cut1 = discounts([int((self.continuations == i).sum()) for i in (1, 2, 3, 4)])
        self.mass = sum(self.cut2[i] * facts[f"{fact}_{name}"] for i, fact in ((1, "once"), (2, "twice"), (3, "more")))
        self.all1, self.mass1, self.words = int(self.continuations.sum()), float(self.cut1[np.minimum(self.continuations, 3)].sum()), words

    def losses(self, b: Block, counts: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Loss of each document of a block; ``counts``: of the block's bigrams in the model, ``mine``: whether a document is in it."""
        n, key = len(b.lengths), b.keys[b.index]
        before, word = key >> BITS, key & MASK
        count, own = counts[b.index], b.freq * mine[b.doc]
        rest = count - own
        cut = lambda c: self.cut2[np.minimum(c, 3)]
        head = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (b.doc[1:] != b.doc[:-1]))))
        spread = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(key))))
        total = (self.total[before[head]] - np.add.reduceat(own, head))[spread]
        mass = (self.mass[before[head]] - np.add.reduceat(cut(count) - cut(rest), head))[spread]
        gone = ((rest == 0) & (own > 0)).astype(np.int64)  # bigrams that no other document has
        pairs, place = np.unique(b.doc << BITS | word, return_inverse=True)
        had = self.continuations[pairs & MASK]
        has = had - np.bincount(place, gone, len(pairs)).astype(np.int64)
        cut1 = lambda c: self.cut1[np.minimum(c, 3)]
        all1 = (self.all1 - np.bincount(b.doc, gone, n))[pairs >> BITS]
        mass1 = (self.mass1 - np.bincount(pairs >> BITS, cut1(had) - cut1(has), n))[pairs >> BITS]
        p1 = np.where(all1 > 0, (has - cut1(has) + np.maximum(mass1, 0) / self.words) / np.maximum(all1, 1), 1 / self.words)[place]
        p1 = np.maximum(p1, 1e-12)
        p2 = np.where(total > 0, (rest - cut(rest) + np.maximum(mass, 1e-9) * p1) / np.maximum(total, 1), p1)
        return np.bincount(b.doc, -b.freq * np.log(p2), n)


def _models(told: DataFrame) -> tuple[Model, Model, bool]:
    """The background and the target model, and whether there is a target; gathers arrays over the vocabulary, whose size is fixed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            total = sum(unpack_longs(x) for x in row["sums"].as_py())
            yield pa.record_batch([pa.array([row["block"].as_py()], pa.int64()), pa.array([pack_longs(total)], pa.binary())], names=["block", "sums"])

    ranges = told.where("block < 0").groupBy("block").agg(F.collect_list("everything").alias("sums")).mapInArrow(add, "block long, sums binary")
    facts, seen = np.zeros((len(FACTS), VOCABULARY), np.int64), np.zeros((2, 4), np.int64)
    for r in ranges.collect():  # VOCABULARY / RANGE + 1 rows
        at = (-1 - r.block) * RANGE
        if at < VOCABULARY:
            facts[:, at : at + RANGE] = unpack_longs(r.sums).reshape(len(FACTS), RANGE)
        else:
            seen = unpack_longs(r.sums).reshape(2, 4)
    named, words = dict(zip(FACTS, facts, strict=True)), int((facts[0] > 0).sum()) + 1
    return Model(named, "all", seen[0].tolist(), words), Model(named, "target", seen[1].tolist(), words), bool(named["total_target"].any())


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` (losses in nats a token) for each row; ``target`` lists ``doc_id``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-scoring")
    listed = scratch.write(target.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("target")).distinct(), "target")
    marked = doc_text(docs).join(checked_side(listed), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    known = spark.sparkContext.broadcast(frequent_words(docs, scratch))  # a fixed size
    blocks = scratch.write(marked.mapInArrow(lambda batches: _make_blocks(batches, known.value), _BLOCKS), "blocks")
    parts = max(shuffle_partitions(spark), int(blocks.agg(F.coalesce(F.sum("n_keys"), F.lit(0)).alias("n")).first().n) // PART_KEYS + 1)
    told = scratch.write(_exchange(blocks, parts), "counts")
    background, aim, some = _models(told)
    sent = spark.sparkContext.broadcast((background, aim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        background, aim = sent.value
        for row in _rows(batches):
            b = Block(row)
            order = np.argsort(part_of(b.keys, parts), kind="stable")
            answers = sorted((a["part"], a["everything"], a["chosen"]) for a in row["answers"].as_py())
            everything, chosen = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            for out, i in ((everything, 1), (chosen, 2)):
                out[order] = np.concatenate([unpack_ints(a[i]) for a in answers])
            n = row["n"].values.to_numpy()
            lost = background.losses(b, everything, np.ones(len(n), bool)) / n
            aimed = aim.losses(b, chosen, b.target) / n if some else np.full(len(n), np.nan)
            cols = [row["ids"].values, pa.array(n, pa.int64()), pa.array(aimed, from_pandas=True), pa.array(lost)]
            yield pa.record_batch(cols, names=["doc_id", "n_tokens", "target_loss", "background_loss"])

    answers = told.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "everything", "chosen")).alias("answers"))
    scored = blocks.join(answers, "block").mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
ORACLE: dict[str, str] = {}
