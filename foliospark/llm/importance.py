"""Target-distribution importance resampling over hashed word n-grams.

Words are runs of ASCII letters and digits (A-Z lower-cased) and characters from U+0080 on;
features are all runs of one to three consecutive words. The gain of a feature's bucket tells how much more
often the target texts hold it than the documents do; a document's weight is the sum of its gains, and Gumbel noise from its
id turns the highest scores into a sample drawn without replacement in proportion to exp(weight / 1000).

Steps: (1) One pass cuts the texts into blocks of a bounded size. A block maps its distinct words to whole
numbers, represents two- and three-word runs as tuples of them, reconstructs the bytes of each distinct
tuple once to hash it, and joins the buckets back to the documents. It is written as sparse (document, bucket, count) rows, packed,
with the block's counts by bucket. (2) The counts are summed: ``BUCKETS`` rows, whatever the input. (3) The gains, an
array of that fixed size, go to all tasks, which weigh the blocks; texts are read once. (4) Scores are sorted by
range, so the drawn documents get their ranks from the sizes of the ranges; no task sees them all.

Tuples are distinct within a block: most three-word runs of a corpus stand in one document only, so telling them apart over
all blocks would shuffle more than the texts themselves.

Null and empty texts have no feature and weight 0. Rows without ``doc_id`` have a weight, but no score, as
nothing names their noise, and are neither drawn nor counted among the documents that may be; repeated rows count, are scored and
can be drawn each, next to one another. Without target texts every gain comes from the documents alone. An empty table gives no row.
Columns other than ``doc_id`` and ``text`` are not read. Memory grows with a block and the longest text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm._common import Scratch, bound_batches, byte_list, checked_side, chunks, shuffle_partitions, table, trim
from foliospark.llm.token_counts import pack_ints, unpack_ints

BUCKETS = 10_000
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
#: Documents drawn, of every hundred.
PERCENT = 5
SEED = 42
BLOCK_BYTES = 8 << 20
#: Letters lower-cased, digits and higher bytes as they are, other ASCII a space.
_FOLD = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_BLOCKS = "ids array<long>, words array<long>, lengths array<int>, buckets binary, freqs binary, counts array<long>"


def _tuples(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers below 2^32 as two arrays, and the place of each given pair among them."""
    distinct, back = np.unique(first << 32 | second, return_inverse=True)
    return distinct >> 32, distinct & 0xFFFFFFFF, back


def _hashed(*parts: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Buckets of tuples of word numbers, from their reconstructed bytes."""
    spelled = map(b" ".join, zip(*(map(words.__getitem__, p.tolist()) for p in parts), strict=True))
    return np.fromiter(map(crc32, spelled), np.uint32, len(parts[0])).astype(np.int64) % BUCKETS


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the document and bucket of every feature, documents in order."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    rows = [np.fromiter(map(number.__getitem__, t.translate(_FOLD).split()), np.int64) for t in texts]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    word, doc = np.concatenate([*rows, np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), sizes)
    words = list(number)
    made = [(doc, _hashed(np.arange(len(words)), words=words)[word])]
    two = np.flatnonzero(doc[1:] == doc[:-1])
    a, b, pair = _tuples(word[two], word[two + 1])
    made.append((doc[two], _hashed(a, b, words=words)[pair]))
    at = np.flatnonzero(np.diff(two) == 1)
    head, tail, triple = _tuples(pair[at], word[two[at] + 2])
    made.append((doc[two[at]], _hashed(a[head], b[head], tail, words=words)[triple]))
    return sizes, np.concatenate([d for d, _ in made]), np.concatenate([x for _, x in made])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    texts: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        sizes, doc, bucket = features(texts)
        key, freq = np.unique(doc * BUCKETS + bucket, return_counts=True)
        lengths = np.bincount(key // BUCKETS, minlength=len(texts))
        steps = np.diff(key % BUCKETS, prepend=0)
        starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        steps[starts] = key[starts] % BUCKETS
        row = [list(ids), sizes, lengths, pack_ints(steps), pack_ints(freq), np.bincount(bucket, minlength=BUCKETS)]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        ids.clear()
        texts.clear()
        return pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[f.split(" ")[0] for f in _BLOCKS.split(", ")])

    for batch in chunks(batches, BLOCK_BYTES):
        raw = byte_list(batch.column("text"))
        size = sum(map(len, raw))
        if texts and held + size > BLOCK_BYTES:
            yield flush()
            held = 0
        ids += batch.column("doc_id").to_pylist()
        texts += raw
        held += size
    if texts:
        yield flush()
    trim()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by bucket of all blocks of a task."""
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        total += b.column("counts").flatten().to_numpy().reshape(-1, BUCKETS).sum(0)
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])


def _weigh(gains: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lengths, freqs = b.column("lengths")[i].values.to_numpy().astype(np.int64), unpack_ints(b.column("freqs")[i].as_py()).astype(np.int64)
                steps, ends = unpack_ints(b.column("buckets")[i].as_py()).astype(np.int64), np.cumsum(lengths)
                climbed = np.concatenate(([0], np.cumsum(steps)))
                bucket = climbed[1:] - np.repeat(climbed[ends - lengths], lengths)
                sums = [np.concatenate(([0], np.cumsum(x))) for x in (freqs, freqs * gains[bucket])]
                n, weight = (s[ends] - s[ends - lengths] for s in sums)
                yield pa.record_batch([b.column("ids")[i].values, b.column("words")[i].values, pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def _texts(df: DataFrame, key: str) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def gain_table(sampled: DataFrame, target: DataFrame) -> DataFrame:
    """``bucket, gain`` for every bucket, from the counts (``bucket, n``) of the documents and of the target texts."""
    counts = sampled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    for name, blocks in (("s", sampled), ("t", target)):
        one = blocks.select("counts").mapInArrow(_summed, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))
        counts = counts.join(one, "bucket", "left").fillna(0, [name])
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = ((F.col("t") + 1).cast("double") * F.lit(float(total.s + BUCKETS))) / ((F.col("s") + 1).cast("double") * F.lit(float(total.t + BUCKETS)))
    return counts.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def resample(docs: DataFrame, target: DataFrame, target_key: str = "item_id", seed: int = SEED, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null where it is not drawn."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    blocks = scratch.write(_texts(docs, "doc_id").mapInArrow(_blocks, _BLOCKS), "blocks")
    wanted = scratch.write(_texts(target, target_key).mapInArrow(_blocks, _BLOCKS), "target")
    gains = np.zeros(BUCKETS, np.int64)
    for row in gain_table(blocks, wanted).collect():  # BUCKETS rows
        gains[row.bucket] = row.gain

    weighed = blocks.select("ids", "words", "lengths", "buckets", "freqs").mapInArrow(_weigh(gains), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = scratch.write(weighed.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "scored")
    scratch.drop(blocks, wanted)

    may = F.col("score").isNotNull() & (F.col("n_words") >= LEAST_WORDS)
    drawn = percent * scored.where(may).count() // 100
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    ranged = scored.where(may).select("score", "doc_id", "row").repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    ranged = scratch.write(ranged.select("row", F.monotonically_increasing_id().alias("place")), "ranged")  # partition and place in it
    part, here = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, at = 0, []
    for p, n in sorted(ranged.groupBy(part.alias("part")).count().collect()):  # a row for each partition
        if before < drawn:
            at.append((p, before))
        before += n
    starts = spark.createDataFrame(at, "part long, before long")
    ranks = ranged.select("row", part.alias("part"), (here + 1).alias("own")).join(F.broadcast(starts), "part").select("row", (F.col("before") + F.col("own")).alias("rank")).where(F.col("rank") <= drawn)
    ranks = scratch.write(ranks, "ranks")
    return scored.join(checked_side(ranks), "row", "left").drop("row")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op12_importance_resampling": op12_importance_resampling}
#: DuckDB has no crc32; ``tests/llm/test_selection.py`` compares with a brute force.
ORACLE: dict[str, str] = {}
