"""Trigrams of characters by blocks of documents, and a modified Kneser-Ney model over them.

Tokens are UTF-16 code units; a trigram is one key of three. A block is a bounded chunk of text with its dictionary of
distinct trigrams and a sparse document-by-trigram matrix, written to a scratch
table. Counts, discounts and probabilities are DataFrame aggregations and joins
sharded by key; only tables keyed by a single token (bounded by the vocabulary) are
broadcast. Each distinct trigram is resolved once, answers go back to the blocks,
and per-document sums are products of matrix and answer vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm._common import Scratch, chunks, doc_text, freed
from foliospark.llm.token_counts import pack_ints, unpack_ints

BLOCK_BYTES = 8 << 20
BEGIN, END = 2, 3
BITS = 16
BLOCK_SCHEMA = "block long, ids array<long>, langs array<string>, n array<long>, repeated array<double>, lengths array<int>, keys array<long>, index binary, freq binary"


def trigrams(text: str) -> np.ndarray:
    """Packed trigrams of a text between two begin units and an end unit; one for each unit and the end."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.int64)
    a = np.concatenate(([BEGIN, BEGIN], units, [END]))
    return a[:-2] << 32 | a[1:-1] << 16 | a[2:]


def repeated_share(text: str) -> float:
    """Share of words that equal the word before them, with ten more words that don't, so that short texts aren't judged by it."""
    words = text.split()
    return sum(map(str.__eq__, words, words[1:])) / (len(words) + 10)


def _make_blocks(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for seq, b in enumerate(chunks(batches, max_bytes)):
        grams, freqs, n, repeated = [], [], [], []
        for text in b.column("text").to_pylist():
            keys, counts = np.unique(trigrams(text), return_counts=True)
            grams.append(keys)
            freqs.append(counts)
            n.append(int(counts.sum()))
            repeated.append(repeated_share(text))
        lengths = [len(g) for g in grams]
        keys, index, docs = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        order = np.argsort(-docs, kind="stable")  # frequent trigrams get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        langs = b.column("lang").to_pylist() if "lang" in b.schema.names else [None] * len(n)
        row = [task << 32 | seq, b.column("doc_id").to_pylist(), langs, n, repeated, lengths, keys[order], pack_ints(rank[index]), pack_ints(np.concatenate(freqs))]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["block", "ids", "langs", "n", "repeated", "lengths", "keys", "index", "freq"])


def make_blocks(docs: DataFrame, scratch: Scratch, max_bytes: int = BLOCK_BYTES) -> DataFrame:
    lang = [F.col("lang").cast("string").alias("lang")] if "lang" in docs.columns else []
    return scratch.write(doc_text(docs, *lang).mapInArrow(freed(lambda batches: _make_blocks(batches, max_bytes)), BLOCK_SCHEMA), "blocks")


def rows_of(blocks: DataFrame) -> DataFrame:
    """``block, pos, doc_id, lang, n``: the documents of the blocks."""
    return blocks.select("block", F.posexplode(F.arrays_zip("ids", "langs", "n")).alias("pos", "d")).select("block", "pos", F.col("d.ids").alias("doc_id"), F.col("d.langs").alias("lang"), F.col("d.n").alias("n"))


def count_trigrams(blocks: DataFrame, chosen: DataFrame, scratch: Scratch) -> DataFrame:
    """``k3, chosen, everything``: counts of each distinct trigram in the chosen documents (``doc_id``) and in all."""
    picked = rows_of(blocks).join(chosen.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("block").agg(F.collect_list("pos").alias("picked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                keys, lengths = row["keys"].values.to_numpy(), row["lengths"].values.to_numpy()
                index, freq = unpack_ints(row["index"].as_py()), unpack_ints(row["freq"].as_py())
                weight = np.zeros(len(lengths))
                weight[row["picked"].as_py() or []] = 1
                some = np.bincount(index, freq * np.repeat(weight, lengths), len(keys)).astype(np.int64)
                every = np.bincount(index, freq, len(keys)).astype(np.int64)
                yield pa.record_batch([pa.array(keys), pa.array(some), pa.array(every)], names=["k3", "chosen", "everything"])

    rows = blocks.drop("ids", "langs", "n", "repeated").join(picked, "block", "left").mapInArrow(freed(run), "k3 long, chosen long, everything long")
    return scratch.write(rows.groupBy("k3").agg(F.sum("chosen").alias("chosen"), F.sum("everything").alias("everything")), "counts")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; plain absolute discounting where those are degenerate."""
    r = counts.agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
    if not all(r):
        return (0.5, 0.5, 0.5)
    y = r.n1 / (r.n1 + 2 * r.n2)
    return tuple(min(max(d, 0.05), j - 0.05) for j, d in ((1, 1 - 2 * y * r.n2 / r.n1), (2, 2 - 3 * y * r.n3 / r.n2), (3, 3 - 4 * y * r.n4 / r.n3)))


def _cut(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, F.lit(d[0])).when(c == 2, F.lit(d[1])).otherwise(F.lit(d[2]))


def _contexts(counts: DataFrame, key: str, d: tuple[float, float, float], name: str, bits: int) -> DataFrame:
    """Total count and back-off mass of each context."""
    mass = F.sum(_cut(F.col("c"), d))
    return counts.groupBy(F.shiftright(key, bits).alias(name)).agg(F.sum("c").alias(f"{name}_total"), mass.alias(f"{name}_mass"))


def log_probabilities(keys: DataFrame, counts: DataFrame, scratch: Scratch, out: str, bits: int = BITS) -> DataFrame:
    """``keys`` (with ``k3``) and ``out``: the log of each trigram's interpolated modified Kneser-Ney probability under ``counts`` (``k3, c``)."""
    low, low2 = (1 << bits) - 1, (1 << 2 * bits) - 1
    c3 = counts.where("c > 0")
    c2 = scratch.write(c3.groupBy(F.col("k3").bitwiseAND(F.lit(low2)).alias("k2")).agg(F.count("*").alias("c")), "bigrams")
    c1 = c2.groupBy(F.col("k2").bitwiseAND(F.lit(low)).alias("w")).agg(F.count("*").alias("c"))
    d3, d2, d1 = discounts(c3), discounts(c2), discounts(c1)
    all1 = c1.agg(F.coalesce(F.sum("c"), F.lit(1)).alias("total"), F.coalesce(F.sum(_cut(F.col("c"), d1)), F.lit(1.0)).alias("mass"), F.count("*").alias("n")).first()
    floor = all1.mass / all1.total / (all1.n + 1)  # the share of an unknown unit
    p1 = c1.select("w", ((F.col("c") - _cut(F.col("c"), d1)) / F.lit(all1.total) + F.lit(floor)).alias("p1"))
    h2, h3 = _contexts(c2, "k2", d2, "h2", bits), _contexts(c3, "k3", d3, "h3", bits)

    def blend(c: str, h: str, d: tuple[float, float, float], lower: Column) -> Column:
        own = F.coalesce((F.col(c) - _cut(F.col(c), d)) / F.col(f"{h}_total"), F.lit(0.0))
        return F.when(F.col(f"{h}_total").isNull(), lower).otherwise(own + F.col(f"{h}_mass") / F.col(f"{h}_total") * lower)

    asked = keys.select(
        *keys.columns, F.col("k3").bitwiseAND(F.lit(low2)).alias("k2"), F.shiftright("k3", bits).alias("h3"),
        F.shiftright("k3", bits).bitwiseAND(F.lit(low)).alias("h2"), F.col("k3").bitwiseAND(F.lit(low)).alias("w"),
    )
    joined = (
        asked.join(F.broadcast(p1), "w", "left").join(F.broadcast(h2), "h2", "left")  # 2 ** bits rows at most
        .join(c2.withColumnRenamed("c", "c2"), "k2", "left").join(h3, "h3", "left").join(c3.withColumnRenamed("c", "c3"), "k3", "left")
    )
    p2 = blend("c2", "h2", d2, F.coalesce("p1", F.lit(floor)))
    return joined.select(*keys.columns, F.log(blend("c3", "h3", d3, p2)).alias(out))


def document_losses(blocks: DataFrame, answers: DataFrame, names: list[str]) -> DataFrame:
    """``doc_id, lang, n, repeated`` and, for each name, the sum of that answer over the document's trigrams, negated."""
    per_key = blocks.select("block", F.posexplode("keys").alias("pos", "k3")).join(answers.select("k3", *names), "k3")
    vectors = per_key.groupBy("block").agg(F.collect_list(F.struct("pos", *(F.col(c).cast("double").alias(c) for c in names))).alias("answer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                got = row["answer"].values
                at = got.field("pos").to_numpy()
                lengths = np.array(row["lengths"].as_py(), np.int64)
                index, freq, ends = unpack_ints(row["index"].as_py()), unpack_ints(row["freq"].as_py()), np.cumsum(lengths)
                cols = [row["ids"].values, row["langs"].values, row["n"].values, row["repeated"].values]
                for c in names:
                    vector = np.full(len(at), np.nan)
                    vector[at] = got.field(c).to_numpy()
                    sums = np.concatenate(([0.0], np.cumsum(vector[index] * freq)))
                    cols.append(pa.array(sums[ends - lengths] - sums[ends]))
                yield pa.record_batch(cols, names=["doc_id", "lang", "n", "repeated", *names])

    return blocks.drop("keys").join(vectors, "block").mapInArrow(freed(run), "doc_id long, lang string, n long, repeated double" + "".join(f", {c} double" for c in names))
