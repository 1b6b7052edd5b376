"""Sharding by vector bin packing over bytes, tokens and rows.

Groups (rows of equal text) are placed where the dot product of their size
vector with the shard's residual capacity is highest. A group that holds at
least ``1 / (shards * grain)`` of any total is placed on its own; there are at most
``3 * shards * grain`` of them, whatever the corpus size. All lighter groups fall
into ``shards * grain`` parcels by a hash of their text, so that what the driver
packs is bounded by the two parameters and never grows with the input. A shard is
therefore off by a parcel or so, about ``1 / grain`` of its size.

Null texts count as empty ones. Repeated rows stay separate rows of one group.
Of equal dot products the lower shard wins; rows without an id are placed like others.
An empty table gives an empty result. A group heavier than a shard fills one by
itself, and long texts are only measured, never held together. Columns other than ``doc_id`` and ``text``
are not read, so clashing names cannot matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm._common import Scratch, table

SHARDS, GRAIN = 16, 128
#: Rows that one numbering task sorts; a hot group is spread over many such cells.
ROWS_PER_CELL = 50_000


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Greedy vector packing: largest item first, into the shard with the highest dot product of item and residual."""
    share = vectors / np.maximum(vectors.sum(axis=0), 1)
    residual = np.full((shards, share.shape[1]), 1.0 / shards)
    out = np.zeros(len(share), dtype=np.int32)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        out[i] = int(np.argmax(residual @ share[i]))
        residual[out[i]] -= share[i]
    return out


def with_sizes(docs: DataFrame) -> DataFrame:
    """Size, checksum and two group hashes of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        (F.octet_length(text) - F.octet_length(F.translate(text, " \n\t", "")) + 1).cast("long").alias("tokens"),
    )


def shard(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """One row per document: ``doc_id, size, tokens, text_crc32, shard, slot``; equal texts share a shard."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    rows = scratch.write(with_sizes(docs), "sizes")
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = scratch.write(groups, "groups")
    axes = ["bytes", "tokens", "rows"]
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in axes)).first()
    parcels = shards * grain
    heavy = F.lit(False)
    for c in axes:
        heavy = heavy | (F.col(c) * parcels >= F.lit(max(total[c], 1)))
    place = F.when(heavy, F.struct(F.lit(-1).alias("parcel"), "h1", "h2")).otherwise(
        F.struct(F.pmod("h1", F.lit(parcels)).cast("int").alias("parcel"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    )
    # at most 3 * shards * grain heavy groups (each holds 1/parcels of a total) and `parcels` parcels
    items = groups.groupBy(place.alias("p")).agg(*(F.sum(c).alias(c) for c in axes)).select("p.*", *axes).orderBy("parcel", "h1", "h2").collect()
    if not items:
        return spark.createDataFrame([], "doc_id long, size long, tokens long, text_crc32 long, shard int, slot long")
    where = pack(np.array([[r[c] for c in axes] for r in items], dtype=np.float64), shards)
    placed = [(r.parcel, r.h1, r.h2, int(s), n) for n, (r, s) in enumerate(zip(items, where, strict=True))]
    alone = [(h1, h2, s, n, items[n]["rows"]) for parcel, h1, h2, s, n in placed if parcel < 0]
    light = {parcel: (s, n, items[n]["rows"]) for parcel, _, _, s, n in placed if parcel >= 0}
    known = spark.createDataFrame(alone, "h1 long, h2 long, a_shard int, a_item int, a_rows long")
    lut = spark.createDataFrame([(p, *v) for p, v in light.items()], "parcel int, p_shard int, p_item int, p_rows long")
    cells = F.greatest(F.lit(1), F.ceil(F.col("item_rows") / ROWS_PER_CELL)).cast("long")
    dealt = (
        rows.withColumn("parcel", F.pmod("h1", F.lit(parcels)).cast("int"))
        .join(F.broadcast(known), ["h1", "h2"], "left")
        .join(F.broadcast(lut), "parcel", "left")
        .select(
            "doc_id", "size", "tokens", "text_crc32", "h1", "h2",
            F.coalesce("a_shard", "p_shard").alias("shard"),
            F.coalesce("a_item", "p_item").alias("item"),
            F.coalesce("a_rows", "p_rows").alias("item_rows"),
        )
        .withColumn("cell", F.pmod(F.xxhash64("doc_id"), cells))
    )
    # gapless slots in two levels: the rank within a cell plus the rows of the shard's cells before it
    counts = dealt.groupBy("shard", "item", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("item", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("item", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("item", "cell").orderBy("h1", "h2", "doc_id")
    return (
        dealt.withColumn("rank", F.row_number().over(inside) - 1)
        .join(starts, ["item", "cell"])
        .select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"))
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


QUERIES = {"op3_sharding": op3_sharding}
ORACLE: dict[str, str] = {}
