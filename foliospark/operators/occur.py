"""Which values stand in which texts, by a gram index instead of a test of every pair.

A gram is a run of bytes of UTF-8. A value is looked up by that of its grams that fewest texts hold; only
texts with this gram are searched for the value. Grams of texts leave a task only if a value may have
them, told by a bit filter of fixed size. Values shorter than a gram use shorter grams, down to one
byte. Grams that very many texts hold are dealt over several tasks.

Null and empty values stand nowhere, null texts hold nothing. Repeated rows of either side count each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.scan import Keep

#: Bytes of a gram; a value uses the longest that it fills.
LENGTHS = (8, 4, 2, 1)
#: Bits of the filter: its size does not depend on the values, only how much it lets through.
FILTER_BITS = 26
#: Texts that hold a gram, beyond which its rows are dealt to several tasks, and rows of hot grams that may be broadcast.
HOT_TEXTS, BROADCAST_ROWS = 10_000, 1_000_000


def grams(data: bytes, length: int) -> np.ndarray:
    """Distinct grams of a text, each packed into a number."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out |= raw[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return np.unique(out)


def gram_length(size: int) -> int:
    return next((x for x in LENGTHS if x <= size), 0)


def _bit(found: np.ndarray, length: int) -> np.ndarray:
    return ((found + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


def _gram_rows(key: str, text: str, lengths: Callable[[int], list[int]], allowed: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, value in zip(b.column(key), b.column(text), strict=True):
                raw = value.as_py().encode()
                for length in lengths(len(raw)):
                    found = grams(raw, length)
                    if allowed is not None and len(found):
                        place = _bit(found, length)
                        found = found[(allowed[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
                    for start in range(0, len(found), 50_000):
                        some = found[start : start + 50_000].view(np.int64)
                        yield pa.record_batch([pa.array([at.as_py()] * len(some), b.schema.field(key).type), pa.array([length] * len(some), pa.int32()), pa.array(some)], names=[key, "length", "gram"])

    return run


def _words_of_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 64-bit words of the filter that a task's grams set."""
    words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for b in batches:
        length, gram = b.column("length").to_numpy(), b.column("gram").to_numpy().view(np.uint64)
        for n in np.unique(length).tolist():
            place = _bit(gram[length == n], n)
            np.bitwise_or.at(words, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
    used = np.flatnonzero(words)
    yield pa.record_batch([pa.array(used, pa.int32()), pa.array(words[used].view(np.int64))], names=["word", "bits"])


def occurrences(values: DataFrame, texts: DataFrame, keep: Keep) -> DataFrame:
    """``item, doc`` for every value (``item, value``) and every text (``doc, text``) that holds it; ids are whole numbers."""
    mark = uuid.uuid4().hex[:8]
    asked = keep(values.where("length(value) > 0").select(F.col("item").cast("long").alias("item"), "value").withColumn("row", F.monotonically_increasing_id()))
    held = texts.where("text is not null").select(F.col("doc").cast("long").alias("doc"), "text").withColumn("row", F.monotonically_increasing_id())
    held = keep(held)
    schema = "row long, length int, gram long"
    own = keep(asked.select("row", "value").mapInArrow(_gram_rows("row", "value", lambda n: [gram_length(n)], None), schema))
    used = sorted(r.length for r in own.select("length").distinct().collect())  # of LENGTHS
    allowed = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in own.select("length", "gram").mapInArrow(_words_of_filter, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():  # no more rows than the filter has words
        allowed[r.word] = r.bits
    found = keep(held.select("row", "text").mapInArrow(_gram_rows("row", "text", lambda n: used, allowed.view(np.uint64)), schema))

    freq = found.groupBy("length", "gram").agg(F.count("*").alias("texts"))
    told = own.join(freq, ["length", "gram"], "left")
    # a value with a gram that no text has stands nowhere
    rarest = told.groupBy("row", "length").agg(F.min_by(F.struct("gram", "texts"), F.struct(F.coalesce("texts", F.lit(0)).alias("n"), "gram")).alias("g"))
    probes = keep(rarest.select(F.col("row").alias("item_row"), "length", "g.gram", "g.texts").where("texts is not null").withColumn("salts", F.ceil(F.col("texts") / HOT_TEXTS)))
    hot = keep(probes.where("salts > 1").select("length", "gram", "salts").distinct())
    known = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    entries = found.select(F.col("row").alias("doc_row"), "length", "gram").join(known, ["length", "gram"], "left")
    entries = entries.select("doc_row", "length", "gram", F.pmod(F.xxhash64("doc_row"), F.coalesce("salts", F.lit(1))).alias("salt"))
    dealt = probes.select("item_row", "length", "gram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    pairs = dealt.join(entries, ["length", "gram", "salt"]).select("item_row", "doc_row")
    spelled = pairs.join(asked.select(F.col("row").alias("item_row"), "item", "value"), "item_row")
    whole = held.select(F.col("row").alias("doc_row"), "doc", F.col("text").alias(f"_text_{mark}"))
    return spelled.join(whole, "doc_row").where(F.col(f"_text_{mark}").contains(F.col("value"))).select("item", "doc")
