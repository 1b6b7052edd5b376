"""Token counts without token ids: each distinct pre-token is split into pieces once.

Plan: (1) per chunk of documents (a block) the distinct pre-tokens and a sparse
document-by-pre-token frequency matrix are written to a scratch table; (2) the
blocks' pre-tokens are routed by hash, so every distinct pre-token meets in one
task, which counts its pieces once and answers each block; (3) a block's answers
are joined to its matrix and summed per document. A block holds a bounded amount
of text and a hot pre-token appears once a block, so no key can swell a task.

Texts of plain Latin characters are pre-split by an equal regular expression;
others, and those with a special string of the tokenizer inside, go through the
library's own normaliser and splitter. Null and empty texts have no token; a very long text is a block of its own. Repeated rows
count alike, rows without an id are counted too, an empty table gives no row, and columns
other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm._common import Scratch, chunks, doc_text, shuffle_partitions, table, tokenizer_file

LIMIT = 2048
BLOCK_BYTES = 8 << 20
#: Pre-tokens of blocks that one part answers, at most about; no part holds more distinct ones.
PART_WORDS = 1_000_000
#: Texts with no other characters are split alike by the library and by PLAIN_SPLIT.
_EXOTIC = re.compile("[^\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]")
_PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")


class PreTokenizer:
    """Pre-tokens of texts for a byte-level BPE file whose splitter is one regular expression."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.plain = {x["type"] for x in spec["normalizer"].get("normalizers", [])} == {"NFC", "Replace", "Lowercase"} and "\\p{N}]|" in pattern
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def __call__(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens in order, and the number of special tokens beside them."""
        special = self.special and "<|" in text and self.special.search(text)
        if self.plain and not special and not _EXOTIC.search(text):
            return _PLAIN_SPLIT.findall(text.lower()), 0
        parts, normal = (self.special.split(text) if special else [text]), self.tokenizer.normalizer
        return [w for p in parts for w, _ in self.split.pre_tokenize_str(normal.normalize_str(p))], len(parts) - 1

    def pieces(self, words: list[str]) -> np.ndarray:
        """Number of pieces of each pre-token. Set apart by spaces, pre-tokens are split off as themselves."""
        out = np.zeros(len(words), np.uint32)
        for at in range(0, len(words), 2048):
            some = words[at : at + 2048]
            which = self.tokenizer.encode(" ".join(some), add_special_tokens=False).word_ids
            got = np.bincount(np.array(which, np.int64), minlength=len(some))
            if len(got) != len(some):  # some pre-token is split again beside others, so each is counted by itself
                got = [len(e.ids) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            out[at : at + 2048] = got
        return out


@lru_cache(maxsize=2)
def _pre_tokenizer(path: str) -> PreTokenizer:
    return PreTokenizer(tokenizer_file(path))


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_ints(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _blocks(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, task, press = _pre_tokenizer(path), TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
        for seq, b in enumerate(chunks(batches, BLOCK_BYTES)):
            local: dict[str, int] = {}
            lengths, special, sizes, index, freq = [], [], [], [], []
            for text in b.column("text").to_pylist():
                words, n = split(text)
                counted = Counter(words)
                index.append(np.fromiter((local.setdefault(w, len(local)) for w in counted), np.uint32, len(counted)))
                freq.append(np.fromiter(counted.values(), np.uint32, len(counted)))
                lengths.append(len(counted))
                special.append(n)
                sizes.append(len(text.encode()))
            raw = [w.encode() for w in local]
            order = np.argsort(_hashes(raw), kind="stable")  # the order of parts, however many there will be
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            words = press.compress(b"\n".join(raw[i] for i in order.tolist()))
            row = [task << 32 | seq, words, len(raw), b.column("doc_id").to_pylist(), sizes, special, lengths, pack_ints(place[np.concatenate(index)]), pack_ints(np.concatenate(freq))]
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[f.split(" ")[0] for f in _BLOCK_SCHEMA.split(", ")])

    return run


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def _send(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts the words of each block, which are in the order of their hashes, into parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("words"), strict=True):
                words = inflate.decompress(blob.as_buffer()).split(b"\n")
                cuts = np.searchsorted((_hashes(words) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
                used = np.flatnonzero(np.diff(cuts)).tolist()
                for at in range(0, len(used), 64):
                    some = used[at : at + 64]
                    cols = [[block] * len(some), some, [press.compress(b"\n".join(words[cuts[p] : cuts[p + 1]])) for p in some]]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "part", "words"])

    return run


_BLOCK_SCHEMA = "block long, words binary, n_words long, ids array<long>, sizes array<long>, special array<int>, lengths array<int>, index binary, freq binary"


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row, repeated rows included."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    blocks = scratch.write(doc_text(docs).mapInArrow(_blocks(path), _BLOCK_SCHEMA), "blocks")
    parts = max(shuffle_partitions(spark), int(blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first().n) // PART_WORDS + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known, inflate = _pre_tokenizer(path), {}, zstandard.ZstdDecompressor()
        for b in batches:
            for block, part, words in zip(b.column("block").to_pylist(), b.column("part").to_pylist(), b.column("words").to_pylist(), strict=True):
                asked = inflate.decompress(words).decode().split("\n")
                new = [w for w in asked if w not in known]
                known.update(zip(new, split.pieces(new).tolist(), strict=True))
                answer = np.fromiter(map(known.__getitem__, asked), np.uint32, len(asked))
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([pack_ints(answer)], pa.binary())], names=["block", "part", "pieces"])

    answers = (
        blocks.where("n_words > 0").select("block", "words").mapInArrow(_send(parts), "block long, part int, words binary")
        .repartitionById(parts, F.col("part")).mapInArrow(count, "block long, part int, pieces binary")
        .groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "pieces"))).alias("answers"))
    )
    answers = scratch.write(answers, "answers")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                told = row["answers"].values.field("pieces").to_pylist() if row["answers"].is_valid else []
                pieces = np.concatenate([*map(unpack_ints, told), np.zeros(0, np.uint32)]).astype(np.int64)
                lengths = row["lengths"].values.to_numpy().astype(np.int64)
                ends = np.cumsum(lengths)
                sums = np.concatenate(([0], np.cumsum(pieces[unpack_ints(row["index"].as_py())] * unpack_ints(row["freq"].as_py()))))
                n = sums[ends] - sums[ends - lengths] + row["special"].values.to_numpy()
                yield pa.record_batch([row["ids"].values, row["sizes"].values, pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    whole = blocks.drop("words", "n_words")
    return whole.join(answers, "block", "left").mapInArrow(total, "doc_id long, n_bytes long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE: dict[str, str] = {}
