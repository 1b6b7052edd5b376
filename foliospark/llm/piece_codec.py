"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf wire format is parsed here; from it come the
normaliser, the word-boundary marker, the pieces with their scores and byte
fallback. A model of the merging kind becomes merges ranked by the score of the
merged piece, one of the unigram kind keeps its scores. No piece of such a model
reaches past a word boundary, so the distinct words of a batch are encoded at once
by the library's threads and texts are put together from their words' ids. Arrow cuts
texts into words, finds the distinct ones and joins ids and pieces.

Parity with the sentencepiece library: the backend encodes every text, those with runs of
spaces, markers and NUL too, and every whole text is encoded by the sentencepiece library as well
(``verify_every = 1``). With a larger ``verify_every``, every distinct word is encoded by both when a
worker first meets it, every text that is not split by words too, and one whole text in ``verify_every`` (by
checksum) again. Where they differ, the sentencepiece library's ids hold and
``agreed`` is false, so that one text fails no job. Each text's ids are decoded and compared with the text.

Null and empty texts give no ids. Text that a model cannot restore (it has unknown
characters and no byte fallback) has ``restored = false``. Repeated rows give equal rows, an empty table
gives none. A text and its ids are held whole by one worker, however long. Only ``doc_id`` and ``text`` are read, so extra columns cannot clash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm._common import chunks, doc_text, freed, table, tokenizer_file, trim

BATCH_BYTES = 1 << 20
#: Words whose ids a task keeps in each of two generations; those not met again while one fills up are let go.
KNOWN_WORDS = 75_000
#: Words that are encoded as one text.
AT_ONCE = 256
MARK = "▁"
#: A space and the word after it with its further spaces, or the spaces at a text's end.
SPACED = r" ( *[^ ]+| *\z)"
#: Texts that are not words with one space between each two.
UNEVEN = r"^ |  | \z|" + MARK


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, type), model kind and normaliser settings of a model file."""
    out = {"pieces": [], "kind": 1, "byte_fallback": False, "dummy_prefix": True, "extra_spaces": True, "escape": True, "charsmap": b"", "unk": 0}
    for field, value in wire(data):
        if field == 1:
            piece, score, kind = "", 0.0, 1
            for f, v in wire(value):
                if f == 1:
                    piece = v.decode()
                elif f == 2:
                    score = struct.unpack("<f", v)[0]
                elif f == 3:
                    kind = v
            out["pieces"].append((piece, score, kind))
        elif field == 2:
            for f, v in wire(value):
                if f == 3:
                    out["kind"] = v
                elif f == 35:
                    out["byte_fallback"] = bool(v)
                elif f == 40:
                    out["unk"] = v
        elif field == 3:
            for f, v in wire(value):
                if f == 2:
                    out["charsmap"] = v
                elif f in (3, 4, 5):
                    out[{3: "dummy_prefix", 4: "extra_spaces", 5: "escape"}[f]] = bool(v)
    return out


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs that make a piece, those of the best score first; a tie goes by the parts' ids."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
            if left is not None and right is not None:
                found.append((-pieces[i][1], i, left, right))
    return [(pieces[a][0], pieces[b][0]) for _, _, a, b in sorted(found)]


@lru_cache(maxsize=1)
def _parsed(data: bytes) -> tuple[dict, list[tuple[str, str]]]:
    """A model and its merges, which a worker keeps for its next task."""
    m = parse_model(data)
    return m, merges_of(m["pieces"]) if m["kind"] == 2 else []


class PieceCodec:
    def __init__(self, path: str, whole: bool = False):
        """``whole``: both libraries' ids of whole texts are compared, so that those of single words need not be."""
        import sentencepiece
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        with open(path, "rb") as f:
            data = f.read()
        m, merges = _parsed(data)
        pieces = m["pieces"]
        if m["kind"] not in (1, 2):
            raise ValueError("only models of the unigram and the merging kind are supported")
        if m["kind"] == 2:
            vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
            model = models.BPE(vocab, merges, unk_token=pieces[m["unk"]][0], fuse_unk=True, byte_fallback=m["byte_fallback"], cache_capacity=0)
        else:
            model = models.Unigram([(p, s) for p, s, _ in pieces], m["unk"], m["byte_fallback"])
        self.tokenizer = Tokenizer(model)
        steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
        if m["extra_spaces"]:
            steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Strip()]
        if m["dummy_prefix"]:
            steps.append(normalizers.Prepend(MARK if m["escape"] else " "))
        if m["escape"]:
            steps.append(normalizers.Replace(" ", MARK))
        self.tokenizer.normalizer = normalizers.Sequence(steps)
        inside = any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind in (1, 4))
        if m["escape"] and not inside:  # no piece goes on past a marker, so a word's ids are the same in any text
            self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        as_bytes = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else b" \xe2\x81\x87 " if kind == 2 else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.bytes = pa.array(as_bytes, pa.large_binary())
        self.prefix, self.strips, self.whole = m["dummy_prefix"], m["extra_spaces"], whole
        self.by_word = m["escape"] and not inside and m["dummy_prefix"] and not m["charsmap"]
        # Merges end at markers by themselves and bytes stand for unknown characters, so words with their markers need no normalising and no splitting.
        self.marked = Tokenizer(model) if self.by_word and m["kind"] == 2 and m["byte_fallback"] else None
        self.opens = np.array([p.startswith(MARK) for p, _, _ in pieces])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.lead = len(self.ids(["a"])[0]), len(self.other.encode("a"))

    def ids(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, texts: list[str]) -> pa.Array:
        """Lists of the words of each text without the space before each; further spaces before a word are part of it. Null where a text must stay whole."""
        if not self.by_word:
            return pa.nulls(len(texts), pa.list_(pa.large_string()))
        col, nothing = pa.array(texts, pa.large_string()), pa.scalar("", pa.large_string())
        uneven, whole = pc.match_substring_regex(col, UNEVEN), pc.equal(col, nothing)
        col = pc.replace_substring(col, MARK, " ")
        if self.strips:
            whole = pc.or_(whole, pc.match_substring_regex(col, UNEVEN))
        col = pc.if_else(whole, pa.scalar(None, pa.large_string()), col)
        if self.strips or not pc.any(uneven).as_py():
            return pc.split_pattern(col, " ")
        col = pc.replace_substring_regex(pc.binary_join_element_wise(nothing, col, pa.scalar(" ", pa.large_string())), SPACED, MARK + r"\1")
        return pc.split_pattern(pc.utf8_slice_codeunits(col, 1), MARK)

    def learn(self, words: list[str]) -> None:
        """Ids of new words, by both backends unless whole texts are compared. A word's first piece alone starts with the marker, so words are encoded side by side and cut apart there."""
        alone = [w for w in words if not w or w[0] == " "]  # begins with more than one marker, or is only markers
        words = [w for w in words if w and w[0] != " "] if alone else words
        groups = [words[at : at + AT_ONCE] for at in range(0, len(words), AT_ONCE)]
        texts = [" ".join(g) for g in groups]
        wants = [None] * len(texts) if self.whole else self.other.encode(texts, num_threads=1)
        found = self.ids(texts) if self.marked is None else self.ids([MARK + MARK.join(g) for g in groups], self.marked)
        for group, ids, want in zip(groups, found, wants, strict=True):
            cuts = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
            if (self.whole or ids.tolist() == want) and len(cuts) == len(group) + 1:
                raw = ids.tobytes()
                self.known.update((w, raw[a:b]) for w, a, b in zip(group, cuts, cuts[1:], strict=False))
            else:
                alone += group
        texts = ["a " + w for w in alone]
        found = self.ids(texts) if self.marked is None else self.ids([MARK + t.replace(" ", MARK) for t in texts], self.marked)
        for w, text, ids in zip(alone, texts, found, strict=True):
            ids = ids[self.lead[0] :]
            if not self.whole and ids.tolist() != (want := self.other.encode(text)[self.lead[1] :]):
                ids = np.array(want, np.int32)
                self.differ.add(w)
            self.known[w] = ids.tobytes()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether both libraries agree on them: on the whole text, or on each of its words."""
        words = self.words(texts)
        unsplit, counts = np.flatnonzero(words.is_null()).tolist(), pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.known]
        self.known.update((w, self.older[w]) for w in new if w in self.older)
        self.learn([w for w in new if w not in self.older])
        joined, ends = taken(pa.array(list(map(self.known.__getitem__, distinct)), pa.large_binary()), flat.indices)
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        tokens, cuts = np.array(np.frombuffer(joined, np.int32)), ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))] // 4
        ids = [tokens[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        for i, some in zip(unsplit, self.ids([texts[i] for i in unsplit]), strict=True):
            ids[i] = some
        agreed = [not self.differ.intersection(w or ()) for w in words.to_pylist()] if self.differ else [True] * len(texts)
        self.check(texts, ids, agreed, range(len(texts)) if self.whole else unsplit)
        return ids, agreed

    def joined(self, ids: list[np.ndarray]) -> list[bytes]:
        """Pieces joined, byte pieces as raw bytes, the added first space removed."""
        raw, ends = taken(self.bytes, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
        cuts = ends[np.cumsum([0, *map(len, ids)])].tolist()
        return [raw[a + (self.prefix and raw[a : min(a + 1, b)] == b" ") : b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [raw.decode(errors="replace") for raw in self.joined(ids)]

    def check(self, texts: list[str], ids: list[np.ndarray], agreed: list[bool], chosen: Sequence[int]) -> None:
        """Compare the chosen texts with the sentencepiece library; where it differs, its ids are taken and the text is marked."""
        for i, want in zip(chosen, self.other.encode([texts[i] for i in chosen], num_threads=1, out_type="numpy"), strict=True):
            if not np.array_equal(want, ids[i]):
                ids[i], agreed[i] = np.array(want, np.int32), False


def taken(values: pa.Array, which: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The chosen values of a large binary array, joined, and where each begins and ends."""
    if not len(which):
        return memoryview(b""), np.zeros(1, np.int64)
    got = values.take(which)
    ends = np.frombuffer(got.buffers()[1], np.int64, count=len(got) + 1)
    return memoryview(got.buffers()[2] or b"")[: ends[-1]], ends


def encode_documents(docs: DataFrame, path: str, verify_every: int = 1, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, restored, agreed`` and, if asked for, ``ids``. Every text is compared whole; with a larger ``verify_every``, its words when first met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(tokenizer_file(path), whole=verify_every == 1)
        for b in chunks(batches, BATCH_BYTES):
            texts = b.column("text").to_pylist()
            ids, agreed = codec.encode(texts)
            if not codec.whole:
                codec.check(texts, ids, agreed, [i for i, t in enumerate(texts) if crc32(t.encode()) % verify_every == 0])
            back = codec.joined(ids)
            lengths = [len(x) for x in ids]
            cols = [
                b.column("doc_id"), pa.array(lengths, pa.int64()),
                pa.array([crc32(x) for x in ids], pa.int64()),
                pa.array([x.encode() == y for x, y in zip(texts, back, strict=True)], pa.bool_()), pa.array(agreed, pa.bool_()),
            ]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32())))
            yield pa.record_batch(cols, names=["doc_id", "n_tokens", "ids_crc32", "restored", "agreed", "ids"][: len(cols)])
        del codec
        trim()

    return doc_text(docs).mapInArrow(freed(run), "doc_id long, n_tokens long, ids_crc32 long, restored boolean, agreed boolean" + ", ids array<int>" * with_ids)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(tokenizer_file(path))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                yield pa.record_batch([some.column("doc_id"), pa.array(codec.decode([np.array(x or [], np.int32) for x in some.column("ids").to_pylist()]), pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(freed(run), "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), model_path())


QUERIES = {"op6_piece_codec": op6_piece_codec}
ORACLE: dict[str, str] = {}
