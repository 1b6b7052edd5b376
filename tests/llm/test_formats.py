"""Hand-made files: a small unigram model, and FLAC streams with everything the own encoder does not write."""

from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import pytest
import sentencepiece

from foliospark.llm import flac, piece_codec


def field(number, kind, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    body = varint(value) if kind == 0 else varint(len(value)) + value if kind == 2 else value
    return varint(number << 3 | kind) + body


def unigram_model(tmp_path, words, kind=1):
    """A model file with byte fallback whose pieces are these words, with and without marker, and all their letters."""
    mark = piece_codec.MARK
    normal = sorted({mark, *"".join(words), *words, *(mark + w for w in words)} - {""})
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))]
    pieces += [(p, -2.0 - 0.37 * i - 3.0 / len(p), 1) for i, p in enumerate(normal)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, t)) for p, s, t in pieces)
    data += field(2, 2, field(3, 0, kind) + field(35, 0, 1) + field(40, 0, 0) + field(41, 0, 1) + field(42, 0, 2))
    data += field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    path = tmp_path / "small.model"
    path.write_bytes(data)
    return str(path)


def test_unigram_models_match_the_library(tmp_path):
    rng = random.Random(5)
    words = ["the", "then", "he", "hen", "en", "no", "note", "tent", "ten", "on"]
    path = unigram_model(tmp_path, words)
    codec, library = piece_codec.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [" ".join("".join(rng.choice([*words, "é", "z", "h"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    ids, agreed = codec.encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts) and codec.decode(ids) == texts
    assert sum(agreed) >= 190  # ties between equal sums may be broken otherwise; the library's ids hold then
    odd = ["", " a", "a  b", "the ", piece_codec.MARK + "on", "no\0te"]
    assert [x.tolist() for x in codec.encode(odd)[0]] == library.encode(odd)


def test_other_kinds_of_models_are_refused(tmp_path):
    with pytest.raises(ValueError, match="kind"):
        piece_codec.PieceCodec(unigram_model(tmp_path, ["a"], kind=4))


def test_every_text_goes_through_both_backends(spark, tmp_path):
    normal = [("bc", -1.0), ("ab", -1.0), (piece_codec.MARK, -2.0), *((c, -3.0 - i) for i, c in enumerate("abcx"))]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256)), *((p, s, 1) for p, s in normal)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, t)) for p, s, t in pieces)
    data += field(2, 2, field(3, 0, 2) + field(35, 0, 1) + field(40, 0, 0) + field(41, 0, 1) + field(42, 0, 2))
    data += field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    path = tmp_path / "ties.model"
    path.write_bytes(data)
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    tied = ["x abc", "x  abc", " abc", "abc ", f"x{piece_codec.MARK}abc", "abc\0"]  # of two scores alike the library takes the left one, the backend the first piece
    texts = [*tied, "x ab", "x  bc", " x", "x ", f"x{piece_codec.MARK}x", "x\0", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"verify_every": 1000}):
        rows = {r.doc_id: r for r in piece_codec.encode_documents(docs, str(path), **options).collect()}
        assert {i: r.ids for i, r in rows.items()} == {i: library.encode(t or "") for i, t in enumerate(texts)}
        assert [rows[i].agreed for i in range(len(texts))] == [t not in tied for t in texts]


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [value >> i & 1 for i in range(width - 1, -1, -1)]
        return self

    def rice(self, value, k):
        u = value << 1 if value >= 0 else (-value << 1) - 1
        self.bits += [0] * (u >> k) + [1]
        return self.put(u & (1 << k) - 1, k)

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, self.bits[i : i + 8])), 2) for i in range(0, len(self.bits), 8))


def crc(data, poly, width):
    value, top, full = 0, 1 << width - 1, (1 << width) - 1
    for byte in data:
        value ^= byte << width - 8
        for _ in range(8):
            value = (value << 1 ^ poly) & full if value & top else value << 1 & full
    return value


def residual(bits, values, order, parts, escape=()):
    """Rice-coded residual in ``2 ** parts`` partitions; those in ``escape`` raw."""
    bits.put(0, 2).put(parts, 4)
    size, at = (len(values) + order) >> parts, 0
    for p in range(1 << parts):
        n = size - (order if p == 0 else 0)
        if p in escape:
            bits.put(15, 4).put(20, 5)
            for v in values[at : at + n]:
                bits.put(v & (1 << 20) - 1, 20)
        else:
            bits.put(3 + p, 4)
            for v in values[at : at + n]:
                bits.rice(v, 3 + p)
        at += n


def subframe(bits, x, width, how):
    wasted = how.get("wasted", 0)
    x, width = [v >> wasted for v in x], width - wasted
    raw = lambda v: bits.put(v & (1 << width) - 1, width)
    kind = {"constant": 0, "verbatim": 1, "fixed": 8 + how.get("order", 0), "lpc": 31 + how.get("order", 0)}[how["kind"]]
    bits.put(0, 1).put(kind, 6).put(1 if wasted else 0, 1)
    if wasted:
        bits.put(1, wasted)
    if how["kind"] == "constant":
        raw(x[0])
    elif how["kind"] == "verbatim":
        for v in x:
            raw(v)
    else:
        order = how["order"]
        for v in x[:order]:
            raw(v)
        if how["kind"] == "lpc":
            coefs, shift = how["coefs"], how["shift"]
            bits.put(9, 4).put(shift, 5)
            for c in coefs:
                bits.put(c & 1023, 10)
        else:
            coefs, shift = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}[order], 0
        residual(bits, [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> shift) for i in range(order, len(x))], order, how.get("parts", 0), how.get("escape", ()))


def stream(channels, width, frames, block):
    """A FLAC stream of equal blocks; each frame names its channel layout and how its subframes are coded."""
    total = len(channels[0])
    wide = (width + 7) // 8
    pcm = b"".join(v.to_bytes(wide, "little", signed=True) for row in zip(*channels, strict=True) for v in row)
    info = struct.pack(">HH", block, block) + bytes(6) + (44100 << 44 | len(channels) - 1 << 41 | width - 1 << 36 | total).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    out = b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info
    for n, (layout, hows) in enumerate(frames):
        parts = [c[n * block : (n + 1) * block] for c in channels]
        code = {"left": 8, "right": 9, "mid": 10}.get(layout, len(channels) - 1)
        head = Bits().put(0b11111111111110, 14).put(0, 2).put(7, 4).put(9, 4).put(code, 4).put({8: 1, 16: 4, 24: 6}[width], 3).put(0, 1).put(n, 8).put(block - 1, 16).bytes()
        head += bytes([crc(head, 0x07, 8)])
        bits = Bits()
        widths = [width] * len(channels)
        if layout in ("left", "right", "mid"):
            left, right = parts
            side = [a - b for a, b in zip(left, right, strict=True)]
            parts = {"left": [left, side], "right": [side, right], "mid": [[(a + b) >> 1 for a, b in zip(left, right, strict=True)], side]}[layout]
            widths = {"left": [width, width + 1], "right": [width + 1, width], "mid": [width, width + 1]}[layout]
        for x, w, how in zip(parts, widths, hows, strict=True):
            subframe(bits, x, w, how)
        body = head + bits.bytes()
        out += body + crc(body, 0x8005, 16).to_bytes(2, "big")
    return out, pcm


LPC = {"kind": "lpc", "order": 3, "coefs": [300, -90, 20], "shift": 8}
CASES = [
    ("plain", [{"kind": "verbatim"}, {"kind": "fixed", "order": 2, "parts": 2}]), ("left", [{"kind": "fixed", "order": 1}, {"kind": "fixed", "order": 0, "parts": 1, "escape": (1,)}]),
    ("right", [{"kind": "fixed", "order": 3, "parts": 3}, LPC]), ("mid", [LPC | {"parts": 2, "escape": (0, 3)}, {"kind": "fixed", "order": 4}]),
]


@pytest.mark.parametrize("width", [8, 16, 24])
def test_flac_decodes_stereo_predictors_partitions_and_escapes(width):
    rng, block, top = random.Random(width), 64, 1 << width - 2
    walk = [0]
    for _ in range(block * len(CASES) - 1):
        walk.append(max(-top, min(top - 1, walk[-1] + rng.randint(-top // 16 - 1, top // 16 + 1))))
    other = [max(-top, min(top - 1, v + rng.randint(-3, 3))) for v in walk]
    data, pcm = stream([walk, other], width, CASES, block)
    info, blocks = flac.decode([data])[0]
    assert (info["bits"], len(blocks)) == (width, len(CASES)) and [first for first, _ in blocks] == [0, 64, 128, 192]
    assert np.concatenate([x for _, x in blocks], axis=1).tolist() == [walk, other] and flac.pcm_bytes(blocks, info) == pcm


def test_flac_decodes_wasted_bits_and_constants():
    x = [8 * ((7 * i) % 31 - 15) for i in range(64)] + [40] * 64
    data, pcm = stream([x], 16, [("plain", [{"kind": "fixed", "order": 1, "wasted": 3}]), ("plain", [{"kind": "constant"}])], 64)
    info, blocks = flac.decode([data])[0]
    assert blocks[0][1].tolist() == [x[:64]] and flac.pcm_bytes(blocks, info) == pcm
    for at in range(len(data) - 20, len(data), 3):
        with pytest.raises(ValueError):
            flac.decode([data[:at] + bytes([data[at] ^ 16]) + data[at + 1 :]])
