from __future__ import annotations

import hashlib
import inspect
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import decontaminate, flac, license_scan, line_dedup, lm_scoring, ngram_blocks, piece_codec, quality_lm, sharding, shingle_join, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block long, node long, label long"
WORDS = [f"w{i}" for i in range(60)]


def frame(spark, texts, start=0):
    """Documents with extra columns whose names clash with those the operators use."""
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 3) for i, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=5):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    near = []
    for t in base[:25]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(1, 3)):
                v[rng.randrange(len(v))] = "edit"
            near.append(" ".join(v))
    texts = base + near + base[:10] + [None, "", " \n\t", "one", "one", "A b C d", "a B c D", "x " * 30_000]
    rng.shuffle(texts)
    return texts


def brute_sets(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


@pytest.mark.parametrize("long_list", [64, 3])
def test_near_duplicates_against_brute_force(spark, monkeypatch, long_list):
    monkeypatch.setattr(shingle_join, "LONG_LIST", long_list)
    monkeypatch.setattr(shingle_join, "PART_SHINGLES", 100 * long_list)
    texts = corpus()
    sets = [brute_sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_near_duplicates_of_nothing(spark):
    assert shingle_join.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in shingle_join.near_duplicates(frame(spark, [None, ""])).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 1)]


def test_settling_a_group_joins_what_is_similar():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [base, base[20:], base[:170], np.sort(rng.integers(0, 2**63, 200).astype(np.uint64))]
    got = shingle_join._settle_group(pa.table({"node": [1, 2, 3, 4], "label": [1, 2, 3, 4], "grams": [s.tobytes() for s in sets]}))
    assert {frozenset(p) for p in zip(got["u"].to_pylist(), got["v"].to_pylist(), strict=True)} >= {frozenset((1, 2)), frozenset((1, 3))}
    assert 4 not in got["u"].to_pylist() + got["v"].to_pylist()


def test_sharding(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(900)] + ["hot text of many copies"] * 60 + [None, "", ""]
    rows = sharding.shard(frame(spark, texts), shards=4).collect()
    assert Counter(r.doc_id for r in rows) == Counter(range(len(texts)))
    for r in rows:
        assert (r.size, r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 1, zlib.crc32((texts[r.doc_id] or "").encode()))
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({r.shard for r in rows if texts[r.doc_id] == "hot text of many copies"}) == 1
    for axis in ("size", "tokens"):
        loads = [sum(r[axis] for r in rows if r.shard == s) for s in range(4)]
        assert max(loads) < 1.05 * sum(loads) / 4
    assert sharding.shard(frame(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=4), st.booleans())
def test_flac_round_trip(payloads, with_lpc):
    padded = [flac.payload_of(p) for p in payloads]
    streams = flac.encode(padded, flac.LPC_CANDIDATES if with_lpc else ())
    for p, (info, blocks) in zip(padded, flac.decode(streams), strict=True):
        assert (np.concatenate([x[0] for _, x in blocks]) + 128).astype(np.uint8).tobytes() == p
        assert [first for first, _ in blocks] == list(range(0, len(p), 576)) and info["total"] == len(p)


def test_flac_notices_damage_and_needs_no_seek_table():
    stream = flac.encode([flac.payload_of(b"some text " * 200)])[0]
    start = flac.parse(stream)["start"]
    bare = stream[:4] + b"\x80" + stream[5:42] + stream[start:]
    assert flac.decode([bare])[0][0]["total"] == 2304
    for at in (start + 3, start + 60, len(stream) - 1):
        with pytest.raises(ValueError):
            flac.decode([stream[:at] + bytes([stream[at] ^ 4]) + stream[at + 1 :]])


def test_flac_media_columns(spark):
    texts = ["", None, "abc", "é" * 1000]
    docs = frame(spark, texts)
    rows = {r.doc_id: r for r in flac.digest_media(flac.encode_media(docs)).collect()}
    for i, t in enumerate(texts):
        want = flac.payload_of((t or "").encode())
        assert (rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    blocks = flac.decode_blocks(flac.encode_media(docs)).where("doc_id = 3").orderBy("block_no").collect()
    assert [b.first_sample for b in blocks] == [0, 576, 1152, 1728]


@pytest.mark.parametrize("part_words", [1_000_000, 2])
def test_token_counts_match_the_library(spark, monkeypatch, part_words):
    monkeypatch.setattr(token_counts, "PART_WORDS", part_words)
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["It's a Test, isn't it?", "a <|endoftext|> b<|startoftext|>", "", None, "x_y__z 12²½ 日本語 İstanbul ΑΣ", "\x1c a\x85b\xa0c ªº 🙂", "word " * 5000, "l’été œuvre ǅ ﬁ", "It's a Test, isn't it?"]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame(spark, texts), path).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


def test_piece_codec_matches_sentencepiece(spark):
    import sentencepiece

    path = piece_codec.model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello world", " a", "a  b", "日本語 🙂 \x00 x\n\n\ty", "<s> </s> <0x41>", "", None, "é́ ñandú", "word " * 3000]
    rows = piece_codec.encode_documents(frame(spark, texts), path, verify_every=1)
    got = {r.doc_id: r for r in rows.collect()}
    assert all(got[i].ids == library.encode(t or "") and got[i].restored for i, t in enumerate(texts))
    assert {r.doc_id: r.text for r in piece_codec.decode_ids(rows, path).collect()} == {i: t or "" for i, t in enumerate(texts)}


def edit_distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(3, 12))) for i in range(8)] + [(90, None), (91, "  ")]
    texts = [None, "", "short"]
    for _ in range(40):
        t = list(rng.choice(items[:8])[1].upper())
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[], ["z"], [t[at], "q"]])
        texts.append(prose(rng, 6) + "\n " + "".join(t) + "  " + prose(rng, 6))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        for item_id, item in items:
            item = decontaminate.normalise(item or "")
            if item and (d := edit_distance_within(item, decontaminate.normalise(t or ""))) <= int(0.1 * len(item)):
                want.add((i, item_id, d))
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(frame(spark, texts), bench, rate=0.1, block_chars=100).collect()}
    assert got == want and want
    kept = decontaminate.clean_documents(frame(spark, texts), bench, rate=0.1)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _, _ in want} and kept.columns == frame(spark, []).columns


def test_patience_blocks_are_common():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(0, 25))] for _ in range(2))
        blocks = line_dedup.patience(a, b)
        assert all(a[p : p + n] == b[q : q + n] for p, q, n in blocks)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(blocks, blocks[1:], strict=False))
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1, 2)]


def test_line_dedup(spark):
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(9)) for i in range(4))
    texts = ["intro one\n" + passage, "other intro\n" + passage + "\nown end", "short\ncommon line", "short\nelse", None, "", passage, passage]
    out = line_dedup.dedup_lines(frame(spark, texts))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: texts[0], 1: "other intro\nown end", 2: texts[2], 3: texts[3], 4: None, 5: "", 6: "", 7: ""}
    assert out.columns == [*frame(spark, []).columns, "lines_removed"]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def brute_repeats(texts, min_words):
    """Places of lines that stand in a block of ``min_words`` words of any earlier document, by comparing all blocks of all lines."""
    def blocks(text):
        lines = [(i, x.strip(), len(x.split())) for i, x in enumerate((text or "").split("\n")) if x.strip()]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(n for _, _, n in lines[i:j]) >= min_words:
                    yield tuple(x for _, x, _ in lines[i:j]), [at for at, _, _ in lines[i:j]]

    seen, out = set(), {}
    for doc_id, text in enumerate(texts):
        mine = list(blocks(text))
        out[doc_id] = {at for key, places in mine if key in seen for at in places}
        seen |= {key for key, _ in mine}
    return out


@pytest.mark.parametrize("spread", [1000, 2])
def test_line_dedup_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(line_dedup, "SPREAD", spread)
    rng = random.Random(8)
    pool = [prose(rng, n) for n in (1, 2, 3, 5, 6, 7, 8, 9, 12, 25)]
    texts = []
    for _ in range(150):
        parts = [rng.choice(pool) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 2)):
            parts += rng.choice([[], texts[-1].split("\n")[:3]]) if texts else []
        texts.append("\n".join(f" {x} " if rng.random() < 0.2 else x for x in parts))
    want = brute_repeats(texts, 20)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i].text == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i])
    assert sum(map(len, want.values())) > 100


def test_line_dedup_finds_the_holder_of_a_whole_block(spark):
    x, y = prose(random.Random(1), 12), prose(random.Random(2), 12)
    texts = ["own a\n" + x, "own b\n" + y, f"own c\n{x}\n{y}", f"own d\n{x}\n{y}"]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: texts[2], 3: "own d"}


def test_repeats_finds_passages_that_either_side_holds_twice():
    x, y, z, u, v, *p = range(8)
    for a, b, want in [([x, *p, y, *p, z], [u, *p, v], {1, 2, 3, 5, 6, 7}), ([u, *p, v], [x, *p, y, *p, z], {1, 2, 3}), ([p[1], p[2], x, p[0]], [p[0], x, p[1], p[2]], {0, 1})]:
        assert line_dedup.repeats(a, [10] * len(a), b, 20) == want
        assert line_dedup.repeats(a, [1] * len(a), b, 20) == set()


def test_license_scan(spark):
    mit = license_scan.TEMPLATES[3][1]
    texts = ["text\nReleased under the MIT License.\nmore", "x\n" + mit.replace("free of charge", "free of any charge"), "Licensed under CC BY-NC 4.0.", "the licence of poets", None, "", "Licensed under the Apache License, Version 2.0."]
    rows = license_scan.scan_licenses(frame(spark, texts)).collect()
    assert {(r.doc_id, r.license_id) for r in rows} == {(0, "MIT"), (1, "MIT"), (2, "CC-BY-NC-4.0"), (6, "Apache-2.0")}
    assert {r.doc_id: r.differences for r in rows}[1] == "+any"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", {("CC-BY-NC-4.0", 0, 1), ("all-rights-reserved", 1, 2)}),
        ("Copyright 2020 Foo.\nReleased under the MIT License.\nLicensed under CC BY 4.0.", {("MIT", 1, 2), ("CC-BY-4.0", 2, 3)}),
        ("\n".join(w for _, w in license_scan.TEMPLATES), {(n, i, i + 1) for i, (n, _) in enumerate(license_scan.TEMPLATES)}),
        ("All rights reserved.\n" * 900, {("all-rights-reserved", i, i + 1) for i in range(900)}),
    ],
)
def test_license_scan_confirms_every_notice_of_a_block(text, want):
    assert {h[:3] for h in license_scan.Scanner().scan(text)} == want


@pytest.mark.parametrize("width", [20, 40, 60, 78])
def test_license_scan_reads_wrapped_notices(width):
    scanner = license_scan.Scanner()
    for name, wording in license_scan.TEMPLATES:
        lines = ["prose before it", *textwrap.wrap(wording, width, break_long_words=False, break_on_hyphens=False), "and prose that goes on"]
        got = scanner.scan("\n * ".join(lines))
        assert [(h[0], h[1], h[2], h[5]) for h in got] == [(name, 1, len(lines) - 1, "")]


def brute_kneser_ney(counts, key):
    """Interpolated modified Kneser-Ney over packed trigrams, straight from the definition."""
    def cut(c, table):
        n = [sum(v == i for v in table.values()) for i in (1, 2, 3, 4)]
        if not all(n):
            return 0.5
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]][min(c, 3) - 1]
        return min(max(d, 0.05), min(c, 3) - 0.05)

    two = Counter(k & 0xFFFFFFFF for k in counts)
    uni = Counter(k & 0xFFFF for k in two)
    total = sum(uni.values())
    floor = sum(cut(c, uni) for c in uni.values()) / total / (len(uni) + 1)
    w, p = key & 0xFFFF, floor
    if w in uni:
        p = (uni[w] - cut(uni[w], uni)) / total + floor
    for table, k in ((two, key & 0xFFFFFFFF), (counts, key)):
        same = {x: c for x, c in table.items() if x >> 16 == k >> 16}
        if same:
            t = sum(same.values())
            p = (table[k] - cut(table[k], table) if k in table else 0) / t + sum(cut(c, table) for c in same.values()) / t * p
    return math.log(p)


def test_quality_perplexity_against_brute_force(spark):
    rng = random.Random(6)
    good = [prose(rng, 40) for _ in range(20)]
    texts = [*good, "@@## %%&& " * 20, None, ""]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15)] + [(16, 1, 1), (20, 0, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_lm.classify(frame(spark, texts), labels, prior=0).collect()}
    counts = Counter(int(k) for i in range(15) for k in ngram_blocks.trigrams(texts[i]))
    for i in (0, 17, 20, 22):
        keys = [int(k) for k in ngram_blocks.trigrams(texts[i] or "")]
        assert rows[i].perplexity == pytest.approx(math.exp(-sum(brute_kneser_ney(counts, k) for k in keys) / len(keys)), rel=1e-9)
    assert not rows[20].keep and all(rows[i].keep for i in range(20))
    none = quality_lm.classify(frame(spark, texts), labels.where("quality = 5"))
    assert none.where("not keep").count() == 0 and none.count() == len(texts)


def test_quality_rejects_words_said_over_and_over(spark):
    rng = random.Random(9)
    good = [prose(rng, 60) for _ in range(20)]
    texts = [*good, "w10 " * 300, good[0] + " " + "w2 " * 200, " ".join(w for w in WORDS[:12] for _ in range(15)), "w1 w1", None]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_lm.classify(frame(spark, texts), labels).collect()}
    assert {i for i, r in rows.items() if not r.keep} == {20, 21, 22}
    assert all(rows[i].perplexity <= rows[i].threshold for i in (20, 22))


def brute_word_losses(texts, trained):
    """Mean loss of each text under an interpolated modified Kneser-Ney model of the word pairs of the other trained texts, from tuples of words."""
    def grams(text):
        w = ["<", *re.findall("[^\x20\x09-\x0D]+", (text or "").lower()), ">"]
        return list(zip(w, w[1:], strict=False))

    def discounts(table):
        n = [sum(v == i for v in table.values()) for i in (1, 2, 3, 4)]
        if not all(n):
            return [0, 0.5, 0.5, 0.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(d, 0.05), j - 0.05) for j, d in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2])))]

    def model(some):
        two = Counter(g for i in some for g in grams(texts[i]))
        return two, Counter(w for _, w in two)

    d2, d1 = (discounts(x) for x in model(trained))
    words = len({w for t in texts for _, w in grams(t)}) + 1
    out = []
    for i, text in enumerate(texts):
        two, one = model([j for j in trained if j != i])
        total = sum(one.values())
        loss = 0
        for h, w in grams(text):
            p = (one[w] - d1[min(one[w], 3)] + sum(d1[min(c, 3)] for c in one.values()) / words) / total if total else 1 / words
            same = {g: c for g, c in two.items() if g[0] == h}
            if same:
                c = two[h, w]
                p = (c - d2[min(c, 3)] + sum(d2[min(x, 3)] for x in same.values()) * p) / sum(same.values())
            loss -= math.log(p)
        out.append(loss / len(grams(text)))
    return out


def test_cross_entropy_difference_of_words_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 150)
    rng = random.Random(10)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(25)] + ["other Wording\tother", None, "", "w1 w2 w3", "w1 w2 w3", "said only here", prose(rng, 900)]
    keys, lengths = lm_scoring.bigrams([w.encode() for w in WORDS])
    assert len(set((keys & lm_scoring.MASK).tolist())) == len(WORDS) + 1 and set(lengths.tolist()) == {2}
    rows = {r.doc_id: r for r in lm_scoring.score(frame(spark, texts), spark.createDataFrame([(i,) for i in (*range(12), 0, None, 28)], "doc_id long")).collect()}
    target, background = brute_word_losses(texts, [*range(12), 28]), brute_word_losses(texts, range(len(texts)))
    for i, t in enumerate(texts):
        assert rows[i].n_tokens == len((t or "").split()) + 1
        assert (rows[i].target_loss, rows[i].background_loss, rows[i].score) == pytest.approx((target[i], background[i], target[i] - background[i]), rel=1e-9, abs=1e-9)
    assert rows[28].background_loss < rows[30].background_loss  # said twice, said once


def test_cross_entropy_difference_without_target_or_documents(spark):
    nobody = spark.createDataFrame([], "doc_id long")
    rows = lm_scoring.score(frame(spark, ["a b", None, "a b"]), nobody).collect()
    assert len(rows) == 3 and all(r.score is None and r.target_loss is None and r.background_loss > 0 for r in rows)
    assert lm_scoring.score(frame(spark, []), nobody).count() == 0


def test_piece_codec_verifies_every_new_word(monkeypatch):
    codec = piece_codec.PieceCodec(piece_codec.model_path())
    right, agreed = codec.encode(["some words here", "some more"])
    assert agreed == [True, True]
    library = codec.other

    class Differs:
        def encode(self, texts, **options):
            if isinstance(texts, str):
                return self.encode([texts])[0]
            return [[*ids, 5] if "odd" in t else ids for t, ids in zip(texts, library.encode(texts, **options), strict=True)]

    monkeypatch.setattr(codec, "other", Differs())
    again, agreed = codec.encode(["some words here", "some more", "some odd words"])
    assert [x.tolist() for x in again[:2]] == [x.tolist() for x in right] and agreed == [True, True, False]
    assert again[2].tolist() == [*library.encode("some odd"), 5, *library.encode("words")]


@pytest.mark.parametrize("whole", [False, True])
def test_piece_codec_runs_of_spaces_are_the_backends(whole):
    rng = random.Random(6)
    codec = piece_codec.PieceCodec(piece_codec.model_path(), whole)
    texts = ["", *(t for k in range(1, 60) for t in (" " * k, "a" + " " * k, " " * k + "日本", "x\n" + " " * k + "the"))]
    texts += ["".join(rng.choice(["the", "a", " ", "  ", "\n", "\0", "é", " " * rng.randint(1, 40)]) for _ in range(rng.randint(1, 20))) for _ in range(300)]
    assert [x.tolist() for x in codec.ids(texts)] == codec.other.encode(texts)
    ids, agreed = codec.encode(texts)
    assert [x.tolist() for x in ids] == codec.other.encode(texts) and all(agreed) and codec.decode(ids) == texts
    assert [x.tolist() for x in codec.encode([""])[0]] == [[]] and codec.encode([]) == ([], [])


def test_piece_codec_compares_every_whole_text():
    codec = piece_codec.PieceCodec(piece_codec.model_path(), whole=True)
    texts = [f"some{gap}text number {i}" for i in range(100) for gap in (" ", "  ")]
    codec.encode(texts)
    codec.known = {w: ids if w != "text" and w != " text" else b"" for w, ids in codec.known.items()}
    ids, agreed = codec.encode([*texts, "some number"])
    assert [x.tolist() for x in ids] == codec.other.encode([*texts, "some number"]) and agreed == [False] * len(texts) + [True]
    assert inspect.signature(piece_codec.encode_documents).parameters["verify_every"].default == 1


def test_piece_codec_lets_words_go(monkeypatch):
    monkeypatch.setattr(piece_codec, "KNOWN_WORDS", 5)
    codec, rng = piece_codec.PieceCodec(piece_codec.model_path()), random.Random(3)
    for _ in range(30):
        texts = [prose(rng, 6) for _ in range(3)]
        assert [x.tolist() for x in codec.encode(texts)[0]] == codec.other.encode(texts)
        assert len(codec.known) <= 5 and len(codec.older) <= 5 + 18


def test_piece_codec_parses_a_model_once(monkeypatch):
    parsed, read = [], piece_codec.parse_model
    monkeypatch.setattr(piece_codec, "parse_model", lambda data: parsed.append(1) or read(data))
    codec, again = (piece_codec.PieceCodec(piece_codec.model_path(), whole=True) for _ in range(2))
    assert len(parsed) <= 1 and again.encode(["as it was"])[0][0].tolist() == codec.other.encode("as it was")


def test_piece_codec_cuts_texts_as_a_plain_loop_does():
    codec, rng, mark = piece_codec.PieceCodec(piece_codec.model_path()), random.Random(8), piece_codec.MARK
    texts = ["", " ", "  ", mark, "a", " a", "a ", "a\n", "\n ", *("".join(rng.choice(["a", "日", " ", "  ", "\n", "\0", "\\1", "$", mark]) for _ in range(rng.randint(1, 12))) for _ in range(3000))]
    want = [[w[1:] for w in re.findall(" *[^ ]+| +", " " + t.replace(mark, " "))] if t else None for t in texts]
    assert codec.words(texts).to_pylist() == want and [x for t in texts for x in codec.words([t]).to_pylist()] == want
    odd = [np.array([rng.randrange(len(codec.opens)) for _ in range(rng.randint(0, 9))], np.int32) for _ in range(500)]
    raw = [b"".join(codec.bytes[i].as_py() for i in x.tolist()) for x in odd]
    assert codec.joined(odd) == [r[1:] if r[:1] == b" " else r for r in raw] and codec.decode([]) == []


def test_flac_damage_stays_with_its_own_stream(spark):
    good = flac.encode([flac.payload_of(b"abc")])[0]
    media = spark.createDataFrame([(1, 3, bytearray(good)), (2, 9, bytearray(b"fLaC broken")), (3, 0, None), (4, 5, bytearray(good[:-3])), (5, 3, bytearray(good))], "doc_id long, n_bytes long, media binary")
    rows = {r.doc_id: r for r in flac.digest_media(media).collect()}
    assert {i: r.error is None for i, r in rows.items()} == {1: True, 2: False, 3: False, 4: False, 5: True} and rows[1].payload_bytes == rows[5].payload_bytes == 576 and rows[2].feature is None
    blocks = flac.decode_blocks(media).collect()
    assert sorted((b.doc_id, b.error is None) for b in blocks) == [(1, True), (2, False), (4, False), (5, True)]


def test_pre_tokens_that_are_split_again_are_counted_alone(monkeypatch):
    import public_tokenizers

    split = token_counts.PreTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert split.pieces(["hello", "two words", "x"]).tolist() == [1, 2, 1]


def test_license_scan_tells_the_kinds_of_bsd_apart():
    texts = {n: w for n, w in license_scan.TEMPLATES if n.startswith("BSD")}
    for name, wording in texts.items():
        lines = textwrap.wrap(wording, 72)
        assert {h[0] for h in license_scan.Scanner().scan("Copyright 2019 Somebody\n\n * " + "\n * ".join(lines) + "\n\nmore prose")} == {name}


def test_near_duplicates_of_rows_without_ids(spark):
    text = prose(random.Random(1), 30)
    docs = spark.createDataFrame([(None, text), (4, text), (3, text + " w1"), (None, "said once only in this very place")], "doc_id long, text string")
    rows = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(docs).collect())
    assert rows == [("3", 27, 3), ("4", 26, 3), ("None", 3, None), ("None", 26, 3)]


def test_sharding_of_rows_without_ids_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None), (2, "a b c")], "doc_id long, text string")
    rows = sharding.shard(docs, shards=2).collect()
    assert len(rows) == 5 and all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in (0, 1))


def test_sharding_packs_as_brute_force_does():
    rng = np.random.default_rng(3)
    vectors = rng.integers(1, 100, (40, 3)).astype(float)
    share, left, want = vectors / vectors.sum(axis=0), [[1 / 4] * 3 for _ in range(4)], [0] * 40
    for i in sorted(range(40), key=lambda i: -max(share[i])):
        best = max(range(4), key=lambda s: (sum(a * b for a, b in zip(left[s], share[i], strict=True)), -s))
        want[i] = best
        left[best] = [a - b for a, b in zip(left[best], share[i], strict=True)]
    assert sharding.pack(vectors, 4).tolist() == want


def test_quality_and_decontamination_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_lm.classify(frame(spark, []), labels).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(frame(spark, ["a", None]), nothing).count() == 0 and decontaminate.find_leaks(frame(spark, []), spark.createDataFrame([(1, "abc")], "item_id long, text string")).count() == 0
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0 and license_scan.scan_licenses(frame(spark, ["All rights reserved."] * 2)).count() == 2
