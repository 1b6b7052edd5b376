"""Divergence audit, importance resampling and nearest neighbours against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import divergence, importance, license_scan, lm_scoring, permutation_index

DOCS = "doc_id long, text string, lang string, source string, block long, term string, rank int, value long, score double, weight long, class long"
WORDS = [*(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)), "Été", "naïve", "x1y", "don't", "ab\x00cd", "日本"]


def rows_of(seed=3, n=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice(["", " ", "--"]) + rng.choice([" ", "\n", ", "]).join(rng.choice(WORDS[: rng.choice([20, 60, len(WORDS)])]).upper() if rng.random() < 0.2 else rng.choice(WORDS[: rng.choice([20, 60, len(WORDS)])]) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 60, 300])))
        rows.append((i, text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "c", "c", None])))
    rows += [rows[5], rows[5], (None, "no id at all " * 9, "en", "a"), (900, None, "en", "lonely"), (901, "", "fr", "only"), (902, "one two", "fr", "other"), (903, "word " * 600_000, "en", "b")]
    return [(*r, 1, "t", 2, 3, 0.5, 4, 5) for r in rows]


def brute_audit(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, kept = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        terms = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        docs[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
    for lang in docs:
        kept[lang] = {t for t, n in docs[lang].items() if n >= 3}

    def shares(lang, count):
        v = len(kept[lang])
        total = sum(count[t] for t in kept[lang])
        return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + v) for t in kept[lang]}

    p = {g: shares(g[0], c) for g, c in counts.items()}
    whole = {lang: shares(lang, sum((c for g, c in counts.items() if g[0] == lang), Counter())) for lang in docs}
    out = []
    for lang, source in counts:
        mine = p[lang, source]
        pairs = [(-sum((mine[t] - q[t]) ** 2 // q[t] for t in mine), o.encode()) for (other, o), q in p.items() if other == lang and o != source]
        q = whole[lang]
        terms = [(-((mine[t] - q[t]) ** 2 // q[t]), t.encode()) for t in mine if counts[lang, source][t] and mine[t] > q[t]]
        out += [(lang, source, "pair", item.decode(), -v, i) for i, (v, item) in enumerate(sorted(pairs), 1)]
        out += [(lang, source, "term", item.decode(), -v, i) for i, (v, item) in enumerate(sorted(terms), 1) if i <= 200]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_audit_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_BYTES", 500), ("PAIRS", 5), ("SUMS", 3)):
            monkeypatch.setattr(divergence, name, value)
    rows = rows_of()
    got = [tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DOCS).repartition(3)).collect()]
    assert sorted(got) == sorted(brute_audit(rows))


def test_audit_of_little(spark):
    empty = spark.createDataFrame([], DOCS)
    assert divergence.audit(empty).columns == ["lang", "source", "part", "item", "value", "rank"] and divergence.audit(empty).count() == 0
    nothing_kept = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, "en", "t"), (3, "c", "de", "u")], "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(nothing_kept).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def brute_features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c | 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return len(words), [zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(rows, target):
    made = [brute_features(r[1]) for r in rows]
    s, t = Counter(x for _, f in made for x in f), Counter(x for text in target for x in brute_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for (doc, *_), (n, f) in zip(rows, made, strict=True):
        weight = sum(gain[b] for b in f)
        h = doc is not None and int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, n, len(f), weight, None if doc is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((x for x in out if x[1] >= 20 and x[4] is not None), key=lambda x: (-x[4], x[0]))
    drawn = defaultdict(list)
    for i, x in enumerate(may[: 5 * len(may) // 100], 1):
        drawn[x].append(i)
    return sorted((repr((*x[:5], drawn[x].pop(0) if drawn[x] else None)) for x in out))


@pytest.mark.parametrize("size", [8 << 20, 700])
def test_resample_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(importance, "BLOCK_BYTES", size)
    rows = rows_of(seed=8, n=200)
    target = ["wa wb wc", None, "", "Été naïve wa", "日本 x1y don't " * 30]
    items = spark.createDataFrame([(i, t, 7) for i, t in enumerate(target)], "item_id long, text string, bucket int")
    got = importance.resample(spark.createDataFrame(rows, DOCS).repartition(3), items)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_resample(rows, target)


def test_tuples_are_hashed_once_a_block(monkeypatch):
    hashed = []
    monkeypatch.setattr(importance, "crc32", lambda x: hashed.append(x) or zlib.crc32(x))
    importance.features([b"a b a b a b", b"A b, c"])
    assert sorted(hashed) == sorted([b"a", b"b", b"c", b"a b", b"b a", b"b c", b"a b a", b"b a b", b"a b c"])


def test_resample_of_little(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in importance.resample(docs, none).orderBy("doc_id").collect()] == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert importance.resample(docs.limit(0), none).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, file int, h long, class long"


def vectors(seed, n, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, width))
    return [(i, (centres[i % 15] + 0.6 * rng.normal(size=width)).astype(np.float32).tolist()) for i in range(n)]


def brute_nearest(rows, queries):
    seen = {(i, tuple(v)): np.array(v, np.float64) for i, v in rows}
    out = {}
    for q, v in {(i, tuple(v)) for i, v in rows if i in queries}:
        pairs = sorted((-float(np.cumsum(seen[q, v] * x)[-1]), i) for (i, _), x in seen.items() if i != q)
        out[q] = [(i, -s + 0.0) for s, i in pairs[:20]]
    return out


def searched(spark, rows, every=20):
    found = defaultdict(list)
    made = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], VECTORS).repartition(3)
    for r in permutation_index.nearest(made, F.col("vec_id") % every == 0).orderBy("query_id", "rank").collect():
        assert r.rank == len(found[r.query_id]) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return found


def test_neighbours_recall_and_scores(spark):
    rows = vectors(1, 2500)
    want, got = brute_nearest(rows, {i for i, _ in rows if i % 20 == 0}), searched(spark, rows)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    at = {i: np.array(v, np.float64) for i, v in rows}
    assert all(s == float(np.cumsum(at[q] * at[i])[-1]) for q in got for i, s in got[q])
    assert all(x == sorted(x, key=lambda y: (-y[1], y[0])) for x in got.values())


def test_neighbours_with_copies_are_exact_when_all_files_are_visited(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "_tuned", lambda probed: (1 << 20, 1 << 20))
    monkeypatch.setattr(permutation_index, "CHUNK_ROWS", (7, 7))
    monkeypatch.setattr(permutation_index, "SLICE_ROWS", 3)
    rows = vectors(2, 300)
    rows += [(1000 + i, rows[40][1]) for i in range(200)] + [(2000 + i, [-x for x in rows[40][1]]) for i in range(30)] + [rows[7], rows[7]]
    assert searched(spark, rows) == brute_nearest(rows, {i for i, _ in rows if i % 20 == 0})


def test_neighbours_that_are_copies_of_vectors_without_a_pivot(spark):
    """Unit vectors are equally far from all pivots but one at most, so their representations are alike."""
    rng = np.random.default_rng(5)
    rows = [(i, np.eye(50)[k].tolist()) for i, k in enumerate(rng.integers(0, 50, 1200))]
    want, got = brute_nearest(rows, {i for i, _ in rows if i % 20 == 0}), searched(spark, rows)
    assert all(len(dict(got[q]).keys() & dict(want[q]).keys()) >= 18 for q in want)


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [-0.0, 2.0]), (4, [3.0, 1.0]), (40, None), (60, [0.0, -0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (140, []), (160, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    got = searched(spark, rows)
    assert dict(got) == {0: [(4, 3.0), (3, 0.0), (20, 0.0)], 20: [(3, 4.0), (4, 2.0), (0, 0.0)]}
    assert not searched(spark, [(1, [1.0, 2.0])]) and not searched(spark, [(20, None)]) and not searched(spark, [(20, [1.0, 2.0])])


def test_footrule_is_the_footrule_distance():
    rng = np.random.default_rng(4)
    q, r = (np.argsort(rng.normal(size=(n, 16)), axis=1)[:, :6].astype(np.uint16) for n in (9, 30))
    near = permutation_index.footrule(q, r, 16)
    place = lambda x: np.array([[list(row).index(p) if p in row else 6 for p in range(16)] for row in x])
    distance = np.abs(place(q)[:, None, :] - place(r)[None, :, :]).sum(2)
    assert (distance == 6 * 7 - 2 * near).all()


def test_rare_words_are_one_unknown_word_and_no_others_meet(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[min(299, int(rng.expovariate(0.02)))] for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    counts = Counter(w for t in texts for w in t.split())
    sizes = Counter(counts.values())
    least, places = 1, 40
    for n in sorted(sizes, reverse=True):
        if sizes[n] > places:
            least = n + 1
            break
        places -= sizes[n]
    frequent = {w for w, n in counts.items() if n >= least}
    assert 10 < len(frequent) <= 40 < len(counts)
    frame = lambda ts: spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(i,) for i in range(0, 60, 4)], "doc_id long")
    replaced = {r.doc_id: r for r in lm_scoring.score(frame([" ".join(w if w in frequent else "rare" for w in t.split()) for t in texts]), target).collect()}
    monkeypatch.setattr(lm_scoring, "MOST_WORDS", 40)
    for r in lm_scoring.score(frame(texts), target).collect():
        other = replaced[r.doc_id]
        assert r.n_tokens == other.n_tokens and r.score == pytest.approx(other.score, abs=1e-9) and r.background_loss == pytest.approx(other.background_loss, abs=1e-9)


def test_many_words_keep_numbers_of_their_own(spark):
    docs = spark.range(100).select("id", F.array_join(F.transform(F.sequence(F.col("id") * 2500, F.col("id") * 2500 + 2499), lambda i: F.concat(F.lit("word"), i.cast("string"))), " ").alias("text"))
    from foliospark.llm._common import Scratch

    known = lm_scoring.frequent_words(docs.select(F.col("id").alias("doc_id"), "text"), Scratch(spark, "words"))
    assert len(known) == 250_000
    keys, _ = lm_scoring.bigrams([b"word0 word249999 nowhere word77", b"word100"], known)
    tokens = (keys & lm_scoring.MASK).tolist()
    assert tokens[2] == lm_scoring.UNKNOWN and tokens[4] == tokens[6] == lm_scoring.END and len({tokens[0], tokens[1], tokens[3], tokens[5]}) == 4 and min(tokens[0], tokens[1], tokens[3], tokens[5]) >= 4


def test_compression_decides_between_wordings(monkeypatch):
    text = "\n".join(w for _, w in license_scan.TEMPLATES)
    want = {(n, i, i + 1) for i, (n, _) in enumerate(license_scan.TEMPLATES)}
    assert {h[:3] for h in license_scan.Scanner().scan(text)} == want and len({n for n, _ in license_scan.TEMPLATES}) >= 40
    monkeypatch.setattr(license_scan.Scanner, "saved", lambda self, i, raw: 0)
    assert {h[:3] for h in license_scan.Scanner().scan(text)} != want


@pytest.mark.parametrize(("text", "want"), [
    ("SPDX-License-Identifier: AGPL-3.0", "AGPL-3.0"), ("Eclipse Public License - v 2.0", "EPL-2.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3", "AGPL-3.0"), ("Licensed under the BSD 3-Clause license.", "BSD-3-Clause"),
    ("european union public licence v. 1.2", "EUPL-1.2"), ("some prose about licensing terms and permission slips", None), ("x " * 300_000 + "SPDX-License-Identifier: Zlib " + "y " * 300_000, "Zlib"),
])
def test_names_and_tags(text, want):
    assert [h[0] for h in license_scan.Scanner().scan(text)] == ([want] if want else [])


def test_a_text_of_many_megabytes(spark):
    """One text of 6 MB among short ones goes through each operator on texts whole."""
    from foliospark.llm import decontaminate, line_dedup, quality_lm, shingle_join

    rng = random.Random(9)
    lines = [" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(90_000)]
    long = "\n".join(lines)
    item = " ".join(lines[60_000:60_003])
    texts = [long, "short one", "\n".join([*lines[70_000:70_010], "an ending of its own"]), long + " more"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    near = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(docs).collect()}
    assert near == {0: 0, 1: 1, 2: 2, 3: 0}
    cut = {r.doc_id: r.lines_removed for r in line_dedup.dedup_lines(docs).collect()}
    assert cut[0] == 0 and cut[2] == 10 and cut[3] >= 89_999
    left = decontaminate.clean_documents(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [1, 2]
    assert quality_lm.classify(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 4
    weights = {r.doc_id: r.n_features for r in importance.resample(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert weights[0] == 3 * 90_000 * 12 - 3
