"""Near-duplicates and substring removal against brute force, odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm_rows import ODD, documents, words  # noqa: F401
from patronage.llm import near_dup, registry, suffix_dedup


def shingles(text, k=5):
    w = (text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(rows):
    """{(id, text): class} by comparing all pairs of rows; null ids come last."""
    top = (1 << 63) - 1
    texts = {}
    for i, t in rows:
        t = t or ""
        texts[t] = min(texts.get(t, top), top if i is None else i)
    parent = {i: i for i in texts.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {t: shingles(t) for t in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(texts[a]), root(texts[b])))
                parent[y] = x
    return {(i, t): root(texts[t or ""]) for i, t in rows}


def edited(text, changes, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def planted(n_copies=60):
    """A group of near copies with all kinds of distances, texts that share a long
    passage but little else, exact copies, texts on their own."""
    base = " ".join(words(300, 5))
    rows = [(1000 + i, edited(base, i % 12, i)) for i in range(n_copies)]
    passage = " ".join(words(120, 6))
    rows += [(2000 + i, passage + " " + " ".join(words(130, 100 + i))) for i in range(40)]
    rows += [(3000 + i, " ".join(words(80, 500 + i // 3))) for i in range(30)]
    chain = " ".join(words(200, 7))
    for i in range(8):  # each like the one before
        chain = edited(chain, 2, 50 + i)
        rows.append((4000 + i, chain))
    return rows


@pytest.mark.parametrize("rows", [planted(), ODD, []], ids=["planted", "odd", "empty"])
def test_classes_equal_all_pairs(documents, rows):
    got = near_dup.near_duplicates(documents(rows)).collect()
    top = (1 << 63) - 1
    want = sorted((i, None if c == top else c) for (i, _), c in brute_classes(rows).items() for _ in range(1)) if not rows or None not in [r[0] for r in rows] else None
    expected = brute_classes(rows)
    if want is not None and len(set(rows)) == len(rows):
        assert sorted((r["doc_id"], r["class_id"]) for r in got) == want
    else:
        assert len(got) == len(rows)
        pairs = {(i, None if c == top else c) for (i, _), c in expected.items()}
        assert {(r["doc_id"], r["class_id"]) for r in got} == pairs


def weighted(text, k=5):
    """{shingle: share of the text's weight}, the weight of one the root of its count."""
    w = (text or "").encode().split()
    every = [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    total = sum(every.count(s) ** 0.5 for s in set(every))
    return {s: every.count(s) ** 0.5 / total for s in set(every)}


def brute_probability_jaccard(x, y):
    both = set(x) | set(y)
    return sum(1 / sum(max(x.get(z, 0) / x[s], y.get(z, 0) / y[s]) for z in both) for s in set(x) & set(y))


def test_weighted_classes_equal_all_pairs(documents):
    """Texts in which a passage comes many times: two that differ in what they say once
    are alike by weight, though not as sets, and the other way round."""
    rows = []
    for g in range(6):
        again, base = " ".join(words(12, 900 + g)), words(40, 950 + g)
        for i in range(6):
            often = again + " "
            rows.append((100 * g + i, often * (4 + 3 * (i % 3)) + edited(" ".join(base), i // 2 * 2, 20 * g + i)))
    shares = {i: weighted(t) for i, t in rows}
    sets = {i: shingles(t) for i, t in rows}
    parent, changed = {i: i for i, _ in rows}, 0
    for a, _ in rows:
        for b, _ in rows:
            if a < b:
                near = brute_probability_jaccard(shares[a], shares[b]) >= 0.8
                changed += near != (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
                if near:
                    low, high = sorted((parent[a], parent[b]))
                    parent = {i: low if p == high else p for i, p in parent.items()}
    assert changed > 0
    got = near_dup.near_duplicates(documents(rows), power=near_dup.POWER).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == parent


def test_one_of_each_class_stays(documents):
    rows = planted()
    df = documents([*rows, rows[0], rows[0]], clashing=True)  # a row three times
    out = near_dup.drop_near_duplicates(df)
    kept = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert out.columns == df.columns
    assert sorted(kept) == sorted(set(brute_classes(rows).values()))


def test_sketch_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    b = np.unique(np.concatenate([a[60:], rng.integers(0, 1 << 63, 40, dtype=np.uint64)]))
    for power in (0, 1):
        wa, wb = (rng.integers(1, 6, len(x)).astype(float) ** power for x in (a, b))
        exact = near_dup.probability_jaccard((a, wa), (b, wb))
        union = {int(x): [0.0, 0.0] for x in np.concatenate([a, b])}
        for x, w in zip(a, wa):
            union[int(x)][0] = w
        for x, w in zip(b, wb):
            union[int(x)][1] = w
        plain = sum(1 / sum(max(p / x, q / y) for p, q in union.values()) for x, y in union.values() if x and y)
        assert exact == pytest.approx(plain)
        hits = near_dup.prob_minhash(a, wa, 20_000) == near_dup.prob_minhash(b, wb, 20_000)
        assert hits.mean() == pytest.approx(exact, abs=0.015)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r["_id"]: r["comp"] for r in near_dup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_cut(rows):
    top = (1 << 63) - 1
    raws = [(top if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, raw in raws:
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            first[w] = min(first.get(w, top + 1), i)
    out = []
    for (i, raw), (real, _) in zip(raws, rows):
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((real, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def overlapping():
    rng = random.Random(3)
    source = " ".join(words(400, 8))
    rows = []
    for i in range(40):
        at = rng.randrange(len(source) - 400)
        size = rng.choice([48, 49, 50, 51, 99, 130, 300])
        rows.append((i, " ".join(words(20, 900 + i)) + source[at : at + size] + " ".join(words(15, 950 + i)) + source[at : at + size][:60]))
    rows += [(100, source), (101, source), (5, source), (200, "ab" * 200), (201, "ab" * 100 + "c"), (202, "é" * 80), (203, "xé" + "é" * 60)]
    rows += [(300, "x" * 49), (301, "x" * 49), (302, "y" * 50), (303, "y" * 50), (303, "y" * 70)]
    return rows


@pytest.mark.parametrize("rows", [overlapping(), ODD, []], ids=["overlapping", "odd", "empty"])
def test_cut_equals_brute_force(documents, rows):
    got = suffix_dedup.substring_digest(documents(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_cut(rows)


def test_cut_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = registry.QUERIES["op5_suffix_dedup"](spark, SF_SMALL).collect()
    assert sorted(map(tuple, got), key=str) == brute_cut(rows)


def test_small_segments_and_chunks_change_nothing(documents, monkeypatch):
    data = np.frombuffer(" ".join(words(900, 2)).encode(), dtype=np.uint8)
    whole = suffix_dedup.samples(data)
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 97)
    parts = suffix_dedup.samples(data)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert whole[3][-1] == len(data) - 50 and (whole[2][1:] == whole[3][:-1] + 1).all()


def test_cut_keeps_columns(documents):
    df = documents(overlapping(), clashing=True)
    out = suffix_dedup.drop_repeated_substrings(df)
    assert out.columns == df.columns and out.count() == len(overlapping())
    assert {r["kind"] for r in out.select("kind").distinct().collect()} == {"extra kind"}
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0
