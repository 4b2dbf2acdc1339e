"""Fill-in-the-middle, spelling variants and SimHash against brute force, odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_rows import ODD, documents, words  # noqa: F401
from patronage.llm import fill_middle, simhash, spelling

# --- fill in the middle -------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 17, 64, 1000, 30_000])
def test_skip_list_finds_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 90, n)
    units, before = fill_middle.SkipList(widths), np.concatenate([[0], np.cumsum(widths)])
    ranks = range(n + 1) if n <= 1000 else [*random.Random(1).sample(range(n + 1), 300), 0, n]
    assert [units.chars_before(r) for r in ranks] == [before[r] for r in ranks]
    assert len(units.lanes) <= 2 + np.log2(n + 1)
    assert n == 0 or all(len(spans) for spans, _, _ in units.lanes)
    for wrong in (-1, n + 1):
        with pytest.raises(IndexError):
            units.chars_before(wrong)


def test_skip_list_takes_few_steps():
    class Counted(list):
        looked = 0

        def __getitem__(self, i):
            Counted.looked += 1
            return super().__getitem__(i)

    units = fill_middle.SkipList(np.ones(100_000, dtype=np.int64))
    units.lanes = [(Counted(spans), widths, down) for spans, widths, down in units.lanes]
    for rank in range(0, 100_000, 997):
        units.chars_before(rank)
    assert Counted.looked / 101 < 150


@pytest.mark.parametrize("text", ["", "a", "\n", "\n\n", "a\n", "a\nb", "é\n日本\n😀x", "x" * 1000 + "\n"])
def test_unit_widths(text):
    assert fill_middle.unit_widths(text.encode()).tolist() == [len(u) for u in re.findall(r"[^\n]*\n|[^\n]+", text)]


def brute_fill(doc_id, text, percent=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (doc_id, n, "plain", None, None, t, t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t)
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t)


FILL = [
    *ODD, (20, "has <P> inside\nand more"), (21, "<S>"), (22, "a\nb<M>\n"), (23, "<P"), (24, "<\n>\n<P\n>"), (25, "no line feed"),
    *[(100 + i, "\n".join(f"línea {i} {k} 日本" for k in range(i)) + "\n" * (i % 3)) for i in range(40)],
    (140, "a line\n" * 50_000),
]


@pytest.mark.parametrize("percent,spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_fill_brute_force(documents, percent, spm):
    for rows in (FILL, []):
        made = fill_middle.fill_in_middle(documents(rows), percent=percent, spm_percent=spm)
        back = fill_middle.restore(F.col("output"), F.col("form"))
        got = made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back.alias("back")).collect()
        assert sorted(map(tuple, got), key=str) == sorted((brute_fill(i, t, percent, spm) for i, t in rows), key=str)


def test_fill_digest_and_columns(documents):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    df = documents(FILL, clashing=True)
    got = sorted(map(tuple, fill_middle.fill_digest(df).collect()), key=str)
    want = [brute_fill(i, t) for i, t in FILL]
    assert got == sorted(((*w[:5], sha(w[5]), sha(w[6])) for w in want), key=str)
    made = fill_middle.fill_in_middle(df)
    assert made.schema["row"].dataType.names == df.columns
    assert made.where("row.doc_id = 4").select("row.n", "n").collect()[0][:] == ("extra n", 1)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("markers", [("", "b", "c"), ("a\n", "b", "c"), ("ab", "bc", "d"), ("aa", "b", "c"), ("x<P>", "<P>", "c"), ("a", "a", "b")])
def test_markers_that_cannot_be_read_back(markers):
    with pytest.raises(ValueError):
        fill_middle.checked_markers(markers)


def test_other_markers(documents):
    marks = ("[pre]", "[suf]", "[mid]")
    rows = [(i, "[pr\ne]\n[suf\n]<P>\n[" * i) for i in range(12)] + [(50, "x [mid] y")]
    made = fill_middle.fill_in_middle(documents(rows), markers=marks)
    got = made.select("row.text", fill_middle.restore(F.col("output"), F.col("form"), marks).alias("back"), "form").collect()
    assert all(r.text == r.back for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}


# --- spelling variants ----------------------------------------------------------------


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_groups(rows, every=97, min_chars=5, min_count=3):
    counts = Counter()
    for i, t in rows:
        lower = "".join(c.lower() if c.isascii() else c for c in t or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if every and h % every == 0 else w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= min_chars and c >= min_count}
    near = {w: [v for v in n if brute_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def variants(seed, n_words=60, n_docs=60):
    """Texts in which words come with misspellings, more or less often."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(4, 9))) for _ in range(n_words)]
    base += ["straße", "ÀÉÎÕÜ", "naïveté", "x" * 63, "x" * 64, "x" * 65, "x" * 64 + "y", "ab" * 200, "ab" * 200 + "c"]

    def change(w):
        i, c = rng.randrange(len(w)), rng.choice("abcdéz")
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])

    pool = []
    for w in base:
        pool += [w] * rng.choice([1, 3, 8, 20])
        for _ in range(4):
            pool += [change(w)] * rng.choice([1, 2, 3, 4])
    pool += ["qqaaaa"] * 6 + ["qqaaab"] * 18 + ["qqaabb"] * 50  # a way of two steps
    rng.shuffle(pool)
    return [(i, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in pool[i::n_docs])) for i in range(n_docs)]


@pytest.mark.parametrize("limit", [spelling.FILTER_BYTES, 0])
def test_spelling_brute_force(documents, limit):
    """Also with filters of one block each, which let nearly all through."""
    for seed in (1, 2):
        rows = variants(seed)
        got = spelling.spelling_groups(documents(rows, clashing=True), limit=limit).collect()
        want = brute_groups(rows)
        assert sorted(map(tuple, got), key=str) == want
        assert any(r[1] for r in want) and any(r[2] != r[1] for r in want if r[1])


def test_spelling_odd_rows(documents):
    again = [(i, (t or "") + " repeat repea Repeatt same sane " * 4) for i, t in ODD] + ODD
    for rows in (ODD, again, []):
        got = spelling.spelling_groups(documents(rows)).collect()
        assert sorted(map(tuple, got), key=str) == brute_groups(rows)


def test_spelling_options(documents):
    rows = variants(3)
    got = spelling.spelling_groups(documents(rows), every=0, min_chars=3, min_count=1).collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(rows, 0, 3, 1)


def test_a_word_across_stretches(monkeypatch):
    text = "abc défg ÷hij klmno" * 50
    want = Counter(re.findall("[A-Za-zÀ-ÿ]+", text))
    for size in (1, 3, 7, 100):
        monkeypatch.setattr(spelling, "STRETCH", size)
        assert spelling.runs(text) == want


def test_edit_hashes_are_those_of_the_edits(monkeypatch):
    monkeypatch.setattr(spelling, "PROBES", 40)
    names = ["abca", "aabb", "zzzz", "éabc"]
    _, codes = next(spelling.by_length(names))
    of = lambda w: tuple(spelling.hashes(np.array([[ord(c) for c in w]], dtype=np.uint32))[:, 0].tolist())
    got = {(int(r), a, b) for row, (x, y) in spelling.deletions(codes) for r, a, b in zip(row, x.tolist(), y.tolist())}
    assert got == {(r, *of(w[:i] + w[i + 1 :])) for r, w in enumerate(names) for i in range(4)}
    letters = np.array(sorted(map(ord, "abcé")), dtype=np.uint32)
    got = [
        (int(r), a, b)
        for row, x, second in spelling.replacements(codes, letters)
        for r, a, b in zip(row, x.tolist(), second(np.arange(len(x))).tolist())
    ]
    want = {(r, *of(w[:i] + c + w[i + 1 :])) for r, w in enumerate(names) for i in range(4) for c in "abcé" if c > w[i]}
    assert set(got) == want and len(got) == len(want)


def test_filters_hold_every_word_and_little_else(spark):
    names = sorted({"".join(random.Random(i).choices("abcdefgh", k=8)) for i in range(5000)})
    vocab = spelling.vocabulary(spark.createDataFrame([(w, 3) for w in names], "word string, n long"))
    sizes = spelling.filter_sizes(vocab)
    made = spelling.filters(vocab, sizes)[8]
    _, codes = next(spelling.by_length(names))
    assert len(spelling.positives(spelling.hashes(codes)[0], made)) == len(names)
    others = np.array([[ord(c) for c in f"{i:08d}"] for i in range(20_000)], dtype=np.uint32)
    assert len(spelling.positives(spelling.hashes(others)[0], made)) < 200
    assert len(spelling.positives(spelling.hashes(others)[0], None)) == 0
    assert sum(spelling.filter_sizes(vocab, 3200).values()) <= 100


# --- SimHash ------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest_reached(fps, ids, radius=3):
    u = np.unique(np.array(fps, dtype=np.uint64))
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    label = np.arange(len(u))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    of = {int(x): int(label[k]) for k, x in enumerate(u)}
    least = {}
    for x, i in zip(fps, ids):
        least[of[x]] = min(least.get(of[x], 1 << 63), i)
    return [least[of[x]] for x in fps]


def brute_classes(rows):
    top = (1 << 63) - 1
    ids = [top if i is None else i for i, _ in rows]
    fps = [brute_fingerprint(t) for _, t in rows]
    comps = smallest_reached(fps, ids)
    return sorted(((i, f"{x:016x}", None if c == top else c) for (i, _), x, c in zip(rows, fps, comps)), key=str)


def near_texts():
    rng = random.Random(4)
    rows = []
    for g in range(6):
        base = words(400, 40 + g)
        for k in range(12):
            w = list(base)
            for _ in range(k % 5):
                w[rng.randrange(len(w))] = f"new{rng.randrange(999)}"
            rows.append((100 * g + k, " ".join(w)))
    return rows + [(900 + i, " ".join(words(3 + i % 4, i % 20))) for i in range(60)]


@pytest.mark.parametrize("sizes", [{}, {"tile": 8, "tiles": 2}, {"tile": 16, "tiles": 1}])
def test_simhash_brute_force(documents, sizes):
    rows = near_texts()
    want = brute_classes(rows)
    got = simhash.simhash_classes(documents(rows, clashing=True), **sizes).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert len({r[2] for r in want}) < len({r[1] for r in want}) < len(want)


def test_simhash_odd_rows(documents):
    for rows in (ODD, [], [(None, "only one without an id here")], [(None, "a b c d"), (7, "a b c d")], ODD + near_texts()):
        got = simhash.simhash_classes(documents(rows)).collect()
        assert sorted(map(tuple, got), key=str) == brute_classes(rows)


def test_a_repeated_id_names_the_components_of_both_texts(documents):
    rows = [(5, "one two three four five six"), (5, "quite another text than that one"), (9, "one two three four five six")]
    got = simhash.simhash_classes(documents(rows)).collect()
    assert [r.component_id for r in got] == [5, 5, 5] and len({r.fingerprint for r in got}) == 2


def clustered(seed, groups, size, spread=4):
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(groups):
        base = rng.integers(0, 2**64, dtype=np.uint64)
        for _ in range(size):
            x = base
            for _ in range(rng.integers(0, spread)):
                x ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
            found.append(x)
    return np.unique(np.array(found, dtype=np.uint64))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_distances(radius):
    fps = clustered(radius, 80, 12)
    n = len(fps)
    got = set()
    for i, j in simhash.near_pairs(fps, np.arange(n) + 1, np.full(n, n), radius):
        got |= {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    assert got == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}


def test_words_beyond_the_radius_are_abandoned(monkeypatch):
    """Of random fingerprints next to none is looked at to the last plane."""
    seen = []
    real = simhash.np.flatnonzero

    def counted(x):
        out = real(x)
        seen.append((len(x), len(out)))
        return out

    fps = np.random.default_rng(3).integers(0, 2**64, 2048, dtype=np.uint64)
    planes = simhash.bit_planes(fps)
    query, word = np.repeat(np.arange(2048), 32), np.tile(np.arange(32), 2048)
    monkeypatch.setattr(simhash.np, "flatnonzero", counted)
    left, _, near = simhash.near_words(fps, planes, query, word)
    monkeypatch.undo()
    assert seen[2][1] < 0.5 * len(query) and seen[-1][1] <= 2048 + 10
    assert set(left.tolist()) == set(range(2048))  # each is within the radius of itself


@pytest.mark.parametrize("sizes", [{}, {"tile": 100, "tiles": 3}, {"tile": 32, "tiles": 4}])
def test_links_reach_all_within_the_radius(spark, sizes):
    """A cluster in which nearly all agree on most bits, and spread ones."""
    fps = np.unique(np.concatenate([clustered(1, 1, 250, 6), clustered(2, 200, 4)]))
    nodes = spark.createDataFrame([(i, x) for i, x in enumerate(fps.view(np.int64).tolist())], "id long, fp long")
    got = simhash.links(nodes, **sizes).collect()
    label = simhash.merged(np.arange(len(fps)), np.array([r.a for r in got]), np.array([r.b for r in got]))
    assert label.tolist() == smallest_reached([int(x) for x in fps], list(range(len(fps))))
    assert all(r.a < r.b for r in got)
    blocks = simhash.blocks(nodes, **sizes)
    most = blocks.groupBy("mask", "value", "low", "high").count().agg(F.max("count")).collect()[0][0]
    tile = sizes.get("tile", simhash.TILE)
    assert most <= 2 * tile + 8 * (2 * tile) ** 0.5


def test_tiles_must_cover_the_radius(spark):
    with pytest.raises(ValueError):
        simhash.blocks(spark.createDataFrame([(1, 1)], "id long, fp long"), tile=4, tiles=2)
