"""Spelling variants grouped under their most frequent neighbour.

Words are the letter runs of all texts, with their number of occurrences. Two words
are near if one inserted, deleted or replaced code point makes one of the other.
A word's form is its most frequent near word if that is at least RATIO times as
frequent as the word itself; its root is where following the forms ends.

Bloom-guided neighbourhoods. The vocabulary goes into blocked Bloom filters, one
for each word length, built on the executors (a bitwise or by block) and broadcast:
at most FILTER_BYTES together, whatever the size of the vocabulary; beyond that
the filters let more through, never less. For every word all deletions and
all replacements by a later letter are generated as hashes (numpy arrays of all
words of a length, never strings) and probed on the spot, so each near pair is found
from one side only: the longer word, or the one with the earlier letter. An
insertion is the other word's deletion. Only the positives are shuffled, as two
128-bit keys, to a join with the vocabulary; the pair of words that comes out is
compared exactly, which removes the false positives of both filter and hash.

A word has at most 90 near words a position (the alphabet is that of the letter
class), so no group is large; counts are combined map-side.

Result: one row per word: word, n, form, form_n, n_near, root.

Defined results: null and empty texts have no words; rows that repeat a doc_id
count each; a null doc_id is an empty one in the key of the seeded misspellings; an
empty table gives an empty result; very long texts are read in stretches, very
long words (of any length; the longest share a filter) in stretches of positions;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, slices, text_column

#: Fixed values of the contract: the letter class, and how misspellings are seeded.
FIRST, LAST = "À", "ÿ"
RUN = re.compile(f"[A-Za-z{FIRST}-{LAST}]+")
MISSPELT_EVERY = 97
#: Code points and occurrences a word has at least; how much more frequent a form is.
MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: Bits of the filters for a word, their bytes altogether at most, and the length
#: from which words share one.
BITS_A_WORD, FILTER_BYTES, LONG = 16, 32 << 20, 64
#: Probes made at a time, and code points of a text read at a time.
PROBES, STRETCH = 1 << 19, 1 << 20

_SECOND = np.uint64(0xA0761D6478BD642F)


# --- words ------------------------------------------------------------------------


def runs(text: str) -> Counter:
    """The letter runs of a text, A-Z in lower case, with their counts."""
    found: Counter = Counter()
    text = text.encode("utf-8").lower().decode("utf-8")  # of bytes: A-Z only
    at = 0
    while at < len(text):
        end = min(at + STRETCH, len(text))
        if end < len(text) and (m := RUN.match(text, end)):
            end = m.end()
        found.update(RUN.findall(text, at, end))
        at = end
    return found


def misspelt(doc_id: str, run: str, every: int = MISSPELT_EVERY) -> str:
    """The run, or the run without a code point where the hash of both says so."""
    if every:
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % every == 0:
            at = h % len(run)
            return run[:at] + run[at + 1 :]
    return run


def word_counts(docs: DataFrame, every: int = MISSPELT_EVERY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) over all texts. ``every`` 0: the words as they are."""

    def run(batches):
        for b in slices(batches):
            total: Counter = Counter()
            for i, t in zip(b.column("_id").to_pylist(), b.column("_text")):
                for word, n in runs(t.as_py()).items():
                    total[misspelt(i, word, every)] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"]
            )

    rows = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("_id"), text_column(f"`{text}`").alias("_text")
    )
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n, h1, h2) of the words long and frequent enough, with their hash."""

    def run(batches):
        for b in batches:
            words = b.column("word").to_pylist()
            keys = np.zeros((2, len(words)), dtype=np.uint64)
            for at, codes in by_length(words):
                keys[:, at] = hashes(codes)
            yield pa.RecordBatch.from_arrays(
                [b.column("word"), b.column("n"), *[pa.array(k.view(np.int64)) for k in keys]], ["word", "n", "h1", "h2"]
            )

    kept = counts.where((F.length("word") >= min_chars) & (F.col("n") >= min_count))
    return kept.select("word", "n").mapInArrow(run, "word string, n long, h1 long, h2 long")


# --- hashes of words and of their edits ------------------------------------------------


def by_length(words: list[str]):
    """(places, code points as a matrix) of the words of each length."""
    places = defaultdict(list)
    for i, w in enumerate(words):
        places[len(w)].append(i)
    for size, at in sorted(places.items()):
        flat = "".join(words[i] for i in at).encode("utf-32-le")
        yield np.array(at), np.frombuffer(flat, dtype="<u4").reshape(len(at), size)


def _terms(codes: np.ndarray, place, seed: np.uint64) -> np.ndarray:
    """What a code point at a place adds to the hash of a word."""
    return mix((codes.astype(np.uint64) + (np.asarray(place).astype(np.uint64) << np.uint64(32))) ^ seed)


_SEEDS = (np.uint64(0), _SECOND)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes (rows) of each word: sums over its places, so that the
    hash of an edit follows from that of the word."""
    place = np.arange(codes.shape[1])
    return np.stack([_terms(codes, place, s).sum(axis=1, dtype=np.uint64) for s in _SEEDS])


def deletions(codes: np.ndarray):
    """Yield (rows, two hashes) of the words without one code point, each result once."""
    size = codes.shape[1]
    step = max(1, PROBES // max(size, 1))
    for i in range(0, len(codes), step):
        some = codes[i : i + step]
        each = []
        for s in _SEEDS:
            here = np.cumsum(_terms(some, np.arange(size), s), axis=1, dtype=np.uint64)
            moved = np.cumsum(_terms(some[:, 1:], np.arange(size - 1), s), axis=1, dtype=np.uint64)
            before = np.pad(here[:, :-1], ((0, 0), (1, 0)))
            after = moved[:, -1:] - np.pad(moved, ((0, 0), (1, 0))) if size > 1 else np.zeros_like(here)
            each.append(before + after)
        once = np.ones(some.shape, dtype=bool)
        once[:, :-1] = some[:, :-1] != some[:, 1:]  # of a run of one letter, its last
        row, _ = np.nonzero(once)
        yield row + i, np.stack([x[once] for x in each])


def replacements(codes: np.ndarray, alphabet: np.ndarray):
    """Yield (rows, first hashes, second hash by place in these) of the words with one
    letter replaced by a later one."""
    size, letters = codes.shape[1], len(alphabet)
    rows = max(1, min(len(codes), PROBES // letters))
    places = max(1, PROBES // (letters * rows))
    for i in range(0, len(codes), rows):
        some = codes[i : i + rows]
        whole = hashes(some)
        for j in range(0, size, places):
            part = some[:, j : j + places]
            later = alphabet[None, None, :] > part[:, :, None]
            place = np.arange(j, j + part.shape[1])
            new = [_terms(alphabet[None, :], place[:, None], s) for s in _SEEDS]
            old = [_terms(part, place, s) for s in _SEEDS]
            row, at, letter = np.nonzero(later)
            first = (whole[0][:, None] - old[0])[row, at] + new[0][at, letter]

            def second(kept, row=row, at=at, letter=letter, whole=whole, old=old, new=new):
                r, p = row[kept], at[kept]
                return whole[1][r] - old[1][r, p] + new[1][p, letter[kept]]

            yield row + i, first, second


# --- blocked Bloom filters --------------------------------------------------------------


def probe_bits(h: np.ndarray, blocks: int):
    """The block of a hash, and its two bits in each of the block's four words."""
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bits, one = mix(h), np.uint64(1)
    words = [
        (one << ((bits >> np.uint64(12 * k)) & np.uint64(63))) | (one << ((bits >> np.uint64(12 * k + 6)) & np.uint64(63)))
        for k in range(4)
    ]
    return block.astype(np.int64), words


def filter_sizes(vocab: DataFrame, limit: int = FILTER_BYTES) -> dict[int, int]:
    """Blocks (of 32 bytes) of the filter of each length: BITS_A_WORD bits a word,
    less where all together would exceed ``limit``."""
    length = F.least(F.length("word"), F.lit(LONG))
    counts = {r["length"]: r["count"] for r in vocab.groupBy(length.alias("length")).count().collect()}  # LONG rows at most
    wanted = sum(counts.values()) * BITS_A_WORD / 256
    share = min(1.0, max(0.0, limit / 32 - len(counts)) / wanted) if wanted else 1.0
    return {k: 1 + int(n * BITS_A_WORD / 256 * share) for k, n in counts.items()}


def filters(vocab: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """The filters: for each length its blocks as rows of four 64-bit words."""

    def run(batches):
        for b in batches:
            words = b.column("word").to_pylist()
            h = b.column("h1").to_numpy().view(np.uint64)
            shard = np.fromiter((min(len(w), LONG) for w in words), dtype=np.int64, count=len(words))
            for k in np.unique(shard):
                block, bits = probe_bits(h[shard == k], sizes[int(k)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(block), k)), pa.array(block), *[pa.array(x.view(np.int64)) for x in bits]],
                    ["shard", "block", "w0", "w1", "w2", "w3"],
                )

    rows = vocab.select("word", "h1").mapInArrow(run, "shard long, block long, w0 long, w1 long, w2 long, w3 long")
    found = rows.groupBy("shard", "block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)]).toArrow()
    made = {k: np.zeros((n, 4), dtype=np.uint64) for k, n in sizes.items()}
    shard, block = found.column("shard").to_numpy(), found.column("block").to_numpy()
    words = np.stack([found.column(f"w{k}").to_numpy().view(np.uint64) for k in range(4)], axis=1)
    for k, blocks in made.items():
        blocks[block[shard == k]] = words[shard == k]
    return made


def positives(h: np.ndarray, blocks: np.ndarray | None) -> np.ndarray:
    """Places of the hashes that the filter lets through."""
    if blocks is None:
        return np.zeros(0, dtype=np.int64)
    block, bits = probe_bits(h, len(blocks))
    left = np.flatnonzero((blocks[block, 0] & bits[0]) == bits[0])
    for k in range(1, 4):
        want = bits[k][left]
        left = left[(blocks[block[left], k] & want) == want]
    return left


# --- near pairs -------------------------------------------------------------------------


def letters(vocab: DataFrame) -> np.ndarray:
    """The letters of the vocabulary, in order (90 at most)."""
    found = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()
    return np.array(sorted(ord(r["c"]) for r in found if r["c"]), dtype=np.uint32)


def candidates(vocab: DataFrame, limit: int = FILTER_BYTES) -> DataFrame:
    """(a1, a2, b1, b2): hashes of words and of those edits that the filters let through."""
    sizes = filter_sizes(vocab, limit)
    alphabet = letters(vocab)
    shared = vocab.sparkSession.sparkContext.broadcast(filters(vocab, sizes))

    def run(batches):
        known = shared.value

        def record(own, row, first, second):
            arrays = [own[0][row], own[1][row], first, second]
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in arrays], ["a1", "a2", "b1", "b2"])

        for b in slices(batches, 4096):
            for _, codes in by_length(b.column("word").to_pylist()):
                own, size = hashes(codes), codes.shape[1]
                shorter, same = known.get(min(size - 1, LONG)), known.get(min(size, LONG))
                for row, (first, second) in deletions(codes):
                    left = positives(first, shorter)
                    yield record(own, row[left], first[left], second[left])
                for row, first, second in replacements(codes, alphabet):
                    left = positives(first, same)
                    yield record(own, row[left], first[left], second(left))

    return vocab.select("word").mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")


def near_pairs(vocab: DataFrame, limit: int = FILTER_BYTES) -> DataFrame:
    """(word, n, near, near_n): every near pair of the vocabulary, from one side."""
    if vocab.isEmpty():
        return vocab.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n"))
    side = lambda x: vocab.select(
        F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("word").alias(f"{x}w"), F.col("n").alias(f"{x}n")
    )
    found = cut(candidates(vocab, limit)).join(side("b"), ["b1", "b2"]).join(side("a"), ["a1", "a2"])
    exact = found.where(F.levenshtein("aw", "bw", 1) == 1)
    return exact.select(
        F.col("aw").alias("word"), F.col("an").alias("n"), F.col("bw").alias("near"), F.col("bn").alias("near_n")
    )


def with_forms(vocab: DataFrame, pairs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word of the vocabulary."""
    best = F.struct((-F.col("near_n")).alias("less"), "near").alias("best")
    both = pairs.select("word", best).union(
        pairs.select(F.col("near").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("near")))
    )
    seen = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    none = F.lit(None).cast("struct<less:long,near:string>")
    rows = seen.withColumn("n", F.lit(None).cast("long")).unionByName(
        vocab.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.alias("best"))
    )
    one = rows.groupBy("word").agg(F.max("n").alias("n"), F.max("n_near").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    return one.select(
        "word", "n", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` with ``root``. A form is at least RATIO times as frequent, so the
    way up ends after at most log n steps; each round doubles the steps taken."""
    up = cut(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        onward = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = cut(up.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"))
        up = new.select("word", "root")
        if new.where(F.col("further").isNotNull()).isEmpty():
            break
    return forms.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    ratio: float = RATIO,
    every: int = MISSPELT_EVERY,
    limit: int = FILTER_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of all texts."""
    vocab = cut(vocabulary(word_counts(docs, every, doc_id, text), min_chars, min_count))
    forms = cut(with_forms(vocab, near_pairs(vocab, limit), ratio))
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")


#: DuckDB SQL for spelling_groups over ``documents`` (the CRC-32 from its polynomial).
ORACLE_SQL = r"""
WITH RECURSIVE tab AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
    FROM documents
), counted AS (
    SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs GROUP BY ALL
), hashed AS (
    SELECT run, c, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda s, b: xor(s >> 8, tab.t[(xor(s, b) & 255) + 1]))) AS h
    FROM counted, tab
), spelt AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
           sum(c)::BIGINT AS n
    FROM hashed GROUP BY ALL
), words AS (
    SELECT word, n FROM spelt WHERE length(word) >= 5 AND n >= 3
), cuts AS (
    SELECT word, n, unnest(range(length(word))) AS pos FROM words
), short AS (
    SELECT word, n, pos, substr(word, 1, pos) || substr(word, pos + 2) AS rest FROM cuts
), near AS (
    SELECT a.word, b.word AS other, b.n AS m FROM short a JOIN short b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
    UNION SELECT s.word, w.word, w.n FROM short s JOIN words w ON s.rest = w.word
    UNION SELECT w.word, s.word, s.n FROM short s JOIN words w ON s.rest = w.word
), best AS (
    SELECT word, count(*) AS n_near, max(m) AS top, min(other ORDER BY other) FILTER (is_top) AS other
    FROM (SELECT *, m = max(m) OVER (PARTITION BY word) AS is_top FROM near) GROUP BY word
), forms AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN other END AS form,
           CASE WHEN top >= 2 * n THEN top END AS form_n
    FROM words LEFT JOIN best USING (word)
), climb AS (
    SELECT word, word AS top, form AS next FROM forms
    UNION ALL SELECT c.word, f.word, f.form FROM climb c JOIN forms f ON f.word = c.next
)
SELECT f.word, f.form, c.top AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN climb c ON c.word = f.word AND c.next IS NULL
"""
