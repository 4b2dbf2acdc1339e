"""Near-duplicate documents by ProbMinHash, banding and verification.

A text is a weighted set of shingles (runs of WORDS words; the weight of one is
its count to the power ``power``, by default and in the registered query 0: plain
sets; with POWER what a text says again and again weighs more than what it says
once, but less than its count). ProbMinHash: every
shingle is the seed of a Poisson process whose rate is its weight; its arrivals
fall on random registers, and each register keeps the shingle of its earliest
arrival. A shingle is left as soon as its next arrival comes after the latest
register, so long texts stop after a few arrivals each. Two texts agree in a
register with the probability Jaccard of their weights (for plain sets: the
Jaccard similarity).

BANDS bands of ROWS registers make the buckets: texts of similarity 0.8 share
no bucket with probability (1 - 0.8^6)^42 < 3e-6.

Exact copies are one node (hash of the text). No group is ever paired in full:

* In every bucket each text is paired with one leader, the member with the most
  company; the pairs of all buckets are made distinct and compared exactly on
  their shingles. The links give connected components.
* Buckets that still hold several components (texts near a group, or texts that
  share a passage) need the other pairs looked at. Their texts are joined on rare
  shingles: shingles are put in one order (those of one component first, they
  cannot link two; then by the number of texts that have them), and two texts of
  similarity S must share a shingle before the last share S of either. This
  prefix is exact, so no bucket, partner or candidate is cut off. A passage that
  many texts share is too frequent to pair them if it is less than the share S of
  each; one of S to about 0.89 of each (similarity below S) still pairs them all, and
  every pair is looked at.

Result: one row per document with ``class_id``, the smallest doc_id of its class.

Defined results: null and empty texts (and any without words) are alike only if
equal; texts of fewer than WORDS words have one shingle; rows that repeat a
doc_id are one document (their classes are joined); a null doc_id is one
document after all others, its class_id null if it is alone in its class; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, cut, digest128, free_name, id_column, mix, shingle_hashes, short_batches, slices, text_column

WORDS = 5
SIMILARITY = 0.8
#: A power between plain sets and counts, for weighted classes.
POWER = 0.5
ROWS, BANDS = 6, 42
REGISTERS = ROWS * BANDS

_STEP = np.uint64(0xD1342543DE82EF95)


# --- sketch ---------------------------------------------------------------------


def weighted_shingles(text: str, words: int = WORDS, power: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted) and their weights."""
    every = shingle_hashes(text.encode("utf-8"), words)
    if not power:
        found = np.unique(every)
        return found, np.ones(len(found))
    found, counts = np.unique(every, return_counts=True)
    return found, counts.astype(np.float64) ** power


def prob_minhash(shingles: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first at each register (uint64)."""
    first = np.full(registers, np.inf)
    winner = np.zeros(registers, dtype=np.uint64)
    seed, rate, now, number = shingles, weights, np.zeros(len(shingles)), 1
    while len(seed):
        block = int(np.clip(8 * registers // len(seed), 1, 1024))  # arrivals drawn at once: enough to fill all registers
        draws = np.arange(number, number + block, dtype=np.uint64)
        number += block
        random = mix(seed[:, None] + draws[None, :] * _STEP)
        gaps = np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / -rate[:, None]
        times = now[:, None] + np.cumsum(gaps, axis=1)
        places = (mix(random) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
        flat_t, flat_p = times.ravel(), places.ravel().astype(np.int64)
        before = first.copy()
        np.minimum.at(first, flat_p, flat_t)
        won = np.flatnonzero((flat_t == first[flat_p]) & (flat_t < before[flat_p]))
        winner[flat_p[won]] = seed[won // block]
        now = times[:, -1]
        going = now < first.max()  # early termination
        seed, rate, now = seed[going], rate[going], now[going]
    return winner


_ROW_FACTORS = mix(np.arange(100, 100 + REGISTERS, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)
_BAND_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)


def band_keys(winner: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, different bands never alike."""
    mixed = mix(winner.reshape(BANDS, ROWS)) * _ROW_FACTORS
    return mix(mixed.sum(axis=1, dtype=np.uint64) + _BAND_SEEDS).view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard of two weighted sets: over the common
    elements d, the sum of 1 / sum over all d' of max(a(d')/a(d), b(d')/b(d))."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    wa, wb = a[1][i], b[1][j]
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    if (wa == wb).all():
        return float(wa.sum() / (only_a + only_b + wa.sum())) if not np.ptp(wa) else float(_by_ratio(wa, wb, only_a, only_b))
    return float(_by_ratio(wa, wb, only_a, only_b))


def _by_ratio(wa: np.ndarray, wb: np.ndarray, only_a: float, only_b: float) -> float:
    order = np.argsort(wa / wb, kind="stable")
    wa, wb = wa[order], wb[order]
    q = wa / wb
    # for element d: the others count with a(d')/a(d) where a(d')/b(d') >= q(d), else with b(d')/b(d)
    below = np.concatenate([[0.0], np.cumsum(wb)])[:-1]
    above = np.cumsum(wa[::-1])[::-1]
    first = np.searchsorted(q, q, side="left")
    return (1.0 / ((only_a + above[first]) / wa + (only_b + below[first]) / wb)).sum()


def sketches(docs: DataFrame, doc_id: str, text: str, power: float) -> DataFrame:
    """(_id, h1, h2, keys): the hash of the text and its band keys (none without words)."""
    rows = docs.select(id_column(f"`{doc_id}`").alias("_id"), text_column(f"`{text}`").alias("_text")).select(
        "_id", digest128(F.col("_text")).alias("_h"), "_text"
    ).select("_id", "_h.h1", "_h.h2", "_text")

    def run(batches):
        for b in slices(batches):
            seen: dict[int, list[int]] = {}  # a copy in the same batch is not sketched again
            out = []
            for h, t in zip(b.column("h1").to_pylist(), b.column("_text")):
                if h not in seen:
                    shingles, weights = weighted_shingles(t.as_py(), power=power)
                    seen[h] = band_keys(prob_minhash(shingles, weights)) if len(shingles) else None
                out.append(seen[h])
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("h1"), b.column("h2"), pa.array(out, pa.list_(pa.int64()))],
                ["_id", "h1", "h2", "keys"],
            )

    return rows.mapInArrow(run, "_id long, h1 long, h2 long, keys array<long>")


# --- links ----------------------------------------------------------------------


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, power: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity. ``texts``: (_id, _text)."""
    sides = pairs.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("text_a")), "a").join(
        texts.select(F.col("_id").alias("b"), F.col("_text").alias("text_b")), "b"
    )

    def run(batches):
        known: dict[str, tuple] = {}  # shingles of the last few texts: a leader comes many times

        def of(t: str):
            found = known.get(t)
            if found is None:
                if len(known) >= 64:
                    known.clear()
                found = known[t] = weighted_shingles(t, power=power)
            return found

        for batch in slices(batches):
            out = []
            for x, y in zip(batch.column("text_a"), batch.column("text_b")):
                p, q = of(x.as_py()), of(y.as_py())
                small, large = sorted((len(p[0]), len(q[0])))
                out.append(power == 0 and small < similarity * large or probability_jaccard(p, q) < similarity)
            keep = ~np.array(out, dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(_id, comp) for every id in a link: the smallest id it is connected to.
    Each round takes the smallest label among the neighbours, then the label of
    that label, so a path shortens to less than half; every round is written to
    the shared folder."""
    both = cut(links.union(links.select("b", "a")).toDF("u", "v").distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    while True:
        step = (
            both.join(labels.select(F.col("u").alias("v"), "l"), "v")
            .groupBy("u")
            .agg(F.min("l").alias("m"))
            .join(labels, "u")
            .select("u", F.least("l", "m").alias("m"), "l")
        )
        onward = labels.select(F.col("u").alias("m"), F.col("l").alias("far"))
        new = cut(step.join(onward, "m", "left").select("u", F.least("m", F.coalesce("far", "m")).alias("n"), "l"))
        labels = new.select("u", F.col("n").alias("l"))
        if new.where("n < l").isEmpty():
            return labels.toDF("_id", "comp")


def _pairs(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _shared(members: DataFrame) -> DataFrame:
    """The members (_id, key) of buckets with several ids, with the size of the bucket."""
    buckets = (
        members.groupBy(F.struct("key").alias("k"))  # a struct, so that the join deals its sides anew and can split them
        .agg(F.min("_id").alias("low"), F.max("_id").alias("high"), F.count("*").alias("n"))
        .where("low < high")
        .select("k.key", "n")
    )
    return cut(members.join(buckets, "key").select("_id", "key", "n"))


def _with_leaders(members: DataFrame) -> DataFrame:
    """(_id, leader) for every member of every bucket. The leader is the member with
    the most company over all its buckets: the text that the others were copied
    from, if there is one."""
    company = members.groupBy(F.struct("_id").alias("i")).agg(F.sum("n").alias("company")).select("i._id", "company")
    known = cut(members.join(company, "_id").select("_id", "key", "company"))
    leaders = (
        known.groupBy(F.struct("key").alias("k"))
        .agg(F.max(F.struct("company", (-F.col("_id")).alias("i"))).alias("top"))
        .select("k.key", (-F.col("top.i")).alias("leader"))
    )
    return known.join(leaders, "key").select("_id", "leader")


def _in_open_buckets(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(_id, comp) of the members of buckets with several components."""
    if comps is None:
        known = members.withColumn("comp", F.col("_id"))
    else:
        known = members.join(comps, "_id", "left").withColumn("comp", F.coalesce("comp", "_id"))
    known = cut(known.select("_id", "key", "comp"))
    buckets = known.groupBy(F.struct("key").alias("k")).agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    return known.join(buckets.where("low < high").select("k.key"), "key").groupBy("_id").agg(F.first("comp").alias("comp"))


def rare_shingle_pairs(nodes: DataFrame, texts: DataFrame, similarity: float, power: float) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (_id, comp) of different components that share a
    shingle of their prefixes: all pairs that can reach the similarity."""

    def run(batches):
        for b in slices(batches, 64):
            sets = [weighted_shingles(t.as_py(), power=power) for t in b.column("_text")]
            sizes = [len(s[0]) for s in sets]
            if sum(sizes):
                at = np.repeat(np.arange(len(sets)), sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("_id").take(pa.array(at)), b.column("comp").take(pa.array(at)),
                        pa.array(np.repeat(sizes, sizes).astype(np.int64)),
                        pa.array(np.concatenate([s[0] for s in sets]).view(np.int64)),
                        pa.array(np.concatenate([s[1] / s[1].sum() for s in sets if len(s[1])])),
                    ],
                    ["_id", "comp", "size", "shingle", "mass"],
                )

    rows = texts.join(nodes, "_id").select("_id", "comp", "_text")
    rows = rows.mapInArrow(run, "_id long, comp long, size long, shingle long, mass double")
    shared = (
        rows.groupBy(F.struct("shingle").alias("s"))
        .agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        .where("low < high")
        .select("s.shingle", "n")
    )
    own = Window.partitionBy("_id")
    onward = own.orderBy(F.desc("n"), F.desc("shingle"))  # from the last shingle back to this one
    prefix = cut(
        rows.join(shared, "shingle")
        .withColumns({"rest": F.sum("mass").over(onward), "left": F.row_number().over(onward)})
        .where(F.col("rest") >= similarity - 1e-9)
        .select("_id", "comp", "size", "shingle", "left")
    )
    pairs = prefix.alias("x").join(prefix.alias("y"), "shingle").where("x.comp < y.comp")
    if power == 0:  # sets: the overlap that the sizes ask for must fit into what is left of both
        most = F.least("x.left", "y.left") * (1 + similarity)
        pairs = pairs.where(most >= similarity * (F.col("x.size") + F.col("y.size")) - 1e-9)
    return pairs.select(*_pairs(F.col("x._id"), F.col("y._id"))).distinct()


def near_duplicate_links(
    nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, power: float = 0.0
) -> DataFrame | None:
    """(_id, comp) of the nodes (_id, keys) that are linked to another; None: no links."""
    members = _shared(nodes.select("_id", F.explode("keys").alias("key")))
    texts = cut(texts.join(members.select("_id").distinct(), "_id"))  # all texts that are compared
    pairs = _with_leaders(members).where("_id <> leader").select(*_pairs(F.col("_id"), F.col("leader"))).distinct()
    links = cut(verified(pairs, texts, similarity, power))
    comps = None if links.isEmpty() else components(links)
    rest = rare_shingle_pairs(cut(_in_open_buckets(members, comps)), texts, similarity, power)
    more = cut(verified(rest, texts, similarity, power))
    return comps if more.isEmpty() else components(links.union(more))


def classes(
    docs: DataFrame, similarity: float = SIMILARITY, power: float = 0.0, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(_id, h1, class_id) for every row: the smallest id (NULL_ID for null) of its class."""
    short_batches(docs.sparkSession)
    drawn = cut(sketches(docs, doc_id, text, power))
    # one node for each text, named by its smallest id
    by_text = cut(drawn.groupBy(F.struct("h1", "h2").alias("h")).agg(F.min("_id").alias("node"), F.first("keys").alias("keys")))
    nodes = by_text.where("keys IS NOT NULL").select(F.col("node").alias("_id"), "keys")
    texts = docs.select(id_column(f"`{doc_id}`").alias("_id"), text_column(f"`{text}`").alias("_text"))
    comps = near_duplicate_links(nodes, texts, similarity, power)
    rows = drawn.select("_id", "h1", "h2").join(by_text.select("h.h1", "h.h2", "node"), ["h1", "h2"])
    if comps is None:
        return rows.select("_id", "h1", F.col("node").alias("class_id"))
    return rows.join(comps.toDF("node", "comp"), "node", "left").select(
        "_id", "h1", F.coalesce("comp", "node").alias("class_id")
    )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, and whether it is the one
    document of its class that stays (``kept``)."""
    found = classes(docs, **options)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(
        real("_id").alias("doc_id"), real("class_id").alias("class_id"), (F.col("_id") == F.col("class_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each class (the smallest id; of rows that
    repeat that id, one)."""
    kept = classes(docs, doc_id=doc_id, **options).where("_id = class_id")
    kept = cut(kept.groupBy("_id").agg(F.min("h1").alias("h1"), F.count("*").alias("n")))
    text = options.get("text", "text")
    own_id, own_hash = free_name(docs, "near_dup_id"), free_name(docs, "near_dup_hash")
    rows = docs.withColumns({own_id: id_column(f"`{doc_id}`"), own_hash: F.xxhash64(text_column(f"`{text}`"))})
    chosen = kept.select(F.col("_id").alias(own_id), F.col("h1").alias(own_hash))
    out = rows.join(chosen, [own_id, own_hash], "left_semi")
    if not kept.where("n > 1").isEmpty():
        out = out.dropDuplicates([own_id])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
