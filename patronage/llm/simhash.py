"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has 64 bits: each is the majority of that bit over the XXH64
of all its shingles (runs of WORDS words, repeats included). Two fingerprints of at
most RADIUS differing bits are linked; the components of these links are the classes.

Equal fingerprints are one node, so copies never meet. The nodes are compared
within buckets that agree on a set of bits (``mask``):

* Pigeonhole: two fingerprints that differ in at most RADIUS bits agree on one of
  RADIUS + 1 parts of any cut of the bits. Buckets start with all bits open; a
  bucket with more than TILE * TILES members is dealt again, by each of the RADIUS + 1
  parts of its open bits. Every pair within the radius meets in a bucket at every
  level, so nothing is lost, and buckets end at TILE members once few bits are open.
* A bucket of up to TILES tiles is cut into tiles of about TILE members (by a hash of
  the fingerprint), and every two tiles meet in a task: blocks of bounded size,
  however many fingerprints a bucket has.
* In a block the fingerprints stand as 64 bit planes: plane b holds bit b of 64
  candidates in each word. For a fingerprint the differing bits of 64 candidates at
  a time come from one exclusive or a plane, and are added to carry-save counters
  (ones, twos, and more than three, kept as three words). After every few planes the
  words whose candidates are all beyond the radius are abandoned.
* A block gives a spanning set of its links (each member and the smallest one it is
  connected to in the block), at most one row a member, never all pairs.

Result: one row per document with its fingerprint and ``component_id``, the
smallest doc_id that can be reached from it.

Defined results: null and blank texts have fingerprint zero, linked like any
other; a text of fewer than WORDS words has one shingle, the whole; rows that
repeat a doc_id are compared by their own texts and each keep their component; a
null doc_id comes after all others, its component_id is null if nothing else is in
its component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, cut, id_column, slices, text_column
from .near_dup import components

WORDS = 3
SEED = 42
RADIUS = 3
BITS = 64
#: Fingerprints of a tile (about), and tiles of the largest bucket that is compared whole.
TILE, TILES = 1024, 32
#: Planes between two looks at what can be abandoned; words compared at a time.
STEP, WORDS_AT_ONCE = 8, 1 << 15

_BIT = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


# --- fingerprints ---------------------------------------------------------------


def simhash(raw: bytes, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    import xxhash

    found = raw.lower().split()  # of bytes: A-Z only, and the six ASCII blanks only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    k = min(words, len(found))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(starts), 8192):
        spans = zip(starts[i : i + 8192], ends[i : i + 8192])
        h = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BIT[2 * counts > len(starts)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, fp): the id (NULL_ID for null) and the fingerprint as a signed long."""

    def run(batches):
        for b in slices(batches):
            found = np.array([simhash(t.as_py().encode("utf-8")) for t in b.column("_text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(found.view(np.int64))], ["_id", "fp"])

    rows = docs.select(id_column(f"`{doc_id}`").alias("_id"), text_column(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, "_id long, fp long")


# --- comparison of a block ----------------------------------------------------------


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of words: bit i of word w of plane b is bit b of fingerprint 64 w + i.
    The last word is filled up with zeros."""
    padded = np.zeros(-(-len(fps) // 64) * 64, dtype=np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near_words(fps: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int = RADIUS):
    """For pairs of a fingerprint (``query``, an index) and a word of candidates:
    those left with a candidate within the radius, and these candidates as bits."""
    limit = 4 - (radius + 1)  # the counters start there, so that four means beyond the radius
    full = ~np.uint64(0)
    ones = np.full(len(query), full if limit & 1 else 0, dtype=np.uint64)
    twos = np.full(len(query), full if limit & 2 else 0, dtype=np.uint64)
    beyond = np.zeros(len(query), dtype=np.uint64)
    own = fps[query]
    for b in range(BITS):
        differs = planes[b, word] ^ (np.uint64(0) - ((own >> np.uint64(b)) & np.uint64(1)))
        carry = ones & differs
        ones ^= differs
        beyond |= twos & carry
        twos ^= carry
        if b % STEP == STEP - 1 and b < BITS - 1:
            going = np.flatnonzero(beyond != full)  # the others: all candidates beyond the radius
            if len(going) < len(query):
                query, word, own = query[going], word[going], own[going]
                ones, twos, beyond = ones[going], twos[going], beyond[going]
                if not len(query):
                    break
    return query, word, ~beyond


def near_pairs(fps: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int = RADIUS):
    """Yield index pairs (i, j), j in first[i]..last[i]-1, of at most ``radius``
    differing bits (and any others in the words that span these)."""
    planes = bit_planes(fps)
    low, high = first // 64, np.where(last > first, -(-last // 64), first // 64)
    count = high - low
    total = np.concatenate([[0], np.cumsum(count)])
    for start in range(0, int(total[-1]), WORDS_AT_ONCE):
        place = np.arange(start, min(start + WORDS_AT_ONCE, int(total[-1])))
        query = np.searchsorted(total, place, side="right") - 1
        query, word, near = near_words(fps, planes, query, low[query] + place - total[query], radius)
        has = np.flatnonzero(near)
        bits = np.unpackbits(near[has].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        i, j = query[has][row], word[has][row] * 64 + bit
        real = (j < len(fps)) & (i != j)
        yield i[real], j[real]


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each member's is the index of a smaller or the same member of its
    class) after the links (i, j)."""
    while True:
        a, b = label[i], label[j]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def block_links(ids: np.ndarray, fps: np.ndarray, block: np.ndarray, tile: np.ndarray, radius: int = RADIUS):
    """Spanning links (a, b) within the blocks of sorted rows. ``block``: a number
    that changes from block to block; ``tile``: 0, or 1 for the second tile of a
    block of two. In blocks of two the first tile is compared with the second."""
    n = len(fps)
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
    at = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    end = edges[1:][at]
    second = edges[:-1] + np.add.reduceat(tile == 0, edges[:-1]) if n else edges[:-1]  # where the second tile begins
    two = (tile[edges[1:] - 1] == 1)[at]
    first = np.where(two, second[at], np.arange(n) + 1)
    last = np.where(two & (tile == 1), first, end)
    label = np.arange(n)
    for i, j in near_pairs(fps, np.minimum(first, last), last, radius):
        label = merged(label, i, j)
    linked = np.flatnonzero(ids[label] != ids)  # a node may stand in several blocks
    return ids[label[linked]], ids[linked]


# --- buckets ------------------------------------------------------------------------


def _parts_of(mask: int, radius: int) -> list[int]:
    """The masks that follow ``mask``: it and one of radius + 1 parts of its open bits."""
    open_bits = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << int(b) for b in part) for part in np.array_split(open_bits, radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, tiles: int = TILES) -> DataFrame:
    """(id, fp, mask, value, low, high, side): every node of ``nodes`` (id, fp) in
    all blocks that it is compared in. A block is one bucket (mask, value), or two
    of its tiles (low, high; ``side`` is 1 in the second)."""
    if tile * tiles < 1 << (radius + 1):  # so that a bucket that is dealt again has more open bits than the radius
        raise ValueError(f"{tiles} tiles of {tile} are too few for radius {radius}")
    ready, rows = [], nodes.withColumn("mask", F.lit(0).cast("long"))
    while True:
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        # keys in a struct, so that the join deals the rows anew and can split a heavy bucket
        sizes = rows.groupBy(F.struct("mask", "value").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
        sizes = sizes.select("k.mask", "k.value", "n")
        rows = cut(rows.join(sizes, ["mask", "value"]).select("id", "fp", "mask", "value", "n"))
        ready.append(rows.where(F.col("n") <= tile * tiles))
        rows = rows.where(F.col("n") > tile * tiles)
        masks = [r.mask for r in rows.select("mask").distinct().collect()]  # (radius + 1) ** level at most
        if not masks:
            break
        parts = [[_signed(p) for p in _parts_of(m % (1 << BITS), radius)] for m in sorted(masks)]
        choice = F.create_map(*[x for m, ps in zip(sorted(masks), parts) for x in (F.lit(m), F.array(*map(F.lit, ps)))])
        rows = rows.select("id", "fp", F.explode(F.element_at(choice, F.col("mask"))).alias("mask"))
    found = ready[0]
    for more in ready[1:]:
        found = found.union(more)
    count = F.ceil(F.col("n") / tile)
    own = F.pmod(F.xxhash64("fp"), F.col("count")).cast("int")
    return (
        found.withColumn("count", count)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1)))
        .select(
            "id", "fp", "mask", "value",
            F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
    )


def links(nodes: DataFrame, radius: int = RADIUS, **sizes) -> DataFrame:
    """(a, b): links between the ids of ``nodes`` (id, fp) that give the components
    of all pairs within the radius."""
    key = ["mask", "value", "low", "high"]
    dealt = blocks(nodes, radius, **sizes).repartition(*key).sortWithinPartitions(*key, "side", "id")

    def run(batches):
        kept: list[pa.RecordBatch] = []  # whole blocks wait until enough rows are there

        def compare(table: pa.Table):
            col = lambda c: table.column(c).to_numpy()
            keys = [col(c) for c in key]
            new = np.zeros(table.num_rows, dtype=np.int64)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            fps = np.ascontiguousarray(col("fp")).view(np.uint64)
            a, b = block_links(col("id"), fps, np.cumsum(new), col("side"), radius)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        def same(x: pa.RecordBatch, i: int, y: pa.RecordBatch, j: int) -> bool:
            return all(x.column(c)[i] == y.column(c)[j] for c in key)

        for batch in batches:
            if not batch.num_rows:
                continue
            if kept and sum(b.num_rows for b in kept) >= 1 << 14:
                # the block at the end of what is kept may go on in this batch
                tail = 0
                while tail < batch.num_rows and same(kept[-1], kept[-1].num_rows - 1, batch, tail):
                    tail += 1
                if tail < batch.num_rows:
                    yield compare(pa.Table.from_batches([*kept, batch.slice(0, tail)]))
                    kept, batch = [], batch.slice(tail)
            kept.append(batch)
        if kept:
            yield compare(pa.Table.from_batches(kept))

    return dealt.select("id", "fp", *key, "side").mapInArrow(run, "a long, b long").distinct()


def simhash_classes(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    rows = cut(fingerprints(docs, doc_id, text))
    nodes = cut(rows.groupBy("fp").agg(F.min("_id").alias("id")))
    # an id that names two nodes (rows that repeat it): nodes need names of their own
    named = nodes.withColumn("node", F.monotonically_increasing_id())
    repeated = not nodes.groupBy("id").count().where("count > 1").isEmpty()
    named = cut(named if repeated else nodes.withColumn("node", F.col("id")))
    found = cut(links(named.select(F.col("node").alias("id"), "fp"), radius, **sizes))
    named = named.select(F.struct("fp").alias("k"), "id", "node")
    if found.isEmpty():
        of_node = named.select("k", F.col("id").alias("component"))
    else:
        comp = components(found).toDF("node", "comp")
        joined = named.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if repeated:
            least = joined.groupBy(F.struct("comp").alias("c")).agg(F.min("id").alias("component"))
            joined = cut(joined).join(least.select("c.comp", "component"), "comp")
        else:
            joined = joined.withColumn("component", F.col("comp"))
        of_node = joined.select("k", "component")
    of_node = of_node.select("k.fp", "component")
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return rows.join(of_node, "fp").select(
        real("_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        real("component").alias("component_id"),
    )
