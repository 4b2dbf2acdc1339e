"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes (its value at a byte depends on the 32
bytes up to it, so chunking finds its feet again after an edit). A chunk ends
where the top bits of the hash are zero; normalised chunking asks for more zero
bits before the average length than after it, which keeps lengths close to the
average. The fingerprint is the sorted set of (chunk digest, chunk length), and
containment is the length of the chunks of one text that the other has too,
over all its length.

Defined results: a null text is empty; an empty text has an empty fingerprint,
equal (1.0) to another empty one and unlike (0.0) all else; repeated rows are
documents of their own; null ids come before all others in the order by
descending id; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_column, mix, short_batches, shuffle_partitions, slices, span_hashes, text_column

MINIMUM, AVERAGE, MAXIMUM = 16, 64, 256
STRICT_BITS, LOOSE_BITS = 8, 4
_GEAR = (mix(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of the gear values of the last 32
    bytes, each shifted by its distance, built by doubling the window."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks, the last one the end of the data."""
    n = len(data)
    if n <= MINIMUM:
        return [n] if n else []
    h = gear(data)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
    strict = loose[h[loose] >> np.uint32(32 - STRICT_BITS) == 0].tolist()
    loose = loose.tolist()
    out, at, i, j, n_strict, n_loose = [], 0, 0, 0, len(strict), len(loose)
    while n - at > MINIMUM:
        i = bisect_left(strict, at + MINIMUM - 1, i)
        if i < n_strict and strict[i] < at + AVERAGE:
            at = strict[i] + 1
        else:
            j = bisect_left(loose, at + AVERAGE - 1, j)
            if j < n_loose and loose[j] < at + MAXIMUM:
                at = loose[j] + 1
            else:
                at = min(at + MAXIMUM, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunk_set(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted chunk digests (each once) and the lengths of the chunks."""
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    ends = np.array(boundaries(data), dtype=np.int64)
    starts = np.concatenate([ends[:0], [0], ends[:-1]])[: len(ends)].astype(np.int64)
    digests, first = np.unique(span_hashes(data, starts, ends), return_index=True)
    return digests, (ends - starts)[first]


def as_text(chunks: tuple[np.ndarray, np.ndarray]) -> str:
    """20 hex digits a chunk: 16 of the digest, 4 of the length."""
    rows = np.zeros(len(chunks[0]), dtype=[("d", ">u8"), ("n", ">u2")])
    rows["d"], rows["n"] = chunks
    return rows.tobytes().hex()


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(bytes.fromhex(fingerprint), dtype=[("d", ">u8"), ("n", ">u2")])
    return rows["d"].astype(np.uint64), rows["n"].astype(np.int64)


def containment(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Length of the chunks of ``a`` that ``b`` has, over the length of all chunks of ``a``."""
    if not len(a[0]):
        return float(not len(b[0]))
    return float(a[1][np.isin(a[0], b[0], assume_unique=True)].sum() / a[1].sum())


def fingerprint_column(text):
    """The fingerprint of a text column."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.fillna("").map(lambda t: as_text(chunk_set(t)))

    return run(text)


def containment_column(a, b):
    """Containment of one fingerprint column in another."""

    @F.pandas_udf("double")
    def run(x, y):
        return pd.Series([containment(from_text(p or ""), from_text(q or "")) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Rows in partitions of neighbouring ids: each partition holds a range of ids
    in descending order, and at its end (``_guard``) a copy of the document after
    the last one. One shuffle of the ids finds the ranges (two numbers a range go
    to the driver), one shuffle of the texts puts them there."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(
        id_column(f"`{doc_id}`").alias("_id"), F.col(f"`{doc_id}`").alias("doc_id"), text_column(f"`{text}`").alias("text")
    )
    n = shuffle_partitions(spark)
    ranges = rows.select("_id").repartitionByRange(n, "_id").groupBy(F.spark_partition_id().alias("p"))
    ranges = sorted((r["low"], r["high"]) for r in ranges.agg(F.min("_id").alias("low"), F.max("_id").alias("high")).collect())
    lows = np.array([r[0] for r in ranges], dtype=np.int64)
    guards = {r[1]: (i + 1) % len(ranges) for i, r in enumerate(ranges)}
    kind = rows.schema["doc_id"].dataType.simpleString()

    def place(batches):
        for b in slices(batches):
            ids = b.column("_id").to_numpy(zero_copy_only=False)
            part = np.searchsorted(lows, ids, side="right") - 1
            extra = np.array([i for i, x in enumerate(ids.tolist()) if x in guards], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(np.zeros(len(ids), bool)), *b.columns],
                ["_part", "_guard", "_id", "doc_id", "text"],
            )
            if len(extra):
                more = b.take(pa.array(extra))
                to = [guards[x] for x in ids[extra].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array(np.ones(len(to), bool)), *more.columns],
                    ["_part", "_guard", "_id", "doc_id", "text"],
                )

    placed = rows.mapInArrow(place, f"_part int, _guard boolean, _id long, doc_id {kind}, text string")
    ordered = placed.repartitionById(max(n, len(ranges)), F.col("_part")).sortWithinPartitions(
        "_part", "_guard", F.desc("_id"), "text"
    )
    return ordered, kind


def edit_digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (see ``edited``; the next
    document is the one of the next smaller id, after the last the first)."""
    ordered, kind = neighbours(docs)

    def run(batches):
        last = None  # (part, guard, doc_id, text, chunks) of the row before
        for b in slices(batches):
            out = []
            for part, guard, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("_part", "_guard", "doc_id", "text"))):
                if guard and last is not None and last[1] and last[0] == part:
                    continue  # a second row with the id of the neighbour
                chunks = chunk_set(text)
                if last is not None and not last[1] and last[0] == part:
                    changed = edited(last[3], text)
                    of_changed = chunk_set(changed) if changed != last[3] else last[4]
                    out.append(
                        (
                            last[2], len(last[3]), hashlib.sha256(changed.encode()).hexdigest(), as_text(last[4]),
                            as_text(of_changed), containment(last[4], of_changed), containment(last[4], chunks),
                        )
                    )
                last = (part, guard, doc_id, text, chunks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in out], b.schema.field("doc_id").type),
                    pa.array([r[1] for r in out], pa.int64()),
                    *[pa.array([r[i] for r in out], pa.string()) for i in (2, 3, 4)],
                    *[pa.array([r[i] for r in out], pa.float64()) for i in (5, 6)],
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return ordered.mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
