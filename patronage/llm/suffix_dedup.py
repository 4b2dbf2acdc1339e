"""Removal of byte strings that an earlier document has, by sampled suffixes.

Every byte covered by a WINDOW-byte string that also starts in a document with a
smaller doc_id goes. Comparing all suffixes would shuffle WINDOW times the text,
so, as in induced sorting, only sampled suffixes are compared and the others
follow from them: the sample of a window is its least KMER-byte string (by hash,
the leftmost of equal ones). Equal windows have equal samples at equal places,
so a repeated window always shows up at its sample. Each step is a Spark
shuffle of compressed arrays, sorted on disk by Spark; a task holds one
partition of one of them:

1. samples: per text the samples in order. Samples found in two texts of one
   task are known to repeat; of those a task sends one marker, of the rest the
   hash and the number. Dealt by hash, samples seen twice or marked are kept.
2. suffix tuples: the kept samples meet their texts (both dealt by document); a
   tuple is the sample with the bytes that its windows reach on both sides. Of equal tuples in one task only the smallest document's goes on, the
   others are settled on the spot.
3. windows: tuples dealt by sample; for each of the places that a window can
   have around its sample the windows are sorted, and those with a smaller
   document are marked. The marked ones around one sample overlap, so each
   tuple gives one span.
4. cutting: spans meet the texts, overlapping ones are merged, the rest is kept.

Exact copies are found beforehand by the hash of the text and never enter step 2.

Defined results: a null text is empty; texts shorter than WINDOW bytes lose
nothing; rows that repeat a doc_id never cut each other; a null doc_id comes
after all others; an empty table gives an empty result; all other columns, of
any name, are returned untouched. A text cut inside a character loses the rest
of that character in ``text`` (not in ``kept``, which is bytes).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, digest128, id_column, mix, powers, short_batches, shuffle_partitions, text_column

WINDOW = 50
KMER = 16
REACH = WINDOW - KMER  # bytes that a window can have on either side of its sample
TUPLE = KMER + 2 * REACH
#: Bytes of text whose samples a task holds at a time, and tuples held before they are sent.
CHUNK_BYTES = 16 << 20
CHUNK_TUPLES = 50_000
_SEGMENT = (1 << 20) - 2 * WINDOW
_PLACE = np.uint64((1 << 20) - 1)


# --- samples ---------------------------------------------------------------------


def samples(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, first, last) of the samples of all windows, by place; the
    windows whose sample it is start at first..last."""
    n = len(data)
    if n < WINDOW:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    found = []
    for s in range(0, n - WINDOW + 1, _SEGMENT):  # windows that start in one segment
        part = data[s : s + _SEGMENT + WINDOW - 1]
        m = len(part) - KMER + 1
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * powers(len(part)), out=sums[1:])
        each = mix((sums[KMER:] - sums[:-KMER]) * powers(m, inverse=True))
        # hash and place in one number: the least is the leftmost of the least hashes
        least = (each & ~_PLACE) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < REACH + 1:
            least = np.minimum(least[: width - REACH - 1], least[REACH + 1 - width :])
        at = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        found.append((at[first] + s, each[at[first]], first + s, last + s))
    if len(found) == 1:
        return found[0]
    places, hashes, first, last = (np.concatenate(c) for c in zip(*found))
    starts = _runs(places)  # the last sample of a segment may be the first of the next
    return places[starts], hashes[starts], first[starts], np.maximum.reduceat(last, starts)


# --- arrays in rows ----------------------------------------------------------------

_PACK = zstandard.ZstdCompressor(level=3)
_UNPACK = zstandard.ZstdDecompressor()


def _compress(text: str) -> bytes:
    return _PACK.compress(text.encode())


def _decompress(payload: bytes) -> bytes:
    return _UNPACK.decompress(payload)


def _blob(*columns: np.ndarray) -> bytes:
    n = np.array([len(columns[0])], dtype="<i8").tobytes()
    return _PACK.compress(n + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _columns(blobs: list[bytes], *kinds: tuple[str, int]) -> list[np.ndarray]:
    """The columns of several blobs, each put together; a kind is (dtype, values a row)."""
    found: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        raw = _UNPACK.decompress(blob)
        n, at = int(np.frombuffer(raw, "<i8", 1)[0]), 8
        for k, (kind, per) in enumerate(kinds):
            size = n * per * np.dtype(kind).itemsize
            found[k].append(np.frombuffer(raw[at : at + size], kind))
            at += size
    return [np.concatenate(f) if f else np.zeros(0, kind) for f, (kind, _) in zip(found, kinds)]


def _by_part(part: np.ndarray, *columns: np.ndarray):
    """(part, blob of its rows) for each part, the rows in their order."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(part)]):
        rows = order[a:b]
        yield int(part[rows[0]]), _blob(*(c[rows] for c in columns))


_ROWS = "part int, kind int, rid long, id long, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (part, kind, payload)."""
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
            pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([r[2] for r in rows], pa.binary()),
        ],
        ["part", "kind", "rid", "id", "payload"],
    )


#: Kinds of rows: whole copies come first, arrays before texts.
COPY, ARRAY, MARKER, READY, TEXT = range(5)


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)


def _spread(per_run: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(per_run, np.diff(np.append(starts, n)))


# --- step 1 --------------------------------------------------------------------------


def _dealt(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, low, high): the part that a hash is dealt to and 40 more bits of it.
    Parts grow in number with the data, so within one the bits go on sufficing;
    two samples taken for one only cost a comparison in step 3."""
    rest = hashes // np.uint64(parts)
    return (hashes % np.uint64(parts)).astype(np.int64), rest.astype("<u4"), (rest >> np.uint64(32)).astype("u1")


def _send_samples(parts: int):
    def flush(held):
        hashes = np.concatenate([h for h, _ in held])
        rids = np.concatenate([np.full(len(h), r, dtype=np.int64) for h, r in held])
        numbers = np.concatenate([np.arange(len(h), dtype="<u4") for h, _ in held])
        order = np.argsort(hashes, kind="stable")  # rows of a hash stay in the order of texts
        starts = _runs(hashes[order])
        if not len(starts):
            return
        ends = np.append(starts[1:], len(order)) - 1
        twice = rids[order][starts] != rids[order][ends]
        known = np.zeros(len(hashes), dtype=bool)
        known[order] = _spread(twice, starts, len(order))
        out = []
        part, low, high = _dealt(hashes[order][starts[twice]], parts)
        for p, blob in _by_part(part, low, high):
            out.append((p, MARKER, blob))
        part, low, high = _dealt(hashes[~known], parts)
        for p, blob in _by_part(part, low, high, rids[~known], numbers[~known]):
            out.append((p, ARRAY, blob))
        for p, blob in _by_part(rids[known] % parts, rids[known], numbers[known]):
            out.append((p, READY, blob))
        for i in range(0, len(out), 64):
            yield _batch(out[i : i + 64])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for rid, text in zip(b.column("rid").to_pylist(), b.column("text")):
                raw = text.as_py().encode()
                hashes = samples(np.frombuffer(raw, dtype=np.uint8))[1]
                if len(hashes):
                    held.append((hashes, rid))
                    size += len(raw)
                if size >= CHUNK_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _keep_repeated(parts: int):
    def run(batches):
        blobs = {ARRAY: [], MARKER: []}
        for b in batches:
            for part, kind, payload in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "payload"))):
                if kind == READY:
                    yield _batch([(part, ARRAY, payload)])
                else:
                    blobs[kind].append(payload)
        bits = (("<u4", 1), ("u1", 1))
        low, high, rids, numbers = _columns(blobs[ARRAY], *bits, ("<i8", 1), ("<u4", 1))
        hashes = low | high.astype(np.uint64) << np.uint64(32)
        low, high = _columns(blobs[MARKER], *bits)
        marked = np.unique(low | high.astype(np.uint64) << np.uint64(32))
        if not len(hashes):
            return
        order = np.argsort(hashes, kind="stable")
        starts = _runs(hashes[order])
        low, high = np.minimum.reduceat(rids[order], starts), np.maximum.reduceat(rids[order], starts)
        again = low != high
        if len(marked):
            own = hashes[order][starts]
            at = np.minimum(np.searchsorted(marked, own), len(marked) - 1)
            again |= marked[at] == own
        keep = np.zeros(len(hashes), dtype=bool)
        keep[order] = _spread(again, starts, len(order))
        rids, numbers = rids[keep], numbers[keep]
        for part, blob in _by_part(rids % parts, rids, numbers):
            yield _batch([(part, ARRAY, blob)])

    return run


# --- steps 2 and 3 ---------------------------------------------------------------------


def _meet(batches, *kinds):
    """One partition of arrays and texts: yields, per batch of texts, (lookup, whole
    copies, rows); lookup(rid) gives the columns of the arrays for a document."""
    copies: set[int] = set()
    blobs: list[bytes] = []
    tables = None
    for b in batches:
        kind = b.column("kind").to_numpy(zero_copy_only=False)
        rids = b.column("rid").to_pylist()
        texts = np.flatnonzero(kind == TEXT)
        for i in np.flatnonzero(kind != TEXT):
            if kind[i] == COPY:
                copies.add(rids[i])
            else:
                blobs.append(b.column("payload")[int(i)].as_py())
        if not len(texts):
            continue
        if tables is None:
            found = _columns(blobs, ("<i8", 1), *kinds)
            blobs.clear()
            order = np.argsort(found[0], kind="stable")
            tables = [c[order] for c in found]

        def lookup(rid, tables=tables):
            a = np.searchsorted(tables[0], rid, side="left")
            z = np.searchsorted(tables[0], rid, side="right")
            return [c[a:z] for c in tables[1:]]

        yield lookup, copies, b.take(pa.array(texts))


def _row_hashes(rows: np.ndarray, block: int = 4096) -> np.ndarray:
    """A 64-bit hash of each row of bytes, some rows at a time."""
    out = np.empty(len(rows), dtype=np.uint64)
    for i in range(0, len(rows), block):
        out[i : i + block] = (_BYTE[rows[i : i + block]] * powers(rows.shape[1])).sum(axis=1, dtype=np.uint64)
    return out


def _cut_tuples(parts: int):
    def flush(held):
        tuples = np.concatenate([h[0] for h in held])
        rids, ids = (np.concatenate([np.full(len(h[0]), h[k], dtype=np.int64) for h in held]) for k in (1, 2))
        places = np.concatenate([h[3] for h in held]).astype("<u4")
        low, high = (np.concatenate([h[k] for h in held]).astype("u1") for k in (4, 5))
        key = mix(_row_hashes(tuples) + low * np.uint64(256) + high)
        order = np.lexsort((ids, key))
        starts = _runs(key[order])
        first = np.empty(len(ids), dtype=np.int64)
        first[order] = _spread(ids[order][starts], starts, len(order))
        settled = ids > first
        begin = places[settled].astype(np.int64) - REACH + low[settled]
        end = places[settled].astype(np.int64) - REACH + high[settled]
        out = []
        for part, blob in _by_part(rids[settled] % parts, rids[settled], begin.astype("<u4"), end.astype("<u4")):
            out.append((part, READY, blob))
        go = ~settled
        sample = mix(_row_hashes(tuples[go, REACH : REACH + KMER]))
        part = (sample % np.uint64(parts)).astype(np.int64)
        for p, blob in _by_part(part, tuples[go], rids[go], ids[go], places[go], low[go], high[go]):
            out.append((p, ARRAY, blob))
        for i in range(0, len(out), 64):
            yield _batch(out[i : i + 64])

    def run(batches):
        held, size = [], 0
        around = np.arange(TUPLE)
        for lookup, copies, rows in _meet(batches, ("<u4", 1)):
            for rid, own, payload in zip(*(rows.column(c).to_pylist() for c in ("rid", "id", "payload"))):
                if rid in copies:
                    continue
                kept = np.unique(lookup(rid)[0])
                if not len(kept):
                    continue
                raw = _decompress(payload)
                data = np.zeros(len(raw) + 2 * REACH, dtype=np.uint8)
                data[REACH : REACH + len(raw)] = np.frombuffer(raw, dtype=np.uint8)
                places, _, first, last = (c[kept] for c in samples(data[REACH : REACH + len(raw)]))
                for i in range(0, len(places), CHUNK_TUPLES):  # a very long text fills several chunks
                    at = places[i : i + CHUNK_TUPLES]
                    low = first[i : i + CHUNK_TUPLES] - at + REACH
                    high = last[i : i + CHUNK_TUPLES] - at + REACH + WINDOW
                    bytes_around = data[at[:, None] + around]
                    bytes_around[(around < low[:, None]) | (around >= high[:, None])] = 0
                    held.append((bytes_around, rid, own, at, low, high))
                    size += len(at)
                    if size >= CHUNK_TUPLES:
                        yield from flush(held)
                        held, size = [], 0
        if held:
            yield from flush(held)

    return run


def repeated_spans(tuples: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) in each tuple of the bytes covered by windows that a tuple with
    a smaller id has at the same place; begin == end: none."""
    n = len(tuples)
    begin, end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    windows = np.empty((REACH + 1, n), dtype=np.uint64)
    back = powers(REACH + 1, inverse=True)
    for s in range(0, n, 4096):
        sums = np.zeros((min(4096, n - s), TUPLE + 1), dtype=np.uint64)
        np.cumsum(_BYTE[tuples[s : s + 4096]] * powers(TUPLE), axis=1, out=sums[:, 1:])
        windows[:, s : s + len(sums)] = mix((sums[:, WINDOW:] - sums[:, : REACH + 1]) * back).T
    for o in range(REACH + 1):
        valid = np.flatnonzero((low <= o) & (o + WINDOW <= high))
        order = valid[np.argsort(windows[o][valid], kind="stable")]
        starts = _runs(windows[o][order])
        if not len(starts):
            continue
        smallest = _spread(np.minimum.reduceat(ids[order], starts), starts, len(order))
        hit = order[ids[order] > smallest]
        begin[hit] = np.where(end[hit] > 0, begin[hit], o)
        end[hit] = o + WINDOW
    return begin, end


def _mark_windows(parts: int):
    def run(batches):
        blobs = []
        for b in batches:
            for part, kind, payload in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "payload"))):
                if kind == READY:
                    yield _batch([(part, ARRAY, payload)])
                else:
                    blobs.append(payload)
        kinds = (("u1", TUPLE), ("<i8", 1), ("<i8", 1), ("<u4", 1), ("u1", 1), ("u1", 1))
        tuples, rids, ids, places, low, high = _columns(blobs, *kinds)
        blobs.clear()
        if not len(rids):
            return
        begin, end = repeated_spans(tuples.reshape(-1, TUPLE), ids, low.astype(np.int64), high.astype(np.int64))
        hit = end > begin
        at = places[hit].astype(np.int64) - REACH
        for part, blob in _by_part(rids[hit] % parts, rids[hit], (at + begin[hit]).astype("<u4"), (at + end[hit]).astype("<u4")):
            yield _batch([(part, ARRAY, blob)])

    return run


# --- step 4 ------------------------------------------------------------------------------


def merge_spans(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans, in order (touching ones are one run)."""
    if not len(begin):
        return []
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    last = np.append(new[1:], len(begin)) - 1
    return list(zip(begin[new].tolist(), reach[last].tolist()))


def _cut_texts(batches):
    for lookup, copies, rows in _meet(batches, ("<u4", 1), ("<u4", 1)):
        out = []
        for rid, payload in zip(rows.column("rid").to_pylist(), rows.column("payload").to_pylist()):
            raw = _decompress(payload)
            if rid in copies:
                spans = [(0, len(raw))] if len(raw) >= WINDOW else []
            else:
                begin, end = lookup(rid)
                spans = merge_spans(begin.astype(np.int64), end.astype(np.int64))
            at, kept = 0, []
            for a, z in spans:
                kept.append(raw[at:a])
                at = z
            kept.append(raw[at:])
            out.append((len(raw), sum(z - a for a, z in spans), len(spans), b"".join(kept)))
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("row"),
                *[pa.array([r[i] for r in out], pa.int64()) for i in range(3)],
                pa.array([r[3] for r in out], pa.binary()),
                pa.array([r[3].decode("utf-8", "ignore") for r in out], pa.string()),
            ],
            ["row", "n_bytes", "n_removed", "n_spans", "kept", "text"],
        )


def _squeeze(text):
    @F.pandas_udf("binary")
    def run(texts):
        return texts.map(_compress)

    return run(text)


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (a struct of the columns of ``docs`` but for the text), n_bytes,
    n_removed, n_spans, kept (bytes) and text (the same as text)."""
    short_batches(docs.sparkSession)
    parts = shuffle_partitions(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    rows = docs.select(
        id_column(f"`{doc_id}`").alias("id"),
        text_column(f"`{text}`").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
    ).withColumn("rid", F.xxhash64("id", "text"))
    part = F.pmod("rid", F.lit(parts)).cast("int").alias("part")

    marks = rows.select("rid", "id", digest128(F.col("text")).alias("h"))
    copied = (
        marks.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
        .select("h.h1", "h.h2", "first")
    )
    whole = (
        marks.select("rid", "id", "h.h1", "h.h2").join(copied, ["h1", "h2"]).where("id > first")
        .select(part, F.lit(COPY).alias("kind"), "rid", "id", F.lit(None).cast("binary").alias("payload"))
    )
    texts = rows.select(part, F.lit(TEXT).alias("kind"), "rid", "id", _squeeze("text").alias("payload"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartitionById(parts, F.col("part")).sortWithinPartitions("kind")

    sent = rows.select("rid", "text").mapInArrow(_send_samples(parts), _ROWS)
    kept = sent.repartitionById(parts, F.col("part")).mapInArrow(_keep_repeated(parts), _ROWS)
    tuples = dealt(kept.union(whole).union(texts)).mapInArrow(_cut_tuples(parts), _ROWS)
    spans = tuples.repartitionById(parts, F.col("part")).mapInArrow(_mark_windows(parts), _ROWS)
    with_row = rows.select(part, F.lit(TEXT).alias("kind"), "rid", "id", _squeeze("text").alias("payload"), "row")
    no_row = F.lit(None).cast(rows.schema["row"].dataType).alias("row")
    final = dealt(spans.union(whole).select("*", no_row).union(with_row))
    kind = rows.schema["row"].dataType.simpleString()
    return final.mapInArrow(_cut_texts, f"row {kind}, n_bytes long, n_removed long, n_spans long, kept binary, text string")


def drop_repeated_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in its own columns, the texts without what earlier documents have
    (and ``n_chars``, where there is such a column, set anew)."""
    out = dedup_substrings(docs, doc_id, text)
    values = {c: F.col(f"row.`{c}`") for c in docs.columns if c != text}
    values[text] = F.col("text")
    if "n_chars" in values:
        values["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[values[c].alias(c) for c in docs.columns])


def substring_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = dedup_substrings(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
