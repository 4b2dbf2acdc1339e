"""Best-fit packing of tokenised documents by bin completion.

Documents are tokenised where they lie (one pass, whole texts). Pieces as long
as a sequence are sequences of their own. The others go by hash into shards of
about SHARD pieces (the number of shards grows with the data, the size of one
does not), and each shard is packed on its histogram of lengths:

* best-fit decreasing gives the first solution (the incumbent);
* bin completion tries to beat it: the longest piece left opens a sequence, the
  undominated fillings around it are tried in order of waste (a filling is
  dominated if another takes larger pieces in the same room), and a branch ends
  when the waste so far is more than one sequence less than the incumbent
  allows, or no solution can have fewer sequences than the sum of lengths or the
  number of pieces of some length and more needs. The fillings come one at a time
  from a table of subset sums, whatever the lengths;
* NODES bounds the search in a shard (a node is one filling looked at); the
  incumbent is always a whole solution.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; a null doc_id stays null; an empty table gives no pieces; other
columns are not read.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, short_batches, slices, text_column

SHARD = 16_384
NODES = 20_000

# --- tokens ---------------------------------------------------------------------

_ENCODERS: dict[str, object] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary file writes for each byte: visible
    Latin-1 characters stand for themselves, the rest are numbered from U+0100."""
    out, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def encoder(path: str):
    """Text -> ids by a byte-level BPE file of the tokenizers library, the strings of
    its added tokens taken as their ids as the library does; loaded once a worker.
    The merges are run by tiktoken, which gives the same ids about five times as fast."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        added = spec.get("added_tokens", ())
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: added tokens that take their surroundings along are not supported")
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        _ENCODERS[path] = partial(encoding.encode, allowed_special="all")
    return _ENCODERS[path]


def cut_points(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of ``length`` but for the first."""
    first = n % length or length
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


def token_pieces(
    docs: DataFrame, path: str, length: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, ``_row`` (a number
    of its own) and, on demand, ``ids`` (little-endian unsigned 32-bit)."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_column(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode, number = encoder(path), TaskContext.get().partitionId() << 33
        for b in slices(batches):
            at, out, numbers, blobs = [], [], [], []
            for i, t in enumerate(b.column("text")):
                ids = np.array([*encode(t.as_py()), end_id], dtype="<u4")
                for k, (start, size) in enumerate(cut_points(len(ids), length)):
                    blob = ids[start : start + size].tobytes()
                    at.append(i)
                    out.append((k, start, size, zlib.crc32(blob)))
                    numbers.append(number)
                    number += 1
                    if with_ids:
                        blobs.append(blob)
            columns = [
                b.column("doc_id").take(pa.array(at, pa.int32())),
                pa.array([x[0] for x in out], pa.int32()),
                *[pa.array([x[j] for x in out], pa.int64()) for j in (1, 2, 3)],
                pa.array(numbers, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_row"]
            if with_ids:
                columns.append(pa.array(blobs, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, _row long"
    return rows.mapInArrow(run, schema + (", ids binary" if with_ids else ""))


# --- packing of one shard ---------------------------------------------------------


def best_fit(counts: dict[int, int], room: int) -> list[list[int]]:
    """Best-fit decreasing on a histogram of lengths; lists of lengths."""
    open_rooms: list[int] = []  # sorted rooms that are left
    by_room: dict[int, list[list[int]]] = {}
    bins: list[list[int]] = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            i = bisect_left(open_rooms, size)
            if i == len(open_rooms):
                b: list[int] = []
                bins.append(b)
                left = room - size
            else:
                old = open_rooms.pop(i)
                b = by_room[old].pop()
                left = old - size
            b.append(size)
            if left:
                insort(open_rooms, left)
                by_room.setdefault(left, []).append(b)
    return bins


class _Left:
    """Pieces left, by length: a histogram, a bit mask of the lengths there are,
    and for each length the sums (as bits) that pieces up to it make.

    The sums are not kept up as pieces are taken: sums of more pieces than there
    are left include all that can be made, so ``_exact`` may follow one in vain but
    misses none. After a few in vain the table is made anew for the node at hand,
    and holds until the search goes back before that node."""

    VAIN, TABLES = 4, 32

    def __init__(self, counts: dict[int, int], room: int):
        self.counts, self.mask, self.room = dict(counts), sum(1 << s for s in counts), room
        self.depth = self.vain = 0
        self.tables = [(0, self._sums())]

    def _sums(self) -> list[int]:
        out, full = [1], (2 << self.room) - 1
        for s in range(1, self.room + 1):
            sums, n, step = out[-1], min(self.counts.get(s, 0), self.room // s), 1
            while n > 0:
                sums |= (sums << s * min(step, n)) & full
                n -= step
                step *= 2
            out.append(sums)
        return out

    def makes(self, most: int, total: int) -> int:
        """Whether pieces up to ``most`` may make ``total``."""
        return self.tables[-1][1][most] >> total & 1

    def in_vain(self) -> None:
        self.vain += 1
        if self.vain >= self.VAIN:
            self.vain = 0
            if len(self.tables) > self.TABLES:
                del self.tables[1]  # an older one holds as well
            self.tables.append((self.depth, self._sums()))

    def at(self, depth: int) -> None:
        """The search is at the node of this depth."""
        self.depth = depth
        while self.tables[-1][0] > depth:
            self.tables.pop()

    def largest(self, most: int) -> int:
        """The largest length of at most ``most`` (0: none)."""
        return (self.mask & ((2 << most) - 1)).bit_length() - 1 if most > 0 and self.mask else 0

    def take(self, sizes) -> None:
        for s in sizes:
            self.counts[s] -= 1
            if not self.counts[s]:
                self.mask ^= 1 << s

    def put(self, sizes) -> None:
        for s in sizes:
            if not self.counts[s]:
                self.mask ^= 1 << s
            self.counts[s] += 1


def _exact(left: _Left, total: int, most: int):
    """All fillings of just ``total`` by pieces up to ``most``, larger pieces first."""
    if not total:
        yield ()
        return
    found = False
    while (s := left.largest(min(most, total))) > 0 and left.makes(s, total):
        for n in range(min(left.counts[s], total // s), 0, -1):
            if left.makes(s - 1, total - n * s):
                for f in _exact(left, total - n * s, s - 1):
                    found = True
                    yield (s,) * n + f
        most = s - 1
    if not found:
        left.in_vain()


def dominates(a: tuple[int, ...], b: tuple[int, ...], steps: int = 200) -> bool:
    """Whether the pieces of ``b`` go into the rooms of the pieces of ``a`` (False
    also if ``steps`` do not tell: such a filling is tried like any other)."""
    rooms, rest = Counter(a), Counter(b)
    common = rooms & rest
    rooms, rest = sorted((rooms - common).elements(), reverse=True), sorted((rest - common).elements(), reverse=True)

    def place(k: int) -> bool:
        nonlocal steps
        if k == len(rest):
            return True
        for i in range(len(rooms)):
            if rest[k] <= rooms[i] and rooms[i] not in rooms[:i]:
                steps -= 1
                if steps < 0:
                    return False
                rooms[i] -= rest[k]
                if place(k + 1):
                    return True
                rooms[i] += rest[k]
        return False

    return not rest or bool(rooms) and sum(rest) <= sum(rooms) and rest[0] <= rooms[0] and len(rest) <= steps and place(0)


def fillings(left: _Left, room: int):
    """The fillings of ``room`` by what is left, least waste first and larger
    pieces first, one at a time: (sizes, waste), or None for one that is dominated
    by a filling before it (by one of the first 32, which tells nearly all)."""
    first = left.largest(room)
    if first == room:  # fills it alone and dominates all others
        yield (first,) if room else (), 0
        return
    before: list[tuple[int, ...]] = []
    for total in range(room, -1, -1):
        if not left.makes(first, total):
            continue
        for f in _exact(left, total, first):
            if any(dominates(x, f) for x in before):
                yield None
            else:
                if len(before) < 32:
                    before.append(f)
                yield f, room - total


def least_bins(counts: dict[int, int], room: int) -> int:
    """No solution has fewer bins: by the sum of lengths, and by the number of
    pieces of each length and more, of which a bin holds room // length."""
    fewest, n = -(-sum(s * k for s, k in counts.items()) // room), 0
    for s in sorted(counts, reverse=True):
        n += counts[s]
        fewest = max(fewest, -(-n // (room // s)))
    return fewest


def bin_completion(counts: dict[int, int], room: int, nodes: int = NODES) -> list[list[int]]:
    """As few bins as the search finds, never more than best fit gives."""
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, room)
    total = sum(s * n for s, n in counts.items())
    fewest = least_bins(counts, room)
    pieces = sum(counts.values())
    # the first dive alone visits a node a bin, so it never counts against the bound
    budget = nodes + len(best)
    while len(best) > fewest and budget > 0:
        allowed = (len(best) - 1) * room - total  # waste that a better solution may have
        left, waste, done = _Left(counts, room), 0, 0
        stack: list[list] = []  # [largest piece, fillings not tried, filling in use, its waste]
        deeper = True
        while budget > 0 and done < pieces:
            if deeper:
                top = left.largest(room)
                left.take((top,))
                left.at(len(stack))
                done += 1
                stack.append([top, fillings(left, room - top), (), 0])
            budget -= 1
            node = stack[-1]
            found = next(node[1], ((), allowed + 1))  # past the last one: more waste than allowed
            deeper = found is not None and waste + found[1] <= allowed
            if deeper:
                node[2], node[3] = found
                left.take(node[2])
                done += len(node[2])
                waste += node[3]
            elif found is not None:  # nothing left to try here: back up
                left.put((node[0],))
                done -= 1
                stack.pop()
                if not stack:
                    break
                left.put(stack[-1][2])
                done -= len(stack[-1][2])
                waste -= stack[-1][3]
                left.at(len(stack) - 1)
        if done < pieces:
            break
        best = [[x[0], *x[2]] for x in stack]
    return best


def pack_lengths(lengths: np.ndarray, room: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each length."""
    order = np.argsort(lengths, kind="stable")
    values, starts = np.unique(lengths[order], return_index=True)
    counts = np.diff([*starts, len(lengths)])
    at = {int(v): int(s) for v, s in zip(values, starts)}
    sequence = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    for k, sizes in enumerate(bin_completion({int(v): int(c) for v, c in zip(values, counts)}, room, nodes)):
        place = 0
        for s in sizes:
            i = order[at[s]]
            at[s] += 1
            sequence[i], offset[i] = k, place
            place += s
    return sequence, offset


# --- packing of all shards ----------------------------------------------------------


def pack(pieces: DataFrame, length: int = 2048, shard: int = SHARD, nodes: int = NODES) -> DataFrame:
    """``pieces`` (of token_pieces) with ``sequence_id`` and ``offset``."""
    pieces = cut(pieces)  # tokenised once, though read twice below
    whole = pieces.where(F.col("length") == length)
    loose = pieces.where(F.col("length") < length)
    shards = max(1, -(-loose.count() // shard))
    types = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join(f"`{k}` {v}" for k, v in types.items()) + ", sequence_id long, offset long"

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_row", kind="stable").drop(columns="_shard")
        sequence, offset = pack_lengths(group["length"].to_numpy(), length, nodes)
        return group.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    placed = (
        loose.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
        .groupBy("_shard")
        .applyInPandas(run, schema)
    )
    alone = whole.withColumn("sequence_id", -1 - F.col("_row")).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(alone).drop("_row")


def pack_documents(docs: DataFrame, path: str, length: int = 2048, end_id: int = 0, with_ids: bool = False, **options):
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return pack(token_pieces(docs, path, length, end_id, with_ids=with_ids), length, **options)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id and
    ``ids`` (little-endian unsigned 32-bit), at most one sequence length a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), ""))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
