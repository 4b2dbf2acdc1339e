"""SentencePiece encoding and decoding by streaming Viterbi.

A model file gives pieces with scores; a text is cut so that the sum of scores
is greatest. The text is read once. Only the last ``longest`` positions (the
length of the longest piece) can begin a piece still to come; scores are kept
for them alone. Behind them a boundary is live while a path that goes on runs
through it: it knows how many live boundaries follow it directly, and dies when
there are none left (and then, perhaps, the one before it). As soon as one live
boundary alone follows the last one handed out, all paths run through it, and the
ids up to it are final. Each boundary dies once, so the work grows with the length
of the text, whatever it holds.

What is kept behind the window are the boundaries back to where all paths meet, 24
bytes each, given back TRIM at a time. In words and most long runs these are some
dozens; in a text where the paths never meet (one letter again and again, whose
repetitions are pieces) they are all of it.

Some boundaries are known beforehand: no piece crosses from another character
into a word mark, and characters that only occur alone stand alone. So the text
is read in stretches between such boundaries, and the ids of a stretch are kept
in a bounded table (stretches are mostly words, and words come again).

Characters without a piece become byte pieces. The word mark itself, where it
stands in a text, is written as bytes, so decoding gives back every text.

Defined results: a null text is empty, an empty text has no ids; repeated rows
are encoded each; other columns are kept by the column functions and not read by
the digest.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, slices, text_column

MARK = "▁"
#: Stretches whose ids are remembered by a worker.
REMEMBERED = 500_000
#: Boundaries handed out before their places are given back.
TRIM = 4096
#: An unknown character scores this much below the lowest piece.
UNKNOWN = 10.0
NEVER = float("-inf")
SCORE, ID = 0, 1

_MODELS: dict[str, "Pieces"] = {}


class Pieces:
    """The pieces of a model file and the two directions."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.surface: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.surface.append(b"")
            else:
                self.pieces[piece] = (i, sp.get_score(i))
                self.surface.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.pieces))
        #: The pieces as a tree: a node has its children by character, its score
        #: (NEVER where no piece ends) at SCORE and its id at ID.
        self.root: dict = {}
        for piece, (i, score) in self.pieces.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {SCORE: NEVER, ID: -1})
            node[SCORE], node[ID] = score, i
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN
        inner = {c for p in self.pieces if len(p) > 1 for c in p}
        alone = "" if "\n" in inner else "\n"
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            self.stretch = re.compile(r"[\s\S]+")  # a piece may hold a mark inside: no boundary is known
        else:
            self.stretch = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + ("|\n" if alone else ""))
        self.memory: dict[str, tuple[int, ...]] = {}

    def viterbi(self, text: str):
        """Yield the ids of ``text`` in runs, each as soon as it is final."""
        root, unknown, longest, n = self.root, self.unknown, self.longest, len(text)
        # the window, by boundary from ``shift`` on: best score, boundary before, piece between (-1: bytes)
        shift, size = 0, min(n, 2 * longest) + 1
        score, back, ids = [NEVER] * size, [0] * size, [-1] * size
        score[0] = 0.0
        # up to it, by boundary from ``first`` on: boundary before, piece between, live boundaries after, sum of these
        first = 0
        before, piece, after, total = (array("q", [0]), array("i", [-1]), array("i", [0]), array("q", [0]))
        done = 0  # boundary up to which all is handed out
        long = n > longest  # else the window holds it all
        for start in range(n):
            at = start - shift
            if long:
                if at >= longest and n > 2 * longest:  # move the window on, once in ``longest`` steps
                    base = score[at]
                    score = [x - base for x in score[at:]] + [NEVER] * at
                    back, ids = back[at:] + [0] * at, ids[at:] + [-1] * at
                    shift, at = start, 0
            if long and start:
                before.append(back[at])
                piece.append(ids[at])
                after.append(0)
                total.append(0)
                after[back[at] - first] += 1
                total[back[at] - first] += start
                dead = past = start - longest  # no piece to come begins up to here
                while done < dead <= past and not after[dead - first]:
                    follows = before[dead - first]
                    after[follows - first] -= 1
                    total[follows - first] -= dead
                    dead = follows
                run = []
                while done <= past and after[done - first] == 1:
                    end = total[done - first]
                    run += self._ids_of(text, done, end, piece[end - first])
                    done = end
                if run:
                    yield run
                if done - first >= TRIM and 2 * (done - first) >= len(piece):
                    for kept in (before, piece, after, total):
                        del kept[: done - first]
                    first = done
            base, k = score[at], at + 1
            node = root.get(text[start])
            best = base + (unknown if node is None or node[ID] < 0 else node[SCORE])  # no piece for it: bytes
            if best > score[k]:
                score[k] = best
                back[k] = start
                ids[k] = -1 if node is None else node[ID]
            if node is not None:
                for c in text[start + 1 : start + longest]:
                    node = node.get(c)
                    if node is None:  # no piece begins like this
                        break
                    k += 1
                    best = base + node[SCORE]
                    if best > score[k]:
                        score[k] = best
                        back[k] = start
                        ids[k] = node[ID]
        out, end = [], n
        while end > done:
            if long and end < n:
                start, i = before[end - first], piece[end - first]
            else:
                start, i = back[end - shift], ids[end - shift]
            if i < 0:
                out.extend(self.bytes[b] for b in reversed(text[start:end].encode()))
            else:
                out.append(i)
            end = start
        if out:
            yield out[::-1]

    def _ids_of(self, text: str, start: int, end: int, piece: int):
        return (piece,) if piece >= 0 else [self.bytes[b] for b in text[start:end].encode()]

    def _remembered(self, stretch: str) -> tuple[int, ...]:
        ids = self.memory.get(stretch)
        if ids is None:
            ids = tuple(chain.from_iterable(self.viterbi(stretch)))
            if len(stretch) <= 64:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[stretch] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        memory = self.memory
        literal = [self.bytes[b] for b in MARK.encode()]
        for k, part in enumerate((" " + text).split(MARK)):
            if k:
                out += literal
            stretches = self.stretch.findall(part.replace(" ", MARK))
            found = [memory.get(s) for s in stretches]
            if None in found:
                found = [self._remembered(s) if f is None else f for s, f in zip(stretches, found)]
            out += chain.from_iterable(found)
        return out

    def decode(self, ids) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def model(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode_column(text, path: str):
    """The ids (array of int) of a text column."""

    @F.pandas_udf("array<int>")
    def run(texts):
        return texts.fillna("").map(model(path).encode)

    return run(text)


def decode_column(ids, path: str):
    """The text of an id array column."""

    @F.pandas_udf("string")
    def run(values):
        return values.map(lambda v: model(path).decode(v) if v is not None else "")

    return run(ids)


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_chars, n_ids, ids_crc32 (little-endian unsigned
    32-bit ids), decoded_sha256 (of the text decoded again), round_trip."""
    short_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_column().alias("text"))

    def run(batches):
        m = model(path)
        for b in slices(batches):
            out = []
            for t in b.column("text"):
                text = t.as_py()
                ids = m.encode(text)
                again = m.decode(ids)
                out.append(
                    (
                        len(text), len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()),
                        hashlib.sha256(again.encode()).hexdigest(), again == text,
                    )
                )
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]],
                ["doc_id", "n_chars", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_chars long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    )
