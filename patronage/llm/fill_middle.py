"""Fill-in-the-middle transformation over an indexable skip list of units.

A text is cut into units (lines with their line feed), two cut ranks are drawn
from a hash of the document's id, and prefix, suffix and middle are written in
another order, each behind its own marker:

* ``psm``: prefix, suffix, middle;
* ``spm``: suffix, prefix, middle;
* ``plain``: the text as it is (empty texts, texts that hold a marker themselves,
  and the share of documents that is not transformed).

The units of a text stand in a skip list. Lane 0 has every unit; each lane above
has the units whose tower is higher (a quarter of the lane below). A node of a lane
carries what lies between it and the next node of that lane: units and code
points. Looking for a rank goes along a lane while the units passed do not exceed
the rank, and one lane down where they would; the code points passed on the way
add up to the place of the cut, so both ranks are found exactly, in a number of
steps that grows with the logarithm of the units.

``restore`` gives back the text from the output and the form alone, with column
functions only. Nothing is shuffled; other columns stay in the JVM.

Defined results: a null text is empty; an empty text has no unit and is plain; a
null doc_id is drawn as an empty one; rows that repeat a doc_id are each cut by
their own lines at the same draws; an empty table gives an empty table; very long
texts are held once, with about 40 bytes a line; other columns, of any name, are
returned inside ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, text_column

#: Fixed values of the contract: the markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED = 7

RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


# --- the skip list ------------------------------------------------------------------


class SkipList:
    """Units of known widths, to be found by rank.

    ``lanes``: from the top, (units, chars, down) of each lane: what every node
    spans up to the next node of its lane, and its place in the lane below.
    """

    def __init__(self, widths: np.ndarray):
        n = len(widths)
        spans, chars, at = np.ones(n, dtype=np.int64), widths.astype(np.int64), np.arange(n)
        lanes = [(spans, chars, at)]
        heights = _heights(n)
        level = 1
        while len(at) > 4:
            up = np.flatnonzero(heights[at] >= level)
            if not len(up) or up[0]:
                up = np.concatenate([[0], up])  # the first unit heads every lane
            if len(up) < len(at):  # a lane that skips nothing is left out
                spans, chars, at = np.add.reduceat(spans, up), np.add.reduceat(chars, up), at[up]
                lanes.append((spans, chars, up))
            level += 1
        self.lanes = [tuple(x.tolist() for x in lane) for lane in lanes[:0:-1]] + [lanes[0][:2] + (None,)]
        self.units = n

    def chars_before(self, rank: int) -> int:
        """Code points in the first ``rank`` units."""
        if not 0 <= rank <= self.units:
            raise IndexError(f"rank {rank} of {self.units} units")
        node, left, chars = 0, rank, 0
        for spans, widths, down in self.lanes:
            while node < len(spans) and spans[node] <= left:
                left -= spans[node]
                chars += int(widths[node])
                node += 1
            if not left:
                break
            if down is not None:
                node = down[node]  # the span that holds the rank begins here
        return chars


def _heights(n: int) -> np.ndarray:
    """Height of each unit's tower: a lane up for every two zero bits of a hash of its place."""
    bits = mix(np.arange(1, n + 1, dtype=np.uint64))
    lowest = bits & (~bits + np.uint64(1))
    return (np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)) // 2).astype(np.int64)


def unit_widths(raw: bytes) -> np.ndarray:
    """Code points of each line (with its line feed) of a UTF-8 text."""
    data = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    if len(data) and (not len(ends) or ends[-1] < len(data)):
        ends = np.append(ends, len(data))
    if not len(ends):
        return np.zeros(0, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    continued = (data & 0xC0) == 0x80
    return (ends - starts) - np.add.reduceat(continued, starts, dtype=np.int64)


# --- the transformation -------------------------------------------------------------


def checked_markers(markers) -> tuple[str, str, str]:
    """The markers, if a text that holds none of them can be read back from between
    them: none is empty, has a line feed, or overlaps another (or itself)."""
    prefix, suffix, middle = markers
    for i, m in enumerate(markers):
        if not m or "\n" in m:
            raise ValueError(f"marker {m!r} is empty or has a line feed")
        for k, other in enumerate(markers):
            if i != k and m in other or any(m.endswith(other[:size]) for size in range(1, min(len(m), len(other)))):
                raise ValueError(f"markers {m!r} and {other!r} overlap")
    return prefix, suffix, middle


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    seed: int = SEED,
    percent: int = 100,
    spm_percent: int = 50,
    markers=MARKERS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), ``n`` (units), ``form``,
    ``prefix_chars`` and ``middle_chars`` (code points, null if plain) and ``output``.

    ``percent`` of the documents are transformed, ``spm_percent`` of these as spm;
    a document's draws depend on ``seed`` and its id alone.
    """
    marks = checked_markers(markers)

    @F.arrow_udf(RESULT)
    def cut(texts: pa.Array, one: pa.Array, two: pa.Array, share: pa.Array, kind: pa.Array) -> pa.Array:
        made: list[list] = [[], [], [], [], []]
        for text_, h1, h2, h3, h4 in zip(texts, one.to_pylist(), two.to_pylist(), share.to_pylist(), kind.to_pylist()):
            t = text_.as_py()
            widths = unit_widths(t.encode("utf-8"))
            n = len(widths)
            if not t or h3 % 100 >= percent or any(m in t for m in marks):
                row = (n, "plain", None, None, t)
            else:
                units = SkipList(widths)
                first, second = sorted((units.chars_before(h1 % (n + 1)), units.chars_before(h2 % (n + 1))))
                prefix, middle, suffix = marks[0] + t[:first], marks[2] + t[first:second], marks[1] + t[second:]
                spm = h4 % 100 < spm_percent
                out = suffix + prefix + middle if spm else prefix + suffix + middle
                row = (n, "spm" if spm else "psm", first, second - first, out)
            for column, value in zip(made, row):
                column.append(value)
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ["n", "form", "prefix_chars", "middle_chars", "output"]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(made, types)], names)

    made = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        cut(text_column(f"`{text}`"), *draws(F.col(f"`{doc_id}`"), seed)).alias("_made"),
    )
    return made.select("row", "_made.*")


def restore(output: Column, form: Column, markers=MARKERS) -> Column:
    """The text, from an output and its form."""
    p, s, m = [F.lit(x) for x in checked_markers(markers)]
    between = lambda a, b: F.split_part(F.split_part(output, a, F.lit(2)), b, F.lit(1))
    middle = F.split_part(output, m, F.lit(2))
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs).select(
        "row.doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: DuckDB SQL for fill_digest over ``documents``.
ORACLE_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
           sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d
    FROM documents
), drawn AS (
    SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
           ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4
    FROM cut
), placed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
           coalesce(array_to_string(u[b + 1:n], ''), '') AS s
    FROM placed
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
