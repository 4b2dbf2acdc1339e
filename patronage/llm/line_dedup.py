"""Line dedup (native): drop lines that occur in several documents.

Lines are exploded with their position and reduced to a 128-bit hash of the
normalised line; the hash is aggregated to its smallest document (combined
map-side, so a line found everywhere is one row per task), joined back to the
line rows to find the positions to drop, and every text is put together again
from the positions that stay. Only hashes and positions are shuffled per line.
A very frequent line makes one heavy join key; the join is a plain shuffle join
that Spark splits when it is skewed.

Defined results: a null text is one empty line; an empty table gives an empty
table; rows that repeat a doc_id are one document when documents are counted,
and each row is cut by its own lines; a null doc_id is one document that comes
after all others; other columns, of any name, are returned untouched.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest128, id_column, text_column

#: Fixed value of the contract: the bytes stripped at both ends of a line.
BLANKS = " \t\n\x0b\f\r"


def line_key(line):
    """The line without blanks at its ends, A-Z in lower case, all else as it is."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def line_rows(docs: DataFrame, min_chars: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows (``_row``, ``_id``, ``_text``, ``_version``) and, for every line long
    enough, (``_id``, ``_version``, ``_pos``, ``h1``, ``h2``)."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        id_column(f"`{doc_id}`").alias("_id"),
        text_column(f"`{text}`").alias("_text"),
    ).withColumn("_version", F.xxhash64("_text"))
    lines = (
        rows.select("_id", "_version", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
        .select("_id", "_version", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("_id", "_version", "_pos", digest128(F.col("_key")).alias("_h"))
        .select("_id", "_version", "_pos", "_h.h1", "_h.h2")
    )
    return rows, lines


def drop_positions(lines: DataFrame, min_docs: int) -> DataFrame:
    """Positions to drop by document: all lines of a key found in at least
    ``min_docs`` documents, but for those of its smallest document."""
    # grouped by a struct, so that the join deals both its sides anew and can split a heavy key
    key = F.struct("h1", "h2").alias("_h")
    if min_docs <= 2:
        keys = lines.groupBy(key).agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last")
    else:
        keys = (
            lines.groupBy(key, "_id").agg(F.lit(1).alias("_one")).groupBy("_h")
            .agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where(F.col("_n") >= min_docs)
        )
    return (
        lines.join(keys.select("_h.h1", "_h.h2", "_first"), ["h1", "h2"])
        .where("_id > _first")
        .groupBy("_id", "_version")
        .agg(F.collect_set("_pos").alias("_drop"))
    )


def dedup_lines(
    docs: DataFrame, min_chars: int = 10, min_docs: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), ``text`` cut to the lines that
    stay, ``n_lines`` (before) and ``n_dropped``."""
    rows, lines = line_rows(docs, min_chars, doc_id, text)
    kept = (
        rows.join(drop_positions(lines, min_docs), ["_id", "_version"], "left")
        .withColumn("_lines", F.split("_text", "\n"))
        .withColumn("_drop", F.array_sort(F.coalesce("_drop", F.array().cast("array<int>"))))
    )
    # the stretches between dropped positions, so that no line is searched in the list of drops
    edges = F.concat(F.array(F.lit(-1)), F.col("_drop"), F.array(F.size("_lines")))
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("_edges") - 1),
            lambda i: F.slice(
                F.col("_lines"), F.element_at("_edges", i) + 2, F.element_at("_edges", i + 1) - F.element_at("_edges", i) - 1
            ),
        )
    )
    kept = kept.withColumn("_edges", edges).withColumn(
        "_kept", F.when(F.size("_drop") == 0, F.col("_text")).otherwise(F.array_join(pieces, "\n"))
    )
    return kept.select(
        F.col("_row").alias("row"),
        F.col("_kept").alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_drop").cast("long").alias("n_dropped"),
    )


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in its own columns, the texts cut to the lines that stay (and
    ``n_chars``, where there is such a column, set anew)."""
    text = options.get("text", "text")
    out = dedup_lines(docs, **options)
    values = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text: F.col("text")}
    if "n_chars" in values:
        values["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[values[c].alias(c) for c in docs.columns])


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 (of the UTF-8 bytes)."""
    return dedup_lines(docs).select(
        "row.doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


#: DuckDB SQL for line_dedup_digest over ``documents``.
ORACLE_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), firsts AS (
    SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
    GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE first_doc < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first_doc IS NULL OR first_doc >= doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (k)
GROUP BY doc_id
"""
