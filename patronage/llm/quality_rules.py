"""Quality rules with adaptive thresholds.

Each text is measured by whole-number ratios (parts of 10,000). For every
language and source a mergeable quantile sketch of each ratio is kept, of the
texts that pass the base rules (very short ones would blur all limits): a
histogram over logarithmic buckets (a DDSketch), so a sketch is a set of counts,
merging is adding, the order of rows does not matter and the relative error of
a value is at most ACCURACY.

The sketch alone sets the limit of a rule: going up from the median, the group's
main body ends at the first gap, a stretch without texts (but for buckets with
less than one text in RARE) as wide as ERRORS standard errors of the ratio in a
text of the group's mean length. So a tail that grows out of the body, however
long, is kept, and a population of its own above it is not, up to half of the
group. Few texts leave chance gaps: the limit of a group of n texts counts n
times, that of its language ``shrink`` times, and likewise the language's with
that of all texts, so that small groups lean on the merged sketches without any
switch. A text is over a limit when it exceeds it by more than ERRORS standard
errors of a text of its own length (the variance is that of a count with mean
``limit``, plus one event, see EVENTS). The limits are joined back to the measures
by language and source, and a document is kept when it passes the base rules and
no ratio is over its limit.

Counting is combined map-side, so a source that holds most rows is a few
hundred counters per task. The limits are one row per language and source;
Spark picks the join from their measured size and splits a skewed one.

Defined results: a null or empty text has no words and fails the base rules;
null languages and sources form groups of their own; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shingle_hashes, short_batches, slices, text_column, word_spans

ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Standard errors: the width of a gap, and what a text may exceed a limit by.
ERRORS = 3
#: Buckets with less than one in this many texts of the group do not close a gap.
RARE = 10_000
#: Rule -> (what is counted, its size where it occurs once, of what, parts).
EVENTS = {
    "symbols": ("n_symbols", 1, "word_chars", 10000),
    "dup_lines": ("n_dup_lines", 1, "n_lines", 10000),
    "repeats": ("n_repeat_words", 6, "n_words", 10000),  # two windows of three words
    "word_length": ("word_chars", 1, "n_words", 100),
    "capitals": ("n_upper", 1, "word_chars", 10000),
    "shouts": ("n_shouts", 1, "n_words", 10000),
}
RULES = tuple(EVENTS)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_UPPER = np.array([chr(c).isupper() for c in range(0x2000)])

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_shouts long"
)


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one whole text, in the order of MEASURES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, _ = word_spans(data)
    n = len(starts)
    if not n:
        return (0, 0, int(_SYMBOL[data].sum()), 0, 0, 0, 0, 0)
    blank = int(((data == 32) | ((data >= 9) & (data <= 13))).sum())
    points = int(((data & 0xC0) != 0x80).sum())
    repeated = 0
    if n >= 4:  # three words make one window, which cannot repeat
        windows = shingle_hashes(raw, 3)
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        if again.any():
            inside = np.zeros(n, dtype=bool)
            for k in range(3):
                inside[k : k + len(again)] |= again
            repeated = int(inside.sum())
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    upper = int(_UPPER[code[code < len(_UPPER)]].sum())
    return (
        n, points - blank, int(_SYMBOL[data].sum()), len(lines) - len(set(lines)), repeated,
        len(lines), upper, raw.count(b"!"),
    )


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"):
    """(doc_id, lang, source, measures...) per row; one pass over the whole texts."""
    short_batches(docs.sparkSession)
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{lang}`").cast("string").alias("lang"),
        F.col(f"`{source}`").cast("string").alias("source"),
        text_column(f"`{text}`").alias("text"),
    )
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches):
        for b in slices(batches):
            found = [measure(x.as_py()) for x in b.column("text")]
            columns = [b.column(c) for c in ("doc_id", "lang", "source")]
            columns += [pa.array([f[i] for f in found], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "source", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, source string, {MEASURES}")


def _with_ratios(m: DataFrame) -> DataFrame:
    """The ratio of each rule under its name and what one event adds to it
    under ``step_<rule>``, in thousandths, so that sums are whole numbers."""
    out = {}
    for rule, (count, size, of, parts) in EVENTS.items():
        out[rule] = F.expr(f"CASE WHEN {of} > 0 THEN {count} * {parts} div {of} ELSE 0L END")
        out[f"step_{rule}"] = F.expr(f"CASE WHEN {of} > 0 THEN {size * parts * 1000} div {of} ELSE 0L END")
    return m.withColumns(out)


def sketches(ratios: DataFrame) -> DataFrame:
    """(level, lang, source, rule, bucket, n, steps): level 0 by language and source, 1 by
    language, 2 all; ``steps`` is the sum of the texts' steps in thousandths. Bucket 0 holds the zeros, bucket i values up to GAMMA^(i-1)."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v"), F.col(f"step_{r}").alias("step")) for r in RULES]))
    # 1e-9: a whole power of GAMMA belongs to its own bucket whatever the last digit of the logarithm
    bucket = F.when(F.col("e.v") <= 0, 0).otherwise(
        F.ceil(F.log(F.col("e.v").cast("double")) / F.lit(math.log(GAMMA)) - F.lit(1e-9)) + 1
    )
    counts = (
        ratios.select("lang", "source", each.alias("e"))
        .select("lang", "source", "e.rule", "e.step", bucket.cast("int").alias("bucket"))
        .groupBy("lang", "source", "rule", "bucket")
        .agg(F.count("*").alias("n"), F.sum("step").alias("steps"))
    )
    none = F.lit(None).cast("string")
    levels = F.explode(
        F.array(
            F.struct(F.lit(0).alias("level"), F.col("lang").alias("l"), F.col("source").alias("s")),
            F.struct(F.lit(1).alias("level"), F.col("lang").alias("l"), none.alias("s")),
            F.struct(F.lit(2).alias("level"), none.alias("l"), none.alias("s")),
        )
    )
    return (
        counts.select(levels.alias("k"), "rule", "bucket", "n", "steps")
        .groupBy(F.col("k.level").alias("level"), F.col("k.l").alias("lang"), F.col("k.s").alias("source"), "rule", "bucket")
        .agg(F.sum("n").alias("n"), F.sum("steps").alias("steps"))
    )


def _error(limit, step):
    """The standard error of a ratio about ``limit`` in a text where one event adds ``step``."""
    return F.sqrt((limit + step) * step)


#: The end of the main body of a sketch: ``b`` its buckets in order (bounded by the
#: largest ratio: some hundreds), ``n`` the texts, ``step`` their mean step.
BODY_END = f"""aggregate(
    transform(b, x -> named_struct('n', x.n, 'v', CASE WHEN x.bucket = 0 THEN 0D
        ELSE 2 * pow({GAMMA!r}D, x.bucket - 1) / {GAMMA + 1!r}D END)),
    named_struct('upto', 0L, 'at', CAST(NULL AS DOUBLE), 'ended', false),
    (s, x) -> CASE
        WHEN s.ended OR 2 * (s.upto + x.n) < n OR (2 * s.upto >= n AND x.n * {RARE} < n)
            THEN named_struct('upto', s.upto + x.n, 'at', s.at, 'ended', s.ended)
        WHEN s.at IS NULL OR x.v <= s.at + {ERRORS} * sqrt((s.at + step) * step)
            THEN named_struct('upto', s.upto + x.n, 'at', x.v, 'ended', false)
        ELSE named_struct('upto', s.upto + x.n, 'at', s.at, 'ended', true) END,
    s -> s.at)"""


def limits(sketch: DataFrame, shrink: int = 100) -> DataFrame:
    """One row per language and source with a limit per rule."""
    per_rule = (
        sketch.groupBy("level", "lang", "source", "rule")
        .agg(
            F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"),
            F.sum("n").alias("n"),
            (F.sum("steps") / F.sum("n") / 1000).alias("step"),
        )
        .withColumn("limit", F.expr(BODY_END))
    )
    wide = cut(  # read three times
        per_rule.groupBy("level", "lang", "source")
        .agg(F.max("n").alias("n"), *[F.max(F.when(F.col("rule") == r, F.col("limit"))).alias(r) for r in RULES])
        .select("level", "lang", "source", "n", F.struct(*RULES).alias("limit"))
    )
    own = wide.where("level = 0").select("lang", "source", "n", "limit")
    of_lang = wide.where("level = 1").select(F.col("lang").alias("l1"), F.col("n").alias("n1"), F.col("limit").alias("limit1"))
    of_all = wide.where("level = 2").select("limit").scalar()  # one row
    joined = own.join(of_lang, F.col("lang").eqNullSafe(F.col("l1")), "left").withColumn("limit2", of_all)

    def leaning(n, limit, wider):
        return (F.col(n) * F.col(limit) + shrink * wider) / (F.col(n) + shrink)

    shrunk = [leaning("n", f"limit.{r}", leaning("n1", f"limit1.{r}", F.col(f"limit2.{r}"))).alias(r) for r in RULES]
    return joined.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(*shrunk).alias("limits"))


def quality_rules(docs: DataFrame, shrink: int = 100, **columns) -> DataFrame:
    """Per row: doc_id, lang, source, the measures, base_failed, kept, the ratios
    (struct ``ratios``) and the limits that held (struct ``limits``)."""
    ratios = _with_ratios(cut(measures(docs, **columns)))
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    table = limits(sketches(ratios.where(~base)), shrink)
    joined = ratios.join(
        table, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    within = F.lit(True)
    for r in RULES:
        limit = F.col(f"limits.{r}")
        within = within & (F.col(r) <= limit + ERRORS * _error(limit, F.col(f"step_{r}") / 1000))
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return joined.select(
        "doc_id", "lang", "source", *names, base.alias("base_failed"), (~base & within).alias("kept"),
        F.struct(*RULES).alias("ratios"), "limits",
    )


def rules_digest(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    rules = ", ".join(
        f"{{'rule': '{r}', 'v': coalesce({count} * {parts} // nullif({of}, 0), 0), 'step': coalesce({size * parts * 1000} // nullif({of}, 0), 0) / 1000}}"
        for r, (count, size, of, parts) in EVENTS.items()
    )
    return rf"""
WITH texts AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), numbered AS (SELECT row_number() OVER () AS id, * FROM texts),
windows AS (
    SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
    FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM numbered WHERE len(w) >= 3)
), again AS (
    SELECT id, count(DISTINCT p) AS n_repeat_words FROM (
        SELECT id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT id, i, count(*) OVER (PARTITION BY id, x) AS n FROM windows) WHERE n > 1)
    GROUP BY id
), measured AS (
    SELECT id, doc_id, lang, source, len(w) AS n_words, list_sum([0] || list_transform(w, lambda x: length(x)))::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
           len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '!')) AS n_shouts
    FROM numbered LEFT JOIN again USING (id)
), each AS (
    SELECT id, lang, source, failed, e.rule AS rule, e.step AS step, e.v AS v,
           CASE WHEN e.v > 0 THEN ceil(ln(e.v::DOUBLE) / {math.log(GAMMA)!r} - 1e-9)::INT + 1 ELSE 0 END AS bucket
    FROM (SELECT id, lang, source, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed, unnest([{rules}]) AS e FROM measured)
), spread AS (
    SELECT grouping(lang, source) AS level, lang, source, rule, count(*) AS texts, avg(step) AS step, quantile_disc(bucket, 0.5) AS middle
    FROM each WHERE NOT failed GROUP BY GROUPING SETS ((lang, source, rule), (lang, rule), (rule))
), counted AS (
    SELECT grouping(lang, source) AS level, lang, source, rule, bucket, count(*) AS n
    FROM each WHERE NOT failed GROUP BY GROUPING SETS ((lang, source, rule, bucket), (lang, rule, bucket), (rule, bucket))
), body AS (
    SELECT s.*, c.bucket, CASE WHEN c.bucket = 0 THEN 0 ELSE 2 * pow({GAMMA!r}, c.bucket - 1) / {GAMMA + 1!r} END AS value
    FROM counted c JOIN spread s ON s.level = c.level AND s.rule = c.rule
        AND s.lang IS NOT DISTINCT FROM c.lang AND s.source IS NOT DISTINCT FROM c.source
    WHERE c.bucket >= middle AND (c.bucket = middle OR c.n * {RARE} >= texts)
), limits AS (
    SELECT level, lang, source, rule, any_value(texts) AS n, min(value) AS top FROM (
        SELECT *, lead(value) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS further FROM body)
    WHERE further IS NULL OR further > value + {ERRORS} * sqrt((value + step) * step)
    GROUP BY level, lang, source, rule
), shrunk AS (
    SELECT a.lang, a.source, a.rule, (a.n * a.top + 100 * ((b.n * b.top + 100 * c.top) / (b.n + 100))) / (a.n + 100) AS top
    FROM limits a
    JOIN limits b ON a.level = 0 AND b.level = 1 AND b.rule = a.rule AND b.lang IS NOT DISTINCT FROM a.lang
    JOIN limits c ON c.level = 3 AND c.rule = a.rule
), judged AS (
    SELECT e.id, bool_and(e.v <= top + {ERRORS} * sqrt((top + e.step) * e.step)) AS within
    FROM each e JOIN shrunk s ON s.rule = e.rule AND s.lang IS NOT DISTINCT FROM e.lang AND s.source IS NOT DISTINCT FROM e.source
    GROUP BY e.id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(within, false) AS kept
FROM measured LEFT JOIN judged USING (id)
"""


#: DuckDB SQL for rules_digest over ``documents``, by the same rule.
ORACLE_SQL = _oracle()
