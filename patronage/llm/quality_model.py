"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1), unlabelled web text and an estimated class prior
take the place of negatives. With g(x) = w.f(x) and the squared loss, both parts
of the unbiased risk are quadratic forms of second moments:

    R(w) = prior * P[(1 - g)^2] + max(0, U[(1 + g)^2] - prior * P[(1 + g)^2])

(P, U: means over the positives and over all training texts, whatever their
label, which are the unlabelled sample.) So one pass over all texts gathers a
d x d matrix of moments for P and one for U (d = number of features, fixed), and
the non-negative risk is minimised exactly over the whole corpus on those two
matrices: a closed-form start, then descent that, as long as the second part is
negative, climbs that part instead. Work on the driver does not depend on the
size of the corpus.

The prior, unless given, is estimated from the positives and the unlabelled texts
alone; no label 0 is ever read. The density ratio of P to U, fitted by least squares
on the same matrices, orders the texts; above any threshold lies at least the
prior times as large a share of U as of P, and just that share where no negative
is above it. So the prior is the least ratio of the two shares, each threshold
weighed by its sampling error, read from one histogram of the ratios for P and
one for U (a second pass over the stored features; BINS counts each).

A score is the logistic function of 2 g(x): no two texts of different g share one.

Features come from the text alone: character classes, repeats, word and line
shape. Rows whose crc32 of the id modulo 3 is 1 are held out: neither their
labels nor their texts are used in fitting.

Defined results: an empty or null text has the features of no words and gets a
score like any other; without positives every score is the
given prior, or 0.5 where none is given; labels that repeat a doc_id count
once, a null label not at all; a null doc_id is scored and never trained on.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, shingle_hashes, short_batches, slices, span_hashes, text_column, word_spans

# --- features -----------------------------------------------------------------

_CLASSES = 8  # of characters: other, lower, upper, other letter, digit, blank, sentence mark, symbol


def _class_table() -> np.ndarray:
    out = np.zeros(0x3000, dtype=np.int64)
    for c in range(len(out)):
        x = chr(c)
        if x.islower():
            out[c] = 1
        elif x.isupper():
            out[c] = 2
        elif x.isalpha():
            out[c] = 3
        elif x.isdigit():
            out[c] = 4
        elif x.isspace():
            out[c] = 5
        elif x in ".,;:?'\"()-":
            out[c] = 6
        elif x in "#*$%&|<>!@^~_=+{}[]\\/":
            out[c] = 7
    return out


_CLASS = _class_table()
#: Points at which a feature bends: it enters as itself and as min(x / point, 1) for each.
_BENDS = {
    "log_words": (1.0, 2.0, 3.0, 4.0, 5.0, 6.0),
    "upper": (0.05, 0.1, 0.3),
    "digit": (0.02, 0.1, 0.3),
    "mark": (0.02, 0.05, 0.1),
    "symbol": (0.005, 0.02, 0.05, 0.1, 0.2),
    "other": (0.02, 0.1),
    "shout": (0.05, 0.3, 1.0),
    "repeat": (0.05, 0.2, 0.5, 0.8),
    "distinct": (0.1, 0.3, 0.5, 0.7),
    "dup_lines": (0.1, 0.3, 0.6),
    "word_length": (4.0, 5.0, 6.0, 7.0, 9.0),
    "long_words": (0.05, 0.2),
    "line_words": (0.02, 0.1, 0.3),
    "ends": (0.3, 0.7),
}
FEATURES = 1 + sum(1 + len(x) for x in _BENDS.values())


def features(text: str | None) -> np.ndarray:
    """The feature vector (FEATURES numbers between 0 and 1, the first is 1)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends = word_spans(data)
    n, points = len(starts), max(len(text), 1)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.bincount(_CLASS[np.minimum(code, len(_CLASS) - 1)], minlength=_CLASSES)
    letters = max(kinds[1] + kinds[2] + kinds[3], 1)
    distinct, repeat, lengths = 1.0, 0.0, np.zeros(1)
    if n:
        words = span_hashes(data, starts, ends)
        distinct = len(np.unique(words)) / n
        lengths = ends - starts
        if n >= 4:
            windows = shingle_hashes(raw, 3)
            repeat = 1 - len(np.unique(windows)) / len(windows)
    lines = [x for x in text.split("\n") if x.strip()]
    marked = sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines)
    values = {
        "log_words": np.log10(n + 1) * 1.5,
        "upper": kinds[2] / letters,
        "digit": kinds[4] / points,
        "mark": kinds[6] / points,
        "symbol": kinds[7] / points,
        "other": kinds[0] / points,
        "shout": raw.count(b"!") / max(n, 1),
        "repeat": repeat,
        "distinct": distinct,
        "dup_lines": 1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0,
        "word_length": float(lengths.mean()),
        "long_words": float((lengths > 12).mean()),
        "line_words": len(lines) / max(n, 1),
        "ends": marked / max(len(lines), 1),
    }
    out = [1.0]
    for name, bends in _BENDS.items():
        x = float(values[name])
        out.append(min(x / (2 * bends[-1]), 1.0))
        out.extend(min(x / at, 1.0) for at in bends)
    return np.array(out)


def held_out(doc_id) -> bool:
    """Rows kept out of training: crc32 of the id as text, modulo 3, is 1."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def held_out_column(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


# --- fitting --------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * (rows @ np.array(self.weights))))


#: The histograms of density ratios: bins of equal width from LEAST to MOST, the
#: outer ones take what lies beyond.
BINS, LEAST, MOST = 2000, -1.0, 3.0
RIDGE = 3e-3


def density_ratio(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Weights whose product with the features approximates the density of P over that of U."""
    return np.linalg.solve(u + RIDGE * np.eye(len(u)), p[0])


def bins_of(ratios: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((ratios - LEAST) / (MOST - LEAST) * BINS), 0, BINS - 1).astype(np.int64)


def estimate_prior(of_p: np.ndarray, of_u: np.ndarray) -> float:
    """The share of positives in U from the histograms of both: the least ratio of the
    shares of U and P above a threshold, the threshold chosen with its sampling error added."""
    n_p, n_u = of_p.sum(), of_u.sum()
    above_p, above_u = of_p[::-1].cumsum() / n_p, of_u[::-1].cumsum() / n_u
    error = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(n_p) + 1 / np.sqrt(n_u))  # both shares, at 95 %
    at = np.argmin(np.where(above_p > 0, (above_u + error) / np.maximum(above_p, 1 / n_p), np.inf))
    return float(min(above_u[at] / above_p[at], 1.0))


def minimise_risk(p: np.ndarray, u: np.ndarray, prior: float, ridge: float = RIDGE, steps: int = 500) -> np.ndarray:
    """Weights that minimise the non-negative risk; ``p`` and ``u`` are the mean
    second moments of the features (the first feature is the constant 1)."""
    d = len(p)
    eye = np.eye(d)
    mp, mu = p[0], u[0]
    # unbiased risk: prior (1 - 2 g_p + ...) + u-part - prior * p-part = w'Uw + 2 (m_u - 2 prior m_p)'w + const
    w = np.linalg.solve(u + ridge * eye, 2 * prior * mp - mu)

    def negative_part(w):
        return (w @ u @ w + 2 * mu @ w + 1) - prior * (w @ p @ w + 2 * mp @ w + 1)

    # a step in the metric of u; halfway between risk and correction it swings to and fro, so the best is kept
    metric = np.linalg.inv(u + p + ridge * eye)

    def risk(w):
        return prior * (w @ p @ w - 2 * mp @ w + 1) + max(0.0, negative_part(w)) + ridge * w @ w

    best, least = w, risk(w)
    if negative_part(w) >= 0:
        return w
    for _ in range(steps):
        if negative_part(w) >= 0:
            slope = u @ w + mu - 2 * prior * mp + ridge * w
        else:
            slope = -((u @ w + mu) - prior * (p @ w + mp))
        w = w - 0.05 * metric @ slope
        if risk(w) < least:
            best, least = w, risk(w)
    return best


def fit(
    docs: DataFrame, labels: DataFrame, prior: float | None = None, doc_id: str = "doc_id", text: str = "text",
    quality: str = "quality",
) -> Model:
    """Gather the moments over all training rows (one pass over the texts), estimate the
    prior unless it is given, and minimise the risk."""
    short_batches(docs.sparkSession)
    marks = (
        labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{quality}`").cast("int").alias("_q"))
        .where(F.col("_id").isNotNull() & F.col("_q").isNotNull() & ~held_out_column(F.col("_id")))
        .groupBy("_id")
        .agg(F.max("_q").alias("_q"))
    )
    rows = (
        docs.select(F.col(f"`{doc_id}`").alias("_id"), text_column(f"`{text}`").alias("_text"))
        .where(F.col("_id").isNotNull() & ~held_out_column(F.col("_id")))
    )
    # features first: the text never meets a shuffle, the joins move short vectors
    vectors = rows.mapInArrow(_vectors, f"_id {rows.schema['_id'].dataType.simpleString()}, _x binary")
    joined = cut(vectors.join(marks, "_id", "left").select((F.col("_q") == 1).alias("_positive"), "_x"))
    parts = joined.mapInArrow(_moments, "kind int, n long, at int, m array<double>")
    total = parts.groupBy("kind", "at").agg(
        F.sum("n").alias("n"), *[F.sum(F.element_at("m", i + 1)).alias(f"c{i}") for i in range(FEATURES)]
    )
    found = {0: [0, np.zeros((FEATURES, FEATURES))], 1: [0, np.zeros((FEATURES, FEATURES))]}
    for r in total.collect():  # 2 x FEATURES rows
        found[r["kind"]][0] = r["n"]
        found[r["kind"]][1][r["at"]] = [r[f"c{i}"] for i in range(FEATURES)]
    (n_u, u), (n_p, p) = found[0], found[1]
    if not n_p or not n_u:
        known = min(max(0.5 if prior is None else prior, 1e-6), 1 - 1e-6)
        return Model((float(np.log(known / (1 - known)) / 2), *[0.0] * (FEATURES - 1)), known)
    u, p = u / n_u, p / n_p
    if prior is None:
        counts = np.zeros((2, BINS))
        bins = joined.mapInArrow(_histograms(density_ratio(p, u)), "kind int, bin int, n long")
        for r in bins.groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect():  # at most 2 x BINS rows
            counts[r["kind"], r["bin"]] = r["n"]
        prior = estimate_prior(counts[1], counts[0])
    return Model(tuple(minimise_risk(p, u, prior)), prior)


def _vectors(batches):
    for b in slices(batches):
        x = [features(t.as_py()).astype("<f4").tobytes() for t in b.column("_text")]
        yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(x, pa.binary())], ["_id", "_x"])


def _unpacked(b) -> tuple[np.ndarray, np.ndarray]:
    """The feature rows of a batch and which of them are positives."""
    x = np.frombuffer(b"".join(v.as_py() for v in b.column("_x")), dtype="<f4").reshape(-1, FEATURES).astype(float)
    return x, np.array([bool(v.as_py()) for v in b.column("_positive")])


def _histograms(weights: np.ndarray):
    """Per task: for all rows (0) and the positives (1), the counts of their ratios by bin."""

    def run(batches):
        counts = np.zeros((2, BINS), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x, positive = _unpacked(b)
                at = bins_of(x @ weights)
                counts[0] += np.bincount(at, minlength=BINS)
                counts[1] += np.bincount(at[positive], minlength=BINS)
        kind, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[kind, at], pa.int64())],
            ["kind", "bin", "n"],
        )

    return run


def _moments(batches):
    """Per task: for all rows (0) and the positives (1), the rows of the matrix of sums."""
    n = [0, 0]
    sums = [np.zeros((FEATURES, FEATURES)) for _ in n]
    for b in batches:
        if not b.num_rows:
            continue
        x, positive = _unpacked(b)
        for kind, part in ((0, x), (1, x[positive])):
            n[kind] += len(part)
            sums[kind] += part.T @ part
    for kind in (0, 1):
        if n[kind]:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * FEATURES, pa.int32()), pa.array([n[kind]] * FEATURES, pa.int64()),
                    pa.array(range(FEATURES), pa.int32()), pa.array([list(r) for r in sums[kind]], pa.list_(pa.float64())),
                ],
                ["kind", "n", "at", "m"],
            )


# --- scoring --------------------------------------------------------------------


def with_scores(docs: DataFrame, model: Model, name: str = "quality_score", text: str = "text") -> DataFrame:
    """``docs`` in its own columns plus the score (0 to 1) under a ``name`` that is new to it."""

    def run(batches):
        for b in slices(batches):
            scores = model.score(np.stack([features(t.as_py()) for t in b.column(text)]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``."""
    name = free_name(docs, "quality_score")
    return with_scores(docs, fit(docs, labels), name).where(F.col(name) >= threshold).drop(name)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id", held_out_column(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )
