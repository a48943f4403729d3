"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is linear in measured features of its whole text.  It is
fitted on preference pairs (label 1 preferred over label 0) by logistic loss
on the differences of their features, then cut at a score quantile: the level
that agrees best with all labelled training rows.

Scores are ``sigmoid(strength - cut)``, so 0.5 is the cut.  Ids, languages,
sources and labels never enter a score.  Null and empty texts have features
like any other and get a score.  Labels that are null, or whose id no document
has, take no part; repeated rows are scored each.  Without a label of both
kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from . import quality_rules
from .store import table
from .textops import Chunk, chunks, release

#: Labelled rows that the fit sees at most, the first by hash of the id.
FIT_ROWS = 20_000
#: Preference pairs drawn from them.
PAIRS = 120_000
#: Score quantiles tried as the cut.
LEVELS = 400

FEATURES = ("length", "tiny", "symbols", "dup_lines", "repeats", "upper", "word_length", "distinct", "exclaims", "bars", "digits", "foreign", "echo", "lines", "stops")

_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_HIGH = np.arange(256) >= 0x80


def features(chunk: Chunk) -> np.ndarray:
    """A row of FEATURES per text, each bounded."""
    m = quality_rules._measure(chunk)
    starts, ends, first = chunk.words()
    hashes = chunk.word_hashes(starts, ends, lower=True)
    own = np.repeat(np.arange(chunk.n), np.diff(first))
    n = np.maximum(m["n_words"], 1)
    size = np.maximum(np.diff(chunk.offsets), 1)
    order = np.lexsort((hashes, own))
    fresh = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (own[order][1:] != own[order][:-1])] if len(own) else np.zeros(0, bool)
    distinct = np.bincount(own[order][fresh], minlength=chunk.n)
    echo = np.bincount(own[1:][(hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])], minlength=chunk.n)
    data = chunk.data
    some = lambda b: chunk.per_text(data == b)
    cols = [
        np.log1p(m["n_words"]) / 10,
        m["n_words"] < 5,
        m["n_symbols"] / np.maximum(m["word_chars"], 1),
        m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        m["n_repeat_words"] / n,
        m["n_upper"] / np.maximum(m["n_letters"], 1),
        m["word_chars"] / n / 20,
        distinct / n,
        some(0x21) / n,
        some(0x7C) / n,
        chunk.per_text(_DIGIT[data]) / size,
        chunk.per_text(_HIGH[data]) / size,
        echo / n,
        m["n_lines"] / n,
        (some(0x2E) + some(0x2C)) / n,
    ]
    return np.clip(np.stack(cols, 1).astype(float), 0, 2)


def _with_features(docs: DataFrame, text_col: str, keep: list[str], name: str) -> DataFrame:
    """Columns ``keep`` and the features of every whole text, in one pass."""
    columns = [*keep, *({text_col} - {*keep})]
    text = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in chunks(batch.column(text)):
                x = features(chunk)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(chunk.n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, chunk.n) for k in range(len(keep))), rows], [*keep, name])
        release()

    schema = StructType([*(docs.schema[c] for c in keep), StructField(name, ArrayType(DoubleType()))])
    return docs.select(*columns).mapInArrow(run, schema)


def featurize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``features array<double>`` of every whole text."""
    return _with_features(docs, text_col, [id_col], "features")


@dataclass(frozen=True)
class Ranker:
    """Strength of a document: weights over features, less the cut."""

    weights: tuple[float, ...]
    cut: float = 0.0

    def strength(self, name: str = "features") -> Column:
        out = F.lit(0.0)
        for k, w in enumerate(self.weights):
            out = out + F.coalesce(F.get(F.col(name), F.lit(k)), F.lit(0.0)) * F.lit(w)
        return out

    def score(self, name: str = "features") -> Column:
        return 1 / (1 + F.exp(F.lit(self.cut) - self.strength(name)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights of the Bradley-Terry model by Newton's steps on preference pairs."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1])
    spread = x.std(0)
    spread[spread < 1e-9] = np.inf  # a constant feature gets no weight
    rng = np.random.default_rng(seed)
    diff = (x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]) / spread
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # share of loss left in each pair
        grad = diff.T @ p / pairs - ridge * w
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w)), grad)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return w / spread


def best_cut(labelled: DataFrame, ranker: Ranker) -> float:
    """The score quantile of all labelled rows that errs least; labelled: features, quality."""
    rows = labelled.select(ranker.strength().alias("s"), "quality")
    levels = [k / LEVELS for k in range(LEVELS + 1)]
    cuts = rows.agg(F.percentile_approx("s", levels, 100_000).alias("q")).first()["q"]
    if not cuts:
        return 0.0
    cuts = sorted(set(cuts))
    bin_ = F.expr(f"size(filter(array({','.join(f'{c!r}D' for c in cuts)}), c -> c <= s))")
    seen = rows.groupBy(bin_.alias("bin")).agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad")).collect()
    good, bad = np.zeros(len(cuts) + 2), np.zeros(len(cuts) + 2)
    for r in seen:
        good[r["bin"]], bad[r["bin"]] = r["good"], r["bad"]
    # rows of bin >= k score at least cuts[k - 1]; keep those, reject the rest
    errors = np.cumsum(good)[:-1] + (bad.sum() - np.cumsum(bad)[:-1])
    k = int(errors[: len(cuts)].argmin())
    return float((cuts[k] + cuts[k - 1]) / 2) if k else float(cuts[0]) - 1e-9


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Ranker:
    """A ranker from rows of (id, features, quality); the first ``rows`` by hash of the id fit it, all of them set the cut."""
    kept = labelled.where(F.col("quality").isin(0, 1))
    sample = kept.orderBy(F.xxhash64("id"), "id").limit(rows).select("features", "quality").collect()
    x = np.array([r["features"] for r in sample]).reshape(-1, len(FEATURES))
    ranker = Ranker(tuple(float(w) for w in fit_pairs(x, np.array([r["quality"] for r in sample]))))
    if not any(ranker.weights):
        return ranker
    return Ranker(ranker.weights, best_cut(kept, ranker))


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def train(featurized: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Ranker:
    """A ranker from the labels that are not held out; labels: id, quality."""
    known = labels.select(F.col(id_col).alias("id"), "quality").where(~held_out("id"))
    return fit(featurized.select(F.col(id_col).alias("id"), "features").join(known, "id"))


def classify(featurized: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` of every featurized row."""
    ranker = train(featurized, labels, id_col)
    scored = featurized.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), ranker.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def select_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, that score 0.5 or more; each text is measured once, and written with its features."""
    name = "__features"
    whole = table(_with_features(docs, text_col, docs.columns, name), "featured")
    ranker = train(whole.select(id_col, F.col(name).alias("features")), labels, id_col)
    return whole.where(ranker.score(name) >= 0.5).select(*docs.columns)


def keep_good(docs: DataFrame, featurized: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, that score 0.5 or more; features travel with their row, so nothing is joined to the texts."""
    ranker = train(featurized, labels, id_col)
    name = "__features"
    return _with_features(docs, text_col, docs.columns, name).where(ranker.score(name) >= 0.5).select(*docs.columns)
