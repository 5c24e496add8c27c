"""Quality scores by a regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance that is shrunk towards the covariance of both classes and
towards a multiple of the identity. The score of a document is the logistic function of the
difference of the two log densities, each from the Mahalanobis distance by a Cholesky factor that
is computed once.

The statistics of all documents are computed once and kept as a narrow table. Learning needs
only sums per class (count, first and second moments), which tasks add up; so it uses every
labelled row, and the driver gets one row per class and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize, ship
from . import words as W
from .rowwise import held_out, per_document

#: A document is predicted to be good from this score on.
THRESHOLD = 0.7
#: Weights of the pooled covariance and of the identity in a class covariance.
POOLED, IDENTITY = 0.1, 0.05
#: Log density differences are divided by this, since statistics aren't independent or normal.
TEMPERATURE = 3.0

_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_BANG = np.isin(np.arange(256), list(b"!?"))
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_OTHER = ~(_SPACE | _SYMBOL | _DIGIT | _BANG | _LETTER)

NAMES = ["log_words", "word_bytes", "word_spread", "upper", "symbol", "digit", "bang", "other", "distinct", "repeated", "short_words", "symbol_words", "upper_words", "lines", "same_lines"]


def _logit(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed log odds of a share; short texts stay near the middle of it."""
    return np.log(x + 0.5) - np.log(np.maximum(n - x, 0) + 0.5)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics per text, in the order of NAMES."""
    out = np.zeros((len(texts), len(NAMES)))
    for c in W.chunks(texts, W.SPACED):
        n_docs = len(c.bounds) - 1
        own = slice(c.first, c.first + n_docs)

        def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags)])
            return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

        n = np.diff(c.bounds).astype(float)
        seen = [table[c.data] for table in (_SPACE, _UPPER, _SYMBOL, _DIGIT, _BANG, _OTHER, _LETTER)]
        space, upper, symbol, digit, bang, other, letter = (per_doc(s, c.offsets) for s in seen)
        size = np.diff(c.offsets) - space
        ends = np.concatenate([[0], np.cumsum(~seen[0])])
        begin = ends[c.starts]
        length = np.diff(begin, append=ends[-1]).astype(float)
        some = np.maximum(n, 1)
        mean = per_doc(length, c.bounds) / some
        spread = np.sqrt(np.maximum(per_doc(length**2, c.bounds) / some - mean**2, 0))
        marked = [np.concatenate([[0], np.cumsum(seen[k])]) for k in (2, 1, 6)]
        stop = np.append(c.starts[1:], len(c.data)) if len(c.starts) else c.starts
        has_symbol = marked[0][stop] > marked[0][c.starts]
        uppers, letters = (m[stop] - m[c.starts] for m in marked[1:])
        all_upper = (uppers >= 2) & (uppers == letters)
        grams = W.grams(c.hashes, 3)
        distinct, repeated, same_lines = np.zeros(n_docs), np.zeros(n_docs), np.zeros(n_docs)
        breaks = per_doc(c.data == 10, c.offsets)
        newline = np.concatenate([[0], np.cumsum(c.data == 10)])
        line_of = newline[c.starts]
        for i in range(n_docs):
            a, b = int(c.bounds[i]), int(c.bounds[i + 1])
            if b - a > 1:
                distinct[i] = len(np.unique(c.hashes[a:b]))
                if b - a > 3:
                    repeated[i] = b - a - 2 - len(np.unique(grams[a : b - 2]))
                first = np.flatnonzero(np.diff(line_of[a:b], prepend=-1))
                sums = _line_hashes(c.hashes[a:b], first)
                same_lines[i] = len(sums) - len(np.unique(sums))
            else:
                distinct[i] = b - a
        stats = [
            np.log1p(n), np.log1p(mean), np.log1p(spread), _logit(upper, letter), _logit(symbol, size), _logit(digit, size), _logit(bang, size), _logit(other, size),
            _logit(n - distinct, n), _logit(repeated, n), _logit(per_doc(length <= 3, c.bounds), n), _logit(per_doc(has_symbol, c.bounds), n), _logit(per_doc(all_upper, c.bounds), n),
            np.log1p(breaks / some), _logit(same_lines, breaks + 1),
        ]
        out[own] = np.stack(stats, axis=1)
    return out


def _line_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    place = np.arange(len(hashes)) - np.repeat(first, np.diff(first, append=len(hashes)))
    return np.add.reduceat(hashes * (2 * place.astype(np.uint64) + np.uint64(1)), first)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id and ``x``, the statistics; null texts count as empty."""

    def make():
        def kernel(texts: pa.Array) -> list[pa.Array]:
            x = statistics(texts)
            return [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().astype(np.float32)))]

        return kernel

    return per_document(docs, make, "x array<float>", id_col, text_col, carry)


@dataclass
class Discriminant:
    """Scaling of the statistics, and per class (0, 1) mean, inverse Cholesky factor, log term."""

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [self.constant[k] - 0.5 * (((z - self.mean[k]) @ self.inverse[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / TEMPERATURE, -60, 60)))


def fit(labelled: DataFrame, pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant | None:
    """From rows (x, label 0 or 1); None if a class has no row."""
    d = len(NAMES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, d)
            y = batch.column(1).to_numpy()
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pydict({"label": pa.array([0, 1], pa.int32()), "s": pa.array(list(sums), pa.list_(pa.float64()))})

    spark = labelled.sparkSession
    ship(spark)
    parts = labelled.select("x", F.col("label").cast("int")).mapInArrow(add, "label int, s array<double>")
    each = parts.select("label", F.posexplode("s").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).collect()  # 2 (1 + d + d^2) rows
    sums = np.zeros((2, 1 + d + d * d))
    for r in each:
        sums[r.label, r.i] = r.v
    n = sums[:, 0]
    if not n.all():
        return None
    raw_mean, second = sums[:, 1 : 1 + d] / n[:, None], sums[:, 1 + d :].reshape(2, d, d) / n[:, None, None]
    total = n.sum()
    centre = (raw_mean * n[:, None]).sum(axis=0) / total
    spread = np.einsum("kii,k->i", second, n) / total - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-12))
    scale[scale < 1e-5] = 1.0
    covariance = np.stack([second[k] - np.outer(raw_mean[k], raw_mean[k]) for k in (0, 1)]) / np.outer(scale, scale)
    both = np.einsum("kij,k->ij", covariance, n) / total
    inverse, constant = [], []
    for k in (0, 1):
        shrunk = (1 - pooled - identity) * covariance[k] + pooled * both + identity * max(np.trace(both) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        inverse.append(np.linalg.inv(factor))
        constant.append(np.log(n[k] / total) - np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, (raw_mean - centre) / scale, np.stack(inverse), np.array(constant))


def score(rows: DataFrame, model: Discriminant | None) -> DataFrame:
    """Adds score and predicted to rows that have ``x``, in place of it; 0.5 if nothing was learned."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in rows.schema.fields if f.name != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), np.float64).reshape(-1, len(NAMES))
            p = shared.value.score(x) if shared.value else np.full(len(x), 0.5)
            arrays = [batch.column(f.name) for f in rest] + [pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in rest] + ["score", "predicted"])

    schema = T.StructType([*rest, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def judge(docs: DataFrame, model: Discriminant | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, score and predicted of whole texts in one pass; the same as ``score`` over ``features``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def kernel(texts: pa.Array) -> list[pa.Array]:
            x = statistics(texts).astype(np.float32).astype(np.float64)
            p = shared.value.score(x) if shared.value else np.full(len(x), 0.5)
            return [pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]

        return kernel

    return per_document(docs, make, "score double, predicted int", id_col, text_col, carry)


def learn(made: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant | None:
    """Fit on the features of labelled documents that aren't held out.

    Labels other than 0 and 1 are left out; a document with several labels counts with each.
    """
    own = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("of").isNotNull())
    return fit(made.join(own.where(~held_out("of")), made.doc_id == F.col("of")).select("x", "label"), pooled, identity)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null texts score as empty ones; rows with the same or a null id each have their row, and a
    null id is neither held out nor learned from; an empty table gives no rows; without labels of
    both classes every score is 0.5; other columns are not read.
    """
    made = materialize(features(docs, id_col, text_col), "quality-features")
    model = learn(made, labels, id_col)
    return score(made, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
