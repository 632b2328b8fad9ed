"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear scorer is fitted with numpy from confirmed toxic texts (positives) and unlabelled
texts. The risk estimator corrects for the class prior ``pi``:

    pi * R_P(+1)  +  max(0, R_U(-1) - pi * R_P(-1))

Labels of clean rows only enter through the prior. A text is described by the presence of its
hashed lower-cased words and word beginnings; nothing else of a row is looked at.

Defined cases: a null or empty text scores sigmoid(bias); equal texts score equally; null or
repeated ids are scored row by row; with no positive label in the training folds every text
gets the prior as its score; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import discard, in_batches, settle
from .textops import U64, chunks, flat, lower_ascii, mix, prefix_hash, span_hash, word_spans

#: Lengths in bytes of the word beginnings that are features beside the whole word.
STEMS = (4, 5, 6)
#: Feature hashes keep 40 bits.
SHIFT = U64(24)


@dataclass
class Scorer:
    """Sorted feature hashes with their weights."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        for lo, hi in chunks(offsets):
            doc, key = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if len(self.keys) and len(key):
                key = key >> SHIFT
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                once = np.unique(doc[hit] * len(self.keys) + at[hit])
                out[lo:hi] += np.bincount(once // len(self.keys), self.weights[once % len(self.keys)], hi - lo)
        return _sigmoid(out)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document index, feature hash) of every word occurrence."""
    start, end, doc = word_spans(data, offsets)
    prefix = prefix_hash(lower_ascii(data))
    keys = [span_hash(prefix, start, end)]
    docs = [doc]
    for n in STEMS:
        long = end - start >= n
        keys.append(mix(span_hash(prefix, start[long], start[long] + n) + U64(n)))
        docs.append(doc[long])
    return np.concatenate(docs), np.concatenate(keys)


def _keys(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of each text, 40 bits of their hashes."""
    data, offsets = flat(column)
    for lo, hi in chunks(offsets):
        doc, key = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        order = np.argsort(doc, kind="stable")
        bound = np.searchsorted(doc[order], np.arange(hi - lo + 1))
        for a, b in zip(bound, bound[1:], strict=False):
            yield np.unique(key[order[a:b]] >> SHIFT)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = list(_keys(batch["text"]))
        at = np.cumsum([0, *map(len, keys)])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, U64), *keys]).astype(np.int64)))
        yield pa.record_batch([batch["positive"], lists], ["positive", "keys"])


def _presence(chosen: np.ndarray):  # noqa: ANN202
    """Which of the chosen features each text has, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.packbits(np.isin(chosen, k, assume_unique=True)).tobytes() for k in _keys(batch["text"])]
            yield pa.record_batch([batch["positive"], pa.array(rows, pa.binary())], ["positive", "bits"])

    return run


def sample(documents: DataFrame, labels: DataFrame, keep: Column, max_positive: int, max_unlabelled: int) -> DataFrame:
    """(positive, text): the rows that a scorer learns from, one for each id."""
    order = F.xxhash64("doc_id", F.lit(17))
    ids = labels.where(keep & (F.col("toxic") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(order, "doc_id").limit(max_positive).withColumn("positive", F.lit(True))
    others = documents.where(keep & F.col("doc_id").isNotNull()).select("doc_id").orderBy(order, "doc_id").limit(max_unlabelled).distinct().withColumn("positive", F.lit(False))
    picked = in_batches(documents).select("doc_id", "text").join(F.broadcast(ids.unionByName(others)), "doc_id")
    # of an id that stands in several rows the text of least hash
    one = picked.groupBy("doc_id", "positive").agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"))).alias("row"))
    return one.select("positive", "row.text")


def fit(
    documents: DataFrame,
    labels: DataFrame,
    keep: Column | None = None,
    max_positive: int = 1500,
    max_unlabelled: int = 3500,
    n_features: int = 512,
    min_gap: float = 2.0,
    steps: int = 300,
) -> Scorer:
    """Fit on at most ``max_positive`` toxic and ``max_unlabelled`` other training rows.

    ``keep`` is a condition on doc_id that holds for training rows. Both samples are the rows of
    least hashed id, so they do not depend on the layout of the tables, and only their ids
    (bounded by these parameters) are broadcast. Features are those whose share among positives
    differs from their share among unlabelled texts by ``min_gap`` standard errors, the
    ``n_features`` that do so most at most; they are counted on the executors, and the driver gets
    a bit for each of them and each row, whatever the length of texts.
    """
    keep = F.lit(True) if keep is None else keep
    known = labels.where(keep & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    n, n_toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n_toxic or n_toxic == n:
        p = (n_toxic or 0.5) / (n + 2)  # below one half where nothing is known
        return Scorer(bias=float(np.log(p / max(1 - p, 1e-6))))
    prior = n_toxic / n
    rows = settle(sample(documents, labels, keep, max_positive, max_unlabelled))
    n_p, n_u = rows.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n_p or not n_u:
        return Scorer(bias=float(np.log(prior / (1 - prior))))
    counted = rows.mapInArrow(_featurize, "positive boolean, keys array<long>").select("positive", F.explode("keys").alias("key"))
    counted = counted.groupBy("key").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    gap = _gap(F.col("p") / n_p, F.col("u") / n_u, n_p, n_u)
    best = counted.select("key", gap.alias("gap")).where(F.col("gap") >= min_gap).orderBy(F.desc("gap"), "key").limit(n_features)
    chosen = np.sort(best.toArrow()["key"].to_numpy()).astype(U64)
    got = rows.mapInArrow(_presence(chosen), "positive boolean, bits binary").toArrow()
    discard(rows)
    flag = np.array(got["positive"].to_pylist(), bool)
    bits = np.frombuffer(b"".join(got["bits"].to_pylist()), np.uint8).reshape(len(flag), -1)
    # sums do not depend on the order in which rows came
    order = np.lexsort((*bits.T, flag))
    x, flag = np.unpackbits(bits[order], axis=1, count=len(chosen)).astype(np.float32), flag[order]
    weights, bias = _descend(x[flag], x[~flag], prior, steps)
    return Scorer(chosen, weights, bias)


def _gap(p: Column, u: Column, n_p: int, n_u: int) -> Column:
    """Difference of shares in standard errors."""
    return F.abs(p - u) / F.sqrt((p + u + 2 / (n_p + n_u)) * (1 / n_p + 1 / n_u))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risks(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """pi R_P(+1), and R_U(-1) - pi R_P(-1), which the method keeps from falling below zero; logistic loss."""
    return float(prior * np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def slope(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """By the scores of positives and of unlabelled rows: the gradient of the risk, or, where the
    second part is below zero, that part's gradient reversed."""
    up = -prior * (1 - _sigmoid(zp)) / len(zp)
    down, un = -prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
    if risks(zp, zu, prior)[1] < 0:
        return -down, -un
    return up + down, un


def _descend(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk."""
    w, b = np.zeros(xp.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        gp, gu = slope(xp @ w + b, xu @ w + b, prior)
        g = np.append(xp.T @ gp + xu.T @ gu + 1e-4 * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def score(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """All columns of ``documents`` but those named toxic_score and toxic, plus these two."""
    carried = [c for c in documents.columns if c not in ("toxic_score", "toxic")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _score_column(scorer, batch["text"])
            yield pa.record_batch([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names, "toxic_score", "toxic"])

    schema = T.StructType([*documents.select(*carried).schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic", T.IntegerType())])
    return in_batches(documents).select(*carried).mapInArrow(run, schema)


def keep_clean(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of ``documents`` that score below one half, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score_column(scorer, batch["text"]) < 0.5))

    return in_batches(documents).mapInArrow(run, documents.schema)


def _score_column(scorer: Scorer, column: pa.Array) -> np.ndarray:
    data, offsets = flat(column)
    return scorer.score(data, offsets)
