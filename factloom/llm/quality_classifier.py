"""Quality classifier from weak labels.

Nine overlapping heuristic labellers vote good, bad or nothing on every document. Expectation
maximisation over the counts of vote patterns (at most 3^9, whatever the corpus) estimates the
share of good documents and each labeller's confusion rates; the posteriors then train a linear
scorer on hashed words and word shapes, which scores every document. No given label is used.

Defined cases: null text counts as empty and is scored by its votes' features alone (no words);
equal texts score equally; ids may repeat or be null; an empty table gives an empty result; extra
columns are carried unless named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import in_batches, one_per_id
from .textops import U64, chunks, flat, lower_ascii, prefix_hash, span_hash, word_spans

GOOD, BAD, NONE = 1, 0, 2
#: Hash slots of words, and of shapes.
WORDS, SHAPES = 4096, 512
# Frequent short words of English, German, French and Spanish.
COMMON = b"the of and to in is that for it was on are as with be die der und das ist nicht ein von zu den mit le la les de et des un une que est en el los por con una para".split()
_common: np.ndarray | None = None


def _parts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per document and hashes per word, shared by labellers and scorer."""
    global _common
    n = len(offsets) - 1
    start, end, doc = word_spans(data, offsets)
    low = lower_ascii(data)
    word = span_hash(prefix_hash(low), start, end)
    if _common is None:
        joined = np.frombuffer(b" ".join(COMMON), np.uint8)
        s, e, _ = word_spans(joined, np.array([0, len(joined)]))
        _common = np.sort(span_hash(prefix_hash(joined), s, e))
    at = np.minimum(np.searchsorted(_common, word), len(_common) - 1)
    per_word = lambda weights=None: np.bincount(doc, weights, n)
    running = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    per_doc = lambda c: c[offsets[1:]] - c[offsets[:-1]]
    upper, lower = running((data >= 65) & (data <= 90)), running((data >= 97) & (data <= 122))
    digit = running((data >= 48) & (data <= 57))
    marks = np.zeros(256, bool)
    marks[list(b"#*$%&|<>!@^~{}[]\\")] = True
    mark = running(marks[data])
    key = np.unique((doc.astype(U64) << U64(44)) | (word >> U64(20)))
    distinct = np.bincount((key >> U64(44)).astype(np.int64), minlength=n)
    breaks = running(data == 10)
    # lines with a word, and those among them that an earlier line of the text equals
    line = breaks[start]
    fresh = np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    of = doc[first]
    text = span_hash(prefix_hash(data), start[first], end[last]) if len(first) else np.zeros(0, U64)
    lines = np.bincount(of, minlength=n)
    seen = np.unique((of.astype(U64) << U64(44)) | (text >> U64(20)))
    length = end - start
    shape = np.minimum(length, 31) * 16 + (upper[end] - upper[start] > 1) * 8 + (digit[end] > digit[start]) * 4 + (mark[end] > mark[start]) * 2 + (lower[end] > lower[start])
    return {
        "doc": doc, "word": word, "shape": shape, "n": per_word(), "chars": per_word(length), "common": per_word(_common[at] == word),
        "distinct": distinct, "lines": lines, "dup": lines - np.bincount((seen >> U64(44)).astype(np.int64), minlength=n),
        "upper": per_doc(upper), "lower": per_doc(lower), "mark": per_doc(mark), "digit": per_doc(digit),
    }


def _vote(value: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NONE))


def votes(p: dict[str, np.ndarray]) -> np.ndarray:
    """One row per document, one column per labeller."""
    n = np.maximum(p["n"], 1)
    letters = np.maximum(p["upper"] + p["lower"], 1)
    size, mark, upper = p["chars"] / n, p["mark"] / n, p["upper"] / letters
    dup, common, fill = p["dup"] / np.maximum(p["lines"], 1), p["common"] / n, n / np.maximum(p["lines"], 1)
    variety, digit = p["distinct"] / n, p["digit"] / np.maximum(p["chars"], 1)
    columns = (
        (p["n"], p["n"] < 15, p["n"] >= 60),
        (mark, mark > 0.15, mark < 0.03),
        (upper, upper > 0.5, upper < 0.15),
        (dup, dup > 0.3, (dup == 0) & (p["lines"] >= 3)),
        (size, (size < 2.2) | (size > 14), (size > 3) & (size < 11)),
        (common, common < 0.01, common > 0.08),
        (fill, fill < 3.5, fill > 8),
        (variety, (variety < 0.25) & (n > 40) & (n < 2000), variety > 0.4),
        (digit, digit > 0.2, digit < 0.05),
    )
    return np.stack([_vote(*c) for c in columns], 1)


N_LABELLERS = 9


@dataclass
class Accuracies:
    """Share of good documents and, per labeller and class, the rates of the three votes."""

    prior: float
    rates: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        log = np.log(np.array([1 - self.prior, self.prior]) + 1e-12)[None, :]
        for k in range(patterns.shape[1]):
            log = log + np.log(self.rates[k][:, patterns[:, k]].T)
        top = log.max(1, keepdims=True)
        e = np.exp(log - top)
        return e[:, 1] / e.sum(1)


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> Accuracies:
    """Expectation maximisation from the majority vote, until it settles or ``steps`` are done."""
    good, bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    post = np.clip((good + 0.5 - 0.5 * bad) / np.maximum(good + bad, 1), 0.05, 0.95)
    model = Accuracies(0.5, np.zeros((patterns.shape[1], 2, 3)))
    for _ in range(steps):
        w = np.stack([(1 - post) * counts, post * counts])
        rates = np.stack([[np.bincount(patterns[:, k], w[c], 3) + 1.0 for c in (0, 1)] for k in range(patterns.shape[1])])
        model = Accuracies(float((w[1].sum() + 1) / (counts.sum() + 2)), rates / rates.sum(2, keepdims=True))
        new = model.posterior(patterns)
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return model


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch["text"])
        codes = [votes(_parts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) @ 3 ** np.arange(N_LABELLERS) for a, b in chunks(offsets)]
        code, count = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)
        yield pa.record_batch([pa.array(code.astype(np.int64)), pa.array(count)], ["code", "n"])


def _unpack(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(N_LABELLERS) % 3


def label_model(documents: DataFrame) -> Accuracies:
    """Accuracies from the votes on all documents."""
    counted = in_batches(documents).select("text").mapInArrow(_patterns, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    if not counted.num_rows:
        return estimate(np.zeros((1, N_LABELLERS), np.int64), np.ones(1))
    return estimate(_unpack(counted["code"].to_numpy()), counted["n"].to_numpy())


def _slots(p: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every word and of its shape."""
    return np.concatenate([p["doc"], p["doc"]]), np.concatenate([(p["word"] % U64(WORDS)).astype(np.int64), WORDS + p["shape"]])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch["text"])
        code, rows = [], []
        for a, b in chunks(offsets):
            p = _parts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            doc, slot = _slots(p, b - a)
            code.append(votes(p) @ 3 ** np.arange(N_LABELLERS))
            x = np.bincount(doc * (WORDS + SHAPES) + slot, minlength=(b - a) * (WORDS + SHAPES)).reshape(b - a, -1)
            rows += [r.astype(np.uint16).tobytes() if r.max(initial=0) < 65536 else (r * 65535 // r.max()).astype(np.uint16).tobytes() for r in x]
        yield pa.record_batch([pa.array(np.concatenate(code) if code else [], pa.int64()), pa.array(rows, pa.binary())], ["code", "x"])


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, p: dict[str, np.ndarray]) -> np.ndarray:
        n = len(p["n"])
        doc, slot = _slots(p, n)
        z = np.bincount(doc, self.weights[slot], n) / np.maximum(p["n"], 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(documents: DataFrame, model: Accuracies, max_documents: int = 3000, steps: int = 250) -> Scorer:
    """Logistic regression on the posteriors of the ``max_documents`` documents of least hashed id;
    of an id that stands in several rows the text of least hash counts."""
    got = one_per_id(documents, max_documents, 31).mapInArrow(_examples, "code long, x binary").toArrow()
    if not got.num_rows:
        return Scorer(np.zeros(WORDS + SHAPES), 0.0)
    pairs = sorted(zip(got["code"].to_pylist(), got["x"].to_pylist(), strict=True))
    x = np.stack([np.frombuffer(r, np.uint16) for _, r in pairs]).astype(np.float32)
    x /= np.maximum(x.sum(1, keepdims=True) / 2, 1)
    y = model.posterior(_unpack(np.array([c for c, _ in pairs]))).astype(np.float32)
    scale = np.sqrt((x * x).mean(0) + 1e-7)
    x /= scale
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        g = (1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y) / len(y)
        g = np.append(x.T @ g.astype(np.float32) + 1e-3 * w, g.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - step[-1]
    return Scorer(w / scale, float(b))


RESULT = {"n_good": T.IntegerType(), "n_bad": T.IntegerType(), "posterior": T.DoubleType(), "score": T.DoubleType(), "kept": T.BooleanType()}


def classify(documents: DataFrame, model: Accuracies, scorer: Scorer) -> DataFrame:
    """Carried columns (not the text), votes for and against, posterior, score, and kept (score >= 0.5)."""
    carried = [c for c in documents.columns if c != "text" and c not in RESULT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch["text"])
            found = []
            for a, b in chunks(offsets):
                p = _parts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                v = votes(p)
                found.append(np.stack([(v == GOOD).sum(1), (v == BAD).sum(1), model.posterior(v), scorer.score(p)]))
            r = np.concatenate(found, 1) if found else np.zeros((4, 0))
            columns = [pa.array(r[0].astype(np.int32)), pa.array(r[1].astype(np.int32)), pa.array(r[2]), pa.array(r[3]), pa.array(r[3] >= 0.5)]
            yield pa.record_batch([*(batch[c] for c in carried), *columns], [*carried, *RESULT])

    schema = T.StructType([*documents.select(*carried).schema.fields, *(T.StructField(k, t) for k, t in RESULT.items())])
    return in_batches(documents).select(*carried, "text").mapInArrow(run, schema)
