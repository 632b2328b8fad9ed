"""Secret scan: three fixed patterns plus a linear-chain conditional random field.

The field tags the white-space words of each line as beginning, inside or outside a secret from
their shape, the neighbouring words and features of the whole file, and is decoded by Viterbi,
all lines of a batch side by side. It is trained here, by maximum likelihood with numpy, on
windows around what the fixed patterns find in a bounded sample of documents and on windows
elsewhere in it; it adds spans that no pattern overlaps and never removes one.

Defined cases: null text counts as empty; a text without secrets has no spans and an empty
joined string; equal texts give equal spans; ids may repeat or be null; without any finding in
the sample the field adds nothing; extra columns are carried unless named like a result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import in_batches, one_per_id
from .textops import U64, chunks, flat, lower_ascii, prefix_hash, span_hash, word_spans

# The patterns of the contract, in listed order, and the least length of each.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")
CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Hash slots of a word, and tags: outside, beginning, inside.
WORDS, OUT, BEGIN, INSIDE = 4096, 0, 1, 2
_SIZES = (512, 512, 512, WORDS, WORDS, WORDS, 64)
BASES = np.concatenate([[0], np.cumsum(_SIZES)])

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """What the three patterns find in one text, (start, end, kind) in code points."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def _candidates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents of the chunk in which a pattern could match."""
    raw, low = data.tobytes(), lower_ascii(data).tobytes()
    at = []
    for cue, where in [(c, low) for c in CUES] + [(b"AKIA", raw)]:
        i = where.find(cue)
        while i >= 0:
            at.append(i)
            i = where.find(cue, i + 1)
    hexa = np.zeros(len(data) + 2, bool)
    hexa[1:-1] = (data >= 48) & (data <= 57) | (data >= 97) & (data <= 102)
    # a run ends where its document does
    turn = hexa[1:] != hexa[:-1]
    turn[offsets] = True
    edge = np.flatnonzero(turn)
    first, size = edge[:-1], np.diff(edge)
    at += first[hexa[first + 1] & (size >= LEAST["hex"])].tolist()
    return np.unique(np.searchsorted(offsets, np.array(at, np.int64), "right") - 1)


@dataclass
class Words:
    """The words of a chunk: byte spans, document, line, and seven feature indices each."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    features: np.ndarray


def describe(data: np.ndarray, offsets: np.ndarray) -> Words:
    start, end, doc = word_spans(data, offsets)
    count = lambda mask: (c := np.concatenate([[0], np.cumsum(mask, dtype=np.int64)]))[end] - c[start]
    size = end - start
    digit = (data >= 48) & (data <= 57)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    n_digit, n_upper, n_lower = count(digit), count(upper), count(lower)
    n_mark = count((data == 61) | (data == 58))
    n_other = count(~(digit | upper | lower) & (data < 128))
    long = np.searchsorted([4, 8, 12, 16, 20, 24, 40], size, "right")
    shape = long * 64 + (n_digit * 4 >= size) * 32 + (n_digit > 0) * 16 + (n_upper > 0) * 8 + (n_lower > 0) * 4 + (n_mark > 0) * 2 + (n_other > n_mark)
    text = lower_ascii(data)
    # the word without marks and quotes around it
    soft = np.ones(256, bool)
    soft[[33, 34, 39, 40, 41, 44, 46, 58, 59, 61, 63, 91, 93, 123, 125]] = False
    inner = soft[text]
    near = np.arange(len(data))
    first = np.minimum.accumulate(np.where(inner, near, len(data))[::-1])[::-1] if len(data) else near
    final = np.maximum.accumulate(np.where(inner, near, -1)) if len(data) else near
    a = np.minimum(first[start], end) if len(start) else start
    b = np.maximum(final[end - 1] + 1, a) if len(start) else end
    word = (span_hash(prefix_hash(text), a, b) % U64(WORDS - 1)).astype(np.int64) + 1
    breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])[start] if len(start) else start
    line = np.cumsum(np.concatenate([[0], (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])])) if len(start) else start
    same = line[1:] == line[:-1] if len(start) else np.zeros(0, bool)

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if by > 0:
            out[1:] = np.where(same, x[:-1], 0)
        else:
            out[:-1] = np.where(same, x[1:], 0)
        return out

    n = len(offsets) - 1
    words = np.bincount(doc, minlength=n)
    assigns = np.bincount(doc, n_mark > 0, n)
    file = np.minimum(np.log2(words + 1).astype(np.int64), 15) * 4 + np.minimum(assigns, 3).astype(np.int64)
    parts = (shape, shifted(shape, 1), shifted(shape, -1), word, shifted(word, 1), shifted(word, -1), file[doc])
    return Words(start, end, doc, line, np.stack([p + s for p, s in zip(parts, BASES, strict=False)], 1))


@dataclass
class Field:
    """Weights of features by tag, and of transitions."""

    emit: np.ndarray
    step: np.ndarray

    @staticmethod
    def blank() -> Field:
        emit = np.zeros((BASES[-1], 3))
        step = np.zeros((3, 3))
        step[OUT, INSIDE] = -1e4
        return Field(emit, step)

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for k in range(features.shape[1]):
            out += self.emit[features[:, k]]
        return out

    def decode(self, features: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Best tags, by Viterbi over every line."""
        n = len(features)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        score = self.scores(features)
        first, size = _lanes(line)
        back = np.zeros((n, 3), np.int8)
        best = score[first].copy()
        best[:, INSIDE] -= 1e4
        for t in range(1, size[0]):
            k = int(np.searchsorted(-size, -t, "left"))
            at = first[:k] + t
            paths = best[:k, :, None] + self.step
            back[at] = paths.argmax(1)
            best[:k] = paths.max(1) + score[at]
        ends = first + size - 1
        tags[ends] = best.argmax(1)
        for t in range(int(size[0]) - 1, 0, -1):
            at = first[: int(np.searchsorted(-size, -t, "left"))] + t
            tags[at - 1] = back[at, tags[at]]
        return tags


def _lanes(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each line, longest line first."""
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    size = np.diff(np.append(first, len(line)))
    order = np.argsort(-size, kind="stable")
    return first[order], size[order]


def train(features: np.ndarray, line: np.ndarray, tags: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; expectations by the forward-backward sweeps of all lines at once."""
    field = Field.blank()
    if not (tags == BEGIN).any():
        return field
    first, size = _lanes(line)
    n, lanes = len(features), len(first)
    inner = np.flatnonzero(line[1:] == line[:-1]) if n > 1 else np.zeros(0, np.int64)
    seen_step = np.zeros((3, 3))
    np.add.at(seen_step, (tags[inner], tags[inner + 1]), 1)
    one = np.eye(3)[tags]
    free = np.ones((3, 3))
    free[OUT, INSIDE] = 0
    m = [np.zeros_like(field.emit), np.zeros((3, 3))]
    v = [np.zeros_like(field.emit), np.zeros((3, 3))]
    lse = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    for it in range(1, steps + 1):
        score = field.scores(features)
        ahead, behind = np.zeros((n, 3)), np.zeros((n, 3))
        ahead[first] = score[first] + [0, 0, -1e4]
        for t in range(1, int(size[0])):
            at = first[: int(np.searchsorted(-size, -t, "left"))] + t
            ahead[at] = lse(ahead[at - 1][:, :, None] + field.step, 1) + score[at]
        for t in range(int(size[0]) - 1, 0, -1):
            at = first[: int(np.searchsorted(-size, -t, "left"))] + t
            behind[at - 1] = lse(field.step + (score[at] + behind[at])[:, None, :], 2)
        total = np.zeros(n)
        total[first] = lse(ahead[first + size - 1], 1)
        total = _fill(total, first, n)
        chance = np.exp(ahead + behind - total[:, None])
        pair = np.exp(ahead[inner][:, :, None] + field.step + (score[inner + 1] + behind[inner + 1])[:, None, :] - total[inner][:, None, None])
        ge = np.zeros_like(field.emit)
        for k in range(features.shape[1]):
            for y in range(3):
                ge[:, y] += np.bincount(features[:, k], chance[:, y] - one[:, y], len(ge))
        grads = [ge / lanes + ridge * field.emit, (pair.sum(0) - seen_step) / lanes * free]
        for i, (g, w) in enumerate(zip(grads, (field.emit, field.step), strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            w -= 0.2 * (m[i] / (1 - 0.9**it)) / (np.sqrt(v[i] / (1 - 0.99**it)) + 1e-6)
    return field


def _fill(total: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Each word gets the value of its line's first word."""
    begins = np.sort(first)
    return np.repeat(total[begins], np.diff(np.append(begins, n)))


def _tag(words: Words, place: np.ndarray, offsets: np.ndarray, found: dict[int, list[Span]]) -> np.ndarray:
    tags = np.zeros(len(words.start), np.int64)
    for d, spans in found.items():
        lo, hi = np.searchsorted(words.doc, [d, d + 1])
        a = place[words.start[lo:hi]] - place[offsets[d]]
        b = place[words.end[lo:hi]] - place[offsets[d]]
        for s, e, _ in spans:
            hit = np.flatnonzero((a < e) & (b > s)) + lo
            inside = tags[hit] != OUT
            tags[hit] = INSIDE
            if len(hit) and not inside.any():
                tags[hit[0]] = BEGIN
    # a line break ends a secret
    if len(tags):
        opens = (tags == INSIDE) & np.concatenate([[True], words.line[1:] != words.line[:-1]])
        tags[opens] = BEGIN
    return tags


def _places(data: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])


def _base_of(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[Span]]:
    raw = data.tobytes()
    return {int(d): s for d in _candidates(data, offsets) if (s := base_spans(raw[offsets[d] : offsets[d + 1]].decode("utf-8", "replace")))}


#: Training windows around findings of one document, at most: evenly spread over them.
WINDOWS = 64


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training windows: 12 words around findings, and one window elsewhere in each text."""
    for batch in batches:
        data, offsets = flat(batch["text"])
        rows: dict[str, list[bytes]] = {"features": [], "tags": []}
        for lo, hi in chunks(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            words = describe(part, at)
            tags = _tag(words, _places(part), at, _base_of(part, at))
            begins = np.flatnonzero(tags == BEGIN)
            centre: list[int] = []
            for own in np.split(begins, np.flatnonzero(np.diff(words.doc[begins])) + 1):
                centre += own[np.linspace(0, len(own) - 1, min(len(own), WINDOWS)).astype(np.int64)].tolist()
            some, bound = np.flatnonzero(np.diff(words.doc, prepend=-1)), len(tags)
            size = np.diff(np.append(some, bound))
            centre += (some + (words.features[some, 3] * 7919) % np.maximum(size, 1)).tolist()
            for c in centre:
                sl = slice(max(0, c - 12), c + 12)
                same = words.line[sl] == words.line[c]
                rows["features"].append(words.features[sl][same].astype(np.int32).tobytes())
                rows["tags"].append(tags[sl][same].astype(np.int8).tobytes())
        yield pa.record_batch([pa.array(rows["features"], pa.binary()), pa.array(rows["tags"], pa.binary())], ["features", "tags"])


def fit(documents: DataFrame, max_documents: int = 6000) -> Field:
    """Train on windows of the ``max_documents`` documents of least hashed id, at most WINDOWS and one
    of a document; of an id that stands in several rows the text of least hash counts."""
    got = one_per_id(documents, max_documents, 29).mapInArrow(_windows, "features binary, tags binary").distinct().toArrow()
    rows = sorted(set(zip(got["features"].to_pylist(), got["tags"].to_pylist(), strict=True)))
    if not rows:
        return Field.blank()
    features = np.concatenate([np.frombuffer(f, np.int32).reshape(-1, len(_SIZES)) for f, _ in rows]).astype(np.int64)
    tags = np.concatenate([np.frombuffer(t, np.int8) for _, t in rows]).astype(np.int64)
    return train(features, np.repeat(np.arange(len(rows)), [len(t) for _, t in rows]), tags)


def find(column: pa.Array, field: Field) -> list[list[Span]]:
    """Spans of every text of the column, patterns' and field's."""
    data, offsets = flat(column)
    out: list[list[Span]] = []
    for lo, hi in chunks(offsets, 1 << 20):  # a sweep over lines costs by its longest one
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        found = _base_of(part, at)
        words = describe(part, at)
        tags = field.decode(words.features, words.line)
        place = None
        begins = np.flatnonzero(tags == BEGIN)
        for i in begins.tolist():
            j = i
            while j + 1 < len(tags) and tags[j + 1] == INSIDE and words.line[j + 1] == words.line[i]:
                j += 1
            place = _places(part) if place is None else place
            d = int(words.doc[i])
            a, b = int(place[words.start[i]] - place[at[d]]), int(place[words.end[j]] - place[at[d]])
            spans = found.setdefault(d, [])
            if all(b <= s or a >= e for s, e, _ in spans):
                spans.append((a, b, "crf"))
        out += [sorted(found.get(d, []), key=lambda s: (s[0], KINDS.index(s[2]))) for d in range(hi - lo)]
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(documents: DataFrame, field: Field) -> DataFrame:
    """Carried columns (not the text) and ``spans``, an array of (kind, start, end)."""
    carried = [c for c in documents.columns if c not in ("text", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for a, b, k in spans] for spans in find(batch["text"], field)]
            yield pa.record_batch([*(batch[c] for c in carried), pa.array(rows, _SPANS_ARROW)], [*carried, "spans"])

    schema = T.StructType([*documents.select(*carried).schema.fields, T.StructField("spans", SPANS)])
    return in_batches(documents).select(*carried, "text").mapInArrow(run, schema)


def redact(documents: DataFrame, field: Field, mask: str = "[SECRET]") -> DataFrame:
    """The same columns, with ``mask`` in place of every span of ``text``; spans that overlap
    become one. ``n_chars``, where there is such a column, follows the text."""
    schema = documents.schema

    def cover(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for a, b, _ in sorted(spans):
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(batch["text"], field)
            texts = batch["text"].to_pylist()
            texts = [cover(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            columns = []
            for f in batch.schema:
                if f.name == "text":
                    columns.append(pa.array(texts, f.type))
                elif f.name == "n_chars":
                    old = batch["n_chars"].to_pylist()
                    columns.append(pa.array([len(t) if s else n for t, s, n in zip(texts, found, old, strict=True)], f.type))
                else:
                    columns.append(batch[f.name])
            yield pa.record_batch(columns, batch.schema.names)

    return in_batches(documents).mapInArrow(run, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts by kind, hash of the patterns' spans, and all spans, joined."""
    text = lambda kinds: F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(text(KINDS[:3]), 256).alias("base_sha256"),
        text(KINDS).alias("spans"),
        count("crf"),
    )


def sha_of(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
