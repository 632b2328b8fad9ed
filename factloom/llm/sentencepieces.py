"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

The distinct marked words of a batch are sorted and made a trie; each of its nodes is a prefix, whose
forward state is found once for all words that share it. For a BPE model all prefixes of one length
are searched at once, from the shortest on. Long words, and those of a unigram model, are searched one
after another: the states of the prefix that a word shares with the word before it are kept on a
stack. A word's ids then serve all its occurrences.

A forward state at position i holds the best last piece of the prefix of length i. For a
unigram model it is the piece of highest total log-probability. For a BPE model piece scores
only order merges and their sum means nothing, so the lattice admits a piece after another only
where merging their joint text gives exactly these two; one path is left, the one that merging
gives. Both give the ids of the reference implementation of the model.

Defined cases: null or empty text has no ids and decodes to ""; characters outside the
vocabulary become byte pieces (or the unknown id if the model has none); U+2581 in a text stands
for a space, as in the model's own rules, so only such texts (and those a model without byte
pieces cannot spell) do not come back unchanged; ids of documents may repeat or be null; extra
columns are carried unless they have the names of the results, which replace them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .components import in_batches
from .textops import chunks, flat

MARK = "▁"
#: Pairs of pieces that a Python worker remembers, of all words (a table of 8 bytes each, by the bits
#: of a hash), and of those longer than LONG (some 100 bytes each).
PLACES, PAIRS, LONG = 20, 100_000, 48
#: Bits of a number of a piece (or of a character that is no piece), and what stands for no piece.
WIDE, NONE = 22, (1 << 22) - 1
#: Words that are searched, and whose ids are put in place, at a time.
TOKENS = 1 << 17
#: Bytes of text that are cut into words at a time; a longer text is alone.
SLICE = 1 << 22


class Recent(dict):
    """The latest results: a full generation becomes the older one, whose hits move to the new."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.half, self.older = size // 2, {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        found = self.older.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:  # noqa: ANN001
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value


class Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Pieces:
    """A vocabulary with its search; plain data, so it travels to executors."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], special: set[int], unk: int, bpe: bool) -> None:
        self.pieces, self.scores, self.byte_ids, self.special, self.unk, self.bpe = pieces, scores, byte_ids, special, unk, bpe
        self.of = {p: i for i, p in enumerate(pieces) if i not in special and i not in set(byte_ids.values())}
        self.longest = max(map(len, self.of), default=1)
        inner = set().union(*(p for p in self.of if len(p) > 1)) if self.of else set()
        #: White space that is part of no longer piece bounds a word: nothing merges across it.
        self.alone = "".join(c for c in "\n\t\r\x0b\x0c" if c not in inner)
        other = re.escape(self.alone)
        self.pattern = f"{MARK}+[^{MARK}{other}]*|[^{MARK}{other}]+" + (f"|[{other}]" if other else "")
        table = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in byte_ids.items():
            table[i] = bytes([b])
        for i in special:
            table[i] = b""
        table[unk] = " ⁇ ".encode()
        self.spelled = table
        #: Lower for pieces that merge earlier.
        self.rank = {p: -scores[i] for p, i in self.of.items()}
        self._endings()
        self._reset()

    def _endings(self) -> None:
        """A trie of all pieces from their ends: ``edges`` (state and character, sorted) lead ``to`` states;
        ``ended`` has the piece that a state stands for, or -1."""
        steps, ended = {}, [-1]
        for piece, i in self.of.items():
            state = 0
            for c in reversed(piece):
                key = state << 21 | ord(c)
                state = steps.get(key)
                if state is None:
                    state = steps[key] = len(ended)
                    ended.append(-1)
            ended[state] = i
        self.edges = np.array(sorted(steps) or [-1], np.int64)
        self.to = np.array([steps.get(k, 0) for k in self.edges.tolist()], np.int64)
        self.ended = np.array(ended, np.int64)

    def _reset(self) -> None:
        self.pairs, self.known = Recent(PAIRS), np.full(1 << PLACES, -1, np.int64)
        #: Whether merging gives a piece whole: at most an entry for each piece of the vocabulary.
        self.whole: dict[str, bool] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("pairs", "known", "whole")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def merged(self, text: str, apart: int = 0) -> list[str]:
        """The model's own merging: the adjacent pair of highest score, leftmost on ties. Ends early, with
        no parts, where it would join what stands on both sides of place ``apart``."""
        parts, get, never = list(text), self.rank.get, float("inf")
        ranks = [get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < never:
            at = ranks.index(least)
            if at < apart:
                if at == apart - 1:
                    return []
                apart -= 1
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], never)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], never)
        return parts

    def _joins(self, left: str, right: str, a: int, b: int) -> bool:
        """Whether merging their joint text gives exactly these two, of ids ``a`` and ``b``."""
        if not self._is_whole(right):
            return False
        if not left:
            return True
        # no piece or marked word holds a space
        key = a << 32 | b if a >= 0 and b >= 0 else f"{left} {right}"
        ok = self.pairs[key]
        if ok is None:
            ok = self.merged(left + right, len(left)) == [left, right]
            self.pairs.keep(key, ok)
        return ok

    def _is_whole(self, piece: str) -> bool:
        if len(piece) < 2:
            return True
        ok = self.whole.get(piece)
        if ok is None:
            ok = self.whole[piece] = self.merged(piece) == [piece]
        return ok

    def _text(self, k: int) -> str:
        return self.pieces[k] if k < len(self.pieces) else chr(k - len(self.pieces))

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of many pairs of numbers, whether merging their joint text gives exactly these two. What was
        found is kept in one of two places that the pair's hash names, where a later pair may replace it."""
        key = left << WIDE | right
        place = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES)).astype(np.int64)
        held = self.known[place]
        other = np.flatnonzero(held >> 1 != key)
        held[other] = self.known[place[other] ^ 1]
        new = other[held[other] >> 1 != key[other]]
        if len(new):
            keys, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            found = []
            for k in keys.tolist():
                a, b = k >> WIDE, self._text(k & NONE)
                ok = self._is_whole(b)
                if ok and a != NONE:
                    a = self._text(a)
                    ok = self.merged(a + b, len(a)) == [a, b]
                found.append(k << 1 | ok)
            found, to = np.array(found, np.int64), place[new[first]]
            self.known[np.where(self.known[to] < 0, to, to ^ 1)] = found
            held[new] = found[which]
        return (held & 1).astype(bool)

    def walk(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of a BPE model, ids of the sorted distinct ``words`` in one array, and how many each has: all
        prefixes of one length are searched at once."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        begin = np.cumsum(size) - size
        # the trie, a level at a time: words that share a prefix stand together
        node, live, nodes = np.zeros(len(words), np.int64), np.arange(len(words)), 1
        levels, depth = [], 0
        while len(live := live[size[live] > depth]):
            c, up = chars[begin[live] + depth].astype(np.int64), node[live]
            new = np.ones(len(live), bool)
            new[1:] = (c[1:] != c[:-1]) | (up[1:] != up[:-1])
            node[live] = nodes - 1 + np.cumsum(new)
            first = np.flatnonzero(new)
            levels.append((c[first], up[first], live[first]))
            nodes += len(first)
            depth += 1
        char = np.concatenate([np.zeros(1, np.int64), *(x[0] for x in levels)])
        parent = np.concatenate([np.zeros(1, np.int64), *(x[1] for x in levels)])
        # the last piece of each prefix, the prefix before it, and how many ids there are up to here
        last, back, count = np.full(nodes, -1, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        last[0] = NONE
        vocabulary, lo = len(self.pieces), 1
        for depth, (c, _, word) in enumerate(levels, 1):
            v = at = np.arange(lo, lo + len(c))
            state = np.zeros(len(c), np.int64)
            for n in range(1, self.longest + 1):
                c = char[at]
                key = state << 21 | c
                edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                state = np.where(self.edges[edge] == key, self.to[edge], 0)
                piece = self.ended[state]
                if n == 1:
                    piece = np.where(piece < 0, vocabulary + c, piece)
                up = parent[at]
                able = np.flatnonzero(piece >= 0)
                done = able[self._join(last[up[able]], piece[able])]
                last[v[done]], back[v[done]] = piece[done], up[done]
                rest = (state > 0) & (up > 0)
                rest[done] = False
                v, at, state = v[rest], up[rest], state[rest]
                if not len(v):
                    break
            level = slice(lo, lo + len(word))
            for k in np.flatnonzero(last[level] < 0).tolist():  # no path in the lattice: merge this prefix itself
                best = self.merged(words[word[k]][:depth])[-1]
                last[lo + k] = self.of.get(best, vocabulary + ord(best[0]))
                at = lo + k
                for _ in best:
                    at = parent[at]
                back[lo + k] = at
            count[level] = count[back[level]] + self._widths(last[level])
            lo += len(word)
        many = count[node]
        ids, end = np.empty(int(many.sum()), np.int32), np.cumsum(many)
        while len(node):
            piece = last[node]
            wide = self._widths(piece)
            end = end - wide
            ids[end] = np.where(piece < vocabulary, piece, self.unk)
            if self.byte_ids and len(odd := np.flatnonzero(piece >= vocabulary)):
                kinds, which = np.unique(piece[odd], return_inverse=True)
                spelled = [[self.byte_ids[b] for b in chr(k - vocabulary).encode()] for k in kinds.tolist()]
                for k in range(4):
                    part = np.array([x[k] if k < len(x) else -1 for x in spelled])[which]
                    ids[end[odd][part >= 0] + k] = part[part >= 0]
            node = back[node]
            end, node = end[node > 0], node[node > 0]
        return ids, many

    def _widths(self, piece: np.ndarray) -> np.ndarray:
        """How many ids there are for each: bytes for a character that is no piece."""
        if not self.byte_ids:
            return np.ones(len(piece), np.int64)
        c = piece - len(self.pieces)
        return 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)

    def search(self, words: list[str]) -> Iterator[tuple[int, ...]]:
        """Ids of each of the sorted ``words``: one walk of their trie."""
        of, longest, score = self.of, self.longest, [0.0]
        last, number, before = [""], [-1], ""
        for word in words:
            n, keep = min(len(before), len(word)), 0
            while keep < n and before[keep] == word[keep]:
                keep += 1
            del last[keep + 1 :], number[keep + 1 :], score[keep + 1 :]
            for i in range(keep + 1, len(word) + 1):
                best, at, top = None, -1, -1e300
                for j in range(i - 1, max(-1, i - longest - 1), -1):
                    piece = word[j:i]
                    k = of.get(piece, -1)
                    if k < 0 and i - j > 1:
                        continue
                    if self.bpe:
                        if self._joins(last[j], piece, number[j], k):
                            best, at = piece, k
                            break
                    else:
                        s = score[j] + (self.scores[k] if k >= 0 else -100.0)
                        if s > top:
                            best, at, top = piece, k, s
                if best is None:  # no path in the lattice: merge this prefix itself
                    best = self.merged(word[:i])[-1]
                    at = of.get(best, -1)
                last.append(best)
                number.append(at)
                score.append(top)
            before = word
            parts, i = [], len(word)
            while i:
                parts.append((last[i], number[i]))
                i -= len(last[i])
            ids: list[int] = []
            for piece, k in reversed(parts):
                if k >= 0:
                    ids.append(k)
                elif self.byte_ids:
                    ids += [self.byte_ids[b] for b in piece.encode()]
                else:
                    ids.append(self.unk)
            yield tuple(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins (length + 1)."""
        split, number = re.compile(self.pattern).findall, Numbers()
        codes = [np.fromiter(map(number.__getitem__, split(MARK + t.replace(" ", MARK))), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        words = sorted(number)
        alone = [w for w in words if len(w) > LONG] if self.bpe else words
        near = [w for w in words if len(w) <= LONG] if self.bpe else []
        walked = [self.walk(near[lo : lo + TOKENS]) for lo in range(0, len(near), TOKENS)]
        others = list(self.search(alone))
        ids = np.concatenate([*(x for x, _ in walked), np.fromiter(chain.from_iterable(others), np.int32)])
        size = np.concatenate([*(n for _, n in walked), np.fromiter(map(len, others), np.int64, len(others))])
        # the ids of each distinct word once, then gathered for all its occurrences
        rank = np.empty(len(words), np.int64)
        rank[np.fromiter(map(number.__getitem__, chain(near, alone)), np.int64, len(words))] = np.arange(len(words))
        first, size = (np.cumsum(size) - size)[rank], size[rank]
        del number, words, alone, near, walked, others, rank
        bounds = np.cumsum([0, *map(len, codes)])
        codes = np.concatenate([np.zeros(0, np.int32), *codes])
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size[codes])])
        out = np.empty(ends[-1], np.int32)
        for lo in range(0, len(codes), TOKENS):
            c = codes[lo : lo + TOKENS]
            a, b = ends[lo : lo + len(c)], ends[lo + len(c)]
            out[a[0] : b] = ids[np.repeat(first[c] - a, size[c]) + np.arange(a[0], b)]
        return out, ends[bounds]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text, the mark before its first word left out."""
        out = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return out[1:] if out[:1] == b" " else out


def load(model_path: str) -> Pieces:
    """Read a SentencePiece model file; only its vocabulary is taken from the library."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(i) for i in range(n)]
    special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
    scores = [m.get_score(i) for i in range(n)]
    ordinary = [s for i, s in enumerate(scores) if i not in special and not m.is_byte(i)]
    bpe = bool(ordinary) and all(s == int(s) for s in ordinary)
    return Pieces(pieces, scores, {int(pieces[i][3:5], 16): i for i in range(n) if m.is_byte(i)}, special, m.unk_id(), bpe)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, some SLICE bytes of text at a time: the more words meet, the more they share."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        _, offsets = flat(whole["text"])
        for lo, hi in chunks(offsets, SLICE):
            held.append(whole.slice(lo, hi - lo))
            size += int(offsets[hi] - offsets[lo])
            if size >= SLICE // 2:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


RESULT = ("n_tokens", "token_ids", "ids_sha256", "decoded_sha256", "round_trip")


def encode(documents: DataFrame, pieces: Pieces, digests: bool = True) -> DataFrame:
    """Carried columns (not the text) and n_tokens, token_ids; with ``digests`` also ids_sha256
    (of little-endian 32-bit ids), decoded_sha256 and round_trip, from decoding the ids again."""
    carried = [c for c in documents.columns if c != "text" and c not in RESULT]
    shared = documents.sparkSession.sparkContext.broadcast(pieces)  # one vocabulary: its size is fixed
    names = RESULT if digests else RESULT[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        for batch in _slices(batches):
            texts = batch["text"].to_pylist()
            ids, at = search.encode(texts)
            found = [pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))]
            if digests:
                parts = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
                back = [search.decode(x) for x in parts]
                sha = lambda x: hashlib.sha256(x).hexdigest()
                found += [pa.array([sha(x.astype("<i4").tobytes()) for x in parts]), pa.array(list(map(sha, back))), pa.array([x == (t or "").encode() for x, t in zip(back, texts, strict=True)])]
            yield pa.record_batch([*(batch[c] for c in carried), *found], [*carried, *names])

    kinds = dict(zip(RESULT, (T.LongType(), T.ArrayType(T.IntegerType()), T.StringType(), T.StringType(), T.BooleanType()), strict=True))
    schema = T.StructType([*documents.select(*carried).schema.fields, *(T.StructField(c, kinds[c]) for c in names)])
    return in_batches(documents).select(*carried, "text").mapInArrow(run, schema)


def decode(documents: DataFrame, pieces: Pieces, ids: str = "token_ids") -> DataFrame:
    """All columns but one named text, and ``text``, which the ids spell (null or no ids: "").
    Bytes that are no UTF-8, as ids in an order that no text has can give, become U+FFFD."""
    carried = [c for c in documents.columns if c != "text"]
    shared = documents.sparkSession.sparkContext.broadcast(pieces)  # one vocabulary: its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = shared.value.decode
        for batch in batches:
            texts = [spell(np.asarray(x.values)).decode("utf-8", "replace") if x.is_valid else "" for x in batch[ids]]
            yield pa.record_batch([*(batch[c] for c in carried), pa.array(texts, pa.string())], [*carried, "text"])

    schema = T.StructType([*documents.select(*carried).schema.fields, T.StructField("text", T.StringType())])
    return in_batches(documents).select(*carried).mapInArrow(run, schema)
