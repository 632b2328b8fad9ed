"""Exact substring removal by merging Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes over it also starts in a document of smaller id.

Routing. Each such string has one anchor: of the hashes of its ANCHOR-byte substrings the least,
leftmost on ties. It depends on the string's bytes only, so all places of a string meet under the
hash of its anchor. Consecutive strings of one anchor form a context of less than twice ``length``
bytes. Documents are dealt to blocks once; a block and the buckets that anchors are hashed to then
talk in three rounds, all of which the block answers from its own texts:

1. the block sends the distinct anchors it has, as differences of sorted hashes; a bucket answers
   which of them stand in another document, and which have very many contexts;
2. for these anchors, each distinct context travels as a hash with its least id: this settles the
   copies of a whole context, of which only the one of least id goes on, and only where another
   context of its anchor has the same bytes on one side of it (as a hash of half of what a string
   has beside its anchor): anchors that meet by chance, which grow with the square of the corpus,
   send no text. The contexts of a very frequent anchor are taken apart into their single
   strings here, which are nothing but whole copies, so no anchor gathers in one task;
3. the bytes of what is still open, one context for all its copies, go to the merge.

Merging. What remains under an anchor are different contexts that may share shorter strings. They
are put into shards; each shard's multi-string Burrows-Wheeler transform is built on its own, and
the transforms are merged by iterative interleave refinement (Holt and McMillan 2014; Egidi and
Manzini 2017): starting from the shards one behind the other, each round sends every entry to the
place of the suffix that begins one symbol earlier, by one stable sort on the symbols. After k
rounds the interleave is right for prefixes of length k, and a boundary that appears in round k
is a common prefix of k - 1. Suffixes are never compared or sorted again. After ``length`` rounds
the intervals between boundaries are the repeated strings; in each, entries of larger documents
than its least one give the bytes to remove.

Hashes route and pre-aggregate: two contexts count as copies where 48 bits of their anchor's hash
and 48 bits of their own agree; partial matches are decided on bytes.

Defined cases: null text counts as empty; texts shorter than ``length`` lose nothing; null ids
order after all others; rows with equal ids take nothing from each other; each input row gives one
row (equal rows equal ones); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import U64, flat, mix, powers, prefix_hash, span_hash

#: Bytes of an anchor.
ANCHOR = 32
#: Bits of an anchor's and of a context's hash that travel.
BITS = U64(48)
#: Bits of an anchor's hash that stay behind in round 1, where two anchors taken for one only lead
#: to more entries.
SPARE = U64(8)
#: Bytes of text that are hashed at a time.
SEGMENT = 1 << 15
#: Bits of a place in a segment, or in a block; the other bits of a packed value order the anchors.
PLACE = U64(24)
_COUNT = np.arange(1 << 17, dtype=U64)
#: An anchor with more contexts than this, counted block by block, is taken apart into strings.
HOT = 2000
#: Bytes of contexts in a shard whose transform is built on its own, and in one merge, at least.
SHARD, MERGE = 1 << 15, 1 << 21
#: Symbols of a suffix that its entry carries, from which the first interleave is made.
SEED = 6
#: Blocks and buckets for each partition of the input. Every block writes to every bucket, so messages
#: grow with the square of the partitions.
BLOCKS, BUCKETS = 4, 1
TOP = (1 << 63) - 1


# ---- contexts -----------------------------------------------------------------------------


def contexts(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Start in ``data``, size, anchor's place in it, anchor hash and own hash of every context, by
    start. Contexts also end where a segment does, which no result depends on."""
    n = len(data)
    size = np.diff(offsets)
    ok = size >= length
    turn = np.zeros(n + 1, np.int8)
    turn[offsets[:-1][ok]] += 1
    turn[offsets[1:][ok] - length + 1] -= 1
    valid = np.cumsum(turn, dtype=np.int8).astype(bool)
    found = []
    for low in range(0, max(0, n - length + 1), SEGMENT):
        piece = data[low : low + SEGMENT + length - 1]
        prefix, (_, down) = prefix_hash(piece), powers(len(piece) + 1)
        anchor = prefix[ANCHOR:] - prefix[:-ANCHOR]
        anchor *= down[: len(anchor)]
        anchor = mix(anchor)
        least = anchor >> PLACE
        least <<= PLACE
        least |= _COUNT[: len(anchor)] if len(anchor) <= len(_COUNT) else np.arange(len(anchor), dtype=U64)
        width, span = length - ANCHOR + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        place = (least & ((U64(1) << PLACE) - U64(1))).astype(np.int64)
        here = valid[low : low + len(place)]
        change = np.ones(len(place) + 1, bool)
        change[1:-1] = (place[1:] != place[:-1]) | (here[1:] != here[:-1])
        cut = np.flatnonzero(change)
        first = cut[:-1][here[cut[:-1]]]
        last = cut[1:][here[cut[:-1]]] - 1 + length
        place = place[first]
        own = mix((prefix[last] - prefix[first]) * down[first])
        # the least hashes are chosen, so they are mixed again to be even
        found.append((first + low, last - first, place - first, mix(anchor[place] ^ U64(0x9E3779B97F4A7C15)) >> (U64(64) - BITS), own >> (U64(64) - BITS)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), none.astype(U64)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def ordered_places(hashes: np.ndarray) -> np.ndarray:
    """Places of hashes of BITS bits, by hash. The upper bits are sorted as one number with the place,
    which is quicker than sorting places; the few runs that the other bits divide are sorted again."""
    n, spare = len(hashes), BITS + PLACE - U64(64)
    if n > 1 << int(PLACE):
        return np.argsort(hashes, kind="stable")
    packed = hashes >> spare << PLACE
    packed |= np.arange(n, dtype=U64)
    packed.sort()
    packed &= (U64(1) << PLACE) - U64(1)
    order = packed.view(np.int64)
    found = hashes[order]
    late = np.flatnonzero(found[1:] < found[:-1])
    if len(late):
        upper = found >> spare
        for value in np.unique(upper[late]):
            a, b = np.searchsorted(upper, [value, value + U64(1)])
            order[a:b] = order[a:b][np.argsort(found[a:b], kind="stable")]
    return order


# Messages are many and short (blocks times buckets), so all that goes to or came from other places is
# worked on at once, and only cut from one array or put into it message by message.


def _rows(values: np.ndarray) -> np.ndarray:
    """The bytes of each number."""
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)


def _planes(rows: np.ndarray, width: int = 6) -> bytes:
    """The low bytes of all numbers, then the next ones: high planes of small numbers compress away."""
    return rows.T[:width].tobytes()


def _numbers(planes: list[bytes], width: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all messages, and how many each has."""
    sizes = np.array([len(x) // width for x in planes], np.int64)
    out, at = np.zeros((int(sizes.sum()), 8), np.uint8), 0
    for x, n in zip(planes, sizes.tolist(), strict=True):
        out[at : at + n, :width] = np.frombuffer(x, np.uint8).reshape(width, n).T
        at += n
    return out.view("<u8").ravel(), sizes


def _steps(ordered: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences, anew from each start."""
    out = np.diff(ordered, prepend=ordered[:1] * 0)
    out[starts] = ordered[starts]
    return out


def _sums(planes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ordered numbers of all messages of differences, and how many each has."""
    steps, sizes = _numbers(planes, 8)
    total, starts = np.cumsum(steps, dtype=U64), np.cumsum(sizes) - sizes
    return total - np.repeat(total[starts] - steps[starts], sizes), sizes


def _packed(flags: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Eight flags to a byte, for each message."""
    wide = -(-sizes // 8)
    ends = np.cumsum(wide)
    out = np.zeros(8 * int(wide.sum()), bool)
    out[np.arange(len(flags)) + np.repeat(8 * (ends - wide) - (np.cumsum(sizes) - sizes), sizes)] = flags
    raw = np.packbits(out).tobytes()
    return [raw[b - n : b] for b, n in zip(ends.tolist(), wide.tolist(), strict=True)]


def _flags(packed: list[bytes], sizes: np.ndarray) -> np.ndarray:
    wide = -(-sizes // 8)
    out = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8)).view(bool)
    return out[np.arange(sizes.sum()) + np.repeat(8 * (np.cumsum(wide) - wide) - (np.cumsum(sizes) - sizes), sizes)]


def _heads(*ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    new = np.zeros(len(ordered[0]), bool)
    new[:1] = True
    for x in ordered:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _runs(heads: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(heads, n))


def _bounds(heads: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Where each run begins and ends."""
    return zip(heads.tolist(), [*heads[1:].tolist(), n][: len(heads)], strict=True)


class Block:
    """The documents of a block, in an order of their own, with their contexts and entries."""

    def __init__(self, docs: pa.Table, replies: pa.Table | None, length: int, buckets: int) -> None:
        ids, keys = docs["doc_id"].to_numpy(), docs["row_key"].to_numpy()
        docs = docs.take(pa.array(np.lexsort((keys, ids))))
        self.ids, self.length, self.buckets = docs["doc_id"].to_numpy(), length, buckets
        self.data, self.offsets = flat(docs["text"])
        self.start, self.size, self.place, self.anchor, self.own = contexts(self.data, self.offsets, length)
        self.owner = self.ids[np.searchsorted(self.offsets, self.start, "right") - 1] if len(self.start) else self.start
        self.order = ordered_places(self.anchor)
        self.heads = _heads(self.anchor[self.order])
        self.said: dict[int, list] = {1: [], 2: [], 3: []}
        if replies is not None:
            for kind, bucket, x, y in sorted(zip(*(replies[c].to_pylist() for c in ("kind", "bucket", "x", "y")), strict=True)):
                self.said[kind].append((bucket, x, y))

    def parts(self, ordered: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """Where the buckets of sorted hashes begin; the buckets, and which part each has."""
        of = ((ordered * U64(self.buckets)) >> BITS).astype(np.int64)
        starts = _heads(of)
        return starts, [(k, slice(a, b)) for k, (a, b) in zip(of[starts].tolist(), _bounds(starts, len(of)), strict=True)]

    def anchors(self) -> Iterator[tuple]:
        """Round 1: (bucket, distinct anchors, contexts of each up to 127 and 128 if of two ids)."""
        runs = _runs(self.heads, len(self.order))
        known = np.ones(len(self.heads), np.uint8)
        many = runs > 1
        if many.any():
            at = self.order[np.repeat(many, runs)]
            run = np.repeat(np.arange(len(runs))[many], runs[many])
            by = np.lexsort((self.own[at], run))
            at, run = at[by], run[by]
            first = _heads(run)
            owner = self.owner[at]
            distinct = np.bincount(run[_heads(run, self.own[at])], minlength=len(runs))[many]
            two = np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first)
            known[many] = np.minimum(distinct, 127) + two * 128
        ordered = self.anchor[self.order[self.heads]]
        starts, parts = self.parts(ordered)
        steps = _rows(_steps(ordered >> SPARE, starts))
        for bucket, part in parts:
            yield bucket, _planes(steps[part], 8), known[part].tobytes()

    def _told(self, kind: int, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two flags for each of the sorted hashes, as the buckets answered."""
        starts, parts = self.parts(ordered)
        if [k for k, _ in parts] != [k for k, _, _ in self.said[kind]]:
            raise ValueError("a bucket did not answer once")
        sizes = _runs(starts, len(ordered))
        x, y = (_flags([a[i] for a in self.said[kind]], sizes) for i in (1, 2))
        return x, y

    def settle(self) -> None:
        """Round 2: the contexts, or strings, of anchors that stand in other documents too; ``entry``
        numbers those that are equal, whose least owner is ``least``."""
        runs = _runs(self.heads, len(self.order))
        shared, hot = (np.repeat(f, runs) for f in self._told(1, self.anchor[self.order[self.heads]]))
        whole, apart = np.sort(self.order[shared & ~hot]), np.sort(self.order[shared & hot])
        key, own = [self.anchor[whole]], [self.own[whole]]
        self.at, self.long, self.by = self.start[whole], self.size[whole], self.owner[whole]
        self.single = np.zeros(len(whole), bool)
        if len(apart):
            n = self.size[apart] - self.length + 1
            first, owner, part = [], [], np.cumsum(n) // SEGMENT  # their bytes are hashed some at a time
            for g in np.split(np.arange(len(apart)), np.flatnonzero(part[1:] != part[:-1]) + 1):
                begin, size, n_g = self.start[apart[g]], self.size[apart[g]], n[g]
                base = np.cumsum(size) - size
                text = self.data[np.repeat(begin - base, size) + np.arange(size.sum())]
                step = np.arange(n_g.sum()) - np.repeat(np.cumsum(n_g) - n_g, n_g)
                at = np.repeat(base, n_g) + step
                value = span_hash(prefix_hash(text), at, at + self.length)
                key.append(mix(value ^ U64(0xD6E8FEB86659FD93)) >> (U64(64) - BITS))
                own.append(value >> (U64(64) - BITS))
                first.append(np.repeat(begin, n_g) + step)
                owner.append(np.repeat(self.owner[apart[g]], n_g))
            self.at, self.by = np.concatenate([self.at, *first]), np.concatenate([self.by, *owner])
            self.long = np.concatenate([self.long, np.full(len(self.at) - len(whole), self.length)])
            self.single = np.arange(len(self.at)) >= len(whole)
        self.place_of = np.concatenate([self.place[whole], np.zeros(len(self.at) - len(whole), np.int64)])
        key, own = np.concatenate(key), np.concatenate(own)
        order = np.lexsort((self.by, own, key))
        key, own, self.inst = key[order], own[order], order
        self.first = _heads(key, own)
        self.key, self.value = key[self.first], own[self.first]
        self.entry = np.repeat(np.arange(len(self.first)), _runs(self.first, len(order)))
        self.least = self.by[order[self.first]]

    def sides(self) -> np.ndarray:
        """Of each entry 8 bits for the bytes left of its anchor and 8 for those on the right, as many
        as two contexts that share a string have in common on one side at least; 0: too few there."""
        inst, need = self.inst[self.first], -(-(self.length - ANCHOR) // 2)
        at, out = self.at[inst] + self.place_of[inst], np.zeros(len(inst), U64)
        room = self.place_of[inst], self.long[inst] - self.place_of[inst] - ANCHOR
        for side, (have, first) in enumerate(zip(room, (at - need, at + ANCHOR), strict=True)):
            some = np.flatnonzero((have >= need) & ~self.single[inst])
            value = np.zeros(len(some), U64)
            for k in range(need):
                value = value * U64(0x100000001B3) + self.data[first[some] + k].astype(U64) + U64(1)
            out[some] |= (mix(value) % U64(255) + U64(1)) << U64(8 * side)
        return out

    def entries(self) -> Iterator[tuple]:
        """(bucket, hashes, context hashes, sides, rank of the owner, owners) of all entries."""
        starts, parts = self.parts(self.key)
        steps, value, sides = _rows(_steps(self.key, starts)), _rows(self.value), _rows(self.sides())
        least, of = self.least.astype(np.int64), np.repeat(np.arange(len(starts)), _runs(starts, len(self.key)))
        order = np.lexsort((least, of))
        heads = _heads(of[order], least[order])
        first = np.searchsorted(heads, starts)  # of each bucket's owners
        rank = np.zeros(len(order), np.int64)
        rank[order] = np.repeat(np.arange(len(heads)), _runs(heads, len(order)))
        rank, ids = _rows(rank - first[of]), _rows(_steps(least[order[heads]].view(U64), first))
        for (bucket, part), (a, b) in zip(parts, _bounds(first, len(heads)), strict=True):
            yield bucket, _planes(steps[part], 8), _planes(value[part]), _planes(sides[part], 2), _planes(rank[part], 4), _planes(ids[a:b], 8)

    def answer(self) -> None:
        self.covered, self.open = self._told(2, self.key)

    def opened(self) -> Iterator[tuple]:
        """(bucket, hashes, entries, owners, sizes, places, bytes) of one context for each open entry."""
        inst = self.inst[self.first]
        keep = np.flatnonzero(self.open & ~self.covered & ~self.single[inst])
        ordered, inst = self.key[keep], inst[keep]
        starts, parts = self.parts(ordered)
        at, size = self.at[inst], self.long[inst]
        end = np.cumsum(size)
        text = self.data[np.repeat(at - (end - size), size) + np.arange(size.sum())]
        steps, keep_, sizes, place = _rows(_steps(ordered, starts)), _rows(keep), _rows(size), _rows(self.place_of[inst])
        owner = _rows(self.least[keep].astype(np.int64).view(U64))
        for bucket, part in parts:
            own = text[end[part.start] - size[part.start] : end[part.stop - 1]]
            yield bucket, _planes(steps[part], 8), _planes(keep_[part], 4), _planes(owner[part], 8), _planes(sizes[part], 4), _planes(place[part], 4), own.tobytes()

    def gone(self) -> np.ndarray:
        """Whether each byte goes."""
        owner, entry = self.by[self.inst], self.entry
        whole = self.covered[entry] | (owner > self.least[entry])
        edge = np.zeros(len(self.data) + 1, np.int32)
        at, size = self.at[self.inst], self.long[self.inst]
        np.add.at(edge, at[whole], 1)
        np.add.at(edge, at[whole] + size[whole], -1)
        runs = _runs(self.first, len(entry))
        if self.said[3]:
            named, place = (_numbers([a[i] for a in self.said[3]], 4)[0].astype(np.int64) for i in (1, 2))
            # every copy in the block of the context that was merged
            n = runs[named]
            copies = np.repeat(self.first[named] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            begin = at[copies] + np.repeat(place, n)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + self.length, -1)
        np.cumsum(edge, out=edge)
        return edge[:-1] > 0


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_int, _bin = pa.int32(), pa.binary()
_REPLY = pa.schema([("block", _int), ("kind", _int), ("bucket", _int), ("x", _bin), ("y", _bin)])
_ANCHORS = pa.schema([("bucket", _int), ("block", _int), ("hash", _bin), ("known", _bin)])
_ENTRIES = pa.schema([("bucket", _int), ("block", _int), ("hash", _bin), ("own", _bin), ("sides", _bin), ("rank", _bin), ("ids", _bin)])
_OPENED = pa.schema([("bucket", _int), ("block", _int), *((c, _bin) for c in ("hash", "entry", "owner", "size", "place", "bytes"))])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", _bin)])


def _ddl(schema: pa.Schema) -> str:
    kinds = {_int: "int", pa.int64(): "long", _bin: "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _send_anchors(length: int, buckets: int):  # noqa: ANN202
    def run(docs: pa.Table) -> pa.Table:
        number = docs["block"][0].as_py()
        return _table([(b, number, *x) for b, *x in Block(docs, None, length, buckets).anchors()], _ANCHORS)

    return run


def _weigh_anchors(hot: int):  # noqa: ANN202
    """Of each anchor: does it stand in two documents, and has it more than ``hot`` contexts?"""

    def run(rows: pa.Table) -> pa.Table:
        every, sizes = _sums(rows["hash"].to_pylist())
        known = np.frombuffer(b"".join(rows["known"].to_pylist()), np.uint8)
        order = np.argsort(every, kind="stable")
        heads = _heads(every[order])
        n, known = _runs(heads, len(order)), known[order]
        shared = (n > 1) | (np.maximum.reduceat(known, heads) > 127)
        much = np.add.reduceat((known & 127).astype(np.int64), heads) > hot
        out = np.zeros((2, len(order)), bool)
        out[0, order], out[1, order] = np.repeat(shared, n), np.repeat(shared & much, n)
        return _answers(rows, 1, sizes, out)

    return run


def _answers(rows: pa.Table, kind: int, sizes: np.ndarray, flags: np.ndarray) -> pa.Table:
    n, (x, y) = len(sizes), (pa.array(_packed(f, sizes), _bin) for f in flags)
    return pa.table([rows["block"].combine_chunks(), pa.array([kind] * n, _int), rows["bucket"].combine_chunks(), x, y], schema=_REPLY)


def _send_entries(length: int, buckets: int):  # noqa: ANN202
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        block, number = Block(docs, replies, length, buckets), docs["block"][0].as_py()
        block.settle()
        return _table([(b, number, *x) for b, *x in block.entries()], _ENTRIES)

    return run


def _weigh_entries(rows: pa.Table) -> pa.Table:
    """Of each context: has a smaller document a copy, and may another one of its anchor elsewhere
    share a string with it? That one then has the same bytes on one side of the anchor."""
    key, sizes = _sums(rows["hash"].to_pylist())
    own, sides, rank = (_numbers(rows[c].to_pylist(), n)[0] for c, n in (("own", 6), ("sides", 2), ("rank", 4)))
    ids, each = _sums(rows["ids"].to_pylist())
    owner = ids.view(np.int64)[rank.astype(np.int64) + np.repeat(np.cumsum(each) - each, sizes)]
    order = np.lexsort((owner, own, key))
    key, own, owner = key[order], own[order], owner[order]
    copies = _heads(key, own)
    least, n = owner[copies], _runs(copies, len(order))
    may, each, sides = np.zeros(len(copies), bool), key[copies], sides[order][copies]
    for side in (sides & U64(0xFF), sides >> U64(8)):
        by = np.flatnonzero(side)
        by = by[np.lexsort((side[by], each[by]))]
        if len(by):
            heads = _heads(each[by], side[by])
            mixed = np.minimum.reduceat(least[by], heads) < np.maximum.reduceat(least[by], heads)
            may[by] |= np.repeat(mixed, _runs(heads, len(by)))
    out = np.zeros((2, len(order)), bool)
    out[0, order], out[1, order] = owner > np.repeat(least, n), np.repeat(may, n)
    return _answers(rows, 2, sizes, out)


def _send_open(length: int, buckets: int):  # noqa: ANN202
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        block, number = Block(docs, replies, length, buckets), docs["block"][0].as_py()
        block.settle()
        block.answer()
        return _table([(b, number, *x) for b, *x in block.opened()], _OPENED)

    return run


def _remove(length: int, buckets: int):  # noqa: ANN202
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(docs, replies, length, buckets)
        block.settle()
        block.answer()
        gone, at = block.gone(), block.offsets
        total = np.searchsorted(np.flatnonzero(gone), at)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        # a document's run does not go on from the one before
        begins[at[:-1][at[:-1] < len(gone)]] |= gone[at[:-1][at[:-1] < len(gone)]]
        spans = np.searchsorted(np.flatnonzero(begins), at)
        kept, left = block.data[~gone].tobytes(), at - total
        rows = []
        for i, (a, b) in enumerate(zip(left, left[1:], strict=False)):
            x, y = at[i], at[i + 1]
            part = kept[a:b]
            rows.append((int(block.ids[i]), int(y - x), int(total[i + 1] - total[i]), int(spans[i + 1] - spans[i]), hashlib.sha256(part).hexdigest(), part))
        return _table(rows, _RESULT)

    return run


# ---- transforms ---------------------------------------------------------------------------


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Multi-string Burrows-Wheeler transform of one shard: of each entry the two symbols before its
    suffix as one number and the suffix's first symbols as another (0 ends a string, byte + 1
    otherwise), and the string and place in it. Ends order by string."""
    sizes = np.array([len(s) for s in strings])
    raw = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    raw[ends] = 0
    n = len(raw)
    which = np.repeat(np.arange(len(strings)), sizes + 1)
    place = np.arange(n) - np.repeat(ends - sizes, sizes + 1)
    head = np.zeros(n, np.int64)
    live = np.ones(n, bool)
    for k in range(SEED):  # nine bits a symbol; nothing beyond an end counts
        at = np.minimum(np.arange(n) + k, ends[which])
        head = head << 9 | np.where(live, raw[at], 0)
        live &= raw[at] > 0
    # ends are told apart by string, everything else by its symbols
    key, step = head * 1, SEED
    key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    tail = np.where(ends[which] - np.arange(n) < SEED, which + 1, 0)
    key = key * (len(strings) + 1) + tail
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if rank.max() == n - 1 or step > sizes.max() + 1:
            break
        key = rank * (n + 1) + rank[np.minimum(np.arange(n) + step, ends[which])]
        step *= 2
    round_ = (sizes + 1)[which]  # strings are read in circles, end symbol and all
    back = lambda k: raw[np.arange(n) - place + (place - k) % round_]
    before, two = back(1), back(2)
    return (two[order] * 257 + before[order]).astype(np.uint32), head[order], which[order], place[order]


def merge(shards: list[tuple[np.ndarray, ...]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave the shards' transforms, right for prefixes of ``depth`` symbols.

    Returns, in merged order, the shard of each entry, its place in that shard's transform, and the
    number of its interval of equal ``depth``-prefixes. The first interleave merges the shards'
    sorted lists on their first SEED symbols; each round then adds the two symbols before a suffix.
    Prefixes that reach a string's end are compared through the end symbol into what its order
    says, so callers leave such entries out.
    """
    size = np.array([len(s[0]) for s in shards])
    begin = np.cumsum(size) - size
    pairs = np.unique(np.concatenate([s[0] for s in shards]), return_inverse=True)[1]
    symbols = pairs.astype(np.uint16) if pairs.max() < 65536 else pairs.astype(np.uint32)
    head = np.concatenate([s[1] for s in shards])
    shard = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), size)
    rounds = max(0, -(-(depth - SEED) // 2))
    shift = 9 * max(0, SEED - (depth - 2 * rounds))
    order = np.argsort(head >> shift, kind="stable")
    shard, head = shard[order], head[order] >> shift
    block = np.zeros(len(head), np.int32)
    np.cumsum(head[1:] != head[:-1], out=block[1:])
    entry = np.empty(len(order), np.int64)
    entry[np.argsort(shard, kind="stable")] = np.arange(len(order))
    for _ in range(rounds):
        symbol = symbols[entry]
        order = np.argsort(symbol, kind="stable")
        shard, block, symbol = shard[order], block[order], symbol[order]
        fresh = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.zeros(len(block), np.int32)
        np.cumsum(fresh, out=block[1:])
        # the k-th entry of a shard is its k-th suffix: transforms keep their own order
        entry[np.argsort(shard, kind="stable")] = np.arange(len(shard))
    return shard, entry - begin[shard], block


def repeated(strings: list[bytes], owners: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(string, start) of every ``length``-byte substring that a string of smaller owner also has."""
    shards, of, held, size = [], [], [], 0
    limit = max(SHARD, sum(map(len, strings)) // 200)
    for i, s in enumerate(strings):
        held.append(i)
        size += len(s) + 1
        if size >= limit or i == len(strings) - 1:
            shards.append(transform([strings[k] for k in held]))
            of.append(np.array(held))
            held, size = [], 0
    if not shards:
        return []
    shard, entry, block = merge(shards, length)
    begin = np.cumsum([0, *(len(s[0]) for s in shards)])
    at = begin[shard] + entry
    which = np.concatenate([o[s[2]] for o, s in zip(of, shards, strict=True)])[at]
    place = np.concatenate([s[3] for s in shards])[at]
    sizes = np.array([len(s) for s in strings])
    whole = place + length <= sizes[which]
    which, place, block = which[whole], place[whole], block[whole]
    if not len(block):
        return []
    heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    owner = owners[which]
    least = np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.append(heads, len(block))))
    hit = owner > least
    return list(zip(which[hit].tolist(), place[hit].tolist(), strict=True))


def trim(anchor: np.ndarray, text: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): how many bytes each context has in common, on either side of its anchor, with
    another of the anchor. Where these are fewer than ``length`` - ANCHOR, it shares no string."""
    prefix, at = prefix_hash(text), begin + place
    out = []
    for side, room in ((-1, place), (1, size - place - ANCHOR)):
        best = np.zeros(len(at), np.int64)
        live = np.flatnonzero(room > 0)
        for k in range(1, length - ANCHOR + 1):
            live = live[room[live] >= k]
            first = at[live] - k if side < 0 else at[live] + ANCHOR
            key = mix(span_hash(prefix, first, first + k) ^ (anchor[live] * U64(0x9E3779B97F4A7C15)))
            order = np.argsort(key, kind="stable")
            n = _runs(heads := _heads(key[order]), len(order))
            live = np.sort(live[order[np.repeat(n > 1, n)]])
            if not len(live):
                break
            best[live] = k
        out.append(best)
    return out[0], out[1]


def _merged(anchor: np.ndarray, text: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, owner: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """(row, place in it) of the strings that a row of smaller owner also has; rows by anchor."""
    left, right = trim(anchor, text, begin, size, place, length)
    rows = np.flatnonzero(left + right >= length - ANCHOR)
    raw, per = text.tobytes(), {}
    for i, a, b in zip(rows.tolist(), (begin + place - left)[rows].tolist(), (begin + place + ANCHOR + right)[rows].tolist(), strict=True):
        per.setdefault(raw[a:b], []).append(i)
    strings = sorted(per)
    first = (place - left).tolist()
    least = np.array([min(owner[per[s]]) for s in strings], np.int64)
    hits: dict[int, list[int]] = {}
    for k, p in repeated(strings, least, length):
        hits.setdefault(k, []).append(p)
    out: tuple[list[int], list[int]] = [], []
    for k, s in enumerate(strings):
        for i in per[s]:
            places = range(len(s) - length + 1) if owner[i] > least[k] else hits.get(k, ())
            out[0].extend([i] * len(places))
            out[1].extend(first[i] + p for p in places)
    return out


def _merge_bucket(length: int):  # noqa: ANN202
    def run(rows: pa.Table) -> pa.Table:
        cols = {c: rows[c].to_pylist() for c in rows.column_names}
        anchor, sizes = _sums(cols["hash"])
        block = np.repeat(cols["block"], sizes)
        entry, size, place = (_numbers(cols[c], 4)[0].astype(np.int64) for c in ("entry", "size", "place"))
        owner = _numbers(cols["owner"], 8)[0].view(np.int64)
        raw = np.frombuffer(b"".join(cols["bytes"]), np.uint8)
        begin = np.cumsum(size) - size
        order = np.argsort(anchor, kind="stable")
        heads = _heads(anchor[order])
        # whole anchors, some bytes at a time
        much = np.cumsum(np.add.reduceat(size[order], heads)) // MERGE
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in _bounds(heads[_heads(much)], len(order)):
            at = order[a:b]
            n = size[at]
            text = raw[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            row, p = _merged(anchor[at], text, np.cumsum(n) - n, n, place[at], owner[at], length)
            row = at[np.array(row, np.int64)]
            found.append((block[row], entry[row], np.array(p, np.int64)))
        blocks, entries, places = map(np.concatenate, zip(*found, strict=True))
        by = np.argsort(blocks, kind="stable")
        blocks, entries, places = blocks[by], _rows(entries[by]), _rows(places[by])
        bucket = cols["bucket"][0]
        return _table([(int(blocks[a]), 3, bucket, _planes(entries[a:b], 4), _planes(places[a:b], 4)) for a, b in _bounds(_heads(blocks), len(blocks))], _REPLY)

    return run


def deduplicate(documents: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) per row."""
    if length < ANCHOR:
        raise ValueError(f"length must be {ANCHOR} at least")
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(TOP)).alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    parts = docs.rdd.getNumPartitions()
    buckets = min(BUCKETS * max(parts, 8), 1 << 15)
    # equal rows of different partitions of the input may go to different blocks
    number = F.pmod(F.xxhash64("doc_id", "row_key", F.spark_partition_id()), F.lit(BLOCKS * max(parts, 8))).cast("int")
    # one shuffle of the texts serves all rounds
    docs = docs.withColumn("block", number).repartition("block")

    def ask(run, kinds: pa.Schema, replies: DataFrame) -> DataFrame:  # noqa: ANN001
        return docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run(length, buckets), _ddl(kinds))

    def told(sent: DataFrame, run) -> DataFrame:  # noqa: ANN001
        return sent.groupBy("bucket").applyInArrow(run, _ddl(_REPLY)).repartition("block")

    first = told(docs.groupBy("block").applyInArrow(_send_anchors(length, buckets), _ddl(_ANCHORS)), _weigh_anchors(hot))
    second = first.union(told(ask(_send_entries, _ENTRIES, first), _weigh_entries))
    third = second.union(told(ask(_send_open, _OPENED, second), _merge_bucket(length)))
    out = ask(_remove, _RESULT, third)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != TOP, F.col("doc_id")))
