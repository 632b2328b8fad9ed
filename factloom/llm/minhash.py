"""Near duplicates by BagMinHash: weighted-Jaccard signatures, bands, verified multiset overlap.

A document is the multiset of its five-word shingles. Signatures follow Ertl (2018): each shingle
owns Poisson processes over its discretised weight levels, arranged dyadically (levels 0-1, 1-2,
2-4, 4-8, ...), so a weight w takes the processes below it and, of the one it falls in, the points
whose level is below w; heavier copies of a shingle see a superset of the points of lighter ones.
A point lies at a time and in one of the signature's slots; each slot keeps its earliest point,
and two documents agree in a slot with probability equal to their weighted Jaccard similarity. A
process stops when it has passed the latest slot of its document, so cost hardly exceeds one
point per shingle.

Signatures are cut into bands. In each band bucket, documents are first paired with a few hubs,
which joins most of a large group at a few candidates a member. Candidates whose signatures agree in
too few slots for the threshold are dropped, the others are verified on the exact multisets, and
components of the verified links are found. In buckets that still hold several components, every
two members of different ones are then compared: in blocks, by their slots, and where enough agree
by the shared elements of all exact multisets of the block at once. Large buckets of the same
components, as a large family has in most bands, are made one first, so that its pairs are compared
once. In a bucket with very many
members outside its largest component, such as texts on one form, only those are compared that
share one of their rarest elements, which every two of the threshold do, so the cost does not grow
with the bucket's square. No pair of a bucket that could reach the threshold is left out.
Equal texts are collapsed before all this and take their class from the one that stands for them.

Defined cases: null text counts as empty; texts without words form a class only with equal texts;
a text of fewer than five words has one shingle, all its words; null ids order after all others;
repeated rows each get a row; extra columns are ignored by ``classes`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components, discard, in_batches, settle
from .textops import U64, chunks, flat, mix, prefix_hash, span_hash, word_spans

#: Slots of a signature, in bands of ROWS. A pair of similarity 0.8 shares no band with
#: probability (1 - 0.8^4)^20 < 3e-5.
SLOTS, ROWS = 80, 4
BANDS = SLOTS // ROWS
#: A pair must agree in this share of slots to be verified; one of similarity 0.8 agrees in fewer
#: with probability below 1e-5.
PRESUMED = 0.6
#: Hubs of a bucket in the first round, the least id and other members, and hubs that a member meets.
HUBS = 4
#: Members, and elements of their multisets, in a block of a bucket, about.
BLOCK, BLOCK_ITEMS = 256, 2_000_000
#: Blocks of members outside a bucket's largest component beyond which it is dealt by rare elements.
FAR = 4
#: Rows in a batch while multisets travel.
PAIRS = 400
#: So many ids at most are broadcast.
FEW_IDS = 50_000
GOLDEN = U64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and multiplicity of every distinct shingle, ordered by document and hash."""
    start, end, doc = word_spans(data, offsets)
    n = len(offsets) - 1
    word = span_hash(prefix_hash(data), start, end)
    weights = [mix(np.array([k + 1], U64) * GOLDEN)[0] | U64(1) for k in range(size)]
    count = np.bincount(doc, minlength=n)
    if len(word) >= size:
        joint = np.zeros(len(word) - size + 1, U64)
        for k in range(size):
            joint += word[k : len(word) - size + 1 + k] * weights[k]
        whole = doc[: len(joint)] == doc[size - 1 :]
        docs, keys = doc[: len(joint)][whole], joint[whole]
    else:
        docs, keys = np.zeros(0, np.int64), np.zeros(0, U64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = [int(sum(int(word[f + k]) * int(weights[k]) for k in range(count[d])) & (1 << 64) - 1) for d, f in zip(short, first, strict=True)]
        docs, keys = np.concatenate([docs, short]), np.concatenate([keys, np.array(extra, U64)])
    bits = U64(max(1, int(n).bit_length()))
    packed = np.sort((docs.astype(U64) << (U64(64) - bits)) | (mix(keys) >> bits))
    new = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(packed)))
    kept = packed[new]
    # hashes of different chunks must agree, so bits above 48 are dropped everywhere
    mask = U64((1 << 48) - 1)
    return (kept >> (U64(64) - bits)).astype(np.int64), ((kept & ((U64(1) << (U64(64) - bits)) - U64(1))) >> (U64(64) - bits - U64(48))) & mask, times


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """n x slots earliest times; infinite where a document has no shingle."""
    first = np.full(n * slots, np.inf)
    if not len(doc):
        return first.reshape(n, slots)
    # one process a shingle for level 0, and one more for each doubling of its weight
    ds, ks, ws, low = [doc], [mix(key + GOLDEN)], [weight], [np.zeros(len(doc), np.int64)]
    level = 1
    while (more := weight > level).any():
        ds.append(doc[more])
        ks.append(mix(key[more] + np.array([level + 1], U64) * GOLDEN))
        ws.append(weight[more])
        low.append(np.full(int(more.sum()), level))
        level *= 2
    d, k, w, base = map(np.concatenate, (ds, ks, ws, low))
    rate = np.maximum(base, 1).astype(np.float64)
    time, step = np.zeros(len(d)), np.zeros(1, U64)
    latest = np.full(n, np.inf)
    while len(d):
        step = step + U64(1)
        x = mix(k + step * GOLDEN)
        y = mix(x ^ GOLDEN)
        time = time - np.log(_uniform(x)) / rate
        alive = time < latest[d]
        if not alive.all():
            d, k, w, base, rate, time, y = (v[alive] for v in (d, k, w, base, rate, time, y))
        slot = ((y >> U64(32)) * U64(slots) >> U64(32)).astype(np.int64)
        below = base + (((y & U64(0xFFFFFFFF)).astype(np.float64) / 2**32) * np.maximum(base, 1)).astype(np.int64) < w
        below |= base == 0
        np.minimum.at(first, d[below] * slots + slot[below], time[below])
        latest = first.reshape(n, slots).max(1)
    return first.reshape(n, slots)


def bands(signature: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(U64).reshape(len(signature), -1, ROWS)
    out = np.zeros(bits.shape[:2], U64)
    for r in range(ROWS):
        out = mix(out ^ (bits[:, :, r] + np.array([r + 1], U64) * GOLDEN))
    return mix(out + np.arange(out.shape[1], dtype=U64)[None, :] * GOLDEN).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch["text"])
        keys, short, sizes = [], [], []
        for a, b in chunks(offsets):
            doc, key, weight = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            s = signatures(doc, key, weight, b - a)
            keys.append(bands(s))
            short += [r.tobytes() for r in (mix(np.ascontiguousarray(s).view(U64)) >> U64(48)).astype(np.uint16)]
            sizes.append(np.bincount(doc, weight, b - a).astype(np.int64))
        k = np.concatenate(keys) if keys else np.zeros((0, BANDS), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1) * BANDS, pa.int32()), pa.array(k.ravel()))
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        yield pa.record_batch([batch["doc_id"], batch["same"], lists, pa.array(short, pa.binary()), pa.array(size > 0), pa.array(size)], ["doc_id", "same", "bands", "signature", "has_words", "size"])


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted elements of each document: a shingle that stands k times is k elements."""
    for batch in batches:
        data, offsets = flat(batch["text"])
        rows = []
        for a, b in chunks(offsets):
            doc, key, weight = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at = np.repeat(np.arange(len(key)), weight)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
            item = mix(key[at] * GOLDEN + nth.astype(U64))
            order = np.lexsort((item, doc[at]))
            item, of = item[order], doc[at][order]
            bound = np.searchsorted(of, np.arange(b - a + 1))
            rows += [item[x:y].tobytes() for x, y in zip(bound, bound[1:], strict=False)]
        yield pa.record_batch([batch["id"], pa.array(rows, pa.binary())], ["id", "items"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
        ok = (x == y).mean(1) >= PRESUMED if batch.num_rows else np.zeros(0, bool)
        kept = batch.filter(pa.array(ok, pa.bool_()))
        yield pa.record_batch([kept["a"], kept["b"]], ["a", "b"])


def _verified(threshold: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["ia"], batch["ib"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                small, large = min(len(p), len(q)), max(len(p), len(q))
                if small < threshold * large:
                    ok.append(False)
                    continue
                both = np.sort(np.concatenate([p, q]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(shared >= threshold * (len(p) + len(q) - shared))
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.record_batch([kept["a"], kept["b"]], ["a", "b"])

    return run


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id (null: after all others), text (null: empty), and ``same``, equal for equal texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    top = F.lit((1 << 63) - 1)
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), top).alias("doc_id"), text.alias("text"), F.xxhash64(text, F.lit(1)).alias("x1"), F.xxhash64(F.lit(2), text).alias("x2")).withColumn("same", F.struct("x1", "x2")).drop("x1", "x2")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal ``at``, which follow one another."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        at = table["at"].to_numpy()
        cut = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist()]
        for x, y in pairwise(cut):
            yield table.slice(x, y - x)
        rest = table.slice(cut[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _unsettled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (at, id) of each group that may have a link there: they agree in enough slots with
    one of another component, and this is the first bucket that the two share."""
    least = int(np.ceil(PRESUMED * SLOTS - 1e-9))
    for group in _groups(batches):
        band, label, ids, anywhere = (group[c].to_numpy() for c in ("band", "label", "id", "any"))
        slots = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint16).reshape(len(ids), -1)
        agree = np.zeros((len(ids), len(ids)), np.uint8)
        for column in slots.T:
            agree += column[:, None] == column
        x, y = np.nonzero(np.triu((agree >= least) & (label[:, None] != label) & (band[:, None] == band), 1))
        if not len(x):
            continue
        every = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        here = (every[x, (every[x] == every[y]).argmax(1)] == band[x]) | anywhere[x]
        kept = np.unique(np.concatenate([x[here], y[here]]))
        yield pa.record_batch([pa.array(group["at"].to_numpy()[kept]), pa.array(ids[kept])], ["at", "id"])


def _shared(items: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many elements each two multisets share."""
    n = len(items)
    out = np.zeros((n, n))
    every, of = np.concatenate(items), np.repeat(np.arange(n), [len(i) for i in items])
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])[: len(every)]
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1
    of, column = of[common], (np.cumsum(new & common) - 1)[common]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        has = np.zeros((n, min(width, int(column[-1]) + 1 - low)), np.float32)
        has[of[a:b], column[a:b] - low] = 1
        out += has @ has.T
    return out


def _linked(threshold: float):  # noqa: ANN202
    """Links (a, b) that join all of a group that verified pairs of it join, as few as do so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ids = group["id"].to_numpy()
            items = [np.frombuffer(i.as_buffer(), U64) for i in group["items"]]
            size, shared = np.array([len(i) for i in items]), _shared(items)
            near = shared >= threshold * (size[:, None] + size - shared)
            left, links = np.ones(len(ids), bool), []
            while left.any():
                todo = [int(left.argmax())]
                left[todo] = False
                while todo:
                    x = todo.pop()
                    more = np.flatnonzero(near[x] & left)
                    left[more] = False
                    links += [(x, y) for y in more.tolist()]
                    todo += more.tolist()
            if links:
                both = np.sort(ids[np.array(links)], 1)
                yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return run


def _parts(here: DataFrame) -> DataFrame:
    """Of each bucket (rows band, id, size, label) that holds several components: members, elements and
    labels, those of its largest component, the groups that its members, those of that component and
    the others are dealt to, and the rows that this takes."""
    count = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_ITEMS), F.lit(1)).cast("int")
    parts = here.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    parts = parts.groupBy("band").agg(F.max(F.struct("n", "size", "label")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("total"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    parts = parts.withColumns({"whole": count(F.col("n"), F.col("total")), "mains": count(F.col("top.n"), F.col("top.size")), "others": count(F.col("n") - F.col("top.n"), F.col("total") - F.col("top.size"))})
    dealt = F.col("top.n") * F.col("others") + (F.col("n") - F.col("top.n")) * (F.col("mains") + F.col("others"))
    return parts.withColumn("rows", F.when(F.col("whole") == 1, F.col("n")).otherwise(dealt))


def _merged(here: DataFrame, parts: DataFrame) -> DataFrame:
    """``here`` with ``any``: False, or True in buckets made of several that are too large for one
    group and hold the same components. The documents of a large family share most of its buckets;
    here they stand in one, so two of them are compared once and not in every band. Buckets stay as
    they are where that takes fewer rows."""
    large = settle(parts.where("whole > 1").select("band", "rows", F.col("top.label").alias("main")))
    own = here.withColumn("any", F.lit(False))
    if not large.limit(1).count():
        return own
    there = here.join(large, "band")
    family = components(settle(there.select(F.col("label").alias("a"), F.col("main").alias("b")).where("a <> b").distinct()))
    family = family.select(F.col("id").alias("label"), F.col("component").alias("family"))
    joint = settle(there.join(family, "label").select(F.xxhash64("family", F.lit(3)).alias("band"), "id", "size", "label").distinct())
    apart = large.join(family, F.col("main") == F.col("label")).groupBy(F.xxhash64("family", F.lit(3)).alias("joint")).agg(F.sum("rows").alias("apart"), F.collect_list("band").alias("bands"))
    better = settle(_parts(joint).join(apart, F.col("band") == F.col("joint")).where(F.col("rows") < F.col("apart")).select("joint", "bands"))
    own = own.join(better.select(F.explode("bands").alias("band")), "band", "left_anti")
    joint = joint.join(better.select(F.col("joint").alias("band")), "band", "left_semi")
    return own.unionByName(joint.withColumn("any", F.lit(True)))


def _blocks(here: DataFrame, parts: DataFrame) -> DataFrame:
    """(at, band, id, label, any) of the buckets ``parts``, dealt to groups of bounded size so that
    every two members of different components meet in one of them. The largest component of a bucket
    is not dealt against itself."""
    parts = parts.select(F.col("band").alias("_band"), F.col("top.label").alias("main"), "whole", "mains", "others")
    dealt = here.join(parts, F.col("band") == F.col("_band")).withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.when(F.col("label") == F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    group = lambda kind, x, y: F.xxhash64("band", F.lit(kind), x, y)
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    meets = F.when(F.col("whole") == 1, F.array(group(0, F.lit(0), F.lit(0))))
    meets = meets.when(F.col("label") == F.col("main"), upto("others", lambda j: group(1, F.col("own"), j)))
    meets = meets.otherwise(F.concat(upto("mains", lambda i: group(1, i, F.col("own"))), upto("others", lambda j: group(2, F.least("own", j), F.greatest("own", j)))))
    return dealt.select("band", "id", "label", "any", F.explode(meets).alias("at"))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ident, raw in zip(batch["id"], batch["items"], strict=True):
            item = np.frombuffer(raw.as_buffer(), np.int64)
            yield pa.record_batch([pa.array(np.full(len(item), ident.as_py())), pa.array(item)], ["id", "item"])


def _by_rare(members: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(band, id, size, label): members under each element of their prefixes, as ``band``.

    In one order of all elements, rare ones first, two multisets of n and m elements that reach the
    threshold share one of the first n - ceil(threshold n) + 1 of the one and of the first m -
    ceil(threshold m) + 1 of the other. An element that only one member has joins nothing."""
    each = items.mapInArrow(_elements, "id long, item long")
    common = each.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = each.join(common, "item").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("known"))
    both = members.join(known, "id")
    prefix = (F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("known"))).cast("int")
    return both.where(prefix > 0).select(F.explode(F.slice("known", F.lit(1), prefix)).alias("k"), "id", "size", "label").select(F.col("k.item").alias("band"), "id", "size", "label")


def _links(signed: DataFrame, texts: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame | None:
    """Components (id, component) of the verified links between texts that stand for themselves;
    ``texts`` gives (id, text) for a table of ids."""
    exploded = signed.where("has_words").select("id", "size", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    members = settle(exploded.join(shared, "band"))

    def multisets(rows: DataFrame) -> DataFrame:
        ids = settle(rows.distinct())
        # few ids (eight bytes each) go to the texts; many texts go to their ids
        wanted = texts(F.broadcast(ids) if ids.count() <= FEW_IDS else ids)
        items = settle(wanted.mapInArrow(_multisets, "id long, items binary"))
        discard(ids)
        return items

    first = signed.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    second = signed.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    seeds = [F.col("id"), *(F.xxhash64("id", F.lit(i)) for i in range(1, HUBS))]
    hubs = members.groupBy("band").agg(F.array_distinct(F.array(*(F.min_by("id", F.struct(s, "id")) for s in seeds))).alias("hubs"), F.count(F.lit(1)).alias("n"))
    pairs = members.join(hubs, "band").select("id", F.explode("hubs").alias("hub"), "n").where("id <> hub")
    # a member meets the hubs it shares most bands with; only in a bucket of two is nothing tried later
    pairs = pairs.groupBy("id", "hub").agg(F.count(F.lit(1)).alias("bands"), F.min("n").alias("n"))
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("bands"), F.xxhash64("hub"), "hub"))
    pairs = pairs.withColumn("turn", turn).where(F.col("turn").between(1, HUBS) | (F.col("n") == 2))
    pairs = pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    likely = settle(pairs.join(first, "a").join(second, "b").select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a long, b long"))
    items = multisets(likely.select(F.explode(F.array("a", "b")).alias("id")))
    ia = items.select(F.col("id").alias("a"), F.col("items").alias("ia"))
    ib = items.select(F.col("id").alias("b"), F.col("items").alias("ib"))
    found = settle(likely.join(ia, "a").join(ib, "b").select("a", "b", "ia", "ib").mapInArrow(_verified(threshold), "a long, b long"))
    discard(items)
    discard(likely)
    labels = components(found) if found.limit(1).count() else None

    # what the hubs did not join: all other pairs of different components
    here = members.withColumn("label", F.col("id")) if labels is None else members.join(labels, "id", "left").select("band", "id", "size", F.coalesce("component", "id").alias("label"))
    # the first round has tried the pair of a bucket of two
    here = settle(_merged(here, settle(_parts(here).where("n > 2"))))
    parts = settle(_parts(here).where("n > 2").withColumn("far", F.col("n") - F.col("top.n") > FAR * BLOCK))
    dealt = _blocks(here, parts.where("not far"))
    if parts.where("far").limit(1).count():
        among = settle(here.join(parts.where("far").select("band"), "band").select("id", "size", "label").distinct())
        items = multisets(among.select("id"))
        rare = settle(_by_rare(among, items, threshold))
        rare = settle(_merged(rare, settle(_parts(rare))).withColumn("any", F.lit(True)))
        dealt = dealt.unionByName(_blocks(rare, _parts(rare)))
    dealt = settle(dealt)
    discard(members)
    signs = signed.select("id", "signature", "bands")
    wide = dealt.join(signs, "id").select("at", "band", "id", "label", "any", "signature", "bands").repartition("at").sortWithinPartitions("at")
    rest = settle(wide.mapInArrow(_unsettled, "at long, id long"))
    discard(dealt)
    items = multisets(rest.select("id"))
    more = settle(rest.join(items, "id").select("at", "id", "items").repartition("at").sortWithinPartitions("at").mapInArrow(_linked(threshold), "a long, b long"))
    discard(items)
    discard(rest)
    if not more.limit(1).count():
        return labels
    return components(found.union(more))


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """While the rounds run: small batches, as a row of a pair holds two multisets, which may be
    those of very long texts; and little about each of many plans kept in the driver."""
    given = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(PAIRS), "spark.sql.constraintPropagation.enabled": "false", "spark.sql.maxPlanStringLength": "2000"}
    before = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def classes(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id) per row: class_id is the least doc_id of the class."""
    keyed = _keyed(in_batches(documents))
    rows = keyed.select("doc_id", "same", "text").mapInArrow(_sign, "doc_id long, same struct<x1:long,x2:long>, bands array<long>, signature binary, has_words boolean, size long")
    alone = settle(
        rows.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.first("has_words").alias("has_words"), F.first("size").alias("size"))
    )
    # ids may repeat under different texts; a text's own number then stands for it
    alone = alone.withColumn("doc", F.col("id")).withColumn("id", F.col("same.x1"))
    owners = alone.select("id", F.col("doc").alias("doc_id"))

    def texts(ids: DataFrame) -> DataFrame:
        every = keyed.select(F.col("same.x1").alias("id"), "text", "doc_id").join(ids, "id", "left_semi")
        return every.join(owners, ["id", "doc_id"], "left_semi").dropDuplicates(["id"]).select("id", "text")

    with _settings(documents.sparkSession):
        labels = _links(alone.select("id", "bands", "signature", "has_words", "size"), texts, threshold)
    stands = alone.select("same", "doc", "id")
    if labels is None:
        named = stands.select("same", F.col("doc").alias("class_id"))
    else:
        with_label = stands.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        least = with_label.groupBy("component").agg(F.min("doc").alias("class_id"))
        named = with_label.join(least, "component").select("same", "class_id")
    named = named.withColumnRenamed("same", "_same")
    out = keyed.select("doc_id", "same").join(named, F.col("same") == F.col("_same"))
    return out.select(_back("doc_id").alias("doc_id"), _back("class_id").alias("class_id"))


def _back(name: str) -> Column:
    return F.when(F.col(name) != (1 << 63) - 1, F.col(name))


def deduplicate(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``documents`` that stand for their class: of each class the least doc_id, one row."""
    found = classes(documents, threshold).where("doc_id <=> class_id").select("doc_id").distinct()
    kept = documents.join(found, documents["doc_id"].eqNullSafe(found["doc_id"]), "left_semi")
    # rows that share this id: equal ones count once, and of different texts each stood for itself
    return kept.dropDuplicates(["doc_id", "text"])
