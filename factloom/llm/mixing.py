"""Temperature mixing of sources, with DataFrame operations only.

Source token shares are raised to an exponent and normalised to weights. The exponent is found by
bisection: the smallest in [0, 1] under which no source is repeated more than ``max_repetition``
times, or, with ``target_entropy``, the largest whose weights keep that entropy (in nats), raised
where the repetition limit asks for it. Weights become token quotas of a budget; by default the
smallest budget that passes over every document at least once, so nothing is lost. A quota is
realised in passes (epochs): each pass is a permutation of the source's blocks, and of the
documents in each block; the last one is cut where the quota is spent.

Rows of a source in the order epoch, block_order, block, row_order, doc_id are the realised sequence.
Where the last pass ends is found by narrowing: block sizes are summed over ranges of block_order,
then block by block in the range that holds the end, then row by row in the block that does. Every
row can then tell by itself how often it comes, so texts are not shuffled and a source of any size
is never gathered in one task. What must fit into a row is one entry for each source.

Defined cases: null source is a source of its own (""), null text has no tokens; a source without
tokens has no weight and keeps its documents once; repeated rows are documents of their own, but
those equal in id and size are all passed over or all not where the last pass is cut; an empty
table gives an empty result; extra columns are carried by ``realise`` unless they have the names
it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import discard, settle

WORD = r"[^\x20\x09-\x0D]+"
#: Halvings of the exponent's interval; beyond these a double does not change.
HALVINGS = 60
ADDED = ("n_tokens", "epoch", "block", "block_order", "row_order")
#: Ranges of block_order, a 32-bit number, in which block sizes are first summed.
RANGES = 4096


def _number(*parts: Column) -> Column:
    """A 32-bit number from the md5 of the parts, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def weights(documents: DataFrame, max_repetition: float = 2.0, target_entropy: float | None = None, budget: int | None = None, block_rows: int = 4096) -> DataFrame:
    """One row per source: tokens, documents, weight, quota, full passes, rest, blocks, exponent."""
    per = documents.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    # all sources side by side in one row, and apart again at the end
    row = per.agg(F.sort_array(F.collect_list(F.struct("source", "tokens", "n_docs"))).alias("all"))
    row = row.withColumn("t", F.transform(F.filter("all", lambda s: s["tokens"] > 0), lambda s: s["tokens"].cast("double")))
    row = row.withColumn("top", F.array_max("t"))
    # relative to the largest source, so powers stay in range
    row = row.withColumn("t", F.array_sort(F.transform("t", lambda v: v / F.col("top"))))

    def total(x: Column, f) -> Column:  # noqa: ANN001
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v))

    t, top = F.col("t"), F.col("top")

    def entropy(a: Column) -> Column:
        z = total(t, lambda v: F.pow(v, a))
        return F.log(z) - total(t, lambda v: F.pow(v, a) * a * F.log(v)) / z

    def repetition(a: Column) -> Column:
        if budget is None:  # the largest source is passed over once
            return F.pow(F.array_min(t), a - 1)
        return F.lit(float(budget)) / top * F.pow(F.array_min(t), a - 1) / total(t, lambda v: F.pow(v, a))

    def bisect(holds) -> Column:  # noqa: ANN001
        """(low, high) around the point of [0, 1] from which ``holds`` is true."""
        begin = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def halve(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            return F.struct(F.when(holds(mid), s["lo"]).otherwise(mid).alias("lo"), F.when(holds(mid), mid).otherwise(s["hi"]).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), begin, halve)

    least = F.when(repetition(F.lit(0.0)) <= max_repetition, F.lit(0.0)).otherwise(bisect(lambda a: repetition(a) <= max_repetition)["hi"])
    if target_entropy is not None:
        flat = F.when(entropy(F.lit(1.0)) >= target_entropy, F.lit(1.0)).otherwise(bisect(lambda a: entropy(a) < target_entropy)["lo"])
        least = F.greatest(least, flat)
    # without any tokens there is no exponent to look for
    row = row.withColumn("exponent", F.when(F.size("t") > 0, least).otherwise(F.lit(0.0)))
    row = row.withColumn("z", total(t, lambda v: F.pow(v, F.col("exponent"))))
    out = row.select("exponent", "top", "z", F.explode("all").alias("s")).select("exponent", "top", "z", "s.*")
    power = F.pow(F.col("tokens") / F.col("top"), F.col("exponent"))
    # with z the sum of powers, the weight is power / z and the default budget top * z
    spend = F.col("top") * power if budget is None else F.lit(float(budget)) * power / F.col("z")
    out = out.withColumn("weight", F.when(F.col("tokens") > 0, power / F.col("z")).otherwise(F.lit(0.0)))
    out = out.withColumn("quota", F.when(F.col("tokens") > 0, F.round(spend).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.select(
        "source", "tokens", "n_docs", "exponent", "weight", "quota",
        F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest(F.col("tokens"), F.lit(1)))).otherwise(F.lit(1)).cast("long").alias("passes"),
        F.when(F.col("tokens") > 0, F.col("quota") % F.greatest(F.col("tokens"), F.lit(1))).otherwise(F.lit(0)).cast("long").alias("rest"),
        F.ceil(F.col("n_docs") / block_rows).cast("long").alias("n_blocks"),
    )


def _orders(seed: int) -> tuple[Column, Column, Column]:
    """block, and block_order and row_order in ``epoch``, of rows with _key, _ident and n_blocks."""
    key, ident, epoch = F.col("_key"), F.col("_ident"), F.col("epoch").cast("string")
    block = _number(F.lit(f"block{seed}"), ident) % F.col("n_blocks")
    return block, _number(F.lit(f"order{seed}"), key, epoch, F.col("block").cast("string")), _number(F.lit(f"row{seed}"), epoch, ident)


def _ends(counted: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``plan`` with the place where each source's last pass ends: _until (block_order, block), whether
    that block is _cut, and _last (row_order, ident, tokens) of the rows that still come in it."""
    block, block_order, row_order = _orders(seed)
    last = plan.withColumn("epoch", F.col("passes") + 1)
    rows = counted.join(last, "_key").withColumn("block", block)
    blocks = rows.groupBy("_key", "block", "epoch", "rest").agg(F.sum("n_tokens").alias("size"))
    blocks = settle(blocks.withColumn("order", block_order).withColumn("range", F.floor(F.col("order") / ((1 << 32) // RANGES))).drop("epoch"))
    before = lambda by, *order: F.coalesce(F.sum("size").over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = blocks.groupBy("_key", "rest", "range").agg(F.sum("size").alias("size"))
    ranges = ranges.withColumn("before", before(Window.partitionBy("_key"), "range")).where("before < rest")
    ranges = ranges.groupBy("_key").agg(F.max(F.struct("range", "before")).alias("r")).select("_key", "r.range", F.col("r.before").alias("base"))
    near = blocks.join(ranges, ["_key", "range"])
    near = near.withColumn("before", F.col("base") + before(Window.partitionBy("_key"), "order", "block")).where("before < rest")
    end = near.groupBy("_key").agg(F.max(F.struct("order", "block", "before", "size", "rest")).alias("e"))
    end = settle(end.select("_key", F.struct("e.order", "e.block").alias("_until"), (F.col("e.before") + F.col("e.size") > F.col("e.rest")).alias("_cut"), (F.col("e.rest") - F.col("e.before")).alias("left")))
    inside = rows.join(end.where("_cut"), "_key").where("block = _until.block").select("_key", "left", row_order.alias("turn"), F.col("_ident").alias("ident"), "n_tokens")
    upto = F.sum("n_tokens").over(Window.partitionBy("_key").orderBy("turn", "ident", "n_tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    final = inside.withColumn("upto", upto).where("upto <= left").groupBy("_key").agg(F.max(F.struct("turn", "ident", "n_tokens")).alias("_last"))
    out = settle(last.join(end.drop("left"), "_key", "left").join(final, "_key", "left"))
    discard(blocks)
    discard(end)
    return out


def realise(documents: DataFrame, seed: int = 0, **limits: float | int | None) -> DataFrame:
    """All columns of ``documents`` with n_tokens, epoch (from 1), block, block_order and row_order: a
    row for each time a document is passed over. ``limits`` are those of ``weights``."""
    carried = [c for c in documents.columns if c not in ADDED]
    own = documents.select(*carried).withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    own = own.withColumn("_key", F.coalesce(F.col("source"), F.lit(""))).withColumn("_ident", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    # tokens are counted once for all that is decided, in a table without texts
    counted = settle(own.select("_key", "_ident", "n_tokens"))
    plan = weights(counted.select(F.col("_key").alias("source"), "n_tokens"), **limits).select(F.col("source").alias("_key"), "passes", "rest", "n_blocks")
    ends = _ends(counted, settle(plan), seed)
    discard(counted)
    block, block_order, row_order = _orders(seed)
    rows = own.join(ends, "_key").withColumn("block", block)
    here, until = F.struct(block_order.alias("order"), F.col("block").alias("block")), F.col("_until")
    row = F.struct(row_order.alias("turn"), F.col("_ident").alias("ident"), F.col("n_tokens").alias("n_tokens"))
    inside = F.when(~F.col("_cut"), F.lit(True)).otherwise(F.coalesce(row <= F.col("_last"), F.lit(False)))
    extra = F.when(until.isNull(), F.lit(False)).when(here < until, F.lit(True)).when(here == until, inside).otherwise(F.lit(False))
    rows = rows.withColumn("_copies", F.col("passes").cast("int") + extra.cast("int")).where("_copies > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.withColumn("block_order", block_order).withColumn("row_order", row_order).select(*carried, *ADDED)


def repeat(documents: DataFrame, seed: int = 0, **limits: float | int | None) -> DataFrame:
    """The rows of ``documents`` as often as they come, with its own columns, whatever their names."""
    own = {c: f"_own{i}" for i, c in enumerate(documents.columns) if c in ADDED}
    mixed = realise(documents.withColumnsRenamed(own), seed, **limits)
    return mixed.drop(*ADDED).withColumnsRenamed({v: k for k, v in own.items()}).select(*documents.columns)


#: The default settings in SQL; the exponent has a closed form there, which bisection meets.
ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS ident, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents
), per AS (
  SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n_docs FROM d GROUP BY 1
), a AS (
  SELECT max(tokens)::DOUBLE AS top, min(tokens) FILTER (tokens > 0) / max(tokens)::DOUBLE AS low FROM per
), e AS (
  SELECT top, CASE WHEN low IS NULL OR 1 / low <= 2.0 THEN 0.0 ELSE 1 + ln(2.0) / ln(low) END AS exponent FROM a
), q AS (
  SELECT source, tokens, ceil(n_docs / 4096.0)::BIGINT AS n_blocks,
    CASE WHEN tokens > 0 THEN round(top * pow(tokens / top, exponent))::BIGINT ELSE 0 END AS quota
  FROM per, e
), p AS (
  SELECT source, n_blocks, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest FROM q
), r AS (
  SELECT d.*, passes, rest, ('0x' || substr(md5('block0:' || ident), 1, 8))::BIGINT % n_blocks AS block FROM d JOIN p USING (source)
), b AS (
  SELECT source, block, sum(n_tokens) AS size, min(rest) AS rest, min(passes) AS passes FROM r GROUP BY 1, 2
), c AS (
  SELECT source, block, size, rest, sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('order0:' || source || ':' || (passes + 1) || ':' || block), 1, 8))::BIGINT, block ROWS UNBOUNDED PRECEDING) AS upto FROM b
), s AS (
  SELECT r.doc_id, r.ident, r.source, r.n_tokens, r.block, r.passes,
    (c.upto - c.size + sum(r.n_tokens) OVER (PARTITION BY r.source, r.block ORDER BY ('0x' || substr(md5('row0:' || (r.passes + 1) || ':' || r.ident), 1, 8))::BIGINT, r.ident, r.n_tokens RANGE UNBOUNDED PRECEDING) <= c.rest AND c.upto - c.size < c.rest) AS extra
  FROM r JOIN c ON r.source = c.source AND r.block = c.block
), o AS (
  SELECT doc_id, ident, source, n_tokens, unnest(range(1, (passes + extra::INT + 1)::BIGINT))::INT AS epoch, block FROM s
)
SELECT doc_id, source, n_tokens, epoch, block, ('0x' || substr(md5('order0:' || source || ':' || epoch || ':' || block), 1, 8))::BIGINT AS block_order,
  ('0x' || substr(md5('row0:' || epoch || ':' || ident), 1, 8))::BIGINT AS row_order FROM o
"""
