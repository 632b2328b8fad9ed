"""Chat formatting after cumulative-snapshot collapse, with DataFrame operations only.

Loggers write a conversation again and again as it grows. Each turn gets rolling hashes of the
turns up to it (two 64-bit hashes of position, role and text, combined by xor along the
conversation), so a conversation that is a proper prefix of a longer one is found by an anti join
of final hashes against the distinct inner ones; equal conversations keep the smallest id. What
remains is rendered.

Defined cases: null role or text is ""; a null turn stands before all others; turns with equal
numbers are ordered by role, then text; rows that repeat one (conv_id, turn, role, text) count
once; rows with null conv_id are one conversation; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role, text and the rolling hashes h1 and h2."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("position", F.row_number().over(by))
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    rolled = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "position", "role", F.lit(seed + 1), "text")).over(so_far)
    return rows.withColumn("h1", rolled(11)).withColumn("h2", rolled(23))


def collapse(conversations: DataFrame) -> DataFrame:
    """Maximal conversations: conv_id, n_turns, n_same (equal ones, itself included), rendered."""
    turns = prefixes(conversations)
    said = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n"))
    whole = turns.groupBy("conv_id").agg(
        F.max("position").cast("long").alias("n_turns"),
        F.max_by("h1", "position").alias("h1"),
        F.max_by("h2", "position").alias("h2"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", said.alias("said")))), lambda t: t["said"]), "").alias("rendered"),
    )
    last = Window.partitionBy("conv_id")
    inner = turns.withColumn("n", F.max("position").over(last)).where("position < n").select(F.col("position").cast("long").alias("n_turns"), "h1", "h2").distinct()
    kept = whole.join(inner, ["n_turns", "h1", "h2"], "left_anti")
    first = F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")
    return kept.groupBy("n_turns", "h1", "h2", "rendered").agg(F.min(first)["conv_id"].alias("conv_id"), F.count(F.lit(1)).alias("n_same")).select("conv_id", "n_turns", "n_same", "rendered")


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT conv_id, row_number() OVER w AS n,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS rendered
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT conv_id, max(n) AS n_turns, arg_max(rendered, n) AS rendered FROM p GROUP BY 1
)
SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_same, rendered FROM f
WHERE NOT EXISTS (SELECT 1 FROM p JOIN f AS g ON p.conv_id = g.conv_id WHERE p.n < g.n_turns AND p.n = f.n_turns AND p.rendered = f.rendered)
GROUP BY n_turns, rendered
"""
