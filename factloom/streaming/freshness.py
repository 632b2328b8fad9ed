"""Freshness ledger: which version of a fact is the current one; as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def ledger(seen: DataFrame) -> DataFrame:
    """(factId, oldHash, newHash, status, seq) per change; ``seen`` has factId, seen, seq, hash.

    A row whose hash differs from the one before it in its fact supersedes that one."""
    order = Window.partitionBy("factId").orderBy("seen", "seq")
    r = seen.withColumn("oldHash", F.coalesce(F.lag("hash").over(order), F.lit("")))
    status = F.when(F.col("oldHash") == "", "fresh").otherwise("superseded")
    return r.where(F.col("oldHash") != F.col("hash")).select("factId", "oldHash", F.col("hash").alias("newHash"), status.alias("status"), "seq")


SCHEMA = "factId string, oldHash string, newHash string, status string, seq bigint"


def stream(seen: DataFrame) -> DataFrame:
    """The same rows from a streaming ``seen``; each fact's last hash is the state."""

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["seen", "seq"], kind="stable")
        last, out = state.get[0] if state.exists else "", []
        for h, seq in zip(rows["hash"], rows["seq"], strict=True):
            if h != last:
                out.append((key[0], last, h, "fresh" if last == "" else "superseded", seq))
                last = h
        state.update((last,))
        yield pd.DataFrame(out, columns=["factId", "oldHash", "newHash", "status", "seq"])

    return seen.groupBy("factId").applyInPandasWithState(step, SCHEMA, "hash string", "append", GroupStateTimeout.NoTimeout)
