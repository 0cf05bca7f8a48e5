"""Incremental event ingest: deduplicated streams, idempotent upserts, streaming hysteresis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.book import held_then_best
from tidemark.operators.names import distinct_latest
from tidemark.session import cut_lineage


def deduplicated(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First arrival of each natural key, however late: no watermark, so no row is lost and the state holds every key.

    For key spaces without a bound use `ingest`, which keeps the keys in the target's partitions instead.
    """
    return stream.dropDuplicates(list(keys))


def upsert(batch: DataFrame, root: str, partition: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Merge a batch into the partitions it touches; running it twice changes nothing.

    The latest row of a key by `order` stays, so late and repeated files give the same table as a
    single load. Only touched partitions are read; the merged rows are checkpointed in the shared
    folder before the partitions they come from are replaced.
    """
    touched = batch.select(partition).distinct()
    merged = batch
    target = _target(batch, root)
    if target is not None:
        old = target.join(touched, partition, "left_semi")
        merged = old.select(batch.columns).unionByName(batch)
    ranking = [F.col(c).desc_nulls_last() for c in order]
    # A full row order as last resort makes the choice independent of arrival.
    rest = [F.col(c) for c in batch.columns if c not in (*keys, *order)]
    latest = cut_lineage(distinct_latest(merged, [*keys], [*ranking, *rest]))
    latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(root)


def _target(batch: DataFrame, root: str) -> DataFrame | None:
    """The table under `root`; none before the first batch."""
    try:
        return batch.sparkSession.read.schema(batch.schema).parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def ingest(stream: DataFrame, root: str, checkpoint: str, partition: str, keys: Sequence[str], order: Sequence[str]):
    """Run all waiting files through `upsert` and stop; the checkpoint remembers what was read."""

    def write(batch: DataFrame, _: int) -> None:
        upsert(batch, root, partition, keys, order)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def hysteresis_stream(ranked: DataFrame, k: int, buffer: int) -> DataFrame:
    """Streaming twin of the hysteresis selection: the state of a strategy is its current names.

    Each micro-batch brings the short ranking (k + buffer names) of new dates per strategy.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ticker = dict(ranked.dtypes)["ticker"]

    def choose(key, batches, state: GroupState):
        kept = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(batches)).sort_values(["trade_date", "rank", "ticker"])
        for _, group in rows.groupby("trade_date", sort=True):
            chosen = held_then_best(group["ticker"].tolist(), kept, k, buffer)
            kept = set(chosen)
            picked = group[group["ticker"].isin(kept)]
            yield picked.assign(target_weight=1.0 / max(len(chosen), 1))[["strategy", "trade_date", "ticker", "rank", "target_weight"]]
        state.update((sorted(kept),))

    return ranked.select("strategy", "trade_date", "ticker", F.col("rank").cast("bigint").alias("rank")).groupBy("strategy").applyInPandasWithState(
        choose,
        f"strategy string, trade_date date, ticker {ticker}, rank bigint, target_weight double",
        f"names array<{ticker}>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
