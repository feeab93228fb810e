"""Keyed state over metric logs, and incremental result tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from rasterledger.operators.ranking import IMPROVEMENT_MARGIN, early_stopping

def _stored(batch: DataFrame, path: str) -> DataFrame | None:
    try:
        return batch.sparkSession.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def keep_early_stopping(
    path: str, patience: int, *, margin: float = IMPROVEMENT_MARGIN
) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: best epoch and stop flag per run after every batch of (run, epoch, value).

    Each batch is folded by ``ranking.early_stopping`` onto the results of the batch before it,
    which are five numbers per run, and stores the results of all runs in a folder of its
    own; a batch that is replayed overwrites itself. A large batch of one run spreads over
    tasks. Rows of a run may come in any order inside a batch; epochs have to arrive in
    order across batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        before = _stored(batch, f"{path}/batch={batch_id - 1}") if batch_id else None
        rows = batch.select("run", F.col("epoch").cast("bigint").alias("epoch"), "value")
        after = early_stopping(rows, "run", "epoch", "value", patience, margin, before)
        after.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_results(spark: SparkSession, path: str) -> DataFrame:
    """Results after the last batch that ``keep_early_stopping`` stored."""
    stored = spark.read.parquet(path)
    last = stored.agg(F.max("batch")).first()[0]
    return stored.where(F.col("batch") == last).drop("batch")


def append_new_results(path: str, keys: Sequence[str], order: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: append rows whose key is not stored, the first by ``order``.

    A batch that is replayed after a failure finds its keys stored and adds nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fields = F.struct(*batch.columns)
        first = batch.groupBy(*keys).agg(F.min_by(fields, order).alias("_r")).select("_r.*")
        stored = _stored(batch, path)
        fresh = first if stored is None else first.join(stored.select(*keys), list(keys), "left_anti")
        fresh.write.mode("append").parquet(path)

    return write


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> int:
    """Process everything that is available and stop; returns the rows that stateful operators dropped as late.

    Rows are counted as the operators see them: an aggregation sees one for each key of an input part.
    """
    query = (
        stream.writeStream.foreachBatch(sink)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer with one folder per batch, so a replay overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
