"""A polling loop of isolated stages over micro-batches, with effects that a replay doesn't double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: What a stage makes of a micro-batch.
Stages = dict[str, Callable[[DataFrame], DataFrame]]
LEDGER = "batch long, stage string, ok boolean, error string"


def run_cycle(batch: DataFrame, batch_id: int, stages: Stages, folder: str) -> list[tuple[int, str, bool, str | None]]:
    """Runs every stage on the batch and notes how it went; a stage that fails doesn't stop the others.

    A stage's rows go to its own folder for this batch, which is replaced as a whole, so that a
    batch that is run again leaves what one run leaves. Rows of a failed stage are kept aside in
    their input form for retry_failed().
    """
    notes: list[tuple[int, str, bool, str | None]] = []
    held = batch.persist()
    try:
        for name, make in stages.items():
            aside = f"{folder}/aside/{name}/batch={batch_id}"
            try:
                make(held).write.mode("overwrite").parquet(f"{folder}/out/{name}/batch={batch_id}")
                notes.append((batch_id, name, True, None))
                held.limit(0).write.mode("overwrite").parquet(aside)
            except Exception as error:  # noqa: BLE001 - the loop goes on, the ledger has it
                notes.append((batch_id, name, False, f"{type(error).__name__}: {str(error)[:300]}"))
                held.write.mode("overwrite").parquet(aside)
    finally:
        held.unpersist()
    batch.sparkSession.createDataFrame(notes, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/of={batch_id}")
    return notes


def polling_loop(source: DataFrame, stages: Stages, folder: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """The loop over a stream; without `every` it takes what there is and ends."""
    writer = source.writeStream.foreachBatch(lambda batch, batch_id: run_cycle(batch, batch_id, stages, folder) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """batch, stage, ok and error of every stage of every batch, as it went last."""
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(f"{folder}/ledger")


def latest(spark: SparkSession, folder: str, stage: str, key: list[str]) -> DataFrame:
    """What a stage has made so far: of each key the row of its last batch."""
    rows = spark.read.option("basePath", f"{folder}/out/{stage}").parquet(f"{folder}/out/{stage}")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("batch")))
    return rows.withColumn("__k", nth).filter("__k = 1").drop("__k", "batch")


def retry_failed(spark: SparkSession, stages: Stages, folder: str) -> list[tuple[int, str, bool, str | None]]:
    """Runs the failed stages of past batches again, on the rows kept aside."""
    out = []
    failed = [(r["batch"], r["stage"]) for r in ledger(spark, folder).filter("not ok").collect()]  # a row a failure
    for batch_id, name in failed:
        aside = spark.read.parquet(f"{folder}/aside/{name}/batch={batch_id}")
        try:
            stages[name](aside).write.mode("overwrite").parquet(f"{folder}/out/{name}/batch={batch_id}")
            out.append((batch_id, name, True, None))
        except Exception as error:  # noqa: BLE001
            out.append((batch_id, name, False, f"{type(error).__name__}: {str(error)[:300]}"))
    for batch_id in {b for b, _ in failed}:
        past = [tuple(r) for r in spark.read.schema(LEDGER).parquet(f"{folder}/ledger/of={batch_id}").collect()]  # a row a stage
        now = {n: note for b, n, *_ in out if b == batch_id for note in out if note[:2] == (b, n)}
        spark.createDataFrame([now.get(r[1], r) for r in past], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/of={batch_id}")
    return out
