"""Structured Streaming front-end: new incident rows -> evidence.

The reference handles incidents one after another as they are listed. Here
incident CSV files landing in a folder are a file stream; each micro-batch
(a set of new incidents) runs the same batch evidence plan, and results are
appended. Progress lives in the checkpoint folder, so a restarted query
resumes after the last completed batch; the evidence tables are keyed by
incident, so a replayed batch rewrites the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from faultlens.operators.metrics import with_neighbours
from faultlens.session import ensure_checkpoint_dir
from faultlens.sources.readers import read_incidents

INCIDENT_CSV_SCHEMA = T.StructType([
    T.StructField("uuid", T.StringType()),
    T.StructField("start_timestamp", T.LongType()),
    T.StructField("end_timestamp", T.LongType()),
    T.StructField("start_time_hour", T.StringType()),
    T.StructField("date", T.StringType()),
])


def incident_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 16) -> DataFrame:
    return (spark.readStream.schema(INCIDENT_CSV_SCHEMA).option("header", True)
            .option("maxFilesPerTrigger", max_files_per_trigger).csv(folder))


def run_incident_stream(spark: SparkSession, folder: str, process: Callable[[DataFrame, int], None],
                        name: str = "incident_evidence", available_now: bool = True, max_files_per_trigger: int = 16):
    """Start the stream; ``process(incidents_batch, batch_id)`` runs the batch plan.

    The stream tells which incidents are new. Their ``seq`` and the neighbours that bound their normal periods come from
    all files of the folder, in file order, so the size of a micro-batch changes no result.
    """
    ckpt = f"{ensure_checkpoint_dir(spark)}/streams/{name}"

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        listed = with_neighbours(read_incidents(session, folder))
        process(listed.join(batch.select("uuid").distinct(), "uuid", "left_semi").dropDuplicates(["uuid"]), batch_id)

    w = incident_stream(spark, folder, max_files_per_trigger).writeStream.foreachBatch(each).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
