"""Continuous submissions (J1): a file stream, analysed per micro-batch, appended to the store."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from riskweave.plans import analysis
from riskweave.schemas import SUBMISSION
from riskweave.sources import reports as store
from riskweave.sources import submissions


def submission_stream(spark: SparkSession, path: str, fmt: str = "parquet", glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """Submissions as files arrive below ``path``."""
    return (
        spark.readStream.format(fmt).schema(SUBMISSION).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", per_trigger).load(path)
    )


def start(
    stream: DataFrame, path: str, checkpoint: str, created_at: Column | None = None, interval: str | None = None
) -> StreamingQuery:
    """Analyses submissions as they come and appends their reports below ``path``.

    The plan orders tokens by position, which streaming frames do not allow, so each
    micro-batch runs the batch plan.  Batches are written under the id that the checkpoint gives the
    query and their own: a batch that is repeated after a failure replaces itself, and a stream with a
    new checkpoint is a run of its own.  ``interval``, such as ``10 seconds``, keeps the stream running;
    without it the stream ends when all that is there has been read.
    """
    def analyse(batch: DataFrame, batch_id: int) -> None:
        rows = store.stored(analysis.reports(submissions.accepted(batch)), created_at)
        run_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        store.append(rows, path, run_id, batch_id)

    writer = stream.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
