"""The report store: a parquet table, appended per batch."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructField, StructType

from riskweave.schemas import REPORT, STORED_REPORT

HISTORY_SIZE = 50
#: Parts into which the ids of a day are dealt, so that a look-up of an id reads one of them.
SHARDS = 8


def iso(moment: Column) -> Column:
    """ISO text in UTC, whatever the time zone of the session."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def report_json(created_at: Column) -> Column:
    """The report as JSON text (A5)."""
    return F.to_json(F.struct(
        "language", "risk_level", "risk_score", "total_weight", "num_findings", "facts", "findings", "filename",
        iso(created_at).alias("analyzed_at"),
    ))


def stored(reports: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Rows of the store; the report id is the id of the submission."""
    moment = F.current_timestamp() if created_at is None else created_at
    return reports.select(
        F.col("file_id").alias("report_id"), "filename", moment.alias("created_at"), "risk_level", "risk_score",
        "num_findings", report_json(moment).alias("report_json"), "language",
    )


def ensure_table(spark: SparkSession, table: str) -> None:
    """Creates an empty store table when there is none."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STORED_REPORT.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY (language)")


def shard_of(report_id: Column) -> Column:
    return F.pmod(F.coalesce(report_id, F.lit(0)), F.lit(SHARDS)).cast("int")


def day_of(moment: Column) -> Column:
    """The day in UTC."""
    return F.to_date(F.to_utc_timestamp(moment, F.current_timezone()))


def append(rows: DataFrame, path: str, run_id: str | None = None, batch_id: int = 0) -> str:
    """Adds a batch to the store and returns its run id (A4).

    Without a run id each call is a run of its own, so nothing that is stored is ever replaced. A stream names its run: a
    batch that it repeats after a failure replaces itself, and is counted once.
    """
    run_id = run_id or uuid.uuid4().hex
    placed = rows.select("*", day_of(F.col("created_at")).alias("day"), shard_of(F.col("report_id")).alias("shard"))
    placed.write.mode("overwrite").partitionBy("day", "shard").parquet(f"{path}/run_id={run_id}/batch_id={batch_id}")
    return run_id


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All stored reports. ``(run_id, batch_id, report_id)`` identifies one, so repeated submissions of a file stay apart."""
    columns = StructType([
        *STORED_REPORT.fields, StructField("run_id", StringType()), StructField("batch_id", LongType()),
        StructField("day", DateType()), StructField("shard", IntegerType())])
    return spark.read.schema(columns).option("basePath", path).parquet(f"{path}/run_id=*/batch_id=*")


def newest(rows: DataFrame, size: int = HISTORY_SIZE) -> DataFrame:
    """Reports of the store from the days that hold the newest ``size``; the others are not read.

    Reports are counted by day from the files' footers; there is one row per day.
    """
    by_day = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    later = F.sum("n").over(W.orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1))
    needed = by_day.withColumn("later", F.coalesce(later, F.lit(0))).where(F.col("later") < size).agg(F.min("day")).first()[0]
    return rows.where(F.col("day") >= F.lit(needed)) if needed else rows


def history(rows: DataFrame, size: int = HISTORY_SIZE) -> DataFrame:
    """The newest reports without their text (H3); on a store, ``newest`` leaves out older days first."""
    return rows.orderBy(F.desc("created_at"), F.desc("report_id")).limit(size).select(
        F.col("report_id").alias("id"), "filename", "language", "created_at", "risk_level", "risk_score", "num_findings"
    )


def decoded(rows: DataFrame) -> DataFrame:
    """Reports read back from their JSON text."""
    return rows.select("report_id", F.from_json("report_json", REPORT).alias("r")).select("report_id", "r.*")


def report_detail(rows: DataFrame, report_id: int) -> DataFrame:
    """One stored report; no row when there is none (A6). Of a store only the part of the id is read."""
    if "shard" in rows.columns:
        rows = rows.filter(F.col("shard") == report_id % SHARDS)
    return decoded(rows.filter(F.col("report_id") == report_id))
