"""Reading submissions and preparing them for analysis."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.functions import text
from riskweave.schemas import SUBMISSION

NO_CODE = "No code provided."
NO_ID = "No file id."
SHARED_ID = "File id is not unique."


def read_submissions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Submissions stored as parquet, json, orc or csv with the submission schema."""
    return spark.read.format(fmt).schema(SUBMISSION).load(path)


def read_source_tree(spark: SparkSession, path: str, glob: str = "*.{py,java}") -> DataFrame:
    """Every file below ``path`` as one submission; the id is a hash of its path.

    Should two paths have one hash, both files are rejected by :func:`rejected` and none is merged into another.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .text(path, wholetext=True)
        .select(F.col("value").alias("code"), F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_modification_time").alias("submitted_at"))
    )
    return files.select(
        F.xxhash64("path").alias("file_id"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.lit(None).cast("string").alias("language_override"),
        "code", "submitted_at",
    )


def write_bucketed(files: DataFrame, table: str, buckets: int) -> None:
    """Store submissions bucketed by ``file_id``.

    The analysis plan needs its rows clustered by ``file_id``.  On such a table it has no
    exchange at all; on any other input it shuffles the texts once.
    """
    (files.repartition(buckets, "file_id").write.mode("append").format("parquet")
     .bucketBy(buckets, "file_id").saveAsTable(table))


def routed(files: DataFrame) -> DataFrame:
    """Submissions with the default file name filled in and the language resolved."""
    named = F.coalesce("filename", F.lit(text.DEFAULT_FILENAME))
    return files.withColumns({
        "language": text.resolve_language(F.col("filename"), F.col("language_override")),
        "filename": named,
    })


def accepted(files: DataFrame) -> DataFrame:
    """Routed submissions that hold code and have an id.

    Ids that several of them share are set aside where the plan clusters files by id (:func:`unique`), so
    that this costs no exchange of its own.
    """
    return routed(files.filter(text.has_code(F.col("code")) & F.col("file_id").isNotNull()))


def _copies() -> Column:
    return F.count(F.lit(1)).over(W.partitionBy("file_id"))


def unique(files: DataFrame) -> DataFrame:
    """Files whose id no other file has; clustered by ``file_id`` from here on."""
    return files.withColumn("_copies", _copies()).filter(F.col("_copies") == 1).drop("_copies")


def latest(files: DataFrame, submitted_at: Column, size: int) -> DataFrame:
    """The ``size`` submissions that came last, of those whose id no other has: chosen without their texts, which are then
    read for these alone."""
    ids = files.select("file_id", submitted_at.alias("moment")).groupBy("file_id").agg(
        F.max("moment").alias("moment"), F.count(F.lit(1)).alias("n")).where(F.col("n") == 1)
    chosen = ids.orderBy(F.desc("moment"), F.desc("file_id")).limit(size).select("file_id")
    return files.join(F.broadcast(chosen), "file_id", "left_semi")  # ``size`` ids


def rejected(files: DataFrame) -> DataFrame:
    """Every submission that gets no report, with the reason."""
    coded = text.has_code(F.col("code"))
    named = files.select("file_id", "filename", coded.alias("coded"))
    reason = F.when(~F.col("coded"), NO_CODE).when(F.col("file_id").isNull(), NO_ID)
    plain = named.filter(~F.col("coded") | F.col("file_id").isNull()).select("file_id", "filename", reason.alias("reason"))
    shared = named.filter(F.col("coded") & F.col("file_id").isNotNull()).withColumn("_copies", _copies()).filter(
        F.col("_copies") > 1).select("file_id", "filename", F.lit(SHARED_ID).alias("reason"))
    return plain.union(shared)
