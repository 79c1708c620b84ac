"""Helpers shared by the operators: shipping the package, shared folders, row keys, per-worker word caches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of applications on a local master that set none, as in tests.
_LOCAL: dict[str, str] = {}
PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that don't have it installed (once per application)."""
    context = spark.sparkContext
    if getattr(context, "_riskweave_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(), "riskweave_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("riskweave", os.path.relpath(path, PACKAGE)))
    context.addPyFile(archive)
    context._riskweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master may go without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='riskweave-')}"
        _LOCAL[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def written(frame: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes ``frame`` to the shared folder; returns the table read back, and its path."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``written`` that later steps no longer read."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(name: str, taken: list[str]) -> str:
    """The name, or with as many underscores behind it as no column of ``taken`` has (names differ by more than case)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def whole_row(frame: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns beside it can clash with none of them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in frame.columns])


def row_column(name: str, of: str = "row") -> Column:
    return F.col(of).getField(name)


#: Keys with one in so many of the rows to be joined count as hot; there are at most so many of them.
HOT_KEYS = 20_000


def split_join(rows: DataFrame, values: DataFrame, key: str, n: str = "n", hot: int = HOT_KEYS) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row per key, ``n`` rows to be joined with it), without a hot key in a shuffle.

    The values of keys with one in ``hot`` of all those rows, at most ``hot`` keys, are broadcast; the others are joined by a
    shuffle. Both frames are read twice: hand over written tables, or what is cheap to make from them.
    """
    total = values.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    is_hot = F.col(n) * hot >= total
    common = F.broadcast(values.where(is_hot))
    return rows.join(common, key).unionByName(
        rows.join(common.select(key), key, "left_anti").join(values.where(~is_hot), key))


def salted_join(rows: DataFrame, values: DataFrame, key: str, spread: Column, hot: int = HOT_KEYS, chunk: int = 1 << 16) -> DataFrame:
    """``rows`` joined with ``values``, which may have many rows per key and of any size, without a hot key in the shuffle.

    Keys with more than ``chunk`` rows and more than one in ``hot`` of all, at most ``hot`` keys, are dealt into parts by the hash
    of ``spread``; the values of such a key go to each of its parts. ``rows`` is read twice.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    many = max(chunk, rows.count() // hot)
    parts = F.broadcast(sizes.where(F.col("n") > many).select(key, F.ceil(F.col("n") / many).cast("int").alias("parts")))
    dealt = rows.join(parts, key, "left").withColumn(
        "part", F.pmod(F.xxhash64(spread), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copied = values.join(parts, key, "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copied, [key, "part"]).drop("part")


def text_hash(column: str = "text") -> Column:
    """Tells rows of one doc_id apart; equal rows share it."""
    return F.xxhash64(F.col(column).isNull(), F.col(column))


def map_batches(frame: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
                schema: str | StructType) -> DataFrame:
    ship(frame.sparkSession)
    return frame.mapInArrow(function, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def text_parts(batch: pa.RecordBatch, column: pa.Array, size: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """``batch`` in runs of rows whose texts (of ``column``) have about ``size`` bytes together, each with its texts."""
    group = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows]
    for at, to in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(at, to - at), texts_of(column.slice(at, to - at))


_REMEMBERED: dict[str, Callable[[], None]] = {}


def takes_over(owner: str, release: Callable[[], None]) -> None:
    """Releases what other operators remember in this Python worker, which later stages use again; ``release`` does so for ``owner``."""
    for other in [x for x in _REMEMBERED if x != owner]:
        _REMEMBERED.pop(other)()
    _REMEMBERED[owner] = release


class Held(dict):
    """``compute(key)`` by key, remembered; about ``2 * limit`` keys are held at most, so a worker's memory is bounded.

    The limit never changes a result: what was not asked for lately is forgotten and computed again when it comes up.
    """

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
