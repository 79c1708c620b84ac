"""Session settings the plans were measured with."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession

#: To be set where the session is built: without it Spark notes the place of each call of a column function, which takes half
#: of the time in which a report is planned.
#: A report has more generated classes than Spark keeps by default, so that every task would compile all of them again.
CLASSES = "spark.sql.codegen.cache.maxEntries"
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false", CLASSES: "2000"}

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Long generated methods are not compiled by the JVM; below this limit Spark generates
    # one class per operator instead, which is compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows arrive sorted by file, so reports are gathered without hashing or sorting again.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # Text grows about tenfold in its token rows after the exchange, so partitions are merged
    # up to a small size only: the sorts of a task then stay in memory (0.8 GB in 8 MB, measured), however large the input is.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # Partitions can only be merged: with as many to begin with, a task gets no more than that up to some 24 GB of shuffled text.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
}


def tuned(spark: SparkSession) -> SparkSession:
    """A session of its own with the settings; ``spark`` and its settings stay as they are.

    The copy shares the application, the catalog and the settings made so far.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, value in SETTINGS.items():
        own.conf.set(key, value)
    # tasks take it from the session of their query, but ``conf.set`` refuses it once a session is built
    own._jsparkSession.sessionState().conf().setConfString(CLASSES, AT_START[CLASSES])
    return own


_HELD: dict = {}


def held(build: Callable) -> Callable:
    """Keeps the columns that a function of plain arguments builds; they name columns only, so any frame can use them.

    A report consists of some three thousand column expressions, each of which is a call into the JVM.
    """
    @wraps(build)
    def found(*args):
        session = SparkSession.getActiveSession()
        context = session.sparkContext if session else None
        if _HELD.get("context") is not context or context is None:
            _HELD.clear()
            _HELD["context"] = context
        key = (build.__module__, build.__qualname__, args)
        if key not in _HELD:
            _HELD[key] = build(*args)
        return _HELD[key]

    return found
