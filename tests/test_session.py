"""Session settings that a report needs in a session which was built without them."""

import os
import subprocess
import sys

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")

# a process of its own: the first query of a JVM fixes how many generated classes it keeps
_TWICE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config(map={
    "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.driver.host": "127.0.0.1"}).getOrCreate()
from riskweave.plans import analysis
from riskweave.session import tuned
own = tuned(spark)
compiled = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME()
counts = []
for _ in range(2):
    files = own.createDataFrame([(1, "a.py", "python", "import os\\n"), (2, "B.java", "java", "class B { }\\n")],
                                "file_id long, filename string, language string, code string")
    analysis.reports(files).collect()
    counts.append(compiled.getCount())
print("COUNTS", *counts)
"""


def test_a_second_report_compiles_nothing_again():
    """Every task compiled all classes of a report: Spark keeps 100 unless told otherwise, and a report has about 160."""
    done = subprocess.run([sys.executable, "-c", _TWICE, ROOT], capture_output=True, text=True, timeout=600)
    line = [x for x in done.stdout.splitlines() if x.startswith("COUNTS")]
    assert line, done.stderr[-2000:]
    first, second = map(int, line[0].split()[1:])
    assert first > 100 and second - first <= 5
