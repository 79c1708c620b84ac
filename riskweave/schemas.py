"""Table schemas shared by the readers, the analysis plan and the report store."""

from pyspark.sql import types as T

SUBMISSION = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("filename", T.StringType()),
    T.StructField("language_override", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("submitted_at", T.TimestampType()),
])

FINDING = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("weight", T.IntegerType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("category", T.StringType()),
])

FACTS = T.StructType([
    T.StructField("imports", T.ArrayType(T.StringType())),
    T.StructField("functions", T.ArrayType(T.StringType())),
    T.StructField("num_lines", T.IntegerType()),
])

REPORT = T.StructType([
    T.StructField("language", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("risk_score", T.IntegerType()),
    T.StructField("total_weight", T.IntegerType()),
    T.StructField("num_findings", T.IntegerType()),
    T.StructField("facts", FACTS),
    T.StructField("findings", T.ArrayType(FINDING)),
    T.StructField("filename", T.StringType()),
    T.StructField("analyzed_at", T.StringType()),
])

STORED_REPORT = T.StructType([
    T.StructField("report_id", T.LongType()),
    T.StructField("filename", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("risk_score", T.IntegerType()),
    T.StructField("num_findings", T.IntegerType()),
    T.StructField("report_json", T.StringType()),
    T.StructField("language", T.StringType()),
])
