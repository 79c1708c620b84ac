"""Operators over the findings of a whole corpus (K1, K2, K3, K5)."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finding_rollup(findings: DataFrame) -> DataFrame:
    """Counts and weights by language, rule and severity with subtotals (K1)."""
    return findings.rollup("language", "rule_id", "severity").agg(
        F.count(F.lit(1)).alias("n_findings"), F.sum("weight").alias("total_weight"),
    )


def riskiest(reports: DataFrame, k: int) -> DataFrame:
    """The k files of the greatest weight (K2)."""
    return reports.orderBy(F.desc("total_weight"), "file_id").limit(k)


def once_per_content(files: DataFrame, analyse: Callable[[DataFrame], DataFrame], salts: int = 256) -> DataFrame:
    """Analyses equal contents once and gives every copy the report (K3).

    A popular content may own a third of all files, so its copies are spread over ``salts``
    groups on the way in (counted per content and salt first) and on the way back (the report
    is repeated only for the salts that occur).
    """
    keyed = files.withColumns({
        "content": F.sha2(F.concat_ws(":", "language", "code"), 256),
        "salt": F.pmod(F.xxhash64("file_id"), F.lit(salts)),
    })
    groups = keyed.groupBy("content", "salt").agg(F.min("file_id").alias("first_id"))
    originals = groups.groupBy("content").agg(F.min("first_id").alias("file_id"))
    reports = analyse(files.join(originals.select("file_id"), "file_id", "left_semi")).drop("filename", "language")
    told = originals.join(reports, "file_id").withColumnRenamed("file_id", "analysed_id")
    spread = groups.select("content", "salt").join(told, "content")
    return keyed.select("file_id", "filename", "language", "content", "salt").join(
        spread, ["content", "salt"]
    ).drop("salt")


def changed_lines(new_lines: DataFrame, old_lines: DataFrame) -> DataFrame:
    """``(file_id, line)`` of lines whose text the older version of the file does not have; lines are compared by digest."""
    digest = F.unhex(F.md5("text")).alias("digest")
    return new_lines.select("file_id", "line", digest).join(
        old_lines.select("file_id", digest), ["file_id", "digest"], "left_anti").select("file_id", "line")


def on_changed_lines(findings: DataFrame, new_lines: DataFrame, old_lines: DataFrame) -> DataFrame:
    """Findings on changed lines only (K5).

    The findings are made once: lines are told apart by digest for all files, which costs far less than to analyse the files again
    for the keys of those with a finding.
    """
    return findings.join(changed_lines(new_lines, old_lines), ["file_id", "line"], "left_semi")
