"""Every operator as a query over the tables of a scale-factor folder."""

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import lexing, text
from riskweave.operators import corpus_wide, facts, lines, tokens
from riskweave.plans import analysis, corpus
from riskweave.session import tuned
from riskweave.sources import dims, submissions
from riskweave.sources import reports as store
from riskweave.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
TOP_K = 25
TUNED_WEIGHTS = {("python", "HARDCODED_SECRET"): 10, ("java", "UNUSED_IMPORT"): 2}
TUNED_THRESHOLDS = {"python": 10, "java": 8}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names for checkpoints; only a local master may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="riskweave-")
    return f"{base}/{uuid.uuid4().hex}"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submissions.accepted(corpus.source_files(spark, sf_dir))


def _language(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    return _files(spark, sf_dir).filter(F.col("language") == language)


def _fact(view: Callable[[DataFrame], DataFrame], language: str, *columns: str) -> Query:
    def query(spark, sf_dir):
        rows = facts.annotated(_language(spark, sf_dir, language))
        return view(rows).select("file_id", *columns)
    return query


def _rule(language: str, rule_id: str) -> Query:
    def query(spark, sf_dir):
        found = analysis.findings(analysis.reports(_language(spark, sf_dir, language), [rule_id]))
        return found.filter(F.col("rule_id") == rule_id)
    return query


def _submissions(spark, sf_dir):
    return corpus.source_files(spark, sf_dir).select("file_id", "filename", "language_override", "code")


def _document_lines(spark, sf_dir):
    return lines.lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def _conversation_lines(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", F.posexplode(text.split_lines(F.col("text"))).alias("pos", "line_text")).select(
        "conv_id", "turn", (F.col("pos") + 1).alias("line"), "line_text")


def _rule_catalog(spark, sf_dir):
    found = analysis.findings(analysis.reports(_files(spark, sf_dir))).groupBy("language", "rule_id").agg(
        F.count(F.lit(1)).alias("n_findings"))
    return F.broadcast(dims.ref_rule(spark)).join(found, ["language", "rule_id"], "left").select(
        "language", "rule_id", "severity", "weight", "category", "rule_order",
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def _routing(spark, sf_dir):
    return submissions.routed(corpus.source_files(spark, sf_dir)).select("file_id", "filename", "language")


def _rejected(spark, sf_dir):
    return submissions.rejected(corpus.source_files(spark, sf_dir))


def _line_counts(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("language").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(text.count_lines(F.col("code"))).alias("n_lines"))


def _tokens(spark, sf_dir):
    return tokens.placed(tokens.tokens(_files(spark, sf_dir))).filter(F.col("t1") != lexing.NONE).select(
        "file_id", "pos", "line", "tok")


def _structure(spark, sf_dir):
    rows = tokens.placed(tokens.tokens(_files(spark, sf_dir))).filter(F.col("t1") != lexing.NONE)
    return rows.select(
        "file_id", "pos", "level", "line_start", F.when(F.col("line_start"), F.col("indent")).alias("margin"),
        F.col("stmt.pos").alias("stmt_pos"))


def _malformed(spark, sf_dir):
    return facts.faults(_files(spark, sf_dir))


def _documents_secrets(spark, sf_dir):
    return lines.secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.lit("python"), "doc_id", "text")


def _conversations_secrets(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", F.explode(text.secret_lines(F.col("text"), F.lit("java"))).alias("line"))


def _scores(spark, sf_dir):
    return analysis.reports(_files(spark, sf_dir)).select(
        "file_id", "filename", "language", "total_weight", "num_findings", "risk_score", "risk_level")


def _facts(spark, sf_dir):
    return analysis.reports(_files(spark, sf_dir), []).select(
        "file_id", F.array_join("facts.imports", "|").alias("imports"),
        F.array_join("facts.functions", "|").alias("functions"), "facts.num_lines")


def _display_counts(spark, sf_dir):
    return analysis.reports(_files(spark, sf_dir)).select(
        "file_id", F.size("facts.functions").alias("n_functions"), F.size("facts.imports").alias("n_imports"),
        "facts.num_lines", "num_findings")


def _ordered_findings(spark, sf_dir):
    return analysis.reports(_files(spark, sf_dir)).select(
        "file_id", F.array_join(F.transform("findings", lambda x: F.concat_ws("@", x["rule_id"], x["line"].cast("string"))), " ").alias("findings"))


def _findings(spark, sf_dir):
    return analysis.findings(analysis.reports(_files(spark, sf_dir)))


def _with_time(spark, sf_dir):
    files = corpus.source_files(spark, sf_dir)
    return analysis.reports(submissions.accepted(files))


def _submitted(file_id):
    return F.timestamp_seconds(F.lit(1700000000) + F.col(file_id))


def _report_json(spark, sf_dir):
    return store.stored(_with_time(spark, sf_dir), _submitted("file_id")).select("report_id", "report_json")


def _report_decoded(spark, sf_dir):
    rows = store.decoded(store.stored(_with_time(spark, sf_dir), _submitted("file_id")))
    return rows.select(
        "report_id", "filename", "language", "risk_score", "analyzed_at",
        F.array_join("facts.imports", "|").alias("imports"),
        F.aggregate("findings", F.lit(0), lambda total, x: total + x["line"]).alias("line_sum"))


def _history(spark, sf_dir):
    """The newest reports; only the submissions that they are about are analysed."""
    files = submissions.accepted(corpus.source_files(spark, sf_dir))
    last = submissions.latest(files, _submitted("file_id"), store.HISTORY_SIZE)
    return store.history(store.stored(analysis.reports(last), _submitted("file_id")))


def _stored_reports(spark, sf_dir):
    path = shared_folder(spark)
    store.append(store.stored(_with_time(spark, sf_dir)), path)
    return store.read_store(spark, path).select("report_id", "filename", "language", "risk_level", "risk_score", "num_findings")


def _streamed_reports(spark, sf_dir):
    folder = shared_folder(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the table is one file or a folder of files; a stream takes either when its path is a pattern
    stream = spark.readStream.schema(documents.schema).parquet(f"{sf_dir}/documents.parque[t]")
    query = ingest.start(corpus.from_documents(stream), f"{folder}/reports", f"{folder}/checkpoint")
    query.awaitTermination()
    return store.read_store(spark, f"{folder}/reports").select(
        "report_id", "filename", "language", "risk_level", "risk_score", "num_findings")


def _rollup(spark, sf_dir):
    return corpus_wide.finding_rollup(_findings(spark, sf_dir))


def _riskiest(spark, sf_dir):
    return corpus_wide.riskiest(analysis.reports(_files(spark, sf_dir)), TOP_K).select(
        "file_id", "filename", "total_weight", "risk_score", "risk_level")


def _once_per_content(spark, sf_dir):
    return corpus_wide.once_per_content(_files(spark, sf_dir), analysis.reports).select(
        "file_id", "filename", "analysed_id", "total_weight", "risk_level")


def _tuned(spark, sf_dir):
    return analysis.reports(_files(spark, sf_dir), thresholds=TUNED_THRESHOLDS, weights=TUNED_WEIGHTS).select(
        "file_id", "total_weight", "num_findings", "risk_score", "risk_level")


def _changed(spark, sf_dir):
    # the version before a submission is the one handed in two ids earlier
    new = lines.lines(_files(spark, sf_dir))
    old = new.select((F.col("file_id") + 2).alias("file_id"), "text")
    return corpus_wide.on_changed_lines(_findings(spark, sf_dir), new, old).select(
        "file_id", "line", "rule_id", "message")


_QUERIES: dict[str, Query] = {
    "a1_submissions": _submissions,
    "a2_document_lines": _document_lines,
    "a2_conversation_lines": _conversation_lines,
    "a3_rule_catalog": _rule_catalog,
    "a4_stored_reports": _stored_reports,
    "a5_report_json": _report_json,
    "a6_report_decoded": _report_decoded,
    "b1_b2_b4_routing": _routing,
    "b3_rejected": _rejected,
    "b6_line_counts": _line_counts,
    "c1_tokens": _tokens,
    "c2_structure": _structure,
    "c3_malformed": _malformed,
    "c4_imports_python": _fact(facts.imports, "python", "line", "path", "top", "bound_name", "wildcard"),
    "c4_imports_java": _fact(facts.imports, "java", "line", "path", "top", "bound_name", "wildcard"),
    "c5_functions_python": _fact(facts.functions, "python", "pos", "name", "line"),
    "c5_methods_java": _fact(facts.functions, "java", "pos", "name", "line"),
    "c6_name_refs": _fact(facts.name_refs, "python", "name"),
    "c7_attributes": _fact(facts.attributes, "python", "pos", "line", "qualifier", "member"),
    "c8_calls_python": _fact(facts.calls, "python", "pos", "line", "qualifier", "member", "n_args"),
    "c8_calls_java": _fact(facts.calls, "java", "pos", "line", "qualifier", "member", "n_args"),
    "c9_parameters_python": _fact(facts.parameters, "python", "function", "line", "parameter"),
    "c9_parameters_java": _fact(facts.parameters, "java", "function", "line", "parameter"),
    "c10_guards_python": _fact(facts.guards, "python", "pos", "line", "name"),
    "c10_guards_java": _fact(facts.guards, "java", "pos", "line", "name"),
    "c11_dereferences_python": _fact(facts.dereferences, "python", "pos", "line", "name"),
    "c11_dereferences_java": _fact(facts.dereferences, "java", "pos", "line", "name"),
    "c12_handlers_python": _fact(facts.handlers, "python", "line", "types", "body"),
    "c12_handlers_java": _fact(facts.handlers, "java", "line", "types", "body"),
    "c13_c14_complexity_python": _fact(facts.spans, "python", "name", "line", "start", "end", "complexity"),
    "c13_complexity_java": _fact(facts.spans, "java", "name", "line", "start", "end", "complexity"),
    "d4_document_secrets": _documents_secrets,
    "e4_conversation_secrets": _conversations_secrets,
    "g1_g4_scores": _scores,
    "g6_facts": _facts,
    "g7_ordered_findings": _ordered_findings,
    "g8_display_counts": _display_counts,
    "h3_history": _history,
    "h4_findings": _findings,
    "j1_streamed_reports": _streamed_reports,
    "k1_finding_rollup": _rollup,
    "k2_riskiest_files": _riskiest,
    "k3_once_per_content": _once_per_content,
    "k4_tuned_scores": _tuned,
    "k5_changed_line_findings": _changed,
}
RULE_KEYS = {}
for _language_name, _letter in (("python", "d"), ("java", "e")):
    _own = [rule for lang, rule, *_ in dims.RULES if lang == _language_name]
    for _number, _rule_id in enumerate(_own):
        RULE_KEYS[f"{_letter}{_number}_{_rule_id.lower()}"] = (_language_name, _rule_id)
_QUERIES.update({key: _rule(*value) for key, value in RULE_KEYS.items()})


def queries() -> dict[str, Query]:
    """All queries, run with the session settings of the library."""
    def bound(query: Query) -> Query:
        return lambda spark, sf_dir: query(tuned(spark), sf_dir)
    return {key: bound(query) for key, query in _QUERIES.items()}
