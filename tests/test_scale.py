"""Plan shape, long inputs, repeated contents, the store and the stream."""

import pytest
from pyspark.sql import functions as F

from riskweave.operators import corpus_wide, lines, tokens
from riskweave.plans import analysis, corpus
from riskweave.sources import reports as store
from riskweave.sources import submissions
from riskweave.streaming import ingest

from conftest import SMALL


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark):
    return submissions.accepted(corpus.source_files(spark, SMALL))


def test_one_exchange_and_no_pairing(files):
    text = plan(analysis.reports(files))
    assert text.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in text and "NestedLoop" not in text and "CartesianProduct" not in text
    assert "Python" not in text


def test_bucketed_table_needs_no_exchange(spark, files, tmp_path):
    spark.sql("DROP TABLE IF EXISTS bucketed_files")
    try:
        (files.repartition(4, "file_id").write.option("path", str(tmp_path / "t")).bucketBy(4, "file_id")
         .saveAsTable("bucketed_files"))
        table = spark.table("bucketed_files")
        mine = analysis.reports(table)
        assert "Exchange hashpartitioning" not in plan(mine)
        keys = ["file_id", "total_weight", "num_findings"]
        assert mine.select(keys).exceptAll(analysis.reports(files).select(keys)).count() == 0
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_files")


def test_long_texts_are_cut_between_tokens(files):
    keys = ["file_id", "pos", "line", "tok"]
    whole = tokens.placed(tokens.tokens(files)).select(keys)
    cut = tokens.placed(tokens.tokens(files, large=0)).select(keys)
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0


def test_hostile_texts(told):
    escapes = "a = '" + "\\n" * 500_000 + "'\n"
    comment = "/*" + " *x" * 500_000 + "*/\n"
    many = "import os\n" + "x = [1, 2]\n" * 60_000 + "y = os.sep\n"
    assert told([("python", escapes), ("java", comment + "class A { }\n"), ("python", many)]) == [[], [], []]


def test_one_content_holds_most_files(spark, sources):
    pairs = [("python", "import os\n")] * 300 + [("python", f"import a{i}\n") for i in range(30)]
    files = sources(pairs)
    once = corpus_wide.once_per_content(files, analysis.reports, salts=8)
    rows = once.collect()
    assert len(rows) == 330 and {r.total_weight for r in rows} == {1}
    assert len({r.analysed_id for r in rows}) == 31
    assert {r.filename for r in rows} == {f"f{i}.py" for i in range(330)}


def test_lines_like_splitlines(spark):
    texts = ["", "a", "a\n", "a\n\nb", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i", "x\n\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "file_id long, code string")
    got = {}
    for row in lines.lines(frame).orderBy("file_id", "line").collect():
        got.setdefault(row.file_id, []).append(row.text)
    assert [got.get(i, []) for i in range(len(texts))] == [t.splitlines() for t in texts]


def test_routing(spark):
    rows = [(1, "A.JAVA", None, "x"), (2, None, None, "x"), (3, "a.txt", "java", "x"), (4, "a.txt", "Java", "x"), (5, "a.py", None, " \n"), (6, "a.py", None, None)]
    files = spark.createDataFrame(rows, "file_id long, filename string, language_override string, code string")
    assert [(r.file_id, r.language) for r in submissions.accepted(files).orderBy("file_id").collect()] == [
        (1, "java"), (2, "python"), (3, "java"), (4, "python")]
    assert {r.file_id for r in submissions.rejected(files).collect()} == {5, 6}


def test_stream_equals_batch_and_replays_once(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    corpus.source_files(spark, SMALL).repartition(3).write.parquet(landing)
    for _ in range(2):  # the second start finds nothing new
        ingest.start(ingest.submission_stream(spark, landing, glob="*.parquet", per_trigger=2), out, str(tmp_path / "cp")).awaitTermination()
    streamed = store.read_store(spark, out)
    batch = store.stored(analysis.reports(submissions.accepted(corpus.source_files(spark, SMALL))))
    keys = ["report_id", "language", "risk_score", "num_findings"]
    assert streamed.select(keys).exceptAll(batch.select(keys)).count() == 0 and streamed.count() == batch.count()

    newest = store.history(store.read_store(spark, out)).collect()
    assert len(newest) == 50 and "report_json" not in newest[0].asDict()
    one = store.report_detail(store.read_store(spark, out), newest[0].id).collect()
    assert len(one) == 1 and one[0].risk_score == newest[0].risk_score and one[0].analyzed_at.endswith("+00:00")
    assert store.report_detail(store.read_store(spark, out), -5).count() == 0


def test_no_submission_vanishes(spark):
    rows = [(None, "a.py", None, "x = 1"), (None, "b.py", None, "y = 2"), (7, "c.py", None, "import os"), (7, "d.py", None, "z = 3"),
            (8, "e.py", None, " "), (None, "f.py", None, ""), (9, "g.py", None, "pass")]
    files = spark.createDataFrame(rows, "file_id long, filename string, language_override string, code string")
    told = analysis.reports(submissions.accepted(files)).select("filename").collect()
    reasons = {r.filename: r.reason for r in submissions.rejected(files).collect()}
    assert [r.filename for r in told] == ["g.py"]
    assert reasons == {"a.py": submissions.NO_ID, "b.py": submissions.NO_ID, "c.py": submissions.SHARED_ID, "d.py": submissions.SHARED_ID,
                       "e.py": submissions.NO_CODE, "f.py": submissions.NO_CODE}


def test_the_store_only_grows(spark, sources, tmp_path):
    rows = store.stored(analysis.reports(sources([("python", "import os\n")])))
    path, landing = str(tmp_path / "store"), str(tmp_path / "in")
    first, second = store.append(rows, path), store.append(rows, path)
    assert first != second and store.read_store(spark, path).count() == 2
    store.append(rows, path, first)  # a replay
    kept = store.read_store(spark, path)
    assert kept.count() == 2 and kept.select("run_id", "batch_id", "report_id").distinct().count() == 2
    sources([("python", "import os\n")]).selectExpr(
        "file_id", "filename", "'python' as language_override", "code", "current_timestamp() as submitted_at").write.parquet(landing)
    for checkpoint in ("one", "one", "two"):  # the new checkpoint begins at batch 0 again
        ingest.start(ingest.submission_stream(spark, landing, glob="*.parquet"), path, str(tmp_path / checkpoint)).awaitTermination()
    assert store.read_store(spark, path).count() == 4


def test_a_stream_that_keeps_running(spark, sources, tmp_path):
    landing, path = str(tmp_path / "in"), str(tmp_path / "store")
    rows = sources([("python", "import os\n"), ("java", "class A { }")]).selectExpr(
        "file_id", "filename", "language as language_override", "code", "current_timestamp() as submitted_at")
    rows.limit(1).write.parquet(landing)
    query = ingest.start(ingest.submission_stream(spark, landing, glob="*.parquet"), path, str(tmp_path / "cp"), interval="1 second")
    try:
        query.processAllAvailable()
        assert query.isActive
        rows.write.mode("append").parquet(landing)
        query.processAllAvailable()
    finally:
        query.stop()
    assert store.read_store(spark, path).count() == 3


def test_times_are_utc_in_any_session(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    assert other.range(1).select(store.iso(F.timestamp_seconds(F.lit(0)))).first()[0] == "1970-01-01T00:00:00.000000+00:00"


def test_the_callers_session_stays_as_it_is(spark):
    from riskweave.session import tuned
    other = spark.newSession()
    other.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "77m")
    tuned(other)
    assert other.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "77m"


def test_store_table(spark):
    spark.sql("DROP TABLE IF EXISTS risk_reports")
    try:
        store.ensure_table(spark, "risk_reports")
        store.ensure_table(spark, "risk_reports")
        assert spark.table("risk_reports").count() == 0
        assert "report_json" in spark.table("risk_reports").columns
    finally:
        spark.sql("DROP TABLE IF EXISTS risk_reports")


def test_source_tree(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("import os\n")
    (tmp_path / "B.java").write_text("class B { }\n")
    (tmp_path / "notes.md").write_text("x\n")
    files = submissions.read_source_tree(spark, str(tmp_path))
    rows = analysis.reports(submissions.accepted(files)).collect()
    assert {(r.filename, r.language, r.num_findings) for r in rows} == {("a.py", "python", 1), ("B.java", "java", 0)}


def test_changed_lines(spark):
    new = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "file_id long, line int, text string")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, text string")
    assert [tuple(r) for r in corpus_wide.changed_lines(new, old).collect()] == [(1, 2)]


def test_a_store_reads_only_what_is_asked_for(spark, sources, tmp_path):
    """A look-up prunes to the part of its id, the history to the newest days; both go on after a restart."""
    path = str(tmp_path / "store")
    made = analysis.reports(sources([("python", f"import os\nx = {i}\n") for i in range(24)]))
    moment = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("file_id") * 3600)
    store.append(store.stored(made, moment), path)
    rows = store.read_store(spark, path)
    plan = store.report_detail(rows, 13)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"(shard#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [r.report_id for r in store.report_detail(rows, 13).collect()] == [13]
    files = lambda frame: {r[0] for r in frame.select(F.input_file_name()).distinct().collect()}
    assert len(files(store.newest(rows, 5))) < len(files(rows))
    assert [r.id for r in store.history(store.newest(rows, 5), 5).collect()] == [23, 22, 21, 20, 19]
    assert [r.id for r in store.history(store.newest(rows, 500), 500).collect()] == list(range(23, -1, -1))
    store.append(store.stored(made.limit(1), F.lit("2024-01-05 10:00:00").cast("timestamp")), path)
    again = store.read_store(spark, path)
    assert again.count() == 25 and len(files(store.newest(again, 1))) == 1
    assert store.newest(again.limit(0), 5).count() == 0


def test_a_stream_over_a_table_of_several_files(spark, tmp_path):
    from riskweave.plans import catalog
    rows = [(i, "a line\n" * i, "en", "web", 7 * i) for i in range(1, 7)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (tmp_path / "many").mkdir()
    documents.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    (tmp_path / "one").mkdir()
    documents.toPandas().to_parquet(tmp_path / "one" / "documents.parquet", index=False)
    for name in ("many", "one"):
        told = catalog.queries()["j1_streamed_reports"](spark, str(tmp_path / name)).collect()
        assert sorted(r.report_id for r in told) == [1, 2, 3, 4, 5, 6]


def test_findings_on_changed_lines_are_made_once(spark, files):
    new = lines.lines(files)
    old = new.select((F.col("file_id") + 2).alias("file_id"), "text")
    made = corpus_wide.on_changed_lines(analysis.findings(analysis.reports(files)), new, old)
    text = plan(made)
    assert text.count("SortAggregate") + text.count("ObjectHashAggregate") == 1


def test_windows_copy_few_columns(files):
    """What a window only passes on is one struct; all columns side by side made up to 60."""
    widths, nodes = [], [analysis.reports(files)._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Window":
            widths.append(node.output().size())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert len(widths) > 8 and max(widths) <= 40
