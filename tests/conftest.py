import os
import sys

import pytest

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from oracle_check import oracle, session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from riskweave.session import tuned
    return tuned(session())


@pytest.fixture(scope="session")
def duck():
    return oracle(SMALL)


@pytest.fixture(scope="session")
def sources(spark):
    """Builds routed submissions from (language, code) pairs; ids are positions."""
    def build(pairs):
        rows = [(i, f"f{i}.{'java' if lang == 'java' else 'py'}", lang, code) for i, (lang, code) in enumerate(pairs)]
        return spark.createDataFrame(rows, "file_id long, filename string, language string, code string")
    return build


@pytest.fixture(scope="session")
def told(sources):
    """rule@line lists per snippet."""
    from riskweave.plans import analysis

    def run(pairs):
        rows = analysis.reports(sources(pairs)).orderBy("file_id").collect()
        return [[f"{f.rule_id}@{f.line}" for f in row.findings] for row in rows]
    return run
