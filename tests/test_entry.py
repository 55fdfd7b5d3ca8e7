import importlib
import subprocess
import sys

import pytest

import __spark_entry__

LLM = ("corpus_pipeline", "lexitally.llm", "lexitally.llm.queries")


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["rank", "word", "cnt"] and df.count() == 100


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("missing", LLM)
def test_engine_alone(monkeypatch, missing):
    monkeypatch.setitem(sys.modules, missing, None)
    for name in LLM:
        if name != missing:
            monkeypatch.delitem(sys.modules, name, raising=False)
    try:
        alone = importlib.reload(__spark_entry__)
        assert "top_words" in alone.queries() and not any(n.startswith("op") for n in alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_engine_does_not_import_the_operators():
    code = "import sys, lexitally.cli, lexitally.plans.queries, lexitally.streaming.word_stream; sys.exit(any('.llm' in m for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
