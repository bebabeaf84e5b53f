"""The registry, and that it holds without the llm folders."""

import builtins
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from seqloom import queries
from seqloom.plans import training

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con(sf_dir):
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_against_sql(spark, sf_dir, con, name):
    want, got = con.sql(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, sf_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    text = lambda d: sorted(map(str, d[sorted(want.columns)].astype(str).itertuples(index=False, name=None)))
    assert text(got) == text(want)


def test_groups_are_aligned_with_trained_weights(spark, sf_dir, monkeypatch):
    seen = []

    def train(sequences, **given):
        seen.append(given)
        return [training.Step(9, 0.0, queries.fixed_weights(sequences.sparkSession))]

    monkeypatch.setattr(training, "train", train)
    rows = lambda df: sorted(map(tuple, df.collect()))
    sequences = queries.order_sequences(spark, sf_dir)
    assert rows(entry.queries()["align_groups"](spark, sf_dir)) == rows(training.align_groups(sequences, queries.fixed_weights(spark)))
    for name in ("edges_by_group", "align_event_groups", "train"):
        assert entry.queries()[name](spark, sf_dir).count() > 0
    assert seen == [{}] * 4


@pytest.mark.parametrize("name", ["try_adding_edges", "is_valid_addition"])
def test_every_scored_edge_is_tried(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() == queries.scored(spark, sf_dir).count() > 0


def test_a_missing_need_of_the_operators_is_not_hidden(monkeypatch):
    """Only the absence of the folders themselves takes their queries away."""
    real = builtins.__import__

    def without_tokenizers(name, *given, **named):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'tokenizers'", name="tokenizers")
        return real(name, *given, **named)

    monkeypatch.setattr(builtins, "__import__", without_tokenizers)
    with pytest.raises(ModuleNotFoundError, match="tokenizers"):
        entry.queries()


def test_without_llm(tmp_path):
    shutil.copytree(f"{ROOT}/seqloom", tmp_path / "seqloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert len(q) > 50 and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
