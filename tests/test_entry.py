from __future__ import annotations

from pathlib import Path

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as registered
from flockscan import storage
from flockscan.operators.collocations import first_nodes
from flockscan.plans.word_graph import word_graph


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


OWN = [name for name in registered.oracle_sql() if name not in registered.LLM_QUERIES]


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, con, sf_dir, name):
    rows, problem = compare(spark, con, name, sf_dir)
    assert not problem
    assert rows or name == "empty_slice_no_date"


def test_every_sql_has_its_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())
    own = set(registered.queries()) - set(registered.LLM_QUERIES)
    assert own - set(registered.oracle_sql()) == {
        "communities",
        "communities_modularity",
    }


def test_entry_has_rows(spark):
    assert registered.entry(spark).limit(1).count() == 1


def test_word_graph_plan(sentences):
    made = word_graph(sentences)
    nodes = {r["word"]: r for r in made.nodes.collect()}
    assert nodes["en"]["size"] == 4 and nodes["la"]["degree"] == 3
    assert {r["component"] for r in nodes.values()} == {0}
    assert all(r["modularity"] is not None for r in nodes.values())
    assert made.stats.first()["edges"] == 9
    core_nodes, core_edges = made.core
    assert (core_nodes.count(), core_edges.count()) == (7, 9)
    assert [r["word"] for r in first_nodes(made.nodes, 3).collect()] == ["en", "guerre", "la"]


def test_saved_tables_live_in_the_named_folder(spark):
    saved = storage.save(spark.range(7), "probe", top=F.max("id"))
    assert saved.rows == 7 and saved.metrics["top"] == 6
    assert saved.path.startswith(storage.shared_folder(spark))
    assert saved.frame.count() == 7
    assert storage.save(spark.range(0), "probe").rows == 0


def test_workspace_leaves_nothing_behind(spark):
    with storage.workspace(spark):
        kept = storage.save(spark.range(3), "probe")
        assert kept.frame.count() == 3 and Path(kept.path).exists()
    assert not Path(kept.path).exists()
    outside = storage.save(spark.range(3), "probe")
    assert Path(outside.path).exists()
    outside.discard()


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_folder(Session())
    Context.master = "local[2]"
    assert "flockscan-" in storage.shared_folder(Session())
