"""Layout helpers: spreading small inputs, cluster settings."""

from murmur.operators.layout import spread
from murmur.session import cluster_conf


def test_spread_only_when_too_few_partitions(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert spread(one, "id").rdd.getNumPartitions() == cores
    many = spark.range(100).repartition(cores * 2)
    assert spread(many, "id") is many


def test_cluster_conf_sizes_shuffles_from_input():
    conf = cluster_conf(100 * 2**40, cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 << 20)
    assert cluster_conf(1 << 30, cores=8000)["spark.sql.shuffle.partitions"] == str(16000)
    assert conf["spark.sql.adaptive.enabled"] == "true"


def _entry_without(monkeypatch, *missing):
    """A fresh copy of the entry file, imported while the named modules cannot be."""
    import importlib.util
    import os
    import sys
    for name in [n for n in sys.modules if n.startswith("murmur.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in missing:
        monkeypatch.setitem(sys.modules, name, None)
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry_copy", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_entry_works_without_the_optional_parts_or_a_library_of_theirs(monkeypatch):
    from murmur.plans.catalog import QUERIES
    for missing in (("murmur.llm",), ("zstandard",)):
        with monkeypatch.context() as m:
            assert set(_entry_without(m, *missing).queries()) == set(QUERIES)
    with monkeypatch.context() as m:
        names = set(_entry_without(m, "corpus_pipeline").queries())
        assert "pipeline" not in names and names >= set(QUERIES)
