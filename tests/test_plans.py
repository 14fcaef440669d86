"""Plan checks: broadcast lexicon, pushed date filters, no Python in native operators,
partial top-k before shuffles."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from murmur.operators import emotions as em
from murmur.plans.registry import Ctx
from tests.conftest import SF_SMALL

NATIVE = ["aggr_by_day", "keywords_by_day", "keywords_by_period", "lexicon_frequency", "emotion_share",
          "emotion_total", "comments_of_day", "quota_sample", "emotion_keywords", "cluster_samples"]


def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_lexicon_is_broadcast(spark):
    p = plan_text(E.queries()["aggr_by_day"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p
    assert "SortMergeJoin" not in p


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_native_queries(spark, name):
    p = plan_text(E.queries()[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "ExistingRDD"):
        assert node not in p


def test_month_range_pushed_to_scan(spark):
    ctx = Ctx(spark, SF_SMALL)
    p = plan_text(em.chart_rows(ctx.predictions, "ekman", "month", ctx.pparams, "1996-01", "1996-03"))
    assert "PushedFilters" in p and "o_orderdate" in p.split("PushedFilters")[1].split("\n")[0]


def test_scan_reads_only_needed_columns(spark):
    p = plan_text(E.queries()["emotion_counts"](spark, SF_SMALL))
    schema = [ln for ln in p.splitlines() if "ReadSchema" in ln][0]
    assert "o_totalprice" not in schema and "o_orderdate" in schema


def test_top_k_runs_partial_limit_before_shuffle(spark):
    p = plan_text(E.queries()["cluster_samples"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_prediction_plugin_uses_arrow_batches(spark):
    p = plan_text(E.queries()["predict_pending"](spark, SF_SMALL))
    assert "MapInPandas" in p and "BatchEvalPython" not in p


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cross_or_nested_loop_joins(spark, name):
    p = plan_text(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_bucketed_tables_join_without_shuffle(spark):
    from murmur.sinks import save_bucketed
    ctx = Ctx(spark, SF_SMALL)
    save_bucketed(ctx.comments.select("id", "comment_lang"), "b_comments", "id", 8)
    save_bucketed(ctx.predictions.where("comment_id IS NOT NULL")
                  .select(F.col("comment_id").alias("id"), "ekman_prediction_emotion"), "b_predictions", "id", 8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("b_comments").join(spark.table("b_predictions"), "id")
        p = plan_text(j)
        assert "SortMergeJoin" in p and "Exchange" not in p
        assert j.count() == ctx.comments.join(ctx.predictions.select(F.col("comment_id").alias("id")), "id").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
