"""Files of derived drops grow with the input; no task reads it whole."""

from pyspark.sql import functions as F

from murmur.operators.ingest import first_per_key
from murmur.sources import drops


def test_files_follow_the_size(spark, tmp_path, monkeypatch):
    src = str(tmp_path / "src")
    spark.range(20000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t")).write.parquet(src)
    df = spark.read.parquet(src)
    assert drops.files_of(df) == drops.files_of(df, gzip=True) == 4
    monkeypatch.setattr(drops, "GZIP_FILE_BYTES", 100_000)
    assert drops.files_of(df, gzip=True) > 8
    out = drops.write_drop(df, str(tmp_path / "drop"), [F.col("k"), F.col("t")], "k", gzip=True)
    got = spark.read.text(out)
    assert len(got.inputFiles()) == drops.files_of(df, gzip=True) and got.distinct().count() == 20000
    firsts = [int(spark.read.text(f).first()[0].split("\t")[0]) for f in sorted(got.inputFiles())]
    assert firsts == sorted(firsts)


def test_first_per_key_holds_the_place_once(spark):
    rows = [(k % 7, f"v{k}", f"file{9 - k % 3}", k // 20, k) for k in range(100)]
    df = spark.createDataFrame(rows, "article_id long, v string, file_path string, block_start long, row_pos long")
    got = first_per_key(df)
    want = {}
    for r in sorted(rows, key=lambda r: r[2:]):
        want.setdefault(r[0], r)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == set(want.values())
    slim = got.select("article_id", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "struct" in slim and slim.count("file_path#") <= 4


def test_compacted_stream_reads_the_input_in_its_parts(spark, tmp_path, monkeypatch):
    import murmur.plans.q_streaming as qs
    from tests.conftest import SF_SMALL
    folder, work = tmp_path / "data", tmp_path / "work"
    folder.mkdir()
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(3).write.parquet(str(folder / "documents.parquet"))
    monkeypatch.setattr(qs, "scratch_path", lambda *_: str(work))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        qs.q_stream_aggr_compacted(spark, str(folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(len(list((work / "drops" / str(k)).glob("*.parquet"))) > 1 for k in range(3))
    assert 3 <= len(list((work / "sink").glob("batch_id=*"))) <= 4


def test_a_drop_of_given_files_shuffles_no_rows(spark, tmp_path):
    rows = [(k * 7919 % 5000, f"line\t{k}") for k in range(5000)] + [(None, "first"), (4999, "twice")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    src = str(tmp_path / "src")
    df.write.parquet(src)
    df = spark.read.parquet(src)
    lines, _ = drops.in_files(df, "k", [F.col("k"), F.col("t")], 4)
    assert "Exchange hash" not in (plan := lines._jdf.queryExecution().executedPlan().toString()) and "Exchange range" not in plan
    out = drops.write_drop(df, str(tmp_path / "drop"), [F.col("k"), F.col("t")], "k", 4)
    files = sorted(spark.read.text(out).inputFiles())
    got = [[r[0].split("\t") for r in spark.read.text(f).collect()] for f in files]
    keys = [int(k or -1) for part in got for k, _ in part]
    assert len(files) == 4 and keys == sorted(keys) and min(map(len, got)) > 1000
    assert sorted((int(k) if k else None, t) for part in got for k, t in part if k) == sorted((k, t.replace("\t", " ")) for k, t in rows if k is not None)
    assert got[0][0] == ["", "first"] and not list((tmp_path / "drop").glob("file=*"))
