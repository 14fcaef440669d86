"""Readers and loaders on hand-made files (FIXTURES.md §3: A1, A3, A6/A7, A10, A11, A12)."""

import gzip
import os
import tempfile


from murmur.operators import ingest as ig
from murmur.operators.lexicon import lexicon_from_csv
from murmur.params import Params
from murmur.sources import files as fl


def _write(path, text, gz=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if gz:
        with gzip.open(path, "wt", encoding="utf-8") as f:
            f.write(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def test_a1_tsv_rules_and_gzip(spark):
    d = tempfile.mkdtemp(prefix="murmur-a1-")
    body = ("rus\t1\tnick\tip\t2024-01-01 10:00:00\tgood \"quoted\" text\n"
            "lat\t2\tnick\tip\n"                                   # short: padded
            "lat\t3\tn\tip\tts\ttext\textra\n"                     # long: skipped
            "\n"                                                   # blank: skipped
            "lat\t4\tn\tip\tts\t\n")                               # empty text → NULL
    _write(f"{d}/c_2024.txt", body)
    _write(f"{d}/gz/c_2024.txt.gz", body, gz=True)
    for path in (f"{d}/c_2024.txt", f"{d}/gz/c_2024.txt.gz"):
        rows = fl.valid_rows(fl.read_tsv(spark, path, fl.COMMENT_COLUMNS)).orderBy("row_pos").collect()
        assert [r.article_id for r in rows] == [1, 2, 4]
        assert rows[0].comment_text == 'good "quoted" text'
        assert rows[1].timestamp is None and rows[1].comment_text is None
        assert rows[2].comment_text is None


def test_a5_dense_ids_follow_file_and_line_order(spark):
    d = tempfile.mkdtemp(prefix="murmur-a5-")
    _write(f"{d}/a.txt", "".join(f"lat\t{i}\tn\tip\tts\tt{i}\n" for i in range(5)))
    _write(f"{d}/b.txt", "".join(f"rus\t{i}\tn\tip\tts\tt{i}\n" for i in range(10, 13)))
    parsed = fl.valid_rows(fl.read_tsv(spark, d, fl.COMMENT_COLUMNS))
    existing = spark.createDataFrame([(7,), (41,)], "id long")
    out = ig.load_comments(parsed, "delfi", Params(), existing).orderBy("id").collect()
    assert [r.id for r in out] == list(range(42, 50))
    assert [r.article_id for r in out] == [0, 1, 2, 3, 4, 10, 11, 12]
    assert {r.website for r in out} == {"delfi"}
    assert [r.comment_lang for r in out][-1] == "ru"


def test_a3_file_selection(spark):
    d = tempfile.mkdtemp(prefix="murmur-a3-")
    names = ["c_2019.txt", "c_2024.csv", "c_2024.txt.gz", "done_2023.txt", "failed_2023.txt", "meta/x_2022.txt",
             "a_meta_2021.txt"]
    for n in names:
        _write(f"{d}/{n}", "x\n")
    listing = fl.list_files(spark, d)
    log = spark.createDataFrame([("done_2023.txt", "Success"), ("failed_2023.txt", "Failed")],
                                "file_name string, status string")
    got = {r.file_name: r.kind for r in fl.select_import_files(listing, log, Params()).collect()}
    assert got == {"c_2024.txt.gz": "comment", "failed_2023.txt": "comment", "x_2022.txt": "article",
                   "a_meta_2021.txt": "article"}


def test_a6_a7_first_row_wins_and_existing_wins(spark):
    d = tempfile.mkdtemp(prefix="murmur-a6-")
    _write(f"{d}/meta_2024.txt", "lat\t5\tfirst\tts\thttps://delfi.lv/5\n"
                                 "lat\t6\tsix\tts\thttps://delfi.lv/6\n"
                                 "lat\t5\tsecond\tts\thttps://delfi.lv/5\n")
    parsed = fl.valid_rows(fl.read_tsv(spark, d, fl.ARTICLE_COLUMNS))
    arts = ig.load_articles(parsed, "delfi", Params())
    got = {r.article_id: r.headline for r in arts.collect()}
    assert got == {5: "first", 6: "six"}
    target = spark.createDataFrame([(6, "old")], "article_id long, headline string")
    from murmur.operators.lookups import insert_if_absent
    assert [r.article_id for r in insert_if_absent(arts, target).collect()] == [5]


def test_a8_import_log(spark):
    d = tempfile.mkdtemp(prefix="murmur-a8-")
    _write(f"{d}/c_2024.txt", "lat\t1\tn\tip\tts\tt\nlat\t2\tn\tip\tts\tt\tbad\n")
    _write(f"{d}/narrow_2024.txt", "lat\t1\ttext\nlat\t2\tn\tip\tts\tt\n")
    _write(f"{d}/empty_2024.txt", "")
    parsed = fl.read_tsv(spark, d, fl.COMMENT_COLUMNS)
    log = ig.import_log(fl.list_files(spark, d), parsed, len(fl.COMMENT_COLUMNS), "tvnet")
    rows = {r.file_name: r for r in log.collect()}
    assert {k: r.status for k, r in rows.items()} == {"c_2024.txt": "Success", "narrow_2024.txt": "Failed", "empty_2024.txt": "Failed"}
    assert "1 skipped" in rows["c_2024.txt"].notes and "file has 3" in rows["narrow_2024.txt"].notes
    assert [r.article_id for r in ig.loadable(parsed, log).collect()] == [1]
    again = fl.select_import_files(fl.list_files(spark, d), log.select("file_name", "status"), Params())
    assert sorted(r.file_name for r in again.collect()) == ["empty_2024.txt", "narrow_2024.txt"]


def test_a10_lexicon_csv(spark):
    d = tempfile.mkdtemp(prefix="murmur-a10-")
    cats = ",".join(("DISKRIM", "LAMUV", "NETAISN", "AICIN", "DARB", "PERS", "ASOC", "MILIT", "NOSOD", "EMOC",
                     "NODEV"))
    _write(f"{d}/lex.csv", f"word,weight,{cats}\nmuļķis,0.75,1,0,0,0,0,0,0,0,0,0,0\nдурак,1.5,0,1,0,0,0,0,0,0,0,0,1\n")
    rows = {r.word: r for r in lexicon_from_csv(fl.read_lexicon_csv(spark, f"{d}/lex.csv")).collect()}
    assert rows["muļķis"].language == "lv" and rows["дурак"].language == "ru"
    assert rows["muļķis"].category_diskrim is True and rows["muļķis"].category_lamuv is False
    assert rows["дурак"].category_nodev is True and rows["дурак"].frequency == 0
    assert rows["дурак"].weight == 1.5


def test_a11_html_table_rows(spark):
    cells = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    flags = ["<img src=x>"] + [""] * 10
    html = ("<html><table id=\"data_table\"><thead><tr><th>h</th></tr></thead><tbody>"
            + cells("1.", "<a href='/w'>muļķis</a>", "p", "1 234", "0,75", *flags)
            + cells("2.", "<a>x</a>", "p", "5", "1", *[""] * 10)                  # 15 cells
            + cells("x.", "<a>y</a>", "p", "5", "1", *flags)                         # rank not numeric
            + cells("3.", "no link", "p", "5", "1", *flags)                          # no link
            + cells("4.", "<a>ok</a>", "p", "1,200", "2", *([""] * 10 + ["<IMG src=y>"]))
            + "</tbody></table></html>")
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = fl.html_lexicon_rows(pages).orderBy("rank").collect()
    assert [(r.rank, r.word, r.frequency, r.weight) for r in rows] == [(1, "muļķis", 1234, 0.75), (4, "ok", 1200, 2.0)]
    assert rows[0].DISKRIM == 1 and rows[0].NODEV == 0 and rows[1].NODEV == 1


def test_a12_stopwords(spark):
    d = tempfile.mkdtemp(prefix="murmur-a12-")
    _write(f"{d}/lv.txt", "ar\nvien\n ar \n\n")
    got = fl.read_stopwords(spark, {"lv": f"{d}/lv.txt", "ru": f"{d}/missing.txt"})
    assert sorted((r.language, r.word) for r in got.collect()) == [("lv", "ar"), ("lv", "vien")]


def test_a1_bad_numeric_field_becomes_null_not_an_error(spark):
    d = tempfile.mkdtemp(prefix="murmur-a1b-")
    _write(f"{d}/c_2024.txt", "lat\tnot-a-number\tn\tip\tts\ttext\nlat\t7\tn\tip\tts\ttext\n")
    rows = fl.valid_rows(fl.read_tsv(spark, d, fl.COMMENT_COLUMNS)).orderBy("row_pos").collect()
    assert [r.article_id for r in rows] == [None, 7]


def test_html_rows_with_line_breaks_quotes_and_references(spark):
    cells = lambda rank, word, weight: (f"<td>\n {rank}. \n</td><td><a href='x'>\n{word} </a></td><td>p</td><td>1&nbsp;234</td><td>{weight}</td>"
                                        + "<td><img src=x></td>" + "<td></td>" * 10)
    page = f"<table class=a id='data_table'><tbody><tr>{cells(1, 'v&#257;rds &amp; x&#x41;', '0,5')}</tr><tr>{cells('no', 'q', '1')}</tr></tbody></table>"
    rows = fl.html_lexicon_rows(spark.createDataFrame([(page,)], "html string")).collect()
    assert [(r["rank"], r["word"], r["frequency"], r["weight"], r["DISKRIM"], r["LAMUV"]) for r in rows] == [(1, "vārds & xA", 1234, 0.5, 1, 0)]


def test_stopwords_by_a_path_without_a_scheme(spark, tmp_path):
    (tmp_path / "lv.txt").write_text("un\n un \n\nir\n", encoding="utf-8")
    got = fl.read_stopwords(spark, {"lv": str(tmp_path / "lv.txt"), "ru": str(tmp_path / "none.txt")})
    assert sorted((r.language, r.word) for r in got.collect()) == [("lv", "ir"), ("lv", "un")]


def test_rewriting_a_day_leaves_the_other_days(spark, tmp_path):
    import datetime as dt
    from murmur.sinks import read_rollup, write_rollup
    schema = "date date, language string, website string, n long"
    days = [(dt.date(2024, 1, k), lang, "all", k) for k in (1, 2, 3) for lang in ("lv", "ru")] + [(dt.date(2024, 2, 1), "lv", "all", 9)]
    write_rollup(spark.createDataFrame(days, schema), str(tmp_path / "r"))
    write_rollup(spark.createDataFrame([(dt.date(2024, 1, 2), "lv", "all", 200), (dt.date(2024, 1, 2), "lv", "site", 7)], schema), str(tmp_path / "r"))
    got = sorted((r.date.isoformat(), r.language, r.website, r.n) for r in read_rollup(spark, str(tmp_path / "r")).collect())
    want = sorted([(d.isoformat(), lang, w, n) for d, lang, w, n in days if (d, lang) != (dt.date(2024, 1, 2), "lv")]
                  + [("2024-01-02", "lv", "all", 200), ("2024-01-02", "lv", "site", 7)])
    assert got == want


def test_no_private_folder_on_a_cluster():
    import pytest
    from murmur.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *a: None)
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session)


def test_a5_keeps_every_row_when_the_split_size_changes(spark):
    """The plan is made under one way of splitting the files and run under another."""
    d = tempfile.mkdtemp(prefix="murmur-a5-split-")
    for f in range(2):
        _write(f"{d}/f{f}.txt", "".join(f"lat\t{f * 20000 + i}\tnick\tip\tts\tline {i} {'x' * 60}\n" for i in range(20000)))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism")
    old = {n: spark.conf.get(n, None) for n in names}
    try:
        parsed = fl.valid_rows(fl.read_tsv(spark, d, fl.COMMENT_COLUMNS))
        out = ig.load_comments(parsed, "delfi", Params(), 100)
        spark.conf.set(names[0], "300k")
        spark.conf.set(names[1], "9")
        got = out.select("id", "article_id").orderBy("id").collect()
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    assert [r.id for r in got] == list(range(101, 40101)) and [r.article_id for r in got] == list(range(40000))
