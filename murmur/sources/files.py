"""File readers: TSV drops (A1, A2), drop-folder listing (A3, A4, A9), lexicon
CSV (A10), lexicon tables in HTML pages (A11), stop-word lists (A12).
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.lexicon import CATEGORIES
from murmur.params import Params
from murmur.session import path_exists

# Column order of the header-less drop files.
COMMENT_COLUMNS = ("region", "article_id", "user_nickname", "encoded_ip", "timestamp", "comment_text")
ARTICLE_COLUMNS = ("region", "article_id", "headline", "pub_timestamp", "url")
LONG_COLUMNS = ("article_id",)


def read_tsv(spark: SparkSession, paths, columns, long_columns=LONG_COLUMNS) -> DataFrame:
    """A1/A2: header-less TSV, plain or gzip, no quoting.

    Lines with more fields than ``columns`` are dropped (T1), shorter ones are
    padded with NULL, empty lines are skipped.  ``_n`` is the number of fields,
    ``_valid`` false for a line that is too long.  Each row keeps its file and a
    file-order key (split start, position in the split) so that "first row
    in the file" and dense ids can be computed without a per-file window.
    """
    raw = (spark.read.text(paths)
           .select("value", F.col("_metadata.file_path").alias("file_path"),
                   F.col("_metadata.file_block_start").alias("block_start"),
                   F.monotonically_increasing_id().alias("row_pos")))
    raw = raw.where(F.col("value") != "")
    parts = F.split(F.col("value"), "\t", -1)
    n = len(columns)
    cols = []
    for i, c in enumerate(columns):
        v = F.element_at(parts, i + 1) if i else parts[0]
        v = F.when(F.size(parts) > i, v)
        v = F.when(v == "", F.lit(None).cast("string")).otherwise(v)
        cols.append((v.try_cast("long") if c in long_columns else v).alias(c))
    return (raw.withColumn("_n", F.size(parts))
            .select(*cols, "file_path", "block_start", "row_pos", "_n")
            .withColumn("_valid", F.col("_n") <= n))


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where("_valid").drop("_valid", "_n")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Listing of a drop folder (paths and sizes only; file contents are not read).

    Spark's scan leaves out files of length 0; they are added from the file
    index the driver holds in any case.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = files.select("path", "length", "modificationTime")
    names = files.inputFiles()
    if len(names) == listed.count():
        return listed
    bare = lambda p: re.sub("^file:/+", "/", unquote(p))
    seen = {bare(r.path) for r in listed.select("path").collect()}
    empty = [F.struct(F.lit(re.sub("^file:/+", "file:/", unquote(p))).alias("path")) for p in names if bare(p) not in seen]
    rows = spark.range(1).select(F.inline(F.array(*empty)))
    return listed.unionByName(rows.select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime")))


def select_import_files(listing: DataFrame, log: DataFrame | None, params: Params, root: str = "",
                        year_in: str = "name") -> DataFrame:
    """``.txt``/``.txt.gz`` files whose name holds a listed year and that no
    Success row of the log names; routed by ``meta`` anywhere in the full path.

    ``year_in='path'`` looks for the year in the path below ``root`` (Spark
    writers pick the file names, so derived drops keep the year in a folder).
    """
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    where = name if year_in == "name" else F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    years = "(" + "|".join(params.years) + ")"
    out = (listing.withColumn("file_name", name)
           .where((name.endswith(".txt") | name.endswith(".txt.gz")) & where.rlike(years)))
    if log is not None:
        done = log.where(F.col("status") == "Success").select("file_name").distinct()
        out = out.join(done, "file_name", "left_anti")
    return out.withColumn("kind", F.when(F.col("path").contains("meta"), F.lit("article"))
                          .otherwise(F.lit("comment")))


def processed_files(log: DataFrame, website: str | None = None) -> DataFrame:
    """Names of files imported with status Success (optionally one site)."""
    d = log.where(F.col("status") == "Success")
    if website:
        d = d.where(F.col("website") == website)
    return d.select("file_name")


def read_lexicon_csv(spark: SparkSession, path: str) -> DataFrame:
    """A10 input: lexicon CSV with a header (word, weight, category columns)."""
    return spark.read.option("header", True).csv(path)


# The lexicon page layout (table id, at least 16 cells a row,
# rank/word/paradigm/frequency/weight then 11 category cells).
HTML_TABLE_ID = "data_table"
HTML_MIN_CELLS = 16
# Character references by name; numeric ones are computed.
HTML_NAMES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}


def _decode_references(c: Column) -> Column:
    """Named and numeric character references of a text; unknown ones stay."""
    names = F.create_map(*[F.lit(x) for kv in HTML_NAMES.items() for x in kv])
    parts = F.split(c, "&", -1)

    def decode(s: Column, i: Column) -> Column:
        name = F.regexp_extract(s, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);", 1)
        rest = F.substring(s, F.length(name) + 2, F.length(s))
        hexed = F.when(name.rlike("^#[xX]"), F.upper(F.substring(name, F.lit(3), F.length(name)))) \
                 .when(name.startswith("#"), F.conv(F.substring(name, F.lit(2), F.length(name)), 10, 16))
        char = F.when(hexed.isNotNull(), F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")) \
                .otherwise(F.try_element_at(names, name))
        return F.when(i == 0, s).when((name != "") & char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), s))
    return F.array_join(F.transform(parts, decode), "")


def _strip_tags(c: Column) -> Column:
    text = _decode_references(F.regexp_replace(c, r"<[^>]*>", ""))
    return F.regexp_replace(F.regexp_replace(text, "\u00a0", " "), r"^\s+|\s+$", "")


def html_lexicon_rows(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Rows of the lexicon table found in HTML pages.

    Rows with fewer than 16 cells, a non-numeric rank or no link in the word
    cell are skipped; frequency drops no-break spaces and commas; weight uses
    a decimal comma; a category flag is set when its cell holds an image.
    """
    table = F.regexp_extract(F.col(html_col),
                             r"(?is)<table[^>]*\bid\s*=\s*[\"']?" + HTML_TABLE_ID + r"\b[\"']?[^>]*>(.*?)</table>", 1)
    body = F.regexp_extract(table, r"(?is)<tbody[^>]*>(.*?)</tbody>", 1)
    rows = pages.select(F.explode(F.regexp_extract_all(body, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("tr"))
    cells = rows.select(F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1).alias("td"))
    cells = cells.where(F.size("td") >= HTML_MIN_CELLS)
    rank = F.regexp_replace(_strip_tags(F.col("td")[0]), r"\.+$", "")
    link = F.regexp_extract(F.col("td")[1], r"(?is)<a[^>]*>(.*?)</a>", 1)
    has_link = F.col("td")[1].rlike(r"(?is)<a[^>]*>.*?</a>")
    freq = F.regexp_replace(_strip_tags(F.col("td")[3]), r"[\s,]", "")
    weight = F.regexp_replace(_strip_tags(F.col("td")[4]), ",", ".")
    out = cells.where(rank.rlike(r"^[0-9]+$") & has_link).select(
        rank.cast("int").alias("rank"), _strip_tags(link).alias("word"),
        _strip_tags(F.col("td")[2]).alias("paradigm"), freq.try_cast("long").alias("frequency"),
        weight.try_cast("double").alias("weight"),
        *[F.col("td")[5 + i].rlike(r"(?i)<img").cast("int").alias(c)
          for i, c in enumerate(CATEGORIES)])
    return out


def read_stopwords(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One word per line per language; trimmed, de-duplicated; a missing file → none.

    Paths are looked up in the file system Spark resolves them to.
    """
    parts = [spark.read.text(path).select(F.lit(lang).alias("language"), F.trim("value").alias("word"))
             for lang, path in paths.items() if path_exists(spark, path)]
    if not parts:
        return spark.createDataFrame([], "language string, word string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("word") != "").distinct()
