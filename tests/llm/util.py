"""Small frames for the operator tests."""

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows, schema=DOC_SCHEMA):
    return spark.createDataFrame(rows, schema)
