"""Small tables with every awkward case, shared by the tests of this folder."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Columns whose names the operators make themselves.
CLASHING = ["size", "target", "copies", "taken", "score", "n", "bits", "_key", "_text", "number", "word", "ids", "row"]
LONG = "the thing and other things of the sea " * 30_000  # over a megabyte


def rows():
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, ties, repeated rows."""
    plain = [(i, f"the thing number {i % 7} and the sea of it", "en", f"s{i % 3}", 10) for i in range(40)]
    other = [(100 + i, f"der die das und {i % 5} nicht über groß", "de", "s1", 10) for i in range(40)]
    odd = [
        (200, None, None, None, None), (201, "", "en", "s0", 0), (202, " \t\n", None, "s0", 3), (203, LONG, "en", None, len(LONG)),
        (None, "the sea and the thing", "en", "s2", 5), (None, "the sea and the thing", "en", "s2", 5),
        (204, "12 34 !!", "en", "s0", 8), (205, "x\u00a0y\u0085z \u00c9T\u00c9 \u03a3\u0391\u03a3 \U0001F600", "en", "", 3),
        (206, "the thing number 1 and the sea of it", "en", "s0", 10), (206, "the thing number 1 and the sea of it", "en", "s0", 10),
        (207, "a" * 70_000, "en", "s0", 70_000),
    ]
    return plain + other + odd


def documents(spark, content=None, extra=True):
    df = spark.createDataFrame(rows() if content is None else content, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    return df
