import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def passage(n, start=0):
    return " ".join(f"w{start + i}" for i in range(n))


ODD_TEXTS = [
    None, "", "   \n\t ", "one", "one two", "one two", passage(60), passage(60), passage(49), "head " + passage(60) + " tail",
    passage(55, 5) + " " + passage(3, 900), "a b c " * 40, "line of four words\n" * 30, "ÄÖ ß\u00a0x \u2003 y 日本 🎉 'll it's 12 ３",
    "tab\tand\x1cnot space\x85", passage(20_000, 50_000), "The The THE the", "#$%& <| *** " * 20, passage(50, 5),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, short, repeated, overlapping and long texts; two rows of one id, one without id; clashing extra columns."""
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, None) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[6], (None, passage(60), None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOC)
    for name in ("hash", "node", "count", "kept", "component", "start", "stop", "size", "block", "target", "score", "key"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
