import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

PROSE = ("the river carries slow water past the old mill where nobody grinds corn now and the wheel stands still "
         "while children throw stones from the bridge and count the rings until the evening bell calls them home")


def long_text(words: int) -> str:
    return " ".join(f"w{i * 7919 % 100_003}" for i in range(words))


def rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, repeated rows."""
    texts = {
        1: PROSE, 2: PROSE, 3: PROSE.replace("bridge", "pier"), 4: None, 5: "", 6: "one two three", 7: "One TWO three", 8: " \n\t ",
        9: long_text(3000), 10: long_text(3000) + " tail of its own", 11: long_text(900)[::-1], 12: "x", 13: "same line here again\n" * 12,
        14: "ÉTÉ naïve 雪 " * 40, 15: "mail bob@site.org or +1 (269) 555-3296 4524132264652876 from 10.0.0.7 now",
    }
    out = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in texts.items()]
    return [*out, out[0], out[3], (None, PROSE + " and more words", None, None, None), (16, "tie " * 30, "en", None, 120)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clash(docs):
    """Extra columns named like those that the operators make on the way."""
    from pyspark.sql import functions as F

    names = ["w", "wh", "lines", "failed", "size", "target", "row", "shard", "number", "range", "tie", "head", "set", "label", "bucket", "block", "kind", "score",
             "held_out", "spans", "copies", "kept_id", "text_hash", "passes", "cuts", "part", "place", "length", "start"]
    return docs.withColumns({c: F.lit("z") for c in names})
