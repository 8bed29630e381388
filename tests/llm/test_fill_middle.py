import hashlib

from pyspark.sql import functions as F

from fxspark.llm import fill_middle as fm
from tests.llm.conftest import rows


def expected(doc_id, text):
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if n == 0 or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b, f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["$1 \\2 $ \\", "<", "a<\nS>b<P", "<P>", "x<M>y", "\r\n\u0085 \n", "😀é雪" * 5000, "\u0000 \u0000", "a\n" * 4096, "ab" * 4096, "b" * 4095, "M>M>M>", "<S<P<M"]


def check(spark, docs, given):
    out = fm.transformed(docs)
    got = out.select("doc_id", "text", "n", "form", "a", "b", "output", fm.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == given
    for r in got:
        assert (r.n, r.form, r.a, r.b, r.output) == expected(r.doc_id, r.text)
        assert r.back == r.text
    return got


def test_rows_equal_plain_python(spark, docs, clash, none):
    seen = check(spark, docs, len(rows()))
    assert sorted(map(str, seen)) == sorted(map(str, check(spark, clash, len(rows()))))
    check(spark, none, 0)


def test_odd_texts_with_many_cuts(spark):
    data = [(i, ODD[i % len(ODD)]) for i in range(40 * len(ODD))]
    got = check(spark, spark.createDataFrame(data, "doc_id long, text string"), len(data))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_very_long_text(spark):
    text = "é雪😀\n" * 300_000
    check(spark, spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), 2)


def test_no_shuffle_and_no_python(spark):
    plan = fm.transformed(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
