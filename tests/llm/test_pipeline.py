import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from fxspark.llm import mixing, private_data
from fxspark.llm.common import stored
from tests.llm.conftest import DOCS, PROSE, rows
from tests.llm.test_ngram_join import brute
from tests.llm.test_private_data import corpus
from tests.llm.test_quality_rules import brute as measures


def test_stages_against_brute_force(spark, tmp_path):
    data = [*rows(), *((100 + i, t.replace("mill", f"mill{i} of {i * i} years"), lang, f"s{i % 4}", None) for i, t, lang, *_ in corpus(60)), (200, PROSE.upper(), "en", "s1", 1)]
    spark.createDataFrame(data, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), "test-stage")
        seen[name] = docs.collect()
        assert name == "slack_packing" or docs.columns == [f.name for f in DOCS]
    good = [r for r in data if measures(r[1])[0] >= 20 and 100 * measures(r[1])[4] <= 30 * measures(r[1])[0] and sum(c.isupper() for c in r[1]) * 2 <= measures(r[1])[1]]
    assert sorted((r.doc_id or -1, r.text) for r in seen["quality_rules"]) == sorted((r[0] or -1, r[1]) for r in good)
    parts = {(d, c) for d, _, c in brute([r[:2] for r in good])}
    assert sorted(r.doc_id or -1 for r in seen["ngram_join"]) == sorted({d for d, c in parts if d == c})
    before = {r.doc_id: r.text for r in seen["ngram_join"]}
    for r in seen["private_data"]:
        assert not private_data.base(r.text) and (r.text == before[r.doc_id]) == (not private_data.base(before[r.doc_id]))
    frame = spark.createDataFrame(seen["private_data"], DOCS)
    taken = sum(x.taken for x in mixing.mix(frame, frame["doc_id"], mixing.words(frame["text"])).collect())
    assert abs(sum(len(r.text.split()) for r in seen["sainte_lague_mix"]) - taken) <= 0
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["sainte_lague_mix"])
    assert sum(r.length for r in seen["slack_packing"]) == n
    assert sorted(map(tuple, cp.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()), key=str) == sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in seen["slack_packing"]), key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
