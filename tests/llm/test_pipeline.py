"""Each stage of the pipeline on its own input, against brute-force versions."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from appfacts.llm import toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) of every stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs, after
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert name == "pieces" or after.columns == before.columns


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    scored = toxicity.score_documents(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert rows(after).keys() == {r.doc_id for r in scored.where("predicted = 0").collect()}
    assert all(rows(before)[d] == r for d, r in rows(after).items())


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    want = brute.jaccard([(d, r.text) for d, r in rows(before).items()])
    assert rows(after).keys() == {d for d, (_, c) in want.items() if c == d}


def test_repeated_bytes(stages):
    before, after = stages["repeated_bytes"]
    want = brute.repeats([(d, r.text) for d, r in rows(before).items()], 100)
    got = rows(after)
    assert {d: r.text for d, r in got.items()} == {d: v[4] for d, v in want.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 5]) for _, t in items for w in [brute.ALNUM.findall(t.translate(brute.LOWER))] for i in range(len(w) - 4)}
    # Brute force only where a text has a shingle of an item; no other can be similar.
    near = []
    for d, r in rows(before).items():
        w = brute.ALNUM.findall(r.text.translate(brute.LOWER))
        if any(tuple(w[i : i + 5]) in grams for i in range(len(w) - 4)):
            near.append((d, r.text))
    leaks = {d for d, _ in brute.item_windows(near, items)}
    assert rows(after).keys() == rows(before).keys() - leaks


def test_pieces(stages):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.tokenizer_path("piece_bpe_32k.model"))
    before, after = stages["pieces"]
    got = rows(after)
    for d, r in rows(before).items():
        ids = sp.encode(r.text)
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_equals_stages(spark, stages):
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages["pieces"][1])


def test_stages_on_hand_made_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, an extra column, and an empty table pass through all stages."""
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string"
    made = [(1, None, None, None, None, None), (2, "", "en", "s", 0, "k"), (3, "some plain words " * 20, "en", "s", 1, "k")]
    docs = spark.createDataFrame([*made, made[2], (None, "other words stand here", "en", "s", 3, "k")], columns)
    for table, least in ((docs, 4), (docs.where("false"), 0)):
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, table, SF).write.parquet(f"{tmp_path}/{least}/{n}")
            table = spark.read.parquet(f"{tmp_path}/{least}/{n}")
            assert name == "pieces" or table.columns == docs.columns
        assert table.select(F.countDistinct("ids_sha256")).first() is not None and table.count() >= least - 1
