"""The pipeline's stages on a small table with null ids, null and empty texts, repeated rows and edited benchmark passages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quaystone.llm import byte_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(6)
VOCAB = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


ITEM, EDITED = prose(60), None
EDITED = " ".join("zz" if i == 30 else w for i, w in enumerate(ITEM.split()))
COPY = prose(80)
SECRET = "AKIA" + "ABCDEFGHIJKLMNOP"
TEXTS = {1: prose(70), 2: None, 3: "", 4: prose(30) + " " + ITEM + " " + prose(30), 5: prose(20) + " " + EDITED + " " + prose(20), 6: COPY, 7: COPY, 8: prose(40) + f" {SECRET} " + prose(40)}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    table(spark, [*TEXTS.items(), (None, prose(50))]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    everything = ids(docs)
    assert ids(corpus_pipeline.drop_toxic(spark, docs, folder)) == everything
    assert ids(corpus_pipeline.drop_near_duplicates(spark, docs, folder)) == [i for i in everything if i != 7]
    assert ids(corpus_pipeline.drop_leaks(spark, docs, folder)) == [i for i in everything if i not in (4, 5)]
    redacted = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, docs, folder).collect()}
    assert "[SECRET]" in redacted[8].text and SECRET not in redacted[8].text and redacted[8].n_chars == len(redacted[8].text)
    assert ids(docs) == sorted(redacted, key=str)
    encoded = {r.doc_id: r.n_tokens for r in corpus_pipeline.encode(spark, docs, folder).collect()}
    assert ids(docs) == sorted(encoded, key=str) and encoded[2] == encoded[3] == 0
    repeated = docs.where("doc_id = 1").union(docs.where("doc_id = 1"))
    assert repeated.count() == 2 and ids(corpus_pipeline.drop_leaks(spark, repeated, folder)) == [1, 1]


def test_run_is_the_stages_in_order(spark, folder):
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(found, key=str) == sorted([None, 1, 2, 3, 6, 8], key=str)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "secrets", "byte bpe"]
    assert all(r.n_tokens == len(r.ids) for r in found.values())
    docs = spark.createDataFrame([(1, TEXTS[1])], "doc_id long, text string")
    assert byte_bpe.encode(docs).select(F.size("ids")).first()[0] == found[1].n_tokens


def test_empty_table(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0
