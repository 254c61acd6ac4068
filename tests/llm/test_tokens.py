import random

import pytest

from memloom.llm import tokens

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def reference():
    t = tokenizers.Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_same_ids_as_the_library(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aAbB 1\n\t.,!é中😀ßт-=_'s") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    texts += ["a" * k for k in range(1, 60)] + ["ab" * 3000, " " * 5000, "<|endoftext|> x", "don't we'll", "=" * 300, "word " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df, ["doc_id"]).collect()}
    assert [got[k] for k in range(len(texts))] == reference()(texts)


def test_null_empty_repeated_and_clashing(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b", None)], "doc_id bigint, text string, ids string")
    got = sorted((str(r.doc_id), r.ids) for r in tokens.encode_corpus(df, ["doc_id"]).collect())
    assert got == [("1", []), ("2", []), ("2", []), ("None", reference()(["a b"])[0])]
    assert tokens.encode_corpus(df.limit(0), ["doc_id"]).count() == 0
    assert sorted(r.n_tokens for r in tokens.token_counts(df, ["doc_id"]).collect()) == [0, 0, 0, 2]


def test_emptied_memo_changes_nothing(monkeypatch):
    enc = tokens.TrieEncoder(tokens.default_vocabulary())
    words = [["alpha", " beta"], [" gamma"], ["alpha"]]
    full = enc.encode_all(words)[0].tolist()
    monkeypatch.setattr(tokens, "MEMO_WORDS", 0)
    assert enc.encode_all(words)[0].tolist() == full


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"]).collect()}
    assert [got[r.doc_id] for r in rows] == reference()([r.text or "" for r in rows])
