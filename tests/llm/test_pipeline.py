from hashlib import sha256

from tokenizers import Tokenizer

import corpus_pipeline as C
from foliospark.llm import bpe


def test_stages_over_a_small_corpus(spark, tmp_path):
    item = " ".join(f"bench{i}" for i in range(20))
    line = "a line of boilerplate that stands in several texts"
    own = lambda k: " ".join(f"own{k}x{i}" for i in range(40))
    docs = [(i, f"{own(i)} filler", "en", "s", 0) for i in range(60)]
    docs += [(100, f"{line}\n{own(100)}", "en", "s", 7), (101, f"{own(101)}\n{line}", "en", "s", 7), (102, own(5) + " filler", "en", "s", 0), (103, f"{item} x", "en", "s", 0), (104, None, None, None, None), (105, "", "en", "s", 0)]
    docs += [(200 + i, f"{own(200 + i)} moron scum", "en", "s", 0) for i in range(20)]
    labels = [(d[0], 1, int(d[0] >= 200)) for d in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in C.run(spark, str(tmp_path)).collect()}
    texts = {i: f"{own(i)} filler" for i in range(60)} | {100: f"{line}\n{own(100)}", 101: own(101), 104: "", 105: ""}
    assert set(got) == set(texts)
    t = Tokenizer.from_file(bpe.default_tokenizer())
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert [tuple(r) for r in out.collect()] == [(1, "some text", "en", "s", 9)]
