from foliospark.llm import bpe
from foliospark.llm import words as W

TEXTS = [None, "", " ", "a", "it's  2 words\n\n\tand 'S", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "漢字 𠮷 é‍ ﷽ ՙ", "word " * 3000, "a\x00b\x85\xa0 c", "it's  2 words\n\n\tand 'S"]


def test_equals_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(W, "BLOCK_BYTES", 300)
    path = bpe.default_tokenizer()
    t = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i if i else None, x, i) for i, x in enumerate(TEXTS)], "doc_id long, text string, ids int")
    got = sorted(((r["doc_id"] or 0), list(r["ids"]), r["decoded"]) for r in bpe.encode(docs.repartition(3), path).collect())
    want = []
    for i, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, ids, t.decode(ids, skip_special_tokens=False)))
    assert got == want
    assert all(d == (x or "") for (_, _, d), x in zip(want, TEXTS, strict=True))


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), bpe.default_tokenizer()).count() == 0


def test_packed_documents_round_trip():
    import numpy as np

    docs = [(1, 0, np.array([0, 3, 300, 70000, 0]), np.array([0.5, 7])), (None, 1, np.array([], int), np.array([-1.5, 8])), (-5, 1, np.array([0, 0, 1]), np.array([0, 9.0]))]
    out = list(W.unpack_docs(W.pack_docs(docs), 900, 2))
    assert [(i, f) for i, f, _, _ in out] == [(1, 0), (None, 1), (-5, 1)]
    assert [e.tolist() for *_, e in out] == [[0.5, 7], [-1.5, 8], [0, 9]]
    assert [x.tolist() for _, _, x, _ in out] == [[902, 2, 299, 69999, 903], [], [904, 905, 0]]
