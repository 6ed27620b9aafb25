import random

import numpy as np

from foliospark.llm import toxicity as X


def corpus(n=600):
    rng = random.Random(7)
    plain = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(5, 60))
        bad = rng.random() < 0.3
        if bad:
            words += ["idiot" + rng.choice(["", "s", "ic"]), "scum"][: rng.randrange(1, 3)]
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, toxicity int")
    known = spark.createDataFrame([*labels, (10**6, 1), (3, None), (labels[0][0], 7)], "doc_id long, toxic int")
    model = X.fit(frame.where(~X.held_out()), known.where(~X.held_out()))
    got = {r["doc_id"]: r["toxicity"] for r in X.score(frame.where(X.held_out()), model).collect()}
    truth = dict(labels)
    assert sum((s >= 0.5) == bool(truth[d]) for d, s in got.items()) >= 0.95 * len(got)


def test_pairs_count_for_more_than_their_parts():
    """An insult is toxic with a group's name only, which weights of single terms can't tell."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(2) < 0.5) for _ in range(2000)]
    y = np.array([float(len(x) == 2) for x in rows])
    model = X._train([x.astype(np.int64) for x in rows], y, {1: 0, 2: 1})
    v = model.vectors
    assert float((v[0] * v[1]).sum()) > 0.5
    p = model.score([np.array([0]), np.array([1]), np.array([0, 1]), np.array([], np.int64)])
    assert p[2] > 0.9 and max(p[0], p[1], p[3]) < 0.2


def test_one_class_nulls_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, ""), (1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r["toxicity"] for r in X.score(docs, X.fit(docs, labels)).collect()} == {0.0}
    assert X.score(docs.limit(0), X.fit(docs.limit(0), labels.limit(0))).count() == 0
    d, lab = corpus(80)
    model = X.fit(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, toxic int"))
    assert all(0 <= r["toxicity"] <= 1 for r in X.score(docs, model).collect())
