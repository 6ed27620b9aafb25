import random
import re

import numpy as np

from foliospark.llm import neardup as N


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(docs, size):
    sets = {d: shingles(t, size) for d, t in docs}
    lead = {d: d for d in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                lead[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 120)))) for i in range(40)]
    for i in range(60):
        words = docs[rng.randrange(40)][1].split()
        for _ in range(rng.randrange(0, max(1, len(words) // 8) + 1)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append((100 + i, " ".join(words).upper()))
    docs += [(300, None), (301, ""), (302, " \n"), (303, "alone"), (304, "ALONE"), (305, "two words"), (306, "z " * 20000), (307, "z " * 300)]
    rng.shuffle(docs)
    return docs


def test_against_brute_force(spark, monkeypatch):
    docs = corpus()
    frame = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, n int, name string")
    for size, grid in ((2, 2048), (5, 3)):
        monkeypatch.setattr(N, "GRID", grid)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.classes(frame, size=size).collect()}
        assert got == brute(docs, size)
    kept = {r["doc_id"] for r in N.dedup(frame).collect()}
    assert kept == {d for d, (_, c) in brute(docs, 5).items() if d == c}


def test_copies_of_an_absent_original(spark):
    rng = random.Random(9)
    base = [f"t{i}" for i in range(200)]
    docs = []
    for i in range(80):
        words = list(base)
        for _ in range(rng.randrange(4, 14)):
            words[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.classes(spark.createDataFrame(docs, "doc_id long, text string"), size=2).collect()}
    assert got == brute(docs, 2)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.8, 0.9, 0.97):
        x = rng.integers(0, 1 << 63, 3000, np.uint64)
        n = int(2 * share / (1 + share) * len(x))
        y = np.concatenate([x[:n], rng.integers(0, 1 << 63, len(x) - n, np.uint64)])
        a, b = (np.frombuffer(N.odd_sketch(N.minima(np.unique(v))), np.uint64) for v in (x, y))
        assert abs(N.estimate(int(np.bitwise_count(a ^ b).sum())) - share) < 0.07
        both = [np.frombuffer(N.odd_sketch(N.minima(np.unique(v))) + N.whole_sketch(np.unique(v)), np.uint64)[None] for v in (x, y)]
        assert N.agree(*both, np.array([6000.0]), 0.8).all()


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == 90 and got[95] == 90


def brute_rows(rows, size):
    """n_shingles and component of rows whose ids may be null or repeated."""
    sets = [shingles(t, size) for _, t in rows]
    lead = list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            n = len(sets[i] & sets[j])
            near = 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)
            if sets[i] and sets[j] and (near or rows[i][0] is not None and rows[i][0] == rows[j][0]):
                lead[find(j)] = find(i)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((str(d), len(sets[i]), min(ids, default=None) if sets[i] else d))
    return sorted(out, key=str)


def test_rows_without_ids_and_with_repeated_ids(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocab, k=40)) for _ in range(12)]
    rows = [(5, texts[0]), (5, texts[1]), (2, texts[1]), (9, texts[0] + " tail"), (None, texts[2]), (None, texts[3]), (None, texts[3]), (7, texts[3]), (8, None), (8, texts[4]), (6, texts[4]), (3, texts[5]), (3, texts[5]), (None, None), (None, "")]
    rows += [(rng.choice([None, *range(20, 26)]), rng.choice(texts[6:])) for _ in range(20)]
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_rows(rows, 2)


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in N.classes(docs).collect())
    assert got == [("1", 1), ("1", 1), ("2", 2), ("None", 1)]
    assert N.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
