import random

from pyspark.sql import functions as F

from foliospark.llm import lines as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        match rng.randrange(3):
            case 0:
                s[i] = rng.choice("abé")
            case 1:
                s.insert(i, rng.choice("abé"))
            case _:
                del s[i]
    return "".join(s)


def brute(docs, floor=1):
    occ = [((d is None, d or 0, n), i, n, x) for i, (d, t) in enumerate(docs) if t is not None for n, raw in enumerate(t.split("\n")) if len(x := raw.strip(L.SPACE)) >= floor]
    first = {}
    for at, _, _, x in occ:
        first[x] = min(first.get(x, at), at)
    gone = [[] for _ in docs]
    for at, i, n, x in occ:
        if at != first[x] or len(x) >= L.LEAST and any(len(y) >= L.LEAST and at2 < first[x] and abs(len(y) - len(x)) <= 2 and distance(x, y) <= 2 for y, at2 in first.items()):
            gone[i].append(n)
    return gone


def corpus():
    rng = random.Random(8)
    base = ["".join(rng.choices("ab é", k=rng.randrange(18, 60))) for _ in range(25)]
    docs = []
    for d in range(40):
        rows = [edited(rng, rng.choice(base), rng.randrange(4)) if rng.random() < 0.7 else rng.choice(base) for _ in range(rng.randrange(1, 6))]
        docs.append((d, "\n".join([*rows, " short", ""])))
    return [*docs, (100, None), (101, ""), (102, "x" * 9000), (103, "x" * 4500 + "y" + "x" * 4500), (None, docs[3][1])]


def test_against_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, i, "other") for i, d in enumerate(docs)], "doc_id long, text string, removed_lines int, th string").drop("removed_lines").withColumn("no", F.lit(1))
    got = {(r["doc_id"], r["text"]): list(r["removed_lines"]) for r in L.mark(frame).collect()}
    for (d, t), want in zip(docs, brute(docs), strict=True):
        assert got[d, t] == want, (d, t)
    got = {(r["doc_id"], r["text"]): list(r["removed_lines"]) for r in L.mark(frame, floor=L.LEAST).collect()}
    for (d, t), want in zip(docs, brute(docs, L.LEAST), strict=True):
        assert got[d, t] == want, (d, t)
    assert L.mark(frame).columns == ["doc_id", "text", "th", "no", "removed_lines"]


def test_crowded_segments_lose_no_pair(spark, monkeypatch):
    rng = random.Random(2)
    stem = "the same beginning of every line of this group, "
    docs = [(i, stem + "".join(rng.choices("abcde", k=30))) for i in range(40)]
    docs += [(100 + i, edited(rng, docs[i][1], 2)) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: list(r["removed_lines"]) for r in L.mark(frame).collect()}
    assert got == {d: g for (d, _), g in zip(docs, brute(docs), strict=True)}


def test_texts_without_repeats_stay(spark):
    docs = spark.createDataFrame([(1, " one line that stands alone here \n\n x"), (2, "boilerplate line of the corpus\nown words of the second one"), (3, "boilerplate line of the corpus\nwholly different content, number three")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.dedup(docs).collect()}
    assert got == {1: " one line that stands alone here \n\n x", 2: "boilerplate line of the corpus\nown words of the second one", 3: "wholly different content, number three"}


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a line that is long enough to count")] * 2, "doc_id long, text string")
    assert [list(r["removed_lines"]) for r in L.mark(docs).collect()] == [[], []]
    assert L.mark(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_distance(spark):
    rng = random.Random(6)
    pairs = [(a := "".join(rng.choices("ab", k=rng.randrange(0, 9))), "".join(rng.choices("ab", k=rng.randrange(0, 9))) if rng.random() < 0.5 else edited(rng, a or "a", 1)) for _ in range(300)]
    chars = spark.createDataFrame([(a, b, list(a), list(b)) for a, b in pairs], "a string, b string, x array<string>, y array<string>")
    for a, b, near in chars.select("a", "b", L.within(F.col("x"), F.col("y"), 2)).collect():
        assert near == (distance(a, b) <= 2), (a, b)
