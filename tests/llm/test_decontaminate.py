import random
import re
from hashlib import sha256

from foliospark.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, w=13):
    d, hit, found = words(text), set(), set()
    for name, item in items:
        x = words(item)
        n = min(w, len(x))
        for i in range(len(x) - n + 1) if n else []:
            for j in range(len(d) - n + 1):
                if d[j : j + n] == x[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(name)
    return len(d), sorted(hit), sorted(str(f) for f in found if f is not None)


def cases():
    rng = random.Random(4)
    vocab = ["a", "B", "c", "dé", "e1"]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, line(rng.randrange(1, 40))) for i in range(12)] + [(90, None), (91, ""), (None, "zz yy"), (5, "one two three"), (5, "one two three")]
    docs = [(i, line(rng.randrange(0, 60))) for i in range(20)]
    docs += [(100, None), (101, ""), (102, "-- !"), (103, "x zz, YY x"), (104, items[3][1]), (104, items[3][1]), (None, "One.two three"), (105, line(5000))]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = cases()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, overlap int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (D.BLOCK_WORDS, 60):
        monkeypatch.setattr(D, "BLOCK_WORDS", block)
        got = {(r["doc_id"], r["text"]): r["overlap"] for r in D.overlaps(frame, benchmark).collect()}
        for i, t in docs:
            n, hit, names = brute(t, items)
            o = got[i, t]
            assert (o["n_words"], sorted({p for s in o["spans"] for p in range(s["start"], s["end"])}), o["item_ids"]) == (n, hit, names)
            assert sha256(",".join(names).encode()).hexdigest()


def test_contaminated_documents_go_and_others_stay(spark):
    item = " ".join(f"w{i}" for i in range(20))
    clean = " ".join(f"c{i}" for i in range(400))
    docs = spark.createDataFrame([(1, f"{item} and more"), (2, clean), (3, f"{clean} {item}"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, items).collect()}
    assert kept == {2: clean, 3: f"{clean} {item}", 4: None}
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, items, cut=True).collect()}
    assert cut[2] == clean and cut[3] == f"{clean} "


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.overlaps(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.overlaps(docs, items).collect()[0]["overlap"]["spans"] == []
