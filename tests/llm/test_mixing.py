import collections
import math
import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import mixing as M
from foliospark.llm import words as W


def corpus():
    rng = random.Random(1)
    vocab = [f"{rng.choice(['ab', 'cé', 'zu'])}{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocab, weights=range(1, 61), k=rng.randrange(1, 80)))) for i in range(120)]
    return [*docs, (500, None), (501, ""), (502, "Ab0 AB0\tab0\x0b.\x1cx " + "q" * 5000), (503, "unheard"), (None, "ab0"), (7, docs[7][1])]


def test_counts_and_base_scores(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_BYTES", 2000)
    docs = corpus()
    frame = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    got = sorted(((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), r["held_out"], r["score"] < 0 and math.isfinite(r["score"])) for r in M.score(frame).collect()))
    counts = collections.Counter()
    rows = []
    for d, t in docs:
        words = [*(t or "").encode().lower().split(), None]
        held = crc32(str("" if d is None else d).encode()) % 5 == 1
        rows.append((d, words, held))
        if not held:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6), held, True) for d, w, held in rows)
    assert got == want


FULL, U32 = (1 << 64) - 1, (1 << 32) - 1


def context_hashes(s: bytes, i: int) -> list[int]:
    """Of the byte at i of a text, one at a time, from the text alone."""
    last = [(s[i - k] + 1) << 9 * (k - 1) if i >= k else 0 for k in range(1, 6)]
    three = sum(last[:3])
    head = s.rfind(b" ", 0, i) + 1

    def word(a, b):
        x = sum((c + 1) * pow(0x100000001B3, k, 1 << 64) for k, c in enumerate(s[a:b]))
        return (x * 0x9E3779B97F4A7C15 + (b - a)) & FULL

    now, hint, previous = word(head, i), 0, 0
    if head:
        previous = word(s.rfind(b" ", 0, head - 1) + 1, head - 1) + 1
        signs = [k for k in range(head) if s[k] >= 128]
        if signs:
            hint = (s[signs[-1]] + 1) | (s[signs[-1] - 1] + 1) << 9
    out = []
    for k, x in enumerate((three, sum(last), now + (hint + 7) * 0xD6E8FEB86659FD93, now + (previous + 3) * 0xA0761D6478BD642F)):
        x &= FULL
        x = ((x ^ x >> 31) * 0xBF58476D1CE4E5B9 + k) & FULL
        out.append(((x ^ x >> 29) * 0x94D049BB133111EB & FULL) >> 32)
    return out


def coded_bits(s: bytes, model):
    """For each bit: byte, bit, depth, slots."""
    for i, c in enumerate(s):
        pair = (s[i - 1] if i else 32) << 8 | c
        hashes = context_hashes(s, i)
        for at in range(int(model.code.start[pair]), int(model.code.start[pair] + model.code.length[pair])):
            node = int(model.code.nodes[at])
            yield i, int(model.code.bits[at]), int(model.code.depth[at]), [((h + node) & U32) * 0x9E3779B1 % (1 << 32) >> 32 - t for h, t in zip(hashes, model.powers)]


def brute_score(s: bytes, model) -> float:
    """A text's score, a bit at a time."""
    tables, weights, refined = model.pairs.value, model.weights.astype(float).copy(), model.map.astype(float).copy()
    total, moves, seen = 0.0, collections.Counter(), collections.defaultdict(list)
    for n, (i, bit, depth, slots) in enumerate(coded_bits(s, model)):
        if n and i // M.CHUNK != before // M.CHUNK:
            for (k, g), x in moves.items():
                weights[k, g] += x
            for spot, bits in seen.items():
                refined[spot] += sum(b - refined[spot] for b in bits) / (len(bits) + M.INERTIA)
            moves, seen = collections.Counter(), collections.defaultdict(list)
        before = i
        pairs = [int(t[x]) for t, x in zip(tables, slots)]
        x = [float(M.ODDS[p]) for p in pairs]
        n_of = [float(M.COUNTS[p & 255] + M.COUNTS[p >> 8]) for p in pairs]
        level = sum(round(n_of[M.WORD]) > t for t in M.KNOWN) * 3 + sum(round(n_of[M.NEXT]) > t for t in M.FOLLOWED)
        gate = level * M.DEPTHS + depth
        z = max(-M.CLIP, min(M.CLIP, sum(weights[k, gate] * x[k] for k in range(M.ORDERS))))
        p = 1 / (1 + math.exp(-z))
        spot = level * M.BINS + round((z + M.CLIP) * (M.BINS - 1) / 2 / M.CLIP)
        both = min(max((p + refined[spot]) / 2, 1e-6), 1 - 1e-6)
        total += math.log10(both if bit else 1 - both)
        seen[spot].append(bit)
        if abs(bit - p) > M.LITTLE:
            for k in range(M.ORDERS):
                moves[k, gate] += (bit - p) * M.OWN_RATE * x[k]
    return total


def test_scores_by_brute_force(spark):
    docs = [(d, t.replace("q" * 4700, "") if t else t) for d, t in corpus()]
    model = M.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    counts = [collections.Counter() for _ in range(M.ORDERS)]
    for d, t in docs:
        if M.learns(d):
            for _, bit, _, slots in coded_bits(M.stream_of(M.tokens_of(t)), model):
                for k, x in enumerate(slots):
                    counts[k][x, bit] += 1
    for k, table in enumerate(model.pairs.value):
        want = np.zeros(len(table), np.uint16)
        for x in {x for x, _ in counts[k]}:
            want[x] = M.coded(np.array([counts[k][x, 0]]), np.array([counts[k][x, 1]]))[0]
        assert (table == want).all()
    streams = [M.stream_of(M.tokens_of(t)) for _, t in docs]
    got = model.score(streams)
    for i in [*range(0, 120, 15), 120, 121, 123, 124]:
        assert math.isclose(got[i], brute_score(streams[i], model), rel_tol=2e-3), streams[i]
    # a text's score is its own, whatever is scored beside it
    assert np.allclose(got, [model.score([s])[0] for s in streams], rtol=1e-5)


def test_very_long_texts_go_on_in_pieces(spark, monkeypatch):
    docs = corpus()
    model = M.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    long = M.stream_of(M.tokens_of(" ".join(t for _, t in docs if t)))
    whole = model.score([long])[0]
    monkeypatch.setattr(M, "PIECE", M.CHUNK * 40)
    assert math.isclose(model.score([long, b" "])[0], whole, rel_tol=0.05)
    assert sum(len(p) - s for p, s in M.pieces_of(long)) == len(long)


def test_probabilities_add_up_to_one(spark):
    """Of all bytes that can come first in a text, given the model."""
    model = M.fit(spark.createDataFrame(corpus(), "doc_id long, text string"))
    total = sum(10 ** model.score([bytes([c])])[0] for c in range(256))
    assert math.isclose(total, 1, rel_tol=1e-3)


def test_copies_and_known_texts_cost_less(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(3, 9))) for _ in range(60)) for _ in range(60)]
    held = [i for i in range(3000) if not M.learns(i)]
    learnt = [i for i in range(3000) if M.learns(i)]
    rows = [*zip(learnt, texts), (held[0], texts[5]), (held[1], " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60)))]
    got = {r["doc_id"]: r["bits_per_byte"] for r in M.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] < 0.5 * got[held[1]]


def test_slots_grow_with_the_input():
    sizes = [1 << 10, 1 << 16, 1 << 18, 1 << 20, 1 << 28, 1 << 30]
    bits = [M.slot_bits(n)[-1] for n in sizes]
    assert bits == sorted(set(bits)) and M.slot_bits(1 << 40)[-1] == M.MOST_BITS


def test_nothing_to_learn_from(spark):
    held = [i for i in range(50) if crc32(str(i).encode()) % 5 == 1][:3]
    docs = spark.createDataFrame([(i, "ab") for i in held], "doc_id long, text string")
    for r in M.score(docs).collect():
        assert r["held_out"] and r["train_tokens"] == 0 and r["base_score"] == 0.0 and math.isclose(r["bits_per_byte"], 8.0, rel_tol=2e-2)
    assert M.score(docs.limit(0)).count() == 0


def test_texts_are_scored_where_spark_runs_as_by_brute_force(spark, monkeypatch):
    """The query's own scorer, Mixer.java, against arrays and a bit at a time; also of texts in several pieces."""
    monkeypatch.setattr(M, "PIECE", M.CHUNK * 40)
    docs = [(k, t.replace("q" * 4700, "") if t else t) for k, (_, t) in enumerate(corpus())]
    docs.append((len(docs), " ".join(t for _, t in docs if t) + "\t ÄB\x85 é \r\n"))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = M.fit(frame)
    got = {r[0]: r[1] for r in frame.select("doc_id", model.scores(spark, F.col("text"))).collect()}
    streams = [M.stream_of(M.tokens_of(t)) for _, t in docs]
    assert [got[k][1] for k, _ in docs] == list(map(len, streams))
    assert np.allclose([got[k][0] for k, _ in docs], model.score(streams), rtol=1e-4)
    for k in (0, 45, 120, 122):
        assert math.isclose(got[k][0], brute_score(streams[k], model), rel_tol=2e-3)


def test_weights_are_learnt_as_by_brute_force(spark):
    """From one text: bits are counted 64 at a time, weights move after BATCH of them."""
    rng = random.Random(5)
    doc = next(i for i in range(50) if M.learns(i))
    text = " ".join(rng.choice(["ab", "cé", "zu"]) + str(rng.randrange(40)) for _ in range(900))
    model = M.fit(spark.createDataFrame([(doc, text)], "doc_id long, text string").coalesce(1))
    counts = [collections.defaultdict(lambda: [0, 0]) for _ in range(M.ORDERS)]
    weights, moved, seen = np.full((M.ORDERS, M.GATES), 0.3), np.full((M.ORDERS, M.GATES), 1e-3), np.zeros((2, M.LEVELS * M.BINS))
    bits = list(coded_bits(M.stream_of(M.tokens_of(text)), model))
    assert len(bits) > 2 * M.BATCH
    for start in range(0, len(bits), M.BATCH):
        slope = np.zeros_like(weights)
        for at in range(start, min(start + M.BATCH, len(bits)), 64):
            some = bits[at : min(at + 64, start + M.BATCH)]
            for _, bit, depth, slots in some:
                pairs = [counts[k][x] if x in counts[k] else (0, 0) for k, x in enumerate(slots)]
                x = np.array([math.log((b + M.PRIOR) / (a + M.PRIOR)) for a, b in pairs])
                level = sum(sum(pairs[M.WORD]) + 0.0 > t for t in M.KNOWN) * 3 + sum(sum(pairs[M.NEXT]) > t for t in M.FOLLOWED)
                gate = level * M.DEPTHS + depth
                z = max(-M.CLIP, min(M.CLIP, float(x @ weights[:, gate])))
                err = bit - 1 / (1 + math.exp(-z))
                seen[bit, level * M.BINS + round((z + M.CLIP) * (M.BINS - 1) / 2 / M.CLIP)] += 1
                if abs(err) > M.LITTLE:
                    slope[:, gate] += err * x
            for _, bit, _, slots in some:
                for k, x in enumerate(slots):
                    counts[k][x][bit] += 1
        moved += slope**2
        weights += M.RATE * slope / np.sqrt(moved)
    assert np.allclose(model.weights, weights, atol=2e-3)
    assert model.seen.sum() == len(bits) and np.abs(model.seen - seen).sum() < 0.01 * len(bits)
