"""Scores of texts by online logistic context mixing.

A text is a stream of bytes: its words, lower-cased, each closed by a space, and one more space as its end. A byte is
coded by the bits of a Huffman code that the byte before picks, fitted to the learning documents, which takes less than
half as many bits as plain bytes do. Each bit is predicted in each of CONTEXTS: the last three and five bytes, also
across words; the word so far with the last sign outside ASCII before it, a hint at the language; the word so far with
the word before. A context's hash and the place in the code pick a slot with counts of
zeros and ones. The contexts' log odds are mixed by weights that a gate picks (how well the word and its sequence are
known, depth in the code), and a map from mixed to observed odds refines the outcome.

Learning is online: a task reads its texts once, predicts each bit by what it has counted so far, counts the bits some
at a time, and moves the weights and the map. Tables of the tasks are added, so they hold all learning documents; weights and maps
are averaged, each by the bits it saw. Scoring is online too: counts stay, but each text has weights and a map of its
own, which start as learnt and move after every CHUNK bytes of it. So a text's score depends on the model and the text
alone. Mixer.java does both, a bit at a time, in Spark's own processes; Model.score scores texts at hand in arrays.

What is gathered: the counts of all tokens, exact, and the slots, whose number grows with the learning documents (see
slot_bits) up to what an executor can hold; beyond that, contexts share slots and blur, but all are counted.

Null and empty texts are an end alone. Very long texts are read in pieces of PIECE bytes; contexts of a piece reach
BEHIND bytes back, the text's weights go on. A null id counts as an empty one in the split. Repeated rows are learnt
and scored each. Ties can't arise. Columns other than the two named are not read. With nothing to learn from, bytes
cost eight bits each; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from foliospark.llm import words as W
from foliospark.sources.runtime import java_object, ship, table

CONTEXTS = ("three bytes", "five bytes", "word after hint", "word after word")
ORDERS = len(CONTEXTS)
#: Slots of the first contexts, as powers of two, at most; of all contexts at least, with plenty
#: of text and at most, see slot_bits(): at most, a learning task's tables take 400 MB.
FEW_BITS, LEAST_BITS, MANY_BITS, MOST_BITS, PLENTY = (20,), 16, 22, 24, 1 << 26
#: Slots of a packed part; text whose pieces a learning task works off side by side; bits by which weights move; text
#: whose bits are held at once; input of a learning task, in bytes of files.
PART, LEARN_BYTES, BATCH, SCORE_BYTES, TASK_BYTES = 1 << 16, 1 << 15, 1 << 12, 1 << 16, 20 << 20
#: Slots that are sent at once.
SENT = 1 << 21
#: Texts that are scored side by side in arrays, and their bytes; a step of few texts costs as much as one of many. Text
#: whose contexts are hashed at once.
GROUP, GROUP_BYTES, HASH_BYTES = 256, 2 << 20, 1 << 16
PIECE, BEHIND, CHUNK = 1 << 18, 256, 32
PRIOR, CLIP, BINS = 0.05, 12.0, 33
#: How well the word so far is known, its sequence too; depths in the code.
KNOWN, FOLLOWED, DEPTHS = np.array([0.5, 2.5, 8.5, 40.5], np.float32), np.array([0.5, 2.5], np.float32), 3
LEVELS = (len(KNOWN) + 1) * (len(FOLLOWED) + 1)
GATES = LEVELS * DEPTHS
#: Rates of learning: of weights, then of a text's own weights and map.
RATE, OWN_RATE, INERTIA, LITTLE = 0.02, 0.002, 50.0, 0.02
#: Counts travel as bytes, an eighth of a power of two a step; what a byte stands for.
COUNTS = (2.0 ** (np.arange(256) / 8) - 1).astype(np.float32)
_LOG = np.log(COUNTS + np.float32(PRIOR))
#: Of a slot's pair of bytes, zeros below ones: log odds and the sum of counts.
_ZEROS, _ONES = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
ODDS = _LOG[_ONES] - _LOG[_ZEROS]
#: Parts of the level by sums of counts, and by a slot's pair of bytes.
WORD_LEVEL, NEXT_LEVEL = ((np.searchsorted(t, np.arange(64)) * n).astype(np.int64) for t, n in ((KNOWN, len(FOLLOWED) + 1), (FOLLOWED, 1)))
_SUMS = np.minimum(COUNTS[_ZEROS] + COUNTS[_ONES] + 0.5, 63).astype(np.int64)
WORD_LEVEL_OF, NEXT_LEVEL_OF = WORD_LEVEL[_SUMS], NEXT_LEVEL[_SUMS]
WORD, NEXT = CONTEXTS.index("word after hint"), CONTEXTS.index("word after word")
_STEP = np.uint32(0x9E3779B1)

END = b" "


def coded(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Counts as pairs of bytes."""
    a, b = (np.minimum(np.rint(8 * np.log2(1.0 + n)), 255).astype(np.uint16) for n in (zeros, ones))
    return a | b << 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def tokens_of(text: str | None) -> list[bytes]:
    return [*words_of(text), END]


def stream_of(tokens: list[bytes]) -> bytes:
    """A space after each word, and the end."""
    return b" ".join(tokens)


def learns(doc_id: int | None) -> int:
    return int(crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1)


def slot_bits(size: int) -> list[int]:
    """Slots of each context, as powers of two, for so many bytes of learning text: four a byte at first, beyond PLENTY
    bytes by the square root of them, as vocabularies grow."""
    bits = max(LEAST_BITS, min(MANY_BITS, (4 * size).bit_length()))
    most = min(MOST_BITS, bits + max(0, size.bit_length() - PLENTY.bit_length()) // 2)
    return [min(few, most) for few in FEW_BITS] + [most] * (ORDERS - len(FEW_BITS))


@dataclass
class Code:
    """Of each pair of a byte and the one before: where its bits start in nodes and bits, and how many they are. nodes:
    inner places of the codes; depth: of a place, in DEPTHS steps."""

    start: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    depth: np.ndarray

    @staticmethod
    def fitted(pairs: np.ndarray) -> Code:
        """Huffman's codes of bytes by the byte before, from counts of the 65,536 pairs, each counted once more."""
        lengths, nodes, bits, depth = [], [], [], []
        plain = _huffman(np.zeros(256))
        for before, row in enumerate(pairs.reshape(256, 256)):
            for path in _huffman(row) if row.any() else plain:
                lengths.append(len(path))
                nodes += [before * 256 + node for node, _ in path]
                bits += [bit for _, bit in path]
                depth += range(len(path))
        length = np.array(lengths)
        step = np.minimum((np.array(depth) + 1) >> 1, DEPTHS - 1)
        return Code(np.cumsum(length) - length, length, np.array(nodes).astype(np.uint32) * np.uint32(0x85EBCA6B), np.array(bits, np.uint8), step.astype(np.uint8))


def _huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """Each byte's path: inner nodes and the bits taken there."""
    heap: list[tuple] = [(int(n) + 1, b, b) for b, n in enumerate(counts)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    under = {b: [b] for b in range(256)}
    for node in range(255):
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in ((0, a), (1, b)):
            for x in under[side]:
                paths[x].append((node, bit))
        under[256 + node] = under.pop(a) + under.pop(b)
        heapq.heappush(heap, (n + m, 256 + node, 256 + node))
    return [p[::-1] for p in paths]


@dataclass
class Bytes:
    """Bytes of texts in the order in which they are worked off: step by step, in each step text by text."""

    text: np.ndarray
    pair: np.ndarray
    hashes: list[np.ndarray]
    steps: np.ndarray  # where each step's bytes end
    texts: int


@dataclass
class Bits:
    """Bits of some of these bytes."""

    text: np.ndarray
    bit: np.ndarray
    depth: np.ndarray
    slots: list[np.ndarray]
    steps: np.ndarray  # where each step's bits end


def contexts(b: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Hashes of each byte's contexts. first: where the byte's text starts."""
    i = np.arange(len(b))
    inside = i - first
    z = b.astype(np.uint64) + np.uint64(1)
    last = []
    for k in range(1, 6):
        x = np.zeros(len(b), np.uint64)
        x[k:] = z[:-k]
        x[inside < k] = 0
        last.append(x << np.uint64(9 * (k - 1)))
    three = last[0] | last[1] | last[2]
    five = three | last[3] | last[4]
    # a hash of the word's bytes so far, by a sum of powers that wraps
    opens = inside == 0
    opens[1:] |= b[:-1] == 32
    head = np.maximum.accumulate(np.where(opens, i, 0))
    at = i - head
    powers = np.cumprod(np.concatenate([[1], np.full(int(at.max(initial=0)), 0x100000001B3)]).astype(np.uint64))
    terms = z * powers[at]
    before = np.cumsum(terms) - terms
    word = (before - before[head]) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)
    earlier = head > first
    previous = np.where(earlier, word[head - 1] + np.uint64(1), np.uint64(0))
    sign = np.maximum.accumulate(np.where(b >= 128, i, -1))[head - 1]
    hint = np.where(earlier & (sign >= first), z[sign] | z[np.maximum(sign - 1, first)] << np.uint64(9), np.uint64(0))
    out = []
    for k, x in enumerate((three, five, word + (hint + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93), word + (previous + np.uint64(3)) * np.uint64(0xA0761D6478BD642F))):
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
        out.append(((x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype(np.uint32))
    return out


def pairs_of(b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each byte under the one before it, which is a space where the text starts."""
    out = np.full(len(b), 32 << 8, np.int64)
    out[1:] = np.where(first[1:] < np.arange(1, len(b)), b[:-1].astype(np.int64) << 8, 32 << 8)
    return out | b


def bytes_of(pieces: list[bytes], skipped: list[int]) -> Bytes:
    """The bytes of pieces but for those skipped at their starts, which are contexts only."""
    found = []
    start = size = 0
    for i, piece in enumerate(pieces):
        size += len(piece)
        if size >= HASH_BYTES or i + 1 == len(pieces):
            # contexts end at the piece, so that few at a time do
            now = pieces[start : i + 1]
            sizes = np.fromiter(map(len, now), np.int64, len(now))
            b = np.frombuffer(b"".join(now), np.uint8)
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            step = (np.arange(len(b)) - first - np.repeat(np.array(skipped[start : i + 1], np.int64), sizes)) // CHUNK
            keep = slice(None) if not any(skipped[start : i + 1]) else step >= 0
            text = np.repeat(np.arange(start, i + 1, dtype=np.int32), sizes)
            found.append([x[keep] for x in (step.astype(np.int16), text, pairs_of(b, first).astype(np.uint16), *contexts(b, first))])
            start, size = i + 1, 0
    step, text, pair, *hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(step, kind="stable")
    return Bytes(text[order], pair[order], [h[order] * _STEP for h in hashes], np.flatnonzero(np.diff(step[order], append=-1)) + 1, len(pieces))


def bits_of(m: Bytes, code: Code, powers: list[int], start: int, steps: np.ndarray) -> Bits:
    """The bits of the steps whose bytes end at `steps`, from the byte at start on."""
    e = slice(start, int(steps[-1]) if len(steps) else start)
    pair = m.pair[e]
    lengths = np.take(code.length, pair)
    ends = np.cumsum(lengths)
    byte = np.repeat(np.arange(len(pair)), lengths)
    place = np.arange(len(byte)) + np.take(np.take(code.start, pair) - ends + lengths, byte)
    nodes = np.take(code.nodes, place) * _STEP
    slots = []
    for h, t in zip(m.hashes, powers, strict=True):
        s = np.take(h[e], byte)
        s += nodes
        s >>= np.uint32(32 - t)
        slots.append(s.astype(np.int64))
    return Bits(np.take(m.text[e].astype(np.int64), byte), np.take(code.bits, place), np.take(code.depth, place), slots, ends[steps - start - 1])


def bins(z: np.ndarray, level: np.ndarray) -> np.ndarray:
    return level * BINS + np.rint((z + np.float32(CLIP)) * np.float32((BINS - 1) / 2 / CLIP)).astype(np.int64)


def mixed(x: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    z = x[0] * np.take(weights[0], gate)
    for k in range(1, ORDERS):
        z += x[k] * np.take(weights[k], gate)
    return np.clip(z, -CLIP, CLIP, out=z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def pieces_of(stream: bytes) -> Iterator[tuple[bytes, int]]:
    """Pieces of a text, each after some bytes of the piece before, and how many those are."""
    for at in range(0, len(stream), PIECE):
        back = max(0, at - BEHIND)
        yield stream[back : at + PIECE], at - back


@dataclass
class Tables:
    """Slots of each context, as pairs of bytes."""

    value: list[np.ndarray]


@dataclass
class Model:
    code: Code
    powers: list[int]
    pairs: Tables
    weights: np.ndarray
    seen: np.ndarray

    def scores(self, spark: SparkSession, text: Column) -> Column:
        """log10 probabilities of a column of texts, and the bytes of their streams, as array<double>."""
        tables = [t[at : at + SENT] for t in self.pairs.value for at in range(0, len(t), SENT)]
        mixer = _mixer(spark, self.code, self.powers, self.weights, self.map, ODDS, WORD_LEVEL_OF.astype(np.uint8), NEXT_LEVEL_OF.astype(np.uint8), *tables)
        return Column(mixer.scores(text.cast("string").cast("binary")._jc))

    def score(self, streams: list[bytes]) -> np.ndarray:
        """log10 probabilities of streams at hand, in arrays."""
        out, tables = np.zeros(len(streams)), self.pairs.value
        for group in _grouped(streams):
            state = (np.tile(self.weights, len(group)), np.tile(self.map, len(group)))
            parts = [list(pieces_of(streams[i])) for i in group]
            for n in range(max(map(len, parts))):
                # texts of several pieces are alone in their group
                now = [p[n] for p in parts]
                m = bytes_of([p for p, _ in now], [s for _, s in now])
                start = at = 0
                while at < len(m.steps):
                    # as many steps at once as make SCORE_BYTES, one at least
                    to = max(at + 1, int(np.searchsorted(m.steps, start + SCORE_BYTES, side="right")))
                    steps = m.steps[at:to]
                    out[group] += self._run(bits_of(m, self.code, self.powers, start, steps), tables, *state)
                    start, at = int(steps[-1]), to
        return out

    @property
    def map(self) -> np.ndarray:
        """The map from bins to probabilities of a one, in doubt those of the bins' odds."""
        z = np.tile((np.arange(BINS) / (BINS - 1) * 2 - 1) * CLIP, LEVELS)
        return ((self.seen[1] + 20 * sigmoid(z)) / (self.seen.sum(0) + 20)).astype(np.float32)

    def _run(self, m: Bits, tables: list[np.ndarray], weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
        x = np.empty((ORDERS, len(m.bit)), np.float32)
        for k in range(ORDERS):
            c = np.take(tables[k], m.slots[k])
            np.take(ODDS, c, out=x[k], mode="clip")
            if k == WORD:
                level = np.take(WORD_LEVEL_OF, c)
            elif k == NEXT:
                level += np.take(NEXT_LEVEL_OF, c)
        gate = m.text * GATES + level * DEPTHS + m.depth
        level += m.text * LEVELS
        p = np.empty(len(m.bit), np.float32)
        start = 0
        for end in m.steps.tolist():
            e = slice(start, end)
            # texts come longest first: those of a step are the first ones
            xe, g, bit, texts = x[:, e], gate[e], m.bit[e], int(m.text[end - 1]) + 1
            z = mixed(xe, weights, g)
            q = sigmoid(z)
            spot = bins(z, level[e])
            old = np.take(refined, spot)
            p[e] = (q + old) / 2
            err = bit - q
            much = np.flatnonzero(np.abs(err) > LITTLE)
            err, g = np.take(err, much).astype(np.float64) * OWN_RATE, np.take(g, much)
            for k in range(ORDERS):
                weights[k, : texts * GATES] += np.bincount(g, err * np.take(xe[k], much), texts * GATES)
            # only bins that were met move, by the sum of their errors over their number
            np.add.at(refined, spot, (bit - old) / (np.take(np.bincount(spot), spot).astype(np.float32) + np.float32(INERTIA)))
            start = end
        p = np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6))
        return np.bincount(m.text, np.log(np.where(m.bit > 0, p, 1 - p)), len(refined) // (LEVELS * BINS)) / np.log(10.0)


def _grouped(streams: list[bytes]) -> Iterator[np.ndarray]:
    """Texts that are scored side by side, the longest first; one of several pieces is alone."""
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    group, size = [], 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        if group and (sizes[group[0]] > PIECE or size + sizes[i] > GROUP_BYTES or len(group) == GROUP):
            yield np.array(group)
            group, size = [], 0
        group.append(i)
        size += int(sizes[i])
    if group:
        yield np.array(group)


def _learning(docs: DataFrame) -> DataFrame:
    own = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))) % 5 != 1
    return docs.where(own).select(F.col("text").cast("string").alias("text"))


def _code(learning: DataFrame) -> tuple[Code, int]:
    """The code of learning texts, and their bytes."""

    pairs = np.zeros(1 << 16)
    counted = _mapped(learning, _mixer(learning.sparkSession), StructType().add("pair", IntegerType()).add("n", LongType()))
    for r in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        pairs[r["pair"]] = r["n"]
    return Code.fitted(pairs), int(pairs.sum())


def fit(docs: DataFrame) -> Model:
    """A model of the documents that learns() names."""
    learning = _learning(docs)
    spark = docs.sparkSession
    code, size = _code(learning)
    powers = slot_bits(size)
    starts = _starts(powers)
    ship(spark)
    weights, seen = np.full((ORDERS, GATES), 0.3, np.float32), np.zeros((2, LEVELS * BINS))
    learnt = _mapped(learning.coalesce(W.tasks_for(docs, TASK_BYTES)), _mixer(spark, code, powers, weights), StructType().add("part", IntegerType()).add("data", BinaryType()))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                arrays = [a.astype(np.float64 if part < 0 else np.uint64) for a in W.unpack(data)]
                held[part] = [a + b for a, b in zip(held[part], arrays, strict=True)] if part in held else arrays
        for part, arrays in held.items():
            packed = W.pack(*arrays) if part < 0 else W.pack(coded(*arrays))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["part", "data"])

    sums = table(learnt.repartition("part").mapInArrow(added, "part int, data binary"), "mixing-tables", "mixing")
    flat = np.zeros(int(starts[-1]) * PART, np.uint16)
    for r in sums.toLocalIterator():  # tables of a bounded size, a part a row
        arrays = W.unpack(bytes(r["data"]))
        if r["part"] < 0:
            weights, seen = (arrays[1] / arrays[0]).astype(np.float32).reshape(weights.shape), arrays[2].reshape(seen.shape)
        else:
            flat[r["part"] * PART :][: len(arrays[0])] = arrays[0]
    pairs = [flat[int(s) * PART :][: 1 << t] for s, t in zip(starts, powers, strict=False)]
    return Model(code, powers, Tables(pairs), weights, seen)


def _starts(powers: list[int]) -> np.ndarray:
    """The first part of each context's table, and their number."""
    return np.cumsum([0, *(max(1 << t, PART) // PART for t in powers)])


def _mapped(texts: DataFrame, mixer: JavaObject, schema: StructType) -> DataFrame:
    """What a mixer makes of each partition's texts."""
    spark = texts.sparkSession
    encoder = spark._jvm.org.apache.spark.sql.Encoders.row(spark._jsparkSession.parseDataType(schema.json()))
    return DataFrame(texts.select(F.col("text").cast("binary"))._jdf.mapPartitions(mixer, encoder), spark)


def _mixer(spark: SparkSession, code: Code | None = None, powers: list[int] = (), *more: np.ndarray) -> JavaObject:
    """A Mixer.java: without a code it counts pairs of bytes; with weights it learns, from these on; with the map and what
    follows it scores."""
    mixer = java_object(spark, Path(__file__).with_name("Mixer.java"), "foliospark.Mixer")
    if code:
        numbers = [DEPTHS, LEVELS, BINS, CHUNK, BATCH, LEARN_BYTES, PIECE, BEHIND, PART, int(_STEP.astype(np.int32)), *powers, *_starts(powers)[:-1].tolist()]
        rates, levels = [PRIOR, CLIP, LITTLE, INERTIA, RATE, OWN_RATE], [x.astype(np.uint8) for x in (WORD_LEVEL, NEXT_LEVEL)]
        arrays = [np.array(numbers, "<i4"), np.array(rates, "<f8"), code.start.astype("<i4"), code.length.astype("<i4"), code.nodes * _STEP, code.bits, code.depth, *levels, *more]
        for x in arrays:
            mixer.add(spark.sparkContext._jsc.broadcast(x.tobytes()))
    return mixer


def _vocabulary(parts: DataFrame, tasks: int) -> DataFrame:
    """Distinct tokens of learning documents and their counts, packed; block: tokens, once: distinct words of a row."""

    def merge(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[bytes, int] = {}
        now = None

        def flush() -> Iterator[tuple]:
            words = sorted(w for w, c in held.items() if c)
            for at in range(0, len(words), 100_000):
                counts = np.array([held[w] for w in words[at : at + 100_000]], "<u8")
                yield int(counts.sum()), now, 0, len(counts), W.pack_words(words[at : at + 100_000], counts)
            held.clear()

        for _, bucket, _, _, data in rows:
            if bucket != now:
                yield from flush()
                now = bucket
            words, (_, seen) = W.unpack_words(data)
            for w, c in zip(words, seen.tolist(), strict=True):
                held[w] = held.get(w, 0) + c
        yield from flush()

    return W.by_bucket(parts.where("kind = 0"), merge, tasks)


def _answers(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Counts of a block's packed words. A task sees its buckets' vocabulary first."""
    counts: dict[bytes, int] = {}
    for block, bucket, kind, once, data in rows:
        words, arrays = W.unpack_words(data)
        if kind == 0:
            counts.update(zip(words, arrays[0].tolist(), strict=True))
        else:
            c = np.fromiter((counts.get(w, 0) for w in words), "<u8", len(words))
            yield block, bucket, 0, once, W.pack(arrays[0], c.astype("<u4") if not len(c) or c.max() < 1 << 32 else c)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of docs (doc_id,
    text): learnt from the documents that learns() names, for all of them."""
    spark = docs.sparkSession
    ship(spark)
    docs = W.dealt(docs.select("doc_id", "text"))
    docs = docs.withColumn("extra", fit(docs).scores(spark, F.col("text")))
    tasks = W.tasks_for(docs)
    parts = table(W.split_blocks(docs, tokens_of, learns, W.buckets_for(docs), weigh=True), "mixing-words", "mixing")
    vocabulary = table(_vocabulary(parts, tasks), "mixing-vocabulary", "mixing")
    totals = vocabulary.agg(F.sum("block"), F.sum("once")).first()
    tokens, distinct = int(totals[0] or 0), int(totals[1] or 0)
    scale = tokens + 0.5 * (distinct + 1)
    answers = W.by_bucket(vocabulary.unionByName(parts.where("kind = 0").withColumn("kind", F.lit(1))), _answers, tasks)
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"

    def add(held: list, data: bytes) -> None:
        steps, counts = W.unpack(data)
        held.append((np.cumsum(steps, dtype=np.int64), counts))

    def finish(held: list, doc_id: int | None, flag: int, ranks: np.ndarray, extra: np.ndarray) -> tuple:
        if not isinstance(held[0], np.ndarray):
            order = np.argsort(np.concatenate([x[0] for x in held]))
            held[:] = [np.concatenate([x[1] for x in held])[order].astype(np.float64)]
        c = held[0][ranks]
        return doc_id, not flag, len(ranks), int((c > 0).sum()), tokens, float(np.log10((c + 0.5) / scale).sum()), float(extra[0]), int(extra[1])

    out = W.by_block(answers.unionByName(parts.where("kind = 1")), list, add, finish, fields, schema, tasks)
    return out.withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs)
