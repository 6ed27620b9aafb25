"""Near-duplicate documents by banded MinHash, with odd sketches to verify candidates.

A document's set is its distinct shingles of so many words, hashed to 64 bits; with fewer words the whole sequence is
one shingle. Equal sets are one class from the start. Of each class, BANDS x ROWS minima over permutations of the
hashes are taken: classes that share a band's minima meet. The samples are folded into a parity bitmap, the odd
sketch; the population count of two sketches' XOR estimates their similarity, and pairs below the threshold go no
further. A second bitmap folds the whole set, whose XOR tells small sets' differences almost exactly. What is left is
confirmed on the full sets. A pair at the threshold misses all bands with a probability of (1 - 0.8 ** ROWS) ** BANDS,
8e-6; unrelated texts hardly ever meet.

A bucket's pairs are not listed: ROUNDS times over, a bucket's members are held against one member, first that which
meets most others over all bands, as the original of copies does, then others, which joins all that are near; members
that are still apart after these rounds are held against all others of their buckets that they are not joined to yet,
so no link is lost. Links become components by rounds of smallest neighbours, on tables.

Each row has a result. Null and empty texts, and texts without words, have empty sets and are linked with nothing.
Rows of one id are linked with each other if they have words. A null id stands for its row alone; such rows take part,
but name no component: one without any id has none. Very long texts are sets as others are, held by one task at a time.
Of members that tie, any may be held against a bucket's others; the links found are the same. Empty tables give an
empty result. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from foliospark.llm import words as W
from foliospark.llm.lines import _join
from foliospark.sources.runtime import ship, table

ROWS, BANDS, SKETCH_BITS, ROUNDS, SEED = 8, 64, 2048, 3, 11
#: An odd sketch of 512 samples errs by 0.02 at 0.8; pairs are let go this far below the threshold.
SLACK = 0.1
#: Members of a bucket that a task holds against as many.
GRID = 2048

_rng = np.random.default_rng(SEED)
_MULTIPLY = (_rng.integers(0, 1 << 32, ROWS * BANDS, np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, ROWS * BANDS, np.uint64).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, size: int) -> np.ndarray:
    """The set of a text: sorted hashes of its shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - size + 1
    out = h[:n].copy()
    for i in range(1, size):
        out = _mix(out + np.uint64(i)) ^ h[i : n + i]
    return np.unique(_mix(out))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash under each permutation of 32 bits."""
    low = (hashes >> np.uint64(16)).astype(np.uint32)
    out = np.full(len(_MULTIPLY), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (_MULTIPLY[:, None] * low[None, at : at + 512] + _ADD[:, None]).min(1), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> bytes:
    spots = _mix((samples.astype(np.uint64) << np.uint64(16)) + np.arange(len(samples), dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(spots.astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def whole_sketch(hashes: np.ndarray) -> bytes:
    """The odd sketch of a set itself."""
    return np.packbits(np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def most_differing(threshold: float) -> int:
    """The most bits in which two sketches of samples may differ: what the estimate comes to at threshold - SLACK."""
    k = ROWS * BANDS
    apart = max(0.0, min(1.0, 1 - threshold + SLACK))
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * k * apart)))


def most_differing_sets(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The most bits in which sketches of sets may differ whose sizes add up to so much: the mean at the threshold and
    five deviations. Sets too large for a sketch always pass."""
    n, d = float(SKETCH_BITS), (1 - threshold) / (1 + threshold) * sizes
    once, twice = np.exp(d * np.log1p(-2 / n)), np.exp(d * np.log1p(-4 / n))
    spread = n / 4 * (1 - twice) + n * n / 4 * (twice - once * once)
    return n / 2 * (1 - once) + 5 * np.sqrt(np.maximum(spread, 0)) + 1


def agree(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of sketches, rows of both bitmaps, can belong to sets at the threshold."""
    bits = np.bitwise_count(a ^ b)
    half = bits.shape[1] // 2
    return (bits[:, :half].sum(1) <= most_differing(threshold)) & (bits[:, half:].sum(1) <= most_differing_sets(sizes, threshold))


def estimate(differing: int, n: int = SKETCH_BITS, k: int = ROWS * BANDS) -> float:
    """Similarity from the XOR's population count."""
    return 1 + n / (4 * k) * float(np.log(max(1e-9, 1 - 2 * differing / n)))


def _signer(size: int):
    @arrow_udf("n long, set_a long, set_b long, bands array<long>, sketch binary")
    def sign(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
        for texts in it:
            rows = []
            for text in texts.to_pylist():
                s = shingles(text, size)
                if len(s):
                    m = minima(s)
                    bands = [xxhash.xxh3_64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(m.reshape(BANDS, ROWS))]
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    rows.append({"n": len(s), "set_a": (whole >> 64) - (1 << 63), "set_b": (whole & (1 << 64) - 1) - (1 << 63), "bands": bands, "sketch": odd_sketch(m) + whole_sketch(s)})
                else:
                    rows.append({"n": 0, "set_a": 0, "set_b": 0, "bands": [], "sketch": b""})
            yield pa.array(rows, kind)
        W.relax()

    return sign


def _sets(size: int):
    @arrow_udf("array<long>")
    def sets(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield pa.array([shingles(t, size).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))
        W.relax()

    return sets


def _close(threshold: int):
    @arrow_udf("boolean")
    def close(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint64).reshape(len(v), -1) for v in (a, b))
        sizes = na.to_numpy(zero_copy_only=False) + nb.to_numpy(zero_copy_only=False)
        return pa.array(agree(x, y, sizes.astype(float), threshold / 100), pa.bool_())

    return close


def _agreeing(threshold: int):
    """The pass over cells of buckets that lists pairs of different components whose sizes and sketches agree."""

    def across(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, j = rows[0][2:4]
        part, name, c, n = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[4:8])
        sketch = np.frombuffer(b"".join(r[8] for r in rows), np.uint64).reshape(len(rows), -1)
        bands = np.array([r[9] for r in rows], np.int64)
        for k in range(len(rows) - 1):
            y = slice(k + 1, None)
            fits = (c[y] != c[k]) & (np.minimum(n[y], n[k]) * 100 >= np.maximum(n[y], n[k]) * threshold)
            if i != j:
                fits &= part[y] != part[k]
            at = np.flatnonzero(fits) + k + 1
            if len(at):
                at = at[agree(sketch[at], sketch[k], (n[at] + n[k]).astype(float), threshold / 100)]
                # in the first band alone that a pair shares
                at = at[(bands[at] == bands[k]).argmax(1) == rows[0][0]] if len(at) else at
                yield np.minimum(name[at], name[k]), np.maximum(name[at], name[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                for a, b in across(held):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:4] != row[:4]:
                    yield from flush()
                held.append(row)
        yield from flush()

    return run


def components(links: DataFrame, tag: str = "neardup") -> DataFrame:
    """node, component (the smallest node reachable) of links (a, b): larger nodes point to their smallest neighbour's
    side, then each node's neighbours to its smallest, until nothing changes."""
    edges = table(links.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links", tag)
    state = None
    for _ in range(60):
        # each node's neighbours that are larger go to its smallest neighbour, itself included
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u != v").distinct()
        # each node's smaller neighbours, and itself, go to the smallest of them
        small = larger.groupBy("v").agg(F.min("u").alias("m"))
        smaller = larger.join(small, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a != b")
        edges = table(smaller.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links", tag)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))


def classes(docs: DataFrame, *, size: int = 5, threshold: int = 80, tag: str = "neardup") -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id, text), a row each: components of links at threshold hundredths
    or more."""
    ship(docs.sparkSession)
    hashed = lambda t: F.xxhash64(t)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows are numbered, as ids may be null or stand for several
    signed = texts.withColumn("s", _signer(size)(F.col("text"))).select(F.monotonically_increasing_id().alias("row"), "doc_id", hashed("text").alias("th"), "s.*")
    signed = table(signed, "signatures", tag)
    # rows of equal sets are one class, named after its first row
    several = signed.where("n > 0").groupBy("set_a", "set_b").agg(F.count("*").alias("m"), F.min("row").alias("first"), F.min("doc_id").alias("least"))
    several = table(several.where("m > 1").drop("m"), "classes", tag)
    classed = _join(signed, several, ["set_a", "set_b"], "left").withColumn("name", F.coalesce("first", "row")).withColumn("lead", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    led = table(classed.select("doc_id", "n", "name", "lead"), "members", tag)
    ones = classed.where("n > 0 and row = name")
    bands = table(ones.select("name", "n", F.posexplode("bands").alias("band", "value")), "bands", tag)
    crowd = table(bands.groupBy("band", "value").agg(F.count("*").alias("m")).where("m > 1"), "crowds", tag)
    shared = _join(bands, crowd, ["band", "value"], "inner")
    central = shared.groupBy("name").agg(F.sum("m").alias("central"))
    met = table(shared.join(central, "name").select("band", "value", "name", "n", "central"), "buckets", tag)
    some = table(met.select("name", "n").distinct(), "candidates", tag)
    sketches = table(_join(ones.select("name", "n", "sketch", "bands", "doc_id", "th"), some.select("name"), "name", "inner"), "sketches", tag)
    # a candidate's text is one of its id's with its hash
    key = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("key")
    wanted = table(sketches.select(key, "th", "name", "n"), "wanted", tag)
    picked = _join(texts.select(key, hashed("text").alias("th"), "text"), wanted, ["key", "th"], "inner").dropDuplicates(["name"])
    known = table(table(picked, "texts", tag).withColumn("set", _sets(size)(F.col("text"))).where(F.size("set") == F.col("n")).select("name", "set"), "sets", tag)

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        """Of distinct pairs (a, b) those whose sets are near enough."""
        side = lambda c: sketches.select(F.col("name").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b")
        close = table(sized.where(_close(threshold)("sa", "sb", "na", "nb")).select("a", "b"), f"close-{name}", tag)
        full = lambda c: known.select(F.col("name").alias(c), F.col("set").alias(f"set{c}"))
        shared = F.size(F.array_intersect("seta", "setb"))
        exact = close.join(full("a"), "a").join(full("b"), "b").where(shared * 100 >= (F.size("seta") + F.size("setb") - shared) * threshold)
        return table(exact.select("a", "b"), f"near-{name}", tag)

    links, joined = None, None

    def labelled() -> DataFrame:
        return met.join(joined, met["name"] == joined["node"], "left").withColumn("c", F.coalesce("component", "name")).drop("node", "component") if joined is not None else met.withColumn("c", F.col("name"))

    # sets whose sizes differ more than this can't be near
    alike = lambda m, n: F.least(m, n) * 100 >= F.greatest(m, n) * threshold

    for turn in range(ROUNDS):
        # the member that a bucket's others are held against: by hash, so that bands and rounds take different ones
        now = labelled()
        order = F.xxhash64("name", "band", "value", F.lit(turn)) if turn else -F.col("central")
        hubs = now.groupBy("band", "value").agg(F.min(F.struct(order.alias("o"), F.col("name").alias("hub"), F.col("c").alias("hc"), F.col("n").alias("hn"))).alias("h")).select("band", "value", "h.hub", "h.hc", "h.hn")
        pairs = now.join(hubs, ["band", "value"]).where((F.col("c") != F.col("hc")) & alike(F.col("n"), F.col("hn"))).select(F.least("name", "hub").alias("a"), F.greatest("name", "hub").alias("b")).distinct()
        found = confirm(pairs, f"round-{turn}")
        links = found if links is None else links.union(found)
        joined = components(links, tag)
    # buckets that still hold several components: their members are held against each other across these, sketch by
    # sketch, in a grid of parts; only pairs whose sketches agree are listed
    now = table(labelled(), "labelled", tag)
    open_ = now.groupBy("band", "value").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.ceil(F.count("*") / GRID).cast("int").alias("parts")).where("low != high").select("band", "value", "parts")
    part = F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")
    rest = now.join(open_, ["band", "value"]).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = _join(rest, sketches.select("name", "sketch", "bands"), "name", "inner")
    cells = rest.select("band", "value", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "name", "c", "n", "sketch", "bands")
    cells = cells.repartition("band", "value", "i", "j").sortWithinPartitions("band", "value", "i", "j")
    pairs = cells.mapInArrow(_agreeing(threshold), "a long, b long").distinct()
    found = confirm(pairs, "rest")
    joined = components(links.union(found), tag)

    # rows of one id are one document, whatever their texts
    linked = led.where("n > 0 and doc_id is not null")
    ids = linked.groupBy("doc_id").agg(F.min("name").alias("a"), F.max("name").alias("z")).where("a != z").select("doc_id", "a")
    ids = table(ids, "ids", tag)
    if ids.take(1):
        joined = components(links.union(found).union(_join(linked, ids, "doc_id", "inner").select("a", F.col("name").alias("b"))), tag)
    nodes = joined.union(joined.select("component", "component")).distinct()
    leads = table(nodes.join(led.where("n > 0").groupBy("name").agg(F.min("lead").alias("lead")), F.col("node") == F.col("name")).select("name", "component", "lead"), "leads", tag)
    top = leads.groupBy("component").agg(F.min("lead").alias("top"))
    over = table(leads.join(top, "component").select("name", "top"), "tops", tag)
    whole = _join(led, over, "name", "left")
    lead = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("top", "lead"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), lead.alias("component_id"))


def dedup(docs: DataFrame, *, size: int = 5, threshold: int = 80, tag: str = "neardup") -> DataFrame:
    """docs whose id leads its class: one document of each group, its smallest id. Rows of an id stay or go together; rows
    without an id stay."""
    found = classes(docs.select("doc_id", "text"), size=size, threshold=threshold, tag=tag)
    gone = table(found.where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone", tag)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs, size=2).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
