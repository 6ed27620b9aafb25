"""Benchmark decontamination by a generalised suffix automaton of the test items.

Each document's words run through the automaton; where the longest match reaches the window, the window's words are
hit. Items shorter than the window count as one window. The automaton of BLOCK_WORDS item words at most goes to the
executors; more items make more blocks, each run over all documents.

Null and empty texts have no words: nothing is hit, and such items are no windows. Repeated items count by their id;
an item without an id hits words but is not listed. Repeated documents are treated row by row. A column of the
result's name is replaced. Empty tables give empty or unhit results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from foliospark.llm import words as W
from foliospark.sources.runtime import ship, table

#: Item words of an automaton: about 100 MB in a Python worker.
BLOCK_WORDS = 120_000

#: Lower-cases A-Z, keeps a-z, 0-9 and whatever is not ASCII; the rest parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RESULT = "n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class SuffixAutomaton:
    """Of several word sequences. step[s]: the transitions of state s; at[s], for states that hold a window: the items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, seq in items:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.at: dict[int, set[str | None]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for name, seq in items:
            s = 0
            for i, w in enumerate(seq):
                s = self.step[s][w]
                if i + 1 >= window:
                    s = self.climb(s)
                    self.at.setdefault(s, set()).add(name)
            if seq and len(seq) < window:
                while self.length[self.link[s]] >= len(seq):
                    s = self.link[s]
                self.short.setdefault(s, []).append((len(seq), name))
        # what ends in a state also ends where a suffix of it does
        for s in sorted(range(len(self.step)), key=self.length.__getitem__):
            if s and (up := self.short.get(self.link[s])):
                self.short[s] = self.short.get(s, []) + up

    def climb(self, s: int) -> int:
        """The state of the last window words of a match in s."""
        while self.length[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def _new(self, step: dict[bytes, int], length: int, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = self._new(dict(self.step[q]), self.length[p] + 1, self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if (q := self.step[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        cur = self._new({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str | None]]:
        """Hit spans, joined where they meet, and the items they are from."""
        step, link, length, window, short = self.step, self.link, self.length, self.window, self.short
        spans: list[list[int]] = []
        found: set[str | None] = set()
        s = n = 0
        for i, w in enumerate(words):
            t = step[s].get(w)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = step[s].get(w)
            if t is None:
                continue
            s, n = t, n + 1
            reach = 0
            if n >= window:
                found |= self.at[self.climb(s)]
                reach = window
            if short and s in short:
                for k, name in short[s]:
                    if k <= n:
                        found.add(name)
                        reach = max(reach, k)
            if reach:
                a = i + 1 - reach
                while spans and spans[-1][0] >= a:
                    spans.pop()
                if spans and spans[-1][1] >= a:
                    spans[-1][1] = i + 1
                else:
                    spans.append([a, i + 1])
        return spans, found


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of BLOCK_WORDS words; a longer item is a block of its own. One block is on the driver at a time."""
    block: list[tuple[str | None, str]] = []
    size = 0
    for r in items.where("text is not null").toLocalIterator():
        n = len(words_of(r[1]))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        if n:
            block.append((r[0], r[1]))
            size += n
    yield block


def _scanner(sent: Broadcast, window: int):
    """The function of a text column that runs its words through the automaton of the items sent."""

    @arrow_udf(RESULT)
    def scan(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = SuffixAutomaton([(name, words_of(text)) for name, text in sent.value], window)
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("item_ids", pa.list_(pa.string()))])
        for texts in it:
            rows = []
            for text in texts.to_pylist():
                words = words_of(text)
                spans, found = automaton.scan(words)
                rows.append({"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in spans], "item_ids": sorted(x for x in found if x is not None)})
            yield pa.array(rows, kind)
        del automaton
        W.relax()

    return scan


def overlaps(docs: DataFrame, items: DataFrame, *, window: int = 13, into: str = "overlap") -> DataFrame:
    """docs with a column `into` of RESULT: words, hit spans (in words, end exclusive) and ids of items that hit.

    docs: any columns, text among them. items: item_id and text.
    """
    spark = docs.sparkSession
    ship(spark)
    out, parts = docs, []
    blocks = _item_blocks(items.select(F.col("item_id").cast("string"), F.col("text").cast("string")))
    for k, block in enumerate(blocks):
        sent = spark.sparkContext.broadcast(block)

        if k:
            out = table(out, f"overlap-{k}")
        name = into if k == 0 else f"__overlap_{k}"
        parts.append(name)
        out = out.withColumn(name, _scanner(sent, window)(F.col("text").cast("string")))
    if len(parts) > 1:
        spots = F.array_distinct(F.flatten(F.array(*(F.flatten(F.transform(F.col(p)["spans"], lambda s: F.sequence(s["start"], s["end"] - 1))) for p in parts))))
        names = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(p)["item_ids"] for p in parts)))))
        spans = F.transform(F.array_sort(spots), lambda p: F.struct(p.alias("start"), (p + 1).alias("end")))
        out = out.withColumn(into, F.struct(F.col(into)["n_words"].alias("n_words"), spans.alias("spans"), names.alias("item_ids"))).drop(*parts[1:])
    return out


def n_hit(overlap: str = "overlap"):
    return F.aggregate(F.col(overlap)["spans"], F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))


def contaminated(overlap: str = "overlap", share: int = 20):
    """Hit words are at least one in `share`."""
    return (n_hit(overlap) > 0) & (F.lit(share) * n_hit(overlap) >= F.col(overlap)["n_words"])


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 13, share: int = 20, cut: bool = False) -> DataFrame:
    """docs without those of which one word in `share` or more is hit; cut: hit words go from the others' texts, too.

    Documents without a hit stay as they are.
    """
    marked = overlaps(docs, items, window=window, into="__overlap").where(~contaminated("__overlap", share))
    if cut:

        @arrow_udf("string")
        def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
            import re

            out = []
            for text, cuts in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                if cuts:
                    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
                    for c in reversed(cuts):
                        text = text[: at[c["start"]][0]] + text[at[c["end"] - 1][1] :]
                out.append(text)
            return pa.array(out, pa.string())

        marked = marked.withColumn("text", without(F.col("text").cast("string"), F.col("__overlap")["spans"]))
    return marked.drop("__overlap")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return overlaps(docs, items).select(
        "doc_id",
        F.col("overlap.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("overlap.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, w, least(len(w), 13) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
grams AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b))),
hits AS (SELECT doc_id, i, grams.m, item_id FROM grams JOIN windows USING (m, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""
