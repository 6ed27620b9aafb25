"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words and the words' openings, hashed to 32 bits. Document frequencies in
labelled texts pick the terms that part the classes; the machine learns a weight for each and a vector for each, whose
products are the pairs' weights, so that two terms together can count for more than both alone. It is fitted with
AdaGrad on the driver, on SAMPLE labelled rows at most (those whose id hashes lowest); scoring covers all rows.

Null and empty texts hold no terms and get the score of the bias alone. Labels other than 0 and 1 and labels of absent
documents are left out; a document with several labels counts as toxic if one of them says so. Without both labels the
score is 0 for all. Rows are scored one by one. A column of the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from foliospark.llm import words as W
from foliospark.llm.decontaminate import words_of
from foliospark.sources.runtime import ship

#: Labelled rows that the model is fitted on, at most; terms that it knows, at most; lengths of openings.
SAMPLE, TERMS, OPENINGS = 20_000, 4096, (4, 5)
FACTORS, EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 8, 12, 1500, 64, 0.08, 1e-4, 7
#: Words whose terms a worker remembers.
HELD = 400_000


def terms_of(word: bytes) -> tuple[int, ...]:
    text = word.decode("utf-8", "replace")
    return (crc32(word), *(crc32(b"^" + text[:n].encode()) for n in OPENINGS if len(text) > n))


@dataclass
class Model:
    bias: float = 0.0
    terms: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))
    empty: bool = True

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for n, x in enumerate(rows):
            if len(x):
                v = self.vectors[x]
                out[n] += self.weights[x].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum()
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.zeros(len(rows)) if self.empty else 1 / (1 + np.exp(-np.clip(self.raw(rows), -40, 40)))


def _features(known: Broadcast | None):
    """The function of a text column that gives its terms: hashes, or the numbers of those known."""

    @arrow_udf("array<long>")
    def features(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number = known.value if known else None
        for texts in it:
            rows = []
            for text in texts.to_pylist():
                terms = {t for w in set(words_of(text)) for t in terms_of(w)}
                rows.append(sorted(terms if number is None else (number[t] for t in terms if t in number)))
            yield pa.array(rows, pa.list_(pa.int64()))
        W.relax()

    return features


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    ship(spark)
    chosen = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # SAMPLE rows of two numbers: a proven bound
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    counts = rows.select("toxic", F.explode(F.concat(F.array(F.lit(-1).cast("long")), _features(None)("text"))).alias("term")).groupBy("term").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"))
    whole = counts.where("term = -1").collect()
    if not whole or not 0 < whole[0]["p"] < whole[0]["n"]:
        return Model()
    p, n = whole[0]["p"], whole[0]["n"]
    rate = p / n
    # standard scores of a term's toxic documents against those expected, by sign
    z = (F.col("p") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    best = counts.where("term >= 0 and n >= 2").select("term", z.alias("z")).where("abs(z) > 2.5").orderBy(F.desc(F.abs("z")), "term").limit(TERMS).collect()
    known = {r["term"]: i for i, r in enumerate(best)}
    sent = spark.sparkContext.broadcast(known)
    data = rows.select("doc_id", "toxic", _features(sent)("text").alias("x")).collect()
    data.sort(key=lambda r: (r[0], r[1], r[2]))
    return _train([np.array(r["x"], np.int64) for r in data], np.array([r["toxic"] for r in data], float), known)


def _train(rows: list[np.ndarray], y: np.ndarray, known: dict[int, int]) -> Model:
    rng = np.random.default_rng(SEED)
    m = Model(float(np.log(y.mean() / (1 - y.mean()))), known, np.zeros(len(known)), rng.normal(0, 0.01, (len(known), FACTORS)), False)
    gw, gv, gb = np.full(len(known), 1e-6), np.full((len(known), FACTORS), 1e-2), 1e-6
    for _ in range(max(EPOCHS, STEPS * BATCH // len(rows))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            lengths = np.array([len(rows[i]) for i in batch])
            x = np.concatenate([rows[i] for i in batch])
            doc = np.repeat(np.arange(len(batch)), lengths)
            v = m.vectors[x]
            sums = np.zeros((len(batch), FACTORS))
            np.add.at(sums, doc, v)
            squares = np.zeros(len(batch))
            np.add.at(squares, doc, (v**2).sum(1))
            raw = m.bias + np.bincount(doc, m.weights[x], len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            err = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[batch]
            touched, back = np.unique(x, return_inverse=True)
            dw = np.bincount(back, err[doc], len(touched)) / len(batch) + DECAY * m.weights[touched]
            dv = np.zeros((len(touched), FACTORS))
            np.add.at(dv, back, err[doc][:, None] * (sums[doc] - v))
            dv = dv / len(batch) + DECAY * m.vectors[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            gb += err.mean() ** 2
            m.weights[touched] -= RATE * dw / np.sqrt(gw[touched])
            m.vectors[touched] -= RATE * 0.25 * dv / np.sqrt(gv[touched])
            m.bias -= RATE * err.mean() / gb**0.5
    return m


def _scorer(sent: Broadcast):
    @arrow_udf("double")
    def score(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model: Model = sent.value
        held: dict[bytes, tuple[int, ...]] = {}
        for texts in it:
            rows = []
            for text in texts.to_pylist():
                x: set[int] = set()
                for w in set(words_of(text)):
                    known = held.get(w)
                    if known is None:
                        if len(held) >= HELD:
                            held.clear()
                        known = held[w] = tuple(model.terms[t] for t in terms_of(w) if t in model.terms)
                    if known:
                        x.update(known)
                rows.append(np.array(sorted(x), np.int64))
            yield pa.array(model.score(rows), pa.float64())
        held.clear()
        W.relax()

    return score


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a column `into`: the probability that a text is toxic."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(into, _scorer(sent)(F.col(text).cast("string")))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learnt from: a fifth, by the id; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return fit(docs.where(~held_out()), labels.where(~held_out()))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, fit_tables(spark, docs, sf_dir), into="score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
