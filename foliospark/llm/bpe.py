"""Byte-level BPE by a distinct-word table.

Texts are split into words in Spark; each distinct word reaches the tokenizer once, by bucket of its hash; its ids
return to the places where the word stands. Decoding joins ids to the vocabulary's pieces.

Null texts count as empty. A repeated row is encoded again, on its own; a null id stays null. A very long text is a block
of its own. Nothing ties. Columns other than the two named are not read.
An empty table gives an empty result. A special token's string in a text becomes its id, as the tokenizers library
does it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import words as W
from foliospark.sources.runtime import ship, table

#: A task's dictionary of words is emptied at this many; a word met again is then encoded again.
WORDS_HELD = 1_500_000


@lru_cache(maxsize=2)
def _model(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[list[bytes], list[str]]:
    """The vocabulary as bytes by id, and the special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the byte alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ids = spec["model"]["vocab"] | {a["content"]: a["id"] for a in spec["added_tokens"]}
    pieces = [b""] * (max(ids.values()) + 1)
    for piece, i in ids.items():
        pieces[i] = bytes(chars[c] for c in piece) if all(c in chars for c in piece) else piece.encode()
    return pieces, [a["content"] for a in spec["added_tokens"]]


def _pre_tokenizer(path: str):
    """The tokenizer's own split, without its vocabulary: tasks that split hold none."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"] |= {"vocab": {}, "merges": []}
    return Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None, "decoder": None})).pre_tokenizer


@lru_cache(maxsize=2)
def _splitter(path: str):
    import regex

    # the split of byte-level vocabularies, a fixed value
    words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    special = _pieces(path)[1]
    parts = regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")") if special else None

    # up to here the categories of this module and of the tokenizer's are the same; later ones differ by Unicode version
    late = regex.compile("[^\\x00-\u0557]")
    own = _pre_tokenizer(path)

    def plain(text: str) -> list[bytes]:
        if late.search(text):
            return [text[a:b].encode() for _, (a, b) in own.pre_tokenize_str(text)]
        return [w.encode() for w in words.findall(text)]

    def split(text: str) -> list[bytes]:
        if parts is None or not any(s in text for s in special):
            return plain(text)
        out = []
        for part in parts.split(text):
            out += [part.encode()] if part in special else plain(part)
        return out

    return split


def encode(docs: DataFrame, tokenizer: str, *, block_bytes: int = W.BLOCK_BYTES) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string, from the ids alone) of docs (doc_id, text).

    tokenizer: path of a byte-level tokenizer file, at the same place on every executor. block_bytes: text of a block.
    """
    ship(docs.sparkSession)

    def split(text: str) -> list[bytes]:
        return _splitter(tokenizer)(text)

    def answer(rows: Iterator[tuple]) -> Iterator[tuple]:
        t = _model(tokenizer)
        known: dict[bytes, bytes] = {}
        for block, bucket, _, once, data in rows:
            words, (steps,) = W.unpack_words(data)
            new = [w for w in words if w not in known]
            if len(known) + len(new) > WORDS_HELD:
                known.clear()
                new = words
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                for w, e in zip(part, t.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, "<u4").tobytes()
            ids = [known[w] for w in words]
            flat = np.frombuffer(b"".join(ids), "<u4")
            yield block, bucket, 0, once, W.pack(steps, np.fromiter((len(x) // 4 for x in ids), "<u4", len(ids)), flat.astype("<u2") if not len(flat) or flat.max() < 1 << 16 else flat)

    def add(held: list, data: bytes) -> None:
        steps, lengths, ids = W.unpack(data)
        held.append((np.cumsum(steps, dtype=np.int64), lengths.astype(np.int64), ids.astype(np.int32)))

    def finish(held: list, doc_id: int | None, _: int, ranks: np.ndarray, __: np.ndarray) -> tuple:
        if len(held) > 1 or held and len(held[0]) == 3:
            # the block's words are complete: each word's ids, by rank, in one array
            words, lengths, ids = (np.concatenate([x[i] for x in held]) for i in range(3))
            first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            first[words], size[words] = np.cumsum(lengths) - lengths, lengths
            held[:] = [(first, size, ids, None)]
        if not len(ranks):
            return doc_id, np.zeros(0, np.int32), ""
        first, size, ids, _ = held[0]
        n = size[ranks]
        at = np.arange(n.sum()) + np.repeat(first[ranks] - np.cumsum(n) + n, n)
        pieces = _pieces(tokenizer)[0]
        return doc_id, ids[at], b"".join(map(pieces.__getitem__, ids[at].tolist())).decode("utf-8", "replace")

    docs = W.dealt(docs.select("doc_id", "text"))
    tasks = W.tasks_for(docs)
    parts = table(W.split_blocks(docs, split, lambda _: 0, W.buckets_for(docs), block_bytes=block_bytes), "bpe-words", "bpe")
    ids = W.by_bucket(parts.where("kind = 0"), answer, tasks)
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    return W.by_block(ids.unionByName(parts.where("kind = 1")), list, add, finish, fields, "doc_id long, ids array<int>, decoded string", tasks)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode(docs, default_tokenizer()))
