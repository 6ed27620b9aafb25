"""Word tables in packed form: what documents of a block have in common travels once, by bucket of the word's hash.

A block is some consecutive documents of one partition, of BLOCK_BYTES of text or one longer document. Its distinct
words are ranked by frequency; a document is then an array of ranks. The words leave the block in one packed row a
bucket, so every task that owns a bucket sees each of its words from all blocks and treats it once, and the answers
return by block. Rows moved: blocks x buckets, whatever the number of words.
"""

from __future__ import annotations

import collections
import ctypes
import gc
import struct
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from foliospark.sources.runtime import plan_bytes

#: Text of a block, and of a bucket's share of the input as Catalyst sees it. More buckets than MOST_BUCKETS would
#: only make packed rows too small; a bucket's words are then held by fewer, larger dictionaries.
BLOCK_BYTES, BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 8 << 20, 4096

#: Input of a task that works on packed rows, and of a piece that rows are dealt in, in bytes of files.
TASK_BYTES, SHARE_BYTES = 24 << 20, 1 << 20

#: Text of documents whose words are split at once.
SPLIT_BYTES = 1 << 18

#: Sizes from here on stand for those that are not known.
NO_ESTIMATE = 1 << 60

#: Words of documents that travel in one row.
CHUNK_WORDS = 300_000

#: kind 0: packed words of (block, bucket), or answers to them; kind 1: documents of the block, bucket being their
#: order. once: the block's first rank of words that stand once.
SCHEMA = "block long, bucket int, kind int, once int, data binary"


def relax() -> None:
    """Give memory back: at a task's end, as the worker goes on to other tasks or waits beside those that do, and before
    a task that needs much."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tasks_for(docs: DataFrame, share: int | None = None) -> int:
    """Tasks that packed words and documents are dealt to, by the input's bytes; the session's number of shuffle
    partitions if Catalyst has no estimate of these."""
    size = plan_bytes(docs)
    return max(8, size // (share or TASK_BYTES)) if size < NO_ESTIMATE else int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(docs: DataFrame) -> DataFrame:
    """docs, dealt to all cores if they come in fewer pieces though each would get SHARE_BYTES of files or more."""
    wanted = min(docs.sparkSession.sparkContext.defaultParallelism, plan_bytes(docs) // SHARE_BYTES)
    return docs.repartition(wanted) if docs.rdd.getNumPartitions() < wanted else docs


def buckets_for(docs: DataFrame) -> int:
    return max(24, min(MOST_BUCKETS, plan_bytes(docs) // BUCKET_BYTES))


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings, one after the other, compressed."""
    out = []
    for a in arrays:
        raw = a if isinstance(a, bytes) else a.dtype.str.encode() + a.tobytes()
        out.append(struct.pack("<I?", len(raw), isinstance(a, bytes)) + raw)
    return zstandard.compress(b"".join(out), 3)


def unpack(blob: bytes) -> list:
    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        n, is_bytes = struct.unpack_from("<I?", raw, at)
        at += 5
        out.append(raw[at : at + n] if is_bytes else np.frombuffer(raw[at + 3 : at + n], raw[at : at + 3].decode()))
        at += n
    return out


def pack_words(words: list[bytes], *arrays: np.ndarray) -> bytes:
    return pack(b"".join(words), np.fromiter(map(len, words), "<u4", len(words)), *arrays)


def unpack_words(blob: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    text, lengths, *arrays = unpack(blob)
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else [], arrays


def pack_docs(docs: list[tuple[int | None, int, np.ndarray, np.ndarray]]) -> bytes:
    """Ids, flags, ranks and extras of documents. Frequent ranks take a byte, others four more; the streams apart."""
    ranks = np.concatenate([d[2] for d in docs])
    low = np.minimum(ranks, 255).astype("|u1")
    rest = (ranks[ranks >= 255] - 255).astype("<u4")
    ids = np.array([d[0] or 0 for d in docs], "<i8")
    extras = np.concatenate([d[3] for d in docs]).astype("<f8")
    return pack(ids, np.array([d[0] is None for d in docs], "|u1"), np.array([d[1] for d in docs], "|u1"), np.array([len(d[2]) for d in docs], "<u4"), extras, low, *((rest >> shift & 0xFF).astype("|u1") for shift in (0, 8, 16, 24)))


def unpack_docs(blob: bytes, once: int, seen: int) -> Iterator[tuple[int | None, int, np.ndarray, np.ndarray]]:
    """once: the first rank of the words that stand once in the block; seen: how many of those came before."""
    ids, null, flags, lengths, extras, low, *rest = unpack(blob)
    ranks = low.astype(np.int64)
    ranks[low == 255] += sum(x.astype(np.int64) << 8 * i for i, x in enumerate(rest))
    ranks -= 1
    new = np.flatnonzero(ranks < 0)
    ranks[new] = once + seen + np.arange(len(new))
    parts = np.split(ranks, np.cumsum(lengths[:-1], dtype=np.int64))
    return zip((None if n else i for i, n in zip(ids.tolist(), null.tolist(), strict=True)), flags.tolist(), parts, extras.reshape(len(ids), -1), strict=True)


def split_blocks(docs: DataFrame, words_of: Callable[[str], list[bytes]], flag_of: Callable[[int | None], int], buckets: int, weigh: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of SCHEMA from docs (doc_id long, text string; a null text has the words of an empty one; extra array<double>,
    if there: numbers that travel with the document, equally many of each).

    weigh: packed words carry how often each stands in the block's documents of flag 1, too. block_bytes: text of a block;
    smaller ones take less memory and move more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 24, 0
        # a new word's number is that of the words before it
        ids: collections.defaultdict[bytes, int] = collections.defaultdict()
        ids.default_factory = ids.__len__
        docs_of: list[tuple[int | None, int, np.ndarray, np.ndarray]] = []
        size = 0
        relax()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, size
            names = list(ids)
            count = np.zeros(len(names), np.int64)
            seen = np.zeros(len(names), np.int64)
            for _, flag, x, _ in docs_of:
                n = np.bincount(x, minlength=len(names)) if len(x) > len(names) // 8 else None
                if n is None:
                    np.add.at(count, x, 1)
                    if flag == 1:
                        np.add.at(seen, x, 1)
                else:
                    count += n
                    if flag == 1:
                        seen += n
            # words that stand once are numbered as they come, so that their documents needn't name them
            rank = np.empty(len(names), np.int64)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(names))
            once = int((count > 1).sum())
            where = np.fromiter((crc32(w) % buckets for w in names), np.int64, len(names))
            order = np.lexsort((rank, where))
            rows = []
            for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(order) else []:
                steps = np.diff(rank[part], prepend=0).astype("<u4")
                rows.append((base + seq, int(where[part[0]]), 0, once, pack_words([names[i] for i in part.tolist()], steps, *([seen[part].astype("<u4")] if weigh else []))))
            chunk, length, n = [], 0, 0
            for doc_id, flag, x, more in docs_of:
                r = rank[x]
                chunk.append((doc_id, flag, np.where(r >= once, 0, r + 1), more))
                length += len(x) + 16
                if length >= CHUNK_WORDS:
                    rows.append((base + seq, n, 1, once, pack_docs(chunk)))
                    chunk, length, n = [], 0, n + 1
            if chunk:
                rows.append((base + seq, n, 1, once, pack_docs(chunk)))
            seq, size = seq + 1, 0
            ids.clear()
            docs_of.clear()
            for at in range(0, len(rows), 256):
                yield batch_of(rows[at : at + 256])

        for group in _groups(batches, SPLIT_BYTES):
            words = [words_of(text) for _, text, _ in group]
            for (doc_id, text, more), own in zip(group, words, strict=True):
                x = np.fromiter(map(ids.__getitem__, own), np.int32, len(own))
                docs_of.append((doc_id, flag_of(doc_id), x, more))
                size += len(text) + 64
                if size >= block_bytes:
                    yield from flush()
        if docs_of:
            yield from flush()
        relax()

    extra = ["extra"] if "extra" in docs.columns else []
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text", *extra).mapInArrow(run, SCHEMA)


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int | None, str, np.ndarray]]]:
    """Documents, so many bytes of text or one longer one at once, and their extras."""
    for batch in batches:
        group, size = [], 0
        extras = np.stack(batch.column(2).to_numpy(zero_copy_only=False)) if batch.num_columns > 2 and batch.num_rows else np.zeros((batch.num_rows, 0))
        for doc_id, text, more in zip(batch.column(0), batch.column(1), extras, strict=True):
            group.append((doc_id.as_py(), text.as_py() or "", more))
            size += len(group[-1][1])
            if size >= most:
                yield group
                group, size = [], 0
        if group:
            yield group


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = [("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("once", pa.int32()), ("data", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], names=[n for n, _ in types])


def by_bucket(rows: DataFrame, run: Callable[[Iterator[tuple]], Iterator[tuple]], tasks: int) -> DataFrame:
    """Deal packed words by bucket; run gets a task's rows as tuples, by kind, and yields rows of SCHEMA."""
    return _stream(rows.repartition(tasks, "bucket").sortWithinPartitions("kind", "bucket"), run)


def _stream(rows: DataFrame, run: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in run(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            out.append(row)
            if len(out) >= 256:
                yield batch_of(out)
                out.clear()
        if out:
            yield batch_of(out)
        relax()

    return rows.mapInArrow(go, SCHEMA)


def by_block(rows: DataFrame, start: Callable[[], object], add: Callable[[object, bytes], None], finish: Callable[[object, int | None, int, np.ndarray, np.ndarray], tuple], fields: list[tuple[str, pa.DataType]], schema: str, tasks: int) -> DataFrame:
    """Bring answers back to their blocks: start() makes a block's table, add() fills in a packed answer, and
    finish(table, doc_id, flag, ranks, extra) gives the row of a document. ranks: of each of its words."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, seen = None, None, 0
        for b in batches:
            for n, _, kind, once, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n != block:
                    block, held, seen = n, start(), 0
                if kind == 0:
                    add(held, data)
                else:
                    out = []
                    for doc_id, flag, ranks, extra in unpack_docs(data, once, seen):
                        out.append(finish(held, doc_id, flag, ranks, extra))
                        seen += int((ranks >= once).sum())
                    yield _rows(out, fields)
        held = None
        relax()

    return rows.repartition(tasks, "block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(go, schema)


def _rows(out: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])
