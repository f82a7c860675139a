"""Stupid-backoff scores of every document against the n-gram counts of all other documents.

1. Documents are dealt into batches and written. Each batch explodes its n-grams (64-bit hashes, orders 1 to
   ``order``), counts them, and sends each hash partition of the count table one block of sorted hashes and counts.
2. The count table is partitioned by hash. A partition sums the counts of equal n-grams over its blocks and joins
   the sums with the blocks again: each gets what the other batches have. Frequent n-grams cost one entry a batch,
   however often they occur.
3. The answers join their batches' documents, whose n-grams are exploded again and scored, and are summed per
   document. A document's own occurrences are taken out of every count, else each n-gram would be known.

Batches and partitions both grow with the square root of the input, so that a block keeps about ``block`` n-grams
and the number of blocks is linear in the input, until they reach ``most_bytes``; from there on (about 3 TB of text)
blocks get smaller as the input grows. What is gathered is every n-gram of every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, as_bytes, runs, spread

WHITE = np.zeros(256, bool)
WHITE[list(SPACE)] = True
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of the texts in order, number of words of each text). Each distinct word is hashed once."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    white = WHITE[data]
    new = np.ones(len(data), bool)
    new[1:] = white[:-1]
    new[(np.cumsum(size) - size)[size > 0]] = True
    new &= ~white
    first = np.flatnonzero(new)
    stop = np.cumsum(size)
    words = np.searchsorted(first, stop) - np.searchsorted(first, stop - size)
    visible = ~white
    at = np.append(np.flatnonzero(np.compress(visible, new)), int(visible.sum())).astype(np.int32)
    units = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.compress(visible, data))]).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, units.dictionary.to_pylist()), np.uint64, len(units.dictionary))
    return known[units.indices.to_numpy()], words


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words, from each position but the last k - 1; windows may reach into the next text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, k, np.uint64)
    for i in range(k):
        acc = acc * _P + words[i : n + i]
    acc ^= acc >> np.uint64(32)
    acc *= _Q
    return acc ^ (acc >> np.uint64(29))


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so the empty ones vanish under zstandard."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def unpack(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(flat.T).reshape(-1).view(kind)


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Positions in the order of their keys, equal keys by position. Sorts the keys' upper bits with the position in the
    lower ones, which is several times faster than a stable argsort; keys that differ in their lower bits only are
    rare, seen afterwards, and then sorted the slow way."""
    bits = np.uint64(max(1, int(len(keys)).bit_length()))
    mixed = (keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64)
    mixed.sort()
    order = (mixed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    found = keys[order]
    if len(found) and ((found[1:] >> bits == found[:-1] >> bits) & (found[1:] != found[:-1])).any():
        return np.argsort(keys, kind="stable")
    return order


@dataclass
class Counts:
    """The n-grams of one order in one batch: distinct hashes (sorted), their counts, and of each window, in order,
    which one it is, how often its text has it, and the word it ends on."""

    distinct: np.ndarray
    n: np.ndarray
    which: np.ndarray
    own: np.ndarray
    last: np.ndarray


def count_grams(words: np.ndarray, doc: np.ndarray, k: int) -> Counts:
    """``doc``: the text of each word; windows within one text count."""
    size = max(0, len(words) - k + 1)
    last = np.flatnonzero(doc[k - 1 :] == doc[:size]) + k - 1 if size else np.zeros(0, np.int64)
    keys = grams(words, k)[last - k + 1]
    order = stable_order(keys)
    sorted_, docs = keys[order], doc[last][order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    first = np.flatnonzero(new)
    which = np.empty(len(order), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    new[1:] |= docs[1:] != docs[:-1]
    runs_ = np.flatnonzero(new)
    long = np.diff(np.append(runs_, len(order)))
    own = np.empty(len(order), np.int32)
    own[order] = np.repeat(long, long)
    return Counts(sorted_[first], np.diff(np.append(first, len(order))), which, own, last)


def scores(found: list[Counts], totals: list[np.ndarray], words: np.ndarray, tokens: int, backoff: float) -> np.ndarray:
    """Sum of log10 scores of each text. ``found`` by order from 1; ``totals``: counts of their distinct n-grams in all
    texts; ``words``: words of each text; ``tokens``: words of all."""
    order, step = len(found), np.log10(backoff)
    start = np.cumsum(words) - words
    longest = np.minimum(np.arange(int(words.sum())) - np.repeat(start, words), order - 1)  # words of context at hand
    rest = np.repeat(np.maximum(tokens - words, 1), words)
    seen = [np.zeros(len(longest), np.int64) for _ in found]  # counts elsewhere of the window that ends on each word
    for k, (c, total) in enumerate(zip(found, totals, strict=True)):
        seen[k][c.last] = total[c.which] - c.own
    value = np.log10(np.maximum(seen[0], 1) / rest) + (longest + (seen[0] == 0)) * step
    for k in range(1, order):
        at = np.flatnonzero(seen[k] > 0)
        value[at] = np.log10(seen[k][at] / seen[k - 1][at - 1]) + (longest[at] - k) * step
    return np.add.reduceat(np.append(value, 0.0), start) * (words > 0) if len(words) else np.zeros(0)


def sized(volume: int, block: int, most: int, least: int = 8 << 20, word: float = 6.4) -> int:
    """Bytes of a batch and of a partition such that a block, which is where the two meet, has so many n-grams."""
    return int(min(most, max(least, (block * word * volume) ** 0.5)))


def lm_scores(docs: DataFrame, *, order: int = 3, backoff: float = 0.4, batch_bytes: int | None = None, block: int = 1000, most_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: id, n_words, log10_score (sum over its words), mean_log10.

    A word scores the relative frequency of the longest n-gram that other rows have, times ``backoff`` for
    each order that had to be given up; a word that no other row has counts as seen once, at one order less
    still. A null text is an empty one: score 0, mean null. Repeated rows know each other. Other columns are not
    read. ``batch_bytes``: text in a batch and a partition, else chosen by the input's size.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = own.schema["_id"].dataType.simpleString()
    volume = own.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    batch_bytes = batch_bytes or sized(volume, block, most_bytes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, size = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        arrow = pa.null()
        texts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            sizes, blob = np.array(list(map(len, texts)), "<i8"), zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_pydict({"_batch": pa.array([part << 32 | k], pa.int64()), "_ids": pa.array([ids], pa.list_(arrow)), "_sizes": pa.array([sizes.tobytes()], pa.binary()), "_blob": pa.array([blob], pa.binary()), "_words": pa.array([sum(len(t.split()) for t in texts)], pa.int64())})

        for b in batches:
            arrow = b["_id"].type
            for ident, t in zip(b["_id"].to_pylist(), as_bytes(b["_text"]), strict=True):
                if texts and size + len(t) > batch_bytes:
                    yield flush()
                    k, size, ids, texts = k + 1, 0, [], []
                ids.append(ident)
                texts.append(t)
                size += len(t) + 32
        if texts:
            yield flush()

    # a batch is one row, so whatever reads the table has batches whole
    dealt = scratch.save(own.mapInArrow(deal, f"_batch long, _ids array<{kind}>, _sizes binary, _blob binary, _words long"), "batches")
    tokens = dealt.agg(F.sum("_words")).first()[0] or 0
    bits = max(1, int(np.ceil(np.log2(max(1, volume / batch_bytes)))))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, sizes, blob in zip(b["_batch"].to_pylist(), b["_sizes"], b["_blob"], strict=True):
                words, per = word_hashes(_texts(sizes.as_py(), blob.as_py()))
                doc = np.repeat(np.arange(len(per), dtype=np.int32), per)
                for k in range(1, order + 1):
                    c = count_grams(words, doc, k)
                    cuts = np.searchsorted(c.distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                    rows = [(p, a, e) for p, (a, e) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) if a < e]
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([p for p, _, _ in rows], pa.int64()), "batch": pa.array([batch] * len(rows), pa.int64()), "k": pa.array([k] * len(rows), pa.int32()),
                        "keys": pa.array([pack(np.diff(c.distinct[a:e], prepend=np.uint64(0))) for _, a, e in rows], pa.binary()), "n": pa.array([pack(c.n[a:e].astype(np.uint32)) for _, a, e in rows], pa.binary()),
                    })

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, ["part"]):
            keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in t["keys"].to_pylist()]
            n = [unpack(x, np.uint32) for x in t["n"].to_pylist()]
            every, m = np.concatenate(keys), np.concatenate(n).astype(np.int64)
            by_key = stable_order(every)
            found = every[by_key]
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
            sums = np.add.reduceat(m[by_key], np.flatnonzero(new))
            others = np.empty_like(m)
            others[by_key] = sums[np.cumsum(new) - 1]
            others -= m
            stop = np.cumsum(list(map(len, keys))).tolist()
            blocks_ = [pack(others[i:j]) for i, j in zip([0, *stop], stop, strict=False)]
            yield pa.RecordBatch.from_pydict({"_batch": t["batch"].combine_chunks(), "_part": t["part"].combine_chunks(), "_k": t["k"].combine_chunks(), "_others": pa.array(blocks_, pa.binary())})

    blocks = dealt.select("_batch", "_sizes", "_blob").mapInArrow(explode, "part long, batch long, k int, keys binary, n binary")
    counted = blocks.repartition(spread(spark, 1 << bits, 1), "part").sortWithinPartitions("part")
    answers = scratch.save(counted.mapInArrow(count, "_batch long, _part long, _k int, _others binary"), "answers")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, ["_batch"]):  # first the documents (order 0), then the answers by order and part
            words, per = word_hashes(_texts(t["_sizes"][0].as_py(), t["_blob"][0].as_py()))
            doc = np.repeat(np.arange(len(per), dtype=np.int32), per)
            found = [count_grams(words, doc, k) for k in range(1, order + 1)]
            which, blocks = t["_k"].to_pylist(), t["_others"].to_pylist()
            totals = [c.n + np.concatenate([np.zeros(0, np.int64), *(unpack(x, np.int64) for w, x in zip(which, blocks, strict=True) if w == k)]) for k, c in enumerate(found, 1)]
            value = scores(found, totals, per, tokens, backoff)
            mean = pa.array(value / np.maximum(per, 1), mask=per == 0)
            yield pa.RecordBatch.from_pydict({id_col: t["_ids"][0].values, "n_words": pa.array(per.astype(np.int64)), "log10_score": pa.array(value), "mean_log10": mean})

    null = lambda kind: F.lit(None).cast(kind)
    texts = dealt.select("_batch", F.lit(-1).cast("long").alias("_part"), F.lit(0).alias("_k"), "_ids", "_sizes", "_blob", null("binary").alias("_others"))
    replies = answers.select("_batch", "_part", "_k", null(f"array<{kind}>").alias("_ids"), null("binary").alias("_sizes"), null("binary").alias("_blob"), "_others")
    joined = texts.union(replies).repartition(spread(spark, volume, 2 * batch_bytes), "_batch").sortWithinPartitions("_batch", "_k", "_part")
    return joined.mapInArrow(score, f"`{id_col}` {kind}, n_words long, log10_score double, mean_log10 double")


def _texts(sizes: bytes, blob: bytes) -> list[bytes]:
    stop = np.cumsum(np.frombuffer(sizes, "<i8")).tolist()
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return [raw[a:e] for a, e in zip([0, *stop], stop, strict=False)]
