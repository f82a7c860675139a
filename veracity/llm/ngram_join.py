"""Near-duplicate join on word n-grams with Bayesian candidate pruning.

1. Every text becomes its set of five-word shingles (64-bit hashes) and 96 MinHash values. Texts with
   equal sets collapse, first within a batch, then over all; the rest works on distinct sets.
2. Sets that share one of 24 bands of 4 values are candidates (a pair at the threshold is missed with
   probability (1 - 0.8^4)^24 < 4e-6). A large bucket is dealt out as pairs of blocks, so no task holds a
   whole bucket and no pair is a row.
3. Candidates compare their MinHash values step by step. A pair goes as soon as the posterior
   probability, from a flat prior, that its similarity reaches the threshold is below ``tolerance``.
   What stays joins sets into candidate components.
4. Within a component each set is written as its difference from one of them, the pivot, so a text crosses
   the network once and what is repeated for pairs of blocks is a signature and a short difference. Pairs that
   survive the same pruning are verified exactly: the intersection of two sets follows from the pivot's size and
   the intersection of their differences. Each set gets its number of links; the links' components are the classes.

The number of blocks of a bucket or component follows the tasks at hand, until a block has ``block`` sets; only
beyond that do the copies of a row grow with its group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, components, numbered, runs, slices, spread

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-9
BANDS, ROWS, STEP = 24, 4, 16
_rng = np.random.default_rng(20_240_501)
_A = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HIGH = np.uint64(1 << 63)


class WordHash(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, hashes: WordHash, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the windows of n words; a shorter text is one window, an empty one none."""
    words = text.split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    if not k:
        return w
    acc = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        acc = acc * _P + w[i : len(w) - k + 1 + i]
    acc ^= acc >> np.uint64(32)
    acc *= _Q
    acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def minhash(sh: np.ndarray) -> np.ndarray:
    """96 MinHash values (32 bits each) of a non-empty set."""
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    x = (sh >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i : i + 1024, None] * _A + _B).min(0), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, different between bands."""
    acc = np.arange(1, BANDS + 1, dtype=np.uint64) * _Q
    for column in values.reshape(BANDS, ROWS).T.astype(np.uint64):
        acc = (acc ^ column) * _P
        acc ^= acc >> np.uint64(29)
    return acc.view(np.int64)


def least_matches(threshold: float, tolerance: float, n: int = BANDS * ROWS, step: int = STEP) -> dict[int, int]:
    """For 16, 32, ... compared values, the fewest matches with P(similarity >= threshold | matches) >= tolerance.

    With a flat prior the posterior is Beta(m + 1, k - m + 1), whose upper tail is the chance of at most m
    successes in k + 1 trials.
    """
    out = {}
    for k in range(step, n + 1, step):
        tail = 0.0
        for m in range(k + 1):
            tail += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if tail >= tolerance:
                break
        out[k] = m
    return out


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that incremental comparison leaves."""
    m = np.zeros(len(a), np.int32)
    for k, need in least.items():
        m += (sig[a, k - STEP : k] == sig[b, k - STEP : k]).sum(1)
        ok = m >= need
        a, b, m = a[ok], b[ok], m[ok]
        if not len(a):
            break
    return a, b


def pairs_of(block: np.ndarray, i: int, j: int, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that the group (i, j) answers for, some rows at a time: all within block i, or those across i and j."""
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for k in range(0, len(left), rows):
        if i == j:
            a, b = np.triu_indices(min(rows, len(left) - k), 1, len(left) - k)
            yield left[k + a], left[k + b]
        else:
            own = left[k : k + rows]
            yield np.repeat(own, len(right)), np.tile(right, len(own))


def candidates(sig: np.ndarray, block: np.ndarray, i: int, j: int, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the group that incremental comparison leaves."""
    found = [surviving(sig, a, b, least) for a, b in pairs_of(block, i, j)] or [(np.zeros(0, np.int64),) * 2]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected with each of n."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the exact intersections of the pairs."""
    if len(a) <= 8:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    used, at = np.unique(np.r_[a, b], return_inverse=True)
    doc = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, col, n = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    shared = n >= 2  # what one set alone has is in no intersection
    col, doc = (np.cumsum(shared) - 1)[col[s := shared[col]]], doc[s]
    total = np.zeros((len(used), len(used)), np.float32)
    for c in range(0, int(shared.sum()), 4096):
        here = (col >= c) & (col < c + 4096)
        m = np.zeros((len(used), 4096), np.float32)
        m[doc[here], col[here] - c] = 1
        total += m @ m.T
    return total[at[: len(a)], at[len(a) :]].astype(np.int64)


def difference(own: np.ndarray, pivot: np.ndarray) -> tuple[bytes, bytes]:
    """(places in the pivot of what the set lacks, what the pivot lacks); both sets sorted, without repeats."""
    at = np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)
    both = pivot[at] == own
    lacks = np.ones(len(pivot), bool)
    lacks[at[both]] = False
    return np.flatnonzero(lacks).astype("<u4").tobytes(), own[~both].tobytes()


@dataclass
class Joined:
    """``classes``: a row for each input row. ``kept``: one whole row of each class."""

    classes: DataFrame
    kept: DataFrame


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = 1024, block_bytes: int = 8 << 20, scratch: Scratch | None = None) -> Joined:
    """Joins the documents whose five-word shingle sets have Jaccard similarity >= threshold.

    Classes: id, class_id (a number that the rows of one class share), class_size, n_links (how many other
    rows reach the threshold with this one), n_same (how many of them have the same shingle set), kept (one
    row a class: smallest id, null last). A text of one to four words is a single shingle; null and blank
    texts have no shingle, link with nothing and stay. Repeated rows link with each other. An empty table gives
    empty results. Other columns of the input are read only if named in ``carry``.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    carry = carry or []
    own = numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"c_{i}") for i, c in enumerate(carry))))
    own = scratch.save(own, "docs")
    least = least_matches(threshold, tolerance)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            first: dict[bytes, int] = {}
            n: list[int | None] = []
            rep, key, size, sig, keys = [], [], [], [], []
            for k, (rid, text) in enumerate(zip(b["_rid"].to_pylist(), as_bytes(b["_text"]), strict=True)):
                sh = shingles(text, hashes)
                digest = xxhash.xxh3_128_digest(sh.tobytes()) if len(sh) else b"%d" % rid
                at = first.setdefault(digest, k)
                rep.append(rid if at == k else rep[at])
                n.append(1 if at == k else None)
                size.append(len(sh))
                new = at == k and len(sh) > 0
                key.append(digest if at == k else None)
                values = minhash(sh) if new else None
                sig.append(values.astype(np.uint16).tobytes() if new else None)
                keys.append(band_keys(values) if new else None)
                if at != k:
                    n[at] += 1
            yield pa.RecordBatch.from_pydict({"_rid": b["_rid"], "_id": b["_id"], "_rep": pa.array(rep, pa.int64()), "_n": pa.array(n, pa.int64()), "_key": pa.array(key, pa.binary()), "_size": pa.array(size, pa.int32()), "_sig": pa.array(sig, pa.binary()), "_bands": pa.array(keys, pa.list_(pa.int64()))})

    ids = own.schema["_id"].dataType.simpleString()
    local = scratch.save(own.select("_rid", "_id", "_text").mapInArrow(sign, f"_rid long, _id {ids}, _rep long, _n long, _key binary, _size int, _sig binary, _bands array<long>"), "signed")
    reps = local.where("_n is not null")
    sets = reps.groupBy("_key").agg(F.min("_rid").alias("_set"), F.sum("_n").alias("_copies"))
    sets = scratch.save(reps.select("_rid", "_key").join(sets, "_key").select("_rid", "_set", "_copies"), "sets")
    unique = reps.where("_sig is not null").join(sets.where("_rid = _set").select("_rid"), "_rid", "left_semi")

    # candidates: blocks of each bucket against each other
    banded = scratch.save(unique.select(F.col("_rid").alias("node"), F.explode("_bands").alias("key")), "bands")
    buckets = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("_parts", _blocks(F.col("n"), tasks / BANDS, 128, block))
    dealt = _in_blocks(banded.join(buckets, "key").join(unique.select(F.col("_rid").alias("node"), "_sig"), "node").drop("n"), "key")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for (_, i, j), t in runs(batches, ["key", "_i", "_j"]):
            node, sig = t["node"].to_numpy(), _signatures(t)
            a, b = candidates(sig, t["_block"].to_numpy(), i, j, least)
            root = node[roots(len(node), a, b)]
            left.append(root[root != node])
            right.append(node[root != node])
            if len(left) >= 5000:
                yield _edges(left, right)
                left, right = [], []
        yield _edges(left, right)

    rows = spread(spark, banded.count(), 500_000)
    edges = dealt.repartition(rows, "key", "_i", "_j").sortWithinPartitions("key", "_i", "_j").mapInArrow(prune, "a long, b long")
    near = components(edges, scratch, "near")
    scratch.drop("bands")

    # verification: differences from the component's smallest node, then blocks against each other
    sized = near.join(unique.select(F.col("_rid").alias("node"), "_size", "_sig"), "node").join(sets.select(F.col("_rid").alias("node"), "_copies"), "node")
    slots = sized.groupBy("root").agg(F.ceil(F.count("*") / 64).cast("int").alias("_slots"))
    whole = sized.join(slots, "root").join(own.select(F.col("_rid").alias("node"), "_text"), "node")
    home = F.pmod(F.hash("node"), F.col("_slots"))
    pivot = F.col("node") == F.col("root")
    # a component of many slots has its pivot in each
    placed = whole.withColumn("_slot", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("_slots") - 1)).otherwise(F.array(home))))
    placed = placed.select("root", "_slot", "node", "_size", "_copies", "_sig", "_text", (~pivot).alias("_rest"), (F.col("_slot") == home).alias("_home"))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        base = np.zeros(0, np.uint64)
        for b in slices(batches, 512):
            lacks, more = [], []
            for rest, text in zip(b["_rest"].to_pylist(), as_bytes(b["_text"]), strict=True):
                sh = shingles(text, hashes)
                if not rest:
                    base = sh
                x, y = difference(sh, base)
                lacks.append(x)
                more.append(y)
            out = {c: b[c] for c in ("root", "node", "_size", "_copies", "_sig", "_home")}
            yield pa.RecordBatch.from_pydict(out | {"_lacks": pa.array(lacks, pa.binary()), "_more": pa.array(more, pa.binary()), "_base": pa.array(b["_size"].to_numpy() + [len(x) // 4 - len(y) // 8 for x, y in zip(lacks, more, strict=True)], pa.int64())})

    rows = spread(spark, reps.agg(F.sum("_size")).first()[0] or 0, 2_000_000)  # tasks of two million shingles
    placed = placed.repartition(rows, "root", "_slot").sortWithinPartitions("root", "_slot", "_rest")
    apart = placed.mapInArrow(differ, "root long, node long, _size int, _copies long, _sig binary, _home boolean, _lacks binary, _more binary, _base long")
    apart = scratch.save(apart.where("_home").drop("_home"), "apart")
    volume = F.sum(F.octet_length("_lacks") + F.octet_length("_more"))
    parts = apart.groupBy("root").agg(F.greatest(_blocks(F.count("*"), tasks, 16, block), F.ceil(volume / block_bytes).cast("int")).alias("_parts"))
    dealt = _in_blocks(apart.join(parts, "root"), "root")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), t in runs(batches, ["root", "_i", "_j"]):
            node, copies, size = (t[c].to_numpy() for c in ("node", "_copies", "_size"))
            a, b = candidates(_signatures(t), t["_block"].to_numpy(), i, j, least)
            lacks = [np.frombuffer(x, "<u4") for x in t["_lacks"].to_pylist()]
            apart = [np.r_[x.astype(np.uint64), np.frombuffer(y, np.uint64) | _HIGH] for x, y in zip(lacks, t["_more"].to_pylist(), strict=True)]
            own = t["_base"].to_numpy() - np.fromiter(map(len, lacks), np.int64, len(lacks))  # what a set has of the pivot
            both = own[a] + own[b] - t["_base"].to_numpy()[a] + overlaps(apart, a, b)
            ok = both / (size[a] + size[b] - both) >= threshold if len(a) else np.zeros(0, bool)
            a, b = a[ok], b[ok]
            links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
            yield pa.RecordBatch.from_pydict({"a": pa.array(node[roots(len(node), a, b)]), "b": pa.array(node), "links": pa.array(links.astype(np.int64))})

    links = dealt.repartition(rows, "root", "_i", "_j").sortWithinPartitions("root", "_i", "_j").mapInArrow(verify, "a long, b long, links long")
    links = scratch.save(links, "links")
    linked = components(links, scratch, "linked")
    scratch.drop("apart")

    # from sets to rows, by way of the batches' representatives
    total = links.groupBy(F.col("b").alias("_set")).agg(F.sum("links").alias("_links"))
    each = sets.join(linked.select(F.col("node").alias("_set"), "root"), "_set", "left").join(total, "_set", "left")
    each = each.select(F.col("_rid").alias("_rep"), F.coalesce("root", "_set").alias("_class"), "_copies", F.coalesce("_links", F.lit(0)).alias("_links"))
    each = scratch.save(local.select("_rid", "_id", "_rep").join(each, "_rep"), "rows")
    best = F.min(F.struct(F.col("_id").isNull(), F.col("_id").alias("id"), F.col("_rid").alias("rid")))
    # written, so that the join below deals out its own sides and AQE can split a large class
    classes = scratch.save(each.groupBy("_class").agg(F.count("*").alias("_size"), best.alias("_best")), "classes")
    for name in scratch.names() - {"docs", "rows", "classes"}:  # what the results read
        scratch.drop(name)
    out = each.join(classes, "_class").select(
        F.col("_id").alias(id_col), F.col("_class").alias("class_id"), F.col("_size").alias("class_size"), (F.col("_links") + F.col("_copies") - 1).alias("n_links"), (F.col("_copies") - 1).alias("n_same"), (F.col("_rid") == F.col("_best.rid")).alias("kept"),
    )
    kept = own.join(classes.select(F.col("_best.rid").alias("_rid")), "_rid", "left_semi")
    return Joined(out, kept.select(*([F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)] or [F.col("_id").alias(id_col), F.col("_text").alias(text_col)])))


def _blocks(n: Column, tasks: float, least: int, most: int) -> Column:
    """Blocks of a group of n sets: as many as give each of the tasks some pairs of blocks, but of ``least`` sets, unless that
    makes blocks of more than ``most``."""
    some = max(1, math.ceil(2 * math.sqrt(tasks)))
    return F.greatest(F.ceil(n / most), F.least(F.lit(some), F.ceil(n / least))).cast("int")


def _in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Deals the rows of a key into ``_parts`` blocks and repeats each for every pair of blocks it is in."""
    rows = rows.withColumn("_block", F.pmod(F.hash("node"), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("_parts") - 1).cast("int"))))
    return rows.withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other")).drop("_other", "_parts")


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["_sig"].to_pylist()), np.uint16).reshape(t.num_rows, -1)


def _edges(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(left or none)), "b": pa.array(np.concatenate(right or none))})
