"""Exact deduplication by distributed MSD radix partitioning.

Two texts are equal when their UTF-8 bytes without ASCII white space are equal.  Texts are split by
successive bytes until a group is a singleton or its texts have ended; no digest decides equality.

1. Each Arrow batch is split in place, so copies that lie together leave one representative.
2. The representatives' leading chunks are counted.  A heavy prefix, which more than ``uneven`` times the rows of
   a task or ``heavy_bytes`` bytes share, is split by its next, longer chunk, again and again.  The driver holds the heavy
   prefixes only, ``most_heavy`` of them a level at most, the greatest first; beyond that, buckets of at most
   (all bytes / most_heavy) stay whole.  A heavy prefix whose texts have ended is one class and needs no further
   comparison or gathering.
3. The rest is dealt out by (heavy prefix, next chunk): each such bucket is small, and one task ends the
   recursion in memory.  Whole texts cross the network once.
4. Classes are summed from one row a representative, so a text that a third of all rows share costs as
   many rows as there are batches.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, as_bytes, numbered, spread

#: Lengths of the successive chunks that split groups: 32 bytes, then four times as many each time.
FIRST, GROWTH = 32, 4


def squeeze(text: bytes) -> bytes:
    """The text without ASCII white space."""
    return text.translate(None, SPACE)


def radix_groups(keys: list[bytes]) -> list[list[int]]:
    """Indices of equal keys together: split by successive chunks until singleton or ended."""
    done: list[list[int]] = []
    todo: list[tuple[list[int], int, int]] = [(list(range(len(keys))), 0, FIRST)]
    while todo:
        rows, at, width = todo.pop()
        parts: dict[bytes, list[int]] = {}
        for i in rows:
            parts.setdefault(keys[i][at : at + width], []).append(i)
        for chunk, own in parts.items():
            if len(own) == 1 or len(chunk) < width:
                done.append(own)
            else:
                todo.append((own, at + width, width * GROWTH))
    return done


def descend(key: bytes, trie: list[dict[tuple[int, bytes], int]]) -> tuple[int, bytes, bool]:
    """The deepest heavy prefix of a key, the chunk after it, and whether the key has ended in that prefix."""
    node, at, width = 0, 0, FIRST
    for level in trie:
        chunk = key[at : at + width]
        if (child := level.get((node, chunk))) is None:
            return node, chunk, False
        node, at = child, at + width
        if len(chunk) < width:
            return node, b"", True
        width *= GROWTH
    return node, key[at : at + width], False


@dataclass
class Deduped:
    """``decisions``: a row for each input row. ``kept``: the rows that stay, with their own columns."""

    decisions: DataFrame
    kept: DataFrame


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, uneven: float = 1.0, heavy_bytes: int = 32 << 20, most_heavy: int = 100_000, task_bytes: int = 24 << 20, scratch: Scratch | None = None) -> Deduped:
    """Finds equal texts; of each group the longest original, then the smallest id (null last) stays.

    Decisions: id, keep_id, group_size, kept, text_sha256.  A null text is an empty one, so all null and
    blank texts form one group; rows that are repeated whole count separately and exactly one stays.
    An empty table gives empty results.  Other columns of the input are read only if named in ``carry``.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    carry = carry or []
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)))
    ids = own.schema["_id"].dataType.simpleString()
    kinds = ", ".join(["_rid long", f"_id {ids}", "_rep long", "_n long", "_chars int", "_sha string", "_text string", *(f"c_{i} {f.dataType.simpleString()}" for i, f in enumerate(own.schema.fields[2:]))])

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [squeeze(t) for t in as_bytes(b["_text"])]
            chars = pc.fill_null(pc.utf8_length(b["_text"]), 0).to_pylist()
            ident, rid = b["_id"].to_pylist(), b["_rid"].to_pylist()
            rep, count, sha = [0] * len(keys), [None] * len(keys), [None] * len(keys)
            for group in radix_groups(keys):
                best = min(group, key=lambda i: (-chars[i], ident[i] is None, ident[i], rid[i])) if len(group) > 1 else group[0]
                count[best], sha[best] = len(group), hashlib.sha256(keys[best]).hexdigest()
                for i in group:
                    rep[i] = rid[best]
            stays = pa.array([x is not None for x in count])
            out = {"_rid": b["_rid"], "_id": b["_id"], "_rep": pa.array(rep, pa.int64()), "_n": pa.array(count, pa.int64()), "_chars": pa.array(chars, pa.int32()), "_sha": pa.array(sha, pa.string())}
            for name in ["_text", *(f"c_{i}" for i in range(len(carry)))]:
                # a representative's null text stays null; nothing else reads it than squeeze()
                out[name] = pc.if_else(stays, b[name], pa.scalar(None, b[name].type))
            yield pa.RecordBatch.from_pydict(out)

    local = scratch.save(numbered(own, "_rid").mapInArrow(collapse, kinds), "local")
    reps = local.where("_n is not null")

    trie: list[dict[tuple[int, bytes], int]] = []
    nodes, volume, heavy_rows = 0, 0, 0.0
    while True:
        def leading(batches: Iterator[pa.RecordBatch], trie=tuple(trie)) -> Iterator[pa.RecordBatch]:
            inner = set(trie[-1].values()) if trie else {0}
            for b in batches:
                n, size = Counter(), Counter()
                for key in map(squeeze, as_bytes(b["_text"])):
                    node, chunk, ended = descend(key, trie)
                    if node in inner and not ended:
                        n[node, chunk] += 1
                        size[node, chunk] += len(key)
                yield pa.RecordBatch.from_pydict({"node": pa.array([k[0] for k in n], pa.int64()), "chunk": pa.array([k[1] for k in n], pa.binary()), "n": pa.array(n.values(), pa.int64()), "size": pa.array((size[k] for k in n), pa.int64())})

        counts = reps.select("_text").mapInArrow(leading, "node long, chunk binary, n long, size long").groupBy("node", "chunk").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
        if not trie:
            counts = scratch.save(counts, "leading")
            every, volume = (x or 0 for x in counts.agg(F.sum("n"), F.sum("size")).first())
            heavy_rows = max(1.0, uneven * every / spread(spark, volume, task_bytes))
        heavy = counts.where((F.col("n") > heavy_rows) | (F.col("size") > heavy_bytes) & (F.col("n") > 1)).orderBy(F.desc("size"), "node", "chunk").limit(most_heavy).select("node", "chunk").collect()
        if not heavy:
            break
        trie.append({(r["node"], bytes(r["chunk"])): nodes + 1 + i for i, r in enumerate(heavy)})
        nodes += len(heavy)

    scratch.drop("leading")
    frozen = tuple(trie)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b["_text"])
            at = [descend(squeeze(t), frozen) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "_rid": b["_rid"],
                "leaf": pa.array([x[0] if x[2] else 0 for x in at], pa.int64()),
                "node": pa.array([0 if x[2] else x[0] for x in at], pa.int64()),
                "chunk": pa.array([b"%d" % r if x[2] else x[1] for x, r in zip(at, b["_rid"].to_pylist(), strict=True)], pa.binary()),
                "_text": pa.array([None if x[2] else t for x, t in zip(at, texts, strict=True)], pa.binary()),
            })

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, leaf, keys = [], [], []
        for b in batches:
            rid += b["_rid"].to_pylist()
            leaf += b["leaf"].to_pylist()
            keys += map(squeeze, as_bytes(b["_text"]))
        cls = [-x for x in leaf]
        open_ = [i for i, x in enumerate(leaf) if not x]
        for group in radix_groups([keys[i] for i in open_]):
            first = min(rid[open_[i]] for i in group)
            for i in group:
                cls[open_[i]] = first
        yield pa.RecordBatch.from_pydict({"_rid": pa.array(rid, pa.int64()), "_cls": pa.array(cls, pa.int64())})

    n = spread(spark, volume, task_bytes)
    dealt = reps.select("_rid", "_text").mapInArrow(route, "_rid long, leaf long, node long, chunk binary, _text binary").repartition(n, "node", "chunk")
    found = scratch.save(dealt.mapInArrow(finish, "_rid long, _cls long"), "classes")

    each = found.join(reps.select("_rid", "_id", "_n", "_chars", "_sha"), "_rid")
    best = F.min(F.struct(-F.col("_chars"), F.col("_id").isNull(), F.col("_id").alias("id"), F.col("_rid").alias("rid")))
    classes = each.groupBy("_cls").agg(F.sum("_n").alias("size"), best.alias("best"))
    each = each.select("_cls", F.col("_rid").alias("_rep"), "_sha").join(classes, "_cls")
    members = local.select("_rid", "_id", "_rep").join(each, "_rep")
    decisions = members.select(
        F.col("_id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("_rid") == F.col("best.rid")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )
    kept = reps.join(classes.select(F.col("best.rid").alias("_rid")), "_rid", "left_semi")
    return Deduped(decisions, kept.select(*([F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)] or [F.col("_id").alias(id_col), F.col("_text").alias(text_col)])))
