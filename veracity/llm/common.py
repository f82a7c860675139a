"""What the operators share: scratch tables, row ids, runs of sorted rows.

Scratch tables stay until the owner calls ``drop()`` or the driver ends, because the frames returned by an operator
read them lazily.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: The ASCII white space of the contracts: ``[\x20\x09-\x0D]``; ``bytes.split()`` splits on the same set.
SPACE = b" \t\n\x0b\x0c\r"


def numbered(docs: DataFrame, name: str = "_rid") -> DataFrame:
    """Adds a row id. Ids may repeat or be null in the input, so rows are told apart by this one.

    The id depends on how the scan is dealt out: write the frame before reading it twice.
    """
    return docs.withColumn(name, F.monotonically_increasing_id())


def spread(spark: SparkSession, volume: float, each: float) -> int:
    """Partitions for ``volume`` at ``each`` a task, the session's shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-volume // each)))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """One table for every run of rows with equal integer keys; the rows must be sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple[int, ...] = ()
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys])
        start = 0
        for end in [*(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]:
            key = tuple(k[:, start].tolist())
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, end - start))
            last, start = key, end
    if held:
        yield last, pa.Table.from_batches(held)


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of the edges ``(a long, b long)``: rows ``(node, root)``, root the smallest node.

    Each round hooks every node to its smallest neighbour, jumps twice, and contracts the edges; their
    number falls at least geometrically.  Only aggregates and joins on unique keys are used, so a star
    with millions of leaves is pre-aggregated or split by AQE and never gathered.  An edge with a null
    end or equal ends counts for nothing; without edges the result is empty.
    """
    edges = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    found = scratch.save(nodes.select("node", F.col("node").alias("root")), f"{name}-r0")
    k = 0
    while not edges.isEmpty():
        k += 1
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("p")).select("n", F.least("n", "p").alias("p"))
        up = scratch.save(up, f"{name}-u{k}")
        hop = up.select(F.col("n").alias("p"), F.col("p").alias("pp"))
        up = up.join(hop, "p", "left").select("n", F.coalesce("pp", "p").alias("p"))
        up = scratch.save(up, f"{name}-v{k}")
        to = lambda c: up.select(F.col("n").alias(c), F.col("p").alias(f"{c}2"))  # noqa: E731, B023
        found = scratch.save(found.join(to("root"), "root", "left").select("node", F.coalesce("root2", "root").alias("root")), f"{name}-r{k}")
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2")
        edges = scratch.save(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"{name}-e{k}")
        for old in (f"e{k - 1}", f"r{k - 1}", f"u{k}", f"v{k}"):
            scratch.drop(f"{name}-{old}")
    scratch.drop(f"{name}-e{k}")
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, scratch: Scratch, *, rows: int, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``rows`` texts with labels to learn from: ``(_text, _label int, _part int)``, dealt into few parts.

    Rows with crc32(id as text) mod 4 = 2 are held out and never used. The rows are those with the smallest
    hash of their id, ties by the id itself, so the sample is the same every time; it is bounded and may be broadcast.
    An id labelled twice takes its greatest label. Of the documents that share an id the text with the smallest
    hash is taken; null labels and null ids are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(id_col))
    chosen = known.groupBy(F.col(id_col).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key").limit(rows)
    found = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_key")
    found = found.groupBy("_key", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    return scratch.save(found.select("_text", "_label", F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(10)).cast("int").alias("_part")), name)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32(id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The batches cut smaller, so what is made of one at a time stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
