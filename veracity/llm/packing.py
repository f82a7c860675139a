"""Packing along a space-filling curve.

A document's hashed token counts, of unit length, are projected to four dimensions; each is cut to 12 bits
and the point's position on the Hilbert curve through that cube is the document's key. Documents are range-sorted by the
key, laid end to end along the curve and cut every ``length`` tokens, so neighbours share sequences and only
the very last sequence is short. Tokens are encoded once and cross the network once; the sort moves only keys
and lengths, with id and row as tie-breaks, so copies spread over as many partitions as they need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered, slices, spread
from .tokens import Encoder, read_spec

DIMS, BITS, HASHED = 4, 12, 4096
_PROJECTION = np.random.default_rng(11).normal(size=(HASHED, DIMS)).astype(np.float32)


def project(ids: np.ndarray) -> np.ndarray:
    """The document's point: DIMS whole numbers of BITS bits."""
    counts = np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20), minlength=HASHED).astype(np.float32)
    x = counts @ _PROJECTION / max(float(np.linalg.norm(counts)), 1e-9)
    return np.minimum((1 / (1 + np.exp(-x)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of points ``(n, dims)``: axes are transposed by exclusive-or steps from the
    highest bit down, then Gray-decoded, and the bits interleaved."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def pack(docs: DataFrame, *, tokenizer: str, end: int = 2, length: int = 4096, drops_space: bool = True, with_ids: bool = True, specials: bool = False, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Pieces of documents in sequences: id, start, length, ids (32-bit little-endian), ids_crc32, doc_tokens,
    sequence_id, offset. Without ``with_ids`` the ids themselves stay out.

    ``tokenizer`` is the path of a tokenizer file on the driver; ``specials`` as in ``tokens``. A null text is an empty one: its document is the
    end id alone. Repeated rows are packed as often as they occur; an empty table gives no piece. Other columns
    are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    own = numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    ids = own.schema["_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(spec.value, drops_space=drops_space, specials=specials)
        for b in slices(batches):
            tokens = list(encoder.many(b["_text"].to_pylist(), (end,)))
            points = [project(np.frombuffer(t, "<u2")) for t in tokens]
            key = hilbert_key(np.stack(points)) if points else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"_rid": b["_rid"], "_id": b["_id"], "_key": pa.array(key), "_n": pa.array([len(t) // 2 for t in tokens], pa.int64()), "_ids": pa.array(tokens, pa.binary())})

    encoded = scratch.save(own.mapInArrow(encode, f"_rid long, _id {ids}, _key long, _n long, _ids binary"), "encoded")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b["_n"].to_numpy()
            stop = at + np.cumsum(n)
            yield pa.RecordBatch.from_pydict({"_rid": b["_rid"], "_part": pa.array(np.full(len(n), part)), "_at": pa.array(stop - n), "_m": b["_n"]})
            at = int(stop[-1]) if len(n) else at

    order = ["_key", "_id", "_rid"]
    curve = encoded.select(*order, "_n").repartitionByRange(spread(spark, encoded.count(), 2_000_000), *order).sortWithinPartitions(*order)
    laid = scratch.save(curve.mapInArrow(lay, "_rid long, _part long, _at long, _m long"), "laid")  # written: ranges are sampled
    base, before = {}, 0
    for r in laid.groupBy("_part").agg(F.sum("_m").alias("n")).orderBy("_part").collect():  # one row a partition
        base[r["_part"]] = before
        before += r["n"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256 if with_ids else 2048):  # ids leave at twice the bytes they come in
            row, start, size, piece, crc, sequence, offset, total = [], [], [], [], [], [], [], []
            for k, (raw, part, at) in enumerate(zip(b["_ids"].to_pylist(), b["_part"].to_pylist(), b["_at"].to_pylist(), strict=True)):
                x, at = np.frombuffer(raw, "<u2").astype("<u4"), base[part] + at
                done = 0
                while done < len(x):
                    n = min(length - (at + done) % length, len(x) - done)
                    row.append(k)
                    start.append(done)
                    size.append(n)
                    own = x[done : done + n].tobytes()
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        piece.append(own)
                    sequence.append((at + done) // length)
                    offset.append((at + done) % length)
                    total.append(len(x))
                    done += n
            long = lambda x: pa.array(x, pa.int64())
            ids_ = {"ids": pa.array(piece, pa.binary())} if with_ids else {}
            yield pa.RecordBatch.from_pydict({id_col: b["_id"].take(long(row)), "start": long(start), "length": long(size), **ids_, "ids_crc32": long(crc), "doc_tokens": long(total), "sequence_id": long(sequence), "offset": long(offset)})

    placed = encoded.select("_rid", "_id", "_ids").join(laid, "_rid")
    return placed.select("_id", "_ids", "_part", "_at").mapInArrow(cut, f"`{id_col}` {ids}, start long, length long, {'ids binary, ' if with_ids else ''}ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences from their pieces: sequence_id, ids (32-bit little-endian); each is at most one length of ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
