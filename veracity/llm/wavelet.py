"""Token ids in binary shards: a wavelet matrix each, in one compressed file that is read in place.

Documents are range-sorted by id, their token ids laid end to end and cut into shards of whole documents. A
shard is one compressed file image that says all there is to know of it: the documents' ids and lengths, and where
its first token stands among all of its part. Images are kept as rows of a Parquet table, so that any store Spark writes
to will do; ``Shard`` answers from the image, ``export`` puts it in a file of its own.

Format (little-endian): magic ``WVL2``; 32-bit numbers: bits, documents, kind of ids (0 long, 1 text); 64-bit:
tokens, tokens before it in its part; sizes of the compressed ids and lengths; for each plane the count of its zeros;
then the directory, and the blocks. A plane holds one bit of every id, highest bit first; ids are stably parted by each
bit before the next plane. Planes are cut into blocks of 32,768 bits, each compressed alone. The directory has for each
block of each plane where it starts and the ones before it in its plane; in front of its bits a block has the ones before each
512 of them. So a look-up opens one block a plane, and nothing is summed when a shard is opened.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered, slices, spread
from .tokens import Encoder, read_spec

MAGIC, BITS, BLOCK, RANK = b"WVL2", 16, 1 << 15, 512
_HEAD = struct.Struct("<4sIIIQQII")


def build(ids: np.ndarray, lengths: np.ndarray, names: list | None = None, before: int = 0, bits: int = BITS) -> bytes:
    """The file image of ids (non-negative, below 2^bits) in documents of these lengths. ``names``: the documents' ids, whole
    numbers or text, null among them; without them they are counted from 0."""
    z = zstandard.ZstdCompressor(level=1)
    x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    zeros, starts, ranks, blocks, at = [], [], [], [], 0
    for level in range(bits - 1, -1, -1):
        one = (x >> level & 1).astype(bool)
        packed = np.packbits(np.pad(one, (0, -len(one) % BLOCK)))
        ones = np.bitwise_count(packed).reshape(-1, RANK // 8).sum(1, dtype=np.int64).reshape(-1, BLOCK // RANK)
        inside = (np.cumsum(ones, 1) - ones).astype("<u2")
        per = ones.sum(1)
        ranks.append(np.cumsum(per) - per)
        for k, part in enumerate(packed.reshape(-1, BLOCK // 8)):
            blocks.append(z.compress(inside[k].tobytes() + part.tobytes()))
            starts.append(at)
            at += len(blocks[-1])
        low = np.compress(~one, x)
        zeros.append(len(low))
        x = np.concatenate([low, np.compress(one, x)])
    named = list(range(len(lengths))) if names is None else names
    text = any(isinstance(v, str) for v in named)
    if text:
        raw = [b"" if v is None else b"." + v.encode() for v in named]  # an empty one is null
        own = np.array(list(map(len, raw)), "<u4").tobytes() + b"".join(raw)
    else:
        own = np.array([v is None for v in named], np.uint8).tobytes() + np.array([v or 0 for v in named], "<i8").tobytes()
    own, tail = z.compress(own), z.compress(lengths.astype("<u4").tobytes())
    head = _HEAD.pack(MAGIC, bits, len(lengths), int(text), len(ids), before, len(own), len(tail))
    directory = np.stack([np.array([*starts, at], "<i8")[:-1], np.concatenate(ranks)], 1).astype("<i8") if len(ids) else np.zeros((0, 2), "<i8")
    return b"".join([head, np.array(zeros, "<i8").tobytes(), directory.tobytes(), struct.pack("<q", at), own, tail, *blocks])


class Shard:
    """Reads a file image in place. A block is decompressed when it is first needed; positions may be arrays."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.image = image
        _, self.bits, self.documents, self.text, self.tokens, self.before, self._own, self._tail = _HEAD.unpack_from(image)
        self.per = -(-self.tokens // BLOCK)  # blocks a plane
        self.zeros = np.frombuffer(image, "<i8", self.bits, _HEAD.size)
        at = _HEAD.size + 8 * self.bits
        self.directory = np.frombuffer(image, "<i8", 2 * self.bits * self.per, at).reshape(-1, 2)
        at += self.directory.nbytes
        (self._end,) = struct.unpack_from("<q", image, at)
        self._names_at = at + 8
        self._blocks_at = self._names_at + self._own + self._tail
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _raw(self, at: int, size: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.image[at : at + size])

    @cached_property
    def lengths(self) -> np.ndarray:
        """Tokens of each document."""
        return np.frombuffer(self._raw(self._names_at + self._own, self._tail), "<u4").astype(np.int64)

    @cached_property
    def names(self) -> list:
        """The documents' ids."""
        raw, n = self._raw(self._names_at, self._own), self.documents
        if not self.text:
            return [None if gone else v for gone, v in zip(raw[:n], np.frombuffer(raw, "<i8", n, n).tolist(), strict=True)]
        stop = 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64)
        return [raw[a + 1 : b].decode() if b > a else None for a, b in zip([4 * n, *stop.tolist()], stop.tolist(), strict=False)]

    def _block(self, plane: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ones before each 512 bits, packed bits) of a block."""
        j = plane * self.per + k
        if j not in self._open:
            start = int(self.directory[j, 0])
            stop = int(self.directory[j + 1, 0]) if j + 1 < len(self.directory) else self._end
            raw = self._raw(self._blocks_at + start, stop - start)
            self._open[j] = np.frombuffer(raw, "<u2", BLOCK // RANK), np.frombuffer(raw, np.uint8, BLOCK // 8, 2 * BLOCK // RANK)
        return self._open[j]

    def _look(self, plane: int, i: np.ndarray, with_bit: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(the bits at the positions, the ones before them); a position may be the plane's length if only ones are asked for."""
        bit, ones = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
        block = i // BLOCK
        for k in np.unique(block).tolist():
            here = np.flatnonzero(block == k) if len(i) > 1 else np.zeros(1, np.int64)
            if k == self.per:  # the end of a plane of whole blocks
                ones[here] = self.tokens - self.zeros[plane]
                continue
            inside, packed = self._block(plane, k)
            at = i[here] - k * BLOCK
            first = at // RANK
            # whole bytes of the 512 bits before the position, and the bits of its own byte
            rest = packed.reshape(-1, RANK // 8)[np.minimum(first, BLOCK // RANK - 1)]
            byte = (at % RANK) // 8
            whole = np.where(np.arange(RANK // 8) < byte[:, None], np.bitwise_count(rest), 0).sum(1)
            own = packed[np.minimum(at // 8, BLOCK // 8 - 1)]
            part = np.bitwise_count(own & (0xFF00 >> (at % 8)).astype(np.uint8))
            ones[here] = self.directory[plane * self.per + k, 1] + inside[np.minimum(first, BLOCK // RANK - 1)] + whole + part
            if with_bit:
                bit[here] = own >> (7 - at % 8).astype(np.uint8) & 1
        return bit, ones

    def access(self, i) -> int | np.ndarray:
        """The ids at positions."""
        at = np.atleast_1d(np.asarray(i, np.int64))
        if len(at) and not (0 <= at.min() and at.max() < self.tokens):
            raise IndexError(i)
        value = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            bit, ones = self._look(k, at)
            value = value << 1 | bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return value if np.ndim(i) else int(value[0])

    def _narrow(self, value: int, at: np.ndarray) -> np.ndarray:
        """Where prefixes of the ids end among the last plane's places of a value."""
        for k in range(self.bits):
            _, ones = self._look(k, at, False)
            at = self.zeros[k] + ones if value >> (self.bits - 1 - k) & 1 else at - ones
        return at

    def count(self, value: int, low=0, high=None) -> int | np.ndarray:
        """How often an id occurs in positions low to high (end exclusive), of which there may be many."""
        one = not np.ndim(low) and not np.ndim(high)
        stop = np.minimum(np.atleast_1d(np.asarray(self.tokens if high is None else high, np.int64)), self.tokens)
        start = np.minimum(np.atleast_1d(np.asarray(low, np.int64)), stop)
        n = np.zeros(len(stop), np.int64)
        if self.tokens and 0 <= value < 1 << self.bits:
            found = self._narrow(value, np.r_[start, stop])
            n = found[len(start) :] - found[: len(start)]
        return int(n[0]) if one else n

    def select(self, value: int, n: int) -> int:
        """The position of the n-th occurrence of an id, counted from 0."""
        if not 0 <= n < self.count(value):
            raise IndexError(n)
        i = int(self._narrow(value, np.zeros(1, np.int64))[0]) + n
        for k in range(self.bits - 1, -1, -1):
            zeros = int(self.zeros[k])
            bit = i >= zeros
            want = i - zeros if bit else i
            low, high = 0, self.tokens - 1
            while low < high:  # the first position whose prefix has one more than `want` such bits
                mid = (low + high) // 2
                ones = int(self._look(k, np.array([mid + 1]), False)[1][0])
                if (ones if bit else mid + 1 - ones) > want:
                    high = mid
                else:
                    low = mid + 1
            i = low
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, n) for n in range(self.count(value))]

    def _bits(self, plane: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The bits of ranges, one after the other."""
        first, last = int(low.min()) // BLOCK, (int(high.max()) - 1) // BLOCK
        packed = np.concatenate([self._block(plane, k)[1] for k in range(first, last + 1)])
        one = np.unpackbits(packed).view(bool)
        if (low[1:] == high[:-1]).all():
            return one[low[0] - first * BLOCK : high[-1] - first * BLOCK]
        size = high - low
        return one[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum())) - first * BLOCK]

    def slice(self, low: int, high: int) -> np.ndarray:
        """The ids at positions low to high (end exclusive).

        Ranks take the range down the planes: at each its positions are one range for every prefix of the ids. From the lowest
        plane up, the bits of these ranges lay the ids in order.
        """
        kind = np.uint16 if self.bits <= 16 else np.uint32
        if high <= low:
            return np.zeros(0, kind)
        a, b = np.array([low]), np.array([high])
        prefix = np.zeros(1, np.int64)
        planes = []
        for k in range(self.bits):
            one = self._bits(k, a, b)
            planes.append(one)
            if (a[1:] == b[:-1]).all():  # one stretch: a rank where it starts, and the ones in it
                _, ra = self._look(k, a[:1], False)
                rb = ra + np.cumsum(np.add.reduceat(one, np.cumsum(b - a) - (b - a), dtype=np.int64))
                ra = np.r_[ra, rb[:-1]]
            else:
                _, ones = self._look(k, np.r_[a, b], False)
                ra, rb = ones[: len(a)], ones[len(a) :]
            a, b = np.r_[a - ra, self.zeros[k] + ra], np.r_[b - rb, self.zeros[k] + rb]
            prefix = np.r_[prefix << 1, prefix << 1 | 1]
            some = b > a
            a, b, prefix = a[some], b[some], prefix[some]
        x = np.repeat(prefix, b - a).astype(kind)
        for one in reversed(planes):
            back = np.empty_like(x)
            zeros = len(one) - int(np.count_nonzero(one))
            back[np.flatnonzero(~one)] = x[:zeros]
            back[np.flatnonzero(one)] = x[zeros:]
            x = back
        return x

    def decode(self) -> np.ndarray:
        """All ids in order."""
        return self.slice(0, self.tokens)


def write_shards(docs: DataFrame, *, tokenizer: str, end: int = 0, shard_tokens: int = 1_000_000, drops_space: bool = False, specials: bool = False, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Writes the shards: rows part, shard, n_tokens, file.

    ``tokenizer`` is the path of a tokenizer file on the driver; ``specials`` as in ``tokens``. Documents are in ascending id order, null first,
    repeated ids by row. A null text is an empty one, the end id alone. A shard ends with the document that
    fills it, so a very long document may make a long shard. Other columns are not read. Ids are whole numbers or
    text.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    own = numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    kind = own.schema["_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint", "string"):
        raise TypeError(f"document ids are whole numbers or text, not {kind}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(spec.value, drops_space=drops_space, specials=specials, keep=1_000_000)
        for b in slices(batches, 4096):
            tokens = list(encoder.many(b["_text"].to_pylist(), (end,)))
            yield pa.RecordBatch.from_pydict({"_rid": b["_rid"], "_id": b["_id"], "_n": pa.array([len(x) // 2 for x in tokens], pa.int64()), "_ids": pa.array(tokens, pa.binary())})

    encoded = scratch.save(own.mapInArrow(encode, f"_rid long, _id {kind}, _n long, _ids binary"), "encoded")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, shard = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        ids: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            image = build(np.frombuffer(b"".join(held), "<u2"), np.array(list(map(len, held)), np.int64) // 2, ids, before)
            long = lambda x: pa.array([x], pa.int64())
            return pa.RecordBatch.from_pydict({"part": long(part), "shard": long(shard), "n_tokens": long(size), "file": pa.array([image], pa.binary())})

        for b in batches:
            for ident, raw in zip(b["_id"].to_pylist(), b["_ids"].to_pylist(), strict=True):
                held.append(raw)
                ids.append(ident)
                size += len(raw) // 2
                if size >= shard_tokens:
                    yield flush()
                    before, shard = before + size, shard + 1
                    held, ids, size = [], [], 0
        if held:
            yield flush()

    # the ranges are sampled from the two narrow columns; ids cross the network once
    total = encoded.agg(F.sum("_n")).first()[0] or 0
    dealt = encoded.repartitionByRange(spread(spark, total, 16 * shard_tokens), F.asc_nulls_first("_id"), "_rid").sortWithinPartitions(F.asc_nulls_first("_id"), "_rid")
    written = scratch.save(dealt.mapInArrow(shards, "part long, shard long, n_tokens long, file binary"), "shards")
    scratch.drop("encoded")
    return written


def read_shards(files: DataFrame, id_col: str = "doc_id", id_type: str = "long", with_ids: bool = True, end: int = 0) -> DataFrame:
    """Documents from written shards: id, start (ids of all documents before it), n_tokens, ids (32-bit little-endian),
    ids_crc32, first_id, n_end (how often it has the end id). Without ``with_ids`` the ids themselves stay out."""
    base, total = {}, 0
    for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row a partition
        base[r["part"]] = total
        total += r["n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            shard = Shard(b["file"][0].as_py())
            n = shard.lengths
            stop = np.cumsum(n)
            start = stop - n
            x = shard.slice(0, shard.tokens).astype("<u4")
            raw = [x[s:e].tobytes() for s, e in zip(start.tolist(), stop.tolist(), strict=True)]
            own = {"ids": pa.array(raw, pa.binary())} if with_ids else {}
            names = pa.array(shard.names, pa.string() if shard.text else pa.int64())
            yield pa.RecordBatch.from_pydict({"_name": names.cast(pa.string()), "start": pa.array(start + base[b["part"][0].as_py()] + shard.before), "n_tokens": pa.array(n), **own, "ids_crc32": pa.array(map(zlib.crc32, raw), pa.int64()), "first_id": pa.array(shard.access(start)), "n_end": pa.array(shard.count(end, start, stop))})

    out = files.select("part", "file").mapInArrow(read, f"_name string, start long, n_tokens long, {'ids binary, ' if with_ids else ''}ids_crc32 long, first_id long, n_end long")
    return out.select(F.col("_name").cast(id_type).alias(id_col), *out.columns[1:])


def export(image: bytes, path: str) -> None:
    """A shard as a file of its own."""
    with open(path, "wb") as f:
        f.write(image)
