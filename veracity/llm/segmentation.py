"""SentencePiece segmentation: the N best paths of the piece lattice, and back to text.

A text with its dummy prefix is cut where no piece can reach across: before each run of the space sign, around
line ends, and in long units wherever no piece of the vocabulary lies over a place. The lattice of the whole text
is the chain of these units' lattices, so its N best paths
come from theirs exactly. Of each unit a forward pass finds the best path and, with a backward pass, by how
much the second best falls short; both are kept for the units seen. Only the few units that can take part in
a document's N best are searched further: backward A* from the unit's end, with the forward Viterbi scores as
heuristic. As these are exact, paths come out best first, and no position is left more than N times. A search keeps
one entry a step with its predecessor, so memory is linear in the unit, however long it is.

Pieces have the model's own scores, and a character that is no piece the least score less ten, as the library's
unigram decoder has them; it then falls back to its bytes. The vocabulary at hand was made by merges, and its scores are
ranks; ``zipf`` reads them as ranks of Zipf's law instead, which favours long pieces. Scores are whole numbers, or whole
millionths where the model's are not, so that sums and ties are exact.
"""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE_SIGN = "▁"
NONE = -(1 << 61)
#: The first entry of a search as the heap has it; entries count down from here.
LATEST = (1 << 34) - 1


class Pieces:
    """The vocabulary: scores in ``unit`` parts of one, ids, and the ids of bytes. Small: the model's pieces."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int]):
        self.ids = {p: i for p, i, _ in pieces}
        self.unit = 1 if all(s == int(s) for _, _, s in pieces) else 1_000_000
        self.scores = {p: round(self.unit * s) for p, _, s in pieces}
        self.byte_ids = byte_ids
        self.unknown = min(self.scores.values(), default=0) - 10 * self.unit
        self.longest = max(map(len, self.ids), default=1)
        self.names = {i: p for p, i, _ in pieces}
        self.bytes_of = {i: b for b, i in enumerate(byte_ids)}

    @classmethod
    def load(cls, path: str, zipf: bool = False) -> Pieces:
        """Reads a SentencePiece model with byte fallback; done on the driver, executors get this object."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = [-math.log(2 + r) if zipf else sp.get_score(i) for r, i in enumerate(plain)]
        found = cls([(sp.id_to_piece(i), i, x) for i, x in zip(plain, score, strict=True)], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if any(SPACE_SIGN in p.lstrip(SPACE_SIGN) or "\n" in p for p in found.ids):
            raise ValueError("a piece reaches across a unit's end")
        return found

    def edges(self, unit: str) -> tuple[array, array, array]:
        """(from, to, score) of the unit's lattice, by start, then end."""
        start, stop, score = array("i"), array("i"), array("q")
        get, n, longest = self.scores.get, len(unit), self.longest
        for i in range(n):
            single = False
            for j in range(i + 1, min(n, i + longest) + 1):
                s = get(unit[i:j])
                if s is not None:
                    start.append(i)
                    stop.append(j)
                    score.append(s)
                    single = single or j == i + 1
            if not single:
                start.append(i)
                stop.append(i + 1)
                score.append(self.unknown)
        return start, stop, score

    def best(self, unit: str) -> tuple[list[int], int, int]:
        """Cut positions of the best path, its score, and how much the second best lacks (-1: there is none)."""
        edges, n = self.edges(unit), len(unit)
        alpha, back = array("q", [0]) + array("q", [NONE]) * n, array("i", [0]) * (n + 1)
        for i, j, s in zip(*edges, strict=True):
            if (t := alpha[i] + s) > alpha[j]:
                alpha[j], back[j] = t, i
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        if len(edges[0]) == len(cuts) - 1:
            return cuts, alpha[n], -1
        beta, taken = array("q", [NONE]) * n + array("q", [0]), array("i", [0]) * (n + 1)
        for i, j in zip(cuts, cuts[1:], strict=False):
            taken[i] = j
        second = NONE
        for i, j, s in zip(*map(reversed, edges), strict=True):
            t = s + beta[j]
            if t > beta[i]:
                beta[i] = t
            if t + alpha[i] > second and taken[i] != j:
                second = t + alpha[i]
        return cuts, alpha[n], alpha[n] - second

    def nbest(self, unit: str, n: int) -> list[tuple[list[int], int]]:
        """The n best paths as (cut positions, score), best first; the first is that of ``best``.

        Entries are (position, the entry it was reached from, score from here to the end). The heap holds, in one number, how much
        an entry's best whole path lacks and the entry, the later one first. A position needs n + 1 ways out at most, since the
        first path may be one of those found.
        """
        size = len(unit)
        start, stop, score = self.edges(unit)
        alpha = array("q", [0]) + array("q", [NONE]) * size
        into = array("i", [0]) * (size + 2)
        for i, j, s in zip(start, stop, score, strict=True):
            alpha[j] = max(alpha[j], alpha[i] + s)
            into[j + 1] += 1
        for j in range(size + 1):
            into[j + 1] += into[j]
        order, at = array("i", [0]) * len(start), array("i", into)
        for e, j in enumerate(stop):
            order[at[j]] = e
            at[j] += 1
        first, best, _ = self.best(unit)
        out = [(first, best)]
        left, made, worst = array("i", [0]) * (size + 1), array("i", [0]) * (size + 1), array("q", [0]) * (size + 1)
        place, came, rest = array("i", [size]), array("q", [-1]), array("q", [0])
        heap = [LATEST]
        while heap and len(out) < n:
            lacks, entry = divmod(heapq.heappop(heap), LATEST + 1)
            entry = LATEST - entry
            here = place[entry]
            if not here:
                cuts, e = [], entry
                while e >= 0:
                    cuts.append(place[e])
                    e = came[e]
                if cuts != first:
                    out.append((cuts, rest[entry]))
                continue
            left[here] += 1
            if left[here] > n + 1:
                continue
            for k in range(into[here], into[here + 1]):
                e = order[k]
                i = start[e]
                g = rest[entry] + score[e]
                gap = best - g - alpha[i]
                if made[i] > n:
                    if gap >= worst[i]:
                        continue  # n + 1 ways from there are as good
                else:
                    made[i] += 1
                    worst[i] = max(worst[i], gap)
                heapq.heappush(heap, gap * (LATEST + 1) + LATEST - len(place))
                place.append(i)
                came.append(entry)
                rest.append(g)
        return out

    def encode(self, unit: str, cuts: list[int]) -> bytes:
        """Ids of a path, 16-bit little-endian."""
        out: list[int] = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            piece = unit[i:j]
            if piece in self.ids:
                out.append(self.ids[piece])
            else:
                out += [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return np.array(out, "<u2").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces as bytes, space signs as spaces, without the dummy prefix."""
        raw = b"".join(bytes([self.bytes_of[i]]) if i in self.bytes_of else self.names[i].replace(SPACE_SIGN, " ").encode() for i in ids.tolist())
        return raw.decode("utf-8", "replace").removeprefix(" ")


#: Units up to this length are searched many at once, and units of more bytes than this are cut where no piece lies over.
SHORT, LONG = 40, 48
_M = np.uint64(0x9E3779B97F4A7C15)


class Lattices:
    """Forward and backward passes over all units of one length at once, by the same rules as ``Pieces.best``.

    Pieces are found by a rolling hash of their characters: a bitmap tells most other substrings apart, and a binary
    search over the 64-bit hashes decides.
    """

    def __init__(self, pieces: Pieces):
        by_hash = sorted((self._hash(p), i, pieces.scores[p]) for p, i in pieces.ids.items())
        self.hashes = np.array([x[0] for x in by_hash], np.uint64)
        self.ids = np.array([x[1] for x in by_hash], np.int32)
        self.scores = np.array([x[2] for x in by_hash], np.int64)
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[self.hashes >> np.uint64(42)] = True
        self.longest = pieces.longest

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return (h ^ len(piece)) * int(_M) & 0xFFFFFFFFFFFFFFFF

    def _found(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, places among the pieces) of the rolling hashes that are pieces of k characters."""
        key = ((h ^ np.uint64(k)) * _M).ravel()
        at = np.flatnonzero(self.bitmap[key >> np.uint64(42)])
        where = np.minimum(np.searchsorted(self.hashes, key[at]), len(self.hashes) - 1)
        ok = self.hashes[where] == key[at]
        return at[ok], where[ok]

    def cuts(self, unit: str) -> np.ndarray:
        """The places inside a unit that no piece lies over."""
        chars = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(chars)
        over = np.zeros(n + 2, np.int32)
        h = chars + np.uint64(1)
        for k in range(2, min(n, self.longest) + 1):
            h = h[: n - k + 1] * np.uint64(0x100000001B3) + chars[k - 1 :] + np.uint64(1)
            at, _ = self._found(h, k)
            np.add.at(over, at + 1, 1)
            np.add.at(over, at + k, -1)
        return np.flatnonzero(np.cumsum(over)[1:n] == 0) + 1

    def best(self, units: list[str]) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
        """(ids, score, gap) of units of one length; ids are None where a character is no piece."""
        n, m = len(units[0]), len(units)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).T.astype(np.uint64)
        score = np.full((min(n, self.longest) + 1, n, m), NONE, np.int64)  # by length and start
        ids = np.zeros((len(score), n, m), np.int32)
        h = np.zeros((n, m), np.uint64)
        for k in range(1, len(score)):
            h = h[: n - k + 1] * np.uint64(0x100000001B3) + chars[k - 1 :] + np.uint64(1)
            at, where = self._found(h, k)
            score[k, : n - k + 1].ravel()[at] = self.scores[where]
            ids[k, : n - k + 1].ravel()[at] = self.ids[where]
        plain = (score[1] > NONE).all(0)
        alpha, back = np.full((n + 1, m), NONE, np.int64), np.zeros((n + 1, m), np.int32)
        alpha[0] = 0
        for j in range(1, n + 1):
            for k in range(min(j, len(score) - 1), 0, -1):
                t = alpha[j - k] + score[k, j - k]
                better = t > alpha[j]
                alpha[j][better] = t[better]
                back[j][better] = k
        beta = np.full((n + 1, m), NONE, np.int64)
        beta[n] = 0
        for i in range(n - 1, -1, -1):
            for k in range(1, min(n - i, len(score) - 1) + 1):
                np.maximum(beta[i], score[k, i] + beta[i + k], out=beta[i])
        taken = np.zeros((n, m), np.int32)  # by start, the length of the best path's piece
        at, every = np.full(m, n), np.arange(m)
        while (on := every[at > 0]).size:
            k = back[at[on], on]
            stuck = k == 0  # only where a character is no piece
            k = np.where(stuck, at[on], k)
            at[on] -= k
            taken[at[on], on] = k
        second = np.full(m, NONE, np.int64)
        for k in range(1, len(score)):
            t = alpha[: n - k + 1] + score[k, : n - k + 1] + beta[k:]
            t[taken[: n - k + 1] == k] = NONE
            np.maximum(second, t.max(0), out=second)
        gap = np.where(second > NONE // 2, alpha[n] - second, -1)
        used = (taken > 0).T
        flat = ids[np.minimum(taken, len(score) - 1), np.arange(n)[:, None], every].T[used].astype("<u2").tobytes()
        stop = (np.cumsum(used.sum(1)) * 2).tolist()
        out: list[bytes | None] = [flat[a:b] for a, b in zip([0, *stop], stop, strict=False)]
        for i in np.flatnonzero(~plain).tolist():
            out[i] = None
        return out, alpha[n], gap


class Segmenter:
    """Whole texts; keeps what it found for the units seen, as UTF-8 with spaces for space signs."""

    def __init__(self, pieces: Pieces, n: int, keep: int = 300_000):
        self.pieces, self.n, self.keep = pieces, n, keep
        self.lattices = Lattices(pieces)
        self.known: dict[bytes, tuple[bytes, int, int]] = {}
        self.searched: dict[bytes, list[tuple[bytes, int]]] = {}
        self.table = [b""] * (max([*pieces.names, *pieces.byte_ids, 0]) + 1)
        for i, p in pieces.names.items():
            self.table[i] = p.replace(SPACE_SIGN, " ").encode()
        for i, x in pieces.bytes_of.items():
            self.table[i] = bytes([x])

    @staticmethod
    def _text(unit: bytes) -> str:
        return unit.decode("utf-8", "surrogatepass").replace(" ", SPACE_SIGN)

    def _look_up(self, units: list[bytes]) -> list[tuple[bytes, int, int]]:
        """(ids, score, gap) of distinct units. Units met when the store is full are not kept."""
        found = list(map(self.known.get, units))
        by_length: dict[int, list[tuple[int, str]]] = {}
        for i, x in enumerate(found):
            if x is None:
                text = self._text(units[i])
                by_length.setdefault(min(len(text), SHORT + 1), []).append((i, text))
        for size, own in by_length.items():
            for a in range(0, len(own), 4096):
                part = own[a : a + 4096]
                whole = self.lattices.best([t for _, t in part]) if size <= SHORT else ([None] * len(part), [0] * len(part), [0] * len(part))
                for (i, text), ids, score, gap in zip(part, *(x if isinstance(x, list) else x.tolist() for x in whole), strict=True):
                    if ids is None:
                        cuts, score, gap = self.pieces.best(text)
                        ids = self.pieces.encode(text, cuts)
                    found[i] = ids, score, gap
                    if len(self.known) < self.keep:
                        self.known[units[i]] = found[i]
        return found

    def _search(self, unit: bytes) -> list[tuple[bytes, int]]:
        if unit not in self.searched:
            if len(self.searched) > self.keep // 4:
                self.searched.clear()
            text = self._text(unit)
            self.searched[unit] = [(self.pieces.encode(text, c), s) for c, s in self.pieces.nbest(text, self.n)]
        return self.searched[unit]

    def many(self, texts: list[str | None], group: int = 2 << 20) -> Iterator[tuple[bytes, list[tuple[int, bytes]]]]:
        """(ids of the best path, the N best as (score, ids)) of each text; texts are taken in groups of so many characters."""
        held: list[bytes] = []
        size = 0
        for k, text in enumerate(texts):
            # a space sign in the text itself is a space to the lattice
            held.append((text or "").replace(SPACE_SIGN, " ").encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size >= group or k == len(texts) - 1:
                yield from self._group(held)
                held, size = [], 0

    def _group(self, texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, bytes]]]]:
        size = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        end = np.cumsum(size)
        data = np.frombuffer(b"".join(b" " + t for t in texts if t), np.uint8)  # each with its dummy prefix
        space, line = data == 32, data == 10
        new = np.ones(len(data), bool)
        new[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        new[(end - size)[size > 0]] = True
        edges = np.append(np.flatnonzero(new), len(data))
        for a, b in zip(edges[:-1][np.diff(edges) > LONG].tolist(), edges[1:][np.diff(edges) > LONG].tolist(), strict=True):
            text = self._text(data[a:b].tobytes())
            inside = self.lattices.cuts(text)
            wide = np.frombuffer(text.replace(SPACE_SIGN, " ").encode("utf-32-le", "surrogatepass"), np.uint32)
            size_ = 1 + (wide >= 0x80) + (wide >= 0x800) + (wide >= 0x10000)
            new[a + np.cumsum(size_)[inside - 1]] = True
        first = np.flatnonzero(new)
        bounds = [0, *np.searchsorted(first, end).tolist()]
        at = np.append(first, len(data)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        which, names = units.indices.to_numpy(), units.dictionary.to_pylist()
        found = self._look_up(names)
        score = np.fromiter((x[1] for x in found), np.int64, len(found))
        gap = np.fromiter((x[2] for x in found), np.int64, len(found))
        long = np.fromiter((len(x[0]) for x in found), np.int64, len(found)) >> 1
        flat, start = np.frombuffer(b"".join(x[0] for x in found), "<u2"), np.cumsum(long) - long
        n = long[which]
        stop = np.cumsum(n)
        out = flat[np.arange(int(n.sum())) + np.repeat(start[which] - (stop - n), n)].tobytes()
        stop = np.append(0, stop * 2)
        gaps, scores = gap[which], score[which]
        gaps = np.where(gaps < 0, np.iinfo(np.int64).max, gaps)
        for a, b in zip(bounds, bounds[1:], strict=False):
            ids = out[stop[a] : stop[b]]
            total, own = int(scores[a:b].sum()), gaps[a:b]
            # a path of the N best departs from the best only where the gap is among the N - 1 smallest
            k = min(self.n - 1, b - a)
            near = np.argpartition(own, k - 1)[:k] if 0 < k < b - a else np.arange(b - a)
            ways: list[tuple[int, dict[int, bytes]]] = [(total, {})]
            for i in sorted(near.tolist(), key=lambda i: (own[i], i)):
                if own[i] < np.iinfo(np.int64).max:
                    less = int(scores[a + i])
                    ways = sorted(((s - less + alt, w if not r else w | {i: x}) for s, w in ways for r, (x, alt) in enumerate(self._search(names[which[a + i]]))), key=lambda x: -x[0])[: self.n]
            yield ids, [(s, self._splice(ids, w, stop[a : b + 1] - stop[a])) for s, w in ways]

    @staticmethod
    def _splice(ids: bytes, other: dict[int, bytes], at: np.ndarray) -> bytes:
        """The ids with those of some units replaced."""
        out, last = [], 0
        for i in sorted(other):
            out += [ids[last : at[i]], other[i]]
            last = at[i + 1]
        return b"".join([*out, ids[last:]]) if out else ids

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids, without the dummy prefix."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u2").tolist())).removeprefix(b" ")


def segment(docs: DataFrame, *, model: str, n: int = 4, zipf: bool = False, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_crc32 (best path), score, n_best, last_score, nbest_crc32 (of each path, comma-joined,
    best first), round_trip, and with ``with_ids`` ids (16-bit, best path) and nbest (score, ids).

    ``model`` is the path of a SentencePiece model on the driver. ``round_trip``: the best ids decode to the text, which
    fails only for texts that hold the space sign itself. A null text is an empty one: no token, score 0, one empty
    path. Rows are independent; other columns are not read. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model, zipf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, unit = Segmenter(shared.value, n), shared.value.unit
        for b in slices(batches, 512):
            rows = []
            texts = b["_text"].to_pylist()
            for text, (ids, ways) in zip(texts, segmenter.many(texts), strict=True):
                same = segmenter.decode(ids) == (text or "").encode("utf-8", "surrogatepass")
                sums = ",".join(str(crc32(x)) for _, x in ways)
                row = (len(ids) // 2, crc32(ids), ways[0][0] / unit, len(ways), ways[-1][0] / unit, sums, same)
                rows.append((*row, ids, [{"score": s / unit, "ids": x} for s, x in ways]) if with_ids else row)
            yield pa.RecordBatch.from_arrays([b["_id"], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    names = [id_col, "n_tokens", "ids_crc32", "score", "n_best", "last_score", "nbest_crc32", "round_trip"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.string(), pa.bool_()]
    sql = [own.schema["_id"].dataType.simpleString(), "long", "long", "double", "int", "double", "string", "boolean"]
    if with_ids:
        names, sql = [*names, "ids", "nbest"], [*sql, "binary", "array<struct<score: double, ids: binary>>"]
        kinds += [pa.binary(), pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())]))]
    return own.mapInArrow(run, ", ".join(f"`{x}` {k}" for x, k in zip(names, sql, strict=True)))


def crc32(ids: bytes) -> int:
    """Of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
