"""Quality rules by compression bands.

A text that zstandard shrinks far more than others of its length is repetitive or of few kinds of words, one that it
hardly shrinks is noise. Two sets of limits hold for each length:

* fixed ones (``Bands.whole``), which any corpus of prose keeps;
* those measured from the corpus: of each half octave of length the median ratio, less ``below`` and plus ``above`` times the
  median deviation from it. Every document past the base rules counts, but copies (equal in length and in
  compressed length) count once, so a text that a third of all rows share moves no limit. A half octave with fewer than
  ``least`` different values has the fixed limits alone.

The whole text's ratio must lie within its limits, and no more than ``stray`` of its bytes may lie in chunks of ``chunk``
bytes beyond the limits of theirs, which are measured likewise: a repetitive or incompressible stretch in an otherwise
usual text. The last chunk takes a rest too short for a chunk of its own, so every byte is judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, slices

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """``whole``: (bytes from, least ratio, greatest ratio), the last entry that a text or chunk reaches holds.

    Below 2048 bytes the greatest ratio follows the length closely: prose and random base64 words come within 0.04
    of each other there, and such a text has no second chunk to tell them apart.
    """

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = ((0, 0.0, float("inf")), (128, 0.30, 0.95), (192, 0.30, 0.88), (256, 0.30, 0.83), (384, 0.30, 0.78), (512, 0.25, 0.74), (768, 0.25, 0.72), (1024, 0.25, 0.70), (2048, 0.20, 0.70), (8192, 0.15, 0.65))
    chunk: int = 2048
    stray: float = 0.25
    below: float = 5.0
    above: float = 7.0
    least: int = 50
    #: A median deviation counts as this share of the median at least, so a corpus of near copies rejects nothing else.
    spread: float = 0.01

    def fixed(self, size: int) -> tuple[float, float]:
        return next((low, high) for at, low, high in reversed(self.whole) if size >= at)


def half_octave(size: int) -> int:
    """Whole part of twice the binary logarithm, exactly."""
    return (size * size).bit_length() - 1 if size else 0


def pieces(raw: bytes, chunk: int) -> list[bytes]:
    """The chunks of a text; a rest of less than a quarter of one goes with the last."""
    cuts = list(range(0, max(1, len(raw)), chunk))
    if len(cuts) > 1 and 4 * (len(raw) - cuts[-1]) < chunk:
        cuts.pop()
    return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


@dataclass
class Limits:
    """Measured limits: (kind, half octave) -> (least, greatest) ratio; kind 0 is a whole text, 1 a chunk."""

    bands: Bands
    measured: dict[tuple[int, int], tuple[float, float]]

    def holds(self, kind: int, size: int, packed: int) -> bool:
        """Whether the ratio of a text or chunk is within both sets of limits; an empty one passes."""
        if not size:
            return True
        ratio = packed / size
        low, high = self.bands.fixed(size)
        least, most = self.measured.get((kind, half_octave(size)), (0.0, float("inf")))
        return max(low, least) <= ratio <= min(high, most)

    def verdict(self, sizes: list[int], packed: list[int]) -> tuple[bool, float]:
        """(whether a text passes, its share of bytes in stray chunks). The whole comes first, then the chunks."""
        stray = sum(n for n, z in zip(sizes[1:], packed[1:], strict=True) if not self.holds(1, n, z))
        share = stray / max(1, sizes[0])
        return self.holds(0, sizes[0], packed[0]) and share <= self.bands.stray, share


def measure(values: DataFrame, bands: Bands) -> Limits:
    """Limits from rows (size, packed, kind); null sizes are left out. What reaches the driver is a histogram of ratios in
    steps of 1/4096 for each kind and half octave, whatever the number of rows."""
    step = 4096
    octave = F.length(F.bin(F.col("size").cast("long") * F.col("size"))) - 1  # half_octave
    seen = values.where("size > 0").distinct().groupBy("kind", octave.alias("octave"), F.floor(F.col("packed") * step / F.col("size")).alias("bin")).count()
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in seen.collect():
        found.setdefault((r["kind"], r["octave"]), []).append((r["bin"], r["count"]))
    measured = {}
    for key, bins in found.items():
        x, n = np.array(sorted(bins)).T
        if n.sum() < bands.least:
            continue
        middle = _median((x + 0.5) / step, n)
        spread = max(_median(np.abs((x + 0.5) / step - middle), n), bands.spread * middle)
        measured[key] = middle - bands.below * spread, middle + bands.above * spread
    return Limits(bands, measured)


def _median(x: np.ndarray, n: np.ndarray) -> float:
    """The least value that half of the weight does not exceed."""
    order = np.argsort(x, kind="stable")
    return float(x[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words that lie in a window of n words which occurs twice or more in the text."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key = x[: len(x) - n + 1].copy()
    for i in range(1, n):
        # renumbered at each step, so a pair of numbers always fits 64 bits
        key = np.unique(key, return_inverse=True)[1] * len(ids) + x[i : len(x) - n + 1 + i]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.zeros(len(x), bool)
    twice = count[at] >= 2
    for i in range(n):
        hit[i : len(x) - n + 1 + i] |= twice
    return int(hit.sum())


def quality_rules(docs: DataFrame, *, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    ratio, stray_share.

    A null text is an empty one: no words, so it fails the base rules. Repeated rows are judged alike. Other columns are
    not read. Texts are read once; the limits are measured from what that pass wrote, a few numbers a document.
    """
    scratch = scratch or Scratch(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=bands.level)
        for b in slices(batches):
            rows = []
            for text in b["_text"].to_pylist():
                text = text or ""
                raw = text.encode("utf-8", "surrogatepass")
                words = raw.split()
                lines = [x for x in raw.split(b"\n") if x.strip()]
                repeat = repeated_words(words)
                failed = len(words) < 50 or 100 * repeat > 50 * len(words)
                parts = [raw, *pieces(raw, bands.chunk)]
                rows.append((len(words), len(text) - len(raw) + len(raw.translate(None, SPACE)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, list(map(len, parts)), [len(z.compress(x)) for x in parts]))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b["_id"], *columns], names=names)

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    names = ["_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_sizes", "_packed"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.list_(pa.int32())] * 2
    sql = [own.schema["_id"].dataType.simpleString(), *["long"] * 5, "boolean", *["array<int>"] * 2]
    counted = scratch.save(own.mapInArrow(judge, ", ".join(f"{n} {k}" for n, k in zip(names, sql, strict=True))), "counted")
    parts = counted.where("not base_failed").select(F.explode(F.transform(F.arrays_zip("_sizes", "_packed"), lambda x, i: F.struct(x["_sizes"].alias("size"), x["_packed"].alias("packed"), (i > 0).cast("int").alias("kind")))).alias("p")).select("p.*")
    shared = docs.sparkSession.sparkContext.broadcast(measure(parts, bands))

    @F.pandas_udf("passes boolean, share double")
    def verdict(sizes: pd.Series, packed: pd.Series) -> pd.DataFrame:
        found = [shared.value.verdict(a.tolist(), b.tolist()) for a, b in zip(sizes, packed, strict=True)]
        return pd.DataFrame(found, columns=["passes", "share"])

    ratio = F.when(F.col("_sizes")[0] > 0, F.col("_packed")[0] / F.col("_sizes")[0]).otherwise(1.0)
    out = counted.withColumn("_v", verdict("_sizes", "_packed"))
    return out.select(F.col("_id").alias(id_col), *names[1:7], (~F.col("base_failed") & F.col("_v.passes")).alias("kept"), ratio.alias("ratio"), F.col("_v.share").alias("stray_share"))
