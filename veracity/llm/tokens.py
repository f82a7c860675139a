r"""Token ids of whole texts by a tokenizer of the tokenizers library.

A byte-pair tokenizer first cuts a text into pre-tokens and then treats each alone, so a worker encodes each
pre-token with the library once and looks it up after that. In texts of Latin-1 characters the two supported
pre-token patterns are stated by the classes of the bytes and their neighbours, so many texts are cut at once, and
each distinct pre-token of them is looked up once. Other texts, and those with an apostrophe, whose short forms
come before all else, are cut by expressions: into pre-tokens if Latin-1, else only where no pre-token can
reach across, into white space with the visible characters that follow, and the library cuts those further.

Strings of special tokens in a text are ordinary text, as the tokenizers' own notes have it, so no document can write an end
mark; with ``specials`` they become special ids, which is the library's setting where none is made.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Unicode's White_Space, which the tokenizers' patterns mean by \s (Python's \s has four more).
WHITE = "\t-\r \x85\xa0  -     　"
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
WORD = re.compile(f"[^{WHITE}]+")
#: Letters, numbers and white space among the Latin-1 characters.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
LATIN_UNIT = re.compile(f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
LATIN_WORD = re.compile(f"{_SHORT}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


#: By Latin-1 byte: 0 white space, 1 letter, 2 number, 3 other.
CLASS = np.full(256, 3, np.uint8)
for _k, _set in enumerate((_S, _L, _N)):
    CLASS[[i for i in range(256) if re.match(f"[{_set}]", chr(i))]] = _k


def starts(data: np.ndarray, docs: np.ndarray, drops_space: bool) -> np.ndarray:
    """Where pre-tokens start in texts laid end to end, which begin at ``docs`` (ascending, none empty).

    Without spaces: where the class of a visible byte changes, and at each number. Else of a run of white space all but
    the last byte are one pre-token; the last goes with the visible bytes after it if it is a space, and is one of its own
    if not; a run that ends a text is one pre-token.
    """
    kind = CLASS[data]
    new = np.empty(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[docs] = True
    if drops_space:
        return (new | (kind == 2)) & (kind > 0)
    white = kind == 0
    before_visible = np.zeros(len(data), bool)
    before_visible[:-1] = white[:-1] & ~white[1:]
    before_visible[docs[1:] - 1] = False
    after_space = np.zeros(len(data), bool)
    after_space[1:] = (data[:-1] == 32) & ~white[1:]
    after_space[docs] = False
    return (new | before_visible) & ~after_space


#: By tokenizer, for the life of a worker: tasks that follow each other share what is known.
_encoders: dict[tuple[int, bool, bool], Encoder] = {}


class Encoder:
    """Packs ids as little-endian 16-bit numbers. ``spec`` is the tokenizer's JSON text, read on the driver.

    ``drops_space``: the tokenizer lower-cases, and cuts into words without white space; else it is byte-level and
    a word takes the space before it.
    """

    def __init__(self, spec: str, *, drops_space: bool, specials: bool = False, keep: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = not specials
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if specials else []
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits are not supported")
        self.drops_space, self.keep = drops_space, keep
        self.known: dict[str | bytes, bytes] = {}  # bytes are Latin-1 units
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        #: Whether an id ends a word, or starts one with its space.
        self.edge = np.array([n.endswith("</w>") if drops_space else n.startswith("Ġ") for n in names])

    @classmethod
    def shared(cls, spec: str, *, drops_space: bool, specials: bool = False, keep: int = 400_000) -> Encoder:
        key = hash(spec), drops_space, specials
        if key not in _encoders:
            _encoders[key] = cls(spec, drops_space=drops_space, specials=specials, keep=keep)
        return _encoders[key]

    def units(self, text: str) -> list[str]:
        if self._marked(text):
            return [text]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return (WORD if self.drops_space else UNIT).findall(text)
        return LATIN_WORD.findall(text.lower()) if self.drops_space else LATIN_UNIT.findall(text)

    def _marked(self, text: str) -> bool:
        """Whether the text holds a special token's string that counts as one; the library then gets it whole."""
        low = text.lower() if self.marks else ""
        return any(m.lower() in low for m in self.marks)

    def _encode(self, units: list[str]) -> list[bytes]:
        """The ids of each unit. Single pre-tokens are encoded in one string: their ends (or starts) are told by the
        ids, and as each has at least one, the counts agree only if each has exactly one. Else each goes alone."""
        if not (self.marks and any(map(self._marked, units))) and (self.drops_space or all(u[0] == " " for u in units)):
            ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.drops_space else "").join(units)], add_special_tokens=False)[0].ids, "<u2")
            at = np.flatnonzero(self.edge[ids])
            if len(at) == len(units):
                cuts = (2 * np.r_[0, at + 1] if self.drops_space else 2 * np.r_[at, len(ids)]).tolist()
                flat = ids.tobytes()
                return [flat[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _look_up(self, units: list) -> list[bytes]:
        """The ids of distinct units, all text or all Latin-1 bytes. Units met when the store is full are not kept."""
        found = list(map(self.known.get, units))
        at = [i for i, x in enumerate(found) if x is None]
        if at:
            names = [units[i] if isinstance(units[i], str) else units[i].decode("latin-1") for i in at]
            spaced = [] if self.drops_space else [i for i, u in enumerate(names) if u[0] == " "]
            other = sorted(set(range(len(names))).difference(spaced)) if spaced else range(len(names))
            for own in (other, spaced):
                for i, ids in zip(own, self._encode([names[i] for i in own]) if own else (), strict=True):
                    found[at[i]] = ids
            if len(self.known) < self.keep:
                self.known.update((units[i], found[i]) for i in at)
        return found

    def _many_latin(self, texts: list[bytes]) -> list[bytes]:
        """Non-empty Latin-1 texts without an apostrophe (lower-cased already if need be)."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        docs = np.cumsum(size) - size
        data = np.frombuffer(b"".join(texts), np.uint8)
        new = starts(data, docs, self.drops_space)
        units_in = np.searchsorted(np.flatnonzero(new), docs + size)
        if self.drops_space:
            visible = CLASS[data] > 0
            data, new = np.compress(visible, data), np.compress(visible, new)
        at = np.append(np.flatnonzero(new), len(data)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        which = units.indices.to_numpy()
        ids = self._look_up(units.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), "<u2")
        long = np.fromiter(map(len, ids), np.int64, len(ids)) >> 1
        first = np.cumsum(long) - long
        n = long[which]
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        out = flat[np.arange(total, dtype=kind) + np.repeat((first[which] - (stop - n)).astype(kind), n)].tobytes()
        bounds = np.r_[0, stop][np.r_[0, units_in]] * 2
        return [out[i:j] for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]

    def many(self, texts: list[str | None], end: Iterable[int] = (), group: int = 8 << 20) -> Iterator[bytes]:
        """The ids of each text, followed by the end ids; texts are taken in groups of so many characters."""
        last = np.array(list(end), "<u2").tobytes()
        held: list[bytes | str] = []
        size = 0
        for k, text in enumerate(texts):
            text = text or ""
            size += len(text)
            held.append(text)
            if "'" not in text and not self._marked(text):
                try:
                    raw = text.encode("latin-1")
                    held[-1] = text.lower().encode("latin-1") if self.drops_space else raw
                except UnicodeEncodeError:
                    pass
            if size >= group or k == len(texts) - 1:
                latin = iter(self._many_latin(own) if (own := [x for x in held if isinstance(x, bytes) and x]) else ())
                slow = [self.units(x) if isinstance(x, str) else [] for x in held]
                distinct = list(set().union(*slow))
                ids = dict(zip(distinct, self._look_up(distinct), strict=True))
                for x, units in zip(held, slow, strict=True):
                    yield (b"".join(map(ids.__getitem__, units)) if isinstance(x, str) else next(latin) if x else b"") + last
                held, size = [], 0

    def __call__(self, text: str | None, end: Iterable[int] = ()) -> bytes:
        return next(self.many([text], end))


def read_spec(path: str) -> str:
    """The tokenizer's file, read on the driver; executors get its text and need no file."""
    with open(path, encoding="utf-8") as f:
        return f.read()
