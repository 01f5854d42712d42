"""Ids of texts by way of their distinct units and words, and the tokenizers library over these.

A unit is what begins at a single space that has a non-space on either side, or at the text's start. A byte-level
pre-tokenizer always starts a new piece at such a space, and what follows it depends on nothing before it, so a text's ids
are its units' ids in order. Where a pre-tokenizer never takes punctuation or a line's end together with letters (``Encoder``), units
also begin at a mark after an ASCII letter and after a line's end between non-spaces, so that a word is the same unit before any mark. Many texts are taken together: their units are found and counted as Arrow binary dictionaries,
so that Python sees each of them once, and a worker keeps the ids of the units and words it met lately, up to a bound.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from .common import cells, held

#: The pieces of a byte-level pre-tokenizer, used for texts in the scripts where all libraries agree on letter classes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECES = regex.compile(PATTERN)
_BEYOND = re.compile("[^\u0000-\u024f]")
#: Units and words in one generation of what a worker remembers.
UNITS, WORDS = 150_000, 300_000
#: Characters of texts taken together.
TEXT = 8_000_000
_WHITE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MARKS = frozenset(bytes([b]) for b in b".,;:!?)\"'")

_loaded: dict[str, object] = {}


class Recent:
    """What was met lately: two generations of bounded size, the older of which is dropped when the newer is full."""

    def __init__(self, size: int):
        self.size, self.now, self.before = size, {}, {}

    def missing(self, keys: list) -> list:
        """The keys not remembered; all others are in ``now`` until the next call."""
        if len(self.now) > self.size:
            self.now, self.before = {}, self.now
        now, old = self.now, self.before
        absent = [key for key in keys if key not in now]
        if old:
            again = [key for key in absent if key in old]
            now.update(zip(again, map(old.__getitem__, again)))
            absent = [key for key in absent if key not in old]
        return absent


def packets(items: list, sizes: list[int], most: int) -> Iterator[list]:
    """The items in turn, in lists of ``most`` size together or of one item."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield items[start:i]
            start, total = i, 0
        total += size
    if items[start:]:
        yield items[start:]


class UnitCoder:
    """Ids of texts from those of their distinct words.

    ``divide`` gives the words of a unit, ``learn`` the ids (native unsigned 32-bit) of new words in turn. Without ``cut``
    a text is one unit.
    """

    def __init__(self, divide: Callable[[str], list[str]], learn: Callable[[list[bytes]], list[bytes]], cut: bool, marks: bytes | None = None):
        self.divide, self.learn, self.cut = divide, learn, cut
        self.marks = None if marks is None else np.isin(np.arange(256), list(marks))
        self.units, self.words = Recent(UNITS), Recent(WORDS)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [ids for some in packets(texts, list(map(len, texts)), TEXT) for ids in self._encode(some)]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        content = [t.encode() for t in texts]
        ends = np.cumsum([len(c) for c in content])
        starts, data = unit_starts(texts, content, ends, self.cut, self.marks), b"".join(content)
        offsets = np.append(starts, len(data))
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which, distinct = units.indices.to_numpy(), cells(units.dictionary)
        self._meet(self.units.missing(distinct))
        ids = list(map(self.units.now.__getitem__, distinct))
        sizes = np.array([len(x) for x in ids], np.int64) // 4
        flat, first = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(sizes) - sizes
        n = sizes[which]
        before = np.append(0, np.cumsum(n))
        out = flat[np.repeat(first[which] - before[:-1], n) + np.arange(before[-1])]
        at = before[np.searchsorted(starts, ends)].tolist()
        return [out[a:b] for a, b in zip([0, *at], at)]

    def _meet(self, fresh: list[bytes]) -> None:
        """Learn units not met lately."""
        one, more = [], {}
        for u in fresh:
            if self.cut and (u[1:] if u[:1] == b" " else u).isalpha():  # ASCII letters
                one.append(u)
            elif self.cut and u[:1] == b" " and u[1:-1].isalpha() and u[-1:] in _MARKS:
                more[u] = (u[:-1], u[-1:])
            else:
                text = u.decode()
                plain, word = self.cut and not _BEYOND.search(text), text.removeprefix(" ")
                if plain and word.isalpha():
                    one.append(u)
                elif plain and word[:-1].isalpha() and u[-1:] in _MARKS:
                    more[u] = (u[:-1], u[-1:])
                else:
                    more[u] = [w.encode() for w in self.divide(text)]
        new = self.words.missing(list(dict.fromkeys(chain(one, chain.from_iterable(more.values())))))
        words, units = self.words.now, self.units.now
        words.update(zip(new, self.learn(new), strict=True))
        units.update(zip(one, map(words.__getitem__, one)))
        known = words.__getitem__
        units.update((u, known(parts[0]) + known(parts[1]) if len(parts) == 2 else b"".join(map(known, parts))) for u, parts in more.items())


def unit_starts(texts: list[str], content: list[bytes], ends: np.ndarray, cut: bool, marks: np.ndarray | None = None) -> np.ndarray:
    """Byte places in the contents, one after the other, where units start; with ``marks`` (by byte), at these and after lines too."""
    sizes = np.array([len(c) for c in content], np.int64)
    own = (ends - sizes)[sizes > 0]
    if not cut or not len(own):
        return own
    raw = np.frombuffer(b"".join(content), np.uint8)
    white = _WHITE[raw]
    for text, end, size in zip(texts, ends.tolist(), sizes.tolist()):
        if not text.isascii() and _WIDE.search(text):  # has other white space: nothing next to its wide characters is cut
            white[end - size : end] |= raw[end - size : end] >= 0x80
    start = np.zeros(len(raw), bool)
    start[1:-1] = (raw[1:-1] == 0x20) & ~white[:-2] & ~white[2:]
    start[ends[sizes > 0] - 1] = False  # a text's last character
    if marks is not None:
        start[1:] |= marks[raw[1:]] & _LETTER[raw[:-1]]
        start[2:] |= (raw[1:-1] == 0x0A) & ~white[:-2] & ~white[2:]
    start[own] = True
    return np.flatnonzero(start)


def load(path: str):
    """The tokenizer of a file, once per worker; its own threads stay off, as Spark has the cores."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _loaded[path] = tok
    return _loaded[path]


class Encoder(UnitCoder):
    """Ids by the tokenizers library. One per worker and file."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.model = self.tok.model
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.letters = {b: c for b, c in _byte_letters()}
        self.mark = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        super().__init__(lambda unit: [unit] if self._odd(unit) else _PIECES.findall(unit), self._ids, True, b"".join(_MARKS - {bytes([b]) for x in self.specials for b in x.encode()}))

    def _odd(self, unit: str) -> bool:
        """Whether the library takes the unit as a whole: it has a special string, or letters beyond those agreed on."""
        return bool(not unit.isascii() and _BEYOND.search(unit) or self.mark.search(unit))

    def _ids(self, words: list[bytes]) -> list[bytes]:
        space, ids, ends, tokenize = self.letters[0x20], [], [0], self.model.tokenize
        for w in words:
            if w[:1] == b" " and (rest := w[1:]).isalpha():
                ids += [t.id for t in tokenize(space + rest.decode())]
            elif self._odd(text := w.decode()):
                ids += self.tok.encode(text, add_special_tokens=False).ids
            else:
                ids += [t.id for t in tokenize(w.decode("latin-1").translate(self.letters))]
            ends.append(4 * len(ids))
        data = array("I", ids).tobytes()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0].tobytes()


def _byte_letters():
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    spare = 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            yield b, chr(b)
        else:
            yield b, chr(spare)
            spare += 1


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    return held(("encoder", path), lambda: Encoder(path))
