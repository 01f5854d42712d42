"""Secret scans: fixed patterns, plus password guess-cost dynamic programming on credential-context values.

Every value found next to a credential word is segmented at minimum cost into dictionary words, dates, repeats,
keyboard walks and brute-force spans; the cost is the base-10 logarithm of the guesses an attacker needs who
knows those habits. Values at or above ``min_log10`` are reported as kind ``guess``, the value alone. The pattern kinds
(``assign``, ``access``, ``hex``) are always reported, whether their value is also a ``guess`` or not.

The dictionary is the short list below, then the commonest words of the texts themselves, counted over all of them in Spark and
ranked by frequency; its size is a bound of the model (``DICTIONARY``).

Defined results: a null text is empty and has no spans; repeated rows are scanned each on its own; an empty
table gives no rows; extra columns are ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held, map_rows, text_of

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10 = 9.0

#: Common words of passwords, most common first (a short list of our own; cost grows with rank).
WORDS = (
    "password pass word admin root user login welcome letmein secret default change changeme test example sample "
    "demo guest master server service system public private key token access my the your this that love hello "
    "dragon monkey shadow sunshine princess football baseball summer winter spring autumn monday friday january "
    "february march april june july august september october november december money power super star magic "
    "freedom computer internet dummy placeholder none null true false temp backup database data mysql postgres "
    "oracle redis mongo docker local host dev prod stage staging production company office home house family"
).split()
#: Words of the texts in the dictionary, and the letters they have.
DICTIONARY, SHORTEST, LONGEST = 20_000, 3, 16
#: Rows of a common keyboard, and how far each is shifted to the right, in keys.
KEYBOARD, SHIFT = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"), (0.0, 0.5, 0.75, 1.25)

_ASCII = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Credential contexts: names with a value, "password is x", bearer headers, user:value@host. A quoted value runs to its closing
#: quote on the line, another one to white space, a quote or a bracket of markup; a host's to the last @ before a slash.
CONTEXT = re.compile(
    r"""(?:(?:password|passwd|secret|token|api_?key|pwd|passphrase|credential|auth|private_?key|access_?key|client_?secret)["']?\x20*[:=]\x20*|(?:password|passphrase|secret|token)\x20+is:?\x20+|bearer\x20+)"""
    r"""(?:"(?!\s)([^"\r\n]{6,})(?<!\s)"(?![a-z0-9])|'(?!\s)([^'\r\n]{6,})(?<!\s)'(?![a-z0-9])|["']?([^\s"'<>]{6,}))|://[A-Za-z0-9_.-]+:([^\s"'<>/]{6,}(?=@)|[^\s"'<>@,;]{6,})""",
    _ASCII,
)
_CUES = ("pwd", "pass", "cred", "auth", "key", "secret", "token", "bearer", "://")
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
#: Dates, with the guesses that each kind takes.
DATES = tuple((re.compile(p), n) for p, n in ((f"{_YEAR}[-/._]?{_MONTH}[-/._]?{_DAY}", 365 * 120), (f"{_DAY}[-/._]?{_MONTH}[-/._]?{_YEAR}", 365 * 120), (_YEAR, 120)))
_LEET = str.maketrans("@4301!5$7", "aaeoiisst")
_KEYS = {c: (x + SHIFT[y], y) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}
#: Cost of opening one more segment: the attacker also guesses where it ends.
SEGMENT = math.log10(2)
#: Longest unit of a repeat, and the choices at a turn of a keyboard walk.
UNIT, TURN = 8, 4.6


def char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 52 if c.isupper() else 26 if c.isalpha() else 33)


def step_of(a: str, b: str) -> tuple[int, int] | None:
    """The direction (left or right, up or down) from a key to a neighbour; None if they are none."""
    if a not in _KEYS or b not in _KEYS:
        return None
    dx, dy = _KEYS[b][0] - _KEYS[a][0], _KEYS[b][1] - _KEYS[a][1]
    return ((dx > 0) - (dx < 0), dy) if abs(dx) <= 1 and abs(dy) <= 1 and (dx or dy) else None


def next_letter(a: str, b: str) -> tuple[int, int] | None:
    return (ord(b) - ord(a), 0) if "a" <= a <= "z" and "a" <= b <= "z" and abs(ord(b) - ord(a)) == 1 else None


class Guesser:
    """Guess costs with a dictionary, most common words first."""

    def __init__(self, words: Iterable[str] = ()):
        self.rank: dict[str, int] = {}
        for w in (*WORDS, *words):
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))

    def cost(self, value: str) -> float:
        """Least log10(guesses) over all segmentations; linear in the length, as a place begins a bounded number of segments:
        words, dates, and of every unit's repeats and of walks the longest from there."""
        n, low = len(value), value.lower()
        low = low if len(low) == n else value
        plain = low.translate(_LEET)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]

        def add(i: int, j: int, cost: float) -> None:
            ends[j].append((i, cost + SEGMENT))

        for i in range(n):
            for j in range(i + SHORTEST, min(n, i + self.longest) + 1):
                if (r := self.rank.get(plain[i:j])) is not None:
                    add(i, j, math.log10(r * (1 if value[i:j] == low[i:j] else 2) * (1 if plain[i:j] == low[i:j] else 2) + 1))
            for pattern, guesses in DATES:
                if m := pattern.match(value, i):
                    add(i, m.end(), math.log10(guesses))
        self._walks(low, step_of, len(_KEYS), add)
        self._walks(low, next_letter, 26, add)
        units: dict[str, float] = {}
        for p in range(1, min(UNIT, n // 2) + 1):
            same = 0
            for i in range(n - p - 1, -1, -1):  # ``same``: characters from i on that are those ``p`` places on
                same = same + 1 if value[i] == value[i + p] else 0
                times = same // p + 1
                if times >= (3 if p == 1 else 2):
                    unit = value[i : i + p]
                    if unit not in units:
                        units[unit] = char_cost(unit) if p == 1 else self.cost(unit)
                    add(i, i + p * times, units[unit] + math.log10(times))
        best = [0.0] + [math.inf] * n  # over prefixes
        brute = [math.inf] * (n + 1)  # the prefix ends inside a brute-force span
        for j in range(1, n + 1):
            brute[j] = min(brute[j - 1], best[j - 1] + SEGMENT) + char_cost(value[j - 1])
            best[j] = min([brute[j], *(best[i] + c for i, c in ends[j])])
        return best[n]

    def _walks(self, low: str, step, starts: int, add) -> None:
        """Walks of three keys and more, each as long as it goes from its start."""
        n, end, turns = len(low), len(low), 1
        steps = [step(a, b) for a, b in zip(low, low[1:])]
        for i in range(n - 2, -1, -1):
            if steps[i] is None:
                end, turns = i + 1, 1
                continue
            if i + 1 < end - 1 and steps[i + 1] != steps[i]:
                turns += 1
            elif i + 1 >= end - 1:
                turns = 1
            if end - i >= 3:
                add(i, end, math.log10(starts) + math.log10(end - i) + turns * math.log10(TURN))


def guess_cost(value: str) -> float:
    """The cost with the short list alone."""
    return _PLAIN.cost(value)


_PLAIN = Guesser()


def find_spans(text: str, min_log10: float = MIN_LOG10, guesser: Guesser = _PLAIN) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all findings, by start and then kind."""
    found = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                found.append((m.start(), m.end(), "assign"))
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    low = text.lower()
    if any(c in low for c in _CUES):
        for m in CONTEXT.finditer(text):
            value, (start, end) = m[m.lastindex], m.span(m.lastindex)
            if m.lastindex == 3:  # without quotes, what divides it from the next thing is no part of it
                value = value.rstrip(",;")
                end = start + len(value)
            if len(value) >= 6 and guesser.cost(value) >= min_log10:
                found.append((start, end, "guess"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones merged) replaced by the mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if end > at:
            if start >= at:
                out += [text[at:start], mark]
            at = end
    return "".join(out) + text[at:]


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> tuple[str, ...]:
    """The commonest words of ASCII letters in all texts, most common first, of equals the first in order: ``size`` at most, where
    words that occur equally often are all in or all out. How many words occur how often settles the least number, so that no more
    than the dictionary comes to the driver."""
    word = F.explode(F.regexp_extract_all(F.lower(text_of(text_col)), F.lit(f"[a-z]{{{SHORTEST},}}"), 0)).alias("word")
    counts = cut(docs.select(word).where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n")))
    least, total = None, 0
    for n, words in sorted(map(tuple, counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True):
        total += words
        if total > size:
            break
        least = n
    if least is None:
        return ()
    return tuple(w for _, w in sorted((-r["n"], r["word"]) for r in counts.where(F.col("n") >= least).collect()))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10: float = MIN_LOG10, words: tuple[str, ...] | None = None) -> DataFrame:
    """Per document: counts by kind, all spans, and the digest of the pattern spans. ``words`` defaults to the texts' own."""
    key = docs.schema[id_col].dataType.simpleString()
    words = dictionary(docs, text_col) if words is None else words

    def make():
        guesser = held(("secrets", words), lambda: Guesser(words))

        def one(text):
            spans = find_spans(text, min_log10, guesser)
            kinds = [k for _, _, k in spans]
            base = listed([s for s in spans if s[2] != "guess"])
            return (*map(kinds.count, KINDS), hashlib.sha256(base.encode()).hexdigest(), listed(spans))

        return lambda columns: [columns[0], *zip(*map(one, columns[1]))] if columns[0] else [[] for _ in range(7)]

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col))
    return map_rows(rows, make, f"doc_id {key}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redacted(text: Column, words: tuple[str, ...] = (), min_log10: float = MIN_LOG10) -> Column:
    """A column of texts with secrets masked; null stays null."""

    @F.arrow_udf("string")
    def mask(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        guesser = held(("secrets", words), lambda: Guesser(words))
        for part in texts:
            yield pa.array([t if t is None else redact(t, find_spans(t, min_log10, guesser)) for t in part.to_pylist()], pa.string())

    return mask(text)
