"""Token counts by overlap resynchronisation.

Documents up to ``chunk`` characters are encoded whole. Longer ones are cut into overlapping chunks, each encoded
with offsets on its own, and spliced where two neighbours have a proven common boundary.

Proof. The pre-tokenizer scans left to right and what it does from a piece's start on depends on the text from
there only. So if both encodings start a piece at one place, they agree from there on, except for what the end of
the left chunk or the start of the right one may have cut: a piece or special string running over that edge. Places
closer to an edge than ``guard`` (longer than any special string) are not used, and neither is a left chunk's last
piece. If an overlap has no common boundary (a piece longer than the overlap), the overlap is doubled and the left
chunk encoded again, up to the whole document.

Defined results: a null text is empty with 0 tokens; repeated rows are counted each on its own; an empty table
gives no rows; extra columns are ignored; a null id is passed through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_of
from .units import Encoder, encoder

CHUNK, OVERLAP = 32_768, 512


def pieces(encoder_: Encoder, text: str) -> tuple[list[int], list[int], int]:
    """Piece starts (characters), tokens before each of them, and all tokens."""
    e = encoder_.tok.encode(text, add_special_tokens=False)
    starts, before, last = [], [], None
    for i, (word, (start, _)) in enumerate(zip(e.word_ids, e.offsets)):
        if word is None or word != last:
            starts.append(start)
            before.append(i)
        last = word
    return starts, before, len(e.ids)


def common_boundary(left: list[int], right: list[int], low: int, high: int) -> int | None:
    """The first place from ``low`` to ``high`` in both sorted lists."""
    i, j = bisect_left(left, low), bisect_left(right, low)
    while i < len(left) and j < len(right) and left[i] <= high and right[j] <= high:
        if left[i] == right[j]:
            return left[i]
        if left[i] < right[j]:
            i += 1
        else:
            j += 1
    return None


def count_spliced(text: str, encode: Callable[[str], tuple[list[int], list[int], int]], guard: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, from chunks of ``chunk`` characters and the overlap after each.

    ``begin`` is a true boundary throughout: all tokens before it are counted.
    """
    n, begin, total = len(text), 0, 0
    while begin < n:
        edge, more = begin + chunk, overlap
        while True:
            stop = edge + more
            if stop >= n:
                return total + encode(text[begin:])[2]
            starts, before, _ = encode(text[begin:stop])
            right = [edge + s for s in encode(text[edge : stop + more])[0]]
            at = common_boundary([begin + s for s in starts], right, edge + guard, stop - guard)
            if at is not None:
                total += before[bisect_left(starts, at - begin)]
                begin = at
                break
            more *= 2  # no boundary in common: widen
    return total


def count(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row, with the tokenizer file at ``path``."""

    def make():
        enc = encoder(path)
        guard = max(map(len, enc.specials), default=0) + 2

        def tokens(texts: list[str]) -> list[int]:
            short = iter(enc.encode_all([t for t in texts if len(t) <= chunk]))
            return [len(next(short)) if len(t) <= chunk else count_spliced(t, lambda part: pieces(enc, part), guard, chunk, overlap) for t in texts]

        return lambda c: [c[0], [len(t.encode()) for t in c[1]], tokens(c[1])]

    key = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col)), make, f"doc_id {key}, n_bytes long, n_tokens long")
