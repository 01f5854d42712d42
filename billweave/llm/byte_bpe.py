"""Byte-level BPE as recursive queries of DuckDB, run per partition inside Spark tasks.

Encoding: a text's pattern matches are words. Words not met before by the worker become token-position rows
(word, position, id); a recursive query joins neighbouring rows with the merge table, contracts each word's leftmost
pair of least rank, and goes on until no word has a pair left. A word that is itself in the vocabulary is one token. Words of
over ``LONG`` bytes go through a query of their own, whose rounds are as many as the different ranks they merge by, not as
the merges.
Decoding: token-position rows join the vocabulary and an ordered aggregation concatenates the bytes.

The merge table has, for every token, each of its two-part splits into tokens, so joining it is the same as looking
up the concatenation's rank. DuckDB has one thread in each task, as Spark has the cores.

Defined results: a null text is empty, with no tokens and empty bytes; repeated rows are encoded each on its own; an
empty table gives no rows; extra columns are ignored; a null id is passed through.
"""

from __future__ import annotations

import base64
import hashlib
import sys

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_rows, text_of
from .units import PATTERN, UnitCoder, packets

#: Bytes of words, and tokens, that a query takes at once; bytes from which a word is long; tokens of a text decoded as one run.
AT_ONCE, TOKENS, LONG, RUN = 400_000, 1_000_000, 96, 65_536

#: Documents taken together: new words are learned from all of them, as a recursive query builds its join tables once a round.
DOCUMENTS = 2000

#: A token's place is its word's number times 2^32, plus its position; a pair's key its rank times 2^32, plus its position,
#: so that the least key is the leftmost pair of least rank.
_ENCODE = """
WITH RECURSIVE step(place, id, live) AS (
    SELECT place, id, true FROM fresh
  UNION ALL (
    WITH paired AS MATERIALIZED (
        SELECT s.place, s.id, s.before, (m.rank::BIGINT << 32) | (s.place & 4294967295) AS key
        FROM (
            SELECT place, id, lag(place) OVER w AS before,
                   CASE WHEN (lead(place) OVER w) >> 32 = place >> 32 THEN (id::BIGINT << 32) | lead(id) OVER w END AS pair
            FROM step WHERE live WINDOW w AS (ORDER BY place)
        ) s LEFT JOIN merges m ON m.pair = s.pair
    ),
    leftmost AS (SELECT place >> 32 AS word, min(key) AS best FROM paired WHERE key IS NOT NULL GROUP BY place >> 32)
    SELECT p.place,
           CASE WHEN (p.place & 4294967295) = (best & 4294967295) THEN (best >> 32)::INTEGER ELSE p.id END,
           best IS NOT NULL
    FROM paired p LEFT JOIN leftmost ON leftmost.word = p.place >> 32
    WHERE best IS NULL OR before IS NULL OR before <> ((p.place >> 32 << 32) | (best & 4294967295))
  )
)
SELECT (place >> 32)::INTEGER AS word, list(id ORDER BY place) AS ids FROM step WHERE NOT live GROUP BY place >> 32
"""

#: The same for long words, whose rounds only give what changes (a token taken into the one before it becomes -1). A round takes all
#: places of a word's least rank, from left to right without overlaps, where the token made is safe: no merge with it as a part
#: ranks below it, so the rank stays the least until no place of it is left. Of other tokens it takes the leftmost.
_ENCODE_LONG = """
WITH RECURSIVE step(place, id) USING KEY (place) AS (
    SELECT place, id FROM fresh
  UNION (
    WITH paired AS MATERIALIZED (
        SELECT s.place, s.next_place, m.rank, m.safe
        FROM (
            SELECT place, lead(place) OVER w AS next_place,
                   CASE WHEN (lead(place) OVER w) >> 32 = place >> 32 THEN (id::BIGINT << 32) | lead(id) OVER w END AS pair
            FROM recurring.step WHERE id >= 0 WINDOW w AS (ORDER BY place)
        ) s JOIN merges m ON m.pair = s.pair
    ),
    least AS (SELECT place >> 32 AS word, min(rank) AS rank FROM paired GROUP BY place >> 32),
    found AS (
        SELECT p.*, p.place >> 32 AS word, coalesce(lag(next_place) OVER (ORDER BY place) <> place, true) AS apart
        FROM paired p JOIN least ON least.word = p.place >> 32 AND least.rank = p.rank
    ),
    runs AS (SELECT *, sum(apart::INTEGER) OVER (ORDER BY place) AS run, row_number() OVER (PARTITION BY word ORDER BY place) AS nth FROM found),
    taken AS (SELECT * FROM runs WHERE safe OR nth = 1 QUALIFY row_number() OVER (PARTITION BY run ORDER BY place) % 2 = 1)
    SELECT place, rank FROM taken UNION ALL SELECT next_place, -1 FROM taken
  )
)
SELECT (place >> 32)::INTEGER AS word, list(id ORDER BY place) AS ids FROM step WHERE id >= 0 GROUP BY place >> 32
"""

_DECODE = """
SELECT t.run, unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS bytes
FROM tokens t JOIN vocabulary v ON v.id = t.id GROUP BY t.run
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec(UnitCoder):
    """A worker's DuckDB with the vocabulary and merge tables, and the words it knows."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks = read_ranks(path)
        #: With the usual pattern a single space between non-spaces always starts a word, so texts can be cut there first.
        super().__init__(regex.compile(pattern).findall, self._ids, pattern == PATTERN)
        self.decimal = list(map(str, range(max(ranks.values()) + 1)))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "250MB"})
        splits = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        unsafe = {part for pair, r in splits for part in (pair >> 32, pair & 0xFFFFFFFF) if r < part}
        self._table("merges", (*zip(*splits), [r not in unsafe for _, r in splits]), ("pair", "rank", "safe"), (pa.int64(), pa.int32(), pa.bool_()))
        self._table("vocabulary", (list(ranks.values()), [t.hex() for t in ranks]), ("id", "hex"), (pa.int32(), pa.string()))

    def _table(self, name, columns, names, types) -> None:
        rows = pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Of words, one token each or by the recursive queries."""
        whole = list(map(self.ranks.get, words))
        out = [b"" if r is None else r.to_bytes(4, sys.byteorder) for r in whole]
        fresh = [i for i, r in enumerate(whole) if r is None and words[i]]
        for query, some in (_ENCODE, [i for i in fresh if len(words[i]) <= LONG]), (_ENCODE_LONG, [i for i in fresh if len(words[i]) > LONG]):
            for part in packets(some, [len(words[i]) for i in some], AT_ONCE):
                sizes = np.array([len(words[i]) for i in part])
                place = np.arange(sizes.sum()) + np.repeat((np.arange(len(part)) << 32) - (np.cumsum(sizes) - sizes), sizes)
                ids = self.single[np.frombuffer(b"".join([words[i] for i in part]), np.uint8)]
                self._table("fresh", (place, ids), ("place", "id"), (pa.int64(), pa.int32()))
                got = self.db.sql(query).to_arrow_table().combine_chunks()
                lists = got["ids"].chunk(0)
                flat, ends = lists.values.to_numpy().tobytes(), (4 * lists.offsets.to_numpy()).tolist()
                for i, start, end in zip(got["word"].to_pylist(), ends, ends[1:]):
                    out[part[i]] = flat[start:end]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        return [x.view(np.int32) for x in self.encode_all(texts)]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each id list, by the ordered aggregation over runs of ``RUN`` tokens at most."""
        runs = [(i, x[a : a + RUN]) for i, x in enumerate(ids) for a in range(0, len(x), RUN)]
        out: list[list[bytes]] = [[] for _ in ids]
        for some in packets(runs, [len(x) for _, x in runs], TOKENS):
            n = np.array([len(x) for _, x in some])
            run = np.repeat(np.arange(len(some), dtype=np.int32), n)
            pos = (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            self._table("tokens", (run, pos, np.concatenate([x for _, x in some])), ("run", "pos", "id"), (pa.int32(),) * 3)
            got = self.db.sql(_DECODE).to_arrow_table()
            content = dict(zip(got["run"].to_pylist(), got["bytes"].to_pylist()))
            for k, (i, _) in enumerate(some):
                out[i].append(content[k])
        return [b"".join(parts) for parts in out]


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a vocabulary file."""
    return held(("codec", path, pattern), lambda: Codec(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row."""
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col))
    return map_rows(rows, lambda: lambda c: [c[0], codec(path, pattern).encode(c[1])], f"doc_id {key}, ids array<int>", DOCUMENTS)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, content`` (the bytes) of rows ``doc_id, ids``; null ids are none."""
    key = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return map_rows(rows, lambda: lambda c: [c[0], codec(path, pattern).decode([np.array(x, np.int32) for x in c[1]])], f"doc_id {key}, content binary", DOCUMENTS)


def encode_checked(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decodes``: the ids, and whether they decode to the text's bytes."""
    key = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(columns):
            coder = codec(path, pattern)
            ids = coder.encode(columns[1])
            return [columns[0], list(map(len, ids)), ids, [t.encode() == b for t, b in zip(columns[1], coder.decode(ids))]]

        return work

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col))
    return map_rows(rows, make, f"doc_id {key}, n_tokens long, ids array<int>, decodes boolean", DOCUMENTS)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoding, digest and decoding in one pass, so that ids need not be stored."""
    key = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(columns):
            coder = codec(path, pattern)
            ids = coder.encode(columns[1])
            sums = [hashlib.sha256(",".join(map(coder.decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]
            back = [hashlib.sha256(b).hexdigest() for b in coder.decode(ids)]
            return [columns[0], list(map(len, ids)), sums, back]

        return work

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col))
    return map_rows(rows, make, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string", DOCUMENTS)
