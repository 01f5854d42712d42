"""Token ids as patched frame-of-reference blocks in shard files.

A shard file holds the ids of a run of documents, in ascending doc_id order:

    magic "PFOR0001"
    blocks: values less the block's minimum, packed at ``width`` bits (the narrowest that holds at least
            ``PERCENT`` of them); the rest are exceptions, stored after the packed words as places and high parts
    footer: block index (offset, ids, minimum, width, exceptions) and document index (id, null flag, ids)
    trailer: footer offset, number of blocks, number of documents, magic

Texts are encoded where they are read, and ids, not texts, are shuffled to the shards: ranges of (doc_id, hash of the text),
with bounds from a sample of about ``SAMPLE`` rows a shard, so that repeated or null ids don't make a shard of their own size. No
task and no driver sees more than its own shards, and a shard streams through its task. Files go to the shared folder under a
name of their own for every attempt, and only the names that finished tasks return are read, so a lost executor or a
repeated task leaves nothing but an unread file.

Defined results: a null text is empty and has only its end id; equal doc_ids are ordered by the hash of their texts; null
doc_ids come first; an empty table gives no shards and no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_uri, slices, text_of
from .units import encoder

BLOCK = 8192
PERCENT = 90
MAGIC = b"PFOR0001"
_INDEX = np.dtype([("offset", "<u8"), ("n", "<u4"), ("minimum", "<u4"), ("width", "<u1"), ("n_except", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("is_null", "<u1"), ("n", "<u8")])
#: Bytes of UTF-8 text per shard aimed at, rows sampled for the bounds of each, and shards whose sizes are summed up together.
SHARD_BYTES, SAMPLE, TOGETHER = 16_000_000, 40, 1024
#: Shards at most (of larger corpora, shards are larger): with them the sample that goes to the driver is bounded.
MOST_SHARDS = 16_384


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned values of ``width`` bits at most, 64 at a time into ``width`` words."""
    if not width:
        return b""
    groups = np.zeros((-(-len(values) // 64), 64), np.uint64)
    groups.reshape(-1)[: len(values)] = values
    words = np.zeros((len(groups), width + 1), np.uint64)
    for i in range(64):
        k, shift = divmod(i * width, 64)
        words[:, k] |= groups[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, k + 1] |= groups[:, i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words[:, :width]).tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint64)
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    out, low = np.empty((len(words), 64), np.uint64), np.uint64((1 << width) - 1)
    for i in range(64):
        k, shift = divmod(i * width, 64)
        part = words[:, k] >> np.uint64(shift)
        if shift + width > 64:
            part = part | words[:, k + 1] << np.uint64(64 - shift)
        out[:, i] = part & low
    return out.reshape(-1)[:n]


def encode_block(ids: np.ndarray, percent: int = PERCENT) -> tuple[bytes, int, int, int]:
    """(payload, minimum, width, exceptions) of a non-empty block."""
    minimum = int(ids.min())
    rest = (ids - np.uint32(minimum)).astype(np.uint64)
    sizes = np.bincount(np.frexp(rest.astype(float))[1], minlength=33)  # bits each value needs
    width = int(np.searchsorted(np.cumsum(sizes), percent * len(ids) / 100))
    odd = np.flatnonzero(rest >> np.uint64(width)).astype("<u4")
    high = (rest[odd] >> np.uint64(width)).astype("<u4")
    return pack(rest & np.uint64((1 << width) - 1), width) + odd.tobytes() + high.tobytes(), minimum, width, len(odd)


def decode_block(data: bytes, n: int, minimum: int, width: int, n_except: int) -> np.ndarray:
    packed = 8 * width * -(-n // 64)
    out = unpack(data[:packed], n, width)
    if n_except:
        odd = np.frombuffer(data, "<u4", n_except, packed)
        out[odd] |= np.frombuffer(data, "<u4", n_except, packed + 4 * n_except).astype(np.uint64) << np.uint64(width)
    return (out + np.uint64(minimum)).astype("<u4")


class ShardWriter:
    """Streams ids into blocks; holds one block of ids and the indexes."""

    def __init__(self, sink, block: int = BLOCK):
        self.sink, self.block = sink, block
        self.sink.write(MAGIC)
        self.at, self.n, self.blocks, self.docs, self.held, self.n_held = len(MAGIC), 0, [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= 16 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            part = ids[i : min(whole, i + self.block)]
            data, minimum, width, n_except = encode_block(part)
            self.sink.write(data)
            self.blocks.append((self.at, len(part), minimum, width, n_except))
            self.at += len(data)
        self.n += whole
        self.held, self.n_held = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> int:
        self._flush(True)
        self.sink.write(np.array(self.blocks, _INDEX).tobytes() + np.array(self.docs, _DOC).tobytes())
        self.sink.write(struct.pack("<QQQ", self.at, len(self.blocks), len(self.docs)) + MAGIC)
        self.sink.close()
        return self.n


def read_shard(source):
    """(doc_id, ids) of each document in order; at most one block beyond the document is in memory."""
    size = source.size()
    source.seek(size - 32)
    tail = source.read(32)
    foot, n_blocks, n_docs = struct.unpack("<QQQ", tail[:24])
    if tail[24:] != MAGIC:
        raise ValueError("not a whole shard file")
    source.seek(foot)
    blocks = np.frombuffer(source.read(n_blocks * _INDEX.itemsize), _INDEX)
    docs = np.frombuffer(source.read(n_docs * _DOC.itemsize), _DOC)
    ends = np.append(blocks["offset"][1:], foot).astype(np.int64)
    held, k = np.empty(0, "<u4"), 0
    for doc_id, null, n in docs.tolist():
        parts = [held]
        have = len(held)
        while have < n:
            b = blocks[k]
            source.seek(int(b["offset"]))
            parts.append(decode_block(source.read(int(ends[k] - int(b["offset"]))), int(b["n"]), int(b["minimum"]), int(b["width"]), int(b["n_except"])))
            have += len(parts[-1])
            k += 1
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield None if null else doc_id, held[:n]
        held = held[n:]


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def bounds(rows: DataFrame, shards: int, n: int) -> list[tuple[bool, int, int]]:
    """Least keys of all shards but the first, by a sample of ``doc_id, h``; a key is (not null, doc_id, h)."""
    if shards < 2:
        return []
    some = rows.select("doc_id", "h").sample(min(1.0, SAMPLE * shards / max(1, n)), 7).toArrow()
    keys = sorted((i is not None, i or 0, h) for i, h in zip(some["doc_id"].to_pylist(), some["h"].to_pylist()))
    return sorted({keys[len(keys) * k // shards] for k in range(1, shards)}) if keys else []


def write(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode and write all documents; ``shard, uri, n_tokens`` of each file, in ascending order of documents.

    ``shards`` defaults to one per ``SHARD_BYTES`` of text, and ``MOST_SHARDS`` at most. The ids must be integers.
    """
    spark = docs.sparkSession
    base = f"{shared_uri(spark)}/pfor-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).withColumn("h", F.xxhash64("text"))
    size, n = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = shards or min(1 + int((size or 0) // SHARD_BYTES), MOST_SHARDS)
    least = bounds(rows, shards, n)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in (part for whole in batches for part in slices(whole, 2000)):
            ids, h = batch["doc_id"].to_pylist(), batch["h"].to_pylist()
            shard = [bisect_right(least, (i is not None, i or 0, x)) for i, x in zip(ids, h)]
            cells = [_narrow(np.append(x, np.uint32(end_id))) for x in enc.encode_all(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch["doc_id"], batch["h"], pa.array(cells, pa.binary())], ["shard", "doc_id", "h", "ids"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, done = None, None, []
        for batch in (part for whole in batches for part in slices(whole, 2000)):
            for shard, doc_id, ids in zip(*(batch[c].to_pylist() for c in ("shard", "doc_id", "ids"))):
                if shard != now:
                    if out is not None:
                        done.append((now, uri, out.close()))
                    now, uri = shard, f"{base}/{shard:06d}-{uuid.uuid4().hex}.pfor"
                    fs, at = _open(uri)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = ShardWriter(fs.open_output_stream(at))
                out.add(doc_id, _wide(ids))
        if out is not None:
            done.append((now, uri, out.close()))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["shard", "uri", "n_tokens"])

    encoded = rows.mapInArrow(encode, "shard int, doc_id long, h long, ids binary")
    dealt = encoded.repartitionById(len(least) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "h", "ids")
    return cut(dealt.mapInArrow(save, "shard long, uri string, n_tokens long"))


def _narrow(ids: np.ndarray) -> bytes:
    """Ids for the shuffle, in two bytes each if they all fit; the last byte says how many."""
    width = 2 if int(ids.max()) < 1 << 16 else 4
    return ids.astype(f"<u{width}").tobytes() + bytes([width])


def _wide(cell: bytes) -> bytes:
    return np.frombuffer(cell, f"<u{cell[-1]}", len(cell) // cell[-1]).astype("<u4").tobytes()


def read(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files that ``write`` returned."""
    group = F.expr(f"shard div {TOGETHER}")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("part", group)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("ahead", F.sum("n").over(before.orderBy("part")))  # one row a part
    placed = files.join(parts.drop("n"), "part").withColumn("first", F.coalesce("ahead", F.lit(0)) + F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("shard")), F.lit(0)))

    def load(batches):
        for pdf in batches:
            for uri, first in zip(pdf["uri"], pdf["first"]):
                fs, at = _open(uri)
                ids, starts, sizes, sums, start = [], [], [], [], int(first)
                with fs.open_input_file(at) as source:
                    for doc_id, tokens in read_shard(source):
                        ids.append(doc_id), starts.append(start), sizes.append(len(tokens)), sums.append(zlib.crc32(tokens.tobytes()))
                        start += len(tokens)
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "start": starts, "n_tokens": sizes, "ids_crc32": sums})

    one_each = placed.select("uri", "first", "shard").repartitionById((files.agg(F.max("shard")).first()[0] or 0) + 1, F.col("shard").cast("int"))
    return one_each.mapInPandas(load, "doc_id long, start long, n_tokens long, ids_crc32 long")
