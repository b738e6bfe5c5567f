"""Token ids packed into rows of fixed length by best-fit-decreasing.

Texts become ids of a public vocabulary. A document longer than a row is split into full rows, which need no
packing, and a rest; nothing is lost. Rests are dealt by hash into shards of bounded size. A shard packs its
rests from the longest to the shortest, each into the open row with the least room that still holds it. A
segment tree over capacities finds that row in logarithmic time.

A packed row carries its ids, the cumulative lengths of its segments (as variable-length attention wants
them), the position of each token in its segment, and where every segment comes from.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import staged, text_chunks

VOCABULARY = "byte_bpe_50k.tiktoken"
LENGTH = 2048
PAD = 50256  # free in the vocabulary
SHARD_DOCS = 20_000
PACKED = (
    "shard bigint, doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>, n_tokens int, ids binary, positions binary"
)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


_encodings: dict[str, object] = {}


def encoding(path: str):
    """The byte-level encoding of a file of ranks, once per process."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


class Capacities:
    """Open rows by the room they have left, with a segment tree over the amounts of room."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.some = [0] * (2 * self.leaves)  # open rows below each node
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._count(room, 1)

    def _count(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.some[node] += change
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(row, room) of the row with the least room of at least *least*, and take it out."""
        node = self.leaves + least
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._count(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Which items go to each row: items from the longest to the shortest, ties in the given order."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    open_rows, rows = Capacities(most), []
    for item in order:
        found = open_rows.take(lengths[item])
        if found is None:
            found = len(rows), most
            rows.append([])
        row, room = found
        rows[row].append(item)
        if room > lengths[item]:
            open_rows.add(row, room - lengths[item])
    return rows


def _packed(shard: int, rows: list[list[tuple[int | None, int, bytes]]], length: int) -> pa.RecordBatch:
    """Packed rows from (doc_id, start, ids) of their segments."""
    columns: list[list] = [[] for _ in range(7)]
    for row in rows:
        sizes = [len(ids) // 2 for _, _, ids in row]
        total = sum(sizes)
        ids = np.full(length, PAD, dtype="<u2")
        ids[:total] = np.frombuffer(b"".join(ids for _, _, ids in row), dtype="<u2")
        places = np.zeros(length, dtype="<u2")
        places[:total] = np.concatenate([np.arange(n) for n in sizes])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for column, value in zip(columns, (shard, [d for d, _, _ in row], [s for _, s, _ in row], ends.tolist(), total, ids.tobytes(), places.tobytes())):
            column.append(value)
    types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())
    names = ["shard", "doc_ids", "starts", "cu_seqlens", "n_tokens", "ids", "positions"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def pieces(docs: DataFrame, path: str, length: int) -> DataFrame:
    """(doc_id, start, size, ids): the ids of every document in pieces of at most *length*."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            for first, last, _, _ in text_chunks(batch["text"]):
                part = batch.slice(first, last - first)
                rows, starts, blobs = [], [], []
                for i, text in enumerate(part["text"].to_pylist()):
                    ids = np.array(encode(text) if text else [], dtype="<u2")
                    for start in range(0, len(ids), length):
                        rows.append(i)
                        starts.append(start)
                        blobs.append(ids[start : start + length].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(pa.array(rows, pa.int64())), part["shard"].take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()),
                     pa.array([len(b) // 2 for b in blobs], pa.int32()), pa.array(blobs, pa.binary())],
                    ["doc_id", "shard", "start", "size", "ids"],
                )

    return docs.mapInArrow(run, "doc_id bigint, shard bigint, start bigint, size int, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Packed rows of all ids of *docs*: shard, doc_ids, starts (where a segment begins in its document),
    cu_seqlens, n_tokens, ids and positions (*length* little-endian 16-bit numbers each, padded).

    Shard -1 holds the full rows of long documents. NULL and empty texts have no ids and no segment;
    repeated rows are packed each; rows without doc_id are packed with a NULL id; an empty table gives an
    empty result; other columns are ignored. doc_id is an integer.
    """
    path = path or vocabulary_path()
    shards = max(1, math.ceil(docs.count() / shard_docs))
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"))
    cut = staged(pieces(dealt, path, length), "packing-pieces")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield _packed(-1, [[row] for row in zip(part["doc_id"].to_pylist(), part["start"].to_pylist(), part["ids"].to_pylist())], length)

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("size", "ascending"), ("ids", "ascending")])
        rows = list(zip(table["doc_id"].to_pylist(), table["start"].to_pylist(), table["ids"].to_pylist()))
        placed = best_fit(table["size"].to_pylist(), length)
        return pa.Table.from_batches([_packed(table["shard"][0].as_py(), [[rows[i] for i in row] for row in placed], length)])

    whole = F.col("size") == length
    return cut.filter(whole).select("doc_id", "start", "ids").mapInArrow(full, PACKED).unionAll(
        cut.filter(~whole).groupBy("shard").applyInArrow(shard, PACKED)
    )


def write(packed: DataFrame, folder: str) -> None:
    """The packed rows as Parquet files: one row of the id matrix, its segment lengths and positions each."""
    packed.write.mode("overwrite").parquet(folder)


def matrix(rows: list, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(ids, positions) of some packed rows as matrices."""
    return tuple(np.frombuffer(b"".join(r[c] for r in rows), dtype="<u2").reshape(-1, length) for c in ("ids", "positions"))
