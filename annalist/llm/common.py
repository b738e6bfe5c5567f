"""What several operators share: word expressions, hashed words of Arrow batches, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.session import cut, staged  # noqa: F401 (staged is for the operators)

#: A word is a run of anything but these six bytes.
SPACES = r"[\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(text: Column) -> Column:
    """The words of *text* as an array; empty for NULL."""
    return F.coalesce(F.array_remove(F.split(text, SPACES), ""), F.array().cast("array<string>"))


def unused(df: DataFrame, name: str) -> str:
    """*name*, lengthened until no column of *df* is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets) of pieces of about *most* bytes.

    A row is never cut, so memory follows the longest text. NULL counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first byte, byte after the last) of every word of a piece of rows."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    empty = np.empty(0, dtype=np.int64)
    if n == 0:
        return empty.astype(np.uint64), empty, empty, empty
    solid = ~_WHITE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    lengths = ends - starts
    values = _BYTE[data]
    power = np.ones(int(lengths.max(initial=0)) + 1, dtype=np.uint64)
    if len(power) > 1:
        power[1:] = np.cumprod(np.full(len(power) - 1, _STEP))
    inside = np.arange(n) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [n]])))
    values *= power[np.minimum(inside, len(power) - 1)]
    values[~solid] = 0
    sums = np.add.reduceat(values, starts) if len(starts) else empty.astype(np.uint64)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return mix(sums + lengths.astype(np.uint64)), rows, starts, ends


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links ``a``, ``b`` reach, for every node of a link.

    Every round each node takes the smallest label among its neighbours and itself, links
    move up to the labels, and links inside one label vanish. Rounds are checkpointed; their
    number is logarithmic in practice.
    """
    edges = cut(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a <> b").distinct()
    )
    found = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
            .select("node", F.least("node", "low").alias("component"))
        )
        if found is None:
            found = step
        else:
            moved = step.select(F.col("node").alias("component"), F.col("component").alias("to"))
            found = cut(
                found.join(moved, "component", "left")
                .select("node", F.coalesce("to", "component").alias("component"))
            )
        low_a = step.select(F.col("node").alias("a"), F.col("component").alias("la"))
        low_b = step.select(F.col("node").alias("b"), F.col("component").alias("lb"))
        edges = cut(
            edges.join(low_a, "a").join(low_b, "b")
            .filter("la <> lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        )
        if edges.isEmpty():
            break
    # A label may itself have moved on: follow labels until none changes.
    while True:
        up = found.select(F.col("node").alias("component"), F.col("component").alias("to"))
        further = cut(
            found.join(up, "component", "left")
            .select("node", F.coalesce("to", "component").alias("component"), (F.col("to") < F.col("component")).alias("moved"))
        )
        found = further.select("node", "component")
        if further.filter("moved").isEmpty():
            return found
