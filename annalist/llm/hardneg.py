"""Hard negatives: rows of other labels whose score lies in a window below that of a positive.

Candidates are written as Parquet blocks along a Hilbert curve inside each label. A block is one row with its
ids, labels and integer vectors, and a zone map: the least and greatest value of every dimension and of the
label. Interval arithmetic over a zone map bounds the scores of its block from both sides, for any anchor, so
the bounds choose the blocks that can hold something an anchor asks for; only those are read for it.

* An anchor's own block gives the first floor for its positives, as rows near it on the curve stand there.
* Positives: blocks that hold the label and whose upper bound reaches the floor.
* Negatives: blocks that hold another label and whose bounds meet one of the anchor's windows.

A chunk of anchors meets its blocks best bound first, in one stream that keeps the first rows of every window
and no more; a block that cannot improve them is passed over. Scores are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import staged

BLOCK = 256  # candidates of a block
CHUNK = 256  # anchors that are asked together
ZONES = 256  # zone maps that are compared at once
LANES = 64  # streams, at most, that read the blocks of a chunk
LANE_BLOCKS = 64  # blocks for which a chunk gets one more of them
_MOST, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min

_MOMENTS = "dims int, n bigint, sums array<double>, squares array<double>"
_PACKED = (
    "block bigint, dims int, n int, low_label bigint, high_label bigint, ids binary, labels binary, anchors binary, floors binary,"
    " vectors binary, low binary, high binary"
)
_ANCHORS = "dims int, block bigint, place int, vec_id bigint, label bigint, anchor boolean, floor bigint, q array<bigint>"
_WANTED = "chunk bigint, block bigint, bound bigint, asking binary"
_FOUND = "chunk bigint, i int, j int, vec_id bigint, score bigint"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices; beyond 64 bits, the end of that range."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * max(int(a.max()), -int(a.min())) * max(int(b.max()), -int(b.min()))
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that any vector between a row of *low* and of *high* can have with a row of *a*."""
    signs = np.concatenate([np.maximum(a, 0), np.minimum(a, 0)], axis=1)
    return products(signs, np.concatenate([low, high], axis=1)), products(signs, np.concatenate([high, low], axis=1))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of every row of *cells* (values below 2**bits), as bytes that sort like it.

    Skilling's transform: from the highest bit on, each axis either reflects or swaps the lower bits of the
    first one; a Gray code over all axes follows.
    """
    x = cells.T.astype(np.uint32).copy()
    if not x.size:
        return np.zeros((len(cells), 0), np.uint8)
    bit = 1 << (bits - 1)
    while bit > 1:
        lower = np.uint32(bit - 1)
        for axis in x:
            swapped = np.where(axis & np.uint32(bit), 0, (x[0] ^ axis) & lower)
            x[0] ^= np.where(axis & np.uint32(bit), lower, swapped).astype(np.uint32)
            if axis is not x[0]:
                axis ^= swapped.astype(np.uint32)
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[-1] & np.uint32(bit), np.uint32(bit - 1), 0).astype(np.uint32)
        bit >>= 1
    x ^= turn
    planes = np.stack([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])
    return np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)


def bits_for(dims: int) -> int:
    """Bits a dimension, for keys of about 64 bits or more."""
    return max(2, min(16, -(-64 // max(1, dims))))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)


def _even(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(dims, rows): runs of rows of equal dims."""
    dims = batch["dims"].to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], dims[1:] != dims[:-1], [True]])) if len(dims) else [0]
    for start, end in zip(edges, edges[1:]):
        yield int(dims[start]), batch.slice(start, end - start)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for dims, rows in _even(batch):
            q = _matrix(rows["q"], dims).astype(np.float64)
            n, sums, squares = found.get(dims, (0, 0.0, 0.0))
            found[dims] = n + len(q), sums + q.sum(axis=0), squares + (q * q).sum(axis=0)
    rows = [(dims, n, s.tolist(), sq.tolist()) for dims, (n, s, sq) in found.items()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))],
        ["dims", "n", "sums", "squares"],
    )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dims, rows in _even(batch):
            bits = bits_for(dims)
            q = _matrix(rows["q"], dims).astype(np.float64)
            mean, spread = (_matrix(rows[c], dims) for c in ("mean", "spread"))
            with np.errstate(divide="ignore", invalid="ignore"):
                cells = np.nan_to_num(np.floor(((q - mean) / (6 * spread) + 0.5) * 2**bits), nan=2 ** (bits - 1))
            cells = np.clip(cells, 0, 2**bits - 1).astype(np.uint32)
            # the widest dimensions are cut first
            keys = hilbert_keys(cells[:, np.argsort(-spread[0], kind="stable")] if dims else cells, bits)
            columns = [rows[c] for c in ("vec_id", "label", "anchor", "floor", "dims", "q")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([k.tobytes() for k in keys], pa.binary())], ["vec_id", "label", "anchor", "floor", "dims", "q", "key"])


def _narrow(q: np.ndarray) -> bytes:
    for kind in ("<i2", "<i4"):
        if not q.size or (q.min() >= np.iinfo(kind).min and q.max() <= np.iinfo(kind).max):
            return q.astype(kind).tobytes()
    return q.astype("<i8").tobytes()


def _wide(raw: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // (n * dims)}").reshape(n, dims).astype(np.int64) if n * dims else np.zeros((n, dims), np.int64)


def _packed(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of equal dims as blocks of *size*."""
    number, held, open_dims = TaskContext.get().partitionId() << 32, [], None
    names = [c.split()[0] for c in _PACKED.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]

    def rows(most: int) -> Iterator[pa.RecordBatch]:
        """Blocks of what is held, until less than *most* rows are left."""
        nonlocal held, number
        ids, labels, anchors, floors, q = (np.concatenate(c) for c in zip(*held))
        start = 0
        while len(ids) - start >= most:
            part = slice(start, start + size)
            n, low, high = len(ids[part]), q[part].min(axis=0), q[part].max(axis=0)
            values = [
                number, open_dims, n, int(labels[part].min()), int(labels[part].max()), ids[part].astype("<i8").tobytes(), labels[part].astype("<i8").tobytes(),
                anchors[part].astype("u1").tobytes(), floors[part].astype("<i8").tobytes(), _narrow(q[part]), low.astype("<i8").tobytes(), high.astype("<i8").tobytes(),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)
            number, start = number + 1, start + n
        held = [(ids[start:], labels[start:], anchors[start:], floors[start:], q[start:])] if start < len(ids) else []

    for batch in batches:
        for dims, part in _even(batch):
            if dims != open_dims and held:
                yield from rows(1)
            open_dims = dims
            plain = (part[c].to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "anchor", "floor"))
            held.append((*plain, _matrix(part["q"], dims)))
            yield from rows(size)
    if held:
        yield from rows(1)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) of a block."""
    ids, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
    return ids, labels, _wide(row["vectors"], row["n"], row["dims"])


def _anchor_rows(positives: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of every block, with the score that their positives reach inside of it."""
    for batch in batches:
        for row in batch.to_pylist():
            at = np.flatnonzero(np.frombuffer(row["anchors"], "u1"))
            if not len(at):
                continue
            ids, labels, q = _opened(row)
            scores = products(q[at], q)
            scores[(labels != labels[at][:, None]) | (ids == ids[at][:, None])] = _LEAST
            floors = np.sort(scores, axis=1)[:, -positives] if scores.shape[1] >= positives else np.full(len(at), _LEAST)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["dims"]] * len(at), pa.int32()), pa.array([row["block"]] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(ids[at]),
                 pa.array(labels[at]), pa.array([True] * len(at)), pa.array(floors), pa.array(q[at].tolist(), pa.list_(pa.int64()))],
                ["dims", "block", "place", "vec_id", "label", "anchor", "floor", "q"],
            )


def _asked(row: dict) -> tuple[np.ndarray, ...]:
    """(ids, labels, vectors, lows, highs) of a chunk: one line of windows an anchor."""
    ids, labels, q = _opened(row)
    lows = np.frombuffer(row["lows"], "<i8").reshape(len(ids), -1)
    highs = np.frombuffer(row["highs"], "<i8").reshape(len(ids), -1) if row["highs"] is not None else np.full(lows.shape, _MOST)
    return ids, labels, q, lows, highs


def _planned(same: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which blocks of some zone maps a chunk must read, and which of its anchors ask for them."""
    for batch in batches:
        for row in batch.to_pylist():
            _, labels, q, lows, highs = _asked(row)
            zones = row["zones"]
            low, high = (np.array([np.frombuffer(z[c], "<i8") for z in zones]).reshape(len(zones), row["dims"]) for c in ("low", "high"))
            least, greatest = bounds(q, low, high)
            first, last = (np.array([z[c] for z in zones]) for c in ("low_label", "high_label"))
            mine = labels[:, None]
            fits = (first <= mine) & (mine <= last) if same else (first != mine) | (last != mine)
            asking = np.zeros_like(fits)
            for j in range(lows.shape[1]):
                window = (lows[:, j : j + 1], highs[:, j : j + 1])
                asking |= (window[0] <= window[1]) & (greatest >= window[0]) & (least <= window[1])
            asking &= fits
            some = np.flatnonzero(asking.any(axis=0))
            if len(some):
                bound = np.where(asking, greatest, _LEAST).max(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]] * len(some), pa.int64()), pa.array([zones[z]["block"] for z in some], pa.int64()), pa.array(bound[some]),
                     pa.array([np.packbits(asking[:, z]).tobytes() for z in some], pa.binary())],
                    ["chunk", "block", "bound", "asking"],
                )


class Best:
    """The first *k* rows of every window of a chunk, by score and then id, over the blocks seen so far."""

    def __init__(self, row: dict, same: bool, k: int):
        self.chunk, self.same, self.k = row["chunk"], same, k
        self.ids, self.labels, self.q, self.lows, self.highs = _asked(row)
        self.floor = self.lows.copy()
        self.window, self.score, self.found = (np.empty(0, np.int64) for _ in range(3))

    def add(self, row: dict) -> None:
        low, high = (np.frombuffer(row[c], "<i8")[None, :] for c in ("low", "high"))
        at = np.flatnonzero(np.unpackbits(np.frombuffer(row["extra"], "u1"))[: len(self.ids)])
        least, greatest = bounds(self.q[at], low, high)
        at = at[((greatest >= self.floor[at]) & (least <= self.highs[at]) & (self.lows[at] <= self.highs[at])).any(axis=1)]
        if not len(at):
            return
        ids, labels, q = _opened(row)
        scores = products(self.q[at], q)
        mine, other = self.labels[at][:, None], self.ids[at][:, None]
        fits = (labels == mine) & (ids != other) if self.same else labels != mine
        windows, kept, found = [self.window], [self.score], [self.found]
        for j in range(self.lows.shape[1]):
            r, c = np.nonzero(fits & (scores >= self.floor[at, j][:, None]) & (scores <= self.highs[at, j][:, None]))
            windows.append(at[r] * self.lows.shape[1] + j)
            kept.append(scores[r, c])
            found.append(ids[c])
        if sum(map(len, windows)) > len(self.window):
            self._keep(*(np.concatenate(c) for c in (windows, kept, found)))

    def _keep(self, window: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        order = np.lexsort((found, ~score, window))
        window, score, found = window[order], score[order], found[order]
        starts = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        place = np.arange(len(window)) - np.repeat(starts, np.diff(np.append(starts, len(window))))
        first = place < self.k
        self.window, self.score, self.found = window[first], score[first], found[first]
        full = place == self.k - 1
        self.floor.reshape(-1)[window[full]] = score[full]

    def rows(self) -> pa.RecordBatch:
        i, j = np.divmod(self.window, self.lows.shape[1])
        columns = [np.full(len(i), self.chunk), i.astype(np.int32), j.astype(np.int32), self.found, self.score]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["chunk", "i", "j", "vec_id", "score"])


def _read(same: bool, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first rows of every window from a stream of chunks, each followed by its blocks."""
    best = None
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if row["lows"] is not None:
                if best is not None:
                    yield best.rows()
                best = Best(row, same, k)
            else:
                best.add(row)
    if best is not None:
        yield best.rows()


def _windows(least: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the windows that the scores of their positives open; an unused place has an empty one."""
    for batch in batches:
        for at in range(batch.num_rows):
            part = batch.slice(at, 1)
            n, opened = part["n"][0].as_py(), part["opened"][0].as_py()
            wide = 1 + max(o["j"] for o in opened)
            lows, highs = np.full((n, wide), _MOST), np.full((n, wide), _LEAST)
            for o in opened:
                lows[o["i"], o["j"]] = -(-least * o["score"] // 100)
                highs[o["i"], o["j"]] = most * o["score"] // 100
            columns = [part[c] for c in ("chunk", "dims", "n", "ids", "labels", "vectors")]
            raw = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (lows, highs)]
            yield pa.RecordBatch.from_arrays(columns + raw, ["chunk", "dims", "n", "ids", "labels", "vectors", "lows", "highs"])


_CHUNK = "chunk bigint, dims int, n int, ids binary, labels binary, vectors binary, lows binary, highs binary"


def _along_curve(rows: DataFrame) -> DataFrame:
    """Rows with ``key``, their place on the curve of their number of dimensions."""
    parts = rows.select("dims", "q").mapInArrow(_moments, _MOMENTS)
    each = parts.select("dims", "n", F.posexplode(F.arrays_zip("sums", "squares")).alias("pos", "at"))
    means = each.groupBy("dims", "pos").agg(
        (F.sum("at.sums") / F.sum("n")).alias("mean"), (F.sum("at.squares") / F.sum("n")).alias("square"),
    ).withColumn("spread", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))))
    shape = staged(
        means.groupBy("dims").agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "spread"))).alias("s"))
        .select("dims", F.col("s.mean").alias("mean"), F.col("s.spread").alias("spread")),
        "hardneg-shape",
    )
    empty = F.array().cast("array<double>")
    shaped = rows.join(shape, "dims", "left").withColumns({c: F.coalesce(c, empty) for c in ("mean", "spread")})
    kept = "vec_id bigint, label bigint, anchor boolean, floor bigint, dims int, q array<bigint>, key binary"
    return shaped.select("vec_id", "label", "anchor", "floor", "dims", "q", "mean", "spread").mapInArrow(_keyed, kept)


def _search(chunks: DataFrame, blocks: DataFrame, n_blocks: int, same: bool, k: int) -> DataFrame:
    """(chunk, i, j, vec_id, score, rank): the first *k* rows of every window of *chunks*."""
    shelves, lanes = math.ceil(n_blocks / ZONES), min(LANES, math.ceil(n_blocks / LANE_BLOCKS))
    shelf = (
        blocks.withColumn("shelf", F.pmod(F.xxhash64("block"), F.lit(shelves))).groupBy("dims", "shelf")
        .agg(F.collect_list(F.struct("block", "low_label", "high_label", "low", "high")).alias("zones"))
    )
    asked = chunks.withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shelves - 1).cast("bigint"))))
    wanted = staged(asked.join(shelf, ["dims", "shelf"]).mapInArrow(partial(_planned, same), _WANTED), "hardneg-wanted")
    wanted = wanted.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)))
    none = F.lit(None).cast("binary")
    heads = wanted.select("chunk", "lane").distinct().join(chunks, "chunk").select(
        "chunk", "lane", "dims", "n", "ids", "labels", "vectors", "lows", "highs", F.lit(_MOST).alias("bound"), none.alias("extra"), none.alias("low"), none.alias("high"),
    )
    bodies = wanted.join(blocks.drop("anchors", "floors"), "block").select(
        "chunk", "lane", "dims", "n", "ids", "labels", "vectors", none.alias("lows"), none.alias("highs"), "bound", F.col("asking").alias("extra"), "low", "high",
    )
    stream = heads.unionByName(bodies).repartition("chunk", "lane").sortWithinPartitions("chunk", "lane", F.col("lows").isNull(), F.desc("bound"))
    found = stream.mapInArrow(partial(_read, same, k), _FOUND)
    first = Window.partitionBy("chunk", "i", "j").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def whole_vectors(vectors: DataFrame, label: Column, anchor: Column) -> DataFrame:
    """(vec_id, label, anchor, q) of the rows that take part: *q* holds floor(256 * x) of every component x."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), anchor.alias("anchor"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256.0).cast("bigint")).alias("q"),
    )


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for *rows* of vec_id, label,
    anchor (whether the row asks) and q (integers).

    A score is the inner product with the anchor, higher first, ties by the smaller vec_id. The positives of an
    anchor are its first rows of the same label, for each of which the first *negatives* rows of other labels
    with least% <= score <= most% of the positive's score are returned.

    Rows meet only rows with as many components. Repeated rows count each, as anchors and as candidates; a row
    is another one if its vec_id differs. Rows without vec_id, label or vector are left out. An empty table, no
    anchor, and anchors without positives or without negatives in a window give no row. Scores beyond 64 bits
    count as the end of that range. Other columns are ignored.
    """
    spark = rows.sparkSession
    taken = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL").select(
        "vec_id", "label", F.coalesce("anchor", F.lit(False)).alias("anchor"), F.lit(0).cast("bigint").alias("floor"), F.size("q").alias("dims"), "q",
    )
    place = ["dims", "label", "key", "vec_id", "salt"]
    curve = staged(_along_curve(staged(taken, "hardneg-rows")), "hardneg-curve").withColumn("salt", F.monotonically_increasing_id())
    blocks = staged(curve.repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(partial(_packed, BLOCK), _PACKED), "hardneg-blocks")
    asking = blocks.select("block", "dims", "n", "ids", "labels", "vectors", "anchors").mapInArrow(partial(_anchor_rows, positives), _ANCHORS)
    near = ["dims", "block", "place"]
    chunks = staged(asking.repartitionByRange(*near).sortWithinPartitions(*near).mapInArrow(partial(_packed, CHUNK), _PACKED), "hardneg-chunks")
    n_blocks = blocks.count()
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n_blocks:
        return spark.createDataFrame([], result)
    plain = ["dims", "n", "ids", "labels", "vectors"]
    first = chunks.select(F.col("block").alias("chunk"), *plain, F.col("floors").alias("lows"), F.lit(None).cast("binary").alias("highs"))
    near_rows = staged(_search(first, blocks, n_blocks, True, positives), "hardneg-positives")
    opened = near_rows.groupBy("chunk").agg(F.collect_list(F.struct("i", (F.col("rank") - 1).alias("j"), "score")).alias("opened"))
    second = staged(first.join(opened, "chunk").mapInArrow(partial(_windows, least, most), _CHUNK), "hardneg-windows")
    far_rows = _search(second, blocks, n_blocks, False, negatives)
    anchors = chunks.mapInArrow(_names, "chunk bigint, i int, anchor_id bigint")
    pairs = near_rows.select("chunk", "i", (F.col("rank") - 1).alias("j"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors, ["chunk", "i"])
    return far_rows.join(pairs, ["chunk", "i", "j"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, raw in zip(batch["block"].to_pylist(), batch["ids"].to_pylist()):
            ids = np.frombuffer(raw, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(ids), pa.int64()), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["chunk", "i", "anchor_id"])


def check_sql() -> str:
    """The rows of the registered query from all pairs of anchors and rows."""
    return """
    WITH given AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
               coalesce(list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2])), 0)::BIGINT AS score
        FROM given a JOIN given r ON len(a.q) = len(r.q)
        WHERE a.vec_id % 100 = 0 AND (a.label <> r.label OR a.vec_id <> r.vec_id)
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
         AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
    QUALIFY rank <= 10
    """
