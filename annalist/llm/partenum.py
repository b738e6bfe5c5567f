"""Similarity join of word shingle sets by PartEnum signatures.

Sets meet in bands of equal size: band *b* holds sizes from 2**(b-1) to 2**b - 1. A set enters its own
band and, if it may be the smaller partner of a set there, the next. In a band the domain of shingles is
cut into slices by hash, and an occupied slice has one signature: the hash of all the shingles that the
set has in it.

Two sets with a Jaccard similarity of at least 3/4 differ in at most a seventh of their sizes together,
which a set knows up to the size of its partner. A set that occupies more slices than that keeps some of
them untouched, whatever the differences are, so the two share at least as many signatures as it occupies
slices beyond the differences. Of so many, the first in an order that is the same for all sets stands
among the first ``differences + 1`` of either set; these are all that a set gives. The number of slices is
chosen so that sets occupy enough of them; one that by chance does not gives all its signatures, and every
shingle as a signature.

Sets are known by 64-bit sums of scrambled shingle hashes, so equal sets are one set throughout.
Candidates are compared exactly. A signature's sets are first compared with the smallest of them; where
that leaves several components, the rest of the group is compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import components, mix, staged, text_chunks, word_hashes

WORDS = 5
#: Slices of a band, as a share of its largest set, and added to that.
SLICES, MORE = 0.33, 4
SKETCH = 64
BLOCK = 200
_Q = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(WORDS, _Q)) * np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = [mix(np.array([i], dtype=np.uint64))[0] for i in range(101, 108)]


def _sets(data: np.ndarray, offsets: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, row of each), sorted by row and hash, of a piece of rows."""
    hashes, rows, _, _ = word_hashes(data, offsets, lower=True)
    n = len(hashes)
    whole = np.maximum(n - WORDS + 1, 0)
    total = np.zeros(whole, dtype=np.uint64)
    for i in range(WORDS):
        total += hashes[i : i + whole] * _POWERS[i]
    inside = rows[:whole] == rows[WORDS - 1 :] if whole else np.zeros(0, bool)
    grams, of = mix(total[inside]), rows[:whole][inside]
    lengths = np.bincount(rows, minlength=count)
    short = np.flatnonzero((lengths > 0) & (lengths < WORDS))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(WORDS - 1):
            has = lengths[short] > i
            extra[has] += mix(hashes[first[has] + i] + _SEEDS[0]) * _POWERS[i]
        grams = np.concatenate([grams, mix(extra)])
        of = np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        grams, of = grams[order], of[order]
    ends = np.searchsorted(of, np.arange(count + 1))
    parts = [np.unique(grams[a:b]) for a, b in zip(ends, ends[1:])]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else grams), np.repeat(np.arange(count), sizes)


def _names(values: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit name) of the set of every row; an empty set has the name 0."""
    sizes = np.bincount(rows, minlength=count)
    names = np.zeros(count, dtype=np.uint64)
    if len(values):
        full = np.flatnonzero(sizes)
        starts = np.searchsorted(rows, full)
        sums = np.add.reduceat(mix(values ^ _SEEDS[1]), starts)
        crossed = np.bitwise_xor.reduceat(mix(values ^ _SEEDS[2]), starts)
        names[full] = mix(sums + mix(crossed + sizes[full].astype(np.uint64)))
    return sizes, names


def _signatures(values: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of the sets of a piece of rows."""
    out, of = [], []
    band = np.zeros(len(sizes), dtype=np.int64)
    band[sizes > 0] = np.frexp(sizes[sizes > 0])[1]  # 2**(band-1) <= size < 2**band
    element = mix(values ^ _SEEDS[3])
    place = mix(values ^ _SEEDS[4]) >> np.uint64(32)
    for up in (0, 1):
        joins = sizes > 0 if not up else (sizes > 0) & (4 * sizes >= 3 * (1 << band))
        mine = joins[rows]
        if not mine.any():
            continue
        top = (1 << (band + up)) - 1
        apart = (sizes + np.minimum(4 * sizes // 3, top)) // 7  # as far as a partner in this band may be
        in_band = (band + up)[rows[mine]]
        slices = (np.ceil(SLICES * ((1 << in_band) - 1)) + MORE).astype(np.uint64)
        spot = (place[mine] * slices) >> np.uint64(32)
        key = (rows[mine].astype(np.uint64) << np.uint64(40)) | spot
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sums = np.add.reduceat(element[mine][order], starts)
        tag = mix(spot[order][starts] * np.uint64(64) + in_band[order][starts].astype(np.uint64) + _SEEDS[5])
        signature, row = mix(sums + tag), rows[mine][order][starts]
        occupied = np.bincount(row, minlength=len(sizes))
        loose = joins & (occupied <= apart)
        # the order is the same for all sets: slices with many shingles first, then by signature
        ranked = np.lexsort((signature, -np.diff(np.append(starts, len(key))), row))
        signature, row = signature[ranked], row[ranked]
        rank = np.arange(len(row)) - (np.cumsum(occupied) - occupied)[row]
        kept = (rank <= apart[row]) | loose[row]
        out.append(signature[kept])
        of.append(row[kept])
        each = loose[rows[mine]]
        if each.any():
            out.append(mix(element[mine][each] + _SEEDS[6] + in_band[each].astype(np.uint64)))
            of.append(rows[mine][each])
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def _sketch(values: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Counts of shingles per cell, up to 255. Two sets differ at least by the difference of their counts."""
    cells = rows * SKETCH + (mix(values ^ _SEEDS[2]) >> np.uint64(58)).astype(np.int64)
    return np.minimum(np.bincount(cells, minlength=count * SKETCH), 255).astype(np.uint8).reshape(count, SKETCH)


def _fine(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Longer sketches, of a power of two of cells: a quarter to a half of the size of the set, 2**14 at most."""
    bits = np.clip(np.frexp(np.maximum(sizes, 1))[1] - 2, 6, 14)
    ends = np.concatenate([[0], np.cumsum(1 << bits)])
    cells = (mix(values ^ _SEEDS[2]) >> np.repeat(64 - bits, sizes).astype(np.uint64)).astype(np.int64)
    counts = np.bincount(cells + np.repeat(ends[:-1], sizes), minlength=ends[-1])
    counts = np.minimum(counts, 255).astype(np.uint8)
    return [counts[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def _blobs(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _pieces(batch: pa.RecordBatch):
    """(rows of *batch*, values, rows, sizes, names) of pieces of a batch with ``text``."""
    for first, last, data, offsets in text_chunks(batch["text"]):
        count = last - first
        values, rows = _sets(data, offsets, count)
        sizes, names = _names(values, rows, count)
        yield batch.slice(first, count), values, rows, sizes, names


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, values, rows, sizes, names in _pieces(batch):
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(sizes), pa.array(names.view(np.int64)), _blobs(_sketch(values, rows, len(sizes))),
                 pa.array(_fine(values, sizes), pa.binary())],
                ["doc_id", "n", "sid", "sketch", "fine"],
            )


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, values, rows, sizes, names in _pieces(batch):
            signatures, of = _signatures(values, rows, sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signatures.view(np.int64)), pa.array(names[of].view(np.int64))], ["sig", "sid"]
            )


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, values, rows, sizes, names in _pieces(batch):
            ends = np.concatenate([[0], np.cumsum(sizes)])
            blobs = pa.array([values[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(names.view(np.int64)), blobs], ["doc_id", "sid", "shingles"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature and set: every further set of a signature, with the first one."""
    last_sig = last_sid = head = None
    for batch in batches:
        sig, sid = batch["sig"].to_numpy(), batch["sid"].to_numpy()
        if not len(sig):
            continue
        new = np.empty(len(sig), dtype=bool)
        new[0] = last_sig is None or sig[0] != last_sig
        new[1:] = sig[1:] != sig[:-1]
        again = np.empty(len(sig), dtype=bool)
        again[0] = not new[0] and sid[0] == last_sid
        again[1:] = ~new[1:] & (sid[1:] == sid[:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        first = np.where(at >= 0, sid[np.maximum(at, 0)], head if head is not None else 0)
        out = ~new & ~again
        last_sig, last_sid, head = sig[-1], sid[-1], first[-1]
        yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(sid[out]), pa.array(first[out])], ["sig", "sid", "head"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and sketches allow a similarity of 3/4."""
    for batch in batches:
        na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
        if not len(na):
            continue
        left, right = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in ("sa", "sb"))
        low, high = np.minimum(na, nb), np.maximum(na, nb)
        keep = (4 * low >= 3 * high) & (7 * np.abs(left - right).sum(axis=1) <= na + nb)
        yield batch.select(["a", "b", "doc_a", "doc_b", "shared"]).filter(pa.array(keep))


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that their long sketches allow; the longer one is folded to the length of the other."""
    for batch in batches:
        keep = []
        for na, nb, x, y in zip(batch["na"].to_pylist(), batch["nb"].to_pylist(), batch["fa"], batch["fb"]):
            u, v = np.frombuffer(x.as_buffer(), np.uint8).astype(np.int32), np.frombuffer(y.as_buffer(), np.uint8).astype(np.int32)
            cells = min(len(u), len(v))
            apart = np.abs(u.reshape(cells, -1).sum(axis=1) - v.reshape(cells, -1).sum(axis=1)).sum()
            # full cells of sketches of different length cannot be compared
            unsure = len(u) != len(v) and max(u.max(), v.max()) == 255
            keep.append(unsure or 7 * int(apart) <= na + nb)
        yield batch.select(["a", "b", "doc_a", "doc_b", "shared"]).filter(pa.array(keep, pa.bool_()))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): from rows sorted by block, its head first, the members with a similarity of at least 3/4."""
    block = head = doc = None
    for batch in batches:
        found = []
        for key, salt, is_head, doc_id, blob in zip(
            batch["key"].to_pylist(), batch["salt"].to_pylist(), batch["head"].to_pylist(), batch["doc_id"].to_pylist(), batch["shingles"]
        ):
            values = np.frombuffer(blob.as_buffer(), np.uint64)
            if is_head:
                block, head, doc = (key, salt), values.copy(), doc_id
                continue
            if block != (key, salt):
                raise ValueError("a block of candidates came without its head")
            both = np.concatenate([head, values])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= 75 * (len(both) - common):
                found.append((doc, doc_id))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])


def _folded(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Long sketches as rows of the shortest length among them, and which of them have a full cell."""
    counts = [np.frombuffer(s, np.uint8) for s in sketches]
    cells = min(map(len, counts))
    rows = np.array([c.reshape(cells, -1).sum(axis=1, dtype=np.int32) for c in counts])
    return rows, np.array([c.max() == 255 for c in counts])


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components from two blocks of one signature that sizes and sketches allow."""
    for batch in batches:
        found: set[tuple[int, int]] = set()
        for at in range(batch.num_rows):
            row = {c: batch[c][at].as_py() for c in batch.schema.names}
            a, b = row["members_a"], row["members_b"]
            fine, full = _folded([x["fine"] for x in a + b])
            short = fine.reshape(len(fine), SKETCH, -1).sum(axis=2)
            sid, component, n = (np.array([x[c] for x in a + b]) for c in ("sid", "component", "n"))
            right = np.arange(len(a), len(a + b))
            for i in range(len(a)):
                low, high = np.minimum(n[i], n[right]), np.maximum(n[i], n[right])
                ok = right[(component[i] != component[right]) & (4 * low >= 3 * high) & ((sid[i] < sid[right]) | (not row["same"]))]
                for sketch in (short, fine):
                    apart = np.abs(sketch[ok] - sketch[i]).sum(axis=1)
                    ok = ok[(7 * apart <= n[i] + n[ok]) | full[i] | full[ok]]
                found.update((min(int(sid[i]), int(sid[j])), max(int(sid[i]), int(sid[j]))) for j in ok)
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"]
            )


def _likely(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """*pairs* (a, b, shared) of set names with their first documents, freed of those that cannot be similar:
    first by short sketches, then by long ones."""
    def side(x: str, sketch: str, *more: str) -> DataFrame:
        named = {"doc": f"doc_{x}", "n": f"n{x}"}
        return profiles.select(F.col("sid").alias(x), *[F.col(c).alias(named[c]) for c in more], F.col(sketch).alias(f"{sketch[0]}{x}"))

    columns = "a bigint, b bigint, doc_a bigint, doc_b bigint, shared bigint"
    first = ("doc", "n")
    some = staged(
        pairs.join(side("a", "sketch", *first), "a").join(side("b", "sketch", *first), "b").mapInArrow(_near, columns), "partenum-some"
    )
    return staged(some.join(side("a", "fine", "n"), "a").join(side("b", "fine", "n"), "b").mapInArrow(_finer, columns), "partenum-near")


def _among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of *docs* whose doc_id may be in *wanted* (id): a filter of fixed size, 2**22 bits in 2**16
    rows, is all that is sent to them. Whatever passes by chance falls out in the exact join behind it."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 22))
    bits = wanted.groupBy(F.shiftright(bit("id"), 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit("id") % 64).cast("int"))).alias("bits")
    )
    return docs.join(F.broadcast(bits), F.shiftright(bit("doc_id"), 6) == F.col("word")).filter(
        F.call_function("shiftright", F.col("bits"), (bit("doc_id") % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    ).select("doc_id", "text")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): the first documents of the sets of *pairs* that are similar.

    Pairs meet by their ``a``, which is sent once to each block of at most some BLOCK partners.
    """
    heads = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("bigint").alias("blocks"), F.any_value("doc_a").alias("doc"))
    members = pairs.join(heads.select("a", "blocks"), "a").select(
        F.col("b").alias("sid"), F.col("doc_b").alias("doc"), F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("blocks")).alias("salt"), F.lit(False).alias("head")
    )
    copies = heads.select(F.col("a").alias("sid"), "doc", F.col("a").alias("key"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("salt"), F.lit(True).alias("head"))
    placed = staged(members.unionAll(copies), "partenum-places")
    sets = _among(docs, placed.select(F.col("doc").alias("id"))).mapInArrow(_whole_sets, "doc_id bigint, sid bigint, shingles binary")
    return staged(
        sets.join(placed.withColumnRenamed("sid", "of"), (F.col("sid") == F.col("of")) & (F.col("doc_id") == F.col("doc")))
        .select("key", "salt", "head", "doc_id", "shingles")
        .repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("head"))
        .mapInArrow(_similar, "a bigint, b bigint").distinct(),
        "partenum-links",
    )


def _open(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The *pairs* between different components of *labels*."""
    of = lambda x: labels.select(F.col("node").alias(f"doc_{x}"), F.col("component").alias(f"c_{x}"))
    return pairs.join(of("a"), "doc_a", "left").join(of("b"), "doc_b", "left").filter(
        F.coalesce("c_a", "doc_a") != F.coalesce("c_b", "doc_b")
    ).select("a", "b", "doc_a", "doc_b", "shared")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of *docs*.

    Words are runs of anything but the six ASCII spaces, with A-Z in lower case; a text of fewer than five
    words is one shingle, one without words (or NULL) has none and links with nothing. Links join sets with
    100 * intersection >= 75 * union; ``component_id`` is the smallest doc_id that links reach. Rows of one
    doc_id count as linked, since they are one document; rows without doc_id have themselves only, and a
    NULL component. An empty table gives an empty result; other columns are ignored. doc_id is an integer.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = staged(texts.mapInArrow(_profiles, "doc_id bigint, n bigint, sid bigint, sketch binary, fine binary"), "partenum-profiles")
    known = texts.filter(F.col("doc_id").isNotNull())
    full = rows.filter("n > 0 AND doc_id IS NOT NULL")
    profiles = staged(
        full.groupBy("sid").agg(F.min("doc_id").alias("doc"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"), F.any_value("fine").alias("fine")),
        "partenum-sets-of",
    )
    groups = staged(
        known.mapInArrow(_signed, "sig bigint, sid bigint").repartition("sig").sortWithinPartitions("sig", "sid")
        .mapInArrow(_runs, "sig bigint, sid bigint, head bigint"),
        "partenum-groups",
    )
    stars = groups.groupBy(F.col("head").alias("a"), F.col("sid").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    likely = _likely(stars, profiles)
    # First each set with the head it shares most with: that joins nearly all that belong together.
    best = staged(
        likely.groupBy("b").agg(F.max_by(F.struct("a", "doc_a", "doc_b", "shared"), F.struct("shared", "a")).alias("p")).select("b", "p.*"),
        "partenum-best",
    )
    same_id = full.join(profiles, "sid").select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).filter("a <> b").distinct()
    twice = same_id.groupBy("a").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("a")
    links = _verified(best, known).unionAll(same_id.join(twice, "a", "left_semi"))
    labels = components(links)
    others = staged(_open(likely.join(best.select("a", "b"), ["a", "b"], "left_anti"), labels), "partenum-open")
    if not others.isEmpty():
        links = links.unionAll(_verified(others, known))
        labels = components(links)
    members = (
        groups.join(profiles, "sid").join(labels, F.col("doc") == F.col("node"), "left")
        .select("sig", "sid", "n", "fine", F.coalesce("component", "doc").alias("component"))
    )
    open_groups = (
        members.groupBy("sig").agg(
            F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"),
            F.bit_xor(F.xxhash64("sid")).alias("mix1"), F.bit_xor(F.xxhash64("sid", F.lit(7))).alias("mix2"),
        ).filter("low <> high")
        .groupBy("size", "mix1", "mix2").agg(F.min("sig").alias("sig"))
        .select("sig", F.ceil(F.col("size") / BLOCK).cast("bigint").alias("blocks"))
    )
    blocks = staged(
        members.join(open_groups, "sig")
        .groupBy("sig", F.pmod(F.xxhash64("sid"), F.col("blocks")).alias("block"))
        .agg(F.collect_list(F.struct("sid", "n", "component", "fine")).alias("members")),
        "partenum-blocks",
    )
    left = blocks.select("sig", F.col("block").alias("block_a"), F.col("members").alias("members_a"))
    right = blocks.select("sig", F.col("block").alias("block_b"), F.col("members").alias("members_b"))
    rest = (
        left.join(right, "sig").filter("block_a <= block_b")
        .select("members_a", "members_b", (F.col("block_a") == F.col("block_b")).alias("same"))
        .mapInArrow(_block_pairs, "a bigint, b bigint").distinct()
    )
    rest = _likely(rest.join(stars, ["a", "b"], "left_anti").withColumn("shared", F.lit(1).cast("bigint")), profiles)
    if not rest.isEmpty():
        labels = components(links.unionAll(_verified(rest, known)))
    whole = full.join(profiles.select("sid", "doc"), "sid").join(labels, F.col("doc") == F.col("node"), "left")
    found = whole.groupBy("doc_id").agg(F.min(F.coalesce("component", "doc")).alias("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of *docs* whose document is the smallest of its component; rows without doc_id stay."""
    others = (
        classes(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("other_id")).distinct()
    )
    return docs.join(others, docs["doc_id"] == others["other_id"], "left_anti")


def check_sql(table: str = "documents") -> str:
    """The rows of ``op5_partenum_join`` in DuckDB: all pairs that share a shingle, and their closure."""
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
 shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM split WHERE len(w) > 0)),
 sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
 common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
 both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM {table} UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, r.component_id FROM {table} d LEFT JOIN sizes USING (doc_id)
 JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
