"""Vector search for many queries at once over vectors kept in lists.

``<root>/centroids`` holds the centres of the lists, fitted on a bounded sample, ``<root>/vectors`` every
vector in a folder of the list whose centre is nearest. A query reads the lists of its nearest centres; with
all lists it is exact. Queries and vectors of a list meet in blocks of bounded size, each of which gives no
more than the first rows of a query, so no window ever sees all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.operators.search import LEAST_COSINE

LISTS = 64
SAMPLE = 20_000  # vectors on which centres are fitted, the first by a hash of their key
ROUNDS = 10
VECTORS, QUERIES = 20_000, 500  # of a list, at most, that meet in one block

_HIT = "query_id string, type string, ref_id string, cosine double"


@dataclass(frozen=True)
class Lists:
    centroids: np.ndarray
    vectors: DataFrame


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centres of at most *lists* groups of the rows of *sample*, by cosine."""
    centres = sample[np.random.default_rng(5).permutation(len(sample))[:lists]]
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1.0), centres)
    return centres


def _assigned(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nearest = np.argmax(_matrix(batch["vector"]) @ centroids.T, axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], [*batch.schema.names, "list"])


def build(embeddings: DataFrame, root: str, dims: int, lists: int = LISTS) -> None:
    """Write the lists of the unit vectors (type, ref_id, vector) of *dims* components to *root*. Vectors that
    are NULL or of another length are left out, as in a search for a vector of that length."""
    spark = embeddings.sparkSession
    rows = embeddings.filter(F.size("vector") == dims).select("type", "ref_id", F.col("vector").cast("array<double>").alias("vector"))
    sample = rows.orderBy(F.xxhash64("type", "ref_id"), "type", "ref_id").limit(SAMPLE).select("vector").toArrow()
    centres = fitted(_matrix(sample["vector"]), lists) if sample.num_rows else np.zeros((1, dims))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, vector array<double>").write.mode("overwrite").parquet(f"{root}/centroids")
    placed = rows.mapInArrow(partial(_assigned, centres), "type string, ref_id string, vector array<double>, list int")
    placed.write.mode("overwrite").partitionBy("list").parquet(f"{root}/vectors")


def load(spark: SparkSession, root: str) -> Lists:
    centres = spark.read.parquet(f"{root}/centroids").orderBy("list").collect()  # at most as many rows as lists
    vectors = spark.read.schema("type string, ref_id string, vector array<double>, list int").parquet(f"{root}/vectors")
    return Lists(np.array([r["vector"] for r in centres]), vectors)


def _probed(centroids: np.ndarray, probes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = np.argsort(-(_matrix(batch["vector"]) @ centroids.T), axis=1, kind="stable")[:, :probes]
        rows = np.repeat(np.arange(batch.num_rows), near.shape[1])
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(near.reshape(-1).astype(np.int32))], [*batch.schema.names, "list"])


def _best(k: int, queries: pa.Table, vectors: pa.Table) -> pa.Table:
    """The first *k* vectors of a block for each of its queries."""
    columns: list[list] = [[], [], [], []]
    if queries.num_rows and vectors.num_rows:
        vectors = vectors.sort_by([("type", "ascending"), ("ref_id", "ascending")])
        names, types, refs = queries["query_id"].to_pylist(), vectors["type"].to_pylist(), vectors["ref_id"].to_pylist()
        for name, row in zip(names, _matrix(queries["vector"]) @ _matrix(vectors["vector"]).T):
            for at in np.argsort(-row, kind="stable")[:k].tolist():
                if row[at] >= LEAST_COSINE:
                    for column, value in zip(columns, (name, types[at], refs[at], float(row[at]))):
                        column.append(value)
    kinds = (pa.string(), pa.string(), pa.string(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "type", "ref_id", "cosine"])


def search(index: Lists, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """(query_id, type, ref_id, cosine, rank): the *k* most similar vectors for every query (query_id, vector of
    length one) with a cosine of at least 0.05, ties by key. *probes* lists are read a query, all by default."""
    dims = index.centroids.shape[1]
    wanted = queries.filter(F.size("vector") == dims).select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = wanted.mapInArrow(partial(_probed, index.centroids, probes or len(index.centroids)), "query_id string, vector array<double>, list int")

    def parts(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    # one row a list
    shape = F.broadcast(parts(asked, QUERIES, "q").join(parts(index.vectors, VECTORS, "v"), "list"))

    def blocks(rows: DataFrame, key: str, mine: str, theirs: str) -> DataFrame:
        return rows.join(shape, "list").withColumn(f"{mine}_part", F.pmod(F.xxhash64(key), F.col(mine)).cast("int")).withColumn(
            f"{theirs}_part", F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))
        ).drop("q", "v")

    place = ["list", "q_part", "v_part"]
    met = blocks(asked, "query_id", "q", "v").groupBy(*place).cogroup(blocks(index.vectors, "ref_id", "v", "q").groupBy(*place))
    found = met.applyInArrow(partial(_best, k), _HIT)
    first = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "type", "ref_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
