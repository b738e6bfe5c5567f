"""Function history across renames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import clock, text
from annalist.plans.shapes import top
from annalist.schema import History
from annalist.session import staged

MERGED = 8
_NODE = ["seed", "name", "path"]
_HISTORY = [
    "function_name", "file_path", "commit_hash", "change_type", "lines_added", "lines_removed",
    "author", "timestamp", "message",
]


def _reach(start: DataFrame, edges: DataFrame, seen: list[DataFrame]) -> list[DataFrame]:
    """(seed, node) numbers reached from *start* one join at a time, never entering *seen*.

    Each round is materialised, so a round costs one join with the edges whatever the depth,
    and the loop ends when a round finds nothing new. Rounds are put together after every MERGED of
    them, so neither plans nor the files that a round reads grow with the length of a chain.
    """
    found, frontier = list(seen), start
    while True:
        step = frontier.join(edges, "node").select("seed", F.col("to").alias("node"))
        known = reduce(DataFrame.unionByName, found)
        frontier = staged(step.distinct().join(known, ["seed", "node"], "left_anti"), "chain-round")
        if frontier.isEmpty():
            return found
        found.append(frontier)
        if len(found) > MERGED:
            found = [staged(reduce(DataFrame.unionByName, found), "chain-rounds")]


def _numbered(rows: DataFrame, number: str, name: str) -> DataFrame:
    """The different *rows* with a number each; written down, so a row keeps its number."""
    return staged(rows.distinct().withColumn(number, F.monotonically_increasing_id()), name)


def _same(a: DataFrame, b: DataFrame, columns: dict[str, str]) -> F.Column:
    return reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in columns.items()])


def rename_chain(h: History, seeds: DataFrame) -> DataFrame:
    """(seed, name, path): what each seed was renamed from, then what it was renamed to.

    Both walks begin at the seed; the second does not pass through nodes of the first. The different
    renames are read once, as pairs of node numbers, and the rounds meet on these numbers.
    """
    old, new = {"old_name": "name", "old_file_path": "path"}, {"new_name": "name", "new_file_path": "path"}
    renames = staged(h.function_renames.select(*old, *new).distinct(), "chain-renames")
    starts = staged(seeds.select(*_NODE).distinct(), "chain-seeds")
    ends = [renames.select(*[F.col(c).alias(n) for c, n in end.items()]) for end in (old, new)]
    nodes = _numbered(reduce(DataFrame.unionByName, [*ends, starts.select("name", "path")]), "node", "chain-nodes")
    labels = _numbered(starts.select("seed"), "number", "chain-labels")

    def at(rows: DataFrame, columns: dict[str, str], number: str) -> DataFrame:
        kept = [c for c in rows.columns if c not in columns]
        return rows.join(nodes, _same(rows, nodes, columns)).select(*[rows[c] for c in kept], F.col("node").alias(number))

    pairs = staged(at(at(renames, old, "old"), new, "new"), "chain-pairs")
    # a node without a name or a path is an end: nothing is known to be the same function
    open_nodes = nodes.filter("name IS NOT NULL AND path IS NOT NULL").select("node")

    def edges(start: str, end: str) -> DataFrame:
        both = pairs.select(F.col(start).alias("node"), F.col(end).alias("to"))
        return staged(both.join(open_nodes, "node", "left_semi"), "chain-edges")

    start = at(starts, {"name": "name", "path": "path"}, "node")
    start = staged(
        start.join(labels, start["seed"].eqNullSafe(labels["seed"])).select(F.col("number").alias("seed"), "node"), "chain-start"
    )
    found = _reach(start, edges("old", "new"), _reach(start, edges("new", "old"), [start]))
    reached = reduce(DataFrame.unionByName, found).withColumnRenamed("seed", "number")
    return reached.join(labels, "number").join(nodes, "node").select(*_NODE)


def _changes_of(h: History, chain: DataFrame) -> DataFrame:
    """Changes of the functions in *chain*, one per (commit, function, file)."""
    nodes = chain.select(
        F.col("name").alias("function_name"), F.col("path").alias("file_path")
    ).distinct()
    rest = [c for c in _HISTORY if c not in ("function_name", "file_path", "commit_hash")]
    rows = h.function_changes.join(nodes, ["function_name", "file_path"], "left_semi")
    one = rows.groupBy("function_name", "file_path", "commit_hash").agg(
        F.min(F.struct(*rest)).alias("row")
    )
    return one.select("function_name", "file_path", "commit_hash", "row.*").select(*_HISTORY)


def function_history(
    h: History, function_name: str, file_path: str, fuzzy: bool = False, limit: int | None = None
) -> DataFrame:
    """History of a function through its renames, newest first.

    *fuzzy* takes every path that contains *file_path* and does not follow renames.
    """
    if fuzzy:
        rows = h.function_changes.filter(
            (F.col("function_name") == function_name)
            & text.contains(F.col("file_path"), file_path)
        ).select(*_HISTORY)
    else:
        spark = h.function_changes.sparkSession
        seed = spark.createDataFrame(
            [(file_path, function_name, file_path)], "seed string, name string, path string"
        )
        rows = _changes_of(h, rename_chain(h, seed))
    order = [F.desc("timestamp"), "commit_hash", "file_path", "function_name", "change_type"]
    return _shown(top(rows, limit, *order))


def history_by_name(h: History, function_name: str) -> DataFrame:
    """History of a name in all files, through the renames of each; by file, newest first.

    A name without changes is looked up as the old name of a rename.
    """
    direct = staged(
        h.function_changes.filter(F.col("function_name") == function_name)
        .select("file_path")
        .distinct(),
        "chain-direct",
    )
    none = direct.agg((F.count("*") == 0).alias("none"))  # one row
    former = (
        h.function_renames.filter(F.col("old_name") == function_name)
        .select(F.col("old_file_path").alias("file_path"))
        .distinct()
        .join(F.broadcast(none))
        .filter("none")
        .drop("none")
    )
    seeds = direct.unionByName(former).select(
        F.col("file_path").alias("seed"),
        F.lit(function_name).alias("name"),
        F.col("file_path").alias("path"),
    )
    rows = _changes_of(h, rename_chain(h, seeds))
    return _shown(rows.orderBy("file_path", F.desc("timestamp"), "commit_hash", "function_name"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("timestamp", clock.known(F.col("timestamp")))
