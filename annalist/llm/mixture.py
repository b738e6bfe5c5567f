"""Mixing sources to target weights, with DataFrame operations only.

Sources share the words of the corpus by weight; no source gives more than *most* times what it
has, and what it cannot give is shared again. Documents of a source stand in hash-random order;
the mix takes whole epochs and then the head of that order up to the exact budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import staged, unused, words
from annalist.plans.shapes import ordered_chunks, running_count

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mixture"


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    """The place of a document in the random order of its source."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, capped) of each source of *sizes* (source, size).

    Sources stand in code point order, NULL last, and take *weights* in turn. Filling up is done
    in one pass: sources sorted by the level at which they run out are capped as long as their
    share of what is left exceeds what they can give.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_count(
        ordered_chunks(by_source.withColumn("absent", F.col("source").isNull()), "absent", "source"), F.lit(1), "place"
    )
    turn = F.array(*[F.lit(w) for w in weights])
    unit = 1
    for weight in set(weights):
        unit *= weight
    weighed = ranked.withColumn("weight", F.get(turn, (F.col("place") % len(weights)).cast("int")).cast("bigint"))
    levels = weighed.withColumn("level", (F.col("source_size") * most * unit / F.col("weight")).cast("decimal(38,0)"))
    ordered = ordered_chunks(
        levels.select("absent", "source", "source_size", "weight", "level"), "level", "absent", "source"
    )
    given = running_count(ordered, F.col("source_size") * most, "given").select("absent", "source", "given")
    used = running_count(ordered, F.col("weight"), "used")
    whole = by_source.agg(F.sum("source_size").alias("whole"))
    all_weight = ordered.rows.agg(F.sum("weight").alias("all_weight"))
    filled = (
        used.join(given.withColumnRenamed("source", "s").withColumnRenamed("absent", "n"),
                  F.col("source").eqNullSafe(F.col("s"))).drop("s", "n")
        .crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(all_weight))
        .withColumn("capped", (F.col("whole") - F.col("given")).cast("decimal(38,0)") * F.col("weight")
                    > (F.col("source_size") * most).cast("decimal(38,0)") * (F.col("all_weight") - F.col("used")))
    )
    filled = staged(filled, "mixture-levels")
    left = filled.agg(
        (F.first("whole") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size") * most)), F.lit(0))).alias("left"),
        F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("left_weight"),
    )
    share = (F.col("weight") * F.col("left")).cast("double") / F.col("left_weight")
    return staged(
        filled.crossJoin(F.broadcast(left)).select(
            "source", "source_size", "capped",
            F.when(F.col("capped"), (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"),
        ),
        "mixture-targets",
    )


def mixture(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of *docs*.

    ``size`` counts the words of the text (NULL: 0). ``taken`` is the number of words the mix takes
    from the row, over all epochs: whole epochs take ``size`` each, the last one follows the random
    order up to the budget and cuts the row it falls in. Rows of one doc_id have the same key and
    stand by size. An empty table gives an empty result; a corpus without words takes nothing.
    Other columns are ignored.
    """
    sizes = staged(
        docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"),
                    random_key(F.col("doc_id"), seed).alias("key")),
        "mixture-sizes",
    )
    wanted = targets(sizes, weights, most).select(
        F.col("source").alias("of"), "source_size", "target", F.floor("target").alias("budget")
    )
    bucket = F.substring("key", 1, 3)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        .select(F.col("source").alias("of"), F.col("bucket").alias("in_bucket"),
                F.coalesce(F.sum("words").over(before), F.lit(0)).alias("carried"))
    )
    inside = (
        Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        sizes.withColumn("bucket", bucket)
        .withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(carried, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in_bucket"))).drop("of")
        .join(wanted, F.col("source").eqNullSafe(F.col("of")))
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    ahead = F.col("carried") + F.col("inside")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - ahead))
    return placed.withColumn("epochs", epochs.cast("bigint")).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + last).cast("bigint").alias("taken"),
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """*docs* as the mix takes them: a row as often as an epoch takes words of it, at most *most*
    times, its last copy whole even where the budget ends inside it. A doc_id that stands in several
    rows goes by its largest share. Rows without doc_id or words are not taken.
    """
    share = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    key, times, copy = (unused(docs, n) for n in ("mixed_id", "mixed_times", "mixed_copy"))
    wanted = (
        mixture(docs, **settings).filter(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias(key)).agg(F.max(share).cast("int").alias(times))
        .filter(F.col(times) > 0)
    )
    joined = docs.join(wanted, docs["doc_id"] == wanted[key])
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def check_sql(table: str = "documents", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> str:
    """The rows of ``op8_source_mixture`` in DuckDB."""
    turn = f"[{', '.join(map(str, weights))}]"
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM {table}),
 sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
 weighed AS (
  SELECT *, list_extract({turn}, 1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(weights)})::INT)::BIGINT AS weight
  FROM sources),
 levels AS (
  SELECT *, coalesce(sum({most} * source_size) OVER w, 0) AS given, coalesce(sum(weight) OVER w, 0) AS used,
    sum(source_size) OVER () AS whole, sum(weight) OVER () AS all_weight FROM weighed
  WINDOW w AS (ORDER BY {most} * source_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 filled AS (SELECT *, (whole - given) * weight > {most} * source_size * (all_weight - used) AS capped FROM levels),
 remaining AS (
  SELECT first(whole) - coalesce(sum({most} * source_size) FILTER (capped), 0) AS rest,
    sum(weight) FILTER (NOT capped) AS rest_weight FROM filled),
 wanted AS (
  SELECT source, source_size, CASE WHEN capped THEN ({most} * source_size)::DOUBLE ELSE (weight * rest)::DOUBLE / rest_weight::DOUBLE END AS target
  FROM filled, remaining),
 placed AS (
  SELECT s.*, w.source_size, w.target, floor(w.target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, source, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size END
   + greatest(0, least(size, CASE WHEN source_size = 0 THEN 0 ELSE budget % source_size END - ahead)))::BIGINT AS taken
FROM placed
"""
