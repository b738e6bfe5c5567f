"""Quality rules with a robust multivariate outlier test, with DataFrame operations only.

A document first meets two plain rules. The others are judged inside their language and source: their
statistics, transformed and rounded to integers, are compared with a minimum-covariance-determinant
estimate of the group by Mahalanobis distance.

The estimate is found by concentration steps. A step puts every document of a group into a bin of its
distance, sums counts, values and products per bin, and keeps the nearest bins that hold the wanted share
of the group. All sums are sums of integers, so results do not depend on the order of rows, and a group
of any size is aggregated in parts. Variances have a floor (a regularised determinant), so groups that
are small or have a constant statistic need no rule of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import SPACES, staged

SYMBOLS = "#*$%&|<>"
#: The transformed statistics and the smallest standard deviation that a group is given for them.
FLOORS = {"x1": 24, "x2": 120, "x3": 80, "x4": 60, "x5": 64}
NAMES = list(FLOORS)
SHARE = (3, 4)  # of a group that an estimate rests on
STEPS = 3
#: Makes the covariance of the nearest three quarters that of the whole, for five normal variables.
CONSISTENCY = 1.41
CUT = 60.0


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the plain counts of every row of *docs*.

    Words are runs of anything but the six ASCII spaces; NULL has none. Windows of three words are told
    apart by a 64-bit hash. Everything is computed inside the row.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, "\t\n\x0b\x0c\r ", "")
    rows = docs.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split(text, SPACES), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.char_length(bare).cast("bigint").alias("word_chars"),
        (F.char_length(bare) - F.char_length(F.translate(bare, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    n = F.size("words")
    word = lambda i: F.get("words", i)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    windows = rows.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols",
        n.cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))).alias("hashes"),
    )
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    sorted_ = windows.withColumn("sorted", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed).otherwise(none))
    near = lambda i: F.coalesce(F.get("sorted", i)["h"], F.lit(None))
    same = lambda e, i: F.coalesce(e["h"] == near(i - 1), F.lit(False)) | F.coalesce(e["h"] == near(i + 1), F.lit(False))
    found = sorted_.withColumn("at", F.sort_array(F.transform(F.filter("sorted", same), lambda e: e["i"])))
    reach = F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3))))
    return found.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.aggregate(reach, F.lit(0), lambda a, b: a + b).cast("bigint").alias("n_repeat_words"),
    )


def transformed(stats: DataFrame) -> DataFrame:
    """*stats* with the base rule and the vector of a document as integers."""
    part = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return stats.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.floor(F.least(F.lit(64.0), part("word_chars", "n_words")) * 64).alias("x1"),
        F.floor(F.log1p(1000 * part("n_symbols", "word_chars")) * 256).alias("x2"),
        F.floor(part("n_dup_lines", "n_lines") * 1024).alias("x3"),
        F.floor(part("n_repeat_words", "n_words") * 1024).alias("x4"),
        F.floor(F.log(F.greatest(F.lit(1), F.col("n_words")).cast("double")) * 64).alias("x5"),
    )


def distance(centre: list[Column], spread: list[list[Column]]) -> list[tuple[str, Column]]:
    """Named columns that end in ``d2``, the squared Mahalanobis distance, by a Cholesky factor written out."""
    p, out = len(NAMES), []
    low = lambda i, j: F.col(f"l{i}{j}")
    for i in range(p):
        for j in range(i + 1):
            rest = spread[i][j]
            for k in range(j):
                rest = rest - low(i, k) * low(j, k)
            out.append((f"l{i}{j}", F.sqrt(rest) if i == j else rest / low(j, j)))
    for i, name in enumerate(NAMES):
        rest = F.col(name) - centre[i]
        for k in range(i):
            rest = rest - low(i, k) * F.col(f"y{k}")
        out.append((f"y{i}", rest / low(i, i)))
    total = F.col("y0") * F.col("y0")
    for i in range(1, p):
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return [*out, ("d2", total)]


def _factor(moments: DataFrame) -> DataFrame:
    """The Cholesky factor of each group, so that rows only have to solve with it."""
    p = len(NAMES)
    n = F.col("m").cast("double")
    centre = [(F.col(f"s{i}") / n) for i in range(p)]
    out = moments.select("glang", "gsource", *[c.alias(f"c{i}") for i, c in enumerate(centre)],
                         *[(F.col(f"q{i}{j}") / n).alias(f"q{i}{j}") for i in range(p) for j in range(i + 1)])
    spread = [[(F.col(f"q{i}{j}") - F.col(f"c{i}") * F.col(f"c{j}")) * CONSISTENCY
               + (float(FLOORS[NAMES[i]] ** 2) if i == j else 0.0) for j in range(i + 1)] for i in range(p)]
    for name, column in distance([F.lit(0)] * p, spread):
        if not name.startswith("l"):
            break
        out = out.withColumn(name, column)
    return out.select("glang", "gsource", *[f"c{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def _measured(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """*rows* joined to the estimate of their group, with ``d2``."""
    p = len(NAMES)
    joined = rows.join(groups, F.col("lang").eqNullSafe(F.col("glang")) & F.col("source").eqNullSafe(F.col("gsource")), "left")
    for name, column in distance([F.col(f"c{i}") for i in range(p)], [[F.lit(0)] * p] * p):
        if not name.startswith("l"):
            joined = joined.withColumn(name, column)
    return joined


def _moments(measured: DataFrame) -> DataFrame:
    """Counts, sums and products of the nearest documents of each group."""
    p = len(NAMES)
    sums = [F.sum(F.col(NAMES[i])).alias(f"s{i}") for i in range(p)]
    products = [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q{i}{j}") for i in range(p) for j in range(i + 1)]
    bins = measured.groupBy(
        F.col("lang").alias("glang"), F.col("source").alias("gsource"),
        F.floor(F.log1p(F.least("d2", F.lit(1e12))) * 16).alias("bin"),
    ).agg(F.count(F.lit(1)).alias("m"), *sums, *products)
    group = Window.partitionBy("glang", "gsource")
    before = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    near = bins.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).withColumn("all", F.sum("m").over(group))
    return (
        near.filter(F.col("before") * SHARE[1] < F.col("all") * SHARE[0])
        .groupBy("glang", "gsource")
        .agg(*[F.sum(c).alias(c) for c in bins.columns if c not in ("glang", "gsource", "bin")])
    )


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges, as the first estimate: a factor without correlations."""
    p = len(NAMES)
    quartiles = rows.groupBy(F.col("lang").alias("glang"), F.col("source").alias("gsource")).agg(
        *[F.percentile(x, [0.25, 0.5, 0.75]).alias(f"p{i}") for i, x in enumerate(NAMES)]
    )
    columns = [F.get(f"p{i}", F.lit(1)).alias(f"c{i}") for i in range(p)]
    for i, name in enumerate(NAMES):
        wide = (F.get(f"p{i}", F.lit(2)) - F.get(f"p{i}", F.lit(0))) / 1.349
        for j in range(i + 1):
            columns.append((F.sqrt(wide * wide + float(FLOORS[name] ** 2)) if i == j else F.lit(0.0)).alias(f"l{i}{j}"))
    return quartiles.select("glang", "gsource", *columns)


def quality(docs: DataFrame, cut: float = CUT, steps: int = STEPS) -> DataFrame:
    """One row for every row of *docs*: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, d2 and kept.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows. ``kept`` is false
    then, and where the distance ``d2`` from the group's estimate exceeds *cut*. NULL language or source
    is a group of its own, NULL text counts as empty, rows of one doc_id are judged one by one, an empty
    table gives an empty result, other columns are ignored.
    """
    rows = staged(transformed(statistics(docs)), "quality-statistics")
    judged = rows.filter(~F.col("base_failed"))
    groups = staged(_start(judged), "quality-start")
    for step in range(steps):
        groups = staged(_factor(_moments(_measured(judged, groups))), f"quality-step{step}")
    return _measured(rows, groups).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(~F.col("base_failed"), F.col("d2")).alias("d2"),
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= cut, F.lit(True))).alias("kept"),
    )


def good(docs: DataFrame, **settings) -> DataFrame:
    """The rows of *docs* that are kept. A doc_id in several rows is kept if one of them is; rows
    without doc_id are dropped."""
    ids = quality(docs, **settings).filter("kept").select(F.col("doc_id").alias("good_id")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["good_id"], "left_semi")


def check_sql(table: str = "documents", cut: float = CUT, steps: int = STEPS) -> str:
    """The rows of ``op1_quality_outliers`` in DuckDB."""
    p = len(NAMES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    parts = [f"""
WITH texts AS (SELECT doc_id, lang, source, row_number() OVER () AS rid, coalesce(text, '') AS text FROM {table}),
 split AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
   regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g') AS bare FROM texts),
 windows AS (SELECT rid, unnest(range(0, len(words) - 2)) AS i, words FROM split),
 grams AS (SELECT rid, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] AS g FROM windows),
 twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
 covered AS (SELECT rid, count(DISTINCT w) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS w FROM twice) GROUP BY rid),
 stats AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(bare)::BIGINT AS word_chars,
   (length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
   FROM split LEFT JOIN covered USING (rid)),
 vectors AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
   floor(least(64.0::DOUBLE, word_chars::DOUBLE / greatest(1, n_words)) * 64)::BIGINT AS x1,
   floor(ln(1 + 1000 * (n_symbols::DOUBLE / greatest(1, word_chars))) * 256)::BIGINT AS x2,
   floor(n_dup_lines::DOUBLE / greatest(1, n_lines) * 1024)::BIGINT AS x3,
   floor(n_repeat_words::DOUBLE / greatest(1, n_words) * 1024)::BIGINT AS x4,
   floor(ln(greatest(1, n_words)::DOUBLE) * 64)::BIGINT AS x5 FROM stats),
 judged AS (SELECT * FROM vectors WHERE NOT base_failed)"""]

    def measured(rows: str, groups: str) -> str:
        text = f"(SELECT r.*, {', '.join(f'g.c{i}' for i in range(p))}, {', '.join(f'g.l{i}{j}' for i, j in pairs)} FROM {rows} r LEFT JOIN {groups} g ON r.lang IS NOT DISTINCT FROM g.lang AND r.source IS NOT DISTINCT FROM g.source)"
        for i, name in enumerate(NAMES):
            rest = f"{name}::DOUBLE - c{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i))
            text = f"(SELECT *, ({rest}) / l{i}{i} AS y{i} FROM {text})"
        return f"(SELECT *, {' + '.join(f'y{i} * y{i}' for i in range(p))} AS d2 FROM {text})"

    columns = [f"median({x}) AS c{i}" for i, x in enumerate(NAMES)]
    for i, j in pairs:
        wide = f"(quantile_cont({NAMES[i]}, 0.75) - quantile_cont({NAMES[i]}, 0.25)) / 1.349::DOUBLE"
        columns.append(f"sqrt({wide} * ({wide}) + {FLOORS[NAMES[i]] ** 2}::DOUBLE) AS l{i}{j}" if i == j else f"0.0::DOUBLE AS l{i}{j}")
    parts.append(f"g0 AS (SELECT lang, source, {', '.join(columns)} FROM judged GROUP BY lang, source)")
    for step in range(steps):
        sums = ", ".join([f"sum({x}) AS s{i}" for i, x in enumerate(NAMES)] + [f"sum({NAMES[i]} * {NAMES[j]}) AS q{i}{j}" for i, j in pairs])
        parts.append(f"b{step} AS (SELECT lang, source, floor(ln(1 + least(d2, 1e12::DOUBLE)) * 16) AS bin, count(*) AS m, {sums} FROM {measured('judged', f'g{step}')} GROUP BY ALL)")
        parts.append(f"n{step} AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY lang, source ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(m) OVER (PARTITION BY lang, source) AS whole FROM b{step})")
        means = ", ".join([f"sum(s{i})::DOUBLE / sum(m)::DOUBLE AS c{i}" for i in range(p)] + [f"sum(q{i}{j})::DOUBLE / sum(m)::DOUBLE AS q{i}{j}" for i, j in pairs])
        text = f"(SELECT lang, source, {means} FROM n{step} WHERE before * {SHARE[1]} < whole * {SHARE[0]} GROUP BY lang, source)"
        for i, j in pairs:
            rest = f"(q{i}{j} - c{i} * c{j}) * {CONSISTENCY}::DOUBLE" + (f" + {FLOORS[NAMES[i]] ** 2}::DOUBLE" if i == j else "")
            rest += "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            text = f"(SELECT *, {f'sqrt({rest})' if i == j else f'({rest}) / l{j}{j}'} AS l{i}{j} FROM {text})"
        parts.append(f"g{step + 1} AS (SELECT * FROM {text})")
    return ",\n".join(parts) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(d2 <= {cut}, true) AS kept FROM {measured('vectors', f'g{steps}')}
"""
