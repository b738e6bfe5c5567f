"""Search documents, and keyword, vector and hybrid search over them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import clock, labels, text
from annalist.operators.lookup import primary_owners
from annalist.plans.shapes import top
from annalist.schema import History

# Term saturation and length weight of the keyword score.
K1, B = 1.2, 0.75
# Fixed values of the fusion: rank constant, rank scale, blend, boosts and cutoffs.
RANK_CONSTANT = 60
RANK_SCALE = 0.033
BLEND = 0.5
BOOSTS = {"function": 1.10, "change": 0.95}
BOTH_BOOST = 1.15
BOOST_FROM, KEEP_FROM = 0.5, 0.15
PER_FILE = 3
LEAST_COSINE = 0.05

DOCUMENT = ["type", "name", "file_path", "author", "content", "detail"]


# ---- documents -----------------------------------------------------------------


def _commit_detail(commit_hash: Column) -> Column:
    day = F.date_format(clock.utc_date(F.col("timestamp")), "yyyy-MM-dd")
    return F.concat(
        F.lit("commit "), text.short_hash(commit_hash), F.lit(" on "), day, F.lit(" ("),
        F.col("files_changed").cast("string"), F.lit(" files)"),
    )


def _function_detail() -> Column:
    return F.concat(
        F.col("kind"), F.lit(" in "), F.col("file_path"), F.lit(" lines "),
        F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"),
        F.lit(" ("), F.col("language"), F.lit(")"),
    )


def documents(h: History) -> DataFrame:
    """One document per commit, function and change."""
    commit_docs = h.commits.select(
        F.lit("commit").alias("type"),
        text.short_hash(F.col("hash")).alias("name"),
        F.lit("").alias("file_path"),
        "author",
        text.split_identifiers(F.col("message")).alias("content"),
        _commit_detail(F.col("hash")).alias("detail"),
    )
    owners = primary_owners(h.blame_entries).select(
        F.col("function_name").alias("name"), "file_path", "owner"
    )
    function_docs = h.functions.join(owners, ["name", "file_path"], "left").select(
        F.lit("function").alias("type"),
        "name",
        "file_path",
        F.coalesce("owner", F.lit("")).alias("author"),
        F.concat_ws(
            " ", "kind", text.split_identifiers(F.col("name")),
            text.split_identifiers(F.col("signature")),
        ).alias("content"),
        _function_detail().alias("detail"),
    )
    change_docs = h.function_changes.select(
        F.lit("change").alias("type"),
        F.col("function_name").alias("name"),
        "file_path",
        "author",
        F.concat_ws(
            " ", "change_type", text.split_identifiers(F.col("function_name")),
            text.split_identifiers(F.col("message")),
        ).alias("content"),
        F.concat(
            F.col("change_type"), F.lit(" +"), F.col("lines_added").cast("string"), F.lit("/-"),
            F.col("lines_removed").cast("string"), F.lit(" in "),
            text.short_hash(F.col("commit_hash")),
        ).alias("detail"),
    )
    return commit_docs.unionByName(function_docs).unionByName(change_docs)


def document_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("type").agg(F.count("*").alias("documents"))


# ---- keyword search ------------------------------------------------------------


def query_terms(query: str) -> list[list[str]]:
    """Terms of a query: each a phrase of one or more index tokens."""
    words = re.findall(r"[A-Za-z0-9_]+", query)
    phrases = [[t for t in word.lower().split("_") if t] for word in words]
    return [p for p in phrases if p]


def _occurrences(folded: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in a field, at adjacent positions.

    Only fields that contain the letters of the phrase are cut into tokens.
    """
    tokens = text.folded_tokens(folded)
    if len(phrase) == 1:
        hits = F.filter(tokens, lambda t: t == phrase[0])
    else:
        pairs = [
            F.slice(tokens, k + 1, F.greatest(F.size(tokens) - len(phrase) + 1, F.lit(0)))
            for k in range(len(phrase))
        ]
        names = [str(k) for k in range(len(phrase))]
        rows = F.arrays_zip(*[p.alias(n) for p, n in zip(pairs, names)])
        hits = F.filter(
            rows,
            lambda row: reduce(lambda a, b: a & b, [row[n] == w for n, w in zip(names, phrase)]),
        )
    possible = reduce(lambda a, b: a & b, [F.contains(folded, F.lit(w)) for w in phrase])
    return F.when(possible, F.size(hits)).otherwise(0)


def keyword_scores(docs: DataFrame, query: str, columns: list[str] = DOCUMENT) -> DataFrame:
    """Documents that hold every query term, with their BM25 ``score``.

    Frequencies and lengths run over all *columns* together, a phrase stays inside one.
    The collection is read twice, once for its statistics (one row) and once for the
    scores; documents are never exploded or shuffled.
    """
    terms = query_terms(query)
    if not terms:
        return docs.withColumn("score", F.lit(0.0)).limit(0)
    names = [f"tf{i}" for i in range(len(terms))]
    folded = [text.fold(F.coalesce(c, F.lit(""))).alias(f"folded{i}") for i, c in enumerate(columns)]
    # a generator keeps the folding from being repeated by every expression that reads it
    prepared = docs.select("*", F.inline(F.array(F.struct(*folded))))
    fields = [F.col(f"folded{i}") for i in range(len(columns))]

    def total(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, parts)

    counted = prepared.select(
        *docs.columns,
        total([F.regexp_count(f, F.lit(text.TOKEN)) for f in fields]).alias("length"),
        *[total([_occurrences(f, t) for f in fields]).alias(n) for n, t in zip(names, terms)],
    )
    statistics = counted.agg(
        F.count("*").alias("n_docs"),
        F.avg("length").alias("mean_length"),
        *[F.count_if(F.col(n) > 0).alias(f"d{n}") for n in names],
    )
    matching = reduce(lambda a, b: a & b, [F.col(n) > 0 for n in names])
    return (
        counted.filter(matching)
        .join(F.broadcast(statistics))  # one row
        .select(*docs.columns, bm25(names).alias("score"))
    )


def bm25(names: list[str]) -> Column:
    """Score of a row with the frequencies *names* and ``length``, the statistics ``n_docs`` and ``mean_length``,
    and how many documents hold each term, ``d`` before its name."""
    parts = []
    for n in names:
        with_term = F.col(f"d{n}")
        rarity = F.ln((F.col("n_docs") - with_term + 0.5) / (with_term + 0.5))
        weight = F.when(rarity > 0, rarity).otherwise(F.lit(1e-6))
        length = F.lit(1 - B) + B * F.col("length") / F.col("mean_length")
        parts.append(weight * F.col(n) * (K1 + 1) / (F.col(n) + K1 * length))
    return reduce(lambda a, b: a + b, parts)


def keyword_search(
    docs: DataFrame, query: str, limit: int | None = 20, type_filter: str | None = None
) -> DataFrame:
    """Best keyword hits. Statistics are of all documents, whatever the type filter."""
    scored = keyword_scores(docs, query)
    if type_filter is not None:
        scored = scored.filter(F.col("type") == type_filter)
    return top(scored, limit, F.desc("score"), "type", "name", "file_path", "detail", "content")


# ---- vectors -------------------------------------------------------------------


def unit(vector: list[float]) -> list[float]:
    """Scaled to length one; a zero vector stays as it is."""
    norm = math.sqrt(sum(x * x for x in vector)) or 1.0
    return [x / norm for x in vector]


def normalized(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    norm = F.when(norm == 0, 1.0).otherwise(norm)
    return F.transform(vector, lambda x: (x / norm).cast("float"))


def similarity(vector: Column, query: list[float]) -> Column:
    """Dot product with *query*, a batch of vectors at a time."""
    weights = np.asarray(query, dtype=np.float64)

    @F.arrow_udf("double")
    def dot(vectors: pa.Array) -> pa.Array:
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        matrix = values.astype(np.float64).reshape(len(vectors), len(weights))
        return pa.array(matrix @ weights)

    return dot(vector)


def vector_scores(
    embeddings: DataFrame, query: list[float], limit: int | None = 100, type_filter: str | None = None
) -> DataFrame:
    """Most similar embeddings with a cosine of at least 0.05, without metadata. Vectors that are NULL or
    of another length than the query (from another model) have no score."""
    rows = embeddings.filter(F.size("vector") == len(query))
    if type_filter is not None:
        rows = rows.filter(F.col("type") == type_filter)
    scored = rows.select("type", "ref_id", similarity(F.col("vector"), query).alias("cosine"))
    return top(
        scored.filter(F.col("cosine") >= LEAST_COSINE), limit, F.desc("cosine"), "type", "ref_id"
    )


def _reference_key(ref_id: Column) -> list[Column]:
    """Name and path that an embedding stands for."""
    is_function = (F.col("type") == "function") & F.contains(ref_id, F.lit("::"))
    cut_at = F.instr(ref_id, "::")
    name = F.when(is_function, F.substring_index(ref_id, "::", 1)).when(
        F.col("type") == "commit", text.short_hash(ref_id)
    )
    path = F.when(is_function, F.substring(ref_id, cut_at + 2, F.length(ref_id)))
    return [
        F.coalesce(name, ref_id).alias("name"),
        F.coalesce(path, F.lit("")).alias("file_path"),
    ]


def enrich(hits: DataFrame, h: History) -> DataFrame:
    """Author, content and detail of vector hits, empty where the source row is gone."""
    keyed = hits.select("*", *_reference_key(F.col("ref_id")))
    detail = (
        h.functions.groupBy(F.lit("function").alias("type"), "name", "file_path")
        .agg(F.min_by(_function_detail(), F.struct("start_line", "kind")).alias("function_detail"))
    )
    commits = h.commits.select(
        F.lit("commit").alias("type"),
        F.col("hash").alias("ref_id"),
        F.col("author").alias("commit_author"),
        F.substring("message", 1, 100).alias("commit_content"),
        _commit_detail(F.col("hash")).alias("commit_detail"),
    )
    empty = F.lit("")
    return (
        keyed.join(detail, ["type", "name", "file_path"], "left")
        .join(commits, ["type", "ref_id"], "left")
        .select(
            *hits.columns, "name", "file_path",
            F.coalesce("commit_author", empty).alias("author"),
            F.coalesce("commit_content", empty).alias("content"),
            F.coalesce("function_detail", "commit_detail", empty).alias("detail"),
        )
    )


def vector_search(
    h: History, query: list[float], limit: int | None = 100, type_filter: str | None = None
) -> DataFrame:
    """Vector hits with metadata and a relevance label."""
    hits = vector_scores(h.embeddings, query, limit, type_filter)
    score = F.col("cosine")
    return (
        enrich(hits, h)
        .select(
            *DOCUMENT, score.alias("score"), "cosine", F.lit("semantic").alias("source"),
            labels.cosine_relevance(score).alias("relevance"),
        )
        .orderBy(F.desc("score"), "type", "name", "file_path")
    )


# ---- hybrid --------------------------------------------------------------------


def hybrid_search(
    h: History,
    query: str,
    query_vector: list[float] | None,
    limit: int = 20,
    type_filter: str | None = None,
    weights: tuple[float, float] = (0.5, 0.5),
    keyword: Callable[[str, int, str | None], DataFrame] | None = None,
) -> DataFrame:
    """Keyword and vector hits fused by rank and cosine. *keyword* (query, limit, type) lists the keyword hits,
    for instance from a stored index; by default the documents are searched.

    After the two top-k searches there are at most ``6 * limit`` rows, so the windows
    without a partition key and the joins below are small by construction.
    """
    fetch = 3 * limit
    key = ["type", "name", "file_path"]
    exact_order = [F.desc("score"), *[F.col(c) for c in [*key, "detail", "content"]]]
    hits = keyword(query, fetch, type_filter) if keyword else keyword_search(h.search_index, query, fetch, type_filter)
    exact = hits.withColumn(
        "exact_rank", F.row_number().over(Window.orderBy(*exact_order))
    )
    # several documents may share a key: the last of them counts
    exact = exact.groupBy(*key).agg(
        F.max("exact_rank").alias("exact_rank"),
        *[F.max_by(c, "exact_rank").alias(f"exact_{c}") for c in ["author", "content", "detail"]],
    )
    embeddings = h.embeddings if query_vector is not None else h.embeddings.limit(0)
    near = vector_scores(embeddings, query_vector or [], fetch, type_filter).withColumn(
        "near_rank", F.row_number().over(Window.orderBy(F.desc("cosine"), "type", "ref_id"))
    )
    described = enrich(near, h)
    near = described.groupBy(*key).agg(
        F.max("near_rank").alias("near_rank"),
        *[F.max_by(c, "near_rank").alias(c) for c in ["cosine", "author", "content", "detail"]],
    )
    most = near.agg(F.max("cosine").alias("most"))
    most = most.select(
        F.when(F.col("most") >= LEAST_COSINE, F.col("most")).otherwise(1.0).alias("most")
    )

    def rank_part(rank: str, weight: float) -> Column:
        return F.coalesce(weight * (1.0 / (RANK_CONSTANT + F.col(rank))), F.lit(0.0))

    in_exact, in_near = F.col("exact_rank").isNotNull(), F.col("near_rank").isNotNull()
    ranks = rank_part("exact_rank", weights[0]) + rank_part("near_rank", weights[1])
    fused = exact.join(near, key, "full_outer").join(F.broadcast(most)).select(
        *key,
        *[
            F.when(in_exact, F.col(f"exact_{c}")).otherwise(F.col(c)).alias(c)
            for c in ["author", "content", "detail"]
        ],
        F.coalesce("cosine", F.lit(0.0)).alias("cosine"),
        F.when(in_exact & in_near, "hybrid").when(in_exact, "exact").otherwise("semantic").alias("source"),
        (
            BLEND * (ranks / RANK_SCALE)
            + BLEND * F.coalesce(F.col("cosine") / F.col("most"), F.lit(0.0))
        ).alias("fused"),
    )
    everything = Window.partitionBy()
    kind = F.col("type")
    boost = F.when(kind == "function", BOOSTS["function"]).when(kind == "change", BOOSTS["change"]).otherwise(1.0)
    both = F.when(F.col("source") == "hybrid", BOTH_BOOST).otherwise(1.0)
    boosted = fused.withColumn("best", F.max("fused").over(everything)).withColumn(
        "score",
        F.when(F.col("fused") >= F.col("best") * BOOST_FROM, F.col("fused") * boost * both).otherwise(
            F.col("fused")
        ),
    )
    kept = boosted.withColumn("best", F.max("score").over(everything)).filter(
        F.col("score") >= F.col("best") * KEEP_FROM
    )
    in_file = Window.partitionBy("file_path").orderBy(F.desc("score"), *key)
    diverse = kept.withColumn("place", F.row_number().over(in_file)).filter(
        (F.col("file_path") == "") | (F.col("place") <= PER_FILE)
    )
    listed = diverse.select(
        *DOCUMENT, "score", "cosine", "source",
        labels.hybrid_relevance(F.col("score")).alias("relevance"),
    )
    return top(listed, limit, F.desc("score"), *key)


# ---- embedding store -----------------------------------------------------------


def embedding_work(h: History, model_changed: bool = False) -> DataFrame:
    """(type, ref_id, text) of functions and commits that have no vector yet; all of them
    if the model changed."""
    functions = h.functions.select(
        F.lit("function").alias("type"),
        F.concat_ws("::", "name", "file_path").alias("ref_id"),
        text.function_text(
            F.col("name"), F.col("kind"), F.col("file_path"), F.col("signature"),
            F.coalesce("docstring", F.lit("")),
        ).alias("text"),
    )
    commits = h.commits.select(
        F.lit("commit").alias("type"),
        F.col("hash").alias("ref_id"),
        text.commit_text(F.col("message"), F.col("files_changed"), F.col("author")).alias("text"),
    )
    wanted = functions.unionByName(commits)
    if model_changed:
        return wanted
    return wanted.join(h.embeddings.select("type", "ref_id"), ["type", "ref_id"], "left_anti")


def embedding_stats(embeddings: DataFrame) -> DataFrame:
    """One row of counts, model and dimension; no row without embeddings."""
    row = embeddings.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("type") == "function").alias("functions"),
        F.count_if(F.col("type") == "commit").alias("commits"),
        F.coalesce(F.max("model"), F.lit("unknown")).alias("model"),
        F.max(F.size("vector")).alias("dim"),
    )
    return row.filter("total > 0")


def embedded_ids(embeddings: DataFrame, type_: str) -> DataFrame:
    return embeddings.filter(F.col("type") == type_).select("ref_id").distinct()
