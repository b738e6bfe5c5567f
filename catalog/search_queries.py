"""Search documents, keyword, vector and hybrid search, embedding work, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import text
from annalist.operators import postings, search, vectors
from annalist.session import shared_folder
from annalist.sources import tables
from catalog.registry import direct, over
from catalog.views import history, read

# ---- text functions over whole texts -------------------------------------------------


@over("functions", "commits", sql="""
    SELECT name AS id, h_split(name) AS words FROM h_functions
    UNION ALL SELECT hash, h_split(message) FROM h_commits""")
def split_identifiers(h):
    parts = h.functions.select(F.col("name").alias("id"), text.split_identifiers(F.col("name")).alias("words"))
    return parts.unionByName(
        h.commits.select(F.col("hash").alias("id"), text.split_identifiers(F.col("message")).alias("words"))
    )


@direct(sql=r"""
    SELECT page_id, md5(array_to_string(list_sort(list_distinct(regexp_extract_all(
               strip_accents(lower(html)), '[\p{L}\p{N}]+'))), ' ')) AS vocabulary,
           len(regexp_extract_all(strip_accents(lower(html)), '[\p{L}\p{N}]+')) AS tokens FROM pages""")
def page_tokens(spark, sf_dir):
    tokens = text.search_tokens(F.col("html"))
    return read(spark, sf_dir, "pages").select(
        "page_id",
        F.md5(F.array_join(F.sort_array(F.array_distinct(tokens)), " ")).alias("vocabulary"),
        F.size(tokens).alias("tokens"),
    )


def _hits(patterns: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(q, '{p}') AS INTEGER)" for p in patterns)


# Fixed values, as in annalist.functions.text: patterns of queries, in the dialect of the check SQL.
_TECHNICAL = _hits([
    "[A-Z][a-z]+[A-Z]", "[a-z]+_[a-z]+", "[A-Z]{2,}", r"[\p{L}\p{N}_]+\.[\p{L}\p{N}_]+",
    r"[\p{L}\p{N}_]+\(\)", r"\*\.[\p{L}\p{N}_]+",
])
_EDGE = r"(?:^|[^\p{L}\p{N}_])"
_EDGE_END = r"(?:$|[^\p{L}\p{N}_])"
_CONCEPTUAL = _hits([
    f"(?i){_EDGE}(?:{words}){_EDGE_END}"
    for words in [
        "how|what|where|when|why|which", "does|is|are|was|were|can|should",
        "architecture|design|pattern|flow|process", "management|handling|processing|streaming",
    ]
])


@direct(sql=rf"""
    WITH q AS (SELECT DISTINCT text AS q FROM conversations),
    t AS (SELECT q, regexp_extract_all(q, '\S+') AS words, {_TECHNICAL} AS tech, {_CONCEPTUAL} AS concept FROM q),
    u AS (SELECT *, len(words) = 1 AND regexp_matches(words[1], '^[A-Za-z_][\p{{L}}\p{{N}}_]*$') AS single,
                 regexp_matches(coalesce(words[1], ''), '^.+\p{{Lu}}') OR contains(coalesce(words[1], ''), '_') AS coded FROM t),
    v AS (SELECT *, tech + CASE WHEN single AND coded THEN 3 ELSE 0 END AS te FROM u),
    w AS (SELECT *, concept + CASE WHEN single AND NOT coded THEN 1 ELSE 0 END
                 + CASE WHEN len(words) >= 3 AND te = 0 THEN 2 ELSE 0 END AS co FROM v)
    SELECT md5(q) AS id, round(CASE WHEN te + co = 0 THEN 0.5 ELSE greatest(0.15, least(0.85, te / (te + co))) END, 6) AS keyword
    FROM w""")
def query_weights(spark, sf_dir):
    asked = read(spark, sf_dir, "conversations").select("text").distinct()
    weights = text.query_weights(F.col("text"))
    return asked.select(
        F.md5("text").alias("id"), F.round(weights["keyword"], 6).alias("keyword")
    )


# ---- documents -------------------------------------------------------------------


@over("search_index", sql="""
    SELECT type, name, file_path, author, content, detail FROM h_search""")
def search_documents(h):
    return h.search_index


@over("search_index", sql="SELECT type, count(*) AS documents FROM h_search GROUP BY 1")
def search_document_counts(h):
    return search.document_counts(h.search_index)


# ---- keyword search ----------------------------------------------------------------


def _tokens_sql(column: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({column})), '[\p{{L}}\p{{N}}]+')"


def _bm25_sql(source: str, columns: list[str], terms: list[list[str]], keep: str) -> str:
    """Scores of the documents in *source* that hold every term."""
    fields = ", ".join(f"{_tokens_sql(c)} AS f{i}" for i, c in enumerate(columns))
    length = " + ".join(f"len(f{i})" for i in range(len(columns)))

    def count(phrase: list[str]) -> str:
        parts = []
        for i in range(len(columns)):
            same = " AND ".join(f"f{i}[p + {k}] = '{word}'" for k, word in enumerate(phrase))
            parts.append(f"len(list_filter(range(1, len(f{i}) + 1), lambda p: coalesce({same}, false)))")
        return " + ".join(parts)

    counts = ", ".join(f"{count(t)} AS tf{k}" for k, t in enumerate(terms))
    found = ", ".join(f"count(*) FILTER (tf{k} > 0) AS d{k}" for k in range(len(terms)))
    parts = [
        f"CASE WHEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) > 0 THEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) ELSE 1e-6 END"
        f" * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * len / mean))"
        for k in range(len(terms))
    ]
    every = " AND ".join(f"tf{k} > 0" for k in range(len(terms)))
    return f"""
        WITH t AS (SELECT *, {fields} FROM {source}),
        c AS (SELECT *, {length} AS len, {counts} FROM t),
        s AS (SELECT count(*) AS n, avg(len) AS mean, {found} FROM c)
        SELECT {keep}, round({" + ".join(parts)}, 6) AS score FROM c, s WHERE {every}"""


@direct(sql=_bm25_sql("documents", ["text", "source"], [["the"], ["and"]], "doc_id"))
def keyword_corpus(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    scored = search.keyword_scores(docs, "the AND", columns=["text", "source"])
    return scored.select("doc_id", F.round("score", 6).alias("score"))


_ALL = ["type", "name", "file_path", "author", "content", "detail"]
_indexes: dict[tuple[str, str], str] = {}


def stored_index(spark, sf_dir) -> postings.Index:
    """The index over all search documents of a sample, built by the first query of a session that asks for it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes:
        root = shared_folder(spark, "search-index")
        postings.build(history(spark, sf_dir, "search_index").search_index, root)
        _indexes[key] = root
    return postings.load(spark, _indexes[key])


@direct(sql=r"""
    WITH t AS (SELECT row_number() OVER () AS doc, unnest(regexp_extract_all(strip_accents(lower(concat_ws(chr(10),
                   coalesce(type, ''), coalesce(name, ''), coalesce(file_path, ''), coalesce(author, ''), coalesce(content, ''),
                   coalesce(detail, '')))), '[\p{L}\p{N}]+')) AS term FROM h_search)
    SELECT term, count(DISTINCT doc) AS documents, count(*) AS occurrences FROM t GROUP BY 1""")
def index_terms(spark, sf_dir):
    return postings.terms(stored_index(spark, sf_dir))


@direct(sql=_bm25_sql("h_search", _ALL, [["fix"], ["red", "widget"]], ", ".join(_ALL)))
def keyword_all(spark, sf_dir):
    scored = postings.keyword_scores(stored_index(spark, sf_dir), "fix red_widget")
    return scored.withColumn("score", F.round("score", 6))


@direct(sql="SELECT * FROM (" + _bm25_sql(
    "h_search", _ALL, [["small"], ["ring"]], ", ".join(_ALL)) + """)
    WHERE type = 'function' ORDER BY score DESC, type, name, file_path, detail, content LIMIT 20""")
def keyword_search(spark, sf_dir):
    hits = postings.keyword_search(stored_index(spark, sf_dir), "small ring", type_filter="function")
    return hits.withColumn("score", F.round("score", 6))


# ---- vectors -------------------------------------------------------------------------

_QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_COSINE = f"list_dot_product(CAST(vector AS DOUBLE[]), CAST({_QUERY} AS DOUBLE[]))"


def _query_vector(spark, sf_dir) -> list[float]:
    row = read(spark, sf_dir, "embeddings").filter("vec_id = 0").first()
    return [float(x) for x in row["embedding"]]


@direct(sql=f"""
    SELECT type, ref_id, round(cosine, 6) AS cosine FROM (SELECT *, {_COSINE} AS cosine FROM h_embeddings)
    WHERE cosine >= 0.05""")
def vector_scores(spark, sf_dir):
    h = history(spark, sf_dir, "embeddings")
    scored = search.vector_scores(h.embeddings, _query_vector(spark, sf_dir), limit=None)
    return scored.withColumn("cosine", F.round("cosine", 6))


_ENRICHED = f"""
    SELECT e.type,
           CASE WHEN e.type = 'function' THEN split_part(ref_id, '::', 1) ELSE ref_id[1:8] END AS name,
           CASE WHEN e.type = 'function' THEN split_part(ref_id, '::', 2) ELSE '' END AS file_path,
           coalesce(c.author, '') AS author, coalesce(c.message[1:100], '') AS content,
           coalesce(f.detail, 'commit ' || ref_id[1:8] || ' on '
               || strftime(to_timestamp(c."timestamp") AT TIME ZONE 'UTC', '%Y-%m-%d')
               || ' (' || c.files_changed || ' files)', '') AS detail,
           cosine, row_number() OVER (ORDER BY cosine DESC, e.type, ref_id) AS near_rank
    FROM (SELECT *, {_COSINE} AS cosine FROM h_embeddings WHERE {_COSINE} >= 0.05
          ORDER BY cosine DESC, type, ref_id LIMIT {{limit}}) e
    LEFT JOIN h_commits c ON e.type = 'commit' AND c.hash = ref_id
    LEFT JOIN (SELECT name, file_path, arg_min(kind || ' in ' || file_path || ' lines ' || start_line || '-'
                      || end_line || ' (' || language || ')', (start_line, kind)) AS detail
               FROM h_functions GROUP BY 1, 2) f
      ON e.type = 'function' AND f.name || '::' || f.file_path = ref_id"""


@direct(sql=f"""
    SELECT type, name, file_path, author, content, detail, round(cosine, 6) AS score,
           round(cosine, 6) AS cosine, 'semantic' AS source,
           CASE WHEN cosine >= 0.4 THEN 'HIGH' WHEN cosine >= 0.3 THEN 'GOOD' WHEN cosine >= 0.2 THEN 'FAIR'
                WHEN cosine >= 0.1 THEN 'LOW' ELSE 'WEAK' END AS relevance
    FROM ({_ENRICHED.format(limit=100)})""")
def vector_search(spark, sf_dir):
    h = history(spark, sf_dir, "embeddings", "functions", "commits")
    hits = search.vector_search(h, _query_vector(spark, sf_dir))
    return hits.withColumns({c: F.round(c, 6) for c in ["score", "cosine"]})


@direct(sql="""
    WITH v AS (SELECT type, ref_id, CAST(vector AS DOUBLE[]) AS v FROM h_embeddings),
    q AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0)
    SELECT query_id, type, ref_id, round(list_dot_product(q, v), 6) AS cosine,
           row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q, v) DESC, type, ref_id) AS rank
    FROM q, v WHERE list_dot_product(q, v) >= 0.05 QUALIFY rank <= 10""")
def vector_search_many(spark, sf_dir):
    """Every twentieth vector as a query, against all lists."""
    root = shared_folder(spark, "vector-lists")
    vectors.build(history(spark, sf_dir, "embeddings").embeddings, root, dims=64)
    asked = read(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select("vec_id", "embedding").toDF("query_id", "vector")
    return vectors.search(vectors.load(spark, root), asked).withColumn("cosine", F.round("cosine", 6))


# ---- hybrid --------------------------------------------------------------------------

_HYBRID = f"""
    WITH near AS ({_ENRICHED.format(limit=60)}),
    hits AS (SELECT *, row_number() OVER (ORDER BY score DESC, type, name, file_path, detail, content) AS r
             FROM ({{keyword}}) ORDER BY score DESC, type, name, file_path, detail, content LIMIT 60),
    exact AS (SELECT type, name, file_path, max(r) AS exact_rank, arg_max(author, r) AS author,
                     arg_max(content, r) AS content, arg_max(detail, r) AS detail FROM hits GROUP BY 1, 2, 3),
    most AS (SELECT CASE WHEN max(cosine) >= 0.05 THEN max(cosine) ELSE 1 END AS most FROM near),
    fused AS (
        SELECT coalesce(e.type, n.type) AS type, coalesce(e.name, n.name) AS name,
               coalesce(e.file_path, n.file_path) AS file_path, coalesce(e.author, n.author) AS author,
               coalesce(e.content, n.content) AS content, coalesce(e.detail, n.detail) AS detail,
               coalesce(cosine, 0.0) AS cosine,
               CASE WHEN exact_rank IS NOT NULL AND near_rank IS NOT NULL THEN 'hybrid'
                    WHEN exact_rank IS NOT NULL THEN 'exact' ELSE 'semantic' END AS source,
               0.5 * ((coalesce(0.6 / (60 + exact_rank), 0) + coalesce(0.4 / (60 + near_rank), 0)) / 0.033)
                 + 0.5 * coalesce(cosine / (SELECT most FROM most), 0) AS fused
        FROM exact e FULL JOIN near n ON e.type = n.type AND e.name = n.name AND e.file_path = n.file_path),
    boosted AS (
        SELECT *, CASE WHEN fused >= 0.5 * max(fused) OVER () THEN fused
                       * CASE type WHEN 'function' THEN 1.10 WHEN 'change' THEN 0.95 ELSE 1 END
                       * CASE source WHEN 'hybrid' THEN 1.15 ELSE 1 END ELSE fused END AS score FROM fused),
    kept AS (SELECT *, max(score) OVER () AS best FROM boosted),
    placed AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, type, name) AS place
               FROM kept WHERE score >= 0.15 * best)
    SELECT type, name, file_path, author, content, detail, round(score, 6) AS score, round(cosine, 6) AS cosine,
           source, CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.5 THEN 'GOOD' WHEN score >= 0.3 THEN 'FAIR'
                        WHEN score >= 0.15 THEN 'LOW' ELSE 'WEAK' END AS relevance
    FROM placed WHERE file_path = '' OR place <= 3 ORDER BY score DESC, type, name, file_path LIMIT 20"""


@direct(sql=_HYBRID.format(keyword=_bm25_sql("h_search", _ALL, [["small"], ["ring"]], ", ".join(_ALL))))
def hybrid_search(spark, sf_dir):
    h = history(spark, sf_dir, "embeddings", "functions", "commits")
    index = stored_index(spark, sf_dir)
    hits = search.hybrid_search(
        h, "small ring", _query_vector(spark, sf_dir), weights=(0.6, 0.4),
        keyword=lambda query, limit, type_: postings.keyword_search(index, query, limit, type_),
    )
    return hits.withColumns({c: F.round(c, 6) for c in ["score", "cosine"]})


# ---- embedding store -------------------------------------------------------------------


_WORK = """
    SELECT type, ref_id, text FROM (
        SELECT 'function' AS type, name || '::' || file_path AS ref_id,
               name || ' — ' || kind || ' in ' || file_path || chr(10) || 'Signature: ' || signature || chr(10)
                 || 'Keywords: ' || h_split(name) AS text FROM h_functions
        UNION ALL
        SELECT 'commit', hash, message || chr(10) || 'Files changed: ' || files_changed || chr(10) || 'Author: ' || author
        FROM h_commits)
    """


@over("functions", "commits", "embeddings", sql=_WORK + "WHERE (type, ref_id) NOT IN (SELECT (type, ref_id) FROM h_embeddings)")
def embedding_work(h):
    return search.embedding_work(h)


@over("functions", "commits", "embeddings", sql=_WORK)
def embedding_work_all(h):
    return search.embedding_work(h, model_changed=True)


@over("embeddings", sql="""
    SELECT count(*) AS total, count(*) FILTER (type = 'function') AS functions,
           count(*) FILTER (type = 'commit') AS commits, 'sample-64' AS model, max(len(vector)) AS dim
    FROM h_embeddings""")
def embedding_stats(h):
    return search.embedding_stats(h.embeddings)


@over("embeddings", sql="SELECT DISTINCT ref_id FROM h_embeddings WHERE type = 'function'")
def embedded_functions(h):
    return search.embedded_ids(h.embeddings, "function")


@direct(sql="""
    SELECT vec_id, unnest(range(0, len(v))) AS place,
           CAST(CAST(unnest(v) / sqrt(list_dot_product(v, v)) AS FLOAT) AS DOUBLE) AS value
    FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(x * 3 AS FLOAT) AS DOUBLE)) AS v FROM embeddings)""")
def normalized_vectors(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: (x * 3).cast("float"))
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(search.normalized(scaled)).alias("place", "unit")
    ).select("vec_id", F.col("place").cast("bigint").alias("place"), F.col("unit").cast("double").alias("value"))


@direct(sql="""
    SELECT type, ref_id, CASE WHEN type = 'commit' THEN 'new' ELSE 'sample-64' END AS model FROM h_embeddings""")
def upsert_embeddings(spark, sf_dir):
    stored = history(spark, sf_dir, "embeddings").embeddings
    update = stored.filter("type = 'commit'").withColumn("model", F.lit("new"))
    return tables.upsert("embeddings", stored, update).select("type", "ref_id", "model")
