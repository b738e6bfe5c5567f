"""Line dedup with a fixed-depth tree of line templates.

Lines descend as in a log parser: by their number of tokens, then by their leading tokens, where a token
with a digit counts as variable. Below, lines belong to one template if they agree in all their tokens, or
in all tokens of one of the two halves that alternate through the line: a template's other tokens
are its variable fields. So every line has three template keys, and lines of one leaf that differ in one
place, or in several places of one parity, always share one.

A template that stands in *min_docs* documents or more recurs. Its line in the first document (by doc_id)
stays; everywhere else lines of the template are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import mix, staged, text_chunks, unused, word_hashes

LEADING = 2
MIN_TOKENS = 5
MIN_HALF = 8  # tokens from which halves count as templates
MIN_DOCS = 3
_SEEDS = mix(np.arange(201, 208, dtype=np.uint64))
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number in its text, three template keys) of lines that are long enough; key 0: none."""
    hashes, rows, starts, _ = word_hashes(data, offsets)
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 3), np.uint64)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    ends = np.append(starts[1:], len(data))
    hashes = np.where(digits[ends] > digits[starts], _SEEDS[0], hashes)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[starts] - breaks[offsets[rows]]  # counts from 0 in each row
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (line[1:] != line[:-1])))
    size = np.diff(np.append(first, len(hashes)))
    inside = np.arange(len(hashes)) - np.repeat(first, size)
    scrambled = mix(hashes + mix(inside.astype(np.uint64)))
    leaf = mix(size.astype(np.uint64) + _SEEDS[1])
    for i in range(LEADING):
        leaf = mix(leaf + np.where(size > i, scrambled[np.minimum(first + i, len(hashes) - 1)], _SEEDS[2]))
    keys = np.empty((len(first), 3), dtype=np.uint64)
    keys[:, 0] = mix(np.add.reduceat(scrambled, first) + leaf + _SEEDS[3])
    for half in (0, 1):
        part = np.where(inside % 2 == half, scrambled, np.uint64(0))
        keys[:, 1 + half] = mix(np.add.reduceat(part, first) + leaf + _SEEDS[4 + half])
    keys[size < MIN_HALF, 1:] = 0
    long = size >= MIN_TOKENS
    return rows[first][long], line[first][long], keys[long]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in text_chunks(batch["text"]):
            rows, line, keys = _keys(data, offsets)
            ids = batch["doc_id"].slice(first, last - first).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [ids, batch["of"].slice(first, last - first).take(pa.array(rows)), pa.array(line.astype(np.int32)), *[pa.array(keys[:, i].copy().view(np.int64)) for i in range(3)]],
                ["doc_id", "of", "line", "k0", "k1", "k2"],
            )


def templates(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, first_doc) of the recurring templates of *lines*."""
    keys = lines.select("doc_id", F.explode(F.array("k0", "k1", "k2")).alias("key")).filter("key <> 0").distinct()
    return (
        keys.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))
        .filter(F.col("docs") >= min_docs).select("key", "first_doc")
    )


def _perhaps(keyed: DataFrame, recurring: DataFrame) -> DataFrame:
    """The rows of *keyed* whose key may be in *recurring*: a filter of fixed size, 2**22 bits in at most 2**16
    rows, meets them before anything is shuffled. What passes by chance falls out in the exact join behind it."""
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 22))
    one = F.lit(1).cast("bigint")
    bits = recurring.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", one, (place % 64).cast("int"))).alias("bits")
    )
    met = keyed.join(F.broadcast(bits), F.shiftright(place, 6) == F.col("word"))
    return met.filter(F.call_function("shiftright", F.col("bits"), (place % 64).cast("int")).bitwiseAND(one) == 1).select(*keyed.columns)


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, by_text: bool = False) -> DataFrame:
    """(doc_id, of, drop): for every document of *docs* with such lines, the sorted numbers (from 0, cut at
    line feeds) of the lines to drop.

    Lines of fewer than five tokens are never dropped and never counted; halves are templates from eight
    tokens on. A document's own repeats count once. Rows of one doc_id are one document with the lines of
    all its rows; rows without doc_id are left out. With *by_text* rows of different texts have line numbers
    of their own, and ``of`` is the hash of the text; else it is 0 and line numbers hold for all rows of a
    doc_id. NULL text has no lines, an empty table gives an empty
    result, other columns are ignored.
    """
    lines = staged(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (F.xxhash64("text") if by_text else F.lit(0).cast("bigint")).alias("of"))
        .filter("doc_id IS NOT NULL")
        .mapInArrow(_lines, "doc_id bigint, of bigint, line int, k0 bigint, k1 bigint, k2 bigint"),
        "logtree-lines",
    )
    recurring = staged(templates(lines, min_docs), "logtree-templates")
    keyed = lines.select("doc_id", "of", "line", F.explode(F.array("k0", "k1", "k2")).alias("key")).filter("key <> 0")
    return (
        _perhaps(keyed, recurring).join(recurring, "key").filter("doc_id <> first_doc")
        .groupBy("doc_id", "of").agg(F.sort_array(F.collect_set("line")).alias("drop"))
    )


def without_repeats(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """*docs* with their texts freed of recurring lines; rows left without a word are dropped if lines
    were taken from them. ``n_chars`` follows the text where there is such a column."""
    key, drop, of = unused(docs, "drop_id"), unused(docs, "drop_lines"), unused(docs, "drop_of")
    dropped = repeated_lines(docs, min_docs, by_text=True).select(F.col("doc_id").alias(key), F.col("of").alias(of), F.col("drop").alias(drop))
    joined = docs.join(dropped, (docs["doc_id"] == dropped[key]) & (F.xxhash64(docs["text"]) == dropped[of]), "left")

    def rest(lines):
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    # One element, so that the lines are cut once and named inside.
    kept = F.get(F.transform(F.array(F.split("text", "\n")), rest), F.lit(0))
    whole = F.col(drop).isNull()
    cut = joined.withColumn("text", F.when(whole, F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return cut.filter(whole | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped): every row of *docs* with its count of lines and the numbers of
    those that go, comma-joined."""
    drop = repeated_lines(docs, min_docs).select(F.col("doc_id").alias("drop_id"), "drop")
    counted = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint").alias("n_lines"))
    return counted.join(drop, F.col("doc_id") == F.col("drop_id"), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce(F.array_join(F.transform("drop", lambda i: i.cast("string")), ","), F.lit("")).alias("dropped"),
    )


def check_sql(table: str = "documents", min_docs: int = MIN_DOCS) -> str:
    """The rows of ``op9_template_lines`` in DuckDB, with the templates written out as text."""
    token = "regexp_replace(x, '^.*[0-9].*$', '<*>')"
    return f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {table}),
 numbered AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM split),
 tokens AS (SELECT doc_id, i, list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), lambda x: {token}) AS t FROM numbered),
 long AS (SELECT doc_id, i, t, len(t) || ' ' || array_to_string(t[1:{LEADING}], ' ') AS leaf FROM tokens WHERE len(t) >= {MIN_TOKENS}),
 keys AS (
  SELECT doc_id, i, leaf || ' all ' || array_to_string(t, ' ') AS key FROM long
  UNION ALL SELECT doc_id, i, leaf || ' even ' || array_to_string(list_filter(t, lambda x, n: n % 2 = 1), ' ') FROM long WHERE len(t) >= {MIN_HALF}
  UNION ALL SELECT doc_id, i, leaf || ' odd ' || array_to_string(list_filter(t, lambda x, n: n % 2 = 0), ' ') FROM long WHERE len(t) >= {MIN_HALF}),
 recurring AS (SELECT key, min(doc_id) AS first_doc FROM keys GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
 dropped AS (SELECT DISTINCT k.doc_id, k.i FROM keys k JOIN recurring r USING (key) WHERE k.doc_id <> r.first_doc),
 listed AS (SELECT doc_id, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS dropped FROM dropped GROUP BY doc_id)
SELECT s.doc_id, len(s.ls)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_dropped, coalesce(dropped, '') AS dropped
FROM split s LEFT JOIN listed USING (doc_id)
"""
