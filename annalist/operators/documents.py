"""Facts from project documents: description, documentation inventory, milestones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.definitions import stripped
from annalist.plans.shapes import top

# Names looked for in the root, in this order, and the milestone heading.
READMES = ["README.md", "README.rst", "README.txt", "README"]
CHANGELOGS = ["CHANGELOG.md", "CHANGES.md", "HISTORY.md", "changelog.md"]
MILESTONE = r"##\s+\[?v?(\d+\.\d+(?:\.\d+)?)\]?\s*[-—(]\s*(\d{4}-\d{2}-\d{2})"


def milestones(texts: DataFrame, key: str, content: str, limit: int | None = 20) -> DataFrame:
    """Version headings of each text, in order: version, date and the rest of the line."""
    # the rest is captured by a look-ahead, so the next heading may follow on the same line
    pattern = F.lit(r"(?U)" + MILESTONE + r"(?=([^\n]*)(\n?))")
    groups = [F.regexp_extract_all(content, pattern, i) for i in (1, 2, 3, 4)]
    rows = texts.filter(F.col(content).rlike(r"(?U)" + MILESTONE)).select(
        key, F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "abcd")])).alias("i", "m")
    )
    if limit is not None:
        rows = rows.filter(F.col("i") < limit)
    title = stripped(F.col("m.c"))
    for mark in (")", "—", "-"):
        title = F.regexp_replace(title, rf"^[{mark}]+", "")
    title = F.when(F.col("m.d") == "", "").otherwise(F.substring(stripped(title), 1, 80))
    return rows.select(
        key,
        (F.col("i") + 1).alias("position"),
        F.col("m.a").alias("version"),
        F.col("m.b").alias("date"),
        title.alias("title"),
    )


def descriptions(texts: DataFrame, key: str, content: str) -> DataFrame:
    """First paragraph after headings, joined to one line of at most 500 characters."""
    lines = texts.select(
        key,
        F.inline(F.array(F.struct(F.transform(F.split(content, "\n"), stripped).alias("lines")))),
    )
    opens = F.transform(
        "lines", lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("=")
    )
    tail = lines.withColumn("first", F.array_position(opens, True)).withColumn(
        "tail",
        F.when(
            F.col("first") > 0,
            F.slice("lines", F.col("first").cast("int"), F.greatest(F.size("lines"), F.lit(1))),
        ).otherwise(F.array().cast("array<string>")),
    )
    stop = F.array_position("tail", "")
    length = F.when(stop > 0, stop - 1).otherwise(F.size("tail")).cast("int")
    return tail.select(
        key, F.substring(F.array_join(F.slice("tail", 1, length), " "), 1, 500).alias("description")
    )


def _first_of(head_files: DataFrame, names: list[str]) -> DataFrame:
    """The first of the named files that exists; at most one row."""
    listed = F.array(*map(F.lit, names))
    found = head_files.filter(F.col("file_path").isin(names))
    return top(found, 1, F.array_position(listed, F.col("file_path")))


def project_context(head_files: DataFrame) -> dict[str, DataFrame]:
    """Description, milestones and documentation inventory of a source tree."""
    docs = head_files.filter(F.col("file_path").rlike(r"^docs/[^/]+\.(?:md|rst|txt)\z")).select(
        F.substring("file_path", 6, 1 << 30).alias("name")
    )
    return {
        "description": descriptions(_first_of(head_files, READMES), "file_path", "content"),
        "milestones": milestones(_first_of(head_files, CHANGELOGS), "file_path", "content"),
        "doc_count": docs.agg(F.count("*").alias("doc_count")),
        "doc_names": top(docs, 10, "name"),
    }
