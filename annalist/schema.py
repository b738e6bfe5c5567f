"""Table schemas of a code history, and the bundle the operators read."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T


TEXT = T.StringType()
INT = T.IntegerType()
LONG = T.LongType()
REAL = T.DoubleType()
SIGNALS = ("body", "signature", "name", "size", "location")


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "commits": _table(
        hash=TEXT, author=TEXT, timestamp=LONG, message=TEXT, files_changed=INT,
        semantic_tags=T.ArrayType(TEXT),
    ),
    "functions": _table(
        name=TEXT, file_path=TEXT, language=TEXT, start_line=INT, end_line=INT, kind=TEXT,
        signature=TEXT, docstring=TEXT,
    ),
    "function_changes": _table(
        function_name=TEXT, file_path=TEXT, commit_hash=TEXT, change_type=TEXT, lines_added=INT,
        lines_removed=INT, author=TEXT, timestamp=LONG, message=TEXT,
    ),
    "blame_entries": _table(
        function_name=TEXT, file_path=TEXT, author=TEXT, line_count=INT, percentage=REAL,
        commit_hash=TEXT,
    ),
    "function_renames": _table(
        commit_hash=TEXT, old_name=TEXT, old_file_path=TEXT, old_kind=TEXT, new_name=TEXT,
        new_file_path=TEXT, new_kind=TEXT, confidence=REAL,
        signals=_table(**{name: REAL for name in SIGNALS}),
    ),
    "config_changes": _table(
        file_path=TEXT, key_path=TEXT, commit_hash=TEXT, change_type=TEXT, old_value=TEXT,
        new_value=TEXT, author=TEXT, timestamp=LONG, message=TEXT,
    ),
    "dep_changes": _table(
        file_path=TEXT, package=TEXT, commit_hash=TEXT, change_type=TEXT, old_version=TEXT,
        new_version=TEXT, author=TEXT, timestamp=LONG, message=TEXT,
    ),
    "embeddings": _table(
        type=TEXT, ref_id=TEXT, text=TEXT, vector=T.ArrayType(T.FloatType()), model=TEXT
    ),
    "search_index": _table(
        type=TEXT, name=TEXT, file_path=TEXT, author=TEXT, content=TEXT, detail=TEXT
    ),
    # raw inputs
    "commit_files": _table(commit_hash=TEXT, path=TEXT, insertions=INT, deletions=INT, lines=INT),
    "file_versions": _table(
        commit_hash=TEXT, file_path=TEXT, before_content=TEXT, after_content=TEXT
    ),
    "head_files": _table(file_path=TEXT, language=TEXT, content=TEXT),
    "blame_lines": _table(file_path=TEXT, line_number=INT, commit_hash=TEXT, author=TEXT),
    "tags": _table(name=TEXT, hash=TEXT, timestamp=LONG, author=TEXT, message=TEXT),
}

# Upsert keys: a later row replaces an earlier one with the same key.
KEYS: dict[str, list[str]] = {
    "commits": ["hash"],
    "functions": ["name", "file_path", "kind", "start_line"],
    "embeddings": ["type", "ref_id"],
}


@dataclass(frozen=True)
class History:
    """Named DataFrames; an operator reads only the ones it needs."""

    commits: DataFrame | None = None
    functions: DataFrame | None = None
    function_changes: DataFrame | None = None
    blame_entries: DataFrame | None = None
    function_renames: DataFrame | None = None
    config_changes: DataFrame | None = None
    dep_changes: DataFrame | None = None
    embeddings: DataFrame | None = None
    search_index: DataFrame | None = None
    commit_files: DataFrame | None = None
    file_versions: DataFrame | None = None
    head_files: DataFrame | None = None
    blame_lines: DataFrame | None = None
    tags: DataFrame | None = None

    def with_tables(self, **tables: DataFrame) -> "History":
        return replace(self, **tables)

    def present(self) -> dict[str, DataFrame]:
        return {f.name: t for f in fields(self) if (t := getattr(self, f.name)) is not None}
