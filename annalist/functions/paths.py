"""Predicates and parts of file paths."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions.text import like

# Supported source extensions and their languages.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".jsx": "javascript",
    ".rs": "rust",
    ".go": "go",
    ".java": "java",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
}

# LIKE patterns of test paths; "_" is a wildcard.
TEST_PATTERNS = ["%test_%", "%_test.%", "%.test.%", "%__tests__%"]

# Structured configuration files.
CONFIG_SUFFIXES = [".json", ".yaml", ".yml", ".toml"]

# Dependency manifests by base name; requirements*.txt count as well.
MANIFESTS = ["package.json", "pyproject.toml", "Cargo.toml", "go.mod"]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def top_directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")


def parent_directory(path: Column) -> Column:
    """Everything up to and with the last slash; '' for a file in the root."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def extension(path: Column) -> Column:
    """The last suffix of the base name; a name that only starts with dots has none."""
    return F.regexp_extract(path, r"[^./][^/]*(\.[^./]*)$", 1)


def language_of(path: Column) -> Column:
    """Language by extension, NULL for files that are not source."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(LANGUAGES.items())])
    return F.try_element_at(table, extension(path))


def is_source(path: Column) -> Column:
    return extension(path).isin(list(LANGUAGES))


def is_test(path: Column) -> Column:
    matches = [like(path, pattern) for pattern in TEST_PATTERNS]
    return matches[0] | matches[1] | matches[2] | matches[3]


def is_config(path: Column) -> Column:
    return path.rlike(r"\.(?:json|yaml|yml|toml)\z")


def is_requirements(path: Column) -> Column:
    name = base_name(path)
    return name.startswith("requirements") & name.endswith(".txt")


def is_manifest(path: Column) -> Column:
    return base_name(path).isin(MANIFESTS) | is_requirements(path)
