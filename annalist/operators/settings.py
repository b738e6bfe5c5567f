"""Changes of configuration keys and of dependencies, from file contents before and after."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.functions import paths
from annalist.operators.definitions import once, stripped
from annalist.operators.lookup import newest_commits
from annalist.schema import History

try:
    import yaml
except ImportError:  # reading a YAML file then fails
    yaml = None
_YAML = getattr(yaml, "CSafeLoader", None) or getattr(yaml, "SafeLoader", None)

_AT = ["commit_hash", "file_path"]
_PAIRS = T.ArrayType(T.StructType().add("key", T.StringType()).add("value", T.StringType()))


# ---- shared: two sides of named values, and the commit they belong to --------------


def _versions(h: History, wanted: Column, max_commits: int | None) -> tuple[DataFrame, DataFrame]:
    versions = h.file_versions.filter(wanted)
    commits = h.commits
    if max_commits is not None:
        commits = newest_commits(h, max_commits)
        hashes = commits.select(F.col("hash").alias("commit_hash"))
        versions = versions.join(hashes, "commit_hash", "left_semi")
    return versions, commits.select(
        F.col("hash").alias("commit_hash"), "author", "timestamp", "message"
    )


def _differences(sides: DataFrame, item: str, labels: dict[str, str]) -> DataFrame:
    """Compare ``before_entries`` and ``after_entries`` (key, value) of every row, inside the row; a repeated key
    keeps its last value. Both sides are sorted together, so the two values of a key are neighbours."""
    def side(name: str, number: int) -> Column:
        return F.transform(
            f"{name}_entries",
            lambda e, i: F.struct(e["key"].alias("key"), F.lit(number).alias("side"), i.alias("place"), e["value"].alias("value")),
        )

    def beside(array: str, i: Column, step: int) -> Column:
        return F.get(F.col(array), i + step)

    def same_key(a: Column, b: Column) -> Column:
        return F.coalesce(a["key"] == b["key"], F.lit(False))

    def last(e: Column, i: Column) -> Column:
        following = beside("sorted", i, 1)
        return ~(same_key(e, following) & F.coalesce(e["side"] == following["side"], F.lit(False)))

    def changed(e: Column, i: Column) -> Column:
        following = beside("named", i, 1)
        both = (e["side"] == 0) & same_key(e, following)
        change = (
            F.when(both, F.when(e["value"] != following["value"], F.lit(labels["changed"])))
            .when(e["side"] == 0, labels["removed"])
            .when(~same_key(e, beside("named", i, -1)), labels["added"])
        )
        old, new = F.when(e["side"] == 0, e["value"]), F.when(both, following["value"]).when(e["side"] == 1, e["value"])
        return F.struct(e["key"].alias(item), change.alias("change_type"), old.alias("old"), new.alias("new"))

    together = F.sort_array(F.concat(side("before", 0), side("after", 1)))
    ordered = once(sides, {"sorted": together}).select(*_AT, "sorted")
    named = once(ordered, {"named": F.filter("sorted", last)}).select(*_AT, "named")
    found = F.filter(F.transform("named", changed), lambda c: c["change_type"].isNotNull())
    return named.select(*_AT, F.inline(found))


# ---- configuration -------------------------------------------------------------


def _load(text: str, file_path: str) -> object:
    if file_path.endswith(".json"):
        return json.loads(text)
    if file_path.endswith(".toml"):
        return tomllib.loads(text)
    return yaml.load(text, Loader=_YAML)


def _leaves(tree: dict) -> dict[str, str]:
    """Dotted key to text; lists as JSON, nothing as ``null``, the rest as Python shows it."""
    leaves: dict[str, str] = {}
    todo = [(str(key), value) for key, value in reversed(tree.items())]
    while todo:
        key, value = todo.pop()
        if isinstance(value, dict):
            todo += [
                (f"{key}.{k}" if key else str(k), v) for k, v in reversed(value.items())
            ]
        elif isinstance(value, list):
            leaves[key] = json.dumps(value)
        else:
            leaves[key] = "null" if value is None else str(value)
    return leaves


@F.pandas_udf(_PAIRS)
def _config_leaves(content: pd.Series, file_path: pd.Series) -> pd.Series:
    """Leaves of each file; empty if it does not parse or is not a mapping."""
    if yaml is None and any(text.strip() and not path.endswith((".json", ".toml")) for text, path in zip(content, file_path)):
        raise RuntimeError("YAML files need PyYAML on every executor")
    broken = (ValueError, RecursionError, *([yaml.YAMLError] if yaml else []))  # JSON and TOML errors are ValueErrors
    found = []
    for text, path in zip(content, file_path):
        try:
            tree = _load(text, path) if text.strip() else None
            leaves = _leaves(tree) if isinstance(tree, dict) else {}
        except broken:
            leaves = {}
        found.append([{"key": k, "value": v} for k, v in leaves.items()])
    return pd.Series(found)


def _both(versions: DataFrame, entries: Callable[[str], Column], *steps: Callable[[str], dict[str, Column]]) -> DataFrame:
    """*versions* with the entries of both sides, one after the other in the same row. *steps* make columns that
    the entries read, each step once a row."""
    sides = {"before_entries": "before_content", "after_entries": "after_content"}
    filled = versions.select(*_AT, *[F.coalesce(c, F.lit("")).alias(c) for c in sides.values()])
    for step in steps:
        filled = once(filled, {name: column for c in sides.values() for name, column in step(c).items()})
    return filled.select(*_AT, *[entries(c).alias(name) for name, c in sides.items()])


def config_changes(h: History, max_commits: int | None = None) -> DataFrame:
    """The ``config_changes`` table: keys added, modified or deleted per commit and file."""
    versions, commits = _versions(h, paths.is_config(F.col("file_path")), max_commits)
    changed = _differences(
        _both(versions, lambda c: _config_leaves(c, "file_path")), "key_path",
        {"added": "added", "removed": "deleted", "changed": "modified"},
    )
    return changed.join(commits, "commit_hash").select(
        "file_path", "key_path", "commit_hash", "change_type",
        F.col("old").alias("old_value"), F.col("new").alias("new_value"),
        "author", "timestamp", "message",
    )


# ---- dependencies --------------------------------------------------------------

# Line shapes and section names of the manifest formats.
_URL = r"^(git\+|https?://|ssh://)"
_REQUIREMENT = (
    r"^([a-zA-Z0-9._-]+)(?:\[.*?\])?\s*((?:[><=!~]+\s*\S+(?:\s*,\s*[><=!~]+\s*\S+)*)?)\z"
)
_PEP508 = r"^([a-zA-Z0-9._-]+)\s*(?:\[.*?\])?\s*([><=!~].*)?"
NPM_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
POETRY_SECTIONS = ["dependencies", "dev-dependencies"]
CARGO_SECTIONS = ["dependencies", "dev-dependencies", "build-dependencies"]


def _normal_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def _or_star(version: Column) -> Column:
    return F.when(version == "", F.lit("*")).otherwise(version)


def _lines(content: str) -> Column:
    """Stripped lines, cut where Python's ``splitlines`` cuts."""
    breaks = r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085\u2028\u2029]"
    return F.transform(F.split(content, breaks), stripped)


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _requirement_entries(lines: Column) -> Column:
    pattern = "(?U)" + _REQUIREMENT

    def entry(line: Column) -> Column:
        return _entry(_normal_name(F.regexp_extract(line, pattern, 1)), _or_star(stripped(F.regexp_extract(line, pattern, 2))))

    kept = F.filter(lines, lambda x: ~x.startswith("#") & ~x.startswith("-") & ~x.rlike(_URL))
    plain = F.transform(kept, lambda x: F.regexp_replace(x, r"(?Us)\s+#.*$", ""))
    return F.transform(F.filter(plain, lambda x: x.rlike(pattern)), entry)


def _npm_entries(content: str) -> Column:
    schema = ", ".join(f"{section} map<string,string>" for section in NPM_SECTIONS)
    parsed = F.from_json(content, schema, {"allowSingleQuotes": "false"})
    empty = F.array().cast("array<struct<key:string,value:string>>")
    sections = F.flatten(F.array(*[F.coalesce(F.map_entries(parsed[s]), empty) for s in NPM_SECTIONS]))
    return F.transform(sections, lambda e: _entry(e["key"], F.coalesce(e["value"], F.lit("None"))))


def _go_mark(line: Column) -> Column:
    return F.when(line.startswith("require ("), 1).when(line == ")", 0)


def _go_marks(lines: Column) -> Column:
    """Where a block opens (1) or closes (0)."""
    every = F.transform(lines, lambda x, i: F.struct(i.alias("at"), _go_mark(x).alias("mark")))
    return F.filter(every, lambda m: m["mark"].isNotNull())


def _go_entries(lines: Column, marks: Column) -> Column:
    """Inside a block the last mark before a line opens one."""
    def described(line: Column, i: Column) -> Column:
        state = F.try_element_at(F.filter(marks, lambda m: m["at"] < i), F.lit(-1))["mark"]
        text = stripped(F.regexp_replace(line, r"(?s)//.*$", ""))
        single = text.startswith("require ") & ~F.contains(text, F.lit("("))
        words = F.regexp_extract_all(F.when(single, F.substring(text, 9, 1 << 30)).otherwise(text), F.lit(r"(?U)\S+"), 0)
        return F.struct((_go_mark(line).isNull() & (single | (F.coalesce(state, F.lit(0)) == 1))).alias("listed"), words.alias("words"))

    return F.transform(
        F.filter(F.transform(lines, described), lambda x: x["listed"] & (F.size(x["words"]) >= 2)), lambda x: _entry(x["words"][0], x["words"][1])
    )


def _table(tree: object, *keys: str) -> dict:
    for key in keys:
        tree = tree.get(key, {}) if isinstance(tree, dict) else {}
    return tree if isinstance(tree, dict) else {}


def _versioned(section: dict, lower: bool) -> list[tuple[str, str]]:
    found = []
    for name, spec in section.items():
        if isinstance(spec, dict):
            spec = spec.get("version", "*")
        if isinstance(spec, str):
            found.append((name.lower() if lower else name, spec))
    return found


def _python_project(tree: dict) -> list[tuple[str, str]]:
    project = _table(tree, "project")
    texts = list(project.get("dependencies", []))
    for group in _table(project, "optional-dependencies").values():
        texts += group
    found = [(None, text) for text in texts]
    for section in POETRY_SECTIONS:
        poetry = dict(_table(tree, "tool", "poetry", section))
        poetry.pop("python", None)
        found += _versioned(poetry, lower=True)
    return found


def _cargo(tree: dict) -> list[tuple[str, str]]:
    return [pair for s in CARGO_SECTIONS for pair in _versioned(_table(tree, s), lower=False)]


_TOML = {"pyproject.toml": _python_project, "Cargo.toml": _cargo}


@F.pandas_udf(_PAIRS)
def _toml_pairs(content: pd.Series, name: pd.Series) -> pd.Series:
    """Names and versions of TOML manifests; one without a name is a requirement text to take apart. Content is
    NULL for files of another kind."""
    found = []
    for text, base in zip(content, name):
        try:
            pairs = _TOML[base](tomllib.loads(text)) if text is not None else []
        except (tomllib.TOMLDecodeError, TypeError, AttributeError):
            pairs = []
        found.append([{"key": n, "value": v} for n, v in pairs])
    return pd.Series(found)


def _toml_entries(pairs: Column) -> Column:
    def entry(e: Column) -> Column:
        text, whole = e["value"], e["key"].isNotNull()
        version = _or_star(stripped(F.regexp_extract(text, _PEP508, 2)))
        return _entry(
            F.when(whole, e["key"]).otherwise(_normal_name(F.regexp_extract(text, _PEP508, 1))), F.when(whole, text).otherwise(version)
        )

    return F.transform(F.filter(pairs, lambda e: e["key"].isNotNull() | e["value"].rlike(_PEP508)), entry)


def dependency_changes(h: History, max_commits: int | None = None) -> DataFrame:
    """The ``dep_changes`` table: packages added, removed or bumped per commit and manifest."""
    path = F.col("file_path")
    versions, commits = _versions(h, paths.is_manifest(path), max_commits)
    name = paths.base_name(path)
    toml = name.isin(*_TOML)

    def entries(content: str) -> Column:
        lines = F.col(f"{content}_lines")
        return (
            F.when(paths.is_requirements(path), _requirement_entries(lines))
            .when(name == "package.json", _npm_entries(content))
            .when(toml, _toml_entries(_toml_pairs(F.when(toml, F.col(content)), name)))
            .when(name == "go.mod", _go_entries(lines, F.col(f"{content}_marks")))
            .otherwise(F.array().cast("array<struct<key:string,value:string>>"))
        )

    listed = _both(
        versions, entries,
        lambda c: {f"{c}_lines": _lines(c)},
        lambda c: {f"{c}_marks": _go_marks(F.col(f"{c}_lines"))},
    )
    changed = _differences(listed, "package", {"added": "added", "removed": "removed", "changed": "bumped"})
    return changed.join(commits, "commit_hash").select(
        "file_path", "package", "commit_hash", "change_type",
        F.col("old").alias("old_version"), F.col("new").alias("new_version"),
        "author", "timestamp", "message",
    )
