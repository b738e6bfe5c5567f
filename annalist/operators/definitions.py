"""Definitions in source text, by line patterns, without a shuffle.

A small Arrow helper goes through the lines of a file once: it finds the lines that define something and where
their blocks end. What is made of the definitions are column expressions.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import paths
from annalist.schema import History

# Line patterns of definitions.
_PYTHON = r"^\s*(?:def\s+(\w+)|class\s+(\w+))"
_JS_NAMED = r"(?:export\s+)?(?:async\s+)?(?:function\s+(\w+)|class\s+(\w+))"
_JS_ARROW = (
    r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[A-Za-z_]\w*)\s*=>"
)
_RUST = (
    r"(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?(?:fn\s+(\w+)|(?:struct|enum|trait|impl)\s+(\w+))"
)
_GO = r"(?:func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)|type\s+(\w+)\s+(?:struct|interface))"
_JAVA_TYPE = (
    r"(?:public|private|protected)?\s*(?:static\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)"
)
_JAVA_METHOD = (
    r"(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\("
)
_C_TYPE = r"(?:typedef\s+)?(?:struct|class|enum)\s+(\w+)"
_C_FUNCTION = r"(?:\w[\w\s\*]*?)\s+(\w+)\s*\([^)]*\)\s*\{"
JAVA_KEYWORDS = [
    "if", "else", "while", "for", "switch", "catch", "synchronized", "return", "throw", "new", "try",
]
# Per language, the patterns in the order they are tried, each with the
# groups that hold the name of a function and of a class (0 for none).
_SCRIPT = [(_JS_NAMED, 1, 2), (_JS_ARROW, 1, 0)]
_C = [(_C_TYPE, 0, 1), (_C_FUNCTION, 1, 0)]
GRAMMARS: dict[str, list[tuple[str, int, int]]] = {
    "python": [(_PYTHON, 1, 2)],
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "rust": [(_RUST, 1, 2)],
    "go": [(_GO, 1, 2)],
    "java": [(_JAVA_TYPE, 0, 1), (_JAVA_METHOD, 1, 0)],
    "c": _C,
    "cpp": _C,
}

@cache
def _classes() -> tuple[str, str]:
    """White space and word characters, as a Unicode regex counts them in Spark, as members of a character class."""
    ranges, first, last = [], None, None
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        # letters, marks, digits and connectors; circled letters; joiners
        if kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or code in (0x200C, 0x200D) or any(a <= code <= b for a, b in _CIRCLED):
            if last != code - 1:
                ranges += [(first, last)] if first is not None else []
                first = code
            last = code
    ranges.append((first, last))
    return _SPACES, "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CIRCLED = [(0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189)]
# Comments and literals that hide braces; possessive, so that long literals are gone through once.
_HIDDEN = [
    ("//", re.compile(r"(?s)//.*$"), ""),
    ('"', re.compile(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'), '""'),
    ("'", re.compile(r"(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'"), "''"),
    ("`", re.compile(r"(?s)`[^`\\]*+(?:\\.[^`\\]*+)*+`"), "``"),
]


# Signs one of which stands in every line that the pattern matches.
_SIGNS = {
    _PYTHON: "def|class", _JS_NAMED: "function|class", _JS_ARROW: "=>", _RUST: "fn|struct|enum|trait|impl", _GO: "func|type",
    _JAVA_TYPE: "class|interface|enum", _JAVA_METHOD: r"\(", _C_TYPE: "struct|class|enum", _C_FUNCTION: r"\{",
}


@cache
def _patterns(language: str, ascii_only: bool) -> list[tuple[re.Pattern, re.Pattern, list[tuple[int, str]]]]:
    """Signs, pattern, and (group, kind) of the names it gives; the wide classes are only made for lines that need them."""
    def compiled(pattern: str) -> re.Pattern:
        if ascii_only:
            return re.compile(pattern, re.ASCII)
        space, word = _classes()
        inside = pattern.replace(r"[\w\s\*]", f"[{word}{space}*]")
        return re.compile(inside.replace(r"\w", f"[{word}]").replace(r"\s", f"[{space}]"))

    return [
        (re.compile(_SIGNS[pattern]), compiled(pattern), [(group, kind) for kind, group in zip(["function", "class"], groups) if group])
        for pattern, *groups in GRAMMARS[language]
    ]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _indent(line: str) -> int:
    """Width of the leading white space, -1 for a blank line."""
    rest = len(line.lstrip(_SPACES))
    return len(line) - rest if rest else -1


def _balance(line: str) -> int:
    """Opening minus closing braces outside comments and literals."""
    if "{" not in line and "}" not in line:
        return 0
    for sign, pattern, replacement in _HIDDEN:
        if sign in line:
            line = pattern.sub(replacement, line)
    return line.count("{") - line.count("}")


def _named(line: str, language: str) -> tuple[str, str] | None:
    """Name and kind that the first matching pattern of the language gives."""
    for signs, pattern, groups in _patterns(language, line.isascii()):
        found = pattern.search(line) if signs.search(line) else None
        for group, kind in groups if found else []:
            if found[group]:
                return found[group], kind
    return None


class _Memo(dict):
    """Facts of lines, made once for every different line of a batch: two versions of a file share most of theirs."""

    def __init__(self, fact: Callable[[str], object]):
        super().__init__()
        self.fact = fact

    def __missing__(self, line: str) -> object:
        found = self[line] = self.fact(line)
        return found


class Outlines:
    """Finds the definitions of texts of one batch."""

    def __init__(self) -> None:
        self.memos: dict[str, tuple[_Memo, _Memo]] = {}

    def of(self, lines: list[str], language: str) -> list[tuple[str, str, int, int]]:
        """(name, kind, first line, last line) of the definitions in the order of their lines."""
        if language not in self.memos:
            self.memos[language] = (_Memo(lambda line: _named(line, language)), _Memo(_indent if language == "python" else _balance))
        named, level = self.memos[language]
        found = [(i, name) for i, name in enumerate(map(named.__getitem__, lines)) if name]
        if not found:
            return []
        ends = (_indented_ends if language == "python" else _braced_ends)([*map(level.__getitem__, lines)], [i for i, _ in found])
        return [
            (name, kind, at + 1, end)
            for (at, (name, kind)), end in zip(found, ends.tolist())
            if not (language == "java" and kind == "function" and name in JAVA_KEYWORDS)
        ]


def _indented_ends(levels: Sequence[int], starts: Sequence[int]) -> np.ndarray:
    """Last line with text before the next line that is not indented deeper; one pass with a stack of open blocks."""
    ends, deeper, last, following = np.empty(len(starts), dtype=np.int64), [], 0, 0
    for i, level in enumerate(levels):
        if level < 0:
            continue
        while deeper and levels[starts[deeper[-1]]] >= level:
            ends[deeper.pop()] = last
        if following < len(starts) and starts[following] == i:
            deeper.append(following)
            following += 1
        last = i + 1
    ends[deeper] = last
    return ends


def _braced_ends(levels: Sequence[int], starts: Sequence[int]) -> np.ndarray:
    """First line where every brace opened since the start is closed again, or the last; one pass with the blocks that
    wait for a brace (a heap by depth) and those that are open (a stack by depth)."""
    ends, waiting, opened, depth, following = np.full(len(starts), len(levels), dtype=np.int64), [], [], 0, 0
    for i, level in enumerate(levels):
        if following < len(starts) and starts[following] == i:
            heapq.heappush(waiting, (depth, following))
            following += 1
        depth += level
        while opened and opened[-1][0] >= depth:
            ends[opened.pop()[1]] = i + 1
        while waiting and waiting[0][0] < depth:
            opened.append(heapq.heappop(waiting))
    return ends


def _cut_out(text: str, language: str, own: bool, outlines: Outlines) -> list[dict]:
    """The definitions of one file in the order of their lines."""
    lines = text.split("\n")
    return [
        {
            "name": name, "kind": kind, "start_line": first, "end_line": last, "signature": lines[first - 1].strip(_SPACES),
            "body": "\n".join(lines[first - 1 : last]) if own else None,
        }
        for name, kind, first, last in outlines.of(lines, language)
    ]


_FOUND = "array<struct<name:string,kind:string,start_line:int,end_line:int,signature:string,body:string>>"
_FOUND_ARROW = pa.list_(pa.struct([
    ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()),
    ("signature", pa.string()), ("body", pa.string()),
]))


def _finder(own: bool) -> Callable[[Column, Column], Column]:
    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array, languages: pa.Array) -> pa.Array:
        rows, outlines = zip(texts.to_pylist(), languages.to_pylist()), Outlines()
        return pa.array([_cut_out(text or "", language, own, outlines) for text, language in rows], _FOUND_ARROW)

    return find


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """*df* with *columns*. They pass a generator, which keeps them from being repeated by every expression that
    reads them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


_CHANGED = [
    ("name", pa.string()), ("kind", pa.string()), ("change_type", pa.string()), ("place", pa.int32()), ("start_line", pa.int32()),
    ("end_line", pa.int32()), ("signature", pa.string()), ("body_hash", pa.string()), ("body_length", pa.int32()), ("body", pa.string()),
]
_CHANGED_SPARK = (
    "array<struct<name:string,kind:string,change_type:string,place:int,start_line:int,end_line:int,"
    "signature:string,body_hash:string,body_length:int,body:string>>"
)


def _sides(lines: list[str], language: str, outlines: Outlines) -> dict[tuple[str, str], tuple[int, int, int]]:
    """Of every (name, kind), where it stands first, and the lines of the last that has it."""
    found: dict[tuple[str, str], tuple[int, int, int]] = {}
    for name, kind, first, last in outlines.of(lines, language):
        known = found.get((name, kind))
        found[name, kind] = (known[0] if known else first, first, last)
    return found


def comparer(own: bool) -> Callable[[Column, Column, Column], Column]:
    """Added, deleted and modified definitions between two texts of a language; *own* adds the lines of those that
    were added or deleted."""
    @F.arrow_udf(_CHANGED_SPARK)
    def compare(befores: pa.Array, afters: pa.Array, languages: pa.Array) -> pa.Array:
        outlines, edges, rows = Outlines(), [0], []
        for before, after, language in zip(befores.to_pylist(), afters.to_pylist(), languages.to_pylist()):
            if before != after:
                olds, news = (before or "").split("\n"), (after or "").split("\n")
                gone, there = _sides(olds, language, outlines), _sides(news, language, outlines)
                for key, (place, first, last) in gone.items():
                    if key not in there:
                        rows.append((*key, "deleted", place, first, last, olds))
                for key, (place, first, last) in there.items():
                    old = gone.get(key)
                    if old is None:
                        rows.append((*key, "added", place, first, last, news))
                    elif old[1:] != (first, last) or olds[first - 1 : last] != news[first - 1 : last]:
                        rows.append((*key, "modified", place, first, last, news))
            edges.append(len(rows))
        bodies = ["\n".join(lines[first - 1 : last]) for *_, first, last, lines in rows]
        columns = [
            *[[row[i] for row in rows] for i in range(6)],
            [lines[first - 1].strip(_SPACES) for *_, first, last, lines in rows],
            [sha256(body.encode()).hexdigest() for body in bodies],
            [len(body) for body in bodies],
            [body if own and row[2] != "modified" else None for row, body in zip(rows, bodies)],
        ]
        fields = [pa.array(column, kind) for column, (_, kind) in zip(columns, _CHANGED)]
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, [name for name, _ in _CHANGED]))

    return compare


def with_definitions(files: DataFrame, texts: list[str], body: bool = False, text: bool = False) -> DataFrame:
    """*files* with an array column ``<text>_defs`` for every text column, without those columns; files in no
    known language are left out.

    A definition is a struct of name, kind, start_line, end_line and signature; with *body* also body_hash and
    body_length of its lines, with *text* the lines themselves. Everything is computed inside the row.
    """
    kept = [c for c in files.columns if c not in texts and c != "language"]
    source = files.withColumn("language", paths.language_of(F.col("file_path"))).filter("language IS NOT NULL")
    find = _finder(body or text)
    located = source.withColumns({f"{c}_found": find(F.col(c), F.col("language")) for c in texts})

    def described(d: Column) -> Column:
        parts = [d[f].alias(f) for f in ("name", "kind", "start_line", "end_line", "signature")]
        if body:
            parts += [F.sha2(d["body"], 256).alias("body_hash"), F.length(d["body"]).alias("body_length")]
        return F.struct(*parts, *([d["body"].alias("body")] if text else []))

    described_columns = {f"{c}_defs": F.transform(f"{c}_found", described) for c in texts}
    return once(located.select(*kept, "language", *[f"{c}_found" for c in texts]), described_columns).select(
        *kept, "language", *described_columns
    )


def parse(files: DataFrame, keys: list[str], content: str, with_body: bool = False) -> DataFrame:
    """One row per definition of *content*: *keys*, language, name, kind, lines, signature.

    *with_body* adds ``body_hash`` and ``body_length`` of the definition's lines.
    """
    source = files.select(*keys, F.col(content).alias("content"))
    return with_definitions(source, ["content"], with_body).select(*keys, "language", F.inline("content_defs"))


def head_functions(h: History) -> DataFrame:
    """The ``functions`` table: definitions in the files at HEAD."""
    parsed = parse(h.head_files.drop("language"), ["file_path"], "content")
    # two definitions with one key can only come from one line, so nothing is replaced here
    return parsed.select(
        "name", "file_path", "language", "start_line", "end_line", "kind", "signature",
        F.lit("").alias("docstring"),
    )
