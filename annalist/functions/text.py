"""Text matching, identifier splitting, tokenizing and the texts built for embedding."""

from __future__ import annotations

import string
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- matching -------------------------------------------------------------


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _ascii_lower(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def like(text: Column, pattern: str) -> Column:
    """LIKE that ignores ASCII case only; ``%`` and ``_`` are wildcards, nothing escapes them."""
    return ascii_lower(text).like(_ascii_lower(pattern).replace("\\", "\\\\"))


def contains(text: Column, needle: str) -> Column:
    """Substring filter; wildcards inside *needle* stay wildcards."""
    return like(text, f"%{needle}%")


def message_matches(message: Column, pattern: str) -> Column:
    """Regex search if the pattern looks like a regex, else a substring filter."""
    if any(mark in pattern for mark in "|([\\"):
        return F.coalesce(message, F.lit("")).rlike(pattern)
    return contains(message, pattern)


# ---- truncation -----------------------------------------------------------


def short_hash(commit_hash: Column) -> Column:
    return F.substring(commit_hash, 1, 8)


def first_line(message: Column, length: int = 120) -> Column:
    return F.substring(F.substring_index(message, "\n", 1), 1, length)


# ---- identifiers ----------------------------------------------------------


# Where a part ends inside a token: at a hump, after an acronym, at a digit.
_HUMP = r"[a-z][A-Z]|[A-Z]{2}[a-z]|(?U:[a-zA-Z]\d|\d[a-zA-Z])"


def _words(token: Column) -> Column:
    # The four places where a token is split, in this order.
    spaced = F.regexp_replace(token, r"([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([a-zA-Z])((?U)\d)", "$1 $2")
    return F.regexp_replace(spaced, r"((?U)\d)([a-zA-Z])", "$1 $2")


def _parts(token: Column) -> Column:
    """The token, its CamelCase and digit parts, and its snake parts, '' among them."""
    none = F.array().cast("array<string>")
    humps = F.split(F.lower(_words(token)), " ")
    snakes = F.split(F.lower(token), "_")
    return F.concat(
        F.array(token),
        F.when(token.rlike(_HUMP), humps).otherwise(none),
        F.when(F.contains(token, F.lit("_")), snakes).otherwise(none),
    )


def split_identifiers(text: Column) -> Column:
    """The text, followed by its identifiers and their CamelCase, digit and snake parts."""
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z_](?U:\w)*"), 0)
    extra = F.sort_array(
        F.array_except(F.flatten(F.transform(tokens, _parts)), F.array(text, F.lit("")))
    )
    return F.array_join(F.concat(F.array(text), extra), " ")


# ---- search tokens --------------------------------------------------------


@cache
def _folding() -> tuple[str, str]:
    """Letters with exactly one diacritic, and the letters under them (by Unicode rule)."""
    marked, plain = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and unicodedata.combining(parts[1]) and parts[0].isalpha():
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without diacritics; bare combining marks vanish."""
    marked, plain = _folding()
    bare = F.regexp_replace(F.translate(F.lower(text), marked, plain), r"[\u0300-\u036f]", "")
    return F.when(text.rlike(r"\P{ASCII}"), bare).otherwise(F.lower(text))


# A token is a run of letters and digits; everything else, "_" included, separates.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def folded_tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(TOKEN), 0)


def search_tokens(text: Column) -> Column:
    return folded_tokens(fold(F.coalesce(text, F.lit(""))))


# ---- query class ----------------------------------------------------------

# Patterns of queries that look like code, and of plain questions.
TECHNICAL = [
    r"[A-Z][a-z]+[A-Z]",
    r"[a-z]+_[a-z]+",
    r"[A-Z]{2,}",
    r"(?U)\w+\.\w+",
    r"(?U)\w+\(\)",
    r"(?U)\*\.\w+",
]
CONCEPTUAL = [
    r"(?iU)\b(?:how|what|where|when|why|which)\b",
    r"(?iU)\b(?:does|is|are|was|were|can|should)\b",
    r"(?iU)\b(?:architecture|design|pattern|flow|process)\b",
    r"(?iU)\b(?:management|handling|processing|streaming)\b",
]


def _hits(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in patterns])


def query_weights(query: Column) -> Column:
    """``struct<keyword, semantic>``: weights that sum to 1, each at least 0.15."""
    tokens = F.regexp_extract_all(query, F.lit(r"(?U)\S+"), 0)
    one = F.try_element_at(tokens, F.lit(1))
    identifier = (F.size(tokens) == 1) & one.rlike(r"^[A-Za-z_](?U:\w)*$")
    coded = one.rlike(r"^.+\p{Lu}") | F.contains(one, F.lit("_"))
    technical = _hits(query, TECHNICAL) + F.when(identifier & coded, 3).otherwise(0)
    conceptual = (
        _hits(query, CONCEPTUAL)
        + F.when(identifier & ~coded, 1).otherwise(0)
        + F.when((F.size(tokens) >= 3) & (technical == 0), 2).otherwise(0)
    )
    total = technical + conceptual
    share = F.greatest(F.lit(0.15), F.least(F.lit(0.85), technical / total))
    keyword = F.when(total == 0, F.lit(0.5)).otherwise(share)
    return F.struct(keyword.alias("keyword"), (F.lit(1.0) - keyword).alias("semantic"))


# ---- commit themes --------------------------------------------------------

# Opening words of a commit message by theme, tried in this order.
THEMES = {
    "fix": r"fix|bug|patch|hotfix|resolve",
    "feature": r"add|implement|create|new|introduce|enable",
    "refactor": r"refactor|split|modular|reorgan|restructur|consolidat|clean",
    "docs": r"doc|readme|changelog|comment|update.*doc",
    "test": r"test|spec|assert|coverage",
    "config": r"config|setup|deploy|ci|build|version|bump",
    "remove": r"remove|delete|deprecate|drop",
}


def commit_theme(message: Column) -> Column:
    text = F.regexp_replace(F.coalesce(message, F.lit("")), r"^(?U)\s+", "")
    branches = [(text.rlike(f"(?id)^(?:{words})"), theme) for theme, words in THEMES.items()]
    head, *tail = branches
    column = F.when(*head)
    for condition, theme in tail:
        column = column.when(condition, theme)
    return column.otherwise("other")


# ---- embedding texts ------------------------------------------------------

# The labels and the order of lines in both texts below.

def _optional(label: str, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.concat(F.lit(label), value))


def function_text(
    name: Column, kind: Column, file_path: Column, signature: Column, docstring: Column
) -> Column:
    keywords = split_identifiers(name)
    return F.concat_ws(
        "\n",
        F.concat(name, F.lit(" — "), kind, F.lit(" in "), file_path),
        _optional("Signature: ", signature),
        _optional("Docstring: ", docstring),
        F.when(keywords != name, F.concat(F.lit("Keywords: "), keywords)),
    )


def commit_text(message: Column, files_changed: Column, author: Column) -> Column:
    return F.concat_ws(
        "\n",
        message,
        F.concat(F.lit("Files changed: "), files_changed.cast("string")),
        F.concat(F.lit("Author: "), author),
    )
