"""Language identification by cross-parsing entropy.

Per language a suffix automaton holds labelled text. A word, between two spaces, is parsed against it into
longest matches: the phrases. The language whose automaton needs the fewest phrases for a text, each
weighed by the bits that name a place in the labelled text, explains it best.

Words are parsed once and remembered, so the work follows the vocabulary. A letter that the language never
shows is a phrase of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import text_chunks

#: Training reads at most so many documents of a language, and so many characters of their texts.
DOCS, CHARS = 200, 60_000
REMEMBERED = 200_000
LONGEST = 64  # letters of words that are remembered
FOLDS = 5
LETTERS = re.compile(r"[^\W\d_]+")


class Automaton:
    """The suffix automaton of a text, as one table from (state, letter) to state."""

    def __init__(self, text: str):
        follow: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for letter in map(ord, text):
            state = len(length)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at != -1 and letter not in follow[at]:
                follow[at][letter] = state
                at = link[at]
            if at != -1:
                target = follow[at][letter]
                if length[at] + 1 == length[target]:
                    link[state] = target
                else:
                    copy = len(length)
                    follow.append(dict(follow[target]))
                    length.append(length[at] + 1)
                    link.append(link[target])
                    while at != -1 and follow[at].get(letter) == target:
                        follow[at][letter] = copy
                        at = link[at]
                    link[target] = link[state] = copy
            last = state
        self.step = {(state << 21) | letter: to for state, moves in enumerate(follow) for letter, to in moves.items()}
        self.bits = math.log2(len(text) + 2)

    def phrases(self, text: str) -> int:
        """How many longest matches, one after the other, make up *text*."""
        step, count, state = self.step.get, 0, 0
        for letter in map(ord, text):
            to = step((state << 21) | letter)
            if to is None:
                count += state != 0
                to = step(letter)
                if to is None:
                    count += 1
                    to = 0
            state = to
        return count + (state != 0)


def normal(text: str) -> list[str]:
    """The runs of letters of *text*, in lower case."""
    return LETTERS.findall(text.lower())


class Model:
    """Automata of all languages, and the words parsed so far."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.automata = [Automaton(texts[n]) for n in self.names]
        self.bits = np.array([a.bits for a in self.automata])
        self.known: dict[str, int] = {}
        self.counts = np.zeros((REMEMBERED, len(self.names)), dtype=np.int32)

    def _parse(self, word: str) -> list[int]:
        return [a.phrases(f" {word} ") for a in self.automata]

    def cost(self, words: list[str]) -> np.ndarray:
        """Phrases of *words* by language."""
        total = np.zeros(len(self.names), dtype=np.int64)
        known = self.known
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            for word in {w for w in part if len(w) > LONGEST}:
                total += np.array(self._parse(word)) * part.count(word)
            part = [w for w in part if len(w) <= LONGEST]
            if len(known) + len(part) > REMEMBERED:
                known.clear()
            for word in set(part).difference(known):
                known[word] = len(known)
                self.counts[known[word]] = self._parse(word)
            total += self.counts[[known[w] for w in part]].sum(axis=0)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): how much the best language saves over the next, from 0 to 1."""
        words = normal(text or "")
        if not words or not self.names:
            return "und", 0.0
        bits = self.cost(words) * self.bits
        order = np.argsort(bits, kind="stable")
        if len(order) == 1:
            return self.names[0], 1.0
        return self.names[order[0]], float(1 - bits[order[0]] / bits[order[1]])


def held_out(column):
    """The fold of a document that training never reads."""
    return F.coalesce(F.crc32(column.cast("string")) % FOLDS == 0, F.lit(False))


def labelled(docs: DataFrame, most_docs: int = DOCS, most_chars: int = CHARS) -> dict[str, str]:
    """Normal text of each language, from at most *most_docs* documents in hash order and at most *most_chars*
    characters of it."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    key = F.md5(F.concat(F.lit("language:"), F.col("doc_id").cast("string")))
    first = Window.partitionBy("lang").orderBy("key", "doc_id")
    chosen = (
        known.select("doc_id", "lang", key.alias("key")).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most_docs)
        .select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("of"), "place")
    )

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, last_row, _, _ in text_chunks(batch["text"]):
                part = batch.slice(first_row, last_row - first_row)
                text = [" ".join(normal(t))[:most_chars] for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["lang"], part["place"], pa.array(text, pa.string())], ["lang", "place", "text"])

    rows = (
        known.select("doc_id", "lang", "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("chosen_id")) & (F.col("lang") == F.col("of")))
        .select("lang", "place", "text").mapInArrow(shorten, "lang string, place int, text string")
    )
    inside = Window.partitionBy("lang").orderBy("place", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(inside), F.lit(0))).filter(F.col("before") < most_chars)
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in rows.select("lang", "place", "text").collect():
        texts.setdefault(row["lang"], []).append((row["place"], row["text"]))
    return {lang: (" " + " ".join(t for _, t in sorted(parts)))[:most_chars] + " " for lang, parts in texts.items()}


_models: dict[str, Model] = {}


def languages(docs: DataFrame, most_docs: int = DOCS, most_chars: int = CHARS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of *docs*, from its text alone.

    Training reads rows with lang, text and doc_id whose crc32 leaves a remainder. NULL texts and texts without
    a letter are ``und``, and so is everything where nothing is labelled; rows without doc_id are predicted
    and count as not held out. Languages with equal cost go to the first name. Repeated rows are predicted each,
    an empty table gives an empty result, other columns are ignored.
    """
    learned = labelled(docs, most_docs, most_chars)
    name = hashlib.sha256(repr(sorted(learned.items())).encode()).hexdigest()
    texts = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models.clear()
            _models[name] = Model(texts.value)
        model = _models[name]
        for batch in batches:
            for first, last, _, _ in text_chunks(batch["text"]):
                part = batch.slice(first, last - first)
                found = [model.predict(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {key}, held_out boolean, lang_pred string, score double"
    )
