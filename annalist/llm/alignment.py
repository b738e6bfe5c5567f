"""Token alignment of two vocabularies: where their tokens end together, and how usual each pair of ids is.

Both tokenizers read the same bytes. Offsets at which a token of either ends cut the tokens into groups, and
the two tokens that end there are linked. How often a pair of ids is linked in the whole corpus is counted
outside of memory:

* tasks write records (pair, document, times), dealt by radix of the B id, as sorted runs compressed by zstd;
* units of runs, bounded in records, are merged with a heap over the next pair of each run, which counts every
  pair; counts of units are summed, so an id that holds most records is split over many units;
* runs and counts share one order, B id first. In that order the counts of an id stand together, which gives
  its highest, and a second merge of the same runs sends counts back to the documents of each record.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import mix, staged, text_chunks
from annalist.llm.transducer import byte_names
from annalist.session import cut

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
RADIX = 16  # parts of the B ids
RUN_RECORDS = 1 << 20  # records a task holds before it writes runs
UNIT_RECORDS = 1 << 21  # records that are merged at once
WORDS = 400_000  # remembered words of a worker, and their characters
CHARACTERS = 1 << 23

#: A blank between two visible characters. No token of A goes on behind such a blank, no piece of B holds a
#: blank behind another sign, and B puts the same blank before a text. So texts may be cut there.
CUT = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
_LOW = np.uint64(0xFFFFFFFF)
_UP = np.uint64(32)

_UNIT = "radix int, b bigint, a bigint, n bigint"
_SENT = "key bigint, n_best bigint, count_sum bigint"


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES)


class Aligner:
    """The groups of words, remembered in columns: word number i has ``n_a[i]`` tokens and so on."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte = {name: value for value, name in enumerate(byte_names())}
        self.bytes_a = {i: bytes(byte[c] for c in piece) for piece, i in vocabulary.items() if all(c in byte for c in piece)}
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.b.get_piece_size())
        ]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.characters = 0
        self.n_a, self.n_b, self.n_groups = array("q"), array("q"), array("q")
        self.groups: list[str] = []
        self.starts, self.codes = array("q", [0]), array("Q")

    def aligned(self, text: str, a: list[int], b: list[int]) -> tuple[str, list[int]] | None:
        """(groups, codes of linked pairs) of the tokens of *text*; None if they do not give its bytes."""
        whole = b" " + text.encode()
        part_a, part_b = [self.bytes_a.get(i, b"") for i in a], [self.bytes_b[i] for i in b]
        if b"".join(part_a) != whole or b"".join(part_b) != whole:
            return None
        groups, codes = [], []
        i = j = from_a = from_b = 0
        end_a, end_b = len(part_a[0]), len(part_b[0])
        while True:
            if end_a == end_b:
                groups.append(f"{','.join(map(str, a[from_a : i + 1]))}|{','.join(map(str, b[from_b : j + 1]))}")
                codes.append(b[j] << 32 | a[i])
                i, j = i + 1, j + 1
                if i == len(a):
                    return ";".join(groups), codes
                from_a, from_b = i, j
                end_a, end_b = end_a + len(part_a[i]), end_b + len(part_b[j])
            elif end_a < end_b:
                i += 1
                end_a += len(part_a[i])
            else:
                j += 1
                end_b += len(part_b[j])

    def learn(self, words: list[str]) -> None:
        """Remember *words*; one that cannot be aligned has no group."""
        tokens_a = self.a.encode_batch([" " + w for w in words], add_special_tokens=False)
        for word, a, b in zip(words, tokens_a, self.b.encode(words, num_threads=1)):
            a = a.ids
            groups, codes = self.aligned(word, a, b) or ("", [])
            self.number[word] = len(self.groups)
            self.characters += len(word)
            self.n_a.append(len(a))
            self.n_b.append(len(b))
            self.n_groups.append(len(codes))
            self.groups.append(groups)
            self.codes.extend(codes)
            self.starts.append(len(self.codes))

    def whole(self, text: str) -> tuple[int, int, str, list[int]] | None:
        """(tokens of A, tokens of B, groups, codes) of a text that was not cut into words."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        found = self.aligned(text, a, b)
        return found and (len(a), len(b), *found)

    def texts(self, texts: list[str]) -> tuple[list[tuple[int, int, int, str]], np.ndarray, np.ndarray, np.ndarray]:
        """Facts (n_a, n_b, n_groups, groups) of every text, and records (code, text, times)."""
        if len(self.groups) > WORDS or self.characters > CHARACTERS:
            self.clear()
        number = self.number
        split = [CUT.split(t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in number))
        if new:
            self.learn(new)
        numbers = [np.fromiter((number[w] for w in words), np.int64, len(words)) for words in split]
        n_a, n_b, n_groups = (np.frombuffer(x, np.int64) if len(x) else np.empty(0, np.int64) for x in (self.n_a, self.n_b, self.n_groups))
        facts, odd = [], []
        for at, found in enumerate(numbers):
            links = n_groups[found]
            if len(found) and not links.all():
                odd.append(at)
                facts.append((0, 0, 0, ""))
            else:
                facts.append((int(n_a[found].sum()), int(n_b[found].sum()), int(links.sum()), ";".join([self.groups[i] for i in found.tolist()])))
        kept = np.ones(len(texts), dtype=bool)
        kept[odd] = False
        which = np.repeat(np.arange(len(texts)), [len(x) for x in numbers])
        word = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        word, which = word[kept[which]], which[kept[which]]
        seen, times = np.unique(which * len(self.groups) + word, return_counts=True)
        which, word = np.divmod(seen, max(1, len(self.groups)))
        starts, codes = np.frombuffer(self.starts, np.int64), np.frombuffer(self.codes, np.uint64) if len(self.codes) else np.empty(0, np.uint64)
        size = n_groups[word]
        place = np.repeat(starts[word] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        columns = [[codes[place]], [np.repeat(which, size)], [np.repeat(times, size)]]
        for at in odd:
            found = self.whole(texts[at])
            if found:
                facts[at] = (found[0], found[1], len(found[3]), found[2])
                for column, values in zip(columns, (np.array(found[3], np.uint64), np.full(len(found[3]), at), np.ones(len(found[3]), np.int64))):
                    column.append(values)
        return facts, *(np.concatenate(c) for c in columns)


def radix_of(codes: np.ndarray) -> np.ndarray:
    return (mix(codes >> _UP) % np.uint64(RADIX)).astype(np.int32)


def runs(codes: np.ndarray, keys: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(radix, records, run) of sorted records: pairs, how many documents each has, those and times."""
    radix = radix_of(codes)
    order = np.lexsort((keys, codes, radix))
    codes, keys, times, radix = codes[order], keys[order], times[order], radix[order]
    first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (keys[1:] != keys[:-1])]))
    codes, keys, radix, times = codes[first], keys[first], radix[first], np.add.reduceat(times, first)
    bounds = np.flatnonzero(np.concatenate([[True], radix[1:] != radix[:-1], [True]]))
    press = zstandard.ZstdCompressor(level=3)
    for start, end in zip(bounds, bounds[1:]):
        pairs, sizes = np.unique(codes[start:end], return_counts=True)
        raw = b"".join([
            np.array([len(pairs), end - start], "<u8").tobytes(), pairs.astype("<u8").tobytes(), sizes.astype("<u4").tobytes(),
            np.diff(keys[start:end], prepend=0).astype("<i8").tobytes(), times[start:end].astype("<u4").tobytes(),
        ])
        yield int(radix[start]), int(end - start), press.compress(raw)


def unpacked(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, first record of each, documents, times) of a run."""
    raw = zstandard.ZstdDecompressor().decompress(run)
    n, records = np.frombuffer(raw, "<u8", 2).tolist()
    pairs, sizes = np.frombuffer(raw, "<u8", n, 16), np.frombuffer(raw, "<u4", n, 16 + 8 * n)
    keys = np.cumsum(np.frombuffer(raw, "<i8", records, 16 + 12 * n))
    return pairs, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), keys, np.frombuffer(raw, "<u4", records, 16 + 12 * n + 8 * records).astype(np.int64)


def merged(lists: list[list[int]]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Every pair once, in order, with the (run, place) it has in each sorted list that holds it."""
    heap = [(pairs[0], i, 0) for i, pairs in enumerate(lists) if pairs]
    heapq.heapify(heap)
    while heap:
        pair, places = heap[0][0], []
        while heap and heap[0][0] == pair:
            _, i, at = heap[0]
            places.append((i, at))
            if at + 1 < len(lists[i]):
                heapq.heapreplace(heap, (lists[i][at + 1], i, at + 1))
            else:
                heapq.heappop(heap)
        yield pair, places


def _counted(table: pa.Table) -> pa.Table:
    """How often the runs of one unit hold each pair."""
    lists, totals = [], []
    for run in table["run"]:
        pairs, starts, _, times = unpacked(run.as_py())
        lists.append(pairs.tolist())
        totals.append(np.add.reduceat(times, starts[:-1]).tolist())
    pairs, counts = [], []
    for pair, places in merged(lists):
        pairs.append(pair)
        counts.append(sum(totals[i][at] for i, at in places))
    codes = np.array(pairs, np.uint64)
    return pa.table({
        "radix": pa.array(np.full(len(codes), table["radix"][0].as_py()), pa.int32()), "b": pa.array((codes >> _UP).astype(np.int64)),
        "a": pa.array((codes & _LOW).astype(np.int64)), "n": pa.array(counts, pa.int64()),
    })


def _sent(units: pa.Table, counts: pa.Table) -> pa.Table:
    """What each document of a unit gets: links whose pair has the highest count of its B id, and counts."""
    counts = counts.sort_by([("b", "ascending"), ("a", "ascending")])
    b, n = counts["b"].to_numpy(), counts["n"].to_numpy()
    codes = (b.astype(np.uint64) << _UP) | counts["a"].to_numpy().astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.empty(0, np.int64)
    highest = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(b)))) if len(b) else n
    facts = zip(codes.tolist(), n.tolist(), (n == highest).tolist())
    opened = [unpacked(run.as_py()) for run in units["run"]]
    count_of = [np.zeros(len(r[0]), np.int64) for r in opened]
    best_of = [np.zeros(len(r[0]), np.int64) for r in opened]
    code = count = best = None
    for pair, places in merged([r[0].tolist() for r in opened]):
        while code != pair:
            code, count, best = next(facts)
        for i, at in places:
            count_of[i][at], best_of[i][at] = count, best
    keys, bests, sums = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for (_, starts, docs, times), counted, best_pairs in zip(opened, count_of, best_of):
        size = np.diff(starts)
        found, at = np.unique(docs, return_inverse=True)
        total = np.zeros((2, len(found)), np.int64)
        np.add.at(total[0], at, np.repeat(best_pairs, size) * times)
        np.add.at(total[1], at, np.repeat(counted, size) * times)
        keys.append(found)
        bests.append(total[0])
        sums.append(total[1])
    return pa.table({"key": np.concatenate(keys), "n_best": np.concatenate(bests), "count_sum": np.concatenate(sums)})


_aligners: dict[tuple[str, str], Aligner] = {}


def _parsed(paths: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    aligner, key, held, waiting = _aligners[paths], TaskContext.get().partitionId() << 40, [], 0
    names = ["doc_id", "key", "n_a", "n_b", "n_groups", "groups", "radix", "n", "run"]
    kinds = [None, *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int64(), pa.binary()]
    kind = None

    def flushed() -> pa.RecordBatch:
        found = list(runs(*(np.concatenate(c) for c in zip(*held))))
        empty = [pa.nulls(len(found), kind), *(pa.nulls(len(found), t) for t in kinds[1:6])]
        return pa.RecordBatch.from_arrays(empty + [pa.array(c, t) for c, t in zip(zip(*found), kinds[6:])], names)

    for batch in batches:
        kind = batch["doc_id"].type
        for first, last, _, _ in text_chunks(batch["text"]):
            part = batch.slice(first, last - first)
            facts, codes, which, times = aligner.texts(part["text"].to_pylist())
            size = len(facts)
            columns = [part["doc_id"], pa.array(key + np.arange(size)), *(pa.array(c, t) for c, t in zip(zip(*facts), kinds[2:6]))]
            yield pa.RecordBatch.from_arrays(columns + [pa.nulls(size, t) for t in kinds[6:]], names)
            if len(codes):
                held.append((codes, which + key, times))
                waiting += len(codes)
            key += size
            if waiting >= RUN_RECORDS:
                yield flushed()
                held, waiting = [], 0
    if held:
        yield flushed()


def align(docs: DataFrame, paths: tuple[str, str] | None = None, groups: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """For every row of *docs*: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups as text,
    ``a1,a2|b1;a3|b2,b3``, or what the function *groups* makes of that text.

    A is a byte-level file of the tokenizers library that reads a blank and the text, B a sentencepiece model
    that reads the text. Links are counted over all rows; n_best counts the links of a row whose pair is the
    most frequent of its B id, ties included, count_sum adds up the counts of its links.

    NULL and empty texts, and texts whose tokens do not give back their bytes, have zeros and empty groups;
    repeated rows count each; doc_id may be NULL or repeat and keeps its type; memory follows the longest
    text; an empty table gives an empty result; other columns are ignored. Both files must exist on every
    executor.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, key bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, radix int, n bigint, run binary"
    parsed = docs.select("doc_id", "text").mapInArrow(partial(_parsed, paths or vocabulary_paths()), schema)
    found = staged(parsed.withColumn("groups", groups(F.col("groups"))), "alignment")
    spilled = found.filter("radix IS NOT NULL").select("radix", "n", "run")
    # at most RADIX rows
    widths = cut(spilled.groupBy("radix").agg(F.ceil(F.sum("n") / UNIT_RECORDS).alias("units")))
    units = spilled.join(F.broadcast(widths), "radix").select("radix", F.pmod(F.xxhash64("run"), "units").alias("unit"), "run")
    counts = cut(units.groupBy("radix", "unit").applyInArrow(_counted, _UNIT).groupBy("radix", "b", "a").agg(F.sum("n").alias("n")))
    every = counts.join(F.broadcast(widths), "radix").select("radix", F.explode(F.expr("sequence(0L, units - 1)")).alias("unit"), "b", "a", "n")
    place = ["radix", "unit"]
    sent = units.groupBy(*place).cogroup(every.groupBy(*place)).applyInArrow(_sent, _SENT)
    sums = sent.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return found.filter("radix IS NULL").join(sums, "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups",
    )
