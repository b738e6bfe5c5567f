"""Token ids packed into sequences by a best-fit plan over the histogram of lengths.

Best-fit-decreasing needs only how many pieces there are of every length, at most as many numbers as a
sequence has tokens, so the plan is made from counts: all pieces of one length go into the tightest class of
sequences that holds them, and a class is a range of sequences with equal room. A step of the plan is one row
(so many pieces of a length into so many sequences, at an offset); how many rows there are depends on the
lengths, not on the documents. Spark deals the rows out into slots, and pieces take slots by joining on
their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import staged, text_chunks
from annalist.llm.transducer import byte_names
from annalist.session import cut

VOCABULARY = "word_bpe_49k.json"
LENGTH = 4096
END = 1  # the id behind every document
SEGMENT = 1 << 20  # bytes of a text that are split into words at once
WORDS = 250_000  # remembered words of a generation, each of at most LONG bytes
LONG = 64
SLOTS = 1 << 16  # slots that one row of the plan becomes at once
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
# The pieces of the vocabulary's file, in lower case and for the signs of PLAIN.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

_RUN = "length bigint, rank bigint, n bigint, sequence bigint, each bigint, at bigint"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Remembered:
    """A bounded memory of bytes in two generations: what is asked for again outlives the rest."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key) -> bytes | None:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value: bytes) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """Ids of whole texts by the tokenizer library, word by word.

    The tokenizer drops white space and no piece, normal form or special token of it reaches over one of the
    six ASCII blanks, so the ids of a text are those of its words one after the other. Words of ASCII signs and
    Latin-1 letters have no normal form but lower case; their pieces go to the library's model at once. All
    other words, and those that may hold a special token, go through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.byte = dict(enumerate(byte_names()))
        self.words, self.pieces = Remembered(WORDS), Remembered(WORDS)

    def _piece(self, piece: str) -> bytes:
        raw = self.pieces.get(piece)
        if raw is None:
            shown = piece if piece.isascii() else "".join(map(self.byte.__getitem__, piece.encode()))
            raw = _raw([token.id for token in self.model.tokenize(shown)])
            if len(piece) <= LONG:
                self.pieces.put(piece, raw)
        return raw

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if PLAIN.fullmatch(text) and "<|" not in text:
            raw = b"".join(map(self._piece, PIECE.findall(text.lower())))
        else:
            raw = _raw(self.library.encode(text, add_special_tokens=False).ids)
        if len(word) <= LONG:
            self.words.put(word, raw)
        return raw

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of UTF-8 *text*."""
        out, at = [], 0
        while at < len(text):
            end = at + SEGMENT
            if end < len(text):
                blank = _BLANK.search(text, end)
                end = blank.start() if blank else len(text)
            words = text[at:end].split()
            parts = list(map(self.words.young.get, words))
            if None in parts:
                for i, word in enumerate(words):
                    if parts[i] is None:
                        known = self.words.get(word)
                        parts[i] = self._word(word) if known is None else known
            out.append(b"".join(parts))
            at = end
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    encoder = _encoders[path]
    part, counts = TaskContext.get().partitionId(), [0] * (length + 1)
    end = _raw([END])
    for batch in batches:
        for first, last, data, offsets in text_chunks(batch["text"]):
            raw = data.tobytes()
            rows, nths, numbers, blobs = [], [], [], []
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist()), first):
                ids = encoder.encode(raw[a:b]) + end
                for number in range(-(-len(ids) // (4 * length))):
                    blob = ids[4 * length * number : 4 * length * (number + 1)]
                    rows.append(i)
                    numbers.append(number)
                    nths.append(counts[len(blob) // 4])
                    counts[len(blob) // 4] += 1
                    blobs.append(blob)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()),
                 pa.array([length * n for n in numbers], pa.int64()), pa.array([len(b) // 4 for b in blobs], pa.int64()),
                 pa.array(blobs, pa.binary()), pa.array([part] * len(rows), pa.int64()), pa.array(nths, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids", "part", "nth"],
            )


def pieces(docs: DataFrame, path: str, length: int) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row, and its place: the ``nth`` piece of its length in ``part``."""
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start bigint, length bigint, ids binary, part bigint, nth bigint"
    return docs.select("doc_id", "text").mapInArrow(partial(_pieces, path, length), schema)


def plan(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over counts of lengths: rows (length, rank, n, sequence, each, at).

    From *rank* on, *n* pieces of *length* go to consecutive sequences from *sequence* on, *each* of them in one
    sequence, the first of a sequence at offset *at*. A sequence that takes a piece is again the tightest for
    the next of this length as long as it has room, so a whole class of equal room can be filled at once.
    """
    classes: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    rows, fresh = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in classes:
                classes[room] = []
                insort(rooms, room)
            classes[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            place = bisect_left(rooms, length)
            if place == len(rooms):
                room, first, n = most, fresh, -(-left // (most // length))
                fresh += n
            else:
                room = rooms[place]
                first, n = classes[room].pop()
                if not classes[room]:
                    del classes[room]
                    rooms.pop(place)
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full * each, first, each, most - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if full < n and left:
                rows.append((length, rank, left, first + full, left, most - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return rows


def slots(runs: DataFrame) -> DataFrame:
    """(length, rank, sequence_id, offset): every slot of a plan, made where it is needed."""
    i = F.col("i")
    return (
        runs.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {SLOTS})")))
        .repartition("length", "rank", "chunk")
        .withColumn("i", F.explode(F.expr(f"sequence(chunk * {SLOTS}, least(n, (chunk + 1) * {SLOTS}) - 1)")))
        .select(
            "length", (F.col("rank") + i).alias("rank"), (F.col("sequence") + F.expr("i div each")).alias("sequence_id"),
            (F.col("at") + i % F.col("each") * F.col("length")).alias("offset"),
        )
    )


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, ids: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Every piece of *docs* with its place: doc_id, piece, start, length, ids or what the function *ids* makes of
    them, sequence_id, offset.

    A document is its ids and the id 1; one of more than *length* ids is cut into pieces of *length*, the last
    one shorter. ``ids`` are little-endian 32-bit numbers. A sequence has no gap and at most *length* ids, and
    there are as many sequences as best-fit-decreasing over all pieces needs.

    NULL and empty texts are the id 1 alone; repeated rows, rows of one doc_id and rows without one are
    packed each; doc_id keeps its type; a very long text is read in segments, its ids are held at once; an
    empty table gives an empty result; other columns are ignored. The file at *path* must exist on every executor.
    """
    path = path or vocabulary_path()
    found = staged(pieces(docs, path, length).withColumn("ids", ids(F.col("ids"))), "fitplan-pieces")
    here = cut(found.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in here.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = docs.sparkSession.createDataFrame(plan(counts, length), _RUN)
    # one row a task and length, so the running sum over tasks stays small
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = here.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = ["part", "length", "nth"]
    taken = (
        found.select(*place).join(base, ["part", "length"])
        .select(*place, (F.col("base") + F.col("nth")).alias("rank"))
        .join(slots(runs), ["length", "rank"])
        .select(*place, "sequence_id", "offset")
    )
    return found.join(taken, place).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, cu_seqlens, doc_ids, pieces, ids): what a trainer reads, one row a sequence."""
    segment = F.struct("offset", "length", "doc_id", "piece", "ids")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(segment)).alias("s")).select(
        "sequence_id",
        F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["length"]).alias("n_tokens"),
        F.concat(F.col("s.offset"), F.array(F.element_at("s", -1)["offset"] + F.element_at("s", -1)["length"])).alias("cu_seqlens"),
        F.col("s.doc_id").alias("doc_ids"), F.col("s.piece").alias("pieces"),
        F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )
