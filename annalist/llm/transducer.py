"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as a state machine.

Merging is local: a boundary between two tokens can only be undone from the right by a chain of merges
of falling precedence, each of which needs the one after it. :func:`lookahead` measures the longest such
chain in the merge list. Once that many symbols stand to the right of a token, nothing that follows can
change it, so it is emitted and forgotten. A word of any length is encoded in constant memory.

The vocabulary is a public tokenizer file whose path is a parameter: byte-level BPE with word ends, text
brought to NFC, white space to single spaces, letters to lower case character by character. Which code
points are letters is the ``regex`` module's view; code points that are newer than the tokenizer's tables
may therefore be cut differently.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from annalist.llm.common import text_chunks

VOCABULARY = "word_bpe_49k.json"
WORD_END = "</w>"
#: The pre-tokenizer pattern, and white space as the tokenizer's regular expressions see it.
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{BLANKS}\p{{L}}\p{{N}}]+"
BUFFER = 512
CACHED = 300_000


def vocabulary_path() -> str:
    """The place of the vocabulary file where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_names() -> list[str]:
    """The visible character that stands for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]]) -> int:
    """How many symbols to the right decide whether a token is final.

    Let two texts differ only beyond a frontier. The first merge that acts differently joins a symbol left
    of the frontier with one beyond it; the frontier moves left by that symbol. The next, later in the list,
    must end in a symbol that begins with the one just lost. The longest way the frontier can move is the
    sum of the left parts along such a chain, found in one pass over the merges in order.
    """
    parts: dict[str, tuple[str, str]] = {}
    reach: dict[str, int] = {}  # by left part: the longest chain so far that ends with it lost
    most = 1
    for left, right in merges:
        first, chain = right, 0
        while True:
            chain = max(chain, reach.get(first, 0))
            if first not in parts:
                break
            first = parts[first][0]
        length = len(left) + chain
        reach[left] = max(reach.get(left, 0), length)
        parts.setdefault(left + right, (left, right))
        most = max(most, length)
    return most + max((len(a) + len(b) for a, b in merges), default=1)


class Encoder:
    """Encodes text with one vocabulary; holds a bounded store of words seen."""

    def __init__(self, path: str, buffer: int = BUFFER, cached: int = CACHED):
        with open(path, encoding="utf-8") as file:
            loaded = json.load(file)
        model = loaded["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.ahead = lookahead(merges)
        self.buffer = max(buffer, 2 * self.ahead)
        self.special = {t["content"]: t["id"] for t in loaded["added_tokens"]}
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.blanks = regex.compile(f"[{BLANKS}]+")
        self.odd = regex.compile(r"[\x1c-\x1f]").search
        self.pieces = regex.compile(PIECES).findall
        self.names = byte_names()
        self.cached = cached
        self.seen: dict[str, list[int]] = {}

    def _merge(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges: the first in the list goes first, and the leftmost of equals."""
        rank, never = self.rank.get, len(self.rank)
        symbols = list(symbols)
        ranks = [rank(pair, never) for pair in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), never)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), never)
        return symbols

    def word(self, symbols: Iterable[str]) -> Iterator[int]:
        """The ids of one pre-token, symbol by symbol; the last symbol gets the word end.

        A token is emitted once ``ahead`` symbols stand behind it. What is kept never exceeds ``buffer``
        symbols. Symbols without an id of their own give no token.
        """
        kept: list[str] = []
        held = None
        for symbol in symbols:
            if held is not None:
                kept.append(held)
                if len(kept) >= self.buffer:
                    tokens, done = self._merge(kept), 0
                    for token in tokens:
                        if done + len(token) > len(kept) - self.ahead:
                            break
                        if token in self.ids:
                            yield self.ids[token]
                        done += len(token)
                    kept = kept[done:]
            held = symbol
        if held is not None:
            for token in self._merge([*kept, held + WORD_END]):
                if token in self.ids:
                    yield self.ids[token]

    def _token(self, token: str) -> list[int]:
        """The ids of text without white space."""
        ids = [i for piece in self.pieces(token) for i in self.word(self.names[b] for b in piece.encode("utf-8"))]
        if len(token) <= 64:
            if len(self.seen) >= self.cached:
                self.seen.clear()
            self.seen[token] = ids
        return ids

    def _plain(self, text: str, out: list[int]) -> None:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        text = text.lower()
        seen = self.seen
        # Python splits at four control characters more than the tokenizer.
        for token in text.split() if not self.odd(text) else self.blanks.split(text):
            known = seen.get(token)
            out.extend(self._token(token) if known is None else known)

    def encode(self, text: str) -> list[int]:
        """The ids of *text*; strings of special tokens in it become those tokens."""
        out: list[int] = []
        if self.at_special is None:
            self._plain(text, out)
            return out
        at = 0
        for found in self.at_special.finditer(text):
            self._plain(text[at : found.start()], out)
            out.append(self.special[found.group()])
            at = found.end()
        self._plain(text[at:] if at else text, out)
        return out


class Decoder:
    """Turns ids into text one by one, holding no more than the state between two of them.

    ``library`` text is what the tokenizer's own decoding gives: the pieces of the vocabulary with one
    space between. ``plain`` text undoes the bytes: pieces become bytes, word ends become spaces, and an
    incremental UTF-8 decoder carries unfinished characters from one token to the next.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            loaded = json.load(file)
        names = {i: piece for piece, i in loaded["model"]["vocab"].items()}
        self.special = {t["id"]: t["content"] for t in loaded["added_tokens"]}
        names.update(self.special)
        self.pieces = np.array([names.get(i, "") for i in range(max(names) + 1)], dtype=object)
        self.bytes = {name: b for b, name in enumerate(byte_names())}

    def library(self, ids) -> str:
        return " ".join(self.pieces[ids].tolist()) if len(ids) else ""

    def plain(self, ids: Iterable[int]) -> Iterator[str]:
        text = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if i in self.special:
                yield text.decode(b"", True) + self.special[i] + " "
                text.reset()
                continue
            piece = self.pieces[i]
            ends = piece.endswith(WORD_END)
            raw = bytes(self.bytes[c] for c in (piece[: -len(WORD_END)] if ends else piece))
            yield text.decode(raw, ends) + (" " if ends else "")
        yield text.decode(b"", True)


_loaded: dict[tuple, object] = {}


def _once(kind, path: str):
    """One encoder or decoder per worker process."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def _encoded(path: str, batches: Iterator[pa.RecordBatch], cached: int = CACHED) -> Iterator[pa.RecordBatch]:
    encoder = _once(Encoder, path)
    encoder.cached = cached
    for batch in batches:
        for part in _slices(batch, "text"):
            ids = [np.array(encoder.encode(t), dtype=np.int32) if t else np.empty(0, np.int32) for t in part["text"].to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([part["doc_id"], column], ["doc_id", "ids"])


def _decoded(path: str, plain: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decoder = _once(Decoder, path)
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            lists, text = part["ids"], []
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for a, b in zip(offsets, offsets[1:]):
                ids = values[a:b]
                text.append("".join(decoder.plain(ids.tolist())) if plain else decoder.library(ids))
            yield pa.RecordBatch.from_arrays([part["doc_id"], lists, pa.array(text, pa.string())], ["doc_id", "ids", "text"])


def _digested(with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["ids"]
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        names = [hashlib.sha256(" ".join(map(str, values[a:b].tolist())).encode()).hexdigest() for a, b in zip(offsets, offsets[1:])]
        text = [hashlib.sha256(t.encode()).hexdigest() for t in batch["text"].to_pylist()]
        columns = [batch["doc_id"], pa.array(np.diff(offsets).astype(np.int64)), pa.array(names, pa.string()), pa.array(text, pa.string())]
        fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        yield pa.RecordBatch.from_arrays(columns + [lists] * with_ids, fields + ["ids"] * with_ids)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row of *docs*: the token ids of the whole text, without special tokens
    around it. NULL and empty texts have no ids; repeated rows are encoded each; an empty table gives an
    empty result; other columns are ignored. The file at *path* must exist on every executor.
    """
    path = path or vocabulary_path()
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_encoded, path), f"doc_id {key}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, plain: bool = False) -> DataFrame:
    """*encoded* (doc_id, ids) with ``text``: the library's decoding, or the plain text of the bytes."""
    path = path or vocabulary_path()
    key = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, path, plain), f"doc_id {key}, ids array<int>, text string")


def _slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """*batch* in parts of about *most* bytes of *column*; a row is never cut."""
    for first, last, _, _ in text_chunks(batch[column], most):
        yield batch.slice(first, last - first)


def digests(docs: DataFrame, path: str | None = None, with_ids: bool = False, cached: int = CACHED) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, and ids if asked for: what :func:`encode`
    and :func:`decode` do, one after the other in one worker, and digests of their outputs. A worker remembers
    *cached* words."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _digested(with_ids, _decoded(path, False, _encoded(path, batches, cached)))

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
