import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from annalist.llm import fitplan
from helpers import MESSY, docs, prose


def by_items(lengths, most):
    """Best-fit-decreasing one item at a time; the room that is left in every sequence."""
    rooms = []
    for size in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= size
        else:
            rooms.append(most - size)
    return sorted(rooms)


def filled(rows, most):
    """The room left in each sequence of a plan, after checking that ranks and offsets have no gap."""
    placed, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, each, at in rows:
        for i in range(n):
            placed[first + i // each].append((at + i % each * length, length))
            ranks[length].append(rank + i)
    for found in ranks.values():
        assert sorted(found) == list(range(len(found)))
    rooms = []
    for segments in placed.values():
        end = 0
        for at, length in sorted(segments):
            assert at == end
            end += length
        assert end <= most
        rooms.append(most - end)
    return sorted(rooms), {length: len(found) for length, found in ranks.items()}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_counts_pack_like_single_items(counts):
    rooms, placed = filled(fitplan.plan(counts, 40), 40)
    assert placed == counts
    assert rooms == by_items([x for x, n in counts.items() for _ in range(n)], 40)


def test_plan_does_not_grow_with_counts():
    draw = random.Random(5)
    counts = {length: draw.randint(1, 40) for length in range(1, 4097, 3)}
    small, large = fitplan.plan(counts, 4096), fitplan.plan({k: v * 10**9 for k, v in counts.items()}, 4096)
    assert len(large) < 3 * len(small) and sum(r[2] for r in large) == 10**9 * sum(counts.values())


ODD = ["ÀÉß÷×ÿ Ærø¿½ª µ DON'T'RE'x <|b| a<|c Ÿ ĳ ", "Hello WORLD's  it's x\n\n1234", "<|endoftext|>a <|startoftext|> <|ENDOFTEXT|>", "é ́ ﬁ ½ İ Σας ΣΑΣ", "हिन्दी 中文\x1cab\x85c", "\U0001f600‍ x\u0000y", " ", "don't'S 'll'"]


def test_words_encode_like_the_whole_text():
    path = fitplan.vocabulary_path()
    library, mine = Tokenizer.from_file(path), fitplan.Encoder(path)
    draw = random.Random(3)
    signs = list(" \t\n\r\x0b\x0c'sSabA1.<|>") + ["́", "̸", "é", "É", "ß", "'RE", "'ll", "×", "µ", "9", "Σ", "İ", "中", " ", " ", "\x1c", "͸", "ᅠ", "가", "<|endoftext|>"]
    texts = ODD + [prose(1, 900)] + ["".join(draw.choices(signs, k=draw.randint(1, 40))) for _ in range(3000)]
    for text in texts:
        got = np.frombuffer(mine.encode(text.encode()), dtype="<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text


def test_long_texts_are_read_in_segments(monkeypatch):
    path = fitplan.vocabulary_path()
    text = prose(9, 3000).encode()
    whole = fitplan.Encoder(path).encode(text)
    monkeypatch.setattr(fitplan, "SEGMENT", 50)
    monkeypatch.setattr(fitplan, "WORDS", 7)
    assert fitplan.Encoder(path).encode(text) == whole


@pytest.mark.parametrize("length", [16, 4096])
def test_pack_against_brute_force(spark, length):
    rows = MESSY + [(20 + i, t, "en", "a") for i, t in enumerate(ODD)] + [(40 + i, prose(i, 1 + i % 9), "de", "b") for i in range(60)]
    frame = docs(spark, rows)
    library = Tokenizer.from_file(fitplan.vocabulary_path())
    want = []
    for doc_id, text, _, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), length):
            part = np.array(ids[start : start + length], dtype="<u4").tobytes()
            want.append((doc_id, start // length, start, len(part) // 4, zlib.crc32(part)))
    packed = fitplan.pack(frame, length).cache()
    got = packed.collect()
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got), key=order) == sorted(want, key=order)
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for segments in placed.values():
        ends = np.cumsum([n for _, n in sorted(segments)])
        assert [a for a, _ in sorted(segments)] == [0, *ends[:-1].tolist()] and ends[-1] <= length
    assert len(placed) == len(by_items([w[3] for w in want], length))
    for r in fitplan.sequences(packed).collect():
        assert r.cu_seqlens[-1] == r.n_tokens == len(r.ids) // 4 == sum(n for _, n in placed[r.sequence_id])
        assert r.cu_seqlens[:-1] == sorted(a for a, _ in placed[r.sequence_id])


def test_slots_of_a_large_run(spark, monkeypatch):
    monkeypatch.setattr(fitplan, "SLOTS", 5)
    runs = fitplan.plan({3: 23, 7: 4}, 10)
    got = fitplan.slots(spark.createDataFrame(runs, fitplan._RUN)).collect()
    want = [(n, rank + i, first + i // each, at + i % each * n) for n, rank, many, first, each, at in runs for i in range(many)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table_and_other_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, length int, part int")
    assert fitplan.pack(empty).collect() == [] and fitplan.sequences(fitplan.pack(empty)).collect() == []
    named = spark.createDataFrame([("x", "a b", 1), (None, None, 2)], "doc_id string, text string, length int")
    assert sorted((r.doc_id or "", r.length) for r in fitplan.pack(named).collect()) == [("", 1), ("x", 3)]
