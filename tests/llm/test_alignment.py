import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from annalist.llm import alignment, queries
from helpers import MESSY, docs, prose

SPECIAL = ["a  b", " a b", "a ", "x\n\ny z\n q", "▁a b", "a ▁ b", "<|endoftext|> x", "<s> a</s> <unk> <0x41>", "ﬁ ½ é é y", "हिन्दी में 中文 text", "\U0001f600‍ x", "\x00a b", "it's don't 's", "    indented\n\tcode  x", " no\xa0break x", "1 234 5", "a" * 300 + " b"]


class Plain:
    """The contract on whole texts, without words, runs or radix."""

    def __init__(self):
        path_a, path_b = alignment.vocabulary_paths()
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        self.byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}

    def groups(self, text):
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        raw_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(self.b.id_to_piece, b)]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return []
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        out, at = [], [0, 0]
        for end in sorted(set(ends_a) & set(ends_b)):
            to = [ends_a.index(end, at[0]) + 1, ends_b.index(end, at[1]) + 1]
            out.append((a[at[0] : to[0]], b[at[1] : to[1]]))
            at = to
        return out

    def rows(self, rows):
        found = [(doc_id, self.groups(text)) for doc_id, text in rows]
        links = [[(b[-1], a[-1]) for a, b in groups] for _, groups in found]
        counts = Counter(x for doc in links for x in doc)
        highest = defaultdict(int)
        for (b, _), n in counts.items():
            highest[b] = max(highest[b], n)
        return [
            (doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(doc),
             sum(counts[x] == highest[x[0]] for x in doc), sum(counts[x] for x in doc),
             ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups))
            for (doc_id, groups), doc in zip(found, links)
        ]


def order(row):
    return tuple(-1 if x is None else x for x in row)


def test_against_plain_alignment(spark, monkeypatch):
    rows = MESSY + [(50 + i, t, "en", "a") for i, t in enumerate(SPECIAL)] + [(100 + i, prose(i % 7, 40) + f"\nline {i}", "de", "b") for i in range(80)]
    want = Plain().rows([(i, t) for i, t, _, _ in rows])
    got = alignment.align(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert sum(1 for r in got if r.n_groups) > 80 and any(r.n_best < r.n_links for r in got)
    # many small runs and units, words forgotten again and again
    monkeypatch.setattr(alignment, "UNIT_RECORDS", 300)
    monkeypatch.setattr(alignment, "RADIX", 3)
    assert sorted(map(tuple, alignment.align(docs(spark, rows).repartition(9)).collect()), key=order) == sorted(want, key=order)


def test_words_align_like_whole_texts():
    draw = random.Random(11)
    signs = list("  \n\t'sabcZ19.,<>|_-") + ["é", "́", "▁", "中", "ß", " ", "\xa0", "\x1c", "<s>", "<0x41>", " the", "ing ", "  ", "हि", "\U0001f600"]
    texts = SPECIAL + ["".join(draw.choices(signs, k=draw.randint(1, 60))) for _ in range(3000)]
    aligner, plain = alignment.Aligner(*alignment.vocabulary_paths()), Plain()
    facts, codes, which, times = aligner.texts(texts)
    links = Counter()
    for text, (n_a, n_b, n_groups, groups) in zip(texts, facts):
        want = plain.groups(text)
        assert groups == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want), repr(text)
        assert (n_a, n_b, n_groups) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want))
        links.update((texts.index(text), b[-1] << 32 | a[-1]) for a, b in want)
    first = [texts.index(t) for t in texts]
    got = Counter()
    for code, text, n in zip(codes.tolist(), which.tolist(), times.tolist()):
        got[first[text], code] += n
    assert got == links


def test_forgetting_words_changes_nothing(monkeypatch):
    texts = [prose(i, 30) for i in range(40)]
    aligner = alignment.Aligner(*alignment.vocabulary_paths())
    want = [aligner.texts([t])[0] for t in texts]
    monkeypatch.setattr(alignment, "WORDS", 50)
    aligner.clear()
    assert [aligner.texts([t])[0] for t in texts] == want and len(aligner.groups) < 120


def test_runs_and_merge():
    draw = np.random.default_rng(2)
    parts, total = [], Counter()
    for _ in range(6):
        codes = (draw.integers(0, 40, 500, dtype=np.uint64) << np.uint64(32)) | draw.integers(0, 5, 500, dtype=np.uint64)
        keys, times = draw.integers(0, 2**45, 500), draw.integers(1, 9, 500)
        keys[:100] = 7
        for c, n in zip(codes.tolist(), times.tolist()):
            total[c] += n
        for radix, n, run in alignment.runs(codes, keys, times):
            pairs, starts, docs_, times_ = alignment.unpacked(run)
            assert starts[-1] == n == len(docs_) and (np.diff(pairs.astype(np.int64)) > 0).all() and (alignment.radix_of(pairs) == radix).all()
            for s, e in zip(starts, starts[1:]):
                assert (np.diff(docs_[s:e]) > 0).all()
            parts.append((pairs.tolist(), np.add.reduceat(times_, starts[:-1]).tolist()))
    got = {pair: sum(parts[i][1][at] for i, at in places) for pair, places in alignment.merged([p for p, _ in parts])}
    assert got == total and list(got) == sorted(got)
    assert list(alignment.merged([])) == []


def test_query_digest_empty_table_and_other_ids(spark, tmp_path):
    rows = [("x", "the cat sat", 1, "q"), ("y", None, 2, None), (None, "the cat", 3, "")]
    frame = spark.createDataFrame(rows, "doc_id string, text string, key int, run string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    want = {r[0]: r for r in Plain().rows([r[:2] for r in rows])}
    for r in queries.op12_spill_alignment(spark, str(tmp_path)).collect():
        text = want[r.doc_id][-1]
        assert tuple(r)[:-1] == want[r.doc_id][:-1] and r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")
    assert alignment.align(frame.limit(0)).collect() == []
    assert alignment.align(frame.filter("text IS NULL")).agg(F.sum("n_a")).first()[0] == 0
