"""Pages, packing, encoding, languages and secrets against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from helpers import MESSY, docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from annalist.llm import crossparse, packing, secretscan, templates, transducer

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def page(body, more=""):
    return (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site <a>top</a></header>"
        f"<nav><ul><li>Home<li>News</ul></nav><div class='cookie-notice'>We use cookies</div><div id=main>{body}</div>"
        f"<div class=\"comments\"><p>first!</p></div><aside>Side</aside><form>Name <input> <button>Go</button></form>{more}<footer>&copy; all</footer></body></html>"
    )


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", 2) for i, u, h in rows], "page_id bigint, url string, html string, slot int, host string, text int")


def test_pages(spark):
    article = "<article><h1>Big &amp; small</h1><p>One\n  two<b> three</b>&nbsp;&eacute;<p>Four<br>five<script>x</script><ul><li>six<li>seven</ul></article>"
    text = "Big & small\nOne two three é\nFour five\nsix\nseven"
    rows = [(i, f"https://a.example/{i}", page(article)) for i in range(6)]
    rows += [(10 + i, f"http://u:p@B.example:80/{i}", page(f"<div><p>{prose(i, 30)}</p><p>{prose(50 + i, 9)}</p></div>")) for i in range(5)]
    rows += [(20, None, None), (21, "no host", ""), (22, "https://c.example/", "plain words"), (23, "https://d.example/", "<p>cut <b>off"), (24, "https://a.example/x", "<body><p>other</p><nav>x</nav>")]
    rows += [(30, "https://a.example/0", page(article)), (30, "https://a.example/0", page(article)), (31, "https://e.example/", "<div>" * 3000 + "deep")]
    got = {}
    result = templates.main_text(pages(spark, rows)).collect()
    assert len(result) == len(rows)
    for r in result:
        got[r.page_id] = r.text
        assert r.n_chars == len(r.text)
    assert all(got[i] == text for i in [*range(6), 30])
    assert all(got[10 + i] == f"{prose(i, 30)}\n{prose(50 + i, 9)}" for i in range(5))
    assert (got[20], got[21], got[22], got[23], got[24], got[31]) == ("", "", "plain words", "cut off", "other", "deep")
    assert templates.main_text(pages(spark, [])).collect() == []


@pytest.mark.parametrize("raw", [
    "<script>for(var i=0;i<n;i++){f(i)}</script>", "<script>var a='<!--';if(a<b&&c>d)f(\"it's\")</script>", "<STYLE>a<b{}'</Style >",
    "<script>x='</scripts>'+\"</p>\"</script\n>", "<svg><title>t</title><path d='M0'/></svg>", "<template><template>a</template>b</template>",
])
def test_raw_elements_end_at_their_own_tag(raw):
    assert templates.extract(f"<body>{raw}<article>One {raw}<p>two</article></body>", None) == "One\ntwo"
    assert templates.extract("<article>One<script>a<b</article>", None) == "One"


def test_only_whole_names_hide():
    article = "<article><h2 id='related-work'>One</h2><section id=search><h3 id='social-history'>two</h3><p data-id='menu' data-role=ad title='class=ad'>three</section><div class='ad-box'>x</div></article>"
    for name in ("content no-sidebar", "has-sidebar", "search-results", "with-comments", "layout sidebar"):
        page = f"<body><div class='{name}'>{article}<aside>y</aside></div></body>"
        assert templates.extract(page, None) == "One\ntwo\nthree"
        assert templates.extract(f"<body><div class='{name}'><main>{prose(1, 5)}</main></div></body>", None) == prose(1, 5)
    more = "<div class='comments-area'><article>first!</article></div><div id='sidebar_left'><article>teaser</article></div>"
    assert templates.extract(f"<body><div>{prose(1, 30)}</div>{more}<div role=search>s</div></body>", "none") != ""
    assert templates.extract(f"<body><article>{prose(1, 30)}</article>{more}</body>", None) == prose(1, 30)


def test_recurring_text_is_template(spark):
    menu = "<div class='x1'>Start News Shop</div>"
    rows = [(i, f"https://a.example/{i}", f"<body><article>{menu * (i > 1)}<p>{prose(i, 30)}</p><p>Same in two {i // 2}</p></article></body>") for i in range(8)]
    rows += [(20 + i, f"https://b.example/{i}", f"<body><div>Menu of b {'and more ' * 20}</div><div><p>{prose(i, 30)}</p></div><p>All rights reserved</p></body>") for i in range(4)]
    rows += [(30 + i, f"https://c.example/{i}", f"<body><p>{prose(1, 30)}</p><p>copy {i}</p></body>") for i in range(4)]
    rows += [(40 + i, f"https://d.example/{i}", f"<body><p>{prose(2, 30)}</p><p>twice</p></body>") for i in range(2)]
    got = {r.page_id: r.text for r in templates.main_text(pages(spark, rows)).collect()}
    assert all(got[i] == f"{prose(i, 30)}\nSame in two {i // 2}" for i in range(8))
    assert all(got[20 + i] == prose(i, 30) for i in range(4))
    assert all(got[30 + i] == f"{prose(1, 30)}\ncopy {i}" for i in range(4))
    assert all(got[40 + i] == f"{prose(2, 30)}\ntwice" for i in range(2))


def test_best_fit_against_search():
    chance = random.Random(4)
    for _ in range(60):
        most = chance.choice([1, 2, 7, 64, 100])
        lengths = [chance.randint(1, most) for _ in range(chance.randint(0, 120))]
        rooms, expected = [], []
        for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [r for r in rooms if r >= lengths[item]]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - lengths[item])
            else:
                rooms.append(most - lengths[item])
        got = packing.best_fit(lengths, most)
        expected = sorted(rooms)
        assert sorted(most - sum(lengths[i] for i in row) for row in got) == expected
        assert sorted(i for row in got for i in row) == list(range(len(lengths)))


def test_packing_loses_nothing(spark):
    rows = MESSY + [(1000 + i, prose(i, 20 + 13 * i), "en", "a") for i in range(60)]
    packed = packing.pack(docs(spark, rows), length=128, shard_docs=20).collect()
    encode = packing.encoding(packing.vocabulary_path()).encode_ordinary
    found = []
    for r in packed:
        ids, positions = (m[0] for m in packing.matrix([r], 128))
        assert r.cu_seqlens[-1] == r.n_tokens <= 128 and (ids[r.n_tokens :] == packing.PAD).all()
        for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            found.append((d, start, tuple(ids[a:b].tolist())))
    expected = []
    for d, text, _, _ in rows:
        ids = encode(text or "")
        expected += [(d, s, tuple(ids[s : s + 128])) for s in range(0, len(ids), 128)]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert {r.shard for r in packed} == {-1, 0, 1, 2, 3}
    assert packing.pack(docs(spark, [])).collect() == []


@pytest.fixture(scope="module")
def coder():
    return transducer.Encoder(transducer.vocabulary_path())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(transducer.vocabulary_path())


ALPHABETS = ["ab", "the rin", "aeiou xyz'stremvdl", "é Σσς İıßKſ", "\x1c\x1f\x85\xa0 ​　ab\n", "👍🏽é中文字абв1२", "<|endoftext|> </w>", "!?.-0"]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(ALPHABETS).flatmap(lambda a: st.text(a, max_size=300)))
def test_encoding_equals_the_library(coder, library, text):
    expected = library.encode(text, add_special_tokens=False).ids
    assert coder.encode(text) == expected
    decoder = transducer._once(transducer.Decoder, transducer.vocabulary_path())
    assert decoder.library(np.array(expected, dtype=np.int32)) == library.decode(expected, skip_special_tokens=False)


def test_long_words_stream_in_constant_memory(coder, library):
    chance = random.Random(2)
    for letters in ("ab", "theinr", "abcdefghijklmnopqrstuvwxyz", "a"):
        word = "".join(chance.choice(letters) for _ in range(6000))
        expected = library.encode(word, add_special_tokens=False).ids
        fed = []

        def symbols(word=word):
            for i, c in enumerate(word):
                fed.append(i)
                yield c

        first = None
        got = []
        for token in coder.word(symbols()):
            first = len(fed) if first is None else first
            got.append(token)
        assert got == expected
        assert first <= coder.buffer + 1  # tokens leave long before the word ends


def test_lookahead_bounds_every_change():
    merges = [("b", "c"), ("a", "b"), ("c", "d"), ("ab", "cd"), ("x", "ab")]
    ahead = transducer.lookahead(merges)
    coder = object.__new__(transducer.Encoder)
    coder.rank = {m: i for i, m in enumerate(merges)}
    chance = random.Random(1)
    for _ in range(3000):
        left = [chance.choice("abcdx") for _ in range(chance.randint(1, 12))]
        tail = [[chance.choice("abcdx") for _ in range(6)] for _ in range(2)]
        ends = []
        for t in tail:
            at, stable = 0, []
            for token in coder._merge(left + t):
                at += len(token)
                if at <= len(left) - ahead:
                    stable.append(token)
            ends.append(stable)
        assert ends[0] == ends[1]


def test_encoding_of_documents(spark, library):
    rows = MESSY + [(50, "Hello  World's café <|endoftext|> x", "en", "a")]
    got = transducer.digests(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    expected = []
    for i, text, _, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append((i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    plain = transducer.decode(transducer.encode(docs(spark, rows)), plain=True).collect()
    texts = {r.doc_id: r.text for r in plain}
    assert texts[50] == "hello world 's café <|endoftext|> x "
    assert texts[6] == prose(6, 20000) + " "
    assert transducer.digests(docs(spark, [])).collect() == []


def test_longest_matches():
    chance = random.Random(3)
    for _ in range(40):
        text = "".join(chance.choice("abc ") for _ in range(chance.randint(1, 60)))
        automaton = crossparse.Automaton(text)
        for _ in range(20):
            word = "".join(chance.choice("abcd ") for _ in range(chance.randint(1, 15)))
            count, at = 0, 0
            while at < len(word):
                size = 0
                while at + size < len(word) and word[at : at + size + 1] in text:
                    size += 1
                at += max(size, 1)
                count += 1
            assert automaton.phrases(word) == count


def test_languages(spark):
    rows = [(i, prose(i, 60, "abcdefgh"), "xx", "a") for i in range(60)] + [(100 + i, prose(i, 60, "ghijklmnop"), "yy", "a") for i in range(60)]
    rows += [(500, prose(500, 60, "abcdefgh"), None, "a"), (501, "a" * 5000 + "b" * 70, "xx", "a")] + MESSY
    got = crossparse.languages(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "xx" for i in range(10, 60)) and all(by_id[100 + i].lang_pred == "yy" for i in range(60))
    assert by_id[500].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got)
    assert by_id[1].lang_pred == by_id[7].lang_pred == "und"
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    other = [(i, t, "zz" if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else lang, s) for i, t, lang, s in rows]
    assert sorted(map(str, crossparse.languages(docs(spark, other)).collect())) == sorted(map(str, got))
    assert crossparse.languages(docs(spark, [])).collect() == []
    assert {r.lang_pred for r in crossparse.languages(docs(spark, [(1, "abc", None, None)])).collect()} == {"und"}


def test_secrets(spark):
    key = "0123456789abcdef0123"
    rows = [
        (20, f'é password = "{key}" and AKIA{"A1" * 8} 😀 {key}', "en", "a"), (21, "TOKEN:short api-key=" + "z" * 20, "en", "a"),
        (22, "Api_Key : 'Abc+/_.=-12345' token=token=abcdefghijklm", "en", "a"),
    ] + MESSY
    rows += [(200 + i, prose(i, 40) + f" secret: {hashlib.sha1(str(i).encode()).hexdigest()} " + prose(90 + i, 40), "en", "a") for i in range(40)]
    got = secretscan.digests(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    base = lambda i: [s for s in by_id[i].spans.split(",") if s and not s.startswith("cnn")]
    assert base(20) == ["assign:2:34", "hex:14:34", "access:40:60", "hex:63:83"]
    assert base(21) == [] and base(22) == ["assign:0:25", "assign:27:52"] and base(1) == []
    assert (by_id[20].n_assign, by_id[20].n_access, by_id[20].n_hex) == (1, 1, 2)
    for i, t, _, _ in rows:
        found = secretscan.base_spans(t or "")
        listed = ",".join(f"{secretscan.KINDS[k]}:{s}:{e}" for s, k, e in found)
        if i is not None:
            assert by_id[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
            assert ",".join(base(i)) == listed
    assert secretscan.digests(docs(spark, [])).collect() == []


def test_network_finds_what_it_learned():
    chance = random.Random(5)
    make = lambda: "".join(chance.choice("0123456789abcdef") for _ in range(40))
    plain = lambda i: prose(i, 30)[:80].rjust(88)
    windows = [("x" * 14 + " token = " + make() + " " + prose(i, 9))[: secretscan.WINDOW] for i in range(150)] + [plain(i) for i in range(150)]
    codes, labels = secretscan.symbols(windows), np.array([1.0] * 150 + [0.0] * 150, dtype=np.float32)
    held = np.arange(300) % 5 == 0
    network = secretscan.Network()
    network.fit(codes[~held], labels[~held])
    network.calibrate(codes[held], labels[held], 0.95)
    score = network.probability(codes[held])
    assert (score[labels[held] > 0] >= network.threshold).mean() >= 0.95
    assert (score[labels[held] == 0] >= network.threshold).mean() <= 0.05


def test_network_learns_from_all_findings(spark, monkeypatch):
    """More than 1,500 findings of a label all take part, and the way rows are dealt changes nothing."""
    monkeypatch.setattr(secretscan, "SHARD", 100)
    monkeypatch.setattr(secretscan, "EPOCHS", 2)
    lesson, seen = secretscan._lesson, []
    monkeypatch.setattr(secretscan, "_lesson", lambda state, weights: seen.append(weights) or lesson(state, weights))
    rows = [(i, prose(i, 12), "en", "a") for i in range(1900)]
    rows += [(5000 + i, prose(i, 12) + f" secret: {hashlib.sha1(str(i).encode()).hexdigest()}", "en", "a") for i in range(40)]
    found = docs(spark, rows).select("doc_id", "text").mapInArrow(secretscan._scan, f"doc_id bigint, found {secretscan.FOUND}")
    labels = [f["label"] for r in found.collect() for f in r["found"] if f["label"] >= 0]
    network = secretscan.train(found)
    assert labels.count(0) > 1500
    assert seen[0].tolist() == [len(labels) / (2 * labels.count(k)) for k in (0, 1)]
    again = secretscan.train(found.repartition(5))
    assert (network.state() == again.state()).all() and network.threshold == again.threshold
    codes = secretscan.symbols([("x" * 14 + " secret: " + "a1" * 20).ljust(88), prose(3, 30)[:88]])
    high, low = network.probability(codes)
    assert high >= network.threshold > low
