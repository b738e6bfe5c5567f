"""Small documents with everything that may go wrong, and words as the contracts cut them."""

import re

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, words int, kept int, key int, sid int, line int,"
    " size int, component_id int, drop_lines int, drop_id int, mixed_id int, mixed_times int, good_id int, sketch int, place int, shard int"
)
EXTRA = (1,) * 15


def docs(spark, rows):
    """Documents from (doc_id, text, lang, source), with columns that clash with inner names."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), *EXTRA) for i, t, lang, source in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, count, letters="abcdefghijklmnop"):
    """Words that look alike for one seed and differ between seeds."""
    out, state = [], seed * 7919 + 13
    for _ in range(count):
        word = ""
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        size = 2 + (state >> 60) % 7
        for k in range(size):
            word += letters[(state >> (8 + 6 * k)) % len(letters)]
        out.append(word)
    return " ".join(out)


MESSY = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \n\t ", None, "a"),
    (4, prose(4, 120), "en", "a"),
    (4, prose(4, 120), "en", "a"),
    (None, prose(5, 80), "de", "b"),
    (6, prose(6, 20000), "en", "a"),
    (7, "###$$$%%% " * 60, "en", "a"),
    (8, "a" * 5000, "en", "a"),
    (9, prose(4, 120), "en", "a"),
]
