"""Rows that operators must bear."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators use or return themselves.
CLASHES = (
    ", keep_id long, kept string, _id string, _text string, n_words string, ids string, start string, slot string,"
    " shard string, score string, rule string, _node string, _hash string, class_id string, item_id string"
)


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


def messy_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies."""
    rng = random.Random(7)
    long = sentence(rng, 30_000)
    base = sentence(rng, 200)
    words = base.split()
    rows = [
        (1, "Hello World\nShared Line\n  shared line \nend", "en", "s0", 1),
        (2, "hello world\nshared line\n  SHARED line \nEND", "en", "s0", 1),
        (3, None, None, None, None),
        (4, "", "en", "s1", 0),
        (5, "\n\n", None, "s1", 2),
        (6, long, "de", "s1", len(long)),
        (7, long + " tail", "de", "s1", len(long)),
        (8, base, "fr", None, 3),
        (9, " ".join(words[:195]), "fr", "s2", 3),
        (10, base.upper() + "!!", "fr", "s2", 3),
        (None, base, None, "s2", 3),
        (None, "no id", None, "s2", 3),
        (11, "one", "en", "s2", 3),
        (12, "...", "en", "s2", 3),
        (13, "Ärger ÉTÉ ärger\nshared line", "de", "s2", 3),
        (13, "same id, other text\nshared line", "de", "s2", 3),
    ]
    rows += [(14, "repeated row\nshared line", "en", "s2", 9)] * 3
    rows += [(20 + i, f"text {i}\n\tShared line\r", "en", f"s{i % 3}", 9) for i in range(9)]
    return rows
