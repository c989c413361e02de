"""Small tables with nulls, ties, repeated rows, odd texts and columns whose names clash with the operators' own."""

from __future__ import annotations

import random

CLASH = ("row", "digest", "key", "part", "grp", "salt", "n", "kept", "score", "copy", "rate", "keep_id", "words", "spans", "node", "component")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def long_text(n: int = 60_000) -> str:
    r = random.Random(1)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))


def rows(extra: list[tuple] = ()) -> list[tuple]:
    """(doc_id, text, lang, source)"""
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    line = prose(9)
    out = [
        (1, base, "en", "src0"), (2, base, "en", "src0"), (3, base.upper(), "en", "src1"), (4, " ".join(near), "en", "src0"),
        (5, None, "en", "src0"), (6, "", None, None), (7, " \t\n ", "en", "src1"), (8, "one", "en", None), (9, "One two", None, "src2"), (10, "one TWO", "de", "src2"),
        (11, base, None, None), (11, base, None, None), (12, prose(30), "en", "src0"), (12, prose(40), "en", "src1"), (None, base, "en", "src0"), (None, None, None, None), (None, prose(25), "fr", "src1"),
        (13, "\n".join([line] * 9 + [prose(8)]), "en", "src0"), (14, "É" * 30 + " ÄÖ é " + prose(20), "fr", "src2"), (15, "a" * 3000, "en", "src0"), (16, long_text(), "en", "src1"), (17, "# $ % " * 40, "en", "src0"),
        (18, "\u0000 nul   line ﻿" + prose(22), "en", "src2"), (-3, prose(50), "es", "src0"),
    ]
    out += [(100 + i, prose(r.randrange(20, 90)), r.choice(["en", "de"]), f"src{r.randrange(4)}") for i in range(60)]
    return out + list(extra)


def frame(spark, data: list[tuple] | None = None):
    data = rows() if data is None else data
    full = [(i, t, l, s, None if t is None else len(t), *(["x"] * len(CLASH))) for i, t, l, s in data]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
