"""Small tables with the awkward cases: NULLs, empty and long texts, ties, repeated rows, odd columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Score double, text_sha256 string, copies int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "", ",", ".")) for _ in range(words))


def documents(spark):
    """Documents with every awkward case; several columns have names the operators use inside."""
    base = prose(1, 300).split()
    near = [" ".join(base[:i] + [f"changed{i}"] + base[i + 1 :]) for i in range(5, 245, 12)]
    texts: list[tuple[int | None, str | None]] = [
        (1, "same text here"), (2, "same text here"), (3, None), (4, ""), (5, "  \n\t "), (6, "one"),
        (7, "two words"), (7, "two words"), (8, prose(2, 20_000)), (9, prose(2, 20_000) + " end"),
        (10, "Ünïcödé 😀 text\nwith lines\n\nand more"), (11, "<|end|> </s>[INST] x"), (None, "same text here"),
        (None, "no id at all"), (12, "Released under the MIT License.\nmore"), (13, "a b c"),
    ]
    texts += [(100 + i, t) for i, t in enumerate([" ".join(base), *near])]
    texts += [(200 + i, prose(50 + i, 10 + i)) for i in range(40)]
    rows = [
        (i, t, "en", None if k % 7 == 0 else f"src{k % 3}", len(t or ""), 0.5, "x", 3)
        for k, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(df):
    return df.where("false")
