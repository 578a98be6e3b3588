import random

import pytest

WORDS = [a + b + c for a in ("ba", "ce", "di", "fo") for b in ("lan", "mer", "nis", "tol") for c in ("", "e", "u", "or", "ing")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text: str, seed: int, n: int) -> str:
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


#: Columns that carry the names of the operators' own.
CLASHES = ("k1", "spans", "size", "key", "n", "bands", "rank", "cid", "shard", "place", "sha", "h", "rb", "v", "copies", "node")


def document_rows() -> list[tuple]:
    """Nulls, empty and short texts, copies, near copies, shared passages, repeated rows and a long text."""
    passage, base, other = prose(1, 90), prose(2, 120), prose(3, 60)
    texts = [
        (0, None), (1, ""), (2, "one two"), (3, base), (4, base), (5, edited(base, 5, 3)), (6, edited(base, 6, 14)), (7, edited(base, 7, 60)),
        (8, f"{prose(8, 50)} {passage} {prose(9, 40)}"), (9, f"{prose(10, 30)} {passage}"), (10, other + " " + passage + " " + passage), (11, "é" * 300 + passage + "ü"),
        (12, "a" * 1500), (13, "ab " * 400), (14, prose(14, 3000)), (15, "released under the MIT  license. And the Apache-License, the mit license"), (16, " \n\t "),
        (17, "GNU General Public License general public license"), (18, "one two"), (19, "Ünïcode wörds Licensed under CC BY-NC 4.0."), (None, prose(20, 80)), (21, None), (22, "é"), (23, base.upper()),
    ]
    rows = [(i, t, "en" if k % 3 else None, None if k % 5 == 0 else f"s{k % 4}", len(t) if t is not None else None) for k, (i, t) in enumerate(texts)]
    return rows + [rows[8], rows[8]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(document_rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def as_rows(df, *columns) -> list[tuple]:
    """Rows in an order of their own, nulls first."""
    got = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in got.collect()), key=lambda r: tuple((x is not None, str(type(x)), x if not isinstance(x, (list, dict)) else str(x)) for x in r))
