from __future__ import annotations

import random

import pytest


def prose(seed: int, n: int, stems: list[str] | None = None) -> str:
    r = random.Random(seed)
    stems = stems or ["the", "of", "and", "th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    return " ".join("".join(r.choices(stems, k=r.randint(1, 4))) for _ in range(n))


LONG = prose(99, 30_000)
#: Rows that every operator must take: null, empty, blank, no spaces, very long, tied, repeated, null id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 5000), (5, LONG), (6, "Same text here."), (7, "Same text here."), (8, "twice over"), (8, "twice over"), (None, "no id at all"), (9, "▁ mark é \U0001f600 \x00 end")]


@pytest.fixture(scope="session")
def odd(spark):
    """With further columns whose names clash with those of outputs and of inner steps."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    extra = "score spans ids kept found key id w h hits class component lang_pred n_words _s _w chunk label removed".split()
    return df.selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as bigint) as n_chars", *[f"'clash' as `{c}`" for c in extra])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
