"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""

from __future__ import annotations

import random

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one".split()

#: names that operators use inside
CLASHING = ["key", "hub", "n", "slot", "weak", "uid", "row", "shard", "__b", "position", "window", "score", "words", "term", "band", "_metadata", "__d", "__h", "__p", "__i"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", "er", "ing", "ed"])) for _ in range(n))


def texts() -> list[str | None]:
    rng = random.Random(5)
    base = prose(rng, 300)
    out = [None, "", " \t\n", "a", "A", "Word", "word", base, base.upper(), base, base + " tail", "x" * 30000, "x" * 30000,
           "é ü ñandú  two   spaces \n\n tab\t", prose(rng, 4000), "ÀÉ àé", "<|endoftext|> mid <|endoftext|>", "\U0001F600 smile"]
    return out + [prose(rng, rng.randint(1, 120)) for _ in range(30)]


def rows() -> list[tuple]:
    """(doc_id, text, lang, source): ids with nulls, repeats and negative values."""
    out = [(i, t, "en", f"src{i % 3}" if i % 7 else None) for i, t in enumerate(texts())]
    out += [(3, "a", "en", "src0"), (3, "a", "en", "src0"), (3, "other", None, "src0"), (None, "no id", "en", "hot"),
            (None, "no id", "en", "hot"), (None, None, None, None), (-5, "Word", "xx", "hot")]
    return out + [(1000 + i, "copied text of a hot group", "en", "hot") for i in range(60)]


def documents(spark, data=None):
    data = rows() if data is None else data
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    for i, c in enumerate(CLASHING):
        df = df.selectExpr("*", f"{i} AS `{c}`")
    return df.repartition(5)


def empty(spark):
    return documents(spark, [])
