from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdefghié") for _ in range(rnd.randint(2, 8))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, equal texts, white space of all kinds."""
    rnd = random.Random(11)
    passage = sentence(rnd, 60)
    rows = [(i * 3 + 1, "\n".join(sentence(rnd, rnd.randint(3, 40)) for _ in range(rnd.randint(1, 6))), "en", f"s{i % 4}") for i in range(40)]
    rows += [(500 + i, f"{sentence(rnd, 20)} {passage} {sentence(rnd, 15)}", "de", "s1") for i in range(6)]
    long_text = " ".join(sentence(rnd, 30) for _ in range(400))
    rows += [(600, long_text, "fr", "s2"), (601, long_text, "fr", "s2"), (602, None, "en", "s0"), (603, "", "en", None), (604, "  \n\t ", None, "s3"), (None, sentence(rnd, 30), "en", "s1"), (None, None, None, None)]
    rows += [(605, sentence(rnd, 30), "en", "s9")] * 3 + [(606, "a  b c\x0bd e 日本 👍", "en", ""), (607, "x" * 700, "en", "s0"), (608, "a <|endoftext|> b, c", "en", "s2"), (-5, "minus", "en", "S")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """Columns with the names that operators use inside, with dots and blanks."""
    from pyspark.sql import functions as F

    return odd_docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(("simhash", "id", "score", "key", "size", "cell", "range", "part", "row", "start", "a.b", "mix", "draws", "c0", "label", "component_id", "toxicity score", "mix row", "mix draw"))])


def counted(rows):
    return sorted(map(repr, rows))
