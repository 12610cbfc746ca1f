"""Small documents with every awkward case."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int, kind: str = "en") -> str:
    rnd = random.Random(seed)
    parts = {"en": ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"], "fr": ["le", "é", "eau", "que", "oi", "aux", "ment", "ç", "un", "ou"]}[kind]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def documents() -> list[tuple]:
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        base, base, " ".join(near), base.upper(), words(2, 60, "fr"), words(3, 60, "fr"), None, "", "   \n\t ", "12 34 ... !!", "One line of some length\nanother line here too\nOne line of some length",
        "ONE line of some length  \nshort\nshort", "short\n\n\n", words(4, 6000), "x" * 20000, words(5, 3), words(1, 40) + "\n" + words(6, 30), "naïve <|endoftext|> café\n\n  two  blanks", "中文 字 ՘ 🙂 words",
    ]
    return [(i * 3 + 1, t, "fr" if i in (4, 5) else None if i == 7 else "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    """All cases, a repeated row, and a column whose name the operators use themselves."""
    from pyspark.sql import functions as F

    rows = documents()
    return spark.createDataFrame([*rows, rows[10]], DOCS).withColumn("n_lines", F.lit("mine")).withColumn("id", F.lit("mine")).withColumn("fp", F.lit("mine"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def nameless(spark):
    """Rows without an id beside one that has one."""
    return spark.createDataFrame([(None, "a line that is long enough\nmore", "en", "s", 31), (None, "a line that is long enough\nmore", "en", "s", 31), (4, "a line that is long enough", "en", None, 26), (None, None, None, None, None)], DOCS)
