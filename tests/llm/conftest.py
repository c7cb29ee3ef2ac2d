import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int"


def make_texts(seed: int, n: int) -> list[str]:
    """Invented prose with exact copies, near copies, shared passages and odd cases."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdeéß", k=draw.randint(2, 7))) for _ in range(400)]
    prose = lambda k: " ".join(draw.choices(vocabulary, k=k))
    passages = [prose(20) for _ in range(3)]
    texts = []
    for i in range(n):
        kind = draw.random()
        if i and kind < 0.15:
            texts.append(draw.choice(texts))
        elif i and kind < 0.3:
            words = draw.choice(texts).split(" ")
            words[draw.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        elif kind < 0.5:
            texts.append(f"{prose(draw.randint(0, 40))} {draw.choice(passages)} {prose(draw.randint(0, 40))}")
        else:
            texts.append(prose(draw.randint(1, 120)))
    return texts


@pytest.fixture(scope="session")
def odd_rows():
    """Rows (doc_id, text, source): nulls, empty and long texts, runs of one character, repeated rows and ids out of order."""
    texts = make_texts(5, 60)
    rows = [(3 * i + 1, t, f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(1000, None, "s0"), (1001, "", None), (1002, "  \n\t ", "s1"), (1003, "a" * 500, "s2"), (1004, "a" * 300, "s2")]
    rows += [(1005, "x y " * 400, None), (1006, "x y " * 300, ""), (999_999_999_999, texts[0], "s3"), (-7, texts[1], "s3")]
    rows += [(None, texts[2], None), (None, None, "s1"), (1007, "one\xa0two　three\x1cfour", "s1"), (1008, "ÀÉ Àé àé àÉ àé Àé", "s1")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with columns whose names operators might use themselves."""
    full = [(i, t, None, s, None, "clash", 1) for i, t, s in odd_rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter(F.lit(False))
