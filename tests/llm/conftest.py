import random

import pytest

#: Odd texts that every operator has to take: null, empty, spaces, other scripts, long words, repeats.
ODD = [
    (-1, None), (-2, ""), (-3, " \n\t "), (-4, "One"), (-5, "one two three"), (-6, "naïve 你好 🙂 ١٢٣ é x"),
    (-7, "x" * 3000), (-8, "la " * 400), (-9, "a<|endoftext|>b  <|endoftext|>"), (-10, "tie tie\ntie tie\n\ntie tie"), (-11, "tie tie\ntie tie\n\ntie tie"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, end int, words string, block int, h long, key string, kind string, score double, y int, item_id long, n long"


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int, str | None]]:
    """Small random texts with exact and near copies and shared passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passage = [word() for _ in range(25)]
    out: list[tuple[int, str | None]] = []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 80))]
        if i % 4 == 0:
            at = r.randrange(len(w))
            w[at:at] = passage[r.randint(0, 6) : r.randint(15, 25)]
        if i % 5 == 0 and i > 5:
            w = (out[i - 3][1] or "").split()
            if w and i % 10 == 0:
                w[r.randrange(len(w))] = word()
        out.append((i, " ".join(w).capitalize() + "."))
    return out + ODD


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with those that operators use."""
    more = len(SCHEMA.split(", ")) - 2
    return spark.createDataFrame([(*x, *[None] * more) for x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
