import random

import pytest

WORDS = [f"{a}{b}" for a in ("ba", "ko", "ri", "sul", "te", "ven") for b in ("na", "do", "mi", "ra", "x", "lo", "pe")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture
def docs(spark):
    """A DataFrame of documents (doc_id, text), an extra column and one that clashes with internal names."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, source string, score int").repartition(3)

    return make


@pytest.fixture
def corpus():
    """Nulls, empty and short texts, copies, near copies, repeated rows, one long text."""
    rng = random.Random(4)
    base = [prose(rng, 120) for _ in range(12)]
    rows = list(enumerate(base))
    rows += [(100 + i, base[i]) for i in range(4)] + [(3, base[3])]
    for i in range(6):
        words = base[5].split(" ")
        for k in rng.sample(range(len(words)), 1 + i):
            words[k] = "zzz"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "   "), (303, "one"), (304, "One"), (None, base[0]), (None, None)]
    rows += [(400, prose(rng, 20_000)), (401, "aaaa " * 300), (402, "é" * 400)]
    return rows
