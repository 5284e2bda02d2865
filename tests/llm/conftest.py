from __future__ import annotations

import random

import pytest

SYL = "the an er on re ti ha es ou in th nd st en or at ed ing ble wh".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYL) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """doc_id, text, lang, source, n_chars and columns whose names the operators use themselves."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(60, 300)) for _ in range(40)]
    texts = list(base)
    texts += [base[0], base[0], base[1]]  # copies
    words = base[2].split()
    words[100 % len(words)] = "changed"
    texts.append(" ".join(words))  # a near copy
    passage = prose(rng, 70)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 40)}" for _ in range(3)]
    texts += [None, "", "   \n\t ", "one", "one two three", "%%% *** 123", "Ünï cödé " * 30, "x" * 3000, "same line again\n" * 60]
    texts.append(prose(rng, 20_000))  # a very long one
    out = [(i, t, None if i % 7 == 0 else "en", f"src{i % 3}", len(t) if t else 0, float(i), f"k{i}") for i, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
