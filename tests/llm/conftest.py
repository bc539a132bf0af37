import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, row long, n string"


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "éta", "straße", "the", "of", "and", "x1", "42"]
    words += ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = some(80)
    near = base.split()
    near[3] = "other"
    far = base.split()
    far[::6] = ["q"] * len(far[::6])
    out = [None, "", "   \t\n", "one", "two words", "Two  WORDS", base, base, base.upper(), " ".join(near), " ".join(far), some(30), some(3000), "word " * 3000, "ß" * 5000]
    out += [some(rng.randint(1, 60)) for _ in range(60)]
    chain = some(100).split()
    for i in range(8):  # each links with the next
        chain = chain[:]
        chain[10 * i] = f"new{i}"
        out.append(" ".join(chain))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Nulls, empty and long texts, copies, repeated and null ids, and columns whose names clash with ours."""
    rows = [(i, t, "en", ["b", "a", None, "ç"][i % 7 % 4], 0, -1, -1, -1, "x") for i, t in enumerate(texts)]
    rows += [rows[6], rows[0], (None, "a text without an id that has a few words", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]
