import re

import pytest

WORDS = ["alpha", "beta", "gam", "delta é", "x", "the", "of", "zeta", "Müller", "naïve"]


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@pytest.fixture(scope="session")
def documents(spark):
    """Small documents with every case: nulls, empty and long texts, copies, near copies, repeated rows, clashing columns."""
    import random

    rng, rows = random.Random(7), []
    for d in range(90):
        if rows and rng.random() < 0.4:
            w = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            t = " ".join(w)
        else:
            t = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 70)))
        rows.append((d, t))
    long = " ".join(rng.choice(WORDS) + str(i) for i in range(6000))
    rows += [(100, None), (101, ""), (102, "  \n "), (103, "A b"), (104, "a B"), (105, long), (106, long[:9000] + " tail"), (107, "z" * 5000), (108, "line one is long enough\nshort\nline one is long enough"), (109, "Line one is long enough \nother"), (110, "x\n line one is long enough"), (111, "!!! 123")]
    return rows


SCHEMA = "doc_id long, text string, n_bytes string, _row string, score double, kept string"


@pytest.fixture(scope="session")
def docs(spark, documents):
    """With columns named like results and like columns in use."""
    return spark.createDataFrame([(d, t, "n", "r", 1.0, "k") for d, t in documents], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, documents):
    """Null ids and repeated rows among others."""
    t = documents[3][1]
    return spark.createDataFrame([(1, t), (1, t), (1, "other text"), (None, t), (None, t), (None, None), (2, None)], "doc_id long, text string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
