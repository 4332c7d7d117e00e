import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, size long, score double, digest string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("alpha beta gamma delta omega sigma kappa lambda theta zeta eta iota".split()) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, repeated lines and passages, odd white space, and one long text."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(1, 90)) for _ in range(30)]
    near = [t.replace("alpha", "Alpha", 1) + " tail" for t in base[10:20]]
    line = "this line is shared by several documents, all of them"
    passage = sentence(rng, 30)
    mixed = [f"{t}\n  {line.upper()}\t\n{t[:20]}\n{passage} {k}" for k, t in enumerate(base[:6])]
    odd = ["", " ", "\n\n", "a", "one two", "tab\tand\x0bfeed", "é" * 60 + " ü", "All rights reserved. CC BY 4.0", "x" * 49, "y" * 130]
    return base + near + base[5:9] + mixed + odd + [" ".join(base) * 8]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with nulls, a repeated row, a null and a repeated doc_id, and columns whose names clash."""
    rows = [(k, t, "en" if k % 3 else None, f"src{k % 4}" if k % 7 else None, k, 0.5, "d") for k, t in enumerate(texts)]
    rows += [(900, None, "en", "src1", 1, None, None), rows[3], (None, texts[4], None, None, None, None, None), (7, "other text of a known id", "en", "src2", 1, 0.1, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
