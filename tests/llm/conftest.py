import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept boolean, score double, n int, terms string"


def _texts():
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "être", "größe", "İx", "mit", "license", "apache", "idiot", "naïve"]
    base = [" ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(80)) for _ in range(6)]
    out = [None, "", " \t\n", "one", "two words", "mit license", "MIT  License, and the GNU General Public License.", "a<|endoftext|>b"]
    out += base + base[:3] + [b.upper() for b in base[:2]] + [b.replace(" ", "  ") for b in base[:2]]
    out += [b + " tail " + str(i) for i, b in enumerate(base)] + [base[0][:300] + " " + base[1][:300], "x" * 5000, "word " * 4000, "é" * 700]
    out += [base[2]] * 5
    return out


@pytest.fixture(scope="session")
def rows():
    """doc_id, text and the rest: nulls in any column, ties, repeated rows, very long texts, clashing names."""
    out = []
    for i, t in enumerate(_texts()):
        out.append((i, t, [None, "en", "de"][i % 3], [None, "a", "b", "", "Ä"][i % 5], None, i, None, None, 3, "t"))
    return [*out, out[9], out[9], (None, "no id", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
