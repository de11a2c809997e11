import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h long, size string, score string, gone string, doc string, n_lines string, own string, of string, taken string, lost string, left string, row string, many string, counted string, license string, host string, evidence string"


def sentence(rnd, n):
    return " ".join("".join(rnd.choice(("ba", "lo", "ti", "re", "su", "mon", "da", "ker")) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Awkward rows: nulls everywhere, empty and long texts, ties, repeated rows, clashing names."""
    rnd = random.Random(3)
    base = [sentence(rnd, 60) for _ in range(12)]
    rows = [(i, t + "\n" + sentence(rnd, 8), "xx" if i % 2 else "yy", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(20, base[0], "yy", "s0", None), (21, base[0], "yy", "s0", 5), (22, base[1] + " ti", None, None, 5)]
    rows += [(23, None, "xx", "s1", 0), (24, "", "xx", "s1", 0), (25, " \t\n\n ", "yy", None, 5), (26, "123 !!", "yy", "s2", 6), (27, "da", "xx", "s2", 2)]
    rows += [(None, base[2], "xx", "s0", 1), (None, None, None, None, None), rows[3], rows[3]]
    rows += [(30, sentence(rnd, 30_000), "xx", "s1", 9)]
    return spark.createDataFrame([(*r, "a", 1, "b", "c", "d", "e", "f", "g", *"hijklmnopq") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
