import random

import pytest

from transit_spark.llm.common import ship_code

#: Names that operators use inside; inputs that have them too must do no harm.
CLASHING = "size string, slot string, node string, chunk string, tie string, words string, taken string, component string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_code(spark)


def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, NULLs, empty, blank and long texts."""
    rng = random.Random(7)
    words = ["the", "of", "and", "river", "stone", "Light", "über", "niño", "walks", "slowly", "42", "end."]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "", str(rng.randint(0, 99))]) for _ in range(n))

    base = [prose(rng.randint(20, 120)) for _ in range(12)]
    passage = prose(60)
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(base)]
    rows += [(20 + k, base[0], "en", "s0") for k in range(9)]  # exact copies
    for k in range(9):  # near copies
        w = base[1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((40 + k, " ".join(w), "en", "s1"))
    rows += [(60 + k, prose(15) + "\n" + passage + "\n" + prose(15), "en", None) for k in range(3)]
    rows += [(70, None, None, "s2"), (71, "", "en", "s2"), (72, " \n\t ", None, None), (73, "!!! 123", "en", "s0"), (74, "a", "en", "s0")]
    rows += [(75, "a\n" * 300 + prose(4000), "en", "s1"), (76, "x" * 5000, "en", "s0"), (77, "日本語の 文 ", None, "s9")]
    rows += [(80, base[2], "en", "s2"), (80, base[2], "en", "s2")]  # a repeated row
    rows += [(81, "one two three", "en", "s2"), (82, "One  two\tthree", "en", "s2"), (83, "one two", "en", "s2")]
    return rows


def frame(spark, rows, kind="doc_id long, text string, lang string, source string"):
    extra = [c.split()[0] for c in CLASHING.split(", ")]
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{kind}, {CLASHING}")


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, corpus()).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
