import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size string, label int, n_card int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared passages, nulls in every column, empty, blank and long texts, repeated rows."""
    base, shared = prose(1, 300), prose(2, 60)
    near = base.split(" ")
    near[150] = "changed"
    texts = {
        7: base, 3: base, 12: base.replace(" ", "  ", 1), 5: " ".join(near), 20: prose(3, 40) + " " + shared + " " + prose(4, 40),
        21: prose(5, 30) + "\n" + shared, 22: None, 23: "", 24: " \t\n", 25: "one", 26: "one", 27: "a b c", 28: "x " * 90,
        29: prose(6, 6000), 30: "Ünï code \U0001f600 " + prose(7, 30), 31: "tab\tand\x0bmore\x0c " + shared + "<|endoftext|> end",
        32: "call +1 (017) 555-7713 or 4929 3483 8514 6305, 4111111111111111, 10.0.0.1, 300.1.1.1, 2024-02-29, 31.02.2020, 03/04/2021, a.b1@mail.example.com",
        33: "Licensed under the Apache License, Version 2.0.", 34: prose(8, 20) + "\nReleased under the MIT License.",
    }
    out = [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in texts.items()]
    return [r + ("r", None, "s", None, 1) for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, NAMES).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], NAMES)
