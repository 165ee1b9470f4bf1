import random

import pytest

WORDS = "the of and to in is it was for on that by this with from they have had not are but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know get through back much before go good new write our used me man too any day same right look think also around another came come work three word must because does part even place well such here take why things help put years different away again off went old number great tell men say small every found still between name should home big give air line set own under read last never us left end along while might next sound below saw something thought both few those always looked show large often together asked house world going want school important until form food keep children feet land side without boy once animals life enough took four head above kind began almost live page got earth need far hand high year mother light parts country father let night following".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a long text, repeated rows, ties, and columns whose names clash with internal ones."""
    base = prose(1, 80)
    rows = [
        (1, base, "en", "a", 1, "x"),
        (2, base, "en", "a", 2, "x"),
        (3, base + " extra tail words here", "en", "a", 3, None),
        (4, None, "en", "b", None, "y"),
        (5, "", None, None, 0, "y"),
        (6, "  \n\t ", "fr", "b", 4, "z"),
        (7, prose(2, 30000), "en", "b", 5, "z"),
        (8, "one two", "en", "a", 6, None),
        (8, "one two", "en", "a", 6, None),
        (None, prose(3, 50), "en", "a", 7, "x"),
        (None, None, None, None, None, None),
        (9, "é日本 ß 👍\x00 end", "en", "b", 8, "q"),
        (10, "12345 !!! 678", "fr", "b", 9, "q"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, key string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
