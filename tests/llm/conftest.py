import random

import pytest


def words(rng, n, vocabulary=40):
    return [f"{'Ww'[rng.random() < 0.8]}{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, empty, blank and long texts, repeats and clashing extra columns."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = base[:60] + ["changed"] + base[61:]
    rows = [
        (1, " ".join(base), "en", "a", 0, 7, 1.5), (2, " ".join(near), "en", None, 0, None, None),
        (3, " ".join(base), None, "a", 0, 7, 1.5), (3, " ".join(base), None, "a", 0, 7, 1.5),
        (4, None, "en", "a", None, 7, None), (5, "", "en", "a", 0, 7, None), (6, " \n\t ", None, None, 0, 7, None),
        (None, " ".join(base[:50]), "en", "a", 0, 7, None), (None, None, None, None, None, None, None),
        (7, "one two", "de", "b", 0, 7, None), (8, "One  two", "de", "b", 0, 7, None), (9, "x", "de", "b", 0, 7, None),
        (10, " ".join(words(rng, 9000, 5000)), "fr", "b", 0, 7, None),
        (11, " ".join(["again and again the same line here"] * 30), "fr", "b", 0, 7, None),
        (12, "é" * 5000 + "\n" + "Ünï <|endoftext|> cödé 's 12", "fr", "b", 0, 7, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, block long, n_words double"
    return spark.createDataFrame(rows, schema)
