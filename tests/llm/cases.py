"""Frames that every operator must stand: odd rows, clashing names, nothing."""

import random

WORDS = "the of and to in mill stone river green over hand light while under seven great paper".split()


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", ","]) for _ in range(words))


def odd_documents(spark, **more):
    """Nulls in every column, empty, blank, one-word and very long texts, ties and repeated rows."""
    long_text = prose(1, 40_000)
    rows = [
        (1, prose(2, 80), "a"), (2, None, "a"), (3, "", "b"), (4, "  \n\t ", None), (5, "word", "b"), (6, long_text, "a"),
        (7, prose(2, 80), "b"), (8, prose(3, 60), None), (8, prose(3, 60), None), (None, prose(4, 30), "a"), (None, None, None),
        (9, "\U0001f600 né́e ß   x" * 20, "c"), (10, prose(5, 500), "a"), (11, prose(5, 500) + " more", "a"),
    ]
    schema = "doc_id long, text string, source string, score double, size long, token string, `bucket.x` int, id string, lang string"
    return spark.createDataFrame([(*r, 0.5, 3, "t", 1, "z", "en") for r in rows], schema)


def no_documents(spark):
    return odd_documents(spark).limit(0)
