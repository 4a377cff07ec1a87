import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that the operators use inside, and that must not matter in a table.
CLASHING = "doc id row text_ size_ target_ taken_ hash owner drops g b r s e n set label score_ kept range extra next_text keys cells component".split()

SYLLABLES = "an the re st on ing ed tion ou er ha wh le pa ch".split()


def prose(rng, words):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def corpus(seed, n=60):
    """Documents with copies, near copies, shared lines, empty, blank, null and long ones."""
    rng = random.Random(seed)
    shared = [prose(rng, 12) for _ in range(3)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.3 and (t := rng.choice(texts)):
            w = t.split(" ")
            w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
        else:
            texts.append("\n".join(rng.choice([*shared, *(prose(rng, rng.randrange(1, 40)) for _ in range(4))]) for _ in range(rng.randrange(1, 7))))
    texts[3:3] = ["", None, " \t\n", "x", "Ünïcode ÄÖ " * 30, "same same " * 3000, prose(rng, 9000)]
    ids = rng.sample(range(5 * len(texts)), len(texts))
    return [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t or "")) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, extra=False):
        from pyspark.sql import functions as F

        d = spark.createDataFrame(rows, SCHEMA)
        return d.withColumns({c: F.lit(1) for c in CLASHING}) if extra else d

    return make
