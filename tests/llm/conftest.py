import random

import pytest

CLASH = ["idx", "fp", "h", "key", "n", "size", "target", "shard", "slot", "draws", "row_id", "mix_shard", "words"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def sentence(rng, n=60):
    syllables = ["ba", "no", "ter", "li", "sun", "per", "do", "ka", "mi", "ro"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows():
    """Documents with every awkward case: nulls, empties, ties, repeats, a very long text, clashing columns."""
    rng = random.Random(4)
    texts = [sentence(rng, rng.randint(3, 200)).capitalize() + ".\nA second line of text here." for _ in range(40)]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i, t in enumerate(texts)]
    out += [(100, None, "en", "a"), (101, "", "en", "a"), (102, " \n\t ", None, None), (None, texts[3], "en", "b"), (None, None, None, None)]
    out += [(103, texts[0], "en", "a"), (104, texts[0], "de", None), (5, texts[5], "en", "a"), (5, texts[5], "en", "a")]
    out += [(105, sentence(rng, 60_000), "en", "a"), (106, "12345 !!! ###", "en", "c")]
    return [(*r, None, *["x"] * len(CLASH)) for r in out]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def make(spark):
    def build(texts, source=None, lang="en"):
        return spark.createDataFrame([(i, t, lang, source[i] if source else "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")

    return build
