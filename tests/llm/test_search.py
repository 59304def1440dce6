import math
import random
import re
from collections import Counter

import pytest

from strandwise.llm import search as module
from strandwise.llm.search import search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k=20):
    """Every item against every row."""
    words = [(d, Counter(plain_terms(t))) for d, t in docs]
    words = [(d, c, c.total()) for d, c in words if c]
    n_docs, n_terms = len(words), sum(n for _, _, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(plain_terms(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, c, n in words:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, (d is not None, d or 0), d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return out


def corpus():
    rng = random.Random(3)
    words = ["the", "The", "of", "zebra", "Ärger", "ärger", "don't", "x_y", "7", "naïve", "漢字", "rare1", "rare2", "rare3", "a"]
    docs = [(i, " ".join(rng.choices(words, weights=[20, 9, 15, 2, 2, 2, 3, 3, 3, 1, 1, 0.2, 0.2, 0.1, 9], k=rng.randint(0, 60)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, " \x00-_ "), (None, "zebra of the night"), (7, docs[7][1]), (7, "another text of a doc with id 7: zebra"), (503, "word " * 100_000 + "rare1")]
    docs += [(600 + i, "a tie between rows, rare2") for i in range(30)]
    items = [(0, "the THE zebra zebra"), (1, "rare1 rare2"), (2, None), (3, ""), (4, "nowhere"), (5, "ärger Ärger ÄRGER"), (None, "of a naïve 漢字"), (0, "x_y"), (6, "a")]
    return docs, items


def frames(spark, docs, items):
    clash = "bucket string, term string, tf string, n string, row_id string, w string"
    return (
        spark.createDataFrame([(*d, *"abcdef") for d in docs], f"doc_id long, text string, {clash}").repartition(3),
        spark.createDataFrame([(*i, *"abcdef") for i in items], f"item_id long, text string, {clash}"),
    )


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_against_every_pair(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(module, "BROADCAST_BYTES", broadcast_bytes)
    docs, items = corpus()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, search(*frames(spark, docs, items)).collect()), key=key) == sorted(plain_search(docs, items), key=key)


def test_terms_are_the_class_of_the_contract():
    text = "".join(chr(c) for c in range(0x250)) + " Mixed-CASE ÀÉ d'où 漢字，かな \U0001f600x"
    assert [t.decode() for t in terms_of(text)] == plain_terms(text)
    assert terms_of(None) == terms_of("") == []


def test_empty_sides(spark):
    docs, items = frames(spark, [], []), frames(spark, *corpus())
    assert search(docs[0], items[1]).count() == 0 and search(items[0], docs[1]).count() == 0


def test_fewer_and_more_rows_than_asked_for(spark):
    docs, items = frames(spark, [(3, "x y"), (1, "x"), (2, "x")], [(9, "x")])
    assert [r["doc_id"] for r in search(docs, items, k=2).orderBy("rank").collect()] == [r[2] for r in plain_search([(3, "x y"), (1, "x"), (2, "x")], [(9, "x")], 2)]
