"""The near-dedup stage against plain sets of shingles."""

import random

import pytest

import corpus_pipeline
from leafmill.llm import neardup
from tests.llm import brute


def _sets(texts):
    out = []
    for t in texts:
        w = [x for x in brute.lower(t).split() if x]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def _classes(texts):
    s = _sets(texts)
    return brute.components(len(s), [(i, j) for i in range(len(s)) for j in range(i) if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])])


def _texts(rnd):
    """Copies with up to 6 words changed, a passage that stands in every other text, short and empty texts."""
    word = lambda: f"w{rnd.randrange(3000)}"
    passage = " ".join(word() for _ in range(40))
    out = ["", None, " \n", "one two", "One  two", "one two three four five", "a b c d e f"]
    for k in range(40):
        base = [word() for _ in range(rnd.randint(20, 300))]
        for _ in range(6):
            x = list(base)
            for _ in range(rnd.randint(0, 6)):
                x[rnd.randrange(len(x))] = word()
            out.append(" ".join(x) + (" " + passage if k % 2 else ""))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("common", [0, neardup.KNOWN])
def test_all_pairs_of_the_similarity_are_found(common, spark, monkeypatch):
    monkeypatch.setattr(neardup, "KNOWN", common)
    texts = _texts(random.Random(7))
    of = _classes(texts)
    assert 40 < sum(of[i] != i for i in range(len(texts))) < len(texts) - 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {r["doc"]: r["label"] for r in neardup.classes(docs).collect()}
    least = {}
    for i in range(len(texts)):
        least.setdefault(made[i], i)
    assert [least[made[i]] for i in range(len(texts))] == of


def test_the_stage_keeps_the_first_of_each(spark):
    texts = _texts(random.Random(9))
    of = _classes(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    made = corpus_pipeline.near_dedup(spark, docs, "")
    assert made.columns == docs.columns
    assert sorted(r["doc_id"] for r in made.collect()) == [i for i in range(len(texts)) if of[i] == i]
