"""What leaves a place of the near-dedup join, and the fingerprints that go before it."""

import random

import numpy as np
import pandas as pd

from leafmill.llm import neardup


def _texts(k, rnd, n):
    return [" ".join(["all of them say this", *(f"w{rnd.randrange(10**6)}" for _ in range(n + i % 40))]) for i in range(k)]


def test_unrelated_sets_do_not_leave_a_place_in_pairs():
    rnd = random.Random(3)
    for n in (30, 300, 3000):
        texts = _texts(60, rnd, n)
        near = texts[0].split()
        near[40 % len(near)] = "other"
        sets = [neardup.shingles(t) for t in [*texts, " ".join(near)]]
        rows = pd.DataFrame({"key": 7, "node": np.arange(len(sets)), "n": [len(s) for s in sets], "at": 0, "label": np.arange(len(sets)), "bits": [neardup._bits(s) for s in sets]})
        made = {p for x in neardup._across(iter([rows])) for p in zip(x["a"].tolist(), x["b"].tolist(), strict=True)}
        alike = {(i, j) for j in range(len(sets)) for i in range(j) if neardup.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
        assert alike <= made and len(made) <= len(alike) + 5


def test_bitmaps_of_any_two_sizes_rule_out_no_similar_pair():
    rnd = np.random.default_rng(4)
    for n in (3, 200, 255, 256, 1000, 1023, 4100, 20_000):
        s = np.unique(rnd.integers(0, 1 << 64, n, np.uint64))
        t = np.unique(np.r_[s[: len(s) - len(s) // 10], rnd.integers(0, 1 << 64, n // 10, np.uint64)])
        bits = np.array([neardup._bits(s), neardup._bits(t)], object)
        apart = int(neardup._apart(bits)(np.array([0]), np.array([1]))[0])
        assert apart <= len(np.setxor1d(s, t))


def test_fingerprints_bring_near_copies_together(spark):
    rnd = random.Random(5)
    base = _texts(6, rnd, 400)
    copies = [t + " end" for t in base]
    sets = [neardup.shingles(t) for t in base + copies]
    rows = [(neardup._node(s), neardup._fingerprint(s)) for s in sets]
    marks = spark.createDataFrame(rows, "node long, fp long")
    wanted = {tuple(sorted((rows[i][0], rows[i + 6][0]))) for i in range(6) if (rows[i][1] ^ rows[i + 6][1]).bit_count() <= 3}
    assert wanted and {(r["a"], r["b"]) for r in neardup._alike(marks).collect()} >= wanted
