"""SimHash near-duplicates by the generalised pigeonhole principle.

1. A fingerprint of 64 bits for each text, by numpy over Arrow batches. Equal fingerprints collapse to one row with a map-side combine, so that a group of copies is one row from there on.
2. Bits are grouped into partitions by their correlation over all fingerprints (64 x 64 counts), correlated ones together.
3. A histogram of the values of each partition (at most 65,536 bins each) over all fingerprints tells how many candidates a probe of radius r would read there. For each fingerprint dynamic programming picks radii, -1 (skip) to 3, that sum to 3 - m + 1 over the m partitions and read the fewest candidates; by the principle every fingerprint within 3 bits is then found.
4. Index and probe rows meet by partition and value; pairs are verified by their bit difference. A meeting place with many rows is split into blocks that meet two by two in tasks of bounded size, and each place hands on a spanning star of its links, never all pairs.
5. Components of the stars; all links between different fingerprints are in them.

Null text, and text without words (an empty one, too), has fingerprint zero and links like any other. Long texts are hashed whole, in one row. Rows with the same id are separate rows, equal ones included; ties cannot be, as a component is named by its smallest id (null ids name none). An empty table gives no rows. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import cut
from leafmill.llm.components import components

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Rows that one meeting place compares with one another; larger ones are split into blocks of half of it.
PLACE = 1024
#: Histograms have two to the power of this bins a partition.
BINS = 16


def _fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % s for s in zip(words, words[1:], words[2:], strict=False)]
    of = xxhash.xxh64_intdigest
    h = np.fromiter((of(s, SEED) for s in shingles), np.uint64, len(shingles))
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65536):
        count += np.unpackbits(h[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h)).view(">i8")[0])


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """The fingerprint as a signed long with the same 64 bits."""
    return pd.Series(np.fromiter(map(_fingerprint, texts), np.int64, len(texts)))


def _bits(fps: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones, highest bit first, for each fingerprint."""
    return np.unpackbits(fps.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def _values(fps: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    bits = _bits(fps)
    return [(bits[:, g].astype(np.int64) << np.arange(len(g))).sum(axis=1) for g in groups]


def co_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set, for all i and j."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS), np.int64)
        for x in batches:
            for i in range(0, len(x), 100_000):
                b = _bits(x["fp"].to_numpy()[i : i + 100_000]).astype(np.float32)
                total += np.rint(b.T @ b).astype(np.int64)
        yield pd.DataFrame({"i": np.arange(BITS * BITS), "n": total.ravel()})

    rows = fps.select("fp").mapInPandas(count, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for r in rows:
        out[r["i"]] = r["n"]
    return out.reshape(BITS, BITS)


def group_bits(co: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits: each starts with the strongest correlation left and takes in the bit that correlates best with it."""
    p = np.diag(co) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    r = np.abs(co / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(r, -1)
    left, groups = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        free = sorted(left)
        sub = r[np.ix_(free, free)]
        i, j = divmod(int(sub.argmax()), len(free))
        g = [free[i], free[j]] if size > 1 else [free[i]]
        while len(g) < size:
            rest = [b for b in free if b not in g]
            g.append(rest[int(r[np.ix_(rest, g)].sum(axis=1).argmax())])
        groups.append(g)
        left -= set(g)
    return groups


@cache
def _ball(width: int, radius: int) -> np.ndarray:
    """The masks with exactly radius of width bits set."""
    from itertools import combinations

    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


def reach(hist: np.ndarray) -> np.ndarray:
    """Candidates within radius 0 to 3 of each value, from the histogram of a partition's values."""
    bits = int(hist.size).bit_length() - 1
    at = np.arange(hist.size)
    near = lambda x: sum(x[at ^ (1 << b)] for b in range(bits))
    one = near(hist)
    two = (near(one) - bits * hist) / 2
    three = (near(two) - (bits - 1) * one) / 3
    return np.cumsum([hist, one, two, three], axis=0)


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """Radii (m, n) of least cost that sum to total, from costs (m, 5, n) of radius -1 to 3, by dynamic programming over the partitions."""
    m, _, n = costs.shape
    span = np.arange(-m, total + m + 1)  # sums that can still end at total
    best = np.full((len(span), n), np.inf)
    best[m] = 0.0  # sum 0
    took = []
    for i in range(m):
        new, how = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for r in range(-1, RADIUS + 1):
            moved = np.full_like(best, np.inf)
            if r >= 0:
                moved[r:] = best[: len(span) - r]
            else:
                moved[:r] = best[-r:]
            moved = moved + costs[i, r + 1]
            less = moved < new
            new, how = np.where(less, moved, new), np.where(less, np.int8(r), how)
        best = new
        took.append(how)
    at = np.full(n, m + total)
    out = np.zeros((m, n), np.int8)
    for i in reversed(range(m)):
        out[i] = took[i][at, np.arange(n)]
        at = at - out[i]
    return out


def parts_for(n: int) -> int:
    """Partitions such that a value has few dozen fingerprints on average."""
    return 4 if n <= 1 << 22 else 3 if n <= 1 << 27 else 2


def _entries(fps: DataFrame, groups: list[list[int]], near: list[np.ndarray]) -> DataFrame:
    """part, value, fp: each fingerprint under its own value in each partition (index), and under those its probes read."""
    m = len(groups)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = [np.concatenate([_ball(len(g), r) for r in range(RADIUS + 1)]) for g in groups]
        ends = [np.cumsum([len(_ball(len(g), r)) for r in range(RADIUS + 1)]) for g in groups]
        for x in batches:
            for j in range(0, len(x), 20_000):
                fp = x["fp"].to_numpy()[j : j + 20_000]
                v = _values(fp, groups)
                costs = np.zeros((m, RADIUS + 2, len(fp)))
                for i in range(m):
                    costs[i, 1:] = near[i][:, v[i] & (len(near[i][0]) - 1)] + 4.0 * ends[i][:, None]
                radii = allocate(costs, RADIUS - m + 1)
                for i in range(m):
                    for r in range(-1, RADIUS + 1):
                        own = radii[i] == r
                        reads = masks[i][: ends[i][max(r, 0)]]  # the first mask is zero: the index row
                        yield pd.DataFrame({"part": np.int32(i), "value": (v[i][own][:, None] ^ reads).ravel(), "fp": np.repeat(fp[own], len(reads))})

    return fps.select("fp").mapInPandas(make, "part int, value bigint, fp bigint")


def _stars(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """A star for each component of the links a - b, which are places in fp."""
    label = np.arange(len(fp))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(fp)))
    return pd.DataFrame({"a": fp[own], "b": fp[label[own]]})


def _links(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Stars of the links within each run of equal keys; rows are sorted by key. Rows of two blocks meet across only."""
    fp, side = rows["fp"].to_numpy(), rows["side"].to_numpy()
    new = np.r_[True, (rows["part"].to_numpy()[1:] != rows["part"].to_numpy()[:-1]) | (rows["value"].to_numpy()[1:] != rows["value"].to_numpy()[:-1]) | (rows["place"].to_numpy()[1:] != rows["place"].to_numpy()[:-1])]
    run = np.cumsum(new) - 1
    size = np.bincount(run)[run]
    left = np.cumsum(np.bincount(run))[run] - np.arange(len(run)) - 1  # rows of the run that follow
    a, b, held = [], [], 0
    for k in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(left >= k)
        if not len(i):
            break
        j = i + k
        near = (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= RADIUS) & (fp[i] != fp[j]) & ((side[i] != side[j]) | (side[i] < 0))
        a.append(i[near])
        b.append(j[near])
        held += int(near.sum())
        if held > 2_000_000:
            yield _stars(fp, np.concatenate(a), np.concatenate(b))
            a, b, held = [], [], 0
    if held:
        yield _stars(fp, np.concatenate(a), np.concatenate(b))


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of a partition sorted by key: whole runs at a time."""
    rest = None
    keys = ["part", "value", "place"]
    for x in batches:
        x = x if rest is None else pd.concat([rest, x], ignore_index=True)
        last = (x[keys] == x[keys].iloc[-1]).all(axis=1).to_numpy()
        cut_at = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut_at:
            yield from _links(x.iloc[:cut_at])
        rest = x.iloc[cut_at:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield from _links(rest)


def links(fps: DataFrame, parts: int | None = None, place: int = PLACE) -> DataFrame:
    """a, b: fingerprints that differ in 3 bits or fewer; a spanning star of the links at each meeting place. fps: distinct fp."""
    n = fps.count()
    m = parts or parts_for(n)
    groups = group_bits(co_counts(fps), n, m)

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((m, 1 << BINS), np.int64)
        for x in batches:
            for i, v in enumerate(_values(x["fp"].to_numpy(), groups)):
                total[i] += np.bincount(v & ((1 << BINS) - 1), minlength=1 << BINS)
        i, v = np.nonzero(total)
        yield pd.DataFrame({"part": i.astype(np.int32), "bin": v, "n": total[i, v]})

    hist = np.zeros((m, 1 << BINS))
    counted = fps.select("fp").mapInPandas(bins, "part int, bin bigint, n bigint").groupBy("part", "bin").agg(F.sum("n").alias("n")).toPandas()
    hist[counted["part"].to_numpy(), counted["bin"].to_numpy()] = counted["n"].to_numpy()
    widths = [min(BINS, len(g)) for g in groups]
    # candidates spread evenly over the bits beyond the bins
    near = [reach(hist[i][: 1 << widths[i]]) / (1 << (len(g) - widths[i])) for i, g in enumerate(groups)]
    entries = _entries(fps, groups, near)
    half = place // 2
    hot = entries.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > place).select("part", "value", F.ceil(F.col("n") / half).cast("int").alias("blocks"))
    hot = cut(hot)
    # a value has at most 2^bits of a partition's width, and a hot one takes place rows: bounded where bins are exact, counted elsewhere
    bounded = hot.count() <= m << BINS
    placed = entries.join(F.broadcast(hot) if bounded else hot, ["part", "value"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("bigint")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct((F.least(own, y) * F.col("blocks") + F.greatest(own, y)).alias("place"), F.when(y == own, -1).when(own < y, 0).otherwise(1).alias("side")))
    placed = placed.select("part", "value", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(-1).alias("place"), F.lit(-1).alias("side")))).otherwise(pairs)).alias("p"))
    placed = placed.select("part", "value", "fp", "p.place", "p.side")
    dealt = placed.repartition("part", "value", "place").sortWithinPartitions("part", "value", "place")
    return dealt.mapInPandas(_meet, "a bigint, b bigint").distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, fp, label, component for each row of docs; label is the smallest fingerprint reachable over links, component the smallest id."""
    made = cut(docs.select(F.col(key).alias("doc"), fingerprint(F.col(text)).alias("fp")))
    fps = cut(made.groupBy("fp").agg(F.min("doc").alias("least")))
    found = components(links(fps))
    of = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = of.groupBy("label").agg(F.min("least").alias("component"))
    of = of.join(least, "label").select("fp", "label", "component")
    return made.join(of, "fp")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return classes(docs, key, text).select(F.col("doc").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
