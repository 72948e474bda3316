"""Near-duplicate documents: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by SimHash and, for what its radius does not reach, an exact prefix-filtered set join.

1. A text becomes the set of the 64-bit hashes of its runs of five words (A-Z lower-cased; a text of fewer words is one run). Equal sets are one node. Each has a fingerprint, of all bits that over half its shingles have; nodes whose fingerprints differ in three bits or fewer meet by the generalised pigeonhole principle (`simhash.links`), and pairs that are similar enough as sets, too, are links.
2. All shingles have one order: those that a sample of documents shows to be common come last. Of two sets that are similar enough, the first shingles in that order (a fifth of each set, and one) share one. The sample only makes places small; what is found does not depend on it.
3. Of two sets that meet at a shingle, bitmaps are compared first: each shingle turns one bit, of as many as the set is large (256 to 4096), so the bits that differ are no more than the shingles that differ. What this cannot rule out is compared whole; sets are made anew from the texts for that, and are never all written, and pairs of large sets are compared in rounds. Pairs are told in two steps: first each with one of the place, in a star. The components of what is similar are then left out, and all pairs of different components are compared, as far as sizes and places in the order allow for the similarity. Bitmaps stand with the rows of a place there, so that only pairs they cannot rule out leave it: pairs grow with the square of how often a shingle stands, rows do not.
4. Components of the verified links. Of each, the document with the smallest id stays.

Texts without words (null and empty ones) are alike. Long texts are sets of any size. Rows with the same id are separate rows; null ids come last; of equal rows one stays, and of rows with one id and equal sets any one. An empty table gives no rows. Columns of other names pass through, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm import simhash
from leafmill.llm.common import cut, drop, free, meet
from leafmill.llm.components import components
from leafmill.llm.linededup import _runs
from leafmill.llm.substring import _hashes, rolling

SHINGLE = 5
#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
SEED = 42
#: Documents looked at for common shingles, in how many of them one is common, and how many are put in order.
SAMPLE, COMMON, KNOWN = 20_000, 5, 100_000
#: Bitmaps have two to the power of this bits, at least and at most.
LEAST, BITS = 8, 12
#: Bytes of sets that one round of comparing pairs moves at least; more where all sets together have four times as many.
ROUND = 256_000_000
#: Nodes a task remembers having sent, and pairs it gathers before it hands them on.
SEEN, HELD = 300_000, 1_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None) -> np.ndarray:
    """The set of shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return np.unique(rolling(_hashes(words), min(SHINGLE, len(words)))) if words else np.zeros(0, np.uint64)


def _node(own: np.ndarray) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(own.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def _bits(own: np.ndarray) -> bytes:
    """A bitmap in which each shingle has turned one bit. Its halves, one turned by the other, are the bitmap of half as many bits."""
    k = min(max(len(own).bit_length(), LEAST), BITS)
    at = (own >> np.uint64(64 - BITS)).astype(np.int64) & ((1 << k) - 1)
    return np.packbits(np.bincount(at, minlength=1 << k) & 1).tobytes()


def _apart(bits: np.ndarray):
    """A function of places i and j in bits: in how many bits the bitmaps there differ, at the size of the smaller one."""
    size = np.fromiter(map(len, bits), np.int64, len(bits))
    levels, rows, words = {}, np.zeros(0, np.int64), None
    for n in np.unique(size)[::-1].tolist():
        while words is not None and words.shape[1] * 8 > n:
            half = words.shape[1] // 2
            words = words[:, :half] ^ words[:, half:]
        own = np.flatnonzero(size == n)
        new = np.frombuffer(b"".join(bits[own]), np.uint64).reshape(len(own), -1)
        rows, words = np.r_[rows, own], new if words is None else np.concatenate([words, new])
        at = np.zeros(len(bits), np.int64)
        at[rows] = np.arange(len(rows))
        levels[n] = at, words

    def count(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        least, out = np.minimum(size[i], size[j]), np.zeros(len(i), np.int64)
        for n, (at, words) in levels.items():
            own = np.flatnonzero(least == n)
            for k in range(0, len(own), 20_000):
                x = own[k : k + 20_000]
                out[x] = np.bitwise_count(words[at[i[x]]] ^ words[at[j[x]]]).sum(axis=1, dtype=np.int64)
        return out

    return count


def _near(apart, n, m):
    """Whether sets of n and m shingles can be similar enough that differ in so many at least."""
    return (OVER + UNDER) * apart <= (UNDER - OVER) * (n + m)


def _fingerprint(own: np.ndarray) -> int:
    """A bit is set if over half the shingles have it."""
    count = np.zeros(simhash.BITS, np.int64)
    for i in range(0, len(own), 65536):
        count += simhash._bits(own[i : i + 65536].view(np.int64)).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(own)).view(">i8")[0])


@F.pandas_udf(T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bits", T.BinaryType()), T.StructField("fp", T.LongType())]))
def sets(texts: pd.Series) -> pd.DataFrame:
    own = [shingles(t) for t in texts]
    return pd.DataFrame({"node": np.array([_node(x) for x in own], np.int64), "n": np.array([len(x) for x in own], np.int32), "bits": [_bits(x) for x in own], "fp": np.array([_fingerprint(x) for x in own], np.int64)})


@F.pandas_udf(T.LongType())
def node(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([_node(shingles(t)) for t in texts], np.int64))


def prefix(n: int) -> int:
    """How many shingles of a set of n, in any one order, share one with those of each set that is similar enough."""
    return n - -(-n * OVER // UNDER) + 1 if n else 0


def similar(both, n, m):
    """Whether sets of n and m shingles with so many in common are similar enough."""
    return (OVER + UNDER) * both >= OVER * (n + m)


def _common(docs: DataFrame, n: int) -> np.ndarray:
    """Common shingles, the commonest last."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for i in range(0, len(x), 500):
                yield pd.DataFrame({"h": np.concatenate([shingles(t) for t in x["text"].iloc[i : i + 500]]).view(np.int64)})

    some = docs.select("text").sample(min(1.0, SAMPLE / max(n, 1)), seed=SEED)
    counted = some.mapInPandas(each, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = counted.orderBy(F.desc("n"), "h").limit(KNOWN).toPandas()
    return found["h"].to_numpy(np.int64)[::-1].copy().view(np.uint64)


def _entries(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """key, node, n (shingles of the set), at (place in the order): the prefix of each set, once a task as far as it remembers."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = np.argsort(common, kind="stable")
        known = common[order]
        seen: set[int] = set()
        for x in batches:
            for i in range(0, len(x), 1000):
                out, ids, sizes, at = [], [], [], []
                for t in x["text"].iloc[i : i + 1000]:
                    s = shingles(t)
                    if (k := _node(s)) in seen:
                        continue
                    seen.add(k)
                    if len(known):
                        p = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        s = s[np.argsort(np.where(known[p] == s, order[p] + 1, 0), kind="stable")]
                    size = prefix(len(s))
                    out.append(s[:size])
                    ids.append(np.full(size, k, np.int64))
                    sizes.append(np.full(size, len(s), np.int32))
                    at.append(np.arange(size, dtype=np.int32))
                if len(seen) > SEEN:
                    seen.clear()
                if out:
                    yield pd.DataFrame({"key": np.concatenate(out).view(np.int64), "node": np.concatenate(ids), "n": np.concatenate(sizes), "at": np.concatenate(at)})

    return docs.select("text").mapInPandas(make, "key bigint, node bigint, n int, at int")


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by key and node, those at places with two nodes or more."""
    for x in _runs(batches, ["key"]):
        k, v = x["key"].to_numpy(), x["node"].to_numpy()
        x = x[np.r_[True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])]]
        k = x["key"].to_numpy()
        run = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1
        yield x[np.bincount(run)[run] > 1]


def _may(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets can be similar enough of which this is the first shingle in common."""
    return similar(1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1, n[i], n[j])


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node of a place with the first one."""
    for x in _runs(batches, ["key"]):
        k, v, n, at = (x[c].to_numpy() for c in ("key", "node", "n", "at"))
        new = np.r_[True, k[1:] != k[:-1]]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        i = np.flatnonzero(~new)
        i = i[_may(n, at, i, first[i])]
        yield pd.DataFrame({"a": v[first[i]], "b": v[i]}).drop_duplicates()


def _mixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by key and label, those at places with two labels or more."""
    for x in _runs(batches, ["key"]):
        k, label = x["key"].to_numpy(), x["label"].to_numpy()
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        last = np.r_[first[1:], len(k)] - 1
        yield x[np.repeat(label[first] != label[last], last - first + 1)]


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of nodes with different labels at a place that their bitmaps do not rule out; rows are sorted by key and label."""
    for x in _runs(batches, ["key"]):
        k, v, n, at, label = (x[c].to_numpy() for c in ("key", "node", "n", "at", "label"))
        size, apart = n.astype(np.int64), _apart(x["bits"].to_numpy())
        run = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1
        end = np.cumsum(np.bincount(run))[run]
        group = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (label[1:] != label[:-1])]) - 1
        after = np.cumsum(np.bincount(group))[group]  # where the next label begins
        a, b, held = [], [], 0
        todo = np.flatnonzero(after < end)
        j = after[todo]
        while len(todo):
            ok = np.flatnonzero(_may(n, at, todo, j))
            ok = ok[_near(apart(todo[ok], j[ok]), size[todo[ok]], size[j[ok]])]
            a.append(np.minimum(v[todo[ok]], v[j[ok]]))
            b.append(np.maximum(v[todo[ok]], v[j[ok]]))
            held += len(ok)
            if held > HELD:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()
                a, b, held = [], [], 0
            j = j + 1
            left = j < end[todo]
            todo, j = todo[left], j[left]
        if held:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        ok = []
        for s, t in zip(x["s"], x["t"], strict=True):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            ok.append(similar(int((t[at] == s).sum()), len(s), len(t)))
        yield x.loc[np.array(ok, bool), ["a", "b"]]


def _possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose bitmaps differ in no more bits than sets may differ in shingles."""
    for x in batches:
        if len(x):
            i = np.arange(len(x))
            apart = _apart(np.r_[x["s"].to_numpy(), x["t"].to_numpy()])(i, i + len(x))
            yield x.loc[_near(apart, x["n"].to_numpy(np.int64), x["m"].to_numpy(np.int64)), ["a", "b", "n", "m"]]


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, own: the sets of wanted nodes, made of the texts of one document each (or of those that share its id)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for i in range(0, len(x), 500):
                own = [shingles(t) for t in x["text"].iloc[i : i + 500]]
                yield pd.DataFrame({"node": np.array([_node(s) for s in own], np.int64), "own": [s.tobytes() for s in own]})

    chosen = cut(nodes.select("node", "d").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("d").alias("d")).select("d").distinct())
    made = meet(docs, chosen, ["d"], "d").select("text").mapInPandas(make, "node bigint, own binary")
    return cut(made.join(wanted, "node", "left_semi").dropDuplicates(["node"]))


def verify(pairs: DataFrame, docs: DataFrame, marks: DataFrame, nodes: DataFrame, compared: bool = False) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. docs: d, text; marks: node, n, bits; nodes: node, d; compared: whether bitmaps have been already. Sets of up to a fourth of the bytes of all (or ROUND) move at a time."""
    spark = docs.sparkSession
    pairs = cut(pairs.distinct())
    of = lambda c, n, bits: marks.select(F.col("node").alias(c), F.col("n").alias(n), *[] if compared else [F.col("bits").alias(bits)])
    both = pairs.join(of("a", "n", "s"), "a").join(of("b", "m", "t"), "b")
    left = cut(both.select("a", "b", "n", "m") if compared else both.select("a", "b", "n", "m", "s", "t").mapInPandas(_possible, "a bigint, b bigint, n int, m int"))
    drop(pairs)
    own = _sets_of(docs, nodes, cut(left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()))
    total = left.agg(F.sum(8 * (F.col("n").cast("long") + F.col("m")))).first()[0] or 0
    every = marks.agg(F.sum(8 * F.col("n").cast("long"))).first()[0] or 0
    rounds = max(1, -(-total // max(ROUND, every // 4)))
    made = []
    for r in range(rounds):
        now = left.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == r).select("a", "b")
        met = now.join(own.select(F.col("node").alias("a"), F.col("own").alias("s")), "a").join(own.select(F.col("node").alias("b"), F.col("own").alias("t")), "b")
        made.append(cut(met.select("a", "b", "s", "t").mapInPandas(_verified, "a bigint, b bigint")))
        free(spark)
    drop(left, own)
    return reduce(DataFrame.unionByName, made)


def _alike(marks: DataFrame) -> DataFrame:
    """a, b: a star of the nodes of each fingerprint, and the links of fingerprints (`simhash.links`) as links of their first nodes."""
    first = cut(marks.groupBy("fp").agg(F.min("node").alias("b")))
    equal = marks.join(first, "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    found = simhash.links(first.select("fp")).withColumnsRenamed({"a": "f", "b": "g"})
    linked = found.join(first.select(F.col("fp").alias("f"), F.col("b").alias("a")), "f").join(first.select(F.col("fp").alias("g"), "b"), "g").select("a", "b")
    return equal.unionByName(linked).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: similar nodes, such that their components are those of all similar pairs. docs: d, text; nodes: node, d, n, bits, fp."""
    spark = docs.sparkSession
    marks = cut(nodes.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "bits", "fp")]))
    alike = verify(_alike(marks), docs, marks, nodes)
    common = _common(docs, nodes.count())
    entries = _entries(docs, common)
    columns = "key bigint, node bigint, n int, at int"
    shared = cut(entries.repartition("key").sortWithinPartitions("key", "node").mapInPandas(_shared, columns))
    free(spark)

    def told(known: DataFrame) -> DataFrame:
        """The rows at places of two labels or more by the links known."""
        of = shared.join(components(known), "node", "left").select("key", "node", "n", "at", F.coalesce("label", "node").alias("label"))
        made = cut(of.repartition("key").sortWithinPartitions("key", "label", "node").mapInPandas(_mixed, f"{columns}, label bigint"))
        free(spark)
        return made

    some = told(alike)
    near = verify(some.repartition("key").sortWithinPartitions("key", "node").mapInPandas(_stars, "a bigint, b bigint"), docs, marks, nodes)
    drop(some)
    rest = told(alike.unionByName(near))
    drop(shared)
    dealt = rest.join(marks.select("node", "bits"), "node").repartition("key").sortWithinPartitions("key", "label", "node")
    far = verify(dealt.mapInPandas(_across, "a bigint, b bigint"), docs, marks, nodes, compared=True)
    drop(rest)
    return alike.unionByName(near).unionByName(far)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, node, label for each row of docs; label is the smallest node reachable over similar pairs."""
    d = F.xxhash64(F.col(key)).alias("d")  # also of a null id
    made = cut(docs.select(F.col(key).alias("doc"), d, sets(F.col(text)).alias("s")).select("doc", "d", "s.node", "s.n", "s.bits", "s.fp"))
    found = components(links(docs.select(d, F.col(text).alias("text")), made))
    return made.select("doc", "node").join(found, "node", "left").select("doc", "node", F.coalesce("label", "node").alias("label"))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the row with the smallest id (of several such rows, one)."""
    least = classes(docs, key, text).groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("unknown"), "doc", "node")).alias("r"))
    found = least.select("r.doc", "r.node")
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), node(F.col(text)).alias("own_node"))
    kept = own.join(found, F.col("row")[key].eqNullSafe(F.col("doc")) & (F.col("own_node") == F.col("node")), "left_semi")
    one = kept.withColumn("id", F.col("row")[key]).dropDuplicates(["id", "own_node"])
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])
