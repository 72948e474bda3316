"""Benchmark decontamination: a prefix-filtered set join between document shingles and benchmark windows.

A window is 8 consecutive words of an item (an item with fewer words is one window). Its shingles are its runs of three words (of all its words, where it has fewer). The windows are sets of shingles that have to be contained whole in a document window of the same size, so by the prefix principle, with shingles in the order of their rarity, a prefix of one is enough: the rarest.

1. Rarity: one pass over the documents, in stretches of words, counts the benchmark's shingles in the whole corpus. Only numbers leave a task, added up before they are shuffled. A window with a shingle that never occurs is out at once.
2. A second pass looks up the rarest shingle of each window alone. What matches goes to the shared folder with the words around it, so a shingle of a frequent phrase brings rows only where all of its window's shingles are as frequent.
3. Position and length bounds, then the exact comparison word by word.

Only built-in column functions run. The set that is looked up is counted: up to BLOCK shingles are broadcast; beyond, shingles are shuffled once, those of the benchmark under SALTS numbers, so that a frequent one is several smaller keys.

Null text has no words; empty texts have none either, and long ones are cut into stretches, so that rows stay small. Rows with the same doc_id are judged one by one, and equal rows have equal results; of ties in rarity the smaller hash is taken, which changes no result. Items without words match nothing; repeated item_ids count once, null ones not at all. Empty tables give no hits or no rows. Other columns are not read by `report` and pass through `clean`, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import SALTS, cut, doc_words, runs_of, stretches

WINDOW = 8
SHINGLE = 3
#: Items from which on the report calls a document contaminated; `clean` drops it for one.
MIN_ITEMS = 2
#: Shingles that are broadcast at most: 24 bytes each, so 24 MB.
BLOCK = 1_000_000


def _shingles(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.expr("array()").cast("array<bigint>"))


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, win (its words, space-joined), len: each different window of each item."""
    words = items.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), doc_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    starts = words.select("item", "w", n.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at"))
    return starts.select("item", F.array_join(F.slice("w", F.col("at"), F.col("len")), " ").alias("win"), "len").distinct()


def _window_shingles(windows: DataFrame) -> DataFrame:
    """win, len, k, h, o: each shingle of each different window with its offset."""
    w = windows.select("win", "len").distinct().select("win", "len", F.split("win", " ").alias("w"))
    of = F.when(F.col("len") >= SHINGLE, _shingles(F.col("w"), SHINGLE)).when(F.col("len") == 2, _shingles(F.col("w"), 2)).otherwise(_shingles(F.col("w"), 1))
    return w.select("win", "len", F.least("len", F.lit(SHINGLE)).alias("k"), F.posexplode(of).alias("o", "h"))


def _look_up(made: DataFrame, looked_up: DataFrame, block: int) -> DataFrame:
    """The rows of made whose h is among the column h of looked_up (null is equal to null)."""
    own = looked_up.select(F.col("h").alias("h2"))
    if own.count() <= block:
        return made.join(F.broadcast(own), F.col("h").eqNullSafe(F.col("h2")))
    own = own.withColumn("salt2", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    made = made.withColumn("salt", F.pmod(F.xxhash64("doc", "fp"), F.lit(SALTS)).cast("int"))
    return made.join(own, F.col("h").eqNullSafe(F.col("h2")) & (F.col("salt") == F.col("salt2"))).drop("salt", "salt2")


def _counted(spoken: DataFrame, shingles: DataFrame, sizes: list[int], block: int) -> DataFrame:
    """k, h, n: how often each shingle of the benchmark that occurs does so. An occurrence in several documents, or several times in one, counts each time."""
    parts = []
    for k in sizes:
        own = cut(shingles.where(F.col("k") == k).select("h").distinct())
        made = spoken.select("doc", "fp", F.explode(runs_of(F.col("s"), k)).alias("h"))
        parts.append(_look_up(made, own, block).groupBy("h").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "h", "n"))
    return reduce(DataFrame.unionByName, parts)


def _matches(spoken: DataFrame, prefix: DataFrame, k: int, every: bool, block: int) -> DataFrame:
    """Places of documents where the k-word shingle of a window's prefix stands, with the words around; if every, also a row with n_words for each document, at null."""
    around = WINDOW - 1
    looked_up = prefix.where(F.col("k") == k).select("h").distinct()
    if every:
        looked_up = looked_up.unionByName(prefix.sparkSession.createDataFrame([(None,)], "h bigint"))
    made = spoken.select("doc", "fp", "n_words", "s", runs_of(F.col("s"), k).alias("hs"))
    hashes = F.when(F.col("s.first") == 0, F.concat("hs", F.array(F.lit(None).cast("bigint")))).otherwise(F.col("hs")) if every else F.col("hs")
    made = made.select("doc", "fp", "n_words", "s", F.posexplode(hashes).alias("i", "h"))
    found = _look_up(made, cut(looked_up), block)
    at = F.when(F.col("h").isNotNull(), F.col("s.first") + F.col("i"))
    first = F.greatest(at - around, F.lit(0))
    return found.select("doc", "fp", F.lit(k).alias("k"), "h", at.alias("at"), first.alias("first"), F.when(at.isNotNull(), F.slice("s.w", first - F.col("s.base") + 1, F.lit(2 * around + SHINGLE))).alias("ctx"), "n_words")


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents: doc, fp, n_words; hits: doc, fp, item, win, start, len). fp tells rows with the same id apart."""
    windows = cut(benchmark_windows(items))
    shingles = cut(_window_shingles(windows))
    sizes = sorted(r["k"] for r in shingles.select("k").distinct().collect())  # 1 to 3
    spoken = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("fp"), doc_words(F.col(text)).alias("w"))
    spoken = spoken.select("doc", "fp", F.size("w").alias("n_words"), F.explode(stretches(F.col("w"), WINDOW - 1, WINDOW + SHINGLE - 1)).alias("s"))
    rarity = cut(_counted(spoken, shingles, sizes or [SHINGLE], block))
    counted = shingles.join(rarity, ["k", "h"], "left")
    rarest = counted.groupBy("win", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "h", "o", "k")).alias("p")).where("p.n > 0")
    prefix = cut(rarest.select("win", "len", F.col("p.k").alias("k"), F.col("p.h").alias("h"), F.col("p.o").alias("o")))
    used = [k for k in sizes if k == SHINGLE or not prefix.where(F.col("k") == k).isEmpty()]
    matches = cut(reduce(DataFrame.unionByName, [_matches(spoken, prefix, k, k == SHINGLE, block) for k in sorted({*used, SHINGLE})]))
    places = matches.where(F.col("at").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("doc", "fp", "at"), F.lit(SALTS)).cast("int"))
    start = F.col("at") - F.col("o")
    small = prefix.count() <= block
    met = places.join(F.broadcast(prefix), ["k", "h"]) if small else places.join(prefix.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))), ["k", "h", "salt"])
    candidates = met.where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    verified = candidates.where(F.array_join(F.slice("ctx", start - F.col("first") + 1, F.col("len")), " ") == F.col("win"))
    hits = verified.select("doc", "fp", "win", start.alias("start"), "len").distinct()
    return matches.where(F.col("at").isNull()).select("doc", "fp", "n_words"), hits.join(windows.select("item", "win"), "win")


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: n_words, n_hit, n_items, items_sha256, contaminated."""
    every, hits = find(docs, items, key, text)
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"))))
    by = hits.groupBy("doc", "fp").agg(spans.alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    n_hit = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n")))["n"]
    by = by.select(F.col("doc").alias("d2"), F.col("fp").alias("f2"), n_hit.alias("hit"), "items")
    joined = every.join(by, F.col("doc").eqNullSafe(F.col("d2")) & (F.col("fp") == F.col("f2")), "left")
    n_items = F.coalesce(F.size("items"), F.lit(0))
    return joined.select(
        F.col("doc").alias(key), F.col("n_words").cast("long").alias("n_words"), F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(n_items).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.col("items").isNotNull() & (F.size("items") >= MIN_ITEMS)).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that hold no window of any item."""
    _, hits = find(docs, items, key, text)
    bad = hits.select("doc", "fp").distinct()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    kept = rows.join(bad, F.col("row")[key].eqNullSafe(F.col("doc")) & (F.xxhash64(F.col("row")[text]) == F.col("fp")), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len, array_to_string(w[i:i + len - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS len, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len FROM bw),
pl AS (SELECT doc_id, len, w, unnest(range(1, len(w) - len + 2)) AS i FROM d, sizes WHERE len(w) >= len),
hit AS (SELECT doc_id, i, p.len, item_id FROM (SELECT doc_id, i, len, array_to_string(w[i:i + len - 1], ' ') AS win FROM pl) p JOIN bw ON p.len = bw.len AND p.win = bw.win),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT DISTINCT doc_id, i, len FROM hit) h, range({WINDOW}) r(k) WHERE k < h.len) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= {MIN_ITEMS} AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
