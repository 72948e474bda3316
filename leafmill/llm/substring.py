"""Substring dedup: words that repeat an earlier passage of 20 words or more go, by fixed-block anchors.

1. Each document is cut into non-overlapping blocks of ten words (the reference blocks), and every rolling window of ten words probes them. A repeated passage of 20 words holds a whole block of the earlier place, wherever it starts in the later. Hashes travel packed, sorted and parted by their upper bits: about seven bytes a probe. A batch sends a hash once, with all its places, so that a passage in a third of all documents stays a few entries.
2. Places where a block and a probe of another place meet are the hits. Only windows of 20 words that hold a hit are candidates; hits extend over all of them.
3. Candidates are matched by a hash of 128 bits of their 20 words: two of 64 bits, each over hashes of the words of its own. Of each sequence the first place, by document and start, stays, and every later one covers its words. Neighbouring windows together are the maximal repeats: instead of extending each pair of a block and a probe word by word, which for a passage in a third of all documents would be all pairs of them, all windows around all hits are matched at once.

A part is a range of hashes. How many there are follows from the length of all texts, so that a part stays the same size however much is read; a task holds one part.

Null text has no words, like an empty one; long texts are batches of their own. Documents come in the order of their ids, null first, then of their texts' hashes, so there are no ties. Equal rows (id and text) count as one document. An empty table gives no rows. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, free, partitions

WINDOW = 20
ANCHOR = WINDOW // 2
#: Words of one packed batch.
BATCH = 1_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
#: Hashes of blocks and probes travel with 48 bits: enough for hits, which are only a first choice.
_TRIM = np.uint64(16)
#: Bytes of text whose hashes a part holds, about.
PART = 24_000_000


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    of = xxhash.xxh64_intdigest
    return np.fromiter((of(w) for w in words), np.uint64, len(words))


def _both_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    import xxhash

    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def rolling(h: np.ndarray, n: int, prime: np.uint64 = _PRIME) -> np.ndarray:
    """A hash of each n consecutive hashes, of the first at 0 and so on; mixed, so that its upper bits are even."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    # by doubling: a run of 2k is a run of k, times prime^k, plus the next run of k
    size, runs, out, done = 1, h, None, 0
    power = int(prime)
    while n:
        if n & 1:
            own = runs[done : len(h) - size + 1]
            out = own.copy() if out is None else out[: len(own)] * np.uint64(power) + own
            done += size
        n >>= 1
        if n:
            runs = runs[: len(runs) - size] * np.uint64(power) + runs[size:]
            size *= 2
            power = power * power % (1 << 64)
    out = out ^ (out >> np.uint64(32))
    out = out * _OTHER
    return out ^ (out >> np.uint64(29))


def pack(values: np.ndarray) -> bytes:
    """Bytes of integers, byte planes apart, compressed."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


class _Batch:
    """Words of some documents in one row, in document order: hashes, and where each document begins."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.drop_duplicates(["doc", "fp"]).sort_values(["doc", "fp"], kind="stable")
        self.docs, self.fps = rows["doc"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64)
        words = [_words(t) for t in rows["text"]]
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.h, self.other = _both_hashes([w for x in words for w in x])
        self.rows = rows

    def places(self, n: int) -> np.ndarray:
        """Where runs of n words begin that stay within a document."""
        ok = np.zeros(len(self.h) + 1, np.int32)
        long = self.sizes >= n
        np.add.at(ok, self.starts[long], 1)
        np.add.at(ok, self.ends[long] - n + 1, -1)
        return np.flatnonzero(np.cumsum(ok[:-1]))

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in groups of about BATCH words."""
    for x in frames:
        size = np.cumsum([len(t or "") // 6 + 1 for t in x["text"]]) // BATCH
        for _, own in x.groupby(size, sort=False):
            yield own


def _within(many: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run of so many."""
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


#: n: entries, or -1 where docs, fps and starts of a whole batch are told.
PACKED = "part int, batch bigint, n int, h binary, h2 binary, many binary, at binary, block binary, doc binary, fp binary"


def _anchors(b: _Batch) -> tuple[np.ndarray, ...]:
    """Hash, no second one, place, whether it is a reference block."""
    at = b.places(ANCHOR)
    return rolling(b.h, ANCHOR)[at] >> _TRIM, None, at, (at - b.starts[b.doc_of(at)]) % ANCHOR == 0


def _candidates(b: _Batch) -> tuple[np.ndarray, ...]:
    """Both hashes and the place of each window that holds a hit."""
    near = np.zeros(len(b.h) + 1, np.int32)
    for start, size, hits in zip(b.starts.tolist(), b.sizes.tolist(), b.rows["hits"], strict=True):
        at = unpack(hits, np.uint32).astype(np.int64)
        np.add.at(near, start + np.maximum(at - (WINDOW - ANCHOR), 0), 1)
        np.add.at(near, start + np.minimum(at + 1, size), -1)
    at = b.places(WINDOW)
    at = at[np.cumsum(near)[at] > 0]
    return rolling(b.h, WINDOW)[at], rolling(b.other, WINDOW, _OTHER)[at], at, np.zeros(len(at), bool)


def _send(parts: int, entries):
    """Packed entries of each batch, one for each hash with all its places, parted by the hash's upper bits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for x in _batches(frames):
            b = _Batch(x)
            number += 1
            h, h2, at, block = entries(b)
            if not len(at):
                continue
            order = np.argsort(h, kind="stable") if h2 is None else np.lexsort((at, h2, h))
            h, at, block = h[order], at[order], block[order]
            h2 = None if h2 is None else h2[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (False if h2 is None else h2[1:] != h2[:-1])]
            first = np.flatnonzero(new)
            ends = np.r_[first[1:], len(h)]
            blocks = np.maximum.reduceat(block, first).astype(np.uint8)
            doc = b.doc_of(at[first])
            upper = h[first] >> np.uint64(16 if h2 is None else 32)
            bounds = np.searchsorted(upper * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))  # parts are ranges of hashes
            rows = [(int(number % parts), number, -1, None, None, None, pack(b.starts), None, pack(b.docs), pack(b.fps))]
            for p in range(parts):
                own = slice(bounds[p], bounds[p + 1])
                if bounds[p] < bounds[p + 1]:
                    many = ends[own] - first[own]
                    places = at[np.repeat(first[own], many) + _within(many)].astype(np.uint32)
                    exact = () if h2 is None else (h2[first[own]], b.docs[doc[own]], b.fps[doc[own]], (at[first[own]] - b.starts[doc[own]]).astype(np.uint32))
                    rows.append((p, number, len(many), pack(np.diff(h[first[own]], prepend=np.uint64(0))), pack(exact[0]) if exact else None, pack(many.astype(np.uint32)), pack(places), pack(exact[3]) if exact else np.packbits(blocks[own]).tobytes(), pack(exact[1]) if exact else None, pack(exact[2]) if exact else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])

    return run


def _hits(rows: list) -> Iterator[tuple[int, np.ndarray]]:
    """Of the entries of one part: all places of hashes with two places or more and a reference block among them."""
    h = np.concatenate([np.cumsum(unpack(r.h, np.uint64)) for r in rows])
    many = np.concatenate([unpack(r.many, np.uint32) for r in rows]).astype(np.int64)
    block = np.concatenate([np.unpackbits(np.frombuffer(r.block, np.uint8), count=r.n) for r in rows])
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    good = (np.add.reduceat(many[order], first) > 1) & (np.maximum.reduceat(block[order], first) > 0)
    hit = np.zeros(len(h), bool)
    hit[order] = np.repeat(good, np.diff(np.r_[first, len(h)]))
    done = 0
    for r in rows:
        own, n = hit[done : done + r.n], many[done : done + r.n]
        done += r.n
        if own.any():
            yield r.batch, unpack(r.at, np.uint32)[np.repeat(own, n)]


def _later(rows: list) -> Iterator[tuple[int, np.ndarray]]:
    """Of the entries of one part: the places of each sequence but the first of all."""
    h = np.concatenate([np.cumsum(unpack(r.h, np.uint64)) for r in rows])
    many = np.concatenate([unpack(r.many, np.uint32) for r in rows]).astype(np.int64)
    h2, start = np.concatenate([unpack(r.h2, np.uint64) for r in rows]), np.concatenate([unpack(r.block, np.uint32) for r in rows])
    doc, fp = np.concatenate([unpack(r.doc, np.int64) for r in rows]), np.concatenate([unpack(r.fp, np.int64) for r in rows])
    order = np.lexsort((start, fp, doc, h2, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])]
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # the first of all, for each in order
    top = np.zeros(len(h), bool)
    top[order] = (doc[order] == doc[lead]) & (fp[order] == fp[lead]) & (start[order] == start[lead])
    done = 0
    for r in rows:
        own, n = top[done : done + r.n], many[done : done + r.n]
        done += r.n
        gone = ~np.repeat(own, n) | (_within(n) > 0)
        if gone.any():
            yield r.batch, unpack(r.at, np.uint32)[gone]


def _receive(judge):
    """Places that judge picks, by batch; what is told of whole batches passes through."""
    names = ["batch", "at", "docs", "fps", "starts"]

    def of(rows: list) -> Iterator[pd.DataFrame]:
        whole = [(r.batch, None, r.doc, r.fp, r.at) for r in rows if r.n < 0]
        entries = [r for r in rows if r.n >= 0]
        if whole:
            yield pd.DataFrame(whole, columns=names)
        if entries:
            for batch, at in judge(entries):
                yield pd.DataFrame([(batch, pack(at), None, None, None)], columns=names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for x in frames:
            for r in x.itertuples(index=False):
                if held and held[-1].part != r.part:
                    yield from of(held)
                    held = []
                held.append(r)
        if held:
            yield from of(held)

    return run


def _by_document(rows: pd.DataFrame) -> pd.DataFrame:
    """The picked places of one batch, as places in documents."""
    whole = rows[rows["docs"].notna()].iloc[0]
    docs, fps, starts = unpack(whole["docs"], np.int64), unpack(whole["fps"], np.int64), unpack(whole["starts"], np.int64)
    found = [unpack(x, np.uint32) for x in rows["at"] if x is not None]
    names = ["doc", "fp", "places"]
    if not found:
        return pd.DataFrame({"doc": np.zeros(0, np.int64), "fp": np.zeros(0, np.int64), "places": np.zeros(0, object)})
    at = np.sort(np.concatenate(found)).astype(np.int64)
    doc = np.searchsorted(starts, at, side="right") - 1  # of documents without words, which begin where the next does, the last is right
    edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
    return pd.DataFrame([(docs[doc[i]], fps[doc[i]], pack((at[i:j] - starts[doc[i]]).astype(np.uint32))) for i, j in zip(edge[:-1], edge[1:], strict=True)], columns=names)


def _parts(docs: DataFrame) -> int:
    """As many parts as the length of all texts asks for, and at least as many as there are partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // PART))


def _exchange(docs: DataFrame, entries, judge, parts: int) -> DataFrame:
    """doc, fp, places: what judge picks of the entries of all documents."""
    sent = docs.mapInPandas(_send(parts, entries), PACKED)
    picked = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInPandas(_receive(judge), "batch bigint, at binary, docs binary, fps binary, starts binary")
    return cut(picked.groupBy("batch").applyInPandas(_by_document, "doc bigint, fp bigint, places binary"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc, fp, places: starts of the windows whose words start earlier too. docs: doc (no null), fp, text."""
    parts = _parts(docs)
    hits = _exchange(docs, _anchors, _hits, parts)
    free(docs.sparkSession)
    hit = hits.select(F.col("doc").alias("d2"), F.col("fp").alias("f2"), F.col("places").alias("hits")).dropDuplicates(["d2", "f2"])
    held = docs.join(hit, (F.col("doc") == F.col("d2")) & (F.col("fp") == F.col("f2"))).select("doc", "fp", "text", "hits")
    made = _exchange(held, _candidates, _later, parts).dropDuplicates(["doc", "fp"])
    del held
    free(docs.sparkSession)
    return made


def covered(n: int, places: bytes | None) -> np.ndarray:
    """Which of n words stand in a window that begins at one of the packed places."""
    marks = np.zeros(n + 1, np.int32)
    if places is not None:
        at = unpack(places, np.uint32).astype(np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + WINDOW, -1)
    return np.cumsum(marks[:-1]) > 0


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n_words, n_removed, kept_sha256 (of the words that stay, joined by spaces) for each row of docs."""
    least = F.lit(-(1 << 63)).cast("long")
    ids = F.coalesce(F.col(key).cast("long"), least).alias("doc")
    single = docs.select(ids).groupBy("doc").count().where("count > 1").isEmpty()  # then ids alone tell documents apart
    own = docs.select(ids, (F.lit(0).cast("long") if single else F.xxhash64(text)).alias("fp"), F.col(text).alias("text"))
    gone = repeats(own).select(F.col("doc").alias("d2"), F.col("fp").alias("f2"), "places")
    joined = own.join(gone, (F.col("doc") == F.col("d2")) & (F.col("fp") == F.col("f2")), "left").select("doc", "text", "places")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for t, places in zip(x["text"], x["places"], strict=True):
                words = _words(t)
                kept = words
                if places is not None:
                    gone = covered(len(words), places)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            made = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
            made.insert(0, "doc", x["doc"].to_numpy())
            yield made

    made = joined.mapInPandas(run, "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return made.select(F.when(F.col("doc") != least, F.col("doc")).alias(key), "n_words", "n_removed", "kept_sha256")


ORACLE = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, range({WINDOW}) r(k)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
