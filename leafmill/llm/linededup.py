"""Line dedup: lines of the whole corpus that are equal, or (from LONG characters on) within an edit distance of two, form classes; the first line of each class stays.

1. One aggregate over all lines, of numbers only and combined before it is shuffled: each line under a hash of 128 bits, which finds the equal ones at every length, and each long line under the hashes of the segment-partition join. A line is cut into threshold + 1 segments of even length; two lines within the threshold share one of them. A line is indexed under its own segments and probes the substrings where a shorter line could have a segment, by length difference, in the windows of the multi-match-aware scheme. Places with one line, which are nearly all, are dropped here.
2. The members of the places that are left are looked up. A place with more than PLACE lines is refined: what remains of its lines without the shared segment is within the threshold, too, and is indexed and probed in the same way, so lines meet again only where a second segment is shared. What is still large after LEVELS such steps is split into blocks that meet two by two, so no task holds more than PLACE lines of one place.
3. Pairs whose counts of characters could be those of near lines are verified by banded bit-parallel edit distance, many pairs at a time; lines already joined are not compared again, so a place gives a spanning star, not all pairs. Components of the stars are the classes.
4. Of each class, the first occurrence by (id, line number) stays. The lines that go are gathered by document.

Lines without words stay. Lines shorter than LONG go only where they are equal: two edits would make different words of them.
Null text has no lines; null ids come first. Rows with one id are told apart by text; equal rows count as one document. Ties cannot be: a class has one first line. Empty tables give no rows. Columns of other names pass through `clean` untouched, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, free, meet
from leafmill.llm.components import components

MAX_EDITS = 2
#: Lines of so many characters are joined within MAX_EDITS, shorter ones at equality.
LONG = 24
#: Lines that one place compares with one another; larger ones are refined, then split into blocks of half of it.
PLACE = 512
LEVELS = 2
#: Characters of the pairs that are compared at a time.
AREA = 2_000_000
#: Stands for null ids, which come first.
NO_ID = -(1 << 63)


def segments(n: int, edits: int = MAX_EDITS) -> list[tuple[int, int]]:
    """Start and length of the segments of a line of n characters: the last ones are the longer ones."""
    short, longer = divmod(n, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        size = short + (i >= edits + 1 - longer)
        out.append((at, size))
        at += size
    return out


def slots(edits: int = MAX_EDITS) -> list[tuple[int, int, int]]:
    """(gap, segment, shift): where a line takes part. Its own segments come first; then, for lines shorter by gap, where that segment may stand in this one, shifted from its place in the shorter line."""
    own = [(0, i, 0) for i in range(edits + 1)]
    wide = [(gap, i, d) for gap in range(edits + 1) for i in range(edits + 1) for d in range(max(-i, gap - edits + i), min(i, gap + edits - i) + 1)]
    return own + [x for x in wide if x not in own]


SLOTS = slots()


def stretch(n: int, slot: int) -> tuple[int, int] | None:
    """Start and length of what a line of n characters shows in a slot; None where the shorter line would have an empty segment or the stretch would lie outside."""
    gap, i, shift = SLOTS[slot]
    if n - gap <= MAX_EDITS:
        return None
    p, size = segments(n - gap)[i]
    return (p + shift, size) if p + shift >= 0 and p + shift + size <= n else None


def within(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, edits: int = MAX_EDITS) -> np.ndarray:
    """Whether the edit distance of a[i] and b[i] is at most edits (7 at most), for all i at once: rows of code points, of lengths na and nb that differ by edits at most and exceed it.

    Hyyrö's banded form of Myers' bit-parallel algorithm, a word of 16 bits a pair: its highest bit is the lowest diagonal of the band. The score follows that diagonal down to a's last character and then runs along a's last row."""
    n, width = len(a), int(nb.max(initial=0))
    padded = np.full((a.shape[1] + width + 2 * edits + 4, n), 0xFFFFFFFF, np.uint32)
    padded[edits + 1 : edits + 1 + a.shape[1]] = a.T  # row p of a stands at p + edits + 1
    other = np.ascontiguousarray(b.T)
    vp, vn = np.full(n, (0xFFFF << (15 - edits)) & 0xFFFF, np.uint16), np.zeros(n, np.uint16)
    score = np.full(n, edits, np.int32)
    one = np.uint16(1)
    for j in range(width):
        c = other[j]
        x = np.zeros(n, np.uint16)
        for d in range(2 * edits + 2):  # a's characters at places j + edits, downwards
            x |= (padded[j + 2 * edits + 1 - d] == c).astype(np.uint16) << np.uint16(15 - d)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        past = j - (na - edits)  # steps along the last row so far
        at = np.uint16(1) << np.clip(14 - past, 0, 15).astype(np.uint16)
        move = np.where(past < 0, (d0 >> np.uint16(15)) == 0, ((hp & at) != 0).astype(np.int32) - ((hn & at) != 0))
        score += np.where(j < nb, move, 0)
        vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
    return score <= edits


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    out = np.zeros((len(lines), int(sizes.max(initial=1))), np.uint32)
    for i, x in enumerate(lines):
        out[i, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, sizes


def bags(lines: list[str]) -> np.ndarray:
    """How many characters of each line fall in each of 32 classes (code point modulo 32). An edit moves the sum of differences by two at most, so lines further apart than 2 * MAX_EDITS cannot be near."""
    out = np.zeros((len(lines), 32), np.int32)
    for i in range(0, len(lines), 5000):
        own = lines[i : i + 5000]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32) & np.uint32(31)
        out[i : i + len(own)] = np.bincount(np.repeat(np.arange(len(own)), sizes) * 32 + codes, minlength=32 * len(own)).reshape(-1, 32)
    return out


def _runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches anew, so that no run of equal keys is parted."""
    rest = None
    for x in batches:
        x = x if rest is None else pd.concat([rest, x], ignore_index=True)
        last = np.logical_and.reduce([(x[c] == x[c].iloc[-1]).to_numpy() for c in by])
        n = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if n:
            yield x.iloc[:n].reset_index(drop=True)
        rest = x.iloc[n:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars of the lines within the threshold, from rows sorted by key and place: id, line, own, side."""
    for x in _runs(batches, ["key", "place"]):
        k, p = x["key"].to_numpy(), x["place"].to_numpy()
        run = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])]) - 1
        left = np.cumsum(np.bincount(run))[run] - np.arange(len(x)) - 1
        lines = x["line"].tolist()
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        own, side, ids = x["own"].to_numpy(), x["side"].to_numpy(), x["id"].to_numpy()
        bag = bags(lines)
        label = np.arange(len(x))
        for gap in range(1, int(left.max(initial=0)) + 1):
            i = np.flatnonzero(left >= gap)
            j = i + gap
            ok = (label[i] != label[j]) & (own[i] | own[j]) & (ids[i] != ids[j]) & (np.abs(sizes[i] - sizes[j]) <= MAX_EDITS) & ((side[i] != side[j]) | (side[i] < 0))
            i, j = i[ok], j[ok]
            ok = np.concatenate([np.abs(bag[i[k : k + 50_000]] - bag[j[k : k + 50_000]]).sum(axis=1) <= 2 * MAX_EDITS for k in range(0, len(i) or 1, 50_000)])
            i, j = i[ok], j[ok]
            order = np.argsort(sizes[i], kind="stable")  # pairs of like length together, so many that they fill AREA
            i, j, at = i[order], j[order], 0
            while at < len(i):
                n = int(np.searchsorted(np.arange(1, len(i) - at + 1) * (sizes[i[at:]] + MAX_EDITS), AREA, side="right")) or 1
                a, b = i[at : at + n], j[at : at + n]
                at += n
                (x_a, n_a), (x_b, n_b) = (_codes([lines[k] for k in side_of]) for side_of in (a, b))
                near = within(x_a, x_b, n_a, n_b)
                for u, v in zip(a[near].tolist(), b[near].tolist(), strict=True):  # labels of a run only: joined lines are not compared again
                    u, v = label[u], label[v]
                    if u != v:
                        same = np.flatnonzero(run == run[u])
                        label[same[label[same] == max(u, v)]] = min(u, v)
        star = np.flatnonzero(label != np.arange(len(x)))
        yield pd.DataFrame({"a": ids[star], "b": ids[label[star]]})


def spoken(docs: DataFrame) -> DataFrame:
    """at, fp, place, line, n (its characters): the lines with a word. docs: at, fp, text."""
    lines = docs.select("at", "fp", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("n", F.length("line"))


def _id(line: Column) -> Column:
    return F.xxhash64(line)


def _second(line: Column) -> Column:
    """Of equal lines both hashes are equal."""
    return F.xxhash64(F.lit(1), line)


#: Stands for the whole line among the slots.
WHOLE = -1


def _slotted(lines: DataFrame, whole: bool = False) -> DataFrame:
    """The long lines once for each slot (and each line once for the whole of it), with key: the hash of what the line shows there, of the length of the indexed line and of the segment's number. Slots are rows rather than columns, so that one short expression makes all keys."""
    entry = lambda *x: F.struct(*[F.lit(v).alias(c) for c, v in zip(("slot", "gap", "part", "shift"), x, strict=True)])
    slots = [entry(i, *x) for i, x in enumerate(SLOTS)]
    made = lines if whole else lines.where(F.col("n") >= LONG)
    made = made.select("*", F.inline(F.array(*([entry(WHOLE, 0, 0, 0)] if whole else []), *slots)))
    made = made.where((F.col("slot") == WHOLE) | (F.col("n") - F.col("gap") >= LONG)).withColumn("size", F.col("n") - F.col("gap"))
    segments = MAX_EDITS + 1
    start = F.expr(f"size div {segments} * part + greatest(size % {segments} - ({segments} - part), 0) + shift + 1").cast("int")
    of = F.expr(f"size div {segments} + if(size % {segments} >= {segments} - part, 1, 0)").cast("int")
    return made.withColumn("key", F.when(F.col("slot") == WHOLE, _id(F.col("line"))).otherwise(F.xxhash64(F.col("size") * 8 + F.col("part"), F.substring("line", start, of))))


def _places(docs: DataFrame, pair: bool) -> DataFrame:
    """k1, k2, lo, hi, own, n: equal lines (k1 and k2 their hashes, lo the first document), and under k1 alone the places of different long lines of which one is indexed there."""
    as_order = (lambda x: F.struct(x.alias("doc"), F.lit(0).cast("long").alias("fp"))) if pair else (lambda x: x)
    whole = F.col("slot") == WHOLE
    made = _slotted(spoken(docs).withColumn("id", _id(F.col("line"))), True)
    made = made.select(F.col("key").alias("k1"), F.when(whole, _second(F.col("line"))).alias("k2"), F.when(whole, F.col("at")).otherwise(as_order(F.col("id"))).alias("v"), F.col("slot").between(0, MAX_EDITS).alias("own"))
    made = made.groupBy("k1", "k2").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("own").alias("own"), F.count(F.lit(1)).alias("n"))
    return cut(made.where(F.when(F.col("k2").isNotNull(), F.col("n") > 1).otherwise(F.col("own") & (F.col("lo") < F.col("hi")))))


def _members(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """key, id, slot, first (the first document with that line): each line at the shared places."""
    made = _slotted(spoken(docs).withColumn("id", _id(F.col("line")))).select("at", "id", "key", "slot")  # no texts, in case they are shuffled
    return cut(meet(made, shared, ["key"], "at").groupBy("key", "id", "slot").agg(F.min("at").alias("first")))


def _rest(line: str, slot: int) -> str | None:
    found = stretch(len(line), slot)
    return line[: found[0]] + line[found[0] + found[1] :] if found else None


def _refined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From key, id, own, rest: the same once more, with keys that also cover a segment of the rest, which is left out of the new rest."""
    import xxhash

    def rows(x: pd.DataFrame) -> Iterator[tuple]:
        for key, i, own, rest in zip(x["key"].tolist(), x["id"].tolist(), x["own"].tolist(), x["rest"], strict=True):
            for slot in range(len(SLOTS)):
                if (found := stretch(len(rest), slot)) is not None:
                    gap, part, _ = SLOTS[slot]
                    p, size = found
                    new = xxhash.xxh64_intdigest(b"%d %d %d " % (key, len(rest) - gap, part) + rest[p : p + size].encode("utf-8", "surrogatepass"))
                    yield new - (1 << 63), i, own and slot <= MAX_EDITS, rest[:p] + rest[p + size :]

    for x in batches:
        for j in range(0, len(x), 2000):
            yield pd.DataFrame(rows(x.iloc[j : j + 2000]), columns=["key", "id", "own", "rest"])


def _first_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield x[["key", "id", "own"]].assign(rest=[_rest(t, s) for t, s in zip(x["line"], x["slot"], strict=True)])


def links(docs: DataFrame, shared: DataFrame, place: int = PLACE, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(a, b: different lines within the threshold, a spanning star a place; id, first: lines that were compared). docs: at, fp, text; shared: key."""
    members = _members(docs, shared)
    own = F.col("slot") <= MAX_EDITS
    wanted = cut(members.groupBy("id").agg(F.min("first").alias("at")))
    lines = cut(meet(spoken(docs).select("at", _id(F.col("line")).alias("id"), "line"), wanted, ["id", "at"], "id").select("id", "line").dropDuplicates(["id"]))

    def large(rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("own").alias("own")).where((F.col("size") > place) & F.col("own") & (F.col("lo") < F.col("hi"))).select("key", "size"))

    now, ready = members.select("key", "id", own.alias("own"), "slot"), []
    for level in range(levels + 1):
        hot = large(now)
        ready.append(meet(now, hot.select("key"), ["key"], "id", "left_anti").select("key", "id", "own"))
        if level == levels or hot.isEmpty():
            break
        met = meet(now, hot.select("key"), ["key"], "id")
        if level == 0:
            met = met.join(lines, "id").select("key", "id", "own", "slot", "line").mapInPandas(_first_rest, "key bigint, id bigint, own boolean, rest string")
        now = cut(met.select("key", "id", "own", "rest").mapInPandas(_refined, "key bigint, id bigint, own boolean, rest string"))
    alone = F.array(F.struct(F.lit(-1).cast("long").alias("place"), F.lit(-1).alias("side")))
    dealt = [x.groupBy("key", "id").agg(F.max("own").alias("own")).select("key", "id", "own", alone[0]["place"].alias("place"), alone[0]["side"].alias("side")) for x in ready]
    if not hot.isEmpty():
        blocks = hot.select("key", F.ceil(F.col("size") / (place // 2)).cast("long").alias("blocks"))
        mine = F.pmod("id", F.col("blocks"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda y: F.struct((F.least(mine, y) * F.col("blocks") + F.greatest(mine, y)).alias("place"), F.when(y == mine, -1).when(mine < y, 0).otherwise(1).alias("side")))
        split = meet(now.groupBy("key", "id").agg(F.max("own").alias("own")), blocks, ["key"], "id").select("key", "id", "own", F.explode(pairs).alias("p"))
        dealt.append(split.select("key", "id", "own", "p.place", "p.side"))
    every = dealt[0]
    for x in dealt[1:]:
        every = every.unionByName(x)
    met = every.join(lines, "id").repartition("key", "place").sortWithinPartitions("key", "place", "id")
    made = cut(met.mapInPandas(_verified, "a bigint, b bigint").distinct())
    free(docs.sparkSession)
    return made, wanted.withColumnRenamed("at", "first")


def gone(docs: DataFrame, pair: bool) -> DataFrame:
    """doc, fp, gone (numbers of the lines that go), for each document that loses any. docs: doc, fp, at, text; pair: whether at holds both, as ids alone do not tell rows apart."""
    found = _places(docs, pair)
    free(docs.sparkSession)
    shared = cut(found.where("k2 IS NULL").select(F.col("k1").alias("key")))
    near, compared = links(docs, shared)
    labels = components(near)
    equal = found.where("k2 IS NOT NULL").select(F.col("k1").alias("id"), F.col("k2").alias("second"), F.col("lo").alias("first"))
    firsts = labels.withColumnRenamed("node", "id").join(compared, "id")
    least = firsts.groupBy("label").agg(F.min("first").alias("first"))
    joined = firsts.select("id", "label").join(least, "label").select("id", F.lit(None).cast("long").alias("second"), "label", "first")
    alone = equal.join(labels.select(F.col("node").alias("id")), "id", "left_anti").select("id", "second", F.col("id").alias("label"), "first")
    rule = cut(joined.unionByName(alone))
    lines = spoken(docs.select("at", "fp", "text")).select("at", "fp", "place", _id(F.col("line")).alias("id"), _second(F.col("line")).alias("own_second"))
    met = meet(lines, rule, ["id"], "fp" if pair else "at").where(F.col("second").isNull() | (F.col("second") == F.col("own_second")))
    of = met.groupBy("at", "fp", "label", (F.col("at") == F.col("first")).alias("mine")).agg(F.min("place").alias("least"), F.collect_list("place").alias("places"))
    goes = of.select("at", "fp", F.when(F.col("mine"), F.filter("places", lambda p: p != F.col("least"))).otherwise(F.col("places")).alias("places"))
    by = goes.groupBy("at", "fp").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("gone")).where(F.size("gone") > 0)
    return cut(by.select((F.col("at.doc") if pair else F.col("at")).alias("doc"), "fp", "gone"))


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row (the columns of docs), lines and gone (numbers of those that go; null for none) for each row of docs."""
    number = lambda c: F.coalesce(c.cast("long"), F.lit(NO_ID).cast("long"))
    pair = not docs.select(number(F.col(key)).alias("doc")).groupBy("doc").count().where("count > 1").isEmpty()
    print_of = (lambda c: F.xxhash64(c)) if pair else (lambda c: F.lit(0).cast("long"))
    own = docs.select(number(F.col(key)).alias("doc"), print_of(F.col(text)).alias("fp"), F.col(text).alias("text"))
    own = own.withColumn("at", F.struct("doc", "fp") if pair else F.col("doc"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    joined = rows.join(gone(own, pair).hint("merge"), (number(F.col("row")[key]) == F.col("doc")) & (print_of(F.col("row")[text]) == F.col("fp")), "left")
    return joined.select("row", F.split(F.coalesce(F.col("row")[text], F.lit("")), "\n").alias("lines"), "gone")


def _kept(lines: Column, gone: Column) -> Column:
    """The lines that stay, joined by newlines."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n_lines, n_removed, kept_sha256 (of the lines that stay, joined by newlines) for each row of docs."""
    made, own = mark(docs.select(key, text), key, text), F.col("row")[text]
    n = F.when(own.isNull(), 0).otherwise(F.size("lines")).cast("long")
    new = F.when(F.col("gone").isNull(), F.coalesce(own, F.lit(""))).otherwise(_kept(F.col("lines"), F.col("gone")))
    return made.select(F.col("row")[key].alias(key), n.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"), F.sha2(new, 256).alias("kept_sha256"))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents without the lines removed; one that loses its last word goes. Columns as they came, the length brought up to date."""
    made = mark(docs, key, text).select("row", F.when(F.col("gone").isNotNull(), _kept(F.col("lines"), F.col("gone"))).alias("new"))
    made = made.where(F.col("new").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    new = {text: F.coalesce("new", F.col("row")[text])} | ({length: F.when(F.col("new").isNull(), F.col("row")[length]).otherwise(F.length("new")).cast("long")} if length in docs.columns else {})
    return made.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
