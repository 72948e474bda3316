"""Token ids in files of our own: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Predictions of three orders drive the coder. The order-2 context (where it is known, else the order-1 context) guesses the id. The odds that the guess holds come from logistic mixing: what the order-2 confidence has been worth so far and what the order-1 confidence has been worth, both learned as logarithms of odds, and the guess's order-0 frequency with a learned weight; all three follow the error as the block goes on. If it does not hold, an order-1 guess of its own has its turn; else the id is coded by its order-0 frequency. Models start anew with every block. What they start from, the order-0 frequencies, is told once for a segment of blocks, so that short blocks need not learn the vocabulary; ids that stand once in a segment are escapes, with their bytes apart. A block is decoded on its own, from its bytes and its segment's frequencies; its entry in the footer has the CRC-32 of its ids and of its bytes.

Python steps through the blocks of a segment side by side, one lane of numpy a block: one step codes one id of each of up to `LANES` blocks. Both guesses and the frequency narrow one range of up to 56 bits, which is then moved up by 0 to 3 units of 16 bits, so that every lane does the same in a step. All arithmetic is on integers; of a range as a float only the exponent is read.

File: magic, segments (frequencies, block payloads), footer (documents: id, length; segments: offset, bytes, CRC, blocks; blocks: offset, bytes, ids, CRCs), CRC of the footer, its length, magic.

Documents go to files by ascending doc_id (null first; rows with one id by text, equal rows one after the other). Null text is empty: its document holds the end id only, like that of an empty text; long texts go over as many blocks as they need. An empty table gives no files and no rows. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm.common import filesystem, partitions, shared_dir, write_once
from leafmill.llm.words import GROUP, Store, groups, ragged

END = 2
BLOCK = 4096
LANES = 2048
MAGIC = b"LMIDS003"
#: Words kept with their ids in a Python worker.
CACHE = 1_000_000

_BITS = 12
_ONE = 1 << _BITS
_SLOTS = 2048
#: Steps whose units are put at their places at once.
_CHUNK = 128
#: Order-0 frequencies of a segment sum to two to the power of this.
_TOTAL_BITS = 20
_TOTAL = 1 << _TOTAL_BITS
_P = (np.arange(_ONE) + 0.5) / _ONE
#: The logarithm of odds of a probability, in 256ths, and back.
_STRETCH = np.clip(np.rint(np.log(_P / (1 - _P)) * 256), -2047, 2047).astype(np.int32)
_SQUASH = np.clip(np.rint(_ONE / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 32, _ONE - 32).astype(np.int64)
#: What a lane's learned numbers begin with: logarithms of odds in 4096ths by order-2 confidence, then by that and agreement, by order-1 confidence (with the place of even odds in _SQUASH), and odds of the other guess by order-1 confidence.
_LEARNED = np.array([-3600, -8500, 900, 8000, -9600, -2600, 2600, 5600, *(2047 * 16 + x for x in (-11000, -4400, 900, 7400)), 512, 512, 512, 1024], np.int64)
_WEIGHT = 10_700
_GOAL, _RATES, _FOUR = np.int64(_ONE - 1), np.array([[2], [3]]), np.int64(4)
_SURE, _UNSURE = np.int64(_ONE - 128), np.int64(64)
_HASH, _SHIFT, _UNIT, _TWO, _THREE = (np.uint32(x) for x in (0x9E3779B1, 21, 1, 2, 3))
_NONE, _B4, _B8, _B12, _B16, _B20, _B32, _B40, _B48, _B64 = (np.uint64(x) for x in (0, 4, 8, 12, 16, 20, 32, 40, 48, 64))
#: A range is below 2 to the power of 56.
_WINDOW, _ALMOST, _TOP = np.uint64((1 << 56) - 1), np.uint64((1 << 40) - 1), np.int64(55 + 1023)


class Table:
    """Order-0 frequencies of a segment: of each id that stands twice or more, and of the escape that stands for all others."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, once: int):
        self.ids, self.counts, self.once = ids.astype(np.uint32), counts.astype(np.int64), once
        self.places: np.ndarray | None = None
        every = np.r_[self.counts, once + 1]
        share = np.maximum(1, every * (_TOTAL - len(every)) // every.sum())
        share[int(share.argmax())] += _TOTAL - int(share.sum())
        self.width, self.start = share.astype(np.uint64), (np.cumsum(share) - share).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(share), dtype=np.uint16 if len(share) <= 1 << 16 else np.uint32), share)
        self.worth = np.full(1 << 16, _STRETCH[1], np.int64)  # of an id's lower 16 bits, as an input of the mixing
        self.worth[self.ids & 0xFFFF] = _STRETCH[np.clip(share[:-1] >> (_TOTAL_BITS - _BITS), 1, _ONE - 1)]

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        known, counts = np.unique(ids, return_counts=True)
        often = counts > 1
        return cls(known[often], counts[often], int((~often).sum()))

    def place(self, ids: np.ndarray) -> np.ndarray:
        """The place of each id in the table; that of the escape for those that it does not have."""
        if self.places is None:  # up to the largest id that it has
            self.places = np.full(int(self.ids.max(initial=0)) + 2, len(self.ids))
            self.places[self.ids] = np.arange(len(self.ids))
        return self.places.take(ids, mode="clip")

    def pack(self) -> bytes:
        columns = (np.diff(self.ids.astype(np.int64), prepend=0).astype("<u4"), self.counts.astype("<u4"))
        planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)
        return struct.pack("<II", len(self.ids), self.once) + zlib.compress(planes, 6)

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        n, once = struct.unpack_from("<II", data)
        planes = np.frombuffer(zlib.decompress(data[8:]), np.uint8).reshape(2, 4, n)
        gaps, counts = (np.ascontiguousarray(p.T).reshape(-1).view("<u4").astype(np.int64) for p in planes)
        return cls(np.cumsum(gaps), counts, once)


class _Model:
    """The state of each lane's models, and the odds they give. Numpy's cost a call counts, so what is done for two orders is done in one array of two rows."""

    def __init__(self, lanes: int, table: Table):
        self.lanes, self.worth = lanes, table.worth
        self.contexts = np.zeros(2 * lanes * _SLOTS, np.uint32)  # id << 2 | confidence; of order 2, then of order 1
        self.learned = np.tile(_LEARNED, lanes)
        self.all_weights = np.full(lanes, _WEIGHT, np.int64)  # of the order-0 logarithm of odds; 65536: one
        self.mark, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)  # hashes of the last id and of that before
        self.narrow(lanes)

    def narrow(self, k: int) -> None:
        """From now on the first k lanes only."""
        lane = np.arange(k)
        self.base = np.stack([lane, lane + self.lanes]) * _SLOTS
        self.base_learned = np.stack([lane * 16, lane * 16 + 8])
        self.hashes, self.i, self.j = np.empty((2, k), np.uint32), np.empty((2, k), np.int64), np.empty((3, k), np.int64)
        self.mark, self.before, self.weights = self.mark[:k], self.before[:k], self.all_weights[:k]

    def predict(self) -> None:
        """Looks up both predictions. guess, other: what the first and the second is; odds, other_odds: that they hold, the latter 0 where there is no second one."""
        np.multiply(self.mark, _HASH, out=self.hashes[0])
        self.hashes[0] += self.before
        self.hashes[1] = self.mark
        np.add(self.base, self.hashes >> _SHIFT, out=self.i)
        self.s = self.contexts.take(self.i)
        self.n, self.held = self.s & _THREE, self.s >> _TWO
        held, self.other = self.held
        agree, (some, known) = held == self.other, self.n != 0
        self.guess = np.where(some, held, self.other)
        np.add(self.base_learned, self.n, out=self.j[:2])
        np.add(self.j[1], 4, out=self.j[2])
        self.j[0] += agree * _FOUR
        self.values = self.learned.take(self.j)
        by_two, by_one, second = self.values
        self.x = self.worth.take(self.guess, mode="clip")
        self.p = _SQUASH.take((by_two + by_one + (self.weights * self.x >> 12)) >> 4, mode="clip")
        self.odds = self.p.view(np.uint64)
        self.also = (some & known) > agree
        self.other_odds = (second * self.also).view(np.uint64)

    def learn(self, hit: np.ndarray, again: np.ndarray, ids: np.ndarray) -> None:
        """hit: the guess held; again: it did not, and the other did, which was asked for."""
        error = hit * _GOAL - self.p
        self.weights += self.x * error >> 14
        values = self.values
        values[:2] += error >> _RATES
        values[2] += (again * _SURE + _UNSURE - values[2] >> 5) * (self.also > hit)
        self.learned[self.j] = values
        s, n = self.s, self.n
        self.contexts[self.i] = np.where(self.held == ids, s + (n != _THREE), np.where(n > _UNIT, s - _UNIT, ids << _TWO | _UNIT))
        self.before, self.mark = self.mark, ids * _HASH


def _evened(rng: np.ndarray) -> np.ndarray:
    """By how many bits, 16 at a time, ranges are moved up to be 2 to the power of 40 or more."""
    return ((_TOP - (rng.astype(np.float64).view(np.int64) >> 52)) & ~15).view(np.uint64)


def encode_blocks(ids: np.ndarray, table: Table, block: int = BLOCK, raw: int = 2) -> list[bytes]:
    """The payload of each block of up to `block` ids of a segment; raw: bytes of an escaped id."""
    out: list[bytes] = []
    for at in range(0, len(ids), block * LANES):
        out += _encode(ids[at : at + block * LANES].astype(np.uint32), table, block, raw)
    return out


def _encode(ids: np.ndarray, table: Table, block: int, raw: int) -> list[bytes]:
    lanes = -(-len(ids) // block)
    last = len(ids) - (lanes - 1) * block
    if lanes == 1:
        block = last
    by_lane = np.r_[ids, np.zeros(lanes * block - len(ids), np.uint32)].reshape(lanes, block)
    model, escape = _Model(lanes, table), len(table.ids)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
    units, pos = np.zeros((2 * block + 8) * lanes, np.uint32), np.zeros(lanes, np.int32)
    escaped = np.zeros((block, lanes), bool)
    k = lanes
    for first in range(0, block, _CHUNK):
        n = min(_CHUNK, block - first)
        tops, moves = np.zeros((n, lanes), np.uint64), np.zeros((n, lanes), np.uint8)
        steps = np.ascontiguousarray(by_lane[:, first : first + n].T)
        coded_as = table.place(steps)
        for j in range(n):
            t = first + j
            if t == last and k == lanes > 1:
                k -= 1
                model.narrow(k)
                ended, low, rng = (low[k], rng[k]), low[:k], rng[:k]
            now, place = steps[j, :k], coded_as[j, :k]
            model.predict()
            hit = model.guess == now
            again = (model.other == now) & model.also > hit
            one = (rng >> _B12) * model.odds
            rest = rng - one
            two = (rest >> _B12) * model.other_odds
            part = (rest - two) >> _B20
            low = low + np.where(hit, _NONE, one + np.where(again, _NONE, two + table.start.take(place) * part))
            rng = np.where(hit, one, np.where(again, two, table.width.take(place) * part))
            np.equal(place, escape, out=escaped[t, :k])
            escaped[t, :k] &= ~(hit | again)
            by = _evened(rng)
            np.right_shift(low, _B8, out=tops[j, :k])
            moves[j, :k] = by >> _B4
            low, rng = np.where(by, low << by & _WINDOW, low), rng << by  # what is not moved keeps its carry
            model.learn(hit, again, now)
        _put(units, pos, lanes, tops, moves)
    if k < lanes:
        low, rng = np.r_[low, ended[0]], np.r_[rng, ended[1]]
    # one more unit tells a number within the range, which is 2 to the power of 40 at least
    tops = ((low + _ALMOST) >> _B40 << _B32)[None]
    _put(units, pos, lanes, tops, np.ones((1, lanes), np.uint8))
    units = units.reshape(-1, lanes)
    for i in range(int(pos.max()) - 1, 0, -1):  # carries
        units[i - 1] += units[i] >> _B16
    coded = np.ascontiguousarray((units[: int(pos.max())] & 0xFFFF).astype(">u2").T)
    many = escaped.sum(axis=0).tolist()
    kept = by_lane[escaped.T].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :raw].tobytes()
    ends = (np.cumsum(many) * raw).tolist()
    # the first byte is always zero: the range begins at 48 of 56 bits
    return [struct.pack("<I", m) + kept[e - m * raw : e] + coded[i, :p].tobytes()[1:] for i, (m, e, p) in enumerate(zip(many, ends, pos.tolist(), strict=True))]


def _put(units: np.ndarray, pos: np.ndarray, lanes: int, tops: np.ndarray, moves: np.ndarray) -> None:
    """Puts the units that steps have moved out of the window at their places, a lane's one after the other; pos: how many each lane has. The uppermost one of a step has a carry above its 16 bits."""
    ends = np.cumsum(moves, axis=0, dtype=np.int32) + pos
    begins = (ends - moves).reshape(-1)
    many, tops = moves.reshape(-1), tops.reshape(-1)
    for j in range(int(many.max(initial=0))):
        at = np.flatnonzero(many > j)
        part = tops[at] >> np.uint64(32 - 16 * j)
        units[(begins[at] + j) * lanes + at % lanes] = part if j == 0 else part & np.uint64(0xFFFF)
    pos[:] = ends[-1]


def decode_blocks(payloads: list[bytes], counts: list[int], table: Table, raw: int = 2) -> list[np.ndarray]:
    """The ids of each block."""
    out: list[np.ndarray] = []
    for at in range(0, len(payloads), LANES):
        out += _decode(payloads[at : at + LANES], np.array(counts[at : at + LANES], np.int64), table, raw)
    return out


def _decode(payloads: list[bytes], counts: np.ndarray, table: Table, raw: int) -> list[np.ndarray]:
    order = np.argsort(-counts, kind="stable")  # lanes that end first come last
    lens = counts[order]
    lanes = len(payloads)
    if not lanes or not lens[0]:
        return [np.zeros(0, np.uint32) for _ in payloads]
    stored = np.array([struct.unpack_from("<I", payloads[i])[0] for i in order], np.int64)
    kept = [payloads[i][4 : 4 + raw * n] for i, n in zip(order, stored.tolist(), strict=True)]
    wide = np.zeros((int(stored.sum()) + 1, 4), np.uint8)
    wide[:-1, :raw] = np.frombuffer(b"".join(kept), np.uint8).reshape(-1, raw)
    kept, many = wide.view("<u4").reshape(-1), np.cumsum(stored) - stored
    coded = [payloads[i][4 + raw * n :] for i, n in zip(order, stored.tolist(), strict=True)]
    coded = [c + bytes(len(c) % 2 + 10) for c in coded]
    units = np.frombuffer(b"".join(coded) + bytes(8), ">u2").astype(np.uint64)
    ahead = units[:-3] << _B48 | units[1:-2] << _B32 | units[2:-1] << _B16 | units[3:]  # at each place this unit and the next three
    sizes = np.array([len(c) // 2 for c in coded], np.int64)
    pos = np.cumsum(sizes) - sizes
    limit = len(ahead) - 1
    code = ahead[pos] >> _B16
    pos += 3
    model, escape = _Model(lanes, table), len(table.ids)
    ids_at = np.r_[table.ids, np.uint32(0)]
    rng = np.full(lanes, (1 << 48) - 1, np.uint64)
    found = np.zeros((int(lens[0]), lanes), np.uint32)
    active = np.searchsorted(-lens, -np.arange(1, int(lens[0]) + 1), side="right")
    held = lanes
    for t, k in enumerate(active.tolist()):
        if k < held:
            held = k
            model.narrow(k)
            code, rng, pos, many = code[:k], rng[:k], pos[:k], many[:k]
        model.predict()
        one = (rng >> _B12) * model.odds
        rest = rng - one
        two = (rest >> _B12) * model.other_odds
        part = (rest - two) >> _B20
        both = one + two
        hit, miss = code < one, code >= both
        again = ~(hit | miss)
        at = np.flatnonzero(miss)
        now = np.where(hit, model.guess, model.other)
        code = code - np.where(hit, _NONE, one)
        rng = np.where(hit, one, two)
        if len(at):
            own, left = part[at], code[at] - two[at]
            i = table.slots.take(left // own, mode="clip")
            code[at] = left - table.start.take(i) * own
            rng[at] = table.width.take(i) * own
            now[at] = ids_at.take(i)
            at = at[i == escape]
            if len(at):
                now[at] = kept.take(many[at], mode="clip")
                many[at] += 1
        by = _evened(rng)
        code = code << by | ahead.take(pos, mode="clip") >> (_B64 - by)
        rng = rng << by
        pos = pos + (by >> _B4).view(np.int64)
        model.learn(hit, again, now)
        found[t, :k] = now
    back = np.empty(lanes, np.int64)
    back[order] = np.arange(lanes)
    by_lane = np.ascontiguousarray(found.T)
    return [by_lane[back[i], : counts[i]] for i in range(lanes)]


class Writer:
    """A file being filled: whole documents in order."""

    def __init__(self, out, block: int = BLOCK, raw: int = 2):
        self.out, self.block, self.raw = out, block, raw
        self.at, self.rest, self.held = len(MAGIC), [], 0
        self.docs: list[tuple[int | None, int]] = []
        self.segments: list[tuple[int, int, int, int]] = []
        self.blocks: list[tuple[int, int, int, int, int]] = []
        out.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc, len(ids)))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block * LANES:
            self._flush(self.held // self.block * self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        now, self.rest = ids[:n], [ids[n:]]
        self.held = len(ids) - n
        if not n:
            return
        if int(now.max()) >= 1 << (8 * self.raw):
            raise ValueError("an id is too large for this file's width")
        table = Table.of(now)
        told = table.pack()
        self.segments.append((self.at, len(told), zlib.crc32(told), -(-n // self.block)))
        self.out.write(told)
        self.at += len(told)
        for i, payload in enumerate(encode_blocks(now, table, self.block, self.raw)):
            own = now[i * self.block : (i + 1) * self.block].astype("<u4", copy=False)
            self.blocks.append((self.at, len(payload), len(own), zlib.crc32(own), zlib.crc32(payload)))
            self.out.write(payload)
            self.at += len(payload)

    def close(self) -> None:
        self._flush(self.held)
        ids = np.array([d or 0 for d, _ in self.docs], "<i8")
        known = np.array([d is not None for d, _ in self.docs], np.uint8)
        lens = np.array([n for _, n in self.docs], "<i8")
        foot = struct.pack("<QQQB", len(self.docs), len(self.segments), len(self.blocks), self.raw) + ids.tobytes() + known.tobytes() + lens.tobytes() + np.array(self.segments, "<u8").tobytes() + np.array(self.blocks, "<u8").tobytes()
        self.out.write(foot + struct.pack("<IQ", zlib.crc32(foot), len(foot)) + MAGIC)


def read_file(data, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document's id and ids, from a random-access file; at most LANES blocks are held at once. Raises ValueError where a checksum differs."""
    tail = 12 + len(MAGIC)
    data.seek(size - tail)
    crc, n = struct.unpack("<IQ", data.read(12))
    data.seek(size - tail - n)
    foot = data.read(n)
    if zlib.crc32(foot) != crc:
        raise ValueError("the footer is damaged")
    n_docs, n_segments, n_blocks, raw = struct.unpack_from("<QQQB", foot)
    at = 25
    docs = np.frombuffer(foot, "<i8", n_docs, at)
    known = np.frombuffer(foot, np.uint8, n_docs, at + 8 * n_docs)
    lens = np.frombuffer(foot, "<i8", n_docs, at + 9 * n_docs)
    segments = np.frombuffer(foot, "<u8", 4 * n_segments, at + 17 * n_docs).reshape(-1, 4).astype(np.int64)
    blocks = np.frombuffer(foot, "<u8", 5 * n_blocks, at + 17 * n_docs + 32 * n_segments).reshape(-1, 5).astype(np.int64)

    def ids() -> Iterator[np.ndarray]:
        first = 0
        for offset, size, crc, n in segments.tolist():
            data.seek(offset)
            told = data.read(size)
            if zlib.crc32(told) != crc:
                raise ValueError("a segment's frequencies are damaged")
            table = Table.unpack(told)
            for i in range(first, first + n, LANES):
                own = blocks[i : min(i + LANES, first + n)]
                data.seek(int(own[0, 0]))
                chunk = data.read(int(own[-1, 0] + own[-1, 1] - own[0, 0]))
                payloads = [chunk[o - own[0, 0] : o - own[0, 0] + m] for o, m in own[:, :2].tolist()]
                if any(zlib.crc32(p) != c for p, c in zip(payloads, own[:, 4].tolist(), strict=True)):
                    raise ValueError("a block's bytes are damaged")
                for x, c in zip(decode_blocks(payloads, own[:, 2].tolist(), table, raw), own[:, 3].tolist(), strict=True):
                    if zlib.crc32(x.astype("<u4", copy=False)) != c:
                        raise ValueError("a block's ids are damaged")
                    yield x
            first += n

    source, rest = ids(), np.zeros(0, np.uint32)
    for d, k, n in zip(docs.tolist(), known.tolist(), lens.tolist(), strict=True):
        while len(rest) < n:
            got = [next(source)]
            while sum(map(len, got)) + len(rest) < n or len(got) < 64:
                if (x := next(source, None)) is None:
                    break
                got.append(x)
            rest = np.concatenate([rest, *got])
        yield (d if k else None), rest[:n]
        rest = rest[n:]


#: What a vocabulary's texts must go through for words to be independent: neither looks across ASCII white space, nor from a letter or digit to the punctuation that ends its word.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


class _Words:
    """Ids of words by one vocabulary. What was encoded is kept: some 30 bytes a word, and CACHE words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        splitter = own["pre_tokenizer"] or {}
        regex = [x.get("pattern", {}).get("Regex") for x in splitter.get("pretokenizers", [])]
        plain = not any(own[k] for k in ("truncation", "padding", "post_processor")) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].isalnum() or not re.fullmatch("[!-~]+", t["content"]) for t in own["added_tokens"])
        #: False: of other vocabularies the library gets whole texts.
        self.apart = plain and (own["normalizer"] or {}).get("normalizers") == _NORMALIZERS and regex == [_SPLITS, None] and splitter["pretokenizers"][1]["type"] == "ByteLevel" and not splitter["pretokenizers"][1]["add_prefix_space"]
        self.added = [t["content"].lower() for t in own["added_tokens"]]
        #: The same vocabulary without what leaves words of a-z as they are: normalizer, splitter within words, added tokens.
        self.bare = Tokenizer(self.model.model) if self.apart else self.model
        if self.apart:
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        end = own["model"].get("end_of_word_suffix")
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        #: Of each id: whether it ends a word.
        self.ends = np.zeros(max(self.model.get_vocab().values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if end and t.endswith(end)]] = True
        self.store = Store(self._encode, CACHE)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has; ASCII ones are in lower case. Words of letters go to the library many in one text, as long as just as many ids end a word."""
        size, parts, alone, place = np.zeros(len(words), np.int64), [], [], []
        letters = [i for i, w in enumerate(words) if w.isalpha()] if self.ends.any() else []
        simple = [i for i in letters if words[i].isascii()]
        others = [i for i in letters if not words[i].isascii()]
        for model, own, i in [(self.bare, simple, i) for i in range(0, len(simple), 500)] + [(self.model, others, i) for i in range(0, len(others), 500)]:
            some = own[i : i + 500]
            ids = np.array(model.encode_batch_fast([" ".join([words[j] for j in some])], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.ends.take(ids))
            if len(at) == len(some) and at[-1] == len(ids) - 1:
                size[some] = np.diff(at, prepend=-1)
                parts.append(ids)
                place += some
            else:
                alone += some
        alone += np.setdiff1d(np.arange(len(words)), letters).tolist()
        for i in range(0, len(alone), 5000):
            some = alone[i : i + 5000]
            found = [e.ids for e in self.model.encode_batch_fast([words[j] for j in some], add_special_tokens=False)]
            size[some] = [len(x) for x in found]
            parts += [np.array(x, np.uint32) for x in found]
            place += some
        order = np.array(place, np.int64)
        own = np.empty(len(words), np.int64)
        own[order] = np.cumsum(size[order]) - size[order]
        return ragged(np.concatenate([*parts, np.zeros(0, np.uint32)]), own, size), size

    def cut(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Of each word what comes before the ASCII punctuation at its end, ASCII words in lower case, and that punctuation. A word stays whole where no ASCII letter or digit stands before it, or where it may hold an added token."""
        lower, ascii_only = pc.ascii_lower(words), pc.string_is_ascii(words)
        held = np.zeros(len(words), bool)
        for token in self.added:
            held |= pc.match_substring(lower, token).to_numpy(zero_copy_only=False)
        start, full, data = _bytes_of(words)
        size = pc.binary_length(pc.ascii_rtrim(words, characters=_PUNCTUATION)).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = held | (size == 0)
        whole[~whole] = ~_ALNUM[data[(start + size - 1)[~whole]]]
        size = np.where(whole, full, size)
        stems = _strings(data, start, size)
        return pc.if_else(pa.array(ascii_only.to_numpy(zero_copy_only=False) & ~held), pc.ascii_lower(stems), stems), _strings(data, start + size, full - size)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.apart:
            return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        words = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        ends = words.offsets.to_numpy().astype(np.int64)
        flat = words.values.dictionary_encode()
        one = pa.concat_arrays(self.cut(flat.dictionary)).dictionary_encode()
        ids, start, size = self.store.of(one.dictionary)
        # ids of a distinct word: those of both its parts
        both = one.indices.to_numpy().reshape(2, -1).T.reshape(-1)
        ids, sizes = ragged(ids, start[both], size[both]), size[both].reshape(-1, 2).sum(axis=1)
        place = flat.indices.to_numpy()
        until = np.r_[0, np.cumsum(sizes[place])][ends]
        ids = ragged(ids, (np.cumsum(sizes) - sizes)[place], sizes[place])
        return [ids[i:j] for i, j in zip(until[:-1].tolist(), until[1:].tolist(), strict=True)]


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the bytes of each string begin, how many there are, and all bytes."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    return ends[:-1], np.diff(ends), np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _strings(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(ragged(data, start, size)))


_stores: dict[str, _Words] = {}


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text, without special ones, from the library. What stands between ASCII white space is encoded once, apart from the punctuation at its end, and kept; texts go in groups of GROUP characters."""
    if path not in _stores:
        _stores[path] = _Words(path)
    out: list[np.ndarray] = []
    for some in groups(texts, GROUP):
        out += _stores[path].encode(some)
    return out


def write(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END, raw: int = 2) -> tuple[str, DataFrame]:
    """Writes the ids of all documents to files in a new shared folder. Returns its URI and the committed file table: part (files in document order), file, n_ids."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "ids")
    n = partitions(spark)
    sorted_docs = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartitionByRange(n, "doc").sortWithinPartitions("doc", "text")
    sorted_docs = sorted_docs.select(F.coalesce("doc", F.lit(0).cast("long")).alias("doc"), F.col("doc").isNotNull().alias("known"), "text")  # a null would make all ids of its batch floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        stop = np.array([end], np.uint32)

        def fill(out) -> None:
            nonlocal total
            writer = Writer(out, raw=raw)
            for x in batches:
                for d, known, ids in zip(x["doc"].tolist(), x["known"].tolist(), encode_texts(tokenizer, x["text"].tolist()), strict=True):
                    writer.add(d if known else None, np.concatenate([ids, stop]))
                    total += len(ids) + 1
            writer.close()

        name = write_once(folder, f"ids-{part:06d}", fill)
        yield pd.DataFrame({"part": [part], "file": [name], "n_ids": [total]})

    rows = sorted_docs.mapInPandas(run, "part int, file string, n_ids bigint")
    rows.write.parquet(f"{folder}/_files.parquet")
    return folder, spark.read.parquet(f"{folder}/_files.parquet")


def read(folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document in the committed files, from their bytes."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.where("n_ids > 0").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # a row a file

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = filesystem(folder)
        for x in batches:
            for name, start in zip(x["file"], x["start"].tolist(), strict=True):
                rows: list[tuple] = []
                with system.open_input_file(f"{path}/{name}") as data:
                    for doc, ids in read_file(data, data.size()):
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False))))
                        start += len(ids)
                        if len(rows) == 20_000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    spark = files.sparkSession
    return placed.repartition(max(1, min(partitions(spark), files.count()))).mapInPandas(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"], dtype=object)
    return made.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})
