"""What is known of words: numbers each word has, kept in Arrow and numpy instead of Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of the texts that are parted into words at once.
GROUP = 16_000_000
#: Bytes that a store has for each word that it may keep, on average; it is full when either runs out.
WORD_BYTES = 64


def groups(texts: list[str], most: int) -> Iterator[list[str]]:
    """Texts of `most` characters together, or one longer one."""
    first = held = 0
    for i, t in enumerate(texts):
        if i > first and held + len(t) > most:
            yield texts[first:i]
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield texts[first:]


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each, one after the other."""
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    for i in range(0, len(size), 16_384):  # what is small stays in the cache
        some, first = slice(i, i + 16_384), int(ends[i - 1]) if i else 0
        at = np.repeat(start[some] - ends[some] + size[some], size[some])
        at += np.arange(first, first + len(at))
        flat.take(at, out=out[first : first + len(at)], mode="clip")
    return out


class Store:
    """The ids of words by make(words), which gives the ids of all and how many each has. `most` words stay, or those of one group of texts where they are more."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.make, self.most = make, most
        self.forget()

    def forget(self) -> None:
        self.words, self.start, self.ids = pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _full(self, more: int) -> bool:
        return len(self.words) + more > self.most or self.words.nbytes + self.start.nbytes + self.ids.nbytes > self.most * WORD_BYTES

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: all ids of the store, and where each word's ids begin and how many there are."""
        at = pc.index_in(words, self.words)
        if at.null_count and self._full(at.null_count):  # what is needed now stays
            kept = at.drop_null()
            old = kept.to_numpy().astype(np.int64)
            size = self.start[old + 1] - self.start[old]
            self.words, self.ids, self.start = self.words.take(kept), ragged(self.ids, self.start[old], size), np.r_[0, np.cumsum(size)]
            at = pc.index_in(words, self.words)
        if at.null_count:
            new = words.filter(at.is_null())
            ids, size = self.make(new.to_pylist())
            i = at.fill_null(-1).to_numpy().astype(np.int64)
            i[i < 0] = np.arange(len(self.words), len(self.words) + len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.start = np.r_[self.start, self.start[-1] + np.cumsum(size)]
            self.ids = np.concatenate([self.ids, ids])
        else:
            i = at.to_numpy().astype(np.int64)
        return self.ids, self.start[i], self.start[i + 1] - self.start[i]
