"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary is read from a .model file. Text is scanned once from left to right; for each place the search keeps the best last piece that ends there, within a window of the longest piece. As soon as the backpointer paths from all places of the window run through one boundary, the ids up to it are committed and forgotten.

What "best" means follows the model's type:

* unigram: the sum of piece scores, as in the library's own search.
* BPE: a path is alive only while each two neighbouring pieces are what merging their joint text by rank gives. Such a path is the merge result for the whole text, and of each prefix exactly one is alive, so the search returns the merge result without ever holding the whole text.

Characters in no piece become byte pieces, or the unknown piece where the model has none. White space before a word is part of the word's piece, and no piece holds it further inside (this is checked on loading); so words are searched one by one. Words no longer than a few windows take one run of an automaton over all pieces, which tells at each place the pieces that end there; longer ones are searched in windows. Texts are parted into words many at once, in Arrow, and each distinct word is looked up once; results are kept for the next time, in a store of bounded size that is emptied at the end of each partition.

Null text counts as empty and has no ids; so does empty text. Rows are coded one by one: repeated rows and rows with one id each have a result. A search has no ties: of equal unigram scores the first path found stays, and of BPE paths one is alive. An empty table gives no rows. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from leafmill.llm.words import Store, ragged

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Words kept with their ids in a Python worker: some 35 bytes each.
CACHE = 250_000
#: Bytes of the texts whose ids are held at once.
GROUP = 1_000_000
#: Pairs of pieces whose check is kept: some 110 bytes each, so 33 MB at most.
PAIRS = 300_000
#: Stands before the first piece, as the upper half of a pair.
_START = 1 << 48


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    def __init__(self, data: bytes):
        self.kind, self.prefix, self.squeeze, self.charsmap = UNIGRAM, True, True, b""
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        for n, v in _fields(data):
            if n == 1:
                piece = {"score": 0.0, "kind": NORMAL} | {{1: "piece", 2: "score", 3: "kind"}.get(k, "other"): x for k, x in _fields(v)}
                self.pieces.append(piece["piece"].decode())
                self.scores.append(struct.unpack("<f", piece["score"])[0] if isinstance(piece["score"], bytes) else 0.0)
                self.kinds.append(piece["kind"])
            elif n == 2:
                self.kind = dict(_fields(v)).get(3, UNIGRAM)
            elif n == 3:
                own = dict(_fields(v))
                self.charsmap, self.prefix, self.squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if self.charsmap or self.squeeze:
            raise ValueError("only models without normalisation are supported: others do not give the text back")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece holds white space inside")
        self.plain_newline = not any("\n" in p for p in self.ids)
        self.text = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.sizes = [len(p) for p in self.pieces]
        self.store = Store(self._ids_of_all, CACHE)
        self.text_size = np.array([len(t) for t in self.text], np.int64)
        self.text_start, self.all_text = np.cumsum(self.text_size) - self.text_size, np.frombuffer(b"".join(self.text), np.uint8)
        self.pairs: dict[int, bool] = {}
        #: What pieces begin with, and the ids of those that a search can use; -1 for the others.
        self.nodes = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | {p: i if self.kind != BPE or self._merge(p) == [p] else -1 for p, i in self.ids.items()}
        self.ending = self._automaton() if self.kind == BPE else None

    def _automaton(self):
        """Of a text: where pieces that a search can use end, with their lengths and ids (plain and as the upper half of a pair), the longer ones of a place first."""
        import ahocorasick

        made = ahocorasick.Automaton()
        for p, i in self.nodes.items():
            if i >= 0:
                made.add_word(p, (len(p), i, i << 24))
        made.make_automaton()
        return made.iter

    def _merge(self, text: str) -> list[str]:
        """The pieces that merging by rank makes of a short text."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        return self._merge(a + b) == [a, b]

    def _fit(self, pair: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[pair] = made = pair >= _START or self.fits(self.pieces[pair >> 24], self.pieces[pair & 0xFFFFFF])
        return made

    def _in_one_window(self, word: str) -> list[int] | None:
        """The ids of a word by BPE: of each place the last piece of the one path that is alive there. None where a character is in no piece."""
        last: list[int | None] = [None] * len(word)  # shifted, as the upper half of a pair
        last.append(_START)  # before the first place
        known, fit = self.pairs.get, self._fit
        for at, (size, i, shifted) in self.ending(word):
            if last[at] is None and (before := last[at - size]) is not None:
                ok = known(before | i)
                if ok or (ok is None and fit(before | i)):
                    last[at] = shifted
        at, out, sizes = len(word) - 1, [], self.sizes
        while at >= 0:
            if (i := last[at]) is None:
                return None
            out.append(i >> 24)
            at -= sizes[i >> 24]
        out.reverse()
        return out

    def _bytes_of(self, char: str) -> list[int]:
        own = [self.bytes.get(b) for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in own else own

    def search(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, in committed runs. Places are counted from the last commit; from each place that a path reaches, pieces are tried forwards while any piece begins like that."""
        bpe, nodes, scores, longest, fits = self.kind == BPE, self.nodes, self.scores, self.longest, self.fits
        n = len(text)
        room = min(n, 3 * longest) + 1
        best: list[float] = [0.0] * room
        back: list[int | None] = [None] * room  # where the last piece ending here begins; None: no path ends here
        back[0] = 0
        start, here, before = 0, 0, ""
        while start + here < n:
            if back[here] is not None:
                at = start + here
                last = text[start + back[here] : at] if here else before
                for end in range(at + 1, min(at + longest, n) + 1):
                    piece = text[at:end]
                    i = nodes.get(piece)
                    if (i is None or i < 0) and end > at + 1:
                        if i is None:
                            break
                        continue
                    j = end - start
                    if bpe:
                        if back[j] is None and (not last or fits(last, piece)):
                            back[j] = here
                    else:
                        s = best[here] + (self.unknown_score if i is None or i < 0 else scores[i])
                        if back[j] is None or s > best[j]:
                            best[j], back[j] = s, here
                    if i is None:
                        break
            here += 1
            if here >= 2 * longest or start + here == n:
                # walk back from every place of the window until the paths meet
                alive = {k for k in range(max(0, here - longest + 1), here + 1) if back[k] is not None} if start + here < n else {here}
                while len(alive) > 1:
                    k = max(alive)
                    alive.discard(k)
                    alive.add(back[k])
                meet = alive.pop()
                if meet:
                    cuts, k = [], meet
                    while k:
                        cuts.append(text[start + back[k] : start + k])
                        k = back[k]
                    cuts.reverse()
                    yield cuts
                    before = cuts[-1]
                    best = [b - best[meet] for b in best[meet:]] + [0.0] * meet
                    back = [None if b is None else max(b - meet, 0) for b in back[meet:]] + [None] * meet
                    back[0] = 0
                    start, here = start + meet, here - meet

    def _ids_of(self, word: str) -> bytes:
        if self.ending and len(word) <= 3 * self.longest and (found := self._in_one_window(word)) is not None:
            return array("I", found).tobytes()
        out: list[int] = []
        for run in self.search(word):
            for p in run:
                i = self.ids.get(p)
                out += [i] if i is not None else self._bytes_of(p)
        return np.array(out, "<u4").tobytes()

    def _ids_of_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self._ids_of, words))
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _words(self, text: str) -> list[str]:
        """The words of any text, one by one."""
        if not text:
            return []
        spaced = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return _WORD.findall(spaced) if self.plain_newline else _SPACED.findall(spaced)

    def _plain(self, text: str) -> bool:
        """Whether a text's words are what stands between its single spaces, each with one before it."""
        return bool(text) and self.prefix and text[0] != " " and "  " not in text and SPACE not in text and _NO_SPACE not in text

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. Places are told by numbers of distinct words; those of plain texts come from Arrow."""
        texts = [t or "" for t in texts]
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        others = [i for i, t in enumerate(texts) if not self._plain(t)]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        try:
            parts = pa.array([texts[i] for i in plain], pa.string())
        except UnicodeEncodeError:  # a surrogate on its own is no string of Arrow's
            plain, others = [], list(range(len(texts)))
        if plain:
            if self.plain_newline:  # a word of its own, and no space before what follows
                parts = pc.replace_substring(parts, "\n", f" \n {_NO_SPACE}")
            parts = pc.split_pattern(parts, " ")
            flat = parts.values.dictionary_encode()
            words, bare = flat.dictionary, pc.starts_with(flat.dictionary, _NO_SPACE)
            words = pc.if_else(bare, pc.utf8_slice_codeunits(words, 1), pc.if_else(pc.equal(words, "\n") if self.plain_newline else False, words, pc.binary_join_element_wise(SPACE, words, "")))
            self._put(out, plain, words, flat.indices.to_numpy(), parts.offsets.to_numpy().astype(np.int64))
        if others:
            listed = [self._words(texts[i]) for i in others]
            number: dict[str, int] = {}
            places = np.array([number.setdefault(w, len(number)) for x in listed for w in x], np.int64)
            self._put(out, others, list(number), places, np.cumsum([0, *map(len, listed)]))
        return out

    def _put(self, out: list[np.ndarray], at: list[int], words: pa.Array | list[str], places: np.ndarray, ends: np.ndarray) -> None:
        """Puts the ids of texts at their places in out. places: of all words, in order; ends: where the texts part."""
        try:
            own = pa.array(words, pa.string()).dictionary_encode()
            ids, start, size = self.store.of(own.dictionary)
            start, size = start[own.indices.to_numpy()], size[own.indices.to_numpy()]
        except UnicodeEncodeError:
            ids, size = self._ids_of_all(words)
            start = np.cumsum(size) - size
        until = np.r_[0, np.cumsum(size[places])][ends].tolist()
        ids = ragged(ids, start[places], size[places])
        for i, a, b in zip(at, until[:-1], until[1:], strict=True):
            out[i] = ids[a:b]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text."""
        return self.encode_all([text])[0]

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each array of ids; bytes that are no UTF-8 become U+FFFD."""
        flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
        size = self.text_size[flat]
        data = ragged(self.all_text, self.text_start[flat], size).tobytes()
        until = np.r_[0, np.cumsum(size)][np.cumsum([0, *map(len, ids)])].tolist()
        return [data[a + (self.prefix and data[a : min(a + 1, b)] == b" ") : b].decode("utf-8", "replace") for a, b in zip(until[:-1], until[1:], strict=True)]

    def decode(self, ids) -> str:
        """The text of ids."""
        return self.decode_all([np.asarray(ids, np.int64)])[0]


#: Stands before words without a space before them while texts are parted.
_NO_SPACE = "\0"
#: Words with the white space before them; the second also parts words at newlines, which no piece holds.
_SPACED = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def _of_texts(docs: DataFrame, model: str, key: str, text: str, columns: str, make) -> DataFrame:
    """key and what make(model, texts) gives (Arrow arrays), in batches of GROUP bytes of texts, or of one longer text; ids never leave Arrow, so that nulls and large ones stay as they are."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        try:
            for b in batches:
                ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
                while at < b.num_rows:
                    end = max(at + 1, int(np.searchsorted(ends, GROUP + (int(ends[at - 1]) if at else 0), side="right")))
                    part = b.slice(at, end - at)
                    yield pa.RecordBatch.from_arrays([part.column(0), *make(own, [t or "" for t in part.column(1).to_pylist()])], names=["key", *names])
                    at = end
        finally:  # workers outlive their tasks
            own.store.forget()
            pa.default_memory_pool().release_unused()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, {columns}").withColumnRenamed("key", key)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, decoded for each row of docs. model: a path that every executor has."""

    def make(own: Model, texts: list[str]) -> list[pa.Array]:
        ids = own.encode_all(texts)
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))), pa.array(own.decode_all(ids), pa.string())]

    return _of_texts(docs, model, key, text, "ids array<int>, decoded string", make)


def report(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 and exact (the decoded text is the text) for each row of docs."""

    def make(own: Model, texts: list[str]) -> list[pa.Array]:
        rows = []
        every = own.encode_all(texts)
        for t, ids, back in zip(texts, every, own.decode_all(every), strict=True):
            rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (t or "")))
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_()))]

    return _of_texts(docs, model, key, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean", make)
