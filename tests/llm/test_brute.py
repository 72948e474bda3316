"""Operators that SQL cannot express, against plain versions, on whole small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from leafmill.llm import linededup, pieces, simhash, tokenbin
from leafmill.llm.queries import QUERIES
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


def test_token_files(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, wanted = 0, []
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        wanted.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    made = QUERIES["op4_token_id_output"](spark, sf_dir).toPandas().sort_values("doc_id")
    assert list(made.itertuples(index=False, name=None)) == wanted


@pytest.mark.parametrize("n", [0, 1, 2, 4095, 4096, 4097, 12_000])
@pytest.mark.parametrize("kind", ["zipf", "even", "same", "top", "turns"])
def test_range_coder(n, kind):
    rng = np.random.default_rng(n)
    ids = {"zipf": rng.zipf(1.3, n) % 49408, "even": rng.integers(0, 65536, n), "same": np.full(n, 7), "top": np.full(n, 65535), "turns": np.arange(n) * 7919 % 13}[kind].astype(np.uint32)
    table = tokenbin.Table.unpack(tokenbin.Table.of(ids).pack())
    coded = tokenbin.encode_blocks(ids, table)
    counts = [min(tokenbin.BLOCK, n - i) for i in range(0, n, tokenbin.BLOCK)]
    back = tokenbin.decode_blocks(coded, counts, table)
    assert np.array_equal(np.concatenate(back) if back else ids[:0], ids)
    if n > 4096:  # blocks are independent
        assert np.array_equal(tokenbin.decode_blocks(coded[1:2], counts[1:2], table)[0], ids[4096:8192])
    if kind in ("same", "turns") and n == 12_000:
        assert sum(map(len, coded)) < n // 10


def test_wide_ids():
    ids = np.random.default_rng(1).integers(0, 1 << 24, 10_000).astype(np.uint32)
    table = tokenbin.Table.of(ids)
    back = tokenbin.decode_blocks(tokenbin.encode_blocks(ids, table, raw=3), [4096, 4096, 1808], table, raw=3)
    assert np.array_equal(np.concatenate(back), ids)


def test_files_are_small(docs):
    """On real texts: below zlib over blocks of the same size, and about the order-0 entropy, whole files with frequencies and footer."""
    import io

    import public_tokenizers

    out = io.BytesIO()
    writer = tokenbin.Writer(out)
    every = tokenbin.encode_texts(public_tokenizers.path("word_bpe_49k.json"), [t or "" for t in docs["text"]])
    for d, ids in enumerate(every):
        writer.add(d, ids)
    writer.close()
    ids = np.concatenate(every)
    counts = np.unique(ids, return_counts=True)[1]
    entropy = -(counts * np.log2(counts / len(ids))).sum() / len(ids)
    zipped = sum(len(zlib.compress(ids[i : i + tokenbin.BLOCK].astype("<u2").tobytes(), 6)) for i in range(0, len(ids), tokenbin.BLOCK))
    size = len(out.getvalue())
    assert size < 0.9 * zipped and 8 * size / len(ids) < entropy + 0.6, (8 * size / len(ids), entropy, 8 * zipped / len(ids))
    assert [x.tolist() for _, x in tokenbin.read_file(out, size)] == [x.tolist() for x in every]


def test_damage_is_noticed():
    import io

    out = io.BytesIO()
    writer = tokenbin.Writer(out)
    writer.add(3, np.arange(5000, dtype=np.uint32))
    writer.add(None, np.arange(2, dtype=np.uint32))
    writer.close()
    data = out.getvalue()
    assert [(d, len(x)) for d, x in tokenbin.read_file(io.BytesIO(data), len(data))] == [(3, 5000), (None, 2)]
    for at in (20, 3000, len(data) - 60):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(tokenbin.read_file(io.BytesIO(bytes(bad)), len(bad)))


def test_word_store_equals_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aB1é' \n\t 　漢😀.,-_<|>́ßΣς") for _ in range(rnd.randint(0, 80))) for _ in range(400)] + ["a<|endoftext|>b don't I'LL x"]
    assert [a.tolist() for a in tokenbin.encode_texts(path, texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_store_parts_words_as_the_tokenizer_does():
    """U+001C to U+001F are white space to Python but not to the tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rnd = random.Random(6)
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = ["one\x1ctwo !\x1c! x", "\x1c", " \x1f \x1d\x1e"] + [f"a{c}b !{c}! {c}{c} x{c}" for c in spaces]
    texts += ["".join(rnd.choice(["a", "B1", "é'", "!", *spaces]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    assert [a.tolist() for a in tokenbin.encode_texts(path, texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_library_gets_each_word_once_and_many_together(monkeypatch, tmp_path, docs):
    """Words that differ in case or in the punctuation after them are one, and most go to the library many in one text: a call's cost for each word was most of op4's time."""
    import shutil

    import public_tokenizers
    import tokenizers

    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got: list[str] = []

    class Counting:
        from_file = staticmethod(lambda path: Counting(kept=whole))

        def __init__(self, model=None, kept=None):
            self.__dict__["kept"] = kept or library(model)

        def __getattr__(self, name):
            return getattr(self.kept, name)

        def __setattr__(self, name, value):
            setattr(self.kept, name, value)

        def encode_batch_fast(self, texts, **options):
            got.extend(texts)
            return self.kept.encode_batch_fast(texts, **options)

    library = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    path = shutil.copy(public_tokenizers.path("word_bpe_49k.json"), tmp_path)
    texts = ["Word word, WORD. word!) (word", "word word;"] + [t or "" for t in docs["text"]]
    made = tokenbin.encode_texts(path, texts)
    assert [a.tolist() for a in made] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    words = [w for t in got for w in t.split()]
    assert sum(w.lower().strip("!.,;)(") == "word" for w in words) == 2 and len(got) < len({w for t in texts for w in t.split()}) / 10


def test_words_that_look_past_their_parts():
    """Composition, lower case, added tokens and contractions, at the places where words are cut."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rnd = random.Random(7)
    marks = ["H\u0331", "h\u0331,", "\u0331", "=\u0338", "A\u030a.", "İ", "\u212a", "\u0958", "\u1100\u1161", "ΑΣ", "ß", "ǅ", "<|ENDOFTEXT|>", "<|endoftext|>", "<|", "'s", "'S", "'", "'ll", "1", "²", "x", "Y", ".", ",", "…", " ", "\n", "\u00a0", "\x1f", "\x00", "é", "漢", "😀"]
    texts = marks + ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + [""]
    assert [a.tolist() for a in tokenbin.encode_texts(path, texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert [a.tolist() for a in tokenbin.encode_texts(path, ["", ""])] == [[], []]
    assert tokenbin.encode_texts(path, []) == []


def test_other_vocabularies_get_whole_texts(tmp_path):
    """Here white space is part of the words, so that words are not independent."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        own = json.load(f)
    own["normalizer"], own["pre_tokenizer"] = None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(own))
    model, texts = Tokenizer.from_file(str(path)), ["One  two, THREE", "a\n b", ""]
    assert [a.tolist() for a in tokenbin.encode_texts(str(path), texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_store_of_words_is_bounded(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    monkeypatch.setattr(tokenbin, "CACHE", 50)
    monkeypatch.setattr(tokenbin, "GROUP", 100)
    monkeypatch.setattr(tokenbin, "_stores", {})
    texts = [f"word{i} other{i % 7}, {'x' * (i % 130)}" for i in range(200)]
    assert [a.tolist() for a in tokenbin.encode_texts(path, texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(tokenbin._stores[path].store.words) <= 60


def test_carries_run_through_units():
    """Frequent and rare ids in turns move ranges by no unit to three at once, and lanes end at each place of a unit."""
    rng = np.random.default_rng(8)
    for n in (3, 4095, 5000, 8192, 30_001):
        ids = np.where(rng.random(n) < 0.9, 5, rng.integers(0, 65536, n)).astype(np.uint32)
        ids[: n // 3] = rng.integers(0, 3, n // 3)
        table = tokenbin.Table.of(ids)
        counts = [min(tokenbin.BLOCK, n - i) for i in range(0, n, tokenbin.BLOCK)]
        back = tokenbin.decode_blocks(tokenbin.encode_blocks(ids, table), counts, table)
        assert np.array_equal(np.concatenate(back), ids)


def _piece_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(spark, sf_dir, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=_piece_path())
    made = QUERIES["op6_sentencepiece"](spark, sf_dir).toPandas().set_index("doc_id")
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        ids = np.array(library.encode(t or ""), "<u4")
        r = made.loc[d]
        assert (r["n_tokens"], r["ids_sha256"], r["exact"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), True)
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_pieces_of_odd_texts():
    import sentencepiece

    model, library = pieces.load(_piece_path()), sentencepiece.SentencePieceProcessor(model_file=_piece_path())
    rnd = random.Random(3)
    vocabulary = list(model.ids)
    texts = ["", " ", "   a  b ", "\n\n", "x" * 5000, "ab" * 4000, "漢字" * 800, "😀é́"] + ["".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 15))).replace("▁", " ") for _ in range(500)]
    for t in texts:
        ids = model.encode(t).tolist()
        assert ids == library.encode(t), t[:60]
        assert model.decode(ids) == t


def test_each_word_is_searched_once(monkeypatch):
    """Also where a text has more words than the store of 120,000 that there was, which forgot them before they came again."""
    model = pieces.Model(open(_piece_path(), "rb").read())
    calls, plain = [], pieces.Model._ids_of
    monkeypatch.setattr(pieces.Model, "_ids_of", lambda self, word: calls.append(word) or plain(self, word))
    words = [f"w{i:x}" for i in range(130_000)]
    ids = model.encode(" ".join(words + words)).tolist()
    assert len(calls) == len(words) and ids[: len(ids) // 2] == ids[len(ids) // 2 :]


def test_words_come_apart_at_any_white_space(monkeypatch):
    """Texts whose words Arrow parts and those whose words it does not, together, with a store that is always full."""
    import sentencepiece

    monkeypatch.setattr(pieces, "CACHE", 5)
    model, library = pieces.Model(open(_piece_path(), "rb").read()), sentencepiece.SentencePieceProcessor(model_file=_piece_path())
    rnd = random.Random(9)
    texts = ["", " ", "\n", " a", "a ", "a\n b", "a \nb", "\n\na", "a\n", "a  b", "▁a ▁", "a▁ b", "\t x", "a\r\nb"] + ["".join(rnd.choice([" ", " ", "\n", "▁", "  ", "the", "of", "ing", "x", "é", "漢", "\t"]) for _ in range(rnd.randint(0, 12))) for _ in range(1500)]
    made = model.encode_all([*texts, None])
    assert [a.tolist() for a in made] == [*map(library.encode, texts), []]
    assert model.decode_all(made) == [*(t.replace("▁", " ") for t in texts), ""]  # U+2581 is white space to the model
    odd = [t.replace("x", "\0").replace("of", "\ud800") for t in texts]
    plain = [[int(i) for w in model._words(t) for i in np.frombuffer(model._ids_of(w), "<u4")] for t in odd]
    assert [a.tolist() for a in model.encode_all(odd)] == plain


def test_unigram_search_is_optimal():
    """The same vocabulary as a unigram model: path scores equal those of a search over the whole text."""
    model = pieces.Model(open(_piece_path(), "rb").read())
    model.kind = pieces.UNIGRAM
    model.nodes |= model.ids
    rnd = random.Random(4)
    for _ in range(60):
        text = "▁" + "".join(rnd.choice("etaoin shrdlu") for _ in range(rnd.randint(1, 150))).replace(" ", "▁")
        best = [0.0] + [float("-inf")] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - model.longest), j):
                p = model.ids.get(text[i:j])
                if p is not None or j - i == 1:
                    best[j] = max(best[j], best[i] + (model.unknown_score if p is None else model.scores[p]))
        found = [p for run in model.search(text) for p in run]
        assert "".join(found) == text
        assert sum(model.scores[model.ids[p]] if p in model.ids else model.unknown_score for p in found) == pytest.approx(best[-1])


def test_line_dedup(spark, sf_dir, docs):
    made = QUERIES["op7_line_dedup"](spark, sf_dir).toPandas().set_index("doc_id")
    for d, t, kept in zip(docs["doc_id"], docs["text"], brute.dedup_lines(docs["text"]), strict=True):
        r = made.loc[d]
        n = len((t or "").split("\n")) if t is not None else 0
        assert (r["n_lines"], r["n_removed"], r["kept_sha256"]) == (n, max(n, 1) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())


def _typos(line, n, rnd, letters="abcdefgh ij"):
    x = list(line)
    for _ in range(n):
        k, at = rnd.randint(0, 2), rnd.randrange(len(x))
        if k == 0:
            x[at] = rnd.choice(letters)
        elif k == 1:
            x.insert(at, rnd.choice(letters))
        elif len(x) > 24:
            del x[at]
    return "".join(x)


@pytest.mark.parametrize(("levels", "most"), [(0, 0), (2, 1_000_000)])
def test_edit_join_finds_all(spark, levels, most, monkeypatch):
    """Lines that differ by 0 to 4 edits, in one large group with a common start and many small ones; places refined, split into blocks; tables broadcast or salted."""
    from pyspark.sql import functions as F

    from leafmill.llm import common

    monkeypatch.setattr(common.meet, "__defaults__", ("inner", most))
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh ij") for _ in range(rnd.randint(24, 60))) for _ in range(40)]
    lines = sorted({x for b in base for x in [b] + [_typos(b, rnd.randint(1, 4), rnd) for _ in range(4)] if len(x) >= 24})
    hot = "the very same beginning of a line "
    lines += [hot + f"{i:02d}" for i in range(60)] + [hot + "".join(rnd.choice("abcdefgh") for _ in range(14)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(lines)), "at long, text string").withColumn("fp", F.lit(0).cast("long"))
    shared = linededup._places(frame, False).select(F.col("k1").alias("key")).distinct()
    found = {frozenset((r["a"], r["b"])) for r in linededup.links(frame, shared, place=16, levels=levels)[0].collect()}
    at = {r["id"]: r["at"] for r in frame.select("at", linededup._id(F.col("text")).alias("id")).collect()}
    mine = brute.components(len(lines), [tuple(at[i] for i in p) for p in found])
    assert mine == brute.line_classes(lines)
    assert all(brute.edit_distance(*[lines[at[i]] for i in p]) <= 4 for p in found)  # a star's rays may be two steps


def test_short_lines_go_where_they_are_equal(spark):
    """Lines of 1 to 23 characters, blank ones, and the place where lines become long."""
    rnd = random.Random(2)
    some = ["Read more", "a", "b", "Ä" * 23, "x" * 22 + "y", "All rights reserved.", "a line of 24 characters!", "a line of 24 characters?", "a line of 23 character!", "a line of 23 character?"]
    docs = ["\n".join(rnd.choice([*some, "", " \t", f"only here {i}"]) for _ in range(rnd.randint(1, 12))) for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    made = {r["doc_id"]: r for r in linededup.report(frame).collect()}
    for i, (t, kept) in enumerate(zip(docs, brute.dedup_lines(docs), strict=True)):
        assert (made[i]["n_removed"], made[i]["kept_sha256"]) == (len(t.split("\n")) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    whole = {r["doc_id"]: r["text"] for r in linededup.clean(frame).collect()}
    assert whole == {i: "\n".join(kept) for i, (t, kept) in enumerate(zip(docs, brute.dedup_lines(docs), strict=True)) if brute.words("\n".join(kept)) or "\n".join(kept) == t}


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_banded_distance(edits):
    rnd = random.Random(edits)
    pairs = []
    for _ in range(400):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(24, 50)))
        b = _typos(a, rnd.randint(0, edits + 3), rnd, "abc")
        if abs(len(a) - len(b)) <= edits:
            pairs.append((a, b))
    x, nx = linededup._codes([a for a, _ in pairs])
    y, ny = linededup._codes([b for _, b in pairs])
    assert linededup.within(x, y, nx, ny, edits).tolist() == [brute.edit_distance(a, b) <= edits for a, b in pairs]


def test_simhash(spark, sf_dir, docs):
    made = QUERIES["op10_simhash"](spark, sf_dir).toPandas().set_index("doc_id")
    fps, of = brute.near(docs["text"])
    for i, d in enumerate(docs["doc_id"]):
        assert made.loc[d, "fingerprint"] == f"{fps[i]:016x}"
        assert made.loc[d, "component_id"] == docs["doc_id"][of[i]]


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_pigeonhole_finds_all(spark, parts):
    """Random, correlated and clustered fingerprints, with places split into blocks."""
    rnd = random.Random(parts)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for base in list(fps)[:40]:
        for _ in range(6):
            x = base
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    hot = rnd.getrandbits(64)
    fps |= {hot ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    fps |= {rnd.getrandbits(16) for _ in range(200)}  # upper bits all alike
    own = sorted(fps)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in own], "fp bigint")
    links = [tuple(v & (1 << 64) - 1 for v in r) for r in simhash.links(frame, parts, place=64).collect()]
    at = {x: i for i, x in enumerate(own)}
    wanted = brute.components(len(own), [(i, j) for i in range(len(own)) for j in range(i) if (own[i] ^ own[j]).bit_count() <= 3])
    assert brute.components(len(own), [(at[a], at[b]) for a, b in links]) == wanted


def test_allocation_is_least():
    from itertools import product

    rng = np.random.default_rng(0)
    costs = np.concatenate([np.zeros((4, 1, 50)), np.sort(rng.random((4, 4, 50)), axis=1)], axis=1)
    radii = simhash.allocate(costs, 0)
    assert (radii.sum(axis=0) == 0).all()
    for k in range(50):
        best = min(sum(costs[i, r[i] + 1, k] for i in range(4)) for r in product(range(-1, 4), repeat=4) if sum(r) == 0)
        assert sum(costs[i, radii[i, k] + 1, k] for i in range(4)) == pytest.approx(best)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_components_of_stars_and_paths(spark, most, monkeypatch):
    """Centres with far more edges than DEGREE, both largest and smallest of their stars, paths, circles and single edges."""
    from leafmill.llm import common, components

    monkeypatch.setattr(common.meet, "__defaults__", ("inner", most))
    rnd = random.Random(3)
    pairs = [(0, i) for i in range(1, 300)] + [(999, i) for i in range(700, 950)] + [(i, i + 1) for i in range(400, 440)] + [(400, 440)]
    pairs += [(i, i + 1) for i in range(500, 600, 2)] + [(7, 7)] + [tuple(rnd.sample(range(600, 690), 2)) for _ in range(40)]
    found = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    wanted = brute.components(1000, pairs)
    assert found == {n: wanted[n] for n in {x for p in pairs if p[0] != p[1] for x in p}}
