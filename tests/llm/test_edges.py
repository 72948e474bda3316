"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator and each pipeline stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import decontam, licenses, linededup, pieces, quality, sharding, simhash, substring, tokenbin, warc
from tests.llm import brute

LONG = " ".join(f"w{i % 997}x{i // 7}" for i in range(120_000))
SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards brew a strong potion of herbs near the old stone bridge at dawn"
BIG = (1 << 62) + 1  # no float holds it
#: Names that operators use for columns of their own.
CLASHING = "doc fp row key id words q whole lines at label __doc __fp places item win h n d2 f2 class".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in [*CLASHING, "a.b"])


def _row(i, t):
    return (i, t, None, None, None if t is None else len(t), *["x"] * (len(CLASHING) + 1))


TEXTS = [(1, SENTENCE), (2, None), (3, ""), (4, LONG), (4, LONG), (None, SENTENCE), (BIG, SENTENCE + " again"), (None, None), (7, " \n\t "), (7, "same id other text"), (8, "one"), (9, "cc by\nCC-BY all rights reserved"), (10, "\n".join([SENTENCE, SENTENCE.replace("dog", "dot")]))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([_row(i, t) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    rows = [("b", SENTENCE), ("a", SENTENCE), (None, SENTENCE), ("e", ""), ("n", None), ("s", "stone bridge"), ("s", "stone bridge")]
    return spark.createDataFrame(rows, "item_id string, text string")


def _piece_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _word_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


REPORTS = {
    "quality": lambda d, i: quality.report(d), "decontam": decontam.report, "sharding": lambda d, i: sharding.report(d),
    "tokens": lambda d, i: tokenbin.read(*tokenbin.write(d, _word_path())), "licenses": lambda d, i: licenses.report(d), "pieces": lambda d, i: pieces.report(d, _piece_path()),
    "lines": lambda d, i: linededup.report(d), "substrings": lambda d, i: substring.report(d), "simhash": lambda d, i: simhash.report(d),
}


@pytest.mark.parametrize("name", REPORTS)
def test_every_row_has_a_result(name, docs, none, items):
    made = REPORTS[name](docs, items).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in made) == sorted((i is not None, i or 0) for i, _ in TEXTS)
    empty = REPORTS[name](none, items)
    assert empty.columns == list(made[0].asDict()) and empty.count() == 0


def _of(frame, columns):
    out = {}
    for r in frame.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def test_quality_results(docs):
    made = _of(quality.report(docs), ["n_words", "base_failed", "kept"])
    assert made[2] == made[3] == [(0, True, False)] and made[1] == [(25, False, True)]
    assert made[4] == [(120_000, False, True)] * 2


def test_decontamination_results(docs, items, spark):
    made = _of(decontam.report(docs, items), ["n_hit", "n_items", "contaminated"])
    assert made[1] == [(25, 3, True)] and made[2] == [(0, 0, False)]
    assert made[None] == [(0, 0, False), (25, 3, True)]
    no_items = spark.createDataFrame([], "item_id string, text string")
    assert {r["n_items"] for r in decontam.report(docs, no_items).collect()} == {0}
    assert _of(decontam.report(docs, items), ["n_hit"]) == _of(_in_blocks(docs, items), ["n_hit"])


def _in_blocks(docs, items):
    """The same with the benchmark looked up in blocks of five shingles."""
    kept = decontam.find
    try:
        decontam.find = lambda d, i, k, t: kept(d, i, k, t, 5)
        return decontam.report(docs, items).cache()
    finally:
        decontam.find = kept


def test_license_results(docs):
    made = _of(licenses.report(docs), ["n_base", "first_word", "last_word", "base_labels"])
    assert made[9] == [(3, 0, 4, "cc-by,reserved")] and made[2] == [(0, None, None, "")]


def test_a_changed_template_is_found(spark):
    words = licenses.TEMPLATES["mit"].split()
    words.insert(16, "really")
    gpl = licenses.TEMPLATES["gpl 2.0"].split()
    docs = spark.createDataFrame([(1, "before it " + " ".join(words) + " after"), (2, " ".join(words[:20])), (3, "x " + " ".join(gpl[900:960])), (4, licenses.TEMPLATES["lgpl notice"]), (5, "Released under the MIT License.")], "doc_id long, text string")
    made = _of(licenses.report(docs), ["labels", "n_base"])
    assert made == {1: [("mit", 0)], 2: [("", 0)], 3: [("gpl", 0)], 4: [("gpl,lgpl", 1)], 5: [("mit", 0)]}
    span = min((r for r in licenses.find(docs)[1].collect() if r["doc"] == 1), key=lambda r: r["first"])
    assert 2 <= span["first"] < 20 and span["last"] > 100


def test_every_template_names_its_license_alone(spark):
    """Of whole texts, and of 60 words from the middle of those that are long enough, the label is told."""
    rows = [(name, text) for name, text in licenses.TEMPLATES.items()] + [(name, " ".join(text.split()[len(text.split()) // 2 :][:60])) for name, text in licenses.TEMPLATES.items() if len(text.split()) > 200 and name not in ("bsd",)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    made = _of(licenses.report(docs), ["labels"])
    for i, (name, _) in enumerate(rows):
        assert licenses.label_of(name) in made[i][0][0].split(","), (name, made[i])


def test_lines_that_fail(spark):
    lines = {
        "Home About Contact Login": True, "Accueil, Connexion, Aide": True, "Home is where the heart is.": False, "Help! Help!": False,
        "All rights reserved.": True, "Read our privacy policy " + "and then some more words of a long sentence " * 5 + ".": False,
        "privacy policy " * 60 + ".": True, "word " * 25: False, "The rest of it can be...": True, "[And more…] ": True, "And... so on.": False, "Alle Rechte vorbehalten": True, "a | b | c | d": True,
    }
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    made = {r["line"]: r["f"] for r in frame.select("line", quality.line_fails(F.col("line")).alias("f")).collect()}
    assert made == lines == {x: brute.line_fails(x) for x in lines}


def test_line_results(docs):
    made = _of(linededup.report(docs), ["n_lines", "n_removed"])
    assert made[None] == [(0, 0), (1, 0)]  # null ids come first
    assert made[1] == [(1, 1)] and made[10] == [(2, 2)] and made[4] == [(1, 0)] * 2 and made[2] == [(0, 0)]


def test_substring_results(docs):
    made = _of(substring.report(docs), ["n_words", "n_removed"])
    assert made[None] == [(0, 0), (25, 0)] and made[1] == [(25, 25)] and made[BIG] == [(26, 25)] and made[4] == [(120_000, 0)] * 2


def test_simhash_results(docs):
    made = _of(simhash.report(docs), ["fingerprint", "component_id"])
    assert made[2] == made[3] == made[7][:1] == [("0" * 16, 2)]
    assert made[4][0] == made[4][1]
    assert made[1] == [x for x in made[None] if x[0] != "0" * 16]


def test_token_results(docs):
    made = tokenbin.read(*tokenbin.write(docs, _word_path())).orderBy("start").collect()
    assert [r["doc_id"] for r in made] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in made] == [sum(r["n_tokens"] for r in made[:k]) for k in range(len(made))]
    assert {r["n_tokens"] for r in made if r["doc_id"] in (2, 3)} == {1}


def test_archives(spark):
    body = "ä" * 600
    pages = [(1, "http://a/\r\nx", body), (BIG, None, body), (3, "http://b/", None), (4, None, "short"), (5, None, "short"), (None, "http://c/", body), (None, None, None), (6, None, "y" * 999), (8, None, "y" * 999), (9, None, body), (9, None, body), (10, None, "z" * 300_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "'y' AS payload", "1 AS salt")
    folder, index = warc.write(frame)
    made = warc.read(folder, index).collect()
    assert len(made) == len(pages) == index.count()
    kinds = {}
    for r in made:
        kinds.setdefault(r["page_id"], set()).add((r["record_type"], r["refers_to"]))
    revisit = {("revisit", BIG)}
    assert kinds[1] == kinds[9] == revisit and kinds[BIG] == kinds[4] == kinds[6] == kinds[8] == kinds[10] == {("response", None)}
    assert kinds[None] == {("response", None)} | revisit
    digests = {r["page_id"]: r["payload_digest"] for r in made}
    assert digests[3] == hashlib.sha1(b"").hexdigest() and digests[1] == hashlib.sha1(body.encode()).hexdigest()
    some = warc.read(folder, index.where("page_id IN (3, 10)")).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in some) == [(3, b""), (10, b"z" * 300_000)]
    assert warc.read(*warc.write(frame.limit(0))).count() == 0


def test_ranges_are_read_together():
    assert warc.spans([(0, 10), (100_000, 5), (20, 10)], gap=50, most=1000) == [(0, 30, [0, 2]), (100_000, 100_005, [1])]
    assert [x[2] for x in warc.spans([(i * 10, 10) for i in range(10)], most=50)] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(k, spark, docs, none, tmp_path, items):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    made, empty = stage(spark, docs, str(tmp_path)), stage(spark, none, str(tmp_path))
    assert empty.count() == 0
    ids = [r["doc_id"] for r in made.collect()]
    if k < len(corpus_pipeline.STAGES) - 1:
        assert made.columns == docs.columns == empty.columns
        assert [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
    wanted = [
        [1, 4, 4, None, BIG],  # the near copy within 10 counts as repetition
        [2, 3, 4, 4, None, None, BIG, 7, 7, 8, 9],
        [1, 2, 4, 7, 8, 9],
        [2, 3, 4, 4, 7, 7, 8, 9, None],
        [i for i, _ in TEXTS],
    ][k]
    own = sorted((i is not None, i or 0) for i in ids)
    if k in (0, 1, 3, 4):
        assert own == sorted((i is not None, i or 0) for i in wanted)
    else:
        assert {1, 4, 8, 9} <= set(ids) and ids.count(4) == 1 and None not in ids
