"""License scans by diagonal voting.

Templates are whole license texts (the folder templates) and the notices that stand for them. Grams that stand in templates of more than one label tell nothing and are left out, so that what GPL and LGPL share speaks for neither.

1. One pass over the documents: the hashes of all rolling five-word grams meet the grams of the templates, a broadcast table of constants. A match votes for the diagonal (place in document minus place in template) it stands on.
2. Votes are added up by document, template and diagonal with a map-side combine; diagonals up to two apart merge (a word more or less in the copy), within a drift of DRIFT words, so a group is one place where part of the template stands.
3. Each group is verified word by word: only grams whose words are equal count, and the label holds if they cover enough of the words that a template has to itself: of a few a share, of many as much as of SPAN words, wherever in the template they stand.

Beside that, base phrases are looked for in each document as they are; their labels always stay.

Null text has no words and no labels, like an empty one; long texts are cut into stretches, so that rows stay small. Rows with one doc_id are judged one by one, equal rows have equal results, and ties cannot be, as all labels that hold are told. Empty tables give no rows. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm.common import NOT_WORD, cut, doc_words, let, runs_of, stretches

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices that stand for a license. The name's first word is the label.
NOTICES = {
    "agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0 notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "gpl notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mit notice": "released under the mit license",
    "mpl-2.0 notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
GRAM = 5
#: Diagonals this close belong together, up to so many from the first of a group.
SHIFT, DRIFT = 2, 16
#: Share of the words a template has to itself, or of SPAN words if they are more, that a group has to cover, and least number of them.
COVER, SPAN, LEAST = 0.6, 40, 5


def _read() -> dict[str, str]:
    """The templates by name, in words as documents have them."""
    found = {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "templates").glob("*.txt"))}
    name = lambda x: re.sub(r"^(l?gpl)-", r"\1 ", x)  # noqa: E731 versions of one license share its label
    texts = {name(k): " ".join(w for w in re.split(NOT_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w) for k, t in found.items()}
    return texts | NOTICES


TEMPLATES = _read()


def label_of(template: str) -> str:
    return template.split(" ")[0]


def template_grams() -> list[tuple[str, int, int, str]]:
    """template, how many of its words such grams cover, place, gram: of those grams that stand in templates of one label only."""
    every = [(name, i, " ".join(w[i : i + GRAM])) for name, text in TEMPLATES.items() for w in [text.split()] for i in range(len(w) - GRAM + 1)]
    labels: dict[str, set[str]] = {}
    for name, _, gram in every:
        labels.setdefault(gram, set()).add(label_of(name))
    own = [x for x in every if len(labels[x[2]]) == 1]
    covered: dict[str, set[int]] = {}
    for name, i, _ in own:
        covered.setdefault(name, set()).update(range(i, i + GRAM))
    return [(name, len(covered[name]), i, gram) for name, i, gram in own]


def phrase_places(words: Column) -> Column:
    """label and place of each base phrase among the words."""

    def of(phrase: str, label: str) -> Column:
        parts = phrase.split()
        rare = max(parts, key=len)

        def starts(w: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (F.get(w, i) == parts[0]) & (F.array_join(F.slice(w, i + 1, len(parts)), " ") == phrase))
            return F.transform(at, lambda i: F.struct(F.lit(label).alias("label"), i.alias("at")))

        return F.when(F.array_contains(words, rare) & F.array_contains(words, parts[0]), let(words, starts)).otherwise(F.expr("array()").cast("array<struct<label:string,at:int>>"))

    return F.concat(*[of(p, label) for p, label in PHRASES.items()])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: doc, fp, n_words, base (label, at); spans: doc, fp, template, label, first, last, cover)."""
    spark = docs.sparkSession
    grams = spark.createDataFrame(template_grams(), "template string, len int, place int, gram string").withColumn("h", F.xxhash64(*[F.get(F.split("gram", " "), F.lit(j)) for j in range(GRAM)]))
    whole = spark.createDataFrame([(None, None, None, None, None)], "template string, len int, place int, gram string, h bigint")
    looked_up = F.broadcast(grams.unionByName(whole).withColumnRenamed("h", "h2"))
    made = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("fp"), doc_words(F.col(text)).alias("w"))
    none = F.expr("array()").cast("array<struct<label:string,at:int>>")
    base = phrase_places(F.col("w"))
    made = made.select("doc", "fp", F.size("w").alias("n_words"), base.alias("base"), F.explode(stretches(F.col("w"), 0, GRAM - 1)).alias("s"))
    own = runs_of(F.col("s"), GRAM)
    whole_row = F.when(F.col("s.first") == 0, F.concat(own, F.array(F.lit(None).cast("bigint")))).otherwise(own)
    made = made.select("doc", "fp", "n_words", F.when(F.col("s.first") == 0, F.col("base")).otherwise(none).alias("base"), "s", whole_row.alias("hs"))
    found = made.select("doc", "fp", "n_words", "base", "s", F.posexplode("hs").alias("i", "h")).join(looked_up, F.col("h").eqNullSafe(F.col("h2")))
    found = found.where(F.col("h").isNull() | (F.array_join(F.slice("s.w", F.col("i") + 1, F.lit(GRAM)), " ") == F.col("gram")))
    at = F.when(F.col("h").isNotNull(), F.col("s.first") + F.col("i"))
    found = found.select("doc", "fp", "template", "len", "place", at.alias("at"), "n_words", F.when(F.col("h").isNull(), F.col("base")).alias("base"))
    found = cut(found)
    by = ("doc", "fp", "template", "len")
    votes = found.where("at IS NOT NULL").withColumn("diagonal", F.col("at") - F.col("place")).groupBy(*by, "diagonal").agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    along = Window.partitionBy(*by).orderBy("diagonal")
    merged = votes.withColumn("starts", (F.col("diagonal") - F.lag("diagonal").over(along) > SHIFT).cast("int")).withColumn("g", F.sum(F.coalesce("starts", F.lit(0))).over(along))
    merged = merged.withColumn("part", F.floor((F.col("diagonal") - F.min("diagonal").over(Window.partitionBy(*by, "g"))) / DRIFT))
    groups = merged.groupBy(*by, "g", "part").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"), (F.max("last") + GRAM - 1).alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + GRAM - 1)))))
    need = F.least(F.col("len"), F.lit(SPAN))
    spans = groups.withColumn("n", covered).where((F.col("n") >= LEAST) & (F.col("n") >= need * F.lit(COVER)))
    spans = spans.select("doc", "fp", "template", F.substring_index("template", " ", 1).alias("label"), "first", "last", F.least(F.col("n") / need, F.lit(1.0)).alias("cover"))
    return found.where("at IS NULL").select("doc", "fp", "n_words", "base"), spans


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs. score: the largest share of a template (of SPAN words of a longer one) that is covered; 1 where a base phrase stands."""
    every, spans = find(docs, key, text)
    by = spans.groupBy(F.col("doc").alias("d2"), F.col("fp").alias("f2")).agg(F.collect_set("label").alias("own"), F.max("cover").alias("cover"))
    rows = every.join(by, F.col("doc").eqNullSafe(F.col("d2")) & (F.col("fp") == F.col("f2")), "left")
    at, names = F.transform("base", lambda x: x["at"]), F.array_distinct(F.transform("base", lambda x: x["label"]))
    none = F.expr("array()").cast("array<string>")
    return rows.select(
        F.col("doc").alias(key), F.col("n_words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.sort_array(names), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union(names, F.coalesce("own", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
tpl(template, text) AS (VALUES {", ".join(f"('{t}', '{x}')" for t, x in TEMPLATES.items())}),
tw AS (SELECT template, string_split(template, ' ')[1] AS label, string_split(text, ' ') AS w FROM tpl),
tg AS (SELECT template, label, i - 1 AS place, array_to_string(w[i:i + {GRAM - 1}], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - {GRAM - 2})) AS i FROM tw)),
og AS (SELECT template, place, gram FROM tg WHERE gram IN (SELECT gram FROM tg GROUP BY gram HAVING count(DISTINCT label) = 1)),
cov AS (SELECT template, count(DISTINCT place + k) AS len FROM og, range({GRAM}) r(k) GROUP BY template),
g AS (SELECT template, len, place, gram FROM og JOIN cov USING (template)),
ph(phrase, label, n) AS (VALUES {", ".join(f"('{p}', '{x}', {len(p.split())})" for p, x in PHRASES.items())}),
pl AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
base AS (SELECT doc_id, count(*) AS n_base, min(i - 1) AS first_word, max(i - 1) AS last_word, list(DISTINCT label) AS labels FROM pl JOIN ph ON w[i:i + n - 1] = string_split(phrase, ' ') GROUP BY doc_id),
votes AS (SELECT DISTINCT doc_id, template, len, place, i - 1 - place AS diagonal FROM (SELECT doc_id, i, array_to_string(w[i:i + {GRAM - 1}], ' ') AS gram FROM pl) JOIN g USING (gram)),
steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, place) > {SHIFT} THEN 1 ELSE 0 END AS s FROM votes),
grp AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, template ORDER BY diagonal, place) AS g FROM steps),
part AS (SELECT *, (diagonal - min(diagonal) OVER (PARTITION BY doc_id, template, g)) // {DRIFT} AS p FROM grp),
spans AS (SELECT doc_id, template, least(any_value(len), {SPAN}) AS need, count(DISTINCT place + k) AS n FROM part, range({GRAM}) r(k) GROUP BY doc_id, template, g, p HAVING count(DISTINCT place + k) >= {LEAST} AND count(DISTINCT place + k) >= least(any_value(len), {SPAN}) * {COVER}),
own AS (SELECT doc_id, list(DISTINCT string_split(template, ' ')[1]) AS labels, max(least(n / need, 1.0)) AS cover FROM spans GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
  (CASE WHEN n_base > 0 THEN 1 ELSE coalesce(cover, 0) END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""
