"""Quality rules, line first: each line passes punctuation, navigation and boilerplate rules or is removed; a document that loses too much text, or fails a rule on the whole, is rejected.

* Punctuation: too many symbols; shouting; a line that breaks off in an ellipsis, as teasers do. Lines without any mark at the end pass: headings, verse and many transcripts have none.
* Navigation: separators of menus and breadcrumbs; or a menu word first, and half of all words from menus.
* Boilerplate: a phrase of it, in four languages, for every BOILERPLATE_WORDS words of the line or fewer. The rule is a density, so that a long line fails as a short one does, and a paragraph that mentions a privacy policy once passes.

All of it is column expressions on one row: no shuffle, no Python, memory in proportion to the longest document.
Null text counts as empty. An empty document has zero counts and is rejected (fewer than 10 words). Repeated rows, and rows with one id, give a result each; there are no ties. An empty table gives no rows. Other columns of the input are neither read nor returned unless `clean` is asked for, which passes them on whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import SPACE, let, split_words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document is rejected if over this percentage of its characters in words stands on removed lines.
MAX_LOST_PERCENT = 50
#: Over this percentage of a line's characters in words being symbols fails the punctuation rule.
MAX_SYMBOL_PERCENT = 15
#: A line of capitals and exclamation marks: at least so many words, over half of which end in "!!".
SHOUT_WORDS = 4
#: Separators of menus and breadcrumbs; a line with three or more, and one for every three words, is navigation.
SEPARATORS = "|»›•·→"
#: How a line ends that breaks off.
ELLIPSIS = r"([.][.][.]|…)[\])\x20\x09-\x0D]*$"
BOILERPLATE = (
    "cookie policy|accept all cookies|privacy policy|terms of (?:use|service)|enable javascript|javascript is (?:disabled|required)"
    "|click here to|subscribe to our newsletter|sign up for our|follow us on|share this (?:page|article|post)|all rights reserved|lorem ipsum"
    "|politique de confidentialité|accepter les cookies|mentions légales|conditions d.utilisation|tous droits réservés|abonnez-vous à|suivez-nous sur|cliquez ici pour|partager cet article"
    "|política de privacidad|aceptar (?:todas )?las cookies|aviso legal|términos de (?:uso|servicio)|todos los derechos reservados|suscríbete a|síguenos en|haz clic aquí|compartir este artículo"
    "|datenschutzerklärung|alle cookies akzeptieren|nutzungsbedingungen|alle rechte vorbehalten|newsletter abonnieren|folgen sie uns|hier klicken|artikel teilen"
)
#: A line with a phrase of boilerplate for so many words or fewer fails.
BOILERPLATE_WORDS = 25
#: Words of menus; a line that begins with one fails if three or more, and half of its words, are among them.
MENU = (
    "home", "menu", "search", "login", "logout", "register", "sitemap", "archive", "contact", "about", "help", "faq", "next", "previous", "categories", "tags",
    "accueil", "rechercher", "connexion", "inscription", "suivant", "précédent", "aide", "inicio", "buscar", "acceder", "registrarse", "contacto", "ayuda", "siguiente", "anterior",
    "startseite", "suche", "anmelden", "registrieren", "kontakt", "hilfe", "weiter", "zurück", "impressum", "übersicht",
)
MENU_LEAST = 3
_LETTERS = "a-zß-öø-ÿ"
_MENU_FIRST = f"^[^{_LETTERS}]*(?:{'|'.join(MENU)})(?:[^{_LETTERS}]|$)"


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def _count_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among chars. One quick search spares most texts the count."""
    return F.when(text.rlike(f"[{chars}]"), F.length(text) - F.length(F.translate(text, chars, ""))).otherwise(0)


def line_fails(line: Column) -> Column:
    """Whether a line breaks the punctuation, navigation or boilerplate rule. A line without words breaks none."""

    def marked(x: Column) -> Column:
        chars, words = _word_chars(x), F.size(split_words(x))
        symbols = F.lit(100) * _count_of(x, SYMBOLS) > F.lit(MAX_SYMBOL_PERCENT) * chars
        shouting = (words >= SHOUT_WORDS) & (F.length(x) - F.length(F.replace(x, F.lit("!!"), F.lit(""))) > words)
        separators = _count_of(x, SEPARATORS)
        return symbols | shouting | ((separators >= 3) & (separators * 4 >= words))

    low = F.lower(line)

    def menu(words: Column) -> Column:
        return (F.size(F.filter(words, lambda w: w.isin(*MENU))) >= MENU_LEAST) & (F.size(F.filter(words, lambda w: w.isin(*MENU))) * 2 >= F.size(words))

    # prose has none of these marks, begins with no menu word and breaks off nowhere: it is done with after four searches
    boilerplate = low.rlike(BOILERPLATE) & (F.size(F.regexp_extract_all(low, F.lit(BOILERPLATE), F.lit(0))) * BOILERPLATE_WORDS >= F.size(split_words(line)))
    navigation = low.rlike(_MENU_FIRST) & let(F.array_remove(F.split(low, f"[^{_LETTERS}]+"), ""), menu)
    return (line.rlike(f"[{SYMBOLS}{SEPARATORS}]|!!") & marked(line)) | line.rlike(ELLIPSIS) | navigation | boilerplate


def repeated_words(words: Column) -> Column:
    """How many words stand in 5-word windows that are found twice or more among the words."""
    n = F.size(words)

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def twice(found: Column) -> Column:
        again = F.filter(found, lambda x, i: F.coalesce(F.get(found, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(found, i + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(again, lambda x: x["p"])), covered)

    def of(hashes: Column) -> Column:
        placed = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), twice)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed).otherwise(0)

    hashes = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
    return F.when(n >= WINDOW, let(hashes, of)).otherwise(0)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Two structs for each row of docs: row, its columns, and q: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept, clean_text (the lines that pass, joined by newlines)."""
    made = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    whole = F.coalesce(F.col("row")[text], F.lit(""))
    made = made.select("row", whole.alias("whole"), split_words(whole).alias("words"), F.split(whole, "\n").alias("lines"))
    made = made.select(
        "row", "whole", "words", "lines",
        F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("spoken"), F.transform("lines", line_fails).alias("bad"),
        F.length(F.array_join("words", "")).alias("word_chars"),
    )
    made = made.select(
        "row", "word_chars", F.size("words").alias("n_words"), _count_of(F.col("whole"), SYMBOLS).alias("n_symbols"),
        (F.size("spoken") - F.size(F.array_distinct("spoken"))).alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array_join(F.filter("lines", lambda x, i: ~F.get(F.col("bad"), i)), "\n").alias("clean_text"),
        F.when(F.array_contains("bad", True), _word_chars(F.array_join(F.filter("lines", lambda x, i: F.get(F.col("bad"), i)), "\n"))).otherwise(0).alias("lost_chars"),
    )
    made = made.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * F.lit(100).cast("long") > F.col("n_words") * F.lit(MAX_REPEAT_PERCENT).cast("long")))
    kept = ~F.col("base_failed") & (F.col("lost_chars") * F.lit(100).cast("long") <= F.col("word_chars") * F.lit(MAX_LOST_PERCENT).cast("long"))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars")]
    return made.select("row", F.struct(*counts, "base_failed", kept.alias("kept"), "clean_text").alias("q"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of figures and verdicts for each row of docs."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    return measure(docs.select(key, text), text).select(F.col("row")[key].alias(key), *[F.col("q")[n].alias(n) for n in names])


def clean(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents that stay, with failing lines removed and the length column, if there is one, brought up to date; columns as they came."""
    # rows are dropped by exploding none or one: a filter would be pushed below the projections and work everything out anew, once for each line
    passed = F.when(F.col("q")["kept"], F.array(F.struct("row", F.col("q")["clean_text"].alias("new"))))
    kept = measure(docs, text).select(F.explode(passed).alias("k")).select("k.row", "k.new")
    new = {text: F.col("new")} | ({length: F.length("new").cast("long")} if length in docs.columns else {})
    return kept.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS l FROM d),
win AS (SELECT doc_id, i, w[i:i+{WINDOW - 1}] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n >= 2),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + k AS p FROM again, range({WINDOW}) r(k)) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(l) AS x FROM w),
judged AS (SELECT doc_id, x, lower(x) AS y, list_filter(regexp_split_to_array(lower(x), '[^{_LETTERS}]+'), lambda y: y <> '') AS m, length(regexp_replace(x, '[ \t-\r]+', '', 'g')) AS c, len(list_filter(regexp_split_to_array(x, '[ \t-\r]+'), lambda y: y <> '')) AS n,
  length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS s, length(x) - length(replace(x, '!!', '')) AS sh, length(x) - length(regexp_replace(x, '[|»›•·→]', '', 'g')) AS sep FROM line),
lost AS (SELECT doc_id, sum(CASE WHEN 100 * s > {MAX_SYMBOL_PERCENT} * c OR (sh > n AND n >= {SHOUT_WORDS}) OR (sep >= 3 AND sep * 4 >= n) OR regexp_matches(x, '{ELLIPSIS}')
  OR (regexp_matches(y, '{BOILERPLATE}') AND len(regexp_extract_all(y, '{BOILERPLATE}')) * {BOILERPLATE_WORDS} >= n)
  OR (regexp_matches(y, '{_MENU_FIRST}') AND len(list_filter(m, lambda k: k IN {MENU})) >= {MENU_LEAST} AND len(list_filter(m, lambda k: k IN {MENU})) * 2 >= len(m)) THEN c ELSE 0 END) AS lost_chars FROM judged GROUP BY doc_id),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ \t-\r]+', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (SELECT count(*) - count(DISTINCT x) FROM (SELECT unnest(l) AS x) WHERE regexp_matches(x, '[^ \t-\r]'))::BIGINT AS n_dup_lines FROM w)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept, lost_chars::BIGINT AS lost_chars
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base LEFT JOIN rep USING (doc_id) JOIN lost USING (doc_id))
"""
