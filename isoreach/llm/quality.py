"""Line-first quality rules (DataFrame functions only).

Each line is judged by itself for punctuation, navigation and boilerplate;
failing lines go, and a document that loses too much of its text that way is
rejected.  Word statistics of the whole text give a base verdict first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
WHITE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
SYMBOL_CLASS = r"[#*$%&|<>]"
TERMINAL = (".", "!", "?", ";", ":", ",", "\u2026", '"', "'", "\u201d", "\u2019", "\u00bb", ")", "]")
SEPARATORS = ("|", " > ", "\u00bb ", "\u203a ")
#: Navigation words that make a line of their own, by language of the corpus.
NAVIGATION = {
    "en": ("home", "menu", "login", "log in", "sign in", "sign up", "next", "previous", "back to top", "skip to content", "share", "search"),
    "de": ("startseite", "menü", "anmelden", "einloggen", "registrieren", "weiter", "zurück", "nach oben", "zum inhalt springen", "teilen", "suche", "suchen"),
    "fr": ("accueil", "connexion", "se connecter", "inscription", "suivant", "précédent", "haut de page", "aller au contenu", "partager", "rechercher"),
    "es": ("inicio", "menú", "iniciar sesión", "acceder", "registrarse", "siguiente", "anterior", "volver arriba", "ir al contenido", "compartir", "buscar"),
}
#: Phrases of notices that are no prose of the document, by language.
NOTICES = {
    "en": ("cookie", "javascript", "rights reserved", "privacy policy", "terms of", "subscribe", "licensed under", "released under"),
    "de": ("rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "newsletter abonnieren", "lizenziert unter", "veröffentlicht unter"),
    "fr": ("droits réservés", "politique de confidentialité", "conditions générales", "abonnez-vous", "sous licence"),
    "es": ("derechos reservados", "política de privacidad", "términos de uso", "condiciones de uso", "suscríbete", "bajo licencia", "bajo la licencia"),
}
MENU = rf"^{WHITE}*(?:{'|'.join(dict.fromkeys(w for words in NAVIGATION.values() for w in words))})[\x20\x09-\x0D.!:]*$"
BOILERPLATE = tuple(w for words in NOTICES.values() for w in words)


@dataclass(frozen=True)
class LineRules:
    """Parameters of the line rules.

    ``min_unpunctuated``: a line without a terminal mark fails only if it is
    shorter than this many characters (headings, menus), as longer ones are
    prose that was wrapped.  ``max_symbols``: share of symbols that a line may
    have.  ``min_separators``: separators that make a line a navigation bar.
    ``max_loss``: share of the word characters that a document may lose with
    its failing lines.
    """

    min_unpunctuated: int = 40
    max_symbols: float = 0.3
    min_separators: int = 2
    max_loss: float = 0.6


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text contains one of some fixed strings."""
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def without_blanks(text: Column) -> Column:
    """A text without its blanks; the rare ones are only looked for if present."""
    plain = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.when(any_of(text, tuple("\t\x0b\f\r")), F.regexp_replace(text, WHITE + "+", "")).otherwise(plain)


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs without blanks; none for null."""
    text = F.coalesce(text, F.lit(""))
    spaced = F.replace(text, F.lit("\n"), F.lit(" "))
    spaced = F.when(any_of(text, tuple("\t\x0b\f\r")), F.regexp_replace(text, WHITE, " ")).otherwise(spaced)
    return F.array_remove(F.split(spaced, " "), "")


def separators(line: Column) -> Column:
    """How many navigation separators a line has."""
    return sum((F.length(line) - F.length(F.replace(line, F.lit(s), F.lit(s[1:]))) for s in SEPARATORS), F.lit(0))


def line_fails(line: Column, rules: LineRules, marks: Column, hints: Column) -> Column:
    """Whether a line fails.

    ``marks`` tells whether its document has symbols or separators at all, and
    ``hints`` whether it has a boilerplate phrase: most documents have neither,
    and their lines are judged by length and last character alone.
    """
    short = F.length(line) < rules.min_unpunctuated
    last = F.substring(F.rtrim(line, F.lit(BLANKS)), -1, 1)
    punctuation = short & ~last.isin(*TERMINAL)
    menu = short & F.lower(line).rlike(MENU)
    symbols = F.regexp_count(line, F.lit(SYMBOL_CLASS)) > rules.max_symbols * F.length(line)
    bar = separators(line) >= rules.min_separators
    return punctuation | menu | (marks & (symbols | bar)) | (hints & any_of(F.lower(line), BOILERPLATE))


def document_marks(text: Column, n_symbols: Column) -> Column:
    """Whether a document has any symbol or separator."""
    return (n_symbols > 0) | any_of(text, SEPARATORS)


#: Windows are sorted as longs: 33 bits of hash over 31 bits of position, which is as long as an array can be.
POSITION = (1 << 31) - 1


def covered_words(at: str) -> Column:
    """Words that 3-word windows starting at sorted positions cover."""
    steps = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), x + 3) - x))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, n: acc + n)


def with_equal_neighbour(rows: str, same: Callable[[Column, Column], Column]) -> Column:
    """Items of a sorted array that equal the one before or after them."""
    meets = lambda x, at: F.coalesce(same(x, F.get(rows, at)), F.lit(False))
    return F.filter(rows, lambda x, i: meets(x, i + 1) | meets(x, i - 1))


def add_repeated_words(stage: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words in 3-word windows found twice or more.

    ``_w`` holds the words and ``_g`` a hash of each window.  Windows sorted by
    hash give those whose hash repeats, which all repeated ones are among; they
    alone are sorted by their words, and where words are equal, repeat.  Their
    positions tell how many words they cover.  Hashes only narrow the search,
    at every length of text.
    """
    packed = F.transform("_g", lambda g, i: g.bitwiseAND(F.lit(~POSITION)).bitwiseOR(i.cast("bigint")))
    stage = stage.withColumn("_s", F.sort_array(packed))
    stage = stage.withColumn("_c", with_equal_neighbour("_s", lambda x, y: x.bitwiseXOR(y).between(0, POSITION)))
    word = lambda i, k: F.get("_w", i + k)

    def window(x: Column) -> Column:
        i = x.bitwiseAND(F.lit(POSITION)).cast("int")
        return F.struct(word(i, 0).alias("a"), word(i, 1).alias("b"), word(i, 2).alias("c"), i.alias("i"))

    stage = stage.withColumn("_v", F.sort_array(F.transform("_c", window)))
    repeated = with_equal_neighbour("_v", lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]))
    stage = stage.withColumn("_at", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    return stage.withColumn("n_repeat_words", covered_words("_at")).drop("_s", "_c", "_v", "_at", "_g", "_w")


def window_hashes(words: str) -> Column:
    """A hash of every 3-word window; the last two starts, which would reach past the end, have none."""
    ahead = lambda k: F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - k, F.lit(0)))
    windows = F.arrays_zip(F.col(words).alias("a"), ahead(1).alias("b"), ahead(2).alias("c"))
    return F.transform(F.slice(windows, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))


def score_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Statistics, base verdict and the line-first verdict of every document.

    A null or empty text has no words and fails the base.  One row comes out
    for each row that goes in; there is no shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    stage = docs.select("doc_id", text.alias("_t"), words_of(text).alias("_w"))
    stage = stage.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(without_blanks(F.col("_t"))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOL_CLASS)).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0).alias("_lines"),
        "_w",
        window_hashes("_w").alias("_g"),
        any_of(F.lower("_t"), BOILERPLATE).alias("_hints"),
        any_of(F.col("_t"), SEPARATORS).alias("_bars"),
    )
    failing = F.filter("_lines", lambda line: line_fails(line, rules, F.col("_bars") | (F.col("n_symbols") > 0), F.col("_hints")))
    lost = F.aggregate(failing, F.lit(0).cast("long"), lambda acc, line: acc + F.length(without_blanks(line)))
    stage = add_repeated_words(
        stage.select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            "_w",
            "_g",
            lost.alias("lost_chars"),
        )
    )
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stage.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (F.col("lost_chars") <= rules.max_loss * F.col("word_chars"))).alias("kept"),
        "lost_chars",
    )


def clean_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with failing lines taken out of ``text``; other columns stay.

    A null text stays null; a text whose lines all fail becomes empty.
    """
    marks = document_marks(F.col("text"), F.regexp_count("text", F.lit(SYMBOL_CLASS)))
    hints = any_of(F.lower("text"), BOILERPLATE)

    def stays(line: Column) -> Column:
        return (F.length(F.trim(line, F.lit(BLANKS))) == 0) | ~line_fails(line, rules, marks, hints)

    return docs.withColumn("text", F.array_join(F.filter(F.split("text", "\n"), stays), "\n"))
