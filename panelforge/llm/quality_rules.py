"""Line-first cleaning and document rules (native: DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .line_dedup import lines_of
from .text import SPACES, let, stripped, text_of

_GAP, _SYMBOL = "[ \t\n\x0b\f\r]+", r"[#*$%&|<>]"

# Phrases and menu words of web pages, in the languages of the corpus.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of (?:use|service)", "enable javascript", "lorem ipsum",
    "subscribe to our", "sign up for our", "click here to", "skip to (?:main )?content", "powered by",
    "alle rechte vorbehalten", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "zum inhalt springen", "newsletter abonnieren",
    "tous droits réservés", "politique de confidentialité", "conditions d[’']utilisation", "aller au contenu", "mentions légales",
    "todos los derechos reservados", "política de (?:privacidad|cookies)", "términos y condiciones", "saltar al contenido", "aviso legal",
)
NAVIGATION = (
    "home", "menu", "login", "log in", "sign in", "register", "search", "next", "previous", "back to top", "read more", "share",
    "contact us", "sitemap",
    "startseite", "menü", "anmelden", "registrieren", "suche", "weiter", "zurück", "nach oben", "mehr lesen", "teilen", "impressum",
    "accueil", "connexion", "se connecter", "s[’']inscrire", "recherche", "suivant", "précédent", "haut de page", "lire la suite", "partager",
    "inicio", "menú", "iniciar sesión", "registrarse", "buscar", "siguiente", "anterior", "volver arriba", "leer más", "compartir",
)
CLOSED = r"""[.!?:;…。！？؟।॥]["'”“’»)\]」』]*$"""

_PART = "[|»>/·-]"


def any_of(patterns: Sequence[str]) -> str:
    """One pattern for all; without any, one that matches nothing."""
    return "|".join(patterns) or "[^\\s\\S]"


def menu_line(navigation: Sequence[str]) -> str:
    """A menu word, then items after separators. An item is a whole run, or ends before a separator that closes the run,
    so a long run of separators isn't tried in all its partitions."""
    return rf"^(?:{any_of(navigation)})(?:\s*+{_PART}\s*+(?:\S++|\S+(?={_PART}\s)))*$"


def unspaced(prefix: str = "Is") -> str:
    """A word's length of characters in scripts that don't part words: two for Han and kana, four for the others.

    ``prefix`` is what the regular expressions of an engine put before the name of a script.
    """
    def scripts(*names: str) -> str:
        return "".join(f"\\p{{{prefix}{n}}}" for n in names)

    return f"[{scripts('Han', 'Hiragana', 'Katakana')}ー]{{2}}|[{scripts('Thai', 'Lao', 'Khmer', 'Myanmar')}]{{4}}"


def unspaced_words(c: Column) -> Column:
    """How many words to add to those parted by white space."""
    return F.when(F.octet_length(c) == F.char_length(c), 0).otherwise(F.regexp_count(c, F.lit(unspaced())))


def words_of(c: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return let(stripped(c), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _GAP, -1)))


def without(c: Column, characters: str) -> Column:
    return F.translate(c, characters, "")


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words inside a window of ``size`` words that the text holds twice or more, the first one included.

    Hashes of the windows show whether any repeats; if so, the windows' own words are sorted and compared.
    """
    def covered(starts):
        gap = F.transform(starts, lambda s, k: F.least(F.lit(size), F.coalesce(F.get(starts, k + 1) - s, F.lit(size))))
        return F.aggregate(gap, F.lit(0), lambda a, b: a + b)

    def exact(w):
        places = F.sequence(F.lit(0), F.size(w) - size)
        windows = F.array_sort(F.transform(
            places, lambda i: F.struct(F.array_join(F.slice(w, i + 1, size), " ").alias("w"), i.alias("i"))))

        def starts(s):
            same = F.filter(s, lambda x, j: (x["w"] == F.coalesce(F.get(s, j - 1)["w"], F.lit("")))
                            | (x["w"] == F.coalesce(F.get(s, j + 1)["w"], F.lit(""))))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        return let(windows, lambda s: let(starts(s), covered))

    def both(a, b):
        return F.xxhash64(a, b)

    def grown(hashes, w, done):
        """Hashes of windows of ``done`` words, made one or twice as long until they have ``size``."""
        if done == size:
            return let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        n = F.size(w)
        if 2 * done <= size:
            return let(hashes, lambda h: grown(F.zip_with(
                F.slice(h, F.lit(1), n - 2 * done + 1), F.slice(h, F.lit(done + 1), n - 2 * done + 1), both), w, 2 * done))
        return let(hashes, lambda h: grown(F.zip_with(
            F.slice(h, F.lit(1), n - done), F.slice(w, F.lit(done + 1), n - done), both), w, done + 1))

    def of(w):
        return F.when(F.size(w) < size, F.lit(0)).when(grown(w, w, 1), exact(w)).otherwise(F.lit(0))

    return let(words, of)


def failing(line: Column, short: int = 3, symbol_pct: int = 30, nav_items: int = 3,
            navigation: Sequence[str] = NAVIGATION, boilerplate: Sequence[str] = BOILERPLATE) -> Column:
    """Whether a line fails: a blank line never does.

    Punctuation: no letter or digit at all, symbols over ``symbol_pct`` of its characters, or ``short`` words or fewer
    without closing punctuation. Navigation: ``nav_items`` or more items parted by ``|``, ``»`` or ``>``, or a line of up
    to five words that is one of the menu words ``navigation``. Boilerplate: one of the phrases ``boilerplate`` in a line of
    up to 25 words. Both are patterns in lower case. Scripts that don't part words count by characters (``unspaced``).
    """
    def rules(t: Column) -> Column:
        length = F.char_length(t)
        closed = t.rlike(CLOSED)
        symbols = F.regexp_count(t, F.lit(_SYMBOL))
        low = F.lower(t)
        items = t.rlike("[|»>]") & (F.size(F.split(t, r"\s[|»>]\s|\s[|»>]$", -1)) >= nav_items)

        def by_words(n: Column) -> Column:
            menu = (n <= 5) & low.rlike(menu_line(navigation))
            return ((n <= short) & ~closed) | menu | ((n <= 25) & low.rlike(any_of(boilerplate)))

        return (t != "") & (
            ~t.rlike(r"[\p{L}\p{N}]") | (symbols * 100 > length * symbol_pct) | items
            | let(F.regexp_count(t, F.lit(_GAP)) + 1 + unspaced_words(t), by_words))

    return let(stripped(line), rules)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat_pct: int = 20,
    max_lost_pct: int = 50, carry: tuple[str, ...] = (), count_unspaced: bool = False,
    navigation: Sequence[str] = NAVIGATION, boilerplate: Sequence[str] = BOILERPLATE,
) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_failed_lines, kept,
    text (the lines that pass), and ``carry``.

    Lines are judged first (``failing``) and removed; a document that loses more than ``max_lost_pct`` of its words'
    characters so is rejected, as is one that fails the base rules: fewer than ``min_words`` words, or more than
    ``max_repeat_pct`` of the words in repeated 5-word windows. A null or empty text has no words and is rejected.
    With ``count_unspaced`` texts in scripts that don't part words reach ``min_words`` by their characters. Repeated rows
    and null ids are judged one by one. No exchange: each row is judged alone.
    """
    out = docs.select(
        F.col(id_col).alias("__id"), text_of(text_col).alias("__text"),
        F.struct(F.lit(0).alias("__0"), *[F.col(c) for c in carry]).alias("__rest"))
    text = F.col("__text")

    def judged(lines: Column) -> Column:
        full = F.filter(lines, lambda x: stripped(x) != "")

        def line_counts(f):
            return F.size(f) - F.size(F.array_distinct(f))

        return let(F.filter(lines, lambda x: ~failing(x, navigation=navigation, boilerplate=boilerplate)), lambda keep: F.struct(
            let(full, line_counts).cast("long").alias("n_dup_lines"),
            (F.size(lines) - F.size(keep)).cast("long").alias("n_failed_lines"), F.array_join(keep, "\n").alias("text")))

    out = out.select(
        "*", let(words_of(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"))).alias("__w"),
        F.regexp_count(text, F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
        let(lines_of(text), judged).alias("__l"))
    n, repeats, chars = F.col("__w.n_words"), F.col("__w.n_repeat_words"), F.col("__w.word_chars")
    known = n + unspaced_words(text) if count_unspaced else n
    base = (known < min_words) | (repeats * 100 > n * max_repeat_pct)
    left = F.when(F.col("__l.n_failed_lines") == 0, chars).otherwise(F.char_length(without(F.col("__l.text"), SPACES)))
    rejected = base | ((chars - left) * 100 > chars * max_lost_pct)
    return out.select(
        F.col("__id").alias(id_col), "__w.n_words", "__w.word_chars", "n_symbols", "__l.n_dup_lines", "__w.n_repeat_words",
        base.alias("base_failed"), "__l.n_failed_lines", (~rejected).alias("kept"), "__l.text",
        *[F.col("__rest")[c].alias(c) for c in carry])
