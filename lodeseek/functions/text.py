"""Identifier and query-text functions as Columns; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could "
    "should may might shall can need dare ought used to of in for on with at by from "
    "as into through during before after above below between out off over under again further then "
    "once here there when where why how all each every both few more most other some such no "
    "nor not only own same so than too very just because but and or if while about up "
    "what which who whom this that these those am it its i me my we our you your he him his she her they them their"
).split()

# What a query word is widened with.
SYNONYMS = {
    "auth": "authentication authorize authorization login",
    "config": "configuration settings preferences",
    "db": "database sqlite postgres mysql",
    "err": "error exception",
    "fn": "function method",
    "func": "function method",
    "init": "initialize initialization setup",
    "msg": "message",
    "nav": "navigation navigate router",
    "param": "parameter argument",
    "pkg": "package",
    "req": "request",
    "res": "response",
    "repo": "repository",
    "sync": "synchronize synchronization",
    "util": "utility utilities helper",
    "utils": "utility utilities helper",
    "env": "environment",
    "middleware": "interceptor handler",
    "api": "endpoint route",
}

TOKEN = r"[\p{L}\p{N}]+"
_EMPTY = "array<string>"


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def is_stop_word(word: Column) -> Column:
    return F.array_contains(_strings(STOP_WORDS), F.lower(word))


def split_camel(word: Column) -> Column:
    """The parts of a camel-case word: `parseHTTPResponse` gives parse, HTTP, Response."""
    return F.split(F.regexp_replace(F.regexp_replace(word, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"), r"\s+")


def is_camel(word: Column) -> Column:
    return word.rlike("[a-z][A-Z]")


def _no_strings() -> Column:
    return F.array().cast(_EMPTY)


def extract_identifiers(text: Column) -> Column:
    """The camel- and snake-case identifiers of a text, each once and followed by its parts, blank-separated."""
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[a-zA-Z_$][a-zA-Z0-9_$]+"), F.lit(0)))
    kept = F.filter(ids, lambda w: (is_camel(w) | w.contains("_")) & ~((F.length(w) < 6) & is_stop_word(w)))

    def parts(w: Column) -> Column:
        return F.concat(F.array(w), F.when(is_camel(w), split_camel(w)).otherwise(_no_strings()), F.when(w.contains("_"), F.filter(F.split(w, "_"), lambda p: p != "")).otherwise(_no_strings()))

    return F.array_join(F.flatten(F.transform(kept, parts)), " ")


def query_tokens(query: Column) -> Column:
    """The words of a query without punctuation and stop words."""
    words = F.split(F.regexp_replace(query, r"[^A-Za-z0-9_\s]", " "), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~is_stop_word(w))


def prepare_query(query: Column) -> Column:
    """struct(tokens, and_phrases, or_phrases, two_phase) of a query; null when no word is left.

    or_phrases are the words with their parts and synonyms, each once; and_phrases are the words alone
    and count only where there are three or more (two_phase).
    """
    synonyms = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), _strings(v.split()))))
    useful = lambda parts: F.filter(parts, lambda p: (F.length(p) > 1) & ~is_stop_word(p))

    def widened(w: Column) -> Column:
        return F.concat(
            F.array(w), F.when(is_camel(w), useful(split_camel(w))).otherwise(_no_strings()), F.when(w.contains("_"), useful(F.split(w, "_"))).otherwise(_no_strings()), F.coalesce(F.try_element_at(synonyms, F.lower(w)), _no_strings())
        )

    tokens = query_tokens(query)
    two = F.size(tokens) >= 3
    built = F.struct(tokens.alias("tokens"), F.when(two, F.array_distinct(tokens)).otherwise(_no_strings()).alias("and_phrases"), F.array_distinct(F.flatten(F.transform(tokens, widened))).alias("or_phrases"), two.alias("two_phase"))
    return F.when(F.size(tokens) > 0, built)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits (the plain, unstemmed tokenizer)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def identifier_boost(query: Column, text: Column) -> Column:
    """1, plus 0.5 for each camel- or snake-case identifier of the query that the text contains, at most 2.5."""
    ids = F.filter(F.regexp_extract_all(query, F.lit(r"[a-zA-Z_$][a-zA-Z0-9_$]{2,}"), F.lit(0)), lambda w: is_camel(w) | w.contains("_"))
    held = F.size(F.filter(ids, lambda w: F.contains(text, w)))
    return F.least(F.lit(1.0) + F.lit(0.5) * F.greatest(F.coalesce(held, F.lit(0)), F.lit(0)), F.lit(2.5))


def preview(text: Column, length: int = 300) -> Column:
    return F.substring(text, 1, length)
