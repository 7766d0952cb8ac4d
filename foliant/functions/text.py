"""Text statistics, language and key phrases, all inside one row and on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import config
from foliant.functions.parse import WS, WS_CHARS, is_blank, strip  # noqa: F401


def words(text: Column) -> Column:
    """Tokens between white space; an empty array for blank text."""
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(F.split(strip(text), f"{WS}+"))


def detect_language(text: Column) -> Column:
    latin = F.length(F.regexp_replace(F.lower(text), "[^a-z]+", ""))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return (
        F.when(is_blank(text) | (letters == 0), "unknown")
        .when(latin / letters > 0.8, "english").otherwise("other")
    )


def has_numbers(text: Column) -> Column:
    return text.rlike(config.TEXT_PATTERNS["numbers"])


def has_dates(text: Column) -> Column:
    return text.rlike(config.TEXT_PATTERNS["dates"])


def has_currency(text: Column) -> Column:
    return text.rlike(config.TEXT_PATTERNS["currency"])


def has_email(text: Column) -> Column:
    return text.contains("@") & text.rlike(config.TEXT_PATTERNS["email"])


def has_phone(text: Column) -> Column:
    return text.rlike(config.TEXT_PATTERNS["phone"])


def key_phrases(tokens: Column, top: int = 10, keep: int = 5, min_len: int = 3) -> tuple[Column, Column, Column]:
    """Steps to the most frequent words of a token array, ties by first position.

    Returned as three expressions to be projected one after another (sorted, starts, phrases), each
    reading the one before as a column named ``sorted`` / ``starts``: sort the (word, position)
    pairs, keep the places where runs start, and read counts off the distance between them. That is
    n log n in the row and needs no explode and no shuffle. Arrays are sorted by their natural order,
    which is compared in compiled code.
    """
    pairs = F.sort_array(F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    sorted_ = F.col("sorted")
    word = lambda i: F.get(sorted_, i)["w"]
    n = F.size(sorted_)
    runs = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(word(i - 1) != word(i), F.lit(True)))).otherwise(F.array().cast("array<int>"))
    starts = F.col("starts")
    counted = F.sort_array(F.transform(starts, lambda i, k: F.struct(
        (i - F.coalesce(F.get(starts, k + 1), n)).alias("neg"), F.get(sorted_, i)["p"].alias("p"), word(i).alias("w"))))
    best = F.filter(F.slice(counted, 1, top), lambda x: ~x["w"].isin(*config.STOP_WORDS) & (F.length(x["w"]) > min_len))
    return pairs, runs, F.transform(F.slice(best, 1, keep), lambda x: x["w"])
