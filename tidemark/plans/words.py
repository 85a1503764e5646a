"""Word statistics of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import LETTERS_ANYWHERE, tokens, words

# The letters counted as vowels.
VOWELS = ["a", "e", "i", "o", "u"]


def word_counts(df: DataFrame, text: str) -> DataFrame:
    return words(df, text).groupBy("word").agg(F.count("*").alias("n"))


def most_frequent(counts: DataFrame, key: str, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), F.asc(key)).limit(k)


def vocabulary_size(df: DataFrame, text: str) -> DataFrame:
    return words(df, text).agg(F.count_distinct("word").alias("distinct_words"))


def once_only(df: DataFrame, text: str) -> DataFrame:
    return word_counts(df, text).where("n = 1")


def first_letters(df: DataFrame, text: str) -> DataFrame:
    """One row per token that starts with a letter, column ``letter``."""
    letter = F.lower(F.substring("token", 1, 1))
    return tokens(df, text).select(letter.alias("letter")).where(F.col("letter").rlike("[a-z]"))


def letter_counts(df: DataFrame, text: str) -> DataFrame:
    return first_letters(df, text).groupBy("letter").agg(F.count("*").alias("n"))


def vowel_split(df: DataFrame, text: str) -> DataFrame:
    vowel = F.col("letter").isin(VOWELS)
    return first_letters(df, text).groupBy(vowel.alias("is_vowel")).agg(F.count("*").alias("n"))


def long_word_lengths(df: DataFrame, text: str, longer_than: int = 8) -> DataFrame:
    """How many words have each length: grouped by length at once, so one exchange."""
    kept = words(df, text, LETTERS_ANYWHERE).where(F.length("word") > longer_than)
    return kept.groupBy(F.length("word").alias("word_length")).agg(F.count("*").alias("n"))


def long_word_lengths_by_word(df: DataFrame, text: str, longer_than: int = 8) -> DataFrame:
    """The same by way of a count per word: two exchanges. Kept to compare plans and results."""
    per_word = words(df, text, LETTERS_ANYWHERE).groupBy("word").agg(F.count("*").alias("n_word"))
    kept = per_word.where(F.length("word") > longer_than)
    return kept.groupBy(F.length("word").alias("word_length")).agg(F.sum("n_word").alias("n"))
