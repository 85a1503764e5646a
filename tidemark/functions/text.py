"""Words out of text, and tests on strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as the word of a blank-separated piece. The first takes the letters it
# begins with, the second its first run of letters and apostrophes anywhere, so they differ for a
# piece such as "1abc".
LEADING_LETTERS = "([a-z]+)"
LETTERS_ANYWHERE = "[^ \na-z']*([a-z']+)"
PIECE_START = "(?:^|[ \n])"

# Fixed value: the spellings of a number that are accepted.
NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"


def tokens(df: DataFrame, text: str, name: str = "token") -> DataFrame:
    """One row per blank-separated piece of every line; empty pieces are kept."""
    one_line = F.replace(text, F.lit("\n"), F.lit(" "))
    return df.select(F.explode(F.split(one_line, " ")).alias(name))


def words(df: DataFrame, text: str, pattern: str = LEADING_LETTERS) -> DataFrame:
    """One row per lower-case word, column ``word``; pieces without letters give none.

    One match over the whole text: splitting first would start the regex engine once per piece,
    and again in the filter that drops empty words.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(PIECE_START + pattern), F.lit(1))
    return df.select(F.explode(found).alias("word"))


def is_number(column: Column) -> Column:
    """True for null and empty strings as well: they stand for a missing number."""
    return column.isNull() | (column == "") | column.rlike(NUMBER)
