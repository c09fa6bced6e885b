"""Token functions. All are column expressions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.functions.words import CLOSED_CLASS, IRREGULAR_FORMS

# \w spelled out: bare \w is ASCII-only in Java.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
TITLE_PREFIX = "title_"


def tokenize(text: Column) -> Column:
    """Lower-cased word tokens; newlines and punctuation separate tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def keep_token(token: Column, closed_class: Sequence[str] = CLOSED_CLASS) -> Column:
    """False for closed-class words and for tokens of digits and underscores only."""
    has_letter = F.translate(token, "0123456789_", "") != ""
    # isin over more than ten values becomes one hash lookup per token.
    return has_letter & ~token.isin(list(closed_class))


def filter_tokens(tokens: Column, closed_class: Sequence[str] = CLOSED_CLASS) -> Column:
    return F.filter(tokens, lambda t: keep_token(t, closed_class))


def suffix_rules(token: Column) -> Column:
    """English suffix rules."""
    n = F.length(token)

    def without(k: int) -> Column:
        return F.substring(token, F.lit(1), n - k)

    def ends(*suffixes: str) -> Column:
        return reduce(or_, [token.endswith(x) for x in suffixes])

    # Most tokens are asked for three endings only; comparing them is cheaper than a pattern.
    plural = (
        F.when(ends("ies") & (n > 4), F.concat(without(3), F.lit("y")))
        .when(ends("sses", "shes", "ches", "xes", "zes") & (n > 4), without(2))
        .when(~ends("ss", "us", "is") & (n > 3), without(1))
        .otherwise(token)
    )
    return (
        F.when(ends("s"), plural)
        .when(ends("ing") & (n > 5), without(3))
        .when(ends("ed") & (n > 4), without(2))
        .otherwise(token)
    )


def base_form(token: Column, irregular: Mapping[str, str] = IRREGULAR_FORMS) -> Column:
    """Table lookup first, then the suffix rules."""
    table = F.create_map(*[F.lit(x) for pair in irregular.items() for x in pair])
    # The map is scanned only for its own keys, found by hash lookup.
    return F.when(token.isin(list(irregular)), F.element_at(table, token)).otherwise(suffix_rules(token))


def lemmatize(tokens: Column, irregular: Mapping[str, str] = IRREGULAR_FORMS) -> Column:
    return F.transform(tokens, lambda t: base_form(t, irregular))


def prefix_title(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.concat(F.lit(TITLE_PREFIX), t))


def lemmas(text: Column) -> Column:
    """Tokenise, drop closed-class words and numbers, reduce to base forms."""
    return lemmatize(filter_tokens(tokenize(text)))


def padded_text(tokens: Column) -> Column:
    """Tokens joined by single spaces with one space at either end."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def add_bigrams(df: DataFrame, name: str, tokens: str = "tokens") -> DataFrame:
    """Add adjacent pairs of the tokens that have at least two characters.

    Two projections: the filtered words are used several times and would be
    computed anew for each use inside one expression.
    """
    words = df.withColumn("_words", F.filter(tokens, lambda t: F.length(t) >= 2))
    n = F.greatest(F.size("_words") - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice("_words", F.lit(1), n),
        F.slice("_words", F.lit(2), n),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return words.withColumn(name, pairs).drop("_words")
