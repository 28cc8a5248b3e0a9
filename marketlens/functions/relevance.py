"""Relevance of an offer title for a query."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions import fixed_values as fv
from marketlens.functions.classify import Lexicon, matched_categories
from marketlens.functions.text import matches_any, matching_form


def negative_categories(title: Column, lexicon: Lexicon = fv.NEGATIVE_PATTERNS) -> Column:
    return matched_categories(matching_form(title), lexicon)


def positive_categories(title: Column, lexicon: Lexicon = fv.POSITIVE_PATTERNS) -> Column:
    return matched_categories(matching_form(title), lexicon)


def accepted_form(
    form: Column,
    negative: Lexicon = fv.NEGATIVE_PATTERNS,
    positive: Lexicon = fv.POSITIVE_PATTERNS,
) -> Column:
    """No negative pattern and at least one positive one, whatever the group."""
    found = lambda lexicon: matches_any(form, [p for group in lexicon.values() for p in group])
    return ~found(negative) & found(positive)


def relevance_score(
    title_words: Column, query_words: Column, attributes: Mapping[str, Column]
) -> Column:
    """Weighted sum in a fixed order, so that doubles come out the same anywhere."""
    score = F.lit(0.0)
    for name, weight in fv.RELEVANCE_WEIGHTS.items():
        score = score + F.when(attributes[name] != fv.UNKNOWN, weight).otherwise(0.0)
    shared = F.size(F.array_intersect(title_words, query_words))
    overlap = F.when(
        F.size(query_words) > 0,
        F.try_divide(shared.cast("double"), F.size(query_words).cast("double"))
        * F.lit(fv.WORD_OVERLAP_WEIGHT),
    ).otherwise(0.0)
    return F.least(score + overlap, F.lit(1.0))
