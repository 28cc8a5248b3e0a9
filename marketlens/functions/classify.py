"""Lexicon expressions: what part, model, side and trim a text speaks of.

A lexicon is an ordered mapping ``key -> terms``.  It is folded into the plan
as literals, so classification is plain codegen with no join and no UDF.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions import fixed_values as fv
from marketlens.functions.text import contains_any, let, matches_any

Lexicon = Mapping[str, Sequence[str]]

PART_LEXICONS: Mapping[str, Lexicon] = {
    "car_model": fv.CAR_MODEL_TERMS,
    "part_type": fv.PART_TYPE_TERMS,
    "side": fv.SIDE_TERMS,
    "variant": fv.VARIANT_TERMS,
    "trim": fv.TRIM_TERMS,
}
TITLE_LEXICONS: Mapping[str, Lexicon] = {
    "car_model": fv.CAR_MODEL_PATTERNS,
    "part_type": fv.POSITIVE_PATTERNS,
    "side": fv.SIDE_PATTERNS,
    "trim": fv.TRIM_PATTERNS,
    "tech": fv.TECH_PATTERNS,
}


def first_match(form: Column, lexicon: Lexicon) -> Column:
    """Upper-cased key of the first entry one of whose terms is in the text.

    `form` is the text in lower case with ASCII digits.  Pass a column, not a
    long expression: it is tested once per key.
    """
    tests = [F.when(contains_any(form, terms), key.upper()) for key, terms in lexicon.items()]
    return F.coalesce(*tests, F.lit(fv.UNKNOWN))


def last_match(form: Column, lexicon: Lexicon) -> Column:
    """Upper-cased key of the last entry one of whose patterns is found."""
    tests = [
        F.when(matches_any(form, patterns), key.upper())
        for key, patterns in reversed(lexicon.items())
    ]
    return F.coalesce(*tests, F.lit(fv.UNKNOWN))


def matched_categories(form: Column, lexicon: Lexicon) -> Column:
    """Names of all entries with a hit, in lexicon order.

    The form is made once, and a text without any pattern is read once, not once an entry.
    """

    def names(x: Column) -> Column:
        hits = [F.when(matches_any(x, p), F.lit(k)) for k, p in lexicon.items()]
        found = matches_any(x, [p for group in lexicon.values() for p in group])
        return F.when(found, F.array_compact(F.array(*hits))).otherwise(F.array().cast("array<string>"))

    return let(form, names)


def known(c: Column) -> Column:
    """NULL for UNKNOWN, so that concat_ws leaves it out."""
    return F.nullif(c, F.lit(fv.UNKNOWN))


def display(c: Column, lexicon: Lexicon) -> Column:
    """Display form of a key (``pro_max`` -> ``Pro_Max``), NULL for UNKNOWN."""
    return F.coalesce(*[F.when(c == k.upper(), k.title()) for k in lexicon])


# --- requested parts: first match --------------------------------------------

def part_key(part_type: Column, side: Column, variant: Column, trim: Column) -> Column:
    middle = F.nullif(F.concat_ws(":", known(side), known(variant)), F.lit(""))
    return F.concat_ws(
        ":", F.lit("BODY"), part_type, F.coalesce(middle, F.lit(fv.UNKNOWN)), trim
    )


def part_display_name(
    m: Mapping[str, Column], fallback: Column, lexicons: Mapping[str, Lexicon] = PART_LEXICONS
) -> Column:
    shown = F.concat_ws(
        " ",
        display(m["car_model"], lexicons["car_model"]),
        display(m["part_type"], lexicons["part_type"]),
        known(m["side"]),
        display(m["trim"], lexicons["trim"]),
        known(m["variant"]),
    )
    return F.coalesce(F.nullif(shown, F.lit("")), fallback)


def extraction_issues(part_type: Column, car_model: Column, side: Column, trim: Column) -> Column:
    unknown = fv.UNKNOWN
    return F.array_compact(
        F.array(
            F.when(part_type == unknown, F.lit(fv.ISSUE_TEXT["part_type"])),
            F.when(car_model == unknown, F.lit(fv.ISSUE_TEXT["car_model"])),
            F.when(
                (side == unknown) & part_type.isin(fv.SIDED_PART_TYPES),
                F.lit(fv.ISSUE_TEXT["side"]),
            ),
            F.when(trim == unknown, F.lit(fv.ISSUE_TEXT["trim"])),
        )
    )


def extraction_is_valid(issues: Column) -> Column:
    return F.size(issues) <= 2


# --- offer titles: last match ------------------------------------------------

def title_attributes(
    form: Column, lexicons: Mapping[str, Lexicon] = TITLE_LEXICONS
) -> dict[str, Column]:
    """Attributes of a title given in matching form."""
    return {name: last_match(form, lexicon) for name, lexicon in lexicons.items()}


def title_part_key(a: Mapping[str, Column]) -> Column:
    return F.concat_ws(":", F.lit("BODY"), a["part_type"], a["side"], a["tech"], a["trim"])


def title_display_name(
    title: Column, a: Mapping[str, Column], lexicons: Mapping[str, Lexicon] = TITLE_LEXICONS
) -> Column:
    shown = F.concat_ws(
        " ",
        display(a["car_model"], lexicons["car_model"]),
        display(a["part_type"], lexicons["part_type"]),
        known(a["side"]),
        display(a["trim"], lexicons["trim"]),
        known(a["tech"]),
    )
    return F.coalesce(F.nullif(shown, F.lit("")), title)
