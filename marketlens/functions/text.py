"""Text and price expressions: Column in, Column out, all inside codegen."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions import fixed_values as fv

# Unicode white space, incl. the no-break spaces and the four ASCII separators
# U+001C..U+001F that Java's \s leaves out.  ZWNJ (U+200C) is not white space.
WHITE_SPACE = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
OTHER_WHITE_SPACE = WHITE_SPACE.replace(r"\x20", r"\x1f")
WORD_CHAR = r"[\p{L}\p{N}_]"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def non_empty(c: Column) -> Column:
    """NULL for the empty string: lets coalesce and join keys treat both alike."""
    return F.nullif(c, F.lit(""))


def plain_words(patterns: Sequence[str]) -> list[str] | None:
    """The words that `patterns` are, if none is more than a word.

    A word that holds another is left out: where it stands, the other does.
    """
    escaped = r"\\(\W)"
    if any(p == "" or re.search(r"[.^$*+?{}\[\]|()\\]", re.sub(escaped, "", p)) for p in patterns):
        return None
    words = dict.fromkeys(re.sub(escaped, r"\1", p) for p in patterns)
    return [w for w in words if not any(o != w and o in w for o in words)]


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether a text has any of `words`; it is computed once."""
    return matches_any(c, [re.escape(w) for w in words])


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    """Whether any of `patterns` is found; the text is computed once.

    Plain words are looked for in the bytes, without decoding the text.  They are one
    literal, so that generated methods stay short.
    """
    words = plain_words(patterns)
    if not words:
        return c.rlike("|".join(patterns))
    return let(c, lambda x: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: x.contains(w)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_digits(c: Column) -> Column:
    return F.translate(
        c, fv.PERSIAN_DIGITS + fv.ARABIC_INDIC_DIGITS, "0123456789" * 2
    )


def clean_whitespace(c: Column) -> Column:
    """Single spaces only, none at the ends.

    The pattern passes over spaces that are fine as they are, so that most texts
    come through without a single replacement.
    """
    return F.trim(F.regexp_replace(c, f"{WHITE_SPACE}{{2,}}|{OTHER_WHITE_SPACE}", " "))


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends, leave the inside alone."""
    return F.regexp_replace(c, f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def matching_form(c: Column) -> Column:
    """Lower case, single spaces, ASCII digits; NULL becomes ''."""
    return or_empty(normalize_digits(clean_whitespace(F.lower(c))))


def words(c: Column) -> Column:
    """Distinct words of an already cleaned text ('' has none)."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))


def extract_price(c: Column) -> Column:
    """Largest positive integer in the text, 0 when there is none.

    NULL if it does not fit 64 bits: never a piece of a longer number.  Each step is
    taken once, by a name for what came before; only longer numbers need decimals.
    """
    text = F.regexp_replace(normalize_digits(c), "|".join(fv.CURRENCY_WORDS), "")
    zero = F.lit(0).cast("bigint")

    def found(x: Column) -> Column:
        plain = F.regexp_extract_all(x, F.lit(fv.PLAIN_NUMBER), F.lit(1))
        # without separators, what the other pattern finds are pieces of these
        return F.when(
            x.rlike("[,،.]"), F.concat(F.regexp_extract_all(x, F.lit(fv.GROUPED_NUMBER), F.lit(1)), plain)
        ).otherwise(plain)

    def largest(numbers: Column) -> Column:
        exact = F.transform(numbers, lambda m: m.try_cast("decimal(38,0)"))
        wide = F.when(~F.exists(exact, lambda n: n.isNull()), F.greatest(F.array_max(exact), F.lit(0)).try_cast("bigint"))
        short = F.greatest(F.array_max(F.transform(numbers, lambda m: m.try_cast("bigint"))), zero)
        return F.when(F.exists(numbers, lambda m: F.length(m) > 18), wide).otherwise(F.coalesce(short, zero))

    def bare(m: Column) -> Column:
        return F.translate(m, "".join(fv.PRICE_SEPARATORS), "")

    return let(text, lambda x: let(F.transform(found(x), bare), largest))


def normalize_seller_name(c: Column) -> Column:
    """Lower, clean, then drop each known prefix and each known suffix once.

    In order: the first prefix, what follows the second, and so on; suffixes
    likewise from the end.  Spaces next to a dropped word go with it.
    """
    prefixes = "^" + "".join(f"(?:{p} *)?" for p in fv.SELLER_PREFIXES)
    suffixes = "".join(f"(?: *{s})?" for s in reversed(fv.SELLER_SUFFIXES)) + "$"
    name = clean_whitespace(F.lower(or_empty(c)))
    return F.regexp_replace(F.regexp_replace(name, prefixes, ""), suffixes, "")


def normalize_part_title(c: Column) -> Column:
    """Lower, clean and drop whole noise words.

    Look-arounds over letters, digits and '_' stand in for \\b, whose meaning
    changes between Java releases.  One alternation is enough: noise words never
    share characters, so removing one cannot create another.
    """
    noise = "|".join(fv.TITLE_NOISE_WORDS)
    title = F.lower(clean_whitespace(or_empty(c)))

    def without(t: Column) -> Column:
        removed = clean_whitespace(F.regexp_replace(t, f"(?<!{WORD_CHAR})(?:{noise})(?!{WORD_CHAR})", ""))
        return F.when(contains_any(t, fv.TITLE_NOISE_WORDS), removed).otherwise(t)

    return let(title, without)


def detect_currency_unit(c: Column) -> Column:
    text = F.lower(or_empty(c))
    return (
        F.when(contains_any(text, fv.TOMAN_WORDS), "toman")
        .when(contains_any(text, fv.RIAL_WORDS), "rial")
        .otherwise("unknown")
    )


def looks_like_price(c: Column) -> Column:
    return F.coalesce(c.rlike(fv.LOOKS_LIKE_PRICE), F.lit(False))


def rial_to_toman(c: Column) -> Column:
    """Floor division by ten (integer `div` alone would truncate toward zero)."""
    ten = F.lit(10).cast("bigint")
    return F.call_function("div", c - F.pmod(c, ten), ten)


def toman_to_rial(c: Column) -> Column:
    """NULL where the product does not fit 64 bits."""
    return F.try_multiply(c, F.lit(10).cast("bigint"))


def format_price(c: Column, currency: str = "toman") -> Column:
    suffix = fv.CURRENCY_SUFFIX.get(currency, "")
    return or_empty(F.concat(F.format_number(c, 0), F.lit(suffix)))


def default_keywords(keywords: Column, part_name: Column) -> Column:
    given = strip(or_empty(keywords))
    return F.when(given == "", F.concat(strip(part_name), F.lit(fv.KEYWORD_SUFFIX))).otherwise(given)


def analysis_text(part_name: Column, part_code: Column) -> Column:
    """Name plus code when there is one, digits and spaces normalised."""
    return clean_whitespace(
        normalize_digits(F.concat_ws(" ", part_name, non_empty(part_code)))
    )
