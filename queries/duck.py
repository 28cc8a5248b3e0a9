"""DuckDB text of the scalar rules, written apart from the Spark expressions."""

from __future__ import annotations

from marketlens.functions import fixed_values as fv

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WORD = r"[^\p{L}\p{N}_]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def digits(x: str) -> str:
    return f"translate({x}, '{fv.PERSIAN_DIGITS}{fv.ARABIC_INDIC_DIGITS}', '01234567890123456789')"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def form(x: str) -> str:
    return f"coalesce({digits(clean(f'lower({x})'))}, '')"


def price(x: str) -> str:
    text = f"regexp_replace({digits(x)}, '{'|'.join(fv.CURRENCY_WORDS)}', '', 'g')"
    found = (
        f"list_concat(regexp_extract_all({text}, '([0-9]{{1,3}}(?:[,،][0-9]{{3}})*(?:\\.[0-9]{{2}})?)', 1), "
        f"regexp_extract_all({text}, '([0-9]+)', 1))"
    )
    numbers = f"list_transform({found}, lambda m: try_cast(translate(m, ',،. ', '') AS HUGEINT))"
    largest = f"coalesce(list_max(list_filter({numbers}, lambda n: n > 0)), 0)"
    return f"CASE WHEN {x} IS NULL OR len(list_filter({numbers}, lambda n: n IS NULL)) = 0 THEN try_cast({largest} AS BIGINT) END"


def seller(x: str) -> str:
    out = clean(f"lower(coalesce({x}, ''))")
    for p in fv.SELLER_PREFIXES:
        out = f"trim(regexp_replace({out}, '^{p}', ''))"
    for s in fv.SELLER_SUFFIXES:
        out = f"trim(regexp_replace({out}, '{s}$', ''))"
    return out


def canonical(x: str) -> str:
    """Alias table written out by hand in normal form."""
    known = {
        "پارت سنتر": ["پارت سنتر", "partcenter"],
        "یدک شاپ": ["یدک شاپ", "yadak", "یدک‌شاپ"],
        "اتو پارت": ["اتو پارت", "autopart", "auto part"],
        "کری پارت": ["کری پارت", "carrypart", "carry part"],
        "ایران پارت": ["ایران پارت", "iranpart", "iran part"],
    }
    arms = " ".join(
        f"WHEN {seller(x)} IN ({', '.join(q(v) for v in vs)}) THEN {q(c)}" for c, vs in known.items()
    )
    return f"CASE WHEN coalesce({x}, '') = '' THEN 'UNKNOWN_SELLER' {arms} ELSE {seller(x)} END"


def title(x: str) -> str:
    """Whole-word removal without look-around: separators are doubled first, so
    that each word has its own pair."""
    t = f"lower({clean(f'coalesce({x}, {q(str())})')})"
    doubled = f"regexp_replace({t}, '({NON_WORD})', '\\1\\1', 'g')"
    noise = "|".join(fv.TITLE_NOISE_WORDS)
    removed = f"regexp_replace({doubled}, '(^|{NON_WORD})(?:{noise})($|{NON_WORD})', '\\1\\2', 'g')"
    single = f"regexp_replace({removed}, '({NON_WORD}){NON_WORD}', '\\1', 'g')"
    return clean(single)


def any_in(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def currency(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    return (
        f"CASE WHEN {any_in(t, fv.TOMAN_WORDS)} THEN 'toman' "
        f"WHEN {any_in(t, fv.RIAL_WORDS)} THEN 'rial' ELSE 'unknown' END"
    )


def first_match(f: str, lexicon: dict) -> str:
    arms = " ".join(f"WHEN {any_in(f, terms)} THEN '{key.upper()}'" for key, terms in lexicon.items())
    return f"CASE {arms} ELSE 'UNKNOWN' END"


def last_match(f: str, lexicon: dict) -> str:
    arms = " ".join(
        f"WHEN regexp_matches({f}, {q('|'.join(ps))}) THEN '{key.upper()}'"
        for key, ps in reversed(list(lexicon.items()))
    )
    return f"CASE {arms} ELSE 'UNKNOWN' END"


def categories(f: str, lexicon: dict) -> str:
    """Comma-joined names of the groups that hit."""
    hits = ", ".join(
        f"CASE WHEN {' OR '.join(f'regexp_matches({f}, {q(p)})' for p in ps)} THEN '{key}' END"
        for key, ps in lexicon.items()
    )
    return f"concat_ws(',', {hits})"


def display(x: str, lexicon: dict) -> str:
    arms = " ".join(f"WHEN '{k.upper()}' THEN '{k.title()}'" for k in lexicon)
    return f"CASE {x} {arms} END"


def known(x: str) -> str:
    return f"nullif({x}, 'UNKNOWN')"


def words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def absolute(x: str, base: str) -> str:
    u = f"coalesce({x}, '')"
    return f"CASE WHEN {u} = '' OR starts_with({u}, 'http') THEN {u} ELSE '{base}' || {u} END"


def score(prefix: str = "") -> str:
    p = prefix
    return (
        f"(CASE WHEN coalesce({p}title_raw, '') <> '' THEN 2 ELSE 0 END"
        f" + CASE WHEN coalesce({p}price_raw, 0) <> 0 THEN 3 ELSE 0 END"
        f" + CASE WHEN coalesce({p}seller_name, '') <> '' THEN 2 ELSE 0 END"
        f" + CASE WHEN coalesce({p}product_url, '') <> '' THEN 1 ELSE 0 END"
        f" + CASE WHEN coalesce({p}seller_url, '') <> '' THEN 1 ELSE 0 END"
        f" + CASE WHEN coalesce({p}availability, '') <> '' THEN 1 ELSE 0 END"
        f" + CASE WHEN coalesce({p}currency_unit, '') NOT IN ('', 'unknown') THEN 1 ELSE 0 END)"
    )


def export_toman(p: str = "") -> str:
    x = f"coalesce({p}price_raw, 0)"
    return f"CASE WHEN {p}currency_unit = 'rial' AND {x} > 0 THEN {x} // 10 ELSE {x} END"


def validation(product: str, seller_url: str) -> str:
    return (
        f"coalesce(nullif(concat_ws(chr(10), 'Product: ' || nullif({product}, ''), "
        f"'Seller: ' || nullif({seller_url}, '')), ''), 'No URLs available')"
    )


def numbered(urls: str, label: str) -> str:
    lines = f"list_transform({urls}, lambda u, i: '{label} ' || i || ': ' || u)"
    return f"coalesce(nullif(array_to_string({lines}, chr(10)), ''), 'No URLs available')"


def first_urls(url: str, n: int) -> str:
    return f"coalesce(list_sort(list(DISTINCT nullif({url}, '')) FILTER (nullif({url}, '') IS NOT NULL))[1:{n}], [])"
