"""When are two offers near-duplicates, and which pairs are."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import fixed_values as fv
from marketlens.functions.text import let, normalize_part_title, normalize_seller_name, words
from marketlens.operators.sellers import canonical_seller
from marketlens.session import materialize

BLOCK = ["part_id", "seller_canonical"]
SIGNATURE = ["title_norm", "price"]
# A hair wider than the log of the largest price ratio allowed, so that similar
# prices are at most one bucket apart whatever the rounding of the logarithm.
BUCKET_WIDTH = -math.log(1 - fv.MAX_PRICE_GAP) * 1.0001
SMALL_BLOCK = 64


def with_signature(
    offers: DataFrame, seller: Column | None = None, title: Column | None = None
) -> DataFrame:
    """Adds the canonical seller, the normalised title and the price (NULL is 0).

    `seller` and `title` name columns that hold them already.
    """
    if seller is None:
        offers = offers.withColumn("_seller", normalize_seller_name(F.col("seller_name")))
        seller = canonical_seller(F.col("seller_name"), norm=F.col("_seller"))
    return offers.withColumns(
        {
            "seller_canonical": seller,
            "title_norm": normalize_part_title(F.col("title_raw")) if title is None else title,
            "price": F.coalesce(F.col("price_raw"), F.lit(0).cast("bigint")),
        }
    ).drop("_seller")


def signature_md5() -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*BLOCK, *SIGNATURE)]
    return F.md5(F.concat_ws(":", *parts))


def completeness_score() -> Column:
    """0..11: how much of an offer is filled in."""
    score = F.lit(0)
    for name, weight in fv.COMPLETENESS_WEIGHTS.items():
        c = F.col(name)
        filled = c != 0 if name == "price_raw" else c != ""
        if name == "currency_unit":
            filled = filled & (c != "unknown")
        score = score + F.when(filled, weight).otherwise(0)
    return score


def price_bucket(price: Column) -> Column:
    return F.floor(F.ln(price.cast("double")) / F.lit(BUCKET_WIDTH))


def _of(row: str | Column, name: str) -> Column:
    return F.col(f"{row}.{name}") if isinstance(row, str) else row[name]


def similar(a: str | Column, b: str | Column) -> Column:
    """Similarity of two offers of one part and seller, as columns `a.*`, `b.*` or structs.

    The title test is skipped when a title is empty, the price test when a price
    is not positive: such offers are similar to many unlike ones, by design.
    """
    pa, pb = _of(a, "price"), _of(b, "price")
    no_title = (_of(a, "title_norm") == "") | (_of(b, "title_norm") == "")
    no_price = (pa <= 0) | (pb <= 0)
    return (no_price | similar_prices(pa, pb)) & (no_title | similar_titles(a, b))


def similar_titles(a: str | Column, b: str | Column) -> Column:
    """Of two titles with words: about equal lengths, and most words in common."""
    la, lb = (F.length(_of(s, "title_norm")).cast("double") for s in (a, b))
    wa, wb = _of(a, "words"), _of(b, "words")
    shared = F.size(F.array_intersect(wa, wb))
    union = F.size(wa) + F.size(wb) - shared
    titles = (
        F.try_divide(F.least(la, lb), F.greatest(la, lb)) >= fv.MIN_LENGTH_RATIO
    ) & (F.try_divide(shared.cast("double"), union.cast("double")) >= fv.MIN_WORD_OVERLAP)
    return F.coalesce(titles, F.lit(False))


def similar_prices(pa: Column, pb: Column) -> Column:
    gap = F.try_divide(F.abs(pa - pb).cast("double"), F.greatest(pa, pb).cast("double"))
    return F.coalesce(gap <= fv.MAX_PRICE_GAP, F.lit(False))


def with_rare_words(titles: DataFrame) -> DataFrame:
    """Adds `prefix`: the words that a similar title has one of, in order of rising frequency.

    `titles` has one row for each title of a block, with its `words`.  Two word sets that
    overlap enough share a word among the first of each in any order that both follow;
    with rare words first, few titles meet at each.
    """
    each = titles.select(*BLOCK, "title_norm", F.explode("words").alias("word"))
    counts = each.groupBy(*BLOCK, "word").agg(F.count(F.lit(1)).alias("n"))
    named = counts.select(*[F.col(c).alias(f"_{c}") for c in (*BLOCK, "word", "n")])
    same_word = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in BLOCK] + [F.col("word") == F.col("_word")]
    ordered = (
        each.join(named, same_word)
        .groupBy(*BLOCK, "title_norm")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), "word"))).alias("ordered"))
    )
    size = F.size("ordered")
    needed = F.ceil(size * F.lit(fv.MIN_WORD_OVERLAP) - F.lit(1e-9)).cast("int")
    return ordered.select(*BLOCK, "title_norm", F.slice("ordered.word", 1, size - needed + 1).alias("prefix"))


def signature_classes(offers: DataFrame) -> DataFrame:
    """Offers with equal part, seller, title and price become one counted row."""
    return (
        with_signature(offers)
        .groupBy(*BLOCK, *SIGNATURE)
        .agg(F.count(F.lit(1)).alias("offers"))
        .withColumn("words", words(F.col("title_norm")))
    )


def similar_pairs(offers: DataFrame, small_block: int = SMALL_BLOCK) -> DataFrame:
    """Near-duplicate pairs of distinct signatures, with their numbers of copies.

    Copies are counted, not paired: `pairs` says how many offer pairs a row
    stands for, and a row with both signatures equal stands for the pairs among
    copies.  The sum of `pairs` is the number of near-duplicate offer pairs.

    A block (part and seller) with few signatures is joined whole.  A larger one
    is joined on keys that any similar pair must share: a word among the first
    of each title (Jaccard prefix filter) and neighbouring price buckets, so
    unlike offers of a hot block never meet.
    """
    classes = signature_classes(offers)
    large = (
        classes.groupBy(*BLOCK)
        .agg(F.count(F.lit(1)).alias("_size"))
        .where(F.col("_size") > small_block)
        .select(*BLOCK, F.lit(True).alias("_large"))
    )
    rows = classes.join(large, BLOCK, "left")

    count = F.size("words")
    needed = F.ceil(count * F.lit(fv.MIN_WORD_OVERLAP) - F.lit(1e-9)).cast("int")
    rows = rows.withColumn(
        "prefix", F.slice(F.array_sort("words"), 1, F.greatest(count - needed + 1, F.lit(0)))
    ).withColumn("bucket", F.when(F.col("price") > 0, price_bucket(F.col("price"))))

    # key = (word, bucket); ANY stands for "every bucket", NONE for "no price",
    # the word '' for "every title"
    ANY, NONE = F.lit(-10).cast("bigint"), F.lit(-11).cast("bigint")
    ALL_TITLES = F.lit("")
    priced, titled = F.col("bucket").isNotNull(), F.col("title_norm") != ""
    b = F.col("bucket")

    def keys(word_list: Column, bucket_list: Column) -> Column:
        return F.flatten(
            F.transform(
                word_list,
                lambda w: F.transform(bucket_list, lambda k: F.struct(w.alias("word"), k.alias("bucket"))),
            )
        )

    whole = F.array(F.struct(ALL_TITLES.alias("word"), ANY.alias("bucket")))
    probe = keys(
        F.when(titled, F.col("prefix")).otherwise(F.array(ALL_TITLES)),
        F.when(priced & titled, F.array(b - 1, b, b + 1))
        .when(priced, F.array(b - 1, b, b + 1, NONE))
        .otherwise(F.array(NONE, ANY)),
    )
    build = keys(
        F.concat(F.col("prefix"), F.array(ALL_TITLES)),
        F.when(priced, F.array(b, ANY)).otherwise(F.array(NONE)),
    )
    is_large = F.coalesce(F.col("_large"), F.lit(False))
    side = [*BLOCK, *SIGNATURE, "words", "prefix", "offers"]
    left = rows.select(*side, F.explode(F.when(is_large, probe).otherwise(whole)).alias("key"), is_large.alias("large"))
    right = rows.select(*side, F.explode(F.when(is_large, build).otherwise(whole)).alias("key"))

    # Which pairs does the probe find from both ends?  Those count once, lower first.
    a_key, b_key = (F.struct(F.col(f"{s}.title_norm"), F.col(f"{s}.price")) for s in "ab")
    a_titled, b_titled = (F.col(f"{s}.title_norm") != "" for s in "ab")
    a_priced, b_priced = (F.col(f"{s}.price") > 0 for s in "ab")
    one_way = F.col("a.large") & (
        (a_titled & b_titled & ~a_priced & b_priced) | (~a_titled & b_titled)
    )
    # Pairs sharing several prefix words count at the first of them.
    shared_prefix = F.array_intersect(F.col("a.prefix"), F.col("b.prefix"))
    first_key = (F.col("a.key.word") == "") | (
        F.col("a.key.word") == F.try_element_at(shared_prefix, F.lit(1))
    )
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in BLOCK] + [
        F.col("a.key.word") == F.col("b.key.word"),
        F.col("a.key.bucket") == F.col("b.key.bucket"),
    ]
    pairs = (
        left.alias("a")
        .join(right.alias("b"), on)
        .where(
            ((one_way & (a_key != b_key)) | (~one_way & (a_key < b_key)))
            & first_key
            & similar("a", "b")
        )
        .select(
            *[F.col(f"a.{c}").alias(c) for c in BLOCK],
            F.least(a_key, b_key).alias("lo"),
            F.greatest(a_key, b_key).alias("hi"),
            F.when(a_key < b_key, F.col("a.offers")).otherwise(F.col("b.offers")).alias("lo_offers"),
            F.when(a_key < b_key, F.col("b.offers")).otherwise(F.col("a.offers")).alias("hi_offers"),
        )
        .select(
            *BLOCK,
            F.col("lo.title_norm").alias("title_a"), F.col("lo.price").alias("price_a"),
            F.col("hi.title_norm").alias("title_b"), F.col("hi.price").alias("price_b"),
            F.col("lo_offers").alias("offers_a"), F.col("hi_offers").alias("offers_b"),
            (F.col("lo_offers") * F.col("hi_offers")).alias("pairs"),
        )
    )
    n = F.col("offers")
    copies = classes.where(n > 1).select(
        *BLOCK,
        F.col("title_norm").alias("title_a"), F.col("price").alias("price_a"),
        F.col("title_norm").alias("title_b"), F.col("price").alias("price_b"),
        n.alias("offers_a"), n.alias("offers_b"),
        F.expr("(offers * (offers - 1)) div 2").alias("pairs"),
    )
    return pairs.unionByName(copies)


def title_links(titles: DataFrame) -> DataFrame:
    """Pairs (title_norm, other) of similar titles of a block, both ways, each with itself.

    Titles meet under a word of both prefixes, if their sizes and the places of that word
    leave room for the overlap that they need, at the first word that they share.
    """
    own_row = [F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (*BLOCK, "title_norm")]
    rows = titles.alias("t").join(with_rare_words(titles).alias("p"), own_row).select("t.*", "p.prefix")
    posted = rows.select("*", F.posexplode("prefix").alias("at", "word"))
    sa, sb = F.size("a.words"), F.size("b.words")
    theta = fv.MIN_WORD_OVERLAP
    needed = F.ceil((sa + sb) * F.lit(theta / (1 + theta)) - F.lit(1e-9))
    room = F.least(sa - F.col("a.at"), sb - F.col("b.at"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in BLOCK] + [
        F.col("a.word") == F.col("b.word"),
        F.col("a.title_norm") < F.col("b.title_norm"),
        F.least(sa, sb) >= F.greatest(sa, sb) * F.lit(theta) - F.lit(1e-9),
        F.col("a.word") == F.try_element_at(F.array_intersect("a.prefix", "b.prefix"), F.lit(1)),
        room >= needed,
        similar_titles("a", "b"),
    ]
    met = posted.alias("a").join(posted.alias("b"), on)
    pair = lambda x, y: F.struct(F.col(f"{x}.title_norm").alias("title_norm"), F.col(f"{y}.title_norm").alias("other"))
    both = met.select(*[F.col(f"a.{c}").alias(c) for c in BLOCK], F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("s"))
    own = titles.select(*BLOCK, "title_norm", F.col("title_norm").alias("other"))
    return both.select(*BLOCK, "s.title_norm", "s.other").unionByName(own)


# Price cells are half as wide as the gap allowed: all prices of a cell are similar, and
# of the cells that a price reaches only the two outermost are reached in part.
_CELL = BUCKET_WIDTH / 2
_UNPRICED, _ALL_PRICED = -1, -2  # cells of their own
_TITLED = "*"  # the series of all titled offers; a title in normal form is never this alone
_LAST = (1 << 63) - 1


def _price_reach(price: Column) -> tuple[Column, Column]:
    """Smallest and largest price similar to one (exact as long as doubles hold prices)."""

    def near(guess: Column) -> Column:
        around = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda k: guess.cast("bigint") + k)
        return F.filter(around, lambda q: (q > 0) & similar_prices(price, q))

    ratio = F.lit(1 - fv.MAX_PRICE_GAP)
    return (
        F.least(price, F.array_min(near(F.ceil(price * ratio)))),
        F.greatest(price, F.array_max(near(F.floor(price / ratio)))),
    )


def _cell(price: Column) -> Column:
    return F.floor(F.ln(price.cast("double")) / F.lit(_CELL)).cast("bigint")


def _points(classes: DataFrame) -> DataFrame:
    """Prices of each series (a title, '' or all titled) by cell, once in rising and once in falling order."""
    priced = F.col("price") > 0
    first = F.struct(F.col("title_norm").alias("t"), F.col("price").alias("p"))
    series = F.when(F.col("title_norm") != "", F.array("title_norm", F.lit(_TITLED))).otherwise(F.array("title_norm"))
    rows = classes.select(
        *BLOCK, F.explode(series).alias("series"), F.when(priced, _cell(F.col("price"))).otherwise(_UNPRICED).alias("cell"),
        "price", "offers", first.alias("first"),
    )
    # equal prices of a series are one point, so a series of all titles has one a price
    points = rows.groupBy(*BLOCK, "series", "cell", F.col("price").alias("v")).agg(
        F.sum("offers").alias("n"), F.min("first").alias("first")
    )
    whole = rows.where(priced).groupBy(*BLOCK, "series").agg(F.sum("offers").alias("n"), F.min("first").alias("first"))
    whole = whole.withColumns({"cell": F.lit(_ALL_PRICED).cast("bigint"), "v": F.lit(0).cast("bigint")})
    once = points.unionByName(whole)
    return once.withColumn("falling", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "v", F.when(F.col("falling"), -F.col("v")).otherwise(F.col("v"))
    )


def _questions(classes: DataFrame, links: DataFrame) -> DataFrame:
    """What each signature asks of each series: cells, up to which price, in which order."""

    def ask(falling: bool, cell: Column, bound: Column) -> Column:
        return F.struct(F.lit(falling).alias("falling"), cell.cast("bigint").alias("cell"), bound.cast("bigint").alias("bound"))

    named = links.select(*[F.col(c).alias(f"_{c}") for c in (*BLOCK, "title_norm")], F.col("other").alias("series"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*BLOCK, "title_norm")]
    rows = classes.select(*BLOCK, *SIGNATURE).join(named, same).select(*BLOCK, *SIGNATURE, "series")
    p, own = F.col("price"), F.col("series") == F.col("title_norm")
    low, high = _price_reach(p)
    rows = rows.withColumns({"_low": low, "_high": high})
    here, first, last = _cell(p), _cell(F.col("_low")), _cell(F.col("_high"))
    everything = F.lit(_LAST)
    inner = F.filter(F.sequence(first, last), lambda k: (k != first) & (k != last) & (k != here))

    def around(cell: Column) -> Column:
        """Its own cell: all of it, or all but itself."""
        but_own = F.array(ask(False, cell, p - 1), ask(True, cell, -p - 1))
        return F.when(own, but_own).otherwise(F.array(ask(False, cell, everything)))

    reach = F.concat(
        F.transform(inner, lambda k: ask(False, k, everything)),
        around(here),
        F.when(first < here, F.array(ask(True, first, -F.col("_low")))).otherwise(F.array()),
        F.when(last > here, F.array(ask(False, last, F.col("_high")))).otherwise(F.array()),
        F.array(ask(False, F.lit(_UNPRICED), everything)),
    )
    no_price = F.concat(F.array(ask(False, F.lit(_ALL_PRICED), everything)), around(F.lit(_UNPRICED)))
    asked = F.explode(F.when(p > 0, reach).otherwise(no_price)).alias("q")
    return rows.select(*BLOCK, *SIGNATURE, "series", asked).select(*BLOCK, *SIGNATURE, "series", "q.*")


def _counts_of_small_blocks(classes: DataFrame) -> DataFrame:
    """`n` and `first` of the other signatures that each is similar to, block by block.

    A block is one array of its few signatures, so each is shuffled once.
    """
    member = F.struct("title_norm", "price", "offers")
    blocks = classes.groupBy(*BLOCK).agg(F.collect_list(member).alias("_members"))
    with_words = F.transform("_members", lambda m: m.withField("words", words(m["title_norm"])))

    def row(a: Column, members: Column) -> Column:
        other = lambda b: (a["title_norm"] != b["title_norm"]) | (a["price"] != b["price"])
        near = F.filter(members, lambda b: other(b) & similar(a, b))
        found = F.transform(near, lambda b: F.struct(b["title_norm"].alias("t"), b["price"].alias("p")))
        return F.struct(
            a["title_norm"].alias("title_norm"), a["price"].alias("price"), a["offers"].alias("offers"),
            F.aggregate(near, F.lit(0).cast("bigint"), lambda n, b: n + b["offers"]).alias("n"),
            F.array_min(found).alias("first"),
        )

    rows = let(with_words, lambda members: F.transform(members, lambda a: row(a, members)))
    return blocks.select(*BLOCK, F.inline(rows))


def _similar_offers() -> list[Column]:
    """The columns of `similar_counts` out of a signature's `n` and `first`."""
    return [
        *[F.col(c) for c in (*BLOCK, *SIGNATURE)],
        F.col("offers"),
        (F.coalesce(F.col("n"), F.lit(0)) + F.col("offers") - 1).alias("similar_offers"),
        F.col("first.t").alias("first_title"),
        F.col("first.p").alias("first_price"),
    ]


def similar_counts(offers: DataFrame, small_block: int = SMALL_BLOCK) -> DataFrame:
    """For each signature: its offers, the offers it is a near-duplicate of, the first such signature.

    Copies of the signature itself count as well; `first_title` and `first_price` are the
    smallest other signature, NULL without one.

    The signatures of a block (part and seller) with few of them are compared in place.
    Of a larger one no pair of signatures is formed.
    """
    counted = materialize(signature_classes(offers).drop("words"), "signature-classes")
    sizes = counted.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > small_block)
    large = materialize(sizes.select(*[F.col(c).alias(f"_{c}") for c in BLOCK]), "large-blocks")
    if large.isEmpty():
        return _counts_of_small_blocks(counted).select(_similar_offers())
    inside = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in BLOCK]
    small = _counts_of_small_blocks(counted.join(large, inside, "left_anti"))
    within = counted.join(large, inside, "left_semi").withColumn("words", words(F.col("title_norm")))
    return small.select(_similar_offers()).unionByName(_counts_of_large_blocks(materialize(within, "large-classes")))


def _counts_of_large_blocks(classes: DataFrame) -> DataFrame:
    """Similar *titles* of a block are found through their rare words; the offers of a title
    (of none, of any) within a price range come from running totals over price cells, which
    also answer for missing prices and titles.
    """
    titles = classes.where(F.col("title_norm") != "").select(*BLOCK, "title_norm", "words").distinct()
    kinds = classes.select(*BLOCK, "title_norm").distinct()
    blank = F.when(F.col("title_norm") == "", F.array(F.lit(""), F.lit(_TITLED))).otherwise(F.array(F.lit("")))
    links = materialize(
        title_links(titles).unionByName(kinds.select(*BLOCK, "title_norm", F.explode(blank).alias("other"))), "title-links"
    )
    points = _points(classes).select(*BLOCK, "series", "falling", "cell", "v", "n", "first", F.lit(0).alias("asks"))
    asked = _questions(classes, links).withColumns({"v": F.col("bound"), "asks": F.lit(1)}).drop("bound")
    running = (
        Window.partitionBy(*BLOCK, "series", "falling", "cell").orderBy("v", "asks").rowsBetween(Window.unboundedPreceding, 0)
    )
    met = points.unionByName(asked, allowMissingColumns=True).withColumns(
        {"n": F.sum("n").over(running), "first": F.min("first").over(running)}
    )
    found = (
        met.where((F.col("asks") == 1) & F.col("n").isNotNull())
        .groupBy(*BLOCK, *SIGNATURE)
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    )
    own = classes.select(*BLOCK, *SIGNATURE, "offers").alias("o")
    on = [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*BLOCK, *SIGNATURE)]
    return own.join(found.alias("f"), on, "left").select("o.*", "f.n", "f.first").select(_similar_offers())
