"""Client-side browse work rebuilt as Spark jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import category_or_default, clean_keyword, photo_url
from ..plans import hotkeys as HK
from ..plans.ranking import group_position
from ..session import materialize
from ..sources.ledger import Ledger
from . import catalog as C

SEARCH_LIMIT = 60          # fixed value: rows shown per search
SORT_COLLATION = "id"  # Indonesian locale order for client sorts (T14)

INDEX_COLUMNS = ["product_id", "name", "sku", "price", "unit", "category_name",
                 "photo_thumb_url", "photo_large_url"]


def normalize_products(rows: DataFrame, storage_base_url: str | None = None) -> DataFrame:
    """C11: client product shape.  Price NULL -> 0 (T16), blank category ->
    'Lainnya', photo path -> public URL (NULL without a path or a base URL)."""
    base = F.lit(storage_base_url or "")
    has_photos = "photo_thumb_path" in rows.columns
    thumb = photo_url(F.col("photo_thumb_path"), base) if has_photos else F.lit(None).cast("string")
    large = photo_url(F.col("photo_large_path"), base) if has_photos else F.lit(None).cast("string")
    return rows.select(
        *[c for c in ("outlet_id",) if c in rows.columns],
        F.col("product_id"), F.col("name"), F.col("sku"),
        F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"),
        F.col("unit"),
        category_or_default(F.col("category_name")).alias("category_name"),
        thumb.alias("photo_thumb_url"), large.alias("photo_large_url"),
        *[c for c in rows.columns if c not in {"outlet_id", "product_id", "name", "sku", "price", "unit",
                                              "category_name", "photo_thumb_path", "photo_large_path"}],
    )


def product_index(listing: DataFrame, history: DataFrame, suggested: DataFrame) -> DataFrame:
    """First-wins union keyed by product id (listing, then history, then suggestions).

    ``min_by`` keeps the row of the highest-priority list; it aggregates
    partially before the shuffle, so a product present in every outlet's
    history is not a hot key.
    """
    def prep(df: DataFrame, prio: int) -> DataFrame:
        return df.select(*[F.col(c) for c in INDEX_COLUMNS], F.lit(prio).alias("_prio"))

    u = prep(listing, 0).unionByName(prep(history, 1)).unionByName(prep(suggested, 2))
    row = F.struct(*[F.col(c) for c in INDEX_COLUMNS if c != "product_id"])
    agg = u.groupBy("product_id").agg(F.min_by(row, F.col("_prio")).alias("_r"), F.min("_prio").alias("source"))
    return agg.select("product_id", *[F.col(f"_r.{c}").alias(c) for c in INDEX_COLUMNS if c != "product_id"],
                      "source")


def catalog_index(ledger: Ledger, vis: C.Visibility = C.DEFAULT, storage_base_url: str | None = None,
                  include_lists: bool = True, history_vis: C.Visibility | None = None,
                  suggestion_vis: C.Visibility | None = None) -> DataFrame:
    """C12 over the whole ledger: listing + every outlet's history and suggestions.

    The lists may be read under different options (as the reference's functions
    were, version by version); a product in several has the first one's row.
    """
    listing = normalize_products(C.product_listing(ledger, vis=vis), storage_base_url)
    if not include_lists:
        return listing.withColumn("source", F.lit(0))
    hist = normalize_products(C.purchase_history(ledger, vis=history_vis or vis), storage_base_url)
    sugg = normalize_products(C.suggestions(ledger, vis=suggestion_vis or vis), storage_base_url)
    return product_index(listing, hist, sugg)


def _sort_name(col: str = "name") -> Column:
    return F.collate(F.coalesce(F.col(col), F.lit("")), SORT_COLLATION)


def search(index: DataFrame, keywords: list[str], limit: int = SEARCH_LIMIT) -> DataFrame:
    """Literal, case-folded substring search in name or sku.

    One row per shown match: keyword, total ``match_count``, ``pos`` (1..limit)
    by name (locale order), ties in listing order; a repeated keyword counts once.  The per-keyword top-N is a
    ``row_number`` filter that Spark plans as a partial ``WindowGroupLimit``.
    """
    if not keywords:
        raise ValueError("search needs at least one keyword")
    # One pass over the index: each product lists the keywords it holds.
    terms = F.array(*[F.struct(F.lit(k).alias("keyword"), clean_keyword(F.lit(k)).alias("term"))
                      for k in dict.fromkeys(keywords)])
    name, sku = F.lower(F.col("name")), F.lower(F.coalesce(F.col("sku"), F.lit("")))
    held = F.filter(terms, lambda k: (k.term != F.lit("")) & (F.contains(name, k.term) | F.contains(sku, k.term)))
    matches = index.select("*", F.explode(held).alias("_term")).select(*index.columns, F.col("_term.keyword"))
    return _shown_matches(matches, limit)


def search_index(listing: DataFrame, storage_base_url: str | None = None) -> DataFrame:
    """The listing in client shape (C11) plus ``raw_category``, the category
    before 'Lainnya' replaces a blank one: search ties follow listing order."""
    return normalize_products(listing.withColumn("raw_category", F.col("category_name")), storage_base_url)


def _shown_matches(matches: DataFrame, limit: int) -> DataFrame:
    """Per keyword: total ``match_count`` and the first ``limit`` matches by name.

    The client sorts by name with a stable sort, so equal names keep listing
    order: raw category NULLS LAST, then id (when the index carries
    ``raw_category``; else the displayed category)."""
    counts = matches.groupBy("keyword").agg(F.count(F.lit(1)).alias("match_count"))
    tie = F.col("raw_category") if "raw_category" in matches.columns else F.col("category_name")
    w = Window.partitionBy("keyword").orderBy(_sort_name(), tie.asc_nulls_last(), F.col("product_id"))
    top = matches.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)
    return top.join(counts, "keyword").withColumn("pos", F.col("pos").cast("bigint"))


# Keyword index: substrings of this length (shorter keywords use their own length).
GRAM = 3
# Candidates of one keyword that one bucket of its search holds: a keyword whose
# rarest gram is in many products (a one-letter search) is split by product hash.
BUCKET_CANDIDATES = 4096


def _grams(text: Column, n: Column) -> Column:
    """Distinct substrings of length ``n`` of ``text`` (empty when shorter)."""
    count = F.length(text) - n + F.lit(1)
    return F.when(count >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), count), lambda i: F.substr(text, i, n)))).otherwise(
        F.array().cast("array<string>"))


def gram_index(index: DataFrame) -> DataFrame:
    """(n, gram, product_id): every distinct 1..GRAM-character substring of the
    lower-cased name and sku of each product.  Product-sized (times text length)."""
    name = F.lower(F.coalesce(F.col("name"), F.lit("")))
    sku = F.lower(F.coalesce(F.col("sku"), F.lit("")))
    parts = [index.select("product_id", F.lit(n).alias("n"),
                          F.explode(F.array_union(_grams(name, F.lit(n)), _grams(sku, F.lit(n)))).alias("gram"))
             for n in range(1, GRAM + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search_table(index: DataFrame, keywords: DataFrame, keyword_col: str = "keyword",
                 limit: int = SEARCH_LIMIT, product_rows: int | None = None,
                 bucket_candidates: int = BUCKET_CANDIDATES) -> DataFrame:
    """C13 for a table of keywords (e.g. every outlet's search log), same output as ``search``.

    A substring test between two tables is a theta join; here it becomes an
    equi-join.  Every substring of a match contains the keyword's grams, so
    each distinct keyword joins the products holding its *rarest* gram (of
    length ``min(GRAM, len)``, chosen from the gram frequencies); the
    candidates get their product rows and the exact ``contains`` test.
    Keywords are deduplicated first, so a keyword searched by many outlets is
    matched once.  ``product_rows`` (a bound of the index rows, e.g. the
    product count) lets the product-row join use the hot-key join.
    """
    kw = (keywords.select(F.col(keyword_col).alias("keyword")).filter(F.col("keyword").isNotNull()).distinct()
          .withColumn("_k", clean_keyword(F.col("keyword"))).filter(F.col("_k") != F.lit(""))
          .withColumn("_n", F.least(F.lit(GRAM), F.length("_k"))))
    # The gram index is read for the frequencies and for the candidates (and
    # again by the count and the shown rows): written once.
    grams = materialize(gram_index(index), "gram_index")
    freq = grams.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("_f"))
    kwg = kw.select("keyword", "_k", F.col("_n").alias("n"), F.explode(_grams(F.col("_k"), F.col("_n"))).alias("gram"))
    # A gram no product holds has frequency 0: the keyword then has no candidates.
    best = kwg.join(freq, ["n", "gram"], "left").groupBy("keyword", "_k", "n").agg(
        F.min(F.struct(F.coalesce(F.col("_f"), F.lit(0)).alias("f"), "gram")).alias("_best"))
    # One row per distinct keyword, read by both the count and the shown rows:
    # written once, so the keyword source (a whole search log) is read once.
    best = materialize(best.select("keyword", "_k", "n", "_best.gram", F.ceil(F.col("_best.f") / F.lit(bucket_candidates)).cast("int").alias("_fan")),
                       "search_keywords")
    # A keyword's fan-out follows its candidates: their number in buckets of
    # ``bucket_candidates``.  Only grams in more products than a bucket holds are
    # split, at most |gram index| / bucket_candidates of them; these are broadcast.
    split = best.filter(F.col("_fan") > 1).select("n", "gram", F.col("_fan").alias("_parts")).distinct()
    bucket = F.pmod(F.xxhash64("product_id"), F.coalesce(F.col("_parts"), F.lit(1))).cast("int")
    held = grams.join(F.broadcast(split), ["n", "gram"], "left").select("n", "gram", "product_id", bucket.alias("_b"))
    fan = best.filter(F.col("_fan") > 0).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_fan") - 1)))
    cand = fan.join(held, ["n", "gram", "_b"]).select("keyword", "_k", "product_id")
    if product_rows is None:
        rows = cand.join(index, "product_id")
    else:
        rows = HK.dimension_join(cand, index, "product_id", product_rows)
    k = F.col("_k")
    matches = rows.filter(F.contains(F.lower(F.col("name")), k)
                          | F.contains(F.lower(F.coalesce(F.col("sku"), F.lit(""))), k)).drop("_k")
    return _shown_matches(matches, limit)


def category_rollup(listing: DataFrame) -> DataFrame:
    """C14 (outlet-independent part): products per category, in locale order."""
    g = listing.groupBy("category_name").agg(F.count(F.lit(1)).alias("item_count"))
    return g.orderBy(_sort_name("category_name"))


def category_picks(listing: DataFrame, cart: DataFrame, product_rows: int | None = None) -> DataFrame:
    """C14 (per outlet): distinct picked products per category, only where > 0.
    ``product_rows`` (a bound of the listing rows) selects the hot-key join."""
    picked = cart.filter(F.col("qty") > 0).select("outlet_id", "product_id").dropDuplicates()
    cats = listing.select("product_id", "category_name")
    per = (picked.join(cats, "product_id") if product_rows is None
           else HK.dimension_join(picked, cats, "product_id", product_rows))
    counts = per.groupBy("outlet_id", "category_name").agg(F.count(F.lit(1)).alias("picked"))
    totals = listing.groupBy("category_name").agg(F.count(F.lit(1)).alias("item_count"))
    return counts.join(totals, "category_name")


def category_items(listing_raw: DataFrame, category: str | None = None,
                   storage_base_url: str | None = None, group_bound: DataFrame | int | None = None) -> DataFrame:
    """Products of a category in listing order, with 1-based ``pos``.

    ``listing_raw`` is the C6 output (raw category).  A category is ranked in
    one task only below a checked size (``group_bound``: e.g. the product
    table); beyond it the distributed ranking is used.
    """
    raw = listing_raw.withColumn("_raw_cat", F.col("category_name"))
    norm = normalize_products(raw, storage_base_url)
    if category is not None:
        norm = norm.filter(F.col("category_name") == F.lit(category))
    pos = group_position(norm, ["category_name"], [F.col("_raw_cat").asc_nulls_last(),
                                                   F.col("name").asc_nulls_last(), F.col("product_id")],
                         group_bound=group_bound)
    return pos.drop("_raw_cat")


def landing_summary(ledger: Ledger, outlets=None, vis: C.Visibility = C.DEFAULT,
                    limit: int | None = C.DEFAULT_SUGGESTIONS) -> DataFrame:
    """Per outlet the three list sizes and the list opened first.

    No suggestion list is built: an outlet's candidates are the ranked
    (sellable, bought-by-someone) products minus those it bought itself, and
    the latter are exactly its history rows, so
    ``suggestion_count = least(limit, ranked_products - history_count)``.
    """
    n = C.clamp(limit, C.DEFAULT_SUGGESTIONS, 1, C.MAX_SUGGESTIONS)
    if isinstance(outlets, str):
        outlet = C.find_outlet(ledger, outlets)
        if outlet is None:
            return C.no_rows(ledger, C.outlet_field(ledger), ("history_count", "bigint"), ("suggestion_count", "bigint"),
                             ("product_count", "bigint"), ("landing", "string"))
        ids = C.usable_tokens(ledger).filter(F.col("outlet_id") == F.lit(outlet)).select("outlet_id")
    else:
        ids = C.resolve_outlets(ledger, outlets)
    sellable = C.catalog_products(ledger, vis).select("product_id")
    # A semi join with the (unique) sellable ids, as the hot-key dimension join.
    # Both uses below (distinct products, pairs per outlet) read the one shuffle
    # that makes the pairs distinct.
    pairs = HK.dimension_join(C.owned_pairs(ledger), sellable, "product_id", ledger.product_count)
    ranked = pairs.select(F.count_distinct("product_id")).scalar()
    # Counted for every customer; the left join below keeps the asked outlets.
    h = pairs.groupBy(F.col("customer_id").alias("outlet_id")).agg(F.count(F.lit(1)).alias("history_count"))
    n_products = C.product_listing(ledger, vis=vis).select(F.count(F.lit(1))).scalar()
    hc = F.coalesce(F.col("history_count"), F.lit(0)).cast("bigint")
    out = ids.join(h, "outlet_id", "left").select(
        "outlet_id", hc.alias("history_count"),
        F.least(F.lit(n).cast("bigint"), (ranked - hc)).cast("bigint").alias("suggestion_count"),
        n_products.cast("bigint").alias("product_count"),
    )
    return out.withColumn(
        "landing", F.when(F.col("history_count") > 0, F.lit("history"))
        .when(F.col("suggestion_count") > 0, F.lit("new")).otherwise(F.lit("all")))
