"""Filters, sorts, search, scores and feeds, each with its SQL where SQL can say it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.functions import score as S
from vitrine.functions.color import hex_to_tag, rgb_to_hsl, tone_class
from vitrine.functions.text import fnv1a, rand01, slugify
from vitrine.operators import catalog_query as C
from vitrine.operators import audits, feed
from vitrine.operators.search import haystack, matches, parse_search, relevance
from vitrine.plans.files import written
from vitrine.plans.catalog import brand_score, fnv_sql, part_condition, PRODUCT_SQL, products, rand_sql, sql_list, STYLES, table

Q: dict = {}
SQL: dict[str, str] = {}
SEED = "s1"
P = f"WITH {PRODUCT_SQL}"
FEED = "category NOT IN (" + ", ".join(f"'{c}'" for c in C.OUT_OF_FEED) + ")"
CAT_W = "CASE category " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in S.CATEGORY_WEIGHT.items()) + " ELSE 0.7 END"
N_GRADED = "len(list_filter(sizes, lambda t: t <> 'TEK BEDEN'))"
BRIGHT = f"len(list_filter(color_tags, lambda t: NOT list_contains({sql_list(S.NEUTRAL_TAGS)}, t)))"


def d(x) -> str:
    """A double literal: decimals would add up exactly where doubles don't."""
    return f"CAST({x} AS DOUBLE)"


def case(*pairs: tuple[str, float], default: float = 0.0) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {d(v)}" for c, v in pairs) + f" ELSE {d(default)} END"


QUALITY = (
    f"least({d(1)}, {case(('n_images >= 4', 0.26), ('n_images >= 2', 0.19), default=0.1)} + {case(('n_variants >= 3', 0.13), ('n_variants >= 2', 0.09), default=0.04)}"
    f" + {case(('price IS NOT NULL', 0.14))} + {case((f'{N_GRADED} >= 6', 0.21), (f'{N_GRADED} >= 4', 0.17), (f'{N_GRADED} >= 2', 0.11), (f'{N_GRADED} = 1', 0.05), ('len(sizes) > 0', 0.04))}"
    f" + {case(('in_stock', 0.1))} + {case(('length(name) BETWEEN 8 AND 46', 0.12), ('length(name) <= 70', 0.06))} + {d(CAT_W)} * {d(0.08)})"
)
BEAUTY = (
    f"least({d(1)}, greatest({d(0)}, {case(('list_contains(styles, ' + chr(39) + 'streetwear' + chr(39) + ')', 0.3))} + {case(('list_contains(styles, ' + chr(39) + 'ravewear' + chr(39) + ')', 0.22))}"
    f" + {case(('list_contains(styles, ' + chr(39) + 'y2k' + chr(39) + ')', 0.2))} + {case(('list_contains(styles, ' + chr(39) + 'techwear' + chr(39) + ')', 0.12))}"
    f" + {case(('list_has_any(styles, [' + chr(39) + 'minimalist' + chr(39) + ', ' + chr(39) + 'basic' + chr(39) + '])', 0.05))}"
    f" + {case(('len(color_tags) = 0', -0.08), (f'{BRIGHT} >= 2', 0.2), (f'{BRIGHT} = 1', 0.14), default=0.06)}"
    f" + {case(('n_images >= 6', 0.24), ('n_images >= 4', 0.18), ('n_images >= 2', 0.08))} + {case(('n_variants >= 4', 0.1), ('n_variants >= 2', 0.05))}))"
)
SCORED = f"""{P},
b AS (SELECT brand_slug, any_value(brand) AS brand, (floor(1 + {rand_sql("score", "any_value(brand)")} * 5) - 1) / 4 AS brand01,
      {rand_sql(SEED, "'marka:' || brand_slug")} AS drift, {rand_sql(SEED, "'tur:' || brand_slug")} AS tur FROM product GROUP BY 1),
q AS (SELECT product.*, brand01, tur, {QUALITY} AS quality, {BEAUTY} AS beauty, least({d(1)}, greatest({d(0)}, brand01 + (drift - {d(0.5)}) * 2 * {d(S.ROTATION)})) AS rank01,
      {rand_sql(SEED, "'oneçıkan:' || id")} AS r_spot, {rand_sql(SEED, "'underdog:' || id")} AS r_under, {rand_sql(SEED, "id")} AS r_id FROM product JOIN b USING (brand_slug)),
scored AS (SELECT *, least({d(1)}, greatest({d(0)}, rank01 * {d(0.55)} + quality * {d(0.28)} + beauty * {d(0.22)} + {case(('day <= 7', 0.08), ('day <= 21', 0.03))}
      + {case((f'{N_GRADED} >= 6', 0.09), (f'{N_GRADED} >= 4', 0.06), (f'{N_GRADED} >= 2', 0.02))}
      + CASE WHEN quality >= 0.8 AND brand01 < 0.8 AND brand01 >= 0.25 AND r_spot <= 0.18 THEN CASE WHEN quality >= 0.9 THEN {d(0.2)} ELSE {d(0.14)} END ELSE {d(0)} END
      + CASE WHEN brand01 BETWEEN 0.15 AND 0.65 AND beauty >= 0.62 AND r_under <= 0.12 THEN CASE WHEN beauty >= 0.78 THEN {d(0.24)} ELSE {d(0.16)} END ELSE {d(0)} END
      - {case((f'{N_GRADED} = 1', 0.18), (f'{N_GRADED} = 2', 0.06))})) AS base FROM q)"""


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def score01():
    return (brand_score(F.col("brand")).cast("double") - 1) / 4


def scored(spark, sf_dir, where=None):
    return feed.scored(products(spark, sf_dir, where), score01(), SEED)


# -- filters: name, query, SQL condition --------------------------------------------------------------

FILTERS = {
    "F01_category": (C.CatalogQuery(category="HOODIE", in_stock_only=False), "category = 'HOODIE'"),
    "F02_default_feed": (C.CatalogQuery(in_stock_only=False), FEED),
    "F03_styles": (C.CatalogQuery(styles=["y2k", "techwear"], in_stock_only=False), f"{FEED} AND list_has_any(styles, ['y2k', 'techwear'])"),
    "F04_genders": (C.CatalogQuery(genders=["erkek"], in_stock_only=False), f"{FEED} AND list_contains(genders, 'erkek')"),
    "F05_brands": (C.CatalogQuery(brands=["Brand#2", "Brand#9"], in_stock_only=False), f"{FEED} AND brand IN ('Brand#2', 'Brand#9')"),
    "F06_colors_all": (C.CatalogQuery(colors=["siyah", "mor"], in_stock_only=False), f"{FEED} AND list_has_all(color_tags, ['siyah', 'mor'])"),
    "F07_sizes_any": (C.CatalogQuery(sizes=["XS", "3XL"], in_stock_only=False), f"{FEED} AND list_has_any(sizes, ['XS', '3XL'])"),
    "F08_price": (C.CatalogQuery(price="1k-2k", in_stock_only=False), f"{FEED} AND price_min <= 2000 AND price_max >= 1000"),
    "F09_in_stock": (C.CatalogQuery(), f"{FEED} AND in_stock"),
    "F10_search": (C.CatalogQuery(search="Siyah canta", in_stock_only=False), "(list_contains(color_tags, 'siyah')) AND category = 'ÇANTA'"),
    "F11_all_filters": (
        C.CatalogQuery(category="CEKET", styles=["basic"], colors=["mavi"], sizes=["M"], price="4k+"),
        "category = 'CEKET' AND list_contains(styles, 'basic') AND list_contains(color_tags, 'mavi') AND list_contains(sizes, 'M') AND price_min <= 1e12 AND price_max >= 4000 AND in_stock",
    ),
}
for _name, (_q, _where) in FILTERS.items():
    query(_name, f"{P} SELECT id, brand, category, price_min FROM product WHERE {_where}")(
        partial(lambda q, spark, sf_dir: C.filtered(products(spark, sf_dir, part_condition(q)), q).select("id", "brand", "category", "price_min"), _q)
    )

# -- sorts and pages ----------------------------------------------------------------------------------

SORTS = {
    "O01_price_asc": (C.CatalogQuery(sort="FİYAT", page=2), "in_stock DESC, price_min ASC NULLS LAST, pos", f"{FEED} AND in_stock"),
    "O01_price_desc": (C.CatalogQuery(sort="FİYAT", direction="desc"), "in_stock DESC, price_min DESC NULLS LAST, pos", f"{FEED} AND in_stock"),
    "O01_date": (C.CatalogQuery(sort="TARİH", in_stock_only=False, page=3), "in_stock DESC, day ASC NULLS LAST, pos", FEED),
    "O03_sold_out_last": (C.CatalogQuery(sort="MARKA", in_stock_only=False), "in_stock DESC, brand ASC NULLS LAST, pos", FEED),
}
for _name, (_q, _order, _where) in SORTS.items():
    query(
        _name,
        f"{P}, r AS (SELECT id, brand, row_number() OVER (ORDER BY {_order}) AS place FROM product WHERE {_where}) SELECT * FROM r WHERE place > {(_q.page - 1) * C.PAGE} AND place <= {_q.page * C.PAGE}",
    )(partial(lambda q, spark, sf_dir: C.run(products(spark, sf_dir), q).select("id", "brand", "place"), _q))


#: Old and new forms of the same links.
LINKS = [
    ("kategori=ceket&marka=brand-2,brand-9&stok=tumu&beden=M&sirala=fiyat&yon=azalan", "cat=CEKET&brand=Brand%232,Brand%239&tukenmis=1&size=M&sort=F%C4%B0YAT&dir=desc"),
    ("fiyat=2k-4k&renk=mavi&tarz=basic&kim=kadin&sirala=tarih&stok=tumu", "price=2&color=mavi&style=basic&gender=kadin&sort=TAR%C4%B0H&dir=asc&tukenmis=1&cat=T%C3%9CM+%C3%9CR%C3%9CNLER"),
    ("q=hot&stok=tumu&sirala=marka&sayfa=2", "q=hot&tukenmis=1&sort=MARKA&page=2"),
]
WHERE = [
    ("category = 'CEKET' AND brand IN ('Brand#2', 'Brand#9') AND list_contains(sizes, 'M')", "price_min DESC NULLS LAST", 1),
    (f"{FEED} AND price_min <= 4000 AND price_max >= 2000 AND list_contains(color_tags, 'mavi') AND list_contains(styles, 'basic') AND list_contains(genders, 'kadin')", "day ASC NULLS LAST", 1),
    ("contains(name, 'hot')", "brand ASC NULLS LAST", 2),
]
P01_SQL = " UNION ALL ".join(
    f"SELECT {k} AS link, id, place FROM (SELECT id, row_number() OVER (ORDER BY in_stock DESC, {order}, pos) AS place FROM product WHERE {where}) WHERE place > {(page - 1) * C.PAGE} AND place <= {page * C.PAGE}"
    for k, (where, order, page) in enumerate(WHERE)
)


def linked_pages(form: int, spark, sf_dir):
    """The pages that product links lead to, in today's form (0) or as old links have it (1)."""
    roster = [r[0] for r in table(spark, sf_dir, "part").select("p_brand").distinct().collect()]  # brands, not products
    found = None
    for k, link in enumerate(LINKS):
        q = C.CatalogQuery.parse(link[form], roster)
        page = C.run(products(spark, sf_dir, part_condition(q)), q).select(F.lit(k).alias("link"), "id", "place")
        found = page if found is None else found.unionByName(page)
    return found


query("P01_product_links", f"{P} {P01_SQL}")(partial(linked_pages, 0))
query("P01_old_links", f"{P} {P01_SQL}")(partial(linked_pages, 1))


@query(
    "O06_page_count",
    f"{P} SELECT count(*) AS matched, CAST(ceil(count(*) / {C.PAGE}) AS BIGINT) AS pages FROM product WHERE {FEED} AND in_stock",
)
def page_count(spark, sf_dir):
    found = C.filtered(products(spark, sf_dir), C.CatalogQuery()).agg(F.count("*").alias("matched"))
    return found.withColumn("pages", F.ceil(F.col("matched") / C.PAGE))


@query("X30_relevance")
def search_relevance(spark, sf_dir):
    full, groups = parse_search("hot gear")
    df = products(spark, sf_dir)
    text = haystack(F.col("name"), F.col("brand"), F.col("category"), F.col("styles"), F.col("color_tags"))
    df = df.filter(matches(text, groups)).withColumn("score", relevance(F.col("name"), F.col("brand"), text, full, groups))
    return df.select("id", "name", "score")


SQL["X30_relevance"] = f"""{P} SELECT id, name,
  CAST(CASE WHEN starts_with(name, 'hot gear') THEN 55 WHEN contains(name, 'hot gear') THEN 30 ELSE 0 END AS DOUBLE)
  + CASE WHEN regexp_matches(name, '(^|[^a-z0-9])hot') THEN 22 ELSE 12 END + CASE WHEN regexp_matches(name, '(^|[^a-z0-9])gear') THEN 22 ELSE 12 END AS score
  FROM product WHERE contains(name, 'hot') AND contains(name, 'gear')"""


@query(
    "O05_search_page",
    f"""{P}, r AS (SELECT id, row_number() OVER (ORDER BY in_stock DESC, CASE WHEN starts_with(name, 'hot') THEN 55 ELSE 30 END DESC, pos) AS place FROM product WHERE contains(name, 'hot'))
    SELECT * FROM r WHERE place <= {C.PAGE}""",
)
def search_page(spark, sf_dir):
    return C.run(products(spark, sf_dir), C.CatalogQuery(search="hot", in_stock_only=False)).select("id", "place")


# -- scalar functions ---------------------------------------------------------------------------------


@query("X23_hash", f"SELECT DISTINCT p_name AS name, CAST({fnv_sql('p_name')} AS BIGINT) AS h, {rand_sql(SEED, 'p_name')} AS r FROM part")
def hashes(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select("name", fnv1a(F.col("name")).alias("h"), rand01(SEED, F.col("name")).alias("r"))


@query("X11_slug", "SELECT DISTINCT p_brand AS brand, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct().select("brand", slugify(F.col("brand")).alias("slug"))


@query("X13_hsl", f"""WITH c AS (SELECT p_partkey AS id, p_size * 5 AS r, (p_partkey * 37) % 256 AS g, (p_partkey * 91) % 256 AS b FROM part),
    m AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS hi, least(r, g, b) / 255.0::DOUBLE AS lo FROM c) SELECT id, round((hi + lo) / 2, 9) AS l, round(hi - lo, 9) AS chroma FROM m""")
def hsl(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    r, g, b = F.col("p_size") * 5, F.col("p_partkey") * 37 % 256, F.col("p_partkey") * 91 % 256
    _, s, light = rgb_to_hsl(r, g, b)
    chroma = F.when(light > 0.5, s * (2 - 2 * light)).otherwise(s * 2 * light)
    return p.select(F.col("p_partkey").alias("id"), F.round(light, 9).alias("l"), F.round(chroma, 9).alias("chroma"))


@query("X14_hex_tags", f"""{P} SELECT id, hex, CASE hex WHEN '#111111' THEN 'siyah' WHEN '#f0efea' THEN 'beyaz' WHEN '#8a8a86' THEN 'gri' WHEN '#cdbfa2' THEN 'bej' WHEN '#b03030' THEN 'kirmizi'
    WHEN '#d1789b' THEN 'pembe' WHEN '#4a7a45' THEN 'yesil' WHEN '#2f6aa8' THEN 'mavi' WHEN '#6a3a8a' THEN 'mor' ELSE 'gri' END AS tag,
    CASE WHEN hex IN ('#111111', '#b03030', '#6a3a8a') THEN 1 WHEN hex IN ('#f0efea', '#cdbfa2') THEN 2
         ELSE CASE WHEN hex = '#2f6aa8' THEN CASE WHEN (0.299 * 47 + 0.587 * 106 + 0.114 * 168) / 255 < 0.38 THEN 1 ELSE 0 END ELSE 0 END END AS tone FROM product""")
def hex_tags(spark, sf_dir):
    return products(spark, sf_dir).select("id", "hex", hex_to_tag(F.col("hex")).alias("tag"), tone_class(F.col("hex")).alias("tone"))


# -- scores and feeds ---------------------------------------------------------------------------------


@query("R02_quality", f"{SCORED} SELECT id, round(quality, 9) AS quality FROM scored")
def quality(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.round("quality", 9).alias("quality"))


@query("R04_aesthetic", f"{SCORED} SELECT id, round(beauty, 9) AS beauty FROM scored")
def beauty(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.round("beauty", 9).alias("beauty"))


@query("R08_brand_rank", f"{SCORED} SELECT DISTINCT brand_slug, round(rank01, 9) AS rank01 FROM scored")
def brand_ranks(spark, sf_dir):
    return scored(spark, sf_dir).select("brand_slug", F.round("rank01", 9).alias("rank01")).distinct()


@query("R10_base_score", f"{SCORED} SELECT id, round(base, 9) AS base, round(base * (1 - {d(0.3)}) + r_id * {d(0.3)}, 9) AS s FROM scored")
def base_scores(spark, sf_dir):
    df = feed.with_noise(scored(spark, sf_dir), "kesfet", SEED)
    return df.select("id", F.round("base", 9).alias("base"), F.round("s", 9).alias("s"))


@query(
    "N03_round_robin",
    f"""{SCORED}, n AS (SELECT *, base * (1 - {d(0.22)}) + r_id * {d(0.22)} AS s, rank01 * {d(0.7)} + tur * {d(0.3)} AS turn FROM scored),
    r AS (SELECT *, row_number() OVER (PARTITION BY brand_slug ORDER BY s DESC, pos) AS round, min(pos) OVER (PARTITION BY brand_slug) AS first FROM n)
    SELECT id, round, row_number() OVER (PARTITION BY round ORDER BY turn DESC, first) AS place FROM r""",
)
def round_robin(spark, sf_dir):
    return feed.round_robin(feed.with_noise(scored(spark, sf_dir), "markalar", SEED), SEED).select("id", "round", "place")


@query("N01_weave")
def weave(spark, sf_dir):
    return feed.weave(feed.with_noise(scored(spark, sf_dir), "kesfet", SEED), "kesfet", SEED, keep=written)


@query("N01_places", "SELECT count(*) AS n, count(*) AS places, count(*) AS last, least(count(*), 400) AS picks, 0 AS out_of_order FROM part")
def weave_places(spark, sf_dir):
    """Every product has one place of its own, without gaps; picks come first, and the tail goes by its keys."""
    w = feed.weave(feed.with_noise(scored(spark, sf_dir), "kesfet", SEED), "kesfet", SEED, keep=written).withColumn("lot", F.floor(F.col("place") / 4096))
    before = F.lag("key").over(Window.partitionBy("lot").orderBy("place"))
    w = w.withColumn("bad", F.coalesce(before > F.col("key"), F.lit(False)) | (F.col("pick").isNotNull() & (F.col("pick") != F.col("place"))))
    return w.agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.max("place").alias("last"), F.count("pick").alias("picks"), F.count_if("bad").cast("int").alias("out_of_order"))


@query("N12_category_feed")
def category_feed(spark, sf_dir):
    df = scored(spark, sf_dir).filter("category = 'HOODIE'")
    return feed.weave(feed.with_noise(df, "kategori", SEED), "kategori", SEED, keep=written)


@query(
    "N04_stratified",
    f"""{P}, t AS (SELECT *, row_number() OVER (PARTITION BY category, brand_slug ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY category, brand_slug) AS first FROM product),
    r AS (SELECT id, category, turn, row_number() OVER (PARTITION BY category ORDER BY turn, first) AS place FROM t) SELECT * FROM r WHERE place <= 30""",
)
def stratified(spark, sf_dir):
    return feed.stratified(products(spark, sf_dir), 30).select("id", "category", "turn", "place")


@query(
    "N11_first_per_brand",
    f"{P}, r AS (SELECT id, brand, row_number() OVER (PARTITION BY brand ORDER BY pos) AS k FROM product) SELECT * FROM r WHERE k <= 3",
)
def first_per_brand(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("brand").orderBy("pos"))
    return products(spark, sf_dir).select("id", "brand", k.alias("k")).filter("k <= 3")


@query(
    "N14_brand_page",
    f"""{SCORED}, n AS (SELECT *, base * (1 - {d(0.12)}) + r_id * {d(0.12)} AS s FROM scored WHERE brand = 'Brand#2'), r AS (SELECT id, in_stock, row_number() OVER (ORDER BY in_stock DESC, s DESC, pos) AS place FROM n) SELECT * FROM r WHERE place <= 48""",
)
def brand_page(spark, sf_dir):
    """A brand's products, in stock first; the brand reaches the scan and the line items, so one brand's rows are aggregated and ranked."""
    df = feed.with_noise(scored(spark, sf_dir, F.col("p_brand") == "Brand#2"), "kategori", SEED)
    order = [F.desc("in_stock"), F.desc("s"), F.asc("pos")]
    return df.orderBy(*order).limit(48).select("id", "in_stock", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("place"))


@query(
    "A26_lift",
    f"""{SCORED}, n AS (SELECT *, row_number() OVER (ORDER BY base DESC, pos) AS place FROM scored), h AS (SELECT brand_slug, count(*) AS c FROM n WHERE place <= 200 GROUP BY 1)
    SELECT round(avg(len(sizes)) FILTER (place <= 200) / avg(len(sizes)), 6) AS sizes, round(avg(n_images) FILTER (place <= 200) / avg(n_images), 6) AS images,
    round(avg(n_variants) FILTER (place <= 200) / avg(n_variants), 6) AS variants, round(avg((price_min IS NOT NULL)::INT) FILTER (place <= 200) / avg((price_min IS NOT NULL)::INT), 6) AS priced,
    round(avg(brand01) FILTER (place <= 200) / avg(brand01), 6) AS score, (SELECT count(*) FROM h) AS brands, round((SELECT max(c) / sum(c) FROM h), 6) AS largest_share FROM n""",
)
def lift(spark, sf_dir):
    """What stands out among the 200 best against all: sizes, pictures, variants, prices, the brand's score, and how many brands share it."""
    df = scored(spark, sf_dir).withColumn("score01", score01())
    head = df.orderBy(F.desc("base"), "pos").limit(200)
    measures = {"sizes": F.size("sizes"), "images": F.col("n_images"), "variants": F.col("n_variants"), "priced": F.col("price_min").isNotNull().cast("int"), "score": F.col("score01")}
    found = audits.discovery_lift(head, df, measures)
    return found.select(*(F.round(c, 6).alias(c) for c in measures), "brands", F.round("largest_share", 6).alias("largest_share"))


assert set(STYLES) <= {"streetwear", "basic", "ravewear", "minimalist", "y2k", "techwear"}
