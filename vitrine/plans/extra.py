"""Text and size rules, dimension joins, state and sink rules over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine import sources
from vitrine.functions import html, score
from vitrine.functions.sizes import band_of, known_sizes, looks_like_sizes, preview, size_kind
from vitrine.functions.text import has_word_start, parse_number
from vitrine.functions.classify import PRIOR_STYLES
from vitrine.operators import audits, resolve
from vitrine.plans.analytics import sql_band
from vitrine.plans.catalog import PRODUCT_SQL, brand_score, products, rand_sql, spread, sql_list, table
from vitrine.plans.ranking import CAT_W, N_GRADED, case
from vitrine.plans.state import RECORDS, records
from vitrine.sources import stores

Q: dict = {}
SQL: dict[str, str] = {}
P = f"WITH {PRODUCT_SQL}"
ID = "p_partkey AS id"


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def cycle(values: list[str], key: str = "p_partkey") -> Column:
    """One of the values for each row, in turn by a number column."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def sql_cycle(values: list[str], key: str = "p_partkey") -> str:
    return f"{sql_list(values)}[{key} % {len(values)} + 1]"


def parts(spark, sf_dir):
    return spread(table(spark, sf_dir, "part"), "p_partkey").withColumn("id", F.col("p_partkey"))


# -- rules on names, sizes, numbers and images -------------------------------------------------------------

def words(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


#: Raw labels, and the tokens that the size grammar makes of them.
SIZE_CASES = {"Small": "S", "X Large": "XL", "S-M": "S,M", "35-38": "35,36,37,38", "TEK BOYUT": "TEK BEDEN", "9-10 YAŞ": "9-10 YAŞ", "Siyah": "", "42": "42"}


@query("F20_known_sizes", f"SELECT {ID}, CASE WHEN p_size BETWEEN 16 AND 130 THEN CAST(p_size AS VARCHAR) || '|' ELSE '' END || {sql_cycle(list(SIZE_CASES.values()))} AS found FROM part")
def known(spark, sf_dir):
    """A number, which is a size from 16 on, and a label in words."""
    number = F.array_join(known_sizes(F.array(F.col("p_size").cast("string"))), ",")
    label = F.array_join(known_sizes(F.array(cycle(list(SIZE_CASES)))), ",")
    return parts(spark, sf_dir).select("id", F.concat(F.when(number != "", F.concat(number, F.lit("|"))).otherwise(""), label).alias("found"))


@query("F14_placeholders", f"SELECT {ID}, 'img/' || (p_partkey % 5) || '.jpg|b/' || p_size || '.png' AS photos FROM part")
def placeholders(spark, sf_dir):
    """Placeholder and repeated images go, the order stays."""
    first = F.concat(F.lit("img/"), F.col("p_partkey") % 5, F.lit(".jpg"))
    second = F.concat(F.lit("b/"), F.col("p_size"), F.lit(".png"))
    urls = F.array(first, F.when(F.col("p_size") % 3 == 0, "x/no-image.png"), first, F.concat(F.lit("a/coming-soon-"), F.col("p_size")), second)
    return parts(spark, sf_dir).select("id", F.array_join(resolve.photos(urls), "|").alias("photos"))


@query("F15_usable_records", f"{RECORDS} SELECT count(*) AS n, count(*) FILTER (image IS NOT NULL) AS usable FROM rec")
def usable_records(spark, sf_dir):
    return records(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("name").isNotNull() & F.col("image").isNotNull()).alias("usable"))


@query("F27_size_like_values", f"SELECT {ID}, p_partkey % 3 <> 1 AS ok FROM part")
def size_like_values(spark, sf_dir):
    """Three fifths of an option's values have to be sizes."""
    lists = F.element_at(F.array(words("S", "M", "Siyah"), words("Siyah", "Beyaz", "S"), words("36", "38", "40")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return parts(spark, sf_dir).select("id", looks_like_sizes(lists).alias("ok"))


@query("X21_numbers", f"SELECT {ID}, CAST(floor(p_retailprice * 100) AS DOUBLE) / 100 AS price FROM part")
def numbers(spark, sf_dir):
    """Prices written with a thousands point and a decimal comma."""
    cents = F.floor(F.col("p_retailprice") * 100)
    whole = F.floor(cents / 100).cast("string")
    grouped = F.regexp_replace(whole, r"(?<=[0-9])(?=([0-9]{3})+$)", ".")
    return parts(spark, sf_dir).select("id", parse_number(F.concat(grouped, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))).alias("price"))


@query("X29_word_start", "SELECT DISTINCT p_name AS name, regexp_matches(p_name, '(^|[^a-z0-9])hot') AS ok FROM part")
def word_start(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("ok", has_word_start(F.col("name"), F.lit("hot")))


@query("X34_owner_hash", "SELECT sha256(CAST(user_id AS VARCHAR)) AS owner, count(*) AS n FROM events GROUP BY 1")
def owner_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.sha2(F.col("user_id").cast("string"), 256).alias("owner")).agg(F.count("*").alias("n"))


@query("X49_snap_width", f"SELECT {ID}, CASE WHEN p_size <= 8 THEN 8 WHEN p_size <= 16 THEN 16 WHEN p_size <= 32 THEN 32 ELSE 48 END AS width FROM part")
def snapped(spark, sf_dir):
    return parts(spark, sf_dir).select("id", html.snap_width(F.col("p_size"), [8, 16, 32, 48]).alias("width"))


@query("X56_widest", f"SELECT {ID}, CASE WHEN p_size >= 10 THEN 'b.jpg' ELSE 'a.jpg' END AS url FROM part")
def widest_source(spark, sf_dir):
    return parts(spark, sf_dir).select("id", html.widest(F.concat(F.lit("a.jpg 100w, b.jpg "), F.col("p_size") * 10, F.lit("w"))).alias("url"))


# -- projections --------------------------------------------------------------------------------------------


# -- filters of the refresh and of brands --------------------------------------------------------------------


@query("F25_only_and_skip", "WITH b AS (SELECT s_name AS slug, CASE s_nationkey % 3 WHEN 0 THEN 'shopify' WHEN 1 THEN 'jsonld' ELSE 'shopier' END AS platform FROM supplier) SELECT slug, platform FROM b WHERE platform = 'jsonld' AND slug NOT IN ('Supplier#000000002', 'Supplier#000000005') UNION ALL SELECT slug, 'only' FROM b WHERE slug IN ('Supplier#000000001', 'Supplier#000000002')")
def only_and_skip(spark, sf_dir):
    """The stores that a run is asked for: of one platform but for two, and two by name."""
    kind = F.element_at(F.array(*map(F.lit, ["shopify", "jsonld", "shopier"])), (F.col("s_nationkey") % 3 + 1).cast("int"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("slug"), kind.alias("platform"))
    two = audits.chosen_brands(b, only=["Supplier#000000001", "Supplier#000000002"]).withColumn("platform", F.lit("only"))
    return audits.chosen_brands(b, skip=["Supplier#000000002", "Supplier#000000005"], platform="jsonld").unionByName(two)


# -- joins with dimensions -------------------------------------------------------------------------------------


@query("J02_prior_styles", f"{P}, b AS (SELECT brand, arg_min(styles, pos) AS own FROM product WHERE pos % 25 <> 7 GROUP BY 1) SELECT id, array_to_string(list_filter(coalesce(own, []), lambda s: s IN ('streetwear', 'basic', 'ravewear', 'old-money', 'minimalist', 'y2k')), '|') AS prior FROM product LEFT JOIN b USING (brand)")
def prior_styles(spark, sf_dir):
    """A brand's styles (here those of its first product) as far as they are a scene; brands without any give none."""
    p = products(spark, sf_dir)
    own = p.filter("pos % 25 <> 7").groupBy("brand").agg(F.min_by("styles", "pos").alias("own"))
    return p.select("id", "brand").join(own, "brand", "left").select("id", F.coalesce(F.array_join(F.array_intersect("own", words(*PRIOR_STYLES)), "|"), F.lit("")).alias("prior"))


PERK_KINDS = ["iade", "kargo", "taksit"]


@query("J05_best_perk", f"WITH p AS (SELECT *, {sql_cycle(PERK_KINDS, 's_suppkey')} AS kind FROM supplier) SELECT s_nationkey AS brand, coalesce(arg_min(s_name, s_suppkey) FILTER (kind = 'kargo'), arg_min(s_name, s_suppkey)) AS perk FROM p GROUP BY 1")
def best_perk(spark, sf_dir):
    """The first delivery perk of a brand, else its first one."""
    p = table(spark, sf_dir, "supplier").withColumn("kind", cycle(PERK_KINDS, "s_suppkey"))
    delivery = F.min_by("s_name", F.when(F.col("kind") == "kargo", F.col("s_suppkey")))
    return p.groupBy(F.col("s_nationkey").alias("brand")).agg(F.coalesce(delivery, F.min_by("s_name", "s_suppkey")).alias("perk"))


@query(
    "J14_vote_counts",
    f"WITH v AS (SELECT json_extract_string(props, '$.k') AS k, count(DISTINCT user_id) AS votes, bool_or(user_id = 3) AS mine FROM events GROUP BY 1) SELECT {ID}, coalesce(votes, 0) AS votes, coalesce(mine, false) AS mine FROM part LEFT JOIN v ON k = CAST(p_partkey AS VARCHAR)",
)
def vote_counts(spark, sf_dir):
    v = table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.countDistinct("user_id").alias("votes"), F.max(F.col("user_id") == 3).alias("mine"))
    both = parts(spark, sf_dir).select("id").join(v, F.col("id").cast("string") == F.col("k"), "left")
    return both.select("id", F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("mine", F.lit(False)).alias("mine"))


@query("J17_roster", "SELECT n_name AS name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def roster(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return both.groupBy(F.col("n_name").alias("name")).agg(F.count("s_suppkey").alias("n"))


# -- aggregations, orders and windows ---------------------------------------------------------------------------


@query("A25_diagnostics", f"{P} SELECT count(*) AS n, count(*) FILTER (in_stock) AS live, count(DISTINCT brand) AS brands FROM product")
def diagnostics(spark, sf_dir):
    return products(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("in_stock").alias("live"), F.countDistinct("brand").alias("brands"))


@query("A41_size_groups", f"{P}, t AS (SELECT 'alpha' AS kind, NULL AS band FROM (SELECT unnest(sizes) FROM product) UNION ALL SELECT 'num', {sql_band('p_size')} FROM part) SELECT kind, band, count(*) AS n FROM t GROUP BY ALL")
def size_groups(spark, sf_dir):
    tokens = products(spark, sf_dir).select(F.explode("sizes").alias("t")).unionByName(parts(spark, sf_dir).select(F.col("p_size").cast("string").alias("t")))
    return tokens.groupBy(size_kind(F.col("t")).alias("kind"), band_of(F.col("t")).alias("band")).agg(F.count("*").alias("n"))


@query("N08_first_wins", "SELECT p_name AS name, min(p_partkey) AS pos, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY 1")
def first_wins(spark, sf_dir):
    """The first row of each name; a partial aggregation, so a common name is no single task."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos"), F.min_by("p_brand", "p_partkey").alias("brand"))


@query("O11_feedback_page", "WITH r AS (SELECT c_custkey AS id, count(*) OVER () AS total, row_number() OVER (ORDER BY c_custkey DESC) AS place FROM customer WHERE c_acctbal > 0) SELECT * FROM r WHERE place BETWEEN 21 AND 35")
def feedback_page(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("c_custkey")))
    page = c.orderBy(F.desc("c_custkey")).limit(35).withColumn("place", place).filter("place > 20")
    return page.crossJoin(c.agg(F.count("*").alias("total"))).select(F.col("c_custkey").alias("id"), "total", "place")


@query("O13_brand_order", f"WITH b AS (SELECT DISTINCT p_brand AS brand FROM part), s AS (SELECT brand, floor(1 + {rand_sql('score', 'brand')} * 5) AS score FROM b) SELECT brand, row_number() OVER (ORDER BY brand IN ('Brand#2', 'Brand#9') DESC, score DESC, brand) AS place FROM s")
def brand_order(spark, sf_dir):
    """Selected brands first, then by score and name; one row a brand."""
    b = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct().withColumn("score", brand_score(F.col("brand")))
    order = [F.col("brand").isin("Brand#2", "Brand#9").desc(), F.desc("score"), F.asc("brand")]
    return b.select("brand", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("place"))


@query("O15_size_preview", f"{P} SELECT id, array_to_string(sizes[1:5], ',') AS shown, len(sizes) - least(len(sizes), 5) AS more FROM product")
def size_preview(spark, sf_dir):
    shown, more = preview(F.col("sizes"))
    return products(spark, sf_dir).select("id", F.array_join(shown, ",").alias("shown"), more.alias("more"))


@query("R01_category_weight", f"{P} SELECT DISTINCT category, CAST({CAT_W} AS DOUBLE) AS weight FROM product")
def category_weights(spark, sf_dir):
    return products(spark, sf_dir).select("category").distinct().withColumn("weight", score.category_weight(F.col("category")))


@query(
    "R03_bonuses",
    f"""{P} SELECT id, {case(("day <= 7", 0.08), ("day <= 21", 0.03))} AS fresh, {case((f"{N_GRADED} >= 6", 0.09), (f"{N_GRADED} >= 4", 0.06), (f"{N_GRADED} >= 2", 0.02))} AS sized,
    {case((f"{N_GRADED} = 1", 0.18), (f"{N_GRADED} = 2", 0.06))} AS scarce FROM product""",
)
def bonuses(spark, sf_dir):
    made = {"fresh": score.fresh_bonus(F.col("day")), "sized": score.size_bonus(F.col("sizes")), "scarce": score.scarcity_penalty(F.col("sizes"))}
    return products(spark, sf_dir).select("id", *(c.alias(n) for n, c in made.items()))


# -- state, sources and sinks -------------------------------------------------------------------------------------


@query("T04_clamped_days", f"SELECT {ID}, CAST(least(180, greatest(1, p_size * 5 - 20)) AS BIGINT) AS days FROM part")
def clamped_days(spark, sf_dir):
    return parts(spark, sf_dir).select("id", F.least(F.lit(180), F.greatest(F.lit(1), F.col("p_size") * 5 - 20)).cast("long").alias("days"))


@query(
    "U10_merge_prefs",
    """WITH s AS (SELECT o_custkey AS c, o_orderkey % 2 AS side, arg_max(o_orderpriority, o_orderkey) AS v, max(o_orderkey) AS at FROM orders GROUP BY ALL),
    a AS (SELECT * FROM s WHERE side = 0), b AS (SELECT * FROM s WHERE side = 1)
    SELECT coalesce(a.c, b.c) AS c, CASE WHEN b.at IS NULL OR a.at > b.at THEN a.v ELSE b.v END AS v FROM a FULL JOIN b ON a.c = b.c""",
)
def merge_prefs(spark, sf_dir):
    """The newer side wins, the other fills gaps."""
    o = table(spark, sf_dir, "orders")

    def side(k: int):
        rows = o.filter(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("c"))
        return rows.agg(F.max_by("o_orderpriority", "o_orderkey").alias(f"v{k}"), F.max("o_orderkey").alias(f"at{k}"))

    newer = F.col("at1").isNull() | (F.col("at0") > F.col("at1"))
    return side(0).join(side(1), "c", "full").select("c", F.when(newer, F.col("v0")).otherwise(F.col("v1")).alias("v"))


@query(
    "S12_shop_records",
    """WITH v AS (SELECT p_partkey AS id, p_partkey % 4 AS form, color, size, price, picture, (p_size >> k) & 1 = 1 AS live FROM part,
        (VALUES ('Red', 'S', 10.0, 0, 'red.jpg'), ('Red', 'M', 12.0, 1, 'red.jpg'), ('Blue', 'S', 14.0, 2, 'blue.jpg'), ('Blue', 'M', 16.0, 3, 'blue.jpg')) AS t(color, size, price, k, picture)),
    r AS (SELECT id, form, CASE WHEN form < 3 THEN color ELSE '' END AS color, bool_or(live) AS in_stock, coalesce(min(price) FILTER (live), min(price))::DOUBLE AS price,
        array_to_string(CASE WHEN form = 2 THEN [] WHEN form = 3 THEN ['S', 'M'] WHEN bool_or(live) THEN list_sort(list(DISTINCT size) FILTER (live), 'DESC') ELSE ['S', 'M'] END, ',') AS sizes,
        CASE WHEN form = 1 THEN any_value(picture) ELSE 'a.jpg' END AS image FROM v GROUP BY 1, 2, 3) SELECT id, color, in_stock, price, sizes, image FROM r""",
)
def shop_records(spark, sf_dir):
    """Landed product lists: sizes under a name that says nothing, before or after the colour, no sizes, no colour."""
    text = F.lit
    rows = [("Red", "S", "10", 0), ("Red", "M", "12.00", 1), ("Blue", "S", "14", 2), ("Blue", "M", "16", 3)]
    form = F.col("p_partkey") % 4
    option = lambda name, at, *v: F.struct(name.alias("name"), F.lit(at).alias("position"), F.array(*map(text, v)).alias("values"))
    sizes, colors = ("S", "M"), ("Red", "Blue")
    options = (
        F.when(form == 0, F.array(option(text("Beyaz"), 1, *sizes), option(text("Colour"), 2, *colors)))
        .when(form == 1, F.array(option(text("Renk"), 1, *colors), option(text("Boyut"), 2, *sizes)))
        .when(form == 2, F.array(option(text("Renk"), 1, *colors)))
        .otherwise(F.array(option(text("Boyut"), 1, *sizes)))
    )

    def variant(color: str, size: str, price: str, k: int):
        one = F.when(form.isin(0, 3), size).otherwise(color)
        two = F.when(form == 0, color).when(form == 1, size)
        live = F.shiftright("p_size", k).bitwiseAND(1) == 1
        return F.struct(F.lit(k).cast("long").alias("id"), one.alias("option1"), two.alias("option2"), text(price).alias("price"), live.alias("available"))

    tied = lambda u, *ids: F.struct(text(u).alias("src"), F.when(form == 1, F.array(*map(F.lit, ids))).alias("variant_ids"))
    images = F.array(tied("a.jpg", 99), tied("red.jpg", 0, 1), tied("blue.jpg", 2, 3))
    product = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), text("h").alias("handle"), options.alias("options"), F.array(*(variant(*r) for r in rows)).alias("variants"), images.alias("images"))
    pages = parts(spark, sf_dir).select(F.col("p_brand").alias("brand"), F.to_json(F.struct(F.array(product).alias("products"))).alias("body"))
    return stores.shopify_records(pages).select("id", "color", "in_stock", "price", F.array_join("sizes", ",").alias("sizes"), "image")


@query("S15_minor_units", f"SELECT {ID}, (p_size * 100 + 5) / 100.0::DOUBLE AS price FROM part")
def minor_units(spark, sf_dir):
    return parts(spark, sf_dir).select("id", sources.woo_price(F.col("p_size") * 100 + 5, F.lit(2)).alias("price"))


@query(
    "K05_keep_last_good",
    f"""{P}, h AS (SELECT brand_slug, count(*) AS o, count(*) FILTER (price < 960) AS n FROM product GROUP BY 1)
    SELECT brand_slug, CASE WHEN n < 0.6 * o THEN o ELSE n END AS n FROM h WHERE n > 0 OR o > 0""",
)
def last_good(spark, sf_dir):
    rows = products(spark, sf_dir).select("brand_slug", "price", F.array(F.lit("S")).alias("sizes"))
    return sources.keep_last_good(rows, rows.filter("price < 960")).groupBy("brand_slug").agg(F.count("*").alias("n"))


@query("K09_insert_absent", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN 'old' ELSE 'new' END AS src FROM supplier")
def inserted(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    old = s.filter("s_suppkey % 3 < 2").select("s_suppkey", F.lit("old").alias("src"))
    return sources.insert_absent(old, s.filter("s_suppkey % 3 > 0").select("s_suppkey", F.lit("new").alias("src")), "s_suppkey")


@query("K10_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 2 = 1 THEN s_name || '*' WHEN s_suppkey % 3 < 2 THEN s_name END AS name FROM supplier")
def upserted(spark, sf_dir):
    """A new value wins where there is one, else the old one stays."""
    s = table(spark, sf_dir, "supplier")
    old = s.filter("s_suppkey % 3 < 2").select("s_suppkey", F.col("s_name").alias("name"))
    new = s.filter("s_suppkey % 3 > 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 1, F.concat("s_name", F.lit("*"))).alias("name"))
    return sources.upsert(old, new, "s_suppkey")
