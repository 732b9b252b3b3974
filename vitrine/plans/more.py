"""Projections, set operations, audits and variant rules over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.functions import logos
from vitrine.functions.classify import cat_has_sizes
from vitrine.functions.sizes import sort_sizes, toggle_band
from vitrine.functions.text import seed_of
from vitrine import sources
from vitrine.operators import resolve, userdata
from vitrine.plans.catalog import COLORS, GROUP, PRODUCT_SQL, SIZES, products, sql_list, table, variants

Q: dict = {}
SQL: dict[str, str] = {}
P = f"WITH {PRODUCT_SQL}"


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query(
    "P02_final_columns",
    f"""{P}, v AS (SELECT pid, string_agg(sid || ':' || vprice, ',' ORDER BY sid) AS variants FROM variant GROUP BY 1)
    SELECT id, brand, brand_slug, name, category, array_to_string(list_sort(genders), '|') AS genders, array_to_string(styles, '|') AS styles, price, price_min, price_max, 'TRY' AS currency,
           '/i/' || id || '-1.jpg' AS image, array_to_string(list_transform(range(1, least(n_images, 5) + 1), lambda k: '/i/' || id || '-' || k || '.jpg'), '|') AS images, array_to_string(sizes, '|') AS sizes,
           array_to_string(color_tags, '|') AS colors, array_to_string(color_tags, '|') AS color_tags, coalesce(variants, '') AS variants, 'https://' || brand_slug || '.com/' || id AS product_url, in_stock, pop, day, 'live' AS source
    FROM product LEFT JOIN v ON pid = pos""",
)
def final_columns(spark, sf_dir):
    """All twenty-two fields of a product as it is stored; lists are joined to be compared."""
    p = products(spark, sf_dir)
    v = variants(spark, sf_dir).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("sid", "vprice"))).alias("v"))
    picture = lambda k: F.concat(F.lit("/i/"), "id", F.lit("-"), k.cast("string"), F.lit(".jpg"))
    shown = F.transform(F.sequence(F.lit(1), F.least("n_images", F.lit(resolve.MAX_IMAGES))), picture)
    joined = lambda c: F.array_join(c, "|")
    each = F.array_join(F.transform(F.coalesce("v", F.array().cast("array<struct<sid:bigint,vprice:double>>")), lambda x: F.concat_ws(":", x.sid.cast("string"), x.vprice.cast("string"))), ",")
    return p.join(v, F.col("pid") == F.col("pos"), "left").select(
        "id", "brand", "brand_slug", "name", "category", joined(F.array_sort("genders")).alias("genders"), joined("styles").alias("styles"), "price", "price_min", "price_max",
        F.lit("TRY").alias("currency"), shown[0].alias("image"), joined(shown).alias("images"), joined("sizes").alias("sizes"), joined("color_tags").alias("colors"),
        joined("color_tags").alias("color_tags"), each.alias("variants"), F.concat(F.lit("https://"), "brand_slug", F.lit(".com/"), "id").alias("product_url"), "in_stock", "pop", "day",
        F.lit("live").alias("source"),
    )


@query("P03_live_brands", f"{P} SELECT brand, brand_slug, bool_or(in_stock) AS live FROM product GROUP BY 1, 2")
def live_brands(spark, sf_dir):
    return products(spark, sf_dir).groupBy("brand", "brand_slug").agg(F.max("in_stock").alias("live"))


#: Categories with and without sizes, dealt over the parts.
SOME_CATEGORIES = ["TAKI", "GÖZLÜK", "SAAT", "CÜZDAN", "AKSESUAR", "ÇANTA", "ŞAPKA", "KEMER", "ÇORAP", "TİŞÖRT", "AYAKKABI"]


@query("P08_sizeless", f"{P} SELECT id, CASE WHEN {sql_list(SOME_CATEGORIES)}[pos % 11 + 1] IN ('TAKI', 'GÖZLÜK', 'SAAT', 'CÜZDAN', 'AKSESUAR') THEN '' ELSE array_to_string(sizes, '|') END AS sizes FROM product")
def sizeless(spark, sf_dir):
    """Jewellery, glasses, watches, wallets and accessories lose their sizes; bags, caps, belts and socks keep them."""
    category = F.element_at(F.array(*map(F.lit, SOME_CATEGORIES)), (F.col("pos") % len(SOME_CATEGORIES) + 1).cast("int"))
    sizes = F.when(cat_has_sizes(category), F.col("sizes")).otherwise(F.array().cast("array<string>"))
    return products(spark, sf_dir).select("id", F.array_join(sizes, "|").alias("sizes"))


@query("N05_default_variant", f"""{P}, r AS (SELECT pid, sid, vprice, len(lines) AS n, row_number() OVER (PARTITION BY pid ORDER BY vstock DESC, CASE WHEN vstock THEN len(lines) ELSE 0 END DESC, sid) AS k FROM variant)
    SELECT pid, sid, vprice AS price, n FROM r WHERE k = 1""")
def default_variant(spark, sf_dir):
    """The variant in stock with most sizes, the first of equals, else the first; its price is the product's."""
    live = F.when(F.col("vstock"), F.size("lines")).otherwise(0)
    k = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("vstock"), F.desc("live"), "sid"))
    v = variants(spark, sf_dir).withColumn("live", live).withColumn("k", k)
    return v.filter("k = 1").select("pid", "sid", F.col("vprice").alias("price"), F.size("lines").alias("n"))


#: Sizes of every kind, in their order.
MIXED = ["XS", "S", "M", "3XL", "28", "36", "104", "Çok büyük", "dar", "ılık", "ince", "Şişman", "uzun", "Üst"]


@query("O12_sorted_sizes", f"SELECT p_partkey AS id, array_to_string([{sql_list(MIXED)}[i] FOR i IN range(1, {len(MIXED) + 1}) IF (i + p_size) % 4 > 0], ',') AS sizes FROM part")
def sorted_sizes(spark, sf_dir):
    """Shuffled sizes back in order: the ladder, numbers by value, then words, where ç, ı, ş and ü stand after c, before i, after s and u."""
    some = F.filter(F.array(*map(F.lit, MIXED)), lambda x: (F.array_position(F.array(*map(F.lit, MIXED)), x) + F.col("p_size")) % 4 > 0)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(sort_sizes(F.shuffle(some)), ",").alias("sizes"))


TOWNS = ["Çınar", "Cem", "Iğdır", "İnci", "Işık", "Ilgaz", "Öz", "Oz", "Şal", "Sal", "Ülkü", "Ulu", "Zil", "Ğ"]


@query("O14_brand_index", f"WITH b AS (SELECT DISTINCT {sql_list(TOWNS)}[p_partkey % {len(TOWNS)} + 1] || ' ' || p_brand AS name FROM part) SELECT name, row_number() OVER (ORDER BY name COLLATE tr) AS place FROM b")
def brand_index(spark, sf_dir):
    """Brands in Turkish alphabetical order."""
    name = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, TOWNS)), (F.col("p_partkey") % len(TOWNS) + 1).cast("int")), "p_brand")
    names = table(spark, sf_dir, "part").select(name.alias("name")).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(F.collate("name", "tr"))  # brands, not products
    return names.withColumn("place", F.row_number().over(order))


WRITTEN = ["SİYAH Tee", "Tee - AÇIK MAVİ", "Açık Yaka GRİ", "Ti\u0307şört Beyaz / Navy", "Kırmızı", "Gri̇ Gömlek", "SI\u0307YAH | Mont", "Mor  Bluz – Mor", "Yeşilimsi Kazak", "LACİVERT/haki Şort"]
CLEAN = ["Tee", "Tee", "Açık Yaka", "Ti\u0307şört", "Kırmızı", "Gömlek", "SI\u0307YAH | Mont", "Bluz", "Yeşilimsi Kazak", "Şort"]


@query("X08_clean_names", f"SELECT p_partkey AS id, {sql_list(CLEAN)}[p_partkey % 10 + 1] || ' ' || p_partkey AS name FROM part WHERE p_partkey % 10 <> 4 UNION ALL SELECT p_partkey, 'Kırmızı' FROM part WHERE p_partkey % 10 = 4")
def clean_names(spark, sf_dir):
    """Colour words cut from names as they are written, İ and combining dots among them; a name of colours only stays."""
    raw = F.element_at(F.array(*map(F.lit, WRITTEN)), (F.col("p_partkey") % 10 + 1).cast("int"))
    shown = resolve.clean_name(F.when(F.col("p_partkey") % 10 == 4, raw).otherwise(F.regexp_replace(raw, "(Tee|Yaka|Ti\u0307şört|Gömlek|Mont|Bluz|Kazak|Şort)", F.concat(F.lit("$1 "), F.col("p_partkey").cast("string")))))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), shown.alias("name"))


@query(
    "A38_logo_inversion",
    """WITH r AS (SELECT doc_id, doc_id % 4 AS form, length(coalesce(text, '')) % 256 AS n FROM documents)
    SELECT doc_id, CASE form WHEN 0 THEN n / 255.0 > 0.5 WHEN 1 THEN n / 255.0 < 0.45 WHEN 2 THEN 0.2126 * n / 255.0 < 0.45 ELSE false END AS inverted FROM r""",
)
def logo_inversion(spark, sf_dir):
    """Rasters made of documents: a box of one grey, a grey mark, a red mark, a bright coloured one, the last three on nothing."""
    d = table(spark, sf_dir, "documents")
    n = F.lpad(F.hex(F.length(F.coalesce("text", F.lit(""))) % 256), 2, "0")
    form = F.col("doc_id") % 4
    pixel = F.when(form < 2, F.concat(n, n, n, F.lit("FF"))).when(form == 2, F.concat(n, F.lit("0000FF"))).otherwise(F.concat(n, F.lit("FF00FF")))
    clear = F.repeat(F.lit("00000000"), 96)
    raster = F.unhex(F.when(form == 0, F.repeat(pixel, 256)).otherwise(F.concat(clear, F.repeat(pixel, 64), clear)))
    return d.select("doc_id", logos.decide_invert(raster, F.lit(16)).alias("inverted"))


HEADS = [
    '<img class="site-logo" src="/a/mark.png?v=1" width="160"><link rel="apple-touch-icon" sizes="180x180" href="/touch.png"><meta property="og:image" content="/hero.jpg">',
    "<img src='/img/LOGO.jpg' alt=x><img src=/pay/logo_visa.png><link rel='shortcut icon' href='data:x'><link rel=icon href=//c.com/i.ico>",
    '<script type="application/ld+json">{"@graph":[{"@type":"Organization","logo":{"url":"https://c.com/l.svg"}}]}</script><img alt="Logo" srcset="s.png 100w, b.png 400w"><meta name="og:logo" content="touch.png">',
    '<img id="logo" src="/brand-x.svg" width="32"><img id="logo" src="/brand-x.svg" width="400"><script type="application/ld+json">{no</script>',
]
RANKED = [
    [("https://s.com/a/mark.png?v=1", 112), ("https://s.com/touch.png", 91), ("https://s.com/hero.jpg", 30), ("https://s.com/favicon.ico", 10)],
    [("https://s.com/img/LOGO.jpg", 75), ("https://c.com/i.ico", 45), ("https://s.com/favicon.ico", 10)],
    [("https://s.com/p/touch.png", 75), ("https://c.com/l.svg", 70), ("https://s.com/p/b.png", 43), ("https://s.com/favicon.ico", 10)],
    [("https://s.com/brand-x.svg", 95), ("https://s.com/favicon.ico", 10)],
]


@query("O18_logo_candidates", " UNION ALL ".join(f"SELECT page_id, {k + 1} AS place, '{u}' AS url, {n} AS score FROM pages WHERE page_id % 4 = {m}" for m, rows in enumerate(RANKED) for k, (u, n) in enumerate(rows)))
def ranked_logos(spark, sf_dir):
    """Candidates of pages with pictures, icons, structured data and meta tags in their heads, the best first."""
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("page_id") % 4 + 1).cast("int"))
    found = logos.logo_candidates(F.concat(head, "html"), F.lit("https://s.com/p/"), F.lit("brand-of"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("at", "c")).select("page_id", (F.col("at") + 1).alias("place"), "c.url", "c.score")


@query("O10_public_lists", "WITH r AS (SELECT o_orderkey AS id, o_totalprice AS views, count(*) OVER () AS total, row_number() OVER (ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F') SELECT * FROM r WHERE place BETWEEN 21 AND 40")
def public_lists(spark, sf_dir):
    """A page by views, then date; the total is one number joined in."""
    return userdata.list_page(published(spark, sf_dir), "views", page=2)


@query("O10_newest_lists", "WITH r AS (SELECT o_orderkey AS id, o_totalprice AS views, count(*) OVER () AS total, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F') SELECT * FROM r WHERE place <= 20")
def newest_lists(spark, sf_dir):
    return userdata.list_page(published(spark, sf_dir), "new", page=1)


def published(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("views"), F.col("o_orderdate").alias("at"))


@query("O09_reviews_newest", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events")
def reviews_newest(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").select("user_id", "event_id", place.alias("place"))


@query("A15_unread", "SELECT t AS topic, count(event_id) AS n FROM (SELECT unnest(['signup', 'error', 'view', 'other']) AS t) LEFT JOIN events ON event_type = t AND value > 50 GROUP BY 1 UNION ALL SELECT 'ALL', count(*) FROM events WHERE value > 50")
def unread(spark, sf_dir):
    domain = spark.createDataFrame([("signup",), ("error",), ("view",), ("other",)], "topic string")
    ev = table(spark, sf_dir, "events").filter("value > 50")
    per = domain.join(ev.groupBy(F.col("event_type").alias("topic")).agg(F.count("*").alias("n")), "topic", "left").na.fill(0, ["n"])
    return per.unionByName(ev.agg(F.count("*").alias("n")).select(F.lit("ALL").alias("topic"), "n"))


@query("U05_group_cover", f"{P}, g AS (SELECT unnest({sql_list([*GROUP, 'ÇORAP'])}) AS category) SELECT 'orphan' AS what, category FROM (SELECT category FROM product EXCEPT SELECT category FROM g) UNION ALL SELECT 'unused', category FROM (SELECT category FROM g EXCEPT SELECT category FROM product)")
def group_cover(spark, sf_dir):
    used = products(spark, sf_dir).select("category").distinct()
    groups = spark.createDataFrame([(c,) for c in [*GROUP, "ÇORAP"]], "category string")
    return used.exceptAll(groups).select(F.lit("orphan").alias("what"), "category").unionByName(groups.join(used, "category", "left_anti").select(F.lit("unused").alias("what"), "category"))


@query("J18_overlap", f"{P}, a AS (SELECT id, brand FROM product ORDER BY price DESC, pos LIMIT 40), b AS (SELECT id, brand FROM product ORDER BY price_max DESC, pos LIMIT 40) SELECT (SELECT count(*) FROM (SELECT id FROM a INTERSECT SELECT id FROM b)) AS products, (SELECT count(*) FROM (SELECT brand FROM a INTERSECT SELECT brand FROM b)) AS brands")
def overlap(spark, sf_dir):
    p = products(spark, sf_dir)
    a, b = (p.orderBy(F.desc(c), "pos").limit(40).select("id", "brand") for c in ("price", "price_max"))
    return a.select("id").intersect(b.select("id")).agg(F.count("*").alias("products")).crossJoin(a.select("brand").intersect(b.select("brand")).agg(F.count("*").alias("brands")))


@query("U07_band_toggle", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN '40' WHEN 1 THEN '40|34|32|36' ELSE '32|34|36' END AS chosen FROM part")
def band_toggle(spark, sf_dir):
    """A band that is chosen whole goes; of a partial or empty one what is missing is added."""
    band = F.array(F.lit("32"), F.lit("34"), F.lit("36"))
    chosen = F.when(F.col("p_size") % 3 == 0, F.array(*map(F.lit, ["36", "40", "32", "34"]))).when(F.col("p_size") % 3 == 1, F.array(F.lit("40"), F.lit("34"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(toggle_band(chosen, band), "|").alias("chosen"))


@query(
    "J22_health_drop",
    f"""{P}, o AS (SELECT brand_slug, count(*) AS n, count(price) AS p FROM product GROUP BY 1), w AS (SELECT brand_slug, count(*) AS n, count(CASE WHEN brand <> 'Brand#2' THEN price END) AS p FROM product WHERE price < 960 OR brand = 'Brand#2' GROUP BY 1)
    SELECT brand_slug, coalesce(w.n, 0) < 0.6 * o.n OR (o.p >= 0.5 * o.n AND coalesce(w.p, 0) < 0.2 * greatest(coalesce(w.n, 0), 1)) AS keep_old FROM o LEFT JOIN w USING (brand_slug)""",
)
def health_drop(spark, sf_dir):
    """A brand's new records against its old ones: too few of them, or their prices gone (brand-2)."""
    p = products(spark, sf_dir).select("brand_slug", "brand", "price", "sizes")
    new = p.filter("price < 960 or brand = 'Brand#2'").withColumn("price", F.when(F.col("brand") != "Brand#2", F.col("price")))
    return sources.brand_verdicts(p, new)


@query("X24_seed", "SELECT event_id, epoch_ms(ts) // 10800000 AS w FROM events")
def seeds(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.conv(seed_of(ms), 36, 10).cast("long").alias("w"))


assert len(COLORS) == 10
