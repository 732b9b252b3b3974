"""Store readers over pages and API answers made from the part table; SQL says what has to come out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import pages as P
from vitrine.operators.audits import allowed_image_host, looks_parked
from vitrine.plans.catalog import spread, table
from vitrine.sources import stores as S

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def fill(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by a column."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def part(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "part"), "p_partkey").withColumn("id", F.col("p_partkey")).withColumn("brand_slug", F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))))


#: Pages by p_partkey % 5: plain node, node in a graph, node three levels down, broken block and meta tags only, model with colours.
PAGE = [
    """<html><head><script type="application/ld+json">{"@type":"Product","name":"{name} {id}","image":["/a/{id}.jpg","not an image here"],"color":"Siyah/Beyaz","category":"Üst","keywords":["x","y"],"offers":[{"price":"{price}","availability":"https://schema.org/OutOfStock","priceCurrency":"usd"},{"price":"{dear}","availability":"https://schema.org/InStock"}]}</script></head><body><select name="Beden"><option>Seçiniz</option><option>S</option><option>M</option></select></body></html>""",
    """<html><script type='application/ld+json'>{"@graph":[{"@type":"WebPage"},{"@type":["Thing","Product"],"Name":"no","name":"{name} {id}","image":{"url":"https://cdn.x.com/{id}.webp"},"Offers":{"Price":"{price}","Availability":"InStock","PriceCurrency":"TRY"}}]}</script><button> XL </button><button>Add</button></html>""",
    """<html><script type="application/ld+json">[{"@type":"Page","main":{"part":[{"@type":"Product","name":"{name} {id}","image":"b/{id}.png","price":"{price}","size":"36"}]}}]</script><script>var o={"sizes":[{"name":"38"},{"name":"40"}]};</script></html>""",
    """<html><script type="application/ld+json">{broken</script><meta property="og:title" content="{name} {id}"><meta property="og:type" content="product"><meta property="og:image" content="https://cdn.x.com/{id}.jpg?a=1&amp;b=2"><meta property="product:price:amount" content="{price}"><meta property="product:price:currency" content="eur"></html>""",
    """<html><meta property="og:title" content="{name} {id}"><meta property="og:image" content="/m/{id}.jpg"><script>var productDetailModel = {"productActive":true,"productPriceStr":"0","product":{"indirimliFiyatiStr":"{price} TL"},"productVariantData":[{"ekSecenekTipiTanim":"Renk","tanim":"Siyah","resimYolu":"/r/{id}.jpg","renkKodu":"#111111"},{"ekSecenekTipiTanim":"Renk","tanim":"Mavi","resimYolu":"/varyasyonresim/2.jpg"},{"ekSecenekTipiTanim":"Beden","tanim":"M","aktif":true,"stokAdedi":{stock}},{"ekSecenekTipiTanim":"Beden","tanim":"L","aktif":false,"stokAdedi":5}]}; var after = "}";</script></html>""",
]
#: Pages that show no product.
OTHER_PAGES = ["<html><title>about</title></html>", """<html><meta property="og:title" content="Blog"><meta property="og:image" content="/x.jpg"></html>"""]


def product_pages(spark, sf_dir) -> DataFrame:
    """(id, brand_slug, url, html): for each part a page, and some that are none."""
    p = part(spark, sf_dir)
    template = F.element_at(F.array(*map(F.lit, PAGE + OTHER_PAGES)), (F.col("id") % (len(PAGE) + len(OTHER_PAGES)) + 1).cast("int"))
    values = {"name": F.col("p_name"), "id": F.col("id"), "price": F.col("p_size") * 10, "dear": F.col("p_size") * 10 + 5, "stock": F.col("p_size") % 2}
    html = template
    for name, value in values.items():
        html = F.replace(html, F.lit("{" + name + "}"), value.cast("string"))
    return p.select("id", "brand_slug", F.concat(F.lit("https://shop.x.com/p/"), F.col("id").cast("string")).alias("url"), html.alias("html"))


K = f"CAST(p_partkey % {len(PAGE) + len(OTHER_PAGES)} AS INTEGER)"
PAGE_SQL = f"WITH p AS (SELECT p_partkey AS id, {K} AS k, p_name || ' ' || p_partkey AS name, p_size * 10.0::DOUBLE AS price, p_size AS z FROM part)"


@query("X37_page_nodes", f"{PAGE_SQL} SELECT id, CASE WHEN k IN (0, 1, 2) THEN name END AS name, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS images, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS offers, CASE k WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 6 THEN 1 ELSE 0 END AS og FROM p")
def page_nodes(spark, sf_dir):
    """Products at the top, in a graph and three levels down; broken blocks are left out."""
    p = product_pages(spark, sf_dir).withColumn("n", P.product_node("html"))
    return p.select("id", "n.name", F.size("n.images").alias("images"), F.size("n.offers").alias("offers"), F.size(P.og_images(F.col("html"))).alias("og")).replace(-1, None, ["images", "offers"])


@query("X38_page_sizes", f"{PAGE_SQL} SELECT id, CASE k WHEN 0 THEN 'S,M' WHEN 1 THEN 'XL' WHEN 2 THEN '36,38,40' ELSE '' END AS sizes FROM p")
def page_sizes(spark, sf_dir):
    p = product_pages(spark, sf_dir).withColumn("n", P.product_node("html"))
    return p.select("id", F.array_join(P.page_sizes(F.col("n.sizes"), F.col("html")), ",").alias("sizes"))


@query("X40_inline_models", f"{PAGE_SQL} SELECT id, CASE WHEN k = 4 THEN 4 END AS variants FROM p")
def inline_models(spark, sf_dir):
    """The object at the anchor, whatever comes after it."""
    p = product_pages(spark, sf_dir)
    return p.select("id", F.size(S.page_model(F.col("html"))["productVariantData"]).alias("variants")).replace(-1, None, ["variants"])


@query("X41_model_price_stock", f"{PAGE_SQL} SELECT id, CASE WHEN k = 4 THEN price END AS price, CASE WHEN k = 4 THEN z % 2 = 1 END AS stock FROM p")
def model_price_stock(spark, sf_dir):
    p = product_pages(spark, sf_dir).withColumn("m", S.page_model(F.col("html")))
    return p.select("id", S.model_price(F.col("m")).alias("price"), F.when(F.col("m").isNotNull(), S.model_stock(F.col("m"))).alias("stock"))


RECORD_SQL = f"""{PAGE_SQL}, c AS (SELECT *, unnest(CASE WHEN k = 4 THEN ['Siyah', 'Mavi'] WHEN k = 0 THEN ['Siyah'] WHEN k < 4 THEN [''] ELSE [] END) AS color FROM p)
    SELECT id, name, color, CASE k WHEN 0 THEN price + 5 ELSE price END AS price, CASE k WHEN 0 THEN 'USD' WHEN 3 THEN 'EUR' ELSE 'TRY' END AS currency,
    CASE k WHEN 0 THEN false WHEN 4 THEN z % 2 = 1 ELSE true END AS in_stock,
    CASE k WHEN 0 THEN 'S,M' WHEN 1 THEN 'XL' WHEN 2 THEN '36,38,40' WHEN 4 THEN CASE WHEN z % 2 = 1 THEN 'M' ELSE 'M,L' END ELSE '' END AS sizes,
    CASE k WHEN 0 THEN 'https://shop.x.com/a/' || id || '.jpg' WHEN 1 THEN 'https://cdn.x.com/' || id || '.webp' WHEN 2 THEN 'https://shop.x.com/p/b/' || id || '.png'
    WHEN 3 THEN 'https://cdn.x.com/' || id || '.jpg?a=1&b=2' ELSE CASE WHEN color = 'Siyah' THEN 'https://shop.x.com/r/' || id || '.jpg' ELSE 'https://shop.x.com/m/' || id || '.jpg' END END AS image FROM c"""


def shown(records: DataFrame) -> DataFrame:
    id_ = F.regexp_extract("product_url", "([0-9]+)$", 1).cast("long")
    return records.select(id_.alias("id"), "name", "color", "price", "currency", "in_stock", F.array_join("sizes", ",").alias("sizes"), "image")


@query("X42_page_records", RECORD_SQL)
def page_records(spark, sf_dir):
    return shown(S.page_records(product_pages(spark, sf_dir)))


@query("S18_site_records", RECORD_SQL)
def site_records(spark, sf_dir):
    """Every page twice, under two addresses; a record of a name, colour and image stays once."""
    pages = product_pages(spark, sf_dir)
    again = pages.withColumn("url", F.concat("url", F.lit("?utm=1/"), F.col("id").cast("string")))
    return shown(S.distinct_records(S.page_records(pages.unionByName(again))))


GRAPH = """[{"id":"g{id}","name":" {name} ","metaData":{"slug":"s-{id}"},"tags":[{"name":"t"}],"categories":[{"name":"c"}],"productVariantTypes":[{"variantType":{"id":"T1","name":"Renk","values":[{"id":"r","name":"Kırmızı","colorCode":"#ff0000"},{"id":"b","name":"Mavi"}]}},{"variantType":{"id":"T2","name":"Siyah","values":[{"id":"s","name":"S"},{"id":"m","name":"M"}]}}],"variants":[{"stocks":[{"stockCount":{stock}}],"variantValues":[{"variantTypeId":"T1","variantValueId":"r"},{"variantTypeId":"T2","variantValueId":"s"}],"prices":[{"priceListId":"x","sellPrice":"1"},{"sellPrice":"{dear}","discountPrice":"{price}","currency":"EUR"}],"images":[{"id":"i2","fileName":"two.png","order":2},{"id":"i1","fileName":"one.jpg","order":1}]},{"sellIfOutOfStock":false,"stocks":[],"variantValues":[{"variantTypeId":"T1","variantValueId":"r"},{"variantTypeId":"T2","variantValueId":"m"}],"prices":[{"sellPrice":"7"}],"images":[]},{"isActive":false,"variantValues":[{"variantTypeId":"T1","variantValueId":"b"}],"images":[{"id":"i3"}]}]}]"""


@query(
    "S14_graph_records",
    """SELECT lower(replace(p_brand, '#', '-')) AS brand_slug, p_partkey AS id, p_name AS name, 'Kırmızı' AS color, '#ff0000' AS color_code, p_size % 2 = 1 AS in_stock,
    CASE WHEN p_size % 2 = 1 THEN 'S' ELSE 'S,M' END AS sizes, CASE WHEN p_size % 2 = 1 THEN p_size * 10.0 ELSE least(7.0, p_size * 10.0) END::DOUBLE AS price, 'EUR' AS currency,
    'https://c/images/M/i1/1080/one.webp|https://c/images/M/i2/1080/two.webp' AS images FROM part""",
)
def graph_records(spark, sf_dir):
    """Typed variants by colour; the size choice is told by its values, not by its name; inactive variants are left out."""
    p = part(spark, sf_dir)
    body = fill(GRAPH, id=F.col("id"), name=F.col("p_name"), stock=F.col("p_size") % 2, dear=F.col("p_size") * 20, price=F.col("p_size") * 10)
    bodies = p.select("brand_slug", F.lit("https://g.com/").alias("url"), F.lit("https://c/").alias("cdn"), F.lit("M").alias("merchant"), body.alias("body"))
    found = S.graph_records(bodies)
    return found.select("brand_slug", F.regexp_extract("product_url", "^https://g.com/s-([0-9]+)$", 1).cast("long").alias("id"), "name", "color", "color_code", "in_stock", F.array_join("sizes", ",").alias("sizes"), "price", "currency", F.array_join("images", "|").alias("images"))


@query("X46_size_choice", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Renk' WHEN 1 THEN 'Beden' END AS name FROM part")
def size_choice(spark, sf_dir):
    """By its values; a name counts among several only."""
    option = lambda name, *values: F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, values)).alias("values"))
    cases = [F.array(option("Renk", "S", "M"), option("Beden", "Mavi", "Gri")), F.array(option("Renk", "S", "M"), option("Beden", "36", "38")), F.array(option("Beden", "Mavi"), option("x", "uzun metin parçası"))]
    options = F.element_at(F.array(*cases), (F.col("id") % 3 + 1).cast("int"))
    return part(spark, sf_dir).select("id", S.pick_sizes(options)["name"].alias("name"))


@query("X47_variant_prices", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_size * 10.0 WHEN p_size % 3 = 1 THEN p_size * 1.0 ELSE p_size * 2.0 END::DOUBLE AS price FROM part")
def variant_prices(spark, sf_dir):
    """The default list's row before others; its discount before its price."""
    row = lambda k, sell, cut: F.struct(k.cast("string").alias("priceListId"), sell.cast("string").alias("sellPrice"), cut.cast("string").alias("discountPrice"), F.lit("TRY").alias("currency"))
    z, none = F.col("p_size"), F.lit(None)
    prices = F.when(z % 3 == 0, F.array(row(F.lit("a"), z, none), row(none, z * 20, z * 10))).when(z % 3 == 1, F.array(row(F.lit("a"), z, none))).otherwise(F.array(row(none, z * 2, F.lit(0))))
    return part(spark, sf_dir).select("id", S.variant_price(prices).alias("price"))


@query("X48_image_urls", "SELECT p_partkey AS id, CASE WHEN p_size % 4 > 0 THEN 'https://c/images/M/' || p_size || '/1080/' || CASE WHEN p_size % 2 = 0 THEN 'my.photo' ELSE 'image' END || '.webp' END AS url FROM part")
def image_urls(spark, sf_dir):
    image = F.struct(F.when(F.col("p_size") % 4 > 0, F.col("p_size").cast("string")).alias("id"), F.when(F.col("p_size") % 2 == 0, "my.photo.JPG").alias("fileName"))
    return part(spark, sf_dir).select("id", S.image_url(F.lit("https://c/"), F.lit("M"), image).alias("url"))


MARKET = """{"link":"https://m/{id}","name":"{name}","primary_image":"l{id}.jpg","price":{"price_code":"TL","price_formatted":"{dear},50 TL"},"labels":{"out_of_stock":{"enabled":true}}}"""
MARKET_HTML = """<html><meta property="og:description" content="soft  cloth"><img src="https://cdn.shopier.app/pictures_large/p{id}.jpg"><script>window.x = {"page":"product","product":{"stock":3,"price":{"price_legacy_formatted":"{price}.00"},"variations":{"variation_1_name":"Renk","variation_1":[{"name":"Kırmızı","stock":1},{"name":"Mavi","stock":0}],"variation_2_name":"Kalıp","variation_2":[{"name":"S","stock":{stock}},{"name":"M","stock":0}]}}}</script></html>"""


@query(
    "S17_market_records",
    """WITH p AS (SELECT p_partkey AS id, p_name AS name, p_size AS z, p_partkey % 3 = 0 AS bare FROM part), c AS (SELECT *, unnest(CASE WHEN bare THEN [''] ELSE ['Kırmızı', 'Mavi'] END) AS color FROM p)
    SELECT id, name, color, CASE WHEN bare THEN z * 20 + 0.5 ELSE z * 10.0 END::DOUBLE AS price, NOT bare AND z % 2 = 1 AND color <> 'Mavi' AS in_stock,
    CASE WHEN bare THEN '' WHEN z % 2 = 1 THEN 'S' ELSE 'S,M' END AS sizes, 'https://cdn.shopier.app/pictures_large/' || CASE WHEN bare THEN 'l' ELSE 'p' END || id || '.jpg' AS image, CASE WHEN bare THEN '' ELSE 'soft cloth' END AS about FROM c""",
)
def market_records(spark, sf_dir):
    """A third of the listing has no page; the stock of a size choice goes before the product's."""
    p = part(spark, sf_dir)
    rows = p.select("brand_slug", fill(MARKET, id=F.col("id"), name=F.col("p_name"), dear=F.col("p_size") * 20).alias("row"))
    html = fill(MARKET_HTML, id=F.col("id"), price=F.col("p_size") * 10, stock=F.col("p_size") % 2)
    pages = p.filter("id % 3 <> 0").select(F.concat(F.lit("https://m/"), F.col("id").cast("string")).alias("link"), html.alias("html"))
    found = S.market_records(rows, pages)
    return found.select(F.regexp_extract("product_url", "([0-9]+)$", 1).cast("long").alias("id"), "name", "color", "price", "in_stock", F.array_join("sizes", ",").alias("sizes"), "image", F.col("source_text").alias("about"))


OWN = """[{"name":"{name}","slug":"o{id}","price":{price},"currency":"usd","images":[{"url":"/1.jpg","sort_order":2},{"url":"/2.jpg","is_primary":true,"sort_order":9}],"variants":[{"size":"S","stock":0},{"name":"M","stock":{stock}}]},{"name":"","images":[{"url":"x"}]},{"name":"{bad}","images":[]}]"""


@query(
    "S20_own_api",
    """WITH p AS (SELECT lower(replace(p_brand, '#', '-')) AS brand_slug, p_partkey AS id, p_name AS name, p_size AS z FROM part), g AS (SELECT brand_slug FROM p GROUP BY 1 HAVING count(*) >= greatest(3, count(*) * CASE WHEN brand_slug LIKE '%-1%' THEN 3 ELSE 2 END * 0.5))
    SELECT id, name, z * 10.0::DOUBLE AS price, 'USD' AS currency, z % 2 = 1 AS in_stock, CASE WHEN z % 2 = 1 THEN 'M' ELSE 'S,M' END AS sizes, 'https://own.com/2.jpg' AS image FROM p WHERE brand_slug IN (SELECT brand_slug FROM g)""",
)
def own_api(spark, sf_dir):
    """Stores of which too few rows are usable give nothing: here those with two useless rows to a good one."""
    p = part(spark, sf_dir)
    body = fill(OWN, id=F.col("id"), name=F.col("p_name"), price=F.col("p_size") * 10, stock=F.col("p_size") % 2, bad=F.lit("x"))
    body = F.when(F.contains("brand_slug", F.lit("-1")), body).otherwise(F.regexp_replace(body, r',\{"name":"","images":\[\{"url":"x"\}\]\}', ""))
    found = S.own_api_records(p.select("brand_slug", F.lit("https://own.com").alias("url"), body.alias("body")))
    return found.select(F.regexp_extract("product_url", "/urun/o([0-9]+)$", 1).cast("long").alias("id"), "name", "price", "currency", "in_stock", F.array_join("sizes", ",").alias("sizes"), "image")


@query(
    "S24_fallback",
    """WITH p AS (SELECT lower(replace(p_brand, '#', '-')) AS brand_slug, p_size AS z FROM part), b AS (SELECT brand_slug, bool_or(z > 48) AS own FROM p GROUP BY 1)
    SELECT brand_slug, CASE WHEN own THEN 'own' ELSE 'pages' END AS source, count(*) AS n FROM p JOIN b USING (brand_slug) WHERE (own AND z > 48) OR (NOT own AND brand_slug <> 'brand-3') GROUP BY ALL""",
)
def fallback(spark, sf_dir):
    """Brands whose own reader gave nothing take the pages' records, but for those on a platform without fallback."""
    p = part(spark, sf_dir)
    record = lambda rows, source: rows.select("brand_slug", F.lit(source).alias("name"), *(F.lit(None).cast("string").alias(c) for c in S.RECORD[2:]))
    platforms = p.select("brand_slug").distinct().withColumn("platform", F.when(F.col("brand_slug") == "brand-3", "shopier").otherwise("jsonld"))
    found = S.with_fallback(record(p.filter("p_size > 48"), "own"), record(p, "pages"), platforms=platforms)
    return found.groupBy("brand_slug", F.col("name").alias("source")).agg(F.count("*").alias("n"))


HOST = "lower(regexp_extract(url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1))"


@query(
    "S23_platform",
    f"""SELECT page_id, CASE WHEN regexp_matches({HOST}, '(^|\\.)shopier\\.com$') THEN 'shopier' WHEN regexp_matches(html, '(?i)myikas\\.com|__IKAS|cdn\\.myikas') THEN 'ikas'
    WHEN regexp_matches(html, '(?i)cdn\\.shopify\\.com|Shopify\\.theme|shopify-features') THEN 'shopify' WHEN regexp_matches(html, '(?i)wp-json|woocommerce') THEN 'woocommerce' ELSE 'jsonld' END AS platform
    FROM (SELECT page_id, CASE page_id % 6 WHEN 5 THEN 'https://a.shopier.com/' ELSE url END AS url,
          html || CASE page_id % 6 WHEN 1 THEN '<link href="//CDN.shopify.com/x">' WHEN 2 THEN '<i class="WooCommerce">' WHEN 3 THEN '<s>window.__ikas</s>' ELSE '' END AS html FROM pages)""",
)
def platform(spark, sf_dir):
    marks = F.element_at(F.array(*map(F.lit, ["", '<link href="//CDN.shopify.com/x">', '<i class="WooCommerce">', "<s>window.__ikas</s>", "", ""])), (F.col("page_id") % 6 + 1).cast("int"))
    url = F.when(F.col("page_id") % 6 == 5, "https://a.shopier.com/").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", S.platform(url, F.concat("html", marks)).alias("platform"))


CODES = ["tl", "", "usd", "₺", "EURO", " eur "]


@query("S30_store_currency", "SELECT p_partkey AS id, ['TRY', 'TRY', 'USD', 'TRY', 'TRY', 'EUR'][p_partkey % 6 + 1] AS market, ['TRY', 'TRY', 'USD', 'TRY', 'TRY', 'TRY'][p_partkey % 6 + 1] AS shop FROM part")
def store_currency(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("id") % 6 + 1).cast("int"))
    return part(spark, sf_dir).select("id", S.currency_of(code).alias("market"), S.shop_currency(code).alias("shop"))


@query("X22_days_since", "WITH n AS (SELECT max(o_orderdate) AS now FROM orders) SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 30 ELSE greatest(0, CAST(round(date_diff('second', o_orderdate, now - INTERVAL 100 DAY) / 86400.0) AS INTEGER)) END AS days FROM orders, n")
def days_since(spark, sf_dir):
    """Days to a fixed now, here a hundred days before the last order; later times count as today."""
    o = table(spark, sf_dir, "orders")
    now = o.agg((F.max("o_orderdate") - F.expr("INTERVAL 100 DAYS")).alias("now"))  # one row
    at = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    return o.crossJoin(F.broadcast(now)).select(F.col("o_orderkey").alias("id"), S.days_since(at, F.col("now")).alias("days"))


SITEMAP = "<urlset>{full}</urlset>"


@query("X43_sitemaps", "SELECT p_partkey AS id, 'https://x.com/' || p_partkey || '&a' AS loc, p_partkey % 3 = 0 AS image FROM part UNION ALL SELECT p_partkey, 'https://x.com/b/' || p_partkey, false FROM part WHERE p_partkey % 3 = 2")
def sitemaps(spark, sf_dir):
    """Url blocks with and without an image; where there are none, bare locations."""
    with_image = "<url><loc><![CDATA[https://x.com/{id}&a]]></loc><image:image>i</image:image></url>"
    plain = "<url>\n<loc> https://x.com/{id}&a </loc></url>"
    bare = "<sitemap><loc>https://x.com/{id}&a</loc></sitemap><loc>https://x.com/b/{id}</loc>"
    xml = F.element_at(F.array(*map(F.lit, [with_image, plain, bare])), (F.col("id") % 3 + 1).cast("int"))
    xml = F.replace(xml, F.lit("{id}"), F.col("id").cast("string"))
    return part(spark, sf_dir).select("id", F.explode(P.url_blocks(xml)).alias("b")).select("id", "b.loc", "b.image")


@query("X43_image_candidates", "SELECT p_partkey AS id, p_partkey % 4 <> 1 AS ok, CASE p_partkey % 4 WHEN 0 THEN 'https://s.com/a/x.jpg' WHEN 1 THEN 'https://s.com/a/no image' WHEN 2 THEN 'https://s.com/my photo.png?x=1' ELSE 'https://t.com/i' END AS url FROM part")
def image_candidates(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ["x.jpg", "no image", "/my photo.png?x=1", "//t.com/i"])), (F.col("id") % 4 + 1).cast("int"))
    return part(spark, sf_dir).select("id", P.image_candidate(raw).alias("ok"), P.absolute(F.lit("https://s.com/a/b"), raw).alias("url"))


HOSTS = ["https://cdn.example.com/x", "https://example.com:8080/", "https://badexample.com/", "https://127.0.0.1/a", "http://localhost/x", "https://intranet/x", "https://A.B.Example.COM/x", "nonsense"]


@query(
    "F18_allowed_hosts",
    f"SELECT page_id, regexp_matches({HOST}, '(^|\\.)example\\.(com|net)$') AS allowed FROM pages UNION ALL SELECT -s_suppkey - 1, [true, true, false, false, false, false, true, false][s_suppkey % 8 + 1] FROM supplier",
)
def allowed_hosts(spark, sf_dir):
    """A listed domain or one below it; addresses, local names and names without a dot are refused."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    made = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("page_id"), F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("s_suppkey") % 8 + 1).cast("int")).alias("url"))
    listed = spark.createDataFrame([("example.com",), ("example.net",)], "suffix string")
    return allowed_image_host(pages.unionByName(made), listed).select("page_id", "allowed")


@query("F28_parked", "SELECT page_id, page_id % 7 = 3 OR length(html) < 800 OR regexp_matches(substr(html, 1, 4000), '(?i)sedo|parked') AS parked FROM pages")
def parked(spark, sf_dir):
    """A page that says its domain is for sale, or with next to nothing on it."""
    html = F.when(F.col("page_id") % 7 == 3, F.concat(F.lit("<p>Buy This Domain</p>"), "html")).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", looks_parked(html).alias("parked"))
