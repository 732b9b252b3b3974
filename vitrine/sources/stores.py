"""Landed store pages and store API bodies to records: one row for each product and colour.

All readers give the columns of RECORD; what a store does not say is null or empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.functions import pages as P
from vitrine.functions.html import entities, meta
from vitrine.functions.sizes import known_sizes, let, looks_like_sizes, normalize_sizes
from vitrine.functions.text import parse_number

RECORD = ["brand_slug", "name", "source_text", "color", "color_code", "image", "images", "sizes", "in_stock", "price", "currency", "product_url"]
MAX_IMAGES, MAX_NAME = 5, 140
TEXTS = "array<string>"


def no_texts() -> Column:
    return F.array().cast(TEXTS)


def first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def shop_currency(code: Column) -> Column:
    """Three letters, else the home currency."""
    return F.when(code.rlike("^[A-Za-z]{3}$"), F.upper(code)).otherwise("TRY")


def currency_of(code: Column) -> Column:
    """A currency from a code or sign as stores write it."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(c.isin("", "TL", "₺") | ~c.rlike("^[A-Z]{3}$"), "TRY").otherwise(c)


def days_since(at: Column, now: Column) -> Column:
    """Whole days from a time to now, never negative; 30 if it is not known."""
    days = F.round((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000)
    return F.when(days.isNull(), 30).otherwise(F.greatest(days, F.lit(0))).cast("int")


def pick_sizes(options: Column, values: str = "values") -> Column:
    """Of options with a name and values the one of sizes: by its values first, by its name among several."""
    like = F.filter(options, lambda o: looks_like_sizes(o[values]))
    return let(like, lambda found: F.coalesce(first(F.filter(found, lambda o: o["name"].rlike(P.SIZE_NAME))), first(found)))


# -- product lists of one shop system --------------------------------------------------------------------------

COLOR_NAME = r"(?i)renk|color|colour"
SHOP_VARIANT = "struct<id:long,option1:string,option2:string,option3:string,price:string,available:boolean,featured_image:struct<src:string>>"
SHOP_PRODUCT = f"""struct<id:long,title:string,handle:string,product_type:string,options:array<struct<name:string,position:int,`values`:array<string>>>,
    variants:array<{SHOP_VARIANT}>,images:array<struct<src:string,variant_ids:array<long>>>>"""


def option_value(variant: Column, option: Column) -> Column:
    """A variant's trimmed value of an option; empty without one."""
    given = F.array(variant["option1"], variant["option2"], variant["option3"])
    return F.trim(F.coalesce(F.try_element_at(given, option["position"]), F.lit("")))


def shopify_records(pages: DataFrame) -> DataFrame:
    """Landed product lists (brand, body JSON) to one record per product and colour.

    The size option is found by its values, its name decides among several; the colour option by its name, never the
    same option.  Colours are what the variants say, else the option's list.  Sizes and the least price come from the
    colour's variants in stock, from all of them if none is; its pictures are those tied to its variants.  All of it is
    array work within a product: no shuffle.
    """
    some = F.array().cast(f"array<{SHOP_VARIANT}>")
    p = pages.select("brand", F.explode(F.from_json("body", f"products array<{SHOP_PRODUCT}>")["products"]).alias("p"))
    p = p.select("brand", "p.*").filter(F.size("images") > 0).withColumn("variants", F.coalesce("variants", some)).withColumn("size_option", pick_sizes(F.col("options")))
    is_color = lambda o: o["name"].rlike(COLOR_NAME) & ~F.coalesce(o["position"] == F.col("size_option.position"), F.lit(False))
    p = p.withColumn("color_option", first(F.filter("options", is_color)))
    colors = F.array_distinct(F.filter(F.transform("variants", lambda v: option_value(v, F.col("color_option"))), lambda c: c != ""))
    colors = F.when(F.col("color_option").isNull(), no_texts()).when(F.size(colors) > 0, colors).otherwise(F.coalesce("color_option.values", no_texts()))
    p = p.withColumn("colors", colors).withColumn("one", F.size("colors") == 0)
    p = p.withColumn("color", F.explode(F.when(F.col("one"), F.array(F.lit(""))).otherwise(F.col("colors"))))
    p = p.withColumn("mine", F.when(F.col("one"), F.col("variants")).otherwise(F.filter("variants", lambda v: option_value(v, F.col("color_option")) == F.col("color"))))
    p = p.withColumn("live", F.filter("mine", lambda v: F.coalesce(v["available"], F.lit(False))))
    p = p.withColumn("src", F.when(F.size("live") > 0, F.col("live")).otherwise(F.col("mine")))
    sized = F.col("size_option").isNotNull()
    sizes = (
        F.when(sized & F.col("one"), normalize_sizes(F.col("size_option.values")))
        .when(sized, normalize_sizes(F.transform("src", lambda v: option_value(v, F.col("size_option")))))
        .when(F.col("one"), known_sizes(F.transform("variants", lambda v: F.trim(F.coalesce(v["option1"], F.lit(""))))))
        .otherwise(no_texts())
    )
    every = F.col("images.src")
    tied = F.filter("images", lambda i: F.arrays_overlap(F.coalesce(i["variant_ids"], F.array().cast("array<long>")), F.col("mine.id")))["src"]
    tied = F.when(F.col("one"), no_texts()).otherwise(F.array_distinct(tied))
    shown = first(F.filter(F.transform("mine", lambda v: v["featured_image"]["src"]), lambda u: u.isNotNull()))
    image = F.coalesce(first(tied), F.when(~F.col("one"), shown), every[0])
    prices = F.filter(F.transform("src", lambda v: parse_number(v["price"])), lambda x: x > 0)
    return p.select(
        "brand", "id", F.trim("title").alias("name"), "color", image.alias("image"), F.slice(F.array_distinct(F.concat(F.array(image), tied, every)), 1, MAX_IMAGES).alias("images"),
        sizes.alias("sizes"), (F.size("live") > 0).alias("in_stock"), F.array_min(prices).alias("price"),
    )


# -- pages with structured data ------------------------------------------------------------------------------

MODEL = """struct<productActive:boolean, productPriceStr:string, productPriceKDVIncluded:string, productPrice:string, totalStockAmount:string,
    product:struct<aktif:boolean, stokAdedi:string, indirimliFiyatiStr:string, urunFiyatiOrjinalStr:string, satisFiyatiStr:string, indirimliFiyati:string, satisFiyati:string>,
    productVariantData:array<struct<ekSecenekTipiTanim:string, tanim:string, aktif:boolean, stokAdedi:string, resimYolu:string, renkKodu:string>>>"""


def page_model(html: Column) -> Column:
    """The product model that some shop software leaves in a page's script."""
    return F.from_json(P.inline_json(html, "productDetailModel"), MODEL)


def model_price(m: Column) -> Column:
    """The first positive of the model's prices, written ones before plain ones."""
    p = m["product"]
    prices = [m["productPriceStr"], m["productPriceKDVIncluded"], p["indirimliFiyatiStr"], p["urunFiyatiOrjinalStr"], p["satisFiyatiStr"], m["productPrice"], p["indirimliFiyati"], p["satisFiyati"]]
    return first(F.filter(F.array(*map(parse_number, prices)), lambda x: x > 0))


def model_stock(m: Column) -> Column:
    """True, false, or null where the model doesn't say: its variants' counts, else the product's."""
    rows = F.filter(m["productVariantData"], lambda v: v.stokAdedi.isNotNull())
    live = F.exists(rows, lambda v: F.coalesce(v.aktif, F.lit(True)) & (v.stokAdedi.try_cast("double") > 0))
    off = F.coalesce(~m["productActive"], F.lit(False)) | F.coalesce(~m["product"]["aktif"], F.lit(False))
    return F.when(off, False).when(F.size(rows) > 0, F.coalesce(live, F.lit(False))).otherwise(parse_number(F.coalesce(m["totalStockAmount"], m["product"]["stokAdedi"])) > 0)


def page_records(pages: DataFrame) -> DataFrame:
    """Pages (brand_slug, url, html) to records; a page that shows no product, name or image gives none.

    A page with a colour choice in its model gives one record a colour; the page's other facts are shared.
    """
    p = pages.withColumn("node", P.product_node("html")).withColumn("model", page_model(F.col("html")))
    node, html = F.col("node"), F.col("html")
    name = F.trim(F.coalesce(node["name"], meta(html, "og:title")))
    shown = F.array_distinct(F.concat(F.coalesce(node["images"], no_texts()), F.transform(P.og_images(html), entities)))
    p = p.withColumn("name", name).withColumn("raw", F.filter(shown, P.image_candidate))
    price = F.coalesce(P.best_offer(node["offers"], node["price"]), parse_number(meta(html, "product:price:amount")), model_price(F.col("model")))
    p = p.withColumn("price", price).filter((F.col("name") != "") & (F.size("raw") > 0))
    is_product = F.lower(F.coalesce(meta(html, "og:type"), F.lit(""))).isin("product", "product.item")
    p = p.filter(node["name"].isNotNull() | (F.size(node["offers"]) >= 0) | is_product | F.col("price").isNotNull())
    said = F.lower(F.coalesce(first(node["offers"])["availability"], F.lit("")))
    stock = F.coalesce(model_stock(F.col("model")), F.when(said != "", said.rlike("instock|in_stock")).otherwise(True))
    vd = F.coalesce(F.col("model")["productVariantData"], F.from_json(F.lit("[]"), "array<struct<ekSecenekTipiTanim:string, tanim:string, aktif:boolean, stokAdedi:string, resimYolu:string, renkKodu:string>>"))
    colored = lambda v: F.coalesce(v.ekSecenekTipiTanim.rlike(P.COLOR_NAME), F.lit(False))
    rows = F.filter(vd, lambda v: ~colored(v))
    live = F.filter(rows, lambda v: F.coalesce(v.aktif, F.lit(True)) & (v.stokAdedi.try_cast("double") > 0))
    source = F.when(F.size(live) > 0, live).otherwise(rows)
    named = F.filter(source, lambda v: F.coalesce(v.ekSecenekTipiTanim.rlike(P.SIZE_NAME), F.lit(False)))
    labels = F.transform(F.when(F.size(named) > 0, named).otherwise(source), lambda v: F.trim(v.tanim))
    model_sizes = F.when(F.size(named) > 0, normalize_sizes(labels)).otherwise(known_sizes(labels))
    p = p.select(
        "brand_slug",
        F.substring("name", 1, MAX_NAME).alias("name"),
        F.concat_ws(" ", node["category"], F.concat_ws(" ", node["keywords"])).alias("source_text"),
        F.slice(P.absolute_all("url", "raw"), 1, MAX_IMAGES).alias("images"),
        stock.alias("in_stock"),
        "price",
        F.upper(F.coalesce(first(node["offers"])["currency"], meta(html, "product:price:currency"), F.lit("TRY"))).alias("currency"),
        F.col("url").alias("product_url"),
        F.when(F.size(vd) > 0, model_sizes).otherwise(P.page_sizes(node["sizes"], html)).alias("sizes"),
        F.trim(F.split(F.coalesce(node["color"], F.lit("")), "[/,]")[0]).alias("own_color"),
        (F.size(vd) > 0).alias("modelled"),
        F.filter(vd, colored).alias("colors"),
    )
    p = p.withColumn("c", F.explode_outer("colors")).withColumn("swatch", P.absolute("product_url", F.col("c.resimYolu")))
    own = F.when((F.col("swatch") != "") & ~F.col("swatch").rlike("(?i)/varyasyonresim/"), F.col("swatch"))
    images = F.when(own.isNotNull(), F.slice(F.array_distinct(F.concat(F.array(own), "images")), 1, MAX_IMAGES)).otherwise(F.col("images"))
    color = F.when(F.col("c").isNotNull(), F.trim("c.tanim")).when(F.col("modelled"), "").otherwise(F.col("own_color"))
    p = p.withColumn("images", images).withColumn("color", color).withColumn("color_code", F.col("c.renkKodu")).withColumn("image", first(F.col("images")))
    return p.select(*RECORD)


def distinct_records(records: DataFrame) -> DataFrame:
    """One record of each name, colour and image, the one whose address is first."""
    first_url = F.row_number().over(Window.partitionBy("brand_slug", "name", "color", "image").orderBy("product_url"))
    return records.withColumn("_k", first_url).filter("_k = 1").drop("_k")


# -- store APIs ------------------------------------------------------------------------------------------------

VARIANT_TYPE = "struct<variantType:struct<id:string,name:string,values:array<struct<id:string,name:string,colorCode:string>>>>"
IKAS = f"""array<struct<id:string, name:string, metaData:struct<slug:string>, tags:array<struct<name:string>>, categories:array<struct<name:string>>, productVariantTypes:array<{VARIANT_TYPE}>,
    variants:array<struct<isActive:boolean, sellIfOutOfStock:boolean, stocks:array<struct<stockCount:double>>, variantValues:array<struct<variantTypeId:string,variantValueId:string>>,
    prices:array<struct<priceListId:string,sellPrice:string,discountPrice:string,currency:string>>, images:array<struct<id:string,fileName:string,`order`:int>>>>>>"""


def price_row(prices: Column) -> Column:
    """The row of the default price list, else the first."""
    return F.coalesce(first(F.filter(prices, lambda r: r.priceListId.isNull())), first(prices))


def variant_price(prices: Column) -> Column:
    row = price_row(prices)
    cut = parse_number(row["discountPrice"])
    return F.when(cut > 0, cut).otherwise(parse_number(row["sellPrice"]))


def image_url(cdn: Column, merchant: Column, image: Column, width: int = 1080) -> Column:
    stem = F.regexp_replace(F.coalesce(image["fileName"], F.lit("image")), r"(?i)\.[a-z0-9]+$", "")
    return F.when((merchant != "") & (image["id"] != ""), F.concat(cdn, F.lit("images/"), merchant, F.lit("/"), image["id"], F.lit(f"/{width}/"), stem, F.lit(".webp")))


def graph_records(bodies: DataFrame) -> DataFrame:
    """Landed answers (brand_slug, url, cdn, merchant, body: JSON array of products) with typed variants to records.

    Variants are dealt into buckets by colour; sizes and price come from those in stock, from all if none is.
    """
    p = bodies.select("brand_slug", F.regexp_replace("url", "/$", "").alias("url"), "cdn", "merchant", F.explode(F.from_json("body", IKAS)).alias("p"))
    p = p.withColumn("pid", F.col("p.id")).dropDuplicates(["brand_slug", "pid"])
    types = F.transform("p.productVariantTypes", lambda t: F.struct(t.variantType.id.alias("id"), t.variantType["name"].alias("name"), t.variantType["values"].alias("rows"), F.transform(t.variantType["values"], lambda v: v["name"]).alias("values")))
    p = p.withColumn("types", types).withColumn("size_type", pick_sizes(F.col("types")))
    color_type = first(F.filter("types", lambda t: t["name"].rlike(P.COLOR_NAME) & ~t.id.eqNullSafe(F.col("size_type")["id"])))
    p = p.withColumn("color_type", color_type).withColumn("named", F.flatten(F.transform("types", lambda t: t.rows)))
    v = p.select("*", F.posexplode("p.variants").alias("at", "v")).filter(F.coalesce(F.col("v.isActive"), F.lit(True)))
    chosen = lambda kind: first(F.filter("v.variantValues", lambda x: x.variantTypeId == F.col(kind)["id"]))["variantValueId"]
    called = lambda key: first(F.filter("named", lambda n: n.id == key))
    count = F.aggregate(F.coalesce("v.stocks", F.array().cast("array<struct<stockCount:double>>")), F.lit(0.0), lambda a, s: a + F.coalesce(s.stockCount, F.lit(0.0)))
    images = F.transform(F.array_sort(F.transform("v.images", lambda i, k: F.struct(F.coalesce(i["order"], F.lit(0)).alias("o"), k.alias("k"), i.alias("i")))), lambda x: image_url(F.col("cdn"), F.col("merchant"), x.i))
    v = v.withColumn("color_id", F.coalesce(chosen("color_type"), F.lit(""))).withColumn("size_id", chosen("size_type"))
    v = v.select(
        "brand_slug", "pid", "url", "at", "color_id",
        F.col("p.name").alias("name"), F.col("p.metaData.slug").alias("slug"),
        F.concat_ws(" ", F.transform("p.tags", lambda t: t["name"]), F.transform("p.categories", lambda c: c["name"])).alias("source_text"),
        called(F.col("color_id")).alias("color"), called(F.col("size_id"))["name"].alias("size"),
        (F.coalesce(F.col("v.sellIfOutOfStock"), F.lit(False)) | (count > 0)).alias("live"),
        variant_price(F.col("v.prices")).alias("price"), price_row(F.col("v.prices"))["currency"].alias("currency"),
        F.filter(images, lambda u: u.isNotNull()).alias("images"),
    )
    # a product's variants are few and arrive in one JSON row, so their lists per colour are small
    in_order = lambda c, of="true": F.transform(F.array_sort(F.collect_list(F.when(F.expr(of), F.struct("at", F.col(c).alias("x"))))), lambda s: s.x)
    g = v.groupBy("brand_slug", "pid", "color_id").agg(
        F.max("live").alias("in_stock"), F.min(F.when(F.col("live") & (F.col("price") > 0), F.col("price"))).alias("live_price"), F.min(F.when(F.col("price") > 0, F.col("price"))).alias("any_price"),
        in_order("size", "live and size is not null").alias("live_sizes"), in_order("size", "size is not null").alias("any_sizes"),
        in_order("currency", "live and currency is not null").alias("live_currency"), in_order("currency", "currency is not null").alias("any_currency"),
        F.slice(F.array_distinct(F.flatten(in_order("images"))), 1, MAX_IMAGES).alias("images"),
        *(F.first(c).alias(c) for c in ("name", "slug", "url", "source_text", "color")),
    )
    pick = lambda c: F.when(F.col("in_stock"), F.col(f"live_{c}")).otherwise(F.col(f"any_{c}"))
    g = g.filter(F.size("images") > 0)
    return g.select(
        "brand_slug",
        F.substring(F.trim("name"), 1, MAX_NAME).alias("name"),
        "source_text",
        F.coalesce("color.name", F.lit("")).alias("color"),
        F.col("color.colorCode").alias("color_code"),
        first(F.col("images")).alias("image"),
        "images",
        normalize_sizes(pick("sizes")).alias("sizes"),
        "in_stock",
        pick("price").alias("price"),
        F.coalesce(first(pick("currency")), F.lit("TRY")).alias("currency"),
        F.when(F.col("slug") != "", F.concat("url", F.lit("/"), "slug")).otherwise(F.col("url")).alias("product_url"),
    )


MARKET_ROW = "struct<link:string,name:string,primary_image:string,price:struct<price_code:string,price_legacy_formatted:string,price_formatted:string>,labels:struct<out_of_stock:struct<enabled:boolean>>>"
_VARIATION = "array<struct<name:string,stock:double>>"
MARKET_PAGE = f"""struct<product:struct<stock:double, price:struct<price_legacy_formatted:string>, variations:struct<variation_1:{_VARIATION}, variation_1_name:string,
    variation_2:{_VARIATION}, variation_2_name:string, variation_3:{_VARIATION}, variation_3_name:string>>>"""
MARKET_CDN = "https://cdn.shopier.app/pictures_large/"


def market_records(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Listing rows (brand_slug, row JSON) completed by their pages (link, html), where there is one, to records.

    A page's price, stock and pictures go before the listing's; the stock of a size choice before the product's.
    """
    r = rows.select("brand_slug", F.from_json("row", MARKET_ROW).alias("r")).withColumn("link", F.col("r.link"))
    j = r.join(pages.select("link", "html"), "link", "left")
    listed = F.when(F.col("r.primary_image") != "", F.concat(F.lit(MARKET_CDN), F.col("r.primary_image")))
    shown = F.slice(F.array_distinct(F.regexp_extract_all("html", F.lit(r"(https://cdn\.shopier\.app/pictures_large/[^\"'\s\\]+)"), 1)), 1, MAX_IMAGES)
    images = F.when(F.size(shown) > 0, shown).when(listed.isNotNull(), F.array(listed)).otherwise(no_texts())
    j = j.withColumn("images", images).filter(F.size("images") > 0)
    j = j.withColumn("p", F.from_json(P.inline_json(F.col("html"), '{"page":"product"'), MARKET_PAGE)["product"])
    choice = lambda k: F.struct(F.trim(F.coalesce(F.col(f"p.variations.variation_{k}_name"), F.lit(""))).alias("name"), F.col(f"p.variations.variation_{k}").alias("rows"), F.transform(f"p.variations.variation_{k}", lambda x: F.trim(x["name"])).alias("values"))
    choices = F.filter(F.array(choice(1), choice(2), choice(3)), lambda c: F.size(c.rows) > 0)
    j = j.withColumn("choices", choices).withColumn("sizes", pick_sizes(F.col("choices")))
    j = j.withColumn("colors", first(F.filter("choices", lambda c: c["name"].rlike(P.COLOR_NAME) & ~c["name"].eqNullSafe(F.col("sizes")["name"]))))
    live = F.filter("sizes.rows", lambda x: x.stock > 0)
    labels = F.transform(F.when(F.size(live) > 0, live).otherwise(F.col("sizes.rows")), lambda x: F.trim(x["name"]))
    counted = F.exists("sizes.rows", lambda x: x.stock.isNotNull())
    stock = F.when(counted, F.size(live) > 0).otherwise(F.coalesce(F.col("p.stock") > 0, ~F.coalesce(F.col("r.labels.out_of_stock.enabled"), F.lit(False))))
    price = F.coalesce(parse_number(F.col("p.price.price_legacy_formatted")), parse_number(F.coalesce("r.price.price_legacy_formatted", "r.price.price_formatted")))
    about = F.substring(F.regexp_replace(F.coalesce(meta(F.col("html"), "og:description"), F.lit("")), r"\s+", " "), 1, 300)
    j = j.withColumn("stock", stock).withColumn("c", F.explode_outer("colors.rows"))
    return j.select(
        "brand_slug",
        F.substring(F.trim("r.name"), 1, MAX_NAME).alias("name"),
        about.alias("source_text"),
        F.coalesce(F.trim("c.name"), F.lit("")).alias("color"),
        F.lit(None).cast("string").alias("color_code"),
        first(F.col("images")).alias("image"),
        "images",
        F.coalesce(normalize_sizes(labels), no_texts()).alias("sizes"),
        (F.col("stock") & F.coalesce(F.col("c.stock") > 0, F.lit(True))).alias("in_stock"),
        price.alias("price"),
        currency_of(F.col("r.price.price_code")).alias("currency"),
        F.col("link").alias("product_url"),
    )


OWN_API = "array<struct<name:string,slug:string,type:string,price:string,currency:string,is_active:boolean,images:array<struct<url:string,is_primary:boolean,sort_order:int>>,variants:array<struct<size:string,name:string,stock:double>>>>"


def own_api_records(bodies: DataFrame, least_share: float = 0.5, least: int = 3) -> DataFrame:
    """Landed answers (brand_slug, url, body: JSON array) of a store's own API to records.

    A store counts only if at least `least` of its rows, and least_share of them, have a name and an image.
    """
    p = bodies.select("brand_slug", "url", F.explode(F.from_json("body", OWN_API)).alias("p"))
    usable = (F.col("p.name") != "") & (F.size("p.images") > 0)
    good = p.groupBy("brand_slug").agg(F.count_if(usable).alias("ok"), F.count(F.lit(1)).alias("n")).filter(F.col("ok") >= F.greatest(F.lit(least), F.col("n") * least_share))
    p = p.filter(usable).join(good.select("brand_slug"), "brand_slug", "left_semi")
    keyed = F.transform("p.images", lambda i, k: F.struct((~F.coalesce(i.is_primary, F.lit(False))).alias("o"), F.coalesce(i.sort_order, F.lit(0)).alias("s"), k.alias("k"), i.url.alias("u")))
    p = p.withColumn("images", P.absolute_all("url", F.slice(F.array_distinct(F.transform(F.array_sort(keyed), lambda x: x.u)), 1, MAX_IMAGES)))
    live = F.filter("p.variants", lambda v: v.stock > 0)
    labels = F.transform(F.when(F.size(live) > 0, live).otherwise(F.col("p.variants")), lambda v: F.coalesce(v["size"], v["name"]))
    return p.select(
        "brand_slug",
        F.substring(F.trim("p.name"), 1, MAX_NAME).alias("name"),
        F.coalesce("p.type", F.lit("")).alias("source_text"),
        F.lit("").alias("color"),
        F.lit(None).cast("string").alias("color_code"),
        first(F.col("images")).alias("image"),
        "images",
        F.coalesce(normalize_sizes(labels), no_texts()).alias("sizes"),
        F.when(F.size("p.variants") > 0, F.size(live) > 0).otherwise(F.coalesce("p.is_active", F.lit(True))).alias("in_stock"),
        parse_number(F.col("p.price")).alias("price"),
        F.upper(F.coalesce("p.currency", F.lit("TRY"))).alias("currency"),
        F.when(F.col("p.slug") != "", F.concat("url", F.lit("/urun/"), "p.slug")).otherwise(F.col("url")).alias("product_url"),
    )


# -- choosing a reader --------------------------------------------------------------------------------------------

#: What shows a store's software in its home page, first match wins; any other is read page by page.
FINGERPRINTS = [
    ("ikas", r"myikas\.com|__IKAS|cdn\.myikas"),
    ("shopify", r"cdn\.shopify\.com|Shopify\.theme|shopify-features"),
    ("woocommerce", "wp-json|woocommerce"),
]


def platform(url: Column, html: Column, known: Column | None = None) -> Column:
    """A store's software: by its host first, then by its page; without a page what is known of it."""
    found = F.lit("jsonld")
    for name, pattern in reversed(FINGERPRINTS):
        found = F.when(html.rlike(f"(?i){pattern}"), name).otherwise(found)
    before = F.when(known != "none", known).otherwise("jsonld") if known is not None else F.lit("jsonld")
    return F.when(host(url).rlike(r"(^|\.)shopier\.com$"), "shopier").when(F.coalesce(html, F.lit("")) == "", before).otherwise(found)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^https?://(?:[^/@]*@)?([^/:?#]+)", 1))


def with_fallback(own: DataFrame, fallback: DataFrame, no_fallback: list[str] = ["shopier"], platforms: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """own records, and for brands without any those of the fallback reader; not for brands on the platforms named.

    platforms: (brand_slug, platform).
    """
    spare = fallback.join(own.select("brand_slug").distinct(), "brand_slug", "left_anti")
    if platforms is not None:
        spare = spare.join(platforms.filter(F.col("platform").isin(no_fallback)).select("brand_slug"), "brand_slug", "left_anti")
    return own.select(*RECORD).unionByName(spare.select(*RECORD))
