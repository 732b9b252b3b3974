"""Landed sitemaps walked from a site's roots: indexes to a depth of two, a bounded number of pages, no page twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.functions.pages import url_blocks

DEPTH, CAP = 2, 3000
#: Parts of addresses that are no products, that are, and of the names of maps that list products.
EXCLUDED = (
    r"(?i)(kategori|category|koleksiyon|collection|/blog|sayfa/|hakkimizda|/about|iletisim|/contact|kampanya|/cart|sepet|\bgiris\b|\blogin\b|\bkayit\b|register|\bsss\b|\bfaq\b"
    r"|kvkk|gizlilik|mesafeli|iade|degisim|sozlesme|politika|aydinlatma|hesabim|uye-|uyelik|favori|magazalar|subeler|kariyer|cerez)"
)
INCLUDED = r"(?i)/(product|products|urun|p)/"
PRODUCT_MAP = r"(?i)product|urun|shop|magaza|katalog"
LAST = 2**31 - 1


def is_map(loc: Column) -> Column:
    return F.lower(F.regexp_replace(loc, "[?#].*$", "")).endswith(".xml")


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)), r"^www\.", "")


def flat(loc: Column, origin: Column) -> Column:
    """Whether a page is the only segment of its path, over three characters long, on the site itself."""
    path = F.regexp_extract(loc, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return (host(loc) == host(origin)) & (F.size(segments) == 1) & (F.length(F.element_at(segments, 1)) > 3)


def sitemap_pages(roots: DataFrame, landed: DataFrame, cap: int = CAP, depth: int = DEPTH) -> DataFrame:
    """(origin, place, url): the product pages that a site's first fruitful root leads to, in the order of the walk.

    roots: (origin, root: the turn of the root, loc); landed: (loc, xml), one row a map.  A map's maps come before its
    own pages.  A page counts if its address or its map says product, it has an image or stands right below the site's
    root.  Maps may name themselves or each other: a level takes each of a site's maps once, and there are depth + 1.
    """
    level = roots.select("origin", "root", "loc", F.array().cast("array<int>").alias("way"), F.lit(False).alias("of_products"))
    pages = None
    for k in range(depth + 1):
        once = F.struct("way", "of_products")
        # of one map the first way counts, and one that is named as a product map at all counts as such from its first on
        level = level.groupBy("origin", "root", "loc", "of_products").agg(F.min(once).alias("o")).select("origin", "root", "loc", "o.way", "of_products")
        blocks = level.join(landed, "loc").select("origin", "root", "way", "of_products", F.posexplode(url_blocks(F.col("xml"))).alias("at", "b"))
        own = blocks.filter(~is_map(F.col("b.loc")) & ~F.col("b.loc").rlike(EXCLUDED))
        own = own.filter(F.col("b.loc").rlike(INCLUDED) | F.col("b.image") | F.col("of_products") | F.coalesce(flat(F.col("b.loc"), F.col("origin")), F.lit(False)))
        own = own.select("origin", "root", F.concat("way", F.array(F.lit(LAST), F.col("at"))).alias("order"), F.col("b.loc").alias("url"))
        pages = own if pages is None else pages.unionByName(own)
        if k < depth:
            below = blocks.filter(is_map(F.col("b.loc")))
            level = below.select("origin", "root", F.col("b.loc").alias("loc"), F.concat("way", F.array("at")).alias("way"), F.col("b.loc").rlike(PRODUCT_MAP).alias("of_products"))
    first = pages.groupBy("origin", "root", "url").agg(F.min("order").alias("order"))
    fruitful = pages.groupBy("origin").agg(F.min("root").alias("root"))
    place = F.row_number().over(Window.partitionBy("origin").orderBy("order"))
    return first.join(fruitful, ["origin", "root"]).withColumn("place", place).filter(F.col("place") <= cap).select("origin", "place", "url")
