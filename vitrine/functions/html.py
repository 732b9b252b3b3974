"""Product data from landed HTML: structured blocks, meta tags, offers, perks, sitemap entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.rules import DANGLING
from vitrine.functions.text import parse_number

OFFER = "struct<price:string,lowPrice:string,availability:string,priceCurrency:string>"
NODE = f"struct<`@type`:string,name:string,image:array<string>,offers:array<{OFFER}>,price:string>"


#: Perk patterns in order of preference, by kind.
PERKS = [
    ("kargo", r"[0-9][0-9.,]*\s*(?:tl|₺)[^\s|]*(?:\s+[^\s|.!?•]+){0,4}\s+(?:ücretsiz|bedava)\s*kargo"),
    ("kargo", r"(?:ücretsiz|bedava)\s*kargo(?:\s+[^\s|.!?•]+){0,3}\s+[0-9][0-9.,]*\s*(?:tl|₺)(?:\s+[^\s|.!?•]+){0,2}"),
    ("kargo", r"(?:ücretsiz|bedava)\s*kargo"),
    ("kargo", r"kargo\s*(?:bedava|ücretsiz)"),
    ("hizli", r"(?:aynı gün|1 gün(?:de)?|24 saat(?:te)?|ertesi gün)\s*(?:içinde\s*)?kargo(?:ya verilir)?"),
    ("taksit", r"[0-9]{1,2}\s*taksit(?:\s+[^\s|.!?•]+){0,3}"),
    ("taksit", r"taksit(?:li)?\s*(?:seçenek|imkan|avantaj)[^\s|.!?•]*(?:\s+[^\s|.!?•]+){0,2}"),
    ("kapida", r"kapıda ödeme(?:\s+[^\s|.!?•]+){0,2}"),
    ("iade", r"[0-9]{1,2}\s*(?:iş\s*)?gün(?:ü)?(?:\s+[^\s|.!?•]+){0,3}\s+(?:iade|değişim)(?:\s+[^\s|.!?•]+){0,3}"),
    ("iade", r"(?:koşulsuz|ücretsiz|kolay)\s*iade(?:\s+[^\s|.!?•]+){0,3}"),
    ("indirim", r"(?:ilk|yeni)\s*(?:üyelik|üye|üyelere|alışveriş|sipariş)(?:\s+[^\s|.!?•]+){0,6}\s+(?:indirim|kupon)(?:\s+[^\s|.!?•]+){0,2}"),
    ("indirim", r"%\s?[0-9]{1,2}\s*indirim\s*kupon(?:\s+[^\s|.!?•]+){0,3}"),
]


#: Dotless and dotted i match themselves only; two letters without case stand for them while matching.
APART, STAND_IN = "ıİ", "\ua840\ua841"
_STAND_IN = str.maketrans(APART, STAND_IN)


MOST_PERK, MOST_DANGLING = 90, 3


def tidy(c: Column) -> Column:
    """What is shown of a perk: from its first letter, digit, ₺ or % on, one space between words, at most MOST_PERK
    characters, without marks at its end, and without the last words that lead nowhere (up to MOST_DANGLING of them)."""
    shown = F.regexp_extract(F.regexp_replace(c, r"\s+", " "), r"([\p{L}\p{N}₺%].*?)[|•·,]*$", 1)
    shown = F.substring(F.trim(shown), 1, MOST_PERK)
    loose = "|".join(DANGLING).translate(_STAND_IN)
    return F.trim(F.regexp_replace(shown, rf"(?iu)(?:\s+(?:{loose})){{1,{MOST_DANGLING}}}$", ""))


def entities(c: Column) -> Column:
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def ld_blocks(html: Column) -> Column:
    """The nodes of all structured-data blocks: single nodes, arrays and graphs; broken ones are left out."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), 1)

    def nodes(b: Column) -> Column:
        b = F.trim(b)
        graph = F.from_json(b, f"struct<`@graph`:array<{NODE}>>")["@graph"]
        many = F.from_json(b, f"array<{NODE}>")
        return F.when(F.startswith(b, F.lit("[")), many).when(graph.isNotNull(), graph).otherwise(F.array(F.from_json(b, NODE)))

    return F.filter(F.flatten(F.transform(raw, nodes)), lambda n: n.isNotNull())


def product_node(html: Column) -> Column:
    return F.try_element_at(F.filter(ld_blocks(html), lambda n: n["@type"] == "Product"), F.lit(1))


def meta(html: Column, name: str) -> Column:
    found = F.regexp_extract(html, rf"(?i)<meta[^>]+(?:property|name)=[\"']{name}[\"'][^>]+content=[\"']([^\"']+)[\"']", 1)
    return F.when(found != "", entities(found))


def offer_price(offers: Column, node_price: Column) -> Column:
    """The least positive price in stock, else of all offers, else the node's own."""
    price = lambda o: parse_number(F.coalesce(o.price, o.lowPrice))
    least = lambda rows: F.array_min(F.filter(F.transform(rows, price), lambda p: p.isNotNull() & (p > 0)))
    live = F.filter(offers, lambda o: F.lower(o.availability).rlike("instock|in_stock|limitedavailability|preorder"))
    return F.coalesce(least(live), least(offers), parse_number(node_price))


def page_record(html: Column) -> Column:
    """struct<name,price,currency,image,in_stock> of a page with a product node; null without one."""
    node = product_node(html)
    image = F.coalesce(F.try_element_at(node["image"], F.lit(1)), meta(html, "og:image"))
    stock = F.exists(node["offers"], lambda o: F.lower(o.availability).rlike("instock|in_stock|limitedavailability|preorder"))
    currency = F.upper(F.try_element_at(node["offers"], F.lit(1))["priceCurrency"])
    return F.when(
        node.isNotNull(),
        F.struct(node["name"].alias("name"), offer_price(node["offers"], node["price"]).alias("price"), currency.alias("currency"), image.alias("image"), F.coalesce(stock, F.lit(False)).alias("in_stock")),
    )


def perks(text: Column) -> Column:
    """array<struct<kind,text>>: for each kind the first pattern that is found, at least 8 characters and no code."""
    text, found = F.translate(text, APART, STAND_IN), []
    for kind in dict.fromkeys(k for k, _ in PERKS):
        hits = []
        for k, pattern in PERKS:
            if k == kind:
                t = tidy(F.regexp_extract(text, f"(?iu){pattern.translate(_STAND_IN)}", 0))
                hits.append(F.when((F.length(t) >= 8) & ~t.rlike(r'[{}<>\\]|":'), t))
        best = F.coalesce(*hits)
        found.append(F.when(best.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.translate(best, STAND_IN, APART).alias("text"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def sitemap_entries(xml: Column) -> Column:
    """array<struct<loc,image>> of a sitemap's url blocks."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<url>(.*?)</url>"), 1)
    loc = lambda b: F.trim(F.regexp_extract(b, r"(?i)<loc>(?:<!\[CDATA\[)?([^<\]]+)", 1))
    return F.filter(F.transform(blocks, lambda b: F.struct(loc(b).alias("loc"), b.rlike("(?i)<image:image>").alias("image"))), lambda x: x.loc != "")


def widest(srcset: Column) -> Column:
    """The widest candidate of a srcset attribute."""
    parts = F.transform(F.split(srcset, ","), lambda p: F.trim(p))
    keyed = F.transform(parts, lambda p: F.struct(F.coalesce(F.regexp_extract(p, r"\s([0-9]+)w$", 1).try_cast("int"), F.lit(0)).alias("w"), F.split(p, r"\s+")[0].alias("u")))
    return F.array_max(keyed).u


def image_type(b: Column) -> Column:
    """The type of image bytes by their first twelve."""
    h = F.hex(F.substring(b, 1, 12))
    brand = F.substring(h, 17, 8)
    return (
        F.when(F.length(h) < 24, None)
        .when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("89504E470D0A1A0A"), "image/png")
        .when(h.startswith("474946383961") | h.startswith("474946383761"), "image/gif")
        .when(h.startswith("52494646") & (brand == "57454250"), "image/webp")
        .when((F.substring(h, 9, 8) == "66747970") & brand.isin("61766966", "61766973"), "image/avif")
        .when((F.substring(h, 9, 8) == "66747970") & brand.isin("68656963", "68656978", "6D696631"), "image/heic")
    )


def snap_width(width: Column, steps: list[int]) -> Column:
    """The smallest step that holds the width, the largest if none does, 0 for no width."""
    enough = F.array_min(F.filter(F.array(*map(F.lit, steps)), lambda s: s >= width))
    return F.when(width > 0, F.coalesce(enough, F.lit(steps[-1]))).otherwise(0)
