"""Landed product pages: structured data, inline models, sizes and images, as columns.

JSON of unknown shape is read in Arrow batches and comes out as typed structs; what follows is DataFrame work.
"""

from __future__ import annotations

import html as entities
import json
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.sizes import known_sizes, looks_like_sizes, normalize_sizes, size_kind
from vitrine.functions.text import parse_number

TEXTS = T.ArrayType(T.StringType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


OFFER = struct(price=T.StringType(), availability=T.StringType(), currency=T.StringType(), size=T.StringType())
NODE = struct(name=T.StringType(), images=TEXTS, offers=T.ArrayType(OFFER), price=T.StringType(), color=T.StringType(), category=T.StringType(), keywords=TEXTS, sizes=TEXTS)
CHOICES = T.ArrayType(struct(named=T.BooleanType(), labels=TEXTS))
#: Names of a size choice, in any language met.
SIZE_NAME = r"(?iu)beden|boyut|ölçü|olcu|size|numara|(?<![a-z0-9_])(?:us|eu|uk)(?![a-z0-9_])"
COLOR_NAME = r"(?i)renk|color|colour"
IMAGE_END = r"(?i)\.(jpe?g|png|webp|gif|avif|heic|heif|bmp|tiff?)$"
IN_STOCK = "instock|in_stock|limitedavailability|preorder"
LD_BLOCK = re.compile(r"<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.I | re.S)
DEPTH = 4


def many(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def text_of(value) -> str | None:
    return None if value is None or isinstance(value, (dict, list)) else str(value)


def any_case(obj, *names):
    """The first of the keys that the object has, in whatever case."""
    lowered = {k.lower(): v for k, v in reversed(obj.items())} if isinstance(obj, dict) else {}
    return next((obj.get(n, lowered[n.lower()]) for n in names if n.lower() in lowered), None)


def find_product(html: str | None) -> dict | None:
    """The first product of the page's structured data, nearest to the top; blocks that don't parse are left out."""
    level: list = []
    for block in LD_BLOCK.findall(html or ""):
        try:
            data = json.loads(block.strip())
        except ValueError:
            continue
        level += data if isinstance(data, list) else data["@graph"] if isinstance(data, dict) and isinstance(data.get("@graph"), list) else [data]
    for _ in range(DEPTH + 1):
        level = [x for x in level if isinstance(x, dict)]
        for node in level:
            if "Product" in many(node.get("@type")):
                return node
        level = [y for x in level for v in x.values() for y in many(v)]
    return None


def plain_node(node: dict) -> dict:
    """A product node in one shape, whatever forms its fields took."""
    images = [i if isinstance(i, str) else any_case(i, "url") for i in many(node.get("image"))]
    offers = [o for o in many(any_case(node, "offers")) if isinstance(o, dict)]
    extra = [p.get("value") for p in many(node.get("additionalProperty")) if isinstance(p, dict) and re.search(SIZE_NAME, str(p.get("name") or ""))]
    variants = [v.get("size") for v in many(node.get("hasVariant")) if isinstance(v, dict)]
    sizes = [text_of(s) for s in [node.get("size"), *variants, *(o.get("size") for o in offers), *extra]]
    return {
        "name": text_of(node.get("name")),
        "images": [i for i in images if isinstance(i, str) and i],
        "offers": [
            {"price": text_of(any_case(o, "price", "lowPrice")), "availability": text_of(any_case(o, "availability")), "currency": text_of(any_case(o, "priceCurrency")), "size": text_of(o.get("size"))}
            for o in offers
        ],
        "price": text_of(any_case(node, "price")),
        "color": text_of(node.get("color")),
        "category": text_of(node.get("category")),
        "keywords": [str(k) for k in many(node.get("keywords")) if k],
        "sizes": [s.strip() for s in sizes if s],
    }


@F.pandas_udf(NODE)
def product_node(html: pd.Series) -> pd.DataFrame:
    """The page's product; a struct of nulls without one."""
    found = [find_product(h) for h in html]
    rows = [plain_node(n) if n is not None else dict.fromkeys(("name", "images", "offers", "price", "color", "category", "keywords", "sizes")) for n in found]
    return pd.DataFrame(rows, columns=["name", "images", "offers", "price", "color", "category", "keywords", "sizes"])


def json_at(html: str | None, anchor: str) -> str | None:
    """The JSON object that begins at or after the anchor, or null if there is none or it is broken."""
    at = (html or "").find(anchor)
    start = (html or "").find("{", at) if at >= 0 else -1
    if start < 0:
        return None
    try:
        return json.dumps(json.JSONDecoder().raw_decode(html, start)[0], ensure_ascii=False)
    except ValueError:
        return None


def inline_json(html: Column, anchor: str) -> Column:
    """JSON text of the object that a page's script holds at the anchor."""

    @F.pandas_udf(T.StringType())
    def found(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: json_at(h, anchor))

    return found(html)


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, url: pd.Series) -> pd.Series:
    """url as seen from base; what is no address stays as it is."""

    def one(b, u):
        try:
            return urljoin(b or "", u) if u is not None else None
        except ValueError:
            return u

    return pd.Series([one(b, u) for b, u in zip(base, url, strict=True)])


@F.pandas_udf(TEXTS)
def absolute_all(base: pd.Series, urls: pd.Series) -> pd.Series:
    """absolute() of every element."""
    return pd.Series([None if us is None else [urljoin(b or "", u) for u in us] for b, us in zip(base, urls, strict=True)])


@F.pandas_udf(T.StringType())
def decoded(text: pd.Series) -> pd.Series:
    """Character references resolved."""
    return text.map(lambda t: None if t is None else entities.unescape(t))


def image_candidate(url: Column) -> Column:
    """Whether a string can be an image's address: it ends like one, or at least has no white space inside."""
    url = F.trim(url)
    return F.coalesce((url != "") & (F.regexp_replace(url, "[?#].*$", "").rlike(IMAGE_END) | ~url.rlike(r"\s")), F.lit(False))


def og_images(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)<meta[^>]+(?:property|name)=[\"']og:image(?::secure_url)?[\"'][^>]+content=[\"']([^\"']+)[\"']"), 1)


def url_blocks(xml: Column) -> Column:
    """array<struct<loc,image>> of a sitemap; without url blocks, its bare locations."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<url>(.*?)</url>"), 1)
    loc = r"(?i)<loc>(?:<!\[CDATA\[)?([^<\]]+)"
    full = F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_extract(b, loc, 1)).alias("loc"), b.rlike("(?i)<image:image>").alias("image")))
    full = F.filter(full, lambda x: x.loc != "")
    bare = F.transform(F.regexp_extract_all(xml, F.lit(loc), 1), lambda x: F.struct(F.trim(x).alias("loc"), F.lit(False).alias("image")))
    return F.when(F.size(full) > 0, full).otherwise(bare)


CHIP = r"(?i)<(?:button|label|li|span|a|div)\b[^>]*>\s*([A-Za-z]{1,5})\s*</(?:button|label|li|span|a|div)>"


def chip_sizes(html: Column) -> Column:
    """Ladder sizes that stand alone in a button, label or the like."""
    return F.filter(known_sizes(F.array_distinct(F.regexp_extract_all(html, F.lit(CHIP), 1))), lambda t: size_kind(t) == "alpha")


SELECT = re.compile(r"<select\b([^>]*)>(.*?)</select>", re.I | re.S)
OPTION = re.compile(r"<option\b[^>]*>(.*?)</option>", re.I | re.S)
EMBEDDED_HEAD = re.compile(r"\\?\"(?:selections|values|choices|options|sizes)\\?\"\s*:\s*\[", re.I)
EMBEDDED_FIELD = re.compile(r"\\?\"(?:value|name|description|title|label)\\?\"\s*:\s*\\?\"([^\"\\]{1,24})\\?\"", re.I)


@F.pandas_udf(CHOICES)
def option_lists(html: pd.Series) -> pd.Series:
    """The choices of a page, from its selects and from lists in its scripts, and whether each is named as one of sizes."""

    def one(h):
        h, out = h or "", []
        for m in SELECT.finditer(h):
            labels = [entities.unescape(re.sub(r"<[^>]+>", "", o).strip()) for o in OPTION.findall(m[2])]
            out.append((m[1], labels))
        for m in EMBEDDED_HEAD.finditer(h):
            labels = dict.fromkeys(entities.unescape(x).strip() for x in EMBEDDED_FIELD.findall(h, m.start(), m.start() + 4000))
            out.append((h[max(0, m.start() - 120) : m.start()], [x for x in labels if x][:40]))
        return [{"named": bool(re.search(SIZE_NAME, name)), "labels": [x for x in labels if x]} for name, labels in out]

    return html.map(one)


def page_sizes(node_sizes: Column, html: Column) -> Column:
    """All sizes that a page shows, in canonical form, at most 20: those of its product, of its choices and of its chips."""
    lists = F.filter(option_lists(html), lambda x: x.named | looks_like_sizes(x.labels))
    chosen = known_sizes(F.flatten(F.transform(lists, lambda x: x.labels)))
    own = F.coalesce(node_sizes, F.array().cast("array<string>"))
    return F.slice(normalize_sizes(F.concat(own, chosen, chip_sizes(html))), 1, 20)


def best_offer(offers: Column, own: Column) -> Column:
    """The least positive price of the offers in stock, else of all, else the node's own."""
    least = lambda rows: F.array_min(F.filter(F.transform(rows, lambda o: parse_number(o.price)), lambda p: p > 0))
    live = F.filter(offers, lambda o: F.lower(F.coalesce(o.availability, F.lit(""))).rlike(IN_STOCK))
    return F.coalesce(least(live), least(offers), parse_number(own))


SIZE_HINT = r"(?i)beden|size|numara|\bus\b|\beu\b|\buk\b"
SIZE_WORD = r"(?i)<(?:button|label|li|span|a|div)\b[^>]*>\s*(?:xxs|xs|s|m|l|xl|xxl|xxxl|2xl|3xl|4xl)\s*</(?:button|label|li|span|a|div)>"


def data_nodes(html: Column) -> Column:
    """array<variant>: the top nodes of a page's structured data, of lists and graphs too; blocks that don't parse are left out."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    parsed = F.filter(F.transform(raw, lambda b: F.try_parse_json(F.trim(b))), lambda v: v.isNotNull())
    one = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v))
    return F.flatten(F.transform(parsed, one))


def probe_page(html: Column) -> Column:
    """struct of what can be read from a product page as it stands: its data node, price, currency, colour, sizes, picture and shop system."""
    text = lambda v, path: F.try_variant_get(v, path, "string")
    some = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda v: (text(v, "$['@type']") == "Product") | F.coalesce(F.array_contains(F.try_variant_get(v, "$['@type']", "array<string>"), "Product"), F.lit(False))
    node = F.try_element_at(F.filter(data_nodes(html), lambda v: F.coalesce(kind(v), F.lit(False))), F.lit(1))
    meta = lambda name: F.nullif(F.regexp_extract(html, rf"(?i)<meta[^>]+(?:property|name)=[\"']{name}[\"'][^>]+content=[\"']([^\"']+)[\"']", 1), F.lit(""))
    of_offer = lambda name: F.coalesce(text(node, f"$.offers[0].{name}"), text(node, f"$.offers.{name}"))
    called = lambda pattern: F.exists(some(node, "$.additionalProperty"), lambda v: F.coalesce(text(v, "$.name"), F.lit("")).rlike(pattern))
    has = lambda c: F.coalesce(c, F.lit(False))
    sized = text(node, "$.size").isNotNull() | F.exists(some(node, "$.hasVariant"), lambda v: text(v, "$.size").isNotNull()) | called(SIZE_HINT)
    return F.struct(
        node.isNotNull().alias("jsonld"),
        F.lower(meta("og:type")).alias("og_type"),
        F.coalesce(of_offer("price"), of_offer("lowPrice"), text(node, "$.price"), meta("product:price:amount")).alias("price"),
        F.coalesce(of_offer("priceCurrency"), meta("product:price:currency")).alias("currency"),
        has(text(node, "$.color").isNotNull() | called("(?i)renk|color")).alias("color"),
        has(sized).alias("size_in_data"),
        F.exists(F.regexp_extract_all(html, F.lit(r"(?i)<select\b([^>]*)>"), F.lit(1)), lambda a: a.rlike(SIZE_HINT)).alias("size_select"),
        html.rlike(SIZE_WORD).alias("size_button"),
        (meta("og:image").isNotNull() | has(F.try_variant_get(node, "$.image", "variant").isNotNull())).alias("image"),
        html.rlike("productDetailModel").alias("model"),
        html.rlike(r"__IKAS|window\.__NEXT_DATA__").alias("state"),
    )
