"""Logo candidates of a page, scored and in document order; whether a logo has to be inverted on a dark ground.

Candidates come from one scan of the page's tags, numbered as they stand, from the logos that its structured data name
at any depth (the VARIANT type, a level at a time), and from the address that icons have had of old.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDIDATES, FROM_DATA, DEPTH = 12, 3, 6
UNPLACED = 1_000_000_000
CANDIDATE = "array<struct<url:string,score:int,kind:string,at:int>>"
#: Words that make a picture a badge, a banner or a network's sign, whatever else it is called.
JUNK = [
    "sprite", "placeholder", "payment", "odeme", "visa", "mastercard", "maestro", "american_?express", "amex", "discover", "troy", "iyzico", "paytr", "paypal", "ideallogo",
    "instagram", "facebook", "tiktok", "twitter", "whatsapp", "telegram", "youtube", "pinterest", "sponsor", "banner", "logo[-_]?band", "slider?", "kampanya", "badge",
    "guvenli", "güvenli", "etbis", "kargo", "yurtici", "hero",
]
#: Scores of a picture by where it is called a logo, of icons, structured data and meta tags.
BY_CLASS, BY_PATH, BY_TEXT = 100, 95, 35
TOUCH_ICON, ICON, DATA, OG_LOGO, OG_IMAGE, OLD_ICON = 80, 45, 70, 75, 30, 10


def attribute(tag: Column, name: str) -> Column:
    """A tag's attribute, quoted in either way or not at all; null without one or if it is empty."""
    forms = (rf'(?i)\b{name}\s*=\s*"([^"]*)"', rf"(?i)\b{name}\s*=\s*'([^']*)'", rf"(?i)\b{name}\s*=\s*([^\s>\"'][^\s>]*)")
    found = [F.trim(F.regexp_extract(tag, f, 1)) for f in forms]
    return F.coalesce(*(F.when(x != "", x) for x in found))


def is_junk(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(f"(?i)(?:^|[^a-z])(?:{'|'.join(JUNK)})(?:[^a-z]|$)")


def first_number(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([0-9]{1,9})", 1).try_cast("int"), F.lit(0))


def widest_of(srcset: Column) -> Column:
    """The widest picture of a srcset, the first of equals; null without one."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda p: F.trim(p)), lambda p: p != "")
    told = F.transform(parts, lambda p, k: F.struct(-F.coalesce(F.regexp_extract(p, r"\s([0-9]+)w$", 1).try_cast("int"), F.lit(0)), k, F.split(p, r"\s+")[0].alias("u")))
    return F.array_min(told)["u"]


def resolved(url: Column, base: Column) -> Column:
    """An address as seen from a page; null for one that is empty, inline or a place on the page."""
    u = F.replace(F.trim(url), F.lit("&amp;"), F.lit("&"))
    origin = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(?<![:/])/[^/]*$", "")
    return (
        F.when((u == "") | u.startswith("data:") | u.startswith("#"), None)
        .when(u.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), u)
        .when(u.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), u))
        .when(u.startswith("/"), F.concat(origin, u))
        .otherwise(F.concat(folder, F.lit("/"), u))
    )


def _picture(tag: Column, slug: Column) -> Column:
    """struct<src,score> of a picture that something calls a logo; null for others and badges."""
    src = F.coalesce(widest_of(attribute(tag, "srcset")), widest_of(attribute(tag, "data-srcset")), *(attribute(tag, a) for a in ("src", "data-src", "data-original")))
    path = F.lower(F.split(src, r"\?")[0])
    width = first_number(attribute(tag, "width"))
    called = F.when(tag.rlike("(?i)(?:class|id)\\s*=\\s*[\"'][^\"']*logo"), BY_CLASS).when(F.contains(path, F.lit("logo")), BY_PATH).otherwise(BY_TEXT)
    size = F.when(width >= 48, F.least(F.lit(15), F.floor(width / 40).cast("int"))).when(width > 0, -25).otherwise(0)
    form = F.when(path.rlike(r"\.(?:svg|png)$"), 8).when(path.rlike(r"\.jpe?g$"), -20).otherwise(0)
    named = F.when(F.exists(F.filter(F.split(slug, "-"), lambda t: F.length(t) > 2), lambda t: F.contains(path, t)), 12).otherwise(0)
    good = tag.rlike("(?i)logo") & src.isNotNull() & ~is_junk(path) & ~is_junk(attribute(tag, "alt"))
    return F.when(good, F.struct(src.alias("src"), (called + size + form + named).alias("score"), F.lit("img").alias("kind")))


def _icon(tag: Column) -> Column:
    rel, href = F.lower(F.coalesce(attribute(tag, "rel"), F.lit(""))), attribute(tag, "href")
    bonus = F.least(F.lit(20), F.round(first_number(F.split(attribute(tag, "sizes"), "x")[0]) / 16).cast("int"))
    score = F.when(F.contains(rel, F.lit("apple-touch-icon")), F.lit(TOUCH_ICON) + bonus).when(rel.rlike(r"\bicon\b|shortcut icon|mask-icon"), F.lit(ICON) + bonus)
    return F.when(href.isNotNull() & ~is_junk(href) & score.isNotNull(), F.struct(href.alias("src"), score.alias("score"), F.lit("icon").alias("kind")))


def _meta(tag: Column) -> Column:
    what, content = F.lower(F.coalesce(attribute(tag, "property"), attribute(tag, "name"))), attribute(tag, "content")
    score = F.when(what == "og:logo", OG_LOGO).when(what.isin("og:image", "twitter:image"), OG_IMAGE)
    return F.when(content.isNotNull() & score.isNotNull(), F.struct(content.alias("src"), score.alias("score"), F.lit("og").alias("kind")))


def data_logos(html: Column) -> Column:
    """The first FROM_DATA logos that a page's structured data name: of objects nearer to the top first, then by their names."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    level = F.filter(F.transform(raw, lambda b: F.try_parse_json(F.trim(b))), lambda v: v.isNotNull())
    text = lambda v, path: F.try_variant_get(v, path, "string")
    found = []
    for _ in range(DEPTH):
        # what an object calls its logo, else its picture: an address, an object that has one, or a list of them
        said = lambda v, k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", text(v, f"$.{k}"))
        logo = lambda v: F.coalesce(said(v, "logo"), text(v, "$.logo.url"), text(v, "$.logo[0]"), said(v, "image"), text(v, "$.image.url"), text(v, "$.image[0]"))
        found.append(F.filter(F.transform(level, logo), lambda u: u.isNotNull()))
        below = lambda v: F.coalesce(
            F.try_variant_get(v, "$", "array<variant>"),
            F.map_values(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin("logo", "image"))),
        )
        level = F.filter(F.flatten(F.filter(F.transform(level, below), lambda a: a.isNotNull())), lambda v: v.isNotNull())
    return F.slice(F.flatten(F.array(*found)), 1, FROM_DATA)


def logo_candidates(html: Column, base: Column, slug: Column) -> Column:
    """array<struct<url,score,kind,at>>: at most CANDIDATES, best first, equals in the order of the page, each address once."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:img|link|meta)\b[^>]*>"), F.lit(0))
    kind = lambda t: F.lower(F.substring(t, 2, 3))
    judge = lambda t: F.when(kind(t) == "img", _picture(t, slug)).when(kind(t) == "lin", _icon(t)).otherwise(_meta(t))
    placed = F.filter(F.transform(tags, lambda t, k: F.struct(judge(t).alias("c"), k.alias("at"))), lambda x: x.c.isNotNull())
    # of one address the first counts by source (pictures, icons, data, meta tags, the old place), then by place
    source = lambda k: F.when(k == "img", 0).when(k == "icon", 1).otherwise(3)
    one = lambda u, score, kind, at, turn, order: F.struct(
        resolved(u, base).alias("url"), score.cast("int").alias("score"), kind.alias("kind"), at.cast("int").alias("at"), turn.cast("int").alias("turn"), order.cast("int").alias("order")
    )
    scanned = F.transform(placed, lambda x: one(x.c.src, x.c.score, x.c.kind, F.when(x.c.kind == "og", UNPLACED).otherwise(x["at"]), source(x.c.kind), x["at"]))
    data = F.transform(data_logos(html), lambda u, k: one(u, F.lit(DATA), F.lit("jsonld"), F.lit(UNPLACED), F.lit(2), k))
    old = F.array(one(F.lit("/favicon.ico"), F.lit(OLD_ICON), F.lit("icon"), F.lit(UNPLACED), F.lit(4), F.lit(0)))
    every = F.filter(F.concat(scanned, data, old), lambda x: x.url.isNotNull())
    before = lambda x, y: (y.url == x.url) & ((y.turn < x.turn) | ((y.turn == x.turn) & (y.order < x.order)))
    once = F.filter(every, lambda x: ~F.exists(every, lambda y: before(x, y)))
    ranked = F.array_sort(F.transform(once, lambda x: F.struct((-x.score).alias("k"), x["at"].alias("at"), x.turn.alias("turn"), x.order.alias("order"), x.url.alias("url"), x.kind.alias("kind"))))
    best = F.slice(ranked, 1, CANDIDATES)
    return F.transform(best, lambda x: F.struct(x.url.alias("url"), (-x.k).cast("int").alias("score"), x.kind.alias("kind"), x["at"].alias("at")))


#: Weights of brightness; from where a pixel is seen; colour that counts, its share, and how bright a coloured
#: logo may stay; fill of a boxed logo, size of its corners, its middle tone; tone below which a mark is dark.
LUMA, SEEN = np.array([0.2126, 0.7152, 0.0722]), 128
COLORED, COLORED_SHARE, COLORED_BRIGHT = 0.2, 0.12, 0.4
BOXED, CORNER, MIDDLE, DARK = 0.85, 0.08, 0.5, 0.45


def inverts(raster: bytes | None, width: int | None) -> bool | None:
    """Whether a raster of red, green, blue and alpha has to be inverted on a dark ground; null for what is no raster."""
    if not raster or not width or len(raster) % (4 * width):
        return None
    px = np.frombuffer(raster, np.uint8).reshape(-1, width, 4)
    light = px[..., :3] @ LUMA / 255
    seen = px[..., 3] >= SEEN
    if not seen.any():
        return False
    spread = (px[..., :3].max(2).astype(int) - px[..., :3].min(2)) / 255
    tone = light[seen].mean()
    if (spread[seen] > COLORED).mean() > COLORED_SHARE and tone >= COLORED_BRIGHT:
        return False
    if seen.mean() > BOXED:
        p = max(2, int(min(px.shape[:2]) * CORNER + 0.5))
        corners = np.concatenate([light[y, x][px[y, x, 3] > SEEN] for y in (slice(0, p), slice(-p, None)) for x in (slice(0, p), slice(-p, None))])
        if len(corners):
            return bool(np.sort(corners)[len(corners) >> 1] > MIDDLE)
    return bool(tone < DARK)


@F.pandas_udf(T.BooleanType())
def decide_invert(raster: pd.Series, width: pd.Series) -> pd.Series:
    """inverts() of each raster; a batch at a time, and nothing of a raster but one bit comes back."""
    return pd.Series([inverts(r, None if pd.isna(w) else int(w)) for r, w in zip(raster, width, strict=True)], dtype="boolean")
