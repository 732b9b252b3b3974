"""The product query: filters, sort and page as one lazy plan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.functions.classify import CATEGORY_GROUPS
from vitrine.functions.text import slug_of
from vitrine.operators.search import haystack, matches, parse_search, relevance

#: Categories that the default view leaves out, price buckets, sort columns, URL names, page size.
OUT_OF_FEED = ["AYAKKABI", "SAAT", "ÇANTA", "ÇORAP", "İÇ GİYİM", "GÖZLÜK", "CÜZDAN", "KEMER", "TAKI", "AKSESUAR", "DİĞER"]
PRICES = {"0-1k": (0.0, 1000.0), "1k-2k": (1000.0, 2000.0), "2k-4k": (2000.0, 4000.0), "4k+": (4000.0, 1e12)}
SORTS = {"FİYAT": "price_min", "TARİH": "day", "MARKA": "brand"}
CATEGORIES = [c for group in CATEGORY_GROUPS.values() for c in group] + ["AYAKKABI"]
EVERYTHING = "TÜM ÜRÜNLER"
#: What a URL calls a field, today's name first; the others are read from old links.
NAMES = {
    "category": ["kategori", "cat"], "search": ["q"], "styles": ["tarz", "style"], "genders": ["kim", "gender"], "brands": ["marka", "brand"], "colors": ["renk", "color"],
    "sizes": ["beden", "size"], "price": ["fiyat", "price"], "sort": ["sirala", "sort"], "direction": ["yon", "dir"], "in_stock_only": ["stok", "tukenmis"], "page": ["sayfa", "page"],
}
DIRECTIONS = {"artan": "asc", "azalan": "desc"}
PAGE = 40


@dataclass(frozen=True)
class CatalogQuery:
    """A product query; empty fields don't filter.  Colours have to match all, other lists any."""

    category: str = ""
    search: str = ""
    styles: list[str] = field(default_factory=list)
    genders: list[str] = field(default_factory=list)
    brands: list[str] = field(default_factory=list)
    colors: list[str] = field(default_factory=list)
    sizes: list[str] = field(default_factory=list)
    price: str = "ALL"
    sort: str = ""
    direction: str = "asc"
    in_stock_only: bool = True
    page: int = 1

    @classmethod
    def parse(cls, query: str, brands: Iterable[str] = ()) -> CatalogQuery:
        """From URL parameters, in today's form (short names, slugs) or that of old links (full names, numbers).

        brands: the roster that brand slugs are looked up in.  Sizes are no slugs and stand one to a parameter, as they
        may hold commas.  A value that nothing is known about stays as it is, and a bad page is the first.
        """
        given: dict[str, list[str]] = {}
        for key, value in parse_qsl(query.removeprefix("?")):
            given.setdefault(key, []).append(value.strip())
        found = {name: (key, given[key]) for name, keys in NAMES.items() for key in reversed(keys) if key in given}
        known = {
            "category": {slug_of(c): c for c in CATEGORIES} | {slug_of(EVERYTHING): ""}, "brands": {slug_of(b): b for b in brands},
            "sort": {slug_of(s): s for s in SORTS}, "direction": DIRECTIONS, "price": dict(zip("0123", PRICES, strict=True)),
        }
        read = lambda name, v: known.get(name, {}).get(slug_of(v) if name != "price" else v, v)
        out: dict = {}
        for name, (key, values) in found.items():
            if name == "sizes":
                out[name] = values
            elif name in ("brands", "colors", "styles", "genders"):
                out[name] = [read(name, v.strip()) for v in values[0].split(",") if v.strip()]
            elif name == "in_stock_only":
                out[name] = values[0] != ("1" if key == "tukenmis" else "tumu")
            elif name == "page":
                out[name] = int(values[0]) if values[0].isdecimal() and int(values[0]) > 0 else 1
            else:
                out[name] = read(name, values[0])
        return cls(**out)

    def url(self) -> str:
        """As URL parameters in today's form; defaults are not written."""
        base, out = CatalogQuery(), []
        for name, (short, *_) in NAMES.items():
            v = getattr(self, name)
            if v == getattr(base, name):
                continue
            if name == "sizes":
                out += [(short, size) for size in v]
            elif name in ("category", "sort"):
                out.append((short, slug_of(v)))
            elif name == "brands":
                out.append((short, ",".join(map(slug_of, v))))
            elif name == "direction":
                out.append((short, "azalan"))
            elif name == "in_stock_only":
                out.append((short, "tumu"))
            else:
                out.append((short, ",".join(v) if isinstance(v, list) else v))
        return urlencode(out)


def cycle_sort(sort: str, direction: str, clicked: str) -> tuple[str, str]:
    """Ascending, then descending, then no explicit sort."""
    if sort != clicked:
        return clicked, "asc"
    return (clicked, "desc") if direction == "asc" else ("", "asc")


def filtered(products: DataFrame, q: CatalogQuery) -> DataFrame:
    df = products
    if q.category:
        df = df.filter(F.col("category") == q.category)
    elif not q.search:
        df = df.filter(~F.col("category").isin(OUT_OF_FEED))
    if q.in_stock_only:
        df = df.filter("in_stock")
    if q.brands:
        df = df.filter(F.col("brand").isin(q.brands))
    for column, wanted in (("styles", q.styles), ("sizes", q.sizes), ("genders", q.genders)):
        if wanted:
            df = df.filter(F.arrays_overlap(column, F.array(*map(F.lit, wanted))))
    if q.colors:
        df = df.filter(F.size(F.array_except(F.array(*map(F.lit, q.colors)), "color_tags")) == 0)
    if q.price in PRICES:
        low, high = PRICES[q.price]
        df = df.filter((F.col("price_min") <= high) & (F.col("price_max") >= low))
    if q.search:
        _, groups = parse_search(q.search)
        df = df.filter(matches(haystack(F.col("name"), F.col("brand"), F.col("category"), F.col("styles"), F.col("color_tags")), groups))
    return df


def ranked(df: DataFrame, q: CatalogQuery) -> DataFrame:
    """df with place: in-stock first, then relevance or the sort column with missing values last, then load order."""
    keys = [F.desc("in_stock")]
    if q.search and not q.sort:
        full, groups = parse_search(q.search)
        text = haystack(F.col("name"), F.col("brand"), F.col("category"), F.col("styles"), F.col("color_tags"))
        df = df.withColumn("relevance", relevance(F.col("name"), F.col("brand"), text, full, groups))
        keys.append(F.desc("relevance"))
    elif q.sort in SORTS:
        column = SORTS[q.sort]
        keys.append(F.asc_nulls_last(column) if q.direction == "asc" else F.desc_nulls_last(column))
    first = q.page * PAGE
    keys.append(F.asc("pos"))
    # only the rows up to the page's end are numbered
    return df.orderBy(*keys).limit(first).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)))


def run(products: DataFrame, q: CatalogQuery) -> DataFrame:
    """One page of the query's result."""
    return ranked(filtered(products, q), q).filter(F.col("place") > (q.page - 1) * PAGE)


def page_list(page: int, count: int) -> list[int | str]:
    """Page numbers to show: all up to seven, else the ends and the neighbours."""
    if count <= 7:
        return list(range(1, count + 1))
    near = sorted({1, count, *(p for p in (page - 1, page, page + 1) if 1 <= p <= count)})
    out: list[int | str] = []
    for p in near:
        if out and p - out[-1] > 1:
            out.append("…")
        out.append(p)
    return out
