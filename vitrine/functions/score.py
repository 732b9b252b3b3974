"""Ranking scores of a product: plain column arithmetic, summed in one fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.sizes import graded
from vitrine.functions.text import rand01

#: Weight of a category.
CATEGORY_WEIGHT = {
    "TİŞÖRT": 1.0, "HOODIE": 1.0, "SWEATSHIRT": 1.0, "CEKET": 1.0, "MONT": 0.95, "GÖMLEK": 0.95, "ELBİSE": 0.95, "PANTOLON": 0.9, "JEAN": 0.9, "TAKIM": 0.9,
    "UZUN KOLLU": 0.88, "ETEK": 0.85, "ŞORT": 0.85, "EŞOFMAN ALTI": 0.85, "TRİKO / KAZAK": 0.85, "HIRKA": 0.82, "YELEK": 0.8, "POLO": 0.8, "FORMA": 0.8, "BLUZ": 0.8,
    "KORSE / BODY": 0.8, "ATLET / KOLSUZ": 0.78, "ÜST": 0.75, "AYAKKABI": 0.75, "ÇANTA": 0.72, "TAYT": 0.7, "ŞAPKA": 0.65, "GÖZLÜK": 0.6, "TAKI": 0.55, "KEMER": 0.55,
    "CÜZDAN": 0.55, "ATKI / ELDİVEN": 0.55, "SAAT": 0.55, "ÇORAP": 0.5, "İÇ GİYİM": 0.5, "AKSESUAR": 0.5, "DİĞER": 0.35,
}
#: Shares and weights of the seeded bonuses, noise by mode.
ROTATION, UNDERDOG_SHARE, SPOTLIGHT_SHARE = 0.16, 0.12, 0.18
NOISE = {"kesfet": 0.3, "markalar": 0.22, "kategori": 0.12}
NEUTRAL_TAGS = ["cok-renkli", "siyah", "beyaz", "gri"]


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def category_weight(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CATEGORY_WEIGHT.items() for x in pair])
    return F.coalesce(F.try_element_at(table, category), F.lit(0.7))


def steps(value: Column, *levels: tuple[int, float], default: float = 0.0) -> Column:
    """The value of the first level that is reached."""
    out = F.lit(default)
    for least, worth in sorted(levels):
        out = F.when(value >= least, worth).otherwise(out)
    return out


def product_quality(images: Column, colors: Column, price: Column, sizes: Column, in_stock: Column, name: Column, category: Column) -> Column:
    n = F.length(name)
    size_part = F.when(graded(sizes) > 0, steps(graded(sizes), (6, 0.21), (4, 0.17), (2, 0.11), (1, 0.05))).when(F.size(sizes) > 0, 0.04).otherwise(0.0)
    total = (
        steps(images, (4, 0.26), (2, 0.19), default=0.1)
        + steps(colors, (3, 0.13), (2, 0.09), default=0.04)
        + F.when(price.isNotNull(), 0.14).otherwise(0.0)
        + size_part
        + F.when(in_stock, 0.1).otherwise(0.0)
        + F.when((n >= 8) & (n <= 46), 0.12).when(n <= 70, 0.06).otherwise(0.0)
        + category_weight(category) * 0.08
    )
    return F.when(images == 0, 0.0).otherwise(F.least(F.lit(1.0), total))


def fresh_bonus(day: Column) -> Column:
    return F.when(day <= 7, 0.08).when(day <= 21, 0.03).otherwise(0.0)


def aesthetic(styles: Column, tags: Column, images: Column, n_variants: Column) -> Column:
    has = lambda *names: F.arrays_overlap(styles, F.array(*map(F.lit, names)))
    bright = F.size(F.filter(tags, lambda t: ~t.isin(NEUTRAL_TAGS)))
    total = (
        F.when(has("streetwear"), 0.3).otherwise(0.0)
        + F.when(has("ravewear"), 0.22).otherwise(0.0)
        + F.when(has("y2k"), 0.2).otherwise(0.0)
        + F.when(has("techwear"), 0.12).otherwise(0.0)
        + F.when(has("minimalist", "basic"), 0.05).otherwise(0.0)
        + F.when(F.size(tags) == 0, -0.08).when(bright >= 2, 0.2).when(bright == 1, 0.14).otherwise(0.06)
        + steps(images, (6, 0.24), (4, 0.18), (2, 0.08))
        + steps(n_variants, (4, 0.1), (2, 0.05))
    )
    return clamp(total)


def underdog_bonus(brand01: Column, beauty: Column, seed: str, pid: Column) -> Column:
    drawn = rand01(seed, F.concat(F.lit("underdog:"), pid)) <= UNDERDOG_SHARE
    return F.when(brand01.between(0.15, 0.65) & (beauty >= 0.62) & drawn, F.when(beauty >= 0.78, 0.24).otherwise(0.16)).otherwise(0.0)


def scarcity_penalty(sizes: Column) -> Column:
    return F.when(graded(sizes) == 1, 0.18).when(graded(sizes) == 2, 0.06).otherwise(0.0)


def size_bonus(sizes: Column) -> Column:
    return steps(graded(sizes), (6, 0.09), (4, 0.06), (2, 0.02))


def brand_rank(brand01: Column, slug: Column, seed: str) -> Column:
    return clamp(brand01 + (rand01(seed, F.concat(F.lit("marka:"), slug)) - 0.5) * 2 * ROTATION)


def spotlight_bonus(quality: Column, brand01: Column, seed: str, pid: Column) -> Column:
    drawn = rand01(seed, F.concat(F.lit("oneçıkan:"), pid)) <= SPOTLIGHT_SHARE
    return F.when((quality >= 0.8) & (brand01 < 0.8) & (brand01 >= 0.25) & drawn, F.when(quality >= 0.9, 0.2).otherwise(0.14)).otherwise(0.0)
