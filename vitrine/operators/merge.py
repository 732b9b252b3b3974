"""Variants, colours and cards of merged products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.color import hex_to_tag, name_to_tags
from vitrine.functions.sizes import let
from vitrine.functions.text import tr_lower

MAX_TAGS = 3
#: The shades of colour names, by hex.
SHADES: dict[str, list[str]] = {
    "#111111": ["siyah", "black", "black/black"],
    "#ededea": ["beyaz", "white"],
    "#e8e2cf": ["ekru", "krem", "cream"],
    "#7d7d75": ["gri", "gray", "grey"],
    "#9a9a92": ["melanj"],
    "#3a3a3d": ["antrasit"],
    "#20263a": ["lacivert", "navy"],
    "#2f4a6a": ["mavi", "blue"],
    "#3a463a": ["yeşil", "yesil", "green"],
    "#4b4d38": ["haki", "khaki"],
    "#7a2727": ["kırmızı", "kirmizi", "red"],
    "#4a1f24": ["bordo", "burgundy", "şarap", "sarap"],
    "#4a3527": ["kahverengi", "brown", "kahve"],
    "#8a5a3a": ["taba"],
    "#a9825a": ["camel"],
    "#c9bda0": ["bej", "beige"],
    "#d8c24a": ["sarı", "sari", "yellow"],
    "#b5652f": ["turuncu", "orange"],
    "#4a2f5a": ["mor", "purple"],
    "#b56a86": ["pembe", "pink"],
    "#8a6aa8": ["lila", "lilac"],
    "#2f8a8a": ["turkuaz"],
    "#22484a": ["petrol"],
    "#9a8a7a": ["vizon"],
    "#8a8a90": ["metalik", "renkli", "çok"],
    "#4a2440": ["mürdüm", "murdum"],
    "#2c3a2e": ["nefti"],
    "#d4e0e4": ["buz"],
    "#8f9296": ["duman"],
    "#b02a6a": ["fuşya", "fusya"],
    "#c39b2e": ["hardal"],
    "#9fd4bb": ["mint", "nane"],
    "#d98a76": ["somon", "salmon"],
    "#adadb2": ["gümüş", "gumus", "silver"],
    "#c9a227": ["altın", "altin", "gold"],
    "#a1552d": ["bakır", "bakir"],
    "#5a5a5a": ["füme", "fume"],
    "#2b3a67": ["indigo"],
    "#2c5aa0": ["saks"],
    "#5c1f2b": ["vişne", "visne"],
    "#9c4a2f": ["kiremit"],
    "#e0705f": ["mercan"],
    "#b9a3d4": ["leylak"],
    "#a9c9e4": ["bebe"],
    "#6e7377": ["çelik", "celik"],
    "#b8ae9c": ["taş", "tas", "stone"],
    "#5a5c33": ["zeytin", "olive"],
    "#8c6239": ["bronz"],
    "#d8a13a": ["safran"],
    "#e6dfd2": ["antikbeyaz", "offwhite", "off white"],
    "#c6f542": ["neon"],
    "#dcd6e8": ["pastel"],
}
NO_COLOR = "#7d7d75"


def unknown_shade(name: Column) -> Column:
    """A grey between 70 and 159 that depends on the name alone."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0), lambda h, c: (h * 31 + F.ascii(c)) % 256)
    level = F.lpad(F.lower(F.hex(70 + h % 90)), 2, "0")
    return F.concat(F.lit("#"), level, level, level)


def color_to_hex(name: Column) -> Column:
    """The shade of a colour name: as a whole, else of its first known part, else of its first known word, else a grey."""
    shades = F.create_map(*[F.lit(x) for shade, names in SHADES.items() for n in names for x in (n, shade)])
    known = lambda words: F.try_element_at(F.filter(F.transform(words, lambda w: F.try_element_at(shades, F.trim(w))), lambda s: s.isNotNull()), F.lit(1))
    grey = lambda key: unknown_shade(F.when(key == "", "default").otherwise(key))
    return let(F.trim(tr_lower(F.coalesce(name, F.lit("")))), lambda key: F.coalesce(F.try_element_at(shades, key), known(F.split(key, r"[/\-,|]")), known(F.split(key, r"\s+")), grey(key)))


def colors_to_hex(names: Column, most: int = 3) -> Column:
    shades = F.slice(F.array_distinct(F.transform(names, color_to_hex)), 1, most)
    return F.when(F.size(shades) > 0, shades).otherwise(F.array(F.lit(NO_COLOR)))


def variant_key(color: Column, hex_: Column) -> Column:
    """A variant's key in its product: its colour's name and family, or its shade where it has no name."""
    name = F.trim(tr_lower(F.coalesce(color, F.lit(""))))
    return F.when(name == "", F.concat(F.lit("#"), hex_)).otherwise(F.concat(name, F.lit("|"), F.coalesce(hex_to_tag(hex_), hex_)))


def better_hex(have: Column, new: Column, name: Column) -> Column:
    """The shade that agrees with the colour's name, the one at hand if both or neither do."""
    agrees = lambda families, h: F.coalesce(F.array_contains(families, hex_to_tag(h)), F.lit(False))
    return let(name_to_tags(name), lambda f: F.when((F.size(f) > 0) & ~agrees(f, have) & agrees(f, new), new).otherwise(have))


def swatch(measured: Column, own: Column, name: Column, suspect: Column) -> Column:
    """The shade to show: the first of the measured, the store's and the name's that the name's families allow.

    A name that tells nothing, or that stands at several variants (suspect), has no say.
    """
    filled = lambda c: F.when(c != "", c)
    plain = F.coalesce(filled(measured), own, F.lit(""))

    def shown(families: Column) -> Column:
        choices = F.array(filled(measured), filled(own), color_to_hex(name))
        agreeing = F.filter(choices, lambda h: h.isNotNull() & F.coalesce(F.array_contains(families, hex_to_tag(h)), F.lit(False)))
        return F.when(F.size(families) == 0, plain).otherwise(F.coalesce(F.try_element_at(agreeing, F.lit(1)), filled(own), measured, F.lit("")))

    return F.when(suspect, plain).otherwise(let(name_to_tags(name), shown))


def tags_from_names(names: Column) -> Column:
    """The families of all colour names, null unless at least half of the names tell one."""
    names = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    each = F.transform(names, name_to_tags)
    told = F.size(F.filter(each, lambda t: F.size(t) > 0))
    return F.when((told > 0) & (told * 2 >= F.size(names)), F.slice(F.array_distinct(F.flatten(each)), 1, MAX_TAGS + 1))


def picked_images(images: Column, places: Column) -> Column:
    """The images at these places (from 0), those that there are."""
    return F.filter(F.transform(places, lambda i: F.get(images, i)), lambda u: u.isNotNull())


def card_image(images: Column, image: Column, variants: Column) -> Column:
    """The first image of the first variant (variants: array of structs with imgs), else the product's, else any."""
    at = F.coalesce(F.get(F.get(variants, F.lit(0))["imgs"], F.lit(0)), F.lit(0))
    return F.coalesce(F.get(images, at), image, F.get(images, F.lit(0)))


def display_price(prices: Column, pick: Column, fallback: Column) -> Column:
    """The price of the variant shown, else the first that is known, else the fallback."""
    return F.coalesce(F.get(prices, pick), F.try_element_at(F.filter(prices, lambda p: p.isNotNull()), F.lit(1)), fallback)


def with_color_tags(products: DataFrame, tags: DataFrame) -> DataFrame:
    """products (id) with color_tags from (id, tags), empty where there are none."""
    return products.join(tags.select("id", F.col("tags").alias("_tags")), "id", "left").withColumn("color_tags", F.coalesce("_tags", F.array().cast("array<string>"))).drop("_tags")


def without_absorbed(entries: DataFrame, links: DataFrame) -> DataFrame:
    """entries (pos) without those that are children of links (child_pos, base_pos)."""
    return entries.join(links.select(F.col("child_pos").alias("pos")), "pos", "left_anti")


def absorb(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (pos, ..) with owner and color_label: children's groups go to their base, under the words they add."""
    moved = groups.join(links.select(F.col("child_pos").alias("pos"), "base_pos", "label"), "pos", "left")
    return moved.withColumn("owner", F.coalesce("base_pos", "pos")).withColumn("color_label", F.col("label")).drop("base_pos", "label")
