"""Text, hash and number functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turkish letters and their plain forms.
TURKISH, PLAIN = "çÇğĞıİöÖşŞüÜâîû", "cCgGiIoOsSuUaiu"
#: Other accented letters that folding reduces to their base.
ACCENTED = "àáãäåèéêëìíïñòóôõùúýÿÀÁÂÃÄÅÈÉÊËÌÍÎÏÑÒÓÔÕÙÚÛÝ"
BASES = "aaaaaeeeeiiinoooouuyyAAAAAAEEEEIIIINOOOOUUUY"
DOT = "̇"


def tr_lower(c: Column) -> Column:
    """Turkish lower case: İ to i, I to ı, no combining dot."""
    return F.lower(F.replace(F.translate(c, "İI", "iı"), F.lit(DOT), F.lit("")))


def en_lower(c: Column) -> Column:
    """Plain lower case without the combining dot that İ leaves."""
    return F.lower(F.replace(F.translate(c, "İ", "i"), F.lit(DOT), F.lit("")))


def haystacks(c: Column) -> Column:
    """The lower-cased copies that rules are tried on: Turkish, plain, and both with tight hyphens."""
    both = F.array(tr_lower(c), en_lower(c))
    return F.array_distinct(F.concat(both, F.transform(both, lambda h: F.regexp_replace(h, r"\s*[-–—]\s*", "-"))))


def fold(c: Column) -> Column:
    """Lower case without accents, for search; punctuation stays."""
    return F.lower(F.translate(F.translate(c, TURKISH, PLAIN), ACCENTED, BASES))


def slug_of(text: str) -> str:
    """slugify() of a name that is at hand while a query is made."""
    plain = text.translate(str.maketrans(TURKISH, PLAIN)).translate(str.maketrans(ACCENTED, BASES)).lower()
    return re.sub("[^a-z0-9]+", "-", re.sub("['’`]", "", plain).replace("&", " and ")).strip("-")


def slugify(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(fold(c), "['’`]", ""), "&", " and ")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def primary_name(c: Column) -> Column:
    return F.trim(F.split(c, "/")[0])


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters' code units."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, x: h.bitwiseXOR(F.ascii(x).cast("long")) * 16777619 % 4294967296)


def rand01(seed: Column | str, key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key alone."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    return fnv1a(F.concat(seed, F.lit("|"), key)) / 4294967296.0


def seed_of(ms: Column) -> Column:
    """The seed of the three-hour window that holds a time in milliseconds, base 36."""
    return F.lower(F.conv(F.floor(ms / 10800000).cast("string"), 10, 36))


def parse_number(c: Column) -> Column:
    """A price in any local notation: the last separator is decimal if one or two digits follow it."""
    kept = F.regexp_replace(c, r"[^0-9.,]", "")
    decimal = kept.rlike(r"[.,][0-9]{1,2}$")
    head = F.regexp_replace(F.when(decimal, F.regexp_replace(kept, r"[.,][0-9]{1,2}$", "")).otherwise(kept), "[.,]", "")
    tail = F.regexp_extract(kept, r"[.,]([0-9]{1,2})$", 1)
    value = F.when(decimal, F.concat(head, F.lit("."), tail)).otherwise(head).try_cast("double")
    return F.when(c.rlike(r"^\s*-"), -value).otherwise(value)


def index_letter(c: Column) -> Column:
    """The upper-case first letter under Turkish rules, # for anything else."""
    first = F.upper(F.translate(F.substring(F.trim(c), 1, 1), "iı", "İI"))
    return F.when(first.rlike(r"^\p{L}"), first).otherwise("#")


def looks_like_email(c: Column) -> Column:
    return (F.length(c) <= 254) & c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$")


#: Tags inside a line, which vanish; all others part sentences.
INLINE_TAGS = ["span", "b", "strong", "em", "i", "u", "small", "font", "mark", "abbr", "label"]


def visible_text(html: Column) -> Column:
    """Text of a page, after the announcements that stand in msg attributes; | stands where a tag parts sentences."""
    announced = F.array_join(F.regexp_extract_all(html, F.lit(r'(?i)\smsg="([^"]{6,120})"'), F.lit(1)), " | ")
    out = html
    for pattern, instead in (
        (r"(?i)<script[\s\S]*?</script>", " "), (r"(?i)<style[\s\S]*?</style>", " "), (rf"(?i)</?(?:{'|'.join(INLINE_TAGS)})\b[^>]*>", ""), (r"<[^>]+>", " | "),
        (r"(?i)&nbsp;?", " "), (r"(?i)&amp;", "&"), (r"(?i)&#x27;|&#39;", "'"), (r"\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, instead)
    return F.concat(F.when(announced != "", F.concat(announced, F.lit(" | "))).otherwise(""), out)


def has_word_start(text: Column, token: Column) -> Column:
    """Whether the token occurs at a word's start; token is taken literally."""
    return F.contains(F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9]", " ")), F.concat(F.lit(" "), token)) & F.contains(text, token)
