"""Short product ids and share links, names and texts as users type them, and small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import fnv1a, primary_name, slugify, tr_lower

WORD32 = 4_294_967_296
#: Fixed values of the share format.
SECOND_ROUND, SEPARATOR, MAX_ITEMS, DEFAULT_LIST = 0x2545F491, ".", 200, "LİSTEM"
MAX_REVIEW, MAX_LIST_NAME, UNNAMED_LIST = 1000, 60, "İSİMSİZ LİSTE"
NICK = r"^[a-z0-9](?:[a-z0-9._-]{1,18})[a-z0-9]$"
#: What a public name must not contain.
BANNED = ["amk", "aq", "orospu", "piç", "pic", "sik", "yarrak", "göt", "got", "pezeven", "fuck", "shit", "bitch", "nigg", "admin"]


def times32(a: Column, k: int) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, by 16-bit halves, so that no step leaves 64 bits."""
    high = F.shiftright(a, 16) * k % 65536
    return (high * 65536 + a.bitwiseAND(65535) * k) % WORD32


def short_id(product_id: Column) -> Column:
    """Eight characters of base 36 from two rounds of a 32-bit hash."""
    h = F.array(fnv1a(product_id))

    def code(h: Column) -> Column:
        second = times32(h.bitwiseXOR(F.shiftright(h, 15)), SECOND_ROUND)
        second = second.bitwiseXOR(F.shiftright(second, 13))
        base36 = lambda n: F.lower(F.conv(n.cast("string"), 10, 36))
        return F.concat(F.substring(F.lpad(base36(h), 7, "0"), -7, 7), base36(second % 36))

    return F.transform(h, code)[0]


def encode_share(ids: Column) -> Column:
    return F.array_join(F.transform(F.slice(ids, 1, MAX_ITEMS), short_id), SEPARATOR)


def decode_share(code: Column) -> Column:
    parts = F.filter(F.transform(F.split(code, r"\."), lambda s: F.trim(s)), lambda s: s != "")
    return F.slice(parts, 1, MAX_ITEMS)


def share_url(origin: Column, name: Column, ids: Column, mode: Column) -> Column:
    named = F.when((name != "") & (name != DEFAULT_LIST), F.concat(F.lit("&ad="), F.url_encode(name))).otherwise("")
    return F.concat(origin, F.lit("/?liste="), encode_share(ids), named, F.when(mode == "kombin", "&mod=kombin").otherwise(""))


def share_mode(value: Column) -> Column:
    return F.when(value == "kombin", "kombin").otherwise("liste")


def review_text(raw: Column, most: int = MAX_REVIEW) -> Column:
    """Runs of blanks become one, of line ends at most two."""
    return F.substring(F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "[ \t]+", " "), "\n{3,}", "\n\n"), F.lit(" \n\t\r")), 1, most)


def rating(raw: Column) -> Column:
    """1 to 5, or null."""
    n = F.floor(raw.try_cast("double") + 0.5)
    return F.when(n.between(1, 5), n.cast("int"))


def list_name(raw: Column) -> Column:
    name = F.substring(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " ")), 1, MAX_LIST_NAME)
    return F.when(name == "", UNNAMED_LIST).otherwise(name)


def public_nick(raw: Column) -> Column:
    """A public name in lower case, or null if its form or a word in it is not allowed."""
    n = F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), r"\s+", "-")
    return F.when(n.rlike(NICK) & ~n.rlike("|".join(BANNED)), n)


def user_nick(raw: Column) -> Column:
    n = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(n.rlike(r"^[\p{L}\p{N}._-]{2,24}$"), n)


def nick_keys(nick: Column) -> Column:
    """Under both ways of lowering."""
    return F.array_distinct(F.array(tr_lower(nick), F.lower(nick)))


def brand_key(name: Column) -> Column:
    """The slug of a brand's primary name."""
    return slugify(primary_name(name))


def currency_code(raw: Column, default: str = "TRY") -> Column:
    code = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(code.isin("", "TL", "₺"), default).otherwise(code)


def format_count(n: Column, lang: Column) -> Column:
    """Thousands with a comma in English, with a point otherwise."""
    plain = F.format_number(n, 0)
    return F.when(lang == "en", plain).otherwise(F.translate(plain, ",", "."))


def format_price(amount: Column, currency: Column) -> Column:
    """Whole amounts without decimals; the sign of the home currency, codes for others."""
    whole = F.translate(F.format_number(F.floor(amount), 0), ",", ".")
    cents = F.round((amount - F.floor(amount)) * 100).cast("int")
    text = F.when(cents > 0, F.concat(whole, F.lit(","), F.lpad(cents.cast("string"), 2, "0"))).otherwise(whole)
    return F.when(currency == "TRY", F.concat(F.lit("₺"), text)).otherwise(F.concat(text, F.lit(" "), currency))


def translated(text: Column, lang: Column, phrases: dict[str, str], patterns: list[tuple[str, str]] = ()) -> Column:
    """The phrase's translation, else by the first pattern that is met, else the text itself; home language unchanged."""
    table = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])
    found = text
    for pattern, to in reversed(list(patterns)):
        found = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, to)).otherwise(found)
    return F.when(lang == "en", F.coalesce(F.try_element_at(table, text), found)).otherwise(text)


def toggled(chosen: Column, item: Column) -> Column:
    """A choice without the item if it was in, with it at the end otherwise."""
    one = F.array(item)
    return F.when(F.array_contains(chosen, item), F.array_except(chosen, one)).otherwise(F.concat(chosen, one))
