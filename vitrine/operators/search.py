"""Search: tokens and synonyms, matching and relevance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import rules
from vitrine.functions.color import color_label
from vitrine.functions.text import ACCENTED, BASES, PLAIN, TURKISH, fold, has_word_start

_FOLD = str.maketrans(TURKISH + ACCENTED, PLAIN + BASES)


def fold_query(text: str) -> str:
    """fold() for text of one request."""
    return text.translate(_FOLD).lower()


def folded(synonyms: dict[str, list[str]]) -> dict[str, list[str]]:
    """The table with folded keys and values, each value once."""
    return {fold_query(k): list(dict.fromkeys(map(fold_query, v))) for k, v in synonyms.items()}


SYNONYMS = folded(rules.SYNONYMS)


def expand_tokens(tokens: Column, synonyms: dict[str, list[str]] = SYNONYMS) -> Column:
    """array<array<string>>: each token with its synonyms after it, one step."""
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    return F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), none)))


def haystack(name: Column, brand: Column, category: Column, styles: Column, tags: Column) -> Column:
    """All searchable text of a product, folded."""
    return fold(F.concat_ws(" ", name, brand, category, F.concat_ws(" ", styles), F.concat_ws(" ", F.transform(tags, color_label))))


def parse_search(text: str, synonyms: dict[str, list[str]] = SYNONYMS) -> tuple[str, list[list[str]]]:
    """(the folded query, for each word the word and its synonyms); the query is text of one request."""
    full = fold_query(text.strip())
    return full, [[w, *synonyms.get(w, [])] for w in full.split()]


def matches(text: Column, groups: list[list[str]]) -> Column:
    """Every word, or a synonym of it, occurs."""
    found = F.lit(True)
    for group in groups:
        one = F.lit(False)
        for t in group:
            one = one | F.contains(text, F.lit(t))
        found = found & one
    return found


def relevance(name: Column, brand: Column, text: Column, full: str, groups: list[list[str]]) -> Column:
    name, brand, query = fold(name), fold(brand), F.lit(full)
    total = F.when(brand == query, 120.0).when(F.contains(brand, query), 70.0).otherwise(0.0)
    total = total + F.when(F.startswith(name, query), 55.0).when(F.contains(name, query), 30.0).otherwise(0.0)
    for group in groups:
        best = F.lit(0.0)
        for k, word in enumerate(group):
            t = F.lit(word)
            s = F.when(has_word_start(name, t), 22.0).when(F.contains(name, t), 12.0).when(has_word_start(brand, t), 18.0).when(F.contains(text, t), 6.0).otherwise(0.0)
            best = F.greatest(best, s * 0.6 if k else s)
        total = total + best
    return total
