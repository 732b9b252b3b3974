"""Users, sessions, feedback and lists: lookups and updates of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.functions.share import brand_key, nick_keys, user_nick
from vitrine.functions.text import looks_like_email
from vitrine.operators.userdata import merge_lists

#: Feedback topics, and how long their fields may be.
TOPICS = ["marka-oner", "geri-bildirim", "marka-kaldir", "diger"]
MAX_TEXT, MAX_BRAND, MAX_LINK, MAX_EMAIL = 1500, 60, 200, 254
MAX_LISTS, MAX_LIST_ITEMS, MAX_ID, MAX_NAME = 40, 200, 40, 60
#: How long the fields of an event may be.
EVENT_FIELDS = {
    "brand": 120, "brandSlug": 80, "productId": 200, "productName": 200, "category": 60, "currency": 8, "ctxCat": 60, "ctxQuery": 120, "session": 64,
}


def is_topic(c: Column) -> Column:
    return F.coalesce(c.isin(TOPICS), F.lit(False))


def feedback_error(topic: Column, text: Column, brand: Column, email: Column) -> Column:
    """What is wrong with a message, the first thing only; null if it can be taken."""
    clean = lambda c, n: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n)
    text, brand, email = clean(text, MAX_TEXT), clean(brand, MAX_BRAND), F.lower(clean(email, MAX_EMAIL))
    about_brand = topic.isin("marka-oner", "marka-kaldir")
    return (
        F.when(~is_topic(topic), "konu")
        .when(about_brand & (F.length(brand) < 2), "marka")
        .when((topic != "marka-oner") & (F.length(text) < 5), "metin")
        .when((email != "") & ~looks_like_email(email), "eposta")
        .when((topic == "marka-kaldir") & (email == ""), "eposta")
    )


def feedback_filter(items: DataFrame, topic: str | None = None, unread_only: bool = False) -> DataFrame:
    """items (topic, read) of a topic, or unread ones."""
    kept = items.filter(F.col("topic") == topic) if topic else items
    return kept.filter(~F.col("read")) if unread_only else kept


def apply_changes(items: DataFrame, changes: DataFrame) -> DataFrame:
    """items (id, read, ..) after changes (id, at, action): the last change of an id marks it read or unread, or removes it.

    Changes of unknown ids do nothing.
    """
    last = changes.groupBy("id").agg(F.max_by("action", "at").alias("_action"))
    joined = items.join(last, "id", "left").filter(~F.col("_action").eqNullSafe("remove"))
    return joined.withColumn("read", F.when(F.col("_action") == "read", True).when(F.col("_action") == "unread", False).otherwise(F.col("read"))).drop("_action")


def owner_view(items: DataFrame, owner: Column) -> DataFrame:
    """items (owner_hash, ..) as others may see them: without the hash, with `mine`."""
    return items.withColumn("mine", F.coalesce(F.col("owner_hash") == owner, F.lit(False))).drop("owner_hash")


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """sessions (token, expires_at) that have not run out."""
    return sessions.filter(F.col("expires_at") >= now)


def upsert_users(users: DataFrame, logins: DataFrame, admins: DataFrame) -> DataFrame:
    """users (id, email, requested_role, providers, created_at, last_login_at) after logins (email, provider, role, at).

    An address stands for one user; new providers are added in the order of their first login; the role asked
    for at the first login stays, and addresses in admins (email) are administrators.
    """
    per = logins.groupBy("email", "provider").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min_by("role", "at").alias("role"))
    new = per.groupBy("email").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "provider"))), lambda x: x.provider).alias("_new"),  # as many as there are providers
        F.min("first").alias("_first"), F.max("last").alias("_last"), F.min_by("role", "first").alias("_role"),
    )
    both = users.join(new, "email", "full").join(admins.select("email").distinct().withColumn("_admin", F.lit(True)), "email", "left")
    none = F.array().cast("array<string>")
    asked = F.coalesce("requested_role", "_role")
    return both.select(
        F.coalesce("id", F.sha2("email", 256)).alias("id"),
        "email",
        asked.alias("requested_role"),
        F.when(F.col("_admin"), "admin").otherwise(asked).alias("role"),
        F.array_union(F.coalesce("providers", none), F.coalesce("_new", none)).alias("providers"),
        F.coalesce("created_at", "_first").alias("created_at"),
        F.coalesce("_last", "last_login_at").alias("last_login_at"),
    )


def nick_requests(users: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (user_id, nick) with verdict: null if the name can be had, "gecersiz" or "kullanimda".

    A name is taken if another user (id, nick) has it under either way of lowering.
    """
    wanted = asked.withColumn("_clean", user_nick(F.col("nick")))
    keys = wanted.filter(F.col("_clean").isNotNull()).select("user_id", F.explode(nick_keys(F.col("_clean"))).alias("_key"))
    held = users.filter(F.col("nick").isNotNull()).select(F.col("id").alias("_owner"), F.explode(nick_keys(F.col("nick"))).alias("_key")).distinct()
    taken = keys.join(held, "_key").filter(F.col("_owner") != F.col("user_id")).select("user_id").distinct().withColumn("_taken", F.lit(True))
    known = users.select(F.col("id").alias("user_id")).distinct().withColumn("_known", F.lit(True))
    found = wanted.join(taken, "user_id", "left").join(known, "user_id", "left")
    verdict = F.when(F.col("_clean").isNull() | F.col("_known").isNull(), "gecersiz").when(F.col("_taken"), "kullanimda")
    return found.withColumn("verdict", verdict).drop("_clean", "_taken", "_known")


def find_brands(brands: DataFrame, names: DataFrame) -> DataFrame:
    """names (name) with the slug of the brand (slug) that the primary name stands for, null if there is none."""
    known = brands.select("slug").distinct().withColumn("_key", F.col("slug"))
    return names.withColumn("_key", brand_key(F.col("name"))).join(known, "_key", "left").drop("_key")


def kept_products(cache: DataFrame, lists: DataFrame) -> DataFrame:
    """cache (id, ..) of the products that some list (ids) still has."""
    return cache.join(lists.select(F.explode("ids").alias("id")).distinct(), "id", "left_semi")


def merge_on_login(user: Column, remote: DataFrame, local: DataFrame, owner: DataFrame) -> DataFrame:
    """Lists after users log in on devices; remote and local: user, pos, id, name, items, created, updated.

    Where the device's data belong to someone else (owner: user, owner), the remote lists replace them; else both
    are merged as by merge_lists.  `user` is the column of the user in owner.
    """
    foreign = owner.filter(F.col("owner").isNotNull() & (F.col("owner") != user)).select("user")
    own = local.join(foreign, "user", "left_anti")
    scoped = lambda d: d.select("pos", F.concat_ws("/", "user", "id").alias("id"), F.concat_ws("/", "user", "name").alias("name"), "items", "created", "updated")
    merged = merge_lists(scoped(remote), scoped(own))
    cut = lambda c: F.split(c, "/", 2)[1]
    return merged.select(F.split("id", "/", 2)[0].alias("user"), cut("id").alias("id"), cut("name").alias("name"), "items", "created", "updated")


def clean_lists(lists: DataFrame) -> DataFrame:
    """lists (owner, pos, id, name, ids) as they may be stored: the first MAX_LISTS of an owner, ids once each and MAX_LIST_ITEMS at most."""
    usable = lists.filter(F.col("id") != "")
    place = F.row_number().over(Window.partitionBy("owner").orderBy("pos"))
    name = F.substring(F.coalesce("name", F.lit("")), 1, MAX_NAME)
    kept = usable.withColumn("_k", place).filter(F.col("_k") <= MAX_LISTS).drop("_k")
    return kept.select(
        "owner", "pos", F.substring("id", 1, MAX_ID).alias("id"), F.when(name == "", "LİSTE").otherwise(name).alias("name"),
        F.slice(F.array_distinct(F.filter("ids", lambda x: x.isNotNull())), 1, MAX_LIST_ITEMS).alias("ids"),
    )


def clean_event(body: Column) -> Column:
    """struct of an event's fields from untrusted ones, cut to their lengths; the target's host is derived anew.

    body: struct of EVENT_FIELDS, kind and url; null without a brand's slug.
    """
    cut = {n: F.substring(body[n], 1, most) for n, most in EVENT_FIELDS.items()}
    cut["brand"] = F.coalesce(cut["brand"], cut["brandSlug"])
    host = F.lower(F.regexp_extract(F.substring(F.coalesce(body["url"], F.lit("")), 1, 2000), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    kind = F.when(body["kind"] == "product", "product").otherwise("brand")
    return F.when(cut["brandSlug"] != "", F.struct(*(c.alias(n) for n, c in cut.items()), kind.alias("kind"), host.alias("targetHost")))


def refresh_plan(brands: DataFrame, fast: list[str], target_minutes: int, force: bool = False) -> DataFrame:
    """brands (slug, platform, age) to read again: fast ones older than half the target, all slow ones, with the lane's place, oldest first.

    Lanes are taken one after the other; within the slow lane the oldest come first, numbered in two steps
    (ages by the hour, then within the hour), so no task orders all brands.
    """
    is_fast = F.col("platform").isin(fast)
    due = brands.filter(force | ~is_fast | (F.col("age") >= target_minutes * 0.5)).withColumn("lane", F.when(is_fast, 0).otherwise(1))
    hour = F.floor(F.col("age") / 60)
    sizes = due.groupBy("lane", hour.alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("lane").orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_before", F.coalesce(before, F.lit(0)))
    within = F.row_number().over(Window.partitionBy("lane", "_hour").orderBy(F.desc("age"), "slug"))
    return due.withColumn("_hour", hour).withColumn("_in", within).join(sizes, ["lane", "_hour"]).select("slug", "platform", "age", "lane", (F.col("_before") + F.col("_in")).alias("place"))


def stale(brands: DataFrame, most_minutes: int) -> DataFrame:
    """brands (slug, age) that were never read or too long ago."""
    return brands.filter(F.col("age").isNull() | (F.col("age") > most_minutes))
