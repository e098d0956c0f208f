"""Keyword rules: multi-label matches, coverage and co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import keyword_pattern, utf16_length

# The keyword sets of the exploratory label scheme.
KEYWORDS = {
    "battery_power": ["battery", "drain", "draining", "drained", "charge", "charging", "charger", "overheating", "overheat", "percent", "percentage", "dies", "dying", "turn off", "powers off"],
    "software_update": ["update", "updated", "updating", "ios11", "ios 11", "high sierra", "upgrade", "upgraded", "install", "installing", "firmware", "restore", "restoring", "downgrade"],
    "keyboard_input": ["keyboard", "autocorrect", "auto correct", "typing", "type", "predictive", "question mark", "question marks", "mark box", "letter", "capital", "emoji", "emojis"],
    "display_touch": ["screen", "touch", "display", "freeze", "freezes", "freezing", "frozen", "unresponsive", "black screen", "glitch", "glitching", "cracked", "shattered"],
    "audio_media": ["music", "itunes", "song", "songs", "playlist", "playlists", "album", "sound", "speaker", "speakers", "volume", "headphone", "headphones", "earpod", "earpods", "airpod", "airpods"],
    "connectivity_network": ["wifi", "wi fi", "bluetooth", "connect", "connecting", "connection", "cellular", "signal", "service", "airdrop", "hotspot", "lte", "network", "sim"],
    "account_icloud": ["icloud", "apple id", "appleid", "account", "password", "passcode", "locked", "lock", "unlock", "verification", "verify", "backup", "back up", "storage", "two factor", "2fa"],
    "billing_purchases": ["charge", "charged", "charges", "billing", "bill", "subscription", "subscribe", "refund", "purchase", "purchased", "receipt", "card", "payment", "paid", "credit"],
}

# Three topic lists that are counted independently, and the word pairs of boundary cases.
SUBTOPICS = {
    "app_store": ["app store", "appstore", "downloading app", "downloading apps", "download app", "download apps", "update app", "update apps", "updating app", "updating apps", "waiting...", "circle spinning"],
    "third_party": ["youtube", "spotify", "whatsapp", "instagram", "facebook", "twitter app", "snapchat", "netflix"],
    "first_party": ["camera app", "photos app", "mail app", "notes app", "messages app", "safari app", "maps app"],
}
BOUNDARY = [(["update"], ["battery", "screen", "keyboard", "wifi", "bluetooth", "sound"]), (["repair", "bill"], ["screen", "glass", "display"]), (["charge", "card"], ["wifi", "sim", "free app"]), (["music", "spotify"], ["app", "crash", "store"])]
SHORT = 25


def topic_counts(df: DataFrame, text: str, topics: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows per topic; a row may count for several."""
    m = matched(text, topics or SUBTOPICS)
    return df.select(F.explode(m).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def ambiguous(text: str | Column) -> Column:
    """Whether a text names both sides of a boundary pair or is short (in UTF-16 units)."""
    x = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    out = utf16_length(x) < SHORT
    for a, b in BOUNDARY:
        out = out | (x.rlike(keyword_pattern(a)) & x.rlike(keyword_pattern(b)))
    return out


def first_match(text: str | Column, order: list[str], fallback: str, rules: dict[str, list[str]] | None = None) -> Column:
    """The first label in the order whose keywords occur, else the fallback."""
    m = matched(text, rules)
    return F.coalesce(*[F.when(F.array_contains(m, label), F.lit(label)) for label in order], F.lit(fallback))


def matched(text: str | Column, rules: dict[str, list[str]] | None = None) -> Column:
    """Sorted array of the labels any of whose keywords occur as whole words."""
    x = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.sort_array(F.array_compact(F.array(*[F.when(x.rlike(keyword_pattern(words)), F.lit(label)) for label, words in (rules or KEYWORDS).items()])))


def coverage(df: DataFrame, text: str, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """Per label: rows that match it and rows that match it alone."""
    m = df.select(matched(text, rules).alias("m"))
    return m.select(F.explode("m").alias("label"), (F.size("m") == 1).alias("alone")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("alone").alias("n_exclusive"))


def match_sizes(df: DataFrame, text: str, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """One row: rows without, with one and with several labels."""
    n = F.size(matched(text, rules))
    return df.select(n.alias("n")).agg(F.count_if(F.col("n") == 0).alias("n_none"), F.count_if(F.col("n") == 1).alias("n_single"), F.count_if(F.col("n") > 1).alias("n_multi"))


def combinations(df: DataFrame, text: str, k: int, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """The ``k`` commonest combinations of several labels."""
    m = df.select(matched(text, rules).alias("m")).where(F.size("m") > 1).groupBy(F.array_join("m", " + ").alias("labels")).agg(F.count(F.lit(1)).alias("n"))
    return m.orderBy(F.desc("n"), "labels").limit(k)
