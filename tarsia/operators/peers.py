"""Peer cohorts: with which entities each one is compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarsia.sources.projection import Tables

#: Attributes that a cohort shares, and its least size; the first level that is met counts.
LEVELS = [(("sector", "size_band", "soc_model", "schedule"), 5), (("sector", "size_band"), 3), (("sector",), 3), (("size_band",), 3), ((), 1)]
ESTABLISHED = 5


def schedule(hours: Column) -> Column:
    """24x7, HH:MM-HH:MM or unknown. A span of no or nearly all minutes of the day is 24x7."""
    word = F.lower(F.trim(F.coalesce(hours, F.lit(""))))
    at = lambda k: F.regexp_extract(word, r"^(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})$", k)
    span = F.pmod(at(3).try_cast("int") * 60 + at(4).try_cast("int") - at(1).try_cast("int") * 60 - at(2).try_cast("int"), F.lit(1440))
    return F.when(word.isin("24x7", "24/7", "24h", "always"), "24x7").when(span.isNull(), "unknown").when((span == 0) | (span >= 1439), "24x7").otherwise(word)


def profiles(t: Tables) -> DataFrame:
    return t.entity.select("entity_id", "sector", "size_band", "soc_model", "soc_provider", schedule(F.col("declared_shift_hours")).alias("schedule"))


def bridge(t: Tables) -> DataFrame:
    """entity_id, peer_id, level: each entity with the members of its cohort, derived once a session."""
    return t.once("bridge", lambda: peer_pairs(t))


def scope(ident: str = "entity_id") -> Column:
    """What an id names behind an @: the scope within which entities are compared."""
    return F.regexp_extract(ident, "@(.*)$", 1)


def key(attributes: tuple[str, ...]) -> Column:
    """One text for the scope and some attributes; null is a value of its own."""
    return F.concat_ws("\x1f", scope(), *[F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in attributes])


def chosen_levels(t: Tables) -> DataFrame:
    """entity_id, level, key: the first level at which an entity has enough peers. Sizes are counts by key, no pairs are made."""
    e = profiles(t)
    keys = F.array(*[F.struct(F.lit(k).alias("level"), key(attrs).alias("key"), F.lit(least).alias("least")) for k, (attrs, least) in enumerate(LEVELS)])
    keyed = e.select("entity_id", F.inline(keys))
    sizes = keyed.groupBy("level", "key").agg((F.count("*") - 1).alias("others"))
    fit = keyed.join(sizes, ["level", "key"]).filter("others >= least")
    return fit.groupBy("entity_id").agg(F.min(F.struct("level", "key")).alias("c")).select("entity_id", "c.level", "c.key")


def peer_pairs(t: Tables) -> DataFrame:
    """Each entity with those that share its key; pairs of others are never made."""
    e = profiles(t)
    members = e.select(F.col("entity_id").alias("peer_id"), F.inline(F.array(*[F.struct(F.lit(k).alias("level"), key(attrs).alias("key")) for k, (attrs, _) in enumerate(LEVELS)])))
    return chosen_levels(t).join(members, ["level", "key"]).filter("entity_id <> peer_id").select("entity_id", "peer_id", "level")


def exclusions(t: Tables) -> DataFrame:
    """entity_id, level, attribute, n: the entities left out of each one's cohort, by the first attribute in which they differ: those
    that share the attributes before it, less those that share it too."""
    e = profiles(t)
    prefixes = [F.struct(F.lit(k).alias("level"), F.lit(n).alias("n"), F.lit(attrs[n - 1] if n else "").alias("attribute"), key(attrs[:n]).alias("key")) for k, (attrs, _) in enumerate(LEVELS) for n in range(len(attrs) + 1)]
    keyed = e.select("entity_id", F.inline(F.array(*prefixes)))
    size = keyed.groupBy("level", "n", "key").agg(F.count("*").alias("size"))
    own = chosen_levels(t).select("entity_id", "level").join(keyed, ["entity_id", "level"]).join(size, ["level", "n", "key"])
    before = F.lag("size").over(Window.partitionBy("entity_id").orderBy("n"))
    return own.withColumn("out", before - F.col("size")).filter("out > 0").select("entity_id", "level", "attribute", F.col("out").alias("n"))


def cohorts(t: Tables) -> DataFrame:
    """entity_id, level, n_peers, strength, members (joined by commas). An entity without any peer has none of them."""
    b = bridge(t).groupBy("entity_id", "level").agg(F.count("*").alias("n_peers"), F.array_join(F.sort_array(F.collect_list("peer_id")), ",").alias("members"))
    last = len(LEVELS) - 1
    rows = t.entity.select("entity_id").join(b, "entity_id", "left").withColumns({"n_peers": F.coalesce("n_peers", F.lit(0)), "members": F.coalesce("members", F.lit(""))})
    strength = F.when(F.col("n_peers") == 0, "none").when((F.col("n_peers") >= ESTABLISHED) & (F.col("level") < last), "established").otherwise("exploratory")
    return rows.withColumn("strength", strength)
