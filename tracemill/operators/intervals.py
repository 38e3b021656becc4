"""Changes between two events whose order is partial: native within an order domain, by time between domains.

For a pair whose ends lie in different domains, a change of the first end's domain follows that end by value and precedes
the other by time, a change of the other's domain the other way round, and one of a third domain lies between by time.
The mixed cases count points below two bounds at once. Such a count is taken without a join of pairs and changes: a
prefix of the changes by value falls into blocks of powers of two, one for each bit of its length, and within a block
a window over time counts what comes before. So a pair is as many rows as that number has bits, and a change as many as
its domain's count has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def counted(points: DataFrame, probes: DataFrame, by: list[str], at: str) -> DataFrame:
    """points: by, at. probes: by, at and others. Adds to the probes less and equal: how many points of the group lie
    before and at each. Probes without a place get none."""
    rest = [c for c in probes.columns if c not in (*by, at)]
    one = points.where(F.col(at).isNotNull()).select(*by, at, F.lit(1).alias("__n"), F.lit(None).cast(probes.select(F.struct(*rest)).schema[0].dataType).alias("__probe"))
    two = probes.where(F.col(at).isNotNull()).select(*by, at, F.lit(0).alias("__n"), F.struct(*rest).alias("__probe"))
    w = W.partitionBy(*by).orderBy(at)
    less = F.coalesce(F.sum("__n").over(w.rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = one.unionByName(two).select("__probe", *by, at, less.alias("less"), F.sum("__n").over(w.rangeBetween(0, 0)).alias("equal"))
    return rows.where("__probe IS NOT NULL").select(*by, at, "__probe.*", "less", "equal")


def below_both(points: DataFrame, probes: DataFrame, by: list[str], rank: str, at: str) -> DataFrame:
    """points: by, rank (0 and up in each group), at. probes: by, rank, at and others. Adds to the probes ``below``: how many
    points of the group have a lesser rank and a lesser place; null where the probe has no rank or no place."""
    bits = W.partitionBy(*by)
    size = F.length(F.bin(F.count("*").over(bits)))
    levels = points.withColumn("__size", size).withColumn("__level", F.explode(F.sequence(F.lit(0), F.col("__size") - 1))).select(*by, "__level", F.expr(f"shiftright({rank}, __level)").alias("__block"), at)
    keyed = probes.withColumn("__key", F.monotonically_increasing_id())
    rest = [c for c in probes.columns if c not in (*by, at)]
    split = keyed.where(F.col(at).isNotNull() & (F.col(rank) > 0)).withColumn("__level", F.explode(F.filter(F.sequence(F.lit(0), F.length(F.bin(rank)) - 1), lambda k: F.call_function("shiftright", F.col(rank), k).bitwiseAND(F.lit(1)) == 1)))
    split = split.select(*by, "__level", (F.expr(f"shiftright({rank}, __level)") - 1).alias("__block"), at, *rest)
    found = counted(levels, split, [*by, "__level", "__block"], at).groupBy(*by, at, *rest).agg(F.sum("less").alias("below"))
    none = probes.where(F.col(at).isNotNull() & (F.col(rank) == 0)).withColumn("below", F.lit(0).cast("long"))
    return found.select(*by, at, *rest, "below").unionByName(none.select(*by, at, *rest, "below"))


def changes_across(events: DataFrame, by: str, pairs: DataFrame) -> DataFrame:
    """events: by, id, domain, value, time (null: unknown), change. pairs: by, from_id, to_id in different domains; each
    once. Adds changes: how many lie strictly between; null if any change can't be compared with an end."""
    end = lambda n: events.select(F.col(by), F.col("id").alias(f"{n}_id"), F.struct("domain", "value", "time", "change").alias(n))
    p = pairs.join(end("from"), [by, "from_id"]).join(end("to"), [by, "to_id"])
    changes = events.where("change").select(by, "domain", "value", "time")
    key = [by, "from_id", "to_id"]

    def probe(name: str, domain: Column, at: Column, column: str) -> DataFrame:
        return p.select(*key, F.lit(name).alias("probe"), domain.alias("domain"), at.alias(column))

    a, b, first, last = F.col("from.domain"), F.col("to.domain"), F.col("from.time"), F.col("to.time")
    native = counted(changes, probe("from", a, F.col("from.value"), "value").unionByName(probe("to", b, F.col("to.value"), "value")), [by, "domain"], "value")
    timed = probe("a_first", a, first, "time")
    for name, domain, at in (("a_last", a, last), ("b_first", b, first), ("b_last", b, last)):
        timed = timed.unionByName(probe(name, domain, at, "time"))
    timed = counted(changes, timed, [by, "domain"], "time")
    whole = probe("first", F.lit(""), first, "time").unionByName(probe("last", F.lit(""), last, "time")).drop("domain")
    whole = counted(changes, whole, [by], "time")

    ranked = changes.withColumn("rank", F.row_number().over(W.partitionBy(by, "domain").orderBy("value")) - 1).select(by, "domain", "rank", "time").where("time IS NOT NULL")
    native = native.select(*key, "probe", "domain", "less", "equal")
    prefix = native.join(p.select(*key, "from", "to"), key)
    # behind the first end by value: all but the prefix up to it; before the other one by value: the prefix below it
    rank = F.when(F.col("probe") == "from", F.col("less") + F.col("equal")).otherwise(F.col("less")).cast("int")
    other = F.when(F.col("probe") == "from", last).otherwise(first)
    both = below_both(ranked, prefix.select(*key, "probe", "domain", rank.alias("rank"), other.alias("time")), [by, "domain"], "rank", "time")

    def wide(rows: DataFrame, names: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
        return rows.groupBy(*key).agg(*(F.max(F.when(F.col("probe") == n, F.col(c))).alias(f"{n}_{c}") for n in names for c in columns))

    n_all = changes.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("time").isNull()).alias("untimed"))
    n_domain = changes.groupBy(by, "domain").agg(F.count("*").alias("n"), F.count_if(F.col("time").isNull()).alias("untimed"))
    side = lambda n: n_domain.select(F.col(by), F.col("domain").alias(f"__{n}"), F.col("n").alias(f"{n}_n"), F.col("untimed").alias(f"{n}_untimed"))
    rows = p.withColumn("__a", a).withColumn("__b", b).join(side("a"), [by, "__a"], "left").join(side("b"), [by, "__b"], "left").join(n_all, by, "left")
    rows = rows.join(wide(native, ("from", "to"), ("less", "equal")), key, "left").join(wide(timed, ("a_first", "a_last", "b_first", "b_last"), ("less", "equal")), key, "left")
    rows = rows.join(wide(whole, ("first", "last"), ("less", "equal")), key, "left").join(wide(both, ("from", "to"), ("below",)), key, "left")
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    own = lambda name: F.coalesce(F.col(name)["change"].cast("int"), F.lit(0))
    others, others_untimed = c("n") - c("a_n") - c("b_n"), c("untimed") - c("a_untimed") - c("b_untimed")
    at = lambda t, what: c(f"{t}_{what}") - c(f"a_{t}_{what}") - c(f"b_{t}_{what}")
    unknown = (
        ((c("a_n") > 0) & (last.isNull() | (c("a_untimed") > 0) | (c("a_last_equal") > 0) | (c("from_equal") > own("from"))))
        | ((c("b_n") > 0) & (first.isNull() | (c("b_untimed") > 0) | (c("b_first_equal") > 0) | (c("to_equal") > own("to"))))
        | ((others > 0) & (first.isNull() | last.isNull() | (others_untimed > 0) | (at("first", "equal") > 0) | (at("last", "equal") > 0)))
    )
    in_a, in_b = c("a_last_less") - c("from_below"), c("to_less") - c("to_below")
    elsewhere = F.greatest(F.lit(0), at("last", "less") - at("first", "less"))
    found = F.when(c("a_n") > 0, in_a).otherwise(0) + F.when(c("b_n") > 0, in_b).otherwise(0) + F.when(others > 0, elsewhere).otherwise(0)
    return rows.select(by, "from_id", "to_id", F.when(~unknown, found).cast("long").alias("changes"))


def changes_between(events: DataFrame, by: str, pairs: DataFrame) -> DataFrame:
    """Pairs of one domain and of two: each by its own way."""
    from tracemill.operators.outcomes import known_changes_between

    domain = lambda n: events.select(F.col(by), F.col("id").alias(f"{n}_id"), F.col("domain").alias(f"__{n}"))
    told = pairs.distinct().join(domain("from"), [by, "from_id"]).join(domain("to"), [by, "to_id"])
    same = F.col("__from").eqNullSafe(F.col("__to"))
    within = known_changes_between(events, by, told.where(same).select(by, "from_id", "to_id"))
    return within.select(by, "from_id", "to_id", "changes").unionByName(changes_across(events, by, told.where(~same).select(by, "from_id", "to_id")))
