"""Identity matching between two catalogs, ordinals, channel substitution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Channels and what may stand in for each.
SUBSTITUTES = {"SL": "BL", "SR": "BR", "BL": "SL", "BR": "SR", "DL": "FL", "BIL": "FL", "DR": "FR", "BIR": "FR"}
#: The layouts that the speech and music encoder takes, by number of channels.
ENCODER_LAYOUTS = (
    ("mono", "FC"), ("stereo", "FL+FR"), ("3.0", "FL+FR+FC"), ("quad", "FL+FR+BL+BR"), ("5.0", "FL+FR+FC+BL+BR"), ("5.1", "FL+FR+FC+LFE+BL+BR"), ("6.1", "FL+FR+FC+LFE+BC+SL+SR"),
    ("7.1", "FL+FR+FC+LFE+BL+BR+SL+SR"),
)


def twins(streams: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordinal, number, by: the tracks of each stream. streams: keys, ordinal, id (null: unknown); tracks: keys, ordinal, number.

    A stream with an id is matched by number (to several or none); one without is matched by place,
    and only if both catalogs list as many.
    """
    by_number = streams.where(F.col("id").isNotNull()).join(tracks.select(*keys, "number"), [*(streams[k] == tracks[k] for k in keys), streams["id"] == tracks["number"]])
    by_number = by_number.select(*[streams[k] for k in keys], "ordinal", "number", F.lit("number").alias("by"))
    n, m = streams.groupBy(*keys).agg(F.count("*").alias("__n")), tracks.groupBy(*keys).agg(F.count("*").alias("__m"))
    alike = n.join(m, keys).where(F.col("__n") == F.col("__m")).select(*keys)
    by_place = streams.where(F.col("id").isNull()).select(*keys, "ordinal").join(alike, keys, "left_semi").join(tracks, [*keys, "ordinal"])
    return by_number.unionByName(by_place.select(*keys, "ordinal", "number", F.lit("place").alias("by")))


def exactly_one(matched: DataFrame, keys: list[str]) -> DataFrame:
    """The matches of streams that have exactly one."""
    w = Window.partitionBy(*keys, "ordinal")
    return matched.withColumn("__n", F.count("*").over(w)).where(F.col("__n") == 1).drop("__n")


def by_ordinal(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer match by ordinal with even: whether both sides of the group have as many rows."""
    n, m = left.groupBy(*keys).agg(F.count("*").alias("__n")), right.groupBy(*keys).agg(F.count("*").alias("__m"))
    even = n.join(m, keys, "full_outer").select(*keys, F.col("__n").eqNullSafe(F.col("__m")).alias("even"))
    return left.join(right, [*keys, "ordinal"], "full_outer").join(even, keys)


def smallest_layout(channels: Column, count: Column | None = None) -> Column:
    """The encoder's first layout that places all channels (an array of names), where a channel's substitute counts if the source lacks it; else the layout of as many channels as there are, or count says."""
    swap = F.create_map(*[F.lit(x) for pair in SUBSTITUTES.items() for x in pair])

    def places(members: str) -> Column:
        own = F.array(*map(F.lit, members.split("+")))

        def placed(c: Column) -> Column:
            other = F.try_element_at(swap, c)
            return F.array_contains(own, c) | F.coalesce(F.array_contains(own, other) & ~F.array_contains(channels, other), F.lit(False))

        return F.forall(channels, placed)

    names = F.array(*[F.lit(name) for name, _ in ENCODER_LAYOUTS])
    many = F.coalesce(F.when(channels.isNotNull(), F.size(channels)), F.lit(None).cast("int") if count is None else count, F.lit(2))
    many = F.least(F.greatest(many, F.lit(1)), F.lit(len(ENCODER_LAYOUTS)))
    return F.coalesce(*[F.when(places(members), name) for name, members in ENCODER_LAYOUTS], F.element_at(names, many.cast("int")))


def folded(sources: DataFrame, folds: DataFrame) -> DataFrame:
    """id, destination, contributors: channels by where they are folded to, in source order. sources: id, seq, channel; folds: channel, choice, targets (array). The first choice whose targets are all there is taken; a channel without one stays alone."""
    present = sources.groupBy("id").agg(F.array_sort(F.collect_list("channel")).alias("have"))  # a stream has a few channels
    options = sources.join(folds, "channel", "left").join(present, "id")
    ok = F.size(F.array_except("targets", "have")) == 0
    chosen = options.groupBy("id", "seq", "channel").agg(F.min(F.when(ok, F.struct("choice", "targets"))).alias("c"))
    ends = chosen.select("id", "seq", "channel", F.explode(F.coalesce(F.col("c.targets"), F.array("channel"))).alias("destination"))
    return ends.groupBy("id", "destination").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "channel"))), lambda x: x["channel"]).alias("contributors"))
