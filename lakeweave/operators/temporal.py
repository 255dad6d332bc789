"""Joins and sessions along time (or any number) that split a hot key by stretches of it: as-of, nearest, band joins, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("backward", "forward", "nearest")


def place(df: DataFrame, column: str) -> Column:
    """A column as a number: microseconds of a time, days of a date, else itself."""
    kind = df.schema[column].dataType.typeName()
    return F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(column).cast("long") if kind == "date" else F.col(column)


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: tuple[str, str], width: float, take: list[str], side: str = "backward", tie: str | None = None) -> DataFrame:
    """left with `take` of the right row that is nearest on one side: columns left.*, take (null where there is none).

    by: columns of both that must be equal; at: the left's and the right's place, a time, date or number. backward takes the
    last right row at or before the left's place, forward the first at or after it, nearest the nearer of the two (the
    backward one of equally near). Of right rows at one place the one with the largest `tie` counts (null: any one, its
    columns then compared).

    Both sides are dealt out by `by` and stretches of `width`, so a hot key is shared out. A row looks in its own stretch first;
    what it needs from others is looked up in a table of one row a key and stretch (its first and last right row), carried
    over stretches without any. Right rows with a null key or place are met by none; left rows with one stay, unmatched. Left
    rows that repeat stay repeated. Columns of `take` must not be columns of left.
    """
    if side not in SIDES or set(take) & set(left.columns):
        raise ValueError("side is backward, forward or nearest; take must not name columns of left")
    found = right.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], place(right, at[1]).alias("__p"), F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(take)]).alias("__r"), (F.col(tie) if tie else F.lit(0)).alias("__t"))
    keys = [f"__k{i}" for i in range(len(by))]
    for c in [*keys, "__p"]:
        found = found.where(F.col(c).isNotNull())
    found = found.groupBy(*keys, "__p").agg(F.max(F.struct("__t", "__r"))["__r"].alias("__r")).withColumn("__side", F.lit(1))
    asked = left.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], place(left, at[0]).alias("__p"), F.struct(*[F.col(c).alias(f"l{i}") for i, c in enumerate(left.columns)]).alias("__l"), F.lit(0).alias("__side"))
    both = found.withColumn("__r", F.struct("__p", "__r")).unionByName(asked, allowMissingColumns=True).withColumn("__b", F.floor(F.col("__p") / width).cast("long"))
    stretch = Window.partitionBy(*keys, "__b")
    # A right row at a left row's own place is behind it: it comes first in one order and, with the left ones last, in neither missed.
    behind = stretch.orderBy(F.col("__p"), F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = stretch.orderBy(F.col("__p").desc(), F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    edges = both.where("__side = 1").groupBy(*keys, "__b").agg(F.max_by("__r", "__p").alias("__last"), F.min_by("__r", "__p").alias("__first"))
    edges = edges.unionByName(both.where("__side = 0 AND __b IS NOT NULL").select(*keys, "__b").distinct(), allowMissingColumns=True)
    edges = edges.groupBy(*keys, "__b").agg(F.first("__last", ignorenulls=True).alias("__last"), F.first("__first", ignorenulls=True).alias("__first"))
    along = Window.partitionBy(*keys).orderBy("__b")
    edges = edges.select(
        *[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)], F.col("__b").alias("__ob"), F.last("__last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.first("__first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    near = both
    if side != "forward":
        near = near.withColumn("__prev", F.last("__r", ignorenulls=True).over(behind))
    if side != "backward":
        near = near.withColumn("__next", F.last("__r", ignorenulls=True).over(ahead))
    near = near.where("__side = 0")
    same = F.col("__b") == F.col("__ob")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__o{i}"))
    near = near.join(edges, same, "left")
    known = F.lit(True)
    for k in [*keys, "__p"]:
        known = known & F.col(k).isNotNull()
    prev = F.when(known, F.coalesce("__prev", "__before")) if side != "forward" else None
    then = F.when(known, F.coalesce("__next", "__after")) if side != "backward" else None
    if side == "nearest":
        far = lambda x: F.abs(x["__p"] - F.col("__p"))
        met = F.when(then.isNull() | (far(prev) <= far(then)), prev).otherwise(then)
    else:
        met = prev if side == "backward" else then
    near = near.select("__l", met["__r"].alias("__m"))
    return near.select(*[F.col(f"__l.l{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"__m.t{i}").alias(c) for i, c in enumerate(take)])


def band_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, by: list[str] | None = None) -> DataFrame:
    """Pairs of a point and an interval that holds it: all columns of both, for low <= at < high and equal `by` columns.

    An interval is put in bins as wide as the next power of two of its own length, so in two bins at most, whatever the
    lengths; a point looks into its bin of each width that occurs (64 widths at most). So there is an equality join on (by, width,
    bin), which Spark can split if skewed, and an exact check. Nulls and empty intervals pair with nothing; repeated rows pair
    each. The two have no column in common but those of `by`, which are kept once.
    """
    by = by or []
    a, z = place(intervals, low).cast("double"), place(intervals, high).cast("double")
    spans = intervals.withColumns({"__a": a, "__z": z}).where("__a < __z")
    spans = spans.withColumn("__w", F.greatest(F.ceil(F.log2(F.col("__z") - F.col("__a"))), F.lit(0)).cast("int"))
    bin_of = lambda x: F.floor(F.col(x) / F.pow(F.lit(2.0), F.col("__w"))).cast("long")
    spans = spans.withColumn("__bin", F.explode(F.sequence(bin_of("__a"), bin_of("__z"))))
    widths = F.broadcast(spans.select("__w").distinct())  # at most 64 rows, as a double's exponent within a long
    looked = points.withColumn("__at", place(points, at).cast("double")).where("__at IS NOT NULL").crossJoin(widths).withColumn("__bin", bin_of("__at"))
    met = looked.join(spans, [*by, "__w", "__bin"]).where("__a <= __at AND __at < __z")
    return met.drop("__a", "__z", "__w", "__bin", "__at")


def sessions(events: DataFrame, actor: str, ts: str, gap_seconds: float, width_seconds: float) -> DataFrame:
    """(actor, session, n, started, ended): an actor's events of which none is more than gap_seconds after the one before it.

    Sessions are numbered from 1. Events are dealt out by actor and stretches of width_seconds, so a hot actor is shared out
    over its time; sessions are cut at the edges of stretches, where the last event before (from a table of one row an
    actor and stretch) tells whether the first one goes on, and the parts of one session are then added up. Rows without an
    actor or a time are left out.
    """
    one = events.select(F.col(actor).alias("actor"), F.col(ts).alias("ts"), place(events, ts).alias("p")).where("actor IS NOT NULL AND p IS NOT NULL")
    one = one.withColumn("b", F.floor(F.col("p") / F.lit(width_seconds * 1e6)).cast("long"))
    along = Window.partitionBy("actor").orderBy("b")
    edges = one.groupBy("actor", "b").agg(F.max("p").alias("last")).withColumn("before", F.lag("last").over(along)).drop("last")
    inside = Window.partitionBy("actor", "b").orderBy("p")
    # Session numbers within a stretch count from its first event; whether that one goes on is settled below.
    new = F.coalesce((F.col("p") - F.lag("p").over(inside) > F.lit(gap_seconds * 1e6)).cast("int"), F.lit(0))
    counted = one.withColumn("new", new).withColumn("k", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = counted.groupBy("actor", "b", "k").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.min("p").alias("p"))
    starts = parts.groupBy("actor", "b").agg(F.max("k").alias("more"), F.min("p").alias("first")).join(edges, ["actor", "b"])
    starts = starts.withColumn("fresh", (F.col("before").isNull() | (F.col("first") - F.col("before") > F.lit(gap_seconds * 1e6))).cast("long"))
    starts = starts.withColumn("base", F.sum(F.col("fresh") + F.col("more")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("more")).select("actor", "b", "base")
    return parts.join(starts, ["actor", "b"]).groupBy("actor", (F.col("base") + F.col("k")).alias("session")).agg(F.sum("n").alias("n"), F.min("started").alias("started"), F.max("ended").alias("ended"))
