"""How many open lines the original OR join gives a transaction (O10), without listing a pair.

The join is ``date in window AND (any of 7 codes equal OR |AMOUNT| among the
line's 4 amounts)``.  Lines that share codes are counted by inclusion and
exclusion: over every non-empty set S of codes, plus or minus the lines that
agree on all of S.  Lines that only share the amount come on top: over every S,
the empty one too, minus or plus the lines that have the amount and agree on S.
So a transaction needs the numbers of at most 127 + 128 groups of lines, each
up to its date.

A group is a mask of codes, their values and perhaps an amount.  The open lines
are summed up once per group: its dates with running counts if it has few, else
a running count per stretch of the calendar and the dates of each stretch under
a key of its own.  The transactions meet the groups by one equi-join on a long
key, the stretches of large groups by another, and nothing that is joined grows
with the number of lines in a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CODE_COLUMNS, MatchConfig
from ..functions.keys import money_key
from ..functions.oracle import minus_days
from ..plans.joins import checked_broadcast, materialize
from .signals import AMOUNT_COLUMNS

#: Stretches of the calendar, cut so that each has about as many open lines.
STRETCHES = 64
#: A group with up to so many different dates keeps them in its own row.
OWN_DATES = 32

_ALL = (1 << len(CODE_COLUMNS)) - 1
_PARTS = [f"_g{i}" for i in range(len(CODE_COLUMNS))]
#: What makes a group: which codes, their values, the amount (NULL where it does not matter).
_GROUP = ["_mask", "_amount", *_PARTS]


def _known_codes(names) -> Column:
    """The mask of the codes that a row has."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(names)])


def _masked(names) -> list[Column]:
    """The codes of the mask, NULL for the others."""
    return [F.when(F.col("_mask").bitwiseAND(1 << i) != 0, F.col(c)).alias(f"_g{i}") for i, c in enumerate(names)]


def _group_key() -> Column:
    return F.xxhash64(*_GROUP)


def _same_group(left: str, right: str) -> Column:
    """The groups behind two equal keys are the same; a sum, so that the key alone is what is joined on."""
    same = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")).cast("int") for c in _GROUP]
    return reduce(lambda a, b: a + b, same) == len(_GROUP)


def _calendar(open_lines: DataFrame, cfg: MatchConfig) -> list:
    """First dates of the stretches after the first."""
    floor = minus_days(F.col("DATINVOICEDATE"), cfg.grace_days)
    cuts = open_lines.agg(F.percentile_approx(floor, [i / STRETCHES for i in range(1, STRETCHES)])).first()[0]
    return sorted(set(cuts or []))


def _stretch(date: Column, cuts: list) -> Column:
    """The number of cuts that are not after the date, by halving."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        cut = F.lit(cuts[middle].isoformat(sep=" ")).cast("timestamp_ntz")
        return F.when(date >= cut, between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(cuts))


def line_groups(open_lines: DataFrame, cuts: list, cfg: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """(groups, stretches of large groups) of the open lines, as written tables."""
    known = _known_codes(CODE_COLUMNS)
    floor = minus_days(F.col("DATINVOICEDATE"), cfg.grace_days).alias("_floor")
    amounts = F.array_distinct(F.array(F.lit(None), *[money_key(F.col(c), cfg) for c in AMOUNT_COLUMNS]))
    lines = open_lines.select(*CODE_COLUMNS, floor, known.alias("_known"), F.explode(amounts).alias("_amount"))
    masks = F.explode(F.sequence(F.when(F.col("_amount").isNull(), 1).otherwise(0), F.lit(_ALL))).alias("_mask")
    lines = lines.select("*", masks).filter(F.col("_mask").bitwiseAND(F.bitwise_not("_known")) == 0)
    dated = lines.select("_mask", "_amount", *_masked(CODE_COLUMNS), "_floor").groupBy(*_GROUP, "_floor").agg(F.count("*").alias("_n"))

    of_group = Window.partitionBy(*_GROUP)
    stretch = F.when(F.count("*").over(of_group) > OWN_DATES, _stretch(F.col("_floor"), cuts))
    dated = dated.withColumn("_stretch", stretch)
    of_part = Window.partitionBy(*_GROUP, "_stretch")
    dated = dated.withColumn("_upto", F.sum("_n").over(of_part.orderBy("_floor")))
    dates = F.sort_array(F.collect_list(F.struct("_floor", "_upto")))
    parts = dated.groupBy(*_GROUP, "_stretch").agg(dates.alias("_dates"), F.sum("_n").alias("_n"))
    parts = materialize(parts.withColumn("_key", _group_key()), "line-groups")

    large = parts.filter(F.col("_stretch").isNotNull())
    counts = F.map_from_entries(F.collect_list(F.struct("_stretch", "_n")))
    each = F.transform(F.sequence(F.lit(0), F.lit(len(cuts))), lambda i: F.coalesce(F.element_at("_counts", i), F.lit(0)))
    add = lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n))
    before = F.aggregate(each, F.array(F.lit(0).cast("long")), add)
    sums = large.groupBy("_key", *_GROUP).agg(counts.alias("_counts")).select("_key", *_GROUP, before.alias("_before"))
    none = F.lit(None)
    groups = parts.filter(F.col("_stretch").isNull()).select("_key", *_GROUP, "_dates", none.cast("array<bigint>").alias("_before"))
    groups = groups.unionByName(sums.select("_key", *_GROUP, none.cast(parts.schema["_dates"].dataType).alias("_dates"), "_before"))
    stretches = large.select(F.xxhash64("_key", "_stretch").alias("_part_key"), "_stretch", *_GROUP, "_dates")
    return materialize(groups, "groups"), stretches


def _count_upto(dates: Column) -> Column:
    """The running count at the last of the dates that is not after TRANDATE."""
    met = F.filter(dates, lambda d: d["_floor"] <= F.col("TRANDATE"))
    return F.coalesce(F.element_at(F.when(F.size(met) > 0, met), -1)["_upto"], F.lit(0))


def candidate_counts(tx: DataFrame, open_lines: DataFrame, cfg: MatchConfig, name: str = "n_lines") -> DataFrame:
    """(TranID, ``name``): for each row of ``tx`` the number of open lines that the OR join pairs it with.

    Every row is counted by itself, also where ids repeat or are NULL; a row
    without a date has no line.  Exact at any size: the groups are broadcast
    behind a measured bound and joined by shuffles above it.
    """
    cuts = _calendar(open_lines, cfg)
    groups, stretches = line_groups(open_lines, cuts, cfg)
    open_amounts = groups.filter("_amount IS NOT NULL AND _mask = 0").select(F.col("_amount").alias("_open_amount"))
    open_amounts, _ = checked_broadcast(open_amounts, cfg.broadcast_max_rows, cfg.broadcast_max_bytes)
    groups, _ = checked_broadcast(groups, cfg.broadcast_max_rows, cfg.broadcast_max_bytes)
    stretches, _ = checked_broadcast(stretches, cfg.broadcast_max_rows, cfg.broadcast_max_bytes)

    rows = tx.select("TranID", "TRANDATE", *CODE_COLUMNS, money_key(F.abs(F.col("AMOUNT")), cfg).alias("_own_amount"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_known", _known_codes(CODE_COLUMNS))
    rows = rows.join(open_amounts, F.col("_own_amount") == F.col("_open_amount"), "left")
    # Masks without the amount, then, where some line has it, the same with it; 0 stands for a row without any group.
    last = F.when(F.col("_open_amount").isNotNull(), F.lit(2 * _ALL + 1)).otherwise(F.lit(_ALL))
    keyed = rows.withColumn("_set", F.explode(F.sequence(F.lit(0), last))).withColumn("_mask", F.col("_set").bitwiseAND(_ALL))
    keyed = keyed.filter(F.col("_mask").bitwiseAND(F.bitwise_not("_known")) == 0)
    keyed = keyed.select("TranID", "TRANDATE", "_row", "_set", "_mask", F.when(F.col("_set") > _ALL, F.col("_open_amount")).alias("_amount"), *_masked(CODE_COLUMNS))
    keyed = keyed.withColumn("_key", F.when(F.col("_set") > 0, _group_key()))
    met = keyed.alias("t").join(groups.alias("g"), (F.col("t._key") == F.col("g._key")) & _same_group("t", "g"), "left")
    met = met.select("t.*", "g._dates", "g._before", _stretch(F.col("TRANDATE"), cuts).alias("_at"))
    part_key = F.when(F.col("_before").isNotNull(), F.xxhash64("_key", F.col("_at")))
    met = met.withColumn("_part_key", part_key).alias("t")
    same = (F.col("t._part_key") == F.col("s._part_key")) & _same_group("t", "s") & (F.col("t._at") - F.col("s._stretch") == 0)
    met = met.join(stretches.alias("s"), same, "left").select("t.*", F.col("s._dates").alias("_part_dates"))

    n = F.when(F.col("_before").isNull(), _count_upto(F.col("_dates"))).otherwise(F.get("_before", F.col("_at")) + _count_upto(F.col("_part_dates")))
    odd = F.bit_count("_mask") % 2 == 1
    plus = F.when(F.col("_set") > _ALL, ~odd).otherwise(odd)
    counted = met.select("TranID", "_row", F.when(plus, n).otherwise(-n).alias("_n"))
    return counted.groupBy("_row", "TranID").agg(F.sum("_n").cast("bigint").alias(name)).drop("_row")

