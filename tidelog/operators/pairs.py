"""Pairing records of two sources within a time window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.columns import field, micros
from tidelog.plans.ordered import OrderedScan
from tidelog.specs import Spec, positive_window, require


@dataclass(frozen=True)
class PairRule(Spec):
    """``output_field`` nests the right record instead of merging it over the left."""

    left_source: str
    right_source: str
    key_field: str
    window: str | float
    output_field: str = ""

    def __post_init__(self):
        require(bool(self.left_source), "join: left_source must not be empty")
        require(bool(self.right_source), "join: right_source must not be empty")
        require(bool(self.key_field), "join: key_field must not be empty")
        positive_window(self.window)


def pair_join(
    df: DataFrame, rule, *, source: str = "source", ts: str = "ts", row_id: str = "id",
    fields: list[str] | None = None, rows_per_task: int | None = None,
) -> DataFrame:
    """One-to-one pairs of a left and a right record with the same key.

    A record waits up to the window (inclusive); a newer one of its side takes
    its place; a match uses both up. ``fields`` are the record's columns (all by
    default). The result has the key, ``left_*`` / ``right_*`` id and time, and
    the merged record.
    """
    rule = PairRule.parse(rule)
    width = positive_window(rule.window)
    names = [c for c in (fields or df.columns) if c != rule.key_field]
    record = F.struct(*[field(n).alias(n) for n in names])
    rows = df.filter(
        field(source).isin(rule.left_source, rule.right_source) & field(rule.key_field).isNotNull()
    ).select(
        field(rule.key_field).alias("__key"),
        micros(ts).alias("__t"),
        field(row_id).alias("__id"),
        (field(source) == rule.left_source).alias("__left"),
        field(ts).alias("__ts"),
        record.alias("__rec"),
    )
    scan = OrderedScan.open(rows, ["__key"], ["__t", "__id"], rows_per_task=rows_per_task)
    scan = scan.lag(
        __pt=F.col("__t"), __pid=F.col("__id"), __pleft=F.col("__left"), __pts=F.col("__ts"), __prec=F.col("__rec")
    )
    # Rows linked to their predecessor form runs of alternating sides; in a run
    # the 2nd, 4th, ... row takes its predecessor.
    linked = (F.col("__left") != F.col("__pleft")) & (F.col("__t") - F.col("__pt") <= width)
    scan = scan.with_df(scan.df.withColumn("__linked", F.coalesce(linked, F.lit(False))))
    scan = scan.number("__n")
    scan = scan.last(__head=F.when(~F.col("__linked"), F.col("__n")))
    pairs = scan.result().filter((F.col("__n") - F.col("__head")) % 2 == 1)

    def side(left: bool, here: str, before: str) -> Column:
        return F.when(F.col("__left") == left, F.col(here)).otherwise(F.col(before))

    left_rec, right_rec = side(True, "__rec", "__prec"), side(False, "__rec", "__prec")
    head = [
        F.col("__key").alias(rule.key_field),
        side(True, "__id", "__pid").alias("left_id"),
        side(False, "__id", "__pid").alias("right_id"),
        side(True, "__ts", "__pts").alias("left_ts"),
        side(False, "__ts", "__pts").alias("right_ts"),
    ]
    if rule.output_field:
        body = [left_rec.getField(n).alias(n) for n in names if n != rule.output_field]
        return pairs.select(*head, *body, right_rec.alias(rule.output_field))
    # A null on the right is a field the right record does not have.
    body = [F.coalesce(right_rec.getField(n), left_rec.getField(n)).alias(n) for n in names]
    return pairs.select(*head, *body)


def nearest_join(
    left: DataFrame, right: DataFrame, key: str, window, *, ts: str = "ts", row_id: str = "id",
    keep_unmatched: bool = False, rows_per_task: int | None = None,
) -> DataFrame:
    """Each left row with the nearest right row of its key within ``window``.

    Ties go to the earlier right row. Both sides are walked once in time order,
    so work and result stay linear in the input whatever the key counts.
    Columns: key, ``left_id``, ``left_ts``, ``right_id``, ``right_ts``.
    """
    width = positive_window(window)

    def side(df: DataFrame, is_left: bool) -> DataFrame:
        return df.select(
            field(key).alias("__key"), micros(ts).alias("__t"), F.lit(1 if is_left else 0).alias("__side"),
            field(row_id).alias("__id"), field(ts).alias("__ts"),
        )

    both = side(left, True).unionByName(side(right, False)).filter("__key is not null")
    partner = F.when(F.col("__side") == 0, F.struct("__t", "__id", "__ts"))
    scan = OrderedScan.open(both, ["__key"], ["__t", "__side", "__id"], rows_per_task=rows_per_task)
    scan = scan.last(__before=partner).reversed().last(__after=partner)
    back = F.col("__t") - F.col("__before.__t")
    ahead = F.col("__after.__t") - F.col("__t")
    back = F.when(back <= width, back)
    ahead = F.when(ahead <= width, ahead)
    chosen = F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.col("__before")).when(
        ahead.isNotNull(), F.col("__after")
    )
    out = scan.result().filter("__side = 1").select(
        F.col("__key").alias(key), F.col("__id").alias("left_id"), F.col("__ts").alias("left_ts"),
        chosen.getField("__id").alias("right_id"), chosen.getField("__ts").alias("right_ts"),
    )
    return out if keep_unmatched else out.filter("right_id is not null")
