"""Composing operators: one stage, or a list of steps, as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from tidelog.operators import filters, multiline, numbering, parse, render, route, shape, suppress, values
from tidelog.specs import require

Step = Callable[[DataFrame], DataFrame]

# Operators a step can name. Each takes the rows and the rest of the step's keys.
NAMED = {
    "parse": parse.parse_lines,
    "promote": parse.promote,
    "filter": filters.filter_rules,
    "validate": filters.validate_schema,
    "sample": filters.sample,
    "transform": shape.transform,
    "tag": shape.tag,
    "enrich": shape.enrich,
    "coalesce": shape.coalesce_fields,
    "flatten": shape.flatten,
    "unwrap": shape.unwrap,
    "split": shape.split_array,
    "fingerprint": shape.fingerprint,
    "cast": values.cast,
    "normalize": values.normalize,
    "truncate": values.truncate,
    "timestamp": values.normalize_timestamp,
    "redact": values.redact,
    "mask": values.mask,
    "classify": values.classify,
    "multiline": multiline.assemble_multiline,
    "dedupe": suppress.dedupe,
    "debounce": suppress.debounce,
    "uniq": suppress.uniq,
    "rate_limit": suppress.rate_limit,
    "ceiling": suppress.ceiling,
    "sequence": numbering.sequence,
    "batch": numbering.assign_batches,
    "retain": numbering.retain_bounded,
    "route": route.route,
    "render": render.render,
}


def step_of(spec: Step | Mapping[str, Any]) -> Step:
    """A callable step, from a function or ``{"op": name, **arguments}``."""
    if callable(spec):
        return spec
    arguments = dict(spec)
    name = arguments.pop("op", None)
    require(name in NAMED, f"flow: unknown op {name!r}")
    return lambda df: NAMED[name](df, **arguments)


class Flow:
    """Steps applied in order to a table or (stateless steps) a stream."""

    def __init__(self, steps: Sequence[Step | Mapping[str, Any]]):
        self.steps = [step_of(s) for s in steps]

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.transform(step)
        return df


def run_stage(
    df: DataFrame, source: str, write: Callable[[DataFrame], None], *, allow: Step | None = None, change: Step | None = None
) -> None:
    """Filter, transform and write one source; errors name the source."""
    for what, step in (("filter", allow), ("transform", change)):
        if step is not None:
            try:
                df = df.transform(step)
            except Exception as error:
                raise RuntimeError(f"{what} [{source}]: {error}") from error
    try:
        write(df)
    except Exception as error:
        raise RuntimeError(f"sink [{source}]: {error}") from error


def run_flow(lines: DataFrame, rules, write: Callable[[DataFrame], None]) -> None:
    """Lines through field extraction and filter rules to a sink.

    Without rules no fields are extracted.
    """
    if rules:
        from pyspark.sql import functions as F

        kept = lines.withColumn("fields", parse.extract_kv(F.col("line")))
        lines = filters.filter_rules(kept, rules, fields="fields").drop("fields")
    write(lines)
