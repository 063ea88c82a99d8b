"""Rule application as one projection.

A rule list is applied to an :class:`Env`, a name-to-expression view of a
DataFrame. Later rules see what earlier rules wrote, and the whole list becomes
a single ``select``. Rule sets of single sources become one CASE per column.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.columns import field
from tidelog.specs import Scoped

Build = Callable[["Env", Any], None]


class Env:
    def __init__(self, df: DataFrame):
        self.columns: dict[str, Column] = {f.name: field(f.name) for f in df.schema.fields}
        self.types: dict[str, T.DataType] = {f.name: f.dataType for f in df.schema.fields}
        self.touched: set[str] = set()

    def __contains__(self, name: str) -> bool:
        return name in self.columns

    def get(self, name: str) -> Column | None:
        return self.columns.get(name)

    def text(self, name: str) -> Column | None:
        """The column if it is a string column."""
        return self.columns[name] if isinstance(self.types.get(name), T.StringType) else None

    def put(self, name: str, value: Column, dtype: T.DataType | None = None) -> None:
        self.columns[name] = value
        self.types[name] = dtype or T.StringType()
        self.touched.add(name)

    def drop(self, name: str) -> None:
        if self.columns.pop(name, None) is not None:
            self.types.pop(name)
            self.touched.add(name)


def project(df: DataFrame, env: Env) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in env.columns.items()])


def apply_rules(
    df: DataFrame, build: Build, rules: Any, layered: str | None = None
) -> DataFrame:
    """Apply ``rules`` (or a :class:`Scoped` of them) with ``build``.

    ``layered``: ``"after"`` runs a source's rules after the default ones,
    ``"before"`` runs them first; by default they replace the default.
    """
    scoped = Scoped.of(rules)
    base = Env(df)
    if scoped.default is not None:
        build(base, scoped.default)
    if not scoped.by_source:
        return project(df, base)

    variants: list[tuple[str, Env]] = []
    for source, own in scoped.by_source.items():
        env = Env(df)
        order = [own]
        if layered and scoped.default is not None:
            order = [scoped.default, own] if layered == "after" else [own, scoped.default]
        for part in order:
            build(env, part)
        variants.append((source, env))

    everything = [base, *[env for _, env in variants]]
    names = list(dict.fromkeys(n for env in everything for n in env.columns))
    touched = set().union(*[env.touched for env in everything])
    where = field(scoped.source)
    out = []
    for name in names:
        if name not in touched:
            out.append(field(name).alias(name))
            continue
        types = [env.types[name] for env in everything if name in env.types]
        target = types[0] if all(t == types[0] for t in types) else T.StringType()

        def value(env: Env) -> Column:
            return env.columns[name].cast(target) if name in env.columns else F.lit(None).cast(target)

        (first, env), *others = variants
        cases = F.when(where == first, value(env))
        for source, env in others:
            cases = cases.when(where == source, value(env))
        out.append(cases.otherwise(value(base)).alias(name))
    return df.select(*out)
