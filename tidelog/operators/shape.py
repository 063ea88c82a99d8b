"""Projection and reshaping: which fields a record has and how they are laid out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.columns import field, let
from tidelog.functions.patterns import java_pattern, replace_all
from tidelog.operators.env import Env, apply_rules
from tidelog.plans.sizing import staged
from tidelog.specs import Scoped, Spec, parse_all, require


@dataclass(frozen=True)
class TransformRule(Spec):
    op: str
    field: str
    value: str = ""
    new_name: str = ""
    pattern: str = ""

    def __post_init__(self):
        require(self.op in ("add", "remove", "rename", "replace"), f"transform: unknown op {self.op!r}")
        require(bool(self.field), "transform: missing field")
        require(self.op != "rename" or bool(self.new_name), "transform: rename needs new_name")
        if self.pattern:
            java_pattern(self.pattern)


def _transform(env: Env, rules) -> None:
    for rule in parse_all(TransformRule, rules):
        present = rule.field in env
        if rule.op == "add":
            env.put(rule.field, F.lit(rule.value))
        elif rule.op == "remove":
            env.drop(rule.field)
        elif rule.op == "rename" and present and rule.new_name != rule.field:
            value, dtype = env.columns[rule.field], env.types[rule.field]
            if rule.new_name in env and env.types[rule.new_name] == dtype:
                # A record without the old name keeps what it has under the new one.
                value = F.coalesce(value, env.columns[rule.new_name])
            env.put(rule.new_name, value, dtype)
            env.drop(rule.field)
        elif rule.op == "replace" and present:
            value = env.columns[rule.field]
            if rule.pattern:
                env.put(rule.field, replace_all(value.cast("string"), rule.pattern, rule.value))
            else:
                env.put(rule.field, F.when(value.isNotNull(), F.lit(rule.value)))


def transform(df: DataFrame, rules) -> DataFrame:
    """Add, remove, rename, replace; a source's rules run after the default ones."""
    return apply_rules(df, _transform, rules, layered="after")


@dataclass(frozen=True)
class TagRule(Spec):
    field: str
    value: str
    overwrite: bool = False

    def __post_init__(self):
        require(bool(self.field), "tag: field must not be empty")


def _tag(env: Env, rules) -> None:
    for rule in parse_all(TagRule, rules, needed=True):
        value = F.lit(rule.value)
        if rule.field in env and not rule.overwrite:
            value = F.coalesce(env.columns[rule.field].cast("string"), value)
        env.put(rule.field, value)


def tag(df: DataFrame, rules) -> DataFrame:
    """Constant fields; existing values stay unless ``overwrite``."""
    return apply_rules(df, _tag, rules)


def _enrich(env: Env, constants) -> None:
    for name, value in constants.items():
        require(bool(name), "enrich: empty field name")
        present = F.coalesce(env.columns[name].cast("string"), F.lit(value)) if name in env else F.lit(value)
        env.put(name, present)


def enrich(df: DataFrame, constants) -> DataFrame:
    """Constant fields where a record has none; a source's constant beats the default's."""
    return apply_rules(df, _enrich, constants, layered="before")


@dataclass(frozen=True)
class CoalesceRule(Spec):
    sources: tuple[str, ...] | list[str]
    dest: str
    keep_sources: bool = False

    def __post_init__(self):
        require(bool(self.sources), "coalesce: sources must not be empty")
        require(bool(self.dest), "coalesce: dest must not be empty")


def _coalesce(env: Env, rules) -> None:
    for rule in parse_all(CoalesceRule, rules, needed=True):
        present = [s for s in rule.sources if s in env]
        if not present:
            continue
        types = {env.types[s].simpleString() for s in present}
        dtype = env.types[present[0]] if len(types) == 1 else T.StringType()
        options = [
            F.nullif(env.columns[s], F.lit("")) if env.text(s) is not None else env.columns[s].cast(dtype)
            for s in present
        ]
        chosen = F.coalesce(*options)
        if rule.dest in env:
            before = env.columns[rule.dest].cast(dtype)
            chosen_or_before = F.coalesce(chosen, before)
        else:
            chosen_or_before = chosen
        kept = {s: env.columns[s] for s in present}
        env.put(rule.dest, chosen_or_before, dtype)
        if not rule.keep_sources:
            for name in present:
                if name != rule.dest:
                    # Sources go only where something was chosen: that is, where
                    # any value is left, an empty text may stay.
                    env.put(name, F.when(chosen.isNull(), kept[name]), env.types[name])


def coalesce_fields(df: DataFrame, rules) -> DataFrame:
    """First non-empty source field into ``dest``; its sources are emptied unless kept."""
    return apply_rules(df, _coalesce, rules)


@dataclass(frozen=True)
class FlattenRule(Spec):
    """``prefix="@field"`` stands for the field's own name."""

    field: str
    prefix: str = ""
    separator: str = "."
    drop_source: bool = False

    def __post_init__(self):
        require(bool(self.field.strip()), "flatten: field must not be blank")


def _leaves(value: Column, dtype: T.StructType, prefix: str, sep: str):
    for part in dtype.fields:
        name = f"{prefix}{sep}{part.name}" if prefix else part.name
        inner = value.getField(part.name)
        if isinstance(part.dataType, T.StructType):
            yield from _leaves(inner, part.dataType, name, sep)
        else:
            yield name, inner, part.dataType


# Columns that leaves of open records may become; beyond that take :func:`flatten_open`'s map.
MOST_LEAVES = 10_000

# Parts of a leaf's path while its separator is not yet known.
BETWEEN = "\x00"


def _leaf_type(seen: list[str]) -> str:
    """One type for a leaf that was seen as these (as VARIANT names its types)."""
    kinds = {k for k in seen if k != "VOID"}
    if len(kinds) == 1 and not next(iter(kinds)).startswith(("ARRAY", "OBJECT")):
        return kinds.pop().lower()
    if kinds and all(k in ("BIGINT", "DOUBLE") or k.startswith("DECIMAL") for k in kinds):
        return "double"
    return "string"


def _flatten_observed(observed: dict[str, list[tuple[str, str]]]):
    """``observed``: the leaves of VARIANT columns, as paths and types; their values are in columns beside them."""

    def build(env: Env, rules) -> None:
        for rule in parse_all(FlattenRule, rules, needed=True):
            dtype = env.types.get(rule.field)
            separator = rule.separator or "."
            prefix = rule.field if rule.prefix == "@field" else rule.prefix
            if isinstance(dtype, T.VariantType) and rule.field in observed:
                held = F.col(f"`__open_{rule.field}`")
                head = prefix + separator if prefix else ""
                leaves = []
                for path, kind in observed[rule.field]:
                    value = F.try_element_at(held, F.lit(path))
                    value = value.cast("string") if kind == "string" else F.try_variant_get(value, "$", kind)
                    leaves.append((head + path.replace(BETWEEN, separator), value, T.StructType.fromDDL(f"x {kind}")["x"].dataType))
            elif isinstance(dtype, T.StructType):
                leaves = list(_leaves(env.columns[rule.field], dtype, prefix, separator))
            else:
                continue
            for name, leaf, leaf_type in leaves:
                if name in env and name != rule.field and env.types[name] == leaf_type:
                    leaf = F.coalesce(leaf, env.columns[name])
                env.put(name, leaf, leaf_type)
            if rule.drop_source:
                env.drop(rule.field)

    return build


def flatten(df: DataFrame, rules) -> DataFrame:
    """Nested leaves as columns named ``prefix + separator + path``.

    Works on structs, and on VARIANT columns of tables, whose leaves are first
    found in the data: at any depth, and each record by its own shape, so a
    field that is an object here and a value there gives columns for both. A
    leaf keeps its type if it has one throughout, numbers of several types
    become doubles, anything else and lists are text. Streams declare theirs
    (:func:`flatten_variant`) or take a map (:func:`open_leaves`).
    """
    scoped = Scoped.of(rules)
    given = [r for part in (scoped.default, *scoped.by_source.values()) if part is not None for r in parse_all(FlattenRule, part)]
    open_ = sorted({r.field for r in given if r.field in df.columns and isinstance(df.schema[r.field].dataType, T.VariantType)})
    require(not (open_ and df.isStreaming), f"flatten: the leaves of {open_} are not known on a stream")
    observed = {}
    for name in open_:
        df = _open_entries(df, name, f"__open_{name}", "", BETWEEN)
        entry = F.explode(F.col(f"`__open_{name}`")).alias("e")
        seen = df.select(entry).groupBy("e.key").agg(F.collect_set(F.schema_of_variant("e.value")).alias("kinds")).limit(MOST_LEAVES + 1).collect()
        require(len(seen) <= MOST_LEAVES, f"flatten: {name} has more than {MOST_LEAVES} leaves; take flatten_open")
        observed[name] = sorted((r["key"], _leaf_type(r["kinds"])) for r in seen)
        df = df.withColumn(f"__open_{name}", F.map_from_entries(F.col(f"`__open_{name}`")))
    return apply_rules(df, _flatten_observed(observed), rules).drop(*[f"__open_{name}" for name in open_])


def flatten_variant(df: DataFrame, column: str, paths: dict[str, str], prefix: str = "", separator: str = ".") -> DataFrame:
    """Declared leaves (``path -> type``) of a VARIANT column as columns.

    A leaf that is missing or does not fit its type is null.
    """
    head = f"{prefix}{separator}" if prefix else ""
    leaves = {
        head + path.replace(".", separator): F.try_variant_get(field(column), "$." + path, dtype)
        for path, dtype in paths.items()
    }
    return df.withColumns(leaves)


def _children(held: Column) -> Column:
    return F.map_entries(F.try_variant_get(held, "$", "map<string,variant>"))


def _entries(value: Column, prefix: str, separator: str) -> Column:
    """The fields of an object as entries; null if it is none."""
    return _renamed(_children(value), F.lit(prefix), separator) if prefix else _children(value)


def _renamed(entries: Column, path: Column, separator: str) -> Column:
    return F.transform(entries, lambda e: F.struct(F.concat(path, F.lit(separator), e["key"]).alias("key"), e["value"].alias("value")))


def _deeper(entries: Column, separator: str) -> Column:
    """Every entry that is an object replaced by its fields."""

    def expand(entry: Column) -> Column:
        below = _renamed(_children(entry["value"]), entry["key"], separator)
        return F.coalesce(below, F.array(F.struct(entry["key"].alias("key"), entry["value"].alias("value"))))

    return F.flatten(F.transform(entries, expand))


def _objects_left(entries: Column) -> Column:
    return F.exists(entries, lambda e: F.try_variant_get(e["value"], "$", "map<string,variant>").isNotNull())


def _texts(entries: Column) -> Column:
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].cast("string").alias("value"))))


def open_leaves(value: str | Column, prefix: str = "", separator: str = ".", depth: int = 8) -> Column:
    """All leaves of a VARIANT object as ``map<string,string>``, names as in :func:`flatten`.

    A value that is no object gives null. One expression, so it fits streams
    too, but goes ``depth`` levels below the first; a deeper object is an
    error. :func:`flatten_open` goes as deep as the data.
    """
    entries = _entries(F.col(value) if isinstance(value, str) else value, prefix, separator)
    for _ in range(depth):
        entries = _deeper(entries, separator)
    too_deep = F.raise_error(F.lit(f"open_leaves: an object lies more than {depth} levels down")).cast("map<string,string>")
    return let(entries, lambda e: F.when(F.coalesce(_objects_left(e), F.lit(False)), too_deep).otherwise(_texts(e)))


def _open_entries(df: DataFrame, column: str, dest: str, prefix: str, separator: str, levels: int = 4) -> DataFrame:
    """``df`` with the leaves of a VARIANT column as entries ``dest``, staged.

    Entries that are objects are replaced by their fields, ``levels`` times in
    one pass, until a pass leaves none. Each pass is written once and asked
    whether objects are left; rows never move.
    """
    held = df.withColumn(dest, _entries(field(column), prefix, separator))
    while True:
        entries = field(dest)
        for _ in range(levels):
            entries = _deeper(entries, separator)
        held = staged(held.withColumn(dest, entries))
        if held.filter(_objects_left(field(dest))).isEmpty():
            return held


def flatten_open(df: DataFrame, column: str, dest: str = "fields", prefix: str = "", separator: str = ".", levels: int = 4) -> DataFrame:
    """``df`` with all leaves of a VARIANT column as map ``dest`` of texts, at any depth; null where it holds no object."""
    require(not df.isStreaming, "flatten_open: streams take open_leaves")
    require(1 <= levels <= 16, "flatten_open: levels must be 1 to 16, as one expression holds them")
    held = _open_entries(df, column, "__entries", prefix, separator, levels)
    return held.withColumn(dest, _texts(F.col("__entries"))).drop("__entries")


@dataclass(frozen=True)
class UnwrapRule(Spec):
    """``keys`` names the entries to promote from a map column."""

    field: str
    prefix: str = ""
    remove: bool = False
    keys: tuple[str, ...] | list[str] = ()

    def __post_init__(self):
        require(bool(self.field.strip()), "unwrap: field must not be blank")


def _locate(env: Env, name: str) -> tuple[Column | None, T.DataType | None]:
    """A column by literal name, else a dotted path into a struct."""
    if name in env:
        return env.columns[name], env.types[name]
    head, *path = name.split(".")
    value, dtype = env.get(head), env.types.get(head)
    for part in path:
        if not isinstance(dtype, T.StructType) or part not in dtype.names:
            return None, None
        value, dtype = value.getField(part), dtype[part].dataType
    return value, dtype


def _unwrap(env: Env, rules) -> None:
    for rule in parse_all(UnwrapRule, rules, needed=True):
        value, dtype = _locate(env, rule.field)
        if isinstance(dtype, T.StructType):
            parts = [(f.name, value.getField(f.name), f.dataType) for f in dtype.fields]
        elif isinstance(dtype, T.MapType):
            parts = [(k, F.try_element_at(value, F.lit(k)), dtype.valueType) for k in rule.keys]
        else:
            continue
        for name, part, part_type in parts:
            name = rule.prefix + name
            if name in env and env.types[name] == part_type:
                part = F.coalesce(part, env.columns[name])
            env.put(name, part, part_type)
        if rule.remove and rule.field not in [rule.prefix + n for n, _, _ in parts]:
            env.drop(rule.field)


def unwrap(df: DataFrame, rules) -> DataFrame:
    """Promote the fields one level below ``field``; names get ``prefix`` as it stands."""
    return apply_rules(df, _unwrap, rules)


def merge_map(fields: str | Column, nested: str | Column) -> Column:
    """Unwrap in map form: the entries of ``nested`` over those of ``fields``."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_concat(F.coalesce(fields, empty), F.coalesce(nested, empty))


def split_array(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """One row per element, with its index as text.

    A null array keeps its single row without an index; an empty one gives none.
    """
    require(bool(column), "split: field must not be empty")
    index = f"{prefix}_index" if prefix else "_index"
    if column not in df.columns or not isinstance(df.schema[column].dataType, T.ArrayType):
        return df
    value = field(column)
    others = [field(c) for c in df.columns if c not in (column, index)]
    rows = df.filter(value.isNull() | (F.size(value) > 0))
    exploded = rows.select(*others, F.posexplode_outer(value).alias("__pos", "__element"))
    kept = [c for c in df.columns if c != index]
    out = [F.col("__element").alias(c) if c == column else field(c) for c in kept]
    return exploded.select(*out, F.col("__pos").cast("string").alias(index))


def fingerprint(df: DataFrame, fields: list[str] | None = None, separator: str = "", dest: str = "fingerprint") -> DataFrame:
    """SHA-256 of the field texts; a missing field counts as ``<nil>``."""
    require(all(f.strip() for f in fields or []), "fingerprint: field name must not be blank")
    names = fields or sorted(df.columns)
    parts = [
        F.coalesce(field(n).cast("string"), F.lit("<nil>")) if n in df.columns else F.lit("<nil>") for n in names
    ]
    return df.withColumn(dest, F.sha2(F.concat_ws(separator or "|", *parts), 256))
