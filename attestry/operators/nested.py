"""Deeply nested JSON records to related flat tables.

The payload is parsed into a VARIANT. A merged schema is inferred over all rows
and walked recursively: members of objects become columns, every array level is
exploded into a child table, and each child carries the key of its parent and
its ordinal within the parent. Sets and items of evidence come in two forms
each, so their levels are named here; their members are inferred like all others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.session import shared_checkpoint

# Labels of a valid claim record, and the order of a list-form item.
KNOWN_LABELS = ("SUPPORTS", "REFUTES", "NOT ENOUGH INFO")
ITEM_FIELDS = ("annotation_id", "evidence_id", "wiki_page", "sentence_id")


def whole_json(text: Column) -> Column:
    """The text as VARIANT, or null if it is not one JSON value from its start to its end.

    The parser stops after the first value, so the text is parsed as the first of two in an array; the second is
    the text's own hash, which what follows a value in the text cannot hold.
    """
    mark = F.xxhash64(text)
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]"))), "$", "array<variant>")
    return F.when((F.size(both) == 2) & (F.try_variant_get(F.get(both, F.lit(1)), "$", "bigint") == mark), F.get(both, F.lit(0)))


def is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def as_array(v: Column, unwrap: str | None = None) -> Column:
    """The array of variants in ``v``, or in its member ``unwrap`` if ``v`` is an object; else null."""
    plain = F.try_variant_get(v, "$", "array<variant>")
    if unwrap is None:
        return plain
    return F.when(is_object(v), F.try_variant_get(v, f"$.{unwrap}", "array<variant>")).otherwise(plain)


def object_members(schema: str) -> dict[str, str]:
    """Top-level members of an ``OBJECT<a: T, b: U>`` schema string."""
    m = re.fullmatch(r"OBJECT<(.*)>", schema, re.S)
    members: dict[str, str] = {}
    if not m:
        return members
    depth, start, quoted, body = 0, 0, False, m[1] + ","
    for i, c in enumerate(body):
        if c == "`":
            quoted = not quoted
        elif not quoted:
            depth += (c == "<") - (c == ">")
            if c == "," and depth == 0:
                name, _, kind = body[start:i].strip().rpartition(": ") if "<" not in body[start:i] else body[start:i].strip().partition(": ")
                members[name.strip("`")] = kind
                start = i + 1
    return members


def explode_level(parent: DataFrame, keys: list[str], array: str, ordinal: str, value: str, keep_childless: bool = False) -> DataFrame:
    """One row per array element with the parent's keys and the ordinal from 0.

    ``keep_childless`` adds a row with ordinal and value null for a parent whose array is null or empty.
    """
    explode = F.posexplode_outer if keep_childless else F.posexplode
    return parent.select(*keys, explode(F.col(array)).alias(ordinal, value))


@dataclass
class Level:
    """A table of the walk: ``rows`` holds its keys and the VARIANT ``value``.

    columns: name, path in ``value`` and kind of each scalar, in the order found. taken: names in use, lower-case.
    """

    name: str
    keys: list[str]
    rows: DataFrame
    columns: list[tuple[str, str, str]] = field(default_factory=list)
    taken: set[str] = field(default_factory=set)

    def add(self, name: str, path: str, kind: str) -> None:
        while name.lower() in self.taken:
            name += "_payload"
        self.taken.add(name.lower())
        self.columns.append((name, path, kind))

    def scalars(self) -> list[Column]:
        return [scalar(F.col("value"), path, kind).alias(name) for name, path, kind in sorted(self.columns)]


def scalar(variant: Column, path: str, kind: str) -> Column:
    """A typed scalar; of members of differing kinds the text, null where an object or array stands."""
    target = kind.lower() if re.fullmatch(r"BIGINT|STRING|BOOLEAN|DOUBLE", kind) else "string"
    if kind.startswith("DECIMAL"):
        target = "double"
    value = F.try_variant_get(variant, path, target)
    inner = F.try_variant_get(variant, path, "variant")
    return F.when(~is_object(inner) & ~is_list(inner), value) if kind == "VARIANT" else value


def member_path(path: str, name: str) -> str:
    quote = '"' if "'" in name else "'"
    return f"{path}[{quote}{name}{quote}]"


def merged_schemas(values: DataFrame) -> dict[str, list[str]]:
    """By place, the merged schemas of its objects, its arrays and its other values; from rows (place, value)."""
    value = F.col("value")
    kinds = (is_object(value), is_list(value), ~is_object(value) & ~is_list(value))
    merged = [F.schema_of_variant_agg(F.when(k, value)).alias(f"s{i}") for i, k in enumerate(kinds)]
    return {r[0]: [k for k in r[1:] if k and k != "VOID"] for r in values.where(value.isNotNull()).groupBy("place").agg(*merged).collect()}


def walk(level: Level, kind: str, path: str, name: str, levels: dict[str, Level], mixed: list[tuple[Level, str, str]], skip: tuple[str, ...] = ()) -> None:
    """Adds the columns of ``kind`` to ``level`` and a level to ``levels`` for each array; places of differing kinds go to ``mixed``."""
    if kind.startswith("OBJECT<"):
        for member, inner in sorted(object_members(kind).items()):
            if member not in skip:
                walk(level, inner, member_path(path, member), f"{name}_{member}" if name else member, levels, mixed)
    elif kind.startswith("ARRAY<"):
        table = f"{level.name}.{name or 'value'}"
        while table in levels:
            table += "_payload"
        position = f"{name or 'value'}_position"
        while position.lower() in {k.lower() for k in level.keys}:
            position += "_inner"
        rows = level.rows.select(*level.keys, F.posexplode(F.try_variant_get("value", path, "array<variant>")).alias(position, "value"))
        keys = [*level.keys, position]
        child = levels[table] = Level(table, keys, rows, taken={k.lower() for k in keys})
        walk(child, kind[6:-1], "$", "", levels, mixed)
    elif kind == "VARIANT":
        mixed.append((level, path, name))
    else:
        level.add(name or "value", path, kind)


def walk_mixed(levels: dict[str, Level], mixed: list[tuple[Level, str, str]]) -> None:
    """Walks the places of differing kinds until none is left; one pass over the data for each depth of them."""
    while mixed:
        by_level: dict[str, list[int]] = {}
        for i, (level, _, _) in enumerate(mixed):
            by_level.setdefault(level.name, []).append(i)
        parts = [
            levels[n].rows.select(F.inline(F.array(*(F.struct(F.lit(str(i)).alias("place"), F.try_variant_get("value", mixed[i][1], "variant").alias("value")) for i in places))))
            for n, places in by_level.items()
        ]
        found, further = merged_schemas(reduce(DataFrame.unionAll, parts)), []
        for i, (level, path, name) in enumerate(mixed):
            kinds = found.get(str(i), [])
            for kind in kinds:
                if kind.startswith(("OBJECT<", "ARRAY<")):
                    walk(level, kind, path, name, levels, further)
                else:  # text beside containers, and scalars of several kinds, are text
                    level.add(name or "value", path, "VARIANT")
        mixed = further


def evidence_variant(records: DataFrame, payload: str = "payload", key: str = "record_id") -> DataFrame:
    """Rows of ``key``, the parsed record ``v`` and ``sets``: array of arrays of item variants.

    Only valid payloads stay: a JSON object with a known label, a claim that is text and not blank,
    and list-form items of exactly four values. Null payloads, broken JSON and other kinds give no row.
    A set that is null, empty or of another kind becomes an empty array; so does absent evidence.
    """
    parsed = records.select(F.col(key), whole_json(F.col(payload)).alias("v")).where(is_object(F.col("v")))
    claim = F.try_variant_get(F.col("v"), "$.claim", "variant")
    label = F.try_variant_get(F.col("v"), "$.label", "variant")
    parsed = parsed.where(
        (F.schema_of_variant(label) == "STRING")
        & F.try_variant_get(F.col("v"), "$.label", "string").isin(*KNOWN_LABELS)
        & (F.schema_of_variant(claim) == "STRING")
        & F.try_variant_get(F.col("v"), "$.claim", "string").rlike(r"(?U)\S")
    )
    nested = with_sets(parsed, key)
    four = F.forall(
        F.flatten("sets"),
        lambda i: ~is_list(i) | F.coalesce(F.size(F.try_variant_get(i, "$", "array<variant>")) == len(ITEM_FIELDS), F.lit(False)),
    )
    return nested.where(four)


def with_sets(parsed: DataFrame, key: str) -> DataFrame:
    """(``key``, ``v``, ``sets``): the items of each evidence set of the record ``v``."""
    sets = F.coalesce(as_array(F.try_variant_get(F.col("v"), "$.evidence", "variant")), F.array().cast("array<variant>"))
    return parsed.select(key, "v", F.transform(sets, lambda s: F.coalesce(as_array(s, "items"), F.array().cast("array<variant>"))).alias("sets"))


def parsed_once(records: DataFrame, payload: str, key: str) -> DataFrame:
    """``evidence_variant`` with the parsed records written once: the schema and every table are read from them."""
    return with_sets(shared_checkpoint(evidence_variant(records, payload, key).select(key, "v"), "payloads"), key)


def item_field(item: Column, name: str, kind: str) -> Column:
    """A field of an item in list form (by place) or in object form (by name)."""
    return F.when(is_list(item), F.try_variant_get(item, f"$[{ITEM_FIELDS.index(name)}]", kind)).otherwise(
        F.try_variant_get(item, f"$.{name}", kind)
    )


SET_KEY, ITEM_KEY = "evidence_set_id", "evidence_item_position"


def evidence_levels(valid: DataFrame, key: str, keep_childless: bool = False) -> tuple[dict[str, Level], list[tuple[Level, str, str]]]:
    """The levels below valid payloads by the walk of their merged schema, and the places of differing kinds still to walk.

    ``keep_childless`` adds rows to ``items``, with ordinals null, for sets and records without any.
    """
    raw_sets = F.try_variant_get("v", "$.evidence", "array<variant>")
    records = valid.select(key, F.col("v").alias("value"), "sets")
    both = valid.select(key, F.arrays_zip(raw_sets.alias("value"), F.col("sets").alias("items")).alias("both"))
    outer = explode_level(both, [key], "both", SET_KEY, "s", keep_childless)
    sets = outer.select(key, SET_KEY, F.col("s.value").alias("value"), F.col("s.items").alias("items"))
    items = explode_level(sets, [key, SET_KEY], "items", ITEM_KEY, "value", keep_childless)
    levels = {
        "records": Level("records", [key], records, taken={key.lower(), "n_sets"}),
        "sets": Level("sets", [key, SET_KEY], sets, taken={key.lower(), SET_KEY, "n_items"}),
        "items": Level("items", [key, SET_KEY, ITEM_KEY], items, taken={key.lower(), SET_KEY, ITEM_KEY, *ITEM_FIELDS}),
    }
    place = lambda n, v: F.struct(F.lit(n).alias("place"), v.alias("value"))
    tagged = F.concat(
        F.array(place("records", F.col("v"))),
        F.transform(F.coalesce(raw_sets, F.array().cast("array<variant>")), lambda x: place("sets", x)),
        F.transform(F.flatten("sets"), lambda x: place("items", x)),
    )
    named, mixed = {"records": ("evidence",), "sets": ("items",), "items": ITEM_FIELDS}, []
    for n, kinds in merged_schemas(valid.select(F.inline(tagged))).items():
        for kind in kinds:
            if not kind.startswith("ARRAY<"):  # the list form of sets and items has the named levels and fields only
                walk(levels[n], kind, "$", "", levels, mixed, named[n])
    return levels, mixed


def flatten_evidence(records: DataFrame, payload: str = "payload", key: str = "record_id") -> dict[str, DataFrame]:
    """Tables ``records``, ``sets`` and ``items`` of valid payloads, and one of each further array in them.

    records: ``key``, ``n_sets`` and the members of the merged schema. sets: ``key``, ``evidence_set_id``,
    ``n_items`` and members of object-form sets. items: ``key``, ``evidence_set_id``, ``evidence_item_position``,
    the four fields and further members of object-form items. A member of a member is a column ``outer_inner``;
    a name in use gets the suffix ``_payload``. An array outside evidence is a table ``parent.outer_inner`` with
    the keys of its parent and ``outer_inner_position``, its scalars as ``value``.

    Every set finds its record and every item its set; empty records stay in ``records`` (n_sets 0) and empty
    sets in ``sets`` (n_items 0). Repeated deliveries are separate parents. Numbers in quotes are read as numbers.
    """
    levels, mixed = evidence_levels(parsed_once(records, payload, key), key)
    walk_mixed(levels, mixed)
    counts = {"records": [F.size("sets").alias("n_sets")], "sets": [F.size("items").alias("n_items")], "items": item_values(F.col("value"))}
    return {n: x.rows.select(*x.keys, *counts.get(n, []), *x.scalars()) for n, x in levels.items()}


def flat_cells(tables: dict[str, DataFrame], key: str = "record_id") -> DataFrame:
    """All tables in one: (table_name, ``key``, ordinals, column_name, cell), one row per value that is not null."""
    parts = []
    for n, df in tables.items():
        ordinals = [c for c in df.columns if c in (SET_KEY, ITEM_KEY) or re.search(r"_position(_inner)*$", c) and "." in n]
        cells = [c for c in df.columns if c != key and c not in ordinals]
        if cells:
            pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("cell")) for c in cells))
            places = F.array(*(F.col(f"`{c}`").cast("int") for c in ordinals)).cast("array<int>").alias("ordinals")
            parts.append(df.select(F.lit(n).alias("table_name"), key, places, F.inline(F.filter(pairs, lambda x: x.cell.isNotNull()))))
    return reduce(DataFrame.unionAll, parts)


def item_values(item: Column) -> list[Column]:
    return [
        item_field(item, n, "string" if n == "wiki_page" else "int" if n == "sentence_id" else "bigint").alias(n)
        for n in ITEM_FIELDS
    ]


def evidence_rows(records: DataFrame, payload: str = "payload", key: str = "record_id") -> DataFrame:
    """One row per item; an empty set gives position -1, a record without sets set -1 and position -1.

    A null or absent ``wiki_page`` is '' and a null or absent ``sentence_id`` -1.
    """
    items, value = evidence_levels(parsed_once(records, payload, key), key, keep_childless=True)[0]["items"].rows, F.col("value")
    return items.select(
        key,
        F.coalesce(SET_KEY, F.lit(-1)).alias(SET_KEY),
        F.coalesce(ITEM_KEY, F.lit(-1)).alias(ITEM_KEY),
        F.coalesce(item_field(value, "wiki_page", "string"), F.lit("")).alias("wiki_page"),
        F.coalesce(item_field(value, "sentence_id", "int"), F.lit(-1)).alias("sentence_id"),
    )
