"""JSON documents with a schema: selection, shrinking and tables as nested column expressions.

Typed columns let Catalyst prune nested fields; nothing is parsed twice.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brevia.functions.text import escape_cell

OPTIONS = {"ignoreNullFields": "false"}


def select_field(value: Column, *names: str) -> Column:
    """A field, or of an array the field of each element that has it."""
    for name in names:
        value = value[name]
    return value


def select_index(items: Column, index: int) -> Column:
    """The element at a place from 0, or from the end at -1; null if there is none."""
    return F.try_element_at(items, F.lit(index + 1 if index >= 0 else index))


def select_slice(items: Column, start: int | None = None, stop: int | None = None) -> Column:
    """The elements from start up to stop, both as in Python; never fails."""
    n = F.size(items)
    bound = lambda x: F.greatest(F.lit(0), F.least(n, n + x if x < 0 else F.lit(x)))
    low = bound(start) if start is not None else F.lit(0)
    high = bound(stop) if stop is not None else n
    return F.slice(items, low + 1, F.greatest(high - low, F.lit(0)))


def select_pick(items: Column, **names: str) -> Column:
    """Of each element a new object: alias=field, with dots for nested fields."""
    return F.transform(items, lambda x: F.struct(*[select_field(x, *path.split(".")).alias(alias) for alias, path in names.items()]))


def drop_keys(df: DataFrame, column: str, *globs: str) -> Column:
    """The struct without fields, at any depth of structs and arrays, whose name matches a glob."""

    def rebuild(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            kept = [f for f in kind.fields if not any(fnmatch.fnmatchcase(f.name, g) for g in globs)]
            return F.when(value.isNotNull(), F.struct(*[rebuild(value[f.name], f.dataType).alias(f.name) for f in kept]))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: rebuild(x, kind.elementType))
        return value

    return rebuild(F.col(column), df.schema[column].dataType)


def drop_empty(entries: Column) -> Column:
    """A map of text without null and empty values."""
    return F.map_filter(entries, lambda k, v: v.isNotNull() & (v != ""))


def max_items(items: Column, most: int) -> Column:
    """An array of text with at most so many elements and a note on the rest."""
    more = F.size(items) - most
    note = F.concat(F.lit("… "), more.cast("string"), F.lit(" more items"))
    return F.when(more > 0, F.concat(F.slice(items, 1, most), F.array(note))).otherwise(items)


def drop_lists_over(items: Column, most: int) -> Column:
    """An array as JSON, or a note in its place where it has more elements."""
    note = F.concat(F.lit('"['), F.size(items).cast("string"), F.lit(' items omitted]"'))
    return F.when(F.size(items) > most, note).otherwise(F.to_json(items, OPTIONS))


def max_str(text: Column, most: int) -> Column:
    """At most so many characters and a note on the rest."""
    more = F.char_length(text) - most
    return F.when(more > 0, F.concat(F.substring(text, 1, most), F.lit("…(+"), more.cast("string"), F.lit(" chars)"))).otherwise(text)


def flatten(df: DataFrame, column: str) -> list[Column]:
    """Columns for all leaves of a struct, named with dots."""

    def walk(value: Column, kind: T.DataType, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in kind.fields for c in walk(value[f.name], f.dataType, f"{name}.{f.name}" if name else f.name)]
        return [value.alias(name)]

    return walk(F.col(column), df.schema[column].dataType, "")


def select_run(items: Column, *names: str, index: int) -> Column:
    """The element at a place of the list that a field of all elements makes (nested lists become one)."""
    return select_index(select_field(items, *names), index)


#: The step that goes on with each element by itself.
EACH = "[]"
Step = str | int | slice | dict[str, tuple]


def select_steps(value: Column, kind: T.DataType, *steps: Step) -> tuple[Column, T.DataType] | None:
    """What a list of steps takes of a typed value, with its type; None where the type has no such part.

    A step is the name of a field, a place from 0 (or from the end at -1), a slice, ``EACH``, or a pick: a dict from new
    names to steps of their own. A field or pick of an array starts a run: it and those that follow it are taken of every
    element, and places and slices behind the run are those of the list that came out, so ("items", "name", 1) is the second
    name, while ("items", EACH, "tags", 0) is the first tag of each. Elements without a match go. A null counts as missing.
    """
    if not steps:
        return value, kind
    step, rest = steps[0], steps[1:]
    if isinstance(step, (str, dict)) and step != EACH:
        if isinstance(kind, T.ArrayType):
            run = next((k for k, s in enumerate(steps) if s == EACH or not isinstance(s, (str, dict))), len(steps))
            mapped = _of_each(value, kind, *steps[:run])
            return mapped and select_steps(*mapped, *steps[run:])
        if not isinstance(kind, T.StructType):
            return None
        if isinstance(step, str):
            return select_steps(value[step], kind[step].dataType, *rest) if step in kind.fieldNames() else None
        found = {name: select_steps(value, kind, *path) for name, path in step.items()}
        picked = {name: x for name, x in found.items() if x}
        if not picked:
            return None
        made = F.when(value.isNotNull(), F.struct(*[x.alias(name) for name, (x, _) in picked.items()]))
        return select_steps(made, T.StructType([T.StructField(name, t) for name, (_, t) in picked.items()]), *rest)
    if not isinstance(kind, T.ArrayType):
        return None
    if step == EACH:
        return _of_each(value, kind, *rest)
    if isinstance(step, slice):
        return select_steps(select_slice(value, step.start, step.stop), kind, *rest)
    return select_steps(select_index(value, step), kind.elementType, *rest)


def _of_each(items: Column, kind: T.ArrayType, *steps: Step) -> tuple[Column, T.DataType] | None:
    """The steps of every element that has them."""
    types: list[T.DataType] = []

    def one(x: Column) -> Column:
        found = select_steps(x, kind.elementType, *steps)
        if found:
            types.append(found[1])
        return found[0] if found else F.lit(None)

    made = F.array_compact(F.transform(items, one))
    return (made, T.ArrayType(types[0])) if types else None


def first_match(entries: Column, key: str) -> Column:
    """The value of the first of (k, v) with that key."""
    return F.try_element_at(F.filter(entries, lambda e: e["k"] == key), F.lit(1))["v"]


def no_match(df: DataFrame, column: str, value: Column, selection: str) -> Column:
    """Why a selection gave nothing, with the keys of the object it was taken from (at most 30) or the size of its array; else null."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StructType):
        names = kind.fieldNames()
        rest: Column = F.lit("; it has the keys " + ", ".join(names[:30] + ["…"] * (len(names) > 30)))
    elif isinstance(kind, T.ArrayType):
        rest = F.concat(F.lit("; it is an array of "), F.size(column).cast("string"), F.lit(" items"))
    else:
        rest = F.lit("")
    return F.when(value.isNull(), F.concat(F.lit(f"nothing matches {selection}"), rest))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _quoted(value: Column, kind: T.DataType = T.StringType()) -> Column:
    """A scalar as JSON: whole numbers, truth values and texts without signs that JSON escapes need no writer."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return value.cast("string")
    written = lambda v: _let(F.to_json(F.array(v), OPTIONS), lambda x: F.substr(x, F.lit(2), F.length(x) - 2))
    if not isinstance(kind, T.StringType):
        return written(value)
    return _let(value, lambda v: F.when(v.rlike(r'["\\\x00-\x1f]'), written(v)).otherwise(F.concat(F.lit('"'), v, F.lit('"'))))


def shrink(
    value: Column, kind: T.DataType, drop: tuple[str, ...] = (), keep_empty: bool = False, max_text: int = 0, drop_lists: int = 0, most_items: int = 0, width: int = 0,
) -> Column:
    """A value of any type as JSON text with less in it.

    From the leaves up: fields whose name matches a glob of ``drop`` go; then values that are null, "", [] or {} once what
    they hold is shrunk, unless keep_empty; then lists of more than drop_lists elements (not the root) become a note, and
    others are cut to most_items with a note on the rest; texts are cut to max_text characters. 0 means no limit.

    With a width the text is laid out: objects and arrays that fit into what their depth leaves of so many bytes stay on one
    line, others have each field or element on a line of its own, a blank deeper. Sizes come from the leaves up, in the same
    pass: every part is made once as one line, and as lines where its own line is too long.
    """
    o = Shrinking(drop, keep_empty, max_text, drop_lists, most_items, width)
    made = _shrunk(value, kind, o, 0)
    return _let(made, lambda x: x["laid"]) if o.has_lines(kind) else made


@dataclass(frozen=True)
class Shrinking:
    drop: tuple[str, ...]
    keep_empty: bool
    max_text: int
    drop_lists: int
    most_items: int
    width: int

    def has_lines(self, kind: T.DataType) -> bool:
        """Whether a part of this type is the struct of its one line (flat) and its lines (laid), not one text."""
        return self.width > 0 and isinstance(kind, (T.StructType, T.MapType, T.ArrayType))

    def one(self, text: Column, kind: T.DataType) -> Column:
        """A part of one line, which is not null."""
        return F.struct(text.alias("flat"), text.alias("laid")) if self.has_lines(kind) else text

    def none(self, kind: T.DataType) -> Column:
        """What a null becomes."""
        if self.keep_empty:
            return self.one(F.lit("null"), kind)
        return F.lit(None).cast("struct<flat:string,laid:string>" if self.has_lines(kind) else "string")

    def within(self, ends: str, body: Callable[[str, str], Column], depth: int, kind: T.DataType) -> Column:
        """An object or array of its parts, which body puts together for a form and a separator; null where nothing is kept."""
        kept = F.lit(self.keep_empty or depth == 0)

        def shown(flat: Column) -> Column:
            if not self.has_lines(kind):
                return F.when((flat != ends) | kept, flat)
            pad = "\n" + " " * (depth + 1)
            lines = F.concat(F.lit(ends[0] + pad), body("laid", "," + pad), F.lit(pad[:-1] + ends[1]))
            laid = F.when((F.octet_length(flat) <= self.width - depth) | (flat == ends), flat).otherwise(lines)
            return F.when((flat != ends) | kept, F.struct(flat.alias("flat"), laid.alias("laid")))

        return _let(F.concat(F.lit(ends[0]), body("flat", ","), F.lit(ends[1])), shown)


def _shrunk(value: Column, kind: T.DataType, o: Shrinking, depth: int) -> Column:
    """A shrunk part at a depth, null where nothing is left of it: its text, or with a width and for objects and arrays the struct of its one line and its lines.

    Every part is bound once before it is used: nothing above a leaf evaluates it a second time.
    """
    below = lambda x, t: _shrunk(x, t, o, depth + 1)
    form = lambda x, t, how: x[how] if o.has_lines(t) else x
    if isinstance(kind, T.StructType):
        fields = [f for f in kind.fields if not any(fnmatch.fnmatchcase(f.name, g) for g in o.drop)]
        heads = [F.lit(json.dumps(f.name, ensure_ascii=False) + ":") for f in fields]

        def together(parts: Column) -> Column:
            named = lambda how: [F.concat(head, form(parts[f"p{i}"], f.dataType, how)) for i, (f, head) in enumerate(zip(fields, heads, strict=True))]
            return o.within("{}", lambda how, between: F.concat_ws(between, *named(how)), depth, kind)

        parts = F.struct(F.lit(0).alias("_"), *[below(value[f.name], f.dataType).alias(f"p{i}") for i, f in enumerate(fields)])
        return F.when(value.isNull(), o.none(kind)).otherwise(_let(parts, together))
    if isinstance(kind, T.MapType):
        pair = lambda e: F.struct(F.concat(_quoted(e["key"]), F.lit(":")).alias("name"), below(e["value"], kind.valueType).alias("part"))
        left = F.filter(F.transform(F.map_entries(value), pair), lambda x: x["part"].isNotNull())
        body = lambda k: lambda how, between: F.array_join(F.transform(k, lambda x: F.concat(x["name"], form(x["part"], kind.valueType, how))), between)
        return F.when(value.isNull(), o.none(kind)).otherwise(_let(left, lambda k: o.within("{}", body(k), depth, kind)))
    if isinstance(kind, T.ArrayType):
        items = F.array_compact(F.transform(value, lambda x: below(x, kind.elementType)))
        texts = lambda k, how: F.transform(k, lambda x: x[how]) if o.has_lines(kind.elementType) else k

        def shown(k: Column) -> Column:
            n = F.size(k)
            left = texts
            if o.most_items:
                more = F.when(n > o.most_items, F.array(F.concat(F.lit('"… '), (n - o.most_items).cast("string"), F.lit(' more items"')))).otherwise(F.array().cast("array<string>"))
                left = lambda k, how: F.concat(texts(F.slice(k, 1, o.most_items), how), more)
            # an element's text is never blank, so a list without elements is the one that reads []
            made = o.within("[]", lambda how, between: F.array_join(left(k, how), between), depth, kind)
            if o.drop_lists and depth:
                made = F.when(n > o.drop_lists, o.one(F.concat(F.lit('"['), n.cast("string"), F.lit(' items omitted]"')), kind)).otherwise(made)
            return made

        return F.when(value.isNull(), o.none(kind)).otherwise(_let(items, shown))
    if isinstance(kind, T.StringType):
        text = max_str(value, o.max_text) if o.max_text else value
        return F.when(value.isNull(), o.none(kind)).when((value == "") & F.lit(not o.keep_empty), F.lit(None).cast("string")).otherwise(_quoted(text))
    return F.when(value.isNull(), o.none(kind)).otherwise(_quoted(value, kind))


#: Limits of a shape: depth, keys of an object, bytes of an object on one line, characters of an example (fixed values).
SHAPE_DEPTH, SHAPE_KEYS, SHAPE_INLINE, SHAPE_EXAMPLE = 12, 60, 80, 30


def shape_text(values: Column, kind: T.DataType, depth: int = 0) -> Column:
    """What an array of values of one type holds, merged: fields with ? where some have none, ranges of array lengths, types with a first example.

    It follows the schema; nulls count as missing, and fields that are missing everywhere are left out.
    """
    return _let(F.array_compact(values), lambda present: F.when(F.size(present) == 0, "null").otherwise(_merged_shape(present, kind, depth)))


def _merged_shape(present: Column, kind: T.DataType, depth: int) -> Column:
    """The shape of an array of values of which none is null, and which has one at least."""
    if isinstance(kind, T.StructType):
        every = F.size(present)
        field = lambda f: lambda v: F.when(F.size(v) > 0, F.concat(F.lit(f.name), F.when(F.size(v) == every, ": ").otherwise("?: "), _merged_shape(v, f.dataType, depth + 1)))
        return _shape_lines(kind, depth, lambda f: _let(F.array_compact(present[f.name]), field(f)))
    if isinstance(kind, T.ArrayType):
        sizes = F.transform(present, F.size)
        low, high = F.array_min(sizes).cast("string"), F.array_max(sizes).cast("string")
        return _shape_items(F.concat(low, F.when(low == high, "").otherwise(F.concat(F.lit("-"), high))), F.flatten(present), kind, depth)
    if isinstance(kind, T.StringType):
        return _shape_example(F.try_element_at(F.filter(present, lambda x: x != ""), F.lit(1)), kind)
    return _shape_example(F.try_element_at(present, F.lit(1)), kind)


def shape_of(value: Column, kind: T.DataType, depth: int = 0) -> Column:
    """The shape of one value, as ``shape_text`` gives it, null for null: arrays alone are gone through element by element."""
    if isinstance(kind, T.StructType):
        shown = _shape_lines(kind, depth, lambda f: F.concat(F.lit(f.name + ": "), shape_of(value[f.name], f.dataType, depth + 1)))
    elif isinstance(kind, T.ArrayType):
        shown = _shape_items(F.size(value).cast("string"), value, kind, depth)
    else:
        shown = _shape_example(F.nullif(value, F.lit("")) if isinstance(kind, T.StringType) else value, kind)
    return F.when(value.isNotNull(), shown)


def _shape_lines(kind: T.StructType, depth: int, line: Callable[[T.StructField], Column]) -> Column:
    """An object's fields, of which line makes each, or a null; on one line if they fit."""
    if depth >= SHAPE_DEPTH:
        return F.lit("{…}")
    lines = [line(f) for f in kind.fields[:SHAPE_KEYS]]
    if len(kind.fields) > SHAPE_KEYS:
        lines.append(F.lit(f"… {len(kind.fields) - SHAPE_KEYS} more keys"))
    pad = " " * (depth + 1)
    rows = F.array(*lines) if lines else F.array().cast("array<string>")  # its nulls are not joined
    wide = lambda r: F.concat(F.lit("{\n" + pad), F.array_join(r, "\n" + pad), F.lit("\n" + pad[1:] + "}"))
    return _let(rows, lambda r: _let(F.concat(F.lit("{"), F.array_join(r, ", "), F.lit("}")), lambda x: F.when((F.octet_length(x) <= SHAPE_INLINE) & ~x.contains("\n"), x).otherwise(wide(r))))


def _shape_items(size: Column, items: Column, kind: T.ArrayType, depth: int) -> Column:
    """The lengths of arrays and the shape of what they hold."""
    return _let(F.array_compact(items), lambda inner: F.concat(F.lit("["), size, F.lit("]"), F.when(F.size(inner) > 0, F.concat(F.lit(" "), _merged_shape(inner, kind.elementType, depth))).otherwise("")))


def _shape_example(first: Column, kind: T.DataType) -> Column:
    """A type with an example; a null is a text of which all are empty."""
    if isinstance(kind, T.StringType):
        example = lambda x: F.when(F.length(x) > SHAPE_EXAMPLE, F.concat(_quoted(F.substring(x, 1, SHAPE_EXAMPLE)), F.lit("…"))).otherwise(_quoted(x))
        return _let(first, lambda x: F.when(x.isNull(), "string").otherwise(F.concat(F.lit("string ("), example(x), F.lit(")"))))
    name = "bool" if isinstance(kind, T.BooleanType) else "number" if isinstance(kind, T.NumericType) else "string"
    return F.concat(F.lit(f"{name} ("), _quoted(first, kind), F.lit(")"))


def n_chars(value: Column) -> Column:
    """The characters that a value of any type has as JSON with all it holds: those of ``shrink`` with keep_empty."""
    return F.char_length(F.to_json(F.array(value), OPTIONS)) - 2


def is_tabular(kind: T.DataType) -> bool:
    """Whether a type is an array of objects, which a table can show."""
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def cell_text(value: Column, kind: T.DataType) -> Column:
    """The shortest text of a value: text as it is, arrays of scalars joined by commas, other arrays and objects as JSON, blank for null."""
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.ArrayType, T.StructType, T.MapType)):
        text = F.array_join(F.transform(value, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ", ")
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(value, OPTIONS)
    else:
        text = value.cast("string")
        if isinstance(kind, (T.NumericType, T.BooleanType)):  # nothing in it to escape
            return F.coalesce(text, F.lit(""))
    return escape_cell(F.coalesce(text, F.lit("")))


def leaves(kind: T.StructType, prefix: str = "") -> list[tuple[str, tuple[str, ...], T.DataType]]:
    """(dotted name, path, type) of all leaves of an object type, in order."""
    out = []
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            out += [(name, (f.name, *path), t) for name, path, t in leaves(f.dataType, f"{prefix}{f.name}.")]
        else:
            out.append((prefix + f.name, (f.name,), f.dataType))
    return out


def full_table(items: Column, kind: T.StructType, notes: Column | None = None) -> Column:
    """Markdown of an array of objects with a column for every leaf, and the notes below, one a line."""
    every = leaves(kind)
    row = lambda x: F.concat(F.lit("| "), F.array_join(F.array(*[cell_text(select_field(x, *path), t) for _, path, t in every]), " | "), F.lit(" |"))
    head = "| " + " | ".join(name.replace("|", "\\|") for name, _, _ in every) + " |\n|" + "---|" * len(every)
    lines = F.concat(F.array(F.lit(head)), F.transform(items, row))
    return F.array_join(F.concat(lines, notes) if notes is not None else lines, "\n")


def rendered(value: Column, kind: T.DataType, width: int = 100, **options) -> Column:
    """A value as its reader takes it in best: a table, fields one a line with tables between, or JSON laid out to a width.

    An array of objects is a table. An object with such arrays has a line ``name: value`` for each other field and a table
    under the name of each of them; fields that are null, "", [] or {} go. Any other value is JSON, shrunk with the options.
    """
    if is_tabular(kind):
        return full_table(value, kind.elementType)
    if not isinstance(kind, T.StructType) or not any(is_tabular(f.dataType) for f in kind.fields):
        return shrink(value, kind, width=width, **options)

    def part(f: T.StructField) -> Column:
        x = value[f.name]
        if is_tabular(f.dataType):
            return F.when(F.size(x) > 0, F.concat(F.lit(f"\n{f.name}:\n"), full_table(x, f.dataType.elementType), F.lit("\n\n")))
        return _let(cell_text(x, f.dataType), lambda t: F.when(x.isNotNull() & ~t.isin("", "{}", "[]"), F.concat(F.lit(f"{f.name}: "), t, F.lit("\n"))))

    whole = F.array_join(F.array_compact(F.array(*map(part, kind.fields))), "")
    return F.when(value.isNotNull(), F.regexp_replace(F.replace(whole, F.lit("\n\n\n"), F.lit("\n\n")), r"^\s+|\s+\z", ""))


def table(items: Column, *fields: str) -> Column:
    """Markdown of an array of objects: one row each, blank where a field is missing."""
    row = lambda x: F.concat(F.lit("| "), F.array_join(F.array(*[escape_cell(F.coalesce(x[f].cast("string"), F.lit(""))) for f in fields]), " | "), F.lit(" |"))
    head = "| " + " | ".join(fields) + " |\n|" + "---|" * len(fields)
    return F.concat(F.lit(head + "\n"), F.array_join(F.transform(items, row), "\n"))


def union_columns(*frames: DataFrame) -> DataFrame:
    """All rows under all columns, in the order they are first seen; null where a frame has no such column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shape(entries: DataFrame) -> DataFrame:
    """key, n_objects, n_present, n_null, kinds and optional of each top-level key, from (doc, key, value as JSON text).

    Two partial aggregations; no document is gathered.
    """
    kind = F.when(F.col("value") == "null", "null").when(F.col("value").rlike('^"'), "string").when(F.col("value").isin("true", "false"), "bool").when(F.col("value").startswith("["), "array").when(F.col("value").startswith("{"), "object").otherwise("number")
    total = entries.agg(F.count_distinct("doc").alias("n_objects"))  # one row, so the join below multiplies nothing
    counted = entries.withColumn("kind", kind).groupBy("key").agg(F.count("*").alias("n_present"), F.count_if(F.col("kind") == "null").alias("n_null"), F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"))
    return counted.join(F.broadcast(total)).select("key", "n_objects", "n_present", "n_null", "kinds", (F.col("n_present") < F.col("n_objects")).alias("optional"))
