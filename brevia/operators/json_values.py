"""Texts that hold any number of JSON values, cut into one row a value, and read by a schema without losing any.

In JSON two values stand side by side, without a comma or colon between, only outside of all brackets. So the cuts are
found by what stands left and right of them once strings are masked: no text is parsed to find them, and no bracket is
counted. A piece that is cut wrongly is one that isn't JSON, and is reported.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Private signs for: an escaped backslash, an escaped quote, a string's two ends, a cut; then what strings hold of blanks and brackets.
_SLASH, _QUOTE, _OPEN, _CLOSE, _CUT = ""
_PLAIN, _HIDDEN = " \t\n\r[]{}", ""
_OWN, _ESCAPE = "[-]", ""
_SCALAR = "[^\\s\\[\\]{},:]"
#: Between the end of one value and the beginning of the next; two scalars need a blank between.
_BETWEEN = f"(?:(?<=[\\]}}])\\s*(?=[\\[{{]|{_SCALAR})|(?<={_SCALAR})\\s+(?=[\\[{{]|{_SCALAR})|(?<={_SCALAR})(?=[\\[{{]))"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
#: The column that says which text didn't fit a schema.
_BAD = "_no_fit"


def _masked(text: Column) -> Column:
    """The text with its strings between private signs, free of blanks and brackets; those signs in the text itself become U+FFFD."""
    plain = F.when(text.rlike(_OWN), F.regexp_replace(text, _OWN, "�")).otherwise(text)
    plain = F.replace(F.replace(plain, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    inside = lambda x: F.concat(F.lit(_OPEN), F.translate(x, _PLAIN, _HIDDEN), F.lit(_CLOSE))
    masked = F.array_join(F.transform(F.split(plain, '"', -1), lambda x, i: F.when(i % 2 == 0, x).otherwise(inside(x))), "")
    odd = (F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))) % 2 == 1  # the last string has no end
    return F.when(odd, F.regexp_replace(masked, f"{_CLOSE}\\z", "")).otherwise(masked)


def _restored(masked: Column) -> Column:
    quoted = F.translate(masked, _OPEN + _CLOSE + _HIDDEN, '""' + _PLAIN)
    return F.replace(F.replace(quoted, F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))


def values(text: Column) -> Column:
    """The JSON values of a text in order, as array<struct<value: string, ok: boolean>>; null for null.

    ok says whether the piece is one whole value. Blank texts have none. A string that never ends takes the rest of the text.
    A text that reads back as the one value it is, sign by sign, needs no cuts: that is looked at first.
    """
    whole = F.when(text.rlike(r"^[\[{]") & ~text.rlike(_OWN), F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT))
    alone = F.transform(F.array(whole), lambda w: F.coalesce((F.size(w) == 1) & (w[0] == text), F.lit(False)))[0]
    return F.when(alone, F.array(F.struct(text.alias("value"), F.lit(True).alias("ok")))).otherwise(_cut_up(text))


def _cut_up(text: Column) -> Column:
    pieces = F.transform(F.split(F.regexp_replace(_masked(text), _BETWEEN, _CUT), _CUT, -1), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", ""))
    count = lambda x, sign: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))
    even = lambda x: (count(x, "[") == count(x, "]")) & (count(x, "{") == count(x, "}"))
    read = lambda v: F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>", _STRICT)
    checked = lambda x: F.transform(F.array(_restored(x)), lambda v: F.struct(v.alias("value"), F.coalesce(even(x) & (F.size(read(v)) == 1), F.lit(False)).alias("ok")))[0]
    return F.transform(F.filter(pieces, lambda x: x != ""), checked)


def records(docs: DataFrame, text: str, schema: T.StructType) -> DataFrame:
    """docs without ``text``, with n, record and error: a row for each record of each text, in order from 0.

    Records are the text's values, and the elements of those that are arrays. Pieces side by side that are neither objects
    nor arrays are one row, as is a broken piece: its error is "invalid JSON", or "does not fit the schema" if the first of
    them is a value. So is the error of a record that the schema can't hold. All keep their place, and have a null record.
    A text without values, or a null one, has one row with an error, an empty array none. Other columns are kept. A text that
    the schema reads and writes back sign by sign is its one record, and is looked at first.
    """
    item = lambda x, error=None: F.struct(x.alias("text"), F.lit(error).cast("string").alias("error"))
    elements = lambda v: F.transform(F.from_json(v["value"], "array<string>", _STRICT), lambda x: item(x))
    nested = lambda v: v["ok"] & v["value"].rlike(r"^[\[{]")
    first = lambda found: F.filter(found, lambda v, i: nested(v) | (i == 0) | F.coalesce(nested(F.get(found, i - 1)), F.lit(True)))
    kept = F.transform(F.array(values(F.col(text))), first)[0]
    each = lambda v: F.when(~v["ok"], F.array(item(v["value"], "invalid JSON"))).when(v["value"].startswith("["), elements(v)).otherwise(F.array(item(v["value"])))
    listed = lambda found: F.when(F.size(found) > 0, F.flatten(F.transform(found, each))).otherwise(F.array(item(F.lit(None).cast("string"), "no JSON value")))
    listed = F.transform(F.array(F.coalesce(kept, F.array().cast("array<struct<value:string,ok:boolean>>"))), listed)[0]
    listed = F.when(F.col("direct").isNotNull(), F.array(item(F.lit(None).cast("string")))).otherwise(listed)
    kept = [c for c in docs.columns if c not in (text, "n", "record", "error")]
    held = docs.select(F.struct(F.lit(0).alias("_"), *kept).alias("row"), text, _direct(F.col(text), schema).alias("direct"))
    rows = held.select("row", "direct", F.posexplode(listed).alias("n", "item"))
    rows = rows.withColumn("read", F.when(F.col("direct").isNull(), F.from_json("item.text", T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())]), {**_STRICT, "columnNameOfCorruptRecord": _BAD})))
    misfit = F.col("read").isNull() | F.col("read")[_BAD].isNotNull() | ~F.coalesce(F.col("item.text").startswith("{"), F.lit(False))
    error = F.when(F.col("direct").isNull(), F.coalesce(F.col("item.error"), F.when(misfit, "does not fit the schema")))
    record = F.when(F.col("direct").isNotNull(), F.col("direct")).when(error.isNull(), F.struct(*[F.col("read")[f.name].alias(f.name) for f in schema.fields]))
    return rows.select(*[F.col("row")[c].alias(c) for c in kept], "n", record.alias("record"), error.alias("error"))


def _direct(text: Column, schema: T.StructType) -> Column:
    """The object that a text is, where the schema writes it back sign by sign, so nothing can stand beside it or be lost; else null."""
    begins = text.startswith("{" + json.dumps(schema.fieldNames()[0], ensure_ascii=False) + ":") if schema.fields else F.lit(False)
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(_OWN)
    same = lambda x: F.when(F.to_json(x, {"ignoreNullFields": "false"}) == text, x)
    return F.when(begins & plain, F.transform(F.array(F.from_json(text, schema, _STRICT)), same)[0])


def root(text: Column, schema: T.DataType) -> Column:
    """A text as one value of a schema, as struct<root, error>: several values side by side are one array of them.

    The error is "invalid JSON" where some piece isn't, else "does not fit the schema" where objects, or objects of an
    array, have a field of another type.
    """
    joined = lambda found: F.when((F.size(found) == 1) & (F.lit(not isinstance(schema, T.ArrayType)) | found[0]["value"].startswith("[")), found[0]["value"]).otherwise(F.concat(F.lit("["), F.array_join(F.transform(found, lambda v: v["value"]), ","), F.lit("]")))
    whole = F.transform(F.array(values(text)), lambda found: F.when((F.size(found) > 0) & F.forall(found, lambda v: v["ok"]), joined(found)))[0]
    inner = schema.elementType if isinstance(schema, T.ArrayType) else schema
    each = lambda x: F.from_json(x, "array<string>", _STRICT) if isinstance(schema, T.ArrayType) else F.array(x)

    def whole_object(x: Column) -> Column:
        """Read once, with the column that says what didn't fit."""
        checked = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])

        def judged(r: Column) -> Column:
            fits = F.coalesce(r[_BAD].isNull() & x.startswith("{"), F.lit(False)) & r.isNotNull()
            error = F.when(x.isNull(), "invalid JSON").when(~fits, "does not fit the schema")
            return F.struct(F.when(fits, F.struct(*[r[f.name].alias(f.name) for f in schema.fields])).alias("root"), error.alias("error"))

        return F.transform(F.array(F.from_json(x, checked, {**_STRICT, "columnNameOfCorruptRecord": _BAD})), judged)[0]

    def read(x: Column) -> Column:
        fits = F.lit(True)
        if isinstance(inner, T.StructType):
            checked = T.StructType([*inner.fields, T.StructField(_BAD, T.StringType())])
            bad = lambda e: e.isNotNull() & (F.from_json(e, checked, {**_STRICT, "columnNameOfCorruptRecord": _BAD})[_BAD].isNotNull() | ~e.startswith("{"))
            fits = F.coalesce(~F.exists(each(x), bad), F.lit(False))
        value = F.from_json(x, schema, _STRICT)
        error = F.when(x.isNull(), "invalid JSON").when(~fits | value.isNull(), "does not fit the schema")
        return F.struct(F.when(error.isNull(), value).alias("root"), error.alias("error"))

    return F.transform(F.array(whole), whole_object if isinstance(schema, T.StructType) else read)[0]
