"""Reading a mixed corpus: every document by its own kind, as Markdown or JSON with its costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brevia.functions.text import clean_text, est_tokens
from brevia.operators import diffs, html, json_docs, json_values, logs, outline, pages, tags
from brevia.operators.lines import explode_lines
from brevia.sources import detect
from brevia.streaming.events import scratch

#: Bytes of a line of JSON that is laid out for paging.
PAGED_WIDTH = 100
SCRIPTED = "the page builds itself with scripts, little of it is text"


def _known(docs: DataFrame) -> DataFrame:
    """id, text and kind of every row."""
    return docs.select("id", "text", detect.kind(F.col("text"), F.col("path"), F.col("content_type")).alias("kind"))


def _by_key(rows: DataFrame, convert: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with markdown, made from (key, text) of distinct texts: rows of one id and text are converted once, and all come back."""
    keyed = rows.withColumn("key", F.concat_ws(" ", "id", F.hex(F.xxhash64("text")), F.length("text").cast("string")))
    made = convert(keyed.select("key", "text").dropDuplicates(["key"]))
    return keyed.drop("text").join(made, "key", "left").select(*[c for c in rows.columns if c != "text"], "markdown")


def _by_lines(convert: Callable[[DataFrame, str], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: convert(explode_lines(rows, "key", "text"), "key")


#: How each kind becomes Markdown: in its own row, or by its lines or tags. A new kind needs an entry here and a rule in ``detect.kind``.
IN_ROW: dict[str, Callable[[Column], Column]] = {"text": clean_text}
BY_PARTS: dict[str, Callable[[DataFrame], DataFrame]] = {"logfile": _by_lines(logs.log_documents), "diff": _by_lines(diffs.diff_markdown), "html": lambda rows: tags.markdown(rows, "key", "text")}


def read_docs(docs: DataFrame, schema: T.DataType | None = None, width: int = 0) -> DataFrame:
    """id, kind, markdown, raw_tokens, out_tokens, note and error of every row of (id, text, path, content_type).

    Texts are converted in one pass over the rows; logs and diffs, which go by lines, and pages, which go by tags, are
    branches of their own. What can't be read is a row with an error, never a failed job. JSON documents are shrunk by
    ``schema`` (and laid out to ``width``, see ``json_docs.shrink``), without one their text is cleaned. Null texts are errors; repeated ids come back as often.
    """
    return _converted(_written(_known(docs)), schema, width)  # each kind's branch asks for it, some more than once


def _converted(known: DataFrame, schema: T.DataType | None = None, width: int = 0) -> DataFrame:
    text, kind = F.col("text"), F.col("kind")
    note = F.when(F.when(kind == "html", html.needs_js(text)), SCRIPTED)
    known = known.withColumns({"raw_tokens": est_tokens(text), "note": note, "empty": text.isNull()})
    markdown = F.when(kind == "json", _shrunk(text, schema, width=width) if schema else clean_text(text))
    for name, convert in IN_ROW.items():
        markdown = markdown.when(kind == name, convert(text))
    made = known.where(kind.isNull() | ~kind.isin(*BY_PARTS)).withColumn("markdown", markdown).drop("text")
    for name, by_parts in BY_PARTS.items():
        made = made.unionByName(_by_key(known.where(kind == name), by_parts))
    why = F.when(F.col("empty"), "source is empty").when(~kind.isin("json", *IN_ROW, *BY_PARTS), "unsupported file type").when(F.col("markdown").isNull(), F.when(kind == "json", "invalid JSON").otherwise("not a recognizable diff/patch"))
    return made.select("id", "kind", "markdown", "raw_tokens", est_tokens(F.col("markdown")).alias("out_tokens"), "note", why.alias("error"))


def _shrunk(text: Column, schema: T.DataType, **options) -> Column:
    """A JSON value, or several side by side as an array, shrunk by a schema; null where a piece is no JSON or doesn't fit."""
    kinds = [schema] if isinstance(schema, T.ArrayType) else [schema, T.ArrayType(schema)]
    shown = lambda kind: lambda x: F.when(x["error"].isNull(), json_docs.shrink(x["root"], kind, **options))
    return F.coalesce(*[F.transform(F.array(json_values.root(text, kind)), shown(kind))[0] for kind in kinds])


def _written(made: DataFrame) -> DataFrame:
    """made, written once: a condition on what is made would else be pushed below the work, which would be done twice."""
    place = scratch(made.sparkSession)
    made.write.parquet(f"{place}/read")
    return made.sparkSession.read.schema(made.schema).parquet(f"{place}/read")


def _marked(made: DataFrame) -> DataFrame:
    """made with ``key``: rows of one id and Markdown share it, others of that id don't. Written once, so nothing is converted twice."""
    return _written(made.withColumn("key", F.concat_ws(" ", "id", F.hex(F.xxhash64("markdown")), F.length("markdown").cast("string"))))


def read_json(docs: DataFrame, schema: T.DataType, select: Callable[[Column], Column] | None = None, table: bool = False, outline: bool = False, **options) -> DataFrame:
    """id, n, content and error of every record of every JSON document of (id, text, path, content_type), read by a schema.

    With an object type as schema a document has a record for each of its values and for each element of those that are
    arrays, numbered from 0 (see ``json_values.records``); with any other it is one record, and several values are one
    array. select takes a part of the record; the part is shrunk with the options of ``json_docs.shrink``, or with ``table``
    shown by ``json_docs.rendered``, or with ``outline`` described by its shape. Documents of other kinds,
    what is no JSON, what the schema can't hold and selections that match nothing are error rows.
    """
    judged = _known(docs).where("text is not null").select("id", "text", _no_json(F.col("kind")).alias("other"))
    apart = judged.where("other is not null").select("id", F.lit(0).alias("n"), F.lit(None).cast("string").alias("content"), F.col("other").alias("error"))
    typed = _records(judged.where("other is null").select("id", "text"), schema)
    part = typed.withColumn("part", select(F.col("root")) if select else F.col("root"))
    kind, value = part.schema["part"].dataType, F.col("part")
    if outline:
        content = _shape(value, kind)
    elif table:
        content = json_docs.rendered(value, kind, **options)
    else:
        content = json_docs.shrink(value, kind, **options)
    error = F.coalesce("why", json_docs.no_match(part, "root", value, "the selection"))
    return part.withColumn("error", error).select("id", "n", F.when(F.col("error").isNull(), content).alias("content"), "error").unionByName(apart)


def _no_json(kind: Column) -> Column:
    """Why a text of a kind can't be read as JSON; null where it is to be tried."""
    other = F.when(~kind.isin("json", "text", "unknown"), F.concat(F.lit("not JSON (it looks like "), kind, F.lit("): use read_docs")))
    return F.coalesce(other, F.when((kind != "json") & ~F.col("text").rlike(r"^\s*[\[{]"), "invalid JSON"))


def _records(asked: DataFrame, schema: T.DataType) -> DataFrame:
    """id, n, root and why it is null of every record of every (id, text): those of an object type by its values and their elements, else one a text."""
    if isinstance(schema, T.StructType):
        return json_values.records(asked, "text", schema).withColumnsRenamed({"record": "root", "error": "why"})
    return asked.withColumn("read", json_values.root(F.col("text"), schema)).select("id", F.lit(0).alias("n"), "read.root", F.col("read.error").alias("why"))


def _shape(value: Column, kind: T.DataType) -> Column:
    tokens = F.floor((json_docs.n_chars(value) + 3) / 4).cast("string")
    return F.concat(F.lit("JSON of about "), tokens, F.lit(" tokens\n"), json_docs.shape_of(value, kind))


def read_outlines(docs: DataFrame, schema: T.DataType | None = None) -> DataFrame:
    """id and outline of every document that can be read: the headings of Markdown; of JSON, with a schema, the shape of each record.

    Rows of one id have an outline each. Records are dealt anew before they are read, as a small file of JSON is much work.
    """
    known = _known(docs)
    apart = known.where("not kind <=> 'json'") if schema else known  # the shape of JSON doesn't need its Markdown
    ready = _marked(_converted(_written(apart)).withColumns({"total": F.char_length("markdown"), "headed": outline.may_have_headings(F.col("markdown"))})).where("error is null")
    plain = ready.where("not headed").select("id", outline.no_headings(F.col("total")).alias("outline"))  # needs no line of its Markdown
    headed = ready.where("headed")
    made = outline.format_outline(headed.dropDuplicates(["key"]), "key", "markdown")
    made = headed.select("id", "key").join(made, "key").select("id", "outline").unionByName(plain)
    if schema is None:
        return made
    kind = detect.kind(F.col("text"), F.col("path"), F.col("content_type"))
    is_asked = F.transform(F.array(kind), lambda k: F.col("text").isNotNull() & _no_json(k).isNull())[0]  # finds the kind once
    asked = docs.where(is_asked).select("id", "text").repartition("id", "text")
    typed = _records(asked, schema)
    shaped = F.when(F.col("why").isNull() & F.col("root").isNotNull(), F.array(_shape(F.col("root"), typed.schema["root"].dataType)))
    return typed.select("id", F.explode(shaped).alias("outline")).unionByName(made)  # exploded, as a filter on the error would read each record again


def read_section(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, wanted, section and error of each (id, wanted): the section of a document that the words or the number name.

    Each row of a repeated id answers for itself.
    """
    made = _marked(read_docs(docs))
    asked = wanted.select("id", "wanted").join(made.select("id", "key", "kind", F.col("error").alias("why")), "id", "left")
    ready = made.where("error is null and kind <> 'json'").select("key", "markdown").dropDuplicates(["key"])
    can = F.coalesce(F.col("key").isNotNull() & F.col("why").isNull() & (F.col("kind") != "json"), F.lit(False))  # others have their error and meet no section
    sought = asked.where(can).select("key", "wanted").distinct()
    found = outline.section_lookup(ready, sought, "key", "markdown").select("key", "wanted", "section")
    facts = asked.where(can).join(found, ["key", "wanted"], "left").unionByName(asked.where(~can).withColumn("section", F.lit(None).cast("string")))
    error = F.when(F.col("kind").isNull(), "no such document").when(F.col("why").isNotNull(), F.col("why")).when(F.col("kind") == "json", "sections are for documents: use read_json").when(F.col("section").isNull(), F.concat(F.lit("no section matches "), F.col("wanted")))
    return facts.select("id", "wanted", "section", error.alias("error"))


def read_page(docs: DataFrame, page: int = 1, most: int = 20_000, schema: T.DataType | None = None) -> DataFrame:
    """id, content (with a footer where there are more pages, and the note) and error of one page of every document that can be read.

    A page never has more than ``most`` characters besides its footer and note: longer lines are cut. JSON, with a schema,
    is laid out so that it can be cut at its lines. Every row has a row: rows of one id are paged each by its own text.
    """
    ready = _written(read_docs(docs, schema, PAGED_WIDTH).select("id", "note", "markdown", "error")).where("error is null")
    paged = F.transform(F.array(pages.packed(F.col("markdown"), max(500, min(most, 500_000)), cut=True)), lambda x: F.struct(F.size(x).alias("n"), F.try_element_at(x, F.lit(page))["content"].alias("content")))[0]
    counted = ready.select("id", "note", paged.alias("page")).select("id", "note", "page.n", "page.content")
    after = F.when(F.col("n") > page, F.lit(f" · next: page={page + 1}")).otherwise("")
    footer = F.when(F.col("n") > 1, F.concat(F.lit(f"\n\n[page {page} of "), F.col("n").cast("string"), after, F.lit("]"))).otherwise("")
    noted = F.when(F.col("note").isNull(), "").otherwise(F.concat(F.lit("\n\n[note: "), F.col("note"), F.lit("]")))
    error = F.when(F.col("content").isNull(), F.concat(F.lit(f"page {page} out of range: there are "), F.col("n").cast("string"), F.lit(" page(s)")))
    return counted.select("id", F.concat("content", footer, noted).alias("content"), error.alias("error"))
