"""Lookups between the parts of a document: relationships, numbering and chains of styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOPS = 10


def style_chain(styles: DataFrame) -> DataFrame:
    """style_id, hop, ancestor of every style and each style it is based on, itself at hop 0, at most ``HOPS`` away."""
    return styles.sparkSession.sql(
        f"""
        with recursive chain(style_id, hop, ancestor) as (
          select style_id, 0, style_id from {{styles}}
          union all
          select c.style_id, c.hop + 1, s.based_on from chain c join {{styles}} s on c.ancestor = s.style_id where s.based_on is not null and c.hop < {HOPS}
        )
        select style_id, hop, ancestor from chain
        """,
        styles=styles,
    )


def inherited(styles: DataFrame, value: str) -> DataFrame:
    """style_id and value: the style's own, else the nearest ancestor's."""
    known = styles.select(F.col("style_id").alias("ancestor"), value).where(F.col(value).isNotNull())
    return style_chain(styles).join(known, "ancestor").groupBy("style_id").agg(F.min_by(value, "hop").alias(value))


def ordered_parts(order: DataFrame, relations: DataFrame) -> DataFrame:
    """doc, position, target and notes: parts in the order of ``order`` (doc, position, rel_id), with the notes part of each, if any.

    relations: doc, owner, rel_id, kind, target. The main part's relations have an empty owner.
    """
    main = relations.where("owner = ''").select("doc", "rel_id", "target")
    notes = relations.where("kind = 'notes'").groupBy("doc", "owner").agg(F.min_by("target", "rel_id").alias("notes")).withColumnRenamed("owner", "target")
    return order.join(main, ["doc", "rel_id"]).join(notes, ["doc", "target"], "left").select("doc", "position", "target", "notes")


def linked(spans: DataFrame, relations: DataFrame) -> DataFrame:
    """spans (doc, span_no, text, rel_id) with url: the relation's target where there is one and it is absolute."""
    urls = relations.where(F.col("target").rlike("^[a-z][a-z0-9+.-]*:")).select("doc", "rel_id", F.col("target").alias("url"))
    return spans.join(urls, ["doc", "rel_id"], "left").select("doc", "span_no", "text", "url")


def numbering(paragraphs: DataFrame, instances: DataFrame, levels: DataFrame) -> DataFrame:
    """paragraphs (doc, num_id, ilvl, ...) with format: the list format of their level, null where they are in no known list.

    instances: doc, num_id, abstract_id. levels: doc, abstract_id, ilvl, format. Two lookups by equality.
    """
    formats = instances.join(levels, ["doc", "abstract_id"]).select("doc", "num_id", "ilvl", "format")
    return paragraphs.join(formats, ["doc", "num_id", "ilvl"], "left")


def resolved(part: Column, target: Column) -> Column:
    """A relation's target as a path of the package: from its root with a leading /, else from the part's folder; . and .. are followed."""
    full = F.when(target.startswith("/"), F.substr(target, F.lit(2))).otherwise(F.concat(F.regexp_replace(part, r"[^/]*\z", ""), target))
    step = lambda acc, name: F.when(name.isin("", "."), acc).when(name == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(name)))
    return F.array_join(F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step), "/")
