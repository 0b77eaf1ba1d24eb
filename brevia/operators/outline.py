"""Outlines and sections of Markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.functions.text import human_count
from brevia.operators.lines import by_line

HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+([^\n]*?))?[ \t#]*\z"
FENCE = r"^ {0,3}(`{3,}|~{3,})"


#: A fenced block with its marker lines: it closes at a bare run of its character, at least as long, or with the text.
_FENCED = "(?md)" + "|".join(rf"^ {{0,3}}({c}{{3,}}+)[^\n]*+(?:\n(?s:.*?)(?:^ {{0,3}}\{k}{c}*+ *+$|\z))?" for k, c in ((1, "`"), (2, "~")))


def fenced_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line, fence and total of every line.

    fence: the number of the fenced block that the line belongs to, marker lines included, else 0. total: the text's
    characters. Blocks are found by one regular expression over the text, so work grows with its length, and nothing is
    shuffled or sorted.
    """
    outside, blocks = F.split(text, _FENCED, -1), F.regexp_extract_all(text, F.lit(_FENCED), F.lit(0))

    def lines(x: Column, i: Column) -> Column:
        # a line end stands between the text and the block before it, and between the text and the block behind it
        plain, block = x["plain"], x["block"]
        behind = F.when(i > 0, F.substr(plain, F.lit(2))).otherwise(plain)
        bare = F.when(block.isNotNull(), F.substr(behind, F.lit(1), F.length(behind) - 1)).otherwise(behind)
        nothing = F.when(i == 0, block.isNotNull() & (plain == "")).otherwise((plain == "") | (block.isNotNull() & (plain == "\n")))
        line = lambda fence: lambda x: F.struct(fence.alias("fence"), x.alias("line"))
        free = F.when(~nothing, F.transform(F.split(bare, "\n", -1), line(F.lit(0))))
        fenced = F.transform(F.split(block, "\n", -1), line((i + 1).cast("int")))
        return F.flatten(F.array_compact(F.array(free, fenced)))

    every = F.flatten(F.transform(F.zip_with(outside, blocks, lambda a, b: F.struct(a.alias("plain"), b.alias("block"))), lines))
    held = docs.select(key, F.char_length(text).alias("total"), every.alias("every"))  # so that no row below carries the text
    rows = held.select(key, "total", F.posexplode("every").alias("at", "x"))
    return rows.select(key, (F.col("at") + 1).alias("line_no"), "x.line", "x.fence", "total")


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every line with start, and where it is a heading level, title, id and end; null otherwise."""
    size = F.char_length("line") + 1
    placed = fenced_lines(docs, key, text).withColumn("start", F.sum(size).over(by_line(key).rowsBetween(Window.unboundedPreceding, 0)) - size)
    bare = F.regexp_replace(F.regexp_extract("line", HEADING, 2), r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    title = F.trim(F.regexp_replace(bare, r"\\([\\`*_{}\[\]()#+\-.!|<>])", "$1"))
    found = placed.withColumn("title", title).withColumn("level", F.when((F.col("fence") == 0) & (F.col("title") != "") & F.col("line").rlike(HEADING), F.length(F.regexp_extract("line", HEADING, 1))))
    listed = found.withColumn("id", F.when(F.col("level").isNotNull(), F.count("level").over(by_line(key).rowsBetween(Window.unboundedPreceding, 0)).cast("int")))
    later = Window.partitionBy(key).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.array(*[F.min(F.when(F.col("level") <= k, F.col("start"))).over(later) for k in range(1, 7)])
    spanned = listed.withColumn("end", F.when(F.col("level").isNotNull(), F.coalesce(F.element_at(ends, F.col("level")), F.col("total"))))
    return spanned.withColumn("n_tokens", F.floor((F.col("end") - F.col("start") + 3) / 4).cast("long"))


def headings(docs: DataFrame, key: str, text: str = "md") -> DataFrame:
    """key, id, level, title, line_no, start, end and n_tokens of every section of every document.

    A section ends at the next heading of its level or above, else with the document. Its tokens count the lines it holds,
    line ends included. Lines in fenced blocks are no headings; titles lose link targets and escapes. Work grows with the
    lines of a document and not with their square: one window for each of the six levels, from the end.
    """
    return _marked(docs, key, text).where("level is not null").select(key, "id", "level", "title", "line_no", "start", "end", "n_tokens")


def may_have_headings(text: Column) -> Column:
    """Whether any line of a text begins as a heading does, in a fence or not."""
    return text.contains("#") & text.rlike(r"(?m)^ {0,3}#")


def no_headings(total: Column) -> Column:
    """The outline of a document of so many characters without headings."""
    return F.concat(F.lit("no headings; about "), human_count(F.floor((total + 3) / 4).cast("long")), F.lit(" tokens, ask for page=1"))


def format_outline(docs: DataFrame, key: str, text: str = "md") -> DataFrame:
    """key and outline: one line per section, indented by its level below the document's top level."""
    deep = lambda x: F.repeat(F.lit("  "), x["level"] - F.array_min(F.transform("found", lambda y: y["level"])))
    line = lambda x: F.concat(deep(x), x["id"].cast("string"), F.lit(". "), x["title"], F.lit(" (~"), x["size"], F.lit(")"))
    marked = _marked(docs, key, text).withColumn("size", human_count(F.col("n_tokens")))
    found = F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("id", "level", "title", "size"))))
    whole = marked.groupBy(key).agg(F.max("total").alias("total"), found.alias("found"))
    about = human_count(F.floor((F.col("total") + 3) / 4).cast("long"))
    head = F.concat(F.size("found").cast("string"), F.lit(" headings, about "), about, F.lit(" tokens; ask for section=<id>\n"), F.array_join(F.transform("found", line), "\n"))
    return whole.select(key, F.when(F.size("found") == 0, no_headings(F.col("total"))).otherwise(head).alias("outline"))


def section_lookup(docs: DataFrame, wanted: DataFrame, key: str, text: str = "md") -> DataFrame:
    """key, wanted, id, title and section for each (key, wanted): the best match's text.

    An id wins, then an equal title, one that starts with the words, one that holds them; of equals the first.
    """
    found = headings(docs, key, text).join(wanted, key)
    want, title = F.lower(F.trim(F.regexp_replace("wanted", "^#+", ""))), F.lower("title")
    rank = F.when(F.col("id").cast("string") == want, 1).when(title == want, 2).when(title.startswith(want), 3).when(title.contains(want), 4)
    best = found.withColumn("rank", rank).where("rank is not null").groupBy(key, "wanted").agg(F.min_by(F.struct("id", "title", "start", "end"), F.struct("rank", "id")).alias("hit"))
    section = F.substring(F.col(text), F.col("hit.start") + 1, F.col("hit.end") - F.col("hit.start"))
    return best.join(docs.select(key, text), key).select(key, "wanted", "hit.id", "hit.title", F.regexp_replace(section, r"^[ \n]+|[ \n]+\z", "").alias("section"))
