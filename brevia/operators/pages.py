"""Paged text: running headers and footers, page numbers, and packing of lines into pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.operators.lines import joined
from brevia.operators.outline import FENCE, fenced_lines

EDGE, LEAST_LINES, LEAST_PAGES = 2, 5, 4
#: A line that is only a page number (fixed value).
PAGE_NUMBER = r"(?i)^[\t\n\f\r \-–—]*(?:page[\t\n\f\r ]*)?([0-9]+)(?:[\t\n\f\r ]*(?:of|/)[\t\n\f\r ]*[0-9]+)?[\t\n\f\r \-–—]*\z"


def marked(lines: DataFrame, doc: str) -> DataFrame:
    """Lines of (doc, page_no, line_no, line) with what decides about page furniture, in one shuffle by document.

    key: of the first and last two non-blank lines of a page of five or more, the position and the text with digits as #, if
    it has three letters; key_pages: pages with that key. value: the number of a first or last line that is only a page number;
    page_offset: its difference to the page; best (page_offset, n): the document's most frequent one, of equals the smaller
    distance, then the smaller value. pages: the document's last page.
    """
    page, whole = Window.partitionBy(doc, "page_no"), Window.partitionBy(doc)
    full = F.col("line").rlike(r"[^\s]").cast("int")
    ranked = lines.repartition(doc).withColumn("full", full).withColumn("n", F.sum("full").over(page)).withColumn("pages", F.max("page_no").over(whole))
    ranked = ranked.withColumn("top", F.sum("full").over(page.orderBy("line_no"))).withColumn("bottom", F.col("n") - F.col("top") + 1)
    text = F.regexp_replace(F.regexp_replace("line", r"^\s+|\s+\z", ""), "[0-9]+", "#")
    edge = (F.col("full") == 1) & (F.col("n") >= LEAST_LINES) & (F.least("top", "bottom") <= EDGE) & text.rlike(r"\pL.*\pL.*\pL")
    keyed = ranked.withColumn("key", F.when(edge, F.concat(F.when(F.col("top") <= EDGE, "top:").otherwise("bottom:"), text)))
    first = F.when(F.col("key").isNotNull() & (F.row_number().over(Window.partitionBy(doc, "key", "page_no").orderBy("line_no")) == 1), 1)
    counted = keyed.withColumn("first", first).withColumn("key_pages", F.sum("first").over(Window.partitionBy(doc, "key")))
    end = (F.col("full") == 1) & ((F.col("top") == 1) | (F.col("bottom") == 1))
    valued = counted.withColumn("value", F.when(end, F.expr("try_cast(regexp_extract(line, r'" + PAGE_NUMBER + "', 1) as bigint)"))).withColumn("page_offset", F.col("value") - F.col("page_no"))
    often = valued.withColumn("often", F.count("value").over(Window.partitionBy(doc, "page_offset")))
    order = F.struct("often", -F.abs("page_offset"), -F.col("page_offset"))
    return often.withColumn("best", F.max_by(F.struct("page_offset", F.col("often").alias("n")), F.when(F.col("value").isNotNull(), order)).over(whole))


def _is_running() -> Column:
    """A key on at least three and 60 % of the pages, in a document of four or more."""
    return F.col("key").isNotNull() & (F.col("pages") >= LEAST_PAGES) & (F.col("key_pages") >= F.greatest(F.lit(3), F.floor(F.col("pages") * 6 / 10)))


def _numbers_track() -> Column:
    """The best offset on at least two and half of the pages, in a document of four or more."""
    return (F.col("pages") >= LEAST_PAGES) & (F.col("best.n") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 2)))


def running_lines(lines: DataFrame, doc: str) -> DataFrame:
    """doc, key and n_pages of running headers and footers."""
    return marked(lines, doc).where(_is_running() & F.col("first").isNotNull()).groupBy(doc, "key").agg(F.max("key_pages").alias("n_pages"))


def page_numbers(lines: DataFrame, doc: str) -> DataFrame:
    """doc, page_no, line_no and value of first and last lines that are only a page number."""
    return marked(lines, doc).where("value is not null").select(doc, "page_no", "line_no", "value")


def page_offsets(lines: DataFrame, doc: str) -> DataFrame:
    """doc, page_offset and n where page numbers track the pages."""
    return marked(lines, doc).where(F.col("value").isNotNull() & _numbers_track()).groupBy(doc).agg(F.max("best").alias("b")).select(doc, "b.page_offset", "b.n")


def without_furniture(lines: DataFrame, doc: str) -> DataFrame:
    """lines without running headers and footers and without page numbers that track the pages."""
    number = F.col("value").isNotNull() & _numbers_track() & (F.col("page_offset") == F.col("best.page_offset"))
    return marked(lines, doc).where(~F.coalesce(_is_running() | number, F.lit(False))).select(*lines.columns)


def page_clamp(most: Column, default: int = 20_000) -> Column:
    """A page size between 500 and 500,000 characters; null or below one means the default."""
    return F.when(most.isNull() | (most < 1), default).otherwise(F.least(F.greatest(most, F.lit(500)), F.lit(500_000))).cast("long")


def scanned_pages(lines: DataFrame, doc: str) -> DataFrame:
    """doc, n_pages and n_scanned: the pages of a document, and those of them without any text."""
    texts = lines.groupBy(doc, "page_no").agg(F.max(F.col("line").rlike(r"[^\s]")).alias("text"))
    return texts.groupBy(doc).agg(F.count("*").alias("n_pages"), F.count_if(~F.coalesce("text", F.lit(False))).alias("n_scanned"))


def pack_pages(docs: DataFrame, key: str, text: str, budget: int, cut: bool = False) -> DataFrame:
    """key, page_no, n_lines and content: lines packed greedily into pages of at most ``budget`` characters.

    A line goes on the current page if it fits with its line end, else it opens a page; a longer line than a page has a page
    of its own, or with ``cut`` falls into pieces of at most a page, so that no page is ever longer than the budget. The fold runs inside each row and keeps where pages begin, so documents are independent, nothing is shuffled,
    and work grows with the lines.
    """
    return docs.select(key, F.explode(packed(F.col(text), budget, cut)).alias("p")).select(key, "p.page_no", "p.n_lines", "p.content")


def packed(text: Column, budget: int, cut: bool = False) -> Column:
    """The pages of a text (see ``pack_pages``) as array<struct<page_no, n_lines, content>>; a text that fits is one page as it is."""
    size = F.char_length
    page = lambda number, n, content: F.struct(number.cast("int").alias("page_no"), n.cast("int").alias("n_lines"), content.alias("content"))

    def step(acc: Column, line: Column) -> Column:
        fits = (acc["at"] > 0) & (acc["used"] + 1 + size(line) <= budget)
        used = F.when(fits, acc["used"] + 1 + size(line)).otherwise(size(line))
        return F.struct(used.cast("int").alias("used"), (acc["at"] + 1).alias("at"), F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["at"]))).alias("starts"))

    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    lines = F.split(text, "\n")
    whole = page(F.lit(1), F.size(lines), text)
    if cut:
        lines = F.flatten(F.transform(lines, lambda x: F.when(size(x) > budget, _cut(x, F.lit(budget))).otherwise(F.array(x))))

    def dealt(x: Column) -> Column:
        starts, every = x["starts"], x["lines"]
        stop = lambda i: F.coalesce(F.try_element_at(starts, i + 2), F.size(every))
        return F.transform(starts, lambda s, i: page(i + 1, stop(i) - s, F.array_join(F.slice(every, s + 1, stop(i) - s), "\n")))

    folded = lambda x: F.struct(x.alias("lines"), F.aggregate(x, start, step, lambda acc: acc["starts"]).alias("starts"))
    many = F.transform(F.transform(F.array(lines), folded), dealt)[0]
    return F.when(size(text) <= budget, F.array(whole)).otherwise(many)


#: The rule under a table's header.
TABLE_RULE = r"^\s*\|[|\-: ]*\z"


def _cut(line: Column, width: Column) -> Column:
    """A line as pieces of at most width characters, cut at the last blank of a piece's last fifth where it has one."""

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        piece = F.substr(rest, F.lit(1), width)
        blank = width - F.instr(F.reverse(piece), " ")
        at_blank = (F.instr(piece, " ") > 0) & (blank > 0) & (blank > width - F.floor(width / 5)) & (F.length(rest) > width)
        out = F.when(at_blank, F.substr(rest, F.lit(1), blank.cast("int"))).otherwise(piece)
        left = F.when(at_blank, F.substr(rest, (blank + 2).cast("int"))).otherwise(F.substr(rest, width + 1))
        return F.when(rest == "", acc).otherwise(F.struct(left.alias("rest"), F.concat(acc["out"], F.array(out)).alias("out")))

    rounds = F.sequence(F.lit(0), F.ceil(F.length(line) / F.greatest(width - F.floor(width / 5), F.lit(1))).cast("int"))
    return F.aggregate(rounds, F.struct(line.alias("rest"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"])


def _blocks(docs: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """key, block_no, n, big, head, tail and units of every block: paragraphs, tables and fenced blocks.

    A block longer than a page is big: its units are its lines, with head (a table's header, an opening fence) and tail (a
    closing fence) to repeat, unless the head takes over half a page; a line that no page can hold is cut, and each piece
    has a page of its own (alone). Another block is one unit.
    """
    each = Window.partitionBy(key).orderBy("line_no")
    kind = F.when(F.col("fence") > 0, F.concat(F.lit("fence "), F.col("fence").cast("string"))).when(F.trim(F.regexp_replace("line", r"\s", " ")) == "", "").when(F.ltrim("line").startswith("|"), "table").otherwise("text")
    lined = fenced_lines(docs, key, text).withColumn("kind", kind).withColumn("opens", (F.col("kind") != "") & (F.col("kind") != F.coalesce(F.lag("kind").over(each), F.lit(""))))
    numbered = lined.withColumn("block_no", F.sum(F.col("opens").cast("int")).over(each.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    blocks = numbered.groupBy(key, "block_no").agg(F.first("kind").alias("kind"), ordered.alias("lines")).withColumn("n", F.char_length(F.array_join("lines", "\n")))
    fence = F.trim(F.regexp_extract(F.col("lines")[0], FENCE, 1))
    table = (F.col("kind") == "table") & (F.size("lines") >= 2) & F.coalesce(F.try_element_at("lines", F.lit(2)).rlike(TABLE_RULE), F.lit(False))
    fenced = F.col("kind").startswith("fence")
    n_head = F.when(table, 2).when(fenced, 1).otherwise(0)
    closed = fenced & (F.size("lines") > 1) & (F.trim(F.element_at("lines", -1)) == fence)
    framed = blocks.withColumn("n_head", F.when(F.char_length(F.array_join(F.slice("lines", F.lit(1), n_head), "\n")) > budget // 2, 0).otherwise(n_head)).withColumn("big", F.col("n") > budget)
    framed = framed.withColumn("head", F.array_join(F.slice("lines", F.lit(1), F.col("n_head")), "\n")).withColumn("tail", F.when(fenced & (F.col("n_head") > 0), fence).otherwise(""))
    body = F.slice("lines", F.col("n_head") + 1, F.size("lines") - F.col("n_head") - F.when(closed & (F.col("n_head") > 0), 1).otherwise(0))
    extra = lambda c: F.when(F.col(c) == "", 0).otherwise(F.char_length(c) + 1)
    sized = framed.withColumn("frame", extra("head") + extra("tail")).withColumn("width", F.greatest(F.lit(budget) - F.col("frame"), F.lit(1)))
    unit = lambda t, alone: F.struct(t.alias("text"), F.char_length(t).alias("n"), alone.alias("alone"))
    cut = F.flatten(F.transform(body, lambda x: F.when(F.char_length(x) <= F.col("width"), F.array(unit(x, F.lit(False)))).otherwise(F.transform(_cut(x, F.col("width")), lambda p: unit(p, F.lit(True))))))
    return sized.select(key, "block_no", "n", "big", "head", "tail", "frame", F.when(F.col("big"), cut).otherwise(F.array(unit(F.array_join("lines", "\n"), F.lit(False)))).alias("units"))


def pack_blocks(docs: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """key, page_no and content: whole blocks packed into pages of at most ``budget`` characters, a blank line between them.

    A block that doesn't fit opens a page. One longer than a page tops the current page up if a quarter of it is left, and
    goes on from page to page; a table's header and a fence are repeated on each. A text that fits on one page stays as it
    is. The fold of a document sees the sizes of its units, not their text, and keeps where pages begin.
    """
    short = F.char_length(F.trim(F.col("text"))) <= budget
    texts = docs.select(key, F.regexp_replace(F.col(text), r"^\s+|\s+\z", "").alias("text"))
    whole = texts.where(short).select(key, F.lit(1).alias("page_no"), F.col("text").alias("content"))
    blocks = _blocks(texts.where(~short), key, "text", budget)
    units = blocks.select(key, "block_no", "big", "head", "tail", "frame", F.posexplode("units").alias("i", "u")).select(key, "block_no", "big", "head", "tail", "frame", "i", "u.*")
    units = units.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("block_no", "i")) - 1)

    def step(acc: Column, u: Column) -> Column:
        on, gap = acc["used"] > 0, F.when(acc["used"] > 0, 2).otherwise(0)
        goes_on = u["big"] & (acc["block"] == u["block_no"])
        size = F.when(goes_on, acc["used"] + 1 + u["n"]).otherwise(acc["used"] + gap + u["frame"] + u["n"])
        little = u["big"] & ~goes_on & on & (F.lit(budget) - acc["used"] - 2 < budget // 4)
        fits = on & (size <= budget) & ~little & ~u["alone"]
        starts = F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["at"])))
        used = F.when(fits, size).otherwise(u["frame"] + u["n"])
        return F.struct(used.cast("int").alias("used"), u["block_no"].cast("long").alias("block"), (acc["at"] + 1).alias("at"), starts.alias("starts"))

    frame = F.when(F.col("big"), F.col("frame")).otherwise(0).cast("int").alias("frame")
    sizes = units.select(key, F.struct("at", F.col("block_no").cast("long").alias("block_no"), "big", frame, "n", "alone").alias("u")).groupBy(key).agg(F.array_sort(F.collect_list("u")).alias("us"))
    start = F.struct(F.lit(0).alias("used"), F.lit(-1).cast("long").alias("block"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    opens = sizes.select(key, F.explode(F.aggregate("us", start, step, lambda acc: acc["starts"])).alias("at"), F.lit(1).alias("opens"))
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    paged = units.join(opens, [key, "at"], "left").withColumn("page_no", F.sum(F.coalesce("opens", F.lit(0))).over(upto).cast("int"))
    chunks = paged.groupBy(key, "page_no", "block_no", "big", "head", "tail").agg(joined("at", "text").alias("body"))
    around = F.concat(F.when(F.col("head") == "", "").otherwise(F.concat("head", F.lit("\n"))), F.col("body"), F.when(F.col("tail") == "", "").otherwise(F.concat(F.lit("\n"), F.col("tail"))))
    chunks = chunks.withColumn("chunk", F.when(F.col("big"), around).otherwise(F.col("body")))
    return whole.unionByName(chunks.groupBy(key, "page_no").agg(joined("block_no", "chunk", "\n\n").alias("content")))
