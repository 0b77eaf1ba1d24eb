"""Removal of whole elements of web pages, however their tags are nested: tag tokens as rows, depth by windows.

A page is cut before every tag. The running depth of each tag name pairs an opening tag with the closing one at its own
depth, so an element goes from its first to its own last tag. All windows and the joining of what is left go by page, so
pages are shuffled once; a page's tokens are the largest unit that meets in a task, and they are sorted, never held in a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brevia.operators import html

#: Elements whose content is no markup: they end at the next closing tag of their name (fixed values).
RAW = ["script", "style", "textarea", "noscript", "iframe"]
#: Elements without an end tag (fixed values).
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
_CUT = "\ue000"
#: Comments, and raw elements that hold no readable text, in one pass.
_UNREAD = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW)})(?=[\s>/])[^>]*>.*?(?:</\1\s*>|\z)"


def tokens(pages: DataFrame, key: str, column: str) -> DataFrame:
    """key, pos, piece, name, move and hides: a row for each tag with the text behind it, and for the text before the first.

    move is 1 for an opening tag, -1 for a closing one, 0 for tags without an end. hides says whether an opening tag's element
    is never read ("always"), or page furniture that goes where there is no article ("chrome").
    """
    bare = F.regexp_replace(F.replace(F.col(column), F.lit(_CUT), F.lit("")), _UNREAD, " ")
    cut = F.split(F.regexp_replace(bare, r"<(?=/?[a-zA-Z])", f"{_CUT}<"), _CUT, -1)
    rows = pages.select(key, F.posexplode(cut).alias("pos", "piece"))
    tag = F.regexp_extract("piece", r"^<[^>]*>", 0)
    named = rows.withColumns({"tag": tag, "name": F.lower(F.regexp_extract("piece", r"^</?([a-zA-Z][\w-]*)", 1))})
    own = ~F.col("name").isin("", *VOID) & ~F.col("tag").rlike(r"/>\z")
    move = F.when(F.col("piece").startswith("</"), -1).when(own, 1).otherwise(0)
    has = lambda rule: F.col("tag").rlike(r"(?i)\s(?:" + rule + ")")
    hidden = has(r"""hidden(?=[\s>=/])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"'>]*display\s*:\s*none""")
    role = has(rf"""role\s*=\s*["']?(?:{"|".join(html.ROLES)})["'\s>]""")
    hides = F.when(F.col("name").isin(*html.DROPPED, "head", "title") | hidden, "always").when(F.col("name").isin(*html.CHROME) | role, "chrome")
    return named.select(key, "pos", "piece", "name", move.alias("move"), F.when(move == 1, hides).alias("hides"))


def ended(found: DataFrame, key: str) -> DataFrame:
    """tokens with ``end``: the place of the closing tag of each opening one, null if it has none."""
    by_name = Window.partitionBy(key, "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    level = F.sum("move").over(by_name) + F.when(F.col("move") == -1, 1).otherwise(0)
    levelled = found.withColumn("level", F.when(F.col("move") != 0, level))
    at_level = Window.partitionBy(key, "name", "level").orderBy("pos")
    closes = (F.col("move") == 1) & (F.lead("move").over(at_level) == -1)
    return levelled.withColumn("end", F.when(closes, F.lead("pos").over(at_level))).drop("level")


def pruned(pages: DataFrame, key: str, column: str) -> DataFrame:
    """key, title and body of every page: its first article, or all of it without page furniture; never what isn't read.

    key must be unique. An element goes with all that it holds, whatever is nested in it; an opening tag without an end
    hides nothing, and a closing tag without a beginning is passed over. Items of a list inside another carry a private sign
    for each list around theirs. Null pages give no row.
    """
    found = ended(tokens(pages, key, column), key)
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    reach = lambda *kinds: F.coalesce(F.max(F.when(F.col("hides").isin(*kinds), F.col("end"))).over(upto), F.lit(-1))
    covered = found.withColumns({"gone": reach("always"), "aside": reach("always", "chrome")})
    article = F.when((F.col("name") == "article") & F.col("end").isNotNull() & (F.col("gone") <= F.col("pos")), F.struct("pos", "end"))
    placed = covered.withColumn("article", F.min(article).over(whole))
    inside = F.when(F.col("article").isNotNull(), (F.col("pos") >= F.col("article.pos")) & (F.col("pos") < F.col("article.end"))).otherwise(True)
    until = F.when(F.col("article").isNotNull(), F.col("gone")).otherwise(F.col("aside"))
    text = F.regexp_replace("piece", r"^<[^>]*>", "")
    lists = F.sum(F.when(F.col("name").isin("ul", "ol"), F.col("move")).otherwise(0)).over(upto)  # that are open behind the tag
    inner = (F.col("name") == "ul") & (F.when(F.col("move") == 1, F.col("lists") > 1).otherwise(F.col("lists") > 0))
    item = F.concat(F.repeat(F.lit(html.NESTED), F.greatest(F.col("lists") - 1, F.lit(0)).cast("int")), F.col("piece"))
    shown = F.when(inner, text).when((F.col("name") == "li") & (F.col("move") == 1), item).otherwise(F.col("piece"))
    placed = placed.withColumn("lists", lists)
    kept = F.when(inside & (until == F.col("pos")), F.concat(F.lit(" "), text)).when(inside & (until < F.col("pos")), shown)
    left = placed.select(key, "pos", kept.alias("piece"), F.when((F.col("name") == "title") & (F.col("move") == 1), F.struct("pos", text.alias("text"))).alias("title"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))), lambda x: x["piece"]), "")
    title = F.trim(F.regexp_replace(F.coalesce(F.min("title")["text"], F.lit("")), r"\s+", " "))
    return left.groupBy(key).agg(title.alias("title"), joined.alias("body"))


def markdown(pages: DataFrame, key: str, column: str) -> DataFrame:
    """key and markdown of every page: its article, or else the body without page furniture; the title first unless a heading opens with it.

    Headings, links, emphasis, code and its language, lists, tables, quotes and breaks keep their meaning; hidden elements,
    citation marks and other tags go. key must be unique. Malformed pages give what their tags say, never an error.
    """
    return pruned(pages, key, column).select(key, html.body_markdown(F.col("body"), F.col("title")).alias("markdown"))
