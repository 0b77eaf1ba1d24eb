"""Inputs of the queries, derived from the shared tables: logs, Markdown, JSON, diffs, pages, grids, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevia.operators.lines import joined

LINES_A_PAGE = 6


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, line_no, line: the events of each user as a log."""
    return read(spark, sf_dir, "events").selectExpr(
        "user_id", "row_number() over (partition by user_id order by ts, event_id) as line_no",
        "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', upper(event_type), ' event ', cast(event_id as string)) as line",
    )


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, md: each conversation with a heading per turn, answers one level below questions."""
    turns = read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "concat(if(role = 'user', '## ', '### '), 'Turn ', cast(turn as string), ' ', role, '\\n\\n', text) as part")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n\n")
    return turns.groupBy("conv_id").agg(F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), parts).alias("md"))


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc: a nested object per order: id, status, owner (key, priority), items (n, part, qty)."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    dealt = read(spark, sf_dir, "lineitem").repartition("l_orderkey")  # before they are listed: lists don't shrink by being made twice
    items = dealt.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    item = F.transform("lines", lambda x: F.struct(x["l_linenumber"].alias("n"), x["l_partkey"].alias("part"), x["l_quantity"].cast("long").alias("qty")))
    owner = F.struct(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("priority"))
    orders = read(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), owner.alias("owner"), item.alias("items")).alias("doc"))


def json_texts(spark: SparkSession, sf_dir: str, most: int = 1_000) -> DataFrame:
    """o_custkey, block, text: each customer's orders as JSON values side by side, or in an array, some with another type, some with a rest that is no JSON."""
    note = F.to_json(F.struct(F.concat(F.lit('a "b" }{ [ \\ '), F.col("o_orderpriority")).alias("note")))
    key = F.when(F.col("o_orderkey") % 13 == 0, '"late"').otherwise(F.col("o_orderkey").cast("string"))
    one = F.concat(F.lit('{"key":'), key, F.lit(","), F.substr(note, F.lit(2)))
    place = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long")
    rows = read(spark, sf_dir, "orders").select("o_custkey", place.alias("place"), one.alias("one")).withColumn("block", F.floor(F.col("place") / most).cast("int"))
    listed = rows.groupBy("o_custkey", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "one"))), lambda x: x["one"]).alias("all"))
    beside = F.array_join("all", "\n")
    for rest, sign in ((1, ""), (2, " \n "), (3, "\r\n")):
        beside = F.when(F.col("o_custkey") % 4 == rest, F.array_join("all", sign)).otherwise(beside)
    text = F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("[ "), F.array_join("all", " ,\n"), F.lit("]"))).otherwise(beside)
    return listed.select("o_custkey", "block", F.concat(text, F.when(F.col("o_custkey") % 7 == 0, " trailing").otherwise("")).alias("text"))


def customer_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, entries: a map of text with nulls and empty values."""
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "map('name', c_name, 'segment', nullif(c_mktsegment, 'BUILDING'), 'nation', if(c_nationkey % 3 = 0, '', cast(c_nationkey as string))) as entries"
    )


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, line_no, line: per conversation a diff of two files: a hunk per turn that replaces its lines, every third by more white space alone, and a new file."""
    turns = read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text", "if(turn % 3 = 0, replace(text, ' ', '  '), translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) as new")
    marked = lambda sign, column: F.transform(F.split(column, "\n"), lambda x: F.concat(F.lit(sign), x))
    head = F.array(F.concat(F.lit("@@ -"), F.col("turn").cast("string"), F.lit(" +"), F.col("turn").cast("string"), F.lit(" @@")))
    hunks = turns.select("conv_id", "turn", F.posexplode(F.concat(head, marked("-", "text"), marked("+", "new"))).alias("k", "line"))
    hunks = hunks.select("conv_id", (F.col("turn").cast("long") * 10_000_000 + F.col("k") + 10).alias("line_no"), "line")
    names = turns.select("conv_id").distinct().selectExpr("conv_id", "concat('c', cast(conv_id as string), '.txt') as name")
    first = names.selectExpr("conv_id", "posexplode(array(concat('diff --git a/', name, ' b/', name), concat('--- a/', name), concat('+++ b/', name))) as (k, line)").selectExpr("conv_id", "cast(k as bigint) as line_no", "line")
    second = names.selectExpr(
        "conv_id", "posexplode(array(concat('diff --git a/new-', name, ' b/new-', name), 'new file mode 100644', '--- /dev/null', concat('+++ b/new-', name), '@@ -0,0 +1 @@', '+one line')) as (k, line)"
    ).selectExpr("conv_id", "1000000000000L + k as line_no", "line")
    return hunks.unionByName(first).unionByName(second)


def log_texts(spark: SparkSession, sf_dir: str, most: int = 5_000) -> DataFrame:
    """user_id, block, text: each user's log in texts of at most so many lines, so no row grows with the table."""
    lines = logs(spark, sf_dir).withColumn("block", F.floor((F.col("line_no") - 1) / most).cast("int"))
    return lines.groupBy("user_id", "block").agg(joined("line_no", "line").alias("text"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, line: each conversation as the event lines of a session: a start, two reports of each answer with a tool's use, results, a line that is no JSON, an end."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("long").alias("turn"), "role", "text")
    usage = lambda n: F.struct(n.cast("long").alias("input_tokens"), F.col("turn").alias("cache_creation_input_tokens"), F.lit(2).alias("cache_read_input_tokens"), F.lit(3).alias("output_tokens"))
    name = F.when(F.col("turn") % 3 == 0, "Bash").when(F.col("turn") % 3 == 1, "mcp__files__read_it").otherwise("Edit")
    use = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), name.alias("name"), F.struct(F.lit(" grep -n x").alias("command")).alias("input")))
    said = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    head = lambda n, blocks: F.concat(F.lit('{"type":"assistant","message":{"id":"m'), F.col("turn").cast("string"), F.lit('","usage":'), F.to_json(usage(n)), F.lit(',"content":['), blocks, F.lit("]}}"))
    content = F.when(F.col("turn") % 4 < 2, F.substring(F.to_json(F.array("text")), 2, 2**30)).otherwise(F.concat(F.lit('[{"type":"text","text":"ab"},'), said, F.lit("]]")))
    result = F.concat(F.lit('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"t'), (F.col("turn") - 1).cast("string"), F.lit('","content":'), F.expr("substr(c, 1, length(c) - 1)"), F.lit("}]}}"))
    lines = turns.withColumn("c", content).select("session", (F.col("turn") * 4 + 10).alias("at"), F.when(F.col("role") == "user", F.array(result)).otherwise(F.array(head(F.lit(1), said), F.lit("{broken"), head(F.length("text"), use))).alias("lines"))
    lines = lines.select("session", "at", F.posexplode("lines").alias("k", "line")).select("session", (F.col("at") + F.col("k")).alias("seq"), "line")
    whole = turns.groupBy("session").agg(F.count("*").alias("n"))
    status = F.when(F.col("session") % 7 == 0, "failed").otherwise("connected")
    start = whole.select("session", F.lit(0).cast("long").alias("seq"), F.concat(F.lit('{"type":"system","subtype":"init","mcp_servers":[{"name":"files","status":"'), status, F.lit('"}]}')).alias("line"))
    fails = F.col("session") % 5 == 0
    done = F.concat(F.lit('{"type":"result","subtype":"'), F.when(fails, "error_max").otherwise("success"), F.lit('","is_error":'), fails.cast("string"), F.lit(',"result":"done\\nall","total_cost_usd":0.25,"num_turns":'), F.col("n").cast("string"),
                    F.lit(',"duration_ms":1500,"permission_denials":[{"tool":"x"}],"modelUsage":{"big":{"inputTokens":100,"outputTokens":5},"small":{"inputTokens":'), F.col("n").cast("string"), F.lit("}}}"))
    return lines.unionByName(start).unionByName(whole.select("session", F.lit(1_000_000).cast("long").alias("seq"), done.alias("line")))


def framed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, md: each conversation as Markdown with a table of its turns and a fenced block of its questions."""
    turns = read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "text", "concat('| ', cast(turn as string), ' | ', role, ' | ', cast(length(text) as string), ' |') as row")
    ordered = lambda column: F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", column))), lambda x: x[column])
    parts = turns.groupBy("conv_id").agg(F.array_join(ordered("row"), "\n").alias("rows"), F.array_join(ordered("text"), "\n\n").alias("body"), F.array_join(ordered("text"), "\n").alias("code"))
    return parts.selectExpr("conv_id", "concat('# Turns\n\n| turn | role | size |\n|---|---|---|\n', rows, '\n\n## Text\n\n', body, '\n\n````text\n', code, '\n````') as md")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, line_no, line: documents cut into pages, each with a header and a number line."""
    lines = read(spark, sf_dir, "documents").selectExpr("doc_id", "posexplode(split(text, '\\n')) as (k, line)").selectExpr("doc_id", f"k div {LINES_A_PAGE} + 1 as page_no", "k + 1 as line_no", "line")
    pages = lines.select("doc_id", "page_no").distinct()
    head = pages.selectExpr("doc_id", "page_no", "0L as line_no", "concat('Corpus report, part ', cast(page_no as string)) as line")
    foot = pages.selectExpr("doc_id", "page_no", "1000000L as line_no", "concat('- ', cast(page_no + 2 as string), ' -') as line")
    return lines.unionByName(head).unionByName(foot)


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet, row_no, cells: the nations of a region with a blank column and blank rows between."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    full = rows.selectExpr("r_name as sheet", "cast(n_nationkey * 2 as bigint) as row_no", "array(n_name, '', cast(n_nationkey as string), ' ') as cells")
    return full.unionByName(rows.selectExpr("r_name as sheet", "cast(n_nationkey * 2 + 1 as bigint) as row_no", "array('', ' ') as cells"))


def site_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, path, size: the paths of each site, with the largest page seen at each."""
    parts = read(spark, sf_dir, "pages").selectExpr(
        "regexp_extract(url, '^[a-z]+://[^/?#]*?([^./?#]+[.][^./?#]+)(?=[/?#]|$)', 1) as root",
        "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '') as path", "cast(length(html) as bigint) as size",
    )
    return parts.where("path <> ''").groupBy("root", "path").agg(F.max("size").alias("size"))
