"""Transcripts, one JSON event a line, as one row a session.

Every line gives some facts: usage of a model call, a tool's use, a tool's result, the end. Uses and results of one tool
call meet by its id, and so do the reports of one model call. That takes three aggregations with partial sums, each over
fewer rows than the one before; no transcript is gathered or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.operators.report import first_line, tool_label

_USAGE = "struct<input_tokens: long, cache_creation_input_tokens: long, cache_read_input_tokens: long, output_tokens: long>"
_BLOCK = "struct<type: string, id: string, name: string, input: struct<command: string>, tool_use_id: string, content: variant>"
#: An event of a transcript (the fields that are read, whatever the type of the event).
EVENT = (
    f"type string, subtype string, mcp_servers array<struct<name: string, status: string>>, message struct<id: string, usage: {_USAGE}, content: variant>, is_error boolean, result string, total_cost_usd double, num_turns int, duration_ms long,"
    f" usage {_USAGE}, modelUsage map<string, struct<inputTokens: long, outputTokens: long, cacheReadInputTokens: long, cacheCreationInputTokens: long>>, permission_denials array<string>"
)
_FACT = "struct<what:string,id:string,label:string,chars:bigint,usage:struct<context:bigint,output:bigint>,end:struct<answer:string,cost:double,turns:int,duration_ms:bigint,denied:int,output:bigint,side_tokens:bigint,error:string>,error:string>"


def tool_text(content: Column) -> Column:
    """The text of the result ``b.content`` of a tool (a variant): a text, or the texts of a list of parts."""
    parts = F.expr("try_cast(b.content as array<struct<text: string>>)")
    return F.coalesce(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.when(F.expr("schema_of_variant(b.content)") == "STRING", content.cast("string")), F.lit(""))


def _total(*counts: Column) -> Column:
    return sum((F.coalesce(c, F.lit(0)) for c in counts[1:]), F.coalesce(counts[0], F.lit(0)))


def _end(e: Column) -> Column:
    used = F.transform(F.map_values(e["modelUsage"]), lambda u: _total(u["inputTokens"], u["outputTokens"], u["cacheReadInputTokens"], u["cacheCreationInputTokens"]))
    side = F.coalesce(F.aggregate(used, F.lit(0).cast("long"), lambda a, b: a + b) - F.array_max(used), F.lit(0))
    error = F.when(e["is_error"], first_line(F.concat(F.coalesce(e["subtype"], F.lit("")), F.lit(": "), F.coalesce(e["result"], F.lit("")))))
    return F.struct(e["result"].alias("answer"), e["total_cost_usd"].alias("cost"), e["num_turns"].alias("turns"), e["duration_ms"].alias("duration_ms"), F.coalesce(F.size(e["permission_denials"]), F.lit(0)).alias("denied"),
                    e["usage"]["output_tokens"].alias("output"), side.alias("side_tokens"), error.alias("error"))


def _facts(lines: DataFrame, server: str | None) -> DataFrame:
    """session, seq, fact of every line that says one; lines that are no JSON object say nothing."""
    event = lines.select("session", "seq", F.from_json("line", EVENT).alias("e"))
    e = F.col("e")
    null = lambda kind: F.lit(None).cast(kind)

    def fact(what: str, id: Column, label=null("string"), chars=null("long"), usage=null("struct<context:bigint,output:bigint>"), end=None, error=null("string")) -> Column:  # noqa: B008
        end = null(_FACT.split(",end:")[1].rsplit(",error:string>", 1)[0]) if end is None else end
        return F.struct(F.lit(what).alias("what"), id.alias("id"), label.alias("label"), chars.cast("long").alias("chars"), usage.alias("usage"), end.alias("end"), error.alias("error"))

    usage = e["message"]["usage"]
    call = fact("call", e["message"]["id"], usage=F.struct(_total(usage["input_tokens"], usage["cache_creation_input_tokens"], usage["cache_read_input_tokens"]).alias("context"), F.coalesce(usage["output_tokens"], F.lit(0).cast("long")).alias("output")))
    one = [F.when((e["type"] == "assistant") & usage.isNotNull() & (e["message"]["id"] != ""), call), F.when(e["type"] == "result", fact("end", F.lit(""), end=_end(e)))]
    if server:
        status = F.coalesce(F.try_element_at(F.filter(e["mcp_servers"], lambda s: s["name"] == server), F.lit(1))["status"], F.lit("missing"))
        one.append(F.when((e["type"] == "system") & (e["subtype"] == "init") & (status != "connected"), fact("start", F.lit(""), error=F.concat(F.lit(f"server {server} "), status))))
    of_lines = event.select("session", "seq", F.lit(0).alias("k"), F.explode(F.array_compact(F.array(*one))).alias("f"))
    content = F.expr(f"try_cast(e.message.content as array<{_BLOCK}>)")
    blocks = event.where(e["type"].isin("assistant", "user")).select("session", "seq", e["type"].alias("type"), content.alias("blocks")).select("session", "seq", "type", F.posexplode("blocks").alias("k", "b"))
    b, place = F.col("b"), F.concat(F.lit("#"), F.col("seq").cast("string"), F.lit("."), F.col("k").cast("string"))
    use = fact("tool", F.coalesce(b["id"], place), label=tool_label(b["name"], b["input"]["command"]))
    answer = fact("tool", F.coalesce(b["tool_use_id"], place), chars=F.length(tool_text(b["content"])))
    of_blocks = blocks.select("session", "seq", "k", F.when((F.col("type") == "assistant") & (b["type"] == "tool_use"), use).when((F.col("type") == "user") & (b["type"] == "tool_result"), answer).alias("f")).where("f is not null")
    return of_lines.unionByName(of_blocks)


def sessions(lines: DataFrame, server: str | None = None) -> DataFrame:
    """One row a session of (session, seq, line): its calls, tools and end.

    n_calls, input_total, context_end (largest context of a call) and output_total: of model calls, each as reported last.
    tools: the labels of tool uses by name, each with how often if more than once. n_tools, n_unanswered (uses without a
    result), tool_chars (of all results) and top_tool (the label whose results are longest). answer, cost, turns,
    duration_ms, denied, side_tokens (of all models but the busiest) and error: from the last result line; with ``server``
    the error is first that this tool server was not connected. Lines that are no JSON, and events of other types, count
    for nothing; a session of such lines has no row. Rows may come in any order, seq orders them.
    """
    facts = _facts(lines, server)
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.struct("seq", "k")))
    by_id = facts.groupBy("session", "f.what", "f.id").agg(
        last("f.usage", F.col("f.usage").isNotNull()).alias("usage"), F.max("f.label").alias("label"), F.count("f.label").alias("uses"), F.count("f.chars").alias("answers"), F.sum("f.chars").alias("chars"),
        last("f.end", F.col("f.end").isNotNull()).alias("end"), F.min("f.error").alias("error"),
    )
    by_label = by_id.groupBy("session", "what", "label").agg(
        F.count("*").alias("n"), F.sum("usage.context").alias("input_total"), F.max("usage.context").alias("context_end"), F.sum("usage.output").alias("output_total"), F.sum("uses").alias("uses"),
        F.count_if((F.col("uses") > 0) & (F.col("answers") == 0)).alias("unanswered"), F.sum("chars").alias("chars"), F.max_by("end", F.col("end").isNotNull()).alias("end"), F.min("error").alias("error"),
    )
    is_call, used = F.col("what") == "call", F.col("label").isNotNull()
    shown = F.when(used, F.concat("label", F.when(F.col("uses") > 1, F.concat(F.lit("×"), F.col("uses").cast("string"))).otherwise("")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    ends = F.max_by("end", F.col("end").isNotNull())
    whole = by_label.groupBy("session").agg(
        zero(F.sum(F.when(is_call, F.col("n")))).alias("n_calls"), zero(F.sum("input_total")).alias("input_total"), zero(F.max("context_end")).alias("context_end"), zero(F.sum("output_total")).alias("output_total"),
        F.array_join(F.array_sort(F.collect_list(shown)), ", ").alias("tools"), zero(F.sum("uses")).alias("n_tools"), zero(F.sum("unanswered")).alias("n_unanswered"), zero(F.sum("chars")).alias("tool_chars"),
        F.max_by(F.when(used, F.col("label")), F.when(used & (F.col("chars") > 0), F.struct("chars", "label"))).alias("top_tool"), ends.alias("end"), F.min("error").alias("start_error"),
    )
    rest = [F.col(f"end.{c}").alias(c) for c in ("answer", "cost", "turns", "duration_ms", "denied", "side_tokens")]
    return whole.select("session", "n_calls", "input_total", "context_end", "output_total", "tools", "n_tools", "n_unanswered", "tool_chars", "top_tool", *rest, F.coalesce("start_error", "end.error").alias("error"))
