"""Measuring: ledgers of what was saved, two-arm comparisons, usage of sessions, grades of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.operators.grids import table_line


def savings_ledger(rows: DataFrame) -> DataFrame:
    """kind (null: all), n, raw_tokens, out_tokens and saved_pct (whole percent) from (kind, raw_tokens, out_tokens)."""
    summed = rows.rollup("kind").agg(F.count("*").alias("n"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("out_tokens").alias("out_tokens"))
    saved = F.when(F.col("raw_tokens") > 0, F.floor((F.col("raw_tokens") - F.col("out_tokens")) * 100 / F.col("raw_tokens")))
    return summed.withColumn("saved_pct", saved.cast("long"))


def ab_pivot(runs: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """task (null: all), and of each arm runs, mean tokens (whole) and correct; tasks without one of the arms are left out.

    runs: task, arm, tokens, correct. One aggregation with the arms as columns, then the total of its rows.
    """
    of = lambda arm, value: F.sum(F.when(F.col("arm") == arm, value))
    cells = [c for a in arms for c in (F.count_if(F.col("arm") == a).alias(f"{a}_runs"), of(a, F.col("tokens")).alias(f"{a}_tokens"), of(a, F.col("correct").cast("long")).alias(f"{a}_correct"))]
    tasks = runs.where(F.col("arm").isin(*arms)).groupBy("task").agg(*cells).where(" and ".join(f"{a}_runs > 0" for a in arms))
    sums = tasks.rollup("task").agg(*[F.sum(f"{a}_{m}").alias(f"{a}_{m}") for a in arms for m in ("runs", "tokens", "correct")])
    mean = lambda a: F.expr(f"{a}_tokens div {a}_runs").alias(f"{a}_mean")
    change = F.expr(f"(({arms[1]}_tokens div {arms[1]}_runs) - ({arms[0]}_tokens div {arms[0]}_runs)) * 100 div ({arms[0]}_tokens div {arms[0]}_runs)").alias("change_pct")
    return sums.select("task", *[c for a in arms for c in (F.col(f"{a}_runs"), mean(a), F.col(f"{a}_correct"))], change)


def session_usage(calls: DataFrame) -> DataFrame:
    """session, n_calls, input_total, context_end (largest) and output_total from (session, seq, call_id, input, output).

    A call that is reported again counts once, as reported last.
    """
    last = calls.groupBy("session", "call_id").agg(F.max_by(F.struct("input", "output"), "seq").alias("u"))
    return last.groupBy("session").agg(F.count("*").alias("n_calls"), F.sum("u.input").alias("input_total"), F.max("u.input").alias("context_end"), F.sum("u.output").alias("output_total"))


def normalise(answer: Column) -> Column:
    """Lower case, markup and thousands separators gone, single blanks."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(answer), r"[*_`]", ""), r"(?<=[0-9]),(?=[0-9]{3})", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def grade(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """answer_id, n_facts, n_missing and correct: a fact is there if one of its phrases stands in the answer as whole words.

    answers: answer_id, task, answer. facts: task, fact_no, phrases (array). Facts are few per task: the join is on task.
    """
    hit = F.exists("phrases", lambda p: F.regexp_like(normalise(F.col("answer")), F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower(p), F.lit(r"\E(?![\p{L}\p{N}])"))))
    graded = answers.join(facts, "task").withColumn("hit", hit)
    return graded.groupBy("answer_id").agg(F.count("*").alias("n_facts"), F.count_if(~F.col("hit")).alias("n_missing"), F.min("hit").alias("correct"))


def error_category(code: Column, status: Column) -> Column:
    """A coarse class of a failed read, from a structured code and an HTTP status."""
    return (
        F.when(code.isNull(), "").when((code == "http") & (status == 404), "not_found").when(code == "http", "network_error").when(code.isin("timeout", "cancelled"), "timeout")
        .when(code == "network", "network_error").when(code.isin("syntax", "truncated"), "invalid_input").when(code == "convert", "convert_error").otherwise("other")
    )


def context_size(calls: DataFrame) -> DataFrame:
    """calls with input: all tokens that a model call read, from fresh_input, cache_creation and cache_read."""
    return calls.withColumn("input", F.coalesce("fresh_input", F.lit(0)) + F.coalesce("cache_creation", F.lit(0)) + F.coalesce("cache_read", F.lit(0)))


def side_tokens(usage: DataFrame) -> DataFrame:
    """session and side_tokens from (session, model, tokens): what all models but the busiest one used."""
    models = usage.groupBy("session", "model").agg(F.sum("tokens").alias("tokens"))
    return models.groupBy("session").agg((F.sum("tokens") - F.max("tokens")).alias("side_tokens"))


def tool_label(name: Column, command: Column) -> Column:
    """A tool call's name without the prefix of its server; a shell call by its command's first word."""
    word = F.regexp_extract(command, r"^\s*(\S+)", 1)
    return F.when((name == "Bash") & (word != ""), F.concat(F.lit("Bash("), word, F.lit(")"))).otherwise(F.regexp_replace(name, r"^mcp__[^_]+(?:_[^_]+)*?__", ""))


def tools_summary(calls: DataFrame) -> DataFrame:
    """session and tools: the labels of (session, label) by name, each with how often if that is more than once."""
    counted = calls.groupBy("session", "label").agg(F.count("*").alias("n"))
    shown = F.when(F.col("n") > 1, F.concat("label", F.lit("×"), F.col("n").cast("string"))).otherwise(F.col("label"))
    return counted.groupBy("session").agg(F.array_join(F.array_sort(F.collect_list(shown)), ", ").alias("tools"))


def verdict(error: Column, correct: Column) -> Column:
    return F.when(F.coalesce(error, F.lit("")) != "", "error").when(correct, "yes").otherwise("no")


def first_line(text: Column) -> Column:
    return F.substring_index(F.trim(F.regexp_replace(text, r"^\s+|\s+\z", "")), "\n", 1)


def error_text(address: Column, status: Column, reason: Column) -> Column:
    """What went wrong with a read: the status of an answer, or the reason alone without the address it repeats."""
    bare = F.regexp_replace(reason, r'^(?:Get|Head|Post) "[^"]*": ', "")
    return F.when(status.isNotNull() & ~status.between(200, 299), F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" from "), address)).when(bare.isNotNull(), F.concat(F.lit("fetch "), address, F.lit(": "), bare))


def entry_size(markdown: Column, raw: Column) -> Column:
    """Bytes that an entry of the cache holds."""
    return (F.coalesce(F.octet_length(markdown), F.lit(0)) + F.coalesce(F.octet_length(raw), F.lit(0))).cast("long")


def markdown_report(rows: DataFrame, *order: str) -> DataFrame:
    """markdown: one Markdown table of a small summary, its rows by ``order`` (nulls last) and then as text.

    For reports, whose rows are bounded by what they sum up (kinds, tasks): they meet in one row.
    """
    line = table_line(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]))
    keys = [x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, line.alias("line")))), lambda x: x["line"]), "\n")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    return rows.agg(F.concat(F.lit(head), body).alias("markdown"))


def write_report(rows: DataFrame, out: str, *order: str) -> None:
    """A summary as a Markdown file and as JSON lines, in folders of ``out``; a second run replaces the first."""
    markdown_report(rows, *order).coalesce(1).write.mode("overwrite").text(f"{out}/markdown")
    rows.write.mode("overwrite").json(f"{out}/json")
