"""Work that must not grow faster than its input: parts are made once, and pages are cut inside their row."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from brevia import api
from brevia.operators import json_docs, json_values, pages
from brevia.sources import detect


def test_a_leaf_is_written_once_however_deep_it_lies(spark):
    kind = "s: string, n: long"
    for _ in range(4):
        kind = f"s: string, deep: struct<{kind}>"
    rows = spark.createDataFrame([('{"s":"x\\"y","deep":{"s":"","deep":{"deep":{"deep":{"n":7}}}}}',)], "t string").select(F.from_json("t", f"struct<{kind}>").alias("v"))
    laid = rows.select(json_docs.shrink(F.col("v"), rows.schema["v"].dataType, width=60).alias("j"))
    assert laid._jdf.queryExecution().analyzed().toString().count("to_json(") == 5  # one a text
    assert laid.first()["j"] == '{"s":"x\\"y","deep":{"deep":{"deep":{"deep":{"n":7}}}}}'


def test_one_value_needs_no_cuts(spark):
    texts = ['{"a":"b c"}', '{"a":1}{"a":2}', '[1,2]', '{"a": 1}', '{}],[{}', '{"a":1}]', '{"a":""}', ' {"a":1}', '{"a":1.50}', "", None, '{"a":1} x']
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", json_values.values(F.col("t")).alias("fast"), json_values._cut_up(F.col("t")).alias("slow")).orderBy("k").collect()
    assert [r["fast"] for r in got] == [r["slow"] for r in got]


def test_pages_are_cut_inside_their_row(spark):
    texts = ["", "a", "a\n" * 300, "b" * 1200 + "\nc", "x " * 900, "y" * 500, "z" * 501]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    one = docs.select("k", pages.packed(F.col("t"), 500, True).alias("p"))
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: [(p["page_no"], p["n_lines"], p["content"]) for p in r["p"]] for r in one.collect()}
    assert all(len(c) <= 500 for p in got.values() for _, _, c in p) and [n for n, _, _ in got[2]] == [1, 2]
    assert got[0] == [(1, 1, "")] and got[5] == [(1, 1, "y" * 500)] and "\n".join(c for _, _, c in got[2]) == texts[2] and got[6] == [(1, 1, "z" * 500), (2, 1, "z")]


def test_kinds_are_found_once_and_by_the_ends_of_a_text(spark):
    docs = spark.createDataFrame([("a", "<p>x", None, "text/html"), ("b", "diff --git a/x b/x\n", None, None), ("c", " \r\n[1]\t", None, None), ("d", "[1] x", None, None), ("e", None, None, None), ("f", " ", None, None)], "id string, text string, path string, content_type string")
    kind = docs.select("id", detect.kind(F.col("text"), F.col("path"), F.col("content_type")).alias("kind"))
    assert "[ \\t\\r\\n]+\\z" not in kind._jdf.queryExecution().analyzed().toString()  # a pattern that looks at every blank of a text
    assert {r["id"]: r["kind"] for r in kind.collect()} == {"a": "html", "b": "diff", "c": "json", "d": "text", "e": "text", "f": "text"}
    assert "<!doctype html" not in api.read_docs(docs)._jdf.queryExecution().optimizedPlan().toString()  # no branch looks for it again


def test_outlines_read_each_record_once_and_only_headed_lines(spark):
    docs = spark.createDataFrame(
        [("a", '{"n":1,"rows":[{"s":"x"},{"s":null}]}', None, "application/json"), ("b", '{"n":"no"}', None, "application/json"), ("c", "plain # words\n    # code", None, None), ("d", "text\n## Head\nmore", None, None),
         ("e", "```\n# fenced\n```", None, None), ("f", None, None, None), ("g", '{"n":2} {"n":3,"rows":[]}', None, None), ("d", "text\n## Head\nmore", None, None)],
        "id string, text string, path string, content_type string",
    )
    made = api.read_outlines(docs, T.StructType.fromDDL("n long, rows array<struct<s: string>>"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    one = docs.select(detect.kind(F.col("text"), F.col("path"), F.col("content_type")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_no_fit,StringType") == 1 and 0 < plan.count("<!doctype html") <= one.count("<!doctype html")  # a record is read by the schema once, a kind is found once
    assert sorted((r["id"], r["outline"]) for r in made.collect()) == [
        ("a", 'JSON of about 10 tokens\n{n: number (1), rows: [2] {s?: string ("x")}}'), ("c", "no headings; about 6 tokens, ask for page=1"), *[("d", "1 headings, about 5 tokens; ask for section=<id>\n1. Head (~3)")] * 2,
        ("e", "no headings; about 4 tokens, ask for page=1"), ("g", "JSON of about 5 tokens\n{n: number (2)}"), ("g", "JSON of about 5 tokens\n{n: number (3), rows: [0]}"), ("g", "no headings; about 7 tokens, ask for page=1"),
    ]


def test_one_value_has_the_shape_of_a_list_of_it(spark):
    kind = T.StructType.fromDDL("id long, name string, one struct<t: string, l: array<array<int>>>, many array<struct<t: string, n: double, deep: array<string>>>, m map<string, int>, wide struct<" + ", ".join(f"f{i}: boolean" for i in range(70)) + ">")
    texts = ['{}', '{"id":1,"name":""}', '{"name":"' + "y" * 40 + '","one":{}}', '{"one":{"t":"q\\"","l":[[1],[],null]},"many":[{"t":""},null,{"n":1.5,"deep":[]},{"deep":[null,"z"]}]}', '{"many":[null],"m":{"a":null}}', '{"wide":{"f1":true,"f69":false}}']
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(F.from_json("t", kind).alias("v"))
    value = F.col("v")
    for r in got.select(json_docs.shape_of(value, kind).alias("one"), json_docs.shape_text(F.array(value), kind).alias("list"), json_docs.n_chars(value).alias("n"), F.length(json_docs.shrink(value, kind, keep_empty=True)).alias("size")).collect():
        assert r["one"] == r["list"] and r["n"] == r["size"], r
