"""Texts of several JSON values against Python's decoder, and their records."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from brevia import api
from brevia.operators import json_docs, json_values

KIND = T.StructType([T.StructField("a", T.LongType()), T.StructField("s", T.StringType())])


def any_value(rng, depth=0):
    pick = rng.randrange(7 if depth < 3 else 5)
    text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", " ", "\n", "x", "é", "", "", "😀"]) for _ in range(rng.randrange(9)))
    if pick < 5:
        return [None, True, rng.randrange(-99, 99), rng.random(), text][pick]
    every = [any_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return every if pick == 5 else {f"{text}{k}": v for k, v in enumerate(every)}


def test_values_are_those_of_a_decoder(spark):
    rng, rows = random.Random(4), []
    for _ in range(300):
        every = [any_value(rng) for _ in range(rng.randrange(5))]
        shown = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1])) for v in every]
        tight = all(t[0] in '{["' and t[-1] in ']}"' for t in shown)
        rows.append((rng.choice(["\n", " ", "\r\n\t"] + [""] * tight).join(shown), every))
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string").select("k", json_values.values(F.col("t")).alias("v")).collect()
    own = lambda x: json.dumps(x).replace("\\ue001", "\\ufffd").replace("\\ue014", "\\ufffd")  # noqa: E731  private signs may be replaced
    for r in got:
        assert own([json.loads(v["value"]) for v in r["v"]]) == own(rows[r["k"]][1]) and all(v["ok"] for v in r["v"])


def records(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumns({"n": F.lit("x"), "error": F.lit(1), "_item": F.lit(2)})
    got = sorted(json_values.records(rows, "t", KIND).collect(), key=lambda r: (r["id"], r["n"]))
    return [[(r["record"] and r["record"]["a"], r["error"]) for r in got if r["id"] == k] for k in range(len(texts))]


def test_records_lose_nothing(spark):
    bad, misfit = (None, "invalid JSON"), (None, "does not fit the schema")
    got = records(spark, '{"a":1}\n{"a":2}\n{"a":3}', '{"a":1} trailing text 5 true', '[{"a":1},{"a":2}]{"a":3}', '{"a":"oops"}', '{"a":1},{"a":2}', '{"a":1}}', "", None, "[]", '{"s":"} {\\" ["}', '[{"a":1},5,null,"q",[1]]',
                  "words 12 and so on", '{"a":1 {"a":2} [3', '{"a":9223372036854775808}', "{'a':1}", '"open {"a":1}', '{"a":1}\n oops \n{"a":2}', "1 2 3", '{"a":null}', '{"a":NaN}', '{"s":"' + "\\\\" * 30_000 + '"} {"a":7}')
    one = lambda *a: [(x, None) for x in a]
    none = [(None, "no JSON value")]
    assert got == [one(1, 2, 3), [*one(1), bad], one(1, 2, 3), [misfit], [bad], [bad], none, none, [], one(None), [*one(1), misfit, misfit, misfit, misfit], [bad], [bad, *one(2), bad], [misfit], [bad], [misfit], [*one(1), bad, *one(2)], [misfit], one(None), [bad], one(None, 7)]


def test_read_json_of_several_values_and_roots(spark):
    rows = [("lines", '{"a":1}\n{"a":2}'), ("array", '[{"a":1},{"a":2,"s":"x"}]'), ("trailing", '{"a":1} x'), ("misfit", '{"a":"oops"}'), ("twice", '{"a":5}'), ("twice", '{"a":6}'), ("prose", "no JSON, 5 words"), ("none", None)]
    docs = spark.createDataFrame(rows, "id string, text string").withColumns({"path": F.lit("x.json"), "content_type": F.lit(None).cast("string")})
    docs = docs.withColumn("path", F.when(F.col("id") != "prose", F.col("path")))
    got = sorted((r["id"], r["n"], r["content"], r["error"]) for r in api.read_json(docs, KIND).na.fill("-").collect())
    assert got == [("array", 0, '{"a":1}', "-"), ("array", 1, '{"a":2,"s":"x"}', "-"), ("lines", 0, '{"a":1}', "-"), ("lines", 1, '{"a":2}', "-"), ("misfit", 0, "-", "does not fit the schema"),
                   ("prose", 0, "-", "invalid JSON"), ("trailing", 0, '{"a":1}', "-"), ("trailing", 1, "-", "invalid JSON"), ("twice", 0, '{"a":5}', "-"), ("twice", 0, '{"a":6}', "-")]
    whole = {r["id"]: r["content"] or r["error"] for r in api.read_json(docs.where("id <> 'twice'"), T.ArrayType(KIND), table=True).collect()}
    assert whole["lines"].count("\n") == 3 and whole["array"].endswith("| 2 | x |") and whole["trailing"] == "invalid JSON" and whole["misfit"] == "does not fit the schema"


def plain_layout(value, width, depth=0):
    flat = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    if not isinstance(value, (dict, list)) or not value or len(flat.encode()) <= width - depth:
        return flat
    pad = "\n" + " " * (depth + 1)
    parts = [json.dumps(k, ensure_ascii=False) + ":" + plain_layout(v, width, depth + 1) for k, v in value.items()] if isinstance(value, dict) else [plain_layout(v, width, depth + 1) for v in value]
    return ("{" if isinstance(value, dict) else "[") + pad + ("," + pad).join(parts) + pad[:-1] + ("}" if isinstance(value, dict) else "]")


def test_layout_breaks_what_is_too_wide(spark):
    rng, rows = random.Random(8), []
    for _ in range(120):
        item = lambda: {"k": rng.randrange(10 ** rng.randrange(1, 9)), "t": ["é" * rng.randrange(1, 30) for _ in range(rng.randrange(1, 4))]}
        rows.append({"name": "n" * rng.randrange(1, 60), "items": [item() for _ in range(rng.randrange(1, 6))], "grid": [[rng.randrange(1000) for _ in range(rng.randrange(1, 20))] for _ in range(rng.randrange(1, 4))], "one": {"two": {"three": "x" * rng.randrange(1, 70)}}})
    kind = "name string, items array<struct<k: long, t: array<string>>>, grid array<array<long>>, one struct<two: struct<three: string>>"
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "k int, t string").select("k", F.from_json("t", kind).alias("v"))
    schema = df.schema["v"].dataType
    for width in (100, 40):
        got = {r["k"]: r["s"] for r in df.select("k", json_docs.shrink(F.col("v"), schema, width=width).alias("s")).collect()}
        for k, r in enumerate(rows):
            assert got[k] == plain_layout(r, width), r
    notes = df.select(json_docs.shrink(F.col("v"), schema, most_items=1, drop=("grid", "one"), max_text=3, width=30).alias("s")).first()["s"]
    assert json.loads(notes)["name"].startswith("nnn"[: len(rows[0]["name"])]) and max(map(len, notes.split("\n"))) < 60


def test_pages_keep_their_budget_and_rows(spark):
    order = json.dumps({"id": 1, "rows": [{"n": k, "text": "word " * 9} for k in range(200)]})
    rows = [("json", order, "x.json"), ("line", "x" * 19_000, "a.txt"), ("line", "y" * 700 + " " + "z" * 700, "a.txt"), ("same", "one\ntwo", "a.txt"), ("same", "one\ntwo", "a.txt")]
    docs = spark.createDataFrame(rows, "id string, text string, path string").withColumn("content_type", F.lit(None).cast("string"))
    kind = T.StructType.fromDDL("id int, rows array<struct<n: int, text: string>>")
    first = [(r["id"], r["content"]) for r in api.read_page(docs, 1, 1000, kind).collect()]
    assert sorted(i for i, _ in first) == ["json", "line", "line", "same", "same"]
    assert all(len(c.rsplit("\n\n[", 1)[0]) <= 1000 for _, c in first)
    shown = dict(first)["json"]
    assert shown.startswith('{\n "id":1,\n "rows":[\n  {"n":0,"text":"word ') and "[page 1 of " in shown
    n = int(shown.rsplit(" of ", 1)[1].split(" ")[0])
    every = [next(r["content"] for r in api.read_page(docs.where("id = 'json'"), k, 1000, kind).collect()).rsplit("\n\n[", 1)[0] for k in (1, 2, n)]
    assert every[1].startswith('  {"n":') and every[2].endswith("\n ]\n}")
    outlines = api.read_outlines(docs.withColumn("text", F.when(F.col("id") == "same", F.concat(F.lit("# A\n"), "text", F.col("path"))).otherwise(F.concat(F.lit("# "), F.substring("text", 1, 5)))).where("id <> 'json'")).collect()
    assert sorted(r["id"] for r in outlines) == ["line", "line", "same", "same"] and {r["outline"].split("\n")[1][:8] for r in outlines if r["id"] == "line"} == {"1. xxxxx", "1. yyyyy"}
    asked = spark.createDataFrame([("line", "1"), ("none", "1")], "id string, wanted string")
    got = api.read_section(docs.withColumn("text", F.concat(F.lit("# H\n"), "text")), asked).collect()
    assert sorted((r["id"], (r["section"] or r["error"])[4:8]) for r in got) == [("line", "xxxx"), ("line", "yyyy"), ("none", "uch ")]


def test_a_text_written_by_its_schema_is_read_at_once_like_any_other(spark):
    kind = T.StructType.fromDDL("id long, s string, x double, list array<struct<n: int, t: string>>, m map<string, int>, d date")
    one = '{"id":1,"s":"a b","x":1.5,"list":[{"n":1,"t":"é"},{"n":null,"t":""}],"m":{"a":1},"d":"2020-01-02"}'
    none = '{"id":2,"s":null,"x":null,"list":null,"m":null,"d":null}'
    texts = [one, none, one + one, one + "x", one + " ", one + "," + none, "[" + one + "]", none.replace("2", "2.0"), none.replace("null", '"\ue010 }{"', 1), none.replace("null", "{}", 1), none.replace("null", '"\\"{"', 1), '{"id":3}', '{"id":"4","s":1}', one[:-1], '{"id":5,"s":"a","s":"b"}', one.replace("1.5", "1.50"), one.replace('"a":1', '"a":1,"a":2')]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = lambda d: sorted((r["k"], r["n"], str(r["record"]), r["error"]) for r in json_values.records(d, "t", kind).collect())
    direct = docs.select("k", json_values._direct(F.col("t"), kind).alias("r")).where("r is not null")
    assert {r["k"] for r in direct.collect()} >= {0, 1, 10} and direct.where(F.col("k").isin(2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15)).count() == 0
    assert rows(docs) == rows(docs.withColumn("t", F.concat(F.lit(" "), "t")))  # which the schema doesn't write
