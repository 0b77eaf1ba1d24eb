"""Charsets, escapes in Markdown, selections by steps and sessions against plain loops."""

from __future__ import annotations

import codecs
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from brevia.functions.text import unescape_intraword
from brevia.operators import json_docs, sessions
from brevia.plans.queries import ORACLE_SQL, QUERIES
from brevia.sources import charsets, detect


@pytest.mark.parametrize("name", ["windows-1252", "windows-1250", "windows-1251", "koi8-r", "iso-8859-2", "iso-8859-5", "iso-8859-7", "iso-8859-15", "ibm866", "windows-1257"])
def test_declared_charsets(spark, name):
    codec = charsets.NAMES[name]
    every = bytes(range(1, 256))
    want = every.decode("latin-1")[:127] + charsets.table(codec)
    rows = [(1, every, f"text/plain; charset={name.upper()}"), (2, b"<html><META charset='" + name.encode() + b"'>" + every, None), (3, every, None), (4, every, "text/plain; charset=nothing-known"), (5, every, "text/plain; charset=utf-8")]
    got = {r["k"]: r["t"] for r in spark.createDataFrame(rows, "k int, b binary, c string").select("k", detect.decoded(F.col("b"), F.col("c")).alias("t")).collect()}
    assert got[1] == want and got[2].endswith(want) and got[3][127:] == charsets.table("cp1252") and got[4] == want[:127] + "�" * 128 and got[5].startswith(want[:127] + "�")
    assert want[128:].replace("�", "") == every[128:].decode(codec, "ignore") or codec == "cp1252"


def plain_unescape(text):
    """The rule line by line and sign by sign."""
    out, fence = [], ""
    for line in text.split("\n"):
        bare = line.lstrip(" ")
        if fence:
            fence = "" if bare.startswith(fence) and not bare.strip(fence[0]) else fence
            out.append(line)
            continue
        runs = [len(bare) - len(bare.lstrip(c)) for c in "`~"]
        if max(runs) >= 3:
            fence = "`~"[runs[1] >= 3] * max(runs)
            out.append(line)
            continue
        made, i = "", 0
        while i < len(line):
            if line[i] == "\\" and i + 1 < len(line):
                inside = line[i + 1] == "_" and made[-1:].isalnum() and line[i + 2 : i + 3].isalnum()
                made += "_" if inside else line[i : i + 2]
                i += 2
            elif line[i] == "`":
                n = len(line[i:]) - len(line[i:].lstrip("`"))
                j, end = i + n, i + n
                while j < len(line):
                    m = len(line[j:]) - len(line[j:].lstrip("`"))
                    if m == n:
                        end = j + m
                        break
                    j += max(m, 1)
                made += line[i:end]
                i = end
            else:
                made += line[i]
                i += 1
        out.append(made)
    return "\n".join(out)


def test_escapes_go_only_inside_words(spark):
    rng = random.Random(6)
    signs = ["a", "1", "é", "\\_", "\\_", "\\", "`", "``", "```", "~~~", "\n", "\n", " ", "*", "_", "\\`", "\n```\n", "\n````\n", "\n ~~~~\n"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", "a\\_b", "```\n" + "a\\_b\n" * 60_000 + "```\nc\\_d", "`" * 50_000 + "a\\_b", "a\\_b`" * 3_000, "~~~\na\\_b", "```"]
    got = {r["k"]: r["t"] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", unescape_intraword(F.col("t")).alias("t")).collect()}
    for k, text in enumerate(texts):
        assert got[k] == plain_unescape(text), repr(text[:300])


def test_words_of_any_first_line_as_sql(spark, tmp_path):
    texts = ["", "\n", "two words\nmore", "Привет мир\na b", "``", "\\_", "é\\_é", " - a\u00a0b_c -\r\nx", "```x\ny", "one", None, "中 1 文"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["unescape_intraword"](spark, str(tmp_path)).select("doc_id", "markdown").collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(ORACLE_SQL["unescape_intraword"]).fetchall()) and len(got) == 11


def test_steps_follow_the_run_rule(spark):
    doc = {"items": [{"name": "alpha", "tags": ["go", "x"], "owner": {"login": "octo"}}, {"name": "beta", "tags": None, "owner": None}, {"name": "gamma", "tags": ["y"], "owner": {"login": "dog"}}], "n": 3}
    df = spark.createDataFrame([(json.dumps(doc),)], "t string").select(F.from_json("t", "items array<struct<name: string, tags: array<string>, owner: struct<login: string>>>, n int").alias("v"))

    def taken(*steps):
        found = json_docs.select_steps(F.col("v"), df.schema["v"].dataType, *steps)
        return found and json.loads(df.select(F.to_json(F.array(found[0])).alias("j")).first()["j"])[0]

    each = json_docs.EACH
    assert taken("items", "name", 1) == "beta" and taken("items", each, "tags", 0) == ["go", "y"] and taken("items", "tags", 0) == ["go", "x"] and taken("n") == 3
    assert taken("items", each, "owner", "login") == ["octo", "dog"] == taken("items", "owner", "login") and taken("items", -1, "name") == "gamma" and taken("items", slice(0, 2), "name") == ["alpha", "beta"]
    assert taken("items", {"who": ("owner", "login"), "name": ("name",)}, 0) == {"who": "octo", "name": "alpha"} and taken("items", {"name": ("name",), "no": ("missing",)}, "name", -1) == "gamma"
    assert taken("items", 0, {"t": ("tags", slice(0, 5))}) == {"t": ["go", "x"]} and taken("items", 9) is None and taken("missing") is None and taken("n", 0) is None and taken("items", "missing") is None
    assert taken("items", slice(5, 10)) == [] and taken("items", each, {"n": ("name",)}, "n") == ["alpha", "beta", "gamma"]


def test_sessions_of_odd_lines(spark):
    use = lambda i, name, cmd=None: {"type": "tool_use", "id": i, "name": name, "input": {"command": cmd}}
    said = lambda m, usage, *blocks: json.dumps({"type": "assistant", "message": {"id": m, "usage": usage, "content": list(blocks)}})
    back = lambda i, content: json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": content}]}})
    lines = [
        ("a", 3, back("t1", '[{"text":"a text that looks like parts"}]')), ("a", 1, said("m1", {"input_tokens": 5}, use("t1", "Bash", "  ls -l"))), ("a", 2, said("m1", {"input_tokens": 7, "cache_read_input_tokens": 1, "output_tokens": 2})),
        ("a", 4, said("m2", {"input_tokens": 1}, use("t2", "mcp__x__look"), use("t3", "Bash", "ls"), use(None, "Edit"))), ("a", 5, back("t2", [{"type": "text", "text": "éa"}, {"type": "image"}])), ("a", 6, json.dumps({"type": "user", "message": {"content": "plain"}})),
        ("a", 9, json.dumps({"type": "result", "result": "ok", "num_turns": 2, "modelUsage": {"b": {"inputTokens": 9}, "s": {"inputTokens": 4}}})), ("a", 8, json.dumps({"type": "result", "result": "early", "is_error": True, "subtype": "x"})),
        ("b", 1, "no json"), ("b", 2, None), ("c", 1, '{"type":"system","subtype":"init","mcp_servers":[]}'), (None, 1, said("m1", {"output_tokens": 4})),
    ]
    got = {r["session"]: r.asDict() for r in sessions.sessions(spark.createDataFrame(lines, "session string, seq long, line string"), "files").collect()}
    assert set(got) == {"a", "c", None} and got["c"]["error"] == "server files missing" and got[None]["output_total"] == 4
    a = got["a"]
    assert (a["n_calls"], a["input_total"], a["context_end"], a["output_total"]) == (2, 9, 8, 2)
    assert (a["tools"], a["n_tools"], a["n_unanswered"], a["tool_chars"], a["top_tool"]) == ("Bash(ls)×2, Edit, look", 4, 2, 43, "Bash(ls)")
    assert (a["answer"], a["turns"], a["side_tokens"], a["error"], a["denied"]) == ("ok", 2, 4, None, 0)


def test_only_a_cut_character_may_end_a_text(spark, tmp_path):
    rng = random.Random(5)
    signs = [b"\x01", b"a", b"\xff", b"\xc3", b"\xa9", b"\xe0", b"\xe2", b"\x82", b"\xac", b"\xf0", b"\x9f", b"\xf4", b"\x90"]
    made = [b"\x01" + b"".join(rng.choices(signs, k=rng.randint(0, 5))) for _ in range(1500)] + [b"\x01\xffA.", b"\x01\xffa", b"", b"\x01" + "😀".encode()[:3]]

    def holds(content: bytes) -> bool:  # a control sign first, so only UTF-8 makes a text
        try:
            codecs.getincrementaldecoder("utf-8")().decode(content, False)
        except UnicodeDecodeError:
            return False
        return True

    got = [r["t"] for r in spark.createDataFrame(list(enumerate(made)), "k int, c binary").orderBy("k").select(detect.is_text(F.col("c")).alias("t")).collect()]
    assert got == [holds(c) for c in made]
    texts = ["a", "A.", "é", "Re.", "€", "😀", "é.", "", "x" * 4000, "€" * 4000, "a" + "€" * 3000]
    docs = spark.createDataFrame([(5 * i + rest, text) for i, text in enumerate(texts) for rest in range(5)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = duckdb.sql(ORACLE_SQL["text_test"].replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, QUERIES["text_test"](spark, str(tmp_path)).collect())) == sorted(held)
