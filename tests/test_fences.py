"""Lines and fenced blocks against a walk line by line, and in linear time."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from brevia.operators import outline


def plain_fences(text):
    out, mark, number = [], "", 0
    for k, line in enumerate(text.split("\n")):
        run = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if mark:
            out.append((k + 1, line, number))
            if run and run[1][0] == mark[0] and len(run[1]) >= len(mark) and line.strip(" ") == run[1]:
                mark = ""
        elif run:
            mark, number = run[1], number + 1
            out.append((k + 1, line, number))
        else:
            out.append((k + 1, line, 0))
    return out


def test_fences_are_those_of_a_walk(spark):
    rng = random.Random(9)
    lines = ["", "", "a", "# h", "```", "```", "````", "~~~", "~~~~ ", "  ```x", "    ```", "``` y", "`` `", "``` \r", "\u2028```", "é"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(14))) for _ in range(1500)] + ["", "\n", "```", "\n```\n", "```\n```\n```\n```", "a\n\n```\n\n```\n\n"]
    got = {}
    for r in outline.fenced_lines(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect():
        got.setdefault(r["k"], []).append((r["line_no"], r["line"], r["fence"]))
        assert r["total"] == len(texts[r["k"]])
    for k, text in enumerate(texts):
        assert sorted(got[k]) == plain_fences(text), repr(text)


def test_many_fences_take_linear_time(spark):
    text = "```\nx\n```\n# h\n" * 20_000 + "~~~\n" + "open\n" * 100_000
    frame = spark.createDataFrame([(1, text)], "k int, t string")
    outline.fenced_lines(frame, "k", "t").count()
    began = time.perf_counter()
    assert outline.fenced_lines(frame, "k", "t").agg(F.max("fence")).first()[0] == 20_001
    assert time.perf_counter() - began < 20
