"""The shape of a corpus against a walk through all its values."""

from __future__ import annotations

import json
import random



from brevia.operators import json_shape


class Shape:
    """What the values at one path hold, in the order of the walk."""

    def __init__(self):
        self.counts, self.example, self.fields, self.inner, self.sizes, self.seen = {}, None, {}, None, [], 0

    def add(self, v):
        kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "null" if v is None else "bool" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
        self.counts[kind] = self.counts.get(kind, 0) + 1
        self.seen += 1
        if kind == "object":
            for k in sorted(v):
                self.fields.setdefault(k, Shape()).add(v[k])
        elif kind == "array":
            self.sizes.append(len(v))
            for x in v:
                self.inner = self.inner or Shape()
                self.inner.add(x)
        elif kind != "null" and self.example is None:
            self.example = json.dumps(v[:30], ensure_ascii=False) + "…" * (len(v) > 30) if kind == "string" else json.dumps(v)

    def label(self, depth=0):
        parts = []
        if "object" in self.counts:
            names = sorted(self.fields)
            rows = [f"{k}{'?' * (self.fields[k].seen < self.counts['object'])}: {self.fields[k].label(depth + 1)}" for k in names[:60]] + [f"… {len(names) - 60} more keys"] * (len(names) > 60)
            flat = "{" + ", ".join(rows) + "}"
            pad = "\n" + " " * (depth + 1)
            parts.append("{…}" if depth >= 12 and names else flat if len(flat.encode()) <= 80 and "\n" not in flat else "{" + pad + pad.join(rows) + pad[:-1] + "}")
        if "array" in self.counts:
            low, high = min(self.sizes), max(self.sizes)
            parts.append(f"[{low}]" if low == high else f"[{low}-{high}]")
            if self.inner:
                parts[-1] += " " + self.inner.label(depth)
        scalars = "|".join(k for k in ("string", "number", "bool") if k in self.counts)
        if scalars:
            parts.append(f"{scalars} ({self.example})")
        return "|".join(parts + ["null"] * ("null" in self.counts))


def value(rng, depth):
    pick = rng.randrange(8 if depth < 5 else 5)
    if pick < 5:
        return [None, rng.random() < 0.5, rng.randrange(-999, 999), "x" * rng.randrange(40), 'é "q" \n'][pick]
    if pick == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcdef") + rng.choice(["", "1"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def shape_of(spark, values):
    rows = spark.createDataFrame([(f"{k:05}", t) for k, t in enumerate(values)], "id string, text string").repartition(5)
    return [tuple(r) for r in json_shape.corpus_shape(rows).collect()]


def test_one_shape_of_many_documents(spark):
    rng = random.Random(3)
    values = [{k: value(rng, 1) for k in "pqr" if rng.random() < 0.9} for _ in range(60)] + [[1, {"p": 2}], "text", None]
    values.append({"wide": {f"k{i:03}": i for i in range(75)}})
    deep = {"end": 1}
    for _ in range(14):
        deep = {"d": deep}
    values.append(deep)
    want = Shape()
    for v in values:
        want.add(v)
    assert shape_of(spark, [*(json.dumps(v, ensure_ascii=False) for v in values), "{broken", None, ""]) == [(len(values), want.label())]


def test_shapes_of_little(spark):
    assert shape_of(spark, []) == [] and shape_of(spark, ["{bad", None]) == []
    assert shape_of(spark, ['{"a":1}', '{"b":[1,2]}', '{"b":[]}']) == [(3, "{a?: number (1), b?: [0-2] number (1)}")]


def test_rows_are_hashed_by_path_and_scalars_never_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_shape, "scratch", lambda _: f"{tmp_path}/s")
    rows = spark.createDataFrame([("a", '{"n":1,"s":"x","o":{"p":[1,2]}}'), ("b", "[]")], "id string, text string")
    json_shape.shape_rows(rows)
    assert [spark.read.parquet(f"{tmp_path}/s/level={k}").count() for k in (1, 2, 3)] == [2, 1, 1] and not (tmp_path / "s" / "level=4").exists()
    plan = json_shape._summed(json_shape._described(spark.read.parquet(f"{tmp_path}/s/level=0")))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" in plan
