"""The corpus pipeline, stage by stage, against plain Python on the smallest tables."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from brevia.llm import quality
from brevia.llm.mixing import mix_plan
from brevia.llm.queries import vocabulary
from tests.conftest import DATA
from tests.llm.test_llm import shingles


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append((name, before, docs))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    (_, first, good), (_, _, single), (_, _, clean), (_, _, mixed), (_, _, stored) = seen
    judged = {r["doc_id"]: r["predicted"] for r in quality.quality(first, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert set(ids(good)) == {d for d, p in judged.items() if p == 1}

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = set(ids(good))
    known = [d for d in ids(first) if d in labels]
    assert np.mean([(d in kept) == (labels[d] == 1) for d in known]) > 0.95

    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    sets = {d: shingles(t) for d, t in texts.items()}
    like = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    left = set(ids(single))
    assert not any(like(a, b) for a in left for b in left if a < b and sets[a] and sets[b])
    assert all(any(like(d, e) for e in kept if e != d) for d in kept - left)

    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(i in (r["text"] or "") for r in clean.collect() for i in items)
    assert all(any(len(shingles(texts[d]) & shingles(i)) > 3 for i in items) for d in left - set(ids(clean)))

    plan = {r["doc_id"]: r["copies"] for r in mix_plan(clean).collect()}
    counted = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counted == {d: n for d, n in plan.items() if n}

    rows = stored.orderBy("start").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(ids(mixed)) and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    assert vocabulary("word_bpe_49k.json")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaked string, draw string, size string, _row string, features string"


def odd(spark, rows):
    """Rows of (doc_id, text) with columns whose names the stages use inside."""
    return spark.createDataFrame([(d, t, "en", "s", 13, "x", "x", "x", "x", "x") for d, t in rows], SCHEMA)


def test_repeated_rows_leave_one(spark):
    docs = odd(spark, [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (3, None), (None, "a b c d e f g"), (4, "h i j k l m"), (4, "n o p q r s"), (5, "n o p q r s")])
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, DATA)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect() if r["text"]) == [("1", "a b c d e f g"), ("4", "h i j k l m"), ("4", "n o p q r s"), ("None", "a b c d e f g")]
    assert got.columns == docs.columns and got.where("doc_id = 3").count() == 1


def test_stages_judge_rows_by_their_texts(spark):
    """Repeated ids with other texts, null ids, null, empty and very long texts, clashing columns; and empty tables."""
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    rows = [(1, f"well {item} so"), (1, "something else entirely here"), (None, f"{item} again"), (None, "nothing to see here at all"), (2, None), (3, ""), (4, "x" * 40_000), (4, "x" * 40_000), (5, "word " * 30_000)]
    docs = odd(spark, rows)
    clean = corpus_pipeline.keep_clean(spark, docs, DATA)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in clean.collect()) == sorted((str(d), t or "") for d, t in rows if item not in (t or ""))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = corpus_pipeline.keep_good(spark, docs, DATA).collect()
    want = {t for (d, t), p in zip(rows, [r["predicted"] for r in quality.quality(docs, labels).collect()], strict=True) if p == 1}
    assert {r["text"] for r in good} == want and len(good) == sum(t in want for _, t in rows)
    mixed = corpus_pipeline.mixed(spark, docs, DATA)
    stored = corpus_pipeline.tokenised(spark, docs, DATA)
    assert mixed.columns == clean.columns == docs.columns and {r["text"] for r in mixed.collect()} <= {t for _, t in rows} and stored.count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        if name != "n-gram Jaccard join":  # tests/llm/test_llm.py has its empty table
            assert stage(spark, docs.limit(0), DATA).count() == 0
