"""Periodic runs, fingerprints and whitening against brute force, on small and awkward tables."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brevia.llm import fingerprints, periodic_runs, whitening
from brevia.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.test_llm import WORD, documents, shingles


def plain_runs(w):
    """Every run of a list of words, lag by lag, word by word."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            part = w[s : e + q]
            if e > s and len(part) >= max(6, 4 * q) and not any(all(x == y for x, y in zip(part, part[p:], strict=False)) for p in range(1, q)):
                out.append((s, len(part), q))
            s = max(e, s + 1)
    return sorted(out)


def planted(doc_id, text):
    """Words of a text as the query reads them."""
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    w = planted(doc_id, text)
    runs = plain_runs(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=40), st.sampled_from([(4096, 64, 4), (0, 1, 1), (8, 3, 2)]))
def test_runs_of_any_words(block, times, rest, how):
    was = periodic_runs.WIDE, periodic_runs.LAG, periodic_runs.FIRST
    periodic_runs.WIDE, periodic_runs.LAG, periodic_runs.FIRST = how
    try:
        for w in (rest + block * times, block * times + rest + block * 4):
            assert periodic_runs.runs(np.array(w, np.int64)) == plain_runs(w)
    finally:
        periodic_runs.WIDE, periodic_runs.LAG, periodic_runs.FIRST = was


def test_runs_of_long_texts():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 50, 30_000)
    for start, period, times in ((100, 1, 9), (900, 700, 5), (9_000, 64, 4), (12_000, 3_001, 5)):
        w[start : start + period * times] = np.tile(w[start : start + period], times)
    found = periodic_runs.runs(w)
    assert {(100, 1), (900, 700), (9_000, 64), (12_000, 3_001)} <= {(s, q) for s, _, q in found} | {(s + 1, q) for s, _, q in found}
    assert periodic_runs.analysed(b"a " * 60_000) == ([(0, 60_000, 1)], b"a")


def test_periodic_runs_of_the_whole_table(spark):
    got = sorted(QUERIES["op11_periodic_runs"](spark, DATA).collect())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert [tuple(r) for r in got] == sorted(digest(*d) for d in docs)
    assert sum(r["n_runs"] > 0 for r in got) > 5


def test_periodic_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 9), (4, "a b " * 4), (4, "a b " * 4), (5, "x" * 50_000), (6, "é é " * 7), (7, "a b\x00 a b\x00\n" * 6), *((k, "w1 w2 w3 w4 w5 w6 w7 w8 w9") for k in range(100, 160))]
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_runs(documents(spark, rows)))
    got = [tuple(r) for r in periodic_runs.run_digest(found).collect()]
    assert sorted(got, key=str) == sorted((digest(*r) for r in rows), key=str)
    texts = {r["doc_id"]: r["collapsed"] for r in found.collect()}
    assert (texts[4], texts[1], texts[None]) == ("a b", "", "a")
    assert periodic_runs.run_digest(periodic_runs.periodic_runs(documents(spark, []))).count() == 0


def test_sketches_estimate_merge_and_read_back():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 2**64, 60_000, np.uint64))
    rng.shuffle(pool)
    small, large = np.sort(pool[:2_000]), np.sort(pool[500:40_000])
    a, b = fingerprints.Sketch.of(small), fingerprints.Sketch.of(large)
    inside, back, both = a.against(b)
    assert abs(inside - 0.75) < 0.08 and abs(back - 1_500 / 39_500) < 0.01 and abs(both - 1_500 / 40_000) < 0.01
    assert a.cut == b.cut == fingerprints.WHOLE // 8 and abs(len(b.hashes) / len(large) - 1 / 8) < 0.01
    for x, y in ((small, large), (small[:30], large), (small[:30], small[20:90]), (small[:0], small[:5])):
        one = fingerprints.Sketch.of(x).merged(fingerprints.Sketch.of(y))
        assert str(one) == str(fingerprints.Sketch.of(np.union1d(x, y)))
        again = fingerprints.Sketch.read(str(one))
        assert again.cut == one.cut and (again.hashes == one.hashes).all()
    few = fingerprints.Sketch.of(small[:40]), fingerprints.Sketch.of(small[10:60])
    assert few[0].against(few[1])[2] == 30 / 60  # small sets are whole
    none = fingerprints.Sketch.of(small[:0])
    assert none.against(none)[0] == 1 and none.against(a)[0] == a.against(none)[0] == 0


def plain_edits(rows):
    """(doc_id, text, edited, next text) of rows in order."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        other, m = rows[(k + 1) % len(rows)][1], len(t) // 4
        out.append((i, t, t[: len(t) - m] + other[:m], other))
    return out


def held_against(got, rows):
    want = plain_edits(rows)
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key) == sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want), key=key)
    prints = dict(zip([t for _, t, _, _ in want], map(str, fingerprints.sketches(pa.array([t for _, t, _, _ in want]))), strict=True))
    one = {i: (t, e, n) for i, t, e, n in want}
    for r in got:
        if sum(w[0] == r["doc_id"] for w in want) > 1:
            continue
        text, edited, other = (shingles(t) for t in one[r["doc_id"]])
        assert r["fingerprint"] == prints[one[r["doc_id"]][0]]
        for b, near, both in ((edited, r["near_edited"], r["jaccard_edited"]), (other, r["near_next"], r["jaccard_next"])):
            if not text or not b:
                assert near == both == float(not text and not b)
                continue
            exact = len(text) <= 64 and len(b) <= 64
            assert both == pytest.approx(len(text & b) / len(text | b), abs=1e-9 if exact else 0.35)
            if exact:
                assert near == pytest.approx(len(text & b) / min(len(text), len(b)))


def test_fingerprints_of_the_whole_table(spark):
    got = QUERIES["op12_document_fingerprints"](spark, DATA).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    held_against(got, docs)
    assert np.median([r["near_edited"] for r in got]) > 0.7 > 0.05 > np.median([r["near_next"] for r in got])


@pytest.mark.parametrize("rows", [
    [(1, "a b c d e f g h"), (2, None), (3, ""), (None, "x y z w v u"), (None, "x y"), (5, "é" * 9), (5, "q r s t u v w x y z"), (5, "q r s t u v w x y z"), (9, "tail of it")],
    [(7, "one alone, whose tail becomes its head")], [(1, None)], [(None, "a b"), (None, None)], [(-5, "m n o p q r"), (2**62, "k l m n o p"), (3, "a" * 40_000)], [(4, "same words here and there again")] * 40,
])
def test_fingerprints_of_odd_rows(spark, rows):
    held_against(fingerprints.edited_fingerprints(documents(spark, rows)).collect(), rows)


def test_fingerprints_of_nothing_and_of_groups(spark):
    assert fingerprints.edited_fingerprints(documents(spark, [])).count() == 0
    rows = [(k, " ".join(f"w{(k * 7 + j) % 90}" for j in range(30))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))))
    prints = fingerprints.fingerprints(docs).join(docs.select("doc_id", "source"), "doc_id")
    got = {r["source"]: r["fingerprint"] for r in fingerprints.merged(prints.repartition(5), "source").collect()}
    for source, rest in ((None, 0), ("s1", 1), ("s2", 2)):
        union = np.unique(np.concatenate(fingerprints.sets(pa.array([t for k, t in rows if k % 3 == rest]))))
        assert got[source] == str(fingerprints.Sketch.of(union))


def plain_whitening(rows, most=8):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in good], object)
    n, s = len(x), x.sum(0)
    deviation = [int(d) for d in ((n * x - s) ** 2).sum(1)]
    y = (x - s / n).astype(float)
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return [i for i, _ in good], n, deviation, y @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def held_white(got, rows, dim):
    ids, n, deviation, white, share = plain_whitening(rows)
    at = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(at) == len(ids) * min(8, dim)
    signs = np.sign([sum(at[i, k + 1]["whitened"] * white[j, k] for j, i in enumerate(ids)) for k in range(min(8, dim))])
    for j, i in enumerate(ids):
        for k in range(min(8, dim)):
            r = at[i, k + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[j])
            assert r["whitened"] == pytest.approx(signs[k] * white[j, k], abs=1e-6) and r["explained"] == pytest.approx(share[k], rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    held_white(QUERIES["op13_embedding_whitening"](spark, DATA).collect(), rows, 64)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit(1) for c in ("x", "w", "label", "n", "k", "dim")})


def test_whitening_of_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in rng.normal(0, 3, 12) * np.arange(1, 13)]) for k in range(200)]
    odd = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [1.0] * 11 + [math.nan]), (904, [-math.inf] + [0.0] * 11)]
    monkeypatch.setattr(whitening, "PAIRS", 7)  # several aggregations
    held_white(whitening.whiten(vectors(spark, rows + odd)).collect(), rows, 12)
    got = whitening.whiten(vectors(spark, [*rows, (905, [1.0, 2.0]), (None, rows[0][1]), (0, rows[0][1])])).collect()
    assert len(got) == 8 * 202 and {r["n"] for r in got} == {202} and sum(r["vec_id"] is None for r in got) == 8
    assert len({r["whitened"] for r in got if r["component"] == 1 and r["vec_id"] in (0, None)}) == 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(k, [0.5, 0.25, -1.0]) for k in range(9)]])
def test_whitening_without_directions(spark, rows):
    out = whitening.whiten(vectors(spark, rows))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_few_directions_and_of_large_numbers(spark):
    got = whitening.whiten(vectors(spark, [(k, [k / 1024, 2 * k / 1024, 5.0]) for k in range(30)])).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1) and got[0]["identity_error"] < 1e-9
    huge = whitening.whiten(vectors(spark, [(k, [1e30 * (-1) ** k, float(k)]) for k in range(30)])).collect()
    assert all(r["deviation"] is None for r in huge) and len(huge) >= 30
