"""Cases that once went wrong: special strings in another case, labels of any type, names in mixed scripts, template pages."""

from __future__ import annotations

import re
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevia.llm import embedding_dedup, ngram_join, pii, token_files
from brevia.llm.queries import vocabulary
from tests.llm.test_llm import brute_force_join, documents


def test_special_strings_in_any_case_and_order(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = ["see <|endoftext|> here", "SEE <|ENDOFTEXT|> HERE", "x<|EndOfText|>y <|endoftext|>", "<|startoftext|> <|STARTOFTEXT|> a<b A<B", "<|ENDOFTEXT|>", "<|endoftext|>", "< | <b> <B> <<"] * 3
    rows = list(enumerate([*texts, *reversed(texts)]))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.token_files(documents(spark, rows).coalesce(1), vocabulary("word_bpe_49k.json")).collect()}
    for i, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text


@pytest.mark.parametrize("kind, a, b", [("string", "cat", "dog"), ("double", 1.2, 1.7), ("decimal(9,2)", Decimal("1.20"), Decimal("1.70")), ("boolean", True, False), ("date", "2020-01-01", "2020-01-02"), ("bigint", 2**62, 2**62 + 1)])
def test_labels_of_any_type(spark, kind, a, b):
    near = [[1.0, 0.0, 0.001 * k] for k in range(3)]
    rows = [(k, near[k % 3], str(a if k < 6 else b)) for k in range(9)] + [(20, near[0], None), (21, near[0], None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("label", F.col("label").cast(kind))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(vectors).collect()}
    assert got == {k: (5, 0) if k < 6 else (2, 6) for k in range(9)} | {20: (0, 20), 21: (0, 21)}


def test_minus_zero_is_zero_as_a_label(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0.0), (2, [1.0, 0.0], -0.0)], "vec_id long, embedding array<double>, label double")
    assert {r["component_id"] for r in embedding_dedup.near_duplicates(vectors).collect()} == {1}


def rewritten(spark, *rows):
    got = pii.pseudonymise(documents(spark, list(enumerate(rows))), "key").collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_names_in_mixed_scripts(spark):
    mixed, again, alone = rewritten(spark, "Dr Anna Берг met Dr Anna Berg.", "Dr Anna Berg and Dr Борис Smith", "Dr Анна Berg saw Анна.")
    words = mixed.rstrip(".").split()
    assert words[1] == words[5] and words[1] != "Anna" and again.split()[1] == words[1]
    assert re.fullmatch(r"\p{IsCyrillic}+".replace(r"\p{IsCyrillic}", "[а-яА-Я]"), words[2]) and re.fullmatch("[A-Za-z]+", words[6])
    assert alone.split()[1] == alone.rstrip(".").split()[-1] != "Анна"


def test_account_numbers_keep_country_and_check_digits(spark):
    number = "DE89 3704 0044 0532 0130 00"
    spaced, bare = rewritten(spark, f"pay {number} now", f"pay {number.replace(' ', '')} now")
    made = re.search(r"DE\d\d(?: \w{4})+ \w\w", spaced)[0]
    assert made != number and made.replace(" ", "") in bare and len(made) == len(number)
    flat = made.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def template_pages(n, own=17, vary=0, seed=5):
    rng = np.random.default_rng(seed)
    shared = [f"t{i}" for i in range(107)]
    return [(k, " ".join([*[f"o{k}x{j}" for j in range(own + (int(rng.integers(0, vary)) if vary else 0))], *shared])) for k in range(n)]


def test_template_pages_make_no_pairs(spark, monkeypatch):
    seen = []
    across = ngram_join._across
    monkeypatch.setattr(ngram_join, "_across", lambda opened, *rest: seen.append(opened.count()) or across(opened, *rest))
    for n in (60, 240):
        got = ngram_join.ngram_join(documents(spark, template_pages(n))).rows.collect()
        assert all(r["n_links"] == 0 and r["component_id"] == r["doc_id"] for r in got)
    assert seen == [0, 0]


def test_pages_of_many_sizes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CENTRAL", 1)  # more is left to the last step
    rows = template_pages(60, 1, 40) + [(100 + i, t.replace("t3 ", "").replace("t90 ", "z ")) for i, t in template_pages(30, 1, 30, 9)]
    want, count = brute_force_join(rows)
    got = ngram_join.ngram_join(documents(spark, rows)).rows.collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and {r["doc_id"]: r["n_links"] for r in got} == count
    assert len(set(want.values())) > 5 and max(count.values()) > 5


def test_the_place_of_the_first_common_token_bounds_the_partner():
    rng = np.random.default_rng(7)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 90))).astype(np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[: max(1, int(len(x) * rng.uniform(0.8, 1)))], rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        levels = ngram_join.Frequent(x[: len(x) // 2], np.full(len(x) // 2, 30, np.uint64))
        a, b = (p.tolist() for p in ngram_join.prefixes([x, y], 11, 80, levels))
        first = next(t for t in a if t in b)
        assert 180 * (len(x) - a.index(first)) // 80 - len(x) >= len(y) and 180 * (len(y) - b.index(first)) // 80 - len(y) >= len(x)
