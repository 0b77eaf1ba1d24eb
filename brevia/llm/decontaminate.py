"""Benchmark decontamination by template canonicalisation.

Texts become sequences of word tokens in which numbers, names and units are typed placeholders (slots). Windows of
``WINDOW`` tokens are hash-joined between documents and benchmark items; matches on one diagonal (document position
minus item position) must fill the slots consistently, so that a re-parameterised question counts and a chance likeness
of shape does not. What counts as a name depends on capitals and stops around it, so windows are also joined with
names as literals and by their exact tokens, all without case: one passage meets itself in any surroundings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._ragged import _BASE, FOLD, SEGMENT, U64, hashes_of, mix, pieces, texts
from ._stage import WORDS, saved

WINDOW = 8
#: A window is a template only with so many literal (not slot) tokens; with fewer it can only match verbatim.
LITERALS = 5
NUMBER, NAME, UNIT = 1, 2, 3
#: Units that turn into a placeholder when they follow a number (fixed values).
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars cent cents euro euros usd eur gbp degree degrees kmh mph"
).split()

_digit = np.isin(np.arange(256), list(range(48, 58)))
_upper = np.isin(np.arange(256), list(range(65, 91)))
_lower = np.isin(np.arange(256), list(range(97, 123)))
_word = _digit | _upper | _lower | (np.arange(256) >= 128)
_stop = np.isin(np.arange(256), list(b".!?:\n"))
_inner = np.isin(np.arange(256), list(b".,"))


_UNIT_HASHES = np.sort(np.concatenate([hashes_of(np.frombuffer(u.encode(), np.uint8), np.array([0]), np.array([len(u)])) for u in UNITS]))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, kind, bounds): the hash of every token, 0 for a literal or its slot kind, and each text's tokens.

    A token is a run of letters, digits and bytes over 127, with . and , inside a number. A name is a word with one
    capital in front and lower case behind, unless it begins a sentence; a unit is a word of ``UNITS`` behind a number.
    """
    inside = _word[data]
    if len(data) > 2:
        inside = inside.copy()
        inside[1:-1] |= _inner[data[1:-1]] & _digit[data[:-2]] & _digit[data[2:]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = np.unique(offsets[:-1][np.diff(offsets) > 0])
    first[edges] = inside[edges]
    before = edges[edges > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets)
    value = hashes_of(FOLD[data], starts, ends)
    kind = np.zeros(len(starts), np.int8)
    if not len(starts):
        return value, kind, bounds
    n_digit = np.concatenate([[0], np.cumsum(_digit[data])])
    n_capital = np.concatenate([[0], np.cumsum(_upper[data])])
    n_stop = np.concatenate([[0], np.cumsum(_stop[data])])
    digits = n_digit[ends] - n_digit[starts]
    number = (digits > 0) & (digits >= (ends - starts) - 2) & _digit[data[starts]]
    follows = np.zeros(len(starts), bool)
    follows[1:] = True
    heads = bounds[:-1][np.diff(bounds) > 0]
    follows[heads] = False
    gap = np.zeros(len(starts), bool)
    gap[1:] = n_stop[starts[1:]] > n_stop[ends[:-1]]
    name = _upper[data[starts]] & (n_capital[ends] - n_capital[starts] == 1) & (ends - starts > 1) & (digits == 0) & follows & ~gap
    at = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
    unit = (_UNIT_HASHES[at] == value) & follows
    unit[1:] &= number[:-1]
    kind[name] = NAME
    kind[unit] = UNIT
    kind[number] = NUMBER
    return value, kind, bounds


TEMPLATE, NAMED, VERBATIM = 0, 1, 2


def forms(kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """The kinds that each form of a window sees: a template all slots, a named one all but names, a verbatim one none."""
    return kind, np.where(kind == NAME, 0, kind), np.zeros_like(kind)


def windows(value: np.ndarray, kind: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(hash, owner, token position, form) of every window of ``size`` tokens inside one text, in each form it has.

    Forms that see the same slots are one and have one hash: a window without slots is a template and verbatim alike.
    """
    count = np.diff(bounds)
    runs = np.maximum(count - size + 1, 0)
    owner = np.repeat(np.arange(len(count)), runs)
    at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + bounds[owner]
    slots, names = _within(kind > 0, at, size), _within(kind == NAME, at, size)
    need = min(size, LITERALS)
    keeps = (size - slots >= need), (0 < names) & (names < slots) & (size - slots + names >= need), slots > 0
    found = []
    for form, (seen, keep) in enumerate(zip(forms(kind), keeps, strict=True)):
        spot = at[keep]
        shape = np.where(seen > 0, mix(seen.astype(np.uint64), 31), value)
        total = np.full(len(spot), size, np.uint64)
        for k in range(size):
            total += shape[spot + k] * U64(pow(_BASE, 2 * k + 1, 2**64))
        found.append((mix(total, 37), owner[keep], spot, np.full(len(spot), form)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _within(mask: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """How many of the ``size`` tokens from each position are in mask."""
    cum = np.concatenate([[0], np.cumsum(mask)])
    return cum[at + size] - cum[at]


_SCHEMA = "id {kind}, window long, at int, template boolean, form int, n int, n_templates int, kinds array<int>, filled array<long>"


def _table(df: DataFrame, keep, short: tuple[int, ...] | None) -> DataFrame:
    """The windows of df (id, text): id, window, at (token position), template (whether it has that form at all), form
    (verbatim for all without slots), n and n_templates (positions of the text with a window, with a template), kinds and
    filled (the slots of its form).

    keep: a broadcast bitmap of window hashes, others are dropped. short: window sizes besides ``WINDOW``, or None to give
    each text of fewer tokens one window of its own size.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in pieces(batch.column(1), SEGMENT):
                part = batch.slice(low, high - low)
                value, kind, bounds = tokens(*texts(part.column(1)))
                count = np.diff(bounds)
                found = []
                for size in {WINDOW, *(short if short is not None else np.unique(count[(count > 0) & (count < WINDOW)]).tolist())}:
                    w, owner, at, form = windows(value, kind, bounds, size)
                    if short is None:
                        right = (count[owner] >= WINDOW) if size == WINDOW else (count[owner] == size)
                    else:
                        spot = w >> U64(40)
                        right = (keep.value[(spot >> U64(6)).astype(np.int64)] >> (spot & U64(63))) & U64(1) == 1
                    found.append((w[right], owner[right], at[right], np.full(int(right.sum()), size), form[right]))
                w, owner, at, size, form = (np.concatenate(x) for x in zip(*found, strict=True))
                width = np.minimum(count, WINDOW)
                n = np.where(count > 0, count - width + 1, 0)
                n_templates = np.bincount(owner[form == TEMPLATE], minlength=len(count))
                template = size - _within(kind > 0, at, size) >= np.minimum(size, LITERALS)
                span = np.arange(WINDOW)
                spots = at[:, None] + span
                seen = np.stack(forms(kind))[form[:, None], np.minimum(spots, len(kind) - 1)] if len(at) else np.zeros((0, WINDOW), np.int8)
                slots = (seen > 0) & (span < size[:, None])
                place = spots[slots]
                offsets = pa.array(np.concatenate([[0], np.cumsum(slots.sum(1))]).astype(np.int32))
                yield pa.record_batch({
                    "id": part.column(0).take(pa.array(owner)), "window": w.view(np.int64), "at": (at - bounds[owner]).astype(np.int32), "template": template, "form": np.where(slots.any(1), form, VERBATIM).astype(np.int32),
                    "n": n[owner].astype(np.int32), "n_templates": n_templates[owner].astype(np.int32),
                    "kinds": pa.ListArray.from_arrays(offsets, pa.array(kind[place].astype(np.int32))), "filled": pa.ListArray.from_arrays(offsets, pa.array(value[place].view(np.int64))),
                })

    return df.mapInArrow(scan, _SCHEMA.format(kind=df.schema["id"].dataType.simpleString()))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """(doc_id, item_id, coverage, n_matched): documents that hold at least ``coverage`` of an item's windows.

    coverage is a share of all its windows or, where that is more, of those that are templates: a question with new
    values can't match the others. n_matched counts all.

    Windows of the items go into a bitmap of fixed size (2**24 bits), which thins the documents' windows before the
    exact join, so a shuffle carries little besides true matches; a larger benchmark thins less and stays exact.
    Items of fewer than ``WINDOW`` tokens are matched whole. Slots must be filled consistently along a diagonal: one
    value of the item always stands for one value in the document, and different names stay different. Each form is
    held to that by itself, and verbatim windows need no slots to agree.
    A window that many items share would pair its documents with all of them. So documents first meet only the rarest
    windows of each item, as many as a document with enough coverage can't all miss; other windows are joined for the
    pairs that met.

    Null and empty texts leak nothing; null ids are kept as null; repeated rows count once per id; other columns are
    ignored.
    """
    return _leaks(docs.select(F.col("doc_id").alias("id"), "text"), benchmark, coverage).withColumnRenamed("id", "doc_id")


def _rarest(items: DataFrame, coverage: float) -> DataFrame:
    """(window, item_id) of the rarest positions of each item; a document with ``coverage`` of it holds one of them.

    Of n positions at least coverage * n must match, so any n - ceil(coverage * n) + 1 of them hold a match; the same of
    the positions that are templates. A position is as common as the most common of its windows, by the items that have it.
    """
    common = items.groupBy("window").agg(F.count_distinct("item_id").alias("k"))
    spot = ["item_id", "n", "n_templates", "at", "template"]
    spots = items.join(common, "window").groupBy(*spot).agg(F.max("k").alias("k"))
    place = lambda *keys: F.row_number().over(Window.partitionBy("item_id", "n", "n_templates", *keys).orderBy("k", "at"))
    enough = lambda n: F.col(n) - F.ceil(F.col(n) * coverage - 1e-9) + 1
    chosen = spots.withColumn("place", place()).withColumn("inner", place("template"))
    chosen = chosen.where((F.col("place") <= enough("n")) | (F.col("template") & (F.col("inner") <= enough("n_templates"))))
    return items.join(chosen.select(*spot), spot, "left_semi").select("window", "item_id").distinct()


def _leaks(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """``leaks`` of documents (id, text), by any id."""
    spark = docs.sparkSession
    items = saved(_table(benchmark.select(F.col("item_id").alias("id"), "text"), None, None), "benchmark-windows")
    short = tuple(_short_sizes(benchmark))
    spots = items.select(F.expr("shiftrightunsigned(window, 40)").alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(s % 64))")).alias("bits")).toArrow()
    bitmap = np.zeros(WORDS, np.uint64)
    bitmap[spots.column("word").to_numpy()] = spots.column("bits").to_numpy().view(np.uint64)
    kept = spark.sparkContext.broadcast(bitmap)
    hits = _table(docs, kept, short).select("id", "window", F.col("at").alias("doc_at"), F.col("filled").alias("doc_filled"))
    hits = saved(hits.withColumn("key", F.xxhash64("id")), "document-windows")
    items = saved(items.withColumnRenamed("id", "item_id").dropDuplicates(["item_id", "window", "at"]), "benchmark-items")
    met = hits.join(_rarest(items, coverage), "window").select("key", "item_id").distinct()
    item, spot = ["id", "item_id", "n", "n_templates"], F.struct("at", "template")
    matched = hits.join(met, "key").join(items, ["window", "item_id"])
    matched = matched.select(*item, "form", spot.alias("spot"), (F.col("doc_at") - F.col("at")).alias("diagonal"), F.arrays_zip("kinds", "filled", "doc_filled").alias("slots"))
    runs = matched.groupBy(*item, "form", "diagonal").agg(F.collect_set("spot").alias("spots"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    names = F.filter("slots", lambda s: s["kinds"] == NAME)
    one_way = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kinds"], s["filled"])))) == F.size("slots")
    back = F.size(F.array_distinct(F.transform(names, lambda s: s["doc_filled"]))) == F.size(names)
    whole = runs.where(one_way & back).groupBy(*item).agg(F.array_distinct(F.flatten(F.collect_set("spots"))).alias("spots")).withColumn("n_matched", F.size("spots"))
    templates = F.when(F.col("n_templates") > 0, F.size(F.filter("spots", lambda s: s["template"])) / F.col("n_templates"))
    share = F.greatest(F.col("n_matched") / F.col("n"), templates)
    return whole.where(share >= coverage).select("id", "item_id", share.alias("coverage"), F.col("n_matched").cast("long").alias("n_matched"))


def _short_sizes(benchmark: DataFrame) -> list[int]:
    """The token counts under ``WINDOW`` that items have: at most WINDOW - 1 values."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.diff(tokens(*texts(batch.column(0)))[2])
            yield pa.record_batch({"size": np.unique(n[(n > 0) & (n < WINDOW)]).astype(np.int32)})

    return sorted(r["size"] for r in benchmark.select("text").mapInArrow(count, "size int").distinct().collect())


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text leaks no item; each row is judged by its own text, whatever its id."""
    row = F.concat_ws(" ", F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.hex(F.xxhash64(docs["text"])), F.hex(F.hash(docs["text"])))
    bad = saved(_leaks(docs.select(row.alias("id"), "text"), benchmark, coverage).select(F.col("id").alias("leaked")).distinct(), "leaked-rows")
    return docs.join(bad, row == bad["leaked"], "left_anti")
