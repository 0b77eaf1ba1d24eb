"""Exact Jaccard join on word n-grams with filters under several global token orders.

A pair can reach the threshold only if its sets share a prefix token under *every* total order of tokens. The first
order finds candidates through an inverted index of prefix tokens; a candidate stays only if the prefixes of all other
orders meet as well, which is tested on hashed prefixes before any text moves; what is left is counted exactly.

All orders put frequent n-grams (passages that many documents share) last, so that those seldom stand in a prefix; among
those of like frequency each order has its own seeded one. The place of a token in a prefix bounds the size of a partner
that can reach the threshold by it (``reach``): a token's documents are thinned by that bound before any pair is made, so
pages of one template that are too different never meet, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._ragged import U64, mix, pieces, ragged, sets
from ._stage import likely, saved, without

#: The list of frequent n-grams never holds more entries (16 bytes each on the driver and in the broadcast).
FREQUENT = 1 << 20
#: Documents that an n-gram needs to be on that list at all.
LEAST = 3
#: N-grams that a task counts at a time, and the share of those seen once that go on.
HELD, THIN = 1 << 20, 16
#: Longs of a signature.
LANES = 16
#: Documents of a token that all others of it are held against, in the step that takes the most central ones.
CENTRAL = 4
#: Seeds of the token orders: the first indexes, the others filter.
ORDERS = (11, 23, 47)
#: Classes and n-grams of a component that are compared in one block; a larger component is cut into blocks.
BLOCK, BLOCK_TOKENS = 1_000, 500_000


@dataclass(frozen=True)
class NgramJoin:
    """``links``: verified pairs (a, b) of class representatives that span every component; ``rows``: one row per document."""

    links: DataFrame
    rows: DataFrame


class Frequent:
    """The frequent n-grams, sorted, and the levels of their frequencies; a bitmap tells most others at once."""

    def __init__(self, tokens: np.ndarray, levels: np.ndarray) -> None:
        self.tokens, self.levels = tokens, levels
        self.known = np.zeros(1 << 22, bool)
        self.known[(tokens >> U64(42)).astype(np.int64)] = True

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in tokens of frequent ones, their levels)."""
        place = np.flatnonzero(self.known[(tokens >> U64(42)).astype(np.int64)])
        if not len(place):
            return place, np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(self.tokens, tokens[place]), len(self.tokens) - 1)
        hit = self.tokens[at] == tokens[place]
        return place[hit], self.levels[at[hit]]


NONE = Frequent(np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def prefix_length(n: int, threshold: int) -> int:
    """Two sets of which one has n tokens can reach threshold/100 only if the first so many tokens of both meet."""
    return n + (-threshold * n // 100) + 1 if n else 0


def prefixes(found: list[np.ndarray], seed: int, threshold: int, frequent: Frequent = NONE) -> list[np.ndarray]:
    """The prefix tokens of every set in their order: rare tokens by a seeded hash, then frequent ones by level and that hash."""
    if not found:
        return []
    keys = mix(np.concatenate(found), seed) >> U64(1)
    place, level = frequent.find(np.concatenate(found))
    keys[place] = U64(1 << 63) + (level << U64(53)) + (keys[place] >> U64(10))
    out, start = [], 0
    for tokens in found:
        length = prefix_length(len(tokens), threshold)
        own = keys[start : start + len(tokens)]
        start += len(tokens)
        first = np.argpartition(own, length - 1)[:length] if length < len(tokens) else np.arange(length)
        out.append(tokens[first[np.argsort(own[first])]])
    return out


def signature(tokens: np.ndarray) -> np.ndarray:
    """Parity bits of a set: where two sets' bits differ counts at most their symmetric difference."""
    bits = np.bincount((mix(tokens, 3) >> U64(20)).astype(np.int64) % (64 * LANES), minlength=64 * LANES) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def same_set(tokens: np.ndarray) -> bytes | None:
    """A key that equal sets share: two sums over the tokens, 128 bits; None for an empty set."""
    return b"".join(int(f(mix(tokens, s))).to_bytes(8, "big") for f, s in ((np.sum, 71), (np.bitwise_xor.reduce, 73))) if len(tokens) else None


def frequent_ngrams(docs: DataFrame, size: int) -> Frequent:
    """The most frequent n-grams over all documents, at most ``FREQUENT``.

    Each task counts the n-grams of all its whole sets exactly, some millions at a time. Those it has seen again go on with
    their counts; of those it has seen once every ``THIN``-th, by a hash that differs from task to task, which counts as so
    many: so an n-gram that is spread thinly over the tasks is found as well. The list's least count comes from a histogram
    of counts, so nothing is sorted as a whole. It only chooses the token order; the join is exact under any order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, held, size_held = TaskContext.get().partitionId() + 101, [], 0
        for batch in _parts(batches, 0):
            held += sets(batch.column(0), size)
            size_held += sum(map(len, held[-batch.num_rows :]))
            if size_held > HELD:
                yield summed_up(held, seed)
                held, size_held = [], 0
        yield summed_up(held, seed)

    def summed_up(held: list[np.ndarray], seed: int) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        once = (n == 1) & (mix(token, seed) % U64(THIN) == 0)
        keep = (n > 1) | once
        return pa.record_batch({"token": token[keep].view(np.int64), "n": np.where(once, THIN, n)[keep], "again": (n > 1)[keep]})

    tokens = docs.select("text").mapInArrow(count, "token long, n long, again boolean")
    summed = tokens.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("again"), F.col("n")).otherwise(0)).alias("sure"))
    summed = summed.where((F.col("sure") >= LEAST) | (F.col("n") >= LEAST * THIN))
    level = F.floor(F.log2("n") * 8).cast("int")
    counted = saved(summed.select("token", level.alias("level")), "ngram-frequent")
    held, least = 0, 0
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # some 500 levels at most
        held += r["count"]
        if held > FREQUENT:
            least = r["level"] + 1
            break
    rows = counted.where(F.col("level") >= least).select("token", "level").toArrow()
    token, level = rows.column("token").to_numpy().view(np.uint64), rows.column("level").to_numpy().astype(np.uint64)
    order = np.argsort(token)
    return Frequent(token[order], level[order])


def ngram_join(docs: DataFrame, threshold: int = 80, size: int = 5) -> NgramJoin:
    """Link documents whose sets of ``size``-word n-grams have 100 * |A n B| >= threshold * |A u B|.

    ``docs`` needs doc_id (long) and text; other columns are ignored. ``rows`` has doc_id, n_shingles (set size),
    component_id (smallest doc_id reachable by links, itself included) and n_links (rows linked directly). Null and empty
    texts have an empty set and link with nothing; fewer words than ``size`` make one n-gram of the whole sequence.
    Repeated rows with one doc_id are one node of the graph and all come back, and each counts in n_links; a null doc_id
    comes back with a null component and 0 links. No partner is ever capped: copies are joined through their class.

    Components come first, in three steps: each document is held against a few leaders of each of its prefix tokens;
    then, for tokens whose documents are still in several components, against those that share the most tokens (the
    middle of a group of near copies); at last all pairs across components are made, which few tokens still need. A link
    joins members of one component only, so n_links then counts all pairs inside each component, block by block, without
    listing them.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    frequent = spark.sparkContext.broadcast(frequent_ngrams(docs, size))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 1):
            found = sets(batch.column("text"), size)
            first, *others = (prefixes(found, seed, threshold, frequent.value) for seed in ORDERS)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n": pa.array([len(x) for x in found], pa.int64()), "class": pa.array([same_set(x) for x in found], pa.binary()),
                "signature": ragged([signature(x) for x in found], pa.int64()), "prefix": ragged([x.view(np.int64) for x in first], pa.int64()),
                **{f: ragged([(x >> U64(48)).astype(np.uint16).view(np.int16) for x in other], pa.int16()) for f, other in zip(filters, others, strict=True)},
            })

    filters = [f"filter{k}" for k in range(len(ORDERS) - 1)]
    described = saved(docs.mapInArrow(describe, "doc_id long, n long, class binary, signature array<long>, prefix array<long>, " + ", ".join(f"{f} array<short>" for f in filters)), "ngram-sets")
    named = described.where("class is not null and doc_id is not null")
    classes = saved(named.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n")), "ngram-classes")
    again = saved(named.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "ngram-again")
    if again.isEmpty():
        nodes = named
        spare = named.select("doc_id", "class").join(classes.where("copies > 1"), "class").where("doc_id <> rep").select("doc_id")
        reps = without(named, "doc_id", saved(spare, "ngram-spare"))
        same = None
    else:  # texts of one doc_id are one node
        reps = nodes = saved(named.join(classes.select("class", F.col("rep").alias("doc_id")), ["class", "doc_id"], "left_semi").dropDuplicates(["class"]), "ngram-reps")
        own = named.join(again, "doc_id", "left_semi").select("doc_id", "class").distinct().join(classes, "class").select("doc_id", "rep")
        same = own.join(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))
    marks = nodes.select(F.col("doc_id").alias("rep"), "n", *[F.col("signature")[k].alias(f"s{k}") for k in range(LANES)])
    heads = nodes.select(F.col("doc_id").alias("rep"), *filters)
    verify = lambda pairs: _verified(docs, _met(saved(pairs, "ngram-pairs"), heads, filters), threshold, size)

    entries = reps.select(F.col("doc_id").alias("rep"), "n", F.posexplode("prefix").alias("place", "token"))
    groups = saved(_index(entries.select("token", "rep", F.col("n").cast("int").alias("n"), _reach(threshold).alias("reach"))), "ngram-groups")
    links = verify(_led(groups, marks, threshold))
    links = saved(links if same is None else links.unionByName(same), "ngram-links")
    found = components(links)
    opened = _open(groups, found)
    central = opened.join(groups.groupBy("rep").agg((-F.count("*")).alias("first")), "rep").select("token", "rep", "n", "reach", "first")
    links = saved(links.unionByName(verify(_apart(_led(_index(central, "first"), marks, threshold), found))), "ngram-links")
    found = components(links)
    links = saved(links.unionByName(verify(_across(_open(groups, found), marks, threshold))), "ngram-links")
    found = components(links)

    ends = classes.join(found, classes["rep"] == found["node"], "left").select("class", "rep", "copies", "n", F.coalesce("component", "rep").alias("component"))
    ends = saved(_link_counts(docs, saved(ends, "ngram-ends"), threshold, size), "ngram-counts")
    rows = described.select("doc_id", "n", "class").join(ends, "class", "left")
    known = F.col("doc_id").isNotNull()
    return NgramJoin(links, rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component", "doc_id")).alias("component_id"), F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links")))


def _reach(threshold: int) -> Column:
    """The largest set that one of n tokens can reach the threshold with if the token at ``place`` is the first that both have.

    At most n - place tokens are then common, and threshold * (n + m) <= (100 + threshold) * common must hold.
    """
    return F.expr(f"{100 + threshold} * (n - place) div {threshold} - n").cast("int")


def _near(rows: DataFrame, of: DataFrame) -> DataFrame:
    """The rows (token, n, reach) that some row of their token can be a partner of: ``of`` has its least n and greatest reach.

    Of two documents that reach the threshold both rows of their first common token stay.
    """
    return rows.join(of, "token").where("least <= reach and n <= most")


def _index(rows: DataFrame, first: str | None = None) -> DataFrame:
    """Of (token, rep, n, reach): the rows with a possible partner, each with the leaders of its token.

    Leaders are the smallest and largest rep, or ``CENTRAL`` documents by the column ``first`` and rep, each the first of its
    share of the documents. That order is the same for all tokens, so documents that share many tokens share their leaders.
    It is an aggregation with partial results and a join whose hot tokens adaptive execution splits.
    """
    if first:
        inside = lambda k: F.min(F.when(F.pmod(F.xxhash64("rep"), F.lit(CENTRAL)) == k, F.struct(first, "rep")))["rep"]
        leaders = F.array_compact(F.array(*[inside(k) for k in range(CENTRAL)]))
    else:
        leaders = F.array(F.min("rep"), F.max("rep"))
    shared = rows.groupBy("token").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), leaders.alias("leaders"), F.min("n").alias("least"), F.max("reach").alias("most")).where("low <> high")
    return _near(rows.select("token", "rep", "n", "reach"), shared.drop("low", "high")).drop("least", "most")


def _led(groups: DataFrame, marks: DataFrame, threshold: int) -> DataFrame:
    """Distinct pairs (a, b), a > b, of a document and a leader of one of its tokens, within the bounds."""
    pairs = groups.select("rep", F.explode("leaders").alias("leader")).where("rep <> leader")
    pairs = pairs.select(F.greatest("rep", "leader").alias("a"), F.least("rep", "leader").alias("b")).distinct()
    return _bounded(_marked(pairs, marks), threshold).select("a", "b")


def _marked(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) with size and signature of both ends, as a_n, a_s0, ... and b_n, ..."""
    for end in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("rep").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in marks.columns if c != "rep"]), end)
    return pairs


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    placed = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return placed.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")


def _open(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(token, rep, n, reach, component) of the tokens whose documents are not all in one component yet, written."""
    placed = saved(groups.join(found, groups["rep"] == found["node"], "left").select("token", "rep", "n", "reach", F.coalesce("component", "rep").alias("component")), "ngram-placed")
    tokens = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least"), F.max("reach").alias("most")).where("x <> y")
    return saved(_near(placed, tokens.drop("x", "y")).drop("least", "most"), "ngram-open")


def _bounded(pairs: DataFrame, threshold: int) -> DataFrame:
    """Of marked pairs: those whose sizes and signatures allow the threshold. It drops no pair that reaches it."""
    differ = " + ".join(f"bit_count(a_s{k} ^ b_s{k})" for k in range(LANES))
    sizes = f"{threshold} * greatest(a_n, b_n) <= 100 * least(a_n, b_n)"
    return pairs.where(f"{sizes} and {100 + threshold} * ({differ}) <= {100 - threshold} * (a_n + b_n)")


def _across(opened: DataFrame, marks: DataFrame, threshold: int) -> DataFrame:
    """All pairs (a, b) of different components that share a prefix token and keep the size, place and signature bounds."""
    rest = saved(opened.drop("n").join(marks, "rep"), "ngram-marked")
    side = lambda end: rest.select("token", *[F.col(c).alias(f"{end}_{c}") for c in ("component", "reach", *marks.columns) if c != "rep"], F.col("rep").alias(end))
    pairs = side("a").join(side("b"), "token").where("a_component < b_component and a_n <= b_reach and b_n <= a_reach")
    return _bounded(pairs, threshold).select("a", "b").distinct()


def _met(pairs: DataFrame, heads: DataFrame, filters: list[str]) -> DataFrame:
    """The pairs whose prefixes meet under the other orders too, written. Only hashed prefixes travel."""
    for end in ("a", "b"):
        pairs = pairs.join(heads.select(F.col("rep").alias(end), *[F.col(f).alias(f"{end}_{f}") for f in filters]), end)
    meet: Column = F.lit(True)
    for f in filters:
        meet &= F.arrays_overlap(f"a_{f}", f"b_{f}")
    return saved(pairs.where(meet).select("a", "b"), "ngram-met")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents whose doc_id is among ``ids`` (id); only those are shuffled."""
    own = likely(docs.where("text is not null"), "doc_id", ids)
    return own.join(ids, own["doc_id"] == ids["id"], "left_semi").select(F.col("doc_id").alias("id"), "text")


def _verified(docs: DataFrame, pairs: DataFrame, threshold: int, size: int) -> DataFrame:
    """The pairs that pass the exact count.

    Texts travel, not sets: a text is smaller than its hashes. Only texts that a pair names are shuffled.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 2):
            a, b = (batch.column(k).to_numpy() for k in (0, 1))
            sides = []
            for column in (2, 3):
                coded = batch.column(column).dictionary_encode()
                sides.append((coded.indices.to_numpy(), sets(coded.dictionary, size)))
            (ia, xs), (ib, ys) = sides
            keep = np.zeros(len(a), bool)
            for k, (i, j) in enumerate(zip(ia, ib, strict=True)):
                x, y = xs[i], ys[j]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * both >= threshold * (len(x) + len(y) - both)
            yield pa.record_batch({"a": a[keep], "b": b[keep]})

    own = saved(_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "ngram-texts")
    for end in ("a", "b"):
        pairs = pairs.join(own.select(F.col("id").alias(end), F.col("text").alias(f"{end}_text")), end)
    return pairs.select("a", "b", "a_text", "b_text").mapInArrow(check, "a long, b long")


def _link_counts(docs: DataFrame, ends: DataFrame, threshold: int, size: int) -> DataFrame:
    """(class, component, n_links) of every class of ``ends`` (class, rep, copies, n, component): the rows that link with one of it.

    Where a component has one or two classes, all its rows link with each other. The classes of others are compared in
    blocks of a bounded number of documents and n-grams; a pair is counted where it is compared and never listed.
    """
    grown = ends.groupBy("component").agg(F.count("*").alias("classes"), F.sum("copies").alias("total"), F.sum("n").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("classes") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    placed = saved(ends.join(grown, "component").select("class", "rep", "copies", "component", "classes", "total", blocks.alias("blocks")), "ngram-placed")
    small = placed.where("classes <= 2").select("class", "component", (F.col("total") - 1).alias("n_links"))

    large = placed.where("classes > 2").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    large = large.select("class", "rep", "copies", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    large = large.select("class", "rep", "copies", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    own = saved(_texts(docs, large.select(F.col("rep").alias("id")).distinct()), "ngram-texts")
    loaded = large.join(own, large["rep"] == own["id"]).select("component", "low", "high", "block", "class", "copies", "text")
    keys = ["component", "low", "high"]
    compared = loaded.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold, size), "class binary, links long")
    linked = compared.groupBy("class").agg(F.sum("links").alias("links"))
    return small.unionByName(placed.where("classes > 2").join(linked, "class", "left").select("class", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))


def _compare(threshold: int, size: int):
    """Rows of one (component, low, high) after another -> per class the rows of other classes that it links with."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 3):
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            found, names = sets(group.column("text").combine_chunks(), size), group.column("class").to_pylist()
            at = {}  # a doc_id may have several texts, and a text several rows: of each class one row with its own text
            for k, (x, name) in enumerate(zip(found, names, strict=True)):
                if name not in at and same_set(x) == name:
                    at[name] = k
            at = np.array(list(at.values()), np.int64)
            block, copies = group.column("block").to_numpy()[at], group.column("copies").to_numpy()[at]
            found = [found[k] for k in at]
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            n = np.array([len(x) for x in found], np.int64)
            both = shared(found, left, right)
            linked = 100 * both >= threshold * (n[left][:, None] + n[right] - both)
            links = np.zeros(len(at), np.int64)
            links[left] = linked @ copies[right]
            if low == high:
                links -= copies
            else:
                links[right] = linked.T @ copies[left]
            yield pa.record_batch({"class": pa.array([names[k] for k in at], pa.binary()), "links": links})

    return compare


def shared(found: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many tokens each set at ``left`` has in common with each at ``right``.

    Tokens of up to 8 sets are counted pair by pair, all others as products of 0/1 matrices of ``width`` tokens.
    """
    both = np.zeros((len(found), len(found)), np.int64)
    token = np.concatenate(found) if found else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    new = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    count = np.bincount(group)[group] if len(token) else group
    few = (count > 1) & (count <= 8)
    t, o = group[few], owner[few]
    for step in range(1, 8):
        same = np.flatnonzero(t[step:] == t[:-step])
        if not len(same):
            break
        both += np.bincount(o[same] * len(found) + o[same + step], minlength=both.size).reshape(both.shape)
    many = count > 8
    t, o = group[many], owner[many]
    t = np.cumsum(np.concatenate([[False], t[1:] != t[:-1]])) if len(t) else t
    both += both.T
    for start in range(0, int(t[-1]) + 1 if len(t) else 0, width):
        low, high = np.searchsorted(t, (start, start + width))
        x = np.zeros((len(found), min(width, int(t[-1]) + 1 - start)), np.float32)
        x[o[low:high], t[low:high] - start] = 1
        both += (x @ x.T).astype(np.int64)
    np.fill_diagonal(both, [len(x) for x in found])
    return both[np.ix_(left, right)]


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in parts of a bounded number of bytes in the column ``text``, so that few sets are held at once."""
    for batch in batches:
        for low, high in pieces(batch.column(text)):
            yield batch.slice(low, high - low)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal first ``keys`` columns (longs or ints) as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(keys)], 1)
        cut = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(values)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if held and tuple(values[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(values[a])
    if held:
        yield pa.Table.from_batches(held)
