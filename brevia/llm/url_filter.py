"""URL filters by a sort-merge range join.

A host's labels are reversed (``a.example.com`` becomes ``com.example.a.``), so a rule's host and all its subdomains are
one interval of keys, and intervals of different rules are nested or disjoint. URLs and rules are dealt to the same key
ranges and sorted; one sweep keeps the stack of rules whose interval holds the current key and takes the longest whose
path begins the URL's.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._ragged import U64, texts

#: Keys that are looked at to choose range borders (short strings on the driver), and borders at most.
SAMPLE, BORDERS = 20_000, 4_096
#: Bytes of a key that borders look at; keys alike so far are told apart by their tie.
HEAD = 64
#: The production rules of the query: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
RULE_TYPE = "rule_host string, rule_path string, rule_verdict string"


def canonical(host):
    """The reversed labels of a host, each with a dot behind; a column in, a column out."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, host (A-Z lower-cased) and path of every row; both empty for a null url or one without ://."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substr(F.col("url"), at + 3)).otherwise("")
    split = pages.select("page_id", rest.alias("_rest"))
    split = split.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.substr(F.col("_rest"), F.length("_host") + 1), r"^[^?#]*", 0)
    return split.select("page_id", F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the longest rule that fits, else null) and verdict of every row.

    Rules (rule_host, rule_path, rule_verdict) fit their host and all subdomains if the path starts with the rule's; of rules
    of one length the one with the longer host wins, then the smaller verdict. Rules with a null or empty host fit nothing;
    a null rule path counts as empty. Pages of one host may fill many ranges: borders are taken from a sample of
    (key, hash of page_id) and each range gets the rules that reach it, so a hot host is dealt to many tasks. Repeated
    rows come back as often; other columns are ignored.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, RULE_TYPE)
    parts = url_parts(pages).withColumn("key", F.when(F.col("host") == "", "").otherwise(canonical(F.col("host")))).withColumn("tie", F.xxhash64("page_id", "path"))
    page_type = parts.schema["page_id"].dataType
    borders = spark.sparkContext.broadcast(_borders(parts))
    clean = rules.where("rule_host is not null and rule_host <> ''").select(canonical(F.translate("rule_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("key"), "rule_host", F.coalesce("rule_path", F.lit("")).alias("rule_path"), "rule_verdict").distinct()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = np.searchsorted(borders.value, _points(batch.column("key"), batch.column("tie").to_numpy()), "right")
            yield pa.RecordBatch.from_arrays([pa.array(spot.astype(np.int32)), *batch.columns], ["range", *batch.schema.names])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.searchsorted(borders.value, _points(batch.column("key"), np.full(batch.num_rows, -(2**63))), "right")
            high = np.searchsorted(borders.value, _points(batch.column("key"), np.full(batch.num_rows, 2**63 - 1), 255), "right")
            count = high - low + 1
            owner = np.repeat(np.arange(batch.num_rows), count)
            spot = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + low[owner]
            out = batch.take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([pa.array(spot.astype(np.int32)), *out.columns], ["range", *batch.schema.names])

    urls = parts.mapInArrow(place, T.StructType([T.StructField("range", T.IntegerType()), *parts.schema.fields]))
    spread = clean.mapInArrow(reach, T.StructType([T.StructField("range", T.IntegerType()), *clean.schema.fields]))
    both = spread.withColumn("is_url", F.lit(0)).unionByName(urls.withColumn("is_url", F.lit(1)), allowMissingColumns=True)
    swept = both.repartition("range").sortWithinPartitions("range", "key", "is_url", "rule_path").select("range", "key", "is_url", "rule_host", "rule_path", "rule_verdict", "page_id", "host", "path")
    result = T.StructType([T.StructField("page_id", page_type), *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])
    return swept.mapInArrow(lambda batches: _sweep(batches, default), result)


def _points(keys: pa.Array, ties: np.ndarray, pad: int = 0) -> np.ndarray:
    """Places in the order of (first ``HEAD`` bytes of the key, tie), as byte strings; pad fills up shorter keys."""
    data, offsets = texts(keys)
    size = np.minimum(np.diff(offsets), HEAD)
    out = np.full((len(ties), HEAD + 8), pad, np.uint8)
    owner = np.repeat(np.arange(len(ties)), size)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    out[owner, inner] = data[offsets[:-1][owner] + inner]
    out[:, HEAD:] = (ties.astype(np.int64).view(np.uint64) ^ U64(1 << 63)).astype(">u8")[:, None].view(np.uint8)
    return out.view(f"S{HEAD + 8}").ravel()


def _borders(parts: DataFrame) -> np.ndarray:
    """At most ``BORDERS`` places that cut the URLs into even ranges, from a sample of bounded size."""
    spark = parts.sparkSession
    wanted = min(BORDERS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2))
    sample = parts.select("key", "tie", F.xxhash64("page_id", F.lit("sample")).alias("_order")).orderBy("_order", "key").limit(min(SAMPLE, 40 * wanted)).toArrow()
    points = np.sort(_points(sample.column("key"), sample.column("tie").to_numpy()))
    return np.unique(points[len(points) * np.arange(1, wanted) // wanted]) if len(points) else points


class _Rules:
    """The rules of one host, by the length of their paths: each length is one lookup for all URLs of a stretch."""

    def __init__(self, key: str, host: str) -> None:
        self.key, self.host, self.paths = key, host, {}

    def add(self, path: str, verdict: str | None) -> None:
        known = self.paths.setdefault(len(path), {})
        if path not in known or (verdict or "") < (known[path] or ""):
            known[path] = verdict


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Judge URLs in key order; the stack holds the rules of every host around the current key.

    Between two rules, or to where the innermost host ends, the stack stays as it is, so such a stretch of URLs is judged at once.
    """
    stack: list[_Rules] = []
    place = None
    for batch in batches:
        spot, is_url = batch.column("range").to_numpy(), batch.column("is_url").to_numpy().astype(bool)
        keys, paths = batch.column("key"), batch.column("path")
        stops = np.flatnonzero(~is_url | np.concatenate([[True], spot[1:] != spot[:-1]])) if len(spot) else np.zeros(0, int)
        rules, verdicts = np.full(len(spot), None, object), np.full(len(spot), default, object)
        at = 0
        while at < len(spot):
            if spot[at] != place:
                place, stack = spot[at], []
            key = keys[at].as_py()
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if not is_url[at]:
                if not stack or stack[-1].key != key:
                    stack.append(_Rules(key, batch.column("rule_host")[at].as_py()))
                stack[-1].add(batch.column("rule_path")[at].as_py(), batch.column("rule_verdict")[at].as_py())
                at += 1
                continue
            after = np.searchsorted(stops, at, "right")
            end = int(stops[after]) if after < len(stops) else len(spot)
            if stack:
                inner = stack[-1].key
                end = bisect_left(range(at + 1, end), True, key=lambda k: not keys[k].as_py().startswith(inner)) + at + 1  # noqa: B023
                _judge(stack, paths.slice(at, end - at), rules[at:end], verdicts[at:end])
            at = end
        chosen = pa.array(is_url)
        urls = batch.filter(chosen)
        yield pa.RecordBatch.from_arrays(
            [urls.column("page_id"), urls.column("host"), urls.column("path"), pa.array(rules[is_url], pa.string()), pa.array(verdicts[is_url], pa.string())],
            ["page_id", "host", "path", "rule", "verdict"],
        )


def _judge(stack: list[_Rules], paths: pa.Array, rules: np.ndarray, verdicts: np.ndarray) -> None:
    """Write the longest fitting rule of each path and its verdict; of one length the longer host wins."""
    open_ = np.ones(len(paths), bool)
    every = sorted(((len(own.host) + n, len(own.host), n, own) for own in stack for n in own.paths), key=lambda x: (-x[0], -x[1]))
    for _, _, n, own in every:
        known = own.paths[n]
        heads = pc.utf8_slice_codeunits(paths, 0, n)
        found = pc.index_in(heads, pa.array(list(known), pa.string())).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(open_ & ~np.isnan(found.astype(float)))
        if len(hit):
            names, decided = np.array([own.host + p for p in known], object), np.array(list(known.values()), object)
            rules[hit], verdicts[hit] = names[found[hit].astype(int)], decided[found[hit].astype(int)]
            open_[hit] = False
            if not open_.any():
                return
