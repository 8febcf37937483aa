"""URL filter: rules and list entries in a sorted array of 64-bit xxhash digests.

An entry is a host and the start of a path. A URL is tried with every suffix of its host that begins at a label, and
with every start of its path that is as long as some entry's; each such key's digest is looked up in the sorted array
by vectorised binary search, and the entry's stored full string must equal the key, so that equal digests do no harm.
The longest entry (host and path together) that fits decides, of equally long ones that with the longer host; a URL
that none fits is allowed.

The array is written as a ``.npy`` file to the worker's temporary folder and memory-mapped from there. A list of up to
``most`` entries is shipped to the workers whole; a longer one is cut into shards by digest, each shard is mapped
where its keys are tried, and the tried keys are dealt by the same shards, hot hosts after removing repetitions. The
number of shards follows the number of keys, so that a shard has about SHARD_KEYS.

Null URLs and URLs without ``://`` have empty host and path. Repeated rows are judged alike. Of entries with the same
host and path, that whose verdict sorts first counts.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a shard, on average; a shard's keys are gathered in one task.
SHARD_KEYS = 100_000


def host_column(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


class DigestArray:
    """Keys (host, a blank, path) in the order of their digests, the digests memory-mapped."""

    def __init__(self, keys: list[str], values: list[str]) -> None:
        digests = np.fromiter(map(digest, keys), np.uint64, len(keys))
        order = np.argsort(digests, kind="stable")
        self.keys = np.array(keys, object)[order]
        self.values = np.array(values, object)[order]
        self.path_lengths = sorted({len(k.partition(" ")[2]) for k in keys})
        fd, name = tempfile.mkstemp(suffix=".npy")
        with os.fdopen(fd, "wb") as f:
            np.save(f, digests[order])
        self.digests = np.load(name, mmap_mode="r") if len(keys) else digests
        os.unlink(name)  # the mapping stays

    def find(self, keys: list[str]) -> np.ndarray:
        """Position of each key, or -1."""
        wanted = np.fromiter(map(digest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        found = np.full(len(keys), -1)
        todo = np.flatnonzero(at < len(self.digests))
        while len(todo):  # more than one step only where digests collide
            todo = todo[self.digests[at[todo]] == wanted[todo]]
            same = np.array([self.keys[at[i]] == keys[i] for i in todo], bool)
            found[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < len(self.digests)]
        return found


def tried_keys(host: str, path: str, path_lengths: list[int]) -> list[str]:
    """The keys that would fit a URL, the longest first, of equally long ones that with the longer host."""
    suffixes = [host] if host else []
    at = host.find(".")
    while at >= 0:
        suffixes.append(host[at + 1 :])
        at = host.find(".", at + 1)
    keys = [f"{s} {path[:n]}" for s in suffixes for n in path_lengths if n <= len(path)]
    return sorted(keys, key=lambda k: (len(k), k.find(" "), k), reverse=True)


KIND = pa.struct([("rule", pa.string()), ("verdict", pa.string())])


def _entries(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(F.min("verdict").alias("verdict"))


def judge(pages: DataFrame, entries: DataFrame, most: int = 100_000) -> DataFrame:
    """``pages`` (page_id, url) with host, path, the entry that decides (host and path joined, else null) and the verdict.

    entries: host, path, verdict (allow or block).
    """
    parts = pages.select("page_id", host_column(F.col("url")).alias("host"), path_column(F.col("url")).alias("path"))
    entries = _entries(entries)
    head = entries.limit(most + 1).collect()  # bounded by most
    if len(head) > most:
        return _judge_sharded(parts, entries)
    shipped = pages.sparkSession.sparkContext.broadcast(([f"{r.host} {r.path}" for r in head], [r.verdict for r in head]))

    def judged(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = DigestArray(*shipped.value)
        for hosts, paths in batches:
            tried = [tried_keys(h, p, index.path_lengths) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            counts = np.array([len(t) for t in tried], np.int64)
            found = index.find([k for t in tried for k in t])
            hit = np.flatnonzero(found >= 0)
            row, first = np.unique(np.repeat(np.arange(len(tried)), counts)[hit], return_index=True)
            rule, verdict = np.full(len(tried), None, object), np.full(len(tried), "allow", object)
            rule[row] = [index.keys[i].replace(" ", "", 1) for i in found[hit[first]]]
            verdict[row] = index.values[found[hit[first]]]
            yield pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string())], fields=list(KIND))

    judged.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return parts.withColumn("d", F.arrow_udf(judged, "struct<rule:string,verdict:string>")("host", "path")).select("page_id", "host", "path", "d.*")


def _judge_sharded(parts: DataFrame, entries: DataFrame) -> DataFrame:
    """For lists of any length. Only distinct keys are dealt, so a hot host or path is tried once."""
    lengths = sorted(r[0] for r in entries.select(F.length("path")).distinct().collect())  # path lengths: at most the longest path's
    keyed = entries.select(F.concat_ws(" ", "host", "path").alias("key"), "verdict")
    keys = F.arrow_udf(_tried(lengths), "array<string>")
    named = parts.where("host <> ''")
    urls = named.select("host", "path").distinct().select("host", "path", F.explode(keys("host", "path")).alias("key"))
    tried = urls.select("key").distinct()
    bits = max(8, math.ceil(math.log2(max(keyed.count(), tried.count(), 1) / SHARD_KEYS)))
    shard = F.arrow_udf(_shard_of(bits), "int")
    keyed, tried = keyed.withColumn("shard", shard("key")), tried.withColumn("shard", shard("key"))
    hits = keyed.groupBy("shard").cogroup(tried.groupBy("shard")).applyInPandas(_probe, "key string, verdict string")
    best = urls.join(hits, "key").groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), F.length(F.substring_index("key", " ", 1)), "key")).alias("b"))
    best = best.select("host", "path", F.regexp_replace("b.key", "^([^ ]*) ", "$1").alias("rule"), "b.verdict")
    done = named.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    none = parts.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return done.union(none)


def _shard_of(bits: int):
    def shard_of(keys: pa.Array) -> pa.Array:
        return pa.array([digest(k) >> (64 - bits) for k in keys.to_pylist()], pa.int32())

    shard_of.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    return shard_of


def _tried(lengths: list[int]):
    def tried(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([tried_keys(h, p, lengths) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)], pa.list_(pa.string()))

    tried.__annotations__ = {"hosts": pa.Array, "paths": pa.Array, "return": pa.Array}
    return tried


def _probe(entries: pd.DataFrame, tried: pd.DataFrame) -> pd.DataFrame:
    index = DigestArray(entries["key"].tolist(), entries["verdict"].tolist())
    found = index.find(tried["key"].tolist())
    hit = found >= 0
    return pd.DataFrame({"key": tried["key"].to_numpy()[hit], "verdict": index.values[found[hit]]})
