"""Exchange of packed keys: what documents ask of a table that is dealt out by key.

An exchange moves one number per different key of a document and not a row
per key: tasks collect the keys of many documents per shard and ship them as
byte strings. A shard is a range of hashes, small enough for one task; a key
that very many documents have adds one entry per document to it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 4 << 20  # of text per shard
MIN_SHARDS = 256
FLUSH = 1 << 19  # keys that a task collects before it ships them
BLOB = "shard int, docs binary, sizes binary, keys binary, extra binary"


def shard_count(docs: DataFrame, text: str = "text") -> int:
    """Shards for a table: more for more text, so that none outgrows a task."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(MIN_SHARDS, math.ceil(total / SHARD_BYTES))


def mixed(keys: np.ndarray) -> np.ndarray:
    """A reversible mix of 64-bit numbers (the finaliser of SplitMix64)."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


class Packer:
    """Collects (document, keys, extra) and gives frames of BLOB rows, one per shard met.

    ``width`` bytes of a key are kept: the low ones, as the shard tells the high ones.
    """

    def __init__(self, shards: int, width: int, extra: str = "<u1"):
        self.shards, self.width, self.extra, self.parts, self.held = shards, width, extra, [], 0

    def add(self, doc: int, keys: np.ndarray, extra: np.ndarray | None = None, route: np.ndarray | None = None) -> None:
        """``extra`` is for all calls or none; ``route`` decides the shard in place of the key."""
        if len(keys):
            self.parts.append((doc, keys, np.empty(0) if extra is None else extra, keys if route is None else route))
            self.held += len(keys)

    def full(self) -> bool:
        return self.held >= FLUSH

    def frame(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({c.split()[0]: [] for c in BLOB.split(", ")}).astype({"shard": "int32"})
        docs = np.repeat(np.array([p[0] for p in self.parts], np.int64), [len(p[1]) for p in self.parts])
        keys, extra, route = (np.concatenate([p[k] for p in self.parts]) for k in (1, 2, 3))
        self.parts, self.held = [], 0
        shard = shard_of(route, self.shards)
        order = np.argsort(shard, kind="stable")
        shard, docs, keys = shard[order], docs[order], keys[order]
        extra = extra[order].astype(self.extra) if len(extra) else extra
        raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :self.width]
        bounds = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
        rows = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            starts = np.flatnonzero(np.concatenate(([True], docs[a + 1:b] != docs[a:b - 1])))
            sizes = np.diff(np.append(starts, b - a)).astype("<u4")
            rows.append((shard[a], docs[a:b][starts].astype("<i8").tobytes(), sizes.tobytes(),
                         np.ascontiguousarray(raw[a:b]).tobytes(), extra[a:b].tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in BLOB.split(", ")])


def unpacked(blobs: pd.DataFrame, width: int, extra: str = "<u1") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, extra) of each entry of the blobs of a shard."""
    sizes = np.frombuffer(b"".join(blobs["sizes"]), "<u4")
    docs = np.repeat(np.frombuffer(b"".join(blobs["docs"]), "<i8"), sizes)
    raw = np.frombuffer(b"".join(blobs["keys"]), np.uint8).reshape(-1, width)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, :width] = raw
    return docs, keys.view("<u8").ravel(), np.frombuffer(b"".join(blobs["extra"]), extra)


def by_shard(blobs: DataFrame, answer: Callable[[int, pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``answer`` gives for each shard. A task takes its shards one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            cuts = np.flatnonzero(np.diff(batch["shard"].to_numpy())) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                part = batch.iloc[a:b]
                if held and held[0]["shard"].iloc[0] != part["shard"].iloc[0]:
                    yield from answer(int(held[0]["shard"].iloc[0]), pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield from answer(int(held[0]["shard"].iloc[0]), pd.concat(held))

    return blobs.repartition("shard").sortWithinPartitions("shard").mapInPandas(run, schema)


def word_hashes(words: list[bytes], cache: dict, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words; the cache is emptied when it has grown large."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(cache) > 200_000:
        cache.clear()
    for w in set(words):
        if w not in cache:
            cache[w] = digest(w, seed)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
