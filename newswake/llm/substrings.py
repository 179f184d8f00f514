"""Substring deduplication by fixed-block anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswake.llm.common import filled, table
from newswake.llm.packed import BLOB, Packer, by_shard, mixed, shard_count, shard_of, unpacked, word_hashes
from newswake.session import written

WINDOW = 13  # words of a repeat at least
GROUPS = 64  # of documents, at least: answers meet texts group by group
HITS = "home int, docs binary, sizes binary, keys binary"


def block_length(window: int) -> int:
    """The longest block of which every window holds a whole one, wherever the blocks lie."""
    return (window + 1) // 2


def _rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    factor = 1
    for k in range(n):
        total += hashes[k:len(hashes) - n + 1 + k] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
    return mixed(total)


def _spread(marks: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the runs of ``n`` that start at the marks."""
    steps = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(marks)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + n, size), -1)
    return np.cumsum(steps[:-1]) > 0


def _home(docs: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(docs.astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int32)


def _answers(docs: np.ndarray, keys: np.ndarray, groups: int) -> Iterator[pd.DataFrame]:
    """The keys that hold of each document, packed by the group of the document."""
    if not len(docs):
        return
    home = _home(docs, groups)
    order = np.lexsort((docs, home))
    home, docs, keys = home[order], docs[order], keys[order]
    bounds = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1], [True])))
    rows = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        starts = np.flatnonzero(np.concatenate(([True], docs[a + 1:b] != docs[a:b - 1])))
        rows.append((home[a], docs[a:b][starts].astype("<i8").tobytes(), np.diff(np.append(starts, b - a)).astype("<u4").tobytes(),
                     keys[a:b].astype("<u8").tobytes()))
    yield pd.DataFrame(rows, columns=["home", "docs", "sizes", "keys"])


def _grouped(hits: pd.DataFrame) -> dict[int, np.ndarray]:
    """Document -> its keys, sorted."""
    if not len(hits):
        return {}
    sizes = np.frombuffer(b"".join(hits["sizes"]), "<u4")
    docs = np.repeat(np.frombuffer(b"".join(hits["docs"]), "<i8"), sizes)
    keys = np.frombuffer(b"".join(hits["keys"]), "<u8")
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    bounds = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1], [True])))
    return {int(docs[a]): keys[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)}


def _within(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys


#: Bytes of a key that travel: the low ones; the shard stands for the high ones. The low bit of an anchor is its mark.
ANCHOR_BYTES, WINDOW_BYTES = 5, 8


def _low(keys: np.ndarray, width: int) -> np.ndarray:
    return keys & np.uint64((1 << 8 * width) - 1)


def _full(shard, low: np.ndarray) -> np.ndarray:
    """Shard and low bytes in one number, for keys of less than eight bytes."""
    return low | (np.asarray(shard).astype(np.uint64) << np.uint64(8 * ANCHOR_BYTES))


def _anchor_keys(keys: np.ndarray, shards: int) -> np.ndarray:
    return _full(shard_of(keys, shards), _low(keys, ANCHOR_BYTES) & ~np.uint64(1))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text_sha256) of every row: words in repeats of ``window`` words are removed.

    A word goes if it lies in a run of ``window`` words that also starts in a
    document with a smaller id. All is judged on the input.

    1. The reference index holds the blocks of every document, (window + 1) / 2
       words each, end to end. Every rolling window of that many words of
       every document probes it. A repeat of ``window`` words holds a whole
       block wherever it starts, so it gives a hit of a later document on an
       earlier one; both sides keep the hits.
    2. Hits are extended: in the texts of documents with hits, the runs of
       ``window`` words around them are looked up by a 64-bit hash, and
       those that an earlier document has count. Overlapping runs make up the
       maximal repeats.
    3. The words that they cover are removed.

    Each exchange moves packed keys, once per document and key: copies meet as
    one smallest id per key and never in pairs. Texts travel compressed, once, and those with hits a second time.

    Null texts have no words. A null id is removed nothing and is no
    reference. Rows that repeat an id are one document as to "smaller".
    """
    spark = docs.sparkSession
    block = block_length(window)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), filled(F.col("text")).alias("text"))
    shards = shard_count(rows)
    groups = max(GROUPS, shards // 4)
    cache: dict = {}

    def split(text: str | bytes) -> tuple[list[bytes], np.ndarray]:
        """Words of a text, or of one that travels compressed."""
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else zstandard.decompress(text)
        words = raw.split()
        return words, word_hashes(words, cache)

    def probe(batches):
        packer = Packer(shards, ANCHOR_BYTES)
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                if pd.isna(doc):
                    continue
                words, hashes = split(text)
                if len(words) < window:
                    continue
                runs = _rolling(hashes, block) & ~np.uint64(1)
                keys, place = np.unique(runs, return_inverse=True)
                flags = np.zeros(len(keys), np.uint64)
                flags[place[::block]] = 1
                packer.add(int(doc), keys | flags)
                if packer.full():
                    yield packer.frame()
        yield packer.frame()

    def meet(shard, blobs):
        ids, keys, _ = unpacked(blobs, ANCHOR_BYTES)
        order = np.argsort(keys, kind="stable")
        ids, keys = ids[order], keys[order]
        aligned, keys = (keys & np.uint64(1)) == 1, keys & ~np.uint64(1)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        first = np.repeat(np.minimum.reduceat(np.where(aligned, ids, np.iinfo(np.int64).max), starts), sizes)
        last = np.repeat(np.maximum.reduceat(ids, starts), sizes)
        hit = (ids > first) | (aligned & (ids < last))
        yield from _answers(ids[hit], _full(shard, keys[hit]), groups)

    probes = rows.mapInPandas(probe, BLOB)
    hits = by_shard(probes, meet, HITS)
    homes = rows.select("doc_id", "text", F.lit(None).cast("int").alias("home"))

    def sent_home(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids = batch["doc_id"].fillna(0).to_numpy(np.int64)
            texts = [squeeze(x.encode("utf-8", "surrogatepass")) for x in batch["text"]]
            yield batch.assign(home=_home(ids, groups), text=texts)

    homes = homes.mapInPandas(sent_home, "doc_id bigint, text binary, home int")
    result = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"

    def candidates(runs_found: np.ndarray, n_windows: int) -> np.ndarray:
        """The windows that hold a run with a hit."""
        steps = np.concatenate(([0], np.cumsum(runs_found)))
        return steps[window - block + 1:][:n_windows] > steps[:n_windows]

    def extend(texts, found):
        known = _grouped(found)
        packer = Packer(shards, WINDOW_BYTES)
        done, waiting = [], []
        for doc, text, home in zip(texts["doc_id"], texts["text"], texts["home"], strict=True):
            words, hashes = split(text)
            own = None if pd.isna(doc) else known.get(int(doc))
            if own is None or len(words) < window:
                done.append((doc, len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()))
                continue
            marks = _within(_anchor_keys(_rolling(hashes, block), shards), own)
            wide = _rolling(hashes, window)
            keys = np.unique(wide[candidates(marks, len(wide))])
            packer.add(int(doc), keys)
            waiting.append((doc, text, home))
        out = pd.DataFrame(done, columns=["doc_id", "n_words", "n_removed", "kept_sha256"]).assign(kind=0)
        texts = pd.DataFrame(waiting, columns=["doc_id", "text", "home"]).assign(kind=1)
        frame = pd.concat([out, texts, packer.frame().assign(kind=2)])
        return frame.reindex(columns=["kind", "doc_id", "n_words", "n_removed", "kept_sha256", "text", "home", *[c.split()[0] for c in BLOB.split(", ")]]).astype(
            {"kind": "int32", "doc_id": "Int64", "n_words": "Int64", "n_removed": "Int64", "home": "Int32", "shard": "Int32"}).astype(object).where(lambda x: x.notna(), None)

    columns = f"kind int, {result}, text binary, home int, {BLOB}"
    state = written(homes.groupBy("home").cogroup(hits.groupBy("home")).applyInPandas(extend, columns), "extended")

    def confirm(shard, blobs):
        ids, keys, _ = unpacked(blobs, WINDOW_BYTES)
        order = np.argsort(keys, kind="stable")
        ids, keys = ids[order], keys[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        first = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.append(starts, len(keys))))
        yield from _answers(ids[ids > first], keys[ids > first], groups)

    repeats = by_shard(state.filter("kind = 2").select(*[c.split()[0] for c in BLOB.split(", ")]), confirm, HITS)

    def cut(texts, found):
        known = _grouped(found)
        out = []
        for doc, text in zip(texts["doc_id"], texts["text"], strict=True):
            words, hashes = split(text)
            own = known.get(int(doc))
            gone = np.zeros(len(words), bool)
            if own is not None:
                gone = _spread(_within(_rolling(hashes, window), own), window, len(words))
            kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g])
            out.append((int(doc), len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    waiting = state.filter("kind = 1").select("doc_id", "text", "home")
    done = waiting.groupBy("home").cogroup(repeats.groupBy("home")).applyInPandas(cut, result)
    untouched = state.filter("kind = 0").select("doc_id", "n_words", "n_removed", "kept_sha256")
    return untouched.unionByName(done)


def op6_block_anchors(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
