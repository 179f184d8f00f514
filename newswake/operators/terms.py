"""Which terms are frequent, found by hashes: the terms of a text move as sorted hashes, and only bits come back.

The words of the texts are packed in chunks. A chunk sends the hashes of its
n-grams, each once, to the tasks that own a range of hashes; these add up over
all chunks and answer with a bit per hash. The chunk then makes the strings
of the terms that stay. Hashes have 96 bits and are compared without the words:
among 2.4 billion terms two of equal hash are expected with a chance of 1 in 10 billion.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswake.session import written

CHUNK_BYTES = 4_000_000  # of words whose terms are made at once
RANGE_BYTES = 8_000_000  # of words and sizes of n-grams that a range of hashes stands for
KEPT = ["event_id", "root_id", "post_id", "n"]


def packed_texts(listed: DataFrame) -> DataFrame:
    """Texts (``event_id, root_id, post_id, n, words``) in chunks of about ``CHUNK_BYTES``, written: ``chunk, bytes, texts``."""
    most = CHUNK_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, current = [], 0, 0
        number = TaskContext.get().partitionId() << 33

        def packet() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for batch in held:
                    stream.write_batch(batch)
            size = sum(pc.sum(pc.binary_length(batch["words"])).as_py() or 0 for batch in held)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([number]), "bytes": pa.array([size], pa.int64()), "texts": pa.array([sink.getvalue().to_pybytes()])})

        for batch in batches:
            if not len(batch):
                continue
            ends = total + np.cumsum(pc.fill_null(pc.binary_length(batch["words"]), 0).to_numpy().astype(np.int64))
            total, piece = int(ends[-1]), ends // most
            cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(batch)]
            for first, last in zip(cuts, cuts[1:]):
                if held and piece[first] != current:
                    yield packet()
                    held, number = [], number + 1
                current = piece[first]
                held.append(batch.slice(first, last - first))
        if held:
            yield packet()

    rows = listed.select(*KEPT, "words").mapInArrow(pack, "chunk bigint, bytes bigint, texts binary")
    return written(rows, "chunks")


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(n: int) -> np.ndarray:
    """An odd number for each lane and place of an n-gram, others for each n."""
    numbers = np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(1000 * n)
    return (_mixed(numbers * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)).reshape(2, n)


class Grams:
    """The n-grams of a chunk: distinct entries sorted by hash (and event), and the texts that have them.

    ``high`` and ``low`` are the hash of an entry, ``event`` the place of its event in ``events`` (0 if events do not
    matter), ``texts`` how many texts have it and ``value`` the sum of their counts. ``pair_entry``, ``pair_text``, ``pair_at`` and
    ``pair_size`` are a row for each text and term.
    """

    def __init__(self, packet: bytes, n_min: int, n_max: int, by_event: bool):
        self.rows = pa.ipc.open_stream(packet).read_all().combine_chunks()
        words = pc.split_pattern(pc.fill_null(_flat(self.rows["words"]), ""), " ")
        of = np.repeat(np.arange(len(words), dtype=np.int32), pc.list_value_length(words).to_numpy())
        coded = words.flatten().dictionary_encode()
        self.words, ids = coded.dictionary, coded.indices.to_numpy()
        filled = ids != (self.words.index(pa.scalar("", self.words.type)).as_py() if len(self.words) else -1)
        self.ids, of = ids[filled], of[filled]
        digests = b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in self.words.to_pylist())
        lanes = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        event = np.zeros(len(self.rows), np.int32)
        self.events = np.zeros(1, np.uint64)
        if by_event:
            listed = _flat(self.rows["event_id"]).dictionary_encode(null_encoding="encode")
            event = listed.indices.to_numpy().astype(np.int32)
            self.events = np.array([_event_hash(e) for e in listed.dictionary.to_pylist()], np.uint64)
        found = []
        for n in range(n_min, n_max + 1):
            many = len(self.ids) - n + 1
            if many <= 0:
                continue
            at = np.flatnonzero(of[:many] == of[n - 1:])
            high, low = (_mixed(sum(lanes[self.ids[at + k], lane] * _factors(n)[lane, k] for k in range(n))) for lane in (0, 1))
            found.append((high, (low >> np.uint64(32)).astype(np.uint32), of[at], at.astype(np.int32), np.full(len(at), n, np.int8)))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, t) for t in (np.uint64, np.uint32, np.int32, np.int32, np.int8)]
        high, low, text, place, size = columns
        order = np.lexsort((event[text], low, high)) if by_event else np.lexsort((low, high))  # stable: of an entry by text
        high, low, text, place, size = (x[order] for x in columns)
        first = np.ones(len(high), bool)
        first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (event[text[1:]] != event[text[:-1]])
        fresh = first.copy()
        fresh[1:] |= text[1:] != text[:-1]
        entry = np.cumsum(first) - 1
        self.pair_entry, self.pair_text, self.pair_at, self.pair_size = entry[fresh], text[fresh], place[fresh], size[fresh]
        self.high, self.low, self.event = high[first], low[first], event[text[first]]
        starts = np.flatnonzero(first[fresh])
        n = np.nan_to_num(_flat(self.rows["n"]).to_numpy(zero_copy_only=False)).astype(np.int64)
        self.texts = np.diff(np.append(starts, len(self.pair_entry))).astype(np.int32)
        self.value = np.add.reduceat(n[self.pair_text], starts) if len(starts) else np.zeros(0, np.int64)

    def ranges(self, many: int) -> np.ndarray:
        """Where the entries of each of ``many`` ranges of hashes begin, and the end."""
        owner = ((self.high >> np.uint64(32)) * np.uint64(many)) >> np.uint64(32)
        return np.searchsorted(owner, np.arange(many + 1, dtype=np.uint64))

    def strings(self, at: np.ndarray, size: np.ndarray) -> pa.Array:
        """The terms of ``size`` words from the words at ``at``."""
        parts, order = [], []
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            words = [self.words.take(pa.array(self.ids[at[own] + k])) for k in range(n)]
            parts.append(words[0] if n == 1 else pc.binary_join_element_wise(*words, " "))
            order.append(own)
        if not parts:
            return pa.array([], pa.string())
        back = np.argsort(np.concatenate(order), kind="stable")
        return pa.concat_arrays([p.cast(pa.string()) for p in parts]).take(pa.array(back))


def _flat(column: pa.ChunkedArray) -> pa.Array:
    flat = column.combine_chunks()
    return pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat


def _event_hash(event) -> int:
    return int.from_bytes(hashlib.blake2b(b"" if event is None else b"=" + str(event).encode(), digest_size=8).digest(), "little")


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns byte by byte, so that equal high bytes stand together."""
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in columns)
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _opened(packet: bytes, many: int, *kinds: type) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(packet[8:], int.from_bytes(packet[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    found, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        found.append(np.ascontiguousarray(planes[at:at + many * width].reshape(width, many).T).view(kind).ravel())
        at += many * width
    return found


def _census(chunks: DataFrame, n_min: int, n_max: int, by_event: bool, ranges: int, parts: int) -> DataFrame:
    """What each chunk has in each range of hashes: ``range, chunk, many, events, entries``."""
    names = ["range", "chunk", "many", "events", "entries"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, packet in zip(batch["chunk"].to_pylist(), batch["texts"]):
                grams = Grams(packet.as_py(), n_min, n_max, by_event)
                ends = grams.ranges(ranges)
                rows = []
                for k in np.flatnonzero(np.diff(ends)).tolist():
                    own = slice(ends[k], ends[k + 1])
                    used, event = np.unique(grams.event[own], return_inverse=True)
                    more = (event.astype(np.int32), grams.value[own]) if by_event else ()
                    entries = _squeezed(np.diff(grams.high[own], prepend=np.uint64(0)), grams.low[own], grams.texts[own], *more)
                    rows.append((k, chunk, int(ends[k + 1] - ends[k]), grams.events[used].tobytes(), entries))
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    dealt = chunks.select("chunk", "texts").repartition(parts, "chunk")
    return dealt.mapInArrow(count, "range int, chunk bigint, many int, events binary, entries binary")


def _answers(census: DataFrame, min_texts: int, by_event: bool, ranges: int) -> DataFrame:
    """Per chunk and range a bit for each entry: whether its term is in ``min_texts`` texts.

    By event only the first chunk that has the term in the event gets a bit, and with it the sum over all chunks and the
    number of events that have the term.
    """

    def merge(rows: pa.Table) -> pa.Table:
        many = rows["many"].to_numpy()
        kinds = (np.uint64, np.uint32, np.int32, *((np.int32, np.int64) if by_event else ()))
        opened = [_opened(e.as_py(), m, *kinds) for e, m in zip(rows["entries"], many.tolist())]
        high, low, texts, *more = ([x[i] for x in opened] for i in range(len(kinds)))
        high = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in high])
        low, texts = np.concatenate(low), np.concatenate(texts)
        del opened
        keys = [low, high]
        if by_event:
            event = np.concatenate([np.frombuffer(e.as_py(), np.uint64)[i] for e, i in zip(rows["events"], more[0])])
            value, keys = np.concatenate(more[1]), [event, *keys]
        order = np.lexsort(keys)
        changes = np.ones(len(order), bool)
        changes[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
        term = np.cumsum(changes) - 1
        often = np.add.reduceat(texts[order].astype(np.int64), np.flatnonzero(changes)) >= min_texts
        flags = np.zeros(len(order), bool)
        if by_event:
            cells = changes.copy()
            cells[1:] |= np.diff(event[order]) != 0
            begin = np.flatnonzero(cells)
            sums, spread = np.zeros(len(order), np.int64), np.zeros(len(order), np.int32)
            sums[order[begin]] = np.add.reduceat(value[order], begin)
            spread[order[begin]] = np.bincount(term[begin])[term[begin]]
            flags[order[begin]] = often[term[begin]]
        else:
            flags[order] = often[term]
        bits, ends = [], np.cumsum(many)
        for first, last in zip((ends - many).tolist(), ends.tolist()):
            own = flags[first:last]
            packet = _squeezed(np.packbits(own))
            if by_event:
                packet = len(packet).to_bytes(8, "little") + packet + _squeezed(sums[first:last][own], spread[first:last][own])
            bits.append(packet)
        return pa.table({"chunk": rows["chunk"], "range": rows["range"], "many": rows["many"], "bits": pa.array(bits, pa.binary())})

    dealt = census.repartition(ranges, "range").groupBy("range")
    return written(dealt.applyInArrow(merge, "chunk bigint, range int, many int, bits binary"), "answers")


def _told(answers: pa.Table, by_event: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bits of a chunk's entries, and the sums and numbers of events of those that have one."""
    flags, sums, spread = [np.zeros(0, bool)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for row in answers.sort_by("range").select(["many", "bits"]).to_pylist():
        packet, rest = row["bits"], b""
        if by_event:
            size = int.from_bytes(packet[:8], "little")
            packet, rest = packet[8:8 + size], packet[8 + size:]
        own = np.unpackbits(_opened(packet, (row["many"] + 7) // 8, np.uint8)[0], count=row["many"]).astype(bool)
        flags.append(own)
        if by_event:
            more = _opened(rest, int(own.sum()), np.int64, np.int32)
            sums.append(more[0])
            spread.append(more[1])
    return np.concatenate(flags), np.concatenate(sums), np.concatenate(spread)


def frequent_terms(listed: DataFrame, n_min: int, n_max: int, min_texts: int, by_event: bool) -> DataFrame:
    """Terms of ``n_min`` to ``n_max`` words that are in ``min_texts`` texts (``event_id, root_id, post_id, n, words``).

    A row per text and term (``event_id, root_id, post_id, n, term``), or by event one per event and term: ``event_id,
    term, value`` (the sum of n) and ``df`` (the events that have the term).
    """
    chunks = packed_texts(listed)
    count, total = chunks.agg(F.count("*"), F.sum("bytes")).first()
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    ranges = max(cores, math.ceil((total or 0) * (n_max - n_min + 1) / RANGE_BYTES))
    answers = _answers(_census(chunks, n_min, n_max, by_event, ranges, max(cores, count)), min_texts, by_event, ranges)
    types = {c: listed.schema[c].dataType.simpleString() for c in KEPT}

    def name(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(chunk["texts"][0].as_py(), n_min, n_max, by_event)
        flags, sums, spread = _told(answers, by_event)
        if by_event:
            firsts = np.flatnonzero(np.diff(grams.pair_entry, prepend=-1))[flags]
            own = {"event_id": grams.rows["event_id"].take(pa.array(grams.pair_text[firsts]))}
            return pa.table({**own, "term": grams.strings(grams.pair_at[firsts], grams.pair_size[firsts]), "value": sums, "df": spread.astype(np.int64)})
        kept = np.flatnonzero(flags[grams.pair_entry]) if len(flags) else np.zeros(0, np.int64)
        text = pa.array(grams.pair_text[kept])
        own = {c: grams.rows[c].take(text) for c in KEPT}
        return pa.table({**own, "term": grams.strings(grams.pair_at[kept], grams.pair_size[kept])})

    if by_event:
        schema = f"event_id {types['event_id']}, term string, value bigint, df bigint"
    else:
        schema = ", ".join(f"{c} {types[c]}" for c in KEPT) + ", term string"
    parts = max(cores, count)
    dealt = chunks.select("chunk", "texts").repartition(parts, "chunk").groupBy("chunk")
    return dealt.cogroup(answers.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(name, schema)
