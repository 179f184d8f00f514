"""A bigram model in Elias-Fano tries, and the scores of documents under it."""

from __future__ import annotations

import math
import mmap
import tempfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswake.llm.common import filled, table
from newswake.llm.packed import BLOB, Packer, by_shard, mixed, shard_count, unpacked, word_hashes
from newswake.llm.packing import pack, unpack
from newswake.session import written

ADD = 0.1  # to each count of a token
STRENGTH = 50.0  # occurrences that the unigram model counts for in a context
HOT_SHARE = 5000  # a word with more than bytes / HOT_SHARE occurrences is hot: less than HOT_SHARE words
WORD_BYTES, PAIR_BYTES = 6, 8
CONTEXT_BITS, PREDICTED_BITS = 32, 32
CODES = 256  # of quantised values
NO_ID = -(1 << 63)  # stands for a null id inside; a document of this id counts as one without
BEGIN, END = b"\n<begin>", b"\n<end>"  # no words: they hold white space


BLOCK_WORDS = 8  # 64-bit words of the unary part per entry of its directory


def _words(data: bytes, spare: int = 0) -> bytes:
    """Filled up with zeros to whole 64-bit words, and ``spare`` more."""
    return data + bytes(-len(data) % 8 + 8 * spare)


class EliasFano:
    """A sequence of numbers that never falls: low bits packed, high bits in unary.

    The unary part holds a one per number and a zero behind the numbers of each
    high part. ``zeros`` tells the zeros before every BLOCK_WORDS words, so
    a zero or a one is found by a search in this directory and counts of
    bits in the words of one block. Numbers are read and searched in this
    form, for many places at once; only ``decode`` writes all of them out.
    """

    def __init__(self, n: int, low_bits: int, top: int, low: bytes, high: bytes, zeros: bytes):
        self.n, self.low_bits, self.top, self.low = n, low_bits, top, np.frombuffer(low, "<u8")
        self.high, self.zeros = np.frombuffer(high, "<u8"), np.frombuffer(zeros, "<u4")

    @classmethod
    def parts(cls, values: np.ndarray) -> tuple[tuple[int, int, int], list[bytes]]:
        """Numbers (n, low_bits, top) and byte strings, of whole words, from which a sequence is made."""
        n = len(values)
        largest = int(values[-1]) if n else 0
        low_bits = max(0, (largest // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = int(ones[-1]) + 2 if n else 0
        bits = np.zeros(-(-size // (64 * BLOCK_WORDS)) * 64 * BLOCK_WORDS, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little")
        full = np.bitwise_count(high.view("<u8")).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.int64)
        before = np.concatenate(([0], np.cumsum(64 * BLOCK_WORDS - full)[:-1])) if n else np.empty(0)
        low = pack(values & np.uint64((1 << low_bits) - 1), low_bits) if low_bits else b""
        shape = (n, low_bits, largest >> low_bits)
        return shape, [_words(low, 1), high.tobytes(), _words(before.astype("<u4").tobytes())]

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        shape, parts = cls.parts(values)
        return cls(*shape, *parts)

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[:self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        return high | _wide(self.low.tobytes(), self.low_bits, self.n)

    def _select(self, rank: np.ndarray, one: bool) -> np.ndarray:
        """The place of the zero, or one, that has ``rank`` others before it."""
        blocks = len(self.high) // BLOCK_WORDS
        zeros = self.zeros[:blocks].astype(np.int64)
        before = np.arange(blocks) * (64 * BLOCK_WORDS) - zeros if one else zeros
        block = np.searchsorted(before, rank, side="right") - 1
        rank = rank - before[block]
        words = self.high.reshape(-1, BLOCK_WORDS)[block]
        if not one:
            words = ~words
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        at = (upto <= rank[:, None]).sum(axis=1)
        rows = np.arange(len(rank))
        rank = rank - np.where(at > 0, upto[rows, at - 1], 0)
        word, place = words[rows, at], np.zeros(len(rank), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            lower = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = rank >= lower
            rank = np.where(up, rank - lower, rank)
            word = np.where(up, word >> np.uint64(half), word)
            place += half * up
        return block * (64 * BLOCK_WORDS) + at * 64 + place

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        both = self.low[word] >> shift
        # A shift by 64 is not defined, so the upper word is shifted in two steps.
        both |= (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return both & np.uint64((1 << self.low_bits) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The numbers at some places."""
        high = (self._select(at, True) - at).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._low(at)

    def find(self, wanted: np.ndarray, first=0, last=None) -> np.ndarray:
        """The place of each number in places ``first`` to ``last`` (exclusive), or -1 if it is not there.

        The zeros before and behind its high part bound the successor; the low
        bits of the places between are searched by halves.
        """
        high = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        inside = high <= self.top
        high = np.where(inside, high, 0)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - high + 1, 0)
        end = np.where(inside, self._select(high, False) - high, 0)
        begin, end = np.maximum(begin, first), end if last is None else np.minimum(end, last)
        low, stop = wanted & np.uint64((1 << self.low_bits) - 1), end.copy()
        open_ = np.flatnonzero(begin < stop)
        while len(open_):
            middle = (begin[open_] + stop[open_]) >> 1
            below = self._low(middle) < low[open_]
            begin[open_[below]] = middle[below] + 1
            stop[open_[~below]] = middle[~below]
            open_ = open_[begin[open_] < stop[open_]]
        place = np.full(len(wanted), -1, np.int64)
        some = np.flatnonzero(begin < end)
        hit = some[self._low(begin[some]) == low[some]]
        place[hit] = begin[hit]
        return place


def _wide(data, width: int, n: int) -> np.ndarray:
    if width <= 32:
        return unpack(data, width, n).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def quantised(values: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray]:
    """A code per value, and the mean of the values of each code; codes hold equally many of the different values."""
    different = np.unique(values)
    cuts = different[np.linspace(0, len(different), min(codes, len(different)), endpoint=False).astype(int)]
    code = np.searchsorted(cuts, values, side="right") - 1
    n = np.bincount(code, minlength=len(cuts))
    return code.astype(np.uint8), np.bincount(code, values, minlength=len(cuts)) / np.maximum(n, 1)


class Trie:
    """Two levels in one memory-mapped file: predicted words, and per word the contexts it was seen in.

    Level 1 is the rising keys of the words, with pointers to their children,
    which rise as well. In level 2 the contexts of a word rise and the words
    follow each other, so a context is stored relative to its word, as
    place of the word * 2^CONTEXT_BITS + context. All three are Elias-Fano
    coded. A word is searched in level 1, two pointers bound its children, and a
    context is found by the successor of its number among these. No level is written out.
    """

    def __init__(self, words: np.ndarray, contexts: np.ndarray, values: np.ndarray):
        """Pairs sorted by word and context, with a value each."""
        keys, place, sizes = np.unique(words, return_inverse=True, return_counts=True)
        relative = (place.astype(np.uint64) << np.uint64(CONTEXT_BITS)) | contexts
        codes, book = quantised(values) if len(values) else (np.empty(0, np.uint8), np.empty(0))
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.uint64)
        levels = [EliasFano.parts(x) for x in (keys, ends, relative)]
        parts = [p for _, own in levels for p in own] + [_words(codes.tobytes()), book.astype("<f8").tobytes()]
        bounds = np.cumsum([0, *map(len, parts)]).tolist()
        with tempfile.TemporaryFile() as f:  # nameless: it is gone with its last use
            f.write(b"".join(parts) or b"\0")
            f.flush()
            whole = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        mapped = [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.keys, self.ends, self.children = (
            EliasFano(*shape, *mapped[3 * k:3 * k + 3]) for k, (shape, _) in enumerate(levels))
        self.codes, self.book = np.frombuffer(mapped[9], np.uint8), np.frombuffer(mapped[10], "<f8")

    def values(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """The value of each pair, 0 where it was not seen."""
        out = np.zeros(len(words))
        if not self.keys.n:
            return out
        different, asked = np.unique(words, return_inverse=True)
        place = self.keys.find(different)
        known = place[asked] >= 0
        first, last = (self.ends.get(np.maximum(place, 0) + k).astype(np.int64)[asked[known]] for k in (0, 1))
        wanted = (place[asked[known]].astype(np.uint64) << np.uint64(CONTEXT_BITS)) | contexts[known]
        at = self.children.find(wanted, first, last)
        out[np.flatnonzero(known)[at >= 0]] = self.book[self.codes[at[at >= 0]]]
        return out


def is_training(doc: int) -> bool:
    return doc != NO_ID and zlib.crc32(str(doc).encode()) % 10 != 0


def _training(docs: np.ndarray) -> np.ndarray:
    different, place = np.unique(docs, return_inverse=True)
    return np.array([is_training(int(d)) for d in different], bool)[place]


def _sums(docs: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    different, place = np.unique(docs, return_inverse=True)
    return different, [np.bincount(place, c, minlength=len(different)) for c in columns]


ANSWER = "kind int, id bigint, x double, y double, z double"


def _answer(kind: int, ids, x, y=0.0, z=0.0) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(ids), kind, np.int32), "id": ids, "x": x, "y": y, "z": z})


def score(docs: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """Base score and model score of every document, under counts of the training documents.

    A document trains unless crc32 of its id as text is 0 modulo 10. The
    model is p(w | v) = (c(v, w) + strength * p(w)) / (c(v) + strength) with
    p(w) = (c(w) + ADD) / (N + ADD * (V + 1)); v is the word before, or the
    begin. So the log of p(w | v) is log p(w), a part of v alone, and
    log(1 + c(v, w) / (strength * p(w))) for pairs that were seen.

    Two exchanges of packed keys, both over all documents. Words: each shard
    counts its words and gives every document the sums of the first two
    parts. Pairs: shards by predicted word, so counts of a word are whole
    there, build the trie of their training pairs and look up the pairs of
    every document. Words that are hot are few and their counts
    known after the first exchange; their pairs are dealt out by the context as well. The
    sums of a document are added up by Spark.

    Null texts are empty: one end token. Rows that repeat an id are one
    document whose texts are summed, and so are rows without an id; the
    hold-out rule cannot be asked for these, so they are held out. An empty table gives an empty one.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    rows = docs.select(doc_id.alias("doc_id"), filled(F.col("text")).alias("text"))
    shards = shard_count(rows)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hot_from = size / HOT_SHARE
    cache: dict = {}

    def split(text: str) -> np.ndarray:
        return mixed(word_hashes(text.encode("utf-8", "surrogatepass").lower().split(), cache))

    def words(batches):
        packer = Packer(shards, WORD_BYTES)
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                keys, n = np.unique(split(text), return_counts=True)
                while len(keys):
                    packer.add(int(doc), keys, np.minimum(n, 255))
                    keys, n = keys[n > 255], n[n > 255] - 255
                if packer.full():
                    yield packer.frame()
        yield packer.frame()

    def count(shard, blobs):
        ids, keys, n = unpacked(blobs, WORD_BYTES)
        different, place = np.unique(keys, return_inverse=True)
        c = np.bincount(place, n * _training(ids), minlength=len(different))
        yield _answer(1, [0], [c.sum()], [float((c > 0).sum())])
        hot = c > hot_from
        if hot.any():
            yield _answer(2, _hot_id(shard, different[hot]), c[hot])
        own = c[place]
        docs_, (base, known, context) = _sums(
            ids, n * np.log10(own + ADD), n * (own > 0.0), n * np.log10(strength / (own + strength)))
        yield _answer(0, docs_, base, known, context)
        yield _answer(3, *_pair(_sums(ids, n)))

    unigrams = by_shard(rows.mapInPandas(words, BLOB), count, ANSWER)
    unigrams = written(unigrams.groupBy("kind", "id").agg(*[F.sum(c).alias(c) for c in "xyz"]), "words")
    totals = unigrams.filter("kind = 1").first()
    held = (F.col("doc_id") == NO_ID) | (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0)
    copies = rows.groupBy("doc_id").agg(F.count("*").alias("rows")).withColumn("held_out", held)
    n_training = float(copies.filter("NOT held_out").agg(F.sum("rows")).first()[0] or 0)
    total = (totals["x"] if totals else 0.0) + n_training
    distinct = (totals["y"] if totals else 0.0) + (n_training > 0)
    mass = total + ADD * (distinct + 1)
    hot = {r["id"]: r.x for r in unigrams.filter("kind = 2").collect()}
    hot_keys = np.array(sorted(hot), np.int64)

    def hot_at(keys: np.ndarray) -> np.ndarray:
        shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        return np.isin(_hot_id(shard, keys & np.uint64((1 << 8 * WORD_BYTES) - 1)), hot_keys)

    begin, end = (mixed(word_hashes([x], {})) for x in (BEGIN, END))

    def pairs(batches):
        packer = Packer(shards, PAIR_BYTES)
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = np.concatenate((begin, split(text), end))
                v, w = own[:-1], own[1:]
                split_up = hot_at(w)
                split_up[-1] = True
                route = np.where(split_up, mixed(w ^ mixed(v)), w)
                low = (w & np.uint64((1 << PREDICTED_BITS) - 1)) | ((v & np.uint64((1 << CONTEXT_BITS) - 1)) << np.uint64(PREDICTED_BITS))
                both, at, n = np.unique(low, return_index=True, return_counts=True)
                route, marks = route[at], split_up[at].astype(np.uint8) << np.uint8(7)
                while len(both):
                    packer.add(int(doc), both, marks + np.minimum(n, 127).astype(np.uint8), route)
                    more = n > 127
                    both, route, marks, n = both[more], route[more], marks[more], n[more] - 127
                if packer.full():
                    yield packer.frame()
        yield packer.frame()

    hot_counts = {k & ((1 << PREDICTED_BITS) - 1): c for k, c in hot.items()} | {
        int(end[0]) & ((1 << PREDICTED_BITS) - 1): n_training}

    def look_up(shard, blobs):
        docs_, low, extra = unpacked(blobs, PAIR_BYTES)
        n, spread = (extra & 127).astype(np.int64), extra >= 128
        # Words that are dealt out by context are kept apart from others with the same low bits.
        w = (low & np.uint64((1 << PREDICTED_BITS) - 1)) | (spread.astype(np.uint64) << np.uint64(PREDICTED_BITS))
        v = low >> np.uint64(PREDICTED_BITS)
        taught = np.where(_training(docs_), n, 0)
        order = np.lexsort((v, w))
        docs_, w, v, n, taught = docs_[order], w[order], v[order], n[order], taught[order]
        firsts = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (v[1:] != v[:-1]))))
        c = np.add.reduceat(taught, firsts)
        pw, pv = w[firsts], v[firsts]
        word, place = np.unique(pw, return_inverse=True)
        counts = np.bincount(place, c, minlength=len(word))
        for k in np.flatnonzero(word >> np.uint64(PREDICTED_BITS)):
            counts[k] = hot_counts.get(int(word[k]) & ((1 << PREDICTED_BITS) - 1), counts[k])
        p = (counts[place] + ADD) / mass
        seen = c > 0
        trie = Trie(pw[seen], pv[seen], np.log10(1 + c[seen] / (strength * p[seen])))
        gain = np.repeat(trie.values(pw, pv), np.diff(np.append(firsts, len(w))))
        yield _answer(0, *_pair(_sums(docs_, n * gain)))

    gains = by_shard(rows.mapInPandas(pairs, BLOB), look_up, ANSWER).groupBy("id").agg(F.sum("x").alias("gain"))
    sums = unigrams.filter("kind = 0").select(F.col("id").alias("doc_id"), "x", "y", "z")
    sizes = unigrams.filter("kind = 3").select(F.col("id").alias("doc_id"), F.col("x").alias("size"))
    per = copies.join(sums, "doc_id", "left").join(sizes, "doc_id", "left").join(gains.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    n_tokens = zero("size") + F.col("rows")
    base = zero("x") + F.col("rows") * math.log10(n_training + ADD) - n_tokens * math.log10(mass)
    whole = base + zero("z") + F.col("rows") * math.log10(strength / (n_training + strength)) + zero("gain")
    return per.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "held_out", n_tokens.cast("bigint").alias("n_tokens"),
        (zero("y") + F.col("rows") * int(n_training > 0)).cast("bigint").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"), base.alias("base_score"), whole.alias("score"))


def _pair(sums):
    return sums[0], sums[1][0]


def _hot_id(shard, low: np.ndarray) -> np.ndarray:
    """Shard and low bytes of a word's key in one number."""
    return low.astype(np.int64) | (np.asarray(shard).astype(np.int64) << (8 * WORD_BYTES))


def op3_elias_fano_bigrams(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
