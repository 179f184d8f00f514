"""Word vectors: training and similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newswake.operators.joins import one_per_element, top_n_per_group
from newswake.operators.phrases import apply_phrases, learn_phrases
from newswake.session import written

PARTS = 8  # of a training at least, whatever the number of cores: their merged vectors then do not depend on it
PART_TOKENS = 6_000_000  # a part is at most about as long: a task holds the vectors of the words in its part
STEP = 0.05  # of a vector, over the root of its summed squares of gradients
NEGATIVES = 5  # drawn words per pair of neighbours
DRAWN = 64  # drawn words that the pairs of a block share, each weighed as its share of ``NEGATIVES``
BLOCK = 4096  # vectors that are compared with each other in one task


@dataclass(frozen=True)
class WordVectors:
    """Trained vectors as a table (word, vector as array): no step passes it through the driver."""

    rows: DataFrame

    def getVectors(self) -> DataFrame:
        return self.rows.select("word", array_to_vector("vector").alias("vector"))

    def findSynonyms(self, word: str, num: int) -> DataFrame:
        """The ``num`` nearest words by cosine, without the word itself."""
        return most_similar(self.rows, [word], topn=num)

    def save(self, path: str) -> None:
        """Fails if there is something at the path."""
        self.rows.write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> WordVectors:
        return cls(spark.read.parquet(path))


def train_word_vectors(
    sentences: DataFrame, size: int = 100, window: int = 5, min_count: int = 5, iterations: int = 5,
    partitions: int = PARTS, seed: int = 1,
) -> WordVectors:
    """Skip-gram vectors of token arrays, by negative sampling. More partitions train faster and need more iterations.

    Sentences are dealt out by the hash of their row (so a key beside the
    tokens spreads equal ones) to ``partitions`` parts, or more if a part had
    over ``PART_TOKENS`` tokens. In an iteration every part trains the vectors
    of its own words, in a task that is sent these alone; those of a word are
    then averaged over its parts. All of it moves by shuffles.
    """
    rows = sentences.select(F.xxhash64(*sentences.columns).alias("place"), "tokens").filter(F.size("tokens") > 0)
    stored = written(rows, "tokens")
    total = stored.agg(F.sum(F.size("tokens"))).first()[0] or 0
    parts = max(partitions, math.ceil(total / PART_TOKENS))
    texts = stored.withColumn("part", F.pmod("place", F.lit(parts)).cast("int"))
    counts = one_per_element(texts, ["part"], F.col("tokens"), "word").groupBy("word", "part").agg(F.count("*").alias("n"))
    words = counts.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list("part").alias("parts")).filter(F.col("n") >= min_count)
    words = written(words, "words")
    if words.isEmpty():
        raise ValueError(f"no word occurs {min_count} times")
    state = words.withColumn("state", F.lit(None).cast("binary"))
    block = min(512, max(32, total // parts // 64))
    for turn in range(iterations):
        state = _averaged(_trained(texts, state, parts, size, window, block, (seed, turn)), size)
    return WordVectors(written(state.select("word", "vector"), "vectors"))


def _trained(texts: DataFrame, state: DataFrame, parts: int, size: int, window: int, block: int, seed: tuple[int, int]) -> DataFrame:
    """An iteration: each part's words with their state after its sentences, a task for a part."""
    word = state.select(F.explode("parts").alias("part"), F.lit(0).alias("kind"), F.xxhash64("word", F.lit(seed[0])).alias("place"), "word", "n", "state",
                        F.lit(None).cast("array<string>").alias("tokens"))
    text = texts.select("part", F.lit(1).alias("kind"), "place", F.lit(None).cast("string").alias("word"), F.lit(None).cast("bigint").alias("n"),
                        F.lit(None).cast("binary").alias("state"), "tokens")
    dealt = word.union(text).repartitionById(parts, "part").sortWithinPartitions("part", "kind", "place", "word")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = [], None
        for batch in batches:
            first = pc.sum(pc.equal(batch["kind"], 0)).as_py() or 0
            known += [batch.slice(0, first)] if first else []
            if first == len(batch):
                continue
            if part is None:
                part = _Part(pa.Table.from_batches(known), size, window, block, seed) if known else None
                if part is None:
                    return
            part.learn(batch.slice(first)["tokens"])
        if part is not None:
            yield from part.told()

    return dealt.mapInArrow(train, "word string, n bigint, part int, state binary")


def _averaged(trained: DataFrame, size: int) -> DataFrame:
    """The words with their mean vector and state, and the parts that have them."""
    told = trained.groupBy("word").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "state"))).alias("told"))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            length = pc.list_value_length(batch["states"]).to_numpy()
            begin = np.cumsum(length) - length
            means = [np.add.reduceat(x, begin, axis=0) / length[:, None].astype(np.float32) for x in _unpacked(batch["states"].flatten(), size)]
            vector = pa.FixedSizeListArray.from_arrays(means[0].ravel(), size).cast(pa.list_(pa.float32()))
            columns = [batch["word"], batch["n"], batch["parts"], _packed(*means), vector]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "parts", "state", "vector"])

    found = told.select("word", "n", F.col("told.part").alias("parts"), F.col("told.state").alias("states"))
    return found.mapInArrow(mean, "word string, n bigint, parts array<int>, state binary, vector array<float>")


def _packed(vector: np.ndarray, beside: np.ndarray, squares: np.ndarray) -> pa.BinaryArray:
    """States as they are shuffled: vectors in half precision, far finer than what a training's chance leaves of them."""
    halves = np.hstack([vector, beside]).astype(np.float16)
    rows = np.hstack([halves.view(np.uint8), np.ascontiguousarray(squares, np.float32).view(np.uint8)])
    return pa.array([x.tobytes() for x in rows], pa.binary())


def _unpacked(states: pa.BinaryArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(states.to_pylist()), np.uint8).reshape(len(states), -1)
    halves = rows[:, :4 * size].copy().view(np.float16).astype(np.float32)
    return halves[:, :size].copy(), halves[:, size:].copy(), rows[:, 4 * size:].copy().view(np.float32)


class _Part:
    """The words of a part, and what they learn from its sentences.

    A state is the vector of a word, its vector as a neighbour, and the sums
    of squares by which steps of the two shrink. Blocks of tokens are learnt
    at once: a step goes by the sum of a word's gradients in a block.
    """

    def __init__(self, words: pa.Table, size: int, window: int, block: int, seed: tuple[int, int]):
        self.rows = words.select(["word", "n", "part"]).combine_chunks().to_batches()[0]
        self.size, self.window, self.block = size, window, block
        self.random = np.random.default_rng([*seed, self.rows["part"][0].as_py()])
        drawn = self.rows["n"].to_numpy().astype(float) ** 0.75
        self.drawn = np.cumsum(drawn) / drawn.sum()
        if words["state"].null_count:
            self.vector, self.beside = self._begun(words["place"].to_numpy()), np.zeros((len(words), size), np.float32)
            self.squares = np.zeros((len(words), 2), np.float32)
        else:
            self.vector, self.beside, self.squares = _unpacked(words["state"], size)

    def _begun(self, place: np.ndarray) -> np.ndarray:
        """Small numbers that the hash of a word gives, the same in every part (SplitMix64)."""
        x = place.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, self.size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53 - 0.5).astype(np.float32) / self.size

    def told(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.rows), 10_000):
            state = _packed(*(x[at:at + 10_000] for x in (self.vector, self.beside, self.squares)))
            yield pa.RecordBatch.from_arrays([*self.rows.slice(at, 10_000).columns, state], [*self.rows.schema.names, "state"])

    def learn(self, sentences: pa.ListArray) -> None:
        """Words that have no vector are left out of their sentence. A block sees the neighbours beyond its ends."""
        ids = pc.index_in(sentences.flatten(), value_set=self.rows["word"])
        of = np.repeat(np.arange(len(sentences)), pc.list_value_length(sentences).to_numpy())[ids.is_valid().to_numpy(zero_copy_only=False)]
        ids = ids.drop_null().to_numpy()
        reach = self.random.integers(1, self.window + 1, len(ids))
        for at in range(0, len(ids), self.block):
            begin, end = max(0, at - self.window), min(len(ids), at + self.block + self.window)
            own = np.arange(begin, end)
            own = (own >= at) & (own < at + self.block)
            self._block(ids[begin:end], of[begin:end], np.where(own, reach[begin:end], 0))

    def _block(self, ids: np.ndarray, of: np.ndarray, reach: np.ndarray) -> None:
        """``reach`` is how far a token looks to both sides; 0 if it is a neighbour only."""
        x, y = self.vector[ids], self.beside[ids]
        to_x, to_y, pairs = np.zeros_like(x), np.zeros_like(y), np.zeros(len(ids), np.float32)
        for far in range(1, min(self.window, len(ids) - 1) + 1):
            front, back = slice(None, -far), slice(far, None)
            same = of[front] == of[back]
            for a, b in ((front, back), (back, front)):
                met = (same & (reach[a] >= far)).astype(np.float32)
                pull = (met / (1 + np.exp(np.clip(np.einsum("ij,ij->i", x[a], y[b]), -30, 30))))[:, None]
                to_x[a] += pull * y[b]
                to_y[b] += pull * x[a]
                pairs[a] += met
        drawn = np.searchsorted(self.drawn, self.random.random(DRAWN)).clip(max=len(self.drawn) - 1)
        z = self.beside[drawn]
        push = -(pairs * (NEGATIVES / DRAWN))[:, None] / (1 + np.exp(np.clip(-(x @ z.T), -30, 30)))
        self._step(self.vector, self.squares[:, 0], ids, to_x + push @ z)
        self._step(self.beside, self.squares[:, 1], np.concatenate([ids, drawn]), np.concatenate([to_y, push.T @ x]))

    @staticmethod
    def _step(vectors: np.ndarray, squares: np.ndarray, ids: np.ndarray, gradients: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        total, rows = np.add.reduceat(gradients[order], starts, axis=0), ids[starts]
        squares[rows] += np.square(total).mean(axis=1)
        vectors[rows] += STEP * total / np.sqrt(squares[rows] + 1e-8)[:, None]


def train_phrase_vectors(sentences: DataFrame, key: str, min_count: int = 5, **training) -> WordVectors:
    """Word vectors of sentences (key, tokens) after their frequent phrases were learnt and merged."""
    merged = apply_phrases(sentences, learn_phrases(sentences), key)
    return train_word_vectors(merged, min_count=min_count, **training)


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def most_similar(
    vectors: DataFrame, positive: Sequence, negative: Sequence = (), topn: int = 10, word: str = "word"
) -> DataFrame:
    """The words nearest to the mean of the signed unit vectors, by cosine, without the given words."""
    unit = vectors.select(word, "vector", F.sqrt(_dot(F.col("vector"), F.col("vector"))).alias("length"))
    given = unit.filter(F.col(word).isin([*positive, *negative]))
    sign = F.when(F.col(word).isin(list(positive)), 1.0).otherwise(-1.0)
    parts = given.select(
        sign.alias("sign"), F.col("length"), F.posexplode("vector").alias("at", "x")
    ).groupBy("at").agg(F.avg(F.col("sign") * F.col("x") / F.col("length")).alias("x"))
    # One number per dimension: the only array gathered, as long as a vector.
    mean = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"])).scalar()
    others = unit.filter(~F.col(word).isin([*positive, *negative])).withColumn("mean", mean)
    cosine = _dot(F.col("vector"), F.col("mean")) / F.col("length") / F.sqrt(_dot(F.col("mean"), F.col("mean")))
    return others.select(word, cosine.alias("similarity")).orderBy(F.desc("similarity"), word).limit(topn)


def nearest(vectors: DataFrame, queries: DataFrame, topn: int = 10, word: str = "word", block: int = BLOCK) -> DataFrame:
    """(query, word, similarity, rank): for each of many query vectors the nearest words by cosine, without itself.

    Vectors and queries are packed in blocks by hash and written once. Every block of queries meets every file of
    blocks of vectors in a task, a matrix product after the other, which reads them where they are: no block is copied
    or shuffled for each that it meets. A task holds two blocks and the ``topn`` best of its queries so far, and only
    those are shuffled. Equal similarities (to nine digits) go by word. Vectors of length 0 are near to none.
    """
    def unit(rows: DataFrame, name: str) -> DataFrame:
        length = F.sqrt(_dot(F.col("vector"), F.col("vector")))
        return rows.select(F.col(word).alias(name), F.transform("vector", lambda x: x.cast("double")).alias("vector"), length.alias("length")).filter(
            "length > 0").select(name, F.transform("vector", lambda x: x / F.col("length")).alias("vector"))

    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_vectors, n_queries = (max(1, math.ceil(df.count() / block)) for df in (vectors, queries))
    word_type = vectors.schema[word].dataType.simpleString()

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("name").combine_chunks()
        names = pa.concat_arrays(rows["name"].chunks)
        numbers = np.array([v for c in rows["vector"].chunks for v in c.to_pylist()], np.float64)
        lists = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
        return pa.table({"block": rows["block"][:1], "names": lists, "numbers": pa.array([numbers.tobytes()], pa.binary())})

    def blocks(rows: DataFrame, n: int) -> DataFrame:
        dealt = unit(rows, "name").withColumn("block", F.pmod(F.xxhash64("name"), F.lit(n)).cast("int")).repartition(n, "block").groupBy("block")
        return written(dealt.applyInArrow(pack, f"block int, names array<{word_type}>, numbers binary"), "blocks")

    # More and smaller blocks of queries than of vectors where there are few, so all cores have work.
    asked = blocks(queries, max(n_queries, min(cores, 4 * n_queries)))
    asked = asked.select("block", F.col("names").alias("queries"), F.col("numbers").alias("asked"))
    both = asked.repartition(max(n_queries, cores), "block").crossJoin(blocks(vectors, n_vectors).select("names", "numbers"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pd.DataFrame] = {}
        for batch in batches:
            for i in range(len(batch)):
                own, (a, b) = batch["block"][i].as_py(), (batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("queries", "names"))
                x, y = (np.frombuffer(batch[c][i].as_buffer(), np.float64).reshape(len(names), -1) for c, names in (("asked", a), ("numbers", b)))
                best[own] = _best(best.get(own), a, x, b, y, topn)
        for near in best.values():
            columns = [pa.array(near[c].to_numpy(), from_pandas=False) for c in ("query", "word", "similarity")]
            yield pa.RecordBatch.from_arrays(columns, ["query", word, "similarity"])

    found = both.mapInArrow(met, f"query {word_type}, {word} {word_type}, similarity double")
    return top_n_per_group(found, ["query"], [F.desc("similarity"), F.asc(word)], topn, [word], rank="rank")


def _best(held: pd.DataFrame | None, asked: np.ndarray, x: np.ndarray, names: np.ndarray, y: np.ndarray, topn: int) -> pd.DataFrame:
    """The ``topn`` nearest of the sorted names for each that asks, and of those held from other blocks."""
    rounded = np.round(x @ y.T, 9)
    # All that are no farther than the last of the best, equal ones included: whole rows are not sorted.
    far = np.where(np.isnan(rounded), np.inf, -rounded)
    first, end = np.searchsorted(names, asked, "left"), np.searchsorted(names, asked, "right")
    for at in np.flatnonzero(end > first):
        far[at, first[at]:end[at]] = np.inf
    last = min(topn, len(names)) - 1
    at, of = np.nonzero(far <= np.partition(far, last, axis=1)[:, last:last + 1])
    near = pd.DataFrame({"at": at, "query": asked[at], "word": names[of], "similarity": rounded[at, of], "far": far[at, of]})
    near = near[near["query"] != near["word"]]
    if held is not None:
        near = pd.concat([held, near], ignore_index=True)
    near = near.sort_values(["at", "far", "word"], kind="stable")
    return near[near.groupby("at").cumcount() < topn]
