"""Secret scan: fixed patterns, and Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswake.llm.common import filled, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # a run has its match at its first AKIA or nowhere, so this is the 20 characters rule
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = "[A-Za-z0-9+/_=-]{8,}"
KINDS = ["assign", "access", "hex", "random"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

MAX_WORD = 12  # letters of a word that identifiers are composed of
MAX_TRAINING = 2_000  # documents that the ordinary identifiers are taken from
UNIFORM = 0.05  # share of a uniform choice in each model
MIN_RATIO = 12.0  # log-likelihood ratio in nats of a whole string
MIN_MEAN = 0.75  # and per transition: camel case of words that no text holds reaches 0.7
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def located(text: Column, pattern: str, matches: Column, keep: Column, kind: str) -> Column:
    """The spans of the matches of a pattern; ``keep`` says which of them count.

    The places come from the lengths of the matches and of the parts between them, in one pass over the text.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(state: Column, x: Column) -> Column:
        place = state["at"] + F.length(x["gap"])
        end = place + F.length(x["m"])
        span = F.struct(place.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        return F.struct(
            end.alias("at"), F.when(x["k"], F.array_append(state["found"], span)).otherwise(state["found"]).alias("found"))

    parts = F.arrays_zip(
        matches.alias("m"), keep.alias("k"), F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("gap"))
    return F.aggregate(parts, start, step, lambda s: s["found"])


def base_spans(text: Column) -> list[Column]:
    """Spans of the three fixed kinds."""
    whole, values = _matches(text, ASSIGN), _matches(text, ASSIGN, 2)
    spans = [located(text, ASSIGN, whole, F.transform(values, lambda v: F.length(v) >= 6), "assign")]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        found = _matches(text, pattern)
        spans.append(located(text, pattern, found, F.transform(found, lambda x: F.lit(True)), kind))
    return spans


def composed(names: Column) -> Column:
    """Identifiers as code writes them, each of three neighbouring words: camel and Pascal case, snake case, constants, paths, kebab case."""
    def one(i: Column) -> Column:
        a, b, c = (F.lower(F.get(names, 3 * i + k)) for k in range(3))
        tall = [F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, MAX_WORD)) for x in (a, b, c)]
        styles = [
            F.concat(a, *tall[1:]), F.concat(*tall), F.concat_ws("_", a, b, c), F.upper(F.concat_ws("_", a, b, c)),
            F.concat_ws("/", a, b, c), F.concat_ws("-", a, b, c), F.concat_ws("/", a, F.concat(b, tall[2]))]
        at = F.pmod(i, F.lit(len(styles)))
        return F.coalesce(*[F.when(at == k, x) for k, x in enumerate(styles)])  # only the one that is asked for is built

    groups = F.floor(F.size(names) / 3).cast("int")
    return F.when(groups > 0, F.transform(F.sequence(F.lit(0), groups - 1), one)).otherwise(F.array().cast("array<string>"))


def labelled_strings(docs: DataFrame, max_docs: int = MAX_TRAINING) -> DataFrame:
    """(random, string): a labelled sample from the ``max_docs`` documents with the smallest hash of their id.

    Random are the values of the fixed patterns in them, and strings made up
    from digests of each id: base64 in both alphabets, hex in both cases, and
    small letters with digits. Ordinary are their other identifiers, their
    words composed as code composes them, numbers and times.
    """
    chosen = docs.filter("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).distinct()
    texts = docs.select("doc_id", filled(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")
    clean = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        clean = F.regexp_replace(clean, pattern, " ")
    id_ = F.col("doc_id").cast("string")
    digest, other = F.sha2(id_, 256), F.sha2(F.concat(F.lit("b"), id_), 256)
    dense = [F.rtrim(F.base64(F.unhex(F.sha2(F.concat(F.lit(x), id_), 512))), F.lit("=")) for x in "cdefgh"]
    web = F.translate(F.rtrim(F.base64(F.unhex(other)), F.lit("=")), "+/", "-_")
    secrets = F.concat(
        F.filter(_matches(F.col("text"), ASSIGN, 2), lambda x: F.length(x) >= 6),
        *[_matches(F.col("text"), p) for p in (ACCESS, HEX)],
        F.array(*dense, web, *[F.translate(x, "+/", "-_") for x in dense[:2]], *[F.lower(F.translate(x, "+/", "")) for x in dense[3:]],
                F.upper(F.substring(digest, 1, 32)), F.upper(F.sha1(id_)), F.sha1(id_)),
    )
    numbers = F.array(F.substring(F.translate(digest, "abcdef", ""), 1, 16), F.substring(F.translate(other, "abcdef", ""), 1, 24))
    stamp = F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64("doc_id"), F.lit(4_000_000_000))), "yyyy-MM-dd'T'HH-mm-ss")
    ordinary = F.concat(_matches(F.col("clean"), IDENTIFIER), composed(F.col("names")), numbers, F.array(stamp))
    # Each step is a column, so that no step is computed again for every element of the next.
    texts = texts.withColumn("clean", clean).withColumn("names", _matches(F.col("clean"), f"[A-Za-z]{{2,{MAX_WORD}}}"))
    labelled = F.array(
        F.struct(F.lit(True).alias("random"), secrets.alias("strings")),
        F.struct(F.lit(False).alias("random"), ordinary.alias("strings")))
    return texts.select(F.explode(labelled).alias("x")).select("x.random", F.explode("x.strings").alias("string"))


def train(strings: DataFrame) -> list[float]:
    """The log-likelihood ratio of every transition of ALPHABET: first-order Markov models, mixed with UNIFORM parts of
    a uniform choice. A share, and not a count, so the ratios mean the same for samples of all sizes."""
    chars = F.split("string", "")
    next_ = F.slice(chars, 2, F.length("string") - 1)
    pairs = strings.filter(F.length("string") > 1).select("random", F.explode(F.zip_with(
        F.slice(chars, 1, F.length("string") - 1), next_, lambda a, b: F.concat(a, b))).alias("pair"))
    counts = {(r.random, r.pair): r.n for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    even = 1 / len(ALPHABET)
    ratios = []
    for a in ALPHABET:
        sizes = {r: sum(counts.get((r, a + b), 0) for b in ALPHABET) for r in (True, False)}
        for b in ALPHABET:
            p, q = (
                (1 - UNIFORM) * counts.get((r, a + b), 0) / sizes[r] + UNIFORM * even if sizes[r] else even for r in (True, False))
            ratios.append(math.log(p / q))
    return ratios


def ratio(string: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a string of ALPHABET."""
    model = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # one literal, folded once
    n = len(ALPHABET)
    places = F.transform(F.split(string, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(state: Column, c: Column) -> Column:
        more = F.when(state["last"] < 0, 0.0).otherwise(F.element_at(model, state["last"] * n + c + 1))
        return F.struct(c.alias("last"), (state["sum"] + more).alias("sum"))

    return F.aggregate(places, start, step, lambda s: s["sum"])


def scan(docs: DataFrame, ratios: list[float], min_ratio: float = MIN_RATIO, min_mean: float = MIN_MEAN) -> DataFrame:
    """(doc_id, spans) of every row: the spans of the fixed kinds and of the strings that the models call random.

    A string is a run of at least 16 characters of identifiers. It is random
    if its log-likelihood ratio reaches ``min_ratio``, and ``min_mean`` per
    transition, and it meets no span of a fixed kind. Spans are in code points,
    end exclusive, sorted by start and kind.

    Null texts are empty and have no spans. Rows are independent: repeated rows and null
    ids have results like others; other columns are not read.
    """
    text = F.col("text")
    rows = docs.select("doc_id", filled(text).alias("text")).withColumn("base", F.concat(*base_spans(text)))
    strings = _matches(text, TOKEN)

    def random(x: Column) -> Column:
        score = ratio(x, ratios)
        return (score >= min_ratio) & (score >= min_mean * (F.length(x) - 1))

    found = located(text, TOKEN, strings, F.transform(strings, random), "random")
    rows = rows.select("doc_id", "base", found.alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return rows.select("doc_id", F.sort_array(F.concat("base", apart)).alias("spans"))


def written_out(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_markov_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = scan(docs, train(labelled_strings(docs)))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return rows.select("doc_id", *map(count, KINDS), F.sha2(written_out(base), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))
