"""Token ids in files of fixed-width packed bits."""

from __future__ import annotations

import math
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newswake.llm.common import filled, row_hash, table
from newswake.session import new_folder, written

MAGIC = b"BITPACK1"
BLOCK = 4096  # ids in a block
END = 2
_encoders: dict = {}
PORTION = 16_000_000  # characters that are encoded at once
_UNSAFE = re.compile(r"^ |\s(?: |\Z)")  # a blank at the start or after white space, or white space at the end


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids of ``width`` bits each, the low bit first, filled up to whole bytes."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=ids.dtype)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def file_bytes(docs: list[tuple[int | None, np.ndarray]], width: int) -> Iterator[bytes]:
    """A file: MAGIC and seven numbers, the documents' ids, presence and ends, the blocks' offsets, and the blocks.

    The numbers (little-endian, 64 bits) are width, ids per block, documents,
    token ids, blocks, and two kept at 0. Offsets count bytes from the first block.
    """
    sizes = np.array([len(x) for _, x in docs], np.int64)
    ids = np.concatenate([x for _, x in docs]) if docs else np.empty(0, np.uint32)
    blocks = [pack(ids[a:a + BLOCK], width) for a in range(0, len(ids), BLOCK)]
    yield MAGIC + np.array([width, BLOCK, len(docs), len(ids), len(blocks), 0, 0], "<i8").tobytes()
    yield np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes()
    yield np.array([d is not None for d, _ in docs], "<u1").tobytes()
    yield np.cumsum(sizes).astype("<i8").tobytes()
    yield np.cumsum([0, *map(len, blocks)]).astype("<i8").tobytes()
    yield from blocks


class PackedFile:
    """Reads a file: whole documents or any range of ids, from the blocks that hold them."""

    def __init__(self, data):
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a packed file")
        self.width, self.block, self.n_docs, self.n_ids, self.n_blocks = np.frombuffer(self.data[8:48], "<i8").tolist()
        at = 64
        numbers = np.frombuffer(self.data[at:at + 8 * self.n_docs], "<i8")
        at += 8 * self.n_docs
        present = np.frombuffer(self.data[at:at + self.n_docs], "<u1")
        at += self.n_docs
        self.doc_ids = [int(x) if p else None for x, p in zip(numbers, present, strict=True)]
        self.ends = np.frombuffer(self.data[at:at + 8 * self.n_docs], "<i8")
        at += 8 * self.n_docs
        self.offsets = np.frombuffer(self.data[at:at + 8 * (self.n_blocks + 1)], "<i8")
        self.first = at + 8 * (self.n_blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.empty(0, np.uint32)
        low, high = start // self.block, -(-stop // self.block)
        parts = []
        for b in range(low, high):
            raw = self.data[self.first + int(self.offsets[b]):self.first + int(self.offsets[b + 1])]
            parts.append(unpack(raw, self.width, min(self.block, self.n_ids - b * self.block)))
        return np.concatenate(parts)[start - low * self.block:stop - low * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _encoder(path: str):
    """The tokenizer of a file, and which of its tokens start with a blank."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        opens = np.zeros(max(vocabulary.values()) + 1, bool)
        opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        _encoders[path] = tokenizer, opens
    return _encoders[path]


def _each(tokenizer, texts: list[str]) -> list[np.ndarray]:
    return [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _words(tokenizer, opens: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words with a blank before each, one after the other, and how many each has."""
    some = _each(tokenizer, ["".join([f" {w}" for w in words[at:at + 500]]) for at in range(0, len(words), 500)])
    ids = np.concatenate([np.empty(0, np.uint32), *some])
    starts = np.flatnonzero(opens[ids])
    if len(starts) == len(words):
        return ids, np.diff(starts, append=len(ids))
    apart = _each(tokenizer, [f" {w}" for w in words])
    return np.concatenate(apart), np.array([len(x) for x in apart], np.int64)


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Token ids of each text, by the tokenizers library without special tokens.

    A byte-level BPE always ends a token before a blank that follows no white
    space. So texts are cut at blanks and each different word is encoded once
    for all of ``texts``: the first word of a text without a blank before it,
    the others with one. Texts in which a blank follows white space, or that
    end with white space, are encoded as they are.
    """
    tokenizer, opens = _encoder(path)
    whole = [not text or _UNSAFE.search(text) is not None for text in texts]
    out = iter(_each(tokenizer, [t for t, w in zip(texts, whole, strict=True) if w]))
    cut = iter(_by_words(tokenizer, opens, [t for t, w in zip(texts, whole, strict=True) if not w]))
    return [next(out if w else cut) for w in whole]


def _by_words(tokenizer, opens: np.ndarray, texts: list[str]) -> list[np.ndarray]:
    if not texts:
        return []
    cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    bounds = cut.offsets.to_numpy().astype(np.int64)
    coded = cut.values.dictionary_encode()
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    heads, head = np.unique(code[bounds[:-1]], return_inverse=True)
    ids, sizes = _words(tokenizer, opens, words)
    first = _each(tokenizer, [words[k] for k in heads])
    code[bounds[:-1]] = len(words) + head
    ids, sizes = np.concatenate([ids, *first]), np.concatenate([sizes, [len(x) for x in first]])
    n = sizes[code]
    ends = np.cumsum(n)
    flat = ids[np.repeat((np.cumsum(sizes) - sizes)[code] - (ends - n), n) + np.arange(ends[-1])]
    return np.split(flat, ends[bounds[1:-1] - 1])


def _portions(texts: list[str], size: int = PORTION) -> Iterator[slice]:
    """Slices of about ``size`` characters; a longer text is one of its own."""
    start = held = 0
    for k, text in enumerate(texts):
        if held and held + len(text) > size:
            yield slice(start, k)
            start, held = k, 0
        held += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def write_packed(docs: DataFrame, path: str, folder: str, end: int = END, width: int | None = None) -> DataFrame:
    """Encode ``doc_id``, ``text`` and write files in ascending order of ids; gives (part, file, n_docs, n_ids) per file.

    The rows are range-partitioned by id and each task writes the file of its
    range under a name of its own attempt, so a task that runs again leaves no
    half-written file behind in the result. Null texts are empty; null ids
    come first; rows that repeat an id follow each other by a hash of the row.
    ``width`` is by default the least that holds every id of the vocabulary.
    """
    from tokenizers import Tokenizer

    if width is None:
        width = max(1, math.ceil(math.log2(max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end + 1))))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs

        out: list[tuple[int | None, np.ndarray]] = []
        for batch in batches:
            doc_ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for part in _portions(texts):
                for i, ids in zip(doc_ids[part], encode(texts[part], path), strict=True):
                    out.append((None if pd.isna(i) else int(i), np.append(ids, np.uint32(end)).astype(np.uint16 if width <= 16 else np.uint32)))
        if not out:
            return
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{uuid.uuid4().hex}.bin"
        fs, place = pyarrow.fs.FileSystem.from_uri(name)
        fs.create_dir(os.path.dirname(place), recursive=True)
        with fs.open_output_stream(place) as f:
            for piece in file_bytes(out, width):
                f.write(piece)
        yield pd.DataFrame({"part": [task.partitionId()], "file": [name], "n_docs": [len(out)], "n_ids": [sum(len(x) for _, x in out)]})

    rows = docs.select("doc_id", filled(F.col("text")).alias("text"), row_hash(docs.select("text")).alias("tie"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tie").select(F.col("doc_id").cast("string"), "text")
    return written(ordered.mapInPandas(write, "part int, file string, n_docs bigint, n_ids bigint"), "parts")


def read_packed(parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; ``start`` counts over all files.

    The rows of ``parts`` are one per file; only their sizes are summed in one task.
    """
    n_files = max(1, parts.count())  # given, so that small rows with large files behind them are not put into one task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = parts.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")).repartition(n_files, "file")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs

        for batch in batches:
            for name, start in zip(batch["file"], batch["start"], strict=True):
                fs, place = pyarrow.fs.FileSystem.from_uri(name)
                with fs.open_input_file(place) as f:
                    packed = PackedFile(f.read())
                first, rows = 0, []
                for k, doc in enumerate(packed.doc_ids):
                    ids = packed.document(k)
                    rows.append((doc, start + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    first += len(ids)
                frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield frame.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})

    return files.mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op4_bit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "packed")
    folder = folder if ":" in folder else f"file://{folder}"
    return read_packed(write_packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder))
