import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from newswake.llm.packing import PackedFile, _portions, encode, file_bytes, pack, read_packed, unpack, write_packed

from .conftest import SF_DIR

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", "a   b c", "x\n y", "x \ny", "tab\t z", " lead", "trail ", "é  ü", "don't 12 <|endoftext|> x", "a  b"]


def expected(rows):
    encoder, start = Tokenizer.from_file(PATH), 0
    for i, text in rows:
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        yield i, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


def test_query_against_the_library(spark, documents):
    got = entry.queries()["op4_bit_packing"](spark, SF_DIR).toPandas().sort_values("doc_id")
    rows = sorted(zip(documents.doc_id, documents.text, strict=True))
    assert list(got.itertuples(index=False, name=None)) == list(expected(rows))


def test_pieces_encode_like_whole_texts():
    encoder = Tokenizer.from_file(PATH)
    for text in [*ODD, " ".join(ODD), "\n".join(ODD)]:
        assert encode([text], PATH)[0].tolist() == encoder.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("width", [1, 5, 8, 15, 16, 17, 32])
def test_round_trip_and_random_access(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, 10_000, dtype=np.uint32)
    assert (unpack(pack(ids, width), width, len(ids)) == ids).all()
    cuts = [0, 0, 3, 4096, 8192, 9000, 10_000]
    docs = [(None if k == 0 else k, ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    packed = PackedFile(b"".join(file_bytes(docs, width)))
    assert packed.doc_ids == [d for d, _ in docs]
    for k, (_, own) in enumerate(docs):
        assert (packed.document(k) == own).all()
    for a, b in rng.integers(0, 10_000, (50, 2)):
        assert (packed.ids(min(a, b), max(a, b)) == ids[min(a, b):max(a, b)]).all()
    assert len(b"".join(file_bytes(docs, width))) < 10_000 * width / 8 + 400


def test_edges(spark, docs, tmp_path):
    rows = [(5, None), (3, "x y " * 60_000), (4, ""), (4, ""), (1, ODD[3]), (None, "n")]
    got = read_packed(write_packed(docs(*rows), PATH, f"file://{tmp_path}/a")).collect()
    want = list(expected(sorted(rows, key=lambda r: -1 if r[0] is None else r[0])))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert read_packed(write_packed(docs(), PATH, f"file://{tmp_path}/b")).count() == 0


def test_words_of_a_portion_are_shared():
    encoder = Tokenizer.from_file(PATH)
    texts = ["", "same same same", "same", "a\x85 b", "a  b", "\nhead tail", "tail\nhead x", "end\n", "Ġa Ġb", "日本 語 😀 x\x00y z", *ODD, "w " * 3 + "w"]
    assert [x.tolist() for x in encode(texts, PATH)] == [encoder.encode(x, add_special_tokens=False).ids for x in texts]
    assert encode([], PATH) == []


def test_portions_cover_all_texts():
    texts = ["a" * 5, "", "b" * 30, "c" * 4, "d" * 6, ""]
    parts = list(_portions(texts, 10))
    assert [x for s in parts for x in texts[s]] == texts
    assert all(len(texts[s]) == 1 or sum(map(len, texts[s])) <= 10 for s in parts)
    assert list(_portions([])) == []
