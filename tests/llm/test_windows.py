import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from runloom.llm import windows
from runloom.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, lengths, size, crcs=None):
    """Whole, gapless, and full but for powers of two."""
    sequences = defaultdict(list)
    for r in rows:
        assert r["length"] > 0
        sequences[r["sequence_id"]].append(r)
    short = 0
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == size or at & (at - 1) == 0
        short += at != size
    assert sum(r["length"] for r in rows) == sum(lengths) and short <= size.bit_length()


def test_words_get_the_librarys_ids(library, odd_rows):
    encoder, rnd = windows.WordEncoder(PATH), random.Random(4)
    alphabet = [" ", "\n", "\xa0", " ", "e", "́", "É", "İ", "Σ", "ς", "'s", "7", "½", "ﬁ", "日本", "😀", "<|endoftext|>", "a", "B", "\x1c", "\x85", "-", "?!"]
    texts = [*(r[1] or "" for r in odd_rows), *("".join(rnd.choices(alphabet, k=30)) for _ in range(1500))]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(library, text)[:-1]


@pytest.mark.parametrize("size, keep", [(16, 1), (64, 2), (64, 5), (100, 3)])
def test_whole_and_gapless(spark, library, odd, odd_rows, size, keep):
    rows = windows.pack_windows(odd, PATH, size=size, keep=keep).collect()
    check(rows, [len(ids_of(library, r[1])) for r in odd_rows], size)
    texts = {r[0]: r[1] for r in odd_rows if r[0] is not None}
    pieces = defaultdict(list)
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] != 9:
            pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts) - {9}
    for doc_id, held in pieces.items():
        ids, at = ids_of(library, texts[doc_id]), 0
        for r in sorted(held, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)


def test_no_rows(none):
    assert windows.pack_windows(none, PATH).count() == 0


def test_never_more_windows_than_allowed_and_best_fit():
    packer, rnd = windows.Packer(100, 4), random.Random(1)
    for k in range(2000):
        packer.document(k, b"\0\0\0\0" * rnd.randrange(1, 250))
        assert len(packer.windows) == len(packer.free) <= 4
        assert all(sum(len(p[2]) // 4 for p in packer.windows[name]) == 100 - free for free, name in packer.free)
    packer = windows.Packer(100, 3)
    for k, n in enumerate((60, 50, 70, 45)):
        packer.document(k, b"\0\0\0\0" * n)
    assert sorted(f for f, _ in packer.free) == [5, 30, 40]  # 45 went to the tightest it fits, with 50 free
    packer.document(9, b"\0\0\0\0" * 41)
    assert sorted(f for f, _ in packer.free) == [4, 30] and packer.emitted == 1  # the fullest took 5 of it and went, 36 fit where 40 were free
    packer.finish()
    assert sum(r[5] is None for r in packer.rows) and not packer.windows


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op12_windows"](spark, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = {k: ids_of(library, t) for k, t in texts.items()}
    check(rows, map(len, ids.values()), 4096)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert {r["doc_id"] for r in rows} == set(texts)
