import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from runloom.llm import bpe, encoders, packing, token_files
from runloom.llm.common import shared_folder
from runloom.llm.encoders import LibraryEncoder, Memo
from runloom.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoders_give_the_librarys_ids(library, odd_rows):
    more = [" x  \n\ny", "\x00\x1c\x1d\x85 x", "😀😀 é", "\t\t\tfoo  \r\n bar ", " 12ab34", "'ll've don'T", "ünïcödé\xa0\n\nb", "  "]
    for encoder in (LibraryEncoder(TOKENIZER), bpe.ForcedBoundaryEncoder(TOKENIZER)):
        for text in [*(r[1] or "" for r in odd_rows), *more]:
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(library, text)


def test_latin_texts_are_split_as_bytes(library, monkeypatch):
    rnd = random.Random(5)
    parts = [" ", " ", "  ", "\n", "\t", "a", "É", "ü", "ñoß", "Zz", "'s", "'ll", "'", "7", "42", "-", ",.", "…", "×", "÷", "µ", "\x1c", "\x00", "x́", "日"]
    texts = [" ", "é", " é", " é's", "né-é,", "é÷é", "é" * 3_000, *("".join(rnd.choice(parts) for _ in range(30)) for _ in range(600))]
    encoder = LibraryEncoder(TOKENIZER)
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(library, text)
        for chunk in text.split():
            assert encoders.words(chunk.encode()) == [w.encode() for w in encoders.WORD.findall(chunk)]
    monkeypatch.setattr(encoders, "WORD", None)
    text = "Où est l'élève? für Größe: straße's niño 12é, naïve\n\n señor"
    assert np.frombuffer(LibraryEncoder(TOKENIZER).encode(text), "<u4").tolist() == ids_of(library, text)


WIDE = ["\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]


def test_white_space_of_any_kind_is_one_run(library):
    texts = ["x \xa0 \xa0 y", "<p> \xa0 \xa0 \xa0 \xa0 text", "\xa0 \xa0", " \xa0 \xa0 \xa0", "a\xa0 \xa0 b é\xa0 \xa0 \xa0 c d", "x \xa0 \xa0<|endoftext|>\xa0 \xa0 y"]
    rnd = random.Random(3)
    texts += ["".join(rnd.choice([" ", " ", "\xa0", "\n", "x", "é", "'s", "7", *WIDE]) for _ in range(40)) for _ in range(300)]
    texts += ["".join(rnd.choice([" ", "\xa0", " \xa0", "ab"]) for _ in range(60)) for _ in range(300)]
    for encoder in (LibraryEncoder(TOKENIZER), bpe.ForcedBoundaryEncoder(TOKENIZER)):
        for text in texts:
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(library, text)


def test_no_token_holds_a_forced_pair():
    vocabulary = bpe.Vocabulary(TOKENIZER)
    assert not vocabulary.inside[ord("a"), ord(" ")] and vocabulary.inside[ord("t"), ord("h")]
    assert all(vocabulary.inside[a, b] for token in vocabulary.ids for a, b in zip(token, token[1:]))


def test_round_trip(library, odd, none):
    rows = bpe.decode(bpe.encode(odd, TOKENIZER), TOKENIZER).collect()
    assert {"doc_id", "text", "score", "simhash", "ids", "decoded"} <= set(rows[0].asDict())
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids_of(library, r["text"]) and r["decoded"] == (r["text"] or "")
    assert bpe.decode(bpe.encode(none, TOKENIZER), TOKENIZER).count() == 0


def test_bytes_that_are_no_text_decode_as_in_the_library(spark, library):
    ids = [ids_of(library, "é")[0], *ids_of(library, "日")[:1]]
    got = bpe.decode(spark.createDataFrame([(np.array(ids, "<u4").tobytes(),)], ["ids"]), TOKENIZER).first()["decoded"]
    assert got == library.decode(ids, skip_special_tokens=False)


def test_memo_is_bounded():
    memo = Memo(lambda k: k * 2, 10)
    assert [memo[k] for k in range(100)] == [2 * k for k in range(100)] and len(memo) <= 10 and len(memo.before) <= 10


def test_files_hold_all_ids_in_order(spark, library, odd, odd_rows, none):
    path = shared_folder(spark, "test-files")
    token_files.write(odd, path, TOKENIZER, row_index_stride=1000)
    rows = sorted(token_files.with_crc(token_files.read(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in odd_rows), key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    texts = dict(r[:2] for r in odd_rows)
    assert all(r["ids"] == [*ids_of(library, texts[r["doc_id"]]), 2] for r in rows if r["doc_id"] is not None)
    one = token_files.read(spark, path).filter("doc_id = 7")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)" in one._jdf.queryExecution().toString()
    empty = shared_folder(spark, "test-files")
    token_files.write(none, empty, TOKENIZER)
    assert token_files.read(spark, empty).count() == 0


def test_packing_is_whole_and_gapless(library, odd, odd_rows, none):
    rows = packing.pack_documents(odd, TOKENIZER, size=64).collect()
    expected = sorted(len(ids_of(library, r[1])) + 1 for r in odd_rows)
    assert sum(r["length"] for r in rows) == sum(expected) and all(r["length"] == 64 for r in rows if r["piece"])
    long_ids = [*ids_of(library, "word " * 30_000), 2]
    for r in (r for r in rows if r["doc_id"] == 8):
        assert r["ids_crc32"] == zlib.crc32(np.array(long_ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    sequences = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert sequences.setdefault(r["sequence_id"], 0) == r["offset"]
        sequences[r["sequence_id"]] += r["length"]
    assert max(sequences.values()) <= 64 and len(sequences) <= -(-sum(expected) // 64) + 2
    assert packing.pack_documents(none, TOKENIZER).count() == 0


def test_genetic_packing_beats_plain_best_fit_or_equals_it():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(200, 500, 600))[::-1]
    first = packing.best_fit(lengths.tolist(), range(len(lengths)), 1024)
    best = packing.evolve(lengths, [], 1024, rng)[0]
    assert packing.quality(lengths, best, 1024) <= packing.quality(lengths, first, 1024)
    child = packing.crossover(lengths, first, best, 1024, rng)
    assert np.bincount(child, lengths).max() <= 1024 and len(child) == len(lengths)


def test_evolving_reaches_the_bound_where_best_fit_is_far_from_it():
    lengths = np.sort(np.random.default_rng(2).integers(280, 400, 900))[::-1]
    first = packing.best_fit(lengths.tolist(), range(len(lengths)), 1024)
    best = packing.evolve(lengths, [], 1024, np.random.default_rng(1))[0]
    assert packing.least_bins(lengths, 1024) == 300 == best.max() + 1 < first.max() + 1
    assert np.bincount(best, lengths).max() <= 1024 and len(best) == 900


def test_later_epochs_improve_a_packing():
    lengths = np.sort(np.random.default_rng(0).integers(200, 500, 1500))[::-1]
    solutions, bins = [], []
    for epoch in range(packing.EPOCHS):
        solutions = packing.evolve(lengths, solutions, 1024, np.random.default_rng([1, epoch]))
        bins.append(packing.quality(lengths, solutions[0], 1024))
        assert all(np.bincount(s, lengths).max() <= 1024 for s in solutions)
    assert bins == sorted(bins, reverse=True) and bins[-1] < bins[0]
    assert bins[-1][0] < 0.96 * packing.quality(lengths, packing.best_fit(lengths.tolist(), range(1500), 1024), 1024)[0]


def test_the_bound_of_bins_is_never_above_the_best_packing():
    def fewest(rest, bins=()):
        if not rest:
            return len(bins)
        tried = [fewest(rest[1:], (*bins[:b], bins[b] + rest[0], *bins[b + 1 :])) for b in range(len(bins)) if bins[b] + rest[0] <= 16]
        return min([*tried, fewest(rest[1:], (*bins, rest[0]))])

    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = np.sort(rng.integers(1, 16, 6))[::-1]
        best = packing.evolve(lengths, [], 16, rng)[0]
        assert packing.least_bins(lengths, 16) <= fewest(tuple(lengths.tolist())) <= best.max() + 1 <= fewest(tuple(lengths.tolist())) + 1


def test_digest_columns_of_the_query(spark, library):
    from runloom.llm.queries import QUERIES

    rows = QUERIES["op2_bpe"](spark, "/root/testdata/sf0.001").limit(20).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r["ids_sha256"] == hashlib.sha256(np.array(ids_of(library, texts[r["doc_id"]]), "<u4").tobytes()).hexdigest() for r in rows)
