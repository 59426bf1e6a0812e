import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import bpe, packing
from tests.llm.brute import sha

ALPHABET = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "a", "b", "Zz", "'s", "'", "1", "²", "é", "ß", "中", "😀",
            "<|endoftext|>", "!", "##", "\U0003fc3f", "　", "\x00", "qzjx", "́", "the", "tion"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.mark.parametrize("kind", [bpe.Codec, packing.PlainCodec])
def test_codec_equals_the_library(library, kind):
    rng = random.Random(5)
    codec = kind(bpe.vocabulary_path())
    for _ in range(3000):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 14)))
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == expected, repr(text)
        assert codec.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_cuts_lie_inside_no_token():
    codec = bpe.Codec(bpe.vocabulary_path())
    word = "qzjxxvkqthethe".encode()
    parts = codec.fragments(word)
    assert b"".join(parts) == word and len(parts) > 1
    for left, right in zip(parts, parts[1:]):
        assert not any(left[-1:] + right[:1] in token for token in codec.token_bytes[:50256])


def test_encoded_table(documents, corpus, library):
    path = bpe.vocabulary_path()
    found = {r.doc_id: r for r in bpe.digests(bpe.decode_ids(bpe.encode_texts(documents, path), path)).collect()}
    assert len(found) == len(corpus)
    for doc_id, text in corpus:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[doc_id].n_tokens == len(ids)
        assert found[doc_id].ids_sha256 == sha(",".join(map(str, ids)))
        assert found[doc_id].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_packed_pieces(documents, corpus, library):
    size = 256
    rows = packing.pack_documents(documents, bpe.vocabulary_path(), size).collect()
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == {d for d, _ in corpus}
    total = 0
    for doc_id, text in corpus:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // size)))
        assert all(r.length == size for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert len(sequences) <= -(-total // size) + 2


def test_sequences_hold_the_tokens(documents, corpus, library):
    small = documents.where("n_chars < 400")
    placed = packing.pack_documents(small, bpe.vocabulary_path(), 128)
    placed = placed.sparkSession.createDataFrame(placed.collect(), placed.schema)
    whole = {r.sequence_id: r.ids for r in packing.sequences(small, placed, bpe.vocabulary_path()).collect()}
    for r in placed.collect():
        ids = np.array(whole[r.sequence_id][r.offset : r.offset + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_plans_fit_and_place_every_piece():
    rng = random.Random(2)
    for _ in range(25):
        size = rng.choice([10, 100, 2048])
        histogram = {}
        for _ in range(rng.choice([1, 5, 60, 900])):
            n = rng.randint(1, size)
            histogram[n] = histogram.get(n, 0) + rng.choice([1, 1, 3, 1000])
        plan = packing.plan_sequences(dict(histogram), size)
        got = {}
        for count, lengths in plan.runs:
            assert count > 0 and sum(lengths) <= size
            for n in lengths:
                got[n] = got.get(n, 0) + count
        assert got == histogram
        best = sum(c for c, _ in packing._best_fit([], dict(histogram), size))
        assert plan.sequences <= 1.02 * best + 1


def test_empty_tables(no_documents):
    path = bpe.vocabulary_path()
    assert bpe.decode_ids(bpe.encode_texts(no_documents, path), path).count() == 0
    assert packing.pack_documents(no_documents, path).count() == 0


def test_repeated_rows_and_nulls(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "a b")], "doc_id long, text string")
    found = packing.pack_documents(rows, bpe.vocabulary_path())
    assert found.agg(F.count("*"), F.countDistinct("sequence_id"), F.sum("length")).first() == (3, 1, 5)


def test_compiled_merges_and_batch_decoding_equal_the_library():
    import random

    import pyarrow as pa

    path = bpe.vocabulary_path()
    assert bpe.merges_by_id(path)
    plain, quick = bpe.Codec(path), bpe.Codec(path, by_id=True)
    rng = random.Random(11)
    tokens = [t.decode("utf-8", "ignore") for t in plain.token_bytes]
    pieces = ["".join(rng.choice(tokens) for _ in range(rng.randrange(1, 5))) for _ in range(5000)]
    pieces += ["", "a" * 5000, "́e" * 60, "\U0001f600" * 40, *tokens[::50]]
    assert [quick.encode_piece(p) for p in pieces] == [plain.encode_piece(p) for p in pieces]
    lists = pa.array([[rng.randrange(50000) for _ in range(rng.randrange(6))] if i % 7 else None for i in range(500)], pa.list_(pa.int32()))
    expected = [plain.decode(x or []) for x in lists.to_pylist()]
    assert quick.decode_lists(lists) == expected
    assert quick.decode_lists(lists.slice(21, 100)) == expected[21:121]
    assert quick.decode_lists(lists.slice(0, 0)) == []
