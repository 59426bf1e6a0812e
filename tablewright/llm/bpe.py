"""Byte-pair encoding and decoding with a public vocabulary.

Method: forced-boundary splitting. A byte pair that lies inside no vocabulary
token can never be merged across, so a cut between the two bytes is certain.
Pre-tokens are cut at all such pairs, each fragment is encoded on its own, and
the ids are concatenated. Two more cuts are certain and taken first: around the
vocabulary's added tokens, and before a single space between two characters
that are not white space, where every pre-token of this vocabulary begins.
Fragments repeat, so their ids are kept in a bounded table per task. Short ones
are merged by a compiled encoder if the vocabulary merges by ascending id, which
is checked once on the driver. Ids of a batch are decoded by one Arrow lookup.

Defined cases: NULL text counts as empty and has no ids; the added token's own
string in a text is that token, as in the library; texts of any length are
encoded whole; rows are independent, so repeats, ties and empty tables need no
rule; other columns are passed through or left out as the caller says.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import map_batches

#: Entries of the table of encoded chunks that one task keeps; it is emptied when full.
CACHED_CHUNKS = 400_000
#: Longer fragments are left to the library, whose time does not grow with their square.
MERGED_BYTES = 100
LITTLE = sys.byteorder == "little"
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


@lru_cache
def merges_by_id(path: str) -> bool:
    """Whether merging the pair whose token has the smallest id is what this vocabulary does.

    It is if ids ascend with the merges and every token is encoded as itself: a
    stretch that ends as two tokens has then come the way of its own token.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    ids = described["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in described["model"]["merges"]]
    made = [ids[a + b] for a, b in merges]
    if any(a >= b for a, b in zip(made, made[1:])):
        return False
    tokenize = Tokenizer.from_file(path).model.tokenize
    added = {x["content"] for x in described["added_tokens"]}
    return all([t.id for t in tokenize(token)] == [i] for token, i in ids.items() if token not in added)


class _UncertainCut(Exception):
    """White space next to a space: the quick cuts don't hold for this text."""


class Codec:
    """Encodes and decodes with one vocabulary file; one for each task."""

    def __init__(self, path: str, pattern: str | None = None, by_id: bool = False):
        import regex
        from tokenizers import Tokenizer

        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.tokenize = library.model.tokenize
        self.pre_tokenize = library.pre_tokenizer.pre_tokenize_str
        self.pieces = regex.compile(pattern).findall
        self.letters = dict(enumerate(byte_alphabet()))
        back = {c: b for b, c in self.letters.items()}
        added = {x["content"]: x["id"] for x in described["added_tokens"]}
        self.added = {text: np.array([i], "<u4").tobytes() for text, i in added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, added)) + ")").split if added else None
        ids = described["model"]["vocab"]
        self.token_bytes = [b""] * (1 + max([*ids.values(), *added.values()]))
        self.inside = set()
        for token, i in ids.items():
            if token not in added:
                raw = bytes(back[c] for c in token)
                self.token_bytes[i] = raw
                self.inside.update(zip(raw, raw[1:]))
        for text, i in added.items():
            self.token_bytes[i] = text.encode()
        #: Ids of a fragment: by a compiled merge of bytes where that is proven to be the same.
        self.fragment_ids = self._merged if by_id else self._tokenized
        if by_id:
            import tiktoken

            ranks = {raw: i for i, raw in enumerate(self.token_bytes) if raw and i not in added.values()}
            self.merge = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.tokens = pa.array(self.token_bytes, pa.binary())
        #: Ids of pre-tokens, and of a space followed by a chunk.
        self.known = _Bounded(self.encode_piece, CACHED_CHUNKS // 4)
        self.chunks = _Bounded(self._after_space, CACHED_CHUNKS)

    def fragments(self, piece: bytes) -> list[bytes]:
        """``piece`` cut between all byte pairs that no token holds."""
        inside, cuts = self.inside, [0]
        cuts += [i for i, pair in enumerate(zip(piece, piece[1:]), 1) if pair not in inside]
        return [piece[a:b] for a, b in zip(cuts, [*cuts[1:], len(piece)])]

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token, fragment by fragment."""
        raw = piece.encode()
        if self.inside.issuperset(zip(raw, raw[1:])):  # most pre-tokens have no certain cut
            ids = self.fragment_ids(raw)
        else:
            ids = [i for fragment in self.fragments(raw) for i in self.fragment_ids(fragment)]
        packed = array("I", ids)
        if not LITTLE:
            packed.byteswap()
        return packed.tobytes()

    def _tokenized(self, fragment: bytes) -> list[int]:
        return [token.id for token in self.tokenize(fragment.decode("latin-1").translate(self.letters))]

    def _merged(self, fragment: bytes) -> list[int]:
        return self.merge(fragment) if 0 < len(fragment) <= MERGED_BYTES else self._tokenized(fragment)

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a stretch of text that begins and ends at certain cuts, as little-endian 32-bit numbers."""
        if chunk.isascii() or all(unicodedata.category(c) != "Cn" for c in chunk):
            pieces = self.pieces(chunk)
        else:  # characters newer than some Unicode tables: as the library classes them
            pieces = [chunk[a:b] for _, (a, b) in self.pre_tokenize(chunk)]
        return b"".join(map(self.known.__getitem__, pieces))

    def _after_space(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self.encode_piece(" " + chunk)
        if _loose(chunk):
            raise _UncertainCut
        if chunk[:-1].isalpha() and chunk[-1] in ",.":
            return self.chunks[chunk[:-1]] + self.known[chunk[-1]]
        return self.encode_chunk(" " + chunk)

    def encode_plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *others = text.split(" ")
        try:
            if first[-1:].isspace():
                raise _UncertainCut
            found = list(map(self.chunks.__getitem__, others))
        except _UncertainCut:
            first, *others = re.split(r"(?<=\S) (?=\S)", text)
            found = [self.encode_chunk(" " + x) if _loose(x) else self.chunks[x] for x in others]
        return b"".join([self.encode_chunk(first), *found])

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.split_added is None or not any(x in text for x in self.added):
            return self.encode_plain(text)
        return b"".join(self.added.get(x) or self.encode_plain(x) for x in self.split_added(text))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode_lists(self, lists: pa.ListArray) -> list[str]:
        """The text of each list of ids; none for NULL."""
        flat = lists.flatten()
        taken = self.tokens.take(flat)
        ends = np.frombuffer(taken.buffers()[1], "<i4", len(flat) + 1, taken.offset * 4)
        joined = memoryview(taken.buffers()[2] or b"")
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = ends[np.cumsum([0, *sizes])].tolist()
        return [str(joined[a:b], "utf-8", "replace") for a, b in zip(at, at[1:])]


def _loose(chunk: str) -> bool:
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


class _Bounded(dict):
    """What ``find`` gives for a key, computed on first use; emptied when full."""

    def __init__(self, find, entries: int):
        super().__init__()
        self.find, self.entries = find, entries

    def __missing__(self, key: str) -> bytes:
        found = self.find(key)
        if len(key) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[key] = found
        return found


def encode_texts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs``."""

    by_id = merges_by_id(path)

    def make():
        codec = Codec(path, by_id=by_id)

        def work(batch: pa.RecordBatch):
            found = [codec.encode(text) for text in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype("i4")
            flat = np.frombuffer(b"".join(found), "<u4").astype("i4")
            return {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}

        return work

    kind = docs.select(id_col).dtypes[0][1]
    return map_batches(docs.select(id_col, text_col), make, f"doc_id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the text that ``ids`` stand for; NULL ids give an empty text."""

    def make():
        codec = Codec(path)

        def work(batch: pa.RecordBatch):
            doc_id, ids = batch.columns
            return {"doc_id": doc_id, "ids": ids, "text": codec.decode_lists(ids)}

        return work

    kind = encoded.select("doc_id").dtypes[0][1]
    return map_batches(
        encoded.select("doc_id", "ids"), make, f"doc_id {kind}, ids array<int>, text string"
    )


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and digests of ids and decoded texts, one row per document."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
