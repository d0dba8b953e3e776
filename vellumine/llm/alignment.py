"""Alignment of the tokens of two tokenizers over the bytes of a text.

Both tokenizers cut the bytes of a space and the text.  The ends of tokens are marked in two
packed bitsets, one bit for each byte.  Their AND marks the cuts that both have: between these
stand the groups.  Counts of bits by word (rank) and their inverse (select) map a cut to the
tokens that end before it.  Their OR marks the ends of the links: between two neighbouring marks
lies one pair of tokens whose byte ranges overlap, and every such pair has just one such place.

The count of a pair of ids is how many documents hold it linked:

1. A run of documents forms a block.  Its documents' linked pairs are counted in the task, so a
   block sends each pair once, with the number of its documents.  What the block itself knows
   (identifiers, sizes, digests, which pairs each document links and how often) is written once, to
   the shared folder; all later steps read it from there, so a block keeps its random name.
2. Pairs are summed over blocks.  The highest count of each id of the first tokenizer is a table
   bounded by its vocabulary, which is broadcast.
3. Blocks get back the count of each pair they sent, and sum up for their documents.

A block's size bounds what a task holds besides one document; a hot pair has one row per block.

Ids are those of the files' own libraries.  Where the merges of the first file stand in the order of
its ids, as rank files have it, texts of characters below U+0250 (where the classes of the pattern
are fixed) go through a quicker reader of rank files that is made from it.

Edge cases: null and empty texts, and texts of which either tokenizer gives other bytes back than
those of space and text (normalised, unknown or lone characters), have no tokens: all numbers are 0
and the groups are empty; they add to no count.  Repeated rows are documents each and count each;
null identifiers are kept; whole texts are read; an empty table gives an empty result; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _runs
from .common import give_back, materialise, send_file, shared_root, ship

#: Linked pairs of documents after which a block is closed.
BLOCK_PAIRS = 1_000_000
#: Bits by which the id of the first tokenizer is shifted in the number of a pair.
SHIFT = 32
#: Bits of a word of a bitset.
WORD = 64

BEYOND = re.compile("[ɐ-\U0010ffff]")
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def default_vocabularies() -> tuple[str, str]:
    """Paths of the public files of the two tokenizers; any files of the same formats can take their place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokens:
    """The bytes of a tokenizer's tokens."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens) or b"\0", np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[_runs(self.starts[ids], self.sizes[ids])].tobytes()


class ByteLevel(Tokens):
    """A byte-level BPE tokenizer of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        vocabulary = self.own.get_vocab(with_added_tokens=True)
        # the printable characters that stand for bytes: themselves, or from U+0100 on for the others
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        super().__init__(tokens)
        self.quick = self._rank_reader(json.loads(self.own.to_str()), tokens)

    @staticmethod
    def _rank_reader(file: dict, tokens: list[bytes]):
        """A reader of rank files with the tokens in place of ranks; None where they aren't ranks or texts are changed or cut otherwise."""
        import public_tokenizers
        from tiktoken import Encoding

        model, cut = file["model"], file["pre_tokenizer"] or {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ordered = all(model["vocab"].get("".join(pair)) == 256 + k for k, pair in enumerate(pairs))
        plain = file["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not model.get("ignore_merges")
        if not (ordered and plain):
            return None
        return Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens[: 256 + len(pairs)])}, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> np.ndarray:
        text = f" {text}"
        if self.quick is None or BEYOND.search(text):
            return np.array(self.own.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        return np.array(self.quick(text), np.int64)


class Pieces(Tokens):
    """A sentencepiece tokenizer that adds a space before the text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        super().__init__([bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) and self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text), np.int64)


@lru_cache(maxsize=2)
def tokenizers(one: str, two: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(one), Pieces(two)


class Bits:
    """A packed bitset with rank and select."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @staticmethod
    def of(places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-size // WORD) * WORD, bool)
        marks[places] = True
        return Bits(np.packbits(marks, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def __len__(self) -> int:
        return int(self.before[-1])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many marks stand before each place."""
        word, bit = np.divmod(places, WORD)
        below = self.words[word] & ((np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def select(self) -> np.ndarray:
        """The places of all marks, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Aligned:
    """The alignment of two rows of token sizes over the same bytes."""

    def __init__(self, one: np.ndarray, two: np.ndarray) -> None:
        size = int(one.sum())
        a, b = (Bits.of(np.cumsum(x) - 1, size) for x in (one, two))
        cuts = (a & b).select()
        #: for each group, how many tokens of either side end with it or before
        self.a_until, self.b_until = a.rank(cuts) + 1, b.rank(cuts) + 1
        ends = (a | b).select()
        #: for each link, the numbers of its two tokens
        self.a_of, self.b_of = a.rank(ends), b.rank(ends)

    def written(self, a: np.ndarray, b: np.ndarray, a_shown: np.ndarray, b_shown: np.ndarray) -> str:
        """The groups as text; ``*_shown`` hold each id with a comma, and from the middle on with what ends its side."""
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[self.a_until - 1] = 1
        b_last[self.b_until - 1] = 1
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.concatenate(([0], self.b_until))[a_group]] = a_shown[a + a_last * (len(a_shown) // 2)]
        out[np.arange(len(b)) + self.a_until[b_group]] = b_shown[b + b_last * (len(b_shown) // 2)]
        return "".join(out.tolist())[:-1]


def aligned(text: str | None, one: ByteLevel, two: Pieces) -> tuple[np.ndarray, np.ndarray, Aligned] | None:
    """The ids of both tokenizers with their alignment; None where a text has no tokens."""
    if not text:
        return None
    try:
        whole = f" {text}".encode()
    except UnicodeEncodeError:
        return None
    a, b = one.ids(text), two.ids(text)
    if one.decode(a) != whole or two.decode(b) != whole:
        return None
    return a, b, Aligned(one.sizes[a], two.sizes[b])


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u4").tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u4")


ROW = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
BLOCK = f"block string, rows array<struct<{ROW}>>, sizes binary, places binary, times binary, pairs array<bigint>, docs array<int>"
_ROW = pa.struct([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])


class Block:
    """A run of documents: a row for each, and its linked pairs with how often it links them."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, row: dict, pairs: np.ndarray, times: np.ndarray) -> None:
        self.rows.append(row)
        self.pairs.append(pairs)
        self.times.append(times)
        self.size += len(pairs)

    def batch(self) -> pa.RecordBatch:
        every = np.concatenate([*self.pairs, np.empty(0, np.int64)])
        pairs, places, docs = np.unique(every, return_inverse=True, return_counts=True)
        sizes, times = np.array([len(p) for p in self.pairs]), np.concatenate([*self.times, np.empty(0, np.int64)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().hex], pa.string()), pa.array([self.rows], pa.list_(_ROW)), *(pa.array([_pack(x)], pa.binary()) for x in (sizes, places, times)),
                pa.array([pairs], pa.list_(pa.int64())), pa.array([docs.astype(np.int32)], pa.list_(pa.int32())),
            ],
            names=["block", "rows", "sizes", "places", "times", "pairs", "docs"],
        )


def _blocks(files: tuple[str, str], size: int):
    """Documents to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tokenizers(*map(SparkFiles.get, files))
        a_shown = np.array([f"{i}{end}" for end in ",|" for i in range(len(one.sizes))], object)
        b_shown = np.array([f"{i}{end}" for end in ",;" for i in range(len(two.sizes))], object)
        block = Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = aligned(text.as_py(), one, two)
                if found is None:
                    block.add({"doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""}, np.empty(0, np.int64), np.empty(0, np.int64))
                    continue
                a, b, own = found
                groups = hashlib.sha256(own.written(a, b, a_shown, b_shown).encode()).hexdigest()
                row = {"doc_id": doc_id, "n_a": len(a), "n_b": len(b), "n_groups": len(own.a_until), "n_links": len(own.a_of), "groups_sha256": groups}
                block.add(row, *np.unique((a[own.a_of] << SHIFT) | b[own.b_of], return_counts=True))
                if block.size >= size:
                    yield block.batch()
                    block = Block()
        if block.rows:
            yield block.batch()
        del block
        give_back()

    return run


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts of their pairs to one row per document."""
    for batch in batches:
        for rows, *blobs, answers in zip(*(batch.column(i) for i in range(5)), strict=True):
            sizes, places, times = (_unpack(x.as_py()).astype(np.int64) for x in blobs)
            counts, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if answers.is_valid:
                place, count, top = (np.asarray(answers.values.field(k)).astype(np.int64) for k in range(3))
                counts, best = np.full(len(place), -1, np.int64), np.zeros(len(place), np.int64)
                counts[place], best[place] = count, top
            if len(places) and (int(places.max()) >= len(counts) or counts.min() < 0):
                raise ValueError("a block has not got all of its counts")
            ends = np.concatenate(([0], np.cumsum(sizes)))
            sums = [np.concatenate(([0], np.cumsum(times * x[places])))[ends] for x in (best, counts)]
            flat = rows.values
            columns = {f.name: flat.field(i) for i, f in enumerate(_ROW)} | {n: pa.array(np.diff(s), pa.int64()) for n, s in zip(("n_best", "count_sum"), sums, strict=True)}
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)
    give_back()


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Every linked pair of ids with the number of its documents and whether no pair with its first id has more."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("count"))
    a = F.shiftright("pair", SHIFT)
    most = pairs.groupBy(a.alias("a")).agg(F.max("count").alias("most"))  # as many rows as the first vocabulary has ids, at most
    return pairs.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] | None = None, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per document: sizes, groups, links, links of the highest count, sum of counts, digest of the groups."""
    spark = docs.sparkSession
    ship(spark)
    files = tuple(send_file(spark, path) for path in vocabularies or default_vocabularies())
    root = shared_root(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialise(rows.mapInArrow(_blocks(files, block_pairs), BLOCK), f"{root}/blocks")
    counts = materialise(pair_counts(blocks), f"{root}/counts")
    sent = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = sent.join(counts.hint("merge"), "pair").groupBy("block").agg(F.collect_list(F.struct("place", "count", F.col("best").cast("int").alias("best"))).alias("answers"))
    whole = blocks.select("block", "rows", "sizes", "places", "times")
    return whole.join(answers.hint("merge"), "block", "left").select("rows", "sizes", "places", "times", "answers").mapInArrow(_summed, RESULT)
