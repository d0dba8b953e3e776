"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Documents are cut into pre-tokens (matches of the public pattern).  A run of documents
   forms a block; a block keeps the positions of its pre-tokens as numbers of its own word
   list, and sends each of its distinct words once to the bucket given by the word's hash.
2. A bucket meets the words of all blocks.  Each distinct word is encoded once, by the merge
   ranks; every block gets back the ids of the words it sent.
   Blocks are named by their contents, so that the two readers of the cut (the words, and the
   positions) may each evaluate it and a lost executor's part can be evaluated again.
3. Blocks are joined with their answers, and the ids of a document are put together by
   position.  Decoding joins these ids with the token-byte table: the table has one entry per
   rank, a size fixed by the vocabulary file, so each task holds it and meets the ids in place.

Whole texts are encoded; nothing is cut.  Edge cases: null and empty texts have no ids and
decode to no bytes; rows that repeat an identifier are encoded each; an empty table gives an
empty result; other columns of the input are ignored.  Memory is bounded by one block, which
closes by the number of its pre-tokens or the memory of its distinct words and is dropped
before the next is filled, plus one document, and by the distinct words of one bucket.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, partitions, send_file, ship

#: Pre-tokens after which a block of documents is closed.
BLOCK_TOKENS = 3_000_000
#: Bytes that the distinct words of a block take, after which it is closed too, and those of a word beside its letters.
BLOCK_BYTES, WORD_BYTES = 64 << 20, 200
#: Buckets of words for each shuffle partition; several, so that partitions come out even.
BUCKETS_PER_PARTITION = 4

# The code points of Unicode's White_Space property, which \s stands for.
WHITE_SPACE = "".join(
    map(chr, (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)


def default_vocabulary() -> str:
    """Path of the public rank file; any file of the same format can take its place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _class(kind: str, below: int) -> str:
    """The characters below ``below`` whose general category starts with ``kind``."""
    return "".join(re.escape(chr(c)) for c in range(below) if unicodedata.category(chr(c))[0] == kind)


@lru_cache(maxsize=1)
def splitter():
    """A function from a text to the list of its pre-tokens.

    Texts whose characters all lie below U+0250 are split by the standard library with
    explicit character classes, which is faster; all others by the general pattern.
    """
    import public_tokenizers

    pattern = public_tokenizers.PATTERN
    general = regex.compile(
        pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE_SPACE}\p{{L}}\p{{N}}]")
        .replace(r"\s", f"[{WHITE_SPACE}]")
        .replace(r"\S", f"[^{WHITE_SPACE}]")
    )
    limit = 0x250
    letters, numbers, space = _class("L", limit), _class("N", limit), "".join(c for c in WHITE_SPACE if ord(c) < limit)
    quick = re.compile(
        pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
        .replace(r"\p{L}", f"[{letters}]")
        .replace(r"\p{N}", f"[{numbers}]")
        .replace(r"\s", f"[{space}]")
        .replace(r"\S", f"[^{space}]")
    )
    beyond = re.compile(f"[^\x00-{chr(limit - 1)}]")

    def split(text: str) -> list[str]:
        return (general if beyond.search(text) else quick).findall(text)

    return split


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: of all neighbours those of the lowest rank are merged first, from the left.

    Candidates stand in a heap, so that a pre-token of any length takes little more than linear time.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        middle = end[i]
        if not i < middle < stop or end[middle] != stop:
            continue  # one of the two parts has been merged meanwhile
        end[i], end[middle] = stop, 0
        left = before[i]
        if left >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heappush(heap, (r, left, stop))
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class TokenBytes:
    """The token-byte table: all tokens in a row, and where the bytes of each id begin and how many they are."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[_runs(self.starts[ids], self.sizes[ids])].tobytes()


@lru_cache(maxsize=4)
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(_ranks(path))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of the given sizes, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _pack_words(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), "<u4", len(raw))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(raw)).tobytes() + sizes.tobytes() + b"".join(raw))


def _unpack_words(blob: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<u4", count, 4), dtype=np.int64) + 4 + 4 * count
    return [data[a:b] for a, b in zip([4 + 4 * count, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Block:
    """A run of documents: their identifiers and sizes, and the places of their words."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.ids: list = []
        self.sizes: list[int] = []
        self.at = array("I")
        self.bytes = 0

    def add(self, key, tokens: list[str]) -> None:
        names, known = self.names, len(self.names)
        self.at.extend([names.setdefault(w, len(names)) for w in tokens])
        self.bytes += sum(WORD_BYTES + sys.getsizeof(w) for w in islice(reversed(names), len(names) - known))
        self.ids.append(key)
        self.sizes.append(len(tokens))

    def close(self, buckets: int) -> tuple[str, np.ndarray, list[str], np.ndarray]:
        """Name, positions, words by number and their buckets; the block itself holds them no longer.

        Common words get small numbers, and words of one count stand by bucket and letters:
        that is how both the positions and the words pack well.
        """
        where = np.frombuffer(self.at, dtype=np.uint32)
        words = list(self.names)
        self.names, self.at = {}, array("I")
        of = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        # a stable sort: the letters decide where counts and buckets are equal
        order = order[np.lexsort((of[order], -np.bincount(where, minlength=len(words))[order]))]
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        positions = rank[where]
        name = xxhash.xxh3_128(repr((self.ids, self.sizes)).encode())
        name.update(positions.tobytes())
        words = [words[i] for i in order]
        name.update("\0".join(words).encode())
        return name.hexdigest(), positions, words, of[order]


def _blocks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[Block]:
    split = splitter()
    block = Block()
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            block.add(key, split(text.as_py() or ""))
            if len(block.at) >= tokens or block.bytes >= BLOCK_BYTES:
                yield block
                block = Block()
                give_back()
    if block.ids:
        yield block
    del block
    give_back()


POSITIONS = "block string, ids array<bigint>, sizes array<int>, positions binary"
SENT = "bucket int, block string, places binary, words binary"


def _positions(buckets: int, tokens: int):
    """Documents to (block, ids, sizes, positions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, tokens):
            name, positions = block.close(buckets)[:2]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name], pa.string()),
                    pa.array([block.ids], pa.list_(pa.int64())),
                    pa.array([block.sizes], pa.list_(pa.int32())),
                    pa.array([_pack(positions)], pa.binary()),
                ],
                names=["block", "ids", "sizes", "positions"],
            )
            del block, positions  # before the next block is filled

    return run


def _spread(buckets: int, tokens: int):
    """Documents to (bucket, block, places, words): each distinct word of a block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, tokens):
            name, words, of = itemgetter(0, 2, 3)(block.close(buckets))
            order = np.argsort(of, kind="stable")
            bounds = np.flatnonzero(np.diff(of[order], prepend=-1))
            parts = np.split(order, bounds[1:]) if len(order) else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(of[order][bounds], pa.int32()),
                    pa.array([name] * len(parts), pa.string()),
                    pa.array([_pack(np.diff(p, prepend=0)) for p in parts], pa.binary()),
                    pa.array([_pack_words([words[i] for i in p]) for p in parts], pa.binary()),
                ],
                names=["bucket", "block", "places", "words"],
            )
            del block, words, of, order, bounds, parts  # before the next block is filled

    return run


def _encode(name: str):
    """Each distinct word of a partition is encoded once; all blocks that sent it share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(SparkFiles.get(name))
        known: dict[bytes, list[int]] = {}
        now = None
        for batch in batches:  # rows come sorted by bucket
            blocks, places, sizes, found = [], [], [], []
            for bucket, block, place, words in zip(*(batch.column(i) for i in range(4)), strict=True):
                if bucket.as_py() != now:
                    known, now = {}, bucket.as_py()
                each = []
                for w in _unpack_words(words.as_py()):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = merged(w, ranks)
                    each.append(ids)
                blocks.append(block.as_py())
                places.append(place.as_py())
                sizes.append(_pack(np.fromiter(map(len, each), np.uint32, len(each))))
                found.append(_pack(np.fromiter((i for ids in each for i in ids), np.uint32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.string()), pa.array(places, pa.binary()), pa.array(sizes, pa.binary()), pa.array(found, pa.binary())],
                names=["block", "places", "sizes", "found"],
            )

    return run


def _assemble(name: str, with_ids: bool):
    """Blocks with their answers to one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(SparkFiles.get(name))
        text_of = [str(i) for i in range(len(table.sizes))]
        for batch in batches:
            for ids, sizes, positions, answers in zip(*(batch.column(i) for i in range(4)), strict=True):
                parts = [(np.cumsum(_unpack(a["places"])), _unpack(a["sizes"]), _unpack(a["found"])) for a in answers.as_py() or ()]
                place, count, flat = (np.concatenate([p[k] for p in parts] or [np.empty(0, np.uint32)]).astype(np.int64) for k in range(3))
                order = np.argsort(place)
                if not np.array_equal(place[order], np.arange(len(place))):
                    raise ValueError("a block has not got all of its answers")
                begin = (np.cumsum(count) - count)[order]
                count = count[order]
                shown = np.array(text_of, object)[flat].tolist()
                shown = [" ".join(shown[i:j]) for i, j in zip(begin.tolist(), (begin + count).tolist(), strict=True)]
                where, start = _unpack(positions.as_py()), 0
                out: dict[str, list] = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "token_ids": []}
                for key, size in zip(ids.as_py(), sizes.as_py(), strict=True):
                    at = where[start : start + size]
                    start += size
                    own = flat[_runs(begin[at], count[at])]
                    out["doc_id"].append(key)
                    out["n_tokens"].append(len(own))
                    out["ids_sha256"].append(hashlib.sha256(" ".join([shown[i] for i in at.tolist()]).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(table.decode(own)).hexdigest())
                    if with_ids:
                        out["token_ids"].append(own.astype(np.int32))
                columns = [pa.array(out["doc_id"], pa.int64()), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
                if with_ids:
                    columns.append(pa.array(out["token_ids"], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=list(out)[: len(columns)])
                del out, columns, parts, place, flat, shown
        give_back()

    return run


def encode_decode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, token_ids.

    ``block_tokens``: pre-tokens of a block; fewer take less memory in a task and send more words.
    """
    spark = docs.sparkSession
    ship(spark)
    path = send_file(spark, vocabulary or default_vocabulary())
    pairs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = BUCKETS_PER_PARTITION * partitions(spark)
    answers = (
        pairs.mapInArrow(_spread(buckets, block_tokens), SENT)
        .repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_encode(path), "block string, places binary, sizes binary, found binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("places", "sizes", "found")).alias("answers"))
    )
    cut = pairs.mapInArrow(_positions(buckets, block_tokens), POSITIONS)
    joined = cut.join(answers.hint("merge"), "block", "left").select("ids", "sizes", "positions", "answers")
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return joined.mapInArrow(_assemble(path, with_ids), schema)


if sys.byteorder != "little":  # packed numbers are little-endian views
    raise ImportError("a little-endian machine is needed")
