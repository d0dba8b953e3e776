"""Alignment of two tokenizers against plain Python: ids by the libraries, overlaps by comparing byte ranges."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.llm import alignment, queries

A_FILE, B_FILE = alignment.default_vocabularies()


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    one, two = Tokenizer.from_file(A_FILE), SentencePieceProcessor(model_file=B_FILE)
    one.encode_special_tokens = True
    assert isinstance(one.decoder, decoders.ByteLevel)
    return one, two


def ends(sizes):
    return np.cumsum(list(sizes)).tolist()


def brute(rows, one, two):
    """Each document's row by comparing all byte ranges near each other, pair by pair."""
    own = alignment.ByteLevel(A_FILE)  # only for the bytes of tokens, which the test on single characters holds against the library
    out, linked = [], collections.Counter()
    for doc_id, text in rows:
        whole = f" {text or ''}"
        a = one.encode(whole, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        a_bytes = [own.bytes[own.starts[i] : own.starts[i] + own.sizes[i]].tobytes() for i in a]
        b_bytes = []
        for i in b:
            p = two.id_to_piece(i)
            b_bytes.append(bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode())
        if not text or b"".join(a_bytes) != whole.encode() or b"".join(b_bytes) != whole.encode():
            out.append((doc_id, 0, 0, 0, 0, [], ""))
            continue
        a_ends, b_ends = ends(map(len, a_bytes)), ends(map(len, b_bytes))
        shared = sorted(set(a_ends) & set(b_ends))
        groups, links, begin, i, j = [], [], 0, 0, 0
        for cut in shared:
            p, q = i, j
            while i < len(a) and a_ends[i] <= cut:
                i += 1
            while j < len(b) and b_ends[j] <= cut:
                j += 1
            groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
            for x in range(p, i):
                for y in range(q, j):
                    if max(a_ends[x] - len(a_bytes[x]), b_ends[y] - len(b_bytes[y])) < min(a_ends[x], b_ends[y]):
                        links.append((a[x], b[y]))
            begin = cut
        assert begin == len(whole.encode())
        linked.update(set(links))
        out.append((doc_id, len(a), len(b), len(groups), len(links), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.defaultdict(int)
    for (x, _), n in linked.items():
        most[x] = max(most[x], n)
    return sorted(
        ((d, na, nb, ng, nl, sum(linked[x] == most[x[0]] for x in links), sum(linked[x] for x in links), sha) for d, na, nb, ng, nl, links, sha in out), key=repr
    )


def texts():
    rng = random.Random(11)
    made = [None, "", " ", "  ", "a", " a ", "a  b   c", "Hello world, it's 12,345!", "\n\n x\t\r\n", "naïve façade Übergröße ñandú", "▁under▁", "ﬁne ＡＢＣ é", "漢字かな交じり文 😀👩‍👩‍👧 é",
            "<s>not</s> <|endoftext|> <unk> <0x0A>", "\x00\x01\x7f\x85\xa0 x　y​", "Ωμέγα и кириллица", "don't we'll I'M they've", "x" * 3000, "the cat " * 400, "﻿bom", "aİbı"]
    alphabet = ["a", "B", "é", "ß", " ", "  ", "\n", "1", "23", "'s", "-", "...", "ing", "tion", "the", "漢", "😀", " ", "▁", "ǅ", "ɐ"]
    for n in (3, 20, 200, 2000):
        made += ["".join(rng.choice(alphabet[: rng.choice((14, 21))]) for _ in range(n)) for _ in range(12)]
    return made


@pytest.mark.parametrize("block_pairs", [alignment.BLOCK_PAIRS, 500])
def test_against_byte_ranges(spark, libraries, block_pairs):
    rows = list(enumerate(texts())) + [(None, "no identifier"), (None, None), (7, "the cat sat"), (7, "the cat sat"), (7, "the cat sat"), (8, "the cat sat")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, block string, n_a int").repartition(3)
    got = sorted(map(tuple, alignment.align(docs, block_pairs=block_pairs).collect()), key=repr)
    want = brute(rows, *libraries)
    assert got == want
    assert sum(r[1] == 0 for r in got) >= 3 and max(r[4] for r in got) > 1000


def test_ids_are_those_of_the_libraries(libraries):
    one, two = libraries
    own = alignment.ByteLevel(A_FILE), alignment.Pieces(B_FILE)
    assert own[0].quick is not None
    for text in filter(None, texts()):
        assert own[0].ids(text).tolist() == one.encode(f" {text}", add_special_tokens=False).ids
        assert own[1].ids(text).tolist() == two.encode(text)
    for c in map(chr, range(1, 0x250)):
        ids = one.encode(c, add_special_tokens=False).ids
        assert own[0].decode(np.array(ids)) == c.encode()


def test_ids_of_documents(spark, libraries):
    one, two = libraries
    own = alignment.ByteLevel(A_FILE), alignment.Pieces(B_FILE)
    found = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    assert [own[1].ids(t).tolist() for t in found] == two.encode(found, num_threads=1)
    assert [own[0].ids(t).tolist() for t in found] == [e.ids for e in one.encode_batch_fast([f" {t}" for t in found], add_special_tokens=False)]


def test_rank_and_select():
    rng = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 1000):
        marks = np.flatnonzero(rng.random(size) < 0.3)
        bits = alignment.Bits.of(marks, size)
        assert bits.select().tolist() == marks.tolist() and len(bits) == len(marks)
        assert bits.rank(np.arange(size)).tolist() == [int((marks < p).sum()) for p in range(size)]


def test_empty_table_and_query(spark, libraries):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nothing = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, nothing)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, *libraries)
    assert got.select(F.sum("n_links")).first()[0] > 0
