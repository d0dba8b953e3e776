"""The training-data operators on small fixtures: edge cases and brute force."""

import base64
import collections
import hashlib
import pathlib
import random
import re
import time
import tracemalloc
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from vellumine.llm import bpe, chat, components, exact_dedup, fingerprints, html_extract, langid, mixing, near_dedup, pii, queries, warc
from vellumine.llm.common import shared_root

LONG = "lorem ipsum dolor sit amet " * 6000
DOCS = [(1, "same text"), (2, "same text"), (3, None), (4, ""), (5, "Same  Text"), (5, "Same  Text"), (None, "no identifier"), (7, LONG), (8, "ﬁne ＡＢＣ"), (9, "fine abc"), (10, "tab\tand\nline")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", "x") for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, digest string, keep string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(DOCS) and {"digest", "keep", "lang"} <= set(got[0].asDict())
    groups = collections.defaultdict(list)
    for i, t in DOCS:
        groups[t or ""].append(i)
    for r in got:
        own = groups[r.text or ""]
        assert r.group_size == len(own) and r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.keep_id == max((x for x in own if x is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_goes_on_from_its_state(spark):
    home = shared_root(spark)
    part = lambda rows: spark.createDataFrame(rows, "digest binary, id long, locator string").write.mode("append").parquet(f"{home}/in")
    part([(b"a", 1, "f"), (b"b", 2, "f")])
    assert {bytes(r.digest): (r.n, r.keep_id) for r in exact_dedup.fold_records(spark, f"{home}/in", home, 1).collect()} == {b"a": (1, 1), b"b": (1, 2)}
    part([(b"a", 9, "g")])
    assert {bytes(r.digest): (r.n, r.keep_id, r.locator) for r in exact_dedup.fold_records(spark, f"{home}/in", home, 1).collect()}[b"a"] == (2, 9, "g")


def test_fingerprints(spark, docs, none):
    rows = sorted([(i, t or "") for i, t in DOCS], key=lambda x: (x[0] if x[0] is not None else -1), reverse=True)
    got = {}
    for r in fingerprints.drift(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for at, (i, t) in enumerate(rows):
        if i == 5:
            continue
        following = rows[(at + 1) % len(rows)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        (r,) = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        same = fingerprints.canonical_text
        assert (r.near_edited, r.near_next) == (float(same(t) == same(edited)), float(same(t) == same(following)))
    assert got[8][0].fingerprint == got[9][0].fingerprint and got[1][0].fingerprint == got[5][0].fingerprint
    assert fingerprints.drift(none).count() == 0


def test_fingerprint_buckets_compare_bytes(spark):
    texts = spark.createDataFrame([(1, "one"), (2, "two"), (3, "One")], "doc_id long, text string")
    marked = texts.select("doc_id", fingerprints._sha(F.col("text")).alias("sha"), F.lit("collision").alias("fingerprint"))
    found = {r.doc_id: r.fingerprint for r in fingerprints.resolve_buckets(marked, texts).collect()}
    assert found[1] == found[3] != found[2]


def test_fingerprints_of_repeated_identifiers(spark):
    rows = [(1, "a"), (2, "a"), (1, "b"), (3, "b"), (None, "A"), (None, "c"), (4, "a")]
    texts = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sha string")
    got = collections.Counter((r.doc_id, r.fingerprint) for r in fingerprints.fingerprint(texts).collect())
    expected = collections.Counter((i, fingerprints.xxhash.xxh3_128_hexdigest(t.lower().encode())) for i, t in rows)
    assert got == expected
    drifted = collections.Counter((r.doc_id, r.fingerprint) for r in fingerprints.drift(texts).collect())
    assert drifted == expected


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def confirmed(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii_against_plain_python(spark):
    random.seed(11)
    parts = [*"a@.-+ 019()_é😀", "4111111111111111", "1.2.3.4", "a@b.co", "+1 (555) 123-4567", "DE89370400440532013000", " iban ", "000.1.1.256", "x@y.z_q@r.st"]
    texts = {i: "".join(random.choice(parts) for _ in range(random.randint(0, 25))) for i in range(1500)}
    texts |= {5000: None, 5001: "a" * 100_000 + "@", 5002: "1 " * 50_000, 5003: "a@b" + ".c" * 20_000, 5004: "+" + "(" * 50_000}
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if confirmed(k, m[0])]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert got[i].spans.startswith(",".join(spans))


def test_pii_added_kinds_need_proof(spark):
    rows = [(1, "pay to IBAN DE89 3704 0044 0532 0130 00 now"), (2, "IBAN DE88 3704 0044 0532 0130 00"), (3, "visa card 378282246310005"), (4, "number 378282246310005"), (5, "SSN 123-45-6789"), (6, "part 123-45-6789")]
    got = {r.doc_id: r.n_added for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0}


def test_pii_of_repeated_rows(spark):
    row = (1, "mail a@b.co or a@b.co, 1.2.3.4")
    got = pii.report(spark.createDataFrame([row, row, (None, row[1]), (2, None)], "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.spans) for r in got) == {(1, "email:5:11,email:15:21,ip:23:30"): 2, (None, "email:5:11,email:15:21,ip:23:30"): 1, (2, ""): 1}


def test_pii_account_numbers_end_where_their_country_has_it(spark):
    rows = [
        (1, "ES91 2100 0418 4502 0005 1332 EUR", "iban:0:29"), (2, "BE68 5390 0754 7034 BANK", "iban:0:19"), (3, "xBE68539007547034", ""), (4, "BE68539007547034X", ""),
        (5, "to BE68539007547034.", "iban:3:19"), (6, "ZZ68 5390 0754 7034", ""), (7, "BE68 5390 0754 7035", ""), (7, "BE68 5390 0754 7034 / BE68 5390 0754 7034", "iban:0:19,iban:22:41"),
    ]
    docs = spark.createDataFrame([(i, t, "own") for i, t, _ in rows], "doc_id long, text string, pii string")
    found = collections.Counter((r.doc_id, ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.pii)) for r in pii.find_pii(docs).collect())
    assert found == collections.Counter((i, spans) for i, _, spans in rows)
    assert pii.report(docs.where("false")).count() == 0


def test_language_id(spark, none):
    train = [("en", "the cat and the dog with this and that of the house"), ("de", "der hund und die katze mit dem haus und der garten"), ("fr", "le chat et le chien avec la maison et les fleurs")]
    rows = [(i, t, k) for i in range(5) for k, t in train]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(1, "the house and the garden"), (2, "die katze und der garten"), (3, None), (4, ""), (5, "123 !!"), (6, "le chien et les chats"), (7, "the " * 100_000), (8, "x"), (9, "中文")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6, 7)] == ["en", "de", "und", "und", "und", "fr", "en"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[8][0] in model and got[9][0] in model
    assert langid.predict(none, model).count() == 0
    assert [r.lang_pred for r in langid.predict(spark.createDataFrame(odd[:1], "doc_id long, text string"), langid.fit(none)).collect()] == ["und"]


def test_language_query_learns_from_the_rest_only(spark, tmp_path):
    """Labels of held-out rows are wrong on purpose: none of them is ever predicted."""
    words = {"en": "the cat and dog with this house", "de": "der hund und die katze mit haus", "fr": "le chat et les chiens avec maison"}
    random.seed(1)
    rows = []
    for i in range(120):
        lang = random.choice(list(words))
        held = zlib.crc32(str(i).encode()) % 4 == 2
        rows.append((i, " ".join(random.choice(words[lang].split()) for _ in range(30)), "wrong" if held else lang, lang))
    rows += [(7, *rows[7][1:]), (500, None, "en", "und"), (501, "12 !", "de", "und"), (None, "the cat", "fr", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, true string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    true = {r[0]: r[3] for r in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred == true[r.doc_id] and 0 <= r.score <= 1


def test_language_of_held_out_documents(spark):
    got = queries.op5_language_id(spark, "/root/testdata/sf0.001").where("held_out")
    both = got.join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("lang_pred <> 'und' and lang is not null")
    right = both.where("lang = lang_pred").count()
    assert both.count() > 30 and right >= 0.95 * both.count()


def test_warc_round_trip(spark):
    rows = [(3, "http://a/", "<p>one</p>"), (1, "http://b/ü x", "<p>one</p>"), (2, None, "two"), (4, "http://c/", None), (5, "http://d/", ""), (6, "http://e/", "é" * 300_000), (None, "http://f/", "two")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, text in rows:
        data = (text or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("response", None), 3: ("revisit", 1), 2: ("response", None), None: ("revisit", 2), 4: ("response", None), 5: ("revisit", 4), 6: ("response", None),
    }
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_of_equal_rows(spark, monkeypatch):
    """Of rows equal in all columns one is the response, however many there are."""
    monkeypatch.setattr(warc, "TWINS", 7)
    long = "p" * 200_000
    rows = [(1, "u", "<p>x")] * 40 + [(1, "v", "<p>x"), (9, "u", "<p>x"), (None, "u", "only"), (None, "u", "only"), (5, "u", ""), (5, "u", None), (6, None, long), (6, None, long)]
    pages = spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id long, url string, html string, record_type string, first int").repartition(4)
    got = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect())
    assert got == {
        (1, "response", None, 4): 1, (1, "revisit", 1, 4): 40, (9, "revisit", 1, 4): 1, (None, "response", None, 4): 1, (None, "revisit", None, 4): 1,
        (5, "response", None, 0): 1, (5, "revisit", 5, 0): 1, (6, "response", None, 200_000): 1, (6, "revisit", 6, 200_000): 1,
    }


def test_warc_members_stand_alone():
    data = [warc.record(i, "http://x/", b"payload %d\r\n\r\n" % i, None, False) for i in range(50)]
    zipper = zlib.compressobj(1, zlib.DEFLATED, warc.GZIP)
    whole = b"".join(map(zipper.compress, data)) + zipper.flush()

    class Stream:
        def __init__(self, raw):
            self.raw, self.at = raw, 0

        def read(self, n):
            self.at += 7
            return self.raw[self.at - 7 : self.at]

    assert [r for _, r in warc.records_of(warc.inflate(Stream(whole)))] == data
    with pytest.raises(ValueError):
        list(warc.records_of(iter([data[0][:-9]])))


def classes_by_force(texts):
    """Classes of near duplicates by comparing all pairs."""
    known = {}
    sets = [dict(zip(*(x.tolist() for x in near_dedup.shingles(t, known)), strict=True)) for t in texts]
    df = collections.Counter(h for x in sets for h in x)
    idf = {h: (np.log((1 + len(texts)) / (1 + c)) + 1) ** near_dedup.IDF_POWER for h, c in df.items()}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = sum(min(c, sets[j][h]) * idf[h] for h, c in x.items() if h in sets[j])
            union = sum(c * idf[h] for h, c in x.items()) + sum(c * idf[h] for h, c in sets[j].items()) - both
            if union and both / union >= near_dedup.THRESHOLD:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_against_all_pairs(spark):
    random.seed(3)
    vocabulary = ["".join(random.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    texts = ["", "one", "one two", "..."]
    for k in range(12):
        words = [random.choice(vocabulary) for _ in range(random.choice([20, 80, 300]))]
        texts.append(" ".join(words))
        for _ in range(random.choice([1, 3, 25])):
            copy = list(words)
            for _ in range(random.randint(0, max(1, len(words) // 60))):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts.append(" ".join(copy))
    texts = list(dict.fromkeys(texts))
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, texts[7]), (1001, None), (None, texts[8])]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = collections.defaultdict(list)
    for r in got.collect():
        found[r.doc_id].append(r.class_id)
    expected = classes_by_force(texts)
    assert [found[i] for i in range(len(texts))] == [[c] for c in expected]
    assert found[1000] == [expected[7]] and found[1001] == [0] and found[None] == [expected[8]]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(expected))
    assert near_dedup.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_of_a_cloud_around_the_threshold(spark):
    """300 texts alike at about the threshold: every link that brute force finds joins its two texts, and no other."""
    random.seed(17)
    vocabulary = ["".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    base = [random.choice(vocabulary) for _ in range(600)]
    texts = []
    for _ in range(300):
        copy = list(base)
        for at in random.sample(range(600), 8):
            copy[at] = random.choice(vocabulary)
        texts.append(" ".join(copy))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    expected = classes_by_force(texts)
    assert 200 < len(set(expected)) < 300  # some links, but no single class
    assert [got[i] for i in range(300)] == expected


def test_links_in_a_crowded_bucket(spark, monkeypatch):
    """A cloud in one bucket: pairs of members that never lead it, and a chain whose ends differ."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16, raising=False)
    sets = {k: range(100 * k, 100 * k + 20) for k in range(300)}
    for k, other in ((101, 100), (151, 150), (203, 202)):
        sets[k] = range(100 * other + 1, 100 * other + 21)
    for k in range(1, 5):  # 250 - 251 - ... - 254: neighbours share 18 of 20, others less than the threshold
        sets[250 + k] = range(25000 + 2 * k, 25020 + 2 * k)
    rows = [
        (
            k.to_bytes(16, "big"), 20.0, near_dedup._squeeze(near_dedup._gaps(np.array(names, np.uint64))),
            near_dedup.zstandard.ZstdCompressor().compress(np.ones(20).tobytes()), [7, 8, *(1000 * k + b for b in range(24))], bytes(130),
        )
        for k, names in sets.items()
    ]
    vectors = spark.createDataFrame(rows, near_dedup.VECTORS).repartition(3)
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in near_dedup.links(vectors, shared_root(spark)).collect()}
    expected = {100: 100, 101: 100, 150: 150, 151: 150, 202: 202, 203: 202, **{250 + k: 250 for k in range(5)}}
    assert {k: v for k, v in got.items() if k in expected or k != v} == expected


def test_chunks_take_little_memory(monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK_SHINGLES", 200_000)
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(random.choices(vocabulary, k=random.choice((3, 700, 1000)))) for _ in range(600)]
    texts += [texts[0] + " " + texts[0], None, "...", texts[1]]
    nodes = [i.to_bytes(2) for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(texts, pa.string())], names=["node", "text"])
    tracemalloc.start()
    chunks = list(near_dedup._chunks(4)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 85 * 200_000
    got = {}
    for row in (r for c in chunks for r in c.to_pylist()):
        assert len(row["slices"]) > 1
        hashes, counts = [], []
        for x in row["slices"]:
            own = np.cumsum(near_dedup._expand(x["hashes"]), dtype=np.uint64) + (np.uint64(x["bucket"]) << np.uint64(near_dedup.BITS - 4))
            assert len(own) == x["size"]
            hashes.append(own)
            counts.append(near_dedup._expand(x["counts"]))
        hashes, counts = np.concatenate(hashes), np.concatenate(counts)
        gaps, times, start, seen = near_dedup._expand(row["places"]), near_dedup._expand(row["times"]), 0, np.zeros(len(hashes), np.uint64)
        for node, size in zip(row["nodes"], row["sizes"], strict=True):
            at = np.cumsum(gaps[start : start + size]).astype(np.int64)
            got[node] = (hashes[at].tolist(), times[start : start + size].tolist())
            seen[at] += np.uint64(1)
            start += size
        assert start == len(gaps) == len(times) and np.array_equal(seen, counts)
    made = {n: tuple(x.tolist() for x in near_dedup.shingles(t or "", {})) for n, t in zip(nodes, texts, strict=True)}
    assert len(chunks) == 2 and got == {n: x for n, x in made.items() if x[0]}


def test_packed_tables_are_not_compressed_again(spark, monkeypatch):
    found, write = {}, near_dedup.materialise

    def written(df, path, *args, **more):
        out = write(df, path, *args, **more)
        for file in pathlib.Path(path.removeprefix("file://")).glob("*.parquet"):
            groups = (meta.row_group(i) for meta in [pq.read_metadata(file)] for i in range(meta.num_row_groups))
            found.setdefault(path.rpartition("/")[2], set()).update(g.column(i).compression for g in groups for i in range(g.num_columns))
        return out

    monkeypatch.setattr(near_dedup, "materialise", written)
    random.seed(4)
    texts = [" ".join(random.choices("abcdefghij", k=60)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *(f"{t} z" for t in texts)])], "doc_id long, text string")
    classes = {tuple(sorted((r.doc_id, r.class_id))) for r in near_dedup.near_classes(docs).collect()}
    assert classes == {(i % 20, i) for i in range(40)}
    assert found["chunks"] == found["vectors"] == {"UNCOMPRESSED"} and found["rows"] == {"SNAPPY"}


def test_weighted_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    names = rng.integers(1, 2**62, 200).astype(np.uint64)
    a, b = rng.uniform(0.1, 5, 150), rng.uniform(0.1, 5, 150)
    seeds = near_dedup._mix(np.arange(1, 2001, dtype=np.uint64))
    x, y = near_dedup.sample(names[:150], a, seeds), near_dedup.sample(names[50:], b, seeds)
    left, right = np.zeros(200), np.zeros(200)
    left[:150], right[50:] = a, b
    assert abs((x == y).mean() - np.minimum(left, right).sum() / np.maximum(left, right).sum()) < 0.04


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), shared_root(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {i: 100 for i in range(100, 161)}


def test_merges_against_the_library():
    import tiktoken

    ranks = bpe._ranks(bpe.default_vocabulary())
    encoding = tiktoken.Encoding("t", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    random.seed(12)
    pieces = ["".join(random.choice("aaabeiorstn 'é中😀ing") for _ in range(random.randint(1, 30))) for _ in range(5000)] + ["a" * 3000, "ab" * 5000, "=" * 2000, "é" * 999]
    table = bpe.token_bytes(bpe.default_vocabulary())
    for p in pieces:
        ids = bpe.merged(p.encode(), ranks)
        assert ids == encoding.encode_ordinary(p) and table.decode(np.array(ids)) == p.encode()
    assert table.decode(np.empty(0, np.int64)) == b""


def test_byte_bpe(spark, docs, none):
    import tiktoken

    encoding = tiktoken.Encoding("t", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks=bpe._ranks(bpe.default_vocabulary()), special_tokens={})
    random.seed(2)
    odd = [(100 + i, "".join(random.choice("ab 'sé\n\t\x00  12½中😀!<|endoftext|>") for _ in range(random.randint(0, 20)))) for i in range(400)]
    source = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = collections.Counter(
        (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        for i, t, ids in ((i, t or "", encoding.encode_ordinary(t or "")) for i, t in [*DOCS, *odd])
    )
    assert collections.Counter(tuple(r) for r in bpe.encode_decode(source).collect()) == rows
    assert collections.Counter(tuple(r) for r in bpe.encode_decode(source, block_tokens=40).collect()) == rows
    assert bpe.encode_decode(none).count() == 0



def test_byte_bpe_holds_one_block(monkeypatch):
    held, most = weakref.WeakSet(), 0

    class Watched(bpe.Block):
        def __init__(self):
            super().__init__()
            held.add(self)

        def add(self, key, tokens):
            nonlocal most
            super().add(key, tokens)
            most = max(most, sum(bool(b.names) for b in held))

    monkeypatch.setattr(bpe, "Block", Watched)
    texts = [f"{i} words and {i % 7} more" for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], names=["id", "text"])
    for run in (bpe._spread, bpe._positions):
        assert len({b for x in run(8, 50)(iter([batch])) for b in x.column("block").to_pylist()}) > 5
    assert most == 1


def test_byte_bpe_blocks_of_distinct_words(monkeypatch):
    # distinct words close a block by their memory, long before its pre-tokens are many
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20_000, raising=False)
    texts = [" ".join(f"{'x' * i}{'abcdefgh'[j]}" for j in range(8)) for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts)], names=["id", "text"])
    blocks = list(bpe._blocks(iter([batch]), 1_000_000))
    assert [i for b in blocks for i in b.ids] == list(range(100)) and 5 < len(blocks) < 20
    same = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts[:1] * 100)], names=["id", "text"])
    assert len(list(bpe._blocks(iter([same]), 1_000_000))) == 1
    for block in blocks:  # common words first, then by bucket and letters
        words, at = list(block.names), list(block.at)
        count, of = collections.Counter(at), {w: xxhash.xxh32_intdigest(w) % 8 for w in block.names}
        order = sorted(range(len(words)), key=lambda i: (-count[i], of[words[i]], words[i]))
        _, positions, got, buckets = block.close(8)
        assert got == [words[i] for i in order] and buckets.tolist() == [of[w] for w in got]
        assert [got[i] for i in positions.tolist()] == [words[i] for i in at] and not block.names


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article><h1>A &amp; B</h1><p>One\n two<br>three</p><script>x='</p>'</script><p>Four</article><footer>no</footer>", "A & B\nOne two three\nFour"),
        ("<nav><a href=/>Home</a></nav><main><p>Text of it.</p><aside>Side</aside><form>Name <input></form><div class='comments'><p>Nice post!</p></div></main>", "Text of it."),
        ("<body><div class=cookie-notice>We use cookies</div><p>" + "The quick fox is in the house and it was the best of all. " * 3 + "</p><p>Short.</p><div id=footer>(c)</div>", ("The quick fox is in the house and it was the best of all. " * 3).strip() + "\nShort."),
        ("<article><p>" + "word " * 50_000 + "</p></article>", ("word " * 50_000).strip()),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


SENTENCE = "The quick fox is in the house and it was the best of all. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="wrapper no-sidebar"><p>Hello there</p></div>', "Hello there"),
        ('<div class="content has-search"><article><p>x y</p></article></div>', "x y"),
        ('<div class="main-nav"><p>Home</p></div><p>Text</p>', "Text"),
        ("<title>abc<p>text</p>", "text"),
        ("<noscript>x<div>abc</div>", "abc"),
        ("<p>a</p><script>x <p>b</p>", "a"),
        (f"<form><p>{SENTENCE * 5}</p><p>Short</p></form>", f"{(SENTENCE * 5).strip()}\nShort"),
        (f"<p>{SENTENCE * 5}</p><form><p>Your name</p></form>", (SENTENCE * 5).strip()),
        (f"<main><p>One</p></main><div><p>{SENTENCE * 5}</p></div><p>Next</p>", f"One\n{(SENTENCE * 5).strip()}\nNext"),
        (f'<div class="popup"><main><p>{SENTENCE}</p></main></div>', SENTENCE.strip()),
        # names that only begin or end like those of boilerplate, inside an article
        (f'<article><p>One</p><div class="side-effects"><p>{SENTENCE * 4}</p></div></article>', f"One\n{(SENTENCE * 4).strip()}"),
        (f'<article><div class="share-price"><p>{SENTENCE * 4}</p></div><div class="share-buttons">Share it</div></article>', (SENTENCE * 4).strip()),
        (f'<main><section id="related-work"><p>{SENTENCE}</p></section><div class="related-posts"><p>{SENTENCE * 4}</p></div></main>', SENTENCE.strip()),
        (f'<main><section id="discussion"><p>{SENTENCE}</p></section><div class="article-sidebar"><p>{SENTENCE * 4}</p></div></main>', SENTENCE.strip()),
        (f'<article><p><a href="/x">{SENTENCE * 2}</a></p></article>', (SENTENCE * 2).strip()),
        (f"<article><p>{SENTENCE * 4}</p><ul><li><a href=/a>Read this too</a></li></ul><div><a href=/a>A</a> <a href=/b>B</a> <a href=/c>C</a></div></article>", (SENTENCE * 4).strip()),
    ],
)
def test_main_text_of_wrapped_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("part", ["<div>", '<a b="', "<svg>", "<!--", "<p><b ", "<article>", "<select>", '<li><a href="', "</p>", "<script>"])
def test_work_grows_with_the_page(part):
    began = time.perf_counter()
    html_extract.main_text(part * (500_000 // len(part)))
    html_extract.main_text(part * (200_000 // len(part)) + ">" + SENTENCE)
    assert time.perf_counter() - began < 8


def test_main_text_of_built_pages(spark):
    """Pages put together from parts of a known kind: all of the article comes out and nothing else."""
    random.seed(8)
    rows, expected = [], {}
    words = "the house of a green fox and it was in this large old garden with &amp; for all".split()
    around = ["<nav><a href=/>Home</a><a href=/b>News</a></nav>", "<div class='cookie-notice'>We use cookies on this page</div>", "<aside>Side</aside>", "<footer>(c) us</footer>", "<ul class=related-links><li><a href=/x>Read this too</a></li></ul>", "<script>var x = '<p>no</p>'</script>", "<div id=comments><p>" + SENTENCE * 4 + "</p></div>", "<form>Mail <input></form>"]
    for i in range(200):
        paragraphs = [" ".join(random.choice(words) for _ in range(random.choice([8, 30, 90]))) for _ in range(random.randint(1, 6))]
        article = "<article><h1>Head</h1>" + "".join(f"<p>{p}</p>\n" for p in paragraphs) + "</article>"
        parts = [random.choice(around) for _ in range(4)]
        rows.append((i, "u", "<html><head><title>t</title></head><body>" + "".join(parts[:2]) + article + "".join(parts[2:]) + "</body></html>", "own"))
        expected[i] = "\n".join(["Head", *(p.replace("&amp;", "&") for p in paragraphs)])
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert {r.page_id: r.text for r in got} == expected and all(r.n_chars == len(r.text) for r in got)


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</p></article>"), (1, "u", None), (None, None, "<p")], "page_id long, url string, html string")
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect())
    assert got == {(1, "x", 1): 1, (1, "", 0): 1, (None, "<p", 2): 1} and html_extract.extract(pages.where("false")).count() == 0


def test_tool_calls(spark):
    call = lambda i, *needs, name="reply", text="x": {"id": i, "name": name, "arguments": {"text": text}, "depends_on": list(needs)}
    pack = lambda *calls: __import__("json").dumps({"tool_calls": list(calls)})
    answer = lambda i: __import__("json").dumps({"tool_call_id": i, "content": "y"})
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "user", ""), (1, 3, "system", None),
        (2, 0, "assistant", pack(call("b", "a"), call("a"))), (2, 1, "tool", answer("b")), (2, 5, "tool", answer("a")), (2, 6, "tool", answer("z")), (2, 7, "tool", answer("a")),
        (3, 0, "assistant", pack(call("p", "q"), call("q", "p"), call("u", name="?"), call("v", text=3))), (None, None, None, None),
    ]
    got = {(r.conv_id, r.turn, r.place): r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r.status for k, r in got.items()} == {
        (1, 0, 0): "ok", (1, 1, 0): "ok", (1, 2, 0): "invalid", (1, 3, 0): "message",
        (2, 0, 0): "ok", (2, 0, 1): "ok", (2, 1, 0): "ok", (2, 5, 0): "ok", (2, 6, 0): "orphan", (2, 7, 0): "duplicate_result",
        (3, 0, 0): "cyclic", (3, 0, 1): "cyclic", (3, 0, 2): "unknown_tool", (3, 0, 3): "invalid", (None, None, 0): "message",
    }
    order = sorted((got[k].after, got[k].depth, got[k].call_id, got[k].kind) for k in [(2, 0, 0), (2, 0, 1), (2, 1, 0), (2, 5, 0)])
    assert [x[2:] for x in order] == [("a", "call"), ("a", "result"), ("b", "call"), ("b", "result")]
    assert got[(1, 0, 0)].canonical == '{"arguments":{"text":"hello"},"id":"turn-0","name":"reply","type":"tool_call"}'
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_malformed_tool_calls(spark, none):
    pack = __import__("json").dumps
    rows = [
        (1, 0, "assistant", pack({"tool_calls": [{"id": "a", "name": "reply", "arguments": {"text": "x"}, "depends_on": 5}, {"id": "b", "name": ["x"]}, 7]})),
        (1, 1, "assistant", '{"tool_calls": [{"id": "s", "name": "reply", "arguments": {"text": "\\ud800"}}]}'),
        (1, 2, "assistant", pack({"tool_calls": [{"name": "reply", "arguments": {"text": "x"}}, {"id": None, "name": "reply", "arguments": "{"}]})),
        (1, 3, "tool", pack({"tool_call_id": None, "content": "y"})), (1, 4, "system", '{"tool_call_id": "s", "content": NaN}'),
        (1, 5, "assistant", pack({"tool_calls": [{"id": 5, "name": "reply", "arguments": '{"text":"x"}', "depends_on": "bc"}]})),
        (1, 6, "system", '{"tool_calls": ' + "[" * 100_000), (1, 7, "tool", pack({"tool_call_id": 5, "content": 1})),
    ]
    source = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, status string")
    got = {(r.turn, r.place): (r.kind, r.call_id, r.status) for r in chat.link(source).collect()}
    assert got == {
        (0, 0): ("call", "a", "invalid"), (0, 1): ("call", "b", "unknown_tool"), (1, 0): ("call", "s", "unanswered"), (2, 0): ("call", None, "unanswered"),
        (2, 1): ("call", None, "invalid"), (3, 0): ("result", None, "orphan"), (4, 0): ("message", None, "message"), (5, 0): ("call", "5", "invalid"),
        (6, 0): ("message", None, "message"), (7, 0): ("result", "5", "ok"),
    }


@pytest.mark.parametrize("graph", [100_000, 3])
def test_order_of_many_calls(spark, monkeypatch, graph):
    """Chains, cycles and what hangs behind them; in one task and by joins."""
    monkeypatch.setattr(chat, "GRAPH", graph)
    call = lambda i, *needs: {"id": i, "name": "reply", "arguments": {"text": "x"}, "depends_on": list(needs)}
    pack = lambda *calls: __import__("json").dumps({"tool_calls": list(calls)})
    chain = [call(k, *([k - 1] if k else [])) for k in range(6)]
    rows = [(1, 0, "a", pack(*chain)), (1, 9, "t", __import__("json").dumps({"tool_call_id": 2})), (2, 0, "a", pack(call("p", "q"), call("q", "p"), call("r", "p"), call("s"), call("t", "s", "nobody"))), (3, 4, "a", pack(call("x", "y"), call("y")))]
    got = {(r.conv_id, r.call_id): (r.status, r.after, r.depth) for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()}
    open_ = "unanswered"
    expected = {(1, str(k)): ("ok" if k == 2 else open_, 9 if k > 2 else 0, 2 * k) for k in range(6)}
    expected |= {(2, k): ("cyclic", 0, 0) for k in "pqr"} | {(2, "s"): (open_, 0, 0), (2, "t"): (open_, 0, 2), (3, "x"): (open_, 4, 2), (3, "y"): (open_, 4, 0)}
    assert got == expected


def test_mixing_meets_targets(spark):
    random.seed(4)
    rows, labels = [], []
    for i in range(600):
        toxic, low = i % 6 == 0, i % 5 == 0
        words = [random.choice(["the", "house", "is", "green", "and", "large", f"w{random.randint(0, 500)}"]) for _ in range(40)]
        if toxic:
            words[3:6] = ["idiot", "trash", "idiot"]
        if low:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words)))
        if i < 500:
            labels.append((i, int(not low), int(toxic)))
    docs = spark.createDataFrame(rows + [(9000, None), (9001, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    targets = {"high": 0.7, "low": 0.25, "toxic": 0.05}
    mixed = mixing.mix(docs, known, targets).cache()
    assert mixed.count() == 602 and mixed.where("rate < 0").count() == 0
    shares = {r.domain: r.share for r in mixing.shares_of(mixed, targets).collect()}
    assert all(abs(shares[d] - targets[d]) < 0.04 * targets[d] for d in mixing.DOMAINS)
    held = mixed.where("doc_id between 500 and 599 and doc_id % 6 = 0").agg(F.avg("p_toxic")).first()[0]
    assert held > 0.7
    assert mixing.mix(docs.where("false"), known).count() == 0


def posteriors_by_force(text, model):
    """n_tokens and the posteriors of a text in plain Python."""
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    hashed = lambda w, seed=42: __import__("xxhash").xxh64_intdigest(w.encode(), seed)
    words = [w for w in re.split(r"\s+", text or "") if w]
    hashes = {signed(hashed(w.rstrip(".,;:").lower())) for w in words} | {signed(hashed(w[-2:], hashed("ending"))) for w in words}
    found = {t for h in hashes if (t := model.table[h % mixing.PLACES]) >> 16 == h >> 16}
    odds = [sum(t >> 8 & 255 for t in found) / mixing.SCALE, sum(t & 255 for t in found) / mixing.SCALE]
    low, toxic = (1 / (1 + np.exp(-np.clip(model.prior[k] + odds[k] / model.temperatures[k], -30, 30))) for k in range(2))
    return len(words), np.array([(1 - toxic) * (1 - low), (1 - toxic) * low, toxic])


def test_mixing_against_plain_python(spark):
    """Posteriors by the model's definition; rates as the least squares fit that stays closest to 1 (KKT)."""
    random.seed(6)
    rows, labels = [], []
    for i in range(400):
        words = [random.choice(["the", "house,", "is", "Green", "and", "large", f"w{random.randint(0, 300)}"]) for _ in range(random.randint(5, 60))]
        if i % 5 == 0:
            words = words[:2] + ["idiot", "trash."] + words[2:]
        if i % 4 == 0:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), "own", 7))
        labels += [(i, int(i % 4 > 0), int(i % 5 == 0)), (i, 1, 0)]
    rows += [(399, *rows[-1][1:]), (399, *rows[-1][1:]), (None, "the idiot", None, 1), (9, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string, p_low int").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = mixing.fit_classifier(docs, known, shared_root(spark))
    targets = {"high": 6.0, "low": 3.0, "toxic": 1.0}
    mixed = mixing.mix(docs, known, targets)
    assert mixed.columns == ["doc_id", "text", *mixing.ADDED]
    got = mixed.collect()
    assert len(got) == len(rows) and {r.rate for r in got if r.doc_id == 399 and r.text == rows[399][1]}.__len__() == 1
    for r in got:
        n, p = posteriors_by_force(r.text, model)
        assert r.n_tokens == n and np.allclose([r[f"p_{d}"] for d in mixing.DOMAINS], p, atol=1e-9)
    n = np.array([r.n_tokens for r in got], float)
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in got])
    rate = np.array([r.rate for r in got])
    e = (n * rate) @ p / n.sum() - np.array([0.6, 0.3, 0.1])
    assert np.abs(e).max() < 2e-3 and (rate >= 0).all()
    reported = {r.domain: (r.target, r.share, r.residual) for r in mixing.shares_of(mixed, targets).collect()}
    assert np.allclose([reported[d][2] for d in mixing.DOMAINS], e) and reported["low"][0] == 0.3
    # rates above 0 are 1 - p . u for one u, so no document can be moved without loss
    inside = rate > 0
    u, rest, *_ = np.linalg.lstsq(p[inside], 1 - rate[inside], rcond=None)
    assert np.allclose(p[inside] @ u, 1 - rate[inside], atol=1e-3) and (1 - p[~inside] @ u <= 1e-3).all()


def test_mixing_writes_the_sample_in_few_files(spark):
    """Tables of the bounded sample don't grow with the session's partitions; what is fitted stays the same."""
    rows = [(i, f"the house is green w{i}" + " idiot" * (i % 6 == 0) + " bad***" * (i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 5 > 0), int(i % 6 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    expected = mixing.fit_classifier(docs, known, shared_root(spark))
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "1k"}
    before = {k: spark.conf.get(k) for k in held}
    home = shared_root(spark)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        model = mixing.fit_classifier(docs, known, home)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("sample", "rest"):
        files = list(pathlib.Path(home.removeprefix("file://"), name).glob("part-*"))
        assert 1 < len(files) <= 16, (name, len(files))
    assert model == expected and any(model.table)


def test_resampling_meets_targets(spark):
    random.seed(5)
    rows = []
    for i in range(1200):
        words = [random.choice(["the", "house", "is", "green", "and", "large", f"w{random.randint(0, 500)}"]) for _ in range(40)]
        if i % 6 == 0:
            words[3:6] = ["idiot", "trash", "idiot"]
        elif i % 5 == 0:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (9000, None)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 6 == 0 or i % 5 != 0), int(i % 6 == 0)) for i in range(1200)], "doc_id long, quality int, toxic int")
    targets = {"high": 0.89, "low": 0.05, "toxic": 0.06}
    mixed = {r.doc_id: r for r in mixing.mix(docs, known, targets).collect()}
    got = collections.Counter(r.doc_id for r in mixing.resample(docs, known, targets).collect())
    assert got == {i: r.copies for i, r in mixed.items() if r.copies > 0}
    tokens = sum(r.n_tokens for r in mixed.values())
    for d, target in targets.items():
        share = sum(n * mixed[i].n_tokens * mixed[i][f"p_{d}"] for i, n in got.items()) / tokens
        assert abs(share - target) < 0.03, (d, share)
    assert got.keys() & {i for i in range(0, 1200, 6)}  # part of a domain that is thinned out stays


def test_pii_of_a_text_full_of_it(spark):
    """A hundred thousand matches in one text: all found at their places, in time that grows with their number."""
    part = "mail a.b@c.de, "
    rows = [(1, part * 100_000), (2, "x" * 1500 + " call +49 (30) 901820 " + "y" * 3000 + " card 4111 1111 1111 1111"), (3, "1.2.3.4 " * 300)]
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.perf_counter() - began < 120
    assert got[1].n_email == 100_000 and got[1].spans == ",".join(f"email:{len(part) * i + 5}:{len(part) * i + 13}" for i in range(100_000))
    assert {"phone:1506:1521", "card:4528:4547"} == set(got[2].spans.split(",")) and got[2].n_phone == got[2].n_card == 1
    assert got[3].spans == ",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(300))
