"""The corpus pipeline, stage by stage and as a whole, against plain Python."""

import collections
import hashlib
import random

import corpus_pipeline
import pytest
from vellumine.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def rows():
    random.seed(9)
    vocabulary = ["".join(random.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    texts = [[random.choice(vocabulary) for _ in range(100)] for _ in range(30)]
    near = [[*words[:50], "changed", *words[51:]] for words in texts[:5]]
    out = [" ".join(words) for words in texts + near]
    out += [*out[10:14], None, "", "12 34 ... !"]
    return [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def labels():
    return [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(20)]


def kept_by_force(rows):
    """After language_id, exact_dedup and minhash_near_dedup."""
    lettered = {i for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    text = {i: t for i, t, *_ in rows}
    single = {max(i for i in lettered if text[i] == t) for t in {text[i] for i in lettered}}
    return lettered, single, single - set(range(30, 35))


def test_stages(spark, rows, labels, tmp_path):
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    by_id = {r[0]: tuple(r) for r in rows}
    lettered, single, apart = kept_by_force(rows)
    stages = dict(corpus_pipeline.STAGES)
    part = lambda ids: docs.where(docs.doc_id.isin(*ids))
    for name, before, after in (("language_id", by_id, lettered), ("exact_dedup", lettered, single), ("minhash_near_dedup", single, apart)):
        got = [tuple(r) for r in stages[name](spark, part(before), str(tmp_path)).collect()]
        assert sorted(got) == [by_id[i] for i in sorted(after)], name
    # columns of the input that are named like those of the operators are passed on
    clashing = part(lettered).selectExpr("*", "5.5 as score", "'l' as lang_pred", "'k' as kept", "-1 as keep_id", "'g' as group_size", "'c' as class_id")
    for name in ("language_id", "exact_dedup", "minhash_near_dedup"):
        got = stages[name](spark, clashing, str(tmp_path)).collect()
        assert all((float(r.score), r.lang_pred, r.kept, r.keep_id, r.group_size, r.class_id) == (5.5, "l", "k", -1, "g", "c") for r in got) and got
    # columns of the input that are named like those of mix() are passed on
    clashing = part(apart).selectExpr("*", "'r' as rate", "'c' as copies", "'n' as n_tokens")
    got = stages["mixing"](spark, clashing, str(tmp_path)).collect()
    copies = {r.doc_id: r.copies for r in mixing.mix(part(apart), spark.createDataFrame(labels, LABELS)).collect()}
    assert collections.Counter(r.doc_id for r in got) == {i: n for i, n in copies.items() if n}
    assert {tuple(r) for r in got} == {(*by_id[i], "r", "c", "n") for i, n in copies.items() if n}
    for r in stages["byte_bpe"](spark, docs, str(tmp_path)).collect():
        assert r.decoded_sha256 == hashlib.sha256((by_id[r.doc_id][1] or "").encode()).hexdigest() and r.n_tokens == len(r.token_ids)


@pytest.mark.parametrize("empty", [False, True])
def test_run(spark, rows, labels, tmp_path, empty):
    docs = spark.createDataFrame([] if empty else rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known = spark.createDataFrame(labels, LABELS)
    known.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    apart = [] if empty else kept_by_force(rows)[2]
    copies = {} if empty else {r.doc_id: r.copies for r in mixing.mix(docs.where(docs.doc_id.isin(*apart)), known).collect()}
    assert collections.Counter(r.doc_id for r in got) == {i: n for i, n in copies.items() if n}
    text = {i: t for i, t, *_ in rows}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in got)
