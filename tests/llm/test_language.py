"""Language vectors against plain Python: letters, binding, bundles, cosines and floors."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellumine.llm import langid

SF = "/root/testdata/sf0.001"


def letters_of(text):
    """Codes of letters, with one 0 for each run of others, and at both ends."""
    codes = [0]
    for c in text:
        low = c.lower()[0] if c.isalpha() else ""
        if not c.isalpha():
            code = 0
        elif "a" <= low <= "z":
            code = ord(low) - 96
        elif low in langid.ACCENTED:
            code = 27 + langid.ACCENTED.index(low)
        else:
            first = 27 + len(langid.ACCENTED)
            code = first + ord(low if ord(c) < 0x10000 else c) % (langid.CODES - first)
        if code or codes[-1]:
            codes.append(code)
    return codes if codes[-1] == 0 else [*codes, 0]


def bundle(text, vectors):
    codes = letters_of(text)
    codes += [0] * (langid.N - len(codes))
    out = np.zeros(langid.DIMENSIONS)
    for i in range(len(codes) - langid.N + 1):
        bound = np.ones(langid.DIMENSIONS)
        for k in range(langid.N):
            # each letter is rotated by its place
            turn = langid.N - 1 - k
            bound = bound * [vectors[codes[i + k]][(d - turn) % langid.DIMENSIONS] for d in range(langid.DIMENSIONS)]
        out += bound
    return out, len(codes) - langid.N + 1


@pytest.fixture(scope="module")
def by_force():
    return np.random.default_rng(langid.SEED).choice(np.array([-1, 1], np.int8), (langid.CODES, langid.DIMENSIONS)).astype(float)


def test_scores_against_plain_python(spark, by_force):
    rng = random.Random(2)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows = rng.sample([r for r in rows if len(r[1]) < 3000], 40) + [(901, "Ünïcode ÇÑß 漢字 кот", "de"), (902, "ab", "en"), (903, "x" * 500, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = collections.defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for _, text, lang in rows:
        own, n = bundle(text, by_force)
        prototypes[lang] += own / math.sqrt(n)
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs), size_col="size").collect()}
    for i, text, _ in rows:
        own, n = bundle(text, by_force)
        cosines = {k: own @ p / np.linalg.norm(own) / np.linalg.norm(p) for k, p in prototypes.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(min(1, max(0, cosines[best])), abs=1e-5) and got[i]["size"] == n


def test_equal_prototypes_tie_to_the_first(spark):
    docs = spark.createDataFrame([(1, "same words here", "fr"), (2, "same words here", "de")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()} == {"de"}


def test_floors(spark):
    rows = [(float(s), n) for n in (70, 100, 127) for s in (0.8, 0.4, 0.6)] + [(0.5, 128), (0.9, 300), (0.1, 10)]
    least = langid.floors(spark.createDataFrame(rows, "score double, size long"))
    assert least == pytest.approx({6: 0.15, 7: 0.125, 8: 0.225})
    asked = spark.createDataFrame([(0.0, 10), (0.14, 64), (0.16, 64), (0.12, 200), (0.2, 256), (0.0, 5000)], "score double, size long")
    assert [r.ok for r in asked.select(langid.alike(least, F.col("score"), F.col("size")).alias("ok")).collect()] == [True, False, True, False, False, True]
    assert langid.floors(asked.where("false")) == {}


def test_stage_rejects_texts_like_no_language(spark):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text, r.lang, "s", 1) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()][:400]
    junk = ["zqx " * 300, "qwrtzp sdfgh yxcvb " * 60, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(900)), "".join(rng.choice("kqxzjwv  ") for _ in range(1500))]
    docs = spark.createDataFrame(rows + [(10_000 + i, t, None, "s", 1) for i, t in enumerate(junk)] + [(20_000, rows[0][1], None, "s", 1), (None, rows[1][1], None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.language_id(spark, docs, "").collect()
    kept = {r.doc_id: r for r in got}
    assert not set(range(10_000, 10_004)) & set(kept)
    assert kept[20_000].lang == rows[0][2] and None in kept
    lost = [r for r in rows if r[0] not in kept]
    # none of the prose goes: what does repeats a few syllables
    assert len(lost) <= 4 and all(len(set(r[1].split())) < 25 for r in lost)
