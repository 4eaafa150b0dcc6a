import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kavak.llm.languages import LANGS, Labeller, code_of, fit, fitted, forward_backward, languages, mislabelled, segments

DATA = "/root/testdata/sf0.001/lang_samples.parquet"


def test_forward_backward_is_brute_force():
    rng = np.random.default_rng(1)
    scores, moves, many = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), np.array([3, 2])
    p, expected = forward_backward(scores, many, moves)
    at, total = 0, np.zeros((3, 3))
    for n in many:
        weights = {}
        for path in np.ndindex(*[3] * n):
            weights[path] = np.exp(sum(scores[at + i, k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        z = sum(weights.values())
        for i in range(n):
            for k in range(3):
                assert p[at + i, k] == pytest.approx(sum(w for q, w in weights.items() if q[i] == k) / z)
        for q, w in weights.items():
            for a, b in zip(q, q[1:]):
                total[a, b] += w / z
        at += n
    assert expected == pytest.approx(total)


@pytest.fixture(scope="module")
def samples(spark):
    if not os.path.exists(DATA):
        pytest.skip("no test tables here")
    return spark.read.parquet(DATA)


def test_held_out(samples):
    rows = [(r["lang"], r["text"]) for r in samples.orderBy(F.xxhash64("sample_id")).collect()]
    labeller = Labeller(fit(rows[:900]))
    _, of, _, _, full, lang, sure = labeller.sentences([t for _, t in rows[900:]])
    right = np.array([rows[900 + i][0] for i in of]) == np.array(LANGS)[lang]
    assert right.mean() >= 0.98 and full.mean() > 0.9 and (sure <= 1).all()


def test_documents(spark, samples):
    by = {lang: " ".join(r["text"] for r in samples.filter(F.col("lang") == lang).limit(6).collect()) for lang in LANGS}
    docs = [
        (1, by["tr"], "tr"), (2, by["tr"], "Türkçe"), (3, by["de"], "tr"), (4, by["fr"], None), (5, by["tr"] + "\n\n" + by["ru"], "tr"), (6, None, None), (7, "", "xx"), (8, "2n = 46", "und"),
        (9, by["en"] + " (Arbeitsblatt)", " en_GB "), (10, by["az"].upper(), "??"), (11, by["en"], "  "),
    ]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = fitted(samples, "lang", "text", rows, "doc_id", "lang", "text")
    got = {tuple(r) for r in mislabelled(rows, "doc_id", "text", "lang", model).collect()}
    assert got == {(3, "de"), (4, "fr"), (5, "tr"), (5, "ru"), (10, "az"), (11, "en")}
    found = {r.doc_id: r.languages for r in languages(rows, "doc_id", "text", model).collect()}
    assert len(found) == 11 and found[6] == [] and found[1][0].lang == "tr" and 0.5 < found[1][0].confidence <= 1
    parts = [(r.lang, r.segment) for r in segments(rows.filter("doc_id = 5"), "doc_id", "text", model).orderBy("segment").collect()]
    assert parts == [("tr", 0), ("ru", 1)]
    assert mislabelled(rows.limit(0), "doc_id", "text", "lang", model).count() == 0


def test_codes(spark):
    names = ["tr", "TR", "tr-TR", "tur", "Türkçe", "English", "en_GB", "deu", "und", "xx", "", "es", None, " ru "]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in rows.select(code_of(F.col("n"))).collect()] == ["tr"] * 5 + ["en", "en", "de", None, None, None, None, None, "ru"]


def test_switches_inside_a_sentence(spark, samples):
    """A clause of another language makes a segment of its own; a single foreign word doesn't; what is sure of no language is told."""
    first = {lang: samples.filter((F.col("lang") == lang) & (F.size(F.split("text", " ")) > 6)).orderBy("sample_id").first()["text"].split(". ")[0].rstrip(".!?") for lang in LANGS}
    word = max(first["de"].split(), key=len)
    docs = [
        (1, f"{first['en']}, {first['tr']}."), (2, f"{first['tr']}."), (3, " ".join([*first["ru"].split()[:4], word, *first["ru"].split()[4:]]) + "."), (4, "Zxqw vrtk plmn qqwz xkcd wvut."), (5, "x"), (6, None), (7, first["tr"]),
    ]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    model = fitted(samples, "lang", "text")
    got = {}
    for r in segments(rows, "doc_id", "text", model).orderBy("doc_id", "segment").collect():
        got.setdefault(r.doc_id, []).append((r.lang, r.sentences))
    assert got[1] == [("en", 0), ("tr", 0)] and got[2] == [("tr", 1)] and got[3] == [("ru", 1)] and 6 not in got
    assert [x for x, _ in got[4]] == ["und"]
    found = {r.doc_id: [(x.lang, x.sentences) for x in r.languages] for r in languages(rows, "doc_id", "text", model).collect()}
    assert found[7] == [("tr", 0)] and found[2] == [("tr", 1)] and found[6] == []
