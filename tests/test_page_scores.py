import random

import pytest
from pyspark.sql import functions as F

from kavak.operators import scoring

OUTCOMES = "outcome_id string, grade int, title string, theme string, framework string"
PAGES = "page int, package_id string, text string"
KEYS = ["page", "package_id"]


def tables(spark):
    rng = random.Random(3)
    words = [f"kelime{i}" for i in range(60)]
    some = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randrange(a, b)))
    outcomes = [(f"o{i}", rng.randrange(9, 13), some(1, 6), some(0, 3), None) for i in range(30)] + [("none", 9, None, None, None), ("absent", 9, "hiçbiryerde yoktur", "", "")]
    pages = [(i, rng.choice(("A-TYT", "A-AYT")), some(0, 40)) for i in range(200)] + [(300, "A-TYT", None)]
    pages += [(i, p, some(3, 20)) for i, p, _ in pages[:40]] + [(i + 400, p, t) for i, p, t in pages[:40]]  # repeated keys; the same texts under other keys
    return spark.createDataFrame(outcomes, OUTCOMES), spark.createDataFrame(pages, PAGES)


def scored(spark, **more):
    outcomes, pages = tables(spark)
    affine = F.contains("package_id", F.when(F.col("grade") <= 10, "-TYT").otherwise("-AYT"))
    return scoring.page_scores(outcomes, pages, KEYS, F.col("text"), affine, **more)


def rows(df):
    columns = ["outcome_id", *KEYS, "title_hits", "bigram_hits", "affine"]
    return {tuple(r[c] for c in columns): pytest.approx(r.score, abs=2e-6) for r in df.collect()}


def test_pages_scored_where_they_lie(spark, monkeypatch):
    """As by shuffle, in whatever pieces; a task's pairs have a bound."""
    few = scoring.FEW_OUTCOMES
    monkeypatch.setattr(scoring, "FEW_OUTCOMES", 0)
    by_shuffle = rows(scored(spark))
    monkeypatch.setattr(scoring, "FEW_OUTCOMES", few)
    assert len(by_shuffle) > 2000
    for cells, hits in ((scoring.CELLS, scoring.HITS), (100, 10**9), (10**9, 50), (1, 1)):
        monkeypatch.setattr(scoring, "CELLS", cells)
        monkeypatch.setattr(scoring, "HITS", hits)
        got = {k: v.expected for k, v in rows(scored(spark)).items()}
        assert got == by_shuffle


def test_pairs_that_cannot_be_best_stay_where_they_are(spark, monkeypatch):
    every = scored(spark)
    top = {tuple(r) for r in scoring.best_pages(every, KEYS, 3).collect()}
    for cells in (scoring.CELLS, 500):
        monkeypatch.setattr(scoring, "CELLS", cells)
        some = scored(spark, best=3)
        assert {tuple(r) for r in scoring.best_pages(some, KEYS, 3).collect()} == top
        assert some.count() < every.count() / 2


def test_nothing_to_score(spark):
    outcomes, pages = tables(spark)
    for o, p in ((outcomes.limit(0), pages), (outcomes, pages.limit(0)), (outcomes.filter("title is null"), pages)):
        assert scoring.page_scores(o, p, KEYS, F.col("text"), F.lit(True), best=3).count() == 0
