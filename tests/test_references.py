import datetime as dt

import pytest

from kavak.operators.references import judged, orphans

DAY = lambda n: dt.datetime(2025, 1, n)
REF = "id string, k1 string, k2 string, at timestamp, created timestamp"
REC = "r1 string, r2 string, created timestamp, deleted timestamp"


def frames(spark):
    refs = spark.createDataFrame(
        [("ok", "a", "x", DAY(5), None), ("gone", "d", "x", DAY(5), None), ("late", "l", "x", DAY(5), None), ("no", "q", "x", DAY(5), None),
         ("half", "a", None, DAY(5), None), ("half_no", "q", None, DAY(5), None), ("other", None, "y", DAY(5), None), ("empty", "", None, DAY(5), None), ("null", None, None, DAY(5), None)],
        REF,
    )
    recs = spark.createDataFrame(
        [("a", "x", DAY(1), None), ("a", "x", DAY(9), None), ("d", "x", DAY(1), DAY(2)), ("l", "x", DAY(8), None), ("l", "x", DAY(1), DAY(2)), (None, "x", DAY(1), None), ("b", None, DAY(1), None)], REC
    )
    return refs, recs


@pytest.mark.parametrize(
    ("match", "more"),
    [
        ("simple", {}),
        ("partial", {"half": "found", "half_no": "missing", "other": "missing"}),
        ("full", {"half": "mixed", "half_no": "mixed", "other": "mixed"}),
    ],
)
def test_masks(spark, match, more):
    refs, recs = frames(spark)
    out = judged(refs, ["k1", "k2"], "at", recs, ["r1", "r2"], "created", "deleted", match)
    assert {r.id: r.kind for r in out.collect()} == {"ok": "found", "gone": "deleted", "late": "late", "no": "missing"} | more


def test_bad_match(spark):
    refs, recs = frames(spark)
    with pytest.raises(ValueError):
        judged(refs, ["k1"], "at", recs, ["r1"], "created", "deleted", "some")


def test_nothing_and_repeats(spark):
    refs, recs = frames(spark)
    none = recs.limit(0)
    out = judged(refs, ["k1"], "at", none, ["r1"], "created", "deleted")
    assert {r.kind for r in out.collect()} == {"missing"} and out.count() == 6
    assert judged(refs.limit(0), ["k1"], "at", recs, ["r1"], "created", "deleted").count() == 0
    twice = refs.union(refs)
    rows = orphans(twice, "t", "id", ["k1"], "at", recs, ["r1"], "created", "deleted").collect()
    assert sorted((r.src_id, r.kind, r.period) for r in rows) == [("gone", "deleted", "2025-01"), ("half_no", "missing", "2025-01"), ("late", "late", "2025-01"), ("no", "missing", "2025-01")]


def test_hot_key(spark):
    refs = spark.range(3000).selectExpr("cast(id as string) id", "if(id % 3 = 0, 'hot', cast(id as string)) k1", "timestamp'2025-01-05' at")
    recs = spark.range(2000).selectExpr("'hot' r1", "timestamp'2025-01-01' created", "cast(null as timestamp) deleted")
    out = judged(refs, ["k1"], "at", recs, ["r1"], "created", "deleted").groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in out} == {"found": 1000, "missing": 2000}
