import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kavak.functions import pages
from kavak.functions import scalars as S
from kavak.functions import text as X
from kavak.operators import lookups, review, scoring

Q = "id string, subject string, grade int, topic string, difficulty string, note string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_filters_take_values_as_they_are(spark):
    q = spark.createDataFrame([("1", "Tarih", 9, "A", "basic", "x"), ("2", "Tarih", 9, "A", "EASY ", None), ("3", "tarih", 9, "A", "hard", "x"), ("4", "Tarih", None, "A", None, "x")], Q)
    assert {r.id for r in lookups.questions_for(q, "Tarih", 9, "A").collect()} == {"1", "2"}
    assert {r.id for r in lookups.questions_for(q, "Tarih", 9, "A", "easy").collect()} == {"1", "2"}
    assert lookups.questions_for(q, "Tarih", 9, "A", "hard").count() == 0 and lookups.questions_for(q.limit(0), "Tarih", 9, "A").count() == 0
    assert lookups.first_matching(q, [F.desc("id")], topic="A").first().id == "4"
    assert {r.id for r in lookups.matching_in_form(q, X.turkish_small, subject="TARİH").collect()} == {"1", "2", "3", "4"}
    grades = lookups.topics_of_grades(spark.createDataFrame([("TYT", "a"), ("AYT", "b")], "exam string, topic string"), spark.createDataFrame([(10,), (11,), (None,)], "grade int"))
    assert {(r.grade, r.topic) for r in grades.collect()} == {(10, "a"), (11, "b")}


def test_choices_between_sources(spark):
    a = spark.createDataFrame([(1, None), (2, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b"), (3, "c"), (3, "b")], "k int, v string")
    assert {(r.k, r.v, r.source_rank) for r in lookups.preferred([a, b], ["k"], "v").collect()} == {(1, "b", 1), (2, "a", 0), (3, "b", 1)}
    parts = spark.createDataFrame([("t", 2, "late"), ("t", 1, "first"), ("t", 0, None), ("u", 1, None), (None, 1, "x")], "topic string, n int, v string")
    assert rows_of(lookups.by_topic({"v": (parts, "v")}, "topic", "n")) == [("t", "first")]
    ids = spark.createDataFrame([("p", "c\u0327", "READY", 5), ("p", "\u00e7", None, 2), ("p", "b", "NO", 1), ("q", "b", None, 3), ("q", None, "READY", 4)], "g string, id string, s string, n int")
    assert rows_of(lookups.ready_or_all(ids, "g", "id", [F.col("s")], "n")) == [("p", "\u00e7", 5), ("q", "b", 3)]
    listed = lookups.in_listed_order(spark.createDataFrame([(1, ["z", "x", "y", "x"]), (2, None)], "k int, refs array<string>"), "k", "refs", spark.createDataFrame([("x", "a" * 120), ("y", "short"), ("z", "b" * 130)], "page string, text string"), "page", "text")
    assert rows_of(listed) == [(1, "x", 2), (1, "z", 1)]


def test_unpivoted_and_back(spark):
    row = spark.createDataFrame([(1, "q", ["a", None, "c"]), (2, None, None), (3, "", [])], "id int, question string, choices array<string>")
    flat = lookups.unpivoted(row, "id", ["question"], ["choices"])
    assert rows_of(flat) == [(1, "choices[0]", "a"), (1, "choices[2]", "c"), (1, "question", "q"), (3, "question", "")]
    back = flat.join(row, "id").select(lookups.path_value("", F.col("path"), ["question"], ["choices"]).eqNullSafe(F.col("text")).alias("same"))
    assert back.filter("not same").count() == 0


def test_partners_are_told(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "r")], "k int, w string")
    told = review.joined_or_told(left, right, ["k"])
    assert {(r.v, r.w, r.error) for r in told.collect()} == {("a", "r", None), ("b", None, "missing"), ("c", None, "missing")}
    assert review.or_raise(told.filter("k = 1")).count() == 1
    with pytest.raises(PySparkException):
        review.or_raise(told).collect()
    decisions = spark.createDataFrame([(1, "YES"), (2, "NO"), (2, "YES"), (9, "YES"), (None, "NO")], "k int, d string")
    assert {(r.v, r.d) for r in review.applied(left, decisions, "k", "d").collect()} == {("a", "YES"), ("b", "REPEATED"), ("c", "PENDING")}
    assert {r.k for r in review.unknown(decisions, left, "k").collect()} == {9, None}
    out = review.carried(left, right, "k", {"long": F.length("w") > 3})
    assert {(r.v, r.status, tuple(r.errors)) for r in out.collect()} == {("a", "BLOCKED", ("long",)), ("b", "BLOCKED", ("original",)), ("c", "BLOCKED", ("original",))}
    assert {(r.v, r.now) for r in review.reconciled(left, right, "k").collect()} == {("a", "RELEASED"), ("b", "SUSPENDED"), ("c", "SUSPENDED")}
    assert rows_of(review.unique_checks(spark.createDataFrame([(1,), (1,), (1,), (None,), (None,)], "k int"), {"once": ["k"]})) == [("once", 2, 3)]
    assert rows_of(review.unique_checks(left.limit(0), {"once": ["k"]})) == [("once", 0, 0)]


def test_row_hash_parts_null_from_empty(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), ("a", "-"), ("a", None)], "x string, y string").select(review.row_hash(["x", "y"]).alias("h"))
    assert rows.distinct().count() == 3


def test_unsafe_expressions(spark):
    texts = ["x**2 + 1", "Open(1)", "opening", "a.__b", "OS.system", "sys .x", "lambda: 1", "sub process", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.is_safe_expression(F.col("t")))
    assert [r[0] for r in rows.collect()] == [True, False, True, False, False, True, False, True, None]


def test_two_page_readers():
    page = "<html><head><title>Ba\u015fl\u0131k</title><style>p</style></head><body><noscript>n</noscript><p>iki  bo\u015fluk</p><template>t</template></body></html>"
    assert pages.plain_lines(page) == "Ba\u015fl\u0131k\niki  bo\u015fluk\nt"
    assert pages.seen(page) == ("iki bo\u015fluk", "Ba\u015fl\u0131k", "")
    assert pages.plain_lines(None) == "" and pages.plain_lines("<p>a") == "a"


def test_sums_from_the_index_are_the_scores(spark):
    """Points summed from what is found in a page are those of each pair scored on its own."""
    fill = " dolgu" * 25
    topics = spark.createDataFrame([(1, "Roma Cumhuriyeti", ["senato ve halk", "k\u00f6lelik d\u00fczeni kurallar"]), (2, "Bizans Toplumu", None), (3, "Lale Devri", ["", "senato ve halk"])], "k int, topic string, subs array<string>")
    docs = spark.createDataFrame(
        [(1, "ROMA CUMHUR\u0130YET\u0130 senato ve halk" + fill), (2, "k\u00f6lelik d\u00fczeni \u0130\u00e7indekiler" + fill), (3, "Bizans roma"), (4, None), (5, ""), (6, "lale devri roma bizans toplumu" + fill * 6), (6, "lale devri roma bizans toplumu" + fill * 6)],
        "id int, text string",
    )
    got = {(r.k, r.id): (r.score, r.support) for r in scoring.topic_page_sums(docs.distinct(), "id", "text", topics, "k", "topic", "subs").collect()}
    pairs = docs.distinct().filter("text is not null").join(topics, F.col("k") > 0).select("k", "id", scoring.topic_page_score(F.col("text"), F.col("topic"), F.col("subs")).alias("s")).collect()
    want = {(r.k, r.id): (r.s.score, r.s.support) for r in pairs}
    assert got and all(want[p] == s for p, s in got.items()) and all(want[p][1] == 0 for p in want.keys() - got.keys())
    assert scoring.topic_page_sums(docs.limit(0), "id", "text", topics, "k", "topic", "subs").count() == 0
