from pyspark.sql import functions as F

from kavak.operators import reshape as R

REGISTRY = "grade_records array<struct<grade:int,themes:array<struct<theme_number:int,theme_name:string,content_framework:string,learning_outcomes:array<struct<id:string,title:string,source_page:int>>>>>>"


def test_registry_there_and_back(spark):
    data = [([(9, [(1, "Düzen", "çerçeve", [("B.9.1", "ilk", 3), ("B.9.2", "iki", 4)]), (2, "Akış", None, [])]), (10, None)],), (None,)]
    rows = R.outcome_rows(spark.createDataFrame(data, REGISTRY))
    assert sorted((r.grade, r.outcome_id, r.theme_name) for r in rows.collect()) == [(9, "B.9.1", "Düzen"), (9, "B.9.2", "Düzen")]
    back = R.nested_outcomes(rows).first()
    assert back.grade == 9 and [o.id for o in back.themes[0].learning_outcomes] == ["B.9.1", "B.9.2"]


def test_pages_and_text(spark):
    corpus = spark.createDataFrame([([("A", [(1, "bir", "x"), (2, None, None)]), ("B", [(1, "öte", "y")])],)], "packages array<struct<package_id:string,pages:array<struct<page:int,text:string,source_anchor:string>>>>")
    rows = R.page_rows(corpus, ["A"])
    assert sorted((r.package_id, r.page, r.text) for r in rows.collect()) == [("A", 1, "bir"), ("A", 2, "")]
    assert R.full_text(rows, "package_id", "page", "text").first().full_text == "[[PAGE:1]]\nbir\n[[PAGE:2]]\n"
    assert R.page_rows(corpus.limit(0)).count() == 0


def test_blocks_frames_claims(spark):
    text = spark.createDataFrame([(1, "ön BİY.9.1. ilk çıktı BİY.9.2. ikinci"), (2, None), (3, "")], "id int, t string")
    got = R.blocks(text, "id", "t", r"(BİY\.\d+\.\d+)\.").orderBy("place").collect()
    assert [(r.code, r.block) for r in got] == [("BİY.9.1", "BİY.9.1. ilk çıktı"), ("BİY.9.2", "BİY.9.2. ikinci")]
    at = spark.createDataFrame([("a", 5), ("a", 1)], "k string, s int")
    assert [(r.s, r.ends) for r in R.frames(at, ["k"], [F.col("s")], "s").orderBy("s").collect()] == [(1, 5), (5, None)]
    claims = spark.createDataFrame([(1, "rule", 2, "b"), (1, "rule", 1, "a"), (1, "other", 3, "x"), (2, "definition", 1, "d")], "id int, kind string, n int, t string")
    out = {r.id: (r.rule, r.definition) for r in R.routed(claims, "id", ["rule", "definition"], "kind", "n", "t").collect()}
    assert out == {1: (["a", "b"], []), 2: ([], ["d"])}
    items = spark.createDataFrame([([("a", "r")],)], "items array<struct<text:string,refs:string>>")
    assert R.without_field(items, "items", "refs").first()["items"][0].asDict() == {"text": "a"}
