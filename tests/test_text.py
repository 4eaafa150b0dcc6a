import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kavak.functions import scalars as S
from kavak.functions import text as X
from kavak.functions.keys import plain_key


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("fn", "value", "expected"),
    [
        (X.searchable, "İstanbul'un IŞIĞI", "istanbul un işiği"),
        (X.searchable, None, ""),
        (X.searchable, "so­ft ｗｉｄｅ", "soft wide"),
        (X.bare, "Işık Straße Çöl", "isik strasse col"),
        (X.bare_keeping_dotless, " Kızıl İz ", "kızıl iz"),
        (X.bare_words, "Kök-Hücre (II)", "kok hucre ii"),
        (X.turkish_small, "IŞIK  İLE", "ışık ile"),
        (X.keyword_small, "ÇIĞ çığ", "cig çığ"),
        (X.trimmed_small, None, "none"),
        (X.slug, "Kök Hücre!", "kok_hucre"),
        (X.unit_slug, " !! ", "unit"),
        (X.unit_slug, "BİY.9.1 Ünite", "biy.9.1-ünite"),
        (X.joined_lines, "devamlı-\nlığı\r\n\r\n\r\n\r\nson", "devamlılığı\n\nson"),
        (X.one_line, " - [[PAGE:3]] a   b : ", "a b"),
        (X.package_name, "Kitap (2)", "kitap"),
        (X.file_stem, "/a/b/Kitap (1).zip", "kitap"),
        (X.grade_number, "grade12", "12"),
        (X.math_text, "x^2 − √2π", "x**2 - sqrt2pi"),
        (X.root, "hücrelerinden", "hücre"),
        (X.root, "kök", "kök"),
    ],
)
def test_normalisers(spark, fn, value, expected):
    assert one(spark, value, fn) == expected


def test_tokens(spark):
    assert one(spark, "Bitki ve bitki hücresi", lambda c: X.search_tokens(c)) == ["bitki", "bitki", "hücresi"]
    assert one(spark, "Bitki ve bitki", lambda c: X.distinct_search_tokens(c)) == ["bitki"]
    assert one(spark, "izini", lambda c: X.question_tokens(c)) == ["izini", "izi"]
    assert one(spark, "a b", lambda c: X.bigrams(F.split(c, " "))) == ["a b"]
    assert one(spark, "a", lambda c: X.bigrams(F.split(c, " "))) == []
    assert one(spark, "açıklama kromozom", X.meaningful_roots) == ["kromozom"]
    assert one(spark, "", X.meaningful_roots) == []
    assert one(spark, "hücre", lambda c: X.roots_overlap(F.array(c), F.array(F.lit("hücreler")))) is True


def test_sentences(spark):
    text = "Kısa.\nhttps://x.example/uzun-bir-adres-daha\nBu cümle yeterince uzun bir cümledir. Bu parça ise kapanmadan süren çok uzun bir parça oldu"
    assert one(spark, text, X.sentences_of) == ["Bu cümle yeterince uzun bir cümledir."]


def model_searchable(value):
    value = unicodedata.normalize("NFKC", value).casefold().replace("̇", "").replace("ı", "i")
    value = re.sub("[­​‌‍﻿]", "", value)
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9çğıöşü\s]", " ", value)).strip()


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aAıIiİçÇşŞğĞüÜöÖ0 9.-\n", max_size=30), min_size=20, max_size=40))
def test_searchable_is_the_model(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", X.searchable(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n) for r in rows] == [(r.t, model_searchable(r.t)) for r in rows]


@pytest.mark.parametrize(
    ("value", "expected"),
    [("\u0412I\u041e10\u200d-S1 ", "bio10-s1"), ("B\u0130Y.9", "biy.9"), ("BI\u0307Y.9", "biy.9"), ("ＢＩＯ９", "bio9"), (None, None), ("  ", ""), ("s\u0327", "\u015f")],
)
def test_plain_key(spark, value, expected):
    assert one(spark, value, plain_key) == expected


def test_scalars(spark):
    assert one(spark, "x/page12.html", S.page_number) == 12
    assert one(spark, "index.html", S.page_number) is None
    assert one(spark, "page3.html page1.html page3.html page0.html", S.page_numbers) == [1, 3]
    assert one(spark, "https://a.example/x", lambda c: S.is_official_url(c, "a.example")) is True
    assert one(spark, "http://a.example/x", lambda c: S.is_official_url(c, "a.example")) is False
    assert one(spark, "not a url", lambda c: S.is_official_url(c, "a.example")) is False
    assert one(spark, "ön A: bir B: iki", lambda c: S.section(c, "A:", ["B:", "C:"])) == "bir"
    assert one(spark, "ön", lambda c: S.section(c, "A:", ["B:"])) == ""
    assert one(spark, "[[PAGE:1]] aa [[PAGE:2]] bb", lambda c: S.marked_page(c, F.lit(25))) == 2
    assert one(spark, "aa", lambda c: S.marked_page(c, F.lit(1))) is None
    assert one(spark, '```json\n{"a": 1}\n```', S.json_part) == '{"a": 1}'
    assert one(spark, "düz", S.json_part) is None
    assert one(spark, "жизнь", S.has_foreign_script) is True
    assert one(spark, "türev anlatır mısın", lambda c: S.without_phrase(c, ["anlatır mısın"])) == "Türev"
    for value, expected in ((39.9, "beginner"), (40, "basic"), (64, "basic"), (65, "intermediate"), (85, "advanced")):
        assert one(spark, str(value), lambda c: S.label(c.cast("double"), [(85, "advanced"), (65, "intermediate"), (40, "basic")], "beginner")) == expected
    assert one(spark, None, lambda c: S.label(c.cast("double"), [(1, "a")], "b")) is None
    assert one(spark, "0.6667", lambda c: S.confidence(c.cast("double"))) == "LOW"
    assert one(spark, "130", lambda c: S.share_of_hundred(c.cast("double"))) == 1.0


def test_distinct_values(spark):
    df = spark.createDataFrame([([" a", "b ", "a", "", None],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(X.distinct_values(F.col("v"))).collect()] == [["a", "b"], None]
