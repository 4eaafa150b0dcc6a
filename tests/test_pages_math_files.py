import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from kavak.functions import mathcheck, pages
from kavak.sources import files, sinks


def test_visible_text(spark):
    html = "<title>Baş &amp; Lık</title><h1>Giriş</h1><p>gör</p><script>gizli()</script><noscript>yok</noscript><p>son</p>"
    text, title, heads = pages.seen(html)
    assert text == "Giriş\ngör\nson" and title == "Baş & Lık" and heads == "Giriş" and pages.seen(None) == ("", "", "")
    assert pages.code_text("<pre><code>a&nbsp;<b>b</b></code></pre> <pre><code>c</code></pre>") == "a b\n\nc"
    df = spark.createDataFrame([(html,), (None,)], "h string")
    assert [r.s.text for r in df.select(pages.visible_text(F.col("h")).alias("s")).collect()] == ["Giriş\ngör\nson", ""]
    got = pages.fingerprint(html, frozenset({"son"}))
    assert got["terms"] == ["bas", "giris", "gor", "lik"] and got["heading_terms"] == ["giris"]
    assert df.select(pages.html_fingerprints(F.col("h"), ["son"]).alias("s")).first().s.title_terms == ["bas", "lik"]


def test_json_hash(spark):
    a, b = '{"b": 1, "a": "ş", "h": 2}', '{"a":"ş","b":1}'
    assert pages.canonical_hash(a, "h") == pages.canonical_hash(b) and pages.canonical_hash("{") is None
    df = spark.createDataFrame([(a,), (None,)], "j string")
    assert [r[0] for r in df.select(pages.json_hash(F.col("j"), "h")).collect()] == [pages.canonical_hash(b), None]


def test_archives(spark, tmp_path):
    def make(name, members):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for m in members:
                z.writestr(zipfile.ZipInfo(m), "x")
        (tmp_path / name).write_bytes(buffer.getvalue())

    make("Kitap.zip", ["k/basic-html/page1.html", "k/basic-html/page2.html", "k/other.txt"])
    make("Kitap (1).zip", ["k/basic-html/page1.html", "k/basic-html/page2.html", "k/other.txt"])
    make("dev-1.zip", [])
    make("Yeni.zip", ["boş.txt"])
    make("Bilinmez.zip", ["ad.txt"])
    got = {r.path.rsplit("/", 1)[1].replace("%20", " "): (r.pages, r.status) for r in files.archives(spark, str(tmp_path), ["kitap", "yeni"]).collect()}
    assert sorted(s for n, (p, s) in got.items() if n.startswith("Kitap")) == ["duplicate", "valid"]
    assert got["dev-1.zip"][1] == "development" and got["Yeni.zip"] == (0, "empty") and got["Bilinmez.zip"][1] == "unknown"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("../basic-html/page1.html", "x")
    with pytest.raises(ValueError):
        pages.members(buffer.getvalue())


def test_json_tables(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "questions.json").write_text(json.dumps([{"id": "q1", "topic": "Limit"}, {"id": "q2"}]), encoding="utf-8-sig")
    (tmp_path / "questions.json").write_text("{broken")
    (tmp_path / "progress.json").write_text(json.dumps({"topics": {"a": {"attempts": 2, "best_score": 9.0, "last_score": 1.0}}}))
    (tmp_path / "manifest.json").write_text(json.dumps({"version": "1", "units": [{"unit_id": "u", "record_id": "r"}]}))
    rows = files.json_table(spark, str(tmp_path), "questions", "questions.json")
    assert sorted(r.id for r in rows.filter("id is not null").collect()) == ["q1", "q2"]
    assert files.broken_files(spark, str(tmp_path), "questions.json").count() == 1
    assert tuple(files.progress_rows(files.json_table(spark, str(tmp_path / "progress.json"), "progress")).first()) == ("a", 2, 9.0, 1.0)
    assert files.units(files.json_table(spark, str(tmp_path / "manifest.json"), "manifest"), "units").first().unit_id == "u"


def test_page_folder(spark, tmp_path):
    for folder in ("Kitap", "Kitap (1)"):
        (tmp_path / folder).mkdir()
        for n in (1, 3):
            (tmp_path / folder / f"page{n}.html").write_text(f"<pre><code>{folder} {n}</code></pre>")
    rows = files.page_folder(spark, str(tmp_path))
    assert {(r.package_id, r.page, r.text) for r in rows.collect()} == {("kitap", 1, "Kitap 1"), ("kitap", 3, "Kitap 3")}
    assert files.package_summary(rows).filter("package_id is null").first().pages == 2
    assert [tuple(r) for r in files.missing_numbers(rows, "package_id", "page").collect()] == [("kitap", 2)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    p = str(tmp_path / "t")
    assert sinks.append_new(rows, p, "id") == 2 and sinks.append_new(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), p, "id") == 1
    assert spark.read.parquet(p).count() == 3
    with pytest.raises(Exception):
        sinks.write(rows, p)
    sinks.write(rows, p, "keep")
    assert spark.read.parquet(p).count() == 3
    sinks.write(rows, p, "replace")
    assert spark.read.parquet(p).count() == 2
    log = str(tmp_path / "log")
    sinks.append_record(spark, log, "Tarih", "Roma", 30)
    sinks.append_record(spark, log, "Tarih", "Roma", 30, 80.0)
    assert spark.read.parquet(log).count() == 2
    told = sinks.write_units(rows, str(tmp_path / "u"), "id", F.col("t") == "a")
    assert {(r.id, r.written) for r in told.collect()} == {(1, True), (2, False)}
    assert sinks.patched(rows, {"t": F.lit("z")}).first().verified is False


@pytest.mark.parametrize(
    ("check", "expected"),
    [
        ({"type": "arithmetic", "expression": "2^3 + 1/2", "expected": "17/2"}, "PASS"),
        ({"type": "arithmetic", "expression": "2+2", "expected": "5"}, "FAIL"),
        ({"type": "equation", "expression": "x^2 - 5*x + 6", "rhs": "0", "expected": "[3, 2]"}, "PASS"),
        ({"type": "equation", "expression": "x^2 - 2", "rhs": "0", "expected": "[1]"}, "UNVERIFIED"),
        ({"type": "polynomial_remainder", "polynomial": "x^3 + 2*x", "divisor_root": "2", "expected": "12"}, "PASS"),
        ({"type": "function_value", "expression": "3*x - 1", "lower": "4", "expected": "11"}, "PASS"),
        ({"type": "function_range", "expression": "x^2", "lower": "-1", "upper": "2", "expected": "[0, 4]"}, "PASS"),
        ({"type": "combination", "lower": "5", "upper": "2", "expected": "10"}, "PASS"),
        ({"type": "permutation", "lower": "5", "upper": "2", "expected": "20"}, "PASS"),
        ({"type": "trigonometric_value", "expression": "sin(30°)", "expected": "1/2"}, "PASS"),
        ({"type": "distance_2d", "lower": "(0, 0)", "upper": "(3, 4)", "expected": "5"}, "PASS"),
        ({"type": "indefinite_integral", "expression": "2*x", "expected": "x^2 + C"}, "PASS"),
        ({"type": "definite_integral", "expression": "x", "lower": "0", "upper": "2", "expected": "2"}, "PASS"),
        ({"type": "inequality", "expression": "x > 2"}, "UNVERIFIED"),
        ({"type": "arithmetic", "expression": "__import__('os')", "expected": "0"}, "UNVERIFIED"),
        ({"type": None}, "UNVERIFIED"),
    ],
)
def test_mathematics(check, expected):
    assert mathcheck.review(check) == expected


def test_mathematics_column(spark):
    rows = spark.createDataFrame([(("arithmetic", "1+1", "2"),), (("arithmetic", None, "2"),)], "c struct<type:string,expression:string,expected:string>")
    assert [r[0] for r in rows.select(mathcheck.reviewed(F.col("c"))).collect()] == ["PASS", "UNVERIFIED"]
