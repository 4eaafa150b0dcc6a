import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kavak.llm.plain import plain, plain_many
from kavak.llm.unlike import not_plain, plain_column, plain_forms


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Мaуa", "Maya"),  # mixed scripts
        ("bu іѕе son", "bu ise son"),  # a whole word in look-alikes
        ("АТР molekülü", "ATP molekülü"),
        ("“дыхание” ve “φύλλο”", "“дыхание” ve “φύλλο”"),
        ("Δt ile α-amilaz, λ", "Δt ile α-amilaz, λ"),
        ("В образце а клетка", "В образце а клетка"),
        ("сельe", "селье"),  # a Latin letter in a word that only Cyrillic spells
        ("Ｄöｎｅｍ １２", "Dönem 12"),
        ("ürün i̇le Şehir", "ürün ile Şehir"),
        ("ı i I İ", "ı i I İ"),
        ("a b c d", "a b c d"),
        ("gli­ko​z﻿⁠", "glikoz"),
        ("haﬁf oﬂ", "hafif ofl"),
        ("a‐b‑c — d – e…", "a-b-c — d – e…"),
        ("CO₂ m² ½ °C «x» “y” â î", "CO₂ m² ½ °C «x» “y” â î"),
        ("K", "K"),
        ("", ""),
        (None, None),
    ],
)
def test_plain(text, expected):
    assert plain(text) == expected


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_plain_is_a_projection(text):
    once = plain(text)
    assert plain(once) == once


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=10))
def test_many_is_each(texts):
    assert plain_many(texts) == [plain(t) for t in texts]


def test_columns(spark):
    rows = spark.createDataFrame([(1, "düz", None, "x"), (2, "bi̇r", "аb", "y"), (2, "bi̇r", "", "y"), (3, None, "z" * 100_000 + "​", "w")], "record_no long, evidence_text string, outcome_title string, field string")
    got = sorted(tuple(r) for r in not_plain(rows, "record_no", ["evidence_text", "outcome_title"]).collect())
    assert got == [(2, "evidence_text"), (2, "evidence_text"), (2, "outcome_title"), (3, "outcome_title")]
    forms = {(r.record_no, r.field): r.plain for r in plain_forms(rows, "record_no", ["evidence_text", "outcome_title"]).collect()}
    assert forms[(1, "evidence_text")] == "düz" and forms[(3, "outcome_title")] == "z" * 100_000 and (1, "outcome_title") not in forms
    assert [r[0] for r in rows.orderBy("record_no").select(plain_column("evidence_text")).collect()][0] == "düz"
    assert not_plain(rows.limit(0), "record_no", ["evidence_text"]).count() == 0
