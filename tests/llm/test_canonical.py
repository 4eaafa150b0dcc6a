import random
import time

import pytest

from kavak.llm.canonical import HELD, NONE, SHORT, SOME, WHOLE, Entries, Trie, folded, mapped_values, near_values

LIST = [(1, "Hitit Hukuku"), (2, "Osmanlı Kuruluş Dönemi"), (3, "Osmanlı Yükselme Dönemi"), (4, "Rönesans ve Reform"), (5, "Asya Hunları"), (6, "Avrupa Hunları"), (7, "Sanayi İnkılabı")]


def meant(entries, typed):
    near = entries.nearest(typed)
    return near[1] if near and near[2] else NONE


@pytest.mark.parametrize(
    ("typed", "number"),
    [
        ("hitit hukuku", 1), ("HİTİT HUKUKU", 1), ("Hukuku Hitit", 1), ("hitt hukuku", 1), ("hiitt hukuki", 1), ("hit. huk.", 1), ("Hitit_Hukuku!", 1), ("tyt Hitit Hukuku test 4", 1),
        ("Ünite 3: hitit hukuku", 1), ("osmanlı kuruluş", 2), ("Kuruluş Dönemi Osmanlı", 2), ("osm. yük. dön.", 3), ("osmanlı dönemi", NONE), ("ronesans reform", 4), ("avr hun", 6),
        ("Sanayi Casusluğu", NONE), ("Osmanlı Mutfak Kültürü", NONE), ("hukuku", NONE), ("", NONE), ("???", NONE), ("x", NONE), ("test", NONE), (None, NONE), ("hititHukuku 3", 1), ("ronesans v reform", 4),
    ],
)
def test_meant(typed, number):
    assert meant(Entries(LIST), typed) == number


def test_every_entry_is_reached_by_its_small_letters():
    """No word is special: names made of words that often stand around others are names as well."""
    names = [(1, "Test Teknikleri"), (2, "Video Kurgu"), (3, "Konu 2"), (4, "Soru Bankası Çözümü"), (5, "Tarih Bölümü"), (6, "1. Ünite"), (7, "Sınav")]
    entries = Entries(names)
    for n, name in names:
        for typed in (name, name.lower(), " ".join(reversed(name.split())), f"{name.lower()} deneme 4"):
            assert meant(entries, typed) == n, typed


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_brute_force():
    """Every string within the edits comes out, with its edits."""
    strings = [(n, " ".join(folded(name))) for n, name in LIST] + [(n + 10, w) for n, w in enumerate("ve su ag agi tas taslar hunlar hunlari".split())]
    trie, rng = Trie(strings), random.Random(2)
    for _ in range(400):
        value = list(rng.choice(strings)[1])
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(value) + 1)
            if rng.random() < 0.3 and k + 1 < len(value):
                value[k], value[k + 1] = value[k + 1], value[k]
            else:
                value[k : k + 1] = rng.choice(([], [rng.choice("abc ")], [*value[k : k + 1], "x"]))
        value = "".join(value)
        for most in range(5):
            assert trie.near(value, most) == {n: osa(value, s) for n, s in strings if osa(value, s) <= most}


def test_kinds():
    entries = Entries(LIST)
    kind = lambda typed, n: entries.within(typed)[n].kind
    assert [kind("hukuku hitit", 1), kind("hitit hukuku test", 1), kind("osmanlı kuruluş 3", 2), kind("hit huk", 1)] == [WHOLE, HELD, SOME, SHORT]
    assert set(entries.within("osmanlı dönemi")) == {2, 3}


def test_ten_thousand_long_names():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcçdefgğhıijklmnoöprsştuüvyz") for _ in range(rng.randrange(3, 10)))
    names = [(i, " ".join(word() for _ in range(12))) for i in range(10_000)]
    began = time.time()
    entries = Entries(names)
    assert time.time() - began < 30
    for i, name in rng.sample(names, 20):
        words = name.split()
        rng.shuffle(words)
        assert meant(entries, " ".join(words)) == i and meant(entries, "x" + name) == i


@pytest.mark.parametrize("piece", [10_000, 3])
def test_mapped(spark, piece):
    ref = spark.createDataFrame(LIST + [(9, None)], "topic_no int, topic string")
    rows = spark.createDataFrame(
        [(1, "Hitit Hukuku", 5), (2, "hitit hukuku", 5), (2, "hitit hukuku", 6), (3, None, 5), (4, "  ", 5), (5, "a" * 200_000, 5), (6, "Hitit Hukuk", 5), (7, "osmanlı dönemi", 5), (8, "avr hunları", 5)],
        "log_id long, topic string, topic_no int",
    )
    got = sorted(tuple(r) for r in mapped_values(rows, "log_id", "topic", ref, "topic_no", "topic", piece).collect())
    assert got == [(2, 1), (4, NONE), (5, NONE), (6, 1), (7, NONE), (8, 6)]
    assert mapped_values(rows.limit(0), "log_id", "topic", ref, "topic_no", "topic").count() == 0
    assert {r.topic_no for r in mapped_values(rows, "log_id", "topic", ref.limit(0), "topic_no", "topic").collect()} == {NONE}
    near = sorted(tuple(r) for r in near_values(rows.drop("topic_no"), "topic", ref.withColumnRenamed("topic", "name"), "topic_no", "name", piece).collect())
    assert ("osmanlı dönemi", 2, 0, "some") in near and ("osmanlı dönemi", 3, 0, "some") in near and ("Hitit Hukuk", 1, 0, "short") in near
    assert near_values(rows.limit(0), "topic", ref.withColumnRenamed("topic", "name"), "topic_no", "name").count() == 0


def test_a_hot_value(spark):
    ref = spark.createDataFrame(LIST, "topic_no int, topic string")
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hitit hukku', concat('asya hunlari ', id)) topic")
    got = {(r.topic_no, r["count"]) for r in mapped_values(rows, "id", "topic", ref, "topic_no", "topic").groupBy("topic_no").count().collect()}
    assert got == {(1, 1000), (5, 2000)}
