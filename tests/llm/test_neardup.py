import random
import re

import pytest

from kavak.llm import neardup
from kavak.llm.neardup import alike, all_pairs, links

SCHEMA = "id long, t string, size int"


def shingles(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"kelime{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(40, 120))))
    for _ in range(n):
        w = rng.choice(texts).split()
        for _ in range(rng.randrange(0, 12)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice(([], [rng.choice(words)], [w[k], rng.choice(words)]))
        if rng.random() < 0.3:
            cut = len(w) // 2
            w = w[cut:] + w[:cut]
        texts.append(" ".join(w))
    return texts


def brute(texts, threshold):
    sets = [shingles(t) for t in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12}


@pytest.mark.parametrize("common", [neardup.COMMON, 12])
def test_pairs_are_brute_force(spark, monkeypatch, common):
    """Texts of 40 to 120 words with up to a dozen edits each, half of them moved around."""
    monkeypatch.setattr(neardup, "COMMON", common)
    texts = corpus(4)
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA)
    pairs, members = alike(rows, "id", "t", 0.45)
    got = {tuple(r) for r in all_pairs(pairs, members).collect()}
    true = brute(texts, 0.45)
    assert got <= true and len(got) >= 0.99 * len(true)


def test_copies_are_one_class(spark):
    base = "Hücre zarı seçici geçirgendir ve madde alışverişini düzenler ayrıca hücreyi dış ortamdan ayırır ve korur her zaman böyle olur denir"
    rows = [(i, base, 0) for i in range(1000)] + [(2000, base.upper().replace("I", "I") + "!!", 0), (3000, None, 0), (3001, "kısa", 0), (3002, "", 0)]
    pairs, members = alike(spark.createDataFrame(rows, SCHEMA), "id", "t", 0.45)
    assert pairs.count() == 0
    got = links(pairs, members).collect()
    assert len(got) == 1001 and {r.class_id for r in got} == {0} and {r.members for r in got} == {1001}


def test_few_words_and_nothing(spark):
    long = "ğ" * 130
    rows = spark.createDataFrame([(1, long, 0), (2, long, 0), (3, "a" * 130 + " b", 0)], SCHEMA)
    pairs, members = alike(rows, "id", "t", 0.45)
    assert [tuple(r) for r in all_pairs(pairs, members).collect()] == [(1, 2)]
    pairs, members = alike(rows.limit(0), "id", "t", 0.45)
    assert all_pairs(pairs, members).count() == 0 and links(pairs, members).count() == 0


def test_one_family_of_a_third_of_all_rows(spark, monkeypatch):
    """No pair is lost, however many records share a run; also where common runs are joined in pieces."""
    rng = random.Random(8)
    words = [f"kelime{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(500):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice(([], [rng.choice(words)], [w[k], rng.choice(words)]))
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(1000)]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA)
    true = brute(texts, 0.45)
    for common in (neardup.COMMON, 100):
        monkeypatch.setattr(neardup, "COMMON", common)
        pairs, members = alike(rows, "id", "t", 0.45)
        assert {tuple(r) for r in all_pairs(pairs, members).collect()} == true
