import random
import re

import pytest

from kavak.llm import leaks as module
from kavak.llm.leaks import containments, leaks


def words(t):
    return re.findall(r"[^\W_]+", (t or "").replace("&nbsp;", " ").replace("İ", "i").replace("I", "i").replace("ı", "i").lower())


@pytest.mark.parametrize("sent", [module.SENT, 0])
def test_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(module, "SENT", sent)
    rng = random.Random(1)
    vocab = [f"söz{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 60)))) for i in range(30)]
    docs = []
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        if d % 2:
            src = rng.choice(items)[1].split()
            a = rng.randrange(len(src))
            part = src[a : a + rng.randrange(6, 16)]
            k = rng.randrange(len(w) + 1)
            w[k:k] = [x.upper() if rng.random() < 0.2 else x for x in part]
        docs.append((d, rng.choice([" ", "\n", "&nbsp;", ", "]).join(w)))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1])]
    held = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 9):
            held.setdefault(tuple(w[k : k + 10]), set()).add(i)
    true = {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - 9) for i in held.get(tuple(w[k : k + 10]), ())}
    rows = leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()
    assert {tuple(r) for r in rows} == true and len(rows) == len(true) and true


def test_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert leaks(docs, "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaks(docs.limit(0), "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


@pytest.mark.parametrize("sent", [module.SENT, 0])
def test_containment(spark, monkeypatch, sent):
    """The share of an item's passages, each counted once however often it stands."""
    monkeypatch.setattr(module, "SENT", sent)
    item = [f"kelime{i}" for i in range(29)]
    docs = [(1, " ".join(item)), (2, " ".join(item[:10] + ["ara"] + item[:10])), (3, " ".join(item[:9])), (4, " ".join(item[5:20])), (5, None)]
    rows = containments(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame([(7, " ".join(item)), (8, "kısa")], "item_id long, text string"), "item_id", "text").collect()
    assert {(r.doc_id, r.item_id, r.shared, r.passages, round(r.containment, 3)) for r in rows} == {(1, 7, 20, 20, 1.0), (2, 7, 1, 20, 0.05), (4, 7, 6, 20, 0.3)}
