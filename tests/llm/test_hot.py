"""Frequent keys and many languages: the same results as the plain way."""

import random

from frametide.llm import common, rules


def test_look_up(spark, monkeypatch):
    """Frequent keys by broadcast, others by a join, keys that the table lacks and null keys without its columns."""
    rng = random.Random(1)
    rows = [(i, 7 if i % 3 == 0 else None if i % 11 == 0 else rng.randrange(60), "x") for i in range(600)]
    table = {k: f"n{k}" for k in range(0, 60, 2)} | {7: "seven"}
    left = spark.createDataFrame(rows, "id long, key int, other string")
    right = spark.createDataFrame(list(table.items()), "key int, name string")
    want = sorted((i, k, "x", table.get(k)) for i, k, _ in rows)
    for hot in (1, 4, 40, 1 << 20):  # none is frequent; one; many; all
        monkeypatch.setattr(common, "HOT_KEYS", hot)
        got = common.look_up(left, right, "key")
        assert sorted(tuple(r) for r in got.select("id", "key", "other", "name").collect()) == sorted(want), hot
    assert common.look_up(left.limit(0), right, "key").count() == 0
    assert common.look_up(left, right.limit(0), "key").where("name is not null").count() == 0


def test_references_in_little_memory(spark, monkeypatch):
    """A task lets go of its counts when all languages together have many words; sums are the same."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(40)), f"l{i % 50}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    whole = rules.references(df)
    monkeypatch.setattr(rules, "FLUSH", 100)
    parts = rules.references(df)
    assert whole.keys() == parts.keys() and len(whole) == 50
    for lang in whole:
        assert whole[lang][1] == parts[lang][1] and (whole[lang][0] == parts[lang][0]).all() and (whole[lang][2] == parts[lang][2]).all()
