"""All stages of the corpus pipeline on a small table with nulls, repeats and columns of any name, and operators on odd tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from frametide.llm import decontaminate, html, jaccard, language, packing, quality, rules, secrets, substring, warc

EN = "the cat and the dog are here with that other one who was there before all of us came along to see it".split()
FR = "le chat et le chien sont ici avec les autres qui ont vu la maison dans une rue pour nous tous ce matin".split()


def _rows():
    rng = random.Random(11)
    text = lambda some, n: " ".join(rng.choice(some) + ("" if rng.random() < 0.8 else str(rng.randrange(50))) for _ in range(n))
    rows = []
    for i in range(90):
        some, lang = ((EN, "en"), (FR, "fr"))[i % 2]
        rows.append((i, text(some, 150), lang, "s", 0))
    long = rows[10][1].split()
    rows.append((200, " ".join(long[:75] + ["changed"] + long[76:]), "en", "s", 0))  # near copy
    rows.append((201, rows[11][1], "fr", "s", 0))  # copy
    rows.append((202, text(EN, 60) + " what is the seventh planet from the sun called by most people " + text(EN, 60), "en", "s", 0))
    rows.append((203, text(EN, 40) + " key Zx9Qw3Er7Ty1Ui5Op2As6Df4Gh8Jk0 " + text(EN, 40), "en", "s", 0))
    rows += [(204, None, None, None, None), (205, "", "en", None, 0), (206, "12 34 !!", None, "s", 8), (None, text(FR, 100), None, "s", 0), (207, text(EN, 4000), "en", "s", 0)]
    rows += [rows[3], rows[3]]
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(_rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, "What is the seventh planet from the Sun called by most people?"), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.collect()
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    # language: what has no letter goes, clean documents stay
    kept = corpus_pipeline.materialize(steps["language"](spark, docs, sf_dir), "t")
    assert kept.columns == docs.columns and kept.count() == len([r for r in before if re.search("[a-z]", r["text"] or "")])
    # near duplicates: against a plain join; the least id of each group stays, once
    words = lambda t: t.lower().split()
    sets = {(r["doc_id"], r["text"]): {tuple(words(r["text"])[i : i + 5]) for i in range(len(words(r["text"])) - 4)} for r in kept.collect()}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = sorted((k for k in sets if not any(o[0] is not None and (k[0] is None or o[0] < k[0]) and linked(k, o) for o in sets)), key=str)
    one = corpus_pipeline.materialize(steps["near_duplicates"](spark, kept, sf_dir), "t")
    assert sorted(((r["doc_id"], r["text"]) for r in one.collect()), key=str) == want and 200 not in {k[0] for k in want} and 201 not in {k[0] for k in want}
    clean = corpus_pipeline.materialize(steps["decontamination"](spark, one, sf_dir), "t")
    assert {r["doc_id"] for r in one.collect()} - {r["doc_id"] for r in clean.collect()} == {202} and clean.columns == docs.columns
    safe = corpus_pipeline.materialize(steps["secrets"](spark, clean, sf_dir), "t")
    texts = {r["doc_id"]: r for r in safe.collect()}
    assert safe.columns == docs.columns and "[SECRET]" in texts[203]["text"] and "Zx9Q" not in texts[203]["text"] and texts[203]["n_chars"] == len(texts[203]["text"]) and texts[0]["text"] == before_text(before, 0)
    packed = steps["packing"](spark, safe, sf_dir).collect()
    assert Counter(p["doc_id"] for p in packed).keys() == texts.keys() and sum(p["length"] for p in packed) == sum({p["doc_id"]: p["doc_tokens"] for p in packed}.values())
    # run() gives the same documents
    assert {p["doc_id"] for p in corpus_pipeline.run(spark, sf_dir).collect()} == set(texts)


def before_text(rows, doc_id):
    return next(r["text"] for r in rows if r["doc_id"] == doc_id)


def test_columns_of_any_name(spark):
    """Stages pass columns through whatever they are called; empty tables give empty tables."""
    names = ["_k1", "_id", "stays", "_base", "_spans", "_n", "part", "label", "id", "h"]
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, " ".join(rng.choice(EN) for _ in range(60)), "en", *range(10)) for i in range(12)], "doc_id long, text string, lang string, " + ", ".join(f"{n} long" for n in names))
    bench = spark.createDataFrame([(1, "no such words at all in any of these few documents here")], "item_id long, text string")
    for step in (language.keep_identified, jaccard.keep_one, lambda d: decontaminate.remove_documents(d, bench), secrets.redact):
        got = step(rows)
        assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
        assert step(rows.limit(0)).columns == rows.columns and step(rows.limit(0)).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert quality.classify(docs, quality.fit(docs, labels)).count() == 0 == rules.judge(docs).count() == html.extract_pages(pages).count()
    assert packing.pack(docs).count() == 0 == secrets.digests(docs).count() == substring.dedup(docs).count() == language.classify(docs).count() == warc.write(pages).read(pages).count()


def test_rules_against_plain_counts(spark):
    """The base counts of every row by plain code, with nulls, repeated lines and words, symbols and characters beyond ASCII."""
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice(["a", "é", "日本", "#x", "$5", "<b>", "und", "the"]) for _ in range(rng.randint(0, 6)))
    texts = [None, "", " \n ", "a b c a b c a b c", "x\ny\nx\n\n x\nx"] + ["\n".join(line() for _ in range(rng.randint(1, 30))) for _ in range(40)]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        repeat = {j + d for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, t


def test_quality_network_against_loops():
    """Scores of short and long texts by plain loops over bytes, filters and chunks."""
    rng = np.random.default_rng(1)
    net = quality.Net.new()
    net.bias[:], net.weights[:], net.offset[:] = rng.normal(size=net.bias.shape), rng.normal(size=net.weights.shape), 0.3
    for n in (0, 5, 200, 600, 1500):
        text = bytes(rng.integers(32, 127, n).astype(np.uint8))
        halves = -(-(n + quality.WIDTH) // quality.HALF)
        padded = text.ljust(halves * quality.HALF, b"\0") + bytes(quality.WIDTH)
        at = lambda i: np.concatenate([net.embed[b] for b in padded[i : i + quality.WIDTH]]) @ net.filters
        top = [np.max([at(h * quality.HALF + p) for p in range(0, quality.HALF, quality.STRIDE)], 0) for h in range(halves)]
        chunks = [np.maximum(np.maximum(top[c], top[min(c + 1, halves - 1)]) + net.bias, 0) for c in range(max(halves - 1, 1))]
        x = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)]) @ net.weights + net.offset[0]
        assert quality.scores(net, [b"other", text])[1] == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-4)


def test_packing_many_short_documents():
    """Two hundred thousand short documents take seconds, and no sequence but the last ones has padding."""
    import time

    rng = np.random.default_rng(3)
    packer, out = packing.Packer(0), []
    began, total = time.time(), 0
    for i, n in enumerate(rng.integers(1, 400, 200_000).tolist()):
        packer.add(i, np.ones(n, "<u4"))
        total += n
        if packer.full():
            packer.pack()
            out += packer.take()
    packer.pack(last=True)
    out += packer.take()
    assert time.time() - began < 90 and sum(p[2] for p in out) == total
    fill = Counter()
    for p in out:
        fill[p[5], p[7]] += p[2]
    assert sum(tier - n for (_, tier), n in fill.items()) < packing.TIERS[0]
