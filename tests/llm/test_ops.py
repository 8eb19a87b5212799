"""Small tables with nulls, empty and long texts, ties and repeats, held against plain versions."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frametide.llm import decontaminate, html, jaccard, language, packing, quality, rules, secrets, substring, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Été", "ß"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = some(120), some(60)
    near = base.split()
    near[50] = "other"
    out = [None, "", "  \t\n", "one", "a b", "A B", base, base, base.upper().lower(), " ".join(near), f"{some(30)} {passage} {some(30)}", f"{some(20)}\n{passage}", "x " * 300, some(5000), some(4), some(40)]
    out += [" ".join(w if rng.random() > 0.004 else "z" for w in base.split()) for _ in range(30)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 0) for i, t in enumerate(texts)] + [(None, texts[6], None, None, None), (5, "A B", "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_substring(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    seen = Counter(tuple(w[i : i + 35]) for w in (_words(r["text"]) for r in rows) for i in range(len(w) - 34))
    want = []
    for r in rows:
        w = _words(r["text"])
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((r["doc_id"], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    for how in ({}, {"hot": 1, "shard_words": 100}, {"map_bits": 3}):
        assert _rows(substring.dedup(docs, **how).select("doc_id", "n_words", "n_removed", "kept")) == sorted(want, key=str)


def test_substring_fm_index():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.append(rng.integers(1, 4, 40), 0) for _ in range(5)])
    index = substring.FMIndex(text, (text > 0).astype(np.int64))
    at = np.array([i for i in range(len(text) - 7) if (text[i : i + 7] > 0).all()])
    count = Counter(tuple(text[i : i + 7]) for i in at)
    assert index.search(text, at, 7, 2).tolist() == [count[tuple(text[i : i + 7])] > 1 for i in at]


def _linked(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(r["text"]) for r in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root(i)] = min(least.get(root(i), 1 << 60), r["doc_id"])
    return sorted(((r["doc_id"], len(sets[i]), least.get(root(i)) if sets[i] else r["doc_id"]) for i, r in enumerate(rows)), key=str)


def test_jaccard(spark, docs):
    want = _linked(docs.select("doc_id", "text").collect())
    for how in ({}, {"block_sets": 3}):
        assert _rows(jaccard.join(docs, **how)) == want


def test_jaccard_keep_one(spark, docs):
    """The least id of each component stays, with rows without shingles; other columns may have any name."""
    wide = docs.select("doc_id", "text", F.lit("x").alias("_id"), F.lit(1).alias("stays"))
    found = _linked(docs.select("doc_id", "text").collect())
    stay = {i for i, _, least in found if i == least}
    want = {(r["doc_id"], r["text"], "x", 1) for r in wide.collect() if r["doc_id"] in stay}
    assert len(stay) < len({i for i, _, _ in found})
    assert _rows(jaccard.keep_one(wide)) == sorted(want, key=str)
    assert _rows(jaccard.keep_one(wide.limit(0))) == []


def test_jaccard_long_texts(spark):
    """Copies about the limit, in groups on both sides of RARE, with passages and single shingles in common."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passage, texts = some(90), []
    for group in range(14):
        base = some(rng.choice([90, 240, 600])) + passage[: rng.choice([0, 8, 90])]
        for _ in range(rng.choice([1, 2, 3, jaccard.RARE, jaccard.RARE + 1, 14])):
            rate = rng.choice([0.005, 0.015, 0.025])
            texts.append(" ".join(rng.choice(words) if rng.random() < rate else w for w in base[: len(base) - rng.randrange(len(base) // 8)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = _linked(docs.collect())
    assert len({w[2] for w in want}) > 20
    for how in ({}, {"block_sets": 3}):
        assert _rows(jaccard.join(docs, **how)) == want


def test_jaccard_candidates(spark):
    """A few frequent shingles in common make no candidates, even in the first places of the order; near copies are candidates in groups of any size."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    passage, rows, sizes = [rng.choice(words) for _ in range(14)], [], [1] * 30 + [3, jaccard.RARE, jaccard.RARE + 1]
    for group, copies in enumerate(sizes):
        base = [rng.choice(words) for _ in range(300)] + passage
        rows += [(group, " ".join(rng.choice(words) if rng.random() < 0.005 and copies > 1 else w for w in base)) for _ in range(copies)]
    group_of = {jaccard.fingerprint(next(jaccard.shingle_sets(pa.array([t]), 5))[1])[0]: g for g, t in rows}
    nothing = spark.sparkContext.broadcast(np.zeros(1 << jaccard.SKETCH_BITS, np.uint32))  # a sketch that tells nothing, as of many texts
    forest = jaccard.Forest()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in jaccard._chains(jaccard._prefixes(docs, nothing, 5, 80), 80).collect():
        forest.join(r["a"], r["b"])
        assert group_of[r["a"]] == group_of[r["b"]]
    assert len({forest.root(x) for x in group_of}) == len(sizes)


def test_decontaminate(spark, docs):
    item = " ".join(_texts()[10].split()[30:60])
    bench = spark.createDataFrame([("long", item), ("short", "A, b!"), ("none", "..."), ("null", None), ("again", item)], "item_id string, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    want = []
    items = {r["item_id"]: norm(r["text"]) for r in bench.collect()}
    for r in docs.collect():
        w, hit, ids = norm(r["text"]), set(), set()
        for name, x in items.items():
            n = min(10, len(x))
            for i in range(len(x) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == x[i : i + n]:
                        hit |= set(range(j, j + n))
                        ids.add(name)
        want.append((r["doc_id"], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert _rows(decontaminate.decontaminate(docs, bench).select(cols)) == sorted(want, key=str) == _rows(decontaminate.decontaminate(docs, bench, broadcast_windows=4).select(cols))
    assert _rows(decontaminate.decontaminate(docs, bench, part_words=11, long_chars=20).select(cols)) == sorted(want, key=str)
    odd = docs.withColumn("_k1", F.lit(1)).withColumn("_K2", F.lit("x"))
    assert decontaminate.remove_documents(odd, bench).where("_k1 = 1 and _K2 = 'x'").count() == sum(not x[5] for x in want)
    assert any(x[2] for x in want) and decontaminate.decontaminate(docs, bench.where("false")).where("contaminated").isEmpty()
    assert decontaminate.remove_documents(docs, bench).count() == sum(not x[5] for x in want)


def test_secrets(spark):
    blob = "Zx9Qw3Er7Ty1Ui5Op2As6Df4Gh8Jk0"
    texts = [None, "", "é token = 'abcdefghijkl' token:secret:abcdefghijklmnop", "AKIAABCDEFGHIJKLMN AKIA1 deadbeefdeadbeef0", f"see {blob} and 123e4567-e89b-12d3-a456-426614174000 end", "einheitverberbeeinheitkeiterlang", "API_KEY: " + "a1" * 4000]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    kinds = [(re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12, 1), (re.compile("AKIA[A-Z0-9]+"), 18, 0), (re.compile("[0-9a-f]+"), 16, 0)]
    got = {r["doc_id"]: r for r in secrets.digests(df).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (p, n, g) in enumerate(kinds) for m in p.finditer(t or "") if len(m[g]) >= n)
        assert [got[i][f"n_{kind}"] for kind in secrets.KINDS[:3]] == [sum(x[1] == k for x in spans) for k in range(3)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    assert got[4]["spans"] == f"entropy:4:{4 + len(blob)}" and got[5]["spans"] == ""
    clean = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert clean[4]["text"].startswith("see [SECRET] and") and clean[0]["text"] is None and clean[3]["n_chars"] == len(clean[3]["text"])


def test_secrets_entropy(spark):
    """Windows' entropies against their definition; candidates and matches by the thousand in seconds; columns of any name."""
    rng = random.Random(1)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    letters = secrets._ALPHABET
    runs = [some(letters[: rng.choice([1, 2, 5, 16, 66])], rng.choice([1, 19, 20, 21, 40, 100])) for _ in range(80)]

    def plain(s):
        counts = [Counter(s[i : i + 20]).values() for i in range(len(s) - 19)]
        return max((np.log2(20) - sum(c * np.log2(c) for c in x) / 20 for x in counts), default=0.0)

    got = spark.createDataFrame([(r,) for r in runs], "s string").select("s", secrets.max_window_entropy(F.col("s")).alias("h")).collect()
    assert all(r["h"] == pytest.approx(plain(r["s"]), abs=1e-9) for r in got)
    long, hexes = some(letters[:62], 300_000), " ".join(some("0123456789abcdef", 20) for _ in range(20_000))
    began = time.time()
    rows = [(0, f"é {long} x", "b", 1), (1, hexes, "b", 1), (2, "a-" * 200_000 + "1", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _base string, _Spans int")
    found = {r["doc_id"]: r for r in secrets.digests(df).collect()}
    assert found[0]["spans"] == f"entropy:2:{2 + len(long)}" and found[1]["n_hex"] == 20_000 and found[2]["spans"] == ""
    clean = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert clean[0]["text"] == "é [SECRET] x" and clean[1]["text"] == " ".join(["[SECRET]"] * 20_000) and clean[2]["text"] == rows[2][1] and clean[1]["_base"] == "b" and clean[1]["_Spans"] == 1
    assert time.time() - began < 90


def test_secrets_joined(spark):
    """A name, a placeholder or a base span beside a secret does not hide it."""
    secret, upper = "Zx9Qw3Er7Ty1Ui5Op2As6Df4Gh8Jk0", "0F1E2D3C4B5A69788796A5B4C3D2E1F0"
    low = "A1B2A1C3B2D4A1E5C3B2F6A1"  # of the hex class, below base64's threshold
    cases = [(f"key-{low}", low), (f"AA_{low}", low), (f"AKIAABCDEFGHIJKLMN/{secret}", secret), (f"example-{secret}", secret), (f"{secret}/dummy", secret), (f"é x=sample_{upper} z", upper), (low, low)]
    clean = ["my-long-example-identifier-12", f"example{secret}", "id-123e4567-e89b-12d3-a456-426614174000", "some-long-name-of-words-joined-2024", "sample/123e4567-e89b-12d3-a456-426614174000"]
    texts = [t for t, _ in cases] + clean
    got = {r["doc_id"]: r["spans"] for r in secrets.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (text, hidden) in enumerate(cases):
        spans = [tuple(map(int, x.split(":")[1:])) for x in got[i].split(",") if x.startswith("entropy")]
        assert any(a <= text.index(hidden) and text.index(hidden) + len(hidden) <= b for a, b in spans), text
    assert [got[i] for i in range(len(cases), len(texts))] == [""] * len(clean)


def test_packing(spark, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = spark.createDataFrame([(100, "日本 語 x <|endoftext|> ½ ²", "x", "s", 0), (101, "it's   two\n\n lines 12ab", "x", "s", 0)], SCHEMA)
    rows = docs.where("doc_id <> 5 and doc_id is not null").unionByName(odd)
    got = packing.pack(rows).collect()
    for r in rows.collect():
        ids = np.array(model.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        pieces = sorted((x for x in got if x["doc_id"] == r["doc_id"]), key=lambda x: x["start"])
        at = 0
        for p in pieces:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes()) and p["doc_tokens"] == len(ids)
            at += p["length"]
        assert at == len(ids)
    by = {}
    for p in got:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_short_documents(spark):
    """A partition of empty and one-word texts: whole sequences but for one, and no more waiting than a buffer holds."""
    rows = spark.createDataFrame([(i, [None, "", "one"][i % 3]) for i in range(3000)], "doc_id long, text string").coalesce(1)
    for how in ({}, {"buffer_tokens": 300}):
        got = packing.pack(rows, **how).collect()
        size, tier = Counter(), {}
        for p in got:
            size[p["sequence_id"]] += p["length"]
            tier[p["sequence_id"]] = p["tier"]
        parts = Counter()
        for p in got:
            parts[p["doc_id"]] += p["length"]
        assert parts == {p["doc_id"]: p["doc_tokens"] for p in got} and len(parts) == 3000
        padded = [s for s in size if size[s] != tier[s]]
        assert len(padded) <= 1 and all(size[s] < packing.TIERS[0] for s in padded)
    packer, most = packing.Packer(0, buffer_tokens=4096), 0
    for i in range(20_000):
        packer.add(i, np.ones(1 + i % 5, "<u4"))
        if packer.full():
            packer.pack()
        most = max(most, packer.tokens)
    assert most < 4096 + 5


def test_language(spark):
    en, fr = "the cat and the dog are here with that other one ", "le chat et le chien sont ici avec les autres qui "
    rows = [(i, (en if i % 2 else fr) * (1 + i % 4), "en" if i % 2 else "fr", "s", 0) for i in range(60)] + [(90, None, "en", "s", 0), (91, "12 34 !", "fr", "s", 0), (92, "the other cat", None, "s", 0), (None, en, "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in language.classify(df).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(60)) and got[90]["lang_pred"] == got[91]["lang_pred"] == "und" and got[92]["lang_pred"] == "en"
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(60))
    assert language.keep_identified(df).count() == len(rows) - 2 and language.classify(df.where("false")).count() == 0


def _parsed(sample, text):
    """Phrases of a plain greedy parse: longest match, or one letter that isn't known."""
    n = count = 0
    while n < len(text):
        m = 1
        while n + m < len(text) and text[n : n + m + 1] in sample:
            m += 1
        count, n = count + 1, n + m
    return count


def test_language_phrases():
    """Exactly those of a plain parse, whatever the lanes, the blocks and the width of the dense table."""
    rng = random.Random(3)
    for _ in range(25):
        letters = "abcdefgh"[: rng.randint(2, 8)]
        some = lambda n, more="": language.normal("".join(rng.choice(letters + " " + more) for _ in range(n)))
        texts = {k: some(rng.choice([1, 5, 60, 400])) or "a" for k in "xyz"[: rng.randint(1, 3)]}
        tried = [some(rng.choice([0, 1, 3, 50, 700]), "zq") for _ in range(4)] + ["a" * 300, texts["x"] * 3, "zz"]
        for dense, lane, cells in ((64, 256, 1 << 22), (1, 7, 1 << 20), (3, 7, 40), (3, 1, 1)):
            model = language.Model(texts, dense=dense)
            got = model.phrases([model.symbols(x) for x in tried], lane, cells)
            assert got.tolist() == [[_parsed(texts[k], x) for k in model.langs] for x in tried]


def test_language_of_many_letters(spark):
    """Clean documents of a labelled language of 3,000 letters and short words stay; those of a script nobody learned go."""
    rng = random.Random(4)
    words = ["".join(chr(0x4E00 + int(rng.paretovariate(0.6)) % 3000) for _ in range(rng.randint(1, 3))) for _ in range(4000)]
    en = "the cat and the dog are here with that other one ".split()
    text = lambda some, n: " ".join(rng.choice(some) for _ in range(n))
    rows = [(i, text(words, 400) if i % 2 else text(en, 150), "zh" if i % 2 else "en", "s", 0) for i in range(160)]
    foreign = [(1000 + i, "".join(chr(0xAC00 + rng.randrange(9000)) for _ in range(900)), None, "s", 0) for i in range(5)]
    df = spark.createDataFrame(rows + foreign, SCHEMA)
    assert {r["doc_id"] for r in language.keep_identified(df).select("doc_id").collect()} == set(range(160))
    # the dense table's width changes nothing, and all letters are in the automaton
    texts = {"a": text(words, 300), "b": text(words, 200), "c": text(en, 50)}
    models = [language.Model(texts, dense=n) for n in (1, 64, 10_000)]
    tried = [texts["a"], texts["b"][:700], text(words, 700), "", "the ☃ 字 cat"]
    counts = [m.phrases([m.symbols(x) for x in tried]) for m in models]
    assert all((c == counts[0]).all() for c in counts)
    assert counts[0][0, 0] == 1


def test_quality_and_rules(spark, docs):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "house", "tree", "runs"]) for _ in range(60))
    rows = [(i, good() if i % 2 else good().upper().replace(" ", "!! "), "en", "s", 0) for i in range(240)] + [(500, None, None, None, None), (501, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(240)] + [(500, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(df, quality.fit(df, labels)).collect()}
    held = [i for i in range(240) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == i % 2 for i in held]) > 0.9 and 0 <= got[500]["score"] <= 1 and got[500]["score"] == pytest.approx(got[501]["score"], abs=1e-6)
    assert quality.fit(df, labels.where("false")).weights.any() == False  # noqa: E712
    net = quality.fit(df, labels)
    long = (good() * 9000).encode()
    pooled = quality._logistic(quality._forward(net, *quality.laid_out([long])) @ net.weights + net.offset)[0]
    assert quality._score_long(net, long) == pytest.approx(float(pooled), abs=1e-5)
    for r in rules.judge(docs).collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and (not r["kept"] or not r["base_failed"])
    p, q = np.array([[0.5, 0.5, 0]]), np.array([0, 0.5, 0.5])
    assert rules.js_distance(p, q)[0] == pytest.approx(np.sqrt(0.5)) and rules.js_distance(p, p[0])[0] == 0


def test_rules_many_languages(spark):
    """Each of 70 languages has references, and documents of the smallest are held against their own."""
    rows, own = [], lambda k: [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(20)]
    for k in range(70):
        rng = random.Random(k)
        rows += [(k * 10 + i, " ".join(rng.choice(own(k)) for _ in range(400 - 3 * k)), f"l{k:02}", "s", 0) for i in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    refs = rules.references(df)
    assert sorted(refs) == [f"l{k:02}" for k in range(70)]
    got = {r["doc_id"]: r for r in rules.judge(df, refs).collect()}
    assert all(got[i]["nearest"] == lang and got[i]["kept"] for i, _, lang, _, _ in rows)
    # distances against a plain count
    for i, text, lang, _, _ in rows[::20]:
        _, known, shares = refs[lang]
        q = np.bincount([known.get(w.encode(), len(known)) for w in text.split()], minlength=len(known) + 1) / len(text.split())
        assert got[i]["word_distance"] == pytest.approx(rules.js_distance(q[None], shares)[0])


def test_html():
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>Menu, one</a></nav><div class='ad'>Buy, now, this, great, thing, today</div><article><h1>Head &amp; line</h1><p>One,  two &eacute;\nthree.<p><b>Four <i>five</b> six<br>seven.</p><ul><li>a</li><li>b</li></ul></article><div id='comments'><p>Nice, post, indeed.</p></div><footer>&copy; x</footer></body></html>"
    assert html.extract(page) == "Head & line\nOne, two é three.\nFour five six seven.\na\nb"
    assert html.extract(None) == html.extract("") == html.extract("<script>x") == ""
    assert html.extract("<div>" * 5000 + "<p>deep text</p>") == "deep text"


def test_html_linear():
    """Pages of a megabyte that leave everything open, or nest it, take seconds."""
    n = 150_000
    began = time.time()
    for page in ("<a " * n, "<div>text, " * n, '<a "x' * n, "<b>" * n + "<hr>t" * n, "<noscript>" * n, "<table>" + "<div>" * n + "<b>" + "</i>" * n, "<b>" * n + "<table>" + "<div>" * n + "</b>" * n, "<li>x" * n, '<a title="x>y' * n):
        html.extract(page)
    assert time.time() - began < 90


def test_html_figures():
    """Captions and what is wrapped in figures stay, in page order, and don't move the container."""
    head = "".join(f"<p>Paragraph {i}, of the story, with words.</p>" for i in range(3))
    cells = "".join(f"<tr><td>cell {i}, of a table, with text</td></tr>" for i in range(8))
    page = f"<body><nav>Menu</nav><article>{head}<figure><img src=x><figcaption>A caption</figcaption></figure><figure><table>{cells}</table></figure><figure><blockquote><p>Quoted.</p></blockquote></figure><figure><pre>code()</pre></figure><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.<p>End, at last.</p></article><footer>f</footer></body>"
    want = [f"Paragraph {i}, of the story, with words." for i in range(3)] + ["A caption"] + [f"cell {i}, of a table, with text" for i in range(8)] + ["Quoted.", "code()", "So x=1.", "End, at last."]
    assert html.extract(page).split("\n") == want
    beside = f"<body><div><figure><figcaption>Lead image</figcaption></figure><div class='content'>{head}</div><div><a href=x>More, to read</a></div></div></body>"
    assert html.extract(beside).split("\n") == ["Lead image", *want[:3]]


def test_warc(spark):
    rows = [(1, "http://www.B.example.com:80/x?q=1#f", "<p>é</p>"), (2, None, None), (3, "", ""), (4, "http://b.example.com/x?q=1", "<p>é</p>"), (5, "https://a.example.org/", "other"), (None, "x y", "other")]
    archive_pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write(archive_pages, block_lines=2)
    got = {r["page_id"]: r for r in archive.read(archive_pages.select("url")).collect()}
    assert len(got) == 6 and all(got[i]["payload_digest"] == warc.digest_of((h or "").encode()) and got[i]["payload_bytes"] == len((h or "").encode()) for i, _, h in rows)
    assert (got[1]["refers_to"], got[2]["refers_to"], got[4]["record_type"], got[5]["record_type"]) == (4, 3, "response", "response")
    found = archive.lookup("http://b.example.com/x?q=1")
    assert sorted(h["WARC-Type"] for h, _ in found) == ["response", "revisit"] and warc.surt(rows[0][1]) == "com,example,b)/x?q=1"
    none = archive_pages.limit(0)
    assert warc.write(none).read(none).count() == 0


def test_warc_odd_urls(spark):
    """Any URL is a key, one URL may have more captures than a block, and every record is found through the bisected index once."""
    rng = random.Random(6)
    odd = ["http://a b/x", "http://a\nb/x y", "http://[::1]:8080/", "http://[::1", "ftp://é.example/ä?ö#ü", " ", "{", "http:///x", "HTTP://WWW2.A.Example.COM:443/%20", "http://x:99999/", "x" * 3000]
    odd += ["".join(rng.choice("ab/:?#[]@ .\t\u2028\x00%,)") for _ in range(rng.randint(1, 14))) for _ in range(60)] + ["http://hot.example/"] * 25
    pages = spark.createDataFrame([(i, u, f"<p>{i % 70}</p>") for i, u in enumerate(odd)], "page_id long, url string, html string")
    archive = warc.write(pages, block_lines=4)
    for part_blocks in (1, 3, 500):
        archive.part_blocks = part_blocks
        assert sorted(r["page_id"] for r in archive.read(pages.select("url")).collect()) == list(range(len(odd)))
    assert len(archive.lookup("http://hot.example")) == 25 == len(archive.lookup("http://www.hot.example:80/#x")) and archive.lookup("http://nowhere.example") == []
