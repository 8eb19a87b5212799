"""Operators 11 to 13: against the library, numpy's eigenvectors and plain loops; odd tables."""

import hashlib
import math
import random

import numpy as np
import pytest

from frametide.llm import codes, pieces, whitening


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def _same(library, texts):
    coder = pieces.codec()
    for text in texts:
        ids = library.encode(text, add_bos=True, add_eos=True)
        raw = coder.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == ids, repr(text)
        assert coder.decode(np.frombuffer(raw, "<u4")) == library.decode(ids), repr(text)


def test_pieces_as_the_library(library):
    rng = random.Random(3)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    _same(library, ["".join(rng.choice(names) for _ in range(rng.randint(1, 9))) for _ in range(3000)])
    _same(library, ["".join(rng.choice("ab \n\t▁é中😀\x00t1<s>e") for _ in range(rng.randint(0, 40))) for _ in range(3000)])
    _same(library, ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(0, 60))) for _ in range(3000)])
    _same(library, [" " * k + "x" * j + " " * m for k in range(36) for j in (0, 1) for m in (0, 1, 17)])
    _same(library, ["", " ", "</s>", "<0x41>", "�", "a" * 5000, "\n" * 50, "the" * 3000, "中" * 3000, "é" * 50])


def test_pieces_decode_any_ids(library):
    rng, coder = random.Random(4), pieces.codec()
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert coder.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_pieces_prefixes_and_caches(monkeypatch):
    """Each prefix's encoding is the prefix table's; small caches change nothing."""
    coder, rng = pieces.codec(), random.Random(5)
    text = "▁" + "".join(rng.choice("thereandhi1▁") for _ in range(80))
    whole = coder.tokens(text)
    at, sizes = 0, [len(coder._name(t)) for t in whole]
    for i, n in enumerate(sizes):
        at += n
        assert coder.tokens(text[:at]) == whole[: i + 1]
    assert coder._trace(coder.tokens("▁the")[0])[-1][1] == "▁the"
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(40)) for _ in range(20)]
    want = [coder.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 7)
    monkeypatch.setattr(pieces, "PAIR_ENTRIES", 5)
    assert [coder.encode(t) for t in texts] == want


def test_pieces_long_text_is_linear():
    import time

    coder, spent = pieces.codec(), []
    for n in (100_000, 400_000):
        began = time.process_time()
        coder.tokens("ab1x" * (n // 4))
        spent.append(time.process_time() - began)
    assert spent[1] < 12 * max(spent[0], 0.02)


def test_pieces_tables(spark, library):
    texts = [None, "", " ", "Hello  world\n", "x" * 20_000, "Hello  world\n", "né 中\x00"]
    df = spark.createDataFrame([(None if i == 3 else i, t, "a", 7) for i, t in enumerate(texts)], "doc_id long, text string, IDS string, text_of_ids int").repartition(2)
    got = {r["doc_id"]: r for r in pieces.digests(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        r = got[None if i == 3 else i]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    encoded = pieces.encode(df)
    assert encoded.columns == ["doc_id", "text", "text_of_ids", "ids"]
    rows = pieces.decode(encoded.union(spark.createDataFrame([(99, "z", 1, None)], encoded.schema))).collect()
    assert {(r["doc_id"], r["decoded"]) for r in rows} == {(None if i == 3 else i, t or "") for i, t in enumerate(texts)} | {(99, None)}
    assert pieces.digests(df.limit(0)).count() == 0 and pieces.encode(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="piece"):
        pieces.Codec(__file__)


ODD = [None, [], [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 0.0, 0.0, 0.0]]


def _table(spark, vectors, d, kind="double"):
    odd = [None if v is None else (v + [0.0] * d)[: d if v else 0] for v in ODD]
    rows = [(i if i != 3 else None, [float(c) for c in v], int(i % 3) if i % 4 else None, "q", 1) for i, v in enumerate(vectors)] + [(900 + i, v, 1, "q", 1) for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, x string, n int").repartition(3)


def _vectors(n, d, seed=1, offset=0.0):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, d)) @ np.diag(np.linspace(2, 0.1, d)) + offset
    return np.concatenate([out, out[:3], out[:1]])  # repeated rows


@pytest.mark.parametrize(("d", "offset"), [(6, 0.0), (7, 5e9), (4, 1e13)])
def test_whitening(spark, d, offset):
    vectors = _vectors(40, d, offset=offset)
    df = _table(spark, vectors, d)
    model = whitening.fit(df)
    rows = whitening.whiten(df, model).collect()
    x = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    distinct = list({tuple(v) for v in x})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    y = np.array([[(n * c - s) for c, s in zip(v, sums, strict=True)] for v in distinct], object)
    v = (y.T @ y).astype(float) / n**3
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(rows) == 4 * len(vectors) and {r["component"] for r in rows} == {1, 2, 3, 4}
    assert np.allclose(model.values, e, rtol=1e-12) and np.allclose(np.abs((model.components * u).sum(0)), 1, atol=1e-9)
    signs = np.sign((model.components * u).sum(0))
    got = sorted((r["component"], r["deviation"], round(r["whitened"], 8)) for r in rows)
    want = []
    for p in x:
        dev = [n * c - s for c, s in zip(p, sums, strict=True)]
        w = (np.array(dev, object).astype(float) / n) @ u / np.sqrt(e) * signs
        want += [(k + 1, sum(c * c for c in dev), round(float(w[k]), 8)) for k in range(4)]
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-7
    assert all(r["n"] == n and r["identity_error"] < 1e-10 and math.isclose(r["explained"], e[r["component"] - 1] / e.sum(), rel_tol=1e-10) for r in rows)


def test_whitening_odd_tables(spark):
    df = _table(spark, _vectors(5, 4), 4)
    assert whitening.whiten(df.limit(0), whitening.fit(df.limit(0))).count() == 0
    one = _table(spark, [[0.5, 0.25, 1.0, 0.0]] * 3, 4)
    assert whitening.whiten(one, whitening.fit(one)).count() == 0  # no eigenvalue above zero
    flat = _table(spark, [[i / 7, 2 * i, 3 * i, 1.0] for i in range(9)], 4, "float")
    model = whitening.fit(flat)
    assert model.identity_error < 1e-9 and 1 <= len(model.values) <= 3
    big = _table(spark, [[1e300, -1e300, 1.0, 2.0], [0.0, 0.0, 0.0, 1.0], [-1e300, 5.0, 1.0, 0.0]], 4)
    assert {r["deviation"] for r in whitening.whiten(big, whitening.fit(big)).collect()} == {None}
    with pytest.raises(ValueError, match="entries"):
        whitening.fit(_table(spark, [[1.0], [1.0, 2.0]], 1))


def test_jacobi_on_hard_matrices():
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 16, 33):
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        for e in (np.logspace(0, -9, d), np.ones(d), np.r_[np.ones(d - 1), 0.0]):
            values, axes = whitening.eigen(q @ np.diag(e) @ q.T)
            want = np.sort(e[e > 0])[::-1][: len(values)]
            assert np.allclose(values, want, rtol=1e-6, atol=1e-15 * d) and np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-10)
    factor, order = whitening.pivoted_cholesky(np.diag([1.0, 4.0, 0.0]))
    assert factor.shape == (3, 2) and order[0] == 1


def _plain_codes(vectors, ids, parts, k, rounds, scale=4096):
    x = [[math.floor(scale * float(c)) for c in v] for v in vectors]
    w = len(x[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in x]
    first = sorted(range(len(x)), key=lambda i: (ids[i] is None, ids[i] or 0, x[i]))[:k]
    books = [[list(cut[i][p]) for i in first] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = [nearest(v[p], books[p])[1] for v in cut]
            for j in range(len(books[p])):
                mine = [v[p] for v, g in zip(cut, got, strict=True) if g == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for v in cut:
        found = [nearest(v[p], books[p]) for p in range(parts)]
        out.append(("".join(f"{j:02x}" for _, j in found), sum(f for f, _ in found)))
    return books, out


@pytest.mark.parametrize(("parts", "k", "n", "size"), [(2, 16, 60, 1.0), (4, 3, 5, 1.0), (2, 70, 150, 1.0), (2, 5, 40, 1e7), (2, 5, 40, 1e3),  (8, 16, 9, 0.01)])
def test_codes(spark, parts, k, n, size):
    vectors = _vectors(n, 8, seed=n) * size
    df = _table(spark, vectors, 8)
    ids = [i if i != 3 else None for i in range(len(vectors))]
    books, want = _plain_codes(vectors, ids, parts, k, 6)
    rows = codes.compress(df, parts=parts, entries=k).collect()
    labels = [i % 3 if i % 4 else None for i in range(len(vectors))]
    total = {a: sum(e for (_, e), b in zip(want, labels, strict=True) if b == a) for a in set(labels)}
    fits = lambda e: e if e < 1 << 63 else None
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in rows) == sorted((i is None, i or 0, c, fits(e), fits(total[a])) for i, (c, e), a in zip(ids, want, labels, strict=True))
    assert {r["codebooks_sha256"] for r in rows} == {hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()}


def test_codes_odd_tables(spark):
    df = _table(spark, _vectors(5, 8), 8)
    assert codes.compress(df.limit(0)).count() == 0 and codes.compress(df.where("vec_id >= 900")).count() == 0
    same = _table(spark, [[0.5] * 8] * 20, 8)
    assert {(r["code"], r["error"]) for r in codes.compress(same).collect()} == {("00" * 8, 0)}
    with pytest.raises(ValueError, match="parts"):
        codes.compress(df, parts=3)


def test_codes_cubes_and_decoding(spark):
    rng = np.random.default_rng(9)
    entries = rng.integers(-30, 30, (130, 3)).tolist() + [[0, 0, 0], [0, 0, 0]]
    book = codes.Codebook(entries)
    x = rng.integers(-60, 60, (500, 3))
    far = ((x[:, None] - np.array(entries)[None]) ** 2).sum(2)
    for radius in (0, 1, book.radius, 1000):
        book.radius = radius
        entry, best = book.nearest(x)
        assert (entry == far.argmin(1)).all() and (best == far.min(1)).all()
    masks = book.within(x, 9)
    inside = (np.abs(x[:, None] - np.array(entries)[None]) <= 9).all(2)
    assert all(bool(int(masks[j // 64, i]) >> (j % 64) & 1) == inside[i, j] for i in range(50) for j in range(len(entries)))
    books = [[[1, 2], [3, 4]], [[5, 6], [-7, 8]]]
    got = codes.decode(spark.createDataFrame([("0100",), ("0001",), (None,)], "code string"), books).collect()
    assert [r["x"] for r in got] == [[3, 4, 5, 6], [1, 2, -7, 8], None]


def test_labels_hot_and_rare(spark, monkeypatch):
    monkeypatch.setattr(codes, "HOT_LABELS", 3)
    rows = [(i, None if i % 2 else i if i > 40 else 7, 1 << 62 if i % 2 else i) for i in range(60)]
    got = codes.with_sums_by_label(spark.createDataFrame(rows, "vec_id long, label int, error long")).collect()
    sums = {}
    for _, label, error in rows:
        sums[label] = sums.get(label, 0) + error
    assert sorted((r["vec_id"], r["label_error"]) for r in got) == [(i, sums[a] if sums[a] < 1 << 63 else None) for i, a, _ in rows]
