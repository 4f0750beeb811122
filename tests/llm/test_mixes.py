"""Lexical search, the curriculum of sources, and whitening, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatescan.llm import curriculum, retrieval, whitening
from gatescan.llm.queries import SCHEDULES

WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_search(items, docs, top=20):
    words = [(i, TERM.findall(lower(t))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, total = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        q, scores = Counter(TERM.findall(lower(text))), []
        for i, w in words:
            tf, m = Counter(w), 75 + (25 * len(w) * n_docs) // total
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, c in q.items() if tf[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def documents(rng, n, vocabulary):
    return [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(30)))) for k in range(n)]


@pytest.mark.parametrize("entries", [1 << 18, 40])
def test_search(spark, monkeypatch, entries):
    monkeypatch.setattr(retrieval, "ITEM_ENTRIES", entries)
    rng = random.Random(5)
    vocabulary = ["a", "b2", "Café", "日本", "x_y", "it's", "ÀB", "zz", *(f"w{k}" for k in range(40))]
    docs = documents(rng, 150, vocabulary) + [(7, "a a b2"), (7, "a a b2"), (None, "a a b2"), (None, None), (900, ""), (901, "!?"), (902, "long " * 20_000 + "zz")]
    items = [(k, t) for k, t in documents(rng, 25, vocabulary)] + [(3, "a a b2"), (None, "zz zz"), (50, None), (51, "unknown"), (52, "")]
    frame = lambda rows, name: spark.createDataFrame([(*r, 1) for r in rows], f"{name} long, text string, rank int").repartition(5)
    got = retrieval.search(frame(items, "item_id"), frame(docs, "doc_id"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.schema["rank"].dataType.simpleString() == "int"
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(items, docs)
    assert retrieval.search(frame(items, "item_id").where("false"), frame(docs, "doc_id")).count() == 0
    assert retrieval.search(frame(items, "item_id"), frame(docs, "doc_id").where("false")).count() == 0


def test_tiles_stay_exact_and_keep_ties(monkeypatch):
    monkeypatch.setattr(retrieval, "ITEM_TILE", 3)
    monkeypatch.setattr(retrieval, "TERM_TILE", 4)
    monkeypatch.setattr(retrieval, "EXACT", 50_000 * retrieval.IMPACT)
    rng = np.random.default_rng(2)
    n_terms, n_docs, n_items = 30, 40, 8
    held = [np.flatnonzero(rng.random(n_terms) < 0.4) for _ in range(n_items)]
    items = retrieval.Items(np.arange(n_items), np.concatenate(([0], np.cumsum([len(h) for h in held]))), np.concatenate(held), rng.integers(1, 4, sum(map(len, held))), {b"%d" % k: k for k in range(n_terms)})
    weights = rng.integers(0, 20_000, n_terms)
    impact = rng.integers(0, 4, (n_terms, n_docs)) * 250_000
    terms, doc = np.nonzero(impact)
    want = np.zeros((n_items, n_docs), dtype=object)
    for i in range(n_items):
        for e in range(items.offsets[i], items.offsets[i + 1]):
            want[i] += int(items.repeats[e]) * int(weights[items.terms[e]]) * impact[items.terms[e]].astype(object)
    best = retrieval._Best(n_items, 5)
    ids = rng.permutation(n_docs)
    for tile in retrieval._tiles(items, weights):
        assert len(tile.pieces) > 1 and all(e - a <= 4 for a, e in tile.pieces)
        for at in range(0, n_docs, 16):
            pick = (doc >= at) & (doc < at + 16)
            n = min(16, n_docs - at)
            got = retrieval._scores(tile, terms[pick], doc[pick] - at, impact[terms[pick], doc[pick]], n)
            assert (got == want[tile.first : tile.first + tile.n_items, at : at + n]).all()
            best.add(tile.first, got, ids[at : at + n], np.zeros(n, dtype=np.int64))
    for i in range(n_items):
        order = sorted((-s, d) for s, d in zip(want[i], ids.tolist(), strict=True) if s > 0)[:5]
        assert [(-s, d) for s, _, d in best.rows[i].T.tolist()] == order


def test_largest_weights_are_below_the_bound():
    assert 10**9 // (1000 + 12 * 75) < retrieval.IMPACT and (10**9 * 10**6) // (1000 * 10**6 + 12 * 75) < retrieval.IMPACT


def schedule_of(spark, sources):
    rows = [(s, float(at), w) for k, s in enumerate(sources) for at, w in enumerate(SCHEDULES[k % 3])]
    return spark.createDataFrame(rows, "source string, at double, weight double")


def brute_mix(docs, passes=3):
    """(id, text, source) -> rows of (id, size, source_size, target, taken)."""
    size = [len(WORD.findall(t or "")) for _, t, _ in docs]
    sums = defaultdict(int)
    for (_, _, s), n in zip(docs, size, strict=True):
        sums[s] += n
    sources = sorted(sums, key=lambda s: (s is None, s or ""))
    weight, capped = {s: k % 3 + 1 for k, s in enumerate(sources)}, set()
    while True:
        rest, left = sum(sums.values()) - sum(passes * sums[s] for s in capped), sum(weight[s] for s in sources if s not in capped)
        more = {s for s in sources if s not in capped and rest * weight[s] / left > passes * sums[s]}
        if not more:
            break
        capped |= more
    target = {s: float(passes * sums[s]) if s in capped else rest * weight[s] / left for s in sources}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    begun, out = defaultdict(int), []
    for key, (i, _, s), n in sorted(((md5(f"{'' if d[0] is None else d[0]}:{md5(d[1] or '')}"), d, n) for d, n in zip(docs, size, strict=True)), key=lambda x: (x[0], str(x[1]))):
        whole, own = math.floor(target[s]), sums[s]
        taken = whole // own * n + max(0, min(n, whole % own - begun[s])) if own else 0
        begun[s] += n
        out.append((i, n, own, target[s], taken))
    return sorted(out, key=str)


def test_curriculum(spark):
    rng = random.Random(8)
    docs = [(k, " ".join("w" * rng.randrange(1, 200)) if k % 7 else None, rng.choice(["a", "a", "a", "a", "b", "é", None, ""])) for k in range(300)]
    docs += [(1000 + k, "x y z", "tiny") for k in range(2)] + [(5, "same row", "b"), (5, "same row", "b"), (None, "no id", "a"), (2000, "a\tb\nc " * 30_000, "é"), (2001, "", "empty")]
    sources = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, source string, size int, __h string").repartition(6)
    got = curriculum.curriculum(df, schedule_of(spark, sources), keep=("source", "size")).collect()
    rows = sorted(((r.doc_id, r.size_, r.source_size, r.target, r.taken) for r in got), key=str)
    assert [r[:3] + r[4:] for r in rows] == [r[:3] + r[4:] for r in brute_mix(docs)]
    assert [r[3] for r in rows] == pytest.approx([r[3] for r in brute_mix(docs)])
    assert {r.size for r in got} == {1}
    tiny = [r for r in got if r.source == "tiny"]
    assert {r.target for r in tiny} == {18.0} and {r.taken for r in tiny} == {9} and all(len(r.passes) == 3 for r in tiny)
    for s in sources:
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == math.floor(own[0].target) and all(r.taken <= 3 * r.size_ for r in own)
    placed = [r.position for r in got if r.position is not None]
    assert placed == sorted(placed) and all(0 <= p < 1 for p in placed) and all((r.position is None) == (r.taken == 0) for r in got)
    again = curriculum.curriculum(df.repartition(2), schedule_of(spark, sources), keep=("source", "size")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_moments_follow_the_schedule(spark):
    knots = [(0.25, 0.0), (0.5, 4.0), (0.75, 4.0), (0.9, 1.0)]
    schedule = spark.createDataFrame([("a", at, w) for at, w in knots] + [("a", 0.5, 4.0), ("b", 0.3, 1.0)], "source string, at double, weight double")
    docs = spark.createDataFrame([(k, "w " * 10, "ab"[k % 2]) for k in range(2000)], "doc_id long, text string, source string")
    order = curriculum.training_order(curriculum.curriculum(docs, schedule, keep=("source",))).collect()
    assert [r.at for r in order] == sorted(r.at for r in order)
    at, w = [0, *(k for k, _ in knots), 1], [0.0, *(v for _, v in knots), 1.0]
    fine = np.linspace(0, 1, 100_001)
    area = np.concatenate(([0], np.cumsum((np.interp(fine, at, w)[1:] + np.interp(fine, at, w)[:-1]) / 2) / 100_000))
    assert curriculum.integrate(schedule).where("key = '=a'").first().weight == pytest.approx(area[-1])
    for moment in (0.2, 0.3, 0.45, 0.6, 0.8, 0.97):
        for source, part in (("a", np.interp(moment, fine, area) / area[-1]), ("b", moment)):
            own = [r for r in order if r.source == source]
            assert sum(r.words for r in own if r.at < moment) == pytest.approx(part * sum(r.words for r in own), abs=11)


def test_curriculum_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert curriculum.curriculum(docs, schedule_of(spark, ["a"])).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, "z")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken, r.passes) for r in curriculum.curriculum(blank, schedule_of(spark, ["a"])).collect()] == [(0, 0.0, 0, [])] * 2


def brute_whitening(vectors):
    x = np.floor(np.array(vectors, dtype=np.float32).astype(float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    d = x - s / n
    values, vecs = np.linalg.eigh(d.T @ d / n)
    order = np.argsort(-values)
    values, vecs = values[order], vecs[:, order]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return n, deviation, values, d @ vecs


def test_whitening(spark):
    rng = np.random.default_rng(4)
    base = (rng.standard_normal((400, 12)) * np.linspace(0.05, 1, 12)).astype(np.float32).tolist()
    rows = [(k, v) for k, v in enumerate(base)] + [(3, base[3]), (None, base[5])]
    kept = [v for _, v in rows]
    rows += [(900, None), (901, [None, *base[0][1:]]), (902, [float("nan"), *base[0][1:]]), (903, [float("inf"), *base[0][1:]]), (904, base[0][:5]), (905, []), (906, [3e38, *base[0][1:]])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int").repartition(7)
    got = whitening.whiten(df).collect()
    n, deviation, values, along = brute_whitening(kept)
    assert len(got) == 8 * n and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 9))
    ids = [i for i, _ in rows[:n]]
    assert sorted(((r.vec_id, r.deviation) for r in got if r.component == 1), key=str) == sorted(zip(ids, deviation, strict=True), key=str)
    for c in range(8):
        own = {r.vec_id: r.whitened for r in got if r.component == c + 1 and r.vec_id not in (3, None)}
        want = {i: w / math.sqrt(values[c]) for i, w in zip(ids, along[:, c], strict=True) if i not in (3, None)}
        sign = math.copysign(1, own[0] * want[0])
        assert max(abs(own[i] - sign * want[i]) for i in want) < 1e-9
        assert {r.explained for r in got if r.component == c + 1}.pop() == pytest.approx(values[c] / values.sum(), rel=1e-10)
    assert {r.identity_error for r in got}.pop() < 1e-9
    exact = lambda df: sorted(map(str, whitening.whiten(df).drop("whitened", "identity_error").collect()))
    assert exact(df.repartition(2)) == exact(df)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).columns[0] == "vec_id"
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(0, 0.0, 0.0, 0.0)] * 4
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], schema)).collect()
    assert {r.component: r.explained for r in line}[1] == pytest.approx(1) and {r.whitened for r in line if r.component == 2} == {0.0}
    for scale in (32.0, 2.0**15, 1e9):
        large = whitening.whiten(spark.createDataFrame([(k, [scale * k, float(k % 7) * scale / 64]) for k in range(50)], schema)).collect()
        assert ({r.deviation for r in large if r.vec_id == 0} == {None}) == (scale > 100) and {r.identity_error for r in large}.pop() < 1e-9


@pytest.mark.parametrize("values", [[9, 5, 5, 5, 1, 1e-6, 1e-6, 0], [1 + 1e-12 * k for k in range(8)], [4, 4 - 1e-7, 2, 2 - 1e-5, 1, 0.5, 0.25, 0.1], [1e-9] * 8])
def test_clustered_eigenvalues(values):
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.standard_normal((8, 8)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.eigen(a)
    assert np.abs(vectors @ vectors.T - np.eye(8)).max() < 1e-14
    assert np.abs(a @ vectors.T - vectors.T * found).max() < 1e-14 * max(values)
    assert np.abs(found - sorted(values, reverse=True)).max() < 1e-14 * max(values)


def test_covariance_is_exact_whatever_the_order(spark):
    rng = np.random.default_rng(9)
    vectors = (1000 + rng.standard_normal((300, 5))).astype(np.float32).tolist()
    df = spark.createDataFrame([(v,) for v in vectors], "vector array<double>")
    first = whitening.covariance(df.repartition(1), 5)
    for parts in (3, 11):
        n, s, v = whitening.covariance(df.repartition(parts).orderBy(F.rand(parts)), 5)
        assert (n, s) == first[:2] and (v == first[2]).all()
    x = [[math.floor(c * 1024) + 100_000 for c in v] for v in vectors]
    exact = (n * sum(r[0] * r[1] for r in x) - s[0] * s[1]) / n**2
    assert v[0, 1] == exact
