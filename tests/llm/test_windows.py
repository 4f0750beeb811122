"""Hashing, substring dedup, prefix join and components against brute force."""

import random
import re

import numpy as np
import pytest

from gatescan.llm import arrays, chunks, components, jaccard, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def brute_dedup(docs, size):
    seen, out = {}, []
    for i, t in docs:
        if i is not None:
            w = words(t)
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                seen[key] = min(seen.get(key, i), i)
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and seen[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def corpus(n=120, seed=4):
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = []
    for k in range(n):
        body = [rng.choice([f"w{j}" for j in range(400)]) for _ in range(rng.randrange(120))]
        if rng.random() < 0.3:
            body[rng.randrange(len(body) + 1) :] = passage.split()[rng.randrange(20) :]
        docs.append((k, "\t ".join(body)))
    docs += [(n + k, docs[7][1]) for k in range(40)]  # copies
    near = [f"n{j}" for j in range(100)]
    for k in range(40):
        x = list(near)
        x[rng.randrange(100)] = f"edit{k}"
        docs.append((n + 40 + k, " ".join(x)))
    return docs + [(n + 100, None), (n + 101, ""), (n + 102, " \n"), (None, docs[7][1]), (n + 103, "Three short WORDS"), (n + 104, "three SHORT words"), (n + 105, "u" * 200_000 + " " + " ".join(near)), (5, docs[5][1]), (n + 106, "\xa0 é　x")]


def test_word_hashes_tell_words_apart_and_agree():
    texts = [b"a bb a", b"", b" ccc\nbb ", "é\u2003x é".encode(), b"x" * 600_000 + b" a"]
    w = arrays.find_words(texts)
    flat = [x for t in texts for x in t.split()]
    assert [w.buf[a:b] for a, b in zip(w.starts, w.ends, strict=True)] == flat
    by = {}
    for word, h in zip(flat, w.hashes.tolist(), strict=True):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)
    assert np.diff(w.offsets).tolist() == [len(t.split()) for t in texts]


def test_rolling_hashes_are_equal_for_equal_windows():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 4, 300_000, dtype=np.uint64) * np.uint64(0x123456789ABCDEF)
    got = arrays.rolling(h, 7)
    keys = {}
    for k in range(0, len(got), 37):
        assert keys.setdefault(h[k : k + 7].tobytes(), got[k]) == got[k]
    assert len(set(keys.values())) == len(keys)
    assert len(arrays.rolling(h[:3], 7)) == 0


@pytest.mark.parametrize("values", [[], [0], [1, 1, 2**64 - 1], list(range(1000))])
def test_integers_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    assert arrays.unpack_ints(arrays.pack_ints(v), len(v)).tolist() == values
    assert arrays.unpack_sorted(arrays.pack_sorted(v), len(v)).tolist() == values


@pytest.mark.parametrize("small_chunks", [False, True])
def test_substring_dedup(spark, monkeypatch, small_chunks):
    if small_chunks:
        monkeypatch.setattr(substrings.C.pack, "__defaults__", (2000,))
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string").repartition(3)
    got = substrings.remove_repeats(df, suffix="_new").collect()
    assert sorted((repr(r.doc_id), r.n_words_new, r.n_removed_new, r.kept_text_new) for r in got) == sorted((repr(i), a, b, c) for i, a, b, c in brute_dedup(docs, 13))
    for r in got:
        assert sum(x.end - x.start for x in r.removed_new) == r.n_removed_new and r.n_words == "x"
        assert all(a.end < b.start for a, b in zip(r.removed_new, r.removed_new[1:], strict=False))
    assert substrings.remove_repeats(df.where("false"), suffix="_new").count() == 0


def brute_components(docs, size=5, percent=80):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t in docs:
        w = words(lower(t))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = {i: i for i, _ in docs if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            i, j = docs[a][0], docs[b][0]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(repr(i), len(s), repr(find(i) if i is not None else None)) for (i, _), s in zip(docs, sets, strict=True)]


@pytest.mark.parametrize("percent", [80, 50])
def test_prefix_join(spark, percent):
    docs = corpus()
    rng = random.Random(8)
    for k in range(40):  # chains of drifting copies
        x = [f"d{k // 10}_{j}" for j in range(60)]
        for j in range(2 * (k % 10)):
            x[j] = f"z{k // 10}_{j}"
        if rng.random() < 0.5:
            x.append("tail")
        docs.append((1000 + k, " ".join(x)))
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string").repartition(3)
    got = [(repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard.link_components(df, percent=percent).collect()]
    assert sorted(got) == sorted(brute_components(docs, percent=percent))
    assert jaccard.link_components(df.where("false")).count() == 0


def test_prefix_join_links_within_a_group(spark):
    part = lambda name, n: [f"{name}{j}" for j in range(n)]
    head, nav, r, q = part("h", 20), part("l", 6), part("r", 60), part("q", 60)
    pages = [head + nav + r + ["own1"], head + nav + q + ["own2"], head + nav + q + ["own3"]]
    for k in range(6):  # the bodies are common, the header stands in the first three pages alone
        pages += [part(f"x{k}_", 90) + nav + r, part(f"y{k}_", 90) + nav + q]
    docs = [(k, " ".join(x)) for k, x in enumerate(pages)]
    got = jaccard.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = [(repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got]
    assert sorted(found) == sorted(brute_components(docs))
    assert next(x for x in found if x[0] == "2")[2] == "1"


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, 2000 + k) for k in range(1, 50)] + [(5, 5), (7, 9), (7, 9)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def join(pairs):
        for a, b in pairs:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)

    def same(result):
        got = {r.node: r.component for r in result.collect()}
        assert got == {n: find(n) for n in parent if find(n) != n}

    join(edges)
    first = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    same(first)
    more = [(1050, 3), (2001, 299), (5000, 5001)]
    join(more)
    same(components.connected_components(spark.createDataFrame(more, "a long, b long"), known=first))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_never_differ_in_more_cells_than_the_sets(monkeypatch):
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 64)
    r = np.random.default_rng(3)
    pool = np.unique(r.integers(0, 1 << 63, 900).astype(np.uint64))
    sets = [np.sort(r.choice(pool, k, replace=False)) for k in (1, 5, 60, 64, 65, 130, 400, 800)]
    n = np.array([len(s) for s in sets])
    packed = jaccard.parity_sketches(np.concatenate(sets), np.cumsum(n), n, np.ones(len(sets), dtype=bool))
    rows = [np.frombuffer(p, dtype=np.uint64)[None] for p in packed]
    assert [64 * x.shape[1] for x in rows] == [64, 64, 64, 64, 128, 256, 512, 1024]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            differ = int(jaccard._differ(rows[i], rows[j])[0, 0])
            assert differ <= len(np.setxor1d(x, y)) and (i != j or differ == 0)


@pytest.mark.parametrize("leaders", [1, 3])
def test_lists_in_blocks_and_any_number_of_leaders_give_the_same(spark, monkeypatch, leaders):
    """Families around one text, whose members differ by up to a third: links in lists of many components."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "VERIFY_PARTS", 2)
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    r = random.Random(9)
    docs = []
    for family in range(4):
        base = [f"w{r.randrange(400)}" for _ in range(60)]
        for _ in range(14):
            text = list(base)
            at = r.randrange(45)
            text[at : at + r.randrange(14)] = [f"x{r.randrange(6)}" for _ in range(r.randrange(14))]
            docs.append((len(docs), " ".join(text)))
    docs += [(len(docs) + k, docs[k][1]) for k in range(3)]
    got = jaccard.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == sorted(brute_components(docs))


def test_prefix_join_reads_only_id_and_text(spark):
    """Columns with the names of the operator's own, repeated rows and one very long text."""
    long = " ".join(f"v{k % 977}x{k % 31}" for k in range(60_000))
    docs = [(1, "a b c d e f", 5, "m"), (1, "a b c d e f", 5, "m"), (2, "A b c d e f", 6, None), (3, long, 7, "m"), (4, long + " z", 8, "m"), (5, None, 9, "m"), (5, "", 9, "m")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_shingles int, token string")
    got = sorted((r.doc_id, r.component_id) for r in jaccard.link_components(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (5, 5)]


def test_texts_that_share_a_frame_leave_no_candidates(spark, monkeypatch):
    """Twelve common words and two own ones: no pair reaches the similarity, and no list is cut into pairs of blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    dealt, real = [], jaccard.C.stored_with

    def watch(df, **measures):
        out = real(df, **measures)
        if "block" in df.columns:
            dealt.append(out[1]["n"])
        return out

    monkeypatch.setattr(jaccard.C, "stored_with", watch)
    frame = " ".join(f"c{k}" for k in range(12))
    docs = [(k, f"{frame} x{k} y{k}") for k in range(200)]
    got = jaccard.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k for k in range(200)}
    assert max(dealt) < 40  # but for hashes that meet in so small a table; 1,400 were all entries in all pairs of blocks
    docs += [(300 + k, frame) for k in range(40)]  # this is similar to each of them
    got = jaccard.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and brute_components(docs)[0][2] == "0"


def test_tables_of_a_scope_go_at_its_end(spark):
    with chunks.temporary_tables(spark):
        inner = chunks.stored(spark.range(5).toDF("x"))
        kept = chunks.checkpoint(inner.where("x > 1"))
    outer = chunks.stored(spark.range(3).toDF("x"))
    assert kept.count() == 3 and outer.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND|FileNotFound"):
        inner.count()
