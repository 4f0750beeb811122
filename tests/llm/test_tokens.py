"""BPE codec and packing against the tokenizers library."""

import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gatescan.llm import arrays, bpe, packing
from gatescan.llm.queries import vocabulary

LIBRARY = Tokenizer.from_file(vocabulary())
CODEC = bpe.codec(vocabulary())
ODD = ["", " ", "a  b\n\n c\t\tx don't 'tis !'s !!?'s  x　y  <|endoftext|> z  <|endoftext|>", "a" * 3000, "١٢٣ ёж Ёж 日本語 👩‍👩‍👧 é é's", "x\u0085y \x1c a'b 1's s'S _'s", "\r\n\r\n  \n foo\x0b\x0cbar", "÷×ß ÿ", "é é\xa0 é", "\x00\x01�"]


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def check(texts):
    for t, got, want in zip(texts, CODEC.encode([t.encode() for t in texts]), LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(got) == want.ids, t
        assert CODEC.decode(got).decode() == LIBRARY.decode(want.ids, skip_special_tokens=False)


def test_odd_texts():
    check(ODD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text(texts):
    check(texts)


def test_texts_of_troublesome_pieces():
    rng = random.Random(1)
    parts = [*"ab'st!? \n\t1é 日.́-_ ", "'re", "'ll", " the", "<|endoftext|>", "aaa"]
    check(["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(2000)])


def test_a_very_long_piece_takes_linear_rounds():
    check(["ab" * 40_000 + "x" * 5000])


def test_a_small_cache_gives_the_same(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_FRAGMENTS", 3)
    own = bpe.Codec(vocabulary())
    for t in ODD:
        assert own.encode([t.encode()]) == CODEC.encode([t.encode()])


def test_each_distinct_fragment_is_looked_up_once():
    """op2's CPU time: a block's repeated fragments cost no lookup of their own."""
    own, asked = bpe.Codec(vocabulary()), []

    class Known(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    own.known = Known()
    texts = [" the cat, the dog! The cat." * 50, "", " the dog! the cat,"]
    assert list(map(ids, own.encode([t.encode() for t in texts]))) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked)) > 3


@pytest.mark.parametrize("shift", [0, 60, 63])
def test_fragments_of_one_hash_are_told_apart(monkeypatch, shift):
    hashes = bpe.slice_hashes
    monkeypatch.setattr(bpe, "slice_hashes", lambda *a: hashes(*a) >> np.uint64(shift) << np.uint64(shift) if shift else np.zeros_like(hashes(*a)))
    check([*ODD, " ".join(ODD) * 3])


@pytest.mark.parametrize("size", [1, 7, 8, 9, 16, 17, 63, 64, 65, 200])
def test_slices_are_told_apart_by_every_byte(monkeypatch, size):
    """F1 (op2's CPU time): slices are hashed and compared eight bytes at a time; a difference in any byte counts, even of one hash."""
    one = bytes(1 + k % 250 for k in range(size))
    slices = [one, *[one[:k] + bytes([one[k] ^ 1]) + one[k + 1 :] for k in range(size)], one, one + b"!", one]
    buf, starts = b"".join(slices), np.cumsum([0, *map(len, slices[:-1])])
    first, number = bpe.distinct_slices(buf, starts)
    assert len(first) == len(set(slices)) and [slices[first[n]] for n in number] == slices
    ends = np.append(starts[1:], len(buf))
    eight = arrays.eights(buf)
    hashes = arrays.slice_hashes(np.frombuffer(buf, np.uint8), starts, ends, eight, arrays.heads(eight, starts, ends - starts)).tolist()
    assert len(set(hashes)) == len(set(slices)) == len(set(zip(slices, hashes, strict=True)))
    monkeypatch.setattr(bpe, "slice_hashes", lambda *a: np.zeros(len(slices), dtype=np.uint64))
    first, number = bpe.distinct_slices(buf, starts)
    assert [slices[first[n]] for n in number] == slices


def test_words_of_either_hash_are_the_same():
    texts = [t.encode() for t in ODD] + [b"a" * 300 + b" " + b"a" * 299 + b"b", b"", b"x " * 20_000, b"x"]
    plain, short = arrays.find_words(texts), arrays.find_words(texts, short=True)
    assert (plain.starts == short.starts).all() and (plain.offsets == short.offsets).all()
    assert len(set(plain.hashes.tolist())) == len(set(short.hashes.tolist())) == len(set(zip(plain.hashes.tolist(), short.hashes.tolist(), strict=True)))


def test_a_word_after_a_line_break_needs_no_pattern():
    """F1 (op2's CPU time): most fragments that are no single word are a line break and a word."""
    own, asked = bpe.Codec(vocabulary()), []

    class Pattern:
        def findall(self, text, pattern=own.split):
            asked.append(text)
            return pattern.findall(text)

    own.split = Pattern()
    texts = ["\nWord", "\n\u00e9t\u00e9", "\n word", "\n\nword", "\n", "\n 12", "\n'tis"]
    assert [ids(own.merge([t.encode()])[0]) for t in texts] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked == texts[3:]


def test_bytes_that_are_no_text_decode_as_in_the_library():
    for one in ([222], [222, 222, 64], [50256, 0]):
        assert CODEC.decode(np.array(one, "<u4").tobytes()).decode() == LIBRARY.decode(one, skip_special_tokens=False)


def test_rows(spark):
    rows = [(1, "x y", "c"), (1, "x y", "c"), (2, None, None), (None, "z", "c"), (3, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_decode(df, vocabulary()).collect()
    assert sorted((r.doc_id or 0, ids(r.ids), r.decoded) for r in got) == sorted((i or 0, LIBRARY.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in rows)
    assert bpe.encode_decode(df.where("false"), vocabulary()).count() == 0
    encoded = bpe.encode_texts(df, vocabulary())
    assert sorted(r.decoded for r in bpe.decode_ids(encoded, vocabulary()).collect()) == ["", "", "x y", "x y", "z"]


def _check_pieces(rows, texts, window):
    want = {i: LIBRARY.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    at, sequences = dict.fromkeys(want, 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = want[r.doc_id]
        assert r.start == at[r.doc_id] and r.length > 0 and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in want.items()}
    sizes = []
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= window
        sizes.append(end)
    return sizes


def test_packing_is_gapless_and_full(spark):
    rng = random.Random(2)
    texts = {k: " ".join(rng.choice(["red", "green", "blue", f"w{k % 7}"]) for _ in range(rng.randrange(90))) for k in range(300)}
    texts |= {300: None, 301: "", 302: "long " * 3000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sizes = _check_pieces(packing.pack_documents(df, vocabulary(), length=256).collect(), texts, 256)
    assert sum(s != 256 for s in sizes) <= 1
    again = packing.pack_documents(df.repartition(3), vocabulary(), length=256)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, packing.pack_documents(df, vocabulary(), length=256).collect()))
    with_ids = packing.pack_documents(df, vocabulary(), length=256, with_ids=True)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in with_ids.limit(50).collect())


def test_packing_prefers_similar_documents(spark):
    topics = [f"{w}{k}" for w in ("sun", "sea") for k in range(20)]
    rows = [(k, " ".join(topics[20 * (k % 2) : 20 * (k % 2) + 20])) for k in range(40)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary(), length=256).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, set()).add(r.doc_id % 2)
    assert sum(len(x) == 1 for x in by.values()) >= len(by) - 2


def test_packing_weighs_each_distinct_term_once():
    """F1 (op2's CPU time): the logarithm of a term's frequency is taken once for a block, not for each text that holds it."""
    asked = []

    class Counted(packing.Statistics):
        def rarity(self, df):
            asked.append(len(df))
            return super().rarity(df)

    texts = [b"a b c d%d" % k for k in range(50)]
    terms, _, _, _ = packing.postings(texts)
    found, df = np.unique(terms, return_counts=True)
    corpus = Counted(found[df > 1], df[df > 1], 50, 200, 800)
    packing.Index(texts, corpus)
    packing.shards_of(texts, np.arange(50, dtype=np.uint64), corpus, 4)
    assert asked == [3, 3]


def test_packing_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b")], "doc_id long, text string")
    assert len(packing.pack_documents(df, vocabulary()).collect()) == 3
    assert packing.pack_documents(df.where("false"), vocabulary()).count() == 0


def test_index_ranks_by_the_formula():
    """All unused documents that share a term, by the sums of BM25 weights written out one by one; ties go to the first."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefghij") * (1 + rng.randrange(2)) for _ in range(rng.randrange(1, 25))) for _ in range(40)] + ["zz", "", "q r s", "q r s"]
    split = [t.split() for t in texts]
    mean = sum(map(len, split)) / len(split)
    df = {w: sum(w in x for x in split) for x in split for w in x}

    def score(seed, doc):
        total = 0.0
        for w in set(split[seed]) & set(split[doc]):
            tf = split[doc].count(w)
            total += math.log1p((len(split) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(split[doc]) / mean))
        return total

    index = packing.Index([t.encode() for t in texts])
    for seed in range(len(texts)):
        used = np.array([k == seed or k % 5 == 3 for k in range(len(texts))])
        want = {k: score(seed, k) for k in range(len(texts)) if not used[k] and set(split[seed]) & set(split[k])}
        got = index.neighbours(seed, used)
        assert sorted(got) == sorted(want)
        assert all(want[a] >= want[b] - 1e-9 for a, b in zip(got, got[1:], strict=False))
    assert index.neighbours(42, np.arange(44) == 42) == [43]


def test_packing_broadcasts_no_more_terms_than_stated(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_TERMS", 64)
    docs = [(k, " ".join(f"t{j}" for j in range(k, k + 400))) for k in range(0, 900, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = packing.corpus_statistics(df.select(df.text.alias("t")))
    assert 0 < len(got.terms) <= 64 and (np.diff(got.terms.astype(np.int64)) > 0).all()
    _check_pieces(packing.pack_documents(df, vocabulary(), length=256).collect(), dict(docs), 256)


def test_packing_brings_copies_of_a_large_corpus_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 4096)
    rng = random.Random(11)
    texts = [" ".join(f"t{k}_{rng.randrange(12)}" for _ in range(30)) + " the of and" for k in range(150)]
    rows = [(k, t) for k, t in enumerate(texts + texts)]  # ids of copies are far apart
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), vocabulary(), length=2048).collect()
    assert len({r.sequence_id >> 32 for r in got}) > 5
    shard = {r.doc_id: r.sequence_id >> 32 for r in got}
    assert all(shard[k] == shard[k + 150] for k in range(150))


def test_packing_statistics_are_those_of_all_documents(spark):
    texts = ["A b b", "a c", None, "", "a b d"]
    got = packing.corpus_statistics(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3))
    assert (got.n, got.words) == (5, 8) and sorted(got.df.tolist()) == [2, 3]


def test_packing_is_the_same_whatever_number_of_terms_is_broadcast(spark, monkeypatch):
    """terms that are not broadcast place documents and weigh as if they were."""
    monkeypatch.setattr(packing, "SHARD_BYTES", 4096)
    rng = random.Random(5)
    texts = [" ".join(f"r{rng.randrange(k % 90 + 1)}_{rng.randrange(40)}" for _ in range(30)) + " the of and" for k in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (300, None), (301, ""), (None, texts[0])], "doc_id long, text string").repartition(4)
    want = sorted(map(str, packing.pack_documents(df, vocabulary(), length=256).collect()))
    for most in (1, 64, 640):
        monkeypatch.setattr(packing, "MOST_TERMS", most)
        got = packing.corpus_statistics(df.select(df.text.alias("t")))
        assert not got.whole
        assert sorted(map(str, packing.pack_documents(df, vocabulary(), length=256).collect())) == want
    monkeypatch.undo()
    assert packing.corpus_statistics(df.select(df.text.alias("t"))).whole


def test_packing_ranks_all_documents_that_share_a_term():
    texts = [b" ".join(b"q%d" % k for k in range(60))] + [b"q%d x%d" % (k % 60, k) for k in range(120)]
    assert len(packing.Index(texts).neighbours(0, np.arange(121) == 0)) == 120
