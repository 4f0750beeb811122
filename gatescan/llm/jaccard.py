"""Operator 10: a similarity join on the Jaccard index of word shingles, by a grouped prefix join.

A document's set is its distinct 5-word shingles, lower-cased (A-Z). Two sets of similarity 0.8 or more must share a shingle
among the first n - ceil(0.8 n) + 1 of each in any one order of all shingles; the order here is by document frequency, rarest
first, which Spark counts over all documents. Shingles of frequency 1 can match nothing and are left out of the prefixes.

1. Equal sets make one class with one representative, whatever the number of copies.
2. Representatives with the same prefix and set size make one group. A prefix shingle has a list of groups; of lists with the
   same groups one is kept. Groups of a list are the candidates, filtered by size, by the positions of the shingle and by
   sketches of the sets.
   Shingles of frequency 1 come first in a set's order and count as sure misses. A large list first loses the entries to which no
   size and position in the list can be a partner.
3. Surviving pairs of groups are expanded to members, which are tested by their sketches and then verified on the whole sets.
   The members of a group stand in packets beside it, so they are expanded inside the task and make no rows of their own.

As only components are asked for, a pair is not compared once its two sides are connected. So at first every member is compared
with the smallest of its group, and every group with LEADERS leaders, one for each of so many orders of the groups: of the leaders
of its lists the one that it shares most lists with. Lists and groups that then still hold several components are compared
completely, in blocks of bounded size: first each entry goes on with its FIRST smallest partners, and once these are verified
and their components joined, with all that are still apart. No pair of different components is left out, so no link between components is lost, and
a group of near copies costs a few comparisons for each member.

A sketch has the parity of the number of shingles in each of a power of two of hash cells, at least as many as the set has
shingles. Two sets differ in at least as many shingles as their sketches in cells, so the test never drops a link. The larger
of two sketches is folded to the size of the smaller.

Defined cases: null, empty or wordless texts have no shingles and link with nothing; fewer than 5 words make one shingle; a
null id links with nothing and has a null component; rows with the same id are the same document; only the id and text
columns are read. Shingles are 64-bit hashes; a frequency is counted on a prefix of the hash, which can only add candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatescan.llm import chunks as C
from gatescan.llm.arrays import find_words, group_starts, mix64, rolling, windows
from gatescan.llm.bpe import raw_texts
from gatescan.llm.components import connected_components

SHINGLE, PERCENT = 5, 80
#: Leaders that every group is compared with before everything that is still open is.
LEADERS = 3
#: Partners of an entry in a list that are verified before all that are left.
FIRST = 4
#: Bits of the smallest sketch, members of one side of a block, members of a packet and of a task, and parts that the pairs of one
#: set are cut into.
SKETCH_BITS, BLOCK, PACKET, TASK_ENTRIES, VERIFY_PARTS = 1024, 512, 64, 8192, 32


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, shingle hash) pairs, ascending."""
    words = find_words([t.lower() for t in texts])
    keys, owner, _ = windows(words, size)
    count = np.diff(words.offsets)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.array([mix64(rolling(words.hashes[words.offsets[k] : words.offsets[k + 1]], int(count[k])) + np.uint64(count[k]))[0] for k in short.tolist()], dtype=np.uint64)
        keys, owner = np.concatenate([keys, extra]), np.concatenate([owner, short])
    order = np.argsort(keys)
    if len(texts) < 1 << 16:
        order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(owner[order], kind="stable")]
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], keys[new]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))]


def parity_sketches(keys: np.ndarray, ends: np.ndarray, n: np.ndarray, used: np.ndarray) -> list[bytes | None]:
    """The sketch of each set in keys (which end at ends and have n entries), None where it isn't used."""
    bits = np.where(used, np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)), 0)
    base = np.cumsum(bits) - bits
    own = np.repeat(used, n)
    cells = np.repeat(base, n)[own] + (mix64(keys[own]) & np.repeat(np.maximum(bits, 1) - 1, n)[own].astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(cells, minlength=int(bits.sum())) & 1).astype(bool)).tobytes()
    return [packed[a // 8 : (a + b) // 8] if b else None for a, b in zip(base.tolist(), bits.tolist(), strict=True)]


def documents_with_prefixes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, sig1, sig2, prefix array<long>, position array<int>, sketch binary, members binary);
    sketch and members only with a prefix."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    chunks = C.checkpoint(C.pack(docs, "t"))
    total = C.total_bytes(chunks)
    width = min(64, 8 * math.ceil((math.log2(max(2, total)) + 1) / 8))
    cut = np.uint64(64 - width)

    def keys_of(rows: pa.Table):
        _, keys = shingle_sets(raw_texts(rows.column("t").combine_chunks()), size)
        keys = np.sort(keys >> cut << cut)
        starts = group_starts(keys)
        return keys[starts], np.diff(np.append(starts, len(keys)))

    def judge(count, starts):
        return np.repeat(np.minimum(np.add.reduceat(count, starts), 65535), np.diff(np.append(starts, len(count))))

    def finish(rows: pa.Table, frequency: np.ndarray) -> pa.Table:
        texts = raw_texts(rows.column("t").combine_chunks())
        owner, keys = shingle_sets(texts, size)
        df = frequency[np.searchsorted(np.unique(keys >> cut), keys >> cut)] if len(keys) else np.empty(0, dtype=np.uint64)
        ends = np.searchsorted(owner, np.arange(len(texts)), side="right")
        n = np.diff(np.concatenate(([0], ends)))
        order = np.lexsort((keys, df, owner))
        place = np.arange(len(keys)) - np.repeat(ends - n, n)
        need = n - (percent * n + 99) // 100 + 1
        use = (df[order] > 1) & (place < np.repeat(need, n))
        use &= np.repeat(np.array(rows.column("doc_id").combine_chunks().is_valid()), n)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[use], minlength=len(texts))))).astype(np.int32)
        prefix = pa.ListArray.from_arrays(offsets, keys[order][use].view(np.int64))
        position = pa.ListArray.from_arrays(offsets, place[use].astype(np.int32))
        used = np.diff(offsets) > 0
        members = [keys[e - k : e].tobytes() if u else None for e, k, u in zip(ends.tolist(), n.tolist(), used.tolist(), strict=True)]
        sketch = parity_sketches(keys, ends, n, used)
        sig = [_sums(mix64(keys ^ np.uint64(salt)), ends).view(np.int64) for salt in (1, 2)]
        return pa.table({"doc_id": rows.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "sig1": sig[0], "sig2": sig[1], "prefix": prefix, "position": position, "sketch": pa.array(sketch, pa.binary()), "members": pa.array(members, pa.binary())})

    answers = C.answer(C.scatter(chunks, keys_of, C.bucket_bits(total)), judge)
    return C.gather(chunks, answers, finish, "doc_id long, n_shingles long, sig1 long, sig2 long, prefix array<long>, position array<int>, sketch binary, members binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int, about: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; `about` so many pairs. A set on side a is sent at most VERIFY_PARTS times,
    and a task sees so large a share of its pairs."""
    cut = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(VERIFY_PARTS)))
    parts = max(128, about // 1024)
    part = lambda a, salt: F.pmod(F.xxhash64(a, salt), F.lit(parts)).alias("part")
    by_b = cut.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("set_b")), "b").select(part("a", "salt"), "a", "salt", "b", "set_b")
    own = cut.select(F.col("a").alias("own"), F.col("salt").alias("block")).distinct()
    by_a = own.join(sets.select(F.col("doc_id").alias("own"), F.col("members").alias("set_a")), "own").select(part("own", "block"), "own", "block", "set_a")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.column("set_a")
        at = {k: i for i, k in enumerate(zip(right.column("own").to_pylist(), right.column("block").to_pylist(), strict=True))}
        keep, last, x = [], None, np.empty(0, dtype=np.uint64)
        order = pa.compute.sort_indices(left, [("a", "ascending"), ("salt", "ascending"), ("b", "ascending")])
        left = left.take(order)
        for key, other in zip(zip(left.column("a").to_pylist(), left.column("salt").to_pylist(), strict=True), left.column("set_b"), strict=True):
            if key != last:
                last, x = key, np.frombuffer(rows[at[key]].as_py(), dtype=np.uint64)
            y = np.frombuffer(other.as_py(), dtype=np.uint64)
            joined = np.sort(np.concatenate((x, y)))
            common = int((joined[1:] == joined[:-1]).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        C.give_back()
        return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return by_b.groupBy("part").cogroup(by_a.groupBy("part")).applyInArrow(run, "a long, b long")


def _compatible(percent: int):
    """Size and position filter for rows with n, pos, lone and n2, pos2, lone2: can the pair still reach the similarity? The lone
    shingles of a set, those of no other document, come first in its order and match nothing."""
    most = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) + F.least(F.col("pos") - F.col("lone"), F.col("pos2") - F.col("lone2"))
    return most * F.lit(100 + percent) >= F.lit(percent) * (F.col("n") + F.col("n2"))  # most: shingles in common at most


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cells in which each sketch of x (rows of longs) differs from each of y; the longer ones are folded."""
    while x.shape[1] > y.shape[1]:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    while y.shape[1] > x.shape[1]:
        y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def close_pairs(entries: DataFrame, percent: int, first: int | None = None) -> DataFrame:
    """(a, b) with a < b, of the `first` smallest a for each b in a list (all if None): pairs of members of different groups in
    the same list, or of one group in its own list, that may reach the similarity and are not known to be connected.

    entries: (list long, whole long, gid long, packet int, n long, pos int, lone int, comp long, within boolean, docs array<long>,
    comps array<long>, sketches array<binary>), an entry for each packet of a group's members. comp is the component of the
    group, null for one of several; comps are those of the members. Pairs of groups are filtered by size, position and
    component, and only the members of those that are left by their sketches. `whole` is the number of members in the list: a
    list above BLOCK is cut into blocks, and each pair of blocks is compared on its own.
    """
    entries = entries.withColumn("cuts", F.ceil(F.col("whole") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("gid", "packet", F.lit(11)), F.col("cuts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    block = F.when(F.col("pair.x") == F.col("pair.y"), -1).otherwise((F.col("own") == F.col("pair.y")).cast("int"))
    dealt = entries.withColumn("pair", F.explode(pairs)).withColumn("h", F.xxhash64("list", "pair")).withColumn("block", block).drop("cuts", "own", "pair", "whole")
    cut, seen = C.stored_with(dealt, n=F.coalesce(F.sum(F.size("docs")), F.lit(0)))
    parts = max(64, seen["n"] // TASK_ENTRIES)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.lexsort([table.column(c).to_numpy() for c in ("packet", "gid", "list", "h")]))
        h, lists, gid, n, pos, lone, block = (table.column(c).to_numpy().astype(np.int64) for c in ("h", "list", "gid", "n", "pos", "lone", "block"))
        mixed, within = np.array(table.column("comp").is_null()), np.array(table.column("within"))
        comp = np.array(table.column("comp").fill_null(0)).astype(np.int64)
        docs, comps, sketches = (pa.compute.list_flatten(table.column(c)) for c in ("docs", "comps", "sketches"))
        docs, comps, sketches = docs.to_numpy(), comps.to_numpy(), sketches.to_pylist()
        ends = np.cumsum(np.array(pa.compute.list_value_length(table.column("docs"))).astype(np.int64))
        begins = np.concatenate(([0], ends[:-1]))
        width = np.array([len(sketches[k]) for k in begins.tolist()])
        cuts = np.append(np.flatnonzero((h[1:] != h[:-1]) | (lists[1:] != lists[:-1])) + 1, len(h)).tolist()

        def members(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The members of the groups and the number of each one's group."""
            size = (ends - begins)[groups]
            owner = np.repeat(np.arange(len(groups)), size)
            return begins[groups][owner] + np.arange(len(owner)) - (np.cumsum(size) - size)[owner], owner

        def rows(at: np.ndarray) -> np.ndarray:
            return np.frombuffer(b"".join([sketches[k] for k in at.tolist()]), dtype=np.uint64).reshape(len(at), -1)

        def compare(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The pairs of members of the groups i and j (each of one width of sketches), which are the same or differ all."""
            both = n[i][:, None] + n[j][None, :]
            most = np.minimum((n[i] - pos[i])[:, None], (n[j] - pos[j])[None, :]) + np.minimum((pos - lone)[i][:, None], (pos - lone)[j][None, :])
            ok = (most * (100 + percent) >= percent * both) & (mixed[i][:, None] | mixed[j][None, :] | (comp[i][:, None] != comp[j][None, :]))
            ok &= (block[i][:, None] < 0) | (block[i][:, None] != block[j][None, :])
            ok &= within[i][:, None] | (gid[i][:, None] != gid[j][None, :])
            i, j, ok, both = i[ok.any(axis=1)], j[ok.any(axis=0)], ok[ok.any(axis=1)][:, ok.any(axis=0)], both[ok.any(axis=1)][:, ok.any(axis=0)]
            (x, of_x), (y, of_y) = members(i), members(j)
            ok = ok[of_x][:, of_y] & (comps[x][:, None] != comps[y][None, :])
            if same := np.isin(x, y).any():
                ok &= docs[x][:, None] < docs[y][None, :]
            some_x, some_y = ok.any(axis=1), ok.any(axis=0)
            x, y, ok, both = x[some_x], y[some_y], ok[some_x][:, some_y], both[of_x[some_x]][:, of_y[some_y]]
            if ok.any():
                ok &= (both - _differ(rows(x), rows(y))) * (100 + percent) >= 2 * percent * both
            u, v = np.nonzero(ok)
            low, high = docs[x[u]], docs[y[v]]
            return (low, high) if same else (np.minimum(low, high), np.maximum(low, high))

        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]
        for a, e in zip([0, *cuts[:-1]], cuts, strict=True):
            classes = [np.flatnonzero(width[a:e] == w) + a for w in np.unique(width[a:e]).tolist()]
            x, y = (np.concatenate(z) for z in zip(*[compare(i, j) for k, i in enumerate(classes) for j in classes[k:]], strict=True))
            if first and len(x):
                order = np.lexsort((x, y))
                x, y = x[order], y[order]
                starts = group_starts(y)
                few = np.arange(len(y)) - np.repeat(starts, np.diff(np.append(starts, len(y)))) < first
                x, y = x[few], y[few]
            found.append((x, y))
        x, y = (np.concatenate(z) for z in zip(*found, strict=True))
        order = np.lexsort((y, x))  # a pair of several lists of this task goes on once
        x, y = x[order], y[order]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        out = pa.table({"a": x[new], "b": y[new]})
        del found, sketches, docs, comps
        C.give_back()
        return out

    return cut.withColumn("part", F.pmod(F.col("h"), F.lit(parts))).groupBy("part").applyInArrow(run, "a long, b long").distinct()


def with_partners(entries: DataFrame, percent: int) -> DataFrame:
    """Of lists above BLOCK, the entries (list, whole, gid, n, pos, lone, within) that may have a partner in the list by sizes and
    positions; all entries of other lists.

    An entry is held against the list's sizes, with the largest number of shingles that a group of each size has from the list's
    shingle on, and before it. So what is compared are the kinds of entries of a list with its sizes, not its entries. A list of
    texts that share a frame but too little else loses all entries here.
    """
    kind = ["list", "n", "pos", "lone"]
    hot = entries.where(F.col("whole") > BLOCK)
    kinds = hot.select(*kind).distinct()
    sizes = kinds.groupBy("list", F.col("n").alias("n2")).agg(F.max(F.col("n") - F.col("pos")).alias("rest2"), F.max(F.col("pos") - F.col("lone")).alias("before2"))
    most = F.least(F.col("n") - F.col("pos"), F.col("rest2")) + F.least(F.col("pos") - F.col("lone"), F.col("before2"))
    fit = kinds.join(sizes, "list").where(most * F.lit(100 + percent) >= F.lit(percent) * (F.col("n") + F.col("n2")))
    return entries.where(F.col("whole") <= BLOCK).unionByName(hot.join(C.stored(fit.select(*kind).distinct()), kind, "left_semi"))


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles long, component_id long): the smallest id reachable by links, for each row of docs."""
    rows = C.stored(documents_with_prefixes(docs, id_col, text_col, size, percent))
    sets = C.stored(rows.where("members is not null").select("doc_id", "members"))
    small = C.stored(rows.where("doc_id is not null and n_shingles > 0").groupBy("n_shingles", "sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("position").alias("position"), F.first("sketch").alias("sketch")))
    reps = small.where(F.size("prefix") > 0).select(F.col("rep").alias("doc"), F.col("n_shingles").alias("n"), "prefix", "position", "sketch", F.xxhash64("prefix", F.lit(7)).alias("k1"), F.xxhash64("prefix", F.lit(8)).alias("k2"))
    groups = C.stored(reps.groupBy("n", "k1", "k2").agg(F.min("doc").alias("gid"), F.first("prefix").alias("prefix"), F.first("position").alias("position")))
    members = C.stored(reps.join(groups.select("n", "k1", "k2", "gid", F.get("position", F.lit(0)).alias("lone")), ["n", "k1", "k2"]).select("gid", "doc", "n", "lone", "sketch"))

    # the lists of groups, one of those that are equal (one token each), with their leaders
    groups = groups.withColumn("lone", F.get("position", F.lit(0)))  # a prefix begins after the lone shingles
    tokens = groups.select("gid", "n", "lone", F.explode(F.arrays_zip("prefix", "position")).alias("x")).select("gid", "n", "lone", F.col("x.prefix").alias("token"), F.col("x.position").alias("pos"))
    leader = lambda k: F.min_by(F.struct("gid", "n", "pos", "lone"), F.col("gid") if not k else F.xxhash64("gid", F.lit(k))).alias(f"l{k}")
    lists = tokens.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("gid", F.lit(1))).alias("s1"), F.bit_xor(F.xxhash64("gid", F.lit(2))).alias("s2"), *[leader(k) for k in range(LEADERS)]).where("c > 1")
    lists = lists.withColumn("leads", F.array_distinct(F.array(*[f"l{k}" for k in range(LEADERS)]))).groupBy("c", "s1", "s2").agg(F.min(F.struct("token", "leads")).alias("x"))
    lists = C.stored(lists.select(F.col("x.token").alias("token"), "c", "x.leads"))
    tokens = C.stored(tokens.join(lists, "token"))

    # each group with the leaders it shares most lists with, and each member with its group
    led = tokens.select("gid", "n", "pos", "lone", F.posexplode("leads").alias("k", "l")).select("gid", "n", "pos", "lone", "k", F.col("l.gid").alias("lead"), F.col("l.n").alias("n2"), F.col("l.pos").alias("pos2"), F.col("l.lone").alias("lone2"))
    near = ((F.col("n") - F.col("lone")) * F.lit(100 + percent) >= F.lit(2 * percent) * F.col("n"))  # members of one group can be similar at all
    between = led.where("gid <> lead").where(_compatible(percent)).groupBy("lead", "gid", "k").count().groupBy("gid", "k").agg(F.max_by("lead", F.struct("count", -F.col("lead"))).alias("lead"))
    pairs = between.select(F.least("lead", "gid").alias("a"), F.greatest("lead", "gid").alias("b")).unionByName(members.where("gid <> doc").where(near).select(F.col("gid").alias("a"), F.col("doc").alias("b")))
    tried, some = C.stored_with(pairs.distinct(), n=F.count(F.lit(1)))
    found = connected_components(verify(tried, sets, percent, some["n"]))
    for first in (FIRST, None):
        placed = members.join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
        placed = C.stored(placed.select("gid", "doc", "n", "comp", "sketch"))
        held = C.stored(placed.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).select("gid", F.when(F.col("low") == F.col("high"), F.col("low")).alias("comp"), "m"))

        # the lists that are still open, and open groups as lists of their own, with the groups' members in packets
        several = tokens.select("token", "gid").join(held, "gid").groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count_if(F.col("comp").isNull()).alias("mixed"), F.sum("m").alias("whole")).where("low <> high or mixed > 0").select("token", "whole")
        open_lists = C.stored(tokens.select("token", "gid", "n", "pos", "lone").join(C.stored(several), "token").select(F.col("token").alias("list"), "whole", "gid", "n", "pos", "lone", F.lit(False).alias("within")))
        packets = placed.drop("n").join(held.withColumnRenamed("comp", "own"), "gid").withColumn("packet", F.pmod(F.xxhash64("doc", F.lit(5)), F.ceil(F.col("m") / PACKET)).cast("int"))
        packets = packets.groupBy("gid", "packet").agg(F.first("own").alias("comp"), F.collect_list(F.struct("doc", "comp", "sketch")).alias("x"))
        packets = C.stored(packets.select("gid", "packet", "comp", F.col("x.doc").alias("docs"), F.col("x.comp").alias("comps"), F.col("x.sketch").alias("sketches")))
        alone = held.where("comp is null").join(groups.select("gid", "n", "lone"), "gid").select(F.xxhash64("gid", F.lit(6)).alias("list"), F.col("m").alias("whole"), "gid", "n", F.col("lone").alias("pos"), "lone", F.lit(True).alias("within")).where(near)
        pairs = close_pairs(with_partners(open_lists.unionByName(alone), percent).join(packets, "gid"), percent, first).join(tried, ["a", "b"], "left_anti")
        pairs, some = C.stored_with(pairs, n=F.count(F.lit(1)))
        if not some["n"]:
            continue
        found, tried = connected_components(verify(pairs, sets, percent, some["n"]), known=found), tried.unionByName(pairs)

    placed = rows.select("doc_id", "n_shingles", "sig1", "sig2").join(small.select("n_shingles", "sig1", "sig2", "rep"), ["n_shingles", "sig1", "sig2"], "left")
    result = placed.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return result.select(F.col("doc_id").alias(id_col), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
