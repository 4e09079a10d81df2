"""Near-duplicate documents: one-permutation hashing, banded buckets, star-shaped candidate edges, exact confirmation, blocks for what stays apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, grams, mixed, signed, slices, written
from .components import components

#: Bins of a signature and bands of a bucket key: a pair that agrees in 0.8 of its bins misses all of 32 buckets of 4
#: with a probability of (1 - 0.8**4)**32, 5 in 10**8; as that share varies, pairs at 0.8 do with 2 to 11 in 10**6.
BINS, BANDS = 128, 32
#: Members of a bucket that are ordered in one window; larger buckets are dealt to several.
RING = 4096
#: Rounds of star edges at most. What they leave apart is looked for exactly, so more only save pairs there.
ROUNDS = 4
#: Members and shingles of a block of those that are compared with all of another block at last, about.
MEMBERS, SHINGLES = 1024, 1 << 19


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle of each text, sorted; and the sizes of the sets.

    Words are lower-cased A-Z; a text with fewer than n words has all of them as one shingle, one without has none.
    """
    words = Words(texts, lower=True)
    h, rows, count = words.hashes(), words.rows(), words.counts
    rolled = grams(h, n)
    inside = rows[: len(rolled)] == rows[n - 1 :] if len(rolled) else np.zeros(0, bool)
    row, value = rows[: len(rolled)][inside], rolled[inside]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = np.full(len(short), 0xC0FFEE, np.uint64)
        for i in range(n - 1):
            at = words.offsets[short] + i
            has = count[short] > i
            own[has] = mixed(own[has] * np.uint64(0x100000001B3F) + h[at[has]] + np.uint64(1))
        row, value = np.concatenate([row, short]), np.concatenate([value, own])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(value) != 0)
    row, value = row[new], value[new]
    return row, value, np.bincount(row, minlength=len(texts))


def signatures(row: np.ndarray, value: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """One-permutation signatures (n x bins): the smallest hash of each bin.

    An empty bin takes the value of another, found by hashing (bin, attempt) until a bin that has one is met: the
    same for all sets, so equal bins stay as likely as the sets are alike (optimal densification).
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * bins, empty)
    spread = mixed(value)
    np.minimum.at(sig, row * bins + (spread % np.uint64(bins)).astype(np.int64), spread)
    sig = sig.reshape(n, bins)
    have = sig != empty
    open_row, open_bin = np.nonzero(~have & have.any(axis=1)[:, None])
    attempt = 0
    while len(open_row):
        attempt += 1
        to = (mixed(open_bin.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt << 20)) % np.uint64(bins)).astype(np.int64)
        met = have[open_row, to]
        sig[open_row[met], open_bin[met]] = sig[open_row[met], to[met]]
        open_row, open_bin = open_row[~met], open_bin[~met]
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(n x bands) bucket keys; the band is part of the hash."""
    n, bins = sig.shape
    parts = sig.reshape(n, bands, bins // bands)
    out = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for i in range(bins // bands):
        out = mixed(out * np.uint64(0x100000001B3F) + parts[:, :, i])
    return out


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set_hi, set_lo, keys): size, a 128-bit name of the shingle set, and its bucket keys.

    keys is null where the set is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                row, value, size = shingle_sets(b.column("text"), n)
                keys = band_keys(signatures(row, value, b.num_rows))
                hi, lo = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
                np.add.at(hi, row, mixed(value + np.uint64(0xA5A5)))
                np.add.at(lo, row, mixed(value ^ np.uint64(0x5A5A5A5A5A5A)))
                ends = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(keys.ravel())), mask=pa.array(size == 0))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(signed(hi)), pa.array(signed(lo)), lists],
                    ["doc_id", "n_shingles", "set_hi", "set_lo", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_hi long, set_lo long, keys array<long>")


def bucket_members(classes: DataFrame) -> DataFrame:
    """(key, rep, n, central): members of buckets of two or more, with the bucket's size.

    ``central`` is the sum of the sizes of a member's buckets. A text that many near copies were made from shares more
    buckets with them than they do with one another, so it is the most central of a bucket. ``classes``: (rep, keys).
    """
    members = classes.select("rep", F.explode("keys").alias("key"))
    held = members.join(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
    return held.join(held.groupBy("rep").agg(F.sum("n").alias("central")), "rep").select("key", "rep", "n", "central")


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def candidates(held: DataFrame, ring: int = RING) -> DataFrame:
    """(a, b), a < b: each bucket's members with its most central one, and each with the next less central.

    So a bucket of g gives 2 g pairs, not g * g. Most pairs of a group of near copies have the same centre in every
    band and meet again there; pairs are made distinct.
    """
    centre = held.groupBy("key").agg(F.max(F.struct("central", (-F.col("rep")).alias("col2"))).alias("c")).select("key", (-F.col("c.col2")).alias("centre"))
    star = held.join(centre, "key").filter("rep <> centre").select(*_ordered(F.col("centre"), F.col("rep")))
    # neighbours in order; a bucket of many thousands is dealt to windows of about ``ring``
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / F.lit(ring)))
    order = Window.partitionBy("key", part).orderBy(F.desc("central"), "rep")
    chain = held.filter("n > 2").select("rep", F.lag("rep").over(order).alias("before")).filter("before IS NOT NULL")
    return star.unionAll(chain.select(*_ordered(F.col("before"), F.col("rep")))).distinct()


def across(held: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): in buckets with members of several components, the most central member of each component with the most
    central one of all and with that of the next component in order."""
    placed = held.join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", "central", F.coalesce("component", "rep").alias("component"))
    best = F.max(F.struct("central", (-F.col("rep")).alias("col2")))
    heads = placed.groupBy("key", "component").agg(best.alias("h")).select("key", F.col("h.central").alias("central"), (-F.col("h.col2")).alias("rep"))
    mixed_keys = heads.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return candidates(heads.join(mixed_keys, "key"))


def apart(held: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """(g, rep, component): groups whose members have to be compared across components, as they share buckets.

    Components that meet in buckets make a family, which is a group; a family of over ``most`` members is left in its buckets, a
    group each, where it can have less to compare.
    """
    placed = held.join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    met = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key", "low")
    mixed_buckets = written(placed.join(met, "key"), "mixed-buckets")
    families = components(mixed_buckets.select(F.col("component").alias("u"), F.col("low").alias("v")))
    members = written(mixed_buckets.join(families.withColumnRenamed("component", "family"), F.col("component") == F.col("node")).select("key", "family", "rep", "component"), "families")
    sizes = members.select("family", "rep").distinct().groupBy("family").agg((F.count("*") > most).alias("large"))
    sizes = written(sizes, "family-sizes")  # so that Spark knows its size before it deals members by family
    marked = members.join(sizes, "family")
    own = marked.filter("NOT large").select(F.struct(F.lit(False).alias("bucket"), F.col("family").alias("id")).alias("g"), "rep", "component").distinct()
    return own.unionAll(marked.filter("large").select(F.struct(F.lit(True).alias("bucket"), F.col("key").alias("id")).alias("g"), "rep", "component"))


def dealt_in_blocks(groups: DataFrame, sets: DataFrame, members: int, shingles: int) -> DataFrame:
    """(g, x, y, block, rep, component, hashes): members with their sets, once for each pair of blocks that their block is in.

    Those of a group's largest component, which need no comparison with one another, have blocks of their own: of the
    others each pair of blocks is compared, and each with each of the largest component's. A block has about ``members``
    members and ``shingles`` hashes at most, a group as many blocks as that takes.
    """
    rows = groups.join(sets, "rep")
    by_component = rows.groupBy("g", "component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    largest = by_component.groupBy("g").agg(F.max(F.struct("n", "component"))["component"].alias("largest"))
    major = F.col("component") == F.col("largest")

    def needed(which: Column) -> Column:
        total = lambda c: F.sum(F.when(which, F.col(c)))
        return F.ceil(F.greatest(total("n") / members, total("shingles") / shingles)).cast("int")

    blocks = by_component.join(largest, "g").groupBy("g", "largest").agg(needed(~major).alias("minor"), needed(major).alias("major"))
    placed = rows.join(written(blocks, "blocks"), "g")
    hashed = F.xxhash64("rep")
    minor = F.pmod(hashed, "minor").cast("int")
    last = F.col("minor") + F.col("major") - 1
    own = F.when(major, F.col("minor") + F.pmod(hashed, "major").cast("int")).otherwise(minor).alias("block")
    placed = placed.select("g", "rep", "component", "hashes", "minor", own, F.when(major, F.col("minor") - 1).otherwise(last).alias("to"))
    pairs = F.transform(F.sequence(F.lit(0), "to"), lambda k: F.struct(F.least(k, "block").alias("x"), F.greatest(k, "block").alias("y")))
    return placed.select("g", "block", "rep", "component", "hashes", F.explode(pairs).alias("p")).select("g", "p.x", "p.y", "block", "rep", "component", "hashes")


def common_counts(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left x right) how many hashes any two different ones of the sets have in common.

    Hashes that over an eighth of the sets have are compared as bits, many at once; the pairs of the others are counted.
    """
    owner, value = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
    code, counts = np.unique(value, return_inverse=True, return_counts=True)[1:]
    shared = counts[code] > 1
    owner, code = owner[shared], code[shared]
    out = np.zeros((len(left), len(right)), np.int32)
    often = counts[code] * 8 > len(lists)
    names, column = np.unique(code[often], return_inverse=True)
    if len(names):
        bits = np.zeros((len(lists), -(-len(names) // 64) * 64), bool)
        bits[owner[often], column] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for i, x in enumerate(left):
            out[i] = np.bitwise_count(packed[x] & packed[right]).sum(axis=1)
    owner, code = owner[~often], code[~often]
    sides = []
    for side in (left, right):
        place = np.full(len(lists), -1)
        place[side] = np.arange(len(side))
        mine = place[owner] >= 0
        order = np.argsort(code[mine], kind="stable")
        sides.append((code[mine][order], place[owner[mine]][order]))
    (hash_l, at_l), (hash_r, at_r) = sides
    begin, end = np.searchsorted(hash_r, hash_l), np.searchsorted(hash_r, hash_l, "right")
    n = end - begin
    step = np.cumsum(n) // (1 << 22)
    for c in range(int(step[-1]) + 1 if len(step) else 0):
        mine = slice(*np.searchsorted(step, [c, c + 1]))
        k = n[mine]
        other = np.repeat(begin[mine] - np.cumsum(k) + k, k) + np.arange(k.sum())
        out += np.bincount(np.repeat(at_l[mine], k) * len(right) + at_r[other], minlength=out.size).reshape(out.shape).astype(np.int32)
    return out


def block_links(groups: DataFrame, texts: DataFrame, n: int, percent: int, members: int = MEMBERS, shingles: int = SHINGLES) -> DataFrame:
    """(u, v): links between components of each group, enough of them to join all that are linked.

    Sets travel as hashes, to each pair of blocks once; a task compares two blocks and gives links that make a forest, so
    neither pairs nor texts of pairs are ever rows.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                _, value, size = shingle_sets(b.column("text"), n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(signed(value)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), lists], ["rep", "size", "hashes"])

    wanted = written(groups.select(F.col("rep").alias("doc_id")).distinct(), "compared")
    sets = written(texts.join(wanted, "doc_id", "left_semi").mapInArrow(hashes, "rep long, size long, hashes array<long>"), "sets")
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        block, rep, component = (t.column(c).to_numpy() for c in ("block", "rep", "component"))
        lists = t.column("hashes").combine_chunks()
        ends, flat = np.asarray(lists.offsets), lists.values.to_numpy()
        each = [flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        size = np.diff(ends)
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        if not (len(left) and len(right)):
            return out.empty_table()
        common = common_counts(each, left, right)
        union = size[left][:, None] + size[right][None, :] - common
        i, j = np.nonzero((100 * common >= percent * union) & (common > 0) & (component[left][:, None] != component[right][None, :]))
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        kept = []
        for p, q in zip(left[i].tolist(), right[j].tolist(), strict=True):
            a, b = root(int(component[p])), root(int(component[q]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                kept.append((int(rep[p]), int(rep[q])))
        return pa.table([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], schema=out)

    dealt = dealt_in_blocks(groups, sets, members, shingles)
    return dealt.groupBy("g", "x", "y").applyInArrow(compare, "u long, v long")


def confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are alike enough: 100 * intersection >= percent * union.

    ``texts``: (doc_id, text). Both texts travel to the pair; the text table is shuffled once and used twice.
    """
    one = texts.join(pairs, texts["doc_id"] == pairs["a"]).select("a", "b", F.col("text").alias("text_a"))
    both = texts.join(one, texts["doc_id"] == one["b"]).select("a", "b", "text_a", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text_a", 1 << 20):
                m = b.num_rows
                row, value, size = shingle_sets(pa.concat_arrays([b.column("text_a"), b.column("text")]), n)
                side, pair = row // m, row % m
                order = np.lexsort((side, value, pair))
                same = (np.diff(value[order]) == 0) & (np.diff(pair[order]) == 0)
                common = np.bincount(pair[order][1:][same], minlength=m)
                union = size[:m] + size[m:] - common
                good = pa.array((100 * common >= percent * union) & (common > 0))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(good), b.column("b").filter(good)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Every document with the group of near duplicates that it belongs to.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links lead to, itself included) and kept
    (doc_id = component_id). Documents are linked when their sets of n-word shingles are alike by ``percent`` or
    more. Documents with equal sets are one class with its smallest doc_id as representative, so copies are never
    paired; candidates between classes come from buckets and are confirmed on full sets. ROUNDS of star edges at most
    join components; then all that share buckets across components are compared in blocks, exactly (block_links).

    Null and empty texts have no shingles and are linked with nothing. A null doc_id is linked with nothing either
    (component_id null, kept true). Rows that share a doc_id are one node: each keeps its row, with the component
    that any of them has. Whole texts are compared, however long. An empty table gives no rows; other columns are not
    read.
    """
    base = written(sketches(docs, n), "sketches")
    known = base.filter("doc_id IS NOT NULL AND keys IS NOT NULL")
    # any() of equal lists; all members of a class have the same keys
    classes = known.groupBy("set_hi", "set_lo", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("keys").alias("keys"))
    classes = written(classes, "classes")
    held = written(bucket_members(classes.select("rep", "keys")), "buckets")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    own = known.select("doc_id", "set_hi", "set_lo", "n_shingles").join(
        classes.select("set_hi", "set_lo", "n_shingles", "rep"), ["set_hi", "set_lo", "n_shingles"]
    )
    copies = own.filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links, tried, found = copies, None, None

    def tested(pairs: DataFrame) -> DataFrame:
        """Links among pairs that haven't been looked at before."""
        nonlocal tried
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionAll(pairs)
        ends = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
        new = confirm(pairs, texts.join(ends, "doc_id", "left_semi"), n, percent)
        return written(new.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")

    for turn in range(ROUNDS):  # after the first, buckets in which components still stand apart
        new = tested(across(held, found) if turn else candidates(held))
        if turn and new.isEmpty():
            break
        links = links.unionAll(new)
        found = components(links)
    groups = written(apart(held, found, BANDS * MEMBERS), "apart")
    if not groups.isEmpty():
        new = written(block_links(groups, texts, n, percent), "links")
        if not new.isEmpty():
            found = components(links.unionAll(new))
    grouped = base.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return grouped.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
