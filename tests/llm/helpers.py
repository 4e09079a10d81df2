"""Plain models of the operators, and awkward documents."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, stock=400):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


def awkward(seed=1):
    """Documents with nulls, empty and long texts, copies, near copies, shared passages, repeated rows, odd characters."""
    rng = random.Random(seed)
    passage, base = prose(rng, 70), prose(rng, 200)
    rows = [(i, prose(rng, rng.randrange(1, 150)), rng.choice(["en", "de", None]), f"s{i % 4}") for i in range(30)]
    rows += [(100 + i, base, "en", "s0") for i in range(6)]  # copies
    for i in range(6):  # near copies
        w = base.split()
        w[rng.randrange(200)] = f"edit{i}"
        rows.append((200 + i, " ".join(w), "en", "s1"))
    rows += [(300 + i, f"{prose(rng, 40)}\n{passage}\t{prose(rng, 40)}", "en", None) for i in range(5)]
    rows += [(310, f"{passage} between {passage}", "en", "s2")]  # repeats within a text
    rows += [(400, None, "en", "s0"), (401, "", "en", "s0"), (402, " \t\n ", None, None), (403, "one", "en", "s3"), (404, None, None, None)]
    rows += [(500, base, "en", "s0"), (500, base, "en", "s0"), (500, "another text under one id " * 12, "en", "s0")]  # repeated rows and ids
    rows += [(None, base, "en", "s0"), (None, None, None, None)]
    rows += [(600, prose(rng, 30_000), "en", "s2"), (601, "same " * 5_000, "en", "s2"), (602, "x" * 50_000, "de", "s2")]  # long ones
    rows += [(700, "Ünïcode  wörds here   漢字 😀 \x1c\x85 ▁ ▁▁x", "de", "\U0001f600"), (701, "ÜNÏCODE wörds", "de", "z")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def frame(spark, rows, clash=False):
    """Rows as documents; with ``clash`` other columns have names that operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        names = "size h skey part row stretches keys packed key start n kind node component n_words kept vslot shard copies target rounds score ids tie sk next"
        for name in names.split():
            df = df.selectExpr("*", f"'mine' AS `{name}`")
    return df


def windows(rows, size=50):
    """Kept text and number of removed words of (doc_id, text), by windows of smaller doc_ids."""
    low = {}
    for i, t, *_ in rows:
        w = words(t)
        for s in range(len(w) - size + 1):
            if i is not None:
                k = " ".join(w[s : s + size])
                low[k] = min(low.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        w, gone = words(t), set()
        for s in range(len(w) - size + 1):
            if i is not None and low[" ".join(w[s : s + size])] < i:
                gone |= set(range(s, s + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def repeats(rows, size=50):
    """(doc_id, n_words, n_repeated, n_removed): a window's first place by (doc_id, word) stays."""
    places = defaultdict(set)
    for i, t, *_ in rows:
        w = words(t)
        for s in range(len(w) - size + 1):
            if i is not None:
                places[" ".join(w[s : s + size])].add((i, s))
    out = []
    for i, t, *_ in rows:
        w, seen, gone = words(t), set(), set()
        for s in range(len(w) - size + 1):
            if i is None:
                break
            p = places[" ".join(w[s : s + size])]
            seen |= set(range(s, s + size)) if len(p) > 1 else set()
            gone |= set(range(s, s + size)) if (i, s) > min(p) else set()
        out.append((i, len(w), len(seen), len(gone)))
    return sorted(out, key=str)


def shingles(text, n):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def groups(rows, n=5, percent=80):
    """(doc_id, n_shingles, component_id)."""
    sets = [(i, shingles(t, n)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i) if s else i) for i, s in sets), key=str)


def base_counts(text):
    w = words(text)
    five = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hash64(*values):
    """Spark's xxhash64 of longs, texts and lists of longs; nulls are passed over."""
    seed = 42
    for v in values:
        for x in v if isinstance(v, list) else [v]:
            if x is not None:
                seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack("<q", x), seed)
    return _signed(seed)


def fingerprint(text, n=5, k=64):
    h = [hash64(w) for w in words(text)]
    every = [hash64(h[i : i + n]) for i in range(len(h) - n + 1)] or ([hash64(h)] if h else [])
    return sorted(set(every))[:k]


def likeness(a, b, k=64):
    both = sorted(set(a) | set(b))[:k]
    return len(set(both) & set(a) & set(b)) / len(both) if both else 1.0


def edits(rows):
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) in descending doc_id, ties by the text's hash."""
    held = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hash64(r[1])))
    hexed = lambda s: "".join(f"{x % (1 << 64):016x}" for x in s)
    out = []
    for k, (i, t) in enumerate(held):
        after = held[(k + 1) % len(held)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = fingerprint(t), fingerprint(edited), fingerprint(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def shards(rows, n, slots):
    """(doc_id, size, checksum, shard): virtual slots by hash, dealt by falling bytes to the lightest shard."""
    seen, records = Counter(), []
    for i, t, *_ in rows:
        r = (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        records.append((*r, hash64(i, r[2], r[1], seen[r]) % slots))
        seen[r] += 1
    totals, loads, shard = Counter(), [0] * n, {}
    for _, size, _, slot in records:
        totals[slot] += size
    for slot, size in sorted(totals.items(), key=lambda x: (-x[1], x[0])):
        shard[slot] = min(range(n), key=lambda s: (loads[s], s))
        loads[shard[slot]] += size
    return sorted(((i, size, crc, shard[slot]) for i, size, crc, slot in records), key=str)
