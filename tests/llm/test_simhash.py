import random

import numpy as np
import xxhash

from latticore.llm import simhash


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    comp = {f: f for f in fps}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    fs = list(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 4:
                comp[root(a)] = root(b)
    return {f: root(f) for f in fs}


def test_golay_code_is_perfect():
    errors = simhash.error_table()
    assert len(set(errors.tolist())) == 2048
    words = np.random.default_rng(1).integers(0, 1 << 23, 400).astype(np.uint32)
    row, key = simhash.fuzzy(words, errors)
    assert set(np.bincount(row)) <= {1, 6}
    near = {k: set(key[row == k].tolist()) for k in range(len(words))}
    for i in range(23):
        for j in range(i, 23):  # one bit (i = j) or two
            flip = np.uint32(1 << i | 1 << j)
            row2, key2 = simhash.fuzzy(words[:40] ^ flip, errors)
            assert all(near[k] & set(key2[row2 == k].tolist()) for k in range(40))


def test_keys_cover_four_bits_and_are_rare_by_chance():
    errors = simhash.error_table()
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, 300, dtype=np.uint64)
    other = fp.copy()
    for k in range(len(fp)):
        for b in rng.choice(64, k % 5, replace=False):
            other[k] ^= np.uint64(1) << np.uint64(b)

    def keys(x):
        got = [set() for _ in x]
        for row, key in (simhash.exact_keys(x), simhash.fuzzy_keys(x, errors)):
            for r, k in zip(row.tolist(), key.tolist()):
                got[r].add(k)
        return got

    a, b = keys(fp), keys(other)
    assert all(x & y for x, y in zip(a, b))
    assert sum(bool(x & y) for i, x in enumerate(a) for y in a[:i]) == 0


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "One", "a b c", "A B C D", "é É Ünï x code \x0b words go here", "w " * 70000, "x\x00y z " * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r.fp & (2**64 - 1) for r in simhash.fingerprints(df).collect()}
    assert got == {i: brute_fp(t) for i, t in enumerate(texts)}


def test_links_match_brute_force(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 8])):
            fps.add(at)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                at ^= 1 << b
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node & (2**64 - 1): r.component & (2**64 - 1) for r in simhash.link(df).collect()}
    want = brute_components(fps)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    full = {f: got.get(f, f) for f in fps}
    assert groups(full) == groups(want)


def test_rows_and_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base), (9, base + " tail"), (1, None), (2, ""), (None, "alone here now then"), (7, "other text of words"), (7, "other text of words")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, key int")
    got = sorted(((r.id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert len(got) == len(rows)
    d = {k: v for k, v in got}
    assert d[1] == d[2] == 1 and d[3] == d[5] == 3 and d[7] == 7 and d[None] is None
    assert simhash.near_duplicates(df.limit(0)).count() == 0
