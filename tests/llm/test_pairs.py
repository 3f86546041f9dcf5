import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from latticore.llm import decontam, egojoin


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=30), st.text("abc", max_size=60))
def test_myers(item, text):
    d, _ = decontam.myers(item, text, len(item))
    assert min(d, len(item)) == brute_distance(item, text)


def test_myers_of_many_rows():
    rng = np.random.default_rng(3)
    pairs = []
    for _ in range(400):
        item = "".join(rng.choice(list("abc"), rng.integers(1, 65)))
        text = "".join(rng.choice(list("abc"), rng.integers(0, 80))) + (item[: rng.integers(0, len(item) + 1)] if rng.random() < 0.5 else "")
        pairs.append((item, text))
    pad = lambda s, n, c: np.concatenate([decontam.codes(s), np.full(n - len(s), c, np.uint32)])
    p, t = (max(len(x[k]) for x in pairs) for k in (0, 1))
    got = decontam.myers_many(np.stack([pad(a, p, 0) for a, _ in pairs]), np.array([len(a) for a, _ in pairs]), np.stack([pad(b, t, 2**32 - 1) for _, b in pairs]))
    assert got.tolist() == [brute_distance(a, b) for a, b in pairs]


def test_short_items_match_as_whole_words():
    m = decontam.Matcher([(1, "cat"), (2, "a cat sat on it"), (3, "Paris 7"), (4, "x")])
    assert m.find("A  CAT sat\non it") == [(1, 0, 5), (2, 0, 15)] and m.find("concatenate xy") == []
    assert m.find("a bat sat on it")[0][:2] == (2, 1) and m.find("so paris 7") == [(3, 0, 10)] and m.find("x") == [(4, 0, 1)]


def test_decontamination_is_complete():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(int(rng.integers(8, 30)))) for i in range(6)] + [(6, None), (7, " "), (8, "zz yy ww")]
    docs = []
    for n in range(60):
        t = list(items[n % 6][1])
        for _ in range(rng.integers(0, int(0.14 * len(t)) + 1)):
            at = int(rng.integers(0, len(t)))
            t[at : at + 1] = rng.choice(["", "z", "yz"])
        docs.append(text(20) + " " + "".join(t).upper() + "\n " + text(20) if n % 3 else "".join(t))
    m = decontam.Matcher(items)
    for d in docs:
        plain = decontam.plain(d)
        want = {(i, b) for i, t in items[:6] if (b := brute_distance(decontam.plain(t), plain)) <= int(0.1 * len(decontam.plain(t)))}
        assert {(i, x) for i, x, _ in m.find(d)} == want


def test_decontamination_rows(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x " * 50000 + item, 0), (None, item.replace("fox", "fax"), 0), (3, item, 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (1, item)], "item_id long, text string")
    got = sorted(tuple(r)[:3] for r in decontam.matches(docs, bench).collect() if r.id)
    assert got == [(3, 1, 0)] * 4
    old, decontam.BLOCK = decontam.BLOCK, 40  # several blocks give the same
    try:
        assert sorted(tuple(r)[:3] for r in decontam.matches(docs, bench).collect() if r.id) == got
    finally:
        decontam.BLOCK = old
    assert {r.end_at for r in decontam.matches(docs, bench).collect() if r.distance == 0} == {len(item), 100000 + len(item)}
    assert decontam.matches(docs, bench.limit(0)).count() == 0
    assert decontam.matches(docs.limit(0), bench).count() == 0


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(900):
        v = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.2, 1])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(5)]
    bad = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None], 1), (2004, rows[0][1], None), (2005, [], 1), (2006, [float("inf")] + [0.0] * 15, 1), (2007, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    old = egojoin.RUN, egojoin.LEAF
    egojoin.RUN, egojoin.LEAF = 64, 8
    try:
        got = {r.id: (r.n_links, r.component_id, r.kept) for r in egojoin.near_vectors(df).collect()}
    finally:
        egojoin.RUN, egojoin.LEAF = old
    v = np.array([r[1] for r in rows])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    hit = (u @ u.T >= 0.93) & (lab[:, None] == lab)
    np.fill_diagonal(hit, False)
    comp = np.arange(len(rows))
    while True:
        new = np.minimum(comp, np.where(hit, comp[None, :], 10**9).min(1))
        if (new == comp).all():
            break
        comp = new
    ids = [r[0] for r in rows]
    for k, i in enumerate(ids):
        assert got[i] == (hit[k].sum(), ids[comp[k]], ids[comp[k]] == i)
    for i, *_ in bad:
        assert got[i] == (0, i, True)
    assert egojoin.near_vectors(df.limit(0)).count() == 0


def test_repeated_ids_and_clashing_names_of_vectors(spark):
    rows = [(1, [1.0, 0.0], 5, 9, 9), (1, [0.0, 1.0], 5, 9, 9), (2, [1.0, 0.01], 5, 9, 9), (None, [1.0, 0.0], 5, 9, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int, n_links int")
    got = sorted(((r.id, r.n_links, r.component_id) for r in egojoin.near_vectors(df).collect()), key=str)
    assert got == [(1, 0, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1)]


def test_the_grid_order_skips_distant_intervals():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(64, 64))
    v = centres[rng.integers(64, size=6000)] + rng.normal(size=(6000, 64)) * 0.05
    u = egojoin._units(v)
    axes = np.linalg.eigh(np.cov(u.T))[1][:, ::-1][:, : egojoin.AXES]
    eps = float(np.sqrt(2 - 2 * 0.93))
    cells = np.floor(u @ axes[:, : egojoin.ORDER] / eps)
    order = np.lexsort(cells.T[::-1])
    side = egojoin.Side(np.arange(6000), np.ones(6000, np.int64), v[order], axes)
    old, egojoin.LEAF = egojoin.LEAF, 32
    try:
        links, root, compared, every = egojoin.interval_join(side, None, eps, 0.93)
    finally:
        egojoin.LEAF = old
    hit = u[order] @ u[order].T >= 0.93
    assert (links == hit.sum(1) - 1).all() and compared < 0.3 * every
    assert all((root[hit[k]] == root[k]).all() for k in range(0, 6000, 97))
