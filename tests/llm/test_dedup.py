"""Exact, near, line and substring deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from shardloom.llm import components, exact_dedup, line_dedup, near_dedup, substring_dedup
from shardloom.llm.common import batch_shingles, shingle_hashes, word_hashes

WS = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def rank(i):
    return (i is None, i or 0)


def test_content_table_grows_and_compares():
    t = exact_dedup.ContentTable(4)
    assert [t.find_or_add(7, b"a%d" % (i % 40))[0] for i in range(80)] == [i % 40 for i in range(80)]


@pytest.mark.parametrize("most", [1, 500, 10**6])
def test_grace_spills(most):
    rows = [(hash(i % 37) * 2654435761 % 2**63, b"c%d" % (i % 37) * 20, [i]) for i in range(300)] + [(5, b"x%d" % (i % 3), [1000 + i]) for i in range(9)]
    got = sorted((c, sorted(g)) for gs in exact_dedup.grace_groups(rows, most) for _, c, g in gs)
    want = defaultdict(list)
    for _, c, p in rows:
        want[c] += p
    assert got == sorted((c, sorted(g)) for c, g in want.items())


def test_grace_holds_a_content_once():
    import tracemalloc

    rows = ((7, bytes(20_000), 1) for _ in range(5000))  # 100 MB of one content
    tracemalloc.start()
    try:
        got = [g for gs in exact_dedup.grace_groups(rows, 10_000, fold=lambda a, b: a + b) for g in gs]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(h, len(c), n) for h, c, n in got] == [(7, 20_000, 5000)] and peak < 2 << 20


@pytest.mark.parametrize("hot", [64, 1, 0])
def test_exact(docs, docs_rows, none, clashing, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT", hot)  # with 1, all copies are folded in salted parts first; with 0, no salting makes a hash cold
    want = defaultdict(list)
    for i, t, *_ in docs_rows:
        want[WS.sub(" ", t or "")].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(docs_rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter(
        (i, min(g, key=rank), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in want.items() for i in g
    )
    assert sum(r["kept"] for r in got) == len(want) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert sum(r["kept"] for r in exact_dedup.exact_dedup(clashing).collect()) == len(want)
    rows = exact_dedup.exact_dedup_rows(clashing)
    assert rows.columns == clashing.columns and rows.count() == len(want)
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter(min(g, key=rank) for g in want.values())
    assert exact_dedup.exact_dedup_rows(none).count() == 0


def test_exact_hot_content(spark, monkeypatch):
    """A content in every partition: several rounds of salted folding."""
    monkeypatch.setattr(exact_dedup, "HOT", 2)
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(df).collect()}
    assert len(got) == 120 and all(r["keep_id"] == (1 if i % 3 else i) and r["group_size"] == (80 if i % 3 else 1) for i, r in got.items())
    assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup_rows(df).collect()) == sorted([1, *range(0, 120, 3)])


def test_hashes():
    a = word_hashes(b"One two  one\tTWO")
    assert a[0] == a[2] and a[1] == a[3] and a[0] != a[1]
    texts = [b"", b"a", b"a b c", b"a b c d e f", b" \n", b"a b c d e f a b c d"]
    h, off = batch_shingles(texts, 4)
    for k, t in enumerate(texts):
        assert h[off[k] : off[k + 1]].tolist() == shingle_hashes(t, 4).tolist()


def brute_components(rows, n, pct):
    """Of each row its set's size and its component: every row is a document, its id only names it."""
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= pct * len(s | t):
                up[root(a)] = root(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    name = {k: min((rows[j][0] for j in g), key=rank) for g in groups.values() for k in g}
    return [len(x) for x in sets], name, list(groups.values())


def test_near(spark, docs, docs_rows, none, clashing):
    for n in (4, 5):
        sizes, name, groups = brute_components(docs_rows, n, 80)
        got = near_dedup.near_dedup(docs, words=n).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((docs_rows[k][0], sizes[k], name[k]) for k in name)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert near_dedup.near_dedup(none).count() == 0
    kept = near_dedup.near_dedup_rows(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(groups)
    assert near_dedup.near_dedup_rows(none).count() == 0


def test_near_null_ids(spark):
    """Null ids are no common node: unrelated texts stay apart, copies lose all but one row."""
    rng = np.random.default_rng(3)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.integers(0, 500, 60)) for _ in range(4))
    rows = [(None, a), (None, a), (None, a + " more"), (None, b), (None, c), (5, b + " x"), (6, d), (None, d), (None, ""), (None, None), (7, " "), (8, a[:20] + c[:100])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, name, groups = brute_components(rows, 5, 80)
    got = near_dedup.near_dedup(df).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((rows[k][0], name[k]) for k in name)
    assert sum(r["kept"] for r in got) == len(groups) == 8
    assert Counter(r["doc_id"] for r in near_dedup.near_dedup_rows(df).collect()) == Counter(min((rows[k][0] for k in g), key=rank) for g in groups)


def test_linked_contracts():
    s = [np.arange(k, k + 50, dtype=np.uint64) for k in (0, 3, 100, 102, 103, 300)]
    assert near_dedup.linked(s, 80).tolist() == [0, 0, 2, 2, 2, 5]
    assert near_dedup.linked(s, 80, np.array([0, 1, 0, 2, 2, 3])).tolist() == [0, 0, 0, 0, 0, 5]


def test_near_node_functions():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**32, (40, near_dedup.T), dtype=np.uint32)
    sig = np.repeat(base, 30, axis=0)
    swap = rng.random(sig.shape) < 0.05
    sig = np.where(swap, rng.integers(0, 2**32, sig.shape, dtype=np.uint32), sig)
    n = near_dedup.nibbles(sig)
    assert (near_dedup.unpack(near_dedup.pack(n)) == n).all()
    label = near_dedup.clusters(n, near_dedup.least_agreement(0.8))
    was, near_dedup.MATRIX_NODE = near_dedup.MATRIX_NODE, 10
    try:
        assert near_dedup.clusters(n, near_dedup.least_agreement(0.8)).tolist() == label.tolist()
    finally:
        near_dedup.MATRIX_NODE = was
    assert len(set(label)) == 40 and all(len(set(label[k * 30 : k * 30 + 30])) == 1 for k in range(40))
    node = np.zeros(len(n), dtype=np.uint64)
    was, near_dedup.SMALL_NODE = near_dedup.SMALL_NODE, 64
    try:  # a large node branches, and loses no cluster
        a, b = near_dedup.node_ties(node, np.arange(len(n)), near_dedup.pack(n), 0.8)
    finally:
        near_dedup.SMALL_NODE = was
    up = list(range(len(n)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = sorted((root(x), root(y)))
        up[y] = x
    assert all(len({root(k * 30 + j) for j in range(30)}) == 1 for k in range(40))


@pytest.mark.parametrize(("vast", "pivots"), [(8, 1), (10**6, 4)])
def test_near_heavy_and_blocks(spark, monkeypatch, vast, pivots):
    """Nodes and groups beyond their bounds are split, with the same result."""
    import random

    rng = random.Random(9)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(120)] = f"v{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dedup, "HEAVY_NODE", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "VAST_NODE", vast)
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    _, name, _ = brute_components(rows, 5, 80)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {rows[k][0]: name[k] for k in name}


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_lines(docs, docs_rows, none, clashing):
    strip = " \t\n\x0b\x0c\r"
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(strip))
    where = defaultdict(set)
    for i, t, *_ in docs_rows:
        for x in (t or "").split("\n"):
            if len(low(x)) >= 20:
                where[low(x)].add(-(2**63) if i is None else i)
    want = Counter()
    for i, t, *_ in docs_rows:
        lines = (t or "").split("\n")
        own = -(2**63) if i is None else i
        stay = [x for x in lines if not (len(where.get(low(x), ())) >= 3 and max(where[low(x)]) != own)]
        want[(i, len(lines), len(lines) - len(stay), "\n".join(stay))] += 1
    for d in (docs, clashing):
        got = line_dedup.line_dedup(d)
        assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == want
    assert line_dedup.line_dedup(none).count() == 0


def brute_substrings(rows):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, b in texts:
        seen.update(b[p : p + 200] for p in range(len(b) - 199))
    out = Counter()
    for i, b in texts:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        gone = gone[:-1]
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("heavy", "levels"), [(4000, 3), (1, 1)])
def test_substrings(docs, docs_rows, none, clashing, monkeypatch, heavy, levels):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    monkeypatch.setattr(substring_dedup, "LEVELS", levels)
    want = brute_substrings(docs_rows)
    d = docs if heavy > 1 else clashing
    got = substring_dedup.substring_dedup(d).collect()
    assert Counter(tuple(r) for r in got) == want
    assert sum(r["n_removed"] for r in got) > 0
    if heavy > 1:
        assert substring_dedup.substring_dedup(none).count() == 0


def test_substrings_periodic_and_null_ids(spark):
    rng = np.random.default_rng(4)
    line = rng.integers(97, 123, 24, dtype=np.uint8).tobytes().decode()
    long_line = rng.integers(97, 123, 180, dtype=np.uint8).tobytes().decode()
    rest = [rng.integers(97, 123, 400, dtype=np.uint8).tobytes().decode() for _ in range(60)]
    rows = [(None, t) for t in rest] + [(None, "x" * 3000), (1, line * 90), (1, long_line * 9), (None, rest[0][:250] + rest[1]), (2, "a" * 199 + rest[2])]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(tuple(r) for r in got) == brute_substrings(rows)


def test_suffix_order():
    """Lexicographic by block, whatever the ties' length; the cover has every difference."""
    m, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % m for a in cover for b in cover} == set(range(m))
    rng = np.random.default_rng(1)
    base = rng.integers(97, 99, 300, dtype=np.uint8).tobytes()
    segments, block = [b"a" * 230, b"a" * 215], [0, 1]
    for k in range(60):
        a = int(rng.integers(0, 60))
        s = bytearray(base[a : a + int(rng.integers(200, 240))])
        if rng.random() < 0.4:
            s[int(rng.integers(0, len(s)))] = 99
        segments.append(bytes(s))
        block.append(k % 3)
    size = np.array([len(s) for s in segments])
    flat = np.frombuffer(b"".join(segments) + bytes(208), dtype=np.uint8)
    seg = np.repeat(np.arange(len(segments)), size - 199)
    at = np.concatenate([np.arange(n - 199) for n in size]) + (np.cumsum(size) - size)[seg]
    order, same = substring_dedup.suffix_order(flat, at, np.array(block)[seg])
    text = flat.tobytes()
    keys = [(block[seg[i]], text[at[i] : at[i] + 200]) for i in order]
    assert keys == sorted(keys)
    assert same.tolist() == [False] + [x == y for x, y in zip(keys, keys[1:])]
    seen = Counter((b, s[i : i + 200]) for b, s in zip(block, segments) for i in range(len(s) - 199))
    hits = substring_dedup.repeating(np.array(block), np.ones(len(segments), dtype=int), segments)
    assert [h.tolist() for h in hits] == [[seen[b, s[i : i + 200]] > 1 for i in range(len(s) - 199)] for b, s in zip(block, segments)]


def test_anchors_of_long_texts(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 6000, dtype=np.uint8).tobytes()
    _, lo, hi, at, h = substring_dedup.anchored_runs([data])
    monkeypatch.setattr(substring_dedup, "CHUNK", 1024)
    _, lo2, hi2, at2, h2 = substring_dedup.anchored_runs([data])
    for a, b in ((lo, hi), (lo2, hi2)):
        assert np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b)]).tolist() == list(range(6000 - 199))
    assert {(p, int(x)) for p, x in zip(at, h)} == {(p, int(x)) for p, x in zip(at2, h2)}
