"""Classifier, mixing, pieces and personal data."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from shardloom.llm import mixing, pieces, pii, quality

DIR = "/root/testdata/sf0.01"


def test_machine_learns_pairs():
    """A label that only a pair of words decides, by words that single weights can't separate."""
    import random

    rng, rows = random.Random(1), []
    for i in range(600):
        a, b = i % 2, i // 2 % 2
        filler = " ".join(rng.choice(("one", "two", "three")) for _ in range(3))
        rows.append((f"{('red', 'tan')[a]} {filler} {('cat', 'dog')[b]}", a ^ b))
    m = quality.FactorisationMachine()
    m.fit([quality.features(t) for t, _ in rows], np.array([y for _, y in rows], dtype=float), steps=3000)
    assert np.mean([(m.score(t) > 0.5) == y for t, y in rows]) > 0.95
    m.v[:] = 0
    assert np.mean([(m.score(t) > 0.5) == y for t, y in rows]) < 0.8


def test_score_by_pairs(spark, docs, small_dir):
    """Scores of the column operator equal the sum over all pairs of features; source, language and id are no inputs."""
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    m = quality.train(docs, labels)
    got = quality.score(docs, m).select("row.text", "row.n_chars", "score").collect()
    for r in got[:25]:
        idx, x = m.row(*quality.features(r["text"] or "", r["n_chars"]))
        if len(idx) > 200:
            continue
        y = m.w0 + sum(m.w[i] * v for i, v in zip(idx, x))
        vecs = [m.v[i] * v for i, v in zip(idx, x)]
        y += sum(float(vecs[i] @ vecs[j]) for i in range(len(vecs)) for j in range(i))
        assert abs(1 / (1 + np.exp(-y)) - r["score"]) < 1e-9
    other = docs.withColumns({"source": F.lit("z"), "lang": F.lit("xx"), "doc_id": F.col("doc_id") + 1000})
    a, b = (Counter(r["score"] for r in quality.score(d, m).select("score").collect()) for d in (docs, other))
    assert a == b


def test_quality_training_with_repeats(spark):
    """Repeated ids and labels: two runs over other partitions learn the same."""
    docs = [(i % 40, f"word{i % 7} and other text number {i}", i) for i in range(200)]
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(60)], "doc_id long, quality int")
    d = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    a, b = (quality.train(x, labels) for x in (d.repartition(1), d.repartition(7)))
    assert (a.w == b.w).all() and (a.v == b.v).all() and a.w.any()


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = quality.query(spark, DIR).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    both = labels.toPandas().merge(got[got.held_out], on="doc_id")
    a, b = both.score[both.quality == 1], both.score[both.quality == 0]
    assert (a.to_numpy()[:, None] > b.to_numpy()[None, :]).mean() > 0.97
    assert (both.predicted == both.quality).mean() > 0.9


def test_quality_edges(spark, docs, none, clashing, small_dir, empty_dir):
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    for d in (docs, clashing):
        out = quality.score(d, quality.train(d, labels))
        assert out.select("row.*").columns == d.columns and out.where("score is null").count() == 0
    assert set(quality.score(docs, quality.train(docs, spark.read.parquet(f"{empty_dir}/labels.parquet"))).toPandas().score) == {0.5}
    assert quality.query(spark, empty_dir).count() == 0


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == [18.75, 7.5, 3.75]
    assert mixing.targets([1, 100, 100], [5, 2, 1]) == pytest.approx([3, 132, 66])
    assert mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_sainte_lague():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        v, c, s = rng.integers(0, 50, n).astype(float), rng.integers(0, 30, n), int(rng.integers(0, 100))
        q = np.zeros(n, dtype=int)
        for _ in range(s):
            best = [(-v[i] / (2 * q[i] + 1), i) for i in range(n) if q[i] < c[i] and v[i] > 0]
            if not best:
                break
            q[min(best)[1]] += 1
        assert q.tolist() == mixing.sainte_lague(s, v, c).tolist()


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mixing(spark, docs, docs_rows, none, clashing, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    for d in (docs, clashing):
        got = mixing.mix(d).toPandas()
        assert len(got) == len(docs_rows)
        assert Counter(zip(got.doc_id.fillna(-1), got["size"])) == Counter((-1 if i is None else i, size(t)) for i, t, *_ in docs_rows)
        assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
        by = got.groupby("source_size").agg(t=("target", "first"), k=("taken", "sum"))
        assert ((by.t - by.k).abs() <= mixing.BLOCK).all(), by
    again = mixing.mix(docs.repartition(3)).toPandas()
    assert Counter(map(tuple, again.fillna(-1).to_numpy())) == Counter(map(tuple, got.fillna(-1).to_numpy()))
    rows = mixing.mix_rows(clashing)
    assert rows.columns == clashing.columns
    taken = Counter()
    for r in rows.collect():
        taken[r["doc_id"]] += size(r["text"])
    want = Counter()
    for r in got.itertuples():
        want[None if r.doc_id != r.doc_id else int(r.doc_id)] += r.taken
    assert +taken == +want
    assert mixing.mix(none).count() == 0 and mixing.mix_rows(none).count() == 0


def test_mixing_small_sources(spark):
    """Sources of a few words come within one of their targets, alone and beside large ones."""
    tiny = [(i, "a b c", f"s{i}") for i in range(6)]
    large = [(100 + i, "w " * 500, "large") for i in range(80)]
    for rows in (tiny, tiny + large):
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
        assert (got.taken <= 3 * got["size"]).all()
        small = got[got.doc_id < 6]
        assert ((small.taken - small.target).abs() <= 1).all(), small
        assert abs(got.taken.sum() - got["size"].sum()) <= 6


def test_mixing_parts_of_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 200)
    monkeypatch.setattr(mixing, "SHARDS", 3)
    rows = [(i, "w " * 100, "ab"[i % 2]) for i in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    by = got.groupby(got.doc_id % 2).agg(t=("target", "first"), k=("taken", "sum"))
    assert (got.taken <= 3 * got["size"]).all() and ((by.t - by.k).abs() / by.t < 0.01).all()


def test_mixing_near_targets(spark):
    got = mixing.query(spark, DIR).toPandas()
    src = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "source").toPandas().merge(got, on="doc_id")
    by = src.groupby("source").agg(t=("target", "first"), k=("taken", "sum"), s=("size", "sum"), ss=("source_size", "first"))
    assert (by.s == by.ss).all() and ((by.k - by.t).abs() / by.t < 0.01).all()
    names = sorted(by.index)
    want = mixing.targets([int(by.s[n]) for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert np.allclose([by.t[n] for n in names], want)


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_pieces_equal_library(sp, docs_rows):
    model = pieces.PieceModel()
    rng = np.random.default_rng(0)
    texts = [t or "" for _, t, *_ in docs_rows] + [" ", "   a", "a  b   c", " " * 100 + "x", "\n\n a\tb\n", "<s> <0x0A>", "x" * 300, " " * 37]
    texts += ["".join(rng.choice(list("abcdethn  \n.é▁ÜßТ中0123-!$\t"), rng.integers(0, 60))) for _ in range(300)]
    got = pieces.Encoder(model).encode(texts)
    for t, ids in zip(texts, got):
        assert ids.tolist() == sp.encode(t)
        assert pieces.decode(model, ids) == sp.decode(sp.encode(t))


def test_pieces_columns(spark, docs, none, clashing, sp):
    got = pieces.encode(clashing)
    assert got.columns == [c for c in clashing.columns if c != "token_ids"] + ["token_ids"]
    for r in got.collect():
        assert r["token_ids"] == sp.encode(r["text"] or "")
    d = pieces.encode_digest(docs).toPandas()
    assert len(d) == docs.count() and d.round_trip.sum() >= len(d) - 1
    assert pieces.encode(none).count() == 0 and pieces.encode_digest(none).count() == 0


def brute_pii(x):
    out = []
    pats = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(pats):
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(v) > 255 for v in m[0].split("."))) or (k == 2 and not (14 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns():
    rng = np.random.default_rng(4)
    texts = ["a@b.c@d.e", "x@y", "@a.b", "1.2.3.4.5.6.7.8", "999.1.1.1 1.2.3.256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (286) 555-5136", "+1 2", "1" * 3000, "a" * 2000 + "@", "0001.2.3.4"]
    texts += ["".join(rng.choice(list("0123456789.@ab-+ ()\n"), 80)) for _ in range(2000)]
    for t in texts:
        assert pii.base_spans(t) == brute_pii(t), t


def test_skip_chain_adds_and_keeps(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        a, b, c = rng.integers(100, 999), rng.integers(200, 999), rng.integers(1000, 9999)
        rows.append((i, f"Some words here call +1 ({a}) {b}-{c} or mail u{i}@ex.org about item {i} of {i % 7} and later from 10.{i % 200}.3.4 end."))
    rows.append((1000, "Call +1 (286) 555-5136 now, as we said, or (286) 555-5136 some other day; count 12 and 7."))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in pii.find_pii(d, pii.train(d)).collect()}
    text, spans = rows[-1][1], got[1000]["spans"].split(",")
    base = {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_pii(text)}
    assert base < set(spans)
    more = [x.split(":") for x in set(spans) - base]
    assert any("555-5136" in text[int(s) : int(e)] and k == "phone" for k, s, e in more), more
    assert not any(text[int(s) : int(e)] in ("12", "7") for _, s, e in more)
    for i, t in rows:
        b = brute_pii(t)
        assert got[i]["base_sha256"] == hashlib.sha256(pii.listed(b).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in b) for j in range(4)]


def _repeats():
    """Item codes look like the last token of a phone number; numbers repeat, whole and in part."""
    rng, rows = np.random.default_rng(8), []
    for i in range(300):
        a, b, c, x, y = rng.integers(100, 999), rng.integers(200, 999), rng.integers(1000, 9999), rng.integers(100, 999), rng.integers(1000, 9999)
        who = ("he", "she", "we", "they")[i % 4]
        rows.append(f"Then {who} rang +1 ({a}) {b}-{c} today and again +1 ({a}) {b}-{c} then; {who} took {x}-{y} on Monday, or {b}-{c} on Sunday, from box {i}.")
    return rows


def test_skip_edges_carry_evidence():
    """A bare repeat of a known number is found because of its skip edge, and only because of it."""
    m = pii.SkipChainCRF()
    m.fit(_repeats())
    text = "We rang +1 (286) 555-5136 once. Is 555-5136 right, or is 777-1234 it?"
    base = pii.base_spans(text)
    assert [text[s:e] for s, _, e in base] == ["+1 (286) 555-5136"]
    with_skip = [text[s:e] for s, _, e in m.added([text], [base])[0]]
    m.skip[:] = 0
    without = [text[s:e] for s, _, e in m.added([text], [base])[0]]
    assert with_skip == ["555-5136"] and without == []


def test_field_decides_what_patterns_nearly_match():
    """Near matches have no label in training; what the field adds of them passes the kind's check."""
    rng, texts = np.random.default_rng(2), []
    for i in range(300):
        n = "".join(map(str, rng.integers(0, 10, 16)))
        texts.append(f"word {i % 90} paid with {n} on {2000 + i % 20} and so on")
    assert 10 < sum(bool(pii.base_spans(t)) for t in texts) < 60
    m = pii.SkipChainCRF()
    m.fit(texts)
    # a right number beside another one, which the pattern takes for one of 20 digits; a wrong one; none
    new = ["they paid with 4012888888881881 2011 and 45 more", "they paid with 1234567890123456 on 2011 and 45 more", "in 2004 there were 12 of 90"]
    assert [pii.base_spans(t) for t in new] == [[], [], []]
    assert [[t[s:e] for s, _, e in x] for t, x in zip(new, m.added(new, [[], [], []]))] == [["4012888888881881"], [], []]


def test_what_added_spans_must_hold():
    card, ip, phone, email = (pii.KINDS.index(k) for k in ("card", "ip", "phone", "email"))
    assert pii.holds(card, "4012888888881881") and pii.holds(card, "4012-8888 8888 1881")
    assert not pii.holds(card, "1234567890123456") and not pii.holds(card, "4012888888881881 4012888888881881") and not pii.holds(card, "1881")
    assert pii.holds(ip, "10.0.0.255") and not pii.holds(ip, "10.0.0.256") and not pii.holds(ip, "10.0.0.1.2") and not pii.holds(ip, "1234")
    assert pii.holds(phone, "(030) 123-4567") and not pii.holds(phone, "1234567890123456") and not pii.holds(phone, "12")
    assert pii.holds(email, "a@b") and not pii.holds(email, "ab")


def test_likelihood_gradient_of_a_tree():
    """Beliefs of edges are the joint's marginals, so the gradient is the likelihood's."""
    m = pii.SkipChainCRF()
    rng = np.random.default_rng(0)
    m.w, m.chain = rng.normal(size=m.w.shape) * 0.3, rng.normal(size=m.chain.shape) * 0.5
    g = pii.Graph(["1a 22b 3@c"])
    g.skip = g.skip[:0]
    u = pii.fixed(m.unary(g), np.array([-1, -1, 2]))
    joint = np.exp(u[0][:, None, None] + u[1][None, :, None] + u[2][None, None, :] + m.chain[:, :, None] + m.chain[None, :, :])
    joint /= joint.sum()
    _, chain, _ = m._beliefs(g, u)
    assert np.allclose(chain, [joint.sum(2), joint.sum(0)], atol=2e-3)


def test_belief_propagation_is_exact_on_trees():
    m = pii.SkipChainCRF()
    rng = np.random.default_rng(0)
    m.w, m.chain, m.trained = rng.normal(size=m.w.shape) * 0.3, rng.normal(size=m.chain.shape) * 0.5, True
    g = pii.Graph(["1a 22b 3@c"])
    g.skip = g.skip[:0]
    p = m.posteriors(g)
    u = m.w[g.x].sum(axis=1)
    joint = np.exp(u[0][:, None, None] + u[1][None, :, None] + u[2][None, None, :] + m.chain[:, :, None] + m.chain[None, :, :])
    joint /= joint.sum()
    assert np.allclose(p, [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))], atol=2e-3)


def test_belief_crosses_long_skip_chains():
    m = pii.SkipChainCRF()
    m.skip, m.trained = np.where(np.eye(pii.LABELS) > 0, 2.0, -2.0), True
    short, long = "1a word 2b", " word ".join(["abc1"] * 25)
    g = pii.Graph([short, long])
    first = len(g.x) - 25
    assert len(g.skip) == 24 and len(g.chain) == 0
    free = min(set(range(1 << pii.BITS)) - set(g.x.ravel().tolist()))
    g.x[first] = free
    m.w[free, 1] = 1
    p = m.posteriors(g)
    u, f, b = np.exp(m.w[g.x[first:]].sum(axis=1)), [np.ones(pii.LABELS)], [np.ones(pii.LABELS)]
    for k in range(24):
        f.append((f[-1] * u[k]) @ np.exp(m.skip))
        b.append(np.exp(m.skip) @ (b[-1] * u[24 - k]))
        f[-1], b[-1] = f[-1] / f[-1].sum(), b[-1] / b[-1].sum()
    want = np.array(f) * u * np.array(b[::-1])
    want /= want.sum(axis=1, keepdims=True)
    assert want[-1, 1] > 0.28 and np.allclose(p[first:], want, atol=5e-3)
    alone = pii.Graph([long])
    alone.x[0] = free
    assert (m.posteriors(alone) == p[first:]).all()


def test_training_reads_whole_documents(spark):
    assert pii._shape("x" * 100 + "-19") == "a-dd" and pii._shape("5" * 100) == "d" * 100
    rows = [(i, "item 12 of some other words " * 400 + f"and call +1 (286) 555-{1000 + i} now.") for i in range(20)]
    assert all(pii.base_spans(t) for _, t in rows)
    assert pii.train(spark.createDataFrame(rows, "doc_id long, text string")).trained


def test_pii_edges(docs, none, clashing):
    model = pii.train(none)
    assert not model.trained
    assert pii.find_pii(none, model).count() == 0
    for d in (docs, clashing):
        got = pii.find_pii(d, pii.train(d))
        assert got.count() == docs.count() and got.where("spans is null").count() == 0


def test_pieces_of_long_texts_in_slices(monkeypatch):
    import sentencepiece

    for name, value in (("SLICE", 60), ("LATTICE_CHARS", 40), ("MEMO", 25), ("MEMO_CHARS", 300)):
        monkeypatch.setattr(pieces, name, value)
    rng = random.Random(8)
    texts = ["".join(rng.choice(["word", "plain", "é", "日本" * 30, "x" * 90, "\n", "  ", "   ", " ", "☃" * 3, "12"]) + rng.choice(["", " "]) for _ in range(120)) for _ in range(8)]
    texts += ["a" * 500, " " * 300 + "b", "", "☃ab" * 100]
    model = pieces.PieceModel()
    want = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(texts, num_threads=1)
    assert [x.tolist() for x in pieces.Encoder(model).encode(texts)] == want
