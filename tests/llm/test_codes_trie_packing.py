import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.llm import codes, packing, prefix_trie

# --- product codes


def brute_codes(rows):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:256]] for p in range(4)]
    near = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e, strict=True)), k) for k, e in enumerate(b))
    for _ in range(4):
        for p, b in enumerate(books):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(part(v, p), b)[1], []).append(part(v, p))
            for k, xs in own.items():
                b[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v, lab in kept:
        found = [near(part(v, p), books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
    sums = {}
    for _, _, e, lab in out:
        sums[lab] = sums.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(y) for b in books for e in b for y in e).encode()).hexdigest()
    return sorted((str(i), c, e, sums[lab], sha) for i, c, e, lab in out)


@pytest.mark.parametrize("n", [12, 400])
def test_codes_by_brute_force(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.1, 2.0]) + rng.random() * rng.choice([0, 0.01]) for _ in range(8)], rng.choice([None, 0, 1])) for i in range(n)]
    rows += [rows[3], rows[3], (None, rows[5][1], 1), (None, [0.0] * 8, None), (7, rows[1][1], 2), (n + 1, None, 1), (n + 2, [None] + [0.0] * 7, 1), (n + 3, [float("nan")] + [0.0] * 7, 1), (n + 4, [float("-inf")] + [0.0] * 7, 1)]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], "vec_id long, embedding array<float>, label int, code string, v string, of string")
    df.repartition(7).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = codes.query(spark, str(tmp_path)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes(rows)
    coded, books = codes.encode(df)
    for r in codes.decode(coded, books).collect():
        assert len(r.decoded) == 8
        assert r.decoded[:2] == [v / 1024 for v in books.books[0][int(r.code[:2], 16)].tolist()]


def test_codes_of_nothing_and_of_unfit_vectors(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = codes.query(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and not got.collect()
    with pytest.raises(ValueError, match="length"):
        codes.encode(spark.createDataFrame([(1, [0.0] * 4, 1), (2, [0.0] * 8, 1)], schema))
    with pytest.raises(Exception, match="too large"):
        codes.encode(spark.createDataFrame([(1, [3e30] * 4, 1)], schema))


@given(st.integers(1, 40), st.integers(1, 300), st.integers(1, 20), st.integers(0, 10**6), st.sampled_from([2, 50, 1 << 26]))
@settings(max_examples=60, deadline=None)
def test_partial_distances_miss_no_nearest_entry(n, k, d, seed, span):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-span, span, (n, d)), rng.integers(-span, span, (k, d))
    full = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    index, distance = codes.nearest(x, book)
    assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


# --- conversations


def brute_trie(rows):
    conv = {}
    for c, t, r, x in rows:
        if c is not None:
            conv.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in conv.items()}
    path = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 6
        path[c] = tuple(conv.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members = {}
    for c, p in path.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        stack, leaves, saved = [p], 0, 0
        while stack:
            q = stack.pop()
            leaves += q not in kids
            saved += (len(members[q]) - 1) * len(q[-1][1]) if q else 0
            stack += kids.get(q, [])
        ends = ",".join(str(c) for c in sorted(m) if path[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(spark, rows, at):
    spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, node string, d string").repartition(6).write.parquet(str(at / "conversations.parquet"))
    return [tuple(r) for r in prefix_trie.query(spark, str(at)).collect()]


def same(got, want):
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_trie_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for c in [*range(40), *range(95, 130), *range(300, 420), 777, 901, -3, -120, -100]:
        n = rng.choice([1, 2, 2, 4, 9])
        rows += [(c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é🤦🏽‍♂️", "", None, "long " * 50])) for t in range(n)]
    rows += [rows[5], rows[5], (5, 0, "user", "x"), (5, 0, "user", "a"), (None, 1, "user", "x"), (None, None, None, None)]
    same(trie_rows(spark, rows, tmp_path), brute_trie(rows))


def test_trie_of_hot_members_and_long_paths(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 16)
    rows = [(c, t, "user", f"turn {t}") for c in range(500) for t in range(3)]  # one conversation, many times
    rows += [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(500, 700) for t in range(8)]
    rows += [(1000, t, "user", f"w{t % 7}") for t in range(300)] + [(1001, t, "user", f"w{t % 7}") for t in range(290)]
    same(trie_rows(spark, rows, tmp_path), brute_trie(rows))


def test_trie_of_nothing_and_of_turnless_paths(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    assert trie_rows(spark, [], tmp_path / "a") == []
    short = [c for c in range(101, 400) if c % 100 and zlib.crc32(str(c).encode()) % 6 > 0][:3]
    rows = [(c, 0, "user", "gone") for c in short]
    got = trie_rows(spark, rows, tmp_path / "b")
    assert got == brute_trie(rows) and len(got) == 1 and got[0][1] == 0


# --- packing


def brute_place(lengths, capacity):
    """Every open sequence is tried and the squares are counted anew."""
    bins, at = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        s = lengths[k]
        gaps = sorted({capacity - sum(b) for b in bins if s <= capacity - sum(b) < capacity})
        best = None
        for g in gaps:
            counts = {}
            for b in bins:
                counts[capacity - sum(b)] = counts.get(capacity - sum(b), 0) + 1
            counts[g] -= 1
            counts[g - s] = counts.get(g - s, 0) + 1
            counts.pop(0, None)
            cost = sum(v * v for v in counts.values())
            best = min(best, (cost, g)) if best else (cost, g)
        at[k] = capacity - best[1] if best else 0
        if best:
            next(b for b in bins if capacity - sum(b) == best[1]).append(s)
        else:
            bins.append([s])
    return bins, [at[k] for k in range(len(lengths))]


@given(st.lists(st.integers(1, 24), max_size=60), st.integers(24, 40))
@settings(max_examples=80, deadline=None)
def test_placement_minimises_squares(lengths, capacity):
    bins, offsets = brute_place(lengths, capacity)
    sequence, offset = packing.sum_of_squares(np.array(lengths, dtype=np.int64), capacity)
    assert offset.tolist() == offsets and len(set(sequence.tolist())) == len(bins)


def test_packing_comes_near_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(5.5, 1, 3000), 1, 2048).astype(np.int64)
    sequence, _ = packing.sum_of_squares(lengths)
    assert sequence.max() + 1 <= math.ceil(lengths.sum() / 2048) + 2


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        return packing.Encoder(f.read())


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sté .,\n\t\r\x0b\x1c\x85\xa0᠎　 1<|endoftext>日🤦")), max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_library(encoder, tokenizer, texts):
    assert [x.tolist() for x in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_in_slices(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 50)
    monkeypatch.setattr(packing, "MEMO_WORDS", 30)
    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        own = packing.Encoder(f.read())
    rng = random.Random(1)
    texts = ["".join(rng.choice(["word", "don't", " ", "  ", "\n", " \n ", "x" * 90, "é", "12"]) + rng.choice(["", " "]) for _ in range(200)) for _ in range(10)]
    assert [x.tolist() for x in own.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.text(alphabet=st.sampled_from(list("aZ'sé×÷ßÀ \n\r\t\x1c\x7f\x85\xa0,.-_9²ªД中”\u0300\u180e\u2003\u200b\u3000")), max_size=40), max_size=8))
@settings(max_examples=300, deadline=None)
def test_cuts_at_lines_and_marks_keep_the_ids(encoder, tokenizer, texts):
    assert [x.tolist() for x in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_encoded_once(tokenizer, monkeypatch):
    """Whatever mark or line follows a word, and when rarer ones are forgotten, it is not encoded anew."""
    monkeypatch.setattr(packing, "MEMO_WORDS", 200)
    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        own = packing.Encoder(f.read())
    given_chars = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given_chars.extend(map(len, texts))
            return tokenizer.encode_batch_fast(texts, **options)

    own.tokenizer = Counted()
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé", k=8)) for _ in range(60)]
    rare = 0
    for _ in range(20):
        once = ["".join(rng.choices("fghijkl", k=8)) for _ in range(30)]
        rare += sum(map(len, once))
        text = " ".join(w + rng.choice([",", ".", "!", ";", ":", ".\n", ""]) for w in words * 5 + once)
        assert own.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert sum(given_chars) < 2 * (rare + sum(map(len, words)))


def test_pieces_and_sequences(spark, docs_rows, clashing, small_dir, empty_dir, tokenizer):
    rows = packing.query(spark, small_dir).collect()
    want = []
    for d, t, *_ in docs_rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(str(d), p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.query(spark, empty_dir).columns == packing.query(spark, small_dir).columns and not packing.query(spark, empty_dir).collect()
    whole = packing.sequences(clashing).collect()
    assert len(whole) == len(by) and sum(len(s.ids) for s in whole) == sum(r.length for r in rows)
    pieces = []
    for d, t, *_ in docs_rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        pieces += [(str(d), ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    got = [(str(d), s.ids[a:b]) for s in whole for d, a, b in zip(s.doc_ids, s.starts, [*s.starts[1:], len(s.ids)], strict=True)]
    assert sorted(got) == sorted(pieces)


def test_groups_split_a_larger_table(spark, small_dir, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    rows = packing.query(spark, small_dir).collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 1
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048
