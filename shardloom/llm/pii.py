"""Personal data: patterns, and a skip-chain conditional random field that adds what they miss.

Nodes are the white-space-delimited tokens that hold a digit or ``@``; all other tokens can only be outside, so the
graph falls apart at them and inference on what is left is the same as on the whole document. Unary potentials are
log-linear in a token's shape, affixes, length and neighbours; chain edges join neighbouring tokens; skip edges join each
occurrence of a token (or of its digits, if it has 7 or more) with the next one in the document, so the edges stay linear
in its length. Loopy belief propagation over all graphs of a batch passes messages both ways, damped, until those of a
document move by less than ``SETTLED``; where loops keep them moving, it ends after enough rounds for evidence to cross
the whole document. Tokens of the patterns' spans are evidence: their labels are fixed, and what repeats or neighbours
them feels it. Runs of tokens whose posterior for one kind reaches the model's confidence become spans, if they hold what a
span of that kind must (:func:`holds`: a card number passes its check digit and has 14 to 19 digits, an address four parts of at most 255,
a phone number at most 15 digits), unless they overlap a pattern's. Of a token's shape, features see the first 3 and last 3
characters besides the whole, and up to 8 of its neighbours' shapes; this bounds features, not texts.

All potentials are fitted by the gradient of the likelihood that belief propagation gives: expected features with the
labels fixed, less those without (``TRAIN_ROUNDS`` of messages at most). In each pass half of the patterns' spans, drawn anew, are evidence and the others are to
be told from it. Tokens that a pattern nearly matches (a card number that fails its check digit, a phone number that runs
into other digits), or that repeat a token of a pattern's span, have no label: the field sums over theirs and later decides them. Training takes at most ``MAX_TRAIN``
documents (those of smallest id hash); a fifth of them is left out of the fit and sets the confidence: the least one at
which no more than ``FALSE_SHARE`` of the tokens found there, without any evidence, are labelled otherwise.

Defined cases: null or empty text has no spans; without training documents nothing is added; repeated rows are treated
alike; ids may be null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, text_of

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0 is outside
MAX_TRAIN = 3000
TRAIN_ROUNDS = 30
BITS = 12
CHUNK_BYTES = 2 << 20
SETTLED = 1e-4
DAMPING = 0.5
FALSE_SHARE = 0.005
SKIP_DIGITS = 7
SKIP_PRIOR = 2.5  # where training sees few repeats, alike tokens agree
#: Least digits of a span of each kind, and what else it must hold.
LEAST = ((0, "@"), (4, "."), (12, ""), (7, ""))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CARRIER = re.compile(r"[0-9@]")
_SPACE = re.compile(f"[{WS}]")
_SPACES = frozenset(" \t\n\x0b\x0c\r")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, leftmost and non-overlapping within a kind, by start and kind."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def holds(kind: int, token: str) -> bool:
    """Whether a span of a kind holds what one must: enough digits (and a sign), and what its pattern would check of them."""
    digits, sign = LEAST[kind]
    d = "".join(c for c in token if c in "0123456789")
    if len(d) < digits or sign not in token:
        return False
    if KINDS[kind] == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    if KINDS[kind] == "ip":
        parts = re.findall("[0-9]+", token)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    return KINDS[kind] != "phone" or len(d) <= 15


def near_misses(text: str) -> list[tuple[int, int]]:
    """Bounds of what a pattern matches but for its check: personal data or not, the pattern cannot tell."""
    out = [m.span() for m in _IP.finditer(text)]
    out += [m.span() for m in _CARD.finditer(text) if len(_NOT_DIGIT.sub("", m[0])) >= LEAST[2][0]]
    return sorted(out + [m.span() for m in _PHONE.finditer(text)])


def carriers(text: str) -> list[tuple[int, int]]:
    """Bounds of the tokens that hold a digit or ``@``."""
    out, end = [], 0
    while m := _CARRIER.search(text, end):
        start = m.start()
        while start > end and text[start - 1] not in _SPACES:
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        out.append((start, end))
    return out


def _shape(token: str) -> str:
    kinds = ["d" if c.isdigit() else "a" if c.isalpha() else c for c in token]
    return "".join(c for i, c in enumerate(kinds) if not (c == "a" and i and kinds[i - 1] == "a"))


def _neighbour(text: str, at: int, step: int) -> str:
    """The whole token before (-1) or after (1) a position."""
    i, end = (at - 1, -1) if step < 0 else (at, len(text))
    while i != end and text[i] in _SPACES:
        i += step
    first = i
    while i != end and text[i] not in _SPACES:
        i += step
    return text[i + 1 : first + 1] if step < 0 else text[first:i]


def _features(text: str, start: int, end: int) -> list[int]:
    token = text[start:end]
    digits = sum(c.isdigit() for c in token)
    shape, before, after = _shape(token), _neighbour(text, start, -1), _neighbour(text, end, 1)
    names = (
        "bias", f"s={shape}", f"p={shape[:3]}", f"e={shape[-3:]}", f"n={min(digits, 20)}", f"l={min(len(token), 30)}", f"at={token.count('@')}",
        f"dots={min(token.count('.'), 4)}", f"dash={min(token.count('-'), 4)}", f"plus={token[:1] == '+'}", f"b={_shape(before)[-8:]}", f"a={_shape(after)[:8]}",
        f"w={before.lower().strip('.,:;()')}" if before.isalpha() else "w", f"bs={_shape(before)[-4:]}|{shape[:6]}", f"as={shape[-6:]}|{_shape(after)[:4]}",
    )
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for n in names]


class Graph:
    """The graphs of a batch: features of all nodes, chain and skip edges, bounds of the tokens and their documents."""

    def __init__(self, texts: list[str]):
        self.bounds: list[tuple[int, int, int]] = []
        rows, chain, skip = [], [], []
        for d, text in enumerate(texts):
            seen: dict[str, int] = {}
            last = -1
            for start, end in carriers(text):
                i = len(rows)
                self.bounds.append((d, start, end))
                rows.append(_features(text, start, end))
                if last >= 0 and not text[last:start].strip(" \t\n\x0b\x0c\r"):
                    chain.append((i - 1, i))
                last = end
                token = text[start:end].lower().strip(".,;:!?()[]{}<>\"'*#$%&")
                digits = _NOT_DIGIT.sub("", token)
                for key in {token, digits if len(digits) >= SKIP_DIGITS else token}:
                    if len(key) > 1:
                        if key in seen and (seen[key], i) not in chain[-1:]:
                            skip.append((seen[key], i))
                        seen[key] = i
        self.x = np.array(rows, dtype=np.int64) if rows else np.empty((0, 1), dtype=np.int64)
        self.chain = np.array(chain, dtype=np.int64).reshape(-1, 2)
        self.skip = np.array(sorted(set(skip)), dtype=np.int64).reshape(-1, 2)

    def overlapped(self, spans: list[list[tuple[int, int]]]) -> np.ndarray:
        """For each token the number, within its document, of the first span (by start) that overlaps it, else -1."""
        out, doc, at = np.full(len(self.bounds), -1), -1, 0
        for i, (d, start, end) in enumerate(self.bounds):
            if d != doc:
                doc, at = d, 0
            own = spans[d]
            while at < len(own) and own[at][1] <= start:
                at += 1
            k = at
            while k < len(own) and own[k][0] < end:
                if own[k][1] > start:
                    out[i] = k
                    break
                k += 1
        return out

    def labels(self, spans: list[list[Span]]) -> tuple[np.ndarray, np.ndarray]:
        """A token's label, the kind of the first span that overlaps it, and that span's number (-1: none)."""
        which = self.overlapped([[(s, e) for s, _, e in own] for own in spans])
        kinds = [1 + spans[d][k][1] if k >= 0 else 0 for (d, _, _), k in zip(self.bounds, which.tolist(), strict=True)]
        return np.array(kinds, dtype=np.int64), which


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _sums(to: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
    """What arrives at each of ``n`` nodes."""
    return np.stack([np.bincount(to, weights=m[:, k], minlength=n) for k in range(LABELS)], axis=1)


def fixed(unary: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Unary potentials with the labels that are not -1 as evidence."""
    known = np.flatnonzero(label >= 0)
    out = unary.copy()
    out[known] = -40.0
    out[known, label[known]] = 0.0
    return out


class SkipChainCRF:
    def __init__(self) -> None:
        self.w = np.zeros((1 << BITS, LABELS))
        self.chain = np.zeros((LABELS, LABELS))
        self.skip = SKIP_PRIOR * np.eye(LABELS)
        self.confidence = 1.0
        self.trained = False

    def unary(self, g: Graph) -> np.ndarray:
        return self.w[g.x].sum(axis=1)

    def fit(self, texts: list[str], epochs: int = 40, batch: int = 400, rate: float = 0.2) -> None:
        """AdaGrad over batches of documents; every fifth document only sets the confidence."""
        parts = [texts[k::5] for k in range(5)] if len(texts) >= 50 else [[], texts]
        held, learned = parts[0], [t for p in parts[1:] for t in p]
        rng, made = np.random.default_rng(3), []
        for at in range(0, len(learned), batch):
            g, y, which = self._truth(learned[at : at + batch])
            if len(y):
                made.append((g, y, which))
        if not any((y > 0).any() for _, y, _ in made):
            return
        params = [self.w, self.chain, self.skip]
        prior, seen = [0.0, 0.0, SKIP_PRIOR * np.eye(LABELS)], [np.full_like(p, 1e-2) for p in params]
        for _ in range(epochs):
            for g, y, which in made:
                doc = np.array([d for d, _, _ in g.bounds])
                draw = rng.random((int(doc.max()) + 1, int(which.max()) + 2)) < 0.5
                unary = self.unary(g)
                free = self._beliefs(g, fixed(unary, np.where((y > 0) & draw[doc, which], y, -1)), TRAIN_ROUNDS)
                tied = self._beliefs(g, fixed(unary, y), TRAIN_ROUNDS)
                diff = [(a - b) / len(y) for a, b in zip(free, tied, strict=True)]
                grad = [np.zeros_like(self.w), diff[1].sum(axis=0), (diff[2] + diff[2].transpose(0, 2, 1)).sum(axis=0) / 2]
                np.add.at(grad[0], g.x, np.broadcast_to(diff[0][:, None, :], (*g.x.shape, LABELS)))
                for p, d, s, q in zip(params, grad, seen, prior, strict=True):
                    d += 1e-4 * (p - q)
                    s += d**2
                    p -= rate * d / np.sqrt(s)
        self.trained = True
        self.confidence = self._least_confidence(held or learned)

    def _truth(self, texts: list[str]) -> tuple[Graph, np.ndarray, np.ndarray]:
        """Graph, labels (-1: unknown) and spans' numbers."""
        g = Graph(texts)
        y, which = g.labels([base_spans(t) for t in texts])
        unknown = (y == 0) & (g.overlapped([near_misses(t) for t in texts]) >= 0)
        alike = y > 0
        for i, j in (*g.skip.tolist(), *g.skip[::-1].tolist()):  # along repeats, forth and back
            alike[i] = alike[j] = alike[i] or alike[j]
        unknown |= (y == 0) & alike
        return g, np.where(unknown, -1, y), which

    def _least_confidence(self, texts: list[str]) -> float:
        g, y, _ = self._truth(texts)
        if not len(y):
            return 0.99
        p = self.posteriors(g)
        for least in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95):
            found = (p[:, 1:].max(axis=1) >= least) & (y >= 0)
            if (p[found].argmax(axis=1) != y[found]).mean() <= FALSE_SHARE if found.any() else True:
                return least
        return 0.99

    def _messages(self, g: Graph, unary: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, ...]:
        """Messages by directed edge (all edges one way, then the other), with their ends and potentials."""
        edges = np.concatenate([g.chain, g.skip])
        pots = np.concatenate([np.broadcast_to(self.chain, (len(g.chain), LABELS, LABELS)), np.broadcast_to(self.skip, (len(g.skip), LABELS, LABELS))])
        src = np.concatenate([edges[:, 0], edges[:, 1]])
        dst = np.concatenate([edges[:, 1], edges[:, 0]])
        pots = np.concatenate([pots, pots.transpose(0, 2, 1)])  # by source's and target's label
        n = len(edges)
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        m = np.zeros((2 * n, LABELS))
        of = np.array([d for d, _, _ in g.bounds])
        limit = 64 + 4 * np.bincount(of)  # damped by a half, a message takes two rounds an edge on average
        limit = limit if rounds is None else np.minimum(limit, rounds)
        of = of[dst]
        live, done = np.arange(2 * n), 0
        while len(live):  # the messages of documents that have not settled; each stops at its own round, whatever its batch
            at = np.empty(2 * n, dtype=np.int64)
            at[live] = np.arange(len(live))
            rev, pot, x = at[back[live]], pots[live], m[live]
            nodes, to = np.unique(dst[live], return_inverse=True)
            docs, own = np.unique(of[live], return_inverse=True)
            u, over = unary[nodes], np.zeros(len(docs), dtype=bool)
            while not over.any():
                inner = ((u + _sums(to, x, len(u)))[to[rev]] - x[rev])[:, :, None] + pot
                top = inner.max(axis=1, keepdims=True)
                new = _log_softmax((top + np.log(np.exp(inner - top).sum(axis=1, keepdims=True)))[:, 0, :])
                new = DAMPING * x + (1 - DAMPING) * new
                moved = np.zeros(len(docs))
                np.maximum.at(moved, own, np.abs(new - x).max(axis=1))
                x, done = new, done + 1
                over = (moved < SETTLED) | (done >= limit[docs])
            m[live] = x
            live = live[~over[own]]
        return m, src, dst, pots

    def _beliefs(self, g: Graph, unary: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of nodes, chain edges and skip edges."""
        unary, n = _log_softmax(unary), len(g.chain) + len(g.skip)
        if not n:
            none = np.empty((0, LABELS, LABELS))
            return np.exp(unary), none, none
        m, src, dst, pots = self._messages(g, unary, rounds)
        total = unary + _sums(dst, m, len(unary))
        a, b = total[src[:n]] - m[n:], total[dst[:n]] - m[:n]  # less what came over the edge itself
        pair = a[:, :, None] + pots[:n] + b[:, None, :]
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        return np.exp(_log_softmax(total)), pair[: len(g.chain)], pair[len(g.chain) :]

    def posteriors(self, g: Graph, evidence: np.ndarray | None = None) -> np.ndarray:
        """Marginals of all nodes by loopy belief propagation, given labels (-1: none)."""
        unary = self.unary(g)
        return self._beliefs(g, unary if evidence is None else fixed(unary, evidence))[0]

    @staticmethod
    def _trimmed(g: Graph, texts: list[str], i: int, j: int) -> tuple[int, int, int]:
        """Document and bounds of a run of tokens without the punctuation around it."""
        d, start, _ = g.bounds[i]
        end, text = g.bounds[j - 1][2], texts[d]
        while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
            end -= 1
        while start < end and not (text[start].isalnum() or text[start] in "(+"):
            start += 1
        return d, start, end

    def added(self, texts: list[str], spans: list[list[Span]]) -> list[list[Span]]:
        """Spans of confident runs that overlap no given one."""
        out: list[list[Span]] = [[] for _ in texts]
        if not self.trained:
            return out
        g = Graph(texts)
        if not len(g.x):
            return out
        taken = g.labels(spans)[0]
        p = self.posteriors(g, np.where(taken > 0, taken, -1))
        label = np.where((taken == 0) & (p.max(axis=1) >= self.confidence), p.argmax(axis=1), 0)
        joined = np.zeros(len(label) + 1, dtype=bool)
        joined[g.chain[:, 1]] = True
        i = 0
        while i < len(label):
            j = i + 1
            if label[i]:
                while j < len(label) and joined[j] and label[j] == label[i]:
                    j += 1
                kind = int(label[i]) - 1
                whole = self._trimmed(g, texts, i, j)
                # a run of several numbers that is none as a whole may have one in it
                for d, start, end in [whole] if j == i + 1 or holds(kind, texts[whole[0]][whole[1] : whole[2]]) else [self._trimmed(g, texts, k, k + 1) for k in range(i, j)]:
                    if holds(kind, texts[d][start:end]):
                        out[d].append((start, kind, end))
            i = j
        return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SkipChainCRF:
    """Fits on at most ``MAX_TRAIN`` documents with a digit or ``@``, each as all its stretches of 100
    characters around such tokens (what else a document holds never reaches the driver; scoring reads whole texts)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, t in zip(batch.column("h").to_pylist(), batch.column("t").cast(pa.binary()).to_pylist(), strict=True):
                text, parts = t.decode("utf-8", "replace"), []
                for start, end in carriers(text):
                    a, b = max(0, start - 100), min(len(text), end + 100)
                    if parts and a <= parts[-1][1]:
                        parts[-1][1] = b
                    else:
                        parts.append([a, b])
                if parts:
                    rows.append((h, "\n".join(text[a:b] for a, b in parts)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["h", "t"])

    some = df.select(F.xxhash64(F.lit(23), id_col, text_of(text_col)).alias("h"), text_of(text_col).alias("t"))
    some = some.where(F.col("t").rlike("[0-9@]"))
    low = some.select("h").distinct().orderBy("h").limit(MAX_TRAIN)
    got = some.join(F.broadcast(low), "h").mapInArrow(windows, "h long, t string").dropDuplicates(["h"]).orderBy("h").limit(MAX_TRAIN).collect()
    model = SkipChainCRF()
    model.fit([r["t"] for r in got])
    return model


def _chunks(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with texts of ``CHUNK_BYTES``, or one longer text."""
    sizes = pa.compute.binary_length(whole.column("t").cast(pa.binary())).to_pylist()
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= CHUNK_BYTES):
            size += sizes[end]
            end += 1
        yield whole.slice(at, end - at)
        at = end


def find_pii(df: DataFrame, model: SkipChainCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, the patterns' counts by kind, their list's SHA-256, and all spans as a list and their number."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for whole in batches:
            for batch in _chunks(whole):
                texts = [t.decode("utf-8", "replace") for t in batch.column("t").cast(pa.binary()).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = crf.added(texts, base)
                counts = [[sum(k == kind for _, k, _ in b) for b in base] for kind in range(len(KINDS))]
                digest = [hashlib.sha256(listed(b).encode()).hexdigest() for b in base]
                spans = [listed(sorted(b + m)) for b, m in zip(base, more, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest), pa.array(spans), pa.array([len(b) + len(m) for b, m in zip(base, more, strict=True)], pa.int64())], names=names)

    schema = f"`{id_col}` long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long"
    return df.select(F.col(id_col).cast("long").alias(id_col), text_of(text_col).alias("t")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_pii(docs, train(docs))
