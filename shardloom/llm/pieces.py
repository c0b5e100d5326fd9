"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut where no piece can cross (before a word's first space mark, around line ends), the distinct
segments are laid end to end and indexed by a suffix array (sorted to the longest piece's length; a mark ends each
segment). Every piece of the vocabulary is binary-searched for its range of occurrences; the ranges are the edges of
all segments' lattices, which are sorted by end position and relaxed, all segments in step.

For a BPE vocabulary the relaxation keeps, at each position, the one edge that byte-pair merging of the prefix would end
with: an edge is compatible with the best edge before it if merging the two pieces' texts gives just these two. Pieces
that merging never yields (unreachable ones) make no edges. Characters without a piece become byte pieces.
The ids equal those of the sentencepiece library for the same model file.

The model is read on the driver and shipped (its size is fixed). Defined cases: null or empty text has no ids; U+2581 in
a text decodes to a space, as the format has it; unpaired surrogates are replaced; runs of spaces, whose pieces tie in
score, are merged directly, leftmost first. Extra columns are ignored or carried, as asked.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of, unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHUNK_CHARS = 3 << 18
MEMO = 200_000
MEMO_CHARS = 8 << 20
SLICE = 1 << 19
LATTICE_CHARS = 1 << 18
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
MOST_PAIRS = 500_000


class PieceModel:
    """A BPE model's pieces with their scores; bytes, control pieces and the unknown piece apart."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.unk = sp.unk_id()
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.width = max(map(len, self.ids), default=1)
        self.cuts_words = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cuts_lines = not any("\n" in p for p in self.ids)
        self.surface = [
            bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        alphabet = sorted({c for p in self.ids for c in p})
        self.code = np.zeros(0x110000, dtype=np.uint16)
        for k, c in enumerate(alphabet):
            self.code[ord(c)] = k + 1
        order = [(p, i) for p, i in self.ids.items() if self.merge(p) == [p]]
        self.piece_id = np.array([i for _, i in order], dtype=np.int32)
        self.piece_len = np.array([len(p) for p, _ in order], dtype=np.int32)
        keys = np.zeros((len(order), self.width), dtype=">u2")
        for k, (p, _) in enumerate(order):
            keys[k, : len(p)] = [self.code[ord(c)] for c in p]
        top = np.where(np.arange(self.width)[None, :] < self.piece_len[:, None], keys, 0xFFFF).astype(">u2")
        self.low, self.high = (np.ascontiguousarray(x).view(f"S{2 * self.width}").ravel() for x in (keys, top))
        if self.cuts_words:
            body = f"[^{MARK}\n]" if self.cuts_lines else f"[^{MARK}]"
            self.segment = re.compile(f"{MARK}*{body}+|{MARK}+" + ("|\n" if self.cuts_lines else ""))
        else:
            self.segment = re.compile("[^\n]+|\n" if self.cuts_lines else "(?s:.+)")
        #: where a text can be cut: a word's first mark, or else a line's end
        self.edge = re.compile(f"(?<!{MARK}){MARK}" if self.cuts_words else "\n") if self.cuts_words or self.cuts_lines else None
        self.pairs: dict[int, bool] = {}
        self.slot_key: np.ndarray | None = None
        self.slot_ok: np.ndarray | None = None

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging: the best-scored neighbouring pair first, ties leftmost."""
        part: list[str | None] = list(text)
        if len(part) <= 40:
            while len(part) > 1:
                best, at = None, -1
                for i in range(len(part) - 1):
                    s = self.score.get(part[i] + part[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if best is None:
                    break
                part[at : at + 2] = [part[at] + part[at + 1]]
            return part
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(part):
                both = part[i] + part[after[i]]
                if both in self.score:
                    heapq.heappush(heap, (-self.score[both], i, both))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= len(part) or part[i] + part[j] != both:
                continue
            part[i], part[j], after[i] = both, None, after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p is not None]

    def to_ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "replace")]
            else:
                out.append(self.unk)
        return out

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the texts of two pieces gives the two; pieces without id (-1) never merge.

        Answers are kept in a direct-mapped table of ``SLOTS`` pairs, looked up for all edges at once, behind it in a dict.
        """
        known, n = self.pairs, len(self.pieces)
        if self.slot_key is None:
            self.slot_key, self.slot_ok = np.full(SLOTS, -1, dtype=np.int64), np.zeros(SLOTS, dtype=bool)
        keys = left.astype(np.int64) * n + right
        with np.errstate(over="ignore"):
            slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        real = (left >= 0) & (right >= 0)
        out = ~real | self.slot_ok[slot]
        miss = np.flatnonzero(real & (self.slot_key[slot] != keys))
        if len(miss):
            asked, back = np.unique(keys[miss], return_inverse=True)
            if len(known) > MOST_PAIRS:
                known.clear()
            ok = np.zeros(len(asked), dtype=bool)
            for k, key in enumerate(asked.tolist()):
                fit = known.get(key)
                if fit is None:
                    a, b = self.pieces[key // n], self.pieces[key % n]
                    fit = known[key] = self.merge(a + b) == [a, b]
                ok[k] = fit
            out[miss] = ok[back]
            self.slot_key[slot[miss]] = keys[miss]
            # of pairs that share a slot only the last one written stays, and with it its answer
            stays = self.slot_key[slot[miss]] == keys[miss]
            self.slot_ok[slot[miss][stays]] = out[miss][stays]
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": {}, "slot_key": None, "slot_ok": None}


def lattice_ids(model: PieceModel, segments: list[str]) -> list[np.ndarray]:
    """Ids of each segment, by one suffix array over all of them."""
    out: list[np.ndarray | None] = [None] * len(segments)
    plain = []
    for k, s in enumerate(segments):
        if s.startswith(MARK * 2) or (len(s) > 1 and not model.cuts_words):
            out[k] = np.array(model.to_ids(model.merge(s)), dtype=np.int32)
        else:
            plain.append(k)
    if not plain:
        return out
    text = "".join(segments[k] for k in plain)
    lens = np.array([len(segments[k]) for k in plain])
    start = np.cumsum(lens) - lens
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    code, m, w = model.code[chars], len(chars), model.width
    seg_start = np.repeat(start, lens)
    rest = np.repeat(start + lens, lens) - np.arange(m)
    padded = np.concatenate([code, np.zeros(w, dtype=np.uint16)])
    window = np.empty((m, w), dtype=">u2")
    for k in range(w):
        window[:, k] = np.where(rest > k, padded[k : k + m], 0)
    words = np.zeros((m, -(-w // 4) * 4), dtype=">u2")
    words[:, :w] = window
    keys = words.view(">u8").astype(np.uint64)
    del words
    suffixes = np.lexsort(tuple(keys[:, k] for k in range(keys.shape[1] - 1, -1, -1)))
    del keys
    ranked = window[suffixes].view(f"S{2 * w}").ravel()
    del window
    lo, hi = np.searchsorted(ranked, model.low, "left"), np.searchsorted(ranked, model.high, "right")
    del ranked
    count = hi - lo
    edge_piece = np.repeat(np.arange(len(lo)), count)
    edge_at = suffixes[np.arange(len(edge_piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    edge_id, edge_end = model.piece_id[edge_piece], edge_at + model.piece_len[edge_piece]
    lone = np.flatnonzero(code == 0)
    edge_at = np.concatenate([edge_at, lone])
    edge_id = np.concatenate([edge_id, np.full(len(lone), -1, dtype=np.int32)])
    edge_end = np.concatenate([edge_end, lone + 1])
    step = edge_end - seg_start[edge_at]
    order = np.argsort(step, kind="stable")
    edge_at, edge_id, edge_end, step = edge_at[order], edge_id[order], edge_end[order], step[order]
    last, back = np.full(m, -2, dtype=np.int32), np.zeros(m, dtype=np.int64)
    bound = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
    for a, b in zip(bound[:-1], bound[1:], strict=True):
        at, piece, end = edge_at[a:b], edge_id[a:b], edge_end[a:b]
        inner = at > seg_start[at]
        ok = ~inner
        if inner.any():
            ok[inner] = model.fits(last[at[inner] - 1], piece[inner])
        last[end[ok] - 1], back[end[ok] - 1] = piece[ok], at[ok]
    at, alive = start + lens - 1, np.arange(len(plain))
    steps = []
    while len(alive):
        steps.append((alive, last[at], at))
        before = back[at] - 1
        go = before >= start[alive]
        alive, at = alive[go], before[go]
    n = np.zeros(len(plain), dtype=np.int64)
    for alive, _, _ in steps:
        n[alive] += 1
    off = np.concatenate([[0], np.cumsum(n)])
    ids, where = np.empty(off[-1], dtype=np.int32), np.empty(off[-1], dtype=np.int64)
    for k, (alive, piece, at) in enumerate(steps):
        ids[off[alive + 1] - 1 - k], where[off[alive + 1] - 1 - k] = piece, at
    odd = set(np.searchsorted(off, np.flatnonzero(ids < 0), side="right") - 1)
    for k, seg in enumerate(plain):
        own = ids[off[k] : off[k + 1]]
        if k in odd:
            made: list[int] = []
            for i, p in zip(own.tolist(), where[off[k] : off[k + 1]].tolist(), strict=True):
                made += [i] if i >= 0 else model.to_ids([chr(chars[p])])
            own = np.array(made, dtype=np.int32)
        out[seg] = own
    return out


def _split_long(model: PieceModel, segment: str) -> list[str]:
    """Parts of an over-long segment: it is cut around characters that no piece has, which never merge with others."""
    chars = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lone = np.flatnonzero(model.code[chars] == 0)
    cut = np.unique(np.concatenate([[0], lone, lone + 1, [len(segment)]]))
    return [segment[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


class Encoder:
    """Encodes batches; segments met before in the task are remembered, up to ``MEMO`` of them and ``MEMO_CHARS``.

    Texts are read in slices of about ``SLICE`` characters, and new segments are indexed in runs of ``LATTICE_CHARS``, so
    memory doesn't grow with a text but for its ids. Only a segment (a word) without a character unknown to the model is
    never split.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.memo, self.chars, self.flat, self.used, self.off = {}, 0, np.empty(1 << 16, dtype=np.int32), 0, np.zeros(1, dtype=np.int64)

    def _slices(self, text: str) -> Iterator[str]:
        """Runs of whole segments of a marked text."""
        at = 0
        while len(text) - at > SLICE and self.model.edge and (cut := self.model.edge.search(text, at + SLICE)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _learn(self, segments: list[str]) -> None:
        size, run = 0, []
        for s in segments:
            if run and size + len(s) > LATTICE_CHARS:
                self._learn_run(run)
                size, run = 0, []
            run.append(s)
            size += len(s)
        self._learn_run(run)

    def _learn_run(self, run: list[str]) -> None:
        if len(run) == 1 and len(run[0]) > LATTICE_CHARS and len(parts := _split_long(self.model, run[0])) > 1:
            other = Encoder(self.model)
            made = [np.concatenate(other.lists(parts))]
        else:
            made = lattice_ids(self.model, run)
        new = np.concatenate(made)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum([len(x) for x in made])])
        self.chars += sum(map(len, run))

    def lists(self, segments: list[str]) -> list[np.ndarray]:
        """Ids of each segment."""
        memo = self.memo
        known = len(memo)
        at = np.fromiter((memo.setdefault(s, len(memo)) for s in segments), dtype=np.int64, count=len(segments))
        if len(memo) > known:
            self._learn(list(islice(memo, known, None)))
        return [self.flat[self.off[k] : self.off[k + 1]] for k in at]

    def _run(self, slices: list[str]) -> list[np.ndarray]:
        if len(self.memo) > MEMO or self.chars > MEMO_CHARS:
            self._forget()
        memo, find, docs = self.memo, self.model.segment.findall, []
        known = len(memo)
        for t in slices:
            segments = find(t)
            docs.append(np.fromiter((memo.setdefault(s, len(memo)) for s in segments), dtype=np.int64, count=len(segments)))
        if len(memo) > known:
            self._learn(list(islice(memo, known, None)))
        out = []
        for d in docs:
            n = self.off[d + 1] - self.off[d]
            first = np.cumsum(n) - n
            out.append(self.flat[np.arange(int(n.sum())) + np.repeat(self.off[d] - first, n)])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, str]] = []
        size = 0
        for k, t in enumerate(texts):
            for s in self._slices(MARK + t.replace(" ", MARK)) if t else ():
                waiting.append((k, s))
                size += len(s)
                if size >= SLICE:
                    self._flush(parts, waiting)
                    waiting, size = [], 0
        self._flush(parts, waiting)
        empty = np.empty(0, dtype=np.int32)
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else empty for p in parts]

    def _flush(self, parts: list[list[np.ndarray]], waiting: list[tuple[int, str]]) -> None:
        for (k, _), ids in zip(waiting, self._run([s for _, s in waiting]) if waiting else [], strict=True):
            parts[k].append(ids)


def decode(model: PieceModel, ids: np.ndarray) -> str:
    """The text of ids; the space that encoding puts in front goes."""
    text = b"".join(map(model.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if len(ids) and model.pieces[ids[0]].startswith(MARK) else text


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        sizes = pa.compute.binary_length(texts).to_pylist()
        at = 0
        while at < len(sizes):
            end, size = at, 0
            while end < len(sizes) and (end == at or size + sizes[end] <= CHUNK_CHARS):
                size += sizes[end]
                end += 1
            yield batch.slice(at, end - at), [t.decode("utf-8", "replace") for t in texts.slice(at, end - at).to_pylist()]
            at = end


def encode(df: DataFrame, text_col: str = "text", model_path: str = MODEL, ids_col: str = "token_ids") -> DataFrame:
    """``df`` with the ids of ``text_col`` as an array column, which replaces one of that name."""
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(PieceModel(model_path))
    kept = [f for f in df.schema.fields if f.name != ids_col]
    schema = T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch, texts in _chunks(batches):
            ids = encoder.encode(texts)
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], made], names=[*[f.name for f in kept], ids_col])

    return df.select(*[F.col(f"`{f.name}`") for f in kept], text_of(text_col).alias(unused(df, "_text"))).mapInArrow(run, schema)


def encode_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """Per row: ``id_col``, n_chars, n_tokens, n_byte_tokens, ids_sha256 (32-bit little-endian ids), decoded_sha256
    (decoded text, UTF-8) and round_trip."""
    model = df.sparkSession.sparkContext.broadcast(PieceModel(model_path))
    names = [id_col, "n_chars", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, m = Encoder(model.value), model.value
        is_byte = np.zeros(len(m.pieces), dtype=bool)
        is_byte[list(m.bytes.values())] = True
        for batch, texts in _chunks(batches):
            cols: list[list] = [[] for _ in names[1:]]
            for t, ids in zip(texts, encoder.encode(texts), strict=True):
                back = decode(m, ids)
                row = (len(t), len(ids), int(is_byte[ids].sum()), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == t)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2 + [pa.bool_()], strict=True)]], names=names)

    schema = T.StructType([df.schema[id_col], *[T.StructField(n, T.LongType()) for n in names[1:4]], *[T.StructField(n, T.StringType()) for n in names[4:6]], T.StructField(names[6], T.BooleanType())])
    return df.select(F.col(id_col), text_of(text_col).alias(unused(df, "_text"))).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return encode_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
