"""Sum-of-squares packing of token sequences.

A document's ids (and the end id after them) make one piece, or, above the capacity, pieces of the whole capacity after a
first one of the remainder. Pieces are dealt by hash to groups of about ``GROUP`` and packed there, longest first: a piece
goes to the open sequence that leaves the squared counts of open sequences per residual gap smallest, to a new one only
where it fits into none. Moving a sequence from gap g to g - s changes the sum of squares by 2 (N[g - s] - N[g]) + 2, or by
1 - 2 N[g] where it closes; all gaps are compared at once, ties go to the smallest gap and the sequence opened last.
The bound on a group's leftovers is a sequence's worth or so, against about ten thousand sequences in a group.

Ids are the tokenizers library's. Texts are cut where its split always begins a piece of its own: before a space that a
character other than white space follows, before and after the last line break of such a run, and after a letter that an
ASCII character other than a letter follows (see ``_begins``). Arrow numbers the distinct words of a run; those not met
before are encoded joined, behind spaces or line breaks, and split again by their tokens' bytes. Only a vocabulary of
byte-level tokens without a normaliser allows that; any other is encoded text by text. Special tokens' strings in a text
are ordinary text.

Defined cases: null or empty text is one piece, the end id; null ids and repeated rows are documents of their own; an
empty table gives an empty result; extra columns are ignored. Texts of any length are read in slices of ``SLICE``
characters, words without white space excepted, which are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_of, written

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0
GROUP = 16_384
SLICE = 4 << 20
CHUNK_BYTES = 4 << 20
MEMO_WORDS = 400_000
MEMO_CHARS = 16 << 20
JOINED = 64
#: A space before anything but white space (U+180E was white space in older Unicode).
WORD = re.compile(" (?=[^\\s᠎])")

_BYTES = np.arange(256)
_LETTER = (_BYTES >= 65) & (_BYTES <= 90) | (_BYTES >= 97) & (_BYTES <= 122)
_SPACE = (_BYTES >= 9) & (_BYTES <= 13) | (_BYTES >= 28) & (_BYTES <= 32)
#: First bytes of characters that are never white space: visible ASCII, and all from U+00C0 on but of U+1000 to U+3FFF.
_SOLID = (_BYTES > 32) & (_BYTES < 127) | (_BYTES >= 0xC3) & ((_BYTES < 0xE1) | (_BYTES > 0xE3))
_PAD = b"   "


def _visible(head: bytes) -> bool:
    """Whether a text that begins so begins with no white space."""
    return bool(_SOLID[head[0]]) or head[0] >= 0x80 and WORD.match(" " + head.decode("utf-8", "ignore")) is not None


def _begins(a: np.ndarray) -> np.ndarray:
    """Where UTF-8 bytes (with ``_PAD`` behind them) can be cut, so that the parts' splits by the byte-level pattern are
    the split of the whole.

    The pattern's pieces are letters, digits or other marks, each with a space before them or not, contractions, and runs
    of white space, which leave their last character to what follows. So a space starts a piece unless white space
    follows; a line break before anything else is a piece; letters end before what is no letter.
    """
    n = len(a) - len(_PAD)
    x, y = a[:n], a[1 : n + 1]
    out = (x == 32) & ~_SPACE[y]
    for i in np.flatnonzero(out & (y >= 0x80) & ~_SOLID[y]).tolist():
        out[i] = _visible(a[i + 1 : i + 5].tobytes())
    line = (x == 10) & _SOLID[y]
    out |= line
    out[1:] |= line[:-1]
    letter = _LETTER[x]
    letter[1:] |= (x[:-1] == 0xC3) & (x[1:] != 0x97) & (x[1:] != 0xB7)  # U+00C0 to U+00FF but two signs
    out[1:] |= letter[:-1] & (x[1:] > 32) & (x[1:] < 127) & ~_LETTER[x[1:]]
    return out


class Encoder:
    """Ids of texts by one tokenizer; words met before are remembered up to a bound, then those met most."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        shape = json.loads(definition)
        before = shape.get("pre_tokenizer") or {}
        self.by_word = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not shape.get("normalizer") and not shape.get("post_processor") and shape["model"]["type"] == "BPE" and not shape["model"].get("continuing_subword_prefix") and not shape["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.words = pa.array([], pa.binary())
        self.flat, self.used = np.empty(1 << 16, dtype=np.int32), 0
        self.at, self.n, self.met = (np.empty(0, dtype=np.int64) for _ in range(3))  # by word: where its ids begin, how many, how often met

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)

    def _forget(self) -> None:
        """Keeps the words met most, of those met again, up to half the bounds."""
        order = np.argsort(-self.met, kind="stable")[: MEMO_WORDS // 2]
        order = order[self.met[order] > 1]
        sizes = pa.compute.binary_length(self.words).to_numpy()[order]
        order = order[np.cumsum(sizes, dtype=np.int64) <= MEMO_CHARS // 2]
        self.words = self.words.take(pa.array(order))
        self.flat = self._ids(order)
        self.used = len(self.flat)
        self.n = self.n[order]
        self.at = np.cumsum(self.n) - self.n
        self.met = self.met[order] // 2

    def _ids(self, words: np.ndarray) -> np.ndarray:
        n = self.n[words]
        return self.flat[np.arange(int(n.sum())) + np.repeat(self.at[words] - (np.cumsum(n) - n), n)]

    def _learn(self, new_words: pa.Array) -> None:
        """Words that begin with a space are joined as they are, visible ones behind line breaks, others come alone."""
        words = new_words.to_pylist()
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for k, w in enumerate(words):
            spaced = w[0] == 32 and len(w) > 1
            kinds[2 if not _visible(w[1:5] if spaced else w[:4]) else 0 if spaced else 1].append(k)
        at, n = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
        new, used = [], self.used
        for own, mark, joined in zip(kinds, (b"", b"\n", b""), (JOINED, JOINED, 1), strict=True):
            parts = [own[lo : lo + joined] for lo in range(0, len(own), joined)]
            texts = [(mark + mark.join([words[k] for k in part])).decode() for part in parts]
            if not texts:
                continue
            got = [np.array(x.ids, dtype=np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            flat = np.concatenate(got)
            ends = np.cumsum([len(words[k]) + len(mark) for k in own])
            last = np.searchsorted(np.cumsum(self.n_bytes[flat]), ends, "right")
            n[own] = np.diff(last, prepend=0) - len(mark)  # a line break is one token
            at[own] = used + last - n[own]
            new.append(flat)
            used += len(flat)
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), 1 << 16), dtype=np.int32)])
        self.flat[self.used : used] = np.concatenate(new)
        self.used = used
        self.at, self.n = np.concatenate([self.at, at]), np.concatenate([self.n, n])
        self.met = np.concatenate([self.met, np.zeros(len(words), dtype=np.int64)])
        self.words = pa.concat_arrays([self.words, new_words])

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE and (cut := WORD.search(text, at + SLICE)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _run(self, slices: list[str]) -> list[np.ndarray]:
        if len(self.words) > MEMO_WORDS or self.words.nbytes > MEMO_CHARS:
            self._forget()
        data = [s.encode() for s in slices]
        ends = np.cumsum([len(d) + 1 for d in data])
        raw = b" ".join([*data, _PAD])  # a space ends each slice; it is a word without ids
        a = np.frombuffer(raw, dtype=np.uint8)
        begins = _begins(a)
        begins[0] = True
        begins[ends - 1] = True
        begins[ends[:-1]] = True
        bounds = np.append(np.flatnonzero(begins), ends[-1])
        words = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        own, known = words.dictionary, len(self.words)
        found = pa.compute.index_in(own, value_set=self.words)
        if found.null_count:
            self._learn(own.filter(found.is_null()))
        code = found.fill_null(-1).to_numpy().astype(np.int64)
        code[code < 0] = np.arange(known, len(self.words))
        which = words.indices.to_numpy()
        self.met[code] += np.bincount(which, minlength=len(code))
        word = code[which]
        stop = np.searchsorted(bounds, ends - 1)
        word = np.delete(word, stop)
        count = np.cumsum(self.n[word])
        ids = self._ids(word)
        upto = np.concatenate([[0], count])[stop - np.arange(len(stop))]
        return np.split(ids, upto[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.by_word:
            return [self._plain(t) for t in texts]
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, str]] = []
        size = 0
        for k, t in enumerate(texts):
            for s in self._slices(t):
                waiting.append((k, s))
                size += len(s)
                if size >= SLICE:
                    self._flush(parts, waiting)
                    waiting, size = [], 0
        self._flush(parts, waiting)
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in parts]

    def _flush(self, parts: list[list[np.ndarray]], waiting: list[tuple[int, str]]) -> None:
        if waiting:
            for (k, _), ids in zip(waiting, self._run([s for _, s in waiting]), strict=True):
                parts[k].append(ids)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


_encoders: dict[int, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """The worker's encoder: tasks that follow each other share what it remembers."""
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    sizes = pa.compute.binary_length(batch.column(1).cast(pa.binary())).to_pylist()
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= CHUNK_BYTES):
            size += sizes[end]
            end += 1
        yield at, end
        at = end


def cut(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """The pieces of each document: ``id_col``, piece, start, length, ids_crc32 (little-endian 32-bit ids) and the ids."""
    with open(tokenizer or tokenizer_path(), encoding="utf-8") as f:
        definition = df.sparkSession.sparkContext.broadcast(f.read())
    names = ["piece", "start", "length", "ids_crc32"]
    schema = T.StructType([df.schema[id_col], T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in names[1:]], *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        for batch in batches:
            for lo, hi in _runs(batch):
                texts = [t.decode("utf-8", "replace") for t in batch.column(1).slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
                owner, piece, start, length, crc, flat = [], [], [], [], [], []
                for k, ids in enumerate(encoder.encode(texts)):
                    ids = np.append(ids, np.int32(END_ID))
                    first = (len(ids) - 1) % capacity + 1
                    ends = range(first, len(ids) + 1, capacity)
                    for p, end in enumerate(ends):
                        begin = max(0, end - capacity) if p else 0
                        owner.append(lo + k)
                        piece.append(p)
                        start.append(begin)
                        length.append(end - begin)
                        crc.append(zlib.crc32(ids[begin:end].astype("<u4").tobytes()))
                    flat.append(ids)
                cols = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(np.concatenate(flat), pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each piece, placed longest first, equal ones in the given order."""
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap; none has gap 0
    open_by_gap: list[list[int]] = [[] for _ in range(capacity)]
    opened = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[k])
        fits = np.flatnonzero(count[s:capacity]) + s
        if len(fits):
            change = 2 * (count[fits - s] - count[fits]) + 2
            if fits[0] == s:  # this one closes: nothing is counted at gap 0
                change[0] = 1 - 2 * count[s]
            gap = int(fits[change.argmin()])
            seq = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, seq, opened = capacity, opened, opened + 1
        sequence[k], offset[k] = seq, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_by_gap[gap - s].append(seq)
    return sequence, offset


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table with ``length``) with sequence_id and offset; sequences are filled without gaps."""
    keys = [c for c in pieces.columns if c != "ids"]
    groups = max(1, -(-pieces.count() // GROUP))
    order = ["length", "_deal"]
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(group: tuple, data: pa.Table) -> pa.Table:
        data = data.take(pa.compute.sort_indices(data, sort_keys=[(c, "ascending") for c in order]))
        sequence, offset = sum_of_squares(data.column("length").to_numpy(), capacity)
        data = data.drop_columns(["_group", "_deal"])
        return data.append_column("sequence_id", pa.array(sequence + (group[0].as_py() << 32))).append_column("offset", pa.array(offset))

    deal = F.xxhash64(*keys, F.monotonically_increasing_id())
    dealt = pieces.withColumn("_deal", deal).withColumn("_group", F.pmod("_deal", F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(pack, schema)


def sequences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences: sequence_id, ids, and doc_ids and starts (where each document's piece begins), by offset."""
    pieces = written(cut(df, id_col, text_col, tokenizer, capacity).withColumn("seat", F.monotonically_increasing_id()), "pieces")
    placed = place(pieces.select("seat", "length"), capacity).select("seat", "sequence_id", "offset")
    held = F.sort_array(F.collect_list(F.struct("offset", F.col(id_col).alias("doc_id"), "ids")))
    return pieces.join(placed, "seat").groupBy("sequence_id").agg(held.alias("held")).select(
        "sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.doc_id").alias("doc_ids"), F.col("held.offset").alias("starts")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return place(written(cut(table(spark, sf_dir, "documents"), with_ids=False), "pieces"))
