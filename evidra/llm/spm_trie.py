"""Operator 8, SentencePiece encoding and decoding: shared-prefix Viterbi.

Texts are cut into marked words (a run of word marks and what follows it; no piece crosses such a cut, which is
checked when the model is read). The distinct words of a slice are sorted, so that they form a trie in depth-first
order, and are traversed with one stack of forward states: words with a common prefix reuse its
states. The state at a position is the last piece of the best path to it.

For a unigram model a state is the best sum of piece scores. For a BPE model the sum of scores does not give
the library's pieces; there a path is right exactly when each two neighbouring pieces, encoded as one string,
stay these two pieces, so the state is the only piece that may follow the state before it. Both
recurrences look only backwards, and so share prefixes alike. Results equal the library's encode().

Defined results: a null or empty text has no ids and decodes to an empty text. Characters outside the
vocabulary become byte pieces. A literal word mark decodes to a space, as in the library. Repeated rows give
repeated results, an empty table an empty one. Other columns pass through on request; n_tokens, ids
and round_trip are replaced if there. The vocabulary's path is a parameter; files are read on each worker.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from . import textkit
from .staging import small_batches

MARK = "▁"
PLAIN = "\x01"
#: Words kept with their ids by each Python worker, between batches.
MEMO_WORDS = 120_000
#: Checked pairs of pieces kept likewise.
MEMO_PAIRS = 200_000
SLICE_CHARS = 1_000_000
_UNIGRAM, _BPE = 1, 2
#: Score of a character outside the vocabulary, for unigram models.
OUTSIDE = -1e4
#: Characters of a word that are compared in arrays.
HEAD = 24


def _kind(model: bytes) -> int:
    """The model_type field of the trainer settings (TrainerSpec in field 2 of the model, type in its field 3)."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                b = data[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        while at < len(data):
            tag = varint()
            wire = tag & 7
            if wire == 0:
                yield tag >> 3, varint()
            else:
                n = varint() if wire == 2 else 8 if wire == 1 else 4
                yield tag >> 3, data[at : at + n]
                at += n

    for number, value in fields(model):
        if number == 2:
            return next((v for k, v in fields(value) if k == 3), _UNIGRAM)
    return _UNIGRAM


class Encoder:
    def __init__(self, path: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            self.bpe = _kind(f.read()) == _BPE
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.out = [b""] * lib.get_piece_size()
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.out[i] = bytes([int(piece[3:5], 16)])
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece crosses words; this model can't be encoded word by word")
                self.id[piece], self.score[piece] = i, lib.get_score(i)
                self.out[i] = piece.replace(MARK, " ").encode()
        if lib.normalize("a  ﬁ") != "▁a▁▁ﬁ" or any(lib.is_unknown(i) for i in self.byte_id):
            raise ValueError("the model's normalisation is not the identity with a leading mark and byte fallback")
        self.dtype = np.uint16 if len(self.out) <= 65536 else np.uint32
        self.n_pairs = 0
        self.memo: dict[str, bytes] = {}
        self.changed: set[str] = set()

    @cached_property
    def raw(self) -> dict[str, bytes]:
        return {p: np.array([i], self.dtype).tobytes() for p, i in self.id.items()}

    @cached_property
    def ending(self) -> dict[str, str | None]:
        """All that some piece begins with, and for each the longest piece that it ends with."""
        out: dict[str, str | None] = {"": None}
        for piece in self.id:
            for n in range(len(piece), 0, -1):
                if (p := piece[:n]) in out:
                    break
                out[p] = p if p in self.id else self._suffix(p)
        return out

    @cached_property
    def shorter(self) -> dict[str, str | None]:
        """For each piece the next shorter one that it ends with."""
        return {p: self._suffix(p) for p in self.id}

    @cached_property
    def info(self) -> dict[str, tuple[dict[str, bool], bytes]]:
        """For each piece met so far: which pieces may follow it or not, as far as checked, and its ids."""
        return {"": ({}, b"")}

    def _suffix(self, s: str) -> str | None:
        """The longest piece that is a proper suffix."""
        return next((s[j:] for j in range(1, len(s)) if s[j:] in self.id), None)

    def _merge(self, s: str) -> list[str]:
        """BPE of a short string by its merges, the best score and then the leftmost first."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                v = self.score.get(parts[i] + parts[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stays(self, a: str, b: str, after: dict[str, bool]) -> bool:
        """Whether piece b may follow piece a, kept in ``after``, which is a's own."""
        if self.n_pairs >= MEMO_PAIRS:
            for checked, _ in self.info.values():
                checked.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        after[b] = got = self._merge(a + b) == ([a, b] if a else [b])
        return got

    def _ids(self, piece: str) -> bytes:
        """A piece's id as bytes, or the ids of its own bytes where it has none."""
        i = self.id.get(piece)
        return np.array([i] if i is not None else [self.byte_id[b] for b in piece.encode()], self.dtype).tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, by one depth-first walk over the trie that the sorted words make.

        Each depth has its forward state: the last piece, what may follow it or the best sum of scores, the ids so far, and where the longest
        run begins that some piece could go on from.
        """
        words = sorted(words)
        depth = max(map(len, words), default=0) + 1
        pieces, states, codes, starts = [""] * depth, [None] * depth, [b""] * depth, [0] * depth
        ending, shorter, info, score, stays = self.ending, self.shorter, self.info, self.score, self._stays
        states[0] = info[""][0] if self.bpe else 0.0
        out: dict[str, bytes] = {}
        for word, n in zip(words, _shared(words), strict=True):
            start = starts[n]
            for i in range(n + 1, len(word) + 1):
                run = word[start:i]
                while run not in ending:
                    start += 1
                    run = word[start:i]
                piece = ending[run]
                if self.bpe:
                    while piece is not None:
                        j = i - len(piece)
                        state = states[j]
                        ok = state.get(piece)
                        if ok or ok is None and stays(pieces[j], piece, state):
                            break
                        piece = shorter[piece]
                    else:  # a character outside the vocabulary
                        piece, j = word[i - 1], i - 1
                        if not stays(pieces[j], piece, states[j]):
                            raise ValueError(f"no pieces for {word[:i]!r}")
                else:
                    total = None
                    for p in _chain(piece, shorter) if word[i - 1] in score else (*_chain(piece, shorter), word[i - 1]):
                        v = states[i - len(p)] + score.get(p, OUTSIDE)
                        if total is None or v > total:
                            piece, total = p, v
                    j = i - len(piece)
                found = info.get(piece)
                if found is None:
                    found = info[piece] = ({}, self._ids(piece))
                pieces[i] = piece
                states[i] = found[0] if self.bpe else total
                codes[i] = codes[j] + found[1]
                starts[i] = start
            out[word] = codes[len(word)]
        return out

    @staticmethod
    def cut(text: str) -> list[str]:
        """Keys of the marked words of a text, newlines apart. A key is the word without its mark; words with no mark, several marks or
        nothing else have their whole text behind ``PLAIN``, as a mark costs two bytes a sign."""
        if not text:
            return []
        lines = text.split("\n") if MARK not in text else text.replace(MARK, " ").split("\n")
        out: list[str] = []
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
            parts = line.split(" ")
            if "" in parts[1:] or parts[0] == "" and len(parts) > 1 or PLAIN in line:
                run = MARK if k == 0 else ""
                for n, p in enumerate(parts):
                    run += MARK if n else ""
                    if p:
                        out.append(PLAIN + run + p)
                        run = ""
                if run:
                    out.append(PLAIN + run)
                continue
            if k:
                if parts[0]:
                    parts[0] = PLAIN + parts[0]
                else:
                    parts = parts[1:]
            elif not parts[0]:
                parts[0] = PLAIN + MARK
            out += parts
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_checked(texts)[0]

    def encode_checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether they decode to it; the ids of a word are decoded once."""
        cuts = [self.cut(t) for t in texts]
        codes = dict.fromkeys(itertools.chain.from_iterable(cuts))
        missing = []
        for key in codes:
            code = codes[key] = self.memo.get(key)
            if code is None:
                missing.append(key)
        words = [w[1:] if w[0] == PLAIN else w if w == "\n" else MARK + w for w in missing]
        ids = self.encode_words(list(set(words)))
        new = {key: ids[word] for key, word in zip(missing, words, strict=True)}
        codes |= new
        nul = np.array([self.byte_id[0]], self.dtype).tobytes()
        if self._bytes(nul.join(ids.values())) != "\0".join(ids).replace(MARK, " ").encode():
            self.changed |= {key for key, word in zip(missing, words, strict=True) if self._bytes(new[key]) != word.replace(MARK, " ").encode()}
        out = [np.frombuffer(b"".join(map(codes.__getitem__, c)), self.dtype) for c in cuts]
        same = [not self.changed or self.changed.isdisjoint(c) for c in cuts]
        self._learn(new, codes)
        return out, same

    def _learn(self, new: dict[str, bytes], used: dict[str, bytes]) -> None:
        """Keep new words. When that is too much a quarter of the memo makes room: words that this slice used stay, then the oldest."""
        if len(self.memo) + len(new) > MEMO_WORDS:
            most = MEMO_WORDS * 3 // 4
            stay = {w: c for w, c in self.memo.items() if w in used}
            self.memo = dict(itertools.islice((stay | self.memo).items(), most))
            new = dict(itertools.islice(new.items(), MEMO_WORDS - len(self.memo)))
        self.memo |= new
        self.changed &= self.memo.keys()

    def _bytes(self, code: bytes) -> bytes:
        return b"".join(map(self.out.__getitem__, np.frombuffer(code, self.dtype).tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def _chain(piece: str | None, shorter: dict[str, str | None]) -> Iterator[str]:
    while piece is not None:
        yield piece
        piece = shorter[piece]


def _shared(words: list[str]) -> list[int]:
    """How many characters each word has in common with the one before; the first ones are compared in arrays."""
    if len(words) < 2:
        return [0] * len(words)
    heads = np.array([w[:HEAD] for w in words], f"U{HEAD}").view(np.uint32).reshape(len(words), HEAD)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    unlike = heads[1:] != heads[:-1]
    same = np.where(unlike.any(1), unlike.argmax(1), HEAD)
    same = np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))
    for k in np.flatnonzero(same == HEAD):
        a, b, n = words[k], words[k + 1], HEAD
        while n < len(a) and n < len(b) and a[n] == b[n]:
            n += 1
        same[k] = n
    return [0, *same.tolist()]


@textkit.worker_cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text) with n_tokens, ids and round_trip (decoding gives the text back)."""
    small_batches(docs.sparkSession)
    new = {"n_tokens", "ids", "round_trip"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new and c != text]
    schema = StructType(
        [docs.schema[c] for c in kept]
        + [StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType(), False)), StructField("round_trip", BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in batches:
            column = batch.column(text)
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and size < SLICE_CHARS:
                    texts.append(column[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                ids, same = enc.encode_checked(texts)
                counts = np.array([len(i) for i in ids], np.int64)
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if len(ids) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(at, len(texts)) for c in kept]
                    + [pa.array(counts), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)), pa.array(same)],
                    [*kept, "n_tokens", "ids", "round_trip"],
                )
                at += len(texts)

    return docs.select(*kept, text).mapInArrow(run, schema)
