"""SentencePiece encoding and decoding (merge type, with bytes for unknown characters).

A merge tokenizer joins, again and again, the two neighbours whose joint piece has the best score,
leftmost first. What it does within a part of a text doesn't depend on what stands beside it, as
long as no merge crosses the part's borders. Hence a row of pieces is the encoding of a text just
if each piece alone comes out whole and no merge crosses the border of any two neighbours; and every
beginning of a text has one such row at most. So a text is encoded by backtracking, without merging it:

1. An Aho-Corasick automaton over all pieces gives the longest piece at each place in one pass.
2. At a place the longest piece is taken that is compatible with the piece before it, which merging
   the characters of the two again shows (answers are kept), and whose end isn't known to fail.
3. Where no piece goes on, the place is marked in a bitfield of failed positions (its row of pieces
   is the only one that reaches it), and the piece before it gives way to a shorter one.

Words repeat, so texts are cut first where the vocabulary has no piece across (every byte pair that
stands inside a piece is a table of 65,536 flags), and the cut-outs are looked up in arrays of
a fixed size, all of some texts at once; those that aren't there are encoded as above. A text
without such places is one cut-out, whatever its length.

Nulls and ties: a null or empty text has no ids and decodes to an empty text; equal scores are taken
leftmost first, as the library does; repeated rows come out as often as they stand there; an empty
table gives an empty result. Other columns pass through; a column named like a new one is replaced.
Memory: a few arrays of a batch's bytes, tables of fixed size in each worker, and four bytes for each
character of the longest cut-out.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from . import textbytes as tb
from .common import columns_of, read_documents

MODEL = "piece_bpe_32k.model"
#: The mark that stands for a space in pieces.
SPACE = "▁"
#: The table of known cut-outs: slots, bytes of a cut-out, ids of one.
SLOTS, WORD_BYTES, WORD_IDS = 1 << 20, 23, 9
#: Most answers about two pieces that a worker keeps.
MAX_PAIRS = 1 << 19


class Pieces:
    """The vocabulary of a model, and decoding by it."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(MODEL)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.of_byte = [0] * 256
        for i in ids:
            if model.is_byte(i):
                self.of_byte[int(model.id_to_piece(i)[1:-1], 16)] = i  # <0x0A>
        if sum(map(model.is_byte, ids)) != 256:
            raise ValueError("the model has no bytes for unknown characters")
        if any(map(model.is_unused, ids)) or model.normalize(" ﬁ  á ") != f"{SPACE}{SPACE}ﬁ{SPACE}{SPACE}á{SPACE}":
            raise ValueError("only models without unused pieces, that change nothing but spaces and add one before a text, are read")
        apart = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in ids]
        self.texts = ["" if a else model.id_to_piece(i) for i, a in zip(ids, apart, strict=True)]
        self.number = {t: i for i, t in enumerate(self.texts) if t}
        self.score = [model.get_score(i) for i in ids]
        out = [bytes([self.of_byte.index(i)]) if model.is_byte(i) else b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else _bytes(self.texts[i]) for i in ids]
        self.out_bytes = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.out_ends = np.cumsum([len(o) for o in out])
        self.out_sizes = np.array([len(o) for o in out])

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of rows of ids: their pieces' bytes, without the space that encoding adds."""
        sizes = self.out_sizes[ids]
        ends = np.cumsum(sizes)
        whole = self.out_bytes[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - self.out_ends[ids], sizes)].tobytes()
        at = np.concatenate(([0], ends))[bounds].tolist()
        out = []
        for a, b, first in zip(at[:-1], at[1:], bounds[:-1].tolist(), strict=True):
            text = whole[a:b]
            spaced = a < b and text[:1] == b" " and self.texts[ids[first]][:1] == SPACE
            out.append((text[1:] if spaced else text).decode("utf-8", "replace"))
        return out


class Encoder(Pieces):
    """Encoding by the vocabulary of a model."""

    def __init__(self, path: str | None = None):
        import ahocorasick

        super().__init__(path)
        self.size = len(self.texts)
        # a character that stands in pieces, but is none, can be merged and has an id of its own kind
        characters = sorted(set().union(*self.number))
        for c in characters:
            if c not in self.number:
                self.number[c] = len(self.texts)
                self.texts.append(c)
                self.score.append(float("-inf"))
        self.lengths = array("i", map(len, self.texts))
        self.foreign = re.compile("([^" + "".join(map(re.escape, characters)) + "])") if characters else re.compile("(.)", re.DOTALL)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.number.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = array("i", (self._prefix(t) for t in self.texts))
        self.pairs: dict[int, bool] = {}

        self.joins = np.zeros((256, 256), dtype=bool)
        for t in self.number:
            for a, b in zip(t, t[1:], strict=False):
                self.joins[_bytes(a)[-1], _bytes(b)[0]] = True
        self.starts_character = tb.CHARACTER
        self.keys = np.zeros((SLOTS, 3), dtype=np.uint64)
        self.known = np.zeros((SLOTS, WORD_IDS), dtype=np.int32)
        self.n_ids = np.zeros(SLOTS, dtype=np.uint8)

    def _prefix(self, text: str) -> int:
        """The longest piece that is a beginning of another one."""
        return next((self.number[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.number), -1)

    def _merge(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` (or ``right`` alone, where ``left`` is empty), merged from their characters, end as these two."""
        text, border = left + right, len(left)
        n = len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-self.score[i], k, k + 1, k + 2) for k in range(n - 1) if (i := self.number.get(text[k : k + 2])) is not None]
        heapify(heap)
        alive = [True] * n
        while heap:
            _, a, b, end = heappop(heap)
            if not (alive[a] and b < n and alive[b] and after[a] == b and after[b] == end):
                continue
            if a < border < end:
                return False
            alive[b] = False
            after[a] = end
            if end < n:
                before[end] = a
                if (i := self.number.get(text[a : after[end]])) is not None:
                    heappush(heap, (-self.score[i], a, end, after[end]))
            if a and (i := self.number.get(text[before[a] : end])) is not None:
                heappush(heap, (-self.score[i], before[a], a, end))
        return sum(alive) == (2 if border else 1)

    def _goes(self, before: int, piece: int) -> bool:
        """Whether a piece can stand after another one (-1: at the start); the answer is kept."""
        goes = self._merge("" if before < 0 else self.texts[before], self.texts[piece])
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[before << 32 | piece] = goes
        return goes

    def _walk(self, text: str) -> list[int]:
        """Ids of a text whose characters all stand in pieces."""
        n, lengths, shorter, pairs = len(text), self.lengths, self.shorter, self.pairs
        longest = array("i", bytes(4 * (n + 1)))
        for end, i in self.automaton.iter(text):
            longest[end + 1 - lengths[i]] = i
        failed = bytearray(n // 8 + 1)
        path: list[int] = []
        at, piece, before = 0, longest[0], -1
        while at < n:
            while piece >= 0:
                end = at + lengths[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    goes = pairs.get(before << 32 | piece)
                    if self._goes(before, piece) if goes is None else goes:
                        break
                piece = shorter[piece]
            if piece >= 0:
                path.append(piece)
                at, before, piece = end, piece, longest[end]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                gone = path.pop()
                at, before, piece = at - lengths[gone], path[-1] if path else -1, shorter[gone]
        return path

    def encode(self, text: str) -> list[int]:
        """Ids of a part of a text (spaces are marks, no space is added before it)."""
        out: list[int] = []
        for k, part in enumerate(self.foreign.split(text)):
            if k % 2:
                out += [self.of_byte[b] for b in _bytes(part)]
            elif part:
                for i in self._walk(part):
                    out += [i] if i < self.size else [self.of_byte[b] for b in _bytes(self.texts[i])]
        return out

    def _cut(self, joined: tb.Joined) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the cut-outs: no piece stands across a cut."""
        data = joined.bytes
        cut = np.ones(len(data), dtype=bool)
        cut[1:] = self.starts_character[data[1:]] & ~self.joins[data[:-1], data[1:]]
        cut[joined.starts] = True
        cut[joined.ends] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        between = np.zeros(len(data), dtype=bool)
        between[joined.ends] = True
        inside = ~between[starts]
        return starts[inside], ends[inside]

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts in UTF-8, one after the other, and where each text's begin (and the end)."""
        joined = tb.Joined([b" " + t.replace(_bytes(SPACE, False), b" ") if t else b"" for t in texts])
        data = joined.bytes
        starts, ends = self._cut(joined)
        key, slot = self._slots(data, starts, ends)
        hit = (self.keys[slot] == key).all(axis=1)
        n = self.n_ids[slot].astype(np.int64)
        missed = np.flatnonzero(~hit)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)]
        first = dict(zip(reversed(words), reversed(missed.tolist()), strict=True))
        new = {w: array("i", self.encode(w.decode("utf-8", "replace").replace(" ", SPACE))).tobytes() for w in first}
        n[missed] = [len(new[w]) // 4 for w in words]

        short = np.arange(WORD_IDS)
        out = np.empty(int(n.sum()), dtype=np.int32)
        of_hit = np.repeat(hit, n)
        out[of_hit] = self.known[slot[hit]][short < n[hit, None]]
        out[~of_hit] = np.frombuffer(b"".join([new[w] for w in words]), dtype=np.int32)
        kept = np.array([i for w, i in first.items() if len(w) <= WORD_BYTES and len(new[w]) <= 4 * WORD_IDS], dtype=np.int64)
        kept = kept[np.unique(slot[kept], return_index=True)[1]]
        if len(kept):
            at = (np.cumsum(n) - n)[kept]
            self.known[slot[kept]] = out[np.minimum(at[:, None] + short, len(out) - 1)]
            self.keys[slot[kept]], self.n_ids[slot[kept]] = key[kept], n[kept]
        bounds = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(starts, joined.starts)]
        return out, np.append(bounds, len(out))

    def _slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key (bytes, then their number) and slot of each cut-out."""
        size = np.minimum(ends - starts, WORD_BYTES + 1)
        key = np.zeros((len(starts), WORD_BYTES + 1), dtype=np.uint8)
        padded = np.concatenate((data, np.zeros(WORD_BYTES, dtype=np.uint8)))
        key[:, :WORD_BYTES] = np.lib.stride_tricks.sliding_window_view(padded, WORD_BYTES)[starts]
        key[:, :WORD_BYTES] *= np.arange(WORD_BYTES) < size[:, None]
        key[:, WORD_BYTES] = size
        key = key.view(np.uint64)
        return key, (tb.mixed(key[:, 0] ^ tb.mixed(key[:, 1] ^ tb.mixed(key[:, 2]))) & np.uint64(SLOTS - 1)).astype(np.int64)


def _bytes(text: str, mark: bool = True) -> bytes:
    """UTF-8, with the mark for a space as a space."""
    return (text.replace(SPACE, " ") if mark else text).encode("utf-8", "surrogatepass")


@cache
def _pieces(kind: type[Pieces], path: str | None) -> Pieces:
    """One for each Python worker, which serves many tasks."""
    return kind(path)


def _with(df: DataFrame, made: str, run: Callable[[pa.Array], Iterator[tuple[int, int, pa.Array]]], kind: DataType, of: Column) -> DataFrame:
    """``df`` with a column that ``run`` makes of the column ``of``, batch by batch."""
    kept = [c for c, name in zip(columns_of(df), df.columns, strict=True) if name.lower() != made.lower()]
    given = df.select(*kept, of.alias(made))
    schema = StructType([*given.schema.fields[:-1], StructField(made, kind)])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            last = batch.num_columns - 1
            for a, b, column in run(batch.column(last)):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(last)), column], names=batch.schema.names)

    return given.mapInArrow(batches, schema)


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``df`` with ``ids_col``, the ids (array of int) of each text; without begin and end ids, no sampling."""

    def run(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
        encoder, given = _pieces(Encoder, model), texts.to_pylist()
        for a, b in tb.pieces(given):
            ids, bounds = encoder.ids(given[a:b])
            yield a, b, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return _with(df, ids_col, run, ArrayType(IntegerType()), text)


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``df`` with ``text_col``, the text of each row of ids (null: empty)."""

    def run(rows: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
        pieces, size = _pieces(Pieces, model), np.diff(rows.offsets.to_numpy())
        total = np.concatenate(([0], np.cumsum(size)))
        start = 0
        while start < len(rows):
            end = max(start + 1, int(np.searchsorted(total, total[start] + tb.PIECE // 4, side="right")) - 1)
            part = rows.slice(start, end - start)
            ids = part.flatten().to_numpy(zero_copy_only=False)
            yield start, end, pa.array(pieces.decoded(ids, total[start : end + 1] - total[start]), pa.string())
            start = end

    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    return _with(df, text_col, run, StringType(), ids)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(read_documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    told = ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"))
    text = decode(told, text_col="decoded").drop("ids")
    return text.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
