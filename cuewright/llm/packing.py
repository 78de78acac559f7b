"""Packing of tokenized documents by a grouping genetic algorithm on islands.

1. Texts become token ids (a public tokenizer's file, its path is a parameter) and an end id;
   only documents over CAPACITY are cut, into whole pieces and a rest. Pieces are written with
   an id of their own. Whole pieces are sequences already.
2. The others are dealt by hash into blocks of about BLOCK pieces, one array row a block.
3. Every block evolves on ISLANDS islands, each a row of its own that any task can take: a
   genome is a grouping of the block's pieces into bins. Crossover injects the well-filled bins
   of one parent whole, removes the other parent's bins that hold a duplicate, lets bins exchange
   a member for a displaced piece that fills them better, and best-fits the rest. After an epoch
   every island's elite migrates to the next one (a written table and a join on block and
   island). A block one of whose groupings meets its lower bound is solved.
4. Bins under WELL_FILLED of the best island's grouping are opened again, and their pieces go
   round once more in other and fewer blocks, until one block held them all or another round
   takes as many bins as the one before.

Nulls and ties: a null or empty text is one end id; repeated rows are packed each by itself;
pieces of equal length stand in the order of their ids; an empty table gives an empty result.
Extra columns are not read. Memory: a block, and a table of words of a fixed size in each worker.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import read_documents, saved, unused

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
BLOCK = 3500
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 5, 4
WELL_FILLED = 0.99
#: The table of known words, of the same size in every worker: slots, bytes of a word, ids of a word.
SLOTS, WORD_BYTES, WORD_IDS = 1 << 20, 23, 6

_MARKS = tb.byte_class(*b".,:;!?#*$%&|")
_LETTERS = tb.byte_class(range(0x61, 0x7B))


class _Tokens:
    """Token ids of texts as little-endian bytes, by way of their words.

    No token of this kind of tokenizer spans white space, it lowers letters itself, and a run of
    marks after a letter is a token of its own; so a text's ids are those of its words, A-Z
    lowered. A text that might hold a special token is encoded as it is.

    Words are looked up in arrays of SLOTS rows, all words of some texts at once. A slot holds one
    word (its bytes and length, compared whole) and its ids, and the latest word to fall on it; so
    memory is the same however many words a corpus has. Words that are longer, or have more ids,
    are encoded each time.
    """

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        most = max(vocabulary.values())
        self.ends_word = np.zeros(most + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.keys = np.zeros((SLOTS, 3), dtype=np.uint64)
        self.known = np.zeros((SLOTS, WORD_IDS), dtype=np.uint16 if most < 1 << 16 else np.uint32)
        self.n_ids = np.zeros(SLOTS, dtype=np.uint8)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words. Those of letters alone are encoded as one text and cut after each token that ends a word."""
        plain, other = [], []
        for w in words:
            (plain if w.isalpha() or _letters(w) else other).append(w)
        out = dict(zip(other, self._encode([_string(w) for w in other]), strict=True))
        if plain:
            ids = np.array(self.tokenizer.encode(" ".join(map(_string, plain)), add_special_tokens=False).ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) == len(plain):
                whole = ids.tobytes()
                out |= {w: whole[a:b] for w, a, b in zip(plain, [0, *ends[:-1]], ends, strict=True)}
            else:
                out |= dict(zip(plain, self._encode([_string(w) for w in plain]), strict=True))
        return out

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words with the marks that end them, after a letter, cut off as words of their own."""
        at = np.where(_MARKS[data], 0, np.arange(1, len(data) + 1))
        cut = np.maximum.accumulate(at)[ends - 1]
        cut = cut[(cut > starts) & (cut < ends) & _LETTERS[data[cut - 1]]]
        return np.sort(np.concatenate((starts, cut)), kind="stable"), np.sort(np.concatenate((ends, cut)), kind="stable")

    def _lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key (bytes, then length) and slot of each word."""
        size = np.minimum(ends - starts, WORD_BYTES + 1)
        key = np.zeros((len(starts), WORD_BYTES + 1), dtype=np.uint8)
        padded = np.concatenate((data, np.zeros(WORD_BYTES, dtype=np.uint8)))
        key[:, :WORD_BYTES] = np.lib.stride_tricks.sliding_window_view(padded, WORD_BYTES)[starts]
        key[:, :WORD_BYTES] *= np.arange(WORD_BYTES) < size[:, None]
        key[:, WORD_BYTES] = size
        key = key.view(np.uint64)
        return key, (tb.mixed(key[:, 0] ^ tb.mixed(key[:, 1] ^ tb.mixed(key[:, 2]))) & np.uint64(SLOTS - 1)).astype(np.int64)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Of texts in UTF-8 that together aren't long (a longer one stands alone)."""
        whole = [b"<|" in t for t in texts]
        joined = tb.Joined([b"" if w else t for t, w in zip(texts, whole, strict=True)])
        data = tb.LOWER[joined.bytes]
        starts, ends = self._words(data, *joined.runs(tb.NOT_BLANK)[:2])
        key, slot = self._lookup(data, starts, ends)
        hit = (self.keys[slot] == key).all(axis=1)
        n = self.n_ids[slot].astype(np.int64)
        missed = np.flatnonzero(~hit)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)]
        first = dict(zip(reversed(words), reversed(missed.tolist()), strict=True))
        new = self._encode_words(list(first))
        n[missed] = [len(new[w]) // 4 for w in words]

        short = np.arange(WORD_IDS)
        out = np.empty(int(n.sum()), dtype="<u4")
        of_hit = np.repeat(hit, n)
        out[of_hit] = self.known[slot[hit]][short < n[hit, None]]
        out[~of_hit] = np.frombuffer(b"".join([new[w] for w in words]), dtype="<u4")

        kept = np.array([i for w, i in first.items() if len(w) <= WORD_BYTES and len(new[w]) <= 4 * WORD_IDS], dtype=np.int64)
        kept = kept[np.unique(slot[kept], return_index=True)[1]]
        at = (np.cumsum(n) - n)[kept]
        self.known[slot[kept]] = out[np.minimum(at[:, None] + short, max(0, len(out) - 1))] if len(out) else 0
        self.keys[slot[kept]], self.n_ids[slot[kept]] = key[kept], n[kept]

        bounds = 4 * np.concatenate(([0], np.cumsum(n)))[np.searchsorted(starts, joined.starts)]
        told = out.tobytes()
        parts = zip(bounds.tolist(), [*bounds[1:].tolist(), len(told)], strict=True)
        return [self._encode([_string(t)])[0] if w else told[a:b] for t, w, (a, b) in zip(texts, whole, parts, strict=True)]


def _string(text: bytes) -> str:
    return text.decode("utf-8", "replace")


def _letters(word: bytes) -> bool:
    """Whether a word with letters beyond ASCII stays one run of letters when it is normalized and lowered."""
    w = _string(word)
    return w.isalpha() and unicodedata.is_normalized("NFC", w) and w.lower().isalpha()


_loaded: dict[str | None, _Tokens] = {}


def _tokens(path: str | None) -> _Tokens:
    """One for each Python worker, which serves many tasks."""
    if path not in _loaded:
        _loaded[path] = _Tokens(path)
    return _loaded[path]


def tokenized(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece."""

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in tb.pieces(texts):
                out: list[list] = [[] for _ in names]
                for doc, ids in zip(docs[a:b], tokens.ids(texts[a:b]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        row = (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, dtype="<u4").astype(np.int32) if with_ids else None)
                        for column, value in zip(out, row, strict=False):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    # bytes: words are cut and looked up without a string being made of them
    rows = df.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    pieces = rows.mapInArrow(run, "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return pieces.withColumn("doc_id", F.col("doc_id").cast(df.schema[id_col].dataType))


# A genome is a list of bins, a bin a list of numbers of pieces.


def _filled(bins: list[list[int]], sizes: list[int]) -> list[int]:
    return [sum([sizes[i] for i in b]) for b in bins]


def _best_fit(bins: list[list[int]], items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Items, in order, each into the fullest bin that takes it, else into a new one."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for b, filled in enumerate(_filled(bins, sizes)):
        room[capacity - filled].append(b)
        open_ |= 1 << (capacity - filled)
    for i in items:
        need = sizes[i]
        fits = open_ >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_ ^= 1 << left
            bins[b].append(i)
        else:
            b, left = len(bins), capacity
            bins.append([i])
        left -= need
        room[left].append(b)
        open_ |= 1 << left
    return bins


def _exchanged(bins: list[list[int]], displaced: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Bins that aren't full give a member for the displaced piece that fills them best; the
    pieces that are displaced then, longest first."""
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    lengths = 0
    for i in displaced:
        held[sizes[i]].append(i)
        lengths |= 1 << sizes[i]
    for b, filled in zip(bins, _filled(bins, sizes), strict=True):
        slack = capacity - filled
        best = at = 0
        for k, i in enumerate(b if slack else ()):
            gain = (lengths & ((2 << (sizes[i] + slack)) - 1)).bit_length() - 1 - sizes[i]
            if gain > best:
                best, at = gain, k
        if best:
            out = b[at]
            wanted = sizes[out] + best
            b[at] = held[wanted].pop()
            if not held[wanted]:
                lengths ^= 1 << wanted
            held[sizes[out]].append(out)
            lengths |= 1 << sizes[out]
    return [i for some in reversed(held) for i in some]


def _cross(one: list[list[int]], other: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Well-filled bins of ``other`` whole, the bins of ``one`` without a duplicate but for a few
    opened ones, and the displaced pieces exchanged and best-fitted."""
    fill = np.array(_filled(other, sizes))
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    stay = [list(other[b]) for b in good[rng.random(len(good)) < 0.5].tolist()]
    taken = {i for b in stay for i in b}
    fill = np.array(_filled(one, sizes))
    opened = (rng.random(len(one)) < 0.05) | (fill < np.quantile(fill, 0.05))
    displaced = []
    for b, open_ in zip(one, opened.tolist(), strict=True):
        if not open_ and taken.isdisjoint(b):
            stay.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    rest = _exchanged(stay, displaced, sizes, capacity)
    return _best_fit(stay, rest, sizes, capacity)


def _fitness(genome: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller full ones (mean square of the filling)."""
    return -len(genome), sum([f * f for f in _filled(genome, sizes)]) / (capacity * capacity * max(1, len(genome)))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any grouping takes at least: for each k, pieces over capacity - k stand without
    those of k and more, and what the pieces between leave open takes no more than it holds; for
    each of a few k, no bin takes more than k pieces over a (k + 1)th of it (a piece counts as the
    whole kths below its share, or as its share where that is a whole number of (k + 1)ths)."""
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    count, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    k = np.arange(1, capacity // 2 + 1)
    alone = count[-1] - count[capacity - k]
    half = count[capacity - k] - count[capacity // 2]
    room = half * capacity - (total[capacity - k] - total[capacity // 2])
    small = total[capacity // 2] - total[k - 1]
    most = int((alone + half + np.maximum(0, -((room - small) // capacity))).max(initial=0))
    most = max(most, -(-int(lengths.sum()) // capacity))
    for k in range(2, 17):
        times = (k + 1) * lengths.astype(np.int64)
        even = times % capacity == 0
        kths, whole = int((times[~even] // capacity).sum()), int(lengths[even].sum())
        most = max(most, -(-(kths * capacity + whole * k) // (k * capacity)))
    return most


def evolve(lengths: np.ndarray, capacity: int, seed: int, guests: list[list[list[int]]], generations: int = GENERATIONS, population: int = POPULATION) -> tuple[list[list[int]], bool]:
    """The best grouping of one island after some generations, and whether it meets the lower bound.

    The first people are best fits of the pieces from long to short, by lengths with noise (one
    by the lengths themselves). A generation replaces the worse half by children."""
    rng = np.random.default_rng(seed)
    bound = lower_bound(lengths, capacity)
    sizes = lengths.tolist()
    people = list(guests)
    while len(people) < max(2, population):
        noise = rng.normal(1, 0.03, len(lengths)) if people else np.ones(len(lengths))
        people.append(_best_fit([], np.argsort(-lengths * noise, kind="stable").tolist(), sizes, capacity))
    ranked = [(_fitness(g, sizes, capacity), g) for g in people]
    for _ in range(generations):
        for _ in range(population):
            a, b = rng.permutation(len(ranked))[:2]
            child = _cross(ranked[a][1], ranked[b][1], sizes, capacity, rng)
            ranked.append((_fitness(child, sizes, capacity), child))
            if len(child) == bound:
                return child, True
        ranked = sorted(ranked, key=lambda r: r[0], reverse=True)[:population]
    return ranked[0][1], len(ranked[0][1]) == bound


def _bins(assigned: np.ndarray) -> list[list[int]]:
    order = np.argsort(assigned, kind="stable")
    return [list(map(int, g)) for g in np.split(order, np.flatnonzero(np.diff(assigned[order])) + 1)] if len(order) else []


def _epoch(epoch: int, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                lengths = np.asarray(r.lengths, dtype=np.int64)
                if r.solved:
                    yield pd.DataFrame([(r.block, r.island, True, r.n_bins, np.asarray(r.bins, dtype=np.int32))], columns=["block", "island", "solved", "n_bins", "bins"])
                    continue
                guests = [_bins(np.asarray(x)) for x in (r.bins, r.guest) if x is not None]
                best, solved = evolve(lengths, capacity, (int(r.block) * EPOCHS + epoch) * ISLANDS + int(r.island), guests)
                bins = np.empty(len(lengths), dtype=np.int32)
                for b, members in enumerate(best):
                    bins[members] = b
                yield pd.DataFrame([(r.block, r.island, solved, len(best), bins)], columns=["block", "island", "solved", "n_bins", "bins"])

    return run


def _evolved(blocks: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """block and the grouping (bins, by position) of its best island."""
    state = blocks.select("block", "lengths", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    state = state.select("block", "island", "lengths", F.lit(False).alias("solved"), F.lit(0).cast("long").alias("n_bins"), *(F.lit(None).cast("array<int>").alias(c) for c in ("bins", "guest")))
    for epoch in range(EPOCHS):
        spread = state.repartition(tasks, "block", "island")  # few heavy rows a task
        elite = saved(spread.mapInPandas(_epoch(epoch, capacity), "block long, island int, solved boolean, n_bins long, bins array<int>"), "elites")
        if epoch + 1 < EPOCHS:
            done = elite.groupBy("block").agg(F.max("solved").alias("done"))
            migrant = elite.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("bins").alias("guest"))
            state = elite.join(migrant, ["block", "island"]).join(done, "block").join(blocks.select("block", "lengths"), "block")
            state = state.select("block", "island", "lengths", F.col("done").alias("solved"), F.when(F.col("done") & ~F.col("solved"), F.lit(1 << 40)).otherwise(F.col("n_bins")).alias("n_bins"), "bins", "guest")
    return elite.groupBy("block").agg(F.min_by("bins", F.struct("n_bins", "island")).alias("bins"))


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            lengths, bins = np.asarray(r.lengths, dtype=np.int64), np.asarray(r.bins, dtype=np.int64)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(lengths[order])
            first = np.concatenate(([True], np.diff(bins[order]) > 0))
            offset = np.empty(len(bins), dtype=np.int64)
            offset[order] = ends - lengths[order] - np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
            yield pd.DataFrame({"piece_id": np.asarray(r.ids), "length": lengths, "block": r.block, "bin": bins, "offset": offset, "filled": np.bincount(bins, lengths).astype(np.int64)[bins]})


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any table with a column length of 1 to capacity), with sequence_id and offset
    in place of columns of these names."""
    pieces = pieces.drop("sequence_id", "offset")
    key = unused(pieces, "piece_id")
    pieces = saved(pieces.withColumn(key, F.monotonically_increasing_id()), "pieces")
    numbered = pieces.select(F.col(key).alias("piece_id"), "length")
    shown = ("piece_id", "sequence_id", "offset")
    left = numbered.where(F.col("length") < capacity)
    parts = [numbered.where(F.col("length") == capacity).select("piece_id", (F.col("piece_id") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    at, n, before, kept = 0, left.count(), None, None
    while n:
        n_blocks = -(-n // BLOCK)
        dealt = left.groupBy(F.pmod(F.xxhash64("piece_id", F.lit(at)), F.lit(n_blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("piece_id", "length"))).alias("s"))
        blocks = saved(dealt.select("block", F.col("s.piece_id").alias("ids"), F.col("s.length").alias("lengths")), "blocks")
        found = blocks.join(_evolved(blocks, capacity, max(1, n_blocks * ISLANDS // 8)), "block").mapInPandas(_placed, "piece_id long, length long, block long, bin long, offset long, filled long")
        number = (F.lit(at).cast("long") * (1 << 32) + F.col("block")) * (1 << 14) + F.col("bin")
        found = saved(found.select("piece_id", "length", (number * 2).alias("sequence_id"), "offset", "filled"), "placed")
        again = (F.col("filled") < WELL_FILLED * capacity) if n_blocks > 1 else F.lit(False)
        first = (F.col("offset") == 0).cast("long")
        told = found.agg(F.sum(first).alias("bins"), F.sum(first * again.cast("long")).alias("open"), F.count_if(again).alias("left")).first()
        if before is not None and told["bins"] >= before:  # dealt anew, the pieces take no fewer bins: they stay as they were
            parts.append(kept)
            break
        parts.append(found.where(~again).select(*shown))
        kept, before = found.where(again).select(*shown), told["open"]
        left, at, n = found.where(again).select("piece_id", "length"), at + 1, told["left"]
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.union(p)
    return pieces.join(placed.withColumnRenamed("piece_id", key), key).drop(key)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenized(read_documents(spark, sf_dir)))
