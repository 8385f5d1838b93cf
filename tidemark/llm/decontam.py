"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared in a plain form: lower-cased, every run
of characters that are neither letters nor digits one space.  An item longer
than ``PIECE`` characters is looked for by every piece of that length, wherever it
starts; a document holds a piece if some stretch of it is within ``budget(m)``
edits, m being the piece's length.

* *Lemma.*  k edits destroy at most k * Q of a piece's n q-grams, so a match shares
  at least ``n - k * Q`` with the document, on diagonals (text place minus item
  place) that drift by at most k.
* *Count.*  Shared q-grams are counted in bands of 2 (k + 1) diagonals, each
  half over the next: any k + 1 neighbouring diagonals lie in one band whole.
  An item's q-grams are posted once for all its pieces: counted first for a cell
  of neighbouring pieces, then, in the cells that reach the lemma's bound, for
  each piece.
* *Short q-grams.*  The lemma holds for any q: of a piece's m - R + 1 grams of R
  characters, all but k * R lie in the band too.  A phrase that many items share meets the
  bound for Q in each of them, but seldom that for R.  What a band of the text holds is
  kept as a bit set per place (it may say yes wrongly, never no), so this costs a look-up
  per place of a cell, for all its pieces at once.
* *Verify.*  The pieces that are left are aligned within their band (and k
  diagonals on either side); a match is within the budget.

The items are taken in blocks of at most ``BLOCK_CHARS`` characters; each
block's index is broadcast, and the documents are read once per block.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, numbered, pick

Q, ERROR, PIECE = 8, 0.1, 120
STEP = PIECE - Q + 1
LANES = 1 << 13
R, R_BITS = 3, 10
BLOCK_CHARS = 4_000_000
CHUNK, GAP = 1 << 18, 64
_TABLE_BITS = 22
_WORDLIKE: list[np.ndarray] = []


def budget(m: int) -> int:
    """Edits allowed for a piece of m characters: a share of it, and few enough for the lemma's bound to be positive."""
    return max(0, min(int(ERROR * m), (m - Q) // Q))


def plain(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text's plain form, and each one's place in the text."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):  # a few letters have longer lower-case forms: those stay
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not _WORDLIKE:
        _WORDLIKE.append(np.array([chr(i).isalnum() for i in range(1 << 16)]))
    word = _WORDLIKE[0][np.minimum(c, 0xFFFF)] | (c > 0xFFFF)
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first other character after a word stands for its run
    at = np.flatnonzero(keep)
    return np.where(word, c, 32)[at].astype(np.uint32), at


def _grams(c: np.ndarray) -> np.ndarray:
    h = np.zeros(max(0, len(c) - Q + 1), np.uint64)
    for j in range(Q):
        h = h * np.uint64(0x9E3779B97F4A7C15 | 1) + c[j:len(c) - Q + 1 + j].astype(np.uint64) + np.uint64(1)
    return h


def _small(c: np.ndarray) -> np.ndarray:
    """The R-gram that begins at each place, hashed to ``R_BITS`` bits."""
    h = np.zeros(max(0, len(c) - R + 1), np.uint32)
    for j in range(R):
        h = h * np.uint32(0x9E3779B1) + c[j:len(c) - R + 1 + j].astype(np.uint32)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - R_BITS)).astype(np.int64)


# Diagonals that an alignment in a band can touch: the band's 2 (k + 1) and k on either side.
WIDE = 4 * int(ERROR * PIECE) + 2


def _windows(c: np.ndarray) -> np.ndarray:
    """For each place p (counted from -WIDE) the R-grams that begin in the ``WIDE`` places
    of the text from p on, as a bit set of words."""
    words = 1 << (R_BITS - 6)
    small = _small(c)
    one = np.zeros((len(c) + 2 * WIDE, words), np.uint64)
    one[np.arange(len(small)) + WIDE, small >> 6] = np.uint64(1) << (small & 63).astype(np.uint64)
    got, size = one, 1
    while size < WIDE:  # the union over twice as many places
        step = min(size, WIDE - size)
        got = got | np.concatenate((got[step:], np.zeros((step, words), np.uint64)))
        size += step
    return got


class Index:
    """The q-grams of a block of items.

    A piece is found by its item and where it starts there.  The starts of an item
    are dealt into cells of ``STEP``; the pieces of a cell lie in 2 ``STEP`` q-grams.
    A q-gram is posted once, with its item's cell at that place; it counts for that cell
    and the one before."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids, self.texts, self.short, self.automaton = [], [], {}, None
        self.names = sorted({item for item, _ in items}, key=lambda x: (x is None, x or 0))
        rank = {item: i for i, item in enumerate(self.names)}
        for item, text in items:
            c, _ = plain(text)
            c = c[: len(c) - (len(c) > 0 and c[-1] == 32)]
            if len(c) >= Q:
                self.ids.append(rank[item])
                self.texts.append(c)
            elif len(c):  # no q-gram: looked for as it is, between blanks
                self.short.setdefault(f" {''.join(map(chr, c))} ", set()).add(rank[item])
        n = np.array([len(c) for c in self.texts], np.int64)
        self.flat, self.offset = np.concatenate([*self.texts, np.zeros(PIECE, np.uint32)]), np.cumsum(n) - n
        self.starts = np.maximum(1, n - PIECE + 1)
        m = np.minimum(n, PIECE)
        k = np.array([budget(x) for x in m.tolist()], np.int64)
        cells = (self.starts - 1) // STEP + 1
        before = np.cumsum(cells) - cells
        self.of = np.repeat(np.arange(len(n)), cells)  # the item of a cell, where its starts begin and how many they are
        self.at = STEP * (np.arange(len(self.of)) - before[self.of])
        self.many = np.minimum(STEP, self.starts[self.of] - self.at)
        self.m, self.budget = m[self.of], k[self.of]
        self.bound = self.m - Q + 1 - self.budget * Q
        self.last = (before + cells - 1)[self.of].astype(np.int32) if len(n) else np.empty(0, np.int32)  # an item's last cell
        self.first = before[self.of].astype(np.int32) if len(n) else np.empty(0, np.int32)
        flat = np.concatenate([*[_grams(c) for c in self.texts], np.empty(0, np.uint64)])
        place = np.concatenate([*[np.arange(x - Q + 1, dtype=np.int32) for x in n.tolist()], np.empty(0, np.int32)])
        cell = np.repeat(before.astype(np.int32), n - Q + 1) + place // np.int32(STEP)  # may lie past the item's last cell, whose pieces still hold the place
        self.spill = np.repeat((before + cells - 1).astype(np.int32), n - Q + 1)
        over, cell = cell > self.spill, np.minimum(cell, self.spill)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(flat)), bool), flat[1:] != flat[:-1])))
        self.gram, self.start, self.count = flat[new], new.astype(np.int32), np.diff(np.append(new, len(flat))).astype(np.int32)
        self.cell, self.place, self.over = cell[order], place[order], over[order]
        del self.spill
        # R-grams of the items by place, as bits; longer items reach over their cells' ends.
        self.small = _small(self.flat)
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        self.seen[self._slot(self.gram)] = True

    @property
    def pieces(self) -> list[np.ndarray]:
        """All that is looked for: whole items of up to ``PIECE`` characters, and every piece of that length of the longer ones."""
        return [c[a:a + PIECE] for c, n in zip(self.texts, self.starts.tolist()) for a in range(n)]

    @property
    def item(self) -> list[int]:
        return [self.names[i] for i, n in zip(self.ids, self.starts.tolist()) for _ in range(n)]

    @property
    def k(self) -> list[int]:
        return [budget(len(p)) for p in self.pieces]

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _TABLE_BITS)

    def regions(self, c: np.ndarray) -> np.ndarray:
        """(cell, band, start) of the pieces that meet the lemma's bound in a stretch of plain text."""
        none = np.empty((0, 3), np.int64)
        if len(c) < Q or not len(self.gram):
            return none
        h = _grams(c)
        at = np.flatnonzero(self.seen[self._slot(h)])
        g = np.searchsorted(self.gram, h[at])
        g = np.minimum(g, len(self.gram) - 1)
        hit = self.gram[g] == h[at]
        at, g = at[hit], g[hit]
        if not len(at):
            return none
        n = self.count[g]
        own = np.repeat(np.arange(len(g)), n)
        post = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + self.start[g][own]
        cell, place, over = self.cell[post].astype(np.int64), self.place[post].astype(np.int64), self.over[post]
        half = (at[own] - place) // (self.budget[cell] + 1)
        # A place counts for its cell and the one before (past the last cell: for that one only).
        more = ~over & (cell > self.first[cell])
        cell, place, half = (np.concatenate((x, y[more])) for x, y in ((cell, cell - 1), (place, place), (half, half)))
        # Bands are numbered by their first half; a q-gram counts for the two bands that hold its diagonal.
        span = len(c) + max(map(len, self.texts)) + 2
        key = cell * 2 * span + half + span
        halves, n = np.unique(key, return_counts=True)
        after = np.minimum(np.searchsorted(halves, halves + 1), len(halves) - 1)
        whole = n + np.where(halves[after] == halves + 1, n[after], 0)
        prior = halves[np.flatnonzero(np.concatenate(([True], halves[1:] != halves[:-1] + 1)))] - 1
        prior_n = n[np.searchsorted(halves, prior + 1)]
        bands, n = np.concatenate((halves, prior)), np.concatenate((whole, prior_n))
        held = np.sort(bands[n >= self.bound[bands // (2 * span)]])
        short = None
        if len(held) > max(64, len(c) // 400):  # worth the bit sets: bands in which no piece may share enough R-grams go
            bits, left, short = _windows(c), [], []
            for a in range(0, len(held), LANES):
                part = held[a:a + LANES]
                fits = self._short_grams(bits, part // (2 * span), part % (2 * span) - span)
                some = fits.any(axis=1)
                left.append(part[some])
                short.append(fits[some])
            held, short = np.concatenate(left), np.concatenate(short)
        if not len(held):
            return none
        # The q-grams of the bands that are left, each for the band of its half and the one before.
        pairs = []
        for k in (key, key - 1):
            lane = np.minimum(np.searchsorted(held, k), len(held) - 1)
            some = held[lane] == k
            pairs.append((lane[some], place[some]))
        lanes, place = (np.concatenate(x) for x in zip(*pairs))
        order = np.argsort(lanes, kind="stable")
        lanes, place = lanes[order], place[order]
        out = []
        for a in range(0, len(held), LANES):  # a frequent q-gram counts once
            part = held[a:a + LANES]
            x, y = np.searchsorted(lanes, (a, a + len(part)))
            cell, band = part // (2 * span), part % (2 * span) - span
            there = np.zeros((len(part), 2 * STEP + 1), np.int16)
            there[lanes[x:y] - a, place[x:y] - self.at[cell][lanes[x:y] - a] + 1] = 1
            there = np.cumsum(there, axis=1, dtype=np.int16)
            n = there[:, STEP:2 * STEP] - there[:, :STEP]  # different q-grams of the piece that starts at each place
            fits = (n >= self.bound[cell][:, None]) & (np.arange(STEP) < self.many[cell][:, None])
            if short is not None:
                fits &= short[a:a + LANES]
            r, start = np.nonzero(fits)
            out.append(np.stack((cell[r], band[r], self.at[cell[r]] + start), axis=1))
        return np.concatenate(out)

    def _short_grams(self, bits: np.ndarray, cell: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether the piece that starts at each place of a cell may share enough R-grams with its band."""
        k, m = self.budget[cell], self.m[cell]
        # Cells of one item lie side by side, and a band's text begins where the place is less the band's lowest diagonal.
        places = np.arange(min(STEP + PIECE, int((self.many[cell] + m).max())) - R)
        item = self.offset[self.of[cell]] + self.at[cell]
        gram = self.small[np.minimum(item[:, None] + places, len(self.small) - 1)]
        text = np.clip(band * (k + 1) - k + self.at[cell] + WIDE, -len(places), len(bits))[:, None] + places + len(places)
        word = np.concatenate((np.zeros((len(places), bits.shape[1]), np.uint64), bits, np.zeros((len(places), bits.shape[1]), np.uint64))).ravel()
        near = (word[text * bits.shape[1] + (gram >> 6)] >> (gram & 63).view(np.uint64)) & np.uint64(1)
        near = np.concatenate((np.zeros((len(cell), 1), np.int16), np.cumsum(near, axis=1, dtype=np.int16)), axis=1)
        begins = np.minimum(np.arange(STEP), near.shape[1] - 1)
        ends = np.minimum(np.arange(STEP) + (m - R + 1)[:, None], near.shape[1] - 1)
        n = np.take_along_axis(near, ends, axis=1) - near[:, begins]
        return n >= (m - R + 1 - R * k)[:, None]

    def align(self, c: np.ndarray, regions: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item's number, distance, start, end) of the best stretch of c along each band
        that is within its piece's budget.  Bands advance together, a character of
        their pieces at a time; those beyond their budget fall out."""
        out: list[tuple[int, int, int, int]] = []
        regions = regions[np.argsort(-self.m[regions[:, 0]], kind="stable")]
        for a in range(0, len(regions), LANES):
            out += self._aligned(c, regions[a:a + LANES])
        return out

    def _aligned(self, c: np.ndarray, regions: np.ndarray) -> list[tuple[int, int, int, int]]:
        cell, band, start = regions.T
        m, k, letters = self.m[cell], self.budget[cell], self.offset[self.of[cell]] + start
        most = int(k.max())
        width = 4 * most + 2
        # Diagonal x of a band holds text that starts lo + x after the piece does.
        lo = band * (k + 1) + start - most
        padded = np.concatenate((np.zeros(PIECE + width, np.uint32), c, np.zeros(2 * PIECE + 2 * width, np.uint32)))
        ramp, got = np.arange(width + 1, dtype=np.int16), []
        d, left = np.zeros((len(cell), width + 1), np.int16), np.arange(len(cell))
        for i in range(int(m[0]) + 1):
            ended = m[left] == i
            if ended.any():
                r, best = left[ended], d[ended].min(axis=1)
                near = best <= k[r]
                got.append(np.stack((r, best, lo[r] + d[ended].argmin(axis=1) + i), axis=1)[near])
            on = ~ended & (d.min(axis=1) <= k[left])
            if not on.all():
                left, d = left[on], d[on]
            if not len(left):
                break
            at = np.clip(lo[left] + i + PIECE + width, 0, len(padded) - width)
            text = padded[at[:, None] + ramp[:width]]
            new = d + np.int16(1)
            new[:, :width] = np.minimum(d[:, :width] + (text != self.flat[letters[left] + i][:, None]), d[:, 1:] + np.int16(1))
            d = np.minimum.accumulate(new - ramp, axis=1) + ramp
        if not got:
            return []
        r, best, end = np.concatenate(got).T
        _, one = np.unique(np.stack((letters[r], end)), axis=1, return_index=True)  # found in both bands
        r, best, end = r[one], best[one], end[one]
        begin = end - m[r]
        edited = best > 0
        begin[edited] = self._starts(c, letters[r[edited]], m[r[edited]], end[edited])
        return list(zip(self.of[cell[r]].tolist(), best.tolist(), np.maximum(0, begin).tolist(), end.tolist()))

    def _starts(self, c: np.ndarray, letters: np.ndarray, m: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the best stretches that end at ``end`` begin: the alignments read backwards."""
        long = PIECE + budget(PIECE)
        padded = np.concatenate((np.zeros(long, np.uint32), c, np.zeros(long, np.uint32)))  # no piece holds a zero
        text = padded[np.clip(end[:, None] - 1 - np.arange(long) + long, 0, len(padded) - 1)]
        ramp = np.arange(long + 1, dtype=np.int16)
        d, out = np.tile(ramp, (len(m), 1)), end.copy()
        for i in range(int(m.max(initial=0))):
            new = d + np.int16(1)
            letter = self.flat[np.maximum(letters + m - 1 - i, 0)]
            new[:, 1:] = np.minimum(new[:, 1:], d[:, :-1] + (text != letter[:, None]))
            d = np.minimum.accumulate(new - ramp, axis=1) + ramp
            if (ended := m == i + 1).any():
                out[ended] -= d[ended].argmin(axis=1)
        return out

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its matches (item, start, end, distance), places in the text itself;
        matches of an item that touch are one, with the smallest of their distances."""
        found: list[list] = [[] for _ in texts]
        forms: list[tuple[int, np.ndarray, np.ndarray]] = []
        held = 0
        for t, text in enumerate(texts):
            c, at = plain(text)
            if self.short:
                found[t] += self._short_items(c, at)
            forms.append((t, c, at))
            held += len(c) + GAP
            if held >= CHUNK:
                self._chunk(forms, found)
                forms, held = [], 0
        self._chunk(forms, found)
        return [[(self.names[i], *rest) for i, *rest in _joined(x)] for x in found]

    def _short_items(self, c: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        if self.automaton is None:  # made where it is used
            self.automaton = ahocorasick.Automaton()
            for text in self.short:
                self.automaton.add_word(text, text)
            self.automaton.make_automaton()
        for end, text in self.automaton.iter(f" {''.join(map(chr, c))} "):
            s, e = end - len(text) + 1, end - 1  # the text's own places, its blanks left out
            for i in self.short[text]:
                yield i, int(at[s]), int(at[e - 1]) + 1, 0

    def _chunk(self, forms: list, found: list) -> None:
        if not forms:
            return
        # Texts lie side by side, with more blanks between them than any budget can bridge.
        starts = np.cumsum([0] + [len(c) + GAP for _, c, _ in forms])
        whole = np.zeros(starts[-1], np.uint32)
        for s, (_, c, _) in zip(starts.tolist(), forms):
            whole[s:s + len(c)] = c
        for a in range(0, max(1, len(whole)), CHUNK * 4):  # a very long text goes in overlapping stretches
            part = whole[a:a + CHUNK * 4 + 4 * PIECE]
            for item, best, s, e in self.align(part, self.regions(part)):
                s, e = s + a, e + a
                i = int(np.searchsorted(starts, s, side="right")) - 1
                t, c, at = forms[i]
                s, e = s - int(starts[i]), min(e - int(starts[i]), len(c))
                if e > s:
                    found[t].append((self.ids[item], int(at[s]), int(at[e - 1]) + 1, best))


def _joined(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[list[int]] = []
    for item, s, e, d in sorted(matches):
        if out and out[-1][0] == item and s <= out[-1][2]:
            out[-1][2], out[-1][3] = max(out[-1][2], e), min(out[-1][3], d)
        else:
            out.append([item, s, e, d])
    return [tuple(x) for x in out]


def _indexes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """An index for each block of items, a block having about ``BLOCK_CHARS`` characters."""
    items = pick(benchmark, item_col, text_col).select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    items = items.where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = math.ceil(chars / BLOCK_CHARS)
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        yield Index(sorted(((r["item"], r["text"]) for r in block), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text") -> DataFrame:
    """(id, item_id, start, end, distance): every stretch of a document that holds a
    benchmark item or a piece of it; code points of the text, end exclusive.

    Null and empty texts match nothing, and neither do items without a letter or digit.
    Items of fewer than Q characters in plain form are found where they stand as they are,
    between blanks of the plain form; items without an id are found under a null id.
    Repeated rows match alike, each for itself.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    part = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {part.schema['id'].dataType.simpleString()}, item_id long, start long, end long, distance int"
    out = spark.createDataFrame([], schema)
    for index in _indexes(benchmark, item_col, item_text_col):
        handle = spark.sparkContext.broadcast(cloudpickle.dumps(index))

        def run(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(handle.value)
            for b in batches:
                found = index.find(b.column(1).to_pylist())
                rows = [m for x in found for m in x]
                ids = b.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array([m[i] for m in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32())))],
                    names=["id", "item_id", "start", "end", "distance"])
        out = out.unionByName(part.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no benchmark item or piece of
    one, items without an id included.  Decided next to the text, so nothing is shuffled."""
    spark, rows, at = docs.sparkSession, numbered(docs), docs.columns.index(text_col)
    bounded_batches(spark)
    for index in _indexes(benchmark, item_col, item_text_col):
        handle = spark.sparkContext.broadcast(cloudpickle.dumps(index))

        def run(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(handle.value)
            for b in batches:
                yield b.filter(pa.array([not x for x in index.find(b.column(at).to_pylist())], pa.bool_()))
        rows = rows.mapInArrow(run, rows.schema)
    return rows.toDF(*docs.columns)
