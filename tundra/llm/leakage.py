"""Evaluation texts leaking into training text, by an FM-index over each shard of the corpus.

The words of the test passages and questions get numbers (a fixed, small table that is broadcast); every other word is
0, and as no window can hold more than ``CHANGES`` of those, longer runs of them are cut short. Each batch of texts is a
shard: its word numbers are put in a row, its suffixes are sorted, and the Burrows-Wheeler transform of that order
goes into a wavelet matrix. All seed phrases of ``SEED`` words are searched backwards at once through its ranks, their occurrences are located by walking to
sampled suffix positions, and each is checked exactly: a window of ``WINDOW`` words that differ from the test
item's in at most ``CHANGES`` places. As the changes can't touch all of ``CHANGES + 1`` parts of a window, a window of
three times ``SEED`` words always holds an unchanged seed, so nothing is missed. Shards are independent: no shuffle,
any number of texts, and a text is never cut.

Defined results
    null or empty texts match nothing; passages of fewer than ``WINDOW`` words can't leak; the first line of an item (the
    instruction; a parameter says how many lines) never counts; items that share a passage are all reported; each (text id, item) comes once for
    each row; with no items or no texts there are no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, CHANGES = 18, 2
SEED = WINDOW // (CHANGES + 1)
#: every so manieth word position is sampled for locating
SAMPLE_RATE = 8
#: words aimed at in a shard; a longer text is one shard
SHARD_WORDS = 1_000_000
#: characters of test items searched for at once (what is sent to every worker); more items go in blocks
ITEM_CHARS = 20_000_000

#: how tags that end a line begin
_BREAKING = {"br", "p>", "/p", "bl", "di", "/d", "li", "/l", "hr", "h1", "h2", "h3"}
#: markup of any length; a scan stops at the next angle, so it is linear
_TAG = re.compile(r"</?[A-Za-z!][^<>]*+>|\[/?[a-zA-Z*]+(?:=[^\]\[]*)?\]")
_JOINED = re.compile("['’ʼ‘`´­​-‏‪-‮⁠-⁤﻿]|(?<=\\w)[-‐‑](?=\\w)")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """The words of a text whatever its case, punctuation, markup, quote marks, special characters and line breaks."""
    t = html.unescape(text) if "&" in text else text
    if "<" in t or "[" in t:
        t = _TAG.sub(lambda m: " " if m.group()[1:3].lower() in _BREAKING else "", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
        t = _MARKS.sub("", unicodedata.normalize("NFD", t))
    return _WORD.findall(_JOINED.sub("", t).lower())


class Wavelet:
    """A wavelet matrix over small numbers: rank and access for many positions at once."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        v = values
        for b in range(self.bits - 1, -1, -1):
            bit = ((v >> b) & 1).astype(bool)
            count = np.zeros(len(v) + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(v) - int(count[-1]))
            v = np.concatenate([v[~bit], v[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        lo, hi = np.zeros_like(at), at
        for k in range(self.bits):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            ones, z = self.ones[k], self.zeros[k]
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, z + a, lo - a), np.where(bit, z + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each position, its occurrences before it)."""
        lo, pos, symbol = np.zeros_like(at), at, np.zeros_like(at)
        for k in range(self.bits):
            ones, z = self.ones[k], self.zeros[k]
            a, b = ones[lo], ones[pos]
            bit = ones[pos + 1] > b
            symbol = (symbol << 1) | bit
            lo, pos = np.where(bit, z + a, lo - a), np.where(bit, z + b, pos - b)
        return symbol, pos - lo


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by prefix doubling over the groups that still tie."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.concatenate([[True], text[order[1:]] != text[order[:-1]]])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = group
    slots = np.flatnonzero(~head | ~np.append(head[1:], True))
    width = 1
    while len(slots):
        at = order[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + width, n)] + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        head = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.maximum.accumulate(np.where(head, slots, 0))
        rank[at] = group
        slots = slots[~head | ~np.append(head[1:], True)]
        width *= 2
    return order


class FMIndex:
    """FM-index of a row of numbers in [0, top]: backward search and locating by sampled positions."""

    def __init__(self, text: np.ndarray, top: int) -> None:
        closed = np.append(text.astype(np.int64) + 1, 0)  # a smallest symbol that occurs once
        order = suffix_order(closed)
        self.wavelet = Wavelet(closed[order - 1], top + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(closed, minlength=top + 2))]).astype(np.int64)
        sampled = order % SAMPLE_RATE == 0
        self.is_sampled = sampled
        self.sampled_before = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of sorted suffixes that begin with each phrase (rows of equal length)."""
        p = phrases.astype(np.int64) + 1
        lo, hi = self.before[p[:, -1]], self.before[p[:, -1] + 1]
        alive = np.flatnonzero(lo < hi)
        for k in range(p.shape[1] - 2, -1, -1):
            c = p[alive, k]
            lo[alive], hi[alive] = self.before[c] + self.wavelet.rank(c, lo[alive]), self.before[c] + self.wavelet.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of sorted suffixes: walk back to a sampled one and count the steps."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        todo = np.flatnonzero(~self.is_sampled[rows])
        while len(todo):
            symbol, rank = self.wavelet.access(rows[todo])
            rows[todo] = self.before[symbol] + rank
            steps[todo] += 1
            todo = todo[~self.is_sampled[rows[todo]]]
        return self.positions[self.sampled_before[rows]] + steps


class Items:
    """The test passages and questions as rows of word numbers, and their seed phrases."""

    def __init__(self, rows: list[tuple[int, str | None]], instruction_lines: int = 1) -> None:
        self.vocabulary: dict[str, int] = {}
        parts: dict[tuple[int, ...], int] = {}
        owners: list[list[int]] = []
        for item, text in rows:
            # the instruction is the first line (unless told otherwise); the others count each by itself
            for part in (text or "").split("\n")[instruction_lines:]:
                ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(part))
                if len(ids) >= WINDOW:
                    if ids not in parts:
                        parts[ids] = len(owners)
                        owners.append([])
                    if item not in owners[parts[ids]]:
                        owners[parts[ids]].append(item)
        self.owners = owners
        gap = [-1] * WINDOW  # no word equals it, so windows never leave their part
        flat, part_of = list(gap), [-1] * WINDOW
        for ids, k in parts.items():
            flat += [*ids, *gap]
            part_of += [k] * len(ids) + [-1] * WINDOW
        self.flat, self.part_of = np.array(flat, dtype=np.int32), np.array(part_of, dtype=np.int32)
        at = np.array([i for i in range(len(flat) - SEED + 1) if part_of[i] >= 0 and part_of[i + SEED - 1] >= 0], dtype=np.int64)
        grams = self.flat[at[:, None] + np.arange(SEED)] if len(at) else np.empty((0, SEED), dtype=np.int32)
        self.seeds, which = np.unique(grams, axis=0, return_inverse=True)
        by = np.argsort(which.ravel(), kind="stable")
        self.places = at[by]
        self.first = np.searchsorted(which.ravel()[by], np.arange(len(self.seeds) + 1))
        self.top = len(self.vocabulary)


def _expand(first: np.ndarray, width: np.ndarray) -> np.ndarray:
    ends = np.cumsum(width)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - width, width) + np.repeat(first, width)


def squeeze(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with runs of 0 cut to CHANGES + 1 at each end, which no window spans, and each one's place in the text."""
    at, n = np.arange(len(words)), len(words)
    known = np.where(words != 0, at, -1)
    since = at - np.maximum.accumulate(known) if n else at
    until = np.minimum.accumulate(np.where(words != 0, at, n)[::-1])[::-1] - at if n else at
    keep = np.flatnonzero((since <= CHANGES + 1) | (until <= CHANGES + 1))
    return words[keep], keep


def find_in_shard(text: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(first word, part) of every window of the shard that leaks; the shard is closed by WINDOW zeros at both ends."""
    none = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
    if not len(items.seeds) or not text.any():
        return none
    index = FMIndex(text, items.top)
    lo, hi = index.search(items.seeds.astype(np.int64))
    width = hi - lo
    seed = np.repeat(np.arange(len(width)), width)
    at = index.locate(_expand(lo, width))
    starts, parts = [], []
    for a in range(0, len(at), 1 << 18):
        s, p = seed[a : a + (1 << 18)], at[a : a + (1 << 18)]
        places = items.first[s + 1] - items.first[s]
        q = items.places[_expand(items.first[s], places)]  # where the seed is in the items
        p = np.repeat(p, places)
        for k in range(CHANGES + 1):  # the seed is the k-th part of the window
            w, v = p - k * SEED, q - k * SEED
            bad = np.zeros(len(w), dtype=np.int8)
            for j in range(WINDOW):
                if not k * SEED <= j < (k + 1) * SEED:
                    bad += text[w + j] != items.flat[v + j]
                    if j % SEED == SEED - 1:
                        some = bad <= CHANGES
                        w, v, bad = w[some], v[some], bad[some]
            some = (bad <= CHANGES) & (items.part_of[v] >= 0) & (items.part_of[v + WINDOW - 1] == items.part_of[v])
            starts.append(w[some])
            parts.append(items.part_of[v[some]])
    return (np.concatenate(starts), np.concatenate(parts)) if starts else none


def within_texts(starts: np.ndarray, parts: np.ndarray, bound: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the windows that lie wholly in one text; the space between texts holds no words."""
    doc = np.searchsorted(bound, starts, side="right") - 1
    some = (doc >= 0) & (starts + WINDOW <= (bound + length)[doc])
    return starts[some], parts[some]


def _spans(starts: np.ndarray, parts: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, part, first word, end) of the merged windows of each text and part."""
    doc = np.searchsorted(bound, starts, side="right") - 1
    by = np.lexsort((starts, parts, doc))
    doc, parts, starts = doc[by], parts[by], starts[by]
    last = None
    for d, p, s in zip(doc.tolist(), parts.tolist(), starts.tolist()):
        if last and last[0] == d and last[1] == p and s <= last[3]:
            last[3] = s + WINDOW
        else:
            if last:
                yield tuple(last)
            last = [d, p, s, s + WINDOW]
    if last:
        yield tuple(last)


def leak_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", instruction_lines: int = 1) -> DataFrame:
    """(doc_id, item_id, first_word, end_word): merged spans of each text that hold passages of an item.

    The first ``instruction_lines`` lines of an item never count; 0 for items without an instruction.
    """
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id IS NOT NULL")
    size = asked.agg(F.sum(F.length("text"))).head()[0] or 0
    blocks = -(-size // ITEM_CHARS) or 1
    parts = [_spans_of_block(docs, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else asked, id_col, text_col, instruction_lines) for k in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _spans_of_block(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, instruction_lines: int) -> DataFrame:
    rows = [(r[0], r[1]) for r in items.collect()]  # one block of the test set
    model = docs.sparkSession.sparkContext.broadcast(Items(rows, instruction_lines))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        it = model.value
        number, zeros = it.vocabulary.get, np.zeros(WINDOW, dtype=np.int32)

        def shard(ids: list, row: list[np.ndarray], bound: list[int], shifts: list[np.ndarray]) -> pd.DataFrame:
            starts, parts = find_in_shard(np.concatenate([*row, zeros]), it)
            starts, parts = within_texts(starts, parts, np.array(bound), np.array([len(x) for x in shifts]))
            out = [(ids[d], item, int(shifts[d][s - bound[d]]), int(shifts[d][e - 1 - bound[d]]) + 1) for d, p, s, e in _spans(starts, parts, np.array(bound)) for item in it.owners[p]]
            return pd.DataFrame(out, columns=["doc_id", "item_id", "first_word", "end_word"]).astype({"doc_id": "int64", "item_id": "int64", "first_word": "int32", "end_word": "int32"})

        ids, row, bound, shifts, n = [], [zeros], [], [], WINDOW
        for pdf in batches:
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                if text:
                    words = words_of(text)
                    kept, offsets = squeeze(np.fromiter((number(w, 0) for w in words), dtype=np.int32, count=len(words)))
                    if len(kept) >= WINDOW:
                        ids.append(i)
                        bound.append(n)
                        shifts.append(offsets)
                        row += [kept, zeros]
                        n += len(kept) + WINDOW
                        if n >= SHARD_WORDS:
                            yield shard(ids, row, bound, shifts)
                            ids, row, bound, shifts, n = [], [zeros], [], [], WINDOW
        if ids:
            yield shard(ids, row, bound, shifts)

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    return src.mapInPandas(run, "doc_id bigint, item_id bigint, first_word int, end_word int")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", instruction_lines: int = 1) -> DataFrame:
    """(doc_id, item_id): the items that each text leaks."""
    return leak_spans(docs, items, id_col, text_col, instruction_lines).select("doc_id", "item_id").distinct()
