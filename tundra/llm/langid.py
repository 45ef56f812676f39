"""Missing or wrong language labels: multinomial naive Bayes over hashed character n-grams.

Training takes a bounded, documented sample of labelled rows (``TRAIN_DOCS`` for each language, chosen by hash of
the id, whole texts). Its n-grams are counted in the partitions and summed by Spark, so the driver only sees the
languages x ``BUCKETS`` matrix of log probabilities (fixed size), which is broadcast. Labels are noisy, so a second
round counts only the passages that the first model assigns to the label they carry.

Scoring runs over all rows in batches: the distinct words of a batch are scored once (sparse n-gram rows times the
matrix), a Viterbi pass over each text's word scores finds its language segments, for many texts at once. No shuffle.

Defined results
    markup and links are not read, everything else is; rows without an id are left out; null or empty texts, texts without letters and texts without a passage of ``MIN_WORDS`` words are no cases and have no
    segments of note; with no usable label anywhere there is no model and no row; repeated rows give rows each;
    confidence is the posterior of the segment's language under the model, tempered by its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import checkpoint

# Customary ways to write the languages (lower case).
LANGUAGES = {
    "en": ("en", "eng", "english", "englisch", "anglais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "francais", "français"),
    "es": ("es", "spa", "spanish", "espanol", "español", "castellano"),
    "pt": ("pt", "por", "portuguese", "portugues", "português"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "ru": ("ru", "rus", "russian", "русский"),
}
CODES = list(LANGUAGES)
BUCKETS = 1 << 16
NGRAMS = (1, 2, 3, 4)
#: bound of the training sample: documents of each language, chosen by hash
TRAIN_DOCS = 1500
MIN_WORDS = 10
#: log penalty for changing the language between two words; between sentences it is easier
SWITCH, SWITCH_AT_BREAK = 14.0, 6.0

#: words decoded side by side, and characters of texts scored at once (bounds of memory; a longer text goes alone)
CELLS, PART_CHARS = 400_000, 8_000_000
#: distinct words whose scores a task keeps; beyond them it starts anew (a bound of memory, results are the same)
CACHE_WORDS = 500_000

#: markup of any length; a scan stops at the next angle, so it is linear
_TAG = re.compile(r"</?[A-Za-z!][^<>]*+>|\[/?[a-zA-Z*]+(?:=[^\]\[]*)?\]")
_LINK = re.compile(r"(?:https?://|www\.)\S+|[\w.+-]{1,64}@\S+")
_SOFT = re.compile("[­​-‏⁠﻿]")
#: a word of letters (marks inside), no part of a code with digits; a break is the end of a sentence or line
_WORD = re.compile(r"(?<!\w)[^\W\d_]++(?:['’ʼ\-][^\W\d_]++)*+(?!-?\d)")
_BREAK = re.compile(r"[.!?…:\n]+")


def canonical(label: str | None) -> str | None:
    """The two-letter code that a label means, or None."""
    if label is None:
        return None
    t = re.split(r"[-_\s(/]", label.strip().lower(), maxsplit=1)[0]
    return _BY_NAME.get(t)


_BY_NAME = {n: c for c, names in LANGUAGES.items() for n in names}


def canonical_label(col: str) -> F.Column:
    """The same as a column."""
    word = F.lower(F.regexp_extract(F.trim(F.col(col)), r"^([^-_\s(/]*)", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in _BY_NAME.items() for x in kv]), word)


def words_of(text: str) -> tuple[list[str], np.ndarray]:
    """Lower-case words of a text and, for each, whether a sentence or line ended before it."""
    t = text if text.isascii() else _SOFT.sub("", text)
    if "&" in t:
        t = html.unescape(t)
    if "<" in t or "[" in t:
        t = _TAG.sub(" ", t)
    if "www." in t or "http" in t or "@" in t:
        t = _LINK.sub(" ", t)
    t = t.lower()
    words, starts = [], []
    for part in _BREAK.split(t):
        got = _WORD.findall(part)
        if got:
            starts.append(len(words))
            words += got
    breaks = np.zeros(len(words), dtype=bool)
    breaks[starts] = True
    return words, breaks


def grams(word: str) -> list[int]:
    w = f" {word} "
    return [xxhash.xxh32_intdigest(w[i : i + n]) % BUCKETS for n in NGRAMS for i in range(len(w) - n + 1)]


class Scorer:
    """Log probabilities of words under each language; words seen before are looked up."""

    def __init__(self, matrix: np.ndarray, cache_words: int = CACHE_WORDS) -> None:
        self.matrix, self.cache_words = matrix, cache_words
        self.row, self.scores = {}, np.empty((0, matrix.shape[1]), dtype=np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        """Each word's scores. They are copies, as the table may be emptied at the next call."""
        new = [w for w in dict.fromkeys(words) if w not in self.row]
        if new:
            if len(self.row) + len(new) > self.cache_words:
                self.row, self.scores = {}, np.empty((0, self.matrix.shape[1]), dtype=np.float32)
                new = list(dict.fromkeys(words))
            ids = [grams(w) for w in new]
            size = np.array([len(x) for x in ids])
            flat = np.concatenate([np.array(x) for x in ids])
            got = np.add.reduceat(self.matrix[flat], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)
            # the n-grams of a word overlap, so their evidence is damped to about one of them a letter
            got = got / len(NGRAMS)
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
            self.scores = np.vstack([self.scores, (got - got.max(axis=1, keepdims=True)).astype(np.float32)])
        return self.scores[np.fromiter(map(self.row.__getitem__, words), dtype=np.int64, count=len(words))]


def viterbi(scores: list[np.ndarray], breaks: list[np.ndarray]) -> list[np.ndarray]:
    """The best language of every word of every text; texts of like length go through together."""
    out: list = [np.empty(0, dtype=np.int8)] * len(scores)
    order = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: len(scores[i]))
    at = 0
    while at < len(order):
        longest = len(scores[order[at]])
        stop = at
        while stop < len(order) and (stop - at + 1) * len(scores[order[stop]]) <= max(CELLS, longest) and len(scores[order[stop]]) <= longest * 1.3 + 8:
            stop += 1
        group = order[at:stop]
        at = stop
        n, k, size = max(len(scores[i]) for i in group), scores[group[0]].shape[1], len(group)
        s, b = np.zeros((n, size, k), dtype=np.float32), np.zeros((n, size), dtype=bool)
        for j, i in enumerate(group):
            s[: len(scores[i]), j], b[: len(breaks[i]), j] = scores[i], breaks[i]
        stay = np.zeros((n, size, k), dtype=bool)
        came = np.zeros((n, size), dtype=np.int8)
        cost = np.where(b, np.float32(SWITCH_AT_BREAK), np.float32(SWITCH))
        best, each = s[0], np.arange(size)
        for t in range(1, n):
            top = best.argmax(axis=1)
            came[t] = top
            jump = (best[each, top] - cost[t])[:, None]
            np.greater_equal(best, jump, out=stay[t])
            best = np.maximum(best, jump) + s[t]
        # padding adds nothing, so the end state of a shorter text is the same after it
        state = best.argmax(axis=1)
        path = np.empty((n, size), dtype=np.int8)
        for t in range(n - 1, -1, -1):
            path[t] = state
            state = np.where(stay[t][each, state], state, came[t])
        for j, i in enumerate(group):
            out[i] = path[: len(scores[i]), j]
    return out


def segments_of(texts: list[str | None], scorer: Scorer) -> list[list[tuple[int, int, int, float]]]:
    """For each text its segments as (language, first word, words, confidence)."""
    split = [words_of(t) if t else ([], np.zeros(0, dtype=bool)) for t in texts]
    scores = [scorer.of(w) for w, _ in split]
    out = []
    for path, s in zip(viterbi(scores, [b for _, b in split]), scores):
        if not len(path):
            out.append([])
            continue
        cut = np.flatnonzero(np.diff(path, prepend=-1))
        ends = np.append(cut[1:], len(path))
        mean = np.add.reduceat(s, cut, axis=0) / np.sqrt(ends - cut)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        out.append([(int(path[a]), int(a), int(e - a), float(p[i, path[a]])) for i, (a, e) in enumerate(zip(cut, ends))])
    return out


def _parts(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts of bounded text length."""
    size = pdf["text"].str.len().fillna(0).astype("int64").cumsum().to_numpy()
    at = 0
    while at < len(pdf):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART_CHARS, side="right")))
        yield pdf.iloc[at:stop]
        at = stop


def _log_matrix(counts: np.ndarray) -> np.ndarray:
    """Smoothed log probabilities of the buckets, languages in columns."""
    total = counts.sum(axis=1, keepdims=True)
    p = np.log((counts + 0.1) / (total + 0.1 * BUCKETS))
    p[total[:, 0] == 0] = -1e3  # a language without training rows is never chosen
    return np.ascontiguousarray(p.T)


def _counted(sample: DataFrame, matrix: np.ndarray | None) -> np.ndarray:
    """Counts of n-grams by language over the sample; with a model only of passages it gives to their label."""
    spark = sample.sparkSession
    model = None if matrix is None else spark.sparkContext.broadcast(matrix)  # BUCKETS x languages, fixed

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(CODES), BUCKETS), dtype=np.int64)
        seen: list[Counter] = [Counter() for _ in CODES]

        def add() -> None:
            for k, words in enumerate(seen):
                if words:
                    ids = [grams(w) for w in words]
                    np.add.at(total[k], np.concatenate([np.array(x) for x in ids]), np.repeat(np.fromiter(words.values(), dtype=np.int64), [len(x) for x in ids]))
                    words.clear()

        scorer = None if model is None else Scorer(model.value)
        for pdf in batches:
            for part in _parts(pdf):
                texts, labels = part["text"].tolist(), part["code"].tolist()
                runs = segments_of(texts, scorer) if scorer else [None] * len(texts)
                for text, code, segments in zip(texts, labels, runs):
                    words, k = words_of(text)[0], CODES.index(code)
                    if segments is not None:
                        words = [w for lang, first, n, _ in segments if lang == k and n >= MIN_WORDS for w in words[first : first + n]]
                    seen[k].update(words)
            if sum(map(len, seen)) > 200_000:
                add()
        add()
        lang, bucket = np.nonzero(total)
        yield pd.DataFrame({"lang": lang.astype("int32"), "bucket": bucket.astype("int32"), "n": total[lang, bucket]})

    got = sample.mapInPandas(count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(CODES), BUCKETS))
    counts[got["lang"], got["bucket"]] = got["n"]
    return counts


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = TRAIN_DOCS) -> np.ndarray:
    """The log-probability matrix (buckets x languages), from at most ``per_language`` labelled rows of each language."""
    coded = docs.select(F.col(id_col).alias("id"), canonical_label(label_col).alias("code"), F.col(text_col).alias("text")).filter("code IS NOT NULL")
    # which ids to take: hash threshold from exact label counts (a scan of the labels only), so the sample is spread over all rows
    n = {r["code"]: r["n"] for r in coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not n:
        return np.zeros((BUCKETS, 0))
    share = F.element_at(F.create_map(*[x for c, k in n.items() for x in (F.lit(c), F.lit(min(1.0, per_language / k)))]), F.col("code"))
    # read twice, so it is kept: a bounded sample
    sample = checkpoint(coded.filter((F.pmod(F.xxhash64(F.col("id")), F.lit(1_000_003)) / 1_000_003) < share).filter("length(text) >= 40").select("code", "text"))
    matrix = _log_matrix(_counted(sample, None))
    return _log_matrix(_counted(sample, matrix))


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", matrix: np.ndarray | None = None) -> DataFrame:
    """(doc_id, label, segment, lang, first_word, n_words, confidence): every language segment of every text."""
    if matrix is None:
        matrix = train(docs, id_col, text_col, label_col)
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), canonical_label(label_col).alias("label")).filter("doc_id IS NOT NULL")
    schema = "doc_id bigint, label string, segment int, lang string, first_word int, n_words int, confidence double"
    if not matrix.shape[1]:
        return docs.sparkSession.createDataFrame([], schema)
    model = docs.sparkSession.sparkContext.broadcast(matrix)  # BUCKETS x languages, fixed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.value)
        for pdf in batches:
            for part in _parts(pdf):
                got = [
                    (i, label, k, CODES[lang], first, n, conf)
                    for i, label, runs in zip(part["doc_id"], part["label"], segments_of(part["text"].tolist(), scorer))
                    for k, (lang, first, n, conf) in enumerate(runs)
                ]
                yield pd.DataFrame(got, columns=["doc_id", "label", "segment", "lang", "first_word", "n_words", "confidence"]).astype({"segment": "int32", "first_word": "int32", "n_words": "int32", "confidence": "float64"})

    return src.mapInPandas(run, schema)


def mislabelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", matrix: np.ndarray | None = None) -> DataFrame:
    """(doc_id, lang): the languages of the texts whose label is missing or wrong or that hold several.

    A language counts if a passage of it has ``MIN_WORDS`` words; the main one has the most words.
    """
    if matrix is None:
        matrix = train(docs, id_col, text_col, label_col)
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), canonical_label(label_col).alias("label")).filter("doc_id IS NOT NULL")
    if not matrix.shape[1]:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, lang string")
    model = docs.sparkSession.sparkContext.broadcast(matrix)  # BUCKETS x languages, fixed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.value)
        for pdf in batches:
            for part in _parts(pdf):
                out = []
                for i, label, runs in zip(part["doc_id"], part["label"], segments_of(part["text"].tolist(), scorer)):
                    held = {lang for lang, _, n, _ in runs if n >= MIN_WORDS}
                    if not held:
                        continue
                    total = np.zeros(len(CODES))
                    for lang, _, n, _ in runs:
                        total[lang] += n
                    main = max(held, key=lambda k: total[k])
                    if len(held) > 1 or label != CODES[main]:
                        out += [(i, CODES[k]) for k in sorted(held)]
                yield pd.DataFrame(out, columns=["doc_id", "lang"]).astype({"doc_id": "int64"})

    return src.mapInPandas(run, "doc_id bigint, lang string")
