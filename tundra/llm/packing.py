"""Filling fixed-capacity containers with texts, with little room left and no text split that fits.

Sizes are tokens of a public tokenizer (its file is a parameter). Per capacity, with the linear grouping scheme:
texts above the capacity give full pieces and one rest; the counts of the sizes (at most ``capacity`` rows, made by a
pre-aggregated group-by) go to the driver; large sizes are cut into ``GROUPS`` groups of equal cardinality and
rounded up to each group's largest; the few-size problem is optimised over configurations by column generation;
actual texts are substituted into the configurations' slots by rank, which is arithmetic on a distributed rank; small
and left-over texts are put best-fit, largest first, into the room that remains, in chunks of bounded size that each
hold a fair share of containers and small texts. Nothing larger than the capacities and the size counts reaches the driver.

Defined results
    rows without an id, null and empty texts hold no tokens and are not placed; a text above the capacity has pieces 0, 1, ... of which all
    but the last are full; repeated texts are placed each; an empty table gives no rows; capacities that are null
    or below 1 are ignored; ``start`` is the token offset in the container.
"""

from __future__ import annotations

import base64
import bisect
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.runtime import checkpoint

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: groups of equal cardinality that large sizes are rounded within
GROUPS = 64
#: sizes above this share of the capacity are large
LARGE = 0.25
#: texts aimed at in a chunk of the best-fit step, and rows aimed at in a rank bucket
CHUNK_ROWS = 40_000
BUCKET_ROWS = 500_000
#: capacities packed in one plan
CAPS_AT_ONCE = 16
# Fixed value: how byte-level BPE splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every text that has any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": np.fromiter((len(enc.encode_ordinary(t)) for t in pdf["text"]), dtype=np.int64, count=len(pdf))})

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND length(text) > 0")
    return src.mapInPandas(run, "doc_id bigint, n_tokens bigint")


def _price(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most value that fits: a bounded knapsack."""
    best = np.zeros(capacity + 1)
    take = np.zeros((len(size), capacity + 1), dtype=np.int16)
    for k in np.flatnonzero(value > 1e-12):
        s, new = int(size[k]), best.copy()
        for m in range(1, capacity // s + 1):
            other = best[: capacity + 1 - m * s] + m * value[k]
            better = other > new[m * s :] + 1e-12
            new[m * s :][better] = other[better]
            take[k, m * s :][better] = m
        best = new
    pattern, room = np.zeros(len(size)), capacity
    for k in range(len(size) - 1, -1, -1):
        m = int(take[k, room])
        pattern[k] = m
        room -= m * int(size[k])
    return float(value @ pattern), pattern


def configurations(size: np.ndarray, count: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each) of few sizes, rounded down to whole containers; by column generation."""
    k = len(size)
    basis = np.diag(np.floor(capacity / size))
    for _ in range(40 * k):
        worth, new = _price(np.linalg.solve(basis.T, np.ones(k)), size, capacity)
        if worth <= 1 + 1e-9:
            break
        entering, now = np.linalg.solve(basis, new), np.linalg.solve(basis, count)
        ratio = np.where(entering > 1e-9, np.maximum(now, 0) / np.where(entering > 1e-9, entering, 1), np.inf)
        leaving = int(ratio.argmin())
        if not math.isfinite(ratio[leaving]):
            break
        basis[:, leaving] = new
    times = np.floor(np.linalg.solve(basis, count) + 1e-6).clip(0)
    # rounding must never use more texts than there are
    while (over := basis @ times - count).max() > 0:
        r = int(over.argmax())
        c = int(np.argmax(np.where(times > 0, basis[r], 0)))
        times[c] -= 1
    some = times > 0
    return basis[:, some].astype(np.int64), times[some].astype(np.int64)


class Plan:
    """Where the texts of one capacity go, from the counts of its sizes (largest first)."""

    def __init__(self, capacity: int, size: np.ndarray, count: np.ndarray) -> None:
        by = np.argsort(-size)
        size, count = size[by], count[by]
        self.capacity, self.total = capacity, int(count.sum())
        self.size, self.first = size, np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        self.large = int(count[size > LARGE * capacity].sum())
        k = min(GROUPS, self.large)
        self.cut = np.unique(np.floor(np.linspace(0, self.large, k + 1)).astype(np.int64)) if k else np.zeros(1, dtype=np.int64)
        rounded = size[np.searchsorted(self.first, self.cut[:-1], side="right") - 1] if k else np.empty(0, dtype=np.int64)
        self.bins = 0
        self.slots: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # for each group: first rank, slots in a container, first container
        if k:
            patterns, times = configurations(rounded.astype(float), np.diff(self.cut).astype(float), capacity)
            base = np.concatenate([[0], np.cumsum(times)])
            self.bins = int(base[-1])
            for g in range(len(rounded)):
                mine = np.flatnonzero(patterns[g])
                used = patterns[g, mine] * times[mine]
                self.slots.append((np.concatenate([[0], np.cumsum(used)]).astype(np.int64), patterns[g, mine], base[mine]))
        self.chunks = max(1, math.ceil(self.total / CHUNK_ROWS))

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(container or -1, chunk) of texts by size and rank among their size."""
        at = self.first[len(self.size) - 1 - np.searchsorted(self.size[::-1], size)] + rank
        bin_ = np.full(len(at), -1, dtype=np.int64)
        group = np.searchsorted(self.cut, at, side="right") - 1
        for g in np.unique(group[at < self.large]):
            some = np.flatnonzero((group == g) & (at < self.large))
            r = at[some] - self.cut[g]
            first, per, base = self.slots[g]
            j = np.searchsorted(first, r, side="right") - 1
            fits = j < len(per)
            some, r, j = some[fits], r[fits], j[fits]
            bin_[some] = base[j] + (r - first[j]) // per[j]
        return bin_, np.where(bin_ >= 0, bin_, at) % self.chunks


def fill(pdf: pd.DataFrame, capacity: int, bins: int, chunks: int) -> pd.DataFrame:
    """One chunk: containers from configurations keep their texts, all others go best-fit, largest first."""
    held = pdf["container_id"].to_numpy().copy()
    size = pdf["n_tokens"].to_numpy()
    chunk = int(pdf["chunk"].iloc[0])
    ids, inverse = np.unique(held[held >= 0], return_inverse=True)
    room = capacity - np.bincount(inverse, weights=size[held >= 0], minlength=len(ids)).astype(np.int64)
    spaces = sorted((int(r), int(c)) for r, c in zip(room, ids) if r > 0)
    opened = 0
    loose = np.flatnonzero(held < 0)
    for i in loose[np.lexsort((pdf["piece"].to_numpy()[loose], pdf["doc_id"].to_numpy()[loose], -size[loose]))]:
        n = int(size[i])
        k = bisect.bisect_left(spaces, (n, -1))
        if k == len(spaces):
            left, c = capacity, bins + chunk + chunks * opened
            opened += 1
        else:
            left, c = spaces.pop(k)
        held[i] = c
        if left > n:
            bisect.insort(spaces, (left - n, c))
    out = pdf[["cap_id", "doc_id", "piece", "n_tokens"]].assign(container_id=held)
    out = out.sort_values(["container_id", "n_tokens", "doc_id", "piece"], ascending=[True, False, True, True], kind="stable")
    by = out.groupby("container_id", sort=False)["n_tokens"]
    return out.assign(position=by.cumcount().astype("int32"), start=by.cumsum() - out["n_tokens"])[["cap_id", "container_id", "position", "doc_id", "piece", "n_tokens", "start"]]


def pack(docs: DataFrame, capacities: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(cap_id, container_id, position, doc_id, piece, n_tokens, start): every text in a container of every capacity."""
    spark = docs.sparkSession
    schema = "cap_id bigint, container_id bigint, position int, doc_id bigint, piece bigint, n_tokens bigint, start bigint"
    caps = {int(r[0]): int(r[1]) for r in capacities.select("cap_id", "max_tokens").filter("cap_id IS NOT NULL AND max_tokens >= 1").collect()}
    if not caps:
        return spark.createDataFrame([], schema)
    # counted once, read by every plan: a reliable checkpoint of two numbers a text
    sizes = checkpoint(token_counts(docs, id_col, text_col, tokenizer))
    some = sorted(caps)
    out: DataFrame | None = None
    for at in range(0, len(some), CAPS_AT_ONCE):  # any number of capacities, a block in one plan
        part = _pack_block(sizes, {i: caps[i] for i in some[at : at + CAPS_AT_ONCE]}, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _pack_block(sizes: DataFrame, caps: dict[int, int], schema: str) -> DataFrame:
    spark = sizes.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("cap_id"), F.lit(c).cast("bigint").alias("cap")) for i, c in caps.items()])).alias("c")
    pieces = (
        sizes.select("doc_id", "n_tokens", each).select("doc_id", "c.cap_id", "c.cap", "n_tokens")
        .withColumn("full", F.expr("n_tokens div cap")).withColumn("rest", F.expr("n_tokens % cap"))
    )
    rests = pieces.filter("rest > 0").select("cap_id", "doc_id", F.col("full").alias("piece"), F.col("rest").alias("n_tokens"))
    counts = rests.groupBy("cap_id", "n_tokens").count().toPandas()  # at most one row for each size up to each capacity
    plans = {i: Plan(c, *(counts.loc[counts["cap_id"] == i, x].to_numpy(np.int64) for x in ("n_tokens", "count"))) for i, c in caps.items()}
    sent = spark.sparkContext.broadcast(plans)  # bounded by the sizes up to each capacity

    # rank of each text among its size: counted in buckets, so that one size may hold any share of the rows
    buckets = max(8, math.ceil(max(p.total for p in plans.values()) / BUCKET_ROWS))
    salted = rests.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = salted.groupBy("cap_id", "n_tokens", "bucket").count().withColumn(
        "before", F.sum("count").over(Window.partitionBy("cap_id", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    )
    ranked = (
        salted.withColumn("rn", F.row_number().over(Window.partitionBy("cap_id", "n_tokens", "bucket").orderBy("doc_id", "piece")))
        .join(before.drop("count"), ["cap_id", "n_tokens", "bucket"])
        .select("cap_id", "doc_id", "piece", "n_tokens", (F.col("rn") - 1 + F.coalesce("before", F.lit(0))).alias("rank"))
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bin_, chunk = np.empty(len(pdf), dtype=np.int64), np.empty(len(pdf), dtype=np.int64)
            for cap, rows in pdf.groupby("cap_id").indices.items():
                bin_[rows], chunk[rows] = sent.value[cap].place(pdf["n_tokens"].to_numpy()[rows], pdf["rank"].to_numpy()[rows])
            yield pdf.drop(columns="rank").assign(container_id=bin_, chunk=chunk)

    placed = ranked.mapInPandas(place, "cap_id bigint, doc_id bigint, piece bigint, n_tokens bigint, container_id bigint, chunk bigint")

    def fill_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        p = sent.value[int(pdf["cap_id"].iloc[0])]
        return fill(pdf, p.capacity, p.bins, p.chunks)

    packed = placed.groupBy("cap_id", "chunk").applyInPandas(fill_chunk, schema)
    # full pieces each have a container of their own, numbered below zero by running sums in the same buckets
    oversize = pieces.filter("full > 0").select("cap_id", "doc_id", "cap", "full").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    totals = oversize.groupBy("cap_id", "bucket").agg(F.sum("full").alias("n")).select(
        "cap_id", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("cap_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    in_bucket = Window.partitionBy("cap_id", "bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    own = (
        oversize.withColumn("inside", F.coalesce(F.sum("full").over(in_bucket), F.lit(0))).join(totals, ["cap_id", "bucket"])
        .select("cap_id", "doc_id", "cap", (F.col("before") + F.col("inside")).alias("first"), F.explode(F.expr("sequence(0L, full - 1)")).alias("piece"))
        .select("cap_id", (-1 - F.col("first") - F.col("piece")).alias("container_id"), F.lit(0).alias("position"), "doc_id", "piece", F.col("cap").alias("n_tokens"), F.lit(0).cast("bigint").alias("start"))
    )
    return packed.unionByName(own)


def usage(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(cap_id, containers, tokens, least_containers, fill): how well each capacity is used."""
    by = packed.groupBy("cap_id", "container_id").agg(F.sum("n_tokens").alias("tokens")).groupBy("cap_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    caps = capacities.select("cap_id", "max_tokens").dropDuplicates(["cap_id"])
    return by.join(caps, "cap_id").select("cap_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("max_tokens")).alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("max_tokens"))).alias("fill"))

