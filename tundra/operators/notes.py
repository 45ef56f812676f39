"""A grouped ledger of notes: add and replace events folded into wide reports.

Events are (group, holder, seq, op, key, num, str). The gate comes first: notes count only while their group is
enabled. Then a replace resets its key. Sums are partial plus final; texts are joined in seq order.

The ledger is dealt once, by group and slice of seq (an order over the group): in a slice, which no group can make larger, notes
sent again are dropped, the gate's state runs as a window, and each key is folded from its last replace on. What is left of
a slice is a row for each holder and key, and of these the slices since the last one with a replace add up. The state
at each slice's start is a running value over the slices' last toggles, from a second scan of the few columns it needs.

Defined results
    events without a group or seq are left out, without a key folded as a key of their own; groups start enabled; a note sent again (same group, holder, seq)
    counts once, of differing copies one that enables or disables, else the least; of toggles with one seq the last holder's counts; values of null
    add nothing; text joined after numbers, lists and accumulators are separate results of a key; an empty ledger gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import accum

SLICE = 100_000


TOGGLES = ("enable", "disable")


def _first_copy(columns: list[str], op: str) -> Column:
    """Of several copies of a note: one that enables or disables, else the least by the other columns."""
    return F.min(F.struct(*([(~F.coalesce(F.col(op).isin(*TOGGLES), F.lit(False))).alias("_later")] if op in columns else []), *columns))


def once(notes: DataFrame, ident: list[str], op: str = "op") -> DataFrame:
    """Each note once, however often it was sent."""
    rest = [c for c in notes.columns if c not in ident]
    return notes.groupBy(*ident).agg(_first_copy(rest, op).alias("_r")).select(*ident, *[f"_r.{c}" for c in rest])


def _sliced(notes: DataFrame, group: str, holder: str, seq: str, op: str) -> DataFrame:
    """The gated add and replace events, each once, with their slice ``_s``; dealt by group and slice."""
    e = notes.filter(F.col(group).isNotNull() & F.col(seq).isNotNull()).withColumn("_s", F.floor(F.col(seq) / SLICE))
    toggle = F.when(F.col(op).isin(*TOGGLES), F.struct(seq, holder, (F.col(op) == "disable").alias("off")))
    last = e.groupBy(group, "_s").agg(F.max(toggle).alias("_last"))
    earlier = Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    start = last.select(group, "_s", (~F.coalesce(F.last("_last.off", True).over(earlier), F.lit(False))).alias("_start"))
    rest = [c for c in notes.columns if c not in (group, holder, seq)]
    dealt = e.repartition(group, "_s").groupBy(group, "_s", holder, seq).agg(_first_copy(rest, op).alias("_r")).select(group, "_s", holder, seq, *[f"_r.{c}" for c in rest])
    on = F.when(F.col(op) == "enable", True).when(F.col(op) == "disable", False)
    state = F.last(on, True).over(Window.partitionBy(group, "_s").orderBy(seq, holder).rowsBetween(Window.unboundedPreceding, 0))
    got = dealt.withColumn("_on", state).join(start, [group, "_s"])
    return got.filter(F.coalesce("_on", "_start") & F.col(op).isin("add", "replace")).drop("_on", "_start")


def gate(notes: DataFrame, group: str = "grp", holder: str = "holder", seq: str = "seq", op: str = "op") -> DataFrame:
    """The add and replace events, each once, whose group was enabled when they came."""
    return _sliced(notes, group, holder, seq, op).select(*notes.columns)


def effective(events: DataFrame, holder: list[str], key: str, seq: str = "seq", op: str = "op") -> DataFrame:
    """The events from each key's last replace on."""
    cut = events.filter(F.col(op) == "replace").groupBy(*holder, key).agg(F.max(seq).alias("_cut"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*holder, key)]
    return events.alias("e").join(cut.alias("c"), same, "left").filter(F.col("_cut").isNull() | (F.col(seq) >= F.col("_cut"))).select("e.*")


def _joined(order: str, text: str) -> Column:
    """Texts in order as one."""
    return F.when(F.count(text) > 0, F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text)))), lambda s: s[text]), ""))


def fold(events: DataFrame, holder: list[str], key: str, num: str, text: str | None = None, seq: str = "seq", lists: str | None = None, stats: str | None = None) -> DataFrame:
    """(holder..., key, n, total, words, items, stats): sums of numbers, texts and lists joined in seq order, accumulators merged.

    ``lists`` is an array column, those without seq come last; ``stats`` a column of ``accum.stat_val`` structs.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(num).alias("total")]
    if text:
        aggs.append(_joined(seq, text).alias("words"))
    if lists:
        aggs.append(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(lists).isNotNull(), F.struct(F.col(seq).isNull().alias("_none"), seq, lists)))), lambda s: s[lists])).alias("items"))
    if stats:
        aggs.append(accum.merge_stat_vals(F.col(stats)).alias("stats"))
    return events.groupBy(*holder, key).agg(*aggs)


def fold_ledger(notes: DataFrame, key: str, num: str, text: str | None = None, group: str = "grp", holder: str = "holder", seq: str = "seq", op: str = "op") -> DataFrame:
    """(group, holder, key, n, total, words): the ledger gated, each note once, folded from every key's last replace on."""
    e = _sliced(notes, group, holder, seq, op)
    cut = F.max(F.when(F.col(op) == "replace", F.col(seq))).over(Window.partitionBy(group, "_s", holder, key))
    kept = e.withColumn("_cut", cut).filter(F.col("_cut").isNull() | (F.col(seq) >= F.col("_cut")))
    words = [_joined(seq, text).alias("_words")] if text else []
    part = kept.groupBy(group, "_s", holder, key).agg(F.count(F.lit(1)).alias("_n"), F.sum(num).alias("_total"), F.max(F.col("_cut").isNotNull()).alias("_new"), *words)
    since = F.max(F.when(F.col("_new"), F.col("_s"))).over(Window.partitionBy(group, holder, key))
    live = part.withColumn("_since", since).filter(F.col("_since").isNull() | (F.col("_s") >= F.col("_since")))
    words = [_joined("_s", "_words").alias("words")] if text else []
    return live.groupBy(group, holder, key).agg(F.sum("_n").alias("n"), F.sum("_total").alias("total"), *words)


def report(folded: DataFrame, holder: list[str], key: str, value: str, fields: list[str] | None = None, required: list[str] | None = None, override: list[str] | None = None, rewrite: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Wide rows, one a holder. Without ``fields`` the columns are the sorted keys, code and name first.
    ``rewrite`` gets the wide table last.

    Only holders with any ``override`` key, or with all ``required`` ones, stay; override counts only beside required.
    """
    if fields is None:
        keys = [r[0] for r in folded.select(key).distinct().filter(F.col(key).isNotNull()).collect()]  # they become the report's columns
        fields = [*(k for k in ("code", "name") if k in keys), *sorted(k for k in keys if k not in ("code", "name"))]
    kept = folded
    if required:
        need = F.count_distinct(F.when(F.col(key).isin(required), F.col(key))) == len(set(required))
        over = F.max(F.when(F.col(key).isin(override), 1)) == 1 if override else F.lit(False)
        ok = folded.groupBy(*holder).agg((need | F.coalesce(over, F.lit(False))).alias("_ok")).filter("_ok").drop("_ok")
        kept = folded.join(ok, holder, "left_semi")
    wide = kept.groupBy(*holder).agg(*[F.max(F.when(F.col(key) == f, F.col(value))).alias(f) for f in fields])
    return wide.transform(rewrite) if rewrite else wide


def keep_keys(folded: DataFrame, key: str, regex: str) -> DataFrame:
    """Only keys that the expression matches from their start."""
    re.compile(regex)
    return folded.filter(F.col(key).rlike(f"^(?:{regex})"))


def lookup(folded: DataFrame, holder: list[str], key: str, name: str, value: str) -> DataFrame:
    """One key of every holder, null where it has none."""
    return folded.select(*holder).distinct().join(folded.filter(F.col(key) == name).select(*holder, F.col(value).alias(name)), holder, "left")


def available(folded: DataFrame, holder: list[str], key: str) -> DataFrame:
    """The sorted key names of each holder; a holder has few keys."""
    return folded.groupBy(*holder).agg(F.array_join(F.array_sort(F.collect_set(key)), ",").alias("names"))


def copy_holder(events: DataFrame, holder: str, old: str, new: str) -> DataFrame:
    """The events of ``old`` again under ``new``."""
    return events.unionByName(events.filter(F.col(holder) == old).withColumn(holder, F.lit(new)))


def csv_lines(wide: DataFrame, fields: list[str], empty: str = "NA", preamble: list[str] | None = None) -> DataFrame:
    """(line_no, line): the report as CSV text, with literal rows above the header."""
    from ..sources.csvtext import render_rows

    return render_rows(wide, fields, empty=empty, preamble=preamble)
