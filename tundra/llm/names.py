"""Variant spellings of names typed by people: merge-and-rematch resolution.

Every distinct spelling shows some evidence: a pair of first and second part, a first part alone, a part given by its
initial or shortened, an acronym, the initials of its further parts, or a catalogue code beside words. Spellings
that show the same merge, and so do those that differ by one slip of the pen; these links never change, so they are found once.
The merged records then are profiles that unite the spellings, initials and parts of all their members, and profiles enter
blocking again: one that shows too little to stand alone (a first part only, an initial, an acronym, a short form)
joins the class that offers what it asks for, if there is exactly one. Merged profiles offer what no single spelling shows, so this goes on until
a round merges nothing; then what is still alone is asked again allowing for a slip.

No group of any size is gathered: blocks of slips hold one part and all but one letter of another, so their size is
bounded by the alphabet; who is the only class behind a key is a minimum and maximum, which are pre-aggregated; classes are labels on
rows. Rows are made distinct first, so a spelling that fills a third of all rows counts once. Each round's state is a
reliable checkpoint.

No list of words is taken from any data. Words that go with many different first parts ("Industries") are learned from the table; forms of
businesses in law and short forms of given names are parameters, whose defaults are public general lists.

Defined results
    what fits several classes joins none of them; null spellings are no records; spellings without any letter or digit stay alone;
    spellings that differ in a byte are different; parts of more than ``LONGEST`` letters must be equal; an empty table gives no rows;
    other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import checkpoint, small

MAX_ROUNDS = 50
#: letters that a short form keeps, letters of the longest short form, letters from which a lone part may be mistyped
KEPT, SHORT, LONE = 3, 6, 5
#: letters of the longest part that may differ in a letter from another
LONGEST = 64
#: a word is general if it goes with this share of all first parts, and with this many
GENERAL_SHARE, GENERAL_LEAST = 0.02, 20
#: keys asked for that are broadcast at most; more are joined by a shuffle
FEW_KEYS = 200_000
#: members of a class that are paired in one task
PAIR_BLOCK = 2000

# Usual abbreviations of forms of businesses in law, as in the public list of entity legal forms.
LEGAL_FORMS = frozenset(
    """ab ag aktiengesellschaft aktiebolag aps as asa bhd bv bvba co company corp corporation cv doo dba eirl ev gbr gmbh gp inc incorporated jsc
    kft kg kgaa kk limited limitada llc llp lp ltd ltda mbh nv oao ohg ood ooo oy oyj pjsc plc private pt pte pty pvt sa sab sapi sarl
    sas sasu sca scs sdn se sl slu snc spa spol spzoo srl sro ug vof zao zrt""".split()
)
# Common English short forms of given names.
NICKNAMES = {
    "alexander": "alex al sandy", "alexandra": "alex sandra", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny", "catherine": "cathy kate katie",
    "charles": "charlie chuck", "christina": "chris tina", "christopher": "chris kit", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "donald": "don",
    "dorothy": "dot dolly", "edward": "ed eddie ted ned", "elizabeth": "liz beth betty eliza lizzie", "eugene": "gene", "frances": "fran", "francis": "frank", "frederick": "fred freddie",
    "gerald": "gerry jerry", "gregory": "greg", "harold": "harry hal", "henry": "harry hank", "jacob": "jake", "james": "jim jimmy jamie", "jeffrey": "jeff", "jennifer": "jen jenny",
    "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "joshua": "josh", "katherine": "kathy kate katie", "kenneth": "ken", "lawrence": "larry", "leonard": "len leo",
    "margaret": "maggie meg peggy", "martha": "patty", "matthew": "matt", "michael": "mike mick", "nancy": "nan", "nathaniel": "nat nate", "nicholas": "nick", "pamela": "pam",
    "patricia": "pat patty trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "raymond": "ray", "rebecca": "becky", "richard": "rick dick rich", "robert": "bob rob bobby",
    "ronald": "ron", "samuel": "sam", "sarah": "sally", "stephen": "steve", "susan": "sue", "theodore": "ted", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim",
    "victoria": "vicky", "vincent": "vince", "walter": "walt", "william": "bill will billy",
}

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CODE = re.compile(r"(?<![A-Za-z])([A-Za-z]{1,4})[ .\-]?(\d{2,})")
#: marks of a variant right behind a code: up to three capitals, more of them after a slash
_VARIANT = re.compile(r"^[ ]?[A-Z]{1,3}(?:/[A-Z]{1,3})*(?![A-Za-z])")
_PART = re.compile(r"[^\W\d_]+\.?")
_WORD = re.compile(r"[^\W_]+")
_SEP = "\x1f"


def plain(text: str) -> str:
    """Without accents, compatibility forms or doubled blanks; the case stays."""
    t = unicodedata.normalize("NFKD", text)
    return " ".join("".join(c for c in t if not unicodedata.combining(c)).split())


def _bare(part: str) -> str:
    """A part in lower case without its point; very long ones by their digest."""
    t = part.rstrip(".").lower()
    return t if len(t) <= LONGEST else hashlib.md5(t.encode()).hexdigest() * 3  # longer than LONGEST, so it stays apart


def maker_parts(text: str, legal: frozenset[str]) -> list[str]:
    """The parts as written, the first part first, without legal forms."""
    t = _CAMEL.sub(" ", plain(text))
    if "," in t:  # the first part is written last
        head, _, tail = t.partition(",")
        t = f"{tail.strip()} {head}"
    return [p for p in _PART.findall(t) if p.rstrip(".").lower() not in legal]


def model_parts(text: str) -> tuple[str | None, list[str]]:
    """The catalogue code, if any, and the words beside it."""
    t = plain(text)
    m = _CODE.search(t)
    if not m:
        return None, [_bare(w) for w in _WORD.findall(t)]
    return f"{m[1].upper()}{m[2]}", [_bare(w) for w in _PART.findall(t[: m.start()] + " " + _VARIANT.sub("", t[m.end() :]))]


def leads(field: str, text: str, legal: frozenset[str] = LEGAL_FORMS) -> list[str]:
    """(first part, further part) pairs that a spelling shows, as the statistics of general words count them."""
    parts = [_bare(p) for p in maker_parts(text, legal)] if field == "Make" else model_parts(text)[1]
    return [f"{parts[0]}{_SEP}{p}" for p in dict.fromkeys(parts[1:]) if p != parts[0]] if parts else []


def atoms(field: str, text: str, general: frozenset[str], legal: frozenset[str], full: dict[str, tuple[str, ...]]) -> list[str]:
    """The evidence that a spelling shows, as (kind, a, b).

    P first and second part; V a lone first part; I first part, short second; G short first, second; A acronym, second; T initial of a
    further part; N initials of all parts; M a lone part in capitals; C a lone code; W code and word; X the words of a model
    without a code, x one of them and a number for the others.
    """
    return _maker_atoms(text, general, legal, full) if field == "Make" else _model_atoms(text, general)


def _maker_atoms(text: str, general: frozenset[str], legal: frozenset[str], full: dict[str, tuple[str, ...]]) -> list[str]:
    raw = maker_parts(text, legal)
    if not raw:
        return []
    written = [raw[0], *(p for p in raw[1:] if _bare(p) not in general)]
    f, s = _bare(written[0]), _bare(written[1]) if len(written) > 1 else ""
    out = {("T", p[0].lower(), "") for p in (*written[2:], *(p for p in raw[1:] if _bare(p) in general))}
    if 3 <= len(raw) <= LONGEST:
        out.add(("N", "".join(p[0].lower() for p in raw), ""))
    capitals = raw[0].isupper() and raw[0].isalpha()
    if not s:
        out.add(("V", f, ""))
        if capitals and KEPT <= len(f) <= SHORT:
            out.add(("M", f, ""))
    elif len(s) == 1 or written[1].endswith("."):
        out.add(("I", f, s))
    elif len(f) < KEPT and (len(f) == 1 or written[0].endswith(".")):
        out.add(("G", f, s))
    elif capitals and 2 <= len(f) < SHORT and not all(p.isupper() for p in raw):
        out.add(("A", f, s))
    else:
        out |= {("P", x, s) for x in (f, *full.get(f, ()))}
    return [_SEP.join(x) for x in sorted(out)]


def _model_atoms(text: str, general: frozenset[str]) -> list[str]:
    code, words = model_parts(text)
    if code:
        said = [w for w in dict.fromkeys(words) if w not in general] or list(dict.fromkeys(words))
        return [_SEP.join(("W", code, w)) for w in said] or [_SEP.join(("C", code, ""))]
    if not words:
        return []
    hashes = [xxhash.xxh64_intdigest(w) for w in words]
    whole = " ".join(sorted(words))
    out = [("X", whole if len(whole) <= LONGEST else hashlib.md5(whole.encode()).hexdigest(), "")]
    total = sum(hashes)
    out += [("x", w, f"{len(words)}:{(total - h) % 2**64}") for w, h in dict.fromkeys(zip(words, hashes)) if KEPT < len(w) <= LONGEST]
    return [_SEP.join(x) for x in out]


def one_slip(a: str, b: str) -> bool:
    """Equal, or one letter lost, added or changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def deletions(word: str) -> set[str]:
    """The word and what is left without one letter; words one slip apart share one of these."""
    return {word} if len(word) > LONGEST else {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def slip_keys(kind: str, a: str, b: str) -> list[str]:
    """Blocks in which a piece of evidence meets all that differ from it by a slip or by the order of its parts."""
    if kind == "P":
        keys = {f"s{a}{_SEP}{d}" for d in deletions(b)} | {f"q{min(a, b)}{_SEP}{max(a, b)}"}
        return sorted(keys | ({f"f{d}{_SEP}{b}" for d in deletions(a)} if len(a) > SHORT else set()))
    if kind == "W":
        return sorted(f"w{a}{_SEP}{d}" for d in deletions(b)) if len(b) > SHORT else []
    return sorted(f"x{b}{_SEP}{d}" for d in deletions(a)) if kind == "x" else []


def same(x: tuple[str, str, str], y: tuple[str, str, str]) -> bool:
    """Whether two pieces of evidence of one kind mean the same but for a slip or the order of the parts."""
    (kind, a, b), (other, c, d) = x, y
    if kind != other:
        return False
    if kind == "P":
        return (a == c and one_slip(b, d)) or (b == d and min(len(a), len(c)) > SHORT and one_slip(a, c)) or (a == d and b == c)
    return (a == c and one_slip(b, d)) if kind == "W" else b == d and one_slip(a, c)


def _slips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of evidence sorted by block. A block holds at most what one letter more than its key can spell."""
    now, block = None, []
    for pdf in batches:
        out: list[tuple[str, str]] = []
        for key, kind, a, b, rep in pdf[["key", "k", "a", "b", "rep"]].itertuples(index=False, name=None):
            if key != now:
                now, block = key, []
            mine = (kind, a, b)
            out += [(rep, r) for other, r in block if r != rep and same(mine, other)]
            block.append((mine, rep))
        yield pd.DataFrame(out, columns=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes but roots: the least node that each hangs together with.

    Every node keeps its least neighbour and hands it on to the others, and each hop is doubled, until all hang on roots.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    for _ in range(MAX_ROUNDS):
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        others = e.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("open"))
        x, y = low.alias("x"), low.alias("y")
        jumped = x.join(y, F.col("x.m") == F.col("y.a"), "left").select("x.a", F.coalesce("y.m", "x.m").alias("b"), F.col("y.a").isNotNull().alias("open"))
        n = checkpoint(others.unionByName(jumped).groupBy("a", "b").agg(F.max("open").alias("open")))
        e = n.select("a", "b")
        if n.filter("open").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"names still hang together anew after {MAX_ROUNDS} rounds")


def general_words(names: DataFrame, legal: frozenset[str]) -> dict[str, frozenset[str]]:
    """For each field the words that go with many different first parts, over all spellings.

    At most 1 / GENERAL_SHARE times as many words as a first part has beside it on average reach the driver.
    """
    shown = F.pandas_udf(lambda field, name: pd.Series([leads(f, n, legal) for f, n in zip(field, name)]), "array<string>")
    pairs = names.select("field_name", F.explode(shown("field_name", "name")).alias("p")).distinct().select("field_name", F.substring_index("p", _SEP, 1).alias("lead"), F.substring_index("p", _SEP, -1).alias("word"))
    of = pairs.select("field_name", "lead").distinct().groupBy("field_name").agg(F.count(F.lit(1)).alias("leads"))  # one row a field
    many = pairs.groupBy("field_name", "word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= GENERAL_LEAST)
    got = many.join(of, "field_name").filter(F.col("n") >= F.col("leads") * GENERAL_SHARE).select("field_name", "word").collect()
    return {f: frozenset(r["word"] for r in got if r["field_name"] == f) for f in ("Make", "DisplayName")}


def _key(*parts: Column | str) -> Column:
    return F.concat_ws(_SEP, *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _starts(word: Column, longest: int) -> Column:
    """The first 1 to ``longest`` letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.substring(word, F.lit(1), k)))


def _deleted(word: Column) -> Column:
    """The word and what is left without one letter, as a column."""
    less = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) > LONGEST, F.array(word)).otherwise(F.array_distinct(F.concat(F.array(word), less)))


def _no_keys() -> Column:
    return F.array().cast("array<string>")


def _with_flags(classes: DataFrame) -> DataFrame:
    """Each class's evidence beside what the class has at all."""
    k, long_first, long_word = F.col("k"), F.length("a") > SHORT, F.length("b") > SHORT
    flags = classes.groupBy("cid").agg(
        F.max(k == "P").alias("pairs"), F.max((k == "P") & long_first).alias("long"), F.max(k.isin("I", "G", "A")).alias("halves"),
        F.max(k == "W").alias("words"), F.max((k == "W") & long_word).alias("long_words"),
        F.collect_set(F.when(k == "T", F.col("a"))).alias("initials"),  # single letters
    )
    return classes.join(flags, "cid")


def _asked(c: DataFrame) -> DataFrame:
    """(cid, key): what classes ask for that show too little to stand alone."""
    k, a, b = F.col("k"), F.col("a"), F.col("b")
    lone, pairless = ~F.col("pairs") & ~F.col("halves"), ~F.col("pairs")
    key = (
        F.when((k == "V") & lone, _key("v", a)).when((k == "M") & lone, _key("m", a)).when((k == "I") & pairless, _key("i", a, b)).when((k == "G") & pairless, _key("g", a, b))
        .when((k == "A") & pairless, _key("a", a, b)).when((k == "P") & ~F.col("long"), _key("n", b, F.substring(a, 1, KEPT)))
        .when((k == "C") & ~F.col("words"), _key("c", a)).when((k == "W") & ~F.col("long_words"), _key("w", a, F.substring(b, 1, KEPT)))
    )
    return c.select("cid", key.alias("key")).filter("key IS NOT NULL")


def _offered(c: DataFrame) -> DataFrame:
    """(cid, key): what classes can be asked for."""
    k, a, b = F.col("k"), F.col("a"), F.col("b")
    acronym = lambda t: F.array(_key("a", F.concat(F.substring(a, 1, 1), t), b), _key("a", F.concat(F.substring(a, 1, 2), t), b), _key("a", F.concat(F.substring(a, 1, 1), F.substring(b, 1, 1), t), b))
    pair = F.concat(
        F.array(_key("v", a), _key("g", F.substring(a, 1, 1), b), _key("g", F.substring(a, 1, 2), b)), F.transform(_starts(b, SHORT), lambda p: _key("i", a, p)),
        F.when(F.length(a) > SHORT, F.array(_key("n", b, F.substring(a, 1, KEPT)))).otherwise(_no_keys()), F.flatten(F.transform("initials", acronym)),
    )
    word = F.concat(F.array(_key("c", a)), F.when(F.length(b) > SHORT, F.transform(_starts(b, KEPT), lambda p: _key("w", a, p))).otherwise(_no_keys()))
    keys = F.when(k == "P", pair).when(k == "I", F.array(_key("v", a))).when(k == "N", F.array(_key("m", a))).when(k == "W", word)
    return c.select("cid", F.explode(keys).alias("key"))


def _only(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """(cid, lo, hi) of the classes behind what a class asks for; pre-aggregated, so that any number may offer a key.

    Most of what is offered nobody asks for, so where the questions are few they go to the offers, and not the offers over the net.
    """
    asked = checkpoint(asked.distinct())
    wanted = small(asked.select("key").distinct(), FEW_KEYS)
    behind = offered.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"))
    return asked.join(behind, "key").groupBy("cid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _joins(found: DataFrame) -> DataFrame:
    return found.filter("lo = hi AND lo <> cid").select(F.col("cid").alias("a"), F.col("lo").alias("b"))


def rematch(classes: DataFrame) -> DataFrame:
    """(a, b): classes that join the only one which offers what they ask for."""
    return _joins(_only(_asked(classes), _offered(classes)))


def rematch_loosely(classes: DataFrame) -> DataFrame:
    """The same for lone parts, short first parts and short words that are still apart, allowing for a slip in them."""
    c, k, a, b = classes, F.col("k"), F.col("a"), F.col("b")
    lone = (k == "V") & ~F.col("pairs") & ~F.col("halves")
    short, few = (k == "P") & ~F.col("long"), (k == "W") & ~F.col("long_words")
    keys = (
        F.when(k.isin("V", "P", "I") & (F.length(a) >= LONE), F.transform(_deleted(a), lambda d: _key("v", d))).otherwise(_no_keys()),
        F.when(k == "P", F.concat(F.array(_key("n", b, F.substring(a, 1, KEPT))), F.transform(_deleted(a), lambda d: _key("s", b, d)))).otherwise(_no_keys()),
        F.when(k == "W", F.transform(_deleted(F.substring(b, 1, KEPT)), lambda d: _key("w", F.col("a"), d))).otherwise(_no_keys()),
    )
    asks = c.select("cid", F.explode(F.concat(F.when(lone, keys[0]).otherwise(_no_keys()), F.when(short, keys[1]).otherwise(_no_keys()), F.when(few, keys[2]).otherwise(_no_keys()))).alias("key")).distinct()
    rich = c.select("cid", F.explode(F.concat(F.when(lone, _no_keys()).otherwise(keys[0]), F.when(short, _no_keys()).otherwise(keys[1]), F.when(few, _no_keys()).otherwise(keys[2]))).alias("key"))
    # those who ask the same differ from each other in a letter or an ending, so a key has few of them
    x, y = asks.alias("x"), asks.alias("y")
    each_other = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.cid") != F.col("y.cid"))).groupBy("x.cid").agg(F.min("y.cid").alias("lo"), F.max("y.cid").alias("hi"))
    return _joins(_only(asks, rich).unionByName(each_other).groupBy("cid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))


def resolve(rows: DataFrame, maker_col: str = "Make", model_col: str = "DisplayName", nicknames: dict[str, str] | None = None, legal_forms: frozenset[str] | None = None) -> DataFrame:
    """(field_name, name, class): every distinct spelling with the class it belongs to (the class's smallest spelling).

    ``nicknames``: full given name -> its short forms, separated by blanks.
    """
    legal = LEGAL_FORMS if legal_forms is None else legal_forms
    full: dict[str, tuple[str, ...]] = {}
    for name, short in (NICKNAMES if nicknames is None else nicknames).items():
        for s in short.split():
            full[s] = (*full.get(s, ()), name)
    both = F.explode(F.array(F.struct(F.lit("Make").alias("field_name"), F.col(maker_col).alias("name")), F.struct(F.lit("DisplayName").alias("field_name"), F.col(model_col).alias("name"))))
    names = rows.select(both.alias("n")).select("n.*").filter("name IS NOT NULL").distinct()
    # the record's id holds the field, so that fields never mix; long names go by their digest
    brief = F.when(F.length("name") <= LONGEST, F.concat(F.lit("="), "name")).otherwise(F.concat(F.lit("#"), F.sha2("name", 256)))
    names = checkpoint(names.withColumn("id", F.concat(F.substring("field_name", 1, 1), brief)))
    general = general_words(names, legal)

    extract = F.pandas_udf(lambda field, name: pd.Series([atoms(f, n, general[f], legal, full) for f, n in zip(field, name)]), "array<string>")
    part = F.split(F.col("x"), _SEP)
    shown = checkpoint(names.select("id", F.explode(extract("field_name", "name")).alias("x")).select("id", part[0].alias("k"), part[1].alias("a"), part[2].alias("b")))

    # what shows the same belongs together, and what differs by a slip
    distinct = checkpoint(shown.filter(~F.col("k").isin("T", "N", "M")).groupBy("k", "a", "b").agg(F.min("id").alias("rep")))
    equal = shown.join(distinct, ["k", "a", "b"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    blocks = F.pandas_udf(lambda k, a, b: pd.Series([[xxhash.xxh64_intdigest(x) - 2**63 for x in slip_keys(*v)] for v in zip(k, a, b)]), "array<bigint>")
    keyed = distinct.filter(F.col("k").isin("P", "W", "x")).withColumn("key", F.explode(blocks("k", "a", "b")))
    slips = keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_slips, "a string, b string")
    labels = components(checkpoint(equal.unionByName(slips)))

    members = names.select("id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cid"))
    classes = checkpoint(_with_flags(shown.filter("k NOT IN ('X', 'x')").join(members, "id").select("cid", "k", "a", "b").distinct()))
    for _ in range(MAX_ROUNDS):
        joined = checkpoint(rematch(classes))
        if joined.isEmpty():
            joined = checkpoint(rematch_loosely(classes))
            if joined.isEmpty():
                break
        moved = components(joined).select(F.col("node").alias("cid"), "root")
        members = members.join(moved, "cid", "left").select("id", F.coalesce("root", "cid").alias("cid"))
        classes = checkpoint(_with_flags(classes.join(moved, "cid", "left").select(F.coalesce("root", "cid").alias("cid"), "k", "a", "b").distinct()))
    else:
        raise RuntimeError(f"names still merge after {MAX_ROUNDS} rounds")
    out = names.join(members, "id").select("field_name", "name", "cid")
    least = out.groupBy("cid").agg(F.min("name").alias("class"))
    return out.join(least, "cid").select("field_name", "name", "class")


def class_sizes(classes: DataFrame) -> DataFrame:
    """(field_name, name, class, n_spellings): the links in linear size, one row a spelling."""
    return classes.join(classes.groupBy("field_name", "class").agg(F.count(F.lit(1)).alias("n_spellings")), ["field_name", "class"])


def linked_pairs(classes: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(field_name, name_a, name_b), name_a < name_b: the pairs within each class of spellings.

    A class's members are dealt to blocks and paired block by block, so that one large class is spread over many tasks.
    """
    sized = class_sizes(classes).withColumn("blocks", F.ceil(F.col("n_spellings") / block).cast("int")).filter("n_spellings > 1")
    sized = sized.withColumn("mine", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = sized.withColumn("theirs", every).select("field_name", "class", F.col("mine").alias("i"), F.col("theirs").alias("j"), F.col("name").alias("name_a"))
    b = sized.withColumn("theirs", every).select("field_name", "class", F.col("theirs").alias("i"), F.col("mine").alias("j"), F.col("name").alias("name_b"))
    return a.join(b, ["field_name", "class", "i", "j"]).filter("name_a < name_b").select("field_name", "name_a", "name_b")
