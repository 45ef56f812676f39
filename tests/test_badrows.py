import csv
import io

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tundra.operators import badrows as B

GOOD = ["M", "X 1", "D", "", "E", "", "", "10", "EUR", "2000", "1.5", "kWh/day", "", "50%", " 7 ", "1000000000", "Std", "C", "", "", "", "", "fine"]


def line(**change):
    cells = [change.get(c, v) for c, v in zip(B.COLUMNS, GOOD)]
    return ",".join('"' + c.replace('"', '""') + '"' if c else "" for c in cells)


@pytest.mark.parametrize("text,reason", [
    (line(), None), (line() + "\r", None), (line().replace('"fine"', '"fine'), "quoting"), (line().replace('"fine"', 'fi"ne'), "quoting"), (line().replace('"fine"', '"fi"ne'), "quoting"),
    (line().replace('"fine"', ' "fine"'), "quoting"), (line() + ",", "columns"), ("a,b", "columns"), (line(Name="  "), "value"), (line(Notes="a\tb"), "value"), (line(Model="�"), "value"),
    (line(Notes="a\nb"), "value"), (line(DisplayName="a\nb"), None), (line(BaseCost="1,5"), "value"), (line(BaseCost="1e5"), None), (line(BaseCost="1.0d"), "value"), (line(BaseCost="nan"), "value"), (line(BaseCost="+.5%"), None),
    (line(BaseCostYear="2000.0"), "value"), (line(BaseCostYear=" 2000 "), None), (line(cooler="--"), "value"), (line(Notes='say ""hi""'), None), (line(Notes="x" * 500_000), None),
])
def test_reasons(text, reason):
    assert B.parse_line(text)[1] == reason


def test_no_records():
    head = ",".join(f'"{c}"' for c in B.COLUMNS)
    assert [B.parse_line(x) for x in (None, "", "   ", "\r", " \r", head, "﻿" + head, head.lower() + "\r")] == [None] * 8


def test_frame(spark):
    df = spark.createDataFrame([(1, line(), "r"), (2, "a,b", None), (2, "a,b", None), (3, None, ""), (None, line(), "")], "line_id bigint, line string, reason string")
    assert rows(B.rejected(df)) == [(2, "columns"), (2, "columns")]
    good = B.loaded(df).collect()
    assert len(good) == 1 and good[0].freezer == 0.5 and good[0].cooler == 7.0 and good[0].roomtemperature == 1000000000 and good[0].BaseCostYear == 2000 and good[0].AlarmDays is None
    assert B.rejected(df.limit(0)).count() == 0 and B.loaded(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_characters="\r\n\x00", blacklist_categories=("Cs",)), max_size=8), min_size=1, max_size=6))
def test_written_records_split_back(fields):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    assert B.split_record(out.getvalue()) == fields


@pytest.mark.parametrize("text,outside,inside", [
    ("", "closed", "open"), ('a,"b"', "closed", "fault"), ('a,"b', "open", "fault"), ('b",c', "fault", "closed"), ('"a""b"', "closed", "fault"), ('a"b', "fault", "fault"), ('"a"b', "fault", "fault"), ('x","y', "fault", "open"), ('","', "closed", "open"), ('""', "closed", "open"),
])
def test_follow(text, outside, inside):
    assert (B.follow(text), B.follow(text, True)) == (outside, inside)


@settings(max_examples=300, deadline=None)
@given(st.text('",a\n', max_size=12))
def test_follow_agrees_with_the_grammar(text):
    import re

    sound = re.fullmatch(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', text) is not None
    assert (B.follow(text) == B.CLOSED) == sound
    if sound:
        want = re.findall(r'(?:^|,)("(?:[^"]|"")*"|[^",]*)', text)
        assert B.split_record(text) == [f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in want]


@pytest.mark.parametrize("slice_", [3, 100_000])
def test_assemble(spark, monkeypatch, slice_):
    """Records that span lines, however many; a stray quote spoils its own line only."""
    monkeypatch.setattr(B, "SLICE", slice_)
    f = ["1,2", 'a,"b', 'c ""d""', '",e"', "3,4", 'a,"b', 'c ""d""', '"', "plain", 'x,"open', "5,6", 'tail"', '"never', *["tail"] * 20, "7,8"]
    long = ['1,"a', *["tail"] * 40, 'b"', "9,9"]
    g = ['x"y', "1,2", 'x"y', '1,"2', '3","', '4",5']
    texts = {"f": f, "g": g, "h": long, "i": ["1,2"], "j": ['"a', None, '",b']}
    df = spark.createDataFrame([(n, i, t) for n, ts in texts.items() for i, t in enumerate(ts)], "file string, n int, line string").repartition(3)
    got = {n: [(i, k, t) for m, i, k, t in sorted(map(tuple, B.assemble(df, "file", "n", "line", 2).collect())) if m == n] for n in texts}
    joined = [(5, 3, 'a,"b\nc ""d""\n"')]
    alone = [(i, 1, t) for i, t in enumerate(f) if i not in (5, 6, 7)]
    assert got["f"] == sorted(alone + joined)
    assert got["g"] == [(0, 1, 'x"y'), (1, 1, "1,2"), (2, 1, 'x"y'), (3, 3, '1,"2\n3","\n4",5')] and got["i"] == [(0, 1, "1,2")]
    assert got["h"] == [(0, 42, "\n".join(long[:-1])), (42, 1, "9,9")] and got["j"] == [(0, 3, '"a\n\n",b')]
    assert B.assemble(df.limit(0), "file", "n", "line").count() == 0


def test_good_lines_after_a_broken_one_load(spark):
    df = spark.createDataFrame([("f", 1, line()), ("f", 2, line().replace('"fine"', '"fi')), ("f", 3, line()), ("f", 4, line(Make="two\nlines").split("\n")[0]), ("f", 5, line(Make="two\nlines").split("\n")[1]), ("f", 6, line())], "file string, n int, line string")
    got = B.parse_records(B.assemble(df, "file", "n", "line"), "n", "line")
    assert rows(got, "line_id", "reason", "Make") == sorted([(1, None, "M"), (2, "quoting", None), (3, None, "M"), (4, None, "two\nlines"), (6, None, "M")], key=repr)
