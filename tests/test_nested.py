import json

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tundra.operators import nested as N

labels = st.one_of(st.none(), st.sampled_from(["pump", "fan", ""]), st.integers(0, 3), st.booleans())
keys = st.sampled_from(["a", "b", "value", "category", "prov", "x_prov", "list"])
trees = st.recursive(labels, lambda t: st.one_of(st.lists(t, max_size=3), st.dictionaries(keys, t, max_size=4)), max_leaves=25)


def plain(rec):
    """The same by direct recursion."""
    out = []

    def label(v):
        if v is None:
            return []
        if isinstance(v, dict):
            return label(v.get("value"))
        if isinstance(v, list):
            return [y for x in v for y in label(x)]
        return [v if isinstance(v, str) else json.dumps(v)]

    def go(v, path, parent):
        if isinstance(v, dict):
            own = label(v.get("category")) if path else []
            here = "/".join(path)
            out.extend((here, parent, x) for x in own)
            for k, x in v.items():
                go(x, [*path, k], here if own else parent)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                go(x, [*path, str(i)], parent)

    go(rec, [], "")
    return out


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(keys, trees, max_size=4))
def test_levels_give_the_objects_back(tree):
    rec = N.clean(tree)
    assert sorted(N.labelled_objects(rec)) == sorted(plain(rec))


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(keys, trees, max_size=4))
def test_every_leaf_comes_back_in_place(tree):
    rec = N.clean(tree)
    want = []

    def go(v, path):
        if isinstance(v, dict):
            for k, x in v.items():
                go(x, (*path, k))
        elif isinstance(v, list):
            for i, x in enumerate(v):
                go(x, (*path, i))
        elif v is not None:
            want.append((path, v))

    go(rec, ())
    got = [leaf for path, entries in N.stripe(rec).items() for leaf in N.positions(path, entries)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_frame(spark):
    deep = {"category": "z"}
    for _ in range(400):
        deep = {"k": [deep]}
    docs = [
        (1, json.dumps({"category": "root", "a": [{"category": {"value": "pump", "prov": "x"}, "b": json.dumps({"category": ["p", None, {"value": 2}]})}]}), "c"),
        (2, "{broken", None), (3, None, None), (4, "[1]", None), (5, '{"a": {}}', None), (6, json.dumps({"x_prov": {"category": "no"}, "a": {"category": None, "b": {"category": "yes"}}}), None),
        (7, json.dumps(deep), None), (None, '{"a": {"category": "x"}}', None),
    ]
    df = spark.createDataFrame(docs, "rec_id bigint, doc string, category string")
    got = rows(N.objects_table(df))
    assert [r for r in got if r[0] == 1] == [(1, "a/0", "", "pump"), (1, "a/0/b", "a/0", "2"), (1, "a/0/b", "a/0", "p")]
    assert [r for r in got if r[0] == 6] == [(6, "a/b", "", "yes")]
    assert len([r for r in got if r[0] == 7]) == 1 and {r[0] for r in got} == {1, 6, 7}
    assert N.objects_table(df.limit(0)).count() == 0
    assert N.values_table(df.filter("rec_id = 6")).count() == 1
    levels = rows(N.leaf_levels(df.filter("rec_id = 1")), "column_path", "entry", "rep_level", "def_level", "value")
    assert ("a/[]/b/category/[]", 0, 0, 5, "p") in levels or any(x[0].startswith("a/[]/b/category") for x in levels)


def test_very_deep_records(spark):
    deep = '{"k": [' * 30_000 + '{"category": "z", "n": [1, {"value": null}]}' + "]}" * 30_000
    text = "[" * 5000 + "]" * 5000
    docs = [(1, deep), (2, json.dumps({"a": {"category": "y", "b": text}})), (3, deep[:-1]), (4, None), (5, "[1]"), (6, "{x")]
    df = spark.createDataFrame(docs, "rec_id bigint, doc string")
    got = rows(N.objects_table(df))
    assert got[0][0] == 1 and got[0][1] == "/".join(["k", "0"] * 30_000) and got[0][3] == "z" and got[1:] == [(2, "a", "", "y")]
    assert rows(N.record_status(df)) == [(1, "whole"), (2, "whole"), (3, "broken"), (4, "null"), (5, "no object"), (6, "broken")]


@settings(max_examples=200, deadline=None)
@given(trees)
def test_json_by_stack(tree):
    from tundra.functions import jsontext

    assert jsontext._by_stack(json.dumps(tree)) == tree and jsontext._by_stack(json.dumps(tree, indent=1)) == tree


def test_broken_json_by_stack():
    import pytest

    from tundra.functions import jsontext

    for text in ("", "{", "[1,]", "{1: 2}", '{"a" 1}', "[1 2]", "[]]", '{"a":}', '{"a": 1,}', "[tru]", '"open', "1 2", "}"):
        with pytest.raises(ValueError):
            jsontext._by_stack(text)
    x = 1
    for _ in range(20_000):
        x = [{"é": x}]
    assert jsontext.loads(jsontext.dumps(x)) is not None and jsontext.dumps(x).startswith('[{"é": [{')
