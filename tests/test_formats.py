import gzip
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tundra.functions import casts
from tundra.sources import csvtext, files, kvp, ogr, packed, yamlfiles


@pytest.mark.parametrize("line,want", [
    ("# This is a pure comment", None), ("    # so is this   ", None), ("foo", ("foo", True)), ("bar # my comment", ("bar", True)), ("thing=124", ("thing", 124)), ("thing2 =-123", ("thing2", -123)),
    ("thing3= +123", ("thing3", 123)), ('thing4 = "foo"', ("thing4", "foo")), ("lthing = 12,34;56:'foo' # a list", ("lthing", [12, 34, 56, "foo"])),
    ("other='hello',12,'and \"more\" stuff'\t# comment", ("other", ["hello", 12, 'and "more" stuff'])), ("thing5=-17.2", ("thing5", -17.2)), ("thing6= 18.27", ("thing6", 18.27)), ("thing8=+19.3", ("thing8", 19.3)),
    ("thing9=+.8", ("thing9", 0.8)), ("thing10=.82", ("thing10", 0.82)), ("thing11=7.", ("thing11", 7.0)), ("thing12=+8.", ("thing12", 8.0)), ("lthing2= 0.8e3,7.e3,-4.2E-03", ("lthing2", [800.0, 7000.0, -0.0042])),
    ("thing13='quoted string with an 0.8 embedded float'", ("thing13", "quoted string with an 0.8 embedded float")), ("somebool= True", ("somebool", True)), ("somebool= false", ("somebool", False)),
    ("something= None", ("something", None)), ('utf8sample= "Dépôt Central*"', ("utf8sample", "Dépôt Central*")), ("x=''", ("x", True)), ("a=1,", ("a", [1])), ("k =", ("k", True)), ("", None), ("   \n", None),
])
def test_kvp(line, want):
    assert kvp.parse_line(line) == want


@pytest.mark.parametrize("line", ["someidentifier,", "a=1, 2", "a=1e5", " a=1", "=1", "a=b=c", "a=,1", "a='open"])
def test_kvp_errors(line):
    with pytest.raises(kvp.Unreadable):
        kvp.parse_line(line)


def test_kvp_frames(spark):
    df = spark.createDataFrame([("d", 1, "a = 1"), ("d", 2, 'a = "x",\'say "hi"\',2'), ("d", 3, "b"), ("d", 4, None), ("e", 1, "c = none")], "doc_id string, seq int, line string")
    doc = kvp.parse_documents(df)
    assert rows(doc) == [("d", "a", "list", '["x", "say \\"hi\\"", 2]'), ("d", "b", "bool", "true"), ("e", "c", "null", "null")]
    lines = rows(kvp.write_lines(doc), "line")
    assert lines == sorted([('a = "x",\'say "hi"\',2',), ("b = True",), ("c = None",)], key=repr)
    bad = df.unionByName(spark.createDataFrame([("f", 1, "someidentifier,")], df.schema))
    assert "Failed to parse <someidentifier,>" in [r.error for r in kvp.parse_lines(bad).collect()]
    with pytest.raises(Exception, match="Failed to parse"):
        kvp.parse_documents(bad).collect()
    assert kvp.parse_documents(df.limit(0)).count() == 0


def test_csv_cells(spark):
    def kinds(cells, quoted):
        df = spark.createDataFrame([(c,) for c in cells], "c string").select("c", csvtext.infer_cell(F.col("c"), quoted).alias("x"))
        return {r.c: tuple(v for v in r.x if v is not None) for r in df.collect()}

    got = kinds(['"12"', "12", "12.5", "1e5", "1.0d", "0x1p3", "", "'x'", "99999999999999999999"], True)
    assert got == {'"12"': ("str", "12"), "12": ("int", 12), "12.5": ("float", 12.5), "1e5": ("float", 1e5), "1.0d": ("str", "1.0d"), "0x1p3": ("str", "0x1p3"), "": ("str", ""), "'x'": ("str", "'x'"), "99999999999999999999": ("str", "99999999999999999999")}
    got = kinds(['"12"', "50%", "x%", "inf"], False)
    assert got['"12"'] == ("str", '"12"') and got["50%"] == ("pct", 0.5) and got["x%"] == ("str", "x%") and got["inf"] == ("float", float("inf"))


@pytest.mark.parametrize("delim", [",", ";", "\t", " "])
def test_csv_files(spark, tmp_path, delim):
    p = tmp_path / "t.csv"
    text = delim.join(['"Name"', '"n"', '"x"']) + "\n" + delim.join(['"a"', "1", "2.5"]) + "\n\n" + delim.join(['"b"', "3", "4"]) + "\n"
    p.write_bytes(gzip.compress(("﻿" + text).encode("utf-8")))
    got = csvtext.read_csv(spark, str(p))
    assert rows(got) == [("a", 1, 2.5), ("b", 3, 4.0)] and csvtext.read_header(spark, str(p)) == ["Name", "n", "x"]
    assert csvtext.read_csv(spark, got) is got
    out = tmp_path / "out"
    csvtext.write_csv(got, str(out), quote=True, sort="Name")
    assert rows(csvtext.read_csv(spark, str(out / "*.txt"))) == rows(got)


def test_csv_write_forms(spark):
    df = spark.createDataFrame([("b", 1e10, True, 1), ("A", None, None, None), ('"q"', 1.5e-5, False, 2), ("c", 0.1, True, 3)], "s string, f double, t boolean, i int")
    lines = [r.line for r in csvtext.render_rows(df, ["s", "f", "t", "i"], quote=True, sort="s").orderBy("line_no").collect()]
    assert lines == ['"s","f","t","i"', '"q",1.5e-05,0,2', '"A","NA","NA","NA"', '"b",10000000000.0,1,1', '"c",0.1,1,3']
    with pytest.raises(Exception, match="cells expected"):
        csvtext.parse_cells(spark.createDataFrame([("1,2,3",)], "line string"), "a,b", ",").collect()
    with pytest.raises(ValueError):
        csvtext.sniff(spark.createDataFrame([("x",)], "line string"), "one")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("x\r\ny".encode("utf-16"))
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    got = {r.path[-5:] + str(r.line_no): r.line for r in files.read_lines(spark, str(tmp_path), glob="*.txt").collect()}
    assert got == {"a.txt0": "x", "a.txt1": "y", "b.txt0": "café"}
    assert files.output_encoding("UTF8") == "utf-8" and files.output_encoding("cp65001") == "utf-8"


def test_detect():
    assert files.detect("\ufeffx".encode())[1] == files.detect(b"plain")[1] == 1.0 and files.detect("x y z w".encode("utf-16-le"))[0] == "utf-16-le"
    name, sure = files.detect("Dépôt Central, façade".encode())
    assert name == "utf-8" and sure >= files.SURE
    name, sure = files.detect("Dépôt – œuvre".encode("cp1252"))
    assert name == "cp1252" and sure >= files.SURE and files.decode("Dépôt – œuvre".encode("cp1252")) == "Dépôt – œuvre"
    assert files.detect(b"\x01\x81\x8d\x8f\x90")[1] < files.SURE and files.decode(b"a\xff", "utf-8") == "a\ufffd"


def test_split_lines(spark, tmp_path):
    """A folder of plain, Latin and packed files as one table; splits of a file keep every line once."""
    (tmp_path / "a.csv").write_bytes("name,n\ncafé,1\n".encode())
    (tmp_path / "b.csv").write_bytes("name,n\ncaf\u00e9 – œ,2\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(gzip.compress(b"name,n\nx,3\n"))
    (tmp_path / "d.csv").write_text("name,n\n" + "".join(f"row{i},{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = csvtext.read_csv(spark, str(tmp_path))
        assert got.dtypes == [("name", "string"), ("n", "bigint")] and got.count() == 5003
        assert sorted(map(tuple, got.filter("name NOT LIKE 'row%'").collect())) == [("café", 1), ("café – œ", 2), ("x", 3)]
        assert csvtext.read_header(spark, str(tmp_path)) == ["name", "n"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("line,delim,want", [
    ('a, "b,c" ,d', ",", ["a", '"b,c"', "d"]), ("a,b,", ",", ["a", "b", ""]), ("", ",", [""]), ('"it""s, ok",x', ",", ['"it""s', 'ok"', "x"]), ("'a;b';c", ";", ["'a;b'", "c"]), ('"a,b"x,c', ",", ['"a', 'b"x', "c"]),
    ('a"b\tc', "\t", []), ('"a\tb"\tc', "\t", ['"a\tb"', "c"]), (" x  y\tz ", None, ["x", "y", "z"]), ('"open,a', ",", ['"open', "a"]),
])
def test_split_line(line, delim, want):
    assert csvtext.split_line(line, delim) == want


def test_simplify_of_deep_and_odd_records():
    deep = 5
    for _ in range(20_000):
        deep = {"a": deep}
    got = yamlfiles.simplify(deep)
    for _ in range(20_000):
        got = got["a"]
    assert got == 5
    assert yamlfiles.simplify({"a": [{"category": "x"}, {"category": "y", "count": {"value": [1]}}], "b": [[{"category": "q", "count": 1}]], "c": {}, "e": []}) == {"ay": [1], "b": [[{"category": "q", "count": 1}]], "c": {}}


def test_yaml(spark, tmp_path):
    rec = {"name": "A", "name_prov": "src", "size": {"value": 3, "prov": "p"}, "inv": [{"category": "X", "count": 2}, 5]}
    assert yamlfiles.simplify(rec) == {"name": "A", "size": 3, "invX": 2, "inv": [5]}
    (tmp_path / "a.yaml").write_text("name: A\nb: !!python/unicode 'x'\nsize: {value: 3}\n")
    (tmp_path / "b.yaml").write_text("- 1\n")
    got = yamlfiles.read_folder(spark, str(tmp_path), simplified=True)
    ok = got.filter("error IS NULL").head()
    assert ok["keys"] == ["name", "b", "size"] and json.loads(ok.record) == {"name": "A", "b": "x", "size": 3} and got.filter("error IS NOT NULL").count() == 1
    assert yamlfiles.key_union(got) == ["b", "name", "size"]
    recs = spark.createDataFrame([(1, '{"z": 1, "name": "q", "abbrev": "one"}'), (2, '{"name": "r"}'), (3, '{"abbrev": ""}')], "id int, record string")
    yamlfiles.save_folder(recs, str(tmp_path / "out"), "id")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["none0.yaml", "none1.yaml", "one.yaml"]
    assert (tmp_path / "out" / "one.yaml").read_text() == "---\nname: q\nabbrev: one\nz: 1\n"
    assert rows(yamlfiles.simplify_json(spark.createDataFrame([(1, "{x", 0), (2, None, 0)], "rec_id bigint, doc string, id int"), "rec_id", "doc")) == [(1, None), (2, None)]


def test_ogr(spark, tmp_path):
    text = "INFO\nLayer OGRFeature x\nOGRFeature(a):1\n  NAME (String) = one\n  ODD (a) (b) = x\n  BAD = a = b\n  POLYGON ((0 0,4 0,4 4,0 0),(1 1,2 1,1 2,1 1))\n\nOGRFeature(a):2\n  NAME (String) = two\n  MULTIPOLYGON (((0 0,1 0,1 1)),((5 5,6 5,6 6)))\n"
    (tmp_path / "s.txt").write_bytes(gzip.compress(text.encode()))
    got = ogr.read_shapes(spark, str(tmp_path), discard_inner=False).orderBy("place").collect()
    assert got[0].attrs == {"NAME": "one", "ODD (a) (b)": "x"} and [len(r) for r in got[0].polygons[0]] == [4, 4] and len(got[1].polygons) == 2
    assert tuple(got[1].polygons[1][0][2]) == (6.0, 6.0)
    assert [len(r.polygons[0]) for r in ogr.read_shapes(spark, str(tmp_path)).collect()] == [1, 1]
    bad = spark.createDataFrame([("OGRFeature(x)\n a = 1\n",), (None,)], "text string")
    assert ogr.parse_features(bad, strict=False).count() == 0
    with pytest.raises(Exception, match="geometry"):
        ogr.parse_features(bad).collect()


def test_packed(spark):
    data = [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.5]]
    df = spark.createDataFrame([(data,), ([],)], "r array<array<double>>")
    got = df.select(packed.unpack(packed.pack(F.col("r")), 4).alias("a"), packed.unpack_named(packed.pack_named(F.col("r"), ["foo", "bar", "bäz", "qux"])).alias("b")).collect()
    assert got[0].a == data and got[0].b.rows == data and got[0].b.names == ["foo", "bar", "bäz", "qux"] and got[1].a == []
    with pytest.raises(ValueError):
        packed.unpack_rows(b"12345678", 3)


def test_casts(spark):
    s = F.col("s")
    df = spark.createDataFrame([(x,) for x in ("7", "", None, "abc", "-1", "0", "t", "TRUE", "f", "False", "3", "NaN", "1.5", "1.0d", "NA", "99999999999999999999")], "s string")
    val = lambda *chain: {r.s: r.v for r in df.select("s", casts.cast_value(s, list(chain), strict=False).alias("v")).collect()}
    b = val("BOOLEAN")
    assert [b[x] for x in ("t", "TRUE", "3", "abc", "NaN")] == [1] * 5 and [b[x] for x in ("f", "False", "0", "", None)] == [0] * 5
    assert val("POSITIVE_INT")["0"] is None and val("NONNEGATIVE_INT")["0"] == 0 and val("NONNEGATIVE_INT")["-1"] is None
    assert val("FLOAT")["1.0d"] is None and val("FLOAT")["1.5"] == 1.5
    assert int(val("LONG")["99999999999999999999"]) == 99999999999999999999 and val("INT")["99999999999999999999"] is None
    assert val("EMPTY_IS_ZERO", "INT")[""] == 0 and val("EMPTY_IS_NULL_STRING")[None] == "" and val("NA")["NA"] == "NA" and val("EMPTY_IS_NONE", "INT")[""] is None
    ok = {r.s: r.v for r in df.select("s", casts.cast_ok(s, ["EMPTY_IS_NONE", "INT"]).alias("v")).collect()}
    assert ok[""] and ok["7"] and not ok["abc"]
    with pytest.raises(Exception, match="line 5 of f.csv"):
        casts.cast_column(spark.createDataFrame([("abc", 5)], "x string, n int"), "x", ["INT"], "n", "f.csv").collect()
    with pytest.raises(Exception, match="cannot cast"):
        df.filter("s = 'abc'").select(casts.safe_float([s], 0.0, "zz")).collect()
    assert df.filter("s = 'abc'").select(casts.safe_float([s], 4.0).alias("v")).head().v == 4.0


def test_data_sources(spark, tmp_path):
    from tundra.sources import register

    register.register(spark)
    for d in ("kvp", "yaml", "ogr", "csv"):
        (tmp_path / d).mkdir()
    (tmp_path / "kvp" / "a.kvp").write_text("a = 1\n# c\nb,\n")
    (tmp_path / "yaml" / "a.yaml").write_text("size: {value: 3}\n")
    (tmp_path / "yaml" / "b.txt").write_text("x")
    (tmp_path / "ogr" / "s.gz.txt").write_bytes(gzip.compress(b"top\nOGRFeature(a):1\n  N (String) = x\n  POLYGON ((0 0,1 0,1 1))\n"))
    (tmp_path / "csv" / "a.csv").write_text('"n";"s"\n1;"x"\n\n')
    (tmp_path / "csv" / "b.csv").write_text('"n";"s"\n2;"y"\n')
    load = lambda f, d, **o: spark.read.format(f).options(**o).load(str(tmp_path / d))
    assert rows(load("kvp", "kvp"), "key", "value", "error") == sorted([("a", "1", None), (None, None, "Failed to parse <b,>")], key=repr)
    assert rows(load("yaml_records", "yaml", simplified="true"), "record") == [('{"size": 3}',)]
    o = load("ogr_listing", "ogr").select(ogr.attributes(F.col("feature"))["N"].alias("n"), F.size(ogr.rings(F.element_at(ogr.geometry_lines(F.col("feature")), 1))).alias("p"))
    assert rows(o) == [("x", 1)]
    assert rows(load("loose_csv", "csv")) == [("1", "x"), ("2", "y")] and load("loose_csv", "csv").columns == ["n", "s"]
