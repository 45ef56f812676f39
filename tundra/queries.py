"""Registry of the core queries and of the SQL they are compared with.

Every query runs over its whole tables. Doubles are rounded in both forms, as sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bitset, casts, mercator, polygon, records, softmax
from .operators import accum, badrows, boxes, hierarchy, histogram, kvstore, nested, notes, spatial, timed, tracts, units
from .plans.runtime import shared_path, ship_package, spread, table
from .sources import csvtext, kvp, ogr, packed, register, yamlfiles
from .streaming import ledger as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; workers get the package before it runs."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, root: str) -> DataFrame:
            ship_package(spark)
            return f(spark, root)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; -0.0 becomes 0.0."""
    return df.select([(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


# ---------------------------------------------------------------- problems 1, 2, 4, 5


def _equipment(spark, d):
    cols = ("row_id", "Energy", "PowerRate", "PowerRateUnits", "BaseCost", "BaseCostCur", "BaseCostYear", "Notes")
    return spread(table(spark, d, "test_csv_input").select(*cols))


@query("p1_found")
def p1_found(spark, d):
    return units.misrecorded(_equipment(spark, d), table(spark, d, "cost_rate"))


@query("p1_normalized")
def p1_normalized(spark, d):
    return units.normalize(_equipment(spark, d), table(spark, d, "cost_rate"))


_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_PLAIN_NUMBER = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*%?)?\s*$"


def _bad_lines_sql() -> str:
    at = {c: i + 1 for i, c in enumerate(badrows.COLUMNS)}
    value = lambda c: f"CASE WHEN f[{at[c]}][1] = '\"' THEN replace(f[{at[c]}][2:-2], '\"\"', '\"') ELSE f[{at[c]}] END"
    numbers = " OR ".join(f"NOT regexp_matches({value(c)}, '{_PLAIN_NUMBER}')" for c in badrows.NUMERIC if c not in badrows.YEARS)
    years = " OR ".join(f"NOT regexp_matches({value(c)}, '^\\s*[0-9]*\\s*$')" for c in badrows.YEARS)
    texts = " OR ".join(f"regexp_matches({value(c)}, '[\\x00-\\x1f\\x{{FFFD}}]')" for c in badrows.CLEAN_TEXT)
    names = ",".join(badrows.COLUMNS)
    return f"""WITH l AS (SELECT line_id, regexp_replace(line, '\\r$', '') AS t FROM csv_line WHERE line IS NOT NULL), s AS (SELECT line_id, t, regexp_full_match(t, '{_FIELD}(?:,{_FIELD})*') AS sound FROM l WHERE trim(t, chr(9) || ' ' || chr(65279)) <> ''),
    p AS (SELECT line_id, sound, ltrim(t, chr(65279)) AS t, list_transform(regexp_extract_all(',' || t, ',({_FIELD})', 1), lambda x: x) AS f FROM s)
    SELECT line_id, reason FROM (SELECT line_id, t, CASE WHEN NOT sound THEN 'quoting' WHEN len(f) <> 23 THEN 'columns' WHEN trim({value('Name')}) = '' OR {texts} OR {numbers} OR {years} THEN 'value' END AS reason FROM p)
    WHERE reason IS NOT NULL AND replace(lower(t), '"', '') <> lower('{names}')"""


@query("p2_found", _bad_lines_sql())
def p2_found(spark, d):
    return badrows.rejected(spread(table(spark, d, "csv_line").select("line_id", "line")))


def _loaded_sql() -> str:
    at = {c: i + 1 for i, c in enumerate(badrows.COLUMNS)}
    raw = lambda c: f"CASE WHEN f[{at[c]}][1] = '\"' THEN replace(f[{at[c]}][2:-2], '\"\"', '\"') ELSE f[{at[c]}] END"

    def typed(c: str) -> str:
        if c not in badrows.NUMERIC:
            return raw(c)
        t = f"trim({raw(c)})"
        number = f"CASE WHEN {t} = '' THEN NULL WHEN {t} LIKE '%\\%' ESCAPE '\\' THEN 0.01::DOUBLE * CAST(ltrim(trim({t}[:-2]), '+') AS DOUBLE) ELSE CAST(ltrim({t}, '+') AS DOUBLE) END"
        return f"TRY_CAST(trunc({number}) AS {badrows.INTEGER[c]})" if c in badrows.INTEGER else number

    bad = _bad_lines_sql()
    sound = bad[: bad.index("SELECT line_id, reason FROM (")]
    rest = f"g AS (SELECT p.line_id, f FROM p WHERE sound AND line_id NOT IN (SELECT line_id FROM ({bad})) AND replace(lower(t), '\"', '') <> lower('{','.join(badrows.COLUMNS)}'))"
    return f"{sound}, {rest} SELECT line_id, " + ", ".join(f'{typed(c)} AS "{c}"' for c in badrows.COLUMNS) + " FROM g"


@query("p2_loaded", _loaded_sql())
def p2_loaded(spark, d):
    return badrows.loaded(spread(table(spark, d, "csv_line").select("line_id", "line")))


@query("p2_assembled")
def p2_assembled(spark, d):
    """The lines of every file taken as text whose records may span lines: the records' first lines, lengths and reasons."""
    whole = badrows.assemble(table(spark, d, "csv_line").select("file_name", "line_no", "line"), "file_name", "line_no", "line")
    keyed = whole.withColumn("at", F.struct("file_name", "line_no", "n_lines"))
    got = badrows.parse_records(keyed.withColumn("key", F.xxhash64("file_name", "line_no")), "key", "line").select(F.col("line_id").alias("key"), "reason")
    return got.join(keyed.select(F.xxhash64("file_name", "line_no").alias("key"), "at.*"), "key").select("file_name", "line_no", "n_lines", "reason")


_HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))))"
_SIDE = "CASE WHEN q.y > p.y THEN (q.x - p.x) * (lat - p.y) - (lon - p.x) * (q.y - p.y) ELSE (p.x - q.x) * (lat - q.y) - (lon - q.x) * (p.y - q.y) END"
_TURNS = f"sum(CASE WHEN least(p.y, q.y) <= lat AND lat < greatest(p.y, q.y) AND {_SIDE} > 0 THEN CASE WHEN q.y > p.y THEN 1 ELSE -1 END ELSE 0 END) <> 0"
_P4 = f"""WITH t AS (SELECT point_id, lon, lat FROM tract_point WHERE abs(lon) <= 180 AND abs(lat) <= 90), r AS (SELECT poly_id, sId, 0 AS h, polygon AS r FROM ctractpoly WHERE len(polygon) >= 3 UNION ALL
SELECT poly_id, sId, i AS h, innerRings[i] AS r FROM ctractpoly, LATERAL (SELECT unnest(range(1, coalesce(len(innerRings), 0) + 1)) AS i) u WHERE len(innerRings[i]) >= 3),
e AS (SELECT poly_id, sId, h, r[i] AS p, r[CASE WHEN i = len(r) THEN 1 ELSE i + 1 END] AS q FROM r, LATERAL (SELECT unnest(range(1, len(r) + 1)) AS i) u),
b AS (SELECT poly_id, min(p.x) AS x0, max(p.x) AS x1, min(p.y) AS y0, max(p.y) AS y1 FROM e WHERE h = 0 GROUP BY poly_id), c AS (SELECT point_id, lon, lat, poly_id FROM t JOIN b ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1),
w AS (SELECT point_id, c.poly_id, sId, h, {_TURNS} AS inside FROM c JOIN e ON c.poly_id = e.poly_id GROUP BY ALL), k AS (SELECT DISTINCT point_id, sId FROM (SELECT point_id, poly_id, sId, bool_or(h = 0 AND inside) AS o, bool_or(h > 0 AND inside) AS i FROM w GROUP BY ALL) WHERE o AND NOT i),
n AS (SELECT DISTINCT sId, centroid.x AS x, centroid.y AS y FROM ctract WHERE centroid.x IS NOT NULL AND centroid.y IS NOT NULL)
SELECT 'in' AS kind, point_id::VARCHAR AS key_a, sId AS key_b FROM k UNION ALL SELECT DISTINCT 'near', a.sId, b.sId FROM n a JOIN n b ON a.sId < b.sId AND abs(a.y - b.y) < 0.02 WHERE {_HAVERSINE} <= 2.0"""


@query("p4_found", _P4)
def p4_found(spark, d):
    inside = spatial.points_in_regions(table(spark, d, "tract_point"), table(spark, d, "ctractpoly"))
    centroids = table(spark, d, "ctract").select("sId", F.col("centroid.x").alias("x"), F.col("centroid.y").alias("y"))
    near = spatial.near_pairs(centroids, "sId", "x", "y", 2.0)
    return inside.select(F.lit("in").alias("kind"), "key_a", "key_b").unionByName(near.select(F.lit("near").alias("kind"), "key_a", "key_b"))


#: every value below the root of every record: a text that holds a structure counts as that structure
_TREE = """RECURSIVE t AS (SELECT rec_id, '' AS parent, NULL::VARCHAR AS field, doc::JSON AS v FROM yaml_rec WHERE json_valid(doc) AND json_type(doc) = 'OBJECT' UNION ALL
SELECT rec_id, parent, field, CASE WHEN json_type(v) = 'VARCHAR' AND regexp_matches(v ->> '$', '(?s)^\\s*[{\\[].*[}\\]]\\s*$') AND json_valid(v ->> '$') THEN (v ->> '$')::JSON ELSE v END AS v FROM (
SELECT rec_id, path AS parent, key AS field, CASE WHEN json_type(v) = 'OBJECT' THEN v -> ('$."' || key || '"') ELSE v -> ('$[' || key || ']') END AS v FROM (
SELECT rec_id, v, CASE WHEN field IS NULL THEN '' WHEN parent = '' THEN field ELSE parent || '/' || field END AS path, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_filter(json_keys(v), lambda k: k <> 'prov' AND NOT contains(k, '_prov')) WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: i::VARCHAR) END) AS key FROM t)))"""
_LEAF = "json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL') AND field IS NOT NULL"


@query(
    "p5_found",
    f"""WITH {_TREE}, l AS (SELECT rec_id, CASE WHEN parent = '' THEN field ELSE parent || '/' || field END AS path, v ->> '$' AS category FROM t WHERE {_LEAF}),
    o AS (SELECT rec_id, regexp_extract(path, '^(.+)/category(?:/(?:[0-9]+|value))*$', 1) AS path, category FROM l WHERE regexp_matches(path, '^(.+)/category(?:/(?:[0-9]+|value))*$')),
    d AS (SELECT DISTINCT rec_id, path FROM o), b AS (SELECT a.rec_id, a.path, max_by(b.path, length(b.path)) AS parent_path FROM d a JOIN d b ON a.rec_id = b.rec_id AND starts_with(a.path, b.path || '/') GROUP BY ALL)
    SELECT o.rec_id, o.path, coalesce(b.parent_path, '') AS parent_path, category FROM o LEFT JOIN b ON o.rec_id = b.rec_id AND o.path = b.path""",
)
def p5_found(spark, d):
    return nested.objects_table(spread(table(spark, d, "yaml_rec").select("rec_id", "doc")))


@query("p5_levels")
def p5_levels(spark, d):
    return nested.leaf_levels(spread(table(spark, d, "yaml_rec").select("rec_id", "doc")))


@query("p5_values", f"WITH {_TREE} SELECT rec_id, parent AS parent_path, field, v ->> '$' AS value FROM t WHERE {_LEAF}")
def p5_values(spark, d):
    return nested.values_table(spread(table(spark, d, "yaml_rec").select("rec_id", "doc")))


@query("p5_status", "SELECT rec_id, CASE WHEN doc IS NULL THEN 'null' WHEN NOT json_valid(doc) THEN 'broken' WHEN json_type(CASE WHEN json_valid(doc) THEN doc END) <> 'OBJECT' THEN 'no object' ELSE 'whole' END AS status FROM yaml_rec")
def p5_status(spark, d):
    """Which records are whole, and why the others are not."""
    return nested.record_status(spread(table(spark, d, "yaml_rec").select("rec_id", "doc")))


# ---------------------------------------------------------------- accumulators

_NTH = "list_sort(list({x}))[CAST(floor({k} * count({x}) / {d}) AS BIGINT) + 1]"


def _nth(x: str, k: int, d: int) -> str:
    return _NTH.format(x=x, k=k, d=d)


@query(
    "accum_by_flag",
    f"""SELECT l_returnflag, count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS stdv, min(l_quantity) AS min, max(l_quantity) AS max,
    {_nth('l_quantity', 1, 2)} AS median, {_nth('l_quantity', 1, 4)} AS q1, {_nth('l_quantity', 3, 4)} AS q3 FROM lineitem GROUP BY l_returnflag""",
)
def accum_by_flag(spark, d):
    return rounded(accum.accumulate(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity"))


@query(
    "statval_by_flag",
    "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS sum, count(l_extendedprice) AS count, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(sum(l_extendedprice) / count(l_extendedprice), 4) AS mean FROM lineitem GROUP BY l_returnflag",
)
def statval_by_flag(spark, d):
    # accumulated by ship mode of status first, then merged: the same as all at once
    part = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(accum.stat_val(F.col("l_extendedprice")).alias("s"))
    merged = part.groupBy("l_returnflag").agg(accum.merge_stat_vals(F.col("s")).alias("s"))
    return merged.select("l_returnflag", F.round("s.sum", 2).alias("sum"), "s.count", "s.min", "s.max", F.round(accum.stat_mean(F.col("s")), 4).alias("mean"))


@query("accum_histogram", "SELECT l_returnflag, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY ALL")
def accum_histogram(spark, d):
    return accum.value_histogram(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


@query(
    "accum_price_order_statistics",
    f"SELECT l_linestatus, {_nth('l_extendedprice', 1, 4)} AS q1, {_nth('l_extendedprice', 1, 2)} AS median, {_nth('l_extendedprice', 3, 4)} AS q3 FROM lineitem GROUP BY l_linestatus",
)
def accum_price_order_statistics(spark, d):
    return accum.order_statistics(table(spark, d, "lineitem"), ["l_linestatus"], "l_extendedprice")


@query(
    "tag_aware_views",
    f"""SELECT event_type, round(avg(value), 6) AS v_ave, round(coalesce(stddev_samp(value), 0), 6) AS v_stdv, min(value) AS v_min, max(value) AS v_max, {_nth('value', 1, 2)} AS v_median, count(value) AS v_count,
    round(avg(user_id), 6) AS u_ave, round(coalesce(stddev_samp(user_id), 0), 6) AS u_stdv, min(user_id)::DOUBLE AS u_min, max(user_id)::DOUBLE AS u_max, {_nth('user_id', 1, 2)}::DOUBLE AS u_median, count(user_id) AS u_count FROM events GROUP BY event_type""",
)
def tag_aware_views(spark, d):
    tags = {"_ave": "mean", "_stdv": "stdv", "_min": "min", "_max": "max", "_median": "median", "_count": "count"}
    e = table(spark, d, "events").withColumn("user_id", F.col("user_id").cast("double"))
    return rounded(accum.tag_aware(e, ["event_type"], {"v": "value", "u": "user_id"}, tags))


@query("accum_render", "SELECT event_type, printf('%.3f+-%.3f', avg(value), coalesce(stddev_samp(value), 0)) AS text FROM events GROUP BY event_type")
def accum_render(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), accum.sample_stdv(F.col("value")).alias("s"))
    return e.select("event_type", accum.render(F.col("m"), F.col("s"), 3).alias("text"))


@query(
    "multival_stats",
    """SELECT p_brand, round(avg(p_size), 6) AS p_size_mean, round(coalesce(stddev_samp(p_size), 0), 6) AS p_size_stdv, min(p_size)::DOUBLE AS p_size_min, max(p_size)::DOUBLE AS p_size_max, count(p_size) AS p_size_count,
    round(avg(p_retailprice), 6) AS p_retailprice_mean, round(coalesce(stddev_samp(p_retailprice), 0), 6) AS p_retailprice_stdv, min(p_retailprice) AS p_retailprice_min, max(p_retailprice) AS p_retailprice_max, count(p_retailprice) AS p_retailprice_count FROM part GROUP BY p_brand""",
)
def multival_stats(spark, d):
    return rounded(accum.multi_val(table(spark, d, "part"), ["p_brand"], ["p_size", "p_retailprice"]))


@query(
    "multival_merge",
    "SELECT 'all' AS scope, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT s_acctbal AS v FROM supplier UNION ALL SELECT c_acctbal AS v FROM customer)",
)
def multival_merge(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return accum.merge_multi_val(a, b).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total")).select(F.lit("all").alias("scope"), "n", "total")


@query(
    "multival_columns",
    "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS orders, array_to_string(list(o_orderstatus ORDER BY o_orderkey), ',') AS states, min_by(o_orderstatus, o_orderkey) AS first_state FROM orders GROUP BY o_custkey",
)
def multival_columns(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.struct("o_orderkey", "o_orderstatus").alias("r")).groupBy("o_custkey").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return o.select(
        "o_custkey", F.array_join(F.transform(accum.position_list("rows", "o_orderkey"), lambda k: k.cast("string")), ",").alias("orders"),
        F.array_join(accum.position_list("rows", "o_orderstatus"), ",").alias("states"), accum.entry("rows", 0)["o_orderstatus"].alias("first_state"),
    )


@query(
    "high_water",
    r"""SELECT row_id, coalesce(PowerRate, 0) AS f, coalesce(BaseCostYear, 0)::BIGINT AS i, CASE WHEN Year IS NULL OR Year = 'NA' THEN 0 WHEN regexp_matches(Year, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') THEN TRY_CAST(Year AS DOUBLE) END AS year_f,
    CASE WHEN Year IS NULL OR Year = 'NA' THEN 0 WHEN regexp_matches(Year, '^\s*[+-]?\d+\s*$') THEN TRY_CAST(Year AS BIGINT) END AS year_i FROM test_csv_input""",
)
def high_water(spark, d):
    """Of numbers, and of text that need not be a number."""
    t = table(spark, d, "test_csv_input")
    year = F.col("Year")
    return t.select("row_id", accum.high_water(t, "PowerRate").alias("f"), accum.high_water_int(F.col("BaseCostYear")).alias("i"), accum.high_water_float(year, strict=False).alias("year_f"), accum.high_water_int(year, strict=False).alias("year_i"))


@query("high_water_array", "SELECT vec_id, list_max(list_transform(embedding, lambda x: x::DOUBLE)) > 0 AS positive, round(list_max(embedding)::DOUBLE, 4) AS high FROM embeddings")
def high_water_array(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", (accum.high_water(e, "embedding") > 0).alias("positive"), F.round(accum.high_water(e, "embedding"), 4).alias("high"))


@query("high_water_accumulator", "SELECT event_type, max(value) AS high, printf('%.3f', avg(value)) AS text FROM events GROUP BY event_type")
def high_water_accumulator(spark, d):
    """Accumulators as numbers and, by an exchanged view, as text."""
    a = table(spark, d, "events").groupBy("event_type").agg(accum.stat_val(F.col("value")).alias("s"))
    shown = accum.Shown().with_text(lambda s: F.format_string("%.3f", accum.stat_mean(s)))
    return a.select("event_type", accum.high_water(a, "s").alias("high"), shown.text(F.col("s")).alias("text")).filter(shown.number(F.col("s")) == F.col("high"))


@query("tag_edit", "SELECT event_type, round(avg(value), 6) AS v_ave, max(value) AS v_max, 'note' AS extra FROM events GROUP BY event_type")
def tag_edit(spark, d):
    """Entries of a tagged view set and deleted: an accumulator goes with its first tag, its other tags are ignored."""
    tags = {"_ave": "mean", "_max": "max"}
    v = accum.tag_aware(table(spark, d, "events"), ["event_type"], {"v": "value", "u": "user_id"}, tags)
    v = accum.set_entry(accum.set_entry(v, "extra", F.lit("note")), "gone", F.lit(1))
    for name in ("gone", "u_ave", "v_max"):
        v = accum.delete_entry(v, name, ["v", "u"], list(tags))
    return rounded(v)


# ---------------------------------------------------------------- histograms

_BINS = "SELECT event_type, CAST(floor(value * (1.0 / {q})) AS BIGINT) AS bin, count(*) AS n, CAST(sum(CASE WHEN value = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros FROM events WHERE value IS NOT NULL GROUP BY 1, 2"
_CENTRES = """SELECT event_type, 0.0::DOUBLE AS centre, zeros AS n FROM bins WHERE bin = 0 UNION ALL SELECT event_type, {q} * 0.5 AS centre, n - zeros AS n FROM bins WHERE bin = 0
UNION ALL SELECT event_type, bin * {q}::DOUBLE + {q} * 0.5 AS centre, n FROM bins WHERE bin <> 0"""


@query("histo_bins", _BINS.format(q="0.5::DOUBLE"))
def histo_bins(spark, d):
    return histogram.build(table(spark, d, "events"), ["event_type"], "value", 0.5)


@query(
    "histo_quantiles",
    f"""WITH bins AS ({_BINS.format(q='7::DOUBLE')}), c AS ({_CENTRES.format(q='7::DOUBLE')}), s AS (SELECT event_type, sum(n) AS count, sum(centre * n) / sum(n) AS mean, min(centre) AS min, max(centre) AS max FROM c GROUP BY 1),
    r AS (SELECT c.*, s.count, s.mean, s.min, s.max, sum(n) OVER (PARTITION BY c.event_type ORDER BY centre ROWS UNBOUNDED PRECEDING) AS cum FROM c JOIN s ON c.event_type = s.event_type)
    SELECT event_type, max(count)::BIGINT AS count, round(max(mean), 6) AS mean, round(sqrt(sum(n * (centre - mean) * (centre - mean)) / (max(count) - 1)), 6) AS stdv, min(min) AS min, max(max) AS max,
    min(CASE WHEN cum >= floor(count / 4) THEN centre END) AS q1, min(CASE WHEN cum >= floor(count * 2 / 4) THEN centre END) AS median, min(CASE WHEN cum >= floor(count * 3 / 4) THEN centre END) AS q3 FROM r GROUP BY event_type""",
)
def histo_quantiles(spark, d):
    return rounded(histogram.statistics(histogram.build(table(spark, d, "events"), ["event_type"], "value", 7.0), ["event_type"], 7.0))


@query("histo_merge", "SELECT CAST(floor(value * 2) AS BIGINT) AS bin, count(*) AS n, CAST(sum(CASE WHEN value = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def histo_merge(spark, d):
    e = table(spark, d, "events")
    a, b = (histogram.build(e.filter(F.col("event_type") == t), [], "value", 0.5) for t in ("click", "view"))
    return histogram.merge(a, b, [])


@query(
    "histo_rebin",
    f"""WITH bins AS ({_BINS.format(q='0.5::DOUBLE')}), c AS ({_CENTRES.format(q='0.5::DOUBLE')})
    SELECT event_type, CAST(floor(centre * 0.5) AS BIGINT) AS bin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN centre = 0 THEN n ELSE 0 END) AS BIGINT) AS zeros FROM c GROUP BY 1, 2""",
)
def histo_rebin(spark, d):
    return histogram.rebin(histogram.build(table(spark, d, "events"), ["event_type"], "value", 0.5), ["event_type"], 0.5, 2.0)


@query("histo_raw", f"WITH bins AS ({_BINS.format(q='50::DOUBLE')}), c AS ({_CENTRES.format(q='50::DOUBLE')}) SELECT event_type, centre AS value FROM c, unnest(range(n)) WHERE n > 0")
def histo_raw(spark, d):
    return histogram.raw(histogram.build(table(spark, d, "events"), ["event_type"], "value", 50.0), ["event_type"], 50.0)


@query("histo_json", f"WITH b AS ({_BINS.format(q='20::DOUBLE')}) SELECT event_type, 20.0::DOUBLE AS quantum, bin, n, zeros FROM b")
def histo_json(spark, d):
    """Written as JSON and read again."""
    bins = histogram.build(table(spark, d, "events"), ["event_type"], "value", 20.0)
    return histogram.from_json(histogram.to_json(bins, ["event_type"], 20.0), ["event_type"])


@query("histo_same", "SELECT DISTINCT event_type, true AS equal FROM events WHERE value IS NOT NULL")
def histo_same(spark, d):
    bins = histogram.build(table(spark, d, "events"), ["event_type"], "value", 20.0)
    again = histogram.from_json(histogram.to_json(bins, ["event_type"], 20.0), ["event_type"]).drop("quantum")
    return histogram.same(bins, again, ["event_type"])


@query(
    "histo_compare",
    f"""WITH bins AS ({_BINS.format(q='50::DOUBLE')}), p AS (SELECT DISTINCT a.event_type AS x, b.event_type AS y FROM bins a JOIN bins b ON b.event_type = CASE a.event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'view' ELSE a.event_type END),
    j AS (SELECT x, coalesce(a.bin, b.bin) AS bin, a.n AS na, b.n AS nb, coalesce(a.zeros, 0) AS za, coalesce(b.zeros, 0) AS zb FROM p JOIN (SELECT DISTINCT bin FROM bins) k ON true LEFT JOIN bins a ON a.event_type = x AND a.bin = k.bin LEFT JOIN bins b ON b.event_type = y AND b.bin = k.bin WHERE a.n IS NOT NULL OR b.n IS NOT NULL),
    g AS (SELECT x, count(na) AS la, count(nb) AS lb, min(CASE WHEN na IS DISTINCT FROM nb AND na IS NOT NULL THEN bin END) AS da, min(CASE WHEN na IS DISTINCT FROM nb AND nb IS NOT NULL THEN bin END) AS db, sum(za) AS za, sum(zb) AS zb FROM j GROUP BY x)
    SELECT g.x AS event_type, CASE WHEN la <> lb THEN sign(la - lb) WHEN da <> db THEN sign(da - db) WHEN da IS NOT NULL THEN sign(j.na - j.nb) ELSE sign(g.za - g.zb) END::INTEGER AS sign FROM g LEFT JOIN j ON j.x = g.x AND j.bin = g.da""",
)
def histo_compare(spark, d):
    """The order of histograms: views and clicks against each other, every other kind against itself."""
    a = histogram.build(table(spark, d, "events"), ["event_type"], "value", 50.0)
    b = a.withColumn("event_type", F.when(F.col("event_type") == "view", "click").when(F.col("event_type") == "click", "view").otherwise(F.col("event_type")))
    return histogram.compare(a, b, ["event_type"])


# ---------------------------------------------------------------- times, softmax


@query(
    "ts_accum",
    "SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdv, min(value) AS min, max(value) AS max, epoch_us(min(ts)) AS min_t, epoch_us(max(ts)) AS max_t FROM events WHERE value IS NOT NULL GROUP BY event_type",
)
def ts_accum(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return rounded(timed.timed_statistics(e, ["event_type"], "value", "t").drop("max_t_end"))


@query(
    "softmax_group",
    "WITH e AS (SELECT p_partkey, p_brand, exp(p_retailprice * 0.01 - max(p_retailprice * 0.01) OVER (PARTITION BY p_brand)) AS e FROM part) SELECT p_partkey, round(e / sum(e) OVER (PARTITION BY p_brand), 9) AS p FROM e",
)
def softmax_group(spark, d):
    return softmax.softmax_rows(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", 0.01).select("p_partkey", F.round("p", 9).alias("p"))


@query(
    "softmax_array",
    """WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE * 2 AS y, generate_subscripts(embedding, 1) AS i FROM embeddings), e AS (SELECT vec_id, i, exp(y - max(y) OVER (PARTITION BY vec_id)) AS e FROM u)
    SELECT vec_id, i::INTEGER AS i, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM e""",
)
def softmax_array(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(softmax.softmax_array(F.col("embedding"), 2.0)).alias("i", "p"))
    return e.select("vec_id", (F.col("i") + 1).cast("int").alias("i"), F.round("p", 9).alias("p"))


@query(
    "softmax_matrix",
    """WITH u AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, embedding[i + 1]::DOUBLE AS y FROM embeddings, unnest(range(64)) AS t(i)), e AS (SELECT vec_id, r, c, exp(y - max(y) OVER (PARTITION BY vec_id, c)) AS e FROM u)
    SELECT vec_id, r::INTEGER AS r, c::INTEGER AS c, round(e / sum(e) OVER (PARTITION BY vec_id, c), 9) AS p FROM e""",
)
def softmax_matrix(spark, d):
    """Vectors as matrices of eight rows, down their columns."""
    m = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("embedding", r * 8 + 1, 8))
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(softmax.softmax_matrix(m)).alias("r", "row"))
    return e.select("vec_id", "r", F.posexplode("row").alias("c", "p")).select("vec_id", "r", "c", F.round("p", 9).alias("p"))


# ---------------------------------------------------------------- notes

_ONCE = "SELECT grp, holder, seq, min(struct_pack(op := op, note_key := note_key, num := num, str_val := str_val)) AS r FROM note_ledger GROUP BY ALL"
_EVENTS = f"WITH o AS (SELECT grp, holder, seq, r.op AS op, r.note_key AS note_key, r.num AS num, r.str_val AS str_val FROM ({_ONCE}))"
_GATED = f"""{_EVENTS}, g AS (SELECT *, coalesce(last_value(CASE op WHEN 'enable' THEN 1 WHEN 'disable' THEN 0 END IGNORE NULLS) OVER (PARTITION BY grp ORDER BY seq ROWS UNBOUNDED PRECEDING), 1) AS is_on FROM o),
e AS (SELECT grp, holder, seq, op, note_key, num, str_val FROM g WHERE is_on = 1 AND op IN ('add', 'replace'))"""
_KEPT = f"""{_GATED}, cut AS (SELECT grp, holder, note_key, max(seq) AS cut FROM e WHERE op = 'replace' GROUP BY ALL),
k AS (SELECT e.* FROM e LEFT JOIN cut ON e.grp = cut.grp AND e.holder = cut.holder AND e.note_key = cut.note_key WHERE cut.cut IS NULL OR e.seq >= cut.cut)"""


def _raw_ledger(spark, d):
    return table(spark, d, "note_ledger").select("grp", "holder", "seq", "op", "note_key", "num", "str_val")


def _ledger(spark, d):
    return notes.once(_raw_ledger(spark, d), ["grp", "holder", "seq"])


@query("notes_sum", f"{_EVENTS} SELECT grp, holder, note_key, count(*) AS n, round(sum(num), 4) AS total FROM o WHERE op = 'add' GROUP BY grp, holder, note_key")
def notes_sum(spark, d):
    return rounded(notes.fold(_ledger(spark, d).filter("op = 'add'"), ["grp", "holder"], "note_key", "num"), 4)


@query("notes_gate", f"{_GATED} SELECT grp, op, count(*) AS n, round(sum(num), 4) AS total FROM e GROUP BY grp, op")
def notes_gate(spark, d):
    return notes.gate(_raw_ledger(spark, d).drop("str_val", "note_key")).groupBy("grp", "op").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("num"), 4).alias("total"))


@query("notes_replace", f"{_KEPT} SELECT grp, holder, note_key, count(*) AS n, round(sum(num), 4) AS total FROM k GROUP BY grp, holder, note_key")
def notes_replace(spark, d):
    return rounded(notes.fold_ledger(_raw_ledger(spark, d), "note_key", "num"), 4)


@query("notes_concat", f"{_KEPT} SELECT grp, holder, note_key, string_agg(str_val, '' ORDER BY seq) AS words FROM k WHERE str_val IS NOT NULL GROUP BY grp, holder, note_key")
def notes_concat(spark, d):
    return notes.fold_ledger(_raw_ledger(spark, d), "note_key", "num", "str_val").filter("words IS NOT NULL").select("grp", "holder", "note_key", "words")


@query(
    "notes_required",
    f"""{_KEPT}, f AS (SELECT grp, holder, note_key, round(sum(num), 4) AS total FROM k GROUP BY ALL), w AS (SELECT grp, holder, max(CASE WHEN note_key = 'int' THEN total END) AS "int", max(CASE WHEN note_key = 'fill' THEN total END) AS fill,
    max(CASE WHEN note_key = 'alarm' THEN total END) AS alarm, bool_or(note_key = 'int') AND bool_or(note_key = 'fill') OR bool_or(note_key = 'alarm') AS ok FROM f GROUP BY grp, holder) SELECT grp, holder, "int", fill, alarm FROM w WHERE ok""",
)
def notes_required(spark, d):
    f = rounded(notes.fold_ledger(_raw_ledger(spark, d), "note_key", "num"), 4)
    return notes.report(f, ["grp", "holder"], "note_key", "total", ["int", "fill", "alarm"], ["int", "fill"], ["alarm"])


@query("notes_clear_all", f"{_EVENTS} SELECT grp, note_key, count(*) AS n FROM o WHERE op = 'add' AND regexp_matches(note_key, '^(?:f|temp)') GROUP BY ALL")
def notes_clear_all(spark, d):
    return notes.keep_keys(_ledger(spark, d).filter("op = 'add'"), "note_key", "f|temp").groupBy("grp", "note_key").agg(F.count(F.lit(1)).alias("n"))


@query("notes_available", f"{_EVENTS} SELECT grp, holder, array_to_string(list_sort(list(DISTINCT note_key)), ',') AS names FROM o WHERE op IN ('add', 'replace') AND note_key IS NOT NULL GROUP BY grp, holder")
def notes_available(spark, d):
    return notes.available(_ledger(spark, d).filter("op IN ('add', 'replace') AND note_key IS NOT NULL"), ["grp", "holder"], "note_key")


@query("notes_lookup", f"{_EVENTS} SELECT grp, holder, count(CASE WHEN note_key = 'alarm' THEN 1 END) > 0 AS has_alarm, CASE WHEN count(CASE WHEN note_key = 'alarm' THEN 1 END) > 0 THEN round(sum(CASE WHEN note_key = 'alarm' THEN num END), 4) END AS alarm FROM o WHERE op = 'add' GROUP BY grp, holder")
def notes_lookup(spark, d):
    f = notes.fold(_ledger(spark, d).filter("op = 'add'"), ["grp", "holder"], "note_key", "num")
    has = f.filter("note_key = 'alarm'").select("grp", "holder", F.lit(True).alias("has_alarm"))
    got = notes.lookup(f, ["grp", "holder"], "note_key", "alarm", "total").join(has, ["grp", "holder"], "left")
    return got.select("grp", "holder", F.coalesce("has_alarm", F.lit(False)).alias("has_alarm"), F.round("alarm", 4).alias("alarm"))


@query(
    "notes_lists",
    f"""{_EVENTS}, a AS (SELECT holder, seq, num, str_val FROM o WHERE op = 'add' AND note_key IS NOT NULL) SELECT holder, string_agg(str_val, ',' ORDER BY seq) AS items, round(sum(num), 4) AS stat_sum, count(num) AS stat_count, max(num) AS stat_max FROM a GROUP BY holder""",
)
def notes_lists(spark, d):
    """Lists and accumulators as notes of one key: every text a list of one, every number an accumulator of one."""
    e = _ledger(spark, d).filter("op = 'add' AND note_key IS NOT NULL").withColumn("key", F.lit("all"))
    one = F.col("num")
    stat = F.struct(one.alias("sum"), F.when(one.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("count"), one.alias("min"), one.alias("max"))
    e = e.withColumn("one", F.when(F.col("str_val").isNotNull(), F.array("str_val"))).withColumn("stat", stat)
    f = notes.fold(e, ["holder"], "key", "num", lists="one", stats="stat")
    return f.select("holder", F.when(F.size("items") > 0, F.array_join("items", ",")).alias("items"), F.round("stats.sum", 4).alias("stat_sum"), F.col("stats.count").alias("stat_count"), F.col("stats.max").alias("stat_max"))


@query(
    "notes_copy_holder",
    "SELECT holder, count(*) AS n FROM (SELECT holder FROM note_ledger UNION ALL SELECT 'hub_copy' FROM note_ledger WHERE holder = 'hub_central') GROUP BY holder",
)
def notes_copy_holder(spark, d):
    n = table(spark, d, "note_ledger").select("holder", "note_id")
    return notes.copy_holder(n, "holder", "hub_central", "hub_copy").groupBy("holder").agg(F.count(F.lit(1)).alias("n"))


@query(
    "notes_csv",
    f"""{_KEPT}, f AS (SELECT grp, holder, note_key, count(*) AS n FROM k WHERE note_key IS NOT NULL GROUP BY ALL), w AS (SELECT grp, holder, max(CASE WHEN note_key = 'fill' THEN n END) AS fill, max(CASE WHEN note_key = 'int' THEN n END) AS i FROM f GROUP BY grp, holder)
    SELECT '# notes' AS line UNION ALL SELECT 'grp,holder,fill,int' UNION ALL SELECT grp || ',' || holder || ',' || coalesce(fill::VARCHAR, 'NA') || ',' || coalesce(i::VARCHAR, 'NA') FROM w""",
)
def notes_csv(spark, d):
    f = notes.fold_ledger(_raw_ledger(spark, d), "note_key", "num").filter("note_key IS NOT NULL")
    wide = notes.report(f, ["grp", "holder"], "note_key", "n", ["fill", "int"])
    return notes.csv_lines(wide, ["grp", "holder", "fill", "int"], preamble=["# notes"]).select("line")


# ---------------------------------------------------------------- keyed store


def _store(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.floor("c_acctbal").cast("bigint").alias("value"))


_STORE = "store AS (SELECT c_custkey AS key, CAST(floor(c_acctbal) AS BIGINT) AS value FROM customer)"
_WRITES = "writes AS (SELECT o_custkey + 700 AS key, max_by(CAST(floor(o_totalprice) AS BIGINT), o_orderkey) AS value FROM orders GROUP BY 1)"


def _writes(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") + 700).alias("key"), F.floor("o_totalprice").cast("bigint").alias("value"), "o_orderkey")
    return kvstore.last_wins(o, "key", "o_orderkey")


@query("kv_last_wins", f"WITH {_WRITES} SELECT * FROM writes")
def kv_last_wins(spark, d):
    return _writes(spark, d)


@query("kv_upsert", f"WITH {_STORE}, {_WRITES} SELECT key, value FROM writes UNION ALL SELECT key, value FROM store WHERE key NOT IN (SELECT key FROM writes)")
def kv_upsert(spark, d):
    return kvstore.upsert(_store(spark, d), _writes(spark, d), "key")


@query("kv_put_all", f"WITH {_STORE}, k AS (SELECT DISTINCT o_custkey + 700 AS key FROM orders) SELECT key, CAST(-1 AS BIGINT) AS value FROM k UNION ALL SELECT key, value FROM store WHERE key NOT IN (SELECT key FROM k)")
def kv_put_all(spark, d):
    return kvstore.put_all(_store(spark, d), _writes(spark, d), "key", "value", -1)


@query("kv_mget", f"WITH {_STORE}, {_WRITES} SELECT w.key, s.value FROM writes w LEFT JOIN store s ON w.key = s.key")
def kv_mget(spark, d):
    return kvstore.get_all(_store(spark, d), _writes(spark, d), "key")


@query("kv_mdel", f"WITH {_STORE}, {_WRITES} SELECT * FROM store WHERE key NOT IN (SELECT key FROM writes)")
def kv_mdel(spark, d):
    return kvstore.delete_all(_store(spark, d), _writes(spark, d), "key")


@query("kv_contains", f"WITH {_STORE}, {_WRITES} SELECT key, key IN (SELECT key FROM store) AS present FROM writes")
def kv_contains(spark, d):
    return kvstore.contains(_store(spark, d), _writes(spark, d), "key")


@query("kv_range", f"WITH {_STORE} SELECT * FROM store WHERE key BETWEEN 100 AND 900")
def kv_range(spark, d):
    return kvstore.key_range(_store(spark, d), "key", 100, 900)


@query("kv_setdefault", f"WITH {_STORE}, {_WRITES} SELECT key, value FROM store UNION ALL SELECT key, value FROM writes WHERE key NOT IN (SELECT key FROM store)")
def kv_setdefault(spark, d):
    return kvstore.set_default(_store(spark, d), _writes(spark, d), "key")


@query("kv_pop", f"WITH {_STORE}, {_WRITES} SELECT key, value, key IN (SELECT key FROM writes) AS taken FROM store")
def kv_pop(spark, d):
    taken, left = kvstore.pop_all(_store(spark, d), _writes(spark, d), "key")
    return taken.withColumn("taken", F.lit(True)).unionByName(left.withColumn("taken", F.lit(False)))


@query("kv_get_and_set", f"WITH {_STORE} SELECT key, value, value * 2 + 1 AS new_value FROM store")
def kv_get_and_set(spark, d):
    return kvstore.get_and_set(_store(spark, d), "value", lambda v: v * 2 + 1)


@query("kv_len", "SELECT count(*) AS n FROM customer")
def kv_len(spark, d):
    return _store(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query("kv_mdebit", f"WITH {_STORE}, {_WRITES} SELECT s.key, s.value AS old_value, CASE WHEN s.value < 100 THEN s.value ELSE greatest(s.value - w.value, 100) END AS new_value, CASE WHEN s.value < 100 THEN w.value ELSE greatest(100 - (s.value - w.value), 0) END AS unmet FROM store s JOIN writes w ON s.key = w.key")
def kv_mdebit(spark, d):
    r = _writes(spark, d).select("key", F.col("value").alias("amount"), F.lit(100).cast("bigint").alias("min_remaining"))
    return kvstore.debit_all(_store(spark, d), r, "key")


@query("kv_mcredit", f"WITH {_STORE}, {_WRITES} SELECT s.key, s.value AS old_value, CASE WHEN s.value > 9000 THEN s.value ELSE least(s.value + w.value, 9000) END AS new_value, CASE WHEN s.value > 9000 THEN w.value ELSE greatest((s.value + w.value) - 9000, 0) END AS unmet FROM store s JOIN writes w ON s.key = w.key")
def kv_mcredit(spark, d):
    r = _writes(spark, d).select("key", F.col("value").alias("amount"), F.lit(9000).cast("bigint").alias("max_remaining"))
    return kvstore.credit_all(_store(spark, d), r, "key")


@query(
    "kv_pool",
    """WITH n AS (SELECT c_custkey AS key, c_nationkey AS nation, CAST(floor(c_acctbal) AS BIGINT) AS value, greatest(5000 - CAST(floor(c_acctbal) AS BIGINT), 0) AS need FROM customer),
    p AS (SELECT *, coalesce(sum(need) OVER (PARTITION BY nation ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev, sum(need) OVER (PARTITION BY nation) AS total FROM n)
    SELECT key, nation, CAST(value + greatest(least(need, 60000 - prev), 0) AS BIGINT) AS new_value, CAST(greatest(60000 - total, 0) AS BIGINT) AS leftover FROM p""",
)
def kv_pool(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.floor("c_acctbal").cast("bigint").alias("value"), F.lit(5000).cast("bigint").alias("most"))
    return kvstore.credit_from_pool(c, "key", "value", "most", 60000, ["nation"]).select("key", "nation", "new_value", "leftover")


@query("kv_store", f"WITH {_STORE} SELECT key, value FROM store")
def kv_store(spark, d):
    """Written with codecs, copied with its options, and read back from the copy."""
    o = kvstore.Options(value_codec="json", dated=True)
    store = kvstore.Store(spark, shared_path(spark, "kv_store") + ".", "key", {"key": "bigint", "value": "bigint"}, o)
    return store.write(_store(spark, d)).copy().read()


@query(
    "kv_debit_notes",
    f"""{_EVENTS}, t AS (SELECT holder AS key, coalesce(sum(num), 0) AS amount FROM o WHERE op = 'add' AND holder IS NOT NULL GROUP BY holder),
    s AS (SELECT Name AS key, max_by(BaseCost, row_id) AS value FROM test_csv_input WHERE Name IS NOT NULL AND BaseCost IS NOT NULL GROUP BY Name)
    SELECT s.key, round(value, 4) AS old_value, round(CASE WHEN value < 0 THEN value ELSE greatest(value - amount, 0) END, 4) AS new_value,
    round(CASE WHEN value < 0 THEN amount ELSE greatest(amount - value, 0) END, 4) AS unmet FROM s JOIN t ON s.key = t.key""",
)
def kv_debit_notes(spark, d):
    """Each name's last base cost, debited by the total of its notes, each note counted once."""
    cost = table(spark, d, "test_csv_input").select(F.col("Name").alias("key"), F.col("BaseCost").alias("value"), "row_id").filter("value IS NOT NULL")
    spent = _ledger(spark, d).filter("op = 'add' AND holder IS NOT NULL").groupBy(F.col("holder").alias("key")).agg(F.coalesce(F.sum("num"), F.lit(0.0)).alias("amount"))
    return rounded(kvstore.debit_all(kvstore.last_wins(cost, "key", "row_id"), spent.withColumn("min_remaining", F.lit(0.0)), "key"), 4)


# ---------------------------------------------------------------- casts

_NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


@query(
    "cast_chain",
    r"""SELECT row_id, CASE WHEN coalesce(Year, '') = '' THEN NULL WHEN regexp_matches(Year, '^\s*[+-]?\d+\s*$') THEN TRY_CAST(Year AS BIGINT) END AS year_int,
    CASE WHEN coalesce(Year, '') = '' THEN true ELSE regexp_matches(Year, '^\s*[+-]?\d+\s*$') END AS ok FROM test_csv_input""",
)
def cast_chain(spark, d):
    s = F.col("Year")
    chain = ["EMPTY_IS_NONE", "INT"]
    return table(spark, d, "test_csv_input").select("row_id", casts.cast_value(s, chain, strict=False).alias("year_int"), casts.cast_ok(s, chain).alias("ok"))


@query(
    "cast_names",
    """SELECT o_orderkey, CASE WHEN k >= 1 THEN k END AS positive, CASE WHEN k >= 0 THEN k END AS nonnegative, CAST(k AS DOUBLE) AS f, CASE WHEN s = '0' THEN 0 ELSE 1 END AS b, s AS text, CASE WHEN s = '' THEN 0 ELSE k END AS zero_or_int
    FROM (SELECT o_orderkey, o_orderkey % 7 - 3 AS k, CAST(o_orderkey % 7 - 3 AS VARCHAR) AS s FROM orders)""",
)
def cast_names(spark, d):
    s = F.col("s")
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 - 3).cast("string").alias("s"))
    c = lambda *chain: casts.cast_value(s, list(chain), strict=False)
    return o.select("o_orderkey", c("POSITIVE_INT").alias("positive"), c("NONNEGATIVE_INT").alias("nonnegative"), c("FLOAT").alias("f"), c("BOOLEAN").alias("b"), c("STRING").alias("text"), c("EMPTY_IS_ZERO", "INT").alias("zero_or_int"))


@query(
    "cast_bool",
    "SELECT row_id, CASE WHEN Category IS NULL THEN 0 WHEN lower(Category) IN ('t', 'true') THEN 1 WHEN lower(Category) IN ('f', 'false') THEN 0 WHEN Category = '' THEN 0 ELSE 1 END AS b FROM test_csv_input",
)
def cast_bool(spark, d):
    return table(spark, d, "test_csv_input").select("row_id", casts.cast_value(F.col("Category"), ["BOOLEAN"]).alias("b"))


@query("safe_float", "SELECT row_id, coalesce(BaseCost, PowerRate, -1.0) AS f, coalesce(PowerRate, -2.0) AS g FROM test_csv_input")
def safe_float(spark, d):
    t = table(spark, d, "test_csv_input")
    return t.select("row_id", casts.safe_float([F.col("BaseCost"), F.col("PowerRate")], -1.0).alias("f"), casts.safe_float([F.col("PowerRate")], -2.0, "NA").alias("g"))


@query("get_float", "SELECT row_id, coalesce(BaseCost, PowerRate) AS f FROM test_csv_input")
def get_float(spark, d):
    return table(spark, d, "test_csv_input").select("row_id", casts.get_float(F.col("BaseCost"), F.col("PowerRate")).alias("f"))


@query("percent", "SELECT p_partkey, round(0.01::DOUBLE * p_size, 9) AS share FROM part")
def percent(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(casts.percent(F.concat(F.col("p_size").cast("string"), F.lit("%"))), 9).alias("share"))


@query("cast_bytes", "SELECT n_nationkey, n_name || 'é' AS a, n_name || 'Ã©' AS b FROM nation")
def cast_bytes(spark, d):
    """Bytes as text by a list of codecs, and by a hint."""
    b = F.encode(F.concat("n_name", F.lit("é")), "utf-8")
    return table(spark, d, "nation").select("n_nationkey", casts.decode_bytes(b).alias("a"), casts.decode_bytes(b, hint="cp1252").alias("b"))


@query("listify", "SELECT row_id, CASE WHEN Make IS NULL THEN 0 ELSE 1 END AS n FROM test_csv_input")
def listify(spark, d):
    t = table(spark, d, "test_csv_input")
    return t.select("row_id", F.size(casts.listify_column(t, "Make")).alias("n"))


# ---------------------------------------------------------------- planar geometry

_RING = "SELECT poly_id, sId, polygon AS r FROM ctractpoly WHERE polygon IS NOT NULL AND len(polygon) >= 3"
_CLOSED = f"WITH a AS ({_RING}), c AS (SELECT poly_id, sId, CASE WHEN r[1].x = r[-1].x AND r[1].y = r[-1].y THEN r ELSE list_append(r, r[1]) END AS r FROM a), e AS (SELECT poly_id, sId, r[i] AS p, r[i + 1] AS q FROM c, LATERAL (SELECT unnest(range(1, len(r))) AS i) t)"


def _rings(spark, d):
    t = table(spark, d, "ctractpoly").filter("polygon IS NOT NULL AND size(polygon) >= 3")
    return t.select("poly_id", "sId", polygon.closed(F.col("polygon")).alias("r"))


@query(
    "poly_area",
    f"{_CLOSED} SELECT poly_id, round(abs(sum(p.x * q.y - q.x * p.y)) / 2, 6) AS area, count(*) AS n_edges FROM e GROUP BY poly_id",
)
def poly_area(spark, d):
    return _rings(spark, d).select("poly_id", F.round(polygon.area(F.col("r")), 6).alias("area"), F.size(polygon.edges(F.col("r"))).cast("bigint").alias("n_edges"))


@query("poly_signed_area", f"{_CLOSED} SELECT poly_id, sum(p.x * q.y - q.x * p.y) > 0 AS counterclockwise FROM e GROUP BY poly_id")
def poly_signed_area(spark, d):
    return _rings(spark, d).select("poly_id", (polygon.signed_area(F.col("r")) > 0).alias("counterclockwise"))


@query(
    "poly_centroid",
    f"{_CLOSED} SELECT poly_id, round(sum((p.x + q.x) * (p.x * q.y - q.x * p.y)) / (3 * sum(p.x * q.y - q.x * p.y)), 3) AS x, round(sum((p.y + q.y) * (p.x * q.y - q.x * p.y)) / (3 * sum(p.x * q.y - q.x * p.y)), 3) AS y FROM e GROUP BY poly_id",
)
def poly_centroid(spark, d):
    c = _rings(spark, d).select("poly_id", polygon.centroid_area(F.col("r")).alias("c"))
    return rounded(c.select("poly_id", "c.x", "c.y"), 3)


@query(
    "poly_extent",
    f"WITH a AS ({_RING}) SELECT poly_id, list_min(list_transform(r, lambda p: p.x)) AS min_x, list_min(list_transform(r, lambda p: p.y)) AS min_y, list_max(list_transform(r, lambda p: p.x)) AS max_x, list_max(list_transform(r, lambda p: p.y)) AS max_y FROM a",
)
def poly_extent(spark, d):
    return _rings(spark, d).select("poly_id", polygon.extent(F.col("r")).alias("e")).select("poly_id", "e.*")


@query(
    "tract_extent",
    f"WITH a AS ({_RING}) SELECT sId, count(*) AS n, min(list_min(list_transform(r, lambda p: p.x))) AS min_x, min(list_min(list_transform(r, lambda p: p.y))) AS min_y, max(list_max(list_transform(r, lambda p: p.x))) AS max_x, max(list_max(list_transform(r, lambda p: p.y))) AS max_y FROM a GROUP BY sId",
)
def tract_extent(spark, d):
    e = _rings(spark, d).select("sId", polygon.extent(F.col("r")).alias("e"))
    return e.groupBy("sId").agg(F.count(F.lit(1)).alias("n"), polygon.extent_of_group(F.col("e")).alias("e")).select("sId", "n", "e.*")


_ROLL = """WITH r AS (SELECT row_number() OVER () AS k, sId, polygon, innerRings FROM ctractpoly WHERE polygon IS NOT NULL AND len(polygon) >= 3), g AS (SELECT k, sId, 0 AS h, polygon AS r FROM r UNION ALL
SELECT k, sId, i, innerRings[i] FROM r, LATERAL (SELECT unnest(range(1, coalesce(len(innerRings), 0) + 1)) AS i) u WHERE len(innerRings[i]) > 2),
e AS (SELECT k, sId, h, r[i] AS p, r[CASE WHEN i = len(r) THEN 1 ELSE i + 1 END] AS q FROM g, LATERAL (SELECT unnest(range(1, len(r) + 1)) AS i) u),
c AS (SELECT k, sId, h, sum(p.x * q.y - q.x * p.y) / 2 AS a, sum((p.x + q.x) * (p.x * q.y - q.x * p.y)) / 6 AS mx, sum((p.y + q.y) * (p.x * q.y - q.x * p.y)) / 6 AS my, min(p.x) AS x0, min(p.y) AS y0, max(p.x) AS x1, max(p.y) AS y1 FROM e GROUP BY ALL),
s AS (SELECT k, sId, h, abs(a) * CASE WHEN h > 0 THEN -1 ELSE 1 END AS w, mx / a AS x, my / a AS y, x0, y0, x1, y1 FROM c WHERE a <> 0),
p AS (SELECT k, sId, CASE WHEN sum(w) = 0 THEN max(CASE WHEN h = 0 THEN w END) ELSE sum(w) END AS w, CASE WHEN sum(w) = 0 THEN max(CASE WHEN h = 0 THEN x END) ELSE sum(w * x) / sum(w) END AS x, CASE WHEN sum(w) = 0 THEN max(CASE WHEN h = 0 THEN y END) ELSE sum(w * y) / sum(w) END AS y, min(CASE WHEN h = 0 THEN x0 END) AS x0, min(CASE WHEN h = 0 THEN y0 END) AS y0, max(CASE WHEN h = 0 THEN x1 END) AS x1, max(CASE WHEN h = 0 THEN y1 END) AS y1 FROM s GROUP BY k, sId)
SELECT sId, count(*) AS n_polys, min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y, round(sum(w * x) / sum(w), 3) AS x, round(sum(w * y) / sum(w), 3) AS y, round(sum(w), 6) AS area FROM p GROUP BY sId"""


@query("tract_roll_up", _ROLL)
def tract_roll_up(spark, d):
    """Centroid and extent of each tract from its polygons minus their holes."""
    r = tracts.roll_up(tracts.polygons(table(spark, d, "ctractpoly")))
    c = F.col("centroid")
    return r.select("sId", "n_polys", "extent.*", (F.round(c["x"], 3) + 0.0).alias("x"), (F.round(c["y"], 3) + 0.0).alias("y"), F.round(c["area"], 6).alias("area"))


_WINDING = "sum(CASE WHEN least(p.y, q.y) <= {y} AND {y} < greatest(p.y, q.y) AND CASE WHEN q.y > p.y THEN (q.x - p.x) * ({y} - p.y) - ({x} - p.x) * (q.y - p.y) ELSE (p.x - q.x) * ({y} - q.y) - ({x} - q.x) * (p.y - q.y) END > 0 THEN CASE WHEN q.y > p.y THEN 1 ELSE -1 END ELSE 0 END)"


@query(
    "pip_centroid",
    f"""{_CLOSED}, k AS (SELECT e.*, c.centroid.x AS x, c.centroid.y AS y FROM e JOIN ctractpoly c ON e.poly_id = c.poly_id WHERE c.centroid.x IS NOT NULL AND c.centroid.y IS NOT NULL)
    SELECT poly_id, {_WINDING.format(x='x', y='y')} <> 0 AS inside FROM k GROUP BY poly_id""",
)
def pip_centroid(spark, d):
    c = table(spark, d, "ctractpoly").select("poly_id", F.col("centroid.x").alias("x"), F.col("centroid.y").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    return _rings(spark, d).join(c, "poly_id").select("poly_id", polygon.in_polygon(F.col("r"), F.col("x"), F.col("y")).alias("inside"))


@query(
    "pip_edges",
    f"{_CLOSED} SELECT poly_id, count(*) AS n, CAST(sum(CASE WHEN q.y > p.y THEN 1 ELSE -1 END) AS BIGINT) AS turn, min(least(p.y, q.y)) AS low FROM e GROUP BY poly_id",
)
def pip_edges(spark, d):
    """The oriented edge table of each ring."""
    e = _rings(spark, d).select("poly_id", F.explode(polygon.oriented_edges(F.col("r"))).alias("e"))
    return e.groupBy("poly_id").agg(F.count(F.lit(1)).alias("n"), F.sum("e.wn_inc").cast("bigint").alias("turn"), F.min("e.y0").alias("low"))


_SQUARE = "(s_suppkey % 5)::DOUBLE"


@query(
    "rect_in_poly",
    """WITH r AS (SELECT s_suppkey, (s_suppkey % 13 - 3)::DOUBLE AS x0, (s_suppkey % 11 - 3)::DOUBLE AS y0, (s_suppkey % 13 - 3 + s_suppkey % 3 + 0.5)::DOUBLE AS x1, (s_suppkey % 11 - 3 + s_suppkey % 4 + 0.25)::DOUBLE AS y1 FROM supplier)
    SELECT s_suppkey, CASE WHEN (y0 >= 0 AND y0 < 10 AND (x0 < 0 AND 0 < x1 OR x0 < 10 AND 10 < x1)) OR (y1 >= 0 AND y1 < 10 AND (x0 < 0 AND 0 < x1 OR x0 < 10 AND 10 < x1))
    OR (x0 >= 0 AND x0 < 10 AND (y0 < 0 AND 0 < y1 OR y0 < 10 AND 10 < y1)) OR (x1 >= 0 AND x1 < 10 AND (y0 < 0 AND 0 < y1 OR y0 < 10 AND 10 < y1)) THEN 'S'
    WHEN x0 >= 0 AND x0 < 10 AND y0 >= 0 AND y0 < 10 AND x1 >= 0 AND x1 < 10 AND y1 >= 0 AND y1 < 10 THEN 'I' ELSE 'O' END AS place FROM r""",
)
def rect_in_poly(spark, d):
    """Rectangles against a square of side 10."""
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))])
    k = F.col("s_suppkey")
    r = table(spark, d, "supplier").select(
        "s_suppkey", (k % 13 - 3).cast("double").alias("x0"), (k % 11 - 3).cast("double").alias("y0"),
        ((k % 13 - 3 + k % 3).cast("double") + 0.5).alias("x1"), ((k % 11 - 3 + k % 4).cast("double") + 0.25).alias("y1"),
    )
    return r.select("s_suppkey", polygon.rect_in_polygon(ring, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("place"))


# ---------------------------------------------------------------- spatial joins


def _boxes(spark, d):
    p = table(spark, d, "ctractpoly").filter("polygon IS NOT NULL AND size(polygon) >= 3").select("poly_id", polygon.extent(F.col("polygon")).alias("e"))
    return p.select("poly_id", F.col("e.min_x").alias("x_min"), F.col("e.max_x").alias("x_max"), F.col("e.min_y").alias("y_min"), F.col("e.max_y").alias("y_max"))


_BOXES = "b AS (SELECT poly_id, list_min(list_transform(polygon, lambda p: p.x)) AS x_min, list_max(list_transform(polygon, lambda p: p.x)) AS x_max, list_min(list_transform(polygon, lambda p: p.y)) AS y_min, list_max(list_transform(polygon, lambda p: p.y)) AS y_max FROM ctractpoly WHERE polygon IS NOT NULL AND len(polygon) >= 3)"


@query("box_stab", f"WITH {_BOXES} SELECT t.point_id, b.poly_id FROM tract_point t JOIN b ON t.lon BETWEEN x_min AND x_max AND t.lat BETWEEN y_min AND y_max")
def box_stab(spark, d):
    pts = table(spark, d, "tract_point").select("point_id", "lon", "lat")
    return boxes.stab_join(pts, _boxes(spark, d), "point_id", "poly_id", "lon", "lat")


@query("box_overlap", f"WITH {_BOXES} SELECT q.poly_id AS a, b.poly_id AS b FROM b AS q JOIN b ON q.x_min <= b.x_max AND q.x_max >= b.x_min AND q.y_min <= b.y_max AND q.y_max >= b.y_min")
def box_overlap(spark, d):
    b = _boxes(spark, d)
    return boxes.overlap_join(b.withColumnRenamed("poly_id", "a"), b.withColumnRenamed("poly_id", "b"), "a", "b")


_STATED = "q AS (SELECT DISTINCT sId, extent.min_lon AS x_min, extent.max_lon AS x_max, extent.min_lat AS y_min, extent.max_lat AS y_max FROM ctract WHERE extent IS NOT NULL)"


@query(
    "box_exists",
    f"WITH {_BOXES}, {_STATED} SELECT sId, bool_or(EXISTS (SELECT 1 FROM b WHERE b.poly_id % 2 = 0 AND q.x_min <= b.x_max AND q.x_max >= b.x_min AND q.y_min <= b.y_max AND q.y_max >= b.y_min)) AS found FROM q GROUP BY sId",
)
def box_exists(spark, d):
    """Stated tract extents against live boxes; boxes with an odd id are removed."""
    q = table(spark, d, "ctract").filter("extent IS NOT NULL").select("sId", F.col("extent.min_lon").alias("x_min"), F.col("extent.max_lon").alias("x_max"), F.col("extent.min_lat").alias("y_min"), F.col("extent.max_lat").alias("y_max")).distinct()
    b = _boxes(spark, d)
    live = boxes.alive(boxes.remove(b.withColumn("removed", F.lit(False)), b.filter("poly_id % 2 <> 0"), "poly_id"))
    return boxes.overlap_exists(q, live, "sId", "poly_id")


@query("box_find_node", f"WITH {_BOXES} SELECT b.* FROM b WHERE poly_id IN (SELECT s_suppkey FROM supplier)")
def box_find_node(spark, d):
    return boxes.find_node(_boxes(spark, d), table(spark, d, "supplier").select(F.col("s_suppkey").alias("poly_id")), "poly_id")


_TRACTS = _P4[: _P4.index(", k AS (SELECT DISTINCT point_id")]


@query(
    "find_tract",
    f"""{_TRACTS}, o AS (SELECT point_id, poly_id, sId, NOT coalesce(bool_or(h > 0 AND inside), false) AS ok FROM w GROUP BY ALL HAVING bool_or(h = 0 AND inside)), a AS (SELECT point_id, bool_or(ok) AS found FROM o GROUP BY point_id)
    SELECT DISTINCT o.point_id, sId FROM o JOIN a ON o.point_id = a.point_id WHERE ok OR NOT found""",
)
def find_tract(spark, d):
    """Tracts of each point; where it lies only in holes, those tracts."""
    return tracts.find_tracts(table(spark, d, "tract_point"), tracts.polygons(table(spark, d, "ctractpoly")), allow_in_holes=True)


@query(
    "find_tract_outer",
    f"""{_CLOSED}, {_BOXES}, h AS (SELECT t.point_id, t.lon, t.lat, b.poly_id FROM tract_point t JOIN b ON t.lon BETWEEN x_min AND x_max AND t.lat BETWEEN y_min AND y_max WHERE t.lat BETWEEN -90 AND 90 AND t.lon BETWEEN -180 AND 180),
    w AS (SELECT point_id, e.poly_id, e.sId, {_WINDING.format(x='h.lon', y='h.lat')} <> 0 AS inside FROM h JOIN e ON h.poly_id = e.poly_id GROUP BY ALL) SELECT DISTINCT point_id, sId FROM w WHERE inside""",
)
def find_tract_outer(spark, d):
    return tracts.find_tracts(table(spark, d, "tract_point"), tracts.polygons(table(spark, d, "ctractpoly")), ignore_holes=True)


@query("tract_ids", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '01' || '002' || '9' || printf('%04.2f', s_suppkey / 100.0) WHEN 1 THEN '01' || '002' || s_suppkey::VARCHAR ELSE 'G' || s_suppkey::VARCHAR END AS tract_id FROM supplier")
def tract_ids(spark, d):
    k = F.col("s_suppkey").cast("string")
    a = F.create_map(F.lit("ST"), F.lit("01"), F.lit("CO"), F.lit("002"), F.lit("TRACTBASE"), F.lit("9"), F.lit("TRACT_NAME"), F.format_string("%.2f", F.col("s_suppkey") / 100), F.lit("STATE"), F.lit("01"), F.lit("COUNTY"), F.lit("002"), F.lit("TRACT"), k, F.lit("GEOID"), F.concat(F.lit("G"), k))
    s = table(spark, d, "supplier").select("s_suppkey", a.alias("a"))
    by = [tracts.tract_id(v, F.col("a")) for v in (1990, 2000, 2015)]
    return s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, by[0]).when(F.col("s_suppkey") % 3 == 1, by[1]).otherwise(by[2]).alias("tract_id"))


@query("state_codes", "SELECT n_name, (n_nationkey * 3 + 1)::INTEGER AS code, n_nationkey * 3 + 1 <= 56 AND n_nationkey * 3 + 1 NOT IN (3, 7, 14, 43, 52) AS used FROM nation")
def state_codes(spark, d):
    code = (F.col("n_nationkey") * 3 + 1).cast("int")
    return table(spark, d, "nation").select("n_name", code.alias("code"), F.array_contains(tracts.state_codes(), code).alias("used"))


# ---------------------------------------------------------------- mercator (M2-M8)


@query(
    "mercator_xy",
    "SELECT point_id, round(ln(tan(pi() / 4 + radians(lat) / 2)), 9) AS y, round(degrees(2 * atan(exp(ln(tan(pi() / 4 + radians(lat) / 2)))) - pi() / 2), 4) AS back FROM tract_point WHERE abs(lat) < 85 AND lon IS NOT NULL",
)
def mercator_xy(spark, d):
    y = mercator.deg_to_y(F.col("lat"))
    t = table(spark, d, "tract_point").filter("abs(lat) < 85 AND lon IS NOT NULL")
    return t.select("point_id", F.round(y, 9).alias("y"), F.round(mercator.y_to_deg(y), 4).alias("back"))


_Y = "ln(tan(pi() / 4 + radians({}) / 2))"


@query(
    "which_pixel",
    f"""WITH g AS (SELECT point_id, (lon + 170) / (40.0 / 800) AS x, ({_Y.format('lat')} - {_Y.format('45.0')}) / (({_Y.format('60.0')} - {_Y.format('45.0')}) / 600) AS y FROM tract_point WHERE abs(lon) <= 180 AND abs(lat) < 85)
    SELECT point_id, CAST(trunc(CASE WHEN x < 0 THEN x - 1 ELSE x END) AS INTEGER) AS px, 600 - CAST(trunc(CASE WHEN y < 0 THEN y - 1 ELSE y END) AS INTEGER) - 1 AS py FROM g""",
)
def which_pixel(spark, d):
    g = mercator.Grid.over((-170.0, 45.0, -130.0, 60.0), (800, 600))
    t = table(spark, d, "tract_point").filter("abs(lon) <= 180 AND abs(lat) < 85")
    return t.select("point_id", g.which_pixel(F.col("lon"), F.col("lat")).alias("p")).select("point_id", "p.*")


@query(
    "pixel_to_deg",
    f"""WITH k AS (SELECT s_suppkey, s_suppkey % 800 AS px, s_suppkey % 600 AS py FROM supplier), a AS (SELECT *, round(-170.0 + px * (40.0 / 800), 6) AS lon, round(degrees(2 * atan(exp({_Y.format('45.0')} + (599 - py) * (({_Y.format('60.0')} - {_Y.format('45.0')}) / 600))) - pi() / 2), 6) AS lat FROM k)
    SELECT s_suppkey, lon, lat, lat AS table_lat FROM a""",
)
def pixel_to_deg(spark, d):
    g = mercator.Grid.over((-170.0, 45.0, -130.0, 60.0), (800, 600))
    k = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 800).alias("px"), (F.col("s_suppkey") % 600).alias("py"))
    both = k.select("s_suppkey", g.pixel_to_deg(F.col("px"), F.col("py")).alias("a"), g.pixel_to_deg_table(F.col("px"), F.col("py")).alias("b"))
    return rounded(both.select("s_suppkey", "a.lon", "a.lat", F.col("b.lat").alias("table_lat")))


# ---------------------------------------------------------------- bits


def _bits(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), (F.col("o_orderkey") % 100).cast("int").alias("i"), (F.col("o_orderkey") % 3).alias("side")).distinct()
    g = o.groupBy("k").agg(F.collect_set(F.when(F.col("side") == 0, F.col("i"))).alias("a"), F.collect_set(F.when(F.col("side") != 0, F.col("i"))).alias("b"))
    return g.select("k", bitset.from_positions(F.col("a"), 100).alias("a"), bitset.from_positions(F.col("b"), 100).alias("b"))


_SETS = "s AS (SELECT DISTINCT o_custkey % 50 AS k, o_orderkey % 100 AS i, o_orderkey % 3 = 0 AS side FROM orders), m AS (SELECT k, i, bool_or(side) AS a, bool_or(NOT side) AS b FROM s GROUP BY k, i)"


@query("bitset_and_or_xor", f"WITH {_SETS} SELECT k, CAST(sum(CASE WHEN a AND b THEN 1 ELSE 0 END) AS BIGINT) AS n_and, count(*) AS n_or, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS n_xor FROM m GROUP BY k")
def bitset_and_or_xor(spark, d):
    a, b = F.col("a"), F.col("b")
    n = lambda o: bitset.count(bitset.bitwise(a, b, o)).cast("bigint")
    return _bits(spark, d).select("k", n("and").alias("n_and"), n("or").alias("n_or"), n("xor").alias("n_xor"))


@query("bitset_slice", f"WITH {_SETS}, g AS (SELECT DISTINCT k FROM m) SELECT g.k, string_agg(CASE WHEN coalesce(m.a, false) THEN '1' ELSE '0' END, '' ORDER BY r.i) AS bits FROM g CROSS JOIN (SELECT unnest(range(60, 70)) AS i) r LEFT JOIN m ON m.k = g.k AND m.i = r.i GROUP BY g.k")
def bitset_slice(spark, d):
    return _bits(spark, d).select("k", F.array_join(F.transform(bitset.test_slice(F.col("a"), 60, 70), lambda x: x.cast("string")), "").alias("bits"))


@query("bitset_set_test", f"WITH {_SETS}, g AS (SELECT DISTINCT k FROM m) SELECT g.k, 1 AS set_bit, 0 AS cleared, CASE WHEN coalesce(bool_or(m.i = 65 AND m.a), false) THEN 1 ELSE 0 END AS other, '101' AS run FROM g LEFT JOIN m ON m.k = g.k GROUP BY g.k")
def bitset_set_test(spark, d):
    s = _bits(spark, d)
    one, zero = (bitset.put(F.col("a"), F.lit(64), F.lit(v), 100) for v in (1, 0))
    run = bitset.test_slice(bitset.put_bits(F.col("a"), 63, "0b101", 100), 63, 66)
    return s.select("k", bitset.test(one, F.lit(64), 100).alias("set_bit"), bitset.test(zero, F.lit(64), 100).alias("cleared"), bitset.test(one, F.lit(65), 100).alias("other"), F.array_join(F.transform(run, lambda x: x.cast("string")), "").alias("run"))


@query("bitset_insert", f"WITH {_SETS}, g AS (SELECT DISTINCT k FROM m), t AS (SELECT g.k, string_agg(CASE WHEN coalesce(m.a, false) THEN '1' ELSE '0' END, '' ORDER BY r.i) AS b FROM g CROSS JOIN (SELECT unnest(range(0, 100)) AS i) r LEFT JOIN m ON m.k = g.k AND m.i = r.i GROUP BY g.k) SELECT k, b[1:5] || '11' || b[6:] AS bits, 102 AS n FROM t")
def bitset_insert(spark, d):
    s = _bits(spark, d).select("k", bitset.insert(bitset.to_bits(F.col("a"), 100), 5, F.lit("11")).alias("bits"))
    return s.select("k", "bits", F.length("bits").alias("n"))


# ---------------------------------------------------------------- formats


_CELL_KIND = r"""CASE WHEN c LIKE '"%"' AND length(c) > 1 THEN 'str' WHEN c LIKE '%\%' ESCAPE '\' THEN CASE WHEN regexp_matches(c[:-2], '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$') THEN 'pct' ELSE 'str' END
WHEN regexp_matches(c, '^[+-]?\d+$') THEN CASE WHEN TRY_CAST(c AS BIGINT) IS NULL THEN 'str' ELSE 'int' END WHEN regexp_matches(c, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:nan|inf|infinity)$') THEN 'float' ELSE 'str' END"""
_LOOSE_CELLS = r"""l AS (SELECT regexp_replace(line, '[\r\n]+$', '') || ',' AS t FROM csv_line WHERE trim(regexp_replace(line, '[\r\n]', '', 'g')) <> ''),
p AS (SELECT regexp_extract_all(t, '\s*(?:"[^"]*"|''[^'']*'')\s*,|[^,]*,') AS p FROM l), u AS (SELECT unnest(p)[:-2] AS c, generate_subscripts(p, 1) AS i FROM p WHERE len(p) = 23), v AS (SELECT i, regexp_replace(c, '^\s+|\s+$', '', 'g') AS c FROM u)"""


@query("csv_cells", f"WITH {_LOOSE_CELLS} SELECT [{', '.join(repr(c) for c in badrows.COLUMNS)}][i] AS name, {_CELL_KIND} AS kind, count(*) AS n FROM v GROUP BY ALL")
def csv_cells(spark, d):
    """Kinds of the loosely typed cells of every line that splits into 23."""
    head = ",".join(f'"{c}"' for c in badrows.COLUMNS)
    cells = csvtext.long_cells(spread(table(spark, d, "csv_line").select("line")), head, ",", strict=False)
    return cells.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("csv_file", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_file(spark, d):
    """A table written as text files and read back with the columns' types found again."""
    fields, path = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], shared_path(spark, "csv_file")
    csvtext.write_csv(table(spark, d, "customer"), path, fields, delim=";", quote=True, sort="c_name")
    return csvtext.read_csv(spark, path)


@query("kvp_file", "SELECT 'k' || n_nationkey AS key, 'str' AS kind, '\"' || n_name || '\"' AS value, NULL::VARCHAR AS error FROM nation")
def kvp_file(spark, d):
    """Key-value lines written as text files and read by the data source."""
    register.register(spark)
    path = shared_path(spark, "kvp_file")
    n = table(spark, d, "nation").select(F.lit("d").alias("doc_id"), F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.lit("str").alias("kind"), F.to_json(F.array("n_name")).alias("value"))
    kvp.write_lines(n.withColumn("value", F.expr("substring(value, 2, length(value) - 2)"))).select("line").write.text(path)
    return spark.read.format("kvp").load(path).select("key", "kind", "value", "error")


@query("yaml_file", "SELECT n_name AS name, n_nationkey::BIGINT AS nationkey, 2 AS n_keys FROM nation")
def yaml_file(spark, d):
    """Records saved as one file each and read by the data source, with provenance simplified away."""
    register.register(spark)
    path = shared_path(spark, "yaml_file").removeprefix("file:")
    n = table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.struct(F.col("n_nationkey").alias("value"), F.lit("t").alias("prov")).alias("nationkey"), F.col("n_name").alias("name"))).alias("record"))
    yamlfiles.save_folder(n, path, "n_nationkey")
    got = spark.read.format("yaml_records").option("simplified", "true").load(path).filter("error IS NULL")
    return got.select(F.get_json_object("record", "$.name").alias("name"), F.get_json_object("record", "$.nationkey").cast("bigint").alias("nationkey"), F.size("keys").alias("n_keys"))


@query(
    "ogr_file",
    """WITH r AS (SELECT poly_id, sId, polygon FROM ctractpoly WHERE len(polygon) >= 3) SELECT poly_id, sId, len(polygon)::INTEGER AS n_points, round(list_min(list_transform(polygon, lambda p: p.x)), 6) AS min_x, round(list_max(list_transform(polygon, lambda p: p.y)), 6) AS max_y FROM r""",
)
def ogr_file(spark, d):
    """Tract polygons written as shape listings and read back."""
    path = shared_path(spark, "ogr_file")
    t = table(spark, d, "ctractpoly").filter("size(polygon) >= 3 AND NOT exists(polygon, p -> p.x IS NULL OR p.y IS NULL)")
    ring = F.array_join(F.transform("polygon", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",")
    k = F.col("poly_id").cast("string")
    text = F.concat(F.lit("OGRFeature(tract):"), k, F.lit("\n  ID (Integer) = "), k, F.lit("\n  GEOID (String) = "), F.coalesce("sId", F.lit("")), F.lit("\n  POLYGON (("), ring, F.lit("))\n"))
    t.select(text).write.text(path)
    a, p = F.col("attrs"), F.col("polygons")[0][0]
    got = ogr.read_shapes(spark, path).select(a["ID"].cast("bigint").alias("poly_id"), F.nullif(a["GEOID"], F.lit("")).alias("sId"), F.size(p).alias("n_points"), F.array_min(F.transform(p, lambda q: q["x"])).alias("min_x"), F.array_max(F.transform(p, lambda q: q["y"])).alias("max_y"))
    return got.select("poly_id", "sId", "n_points", F.round("min_x", 6).alias("min_x"), F.round("max_y", 6).alias("max_y"))


@query(
    "csv_infer",
    """SELECT p_partkey, 'int' AS k_size, p_size::BIGINT AS size, 'float' AS k_price, p_retailprice AS price, 'str' AS k_brand, p_brand AS brand, 'pct' AS k_pct, round(0.01::DOUBLE * p_size, 9) AS pct, 'str' AS k_quoted, p_size::VARCHAR AS quoted FROM part""",
)
def csv_infer(spark, d):
    """Lines written from a table and read again: quoted text stays text, even digits."""
    p = table(spark, d, "part")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    size = F.col("p_size").cast("string")
    lines = p.select("p_partkey", F.concat_ws(",", size, F.concat(F.format_string("%.2f", "p_retailprice")), q(F.col("p_brand")), F.concat(size, F.lit("%")), q(size)).alias("line"))
    c = csvtext.parse_cells(lines, '"size","price","brand","pct","quoted"', ",", carry=["p_partkey"])
    return c.select(
        "p_partkey", F.col("size.kind").alias("k_size"), F.col("size.i").alias("size"), F.lit("float").alias("k_price"), F.coalesce("price.f", F.col("price.i").cast("double")).alias("price"),
        F.col("brand.kind").alias("k_brand"), F.col("brand.s").alias("brand"), F.col("pct.kind").alias("k_pct"), F.round("pct.f", 9).alias("pct"), F.col("quoted.kind").alias("k_quoted"), F.col("quoted.s").alias("quoted"),
    )


@query("csv_write", """SELECT 'c_custkey,c_name,c_mktsegment' AS line UNION ALL SELECT c_custkey::VARCHAR || ',' || coalesce(c_name, 'NA') || ',' || coalesce(c_mktsegment, 'NA') FROM customer""")
def csv_write(spark, d):
    return csvtext.render_rows(table(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"], sort="c_mktsegment").select("line")


@query("csv_sort", """SELECT row_number() OVER (ORDER BY lower(s), line) AS line_no, line FROM (SELECT n_name AS s, '"' || n_name || '",' || n_regionkey AS line FROM nation) UNION ALL SELECT 0, '"n_name","n_regionkey"'""")
def csv_sort(spark, d):
    return csvtext.render_rows(table(spark, d, "nation"), ["n_name", "n_regionkey"], quote=True, sort="n_name")


@query("kvp_parse", "SELECT event_id::VARCHAR AS doc_id, 'k' AS key, 'int' AS kind, regexp_extract(props, '\"k\": *([0-9]+)', 1) AS value FROM events WHERE regexp_matches(props, '\"k\": *[0-9]+')")
def kvp_parse(spark, d):
    """Event properties as key-value lines; later lines of a key win."""
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    e = spread(table(spark, d, "events").select("event_id", "props")).filter(F.col("props").rlike(r'"k": *[0-9]+'))
    lines = e.select(F.col("event_id").cast("string").alias("doc_id"), F.posexplode(F.array(F.lit("# a comment"), F.lit("k = 'old' # replaced"), F.concat(F.lit("k ="), k))).alias("seq", "line"))
    return kvp.parse_documents(lines)


@query("kvp_round_trip", "SELECT p_partkey::VARCHAR AS doc_id, k.key, k.kind, k.value FROM part, LATERAL (SELECT unnest([{'key': 'brand', 'kind': 'str', 'value': '\"' || p_brand || '\"'}, {'key': 'size', 'kind': 'int', 'value': p_size::VARCHAR}, {'key': 'flag', 'kind': 'bool', 'value': 'true'}]) AS k)")
def kvp_round_trip(spark, d):
    """Written and read again."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), "p_brand", "p_size")
    rows = p.select("doc_id", F.explode(F.array(
        F.struct(F.lit("brand").alias("key"), F.lit("str").alias("kind"), F.concat(F.lit('"'), F.col("p_brand"), F.lit('"')).alias("value")),
        F.struct(F.lit("size").alias("key"), F.lit("int").alias("kind"), F.col("p_size").cast("string").alias("value")),
        F.struct(F.lit("flag").alias("key"), F.lit("bool").alias("kind"), F.lit("true").alias("value")),
    )).alias("r")).select("doc_id", "r.*")
    return kvp.parse_documents(kvp.write_lines(rows).withColumn("seq", F.lit(0)))


@query("yaml_simplify")
def yaml_simplify(spark, d):
    return yamlfiles.simplify_json(spread(table(spark, d, "yaml_rec").select("rec_id", "doc")), "rec_id", "doc")


@query(
    "yaml_scalars",
    """WITH d AS (SELECT rec_id, doc::JSON AS j FROM yaml_rec WHERE json_valid(doc) AND json_type(doc) = 'OBJECT'), c AS (SELECT rec_id, list_contains(json_keys(j), 'value') AS cut, CASE WHEN list_contains(json_keys(j), 'value') THEN j -> '$.value' ELSE j END AS j FROM d),
    k AS (SELECT rec_id, cut, j, unnest(json_keys(j)) AS key FROM c WHERE json_type(j) = 'OBJECT'), v AS (SELECT rec_id, cut, key, j -> ('$."' || key || '"') AS v FROM k WHERE cut OR (key <> 'prov' AND NOT contains(key, '_prov'))),
    o AS (SELECT rec_id, key, CASE WHEN NOT cut AND json_type(v) = 'OBJECT' AND list_contains(json_keys(v), 'value') THEN v -> '$.value' ELSE v END AS v FROM v) SELECT rec_id, count(*) AS n, string_agg(key, ',' ORDER BY key) AS keys, sum(length(v ->> '$'))::BIGINT AS letters FROM o WHERE json_type(v) = 'VARCHAR' GROUP BY rec_id""",
)
def yaml_scalars(spark, d):
    """The top-level texts of every record once it is simplified."""
    s = yamlfiles.simplify_json(spread(table(spark, d, "yaml_rec").select("rec_id", "doc")), "rec_id", "doc").select("rec_id", F.parse_json("simplified").alias("v")).filter("schema_of_variant(v) LIKE 'OBJECT%'")
    each = s.select("rec_id", F.explode(F.map_entries(s["v"].cast("map<string,variant>"))).alias("e")).select("rec_id", "e.key", "e.value").filter("schema_of_variant(value) = 'STRING'")
    return each.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"), F.sum(F.length(F.col("value").cast("string"))).alias("letters"))


@query("yaml_key_union", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(doc)) AS key FROM yaml_rec WHERE json_valid(doc)) GROUP BY key")
def yaml_key_union(spark, d):
    """Top-level keys of all whole records with their counts."""
    keys = F.explode(F.json_object_keys("doc"))
    return table(spark, d, "yaml_rec").select(keys.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("ogr_wkt", "SELECT s_suppkey AS id, 0::BIGINT AS feature_no, s_name AS name, 2 AS n_polys, 2 AS n_rings, s_suppkey::DOUBLE AS x0, 4 AS hole_points FROM supplier")
def ogr_wkt(spark, d):
    """Listings made of suppliers and parsed again."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("INFO: Open\nLayer name: x OGRFeature count 1\nOGRFeature(x):0\n  NAME (String) = "), F.col("s_name"), F.lit("\n  MULTIPOLYGON ((("), k, F.lit(" 0,9 0,9 9,0 9),(1 1,2 1,2 2,1 1)),((20 20,21 20,21 21,20 20)))\n"))
    f = ogr.parse_features(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), text.alias("text")), "text", ["id"], discard_inner=False)
    p = F.col("polygons")
    return f.select("id", F.col("feature_no").cast("bigint").alias("feature_no"), F.element_at("attrs", "NAME").alias("name"), F.size(p).alias("n_polys"), F.size(p[0]).alias("n_rings"), p[0][0][0]["x"].alias("x0"), F.size(p[0][1]).alias("hole_points"))


@query("multival_pack", "SELECT p_brand, count(*) AS n, CAST(round(sum(p_size)) AS BIGINT) AS total FROM part GROUP BY p_brand")
def multival_pack(spark, d):
    """Packed as 32-bit floats with their names and unpacked."""
    # a block of rows a value, so that no value holds a brand of any size
    rows = table(spark, d, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 10_000)).agg(F.collect_list(F.array(F.col("p_partkey").cast("double"), F.col("p_size").cast("double"))).alias("r"))
    u = rows.select("p_brand", packed.unpack_named(packed.pack_named(F.col("r"), ["p_partkey", "p_size"])).alias("u"))
    r = u.select("p_brand", F.explode("u.rows").alias("r"))
    return r.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("r")[1])).cast("bigint").alias("total"))


# ---------------------------------------------------------------- hierarchy, records, text


@query(
    "hierarchy_closure",
    """WITH RECURSIVE l AS (SELECT doc_id, parent_id FROM documents WHERE doc_id IS NOT NULL AND parent_id IS NOT NULL), n AS (SELECT doc_id AS node FROM l UNION SELECT parent_id FROM l),
    r AS (SELECT node, node AS ancestor FROM n UNION SELECT r.node, l.parent_id FROM r JOIN l ON r.ancestor = l.doc_id) SELECT node, count(*) AS n_ancestors, min(ancestor) AS first FROM r GROUP BY node""",
)
def hierarchy_closure(spark, d):
    """Posts and all posts above them."""
    c = hierarchy.closure(table(spark, d, "documents"), "doc_id", "parent_id")
    return c.groupBy("node").agg(F.count(F.lit(1)).alias("n_ancestors"), F.min("ancestor").alias("first"))


@query("hierarchy_is_instance", "SELECT a.n_name AS node, r_name AS ancestor, a.n_regionkey = r_regionkey AS is_instance FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25 JOIN region ON b.n_regionkey = r_regionkey")
def hierarchy_is_instance(spark, d):
    """Each nation against the region of the next one."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    links = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("c"), F.col("r_name").alias("p"))
    after = links.select(((F.col("k") + 24) % 25).alias("k"), F.col("p").alias("ancestor"))
    return hierarchy.is_instance(links.select("k", F.col("c").alias("node")).join(after, "k").select("node", "ancestor"), hierarchy.closure(links, "c", "p"))


@query("enum_decode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS code, 'Order(status=' || o_orderstatus || ', key=' || o_orderkey || ', pri=''' || o_orderpriority || ''')' AS text FROM orders")
def enum_decode(spark, d):
    status = records.Enum("F", "O", "P")
    o = table(spark, d, "orders").select("o_orderkey", records.record(status=status.number(F.col("o_orderstatus")), key=F.col("o_orderkey"), pri=F.col("o_orderpriority")).alias("r"))
    return o.select("o_orderkey", F.col("r.status").alias("code"), records.record_text("Order", F.col("r"), {"status": status, "key": "bigint", "pri": "string"}).alias("text"))


@query("default_dict", "SELECT c_custkey, coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END, lower(c_mktsegment)) AS code FROM customer")
def default_dict(spark, d):
    m = F.create_map(F.lit("BUILDING"), F.lit("b"), F.lit("MACHINERY"), F.lit("m"))
    return table(spark, d, "customer").select("c_custkey", records.with_default(m, F.col("c_mktsegment"), F.lower).alias("code"))


@query("key_union", "SELECT key, count(*) AS n FROM (SELECT DISTINCT rec_id, unnest(list_concat(json_keys(doc), ['abbrev', 'size'])) AS key FROM yaml_rec WHERE json_valid(doc) AND json_type(doc) = 'OBJECT') GROUP BY key")
def key_union(spark, d):
    """Keys of whole records with two more added to each set."""
    r = table(spark, d, "yaml_rec").select("rec_id", F.json_object_keys("doc").alias("k")).filter("k IS NOT NULL")
    return r.select(F.explode(F.array_union("k", F.array(F.lit("abbrev"), F.lit("size")))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- streams


@query(
    "stream_statistics",
    "SELECT event_type, count(value) AS count, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdv, min(value) AS min, max(value) AS max FROM events GROUP BY event_type",
)
def stream_statistics(spark, d):
    """The accumulators of a stream that is read to its present end."""
    return rounded(streams.run_available(streams.running_statistics(streams.table_stream(spark, d, "events"), ["event_type"], "value"), ["event_type"]))


@query("stream_histogram", _BINS.format(q="5::DOUBLE"))
def stream_histogram(spark, d):
    return streams.run_available(streams.running_histogram(streams.table_stream(spark, d, "events"), ["event_type"], "value", 5.0), ["event_type", "bin"])
