"""Expressions over tables: against SQL, against the document evaluator, and by their plans."""

import json

import pytest
from pyspark.sql import functions as F

from compare import rows_of, sql_rows
from pathframe import queries as Q
from pathframe.api import compile
from pathframe.errors import EvalError, code_of
from pathframe.plans.values import Unsupported

SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    got = rows_of(Q.queries()[name](spark, small))
    assert got == sql_rows(small, SQL[name])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = _plan(Q.queries()["group_filtered"](spark, small))
    assert "GreaterThan(l_quantity,45.0)" in plan
    assert "l_tax" not in plan and "l_shipdate" not in plan


def test_joins_are_hash_or_merge_joins(spark, small):
    for name in ("join_equi", "join_multi", "join_implicit", "semi_join", "anti_join", "lookup_left"):
        plan = _plan(Q.queries()[name](spark, small))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_aggregates_over_one_sequence_share_a_scan(spark, small):
    assert _plan(Q.queries()["scan_fusion"](spark, small)).count("Scan parquet") == 1
    assert _plan(Q.queries()["agg_min_max"](spark, small)).count("Scan parquet") == 1


def test_top_k_is_not_a_full_sort(spark, small):
    assert "TakeOrderedAndProject" in _plan(Q.queries()["sort_limit"](spark, small))


def test_no_python_in_typed_queries(spark, small):
    for name in (n for n in Q.QUERIES if not n.startswith("dynamic")):
        plan = _plan(Q.queries()[name](spark, small))
        assert "Python" not in plan and "Arrow" not in plan, name


ROW_EXPRESSIONS = [
    "o_totalprice * 2 - 1", "o_orderstatus & '-' & o_orderkey", "o_totalprice > 100000 ? 'b' : 's'", "$uppercase(o_orderpriority)", "$substring(o_orderpriority, 2)",
    "$substring(o_orderpriority, -3, 2)", "$split(o_orderpriority, '-')", "$round(o_totalprice)", "$length(o_orderpriority)", "$count(lines)", "$sum(lines.l_quantity)", "lines[l_quantity > 20].l_linenumber",
    "$sum(lines.(l_quantity * l_extendedprice)) > 0", "lines^(>l_quantity)[0].l_quantity", "$map(lines, function($l, $i) { $l.l_quantity + $i })", "$max(lines.l_quantity)", "nothing", "$exists(lines)",
    "o_orderkey in [1, 2, 3]", "$string(o_totalprice)", "$not(o_orderkey = 3)", "$contains(o_orderpriority, /[0-9]/)", "$reduce(lines.l_quantity, function($a, $b) { $a + $b })", "$join($split(o_orderpriority, ''), '.')",
    "$pad(o_orderstatus, 3, '*')", "$keys({'a': o_orderkey})", "$number('12') + 1", "o_orderkey % 7", "o_orderkey / 0 > 1", "$boolean(lines)", "$distinct(lines.l_returnflag)", "$reverse(lines.l_linenumber)",
    r"$replace(o_orderpriority, /[A-Z]/, '\\\\')", r"$replace(o_orderpriority, /([A-Z])/, '\\\\$1$$')", r"$replace(o_orderpriority, /[A-Z]/, '\\\\$x')", "$decodeUrl('a%2Bb%20+%41%2f')", "$decodeUrl($encodeUrl(o_orderpriority & '+/?é'))",
]


@pytest.mark.parametrize("text", ROW_EXPRESSIONS)
def test_columns_equal_documents(spark, small, text):
    """The same expression as a Column and over the row's JSON."""
    tables = {t: spark.read.parquet(f"{small}/{t}.parquet") for t in ("orders", "lineitem")}
    df = Q._with_lines(tables)["orders"].drop("o_orderdate").where("o_orderkey < 200")
    e = compile(text)
    rows = df.select(e.as_column(df, strict=True).alias("v"), F.to_json(F.struct("*")).alias("d")).collect()

    def plain(v):
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    def collapsed(v):
        return (v[0] if len(v) == 1 else None if not v else v) if isinstance(v, list) else v

    for r in rows:
        expected = e.evaluate(json.loads(r.d))
        got, expected = plain(r.v), plain(expected)
        assert collapsed(got) == collapsed(expected) or got == pytest.approx(expected, rel=1e-9), (r.d, got, expected)


def test_fallback_to_documents(spark):
    df = spark.createDataFrame([(1, "x"), (5, None)], "n int, s string")
    e = compile("($f := function($n) { $n < 2 ? 1 : $n * $f($n - 1) }; {'f': $f(n), 's': s})")
    with pytest.raises(Unsupported):
        e.as_column(df, strict=True)
    got = [r[0] for r in df.select(e.as_column(df)).collect()]
    assert list(map(json.loads, got)) == [{"f": 1, "s": "x"}, {"f": 120}]


def test_static_type_errors(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    for text, code in (("orders[o_orderstatus > 1]", "T2009"), ("orders.(o_orderstatus + 1)", "T2001"), ("$sum(orders.o_orderstatus)", "T0412"), ("orders{o_orderkey: 1}", "T1003")):
        with pytest.raises(EvalError) as e:
            compile(text).on({"orders": orders})
        assert e.value.code == code


def test_nulls_are_missing(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, None), (None, "c", 0.0)], "k int, s string, v double")
    t = {"t": df}
    assert [r[0] for r in compile("t.s").on(t).collect()] == ["a", "c"]
    assert [r[0] for r in compile("t[s = nothing].k").on(t).collect()] == []
    assert [r[0] for r in compile("t[s != 'a'].v").on(t).collect()] == [0.0]
    assert sorted((r.key, r.n) for r in compile("t{s: {'n': $count(k)}}").on(t).collect()) == [("a", 1.0), ("c", 0.0)]
    assert [r.x for r in compile("t.{'x': v ?: -1}").on(t).collect()] == [2.0, -1.0, -1.0]
    assert compile("$sum(t.v)").on({"t": df.where("false")}).collect()[0][0] is None


def test_streaming_rows(spark, small, tmp_path):
    """Row expressions run unchanged on a stream."""
    from pathframe.streaming.rows import select_stream

    spark.read.parquet(f"{small}/customer.parquet").limit(40).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").parquet(str(tmp_path / "in"))
    out = select_stream(compile('{"k": c_custkey, "s": $uppercase(c_mktsegment)}'), stream)
    q = out.writeStream.format("memory").queryName("rows_out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("rows_out").count() == 40


def test_dynamic_steps_over_tables(spark, small):
    nation = {"nation": spark.read.parquet(f"{small}/nation.parquet")}
    got = [r[0] for r in compile('nation[n_nationkey < 3].$formatInteger(n_nationkey, "w")').on(nation).collect()]
    assert got == ['"zero"', '"one"', '"two"']
    text = "( $f := function($n) { $n < 2 ? 1 : $n * $f($n - 1) }; nation[n_nationkey < 5].($f(n_nationkey)) )"
    assert [r[0] for r in compile(text).on(nation).collect()] == ["1", "1", "2", "6", "24"]
    assert [r[0] for r in compile('nation.n_nationkey[$ < 2].($formatNumber($, "00"))').on(nation).collect()] == ['"00"', '"01"']


def test_registered_columns(spark, small):
    nation = spark.read.parquet(f"{small}/nation.parquet")
    e = compile("nation[n_nationkey = 3].{'v': $shout(n_name)}").register_column("shout", lambda c: F.concat(F.upper(c), F.lit("!")), "string", lambda s: s.upper() + "!")
    got = e.on({"nation": nation}).collect()[0].v
    assert got == e.evaluate({"nation": [r.asDict() for r in nation.collect()]})["v"]


TABLE_EXPRESSIONS = [
    "nation.n_name", "nation[n_regionkey = 1].n_name", "nation[0].n_name", "nation[-1].n_name".replace("[-1]", "^(n_nationkey)[-1]"), "nation.n_name[0]", "nation.(n_name & '!')", "nation.[n_nationkey, n_regionkey]",
    "nation.{'a': n_name, 'b': n_regionkey > 2 ? 'hi'}", "nation^(>n_regionkey, n_name).n_nationkey", "nation^(n_name)[[2..4]].n_name", "$count(nation)", "$sum(nation.n_nationkey)", "$sum(nation[n_nationkey > 99].n_nationkey)",
    "nation{$string(n_regionkey): $count($)}", "nation{$string(n_regionkey): $max(n_nationkey)}", "nation[n_nationkey < 6]{n_name: $sum(n_regionkey)}", "region@$r.nation@$n[$r.r_regionkey = $n.n_regionkey].{'r': $r.r_name, 'n': $n.n_name}",
    "region@$r.nation[$r.r_regionkey = n_regionkey].n_name", "nation[n_regionkey in $$.region[r_name != 'ASIA'].r_regionkey].n_name", "nation[$not(n_nationkey in $$.supplier.s_nationkey)].n_nationkey", "$distinct(nation.n_regionkey)",
    "[nation.n_regionkey, region.r_regionkey]", "$append(nation.n_name, region.r_name)", "nation#$i[$i < 3].{'i': $i, 'n': n_name}", "nation[n_nationkey < 5]#$i.{'i': $i}", "region.($k := r_regionkey; {'r': r_name, 'n': $count($$.nation[n_regionkey = $k])})",
    "($x := nation[n_regionkey > 1]; {'n': $count($x), 's': $sum($x.n_nationkey), 'a': $average($x.n_nationkey)})", "nation ~> |$[n_regionkey = 1]|{'n_name': 'x'}|", "$map(nation, function($n) { $n.n_nationkey * 2 })", "$filter(nation, function($n) { $n.n_regionkey = 4 }).n_name",
    "nation.nothing", "nation[nothing].n_name", "nation.$uppercase(n_name)", "nation.$substring(n_name, 1, 3)", "$sort(nation.n_name)", "$max(nation.n_nationkey) - $min(nation.n_nationkey)", "nation[n_name = 3].n_name", "nation[n_name != 3].n_nationkey",
    "$exists(nothing)", "nation.n_nationkey[$ > 20]", "nation.(n_nationkey > 3 and n_regionkey < 2)", "supplier.{'v': $round(s_acctbal)}", "supplier[s_acctbal > 0 or s_nationkey = 3]{$string(s_nationkey): {'n': $count($), 'p': $count($[s_acctbal > 5000])}}",
]


@pytest.mark.parametrize("text", TABLE_EXPRESSIONS)
def test_tables_equal_documents(spark, small, text):
    """The same expression over tables and over the same rows as one document."""
    names = ("nation", "region", "supplier")
    tables = {t: spark.read.parquet(f"{small}/{t}.parquet") for t in names}
    document = {t: [r.asDict() for r in df.collect()] for t, df in tables.items()}
    expected = compile(text).evaluate(document)
    df = compile(text).on(tables)

    def shown(v):
        if isinstance(v, dict):
            return str(sorted((k, shown(x)) for k, x in v.items() if x is not None))
        if isinstance(v, (list, tuple)):
            return str([shown(x) for x in v])
        return repr(float(f"{v:.11g}") + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)

    rows = [r.asDict(True) for r in df.collect()]
    grouped = "key" in df.columns
    if grouped:
        got = {r.pop("key"): next(iter(r.values())) if set(r) == {"value"} else r for r in rows}
        assert shown(got) == shown(expected)
        return
    objects = isinstance(expected, dict) or isinstance(expected, list) and expected and isinstance(expected[0], dict)
    values = rows if objects else [next(iter(r.values())) for r in rows]
    values = [v for v in values if v is not None]
    wanted = [] if expected is None else expected if isinstance(expected, list) and not (len(values) == 1 and isinstance(values[0], (list, tuple))) else [expected]
    assert sorted(map(shown, values)) == sorted(map(shown, wanted))


def test_keys_of_two_pairs_clash(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    for text in ("t{k: $count($), 'a': 1}", "t{k: $sum(v), k & '': $count(k)}"):
        with pytest.raises(Exception) as e:
            compile(text).on({"t": df}).collect()
        assert code_of(e.value) == "D1009"
        with pytest.raises(EvalError) as e:
            compile(text).evaluate({"t": [r.asDict() for r in df.collect()]})
        assert e.value.code == "D1009"
    got = compile("t{k: $sum(v), k & 2: $count(v), 'all': $max(v)}").on({"t": df})
    assert {r.key: r.value for r in got.collect()} == compile("t{k: $sum(v), k & 2: $count(v), 'all': $max(v)}").evaluate({"t": [r.asDict() for r in df.collect()]})
    assert _plan(compile("t{k: $sum(v), k & 2: $count(v)}").on({"t": df})).count("Scan ExistingRDD") == 1


def test_ties_keep_their_order(spark):
    rows = [(i, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, k int").repartition(1)
    document = {"t": [r.asDict() for r in df.collect()]}
    for text in ("t^(k)[0].i", "t^(>k)[[3..8]].i", "t^(k)[-1].i", "t^(k)[-5].i", "t[-1].i", "t[-70].i", "t[-2].i", "t^(k)[i % 7].i", "t[k - 3].i", "t^(k)#$p[$p = 4].i", "$reverse(t).i", "t^(>k).i", "t[i > 30]^(k).i"):
        expected = compile(text).evaluate(document)
        got = [r[0] for r in compile(text).on({"t": df}).collect()]
        assert got == ([] if expected is None else expected if isinstance(expected, list) else [expected]), text


def test_positions_count_no_rows_twice(spark, small):
    part = spark.read.parquet(f"{small}/part.parquet")
    assert "TakeOrderedAndProject" in _plan(compile("part^(p_size)[-1].p_partkey").on({"part": part}))


def test_tables_in_dynamic_steps_are_refused(spark, small):
    tables = {t: spark.read.parquet(f"{small}/{t}.parquet") for t in ("nation", "region")}
    with pytest.raises(Unsupported):
        compile("nation@$n.region@$r[$n.n_regionkey = $r.r_regionkey].$formatInteger($count(nation), '0')").on(tables)


def test_interval_joins_compare_buckets(spark):
    import random

    rnd = random.Random(8)
    spans = [(i, lo := rnd.uniform(-50, 50), lo + rnd.choice([0.0, 0.001, 1, 30, -5, 1e6])) for i in range(200)] + [(900, None, 1.0), (901, 0.0, None)]
    points = [(i, rnd.choice([rnd.uniform(-60, 60), float(rnd.randint(-60, 60)), spans[i % 200][1]])) for i in range(300)] + [(900, None)]
    t = {"a": spark.createDataFrame(spans, "i int, lo double, hi double"), "b": spark.createDataFrame(points, "j int, x double")}
    for text, inside in (
        ("a@$a.b@$b[$a.lo <= $b.x and $b.x < $a.hi].{'i': $a.i, 'j': $b.j}", lambda lo, hi, x: lo <= x < hi),
        ("b@$b.a@$a[$b.x > $a.lo][$a.hi >= $b.x].{'i': $a.i, 'j': $b.j}", lambda lo, hi, x: lo < x <= hi),
    ):
        df = compile(text).on(t)
        plan = _plan(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        want = sorted((i, j) for i, lo, hi in spans for j, x in points if None not in (lo, hi, x) and inside(lo, hi, x))
        assert sorted((r.i, r.j) for r in df.collect()) == want


@pytest.mark.parametrize("task_pairs", [1 << 26, 100])
def test_interval_joins_deal_crowded_cells(spark, monkeypatch, task_pairs):
    """Crowded cells in blocks by a merge join; intervals of any width; equal rows; numbers at the ends."""
    import random

    from pathframe.operators import intervals

    for name, n in (("TASK_PAIRS", task_pairs), ("POINT_ROWS", 16), ("INTERVAL_ROWS", 8)):
        monkeypatch.setattr(intervals, name, n, raising=False)
    rnd, inf = random.Random(9), float("inf")
    spans = [(i, lo := rnd.uniform(0, 10), lo + rnd.choice([0.0, 1, 8, 9, 1000])) for i in range(150)]
    spans += [(200, 0.0, 1e300), (201, -1e300, 1e300), (202, -inf, 5.0), (203, 5.0, inf), (204, -inf, inf), (205, inf, inf), (206, float("nan"), 1.0), *[(207, 4.0, 6.0)] * 3]
    points = [(i, rnd.choice([5.0, rnd.uniform(0, 10), spans[i % 150][2]])) for i in range(300)] + [(400, 1e20), (401, -1e250), (402, inf), (403, -inf), (404, float("nan")), *[(405, 5.0)] * 40]
    t = {"a": spark.createDataFrame(spans, "i int, lo double, hi double"), "b": spark.createDataFrame(points, "j int, x double")}
    want = sorted((i, j) for i, lo, hi in spans for j, x in points if lo <= x <= hi)
    for text in ("a@$a.b@$b[$a.lo <= $b.x and $b.x <= $a.hi].{'i': $a.i, 'j': $b.j}", "b@$b.a@$a[$a.lo <= $b.x and $b.x <= $a.hi].{'i': $a.i, 'j': $b.j}"):
        df = compile(text).on(t)
        assert task_pairs > 100 or "SortMergeJoin" in _plan(df)
        assert sorted((r.i, r.j) for r in df.collect()) == want


def test_windowed_groups(spark):
    from pathframe.streaming.rows import windowed_groups

    rows = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:20", "a"), ("2024-01-01 00:01:10", "b")], "t string, s string").select(F.to_timestamp("t").alias("t"), "s")
    got = windowed_groups(compile("$uppercase(s)"), rows, "t", "1 minute", "5 minutes").collect()
    assert sorted((r.key, r.n) for r in got) == [("A", 2), ("B", 1)]


def test_picture_query_has_whole_years(spark, tmp_path):
    """Years over 9999, which its SQL writes in full; `[Y0001]` keeps four digits of them, as in the reference."""
    ids = [0, 1, 10957, 2932896, 2932897, 3000000, 3652059, 5999999]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(map(tuple, Q.queries()["json_picture"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(SQL["json_picture"]).fetchall())
    assert compile('$fromMillis(2932897 * 86400000, "[Y0001] [Y]")').evaluate() == "0000 10000"
