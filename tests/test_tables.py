"""Sources, options, types, states and statements."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators import relational as rel
from siltstone.operators import states as S
from siltstone.operators.collapsing import Collapsing
from siltstone.sources import catalog, io, settings
from siltstone.sources import types as K


def test_types():
    assert K.parse("Nullable(FixedString(50))") == (T.VarcharType(50), True) and K.parse("LowCardinality(Nullable(String))") == (T.StringType(), True)
    assert K.parse("Array(Array(Int32))")[0] == T.ArrayType(T.ArrayType(T.IntegerType(), False), False) and K.parse("DateTime64(6, 'Europe/Berlin')")[0] == T.TimestampType()
    assert K.parse("Decimal(15, 2)")[0] == T.DecimalType(15, 2) and K.parse("Decimal64(6)")[0] == T.DecimalType(18, 6) and K.parse("UInt32")[0] == T.LongType()
    assert K.parse("Tuple(Int32, String, Float32)")[0].names == ["_1", "_2", "_3"] and K.parse("Tuple(a Int32, b Array(Tuple(x Int8, y String)))")[0].names == ["a", "b"]
    assert K.parse("Nested(a Int32, b Int32)")[0].elementType.names == ["a", "b"] and K.parse("Enum8('a, b' = 1, 'c' = 2)")[0] == T.StringType()
    assert K.parse("AggregateFunction(count)")[0] == T.LongType() and K.aggregate_of("AggregateFunction(quantile(0.9), Int32)") == "quantile" and K.parse("SimpleAggregateFunction(sum, Int64)")[0] == T.LongType()
    for bad in ("Decimal(8)", "Nullable(Nullable(Int8))", "Map(String, Int8)", "Decimal256(3)", "Nonsense", "Array(Int8"):
        with pytest.raises(ValueError):
            K.parse(bad)


def test_engines_and_options():
    assert catalog.Engine.parse("CollapsingMergeTree(sign)") == catalog.Engine("collapsing", "sign") and catalog.Engine.parse("AggregatingMergeTree").kind == "aggregating" and catalog.Engine.parse(None).kind == "default"
    for text in ("collapsingmergetree(sign)", "ReplicatedCollapsingMergeTree('/a', 'b', sign)", "VersionedCollapsingMergeTree(sign, v)", "replicatedVersionedCollapsingMergeTree('/a,b', 'c', `sign`, v)"):
        assert catalog.Engine.parse(text) == catalog.Engine("collapsing", "sign"), text
    assert catalog.Engine.parse("replicatedaggregatingmergetree('/a', 'b')").kind == "aggregating"
    for bad in ("CollapsingMergeTree(sign) + 1)", "CollapsingMergeTree(a; DROP TABLE x)", "CollapsingMergeTree('x')"):
        with pytest.raises(ValueError):
            catalog.Engine.parse(bad)
    for bad in ({"fetch_size": "-5"}, {"x": "1"}, {"database": "a\r\nb"}, {"table_name": ""}):
        with pytest.raises(ValueError):
            catalog.validate(bad)


def test_settings():
    assert settings.parse_settings("") == {} and settings.parse_settings("a 1, b = 'x, y', c 'it''s'") == {"a": "1", "b": "x, y", "c": "it's"}
    for bad in ("a", "a 1 b 2", "a 'x", ", a 1", "a 1,, b 2"):
        with pytest.raises(ValueError):
            settings.parse_settings(bad)


def test_table_spec_reads_declared_columns(spark, tmp_path):
    spark.createDataFrame([(1, "x", -1), (2, "y", 1)], "ch_id int, ch_val string, sign int").write.parquet(str(tmp_path / "db" / "t.parquet"))
    spec = catalog.TableSpec.of("mine", str(tmp_path), {"database": "db", "table_name": "t", "engine": "CollapsingMergeTree(sign)"}, {"id": "Int32", "Val": "Nullable(String)", "sign": "Int32"}, {"id": "ch_id", "Val": "ch_val"})
    df = spec.read(spark)
    assert df.columns == ["id", "Val", "sign"] and df.agg(spec.aggregates.sum("id"), spec.aggregates.count()).first()[:] == (1, 0)
    assert catalog.import_schema(spark, str(tmp_path / "db"), prefix="db_").keys() == {"t"} and spark.table("db_t").count() == 2
    with pytest.raises(ValueError):
        catalog.import_schema(spark, str(tmp_path / "db"), only=["none"])


def test_insert_copy_and_raw_query(spark, tmp_path):
    path, source = str(tmp_path / "t.parquet"), tmp_path / "in.tsv"
    io.create(spark, path, "a int, b string, c date")
    io.insert(spark.createDataFrame([(1, "x")], "a int, b string"), path)
    source.write_text("2\ty\t2026-01-02\n3\t\\N\t\\N\n")
    io.copy_from(spark, str(source), path)
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, spark.createDataFrame([(1, "x", None), (2, "y", __import__("datetime").date(2026, 1, 2)), (3, None, None)], "a int, b string, c date").collect()))
    assert io.raw_query(spark, "SELECT 1 AS a, NULL AS b, 'x\ty' AS c, :p AS d", {"p": True}) == "1\t\\N\tx\\ty\ttrue\n"
    with pytest.raises(ValueError):
        io.insert(spark.createDataFrame([(1,)], "zz int"), path)
    with pytest.raises(io.NotSupported):
        io.delete(path)
    (tmp_path / "arrays.tsv").write_text("1\t[1,2]\t['a','b']\n2\t\\N\t[]\n")
    assert [tuple(r) for r in io.read_tsv(spark, str(tmp_path / "arrays.tsv"), "k int, v array<int>, s array<string>").orderBy("k").collect()] == [(1, [1, 2], ["a", "b"]), (2, None, [])]


def test_states_merge_to_what_one_pass_gives(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), (F.col("id") % 3).alias("p"), (F.col("id") % 50).alias("x"))
    for name in S.STATES:
        whole = {r.g: r.v for r in df.groupBy("g").agg(S.state(name).write("x").alias("s")).select("g", S.state(name).finish("s").alias("v")).collect()}
        parts = {r.g: r.v for r in df.groupBy("g", "p").agg(S.state(name).write("x").alias("s")).groupBy("g").agg(S.merged(name, "s").alias("v")).collect()}
        assert whole == parts, name
    maps = spark.createDataFrame([(1, [1, 2], [10, 20]), (1, [2, 3], [5, 5]), (2, [], [])], "g int, k array<int>, v array<int>")
    assert {r.g: r.sums for r in S.sum_map(maps, ["g"], "k", "v").collect()} == {1: {1: 10, 2: 25, 3: 5}}
    with pytest.raises(ValueError):
        S.state("nonsense")


def test_collapsing(spark):
    c = Collapsing()
    df = spark.createDataFrame([(10.0, 1), (10.0, -1), (20.0, 1), (None, 1)], "x double, sign int")
    assert df.agg(c.sum("x"), c.count(), c.count("x"), c.avg("x"), c.sum("x", F.col("x") > 15), F.max("x")).first()[:] == (20.0, 2, 1, 20.0, 20.0, 20.0)
    assert df.where("x > 99").agg(c.count(), c.avg("x")).first()[:] == (0, None)


def test_not_in_and_groups_frames(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = lambda *xs: spark.createDataFrame([(x,) for x in xs], "b int")
    ids = lambda df: sorted((r.a for r in df.collect()), key=str)
    assert ids(rel.not_in(left, "a", right(2, 3), "b")) == [1] and ids(rel.not_in(left, "a", right(2, None), "b")) == [] and ids(rel.not_in(left, "a", right(), "b")) == [1, 2, None]
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 5)], "id int, k int")
    got = rel.groups_frame(df, [], [F.col("k")], -1, 0, {"n": F.count("*")}).collect()
    assert {r.id: r.n for r in got} == {1: 2, 2: 2, 3: 3, 4: 2}


def test_tsv_cells_with_quotes_and_escapes(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("1\t['it\\'s','b\"c','x,[y]','NULL',NULL,'\\\\\\'','a\\tb']\ta\\tb\\\\n\n2\t[]\t\\N\n")
    (tmp_path / "n.tsv").write_text("1\t[[1,2],[],[NULL]]\n")
    got = sorted(tuple(r) for r in io.read_tsv(spark, str(tmp_path / "q.tsv"), "k int, v array<string>, s string").collect())
    assert got == [(1, ["it's", 'b"c', "x,[y]", "NULL", None, "\\'", "a\tb"], "a\tb\\n"), (2, [], None)]
    assert io.read_tsv(spark, str(tmp_path / "n.tsv"), "k int, v array<array<int>>").first().v == [[1, 2], [], [None]]
    (tmp_path / "bad.tsv").write_text("1\t[1,\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_tsv(spark, str(tmp_path / "bad.tsv"), "k int, v array<int>").collect()


def test_retry():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert io.retry(flaky, wait=0) == "ok" and len(calls) == 3
    with pytest.raises(KeyError):
        io.retry(lambda: {}["x"], wait=0)
    with pytest.raises(TimeoutError):
        calls.clear()
        io.retry(flaky, attempts=2, wait=0)


def test_a_stream_drops_late_rows(spark, tmp_path):
    import datetime as dt
    import os

    from siltstone.streaming import windows

    day = lambda d, h=1: dt.datetime(2026, 1, d, h)
    for k, rows in enumerate(([(day(1), 1), (day(2), 1), (day(10), 1)], [(day(12), 1), (day(10, 5), 1)], [(day(2, 5), 100), (day(20), 1)])):
        spark.createDataFrame(rows, "ts timestamp, x int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        new = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime)[-1]
        os.utime(new, (1_700_000_000 + 100 * k,) * 2)
    stream = spark.readStream.schema("ts timestamp, x int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windows.run_to_end(windows.tumbling(stream, "1 day", [], {"n": F.sum("x")}, late="2 days"), str(tmp_path / "out"))
    assert sorted((r.start.day, r.n) for r in out.collect()) == [(1, 1), (2, 1), (10, 2), (12, 1)]


def test_the_dialect_in_sql(spark):
    from siltstone.functions import registry
    from siltstone.sources import dialect

    t = spark.createDataFrame([(1, 1, "a,b", '{"k": {"z": "q"}, "a b": 3}', [1, 2, 3]), (2, 2, "foo1", '{"k": 1}', [3]), (2, 3, "Foo", "{}", [])], "a int, b int, s string, j string, v array<int>")
    run = lambda text: [tuple(r) for r in dialect.sql(spark, text, t=t).collect()]
    assert run("SELECT argMax(a, b), argMin(a, b), uniqExact(a) FILTER (WHERE b > 1), uniqExact(a, b), quantileExact(a), quantile(0.25) WITHIN GROUP (ORDER BY a) FROM t") == [(2, 1, 1, 3, 2.0, 1.5)]
    assert run(r"SELECT b FROM t WHERE s ~ '^fo+\d' OR s !~* 'f' AND a + 1 = 2 ORDER BY b") == [(1,), (2,)]
    assert run("SELECT j -> 'k' ->> 'z', j -> 'k', j ->> 'a b', v[1], v[2:], v[:2] FROM t ORDER BY b") == [("q", '{"z":"q"}', "3", 1, [2, 3], [1, 2]), (None, "1", None, 3, [], [3]), (None, None, None, None, [], [])]
    assert run("SELECT b FROM t WHERE v @> ARRAY[1,2] AND v && ARRAY[2] AND NOT v <@ ARRAY[9]") == [(1,)]
    assert run("SELECT string_agg(s, '|' ORDER BY s DESC), array_agg(b ORDER BY b) FROM t WHERE a::text = '2'") == [("foo1|Foo", [2, 3])]
    assert run(r"SELECT 'it''s \d', $$x'y$$, \"b\" AS \"the b\" FROM t WHERE b = 1".replace('\\"', '"')) == [("it's \\d", "x'y", 1)]
    assert run("SELECT t.a, count(*) FROM t JOIN (SELECT a FROM t WHERE s ~* 'FOO') u ON t.a = u.a GROUP BY t.a HAVING count(*) > 1") == [(2, 4)]
    assert run("SELECT b FROM t WHERE s ~ lower(s) -- a pattern from a column\nORDER BY b") == [(1,), (2,)]
    assert run(r"SELECT regexp_match(s, '(f)(o)'), re2multimatchallindices(s, 'o', '^F'), re2regexpquotemeta('a.b c') FROM t WHERE b = 3") == [([], [1, 2], r"a\.b c")]
    for bad in ("SELECT (1", "SELECT 1]", "SELECT ?"):
        with pytest.raises(ValueError):
            dialect.translate(bad)
    known = {f.name.lower() for f in spark.catalog.listFunctions()}
    assert all(n.lower() in dialect.CALLS or n.lower() in known for n in registry.FUNCTIONS)
    assert run("SELECT array_positions(v, 2), array_replace(v, 2, 9), array_dims(v), array_upper(v, 1), re2extractallgroupsvertical(s, '(.),?(b)') FROM t WHERE b = 1") == [([2], [1, 9, 3], "[1:3]", 3, [["a", "b"]])]
