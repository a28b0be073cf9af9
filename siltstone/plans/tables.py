"""Sources, sinks and statements (S), the function registry (U) and event-time windows (T).

Queries that write do so into a folder of their own under the session's checkpoint folder, so that every executor
reaches it.
"""

from __future__ import annotations

import re
import tempfile
import threading
import time
import uuid

from pyspark.sql import functions as F

from ..functions import registry
from ..sources import catalog, dialect, io, settings
from ..streaming import windows
from .common import col, lit, table
from .registry import query

C, O, E = "customer", "orders", "events"


def scratch(spark) -> str:
    """A new folder that the driver and all executors share; of this machine only where all runs on it."""
    sc = spark.sparkContext
    shared = sc._jsc.sc().getCheckpointDir()
    base = shared.get() if shared.isDefined() else sc.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='siltstone-')}/scratch-{uuid.uuid4().hex}"


@query("s01_scan", "SELECT c_name, c_acctbal FROM customer")
def s01(spark, sf_dir):
    return io.scan(spark, f"{sf_dir}/customer.parquet", ["c_name", "c_acctbal"])


@query("s01_scan_no_columns", "SELECT count(*) AS n FROM lineitem")
def s01_none(spark, sf_dir):
    return io.scan(spark, f"{sf_dir}/lineitem.parquet").agg(F.count("*").alias("n"))


@query("s02_streamed_batches", "SELECT n_nationkey, n_name FROM nation")
def s02(spark, sf_dir):
    # what a client receives partition by partition; a table of 25 rows
    return spark.createDataFrame([(r.n_nationkey, r.n_name) for r in io.batches(table(spark, sf_dir, "nation"))], "n_nationkey int, n_name string")


@query("s03_text_reader", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal FROM customer")
def s03(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, C).select("c_custkey", F.nullif("c_mktsegment", lit("BUILDING")).alias("segment"), "c_acctbal").write.csv(path, sep="\t", nullValue="\\N", quote="")
    return io.read_tsv(spark, path, "c_custkey long, segment string, c_acctbal double")


@query("s04_compressed_blocks", "SELECT 'lz4' AS codec, count(*) AS n FROM customer UNION ALL SELECT 'none', count(*) FROM customer UNION ALL SELECT 'zstd', count(*) FROM customer")
def s04(spark, sf_dir):
    out = None
    for codec in ("lz4", "none", "zstd"):
        path = scratch(spark)
        table(spark, sf_dir, C).write.option("compression", io.CODECS[codec]).parquet(path)
        part = spark.read.parquet(path).agg(F.count("*").alias("n")).select(lit(codec).alias("codec"), "n")
        out = part if out is None else out.union(part)
    return out


@query("s05_insert", "SELECT c_custkey AS id, c_name AS name, CAST(NULL AS DOUBLE) AS balance, 'x' AS tag FROM customer UNION ALL SELECT o_orderkey, CAST(NULL AS VARCHAR), o_totalprice, 'x' FROM orders")
def s05(spark, sf_dir):
    path = scratch(spark)
    io.create(spark, path, "id long, name string, balance double, tag string")
    io.insert(table(spark, sf_dir, C).select("c_custkey", "c_name"), path, ["id", "name"], {"tag": lit("x")})
    io.insert(table(spark, sf_dir, O).select("o_totalprice", "o_orderkey"), path, ["balance", "id"], {"tag": lit("x")})
    return spark.read.parquet(path)


@query("s06_copy_from", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def s06(spark, sf_dir):
    source, path = scratch(spark), scratch(spark)
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.csv(source, sep="\t")
    io.create(spark, path, "id int, name string")
    io.copy_from(spark, source, path)
    return spark.read.parquet(path)


@query("s07_no_updates", "SELECT 'tables do not support updates/deletes' AS message")
def s07(spark, sf_dir):
    try:
        io.update(table(spark, sf_dir, C))
    except io.NotSupported as e:
        return spark.createDataFrame([(str(e),)], "message string")


@query("s08_import_schema", "SELECT 'customer' AS name, 5 AS columns UNION ALL SELECT 'orders', 6")
def s08(spark, sf_dir):
    got = catalog.import_schema(spark, sf_dir, only=["customer", "orders"], prefix="imported_")
    return spark.createDataFrame([(n, len(s.fields)) for n, s in got.items()], "name string, columns int")


@query("s09_table_options", "SELECT c_custkey AS id, c_mktsegment AS Segment FROM customer")
def s09(spark, sf_dir):
    spec = catalog.TableSpec.of("buyers", sf_dir, {"table_name": "customer", "fetch_size": "1000"}, column_names={"id": "c_custkey", "Segment": "c_mktsegment"})
    return spec.read(spark).select("id", "Segment")


@query("s10_option_validator", "SELECT 'fetch_size' AS option UNION ALL SELECT 'nonsense' UNION ALL SELECT 'table_name'")
def s10(spark, sf_dir):
    refused = []
    for name, value in (("fetch_size", "-1"), ("nonsense", "1"), ("table_name", "../x"), ("database", "fine")):
        try:
            catalog.validate({name: value})
        except ValueError:
            refused.append((name,))
    return spark.createDataFrame(refused, "option string")


@query("s11_raw_query", "SELECT string_agg(r_regionkey || chr(9) || r_name || chr(10), '' ORDER BY r_regionkey) AS result FROM region")
def s11(spark, sf_dir):
    text = io.raw_query(spark, f"SELECT r_regionkey, r_name FROM parquet.`{sf_dir}/region.parquet` ORDER BY r_regionkey")
    return spark.createDataFrame([(text,)], "result string")


@query("s12_analyze", "SELECT count(*) AS n FROM region")
def s12(spark, sf_dir):
    table(spark, sf_dir, "region").createOrReplaceTempView("analyzed_region")
    io.analyze(spark, "analyzed_region")
    return spark.table("analyzed_region").agg(F.count("*").alias("n"))


@query("s13_explain", "SELECT true AS pushed, true AS pruned")
def s13(spark, sf_dir):
    plan = io.explain(table(spark, sf_dir, C).where("c_nationkey = 3").select("c_name"))
    return spark.createDataFrame([("EqualTo(c_nationkey,3)" in plan, "ReadSchema: struct<c_name:string,c_nationkey:int>" in plan)], "pushed boolean, pruned boolean")


@query("s14_settings", "SELECT 'a' AS name, '1' AS value UNION ALL SELECT 'b', 'it''s, so' UNION ALL SELECT 'c', 'x\\y'")
def s14(spark, sf_dir):
    return spark.createDataFrame(list(settings.parse_settings(r"a 1, b 'it\'s, so', c = 'x\\y'").items()), "name string, value string")


@query("s15_accepted_switch", "SELECT 'pushdown_regex' AS name, 'off' AS value")
def s15(spark, sf_dir):
    return spark.createDataFrame(list(settings.apply_settings(spark, "pushdown_regex off").items()), "name string, value string")


@query("s16_version")
def s16(spark, sf_dir):
    return spark.createDataFrame([(io.version(),)], "version string")


@query("s17_cancel", "SELECT 1 AS stopped, true AS went_on")
def s17(spark, sf_dir):
    """A query that sleeps in many tasks is started under a tag and stopped; the session goes on."""
    tag, ended = f"siltstone-{uuid.uuid4().hex}", []

    def slow() -> None:
        with io.cancellable(spark, tag):
            try:
                sleep = F.java_method(lit("java.lang.Thread"), lit("sleep"), lit(250).cast("bigint"))
                spark.range(0, 1000, 1, 1000).select(F.length(sleep).alias("x")).where("x >= 0").collect()
            except Exception as e:  # noqa: BLE001 - how it ends is the point
                ended.append(e)

    thread = threading.Thread(target=slow, daemon=True)
    thread.start()
    for _ in range(600):
        if io.cancel(spark, tag) or ended:
            break
        time.sleep(0.1)
    thread.join(60)
    stopped = sum("cancel" in str(e).lower() for e in ended)
    return spark.createDataFrame([(stopped, spark.range(3).count() == 3)], "stopped int, went_on boolean")


@query("s18_retry", "SELECT count(*) AS n, 2 AS attempts FROM orders")
def s18(spark, sf_dir):
    """A read whose first attempt fails as a lost connection does."""
    attempts = []

    def read():
        attempts.append(1)
        if len(attempts) == 1:
            raise ConnectionError("lost")
        return table(spark, sf_dir, O).agg(F.count("*").alias("n"))

    return io.retry(read).withColumn("attempts", lit(len(attempts)))


def spoken(name: str, text: str, duck: str, *tables: str) -> None:
    """A statement of the dialect, run as it is written; and another engine's."""

    @query(name, duck)
    def run(spark, sf_dir):
        return dialect.sql(spark, text, **{t: table(spark, sf_dir, t) for t in tables})


spoken(
    "u01_sql_aggregates",
    """SELECT o_orderstatus, argMax(o_orderkey, o_totalprice) AS best, argMin(o_orderkey, o_totalprice) AS least, uniqExact(o_custkey) AS people,
uniqExact(o_custkey, o_orderpriority) FILTER (WHERE o_totalprice > 1000) AS pairs, quantile(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS q,
string_agg(DISTINCT o_orderstatus, ',') AS s, bool_and(o_totalprice > 0) AS positive FROM orders GROUP BY o_orderstatus""",
    """SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS best, arg_min(o_orderkey, o_totalprice) AS least, count(DISTINCT o_custkey) AS people,
count(DISTINCT (o_custkey, o_orderpriority)) FILTER (WHERE o_totalprice > 1000) AS pairs, quantile_cont(o_totalprice, 0.25) AS q,
o_orderstatus AS s, bool_and(o_totalprice > 0) AS positive FROM orders GROUP BY o_orderstatus""",
    O,
)
spoken(
    "u01_sql_patterns",
    r"""SELECT p_partkey, re2extract(p_name, '(\w+)$') AS last, re2countmatches(p_name, '[aeiou]') AS n, re2multimatchanyindex(p_name, '^q', 'r') AS i,
regexp_replace(p_name, '([a-z])([a-z])', '\2\1') AS swapped, p_name ~* '^[A-M]' AND p_brand !~ '#1' AS early FROM part WHERE p_name ~ '[aeiou]' OR p_size + 1 > 20""".replace("\\\\", "\\"),
    r"""SELECT p_partkey, regexp_extract(p_name, '(\w+)$', 1) AS last, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INTEGER) AS n, CASE WHEN regexp_matches(p_name, '^q') THEN 1 WHEN regexp_matches(p_name, 'r') THEN 2 ELSE 0 END AS i,
regexp_replace(p_name, '([a-z])([a-z])', '\2\1') AS swapped, regexp_matches(lower(p_name), '^[a-m]') AND NOT regexp_matches(p_brand, '#1') AS early FROM part WHERE regexp_matches(p_name, '[aeiou]') OR p_size + 1 > 20""".replace("\\\\", "\\"),
    "part",
)
spoken(
    "u01_sql_json_arrays",
    """SELECT event_id, props ->> 'k' AS k, props -> 'k' AS j, (ARRAY[event_id, user_id, 7])[2] AS second, (ARRAY[1, 2, 3, 4])[2:3] AS mid, toUInt16(user_id % 1000) AS u,
ARRAY[event_id % 3, 1] @> ARRAY[1] AS has, ARRAY[event_id % 3] && ARRAY[0, 2] AS meets, idx(ARRAY[5, 6], 6) AS at, event_id::text || '!' AS t FROM events""",
    """SELECT event_id, props ->> 'k' AS k, CAST(props -> 'k' AS VARCHAR) AS j, user_id AS second, [2, 3] AS mid, CAST(user_id % 1000 AS INTEGER) AS u,
true AS has, event_id % 3 IN (0, 2) AS meets, 2 AS at, event_id || '!' AS t FROM events""",
    E,
)


@query("u01_function_surface", "SELECT 0 AS unknown")
def u01(spark, sf_dir):
    """Every registered function is callable from the dialect's SQL: Spark's own by that name, or a translated one."""
    known = {f.name.lower() for f in spark.catalog.listFunctions()} | {"extract", "string_agg", "array_agg", "count", "now", "date"}
    missing = [n for n in registry.FUNCTIONS if n.lower() not in dialect.CALLS and n.lower() not in known]
    return spark.createDataFrame([(len(missing),)], "unknown int")


@query("u02_function_registry", "SELECT 1 AS known")
def u02(spark, sf_dir):
    wanted = {"argMax", "argMin", "uniq", "uniqExact", "uniqCombined", "uniqCombined64", "uniqHLL12", "uniqTheta", "quantile", "quantileExact", "re2match", "re2extractall", "idx", "soundex", "levenshtein", "toUInt8", "toUInt128"}
    return spark.createDataFrame([(int(wanted <= set(registry.FUNCTIONS)),)], "known int")


@query("t01_tumbling_window", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t01(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, E), "1 hour", ["event_type"], {"n": F.count("*")}).select(col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("t01_sliding_window", "SELECT date_trunc('hour', ts) - INTERVAL (h) HOUR AS start, count(*) AS n FROM events, range(0, 2) t(h) GROUP BY ALL")
def t01_sliding(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, E), "2 hours", [], {"n": F.count("*")}, slide="1 hour").select(col("start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "t01_session_window",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def t01_session(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, E), "6 hours", ["user_id"], {"n": F.count("*")}).select("user_id", col("start").cast("timestamp_ntz").alias("start"), "n")


@query("t01_stream", "SELECT * FROM (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)")
def t01_stream(spark, sf_dir):
    """The windows that are final once the latest event has been seen."""
    stream = spark.readStream.schema(table(spark, sf_dir, E).schema).parquet(f"{sf_dir}/events.parque[t]")
    counts = windows.tumbling(stream.withColumn("ts", col("ts").cast("timestamp")), "1 day", ["event_type"], {"n": F.count("*")}, late="0 seconds")
    return windows.run_to_end(counts, scratch(spark)).select(col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
