"""Queries over the relational tables: statistics, lookups, set operations, upserts, name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import text as T
from tessera.operators import resolve as E
from tessera.operators import tables as B
from tessera.session import table
from tessera.sources import files as S
from tessera.plans.registry import Registry

query = Registry()


@query("""SELECT 'min' AS stat, min(l_quantity) AS l_quantity, min(l_discount) + 0.0 AS l_discount, min(l_tax) + 0.0 AS l_tax FROM lineitem
UNION ALL SELECT 'max', max(l_quantity), max(l_discount), max(l_tax) FROM lineitem
UNION ALL SELECT 'average', round(avg(l_quantity), 6), round(avg(l_discount), 6), round(avg(l_tax), 6) FROM lineitem""")
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_quantity", "l_discount", "l_tax"]
    stats = B.column_statistics(table(spark, sf_dir, "lineitem"), columns)
    return stats.select("stat", *[(F.round(c, 6) + 0.0).alias(c) for c in columns])


@query("""WITH s AS (SELECT l_returnflag, sum(l_quantity) AS total FROM lineitem GROUP BY 1) SELECT l_returnflag, total, round(100.0 * total / sum(total) OVER (), 8) AS percent FROM s""")
def percent_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.percent_of_total(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_quantity"))
    return out.withColumn("percent", F.round("percent", 8))


@query("""WITH s AS (SELECT l_linestatus, sum(l_quantity) / 1000 AS amount FROM lineitem GROUP BY 1)
SELECT l_linestatus, round(amount, 6) AS amount FROM s UNION ALL SELECT 'TOTAL', round(sum(amount), 6) FROM s""")
def scaled_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.with_total(table(spark, sf_dir, "lineitem"), "l_linestatus", F.col("l_quantity"), 1000.0)
    return out.withColumn("amount", F.round("amount", 6))


@query("""WITH n AS (SELECT DISTINCT user_id, event_id FROM events), i AS (SELECT *, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM n),
r AS (SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY user_id, g)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.longest_run(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_purchase FROM events""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("last_purchase", F.when(F.col("event_type") == "purchase", F.col("value")))
    return B.forward_fill(e, "user_id", "event_id", ["last_purchase"]).select("event_id", "user_id", "last_purchase")


@query("""SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN CASE p_brand WHEN 'Brand#11' THEN 1.25 ELSE 2.5 END ELSE 15.0 END::DOUBLE AS price FROM part""")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("Brand#11", 1.25), ("Brand#12", 2.5)], "p_brand string, price double")
    return B.lookup(table(spark, sf_dir, "part"), prices, ["p_brand"], "price", 15.0).select("p_partkey", "price")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def override_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    zero = s.where("s_suppkey % 10 = 0").select("s_suppkey", F.lit(0.0).alias("s_acctbal"))
    return B.override(s, zero, "s_suppkey", "s_acctbal").select("s_suppkey", "s_acctbal")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def semi_with_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def bundle_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return n.unionByName(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@query("""WITH a AS (SELECT n_name AS name, 0 AS f, n_nationkey AS pos FROM nation UNION ALL SELECT r_name, 1, r_regionkey FROM region)
SELECT name, row_number() OVER (ORDER BY min(f * 1000 + pos)) AS place FROM a GROUP BY name""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("pos"))
    return B.ordered_union([n, r], "name")


@query("""SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT s_suppkey, 'new ' || s_name, s_nationkey, 1.5 FROM supplier WHERE s_suppkey % 7 = 0
UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 7 = 1""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    changed = s.where("s_suppkey % 7 = 0").withColumns({"s_name": F.concat(F.lit("new "), "s_name"), "s_acctbal": F.lit(1.5)})
    added = s.where("s_suppkey % 7 = 1").withColumn("s_suppkey", F.col("s_suppkey") + 1000000)
    return B.upsert(s, changed.unionByName(added), ["s_suppkey"])


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("SELECT p_partkey, p_name || '_old' AS p_name, p_size FROM part UNION ALL SELECT p_partkey, p_name || '_new', p_size + 1 FROM part")
def clone_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return B.clone_override(p, "p_name", {"p_size": (F.col("p_size") + 1).cast("int")})


@query("SELECT DISTINCT p_brand, p_size FROM part WHERE p_brand IS NOT NULL AND p_size IS NOT NULL")
def distinct_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.options(table(spark, sf_dir, "part"), "p_brand", "p_size")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 16")
def kth_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.kth(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 17)


@query("SELECT c_custkey, c_acctbal, count(*) OVER () AS total, 10::BIGINT AS shown FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal")
    return B.page(c, [F.desc("c_acctbal"), "c_custkey"], 10).withColumn("shown", F.col("shown").cast("long"))


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem")
def integrity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, CASE WHEN (props->>'k')::BIGINT > 5 THEN 'high' ELSE 'low' END AS band FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(k > 5, "high").otherwise("low").alias("band"))


@query("""SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11' GROUP BY event_type""")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days from the 5th to the 10th, as a half-open range of instants."""
    days = D.day_bounds(F.lit("2024-01-05"), F.lit("2024-01-10"))
    e = table(spark, sf_dir, "events").where((F.col("ts") >= days["since"]) & (F.col("ts") < days["before"]))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT event_id, CASE WHEN (extract(hour FROM ts) + 8) % 24 BETWEEN 9 AND 17 THEN 1 ELSE 5 END AS minutes, floor(epoch(ts))::BIGINT AS seconds FROM events""")
def poll_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", D.poll_minutes(F.col("ts").cast("timestamp")).alias("minutes"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed FROM orders""")
def record_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return o.select("o_orderkey", D.record_datetime(said).alias("parsed"))


@query("""SELECT event_id, (event_id // 3600)::BIGINT || ':' || lpad(((event_id // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') AS length FROM events""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.seconds_text(F.col("event_id")).alias("length"))


@query("""SELECT s.s_suppkey AS input_id, n.n_nationkey AS id FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey""")
def fuzzy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers write their nation's name in other case and with marks around it; it is resolved to its record."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("id"))
    inputs = s.select(F.col("s_suppkey").alias("input_id"), F.concat(F.lit("~"), F.lower("name"), F.lit("~")).alias("value"))
    return E.resolve(inputs, n, ["name"])


@query(r"""WITH records AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type AS name FROM part),
inputs AS (SELECT id AS input_id, lower(CASE id % 3 WHEN 0 THEN substr(name, 1, k) || substr(name, k + 2) WHEN 1 THEN substr(name, 1, k) || '*' || substr(name, k + 2) ELSE substr(name, 1, k) || substr(name, k + 1, 1) || substr(name, k + 1) END) AS v
  FROM (SELECT *, (id % 19)::INT AS k FROM records)),
cut AS (SELECT v, n, unnest(range(0, length(v) - n + 1)) AS trim FROM (SELECT DISTINCT v, unnest(range(1, length(v) + 1)) AS n FROM inputs)),
asked AS (SELECT v, n, trim, substr(v, trim + 1, n) AS sub FROM cut),
named AS (SELECT DISTINCT lower(name) AS name FROM records),
held AS (SELECT DISTINCT name, substr(name, i, n) AS sub FROM (SELECT name, n, unnest(range(1, length(name) - n + 2)) AS i FROM (SELECT name, unnest(range(1, length(name) + 1)) AS n FROM named))),
first AS (SELECT v, n, sub FROM asked SEMI JOIN held USING (sub) QUALIFY row_number() OVER (PARTITION BY v ORDER BY n DESC, trim) = 1),
found AS (SELECT v, id, regexp_replace(name, '[^\p{L}\p{N}]', '', 'g') AS key, regexp_replace(v, '[^\p{L}\p{N}]', '', 'g') AS asked FROM first JOIN held USING (sub) JOIN (SELECT id, lower(name) AS name FROM records) USING (name)),
close AS (SELECT *, contains(key, asked) OR contains(asked, key) AS near FROM found),
pick AS (SELECT v, id FROM close QUALIFY row_number() OVER (PARTITION BY v ORDER BY near DESC, length(key), key, id) = 1)
SELECT input_id, id FROM inputs LEFT JOIN pick USING (v)""")
def fuzzy_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with a character lost, replaced or doubled, resolved to the records of the parts."""
    name, k, n = F.concat_ws(" ", "p_name", "p_brand", "p_type"), (F.col("id") % 19).cast("int"), F.col("id") % 3
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    head, tail = F.substring(F.col("name"), F.lit(1), k), lambda at: F.substring(F.col("name"), k + at, F.char_length("name"))
    typed = F.when(n == 0, F.concat(head, tail(2))).when(n == 1, F.concat(head, F.lit("*"), tail(2))).otherwise(F.concat(head, F.substring(F.col("name"), k + 1, F.lit(1)), tail(1)))
    return E.resolve(p.select(F.col("id").alias("input_id"), typed.alias("value")), p, ["name"])


@query("""WITH v AS (SELECT user_id, event_id, value - 50 AS f FROM events), c AS (SELECT *, f * lag(f) OVER (PARTITION BY user_id ORDER BY event_id) <= 0 AS crossed FROM v)
SELECT user_id, count(*) FILTER (crossed) AS changes, arg_min(event_id, {'a': abs(f), 'b': event_id}) AS nearest_x, max(f) AS greatest FROM c GROUP BY user_id""")
def sweep_sign_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("f", F.col("value") - 50)
    return B.sign_changes(e, "user_id", "event_id", "f")


@query("""SELECT l_linenumber, round(median(l_quantity), 6) AS l_quantity FROM (SELECT *, min(l_discount) OVER (PARTITION BY l_linenumber) AS low FROM lineitem) WHERE l_discount = low GROUP BY 1""")
def median_at_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.median_at_minimum(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_quantity", "l_discount")
    return out.withColumn("l_quantity", F.round("l_quantity", 6))


@query("""SELECT l_returnflag AS curve, round_even(l_quantity, 0) AS x, round(median(l_discount), 6) AS y FROM lineitem GROUP BY 1, 2""")
def collapse_by_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("curve"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return B.collapse_by_median(points, "curve", "x", "y").withColumn("y", F.round("y", 6))


@query("""SELECT item_id AS id, text, '{"item_id":' || item_id || '}' AS metadata FROM benchmark""")
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("id"), "text", S.metadata_json(b).alias("metadata"))


@query("""SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def ledger_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"))
    return S.pending(table(spark, sf_dir, "documents").select("doc_id"), ledger, "doc_id")


@query("""SELECT user_id, event_id, price, sum(new) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM (SELECT user_id, event_id, floor(value / 10) AS price,
  CASE WHEN floor(value / 10) IS NOT DISTINCT FROM lag(floor(value / 10)) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def repeat_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal readings in a row of each instrument as runs, by row."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("value") / 10).cast("double").alias("price"))
    return B.in_runs(e, "user_id", "event_id", "price").select("user_id", "event_id", "price", "run")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 < 2 THEN 'Balance invalid|' WHEN c_acctbal <= 0 THEN 'Balance must be > 0|' WHEN c_acctbal < 100 THEN 'Balance must be >= 100|' WHEN c_acctbal > 5000 THEN 'Balance must be <= 5000|' ELSE '' END
  || CASE WHEN c_nationkey < 3 THEN 'nation must be >= 3|' ELSE '' END AS problems FROM customer""")
def form_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances that must be positive and in a range, some of them blank or no numbers, and nations with a least number."""
    said = F.when(F.col("c_custkey") % 7 == 0, " ").when(F.col("c_custkey") % 7 == 1, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    found = T.form_problems({"balance": said, "nation": F.col("c_nationkey")}, {"balance": T.Limits(True, 100, 5000, "Balance"), "nation": T.Limits(least=3)})
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(found, lambda x: F.concat(x, F.lit("|"))), "").alias("problems"))


#: Lines of a log that name a size, but for every third.
_LOG = "WITH log AS (SELECT s_suppkey, s_nationkey * 123456789::BIGINT AS number, 'in bytes=' || s_nationkey * 123456789::BIGINT || ' out' AS line FROM supplier WHERE s_suppkey % 3 <> 0)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = F.concat(F.lit("  in bytes="), (F.col("s_nationkey") * F.lit(123456789).cast("long")).cast("string"), F.lit(" out "))
    line = F.when(F.col("s_suppkey") % 3 == 0, F.lit("5 bytes")).otherwise(sized)
    return B.by_number(table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("line")), "line", "s_suppkey")


@query(_LOG + " SELECT s_suppkey, line, number FROM log")
def log_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)


@query(_LOG + " SELECT sum(number)::BIGINT AS total, format('{:.3f}', sum(number) / 1073741824) AS total_gb FROM log")
def log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.number_totals(_log(spark, sf_dir))


@query("SELECT user_id, count(*) FILTER (event_id % 2 = 0) AS buys, count(*) FILTER (event_id % 2 = 1) AS sells FROM events GROUP BY user_id")
def side_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("side", F.when(F.col("event_id") % 2 == 0, "Buy").otherwise("SELL"))
    return B.by_side(e, "user_id", "side")
