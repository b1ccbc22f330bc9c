"""The model's tables from the supplied star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans.shared import dealt
from tideline.sources.tables import points_to_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, odd: bool = True) -> DataFrame:
    """Points from events: a user is a run, an event type a metric. `odd`: some values are NaN or infinite."""
    step = F.expr("timestampdiff(MICROSECOND, CAST('2024-01-01' AS TIMESTAMP_NTZ), CAST(ts AS TIMESTAMP_NTZ))") / 1e6
    i = F.col("event_id")
    value = F.when(i % 17 == 0, float("nan")).when(i % 29 == 5, float("inf")).when(i % 31 == 7, float("-inf")).otherwise(F.col("value")) if odd else F.col("value")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("key"), i.alias("seq"), step.alias("step"), step.alias("t"), value.alias("value"))


POINTS = """p AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS key, event_id AS seq, epoch_us(ts - INTERVAL 19723 DAY) / 1e6 AS step, epoch_us(ts - INTERVAL 19723 DAY) / 1e6 AS t,
CASE WHEN event_id % 17 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 29 = 5 THEN CAST('inf' AS DOUBLE) WHEN event_id % 31 = 7 THEN CAST('-inf' AS DOUBLE) ELSE value END AS value FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from lineitem: an order is a run, its measures are metrics, its lines are rows."""
    items = table(spark, sf_dir, "lineitem")
    keyed = items.select(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linenumber").cast("long").alias("seq"), "l_quantity", "l_discount")
    wide = dealt(keyed, items.count(), "run_id", "seq").groupBy("run_id", "seq").agg(F.max("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"))
    return wide.unpivot(["run_id", "seq"], ["quantity", "discount"], "key", "value").withColumns({"step": F.col("seq").cast("double"), "t": F.col("seq") / 2})


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as rows, two points in each at most."""
    return points_to_rows(lines(spark, sf_dir), 2 * table(spark, sf_dir, "lineitem").count())


LINES = """w AS (SELECT CAST(l_orderkey AS VARCHAR) AS run_id, CAST(l_linenumber AS BIGINT) AS seq, max(l_quantity) AS quantity, max(l_discount) AS discount FROM lineitem GROUP BY ALL),
l AS (SELECT run_id, seq, 'quantity' AS key, quantity AS value, CAST(seq AS DOUBLE) AS step, seq / 2 AS t FROM w UNION ALL SELECT run_id, seq, 'discount', discount, CAST(seq AS DOUBLE), seq / 2 FROM w)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records from customers: region/nation/customer is the path."""
    t = lambda name: table(spark, sf_dir, name)
    k = F.col("c_custkey")
    joined = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    config = F.from_json(F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.when(k % 3 == 0, k % 10).alias("lr"), F.struct(F.lit("adam").alias("name")).alias("opt"))), "map<string,variant>")
    balance = F.when(k % 13 == 0, F.lit('"nan"')).when(k % 13 == 1, F.lit('"inf"')).otherwise(F.col("c_acctbal").cast("string"))
    summary = F.from_json(F.concat(F.lit('{"acctbal": '), balance, F.lit(', "segment": 1}')), "map<string,variant>")
    return joined.select(
        F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), F.concat_ws("/", "r_name", "n_name", "c_name").alias("run_id"), F.col("c_name").alias("name"), F.concat_ws("/", "r_name", "n_name").alias("parent"),
        F.element_at(F.array(*map(F.lit, ("running", "finished", "failed", "crashed"))), (k % 4 + 1).cast("int")).alias("state"),
        k.cast("double").alias("created"), (k % 700).cast("double").alias("heartbeat"), (k % 50).cast("double").alias("step"), k.alias("id"),
        F.when(k % 5 == 1, None).when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("v"), (k % 5).cast("string")), "c_mktsegment")).alias("tags"),
        config.alias("config"), summary.alias("summary"), F.parse_json(F.concat(F.lit('{"git": {"sha": "'), F.col("n_name"), F.lit('"}, "a.b": 1}'))).alias("info"), "c_acctbal", "c_mktsegment",
    )


RUNS = """r AS (SELECT r_name || '/' || n_name || '/' || c_name AS run_id, c_name AS name, r_name, n_name, CASE c_custkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'finished' WHEN 2 THEN 'failed' ELSE 'crashed' END AS state,
CAST(c_custkey AS DOUBLE) AS created, CAST(c_custkey % 700 AS DOUBLE) AS heartbeat, CAST(c_custkey % 50 AS DOUBLE) AS step, c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation, c_acctbal,
CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 10 END AS lr,
CASE WHEN c_custkey % 13 = 0 THEN CAST('nan' AS DOUBLE) WHEN c_custkey % 13 = 1 THEN CAST('inf' AS DOUBLE) ELSE c_acctbal END AS acctbal
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media items from pages: a page's language is its run, its number its place and step."""
    p = table(spark, sf_dir, "pages")
    return p.select((F.col("page_id") % 7).cast("string").alias("run_id"), F.col("page_id").alias("order"), F.col("page_id").cast("double").alias("step"), F.col("page_id").cast("double").alias("t"), F.concat(F.lit("page/"), (F.col("page_id") % 3).cast("string")).alias("key"), F.lit("html").alias("kind"), F.lit("html").alias("ext"), F.col("html").cast("binary").alias("content"))


MEDIA = "m AS (SELECT CAST(page_id % 7 AS VARCHAR) AS run_id, page_id AS ord, CAST(page_id AS DOUBLE) AS step, 'page/' || page_id % 3 AS key, html FROM pages)"
