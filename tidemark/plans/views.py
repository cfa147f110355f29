"""Derived views over the star-schema tables, the same SQL for both engines, so that every operator has inputs and an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OBS = """
SELECT r_name AS entity,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Jan 1997' WHEN '2' THEN 'Jun 1997' WHEN '3' THEN 'Oct 1997'
    WHEN '4' THEN 'Dec 1997' ELSE 'Mar 1998' END AS period,
  CAST(o_orderdate AS date) AS obs_date, o_orderkey AS seq, o_totalprice AS value, o_custkey AS src_key
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
OBS_EV = """
SELECT concat('U', CAST(user_id AS string)) AS entity,
  CASE event_type WHEN 'click' THEN 'Jan 2027' WHEN 'error' THEN 'Jun 2027' WHEN 'purchase' THEN 'Oct 2027'
    WHEN 'signup' THEN 'Dec 2027' ELSE 'Mar 2028' END AS period,
  CAST(ts AS date) AS obs_date, CAST(ts AS timestamp) AS update_ts, event_id AS seq, value
FROM events
"""
SNAP = """
SELECT entity, period, CAST(date_trunc('month', obs_date) AS date) AS snap_date, avg(value) AS value, max(value) AS high,
  min(value) AS low, count(DISTINCT src_key) AS coverage, sum(value) AS price
FROM v_obs GROUP BY entity, period, CAST(date_trunc('month', obs_date) AS date)
"""
GRID = "SELECT CAST(last_day(d) AS date) AS as_of FROM ({starts}) AS m"
SPARK_STARTS = "SELECT explode(sequence(DATE'1995-04-01', DATE'2001-05-01', INTERVAL 1 MONTH)) AS d"
DUCK_STARTS = "SELECT CAST(unnest(generate_series(DATE '1995-04-01', DATE '2001-05-01', INTERVAL 1 MONTH)) AS date) AS d"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")


def with_views(sql: str) -> str:
    """DuckDB: ``sql`` after the common table expressions of the views it names."""
    need = [(n, b) for n, b in (("v_obs", OBS), ("v_obs_ev", OBS_EV), ("v_snap", SNAP), ("v_grid", GRID.format(starts=DUCK_STARTS))) if n in sql or (n == "v_obs" and "v_snap" in sql)]
    parts = ", ".join(f"{n} AS ({b})" for n, b in need)
    body = sql.strip()
    if not parts:
        return body
    return f"WITH {parts}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {parts} {body}"


def dated(sql: str, *columns: str) -> str:
    """``sql`` (of :func:`with_views`) with the named date columns as text, as the queries return them."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)}) FROM ({sql})"


def plain(df: DataFrame) -> DataFrame:
    """``df`` with dates as text, which both engines write alike."""
    return df.withColumns({f.name: df[f.name].cast("string") for f in df.schema if f.dataType.typeName() == "date"})


class Views:
    """The views over the tables in one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _sql(self, sql: str, **frames: DataFrame) -> DataFrame:
        for name in frames:
            sql = sql.replace(name, "{" + name + "}")
        return self.spark.sql(sql, **frames)

    def obs(self) -> DataFrame:
        return self._sql(OBS.replace("FROM orders JOIN customer", "FROM ordrs JOIN custmr").replace("JOIN nation ON", "JOIN natn ON").replace("JOIN region ON", "JOIN regn ON"), ordrs=self.table("orders"), custmr=self.table("customer"), natn=self.table("nation"), regn=self.table("region"))

    def obs_ev(self) -> DataFrame:
        return self._sql(OBS_EV.replace("FROM events", "FROM evts"), evts=self.table("events"))

    def snap(self) -> DataFrame:
        return self._sql(SNAP, v_obs=self.obs())

    def grid(self) -> DataFrame:
        return self.spark.sql(GRID.format(starts=SPARK_STARTS))
