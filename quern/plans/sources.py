"""Sources, sinks and changes of tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import versions as V
from quern.operators.relational import generate_series, generate_series_time
from quern.plans.registry import query, same
from quern.plans.statements import Engine
from quern.sources.files import copy_csv, copy_json
from quern.sources.tables import register, table

C = F.col
same("values_source", "SELECT a + 1 AS a, upper(b) AS b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) AS t(a, b)")
same("no_from", "SELECT 1 + 1 AS two, 'a' || 'b' AS ab")


@query("SELECT generate_series AS value FROM generate_series(1, 1000, 3)")
def generate_series_int(spark, sf):
    return generate_series(spark, 1, 1000, 3)


@query("SELECT generate_series AS value FROM generate_series(10, 1, -1)")
def generate_series_down(spark, sf):
    """Runs down by itself where the start is above the stop."""
    return generate_series(spark, 10, 1)


@query("SELECT generate_series AS value FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 6 HOUR)")
def generate_series_ts(spark, sf):
    return generate_series_time(spark, "2024-01-01 00:00:00", "2024-03-01 00:00:00", 6, "hour")


@query("SELECT o_custkey, count(*) AS n FROM (SELECT * FROM orders WHERE o_totalprice > 250000) v GROUP BY o_custkey")
def view_query(spark, sf):
    table(spark, sf, "orders").filter("o_totalprice > 250000").createOrReplaceTempView("quern_big_orders")
    return spark.sql("SELECT o_custkey, count(*) AS n FROM quern_big_orders GROUP BY o_custkey")


def order_versions(spark, sf):
    """Each order has a first version, and from its day on plus 30 a second with another status."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    later = C("o_orderdate") + F.expr("INTERVAL 30 DAY")
    first = o.select("o_orderkey", F.lit("new").alias("status"), C("o_orderdate").alias("valid_from"), later.alias("valid_to"))
    return first.unionAll(o.select("o_orderkey", C("o_orderstatus").alias("status"), later, F.lit(None).cast("timestamp_ntz")))


@query("""
SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1996-01-01' THEN o_orderstatus ELSE 'new' END AS status FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01'""")
def as_of_timestamp(spark, sf):
    return V.as_of(order_versions(spark, sf), F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")).select("o_orderkey", "status")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT c_custkey + 10000000, 1.5 FROM customer WHERE c_custkey % 100 = 0""")
def upsert_merge(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    changed = c.filter("c_custkey % 10 = 0").select("c_custkey", (C("c_acctbal") + 100).alias("c_acctbal"))
    fresh = c.filter("c_custkey % 100 = 0").select((C("c_custkey") + 10000000).alias("c_custkey"), F.lit(1.5).alias("c_acctbal"))
    return V.upsert(c, changed.unionAll(fresh), ["c_custkey"], ["c_acctbal"])


@query("SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT 20000001, 7.0")
def upsert_do_nothing(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    new = spark.sql("SELECT bigint(20000001) AS c_custkey, double(7) AS c_acctbal").unionAll(c.select("c_custkey", F.lit(-1.0)))
    return V.upsert(c, new, ["c_custkey"])


REPEATED = """
WITH s AS (SELECT c_custkey AS k, c_acctbal AS v, 0 AS step FROM customer
           UNION ALL SELECT c_custkey, c_acctbal + 1, 1 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 50000000, 5.0, 1 FROM customer
           UNION ALL SELECT c_custkey, c_acctbal + 2, 2 FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey + 50000000, 6.0, 2 FROM customer WHERE c_custkey % 3 = 0)
"""


def repeated(spark, sf):
    """Rows to insert in which keys come twice, and new keys too; one partition, as the order of rows counts."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    new = lambda v: c.select((C("c_custkey") + 50000000).alias("c_custkey"), F.lit(v).alias("c_acctbal"))
    more = lambda n: c.filter(f"c_custkey % {2 * n} = 0").withColumn("c_acctbal", C("c_acctbal") + n)
    return c, more(1).unionAll(new(5.0)).unionAll(more(2)).unionAll(new(6.0).filter("(c_custkey - 50000000) % 3 = 0"))


@query(REPEATED + "SELECT k AS c_custkey, arg_max(v, step) AS c_acctbal FROM s GROUP BY k")
def upsert_repeated_keys(spark, sf):
    c, rows = repeated(spark, sf)
    return V.upsert(c, rows, ["c_custkey"], ["c_acctbal"])


@query(REPEATED + "SELECT k AS c_custkey, arg_min(v, step) AS c_acctbal FROM s GROUP BY k")
def upsert_nothing_repeated(spark, sf):
    c, rows = repeated(spark, sf)
    return V.upsert(c, rows, ["c_custkey"])


@query("SELECT s_suppkey, CASE WHEN nullif(s_nationkey, 3) > 12 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_rewrite(spark, sf):
    s = table(spark, sf, "supplier")
    return V.update(s, F.nullif(C("s_nationkey"), F.lit(3).cast("bigint")) > 12, s_acctbal=C("s_acctbal") * 2).select("s_suppkey", "s_acctbal")


@query("SELECT s_suppkey FROM supplier WHERE NOT coalesce(nullif(s_nationkey, 3) > 12, false)")
def delete_rewrite(spark, sf):
    return V.delete(table(spark, sf, "supplier"), F.nullif(C("s_nationkey"), F.lit(3).cast("bigint")) > 12).select("s_suppkey")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT 900001, 'new', 1, 0.5")
def insert_append(spark, sf):
    return V.insert(table(spark, sf, "supplier"), spark.sql("SELECT bigint(900001) AS s_suppkey, 'new' AS s_name, bigint(1) AS s_nationkey, double(0.5) AS s_acctbal"), "s_suppkey", ["s_name"])


def shared_folder(spark) -> str:
    """A new folder in the one that the cluster shares; a folder of this machine only where the executors are on it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{folder.rstrip('/') if folder else 'file://' + tempfile.mkdtemp(prefix='quern-')}/tables-{uuid.uuid4().hex}"


def suppliers(spark, sf) -> Engine:
    """An engine whose catalogue holds supplier and nation, as SQL made them."""
    engine = Engine(spark, shared_folder(spark))
    engine.sql("CREATE TABLE land (id INTEGER PRIMARY KEY, name TEXT NOT NULL)")
    engine.sql("CREATE TABLE firm (id INTEGER PRIMARY KEY, name TEXT NOT NULL, land_id INTEGER REFERENCES land(id), balance FLOAT DEFAULT 0.5, CHECK (id >= 0))")
    register(spark, sf, "nation", "supplier")
    engine.sql("INSERT INTO land SELECT n_nationkey, n_name FROM nation")
    engine.sql("INSERT INTO firm SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
    return engine


@query("""
SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN s_name || '!' ELSE s_name END AS name, CASE WHEN s_acctbal < 0 THEN -s_acctbal ELSE s_acctbal END AS balance
FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT 900001, 'new', 0.5""")
def sql_changes(spark, sf):
    engine = suppliers(spark, sf)
    engine.sql("UPDATE firm SET name = name || '!', balance = -balance WHERE balance < 0")
    engine.sql("DELETE FROM firm AS f WHERE f.land_id IN (SELECT id FROM land WHERE id = ?)", [3])
    engine.sql("INSERT INTO firm (id, name, land_id) VALUES (900001, 'new', 1)")
    return engine.sql("SELECT id, name, balance FROM firm")


@query("SELECT s_suppkey AS id, s_acctbal * 2 AS twice FROM supplier WHERE s_nationkey > 12")
def sql_update_returning(spark, sf):
    return suppliers(spark, sf).sql("UPDATE firm SET balance = balance * 2 WHERE land_id > 12 RETURNING id, balance AS twice")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_acctbal < 1000")
def sql_delete_returning(spark, sf):
    return suppliers(spark, sf).sql("DELETE FROM firm WHERE balance < 1000 RETURNING id, name")


@query("""
SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal > 5000 THEN s_acctbal + 10 ELSE s_acctbal END AS balance FROM supplier
UNION ALL SELECT s_suppkey + 70000000, 'fresh', 10 FROM supplier WHERE s_acctbal > 5000""")
def sql_upsert_expression(spark, sf):
    engine = suppliers(spark, sf)
    engine.sql("INSERT INTO firm (id, name, balance) SELECT s_suppkey, 'met', 10 FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT s_suppkey + 70000000, 'fresh', 10 FROM supplier WHERE s_acctbal > 5000 "
               "ON CONFLICT (id) DO UPDATE SET balance = firm.balance + excluded.balance")  # fmt: skip
    return engine.sql("SELECT id, name, balance FROM firm")


@query("SELECT n_name AS land, count(*) AS n, count(CASE WHEN s_acctbal >= 3000 THEN 1 END) AS left_over FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def sql_as_of(spark, sf):
    """The first change of firm makes it, the second fills it; paths go over the references that SQL declared."""
    engine = suppliers(spark, sf)
    engine.sql("DELETE FROM firm WHERE balance < 3000")
    return engine.sql("SELECT l.name AS land, count(*) AS n, count(f.id) AS left_over FROM firm AS OF TRANSACTION 2 AS o JOIN land l ON l.id = o.land_id LEFT JOIN firm f ON f.id = o.id GROUP BY l.name")


@query("SELECT n_name AS land, sum(s_acctbal) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY n_name HAVING sum(s_acctbal) > 5000")
def sql_view(spark, sf):
    engine = suppliers(spark, sf)
    engine.sql("CREATE VIEW solvent AS SELECT f.land_id.name AS land, f.balance FROM firm f WHERE f.balance > 0")
    engine.sql("CREATE VIEW totals (land, total) AS SELECT land, sum(balance) FROM solvent GROUP BY land")
    return engine.sql("SELECT land, total FROM totals WHERE total > 5000")


CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("rich", T.BooleanType()), T.StructField("c_acctbal", T.DoubleType())])


def customers(spark, sf):
    rich = F.when(C("c_acctbal") > 5000, "yes").when(C("c_acctbal") > 0, "F")
    return table(spark, sf, "customer").select("c_custkey", "c_name", rich.alias("rich"), "c_acctbal")


COPIED = "SELECT c_custkey, c_name, CASE WHEN c_acctbal > 5000 THEN true WHEN c_acctbal > 0 THEN false END AS rich, c_acctbal FROM customer"


@query(COPIED)
def copy_csv_roundtrip(spark, sf):
    path = shared_folder(spark)
    customers(spark, sf).write.csv(path, header=True, sep=";", escape='"')
    return copy_csv(spark, path, CUSTOMER, delimiter=";")


@query(COPIED)
def copy_json_roundtrip(spark, sf):
    path = shared_folder(spark)
    customers(spark, sf).withColumnRenamed("c_name", "C_NAME").write.json(path)
    return copy_json(spark, path, CUSTOMER)


@query("""
SELECT 'o_custkey' AS column_name, count(*) AS row_count, count(*) - count(o_custkey) AS null_count, CAST(min(o_custkey) AS VARCHAR) AS least, CAST(max(o_custkey) AS VARCHAR) AS most FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders""")
def analyze_table(spark, sf):
    """ANALYZE: what a catalogue keeps of each column, in one pass over the table."""
    names = ["o_custkey", "o_orderstatus"]
    one = table(spark, sf, "orders").agg(F.count("*").alias("n"), *[f.alias(f"{k}_{c}") for c in names for k, f in (("some", F.count(c)), ("least", F.min(c)), ("most", F.max(c)))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), C("n").alias("row_count"), (C("n") - C(f"some_{c}")).alias("null_count"), C(f"least_{c}").cast("string").alias("least"), C(f"most_{c}").cast("string").alias("most")) for c in names])
    return one.select(F.inline(rows))
