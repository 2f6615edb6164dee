"""Categorical encoders."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from shelfline.catalog.base import DAILY, query, r6
from shelfline.functions.rolling import along
from shelfline.operators import encode
from shelfline.sources import files, retail


def _orders(spark, sf):
    orders = files.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    customers = files.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", "o_custkey", "o_orderpriority", "c_mktsegment", "o_totalprice")


_ORDERS = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, c_mktsegment, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
"""


@query(
    "e01_label_encode",
    """WITH c AS (SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS brand_code FROM (SELECT DISTINCT p_brand FROM part))
SELECT 'part' AS side, p_partkey AS row_key, brand_code FROM part JOIN c USING (p_brand)
UNION ALL SELECT 'line', l_orderkey, brand_code FROM lineitem JOIN part ON l_partkey = p_partkey JOIN c USING (p_brand)""",
)
def label_encode(spark, sf):
    """Codes learned on one table and applied to two."""
    part = files.table(spark, sf, "part").select("p_partkey", "p_brand")
    codes = encode.level_codes(part, "p_brand")
    lines = files.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    a = encode.label_encode(part, "p_brand", codes, "brand_code")
    b = encode.label_encode(lines, "p_brand", codes, "brand_code")
    return a.select(F.lit("part").alias("side"), F.col("p_partkey").alias("row_key"), "brand_code").unionByName(
        b.select(F.lit("line").alias("side"), F.col("l_orderkey").alias("row_key"), "brand_code")
    )


@query(
    "e02_category_codes",
    DAILY
    + """, c AS (SELECT event_name_1, CAST(dense_rank() OVER (ORDER BY event_name_1) AS BIGINT) AS code FROM (SELECT DISTINCT event_name_1 FROM cal WHERE event_name_1 IS NOT NULL)),
t AS (SELECT type_name, CAST(dense_rank() OVER (ORDER BY type_name) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT store_id AS type_name FROM ids))
SELECT id, date, coalesce(c.code, 0) AS event_code, t.code AS store_code, t.code + 1 AS store_factor
FROM daily JOIN cal USING (date) LEFT JOIN c USING (event_name_1) JOIN t ON t.type_name = daily.store_id""",
)
def category_codes(spark, sf):
    sold = retail.staged_daily_sold(spark, sf)
    calendar = retail.calendar(spark, 0, sold).select("date", "event_name_1")
    stores = sold.select("store_id").distinct()
    df = retail.daily_series(spark, sf, sold).select("id", "store_id", "date").join(F.broadcast(calendar), "date")
    df = encode.category_codes(df, "event_name_1", "event_code", source=calendar)
    df = encode.category_codes(df, "store_id", "store_code", source=stores)
    return df.select("id", "date", "event_code", "store_code", (F.col("store_code") + 1).alias("store_factor"))


@query(
    "e03_ordinal_encoder",
    _ORDERS
    + """, seen AS (SELECT c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS learned FROM (SELECT DISTINCT c_mktsegment FROM o WHERE o_orderpriority = '1-URGENT' AND c_mktsegment <> 'MACHINERY'))
SELECT o_orderkey, learned, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 END AS BIGINT) AS given FROM o LEFT JOIN seen USING (c_mktsegment)""",
)
def ordinal_encoder(spark, sf):
    df = _orders(spark, sf)
    train = df.filter("o_orderpriority = '1-URGENT' AND c_mktsegment <> 'MACHINERY'")
    learned = encode.OrdinalEncoder().fit(train, "c_mktsegment")
    given = encode.OrdinalEncoder({"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1}).fit(df, "o_orderpriority")
    out = given.transform(learned.transform(df, "c_mktsegment", "learned"), "o_orderpriority", "given")
    return out.select("o_orderkey", "learned", "given")


_GROUPED = """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT source, row_number() OVER (ORDER BY n DESC, source) AS pos, sum(n) OVER (ORDER BY n DESC, source) AS run FROM c),
g AS (SELECT doc_id, CASE WHEN pos <= 6 THEN source ELSE 'OTHER' END AS top, CASE WHEN run < 0.5 * (SELECT sum(n) FROM c) THEN source ELSE 'OTHER' END AS share FROM documents JOIN r USING (source))
"""


@query(
    "e04_grouping_encoder",
    _GROUPED
    + """SELECT doc_id, (SELECT count(DISTINCT top) FROM g x WHERE x.top < g.top) AS top_code, (SELECT count(DISTINCT share) FROM g x WHERE x.share < g.share) AS share_code FROM g""",
)
def grouping_encoder(spark, sf):
    df = files.table(spark, sf, "documents").select("doc_id", "source")
    top = encode.GroupingEncoder(encode.OrdinalEncoder(), 6).fit(df, "source")
    share = encode.GroupingEncoder(encode.OrdinalEncoder(), 0.5).fit(df, "source")
    return share.transform(top.transform(df, "source", "top_code"), "source", "share_code").drop("source")


@query(
    "e05_target_mean_encoder",
    _ORDERS
    + """, m AS (SELECT o_orderpriority, avg(o_totalprice) AS v FROM o WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT o_orderkey, round(coalesce(v, (SELECT avg(o_totalprice) FROM o WHERE o_orderpriority <> '5-LOW')), 4) AS encoded FROM o LEFT JOIN m USING (o_orderpriority)""",
)
def target_mean_encoder(spark, sf):
    df = _orders(spark, sf)
    model = encode.TargetAvgEncoder().fit(df.filter("o_orderpriority <> '5-LOW'"), "o_orderpriority", "o_totalprice")
    out = model.transform(df, "o_orderpriority", "encoded")
    return out.select("o_orderkey", F.round("encoded", 4).alias("encoded"))


# Targets in whole cents: their sums are exact, so the quotients agree bit for bit.
_LOO = """WITH o AS (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS y FROM orders),
s AS (SELECT o_custkey, CAST(sum(y) AS DOUBLE) AS s, count(*) AS n FROM o GROUP BY 1), g AS (SELECT avg(y) AS g FROM o),
e AS (SELECT o.*, s, n, g, CASE WHEN n > 1 THEN (s - y) / (n - 1) ELSE g END AS train, CASE WHEN n > 1 THEN s / n ELSE g END AS score FROM o JOIN s USING (o_custkey), g)
"""


def _cents(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return files.table(spark, sf, "orders").select("o_orderkey", "o_custkey", cents.alias("y"))


@query("e06_leave_one_out", _LOO + "SELECT o_orderkey, train AS train_value, score AS score_value FROM e")
def leave_one_out(spark, sf):
    df = _cents(spark, sf)
    model = encode.LeaveOneOutEncoder(noise=False).fit(df, "o_custkey", "y")
    out = model.transform(model.transform(df, "o_custkey", "train_value", target="y"), "o_custkey", "score_value")
    return out.select("o_orderkey", "train_value", "score_value")


def _draw(i: int) -> str:
    return f"((('0x' || substr(md5('{i}|' || o_orderkey), 1, 8))::BIGINT + 0.5) / 4294967296)"


@query(
    "e06_leave_one_out_noise",
    _LOO + f"SELECT o_orderkey, round(train * (1 + 0.05 * sqrt(-2 * ln({_draw(0)})) * cos(2 * pi() * {_draw(1)})), 3) AS train_value FROM e",
)
def leave_one_out_noise(spark, sf):
    df = _cents(spark, sf)
    model = encode.LeaveOneOutEncoder(noise=True, sigma=0.05, seed=0).fit(df, "o_custkey", "y")
    out = model.transform(df, "o_custkey", "train_value", target="y", key="o_orderkey")
    return out.select("o_orderkey", F.round("train_value", 3).alias("train_value"))


@query(
    "e07_one_hot",
    "SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS date, "
    + ", ".join(f"CAST(l_returnflag = '{v}' AS INTEGER) AS \"l_returnflag_{v}\"" for v in "ANR")
    + " FROM lineitem",
)
def one_hot(spark, sf):
    df = files.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("date"), "l_returnflag"
    )
    return encode.OneHotEncoder().fit(df, "l_returnflag").transform(df, "l_returnflag", "l_returnflag").drop("l_returnflag")


@query(
    "e08_many_columns",
    _ORDERS
    + """, p AS (SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT o_orderpriority FROM o)),
m AS (SELECT c_mktsegment, avg(o_totalprice) AS v FROM o GROUP BY 1)
SELECT o_orderkey, o_totalprice, p.code AS "o_orderpriority_OrdinalEncoder", round(m.v, 4) AS "c_mktsegment_TargetAvgEncoder" FROM o JOIN p USING (o_orderpriority) JOIN m USING (c_mktsegment)""",
)
def many_columns(spark, sf):
    df = _orders(spark, sf).drop("o_custkey")
    columns = ["o_orderpriority", "c_mktsegment"]
    model = encode.CategoricalFeaturesEncoder(columns, [encode.OrdinalEncoder(), encode.TargetAvgEncoder()])
    out = model.fit(df, "o_totalprice").transform(df, "o_totalprice")
    return out.withColumn("c_mktsegment_TargetAvgEncoder", F.round("c_mktsegment_TargetAvgEncoder", 4))


def target_encoding_sql(source: str, target: str) -> tuple[str, str]:
    """(CTEs, joins) that attach every key set's mean and std to a table with the id columns."""
    ctes, joins = [], []
    for keys in encode.TARGET_KEY_SETS:
        name = "enc_" + "_".join(keys)
        ctes.append(
            f"t_{name} AS (SELECT {', '.join(keys)}, avg({target}) AS {name}_mean, stddev_samp({target}) AS {name}_std FROM {source} GROUP BY ALL)"
        )
        joins.append(f"LEFT JOIN t_{name} USING ({', '.join(keys)})")
    return ",\n".join(ctes), "\n".join(joins)


_ENC_NAMES = [f"enc_{'_'.join(k)}_{s}" for k in encode.TARGET_KEY_SETS for s in ("mean", "std")]
_ENC = target_encoding_sql("early", "shifted_demand")


@query(
    "e09_target_encodings",
    DAILY
    + """, s AS (SELECT *, lag(demand, 28) OVER (PARTITION BY id ORDER BY date) AS shifted_demand FROM daily),
early AS (SELECT * FROM s WHERE shifted_demand IS NOT NULL AND date <= DATE '2001-11-04' - 28),
"""
    + _ENC[0]
    + "\nSELECT id, date, "
    + ", ".join(f"round({n}, 6) AS {n}" for n in _ENC_NAMES)
    + " FROM s\n"
    + _ENC[1],
)
def target_encodings(spark, sf):
    df = retail.daily_series(spark, sf).withColumn("shifted_demand", F.lag("demand", 28).over(along("id", "date")))
    early = df.filter(F.col("date") <= F.lit(retail.SPAN_END - timedelta(days=28)))
    table = encode.target_encoding_table(early, "shifted_demand", retail.IDS)
    out = df.select("id", "date").join(table.drop(*retail.IDS[1:]), "id", "left")
    return out.select("id", "date", *[r6(n).alias(n) for n in _ENC_NAMES])
