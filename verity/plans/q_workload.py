"""Q1-Q8: the SQL carried as text by the reference corpus and prompts, run on
the TPC-H-shaped tables as DataFrame plans.

Sums of money are taken over DECIMAL(18,2) so they are exact and independent
of partitioning. Aggregations over ``orders`` run before the join with
``customer`` (pre-aggregate, then join one row per customer), so the join
input shrinks to the number of customers and a hot customer key is combined
map-side instead of shuffled row by row.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verity.operators.sqlbench import avg6, r6
from verity.plans.catalog import register
from verity.sources.tables import table


def dsum(c):
    """Exact sum of a 2-decimal money column, returned as double."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


DSUM = "CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


@register(
    "q1_avg_over_table",
    "SELECT " + "(CASE WHEN count(p_retailprice) = 0 THEN NULL ELSE (CAST(sum(CAST(p_retailprice AS DECIMAL(28,8))) "
    "* 100000000 AS HUGEINT) + 50 * count(p_retailprice)) // (100 * count(p_retailprice)) END) / 1000000.0 "
    "AS avg_retailprice FROM part",
)
def q1_avg_over_table(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(avg6("p_retailprice").alias("avg_retailprice"))


def _spend(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    per_cust = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("order_count"), dsum("o_totalprice").alias("total_spent"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(per_cust, "c_custkey")


@register(
    "q2_join_group_sum_sort",
    f"""SELECT c.c_custkey, c.c_name, {DSUM.format(c='o.o_totalprice')} AS total_spent
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey, c.c_name ORDER BY total_spent DESC""",
)
def q2_join_group_sum_sort(spark, sf_dir):
    return _spend(spark, sf_dir).select("c_custkey", "c_name", "total_spent").orderBy(F.desc("total_spent"))


@register(
    "q3_join_group_having",
    f"""SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS order_count,
       {DSUM.format(c='o.o_totalprice')} AS total_spent
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey, c.c_name
HAVING count(o.o_orderkey) > 3 AND sum(o.o_totalprice) > 1000""",
)
def q3_join_group_having(spark, sf_dir):
    s = _spend(spark, sf_dir)
    return s.filter((F.col("order_count") > 3) & (F.col("total_spent") > 1000)).select(
        "c_custkey", "c_name", "order_count", "total_spent")


@register(
    "q4_monthly_growth_lag",
    f"""WITH monthly AS (
  SELECT year(o.o_orderdate) AS year, month(o.o_orderdate) AS month, p.p_brand AS category,
         {DSUM.format(c='l.l_extendedprice')} AS monthly_total
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2, 3)
SELECT year, month, category, monthly_total,
       lag(monthly_total) OVER (PARTITION BY category ORDER BY year, month) AS prev_total,
       round((monthly_total - lag(monthly_total) OVER (PARTITION BY category ORDER BY year, month))
             / nullif(lag(monthly_total) OVER (PARTITION BY category ORDER BY year, month), 0) * 100, 6) AS growth_pct
FROM monthly""",
)
def q4_monthly_growth_lag(spark, sf_dir):
    """CTE + 3-way join + month bucket + LAG growth. The window runs on the
    aggregated (category, month) rows, never on line items."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    monthly = j.groupBy(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("p_brand").alias("category")
    ).agg(dsum("l_extendedprice").alias("monthly_total"))
    w = Window.partitionBy("category").orderBy("year", "month")
    prev = F.lag("monthly_total").over(w)
    return monthly.select(
        "year", "month", "category", "monthly_total", prev.alias("prev_total"),
        r6(F.try_divide(F.col("monthly_total") - prev, F.when(prev != 0, prev)) * 100).alias("growth_pct"),
    )


@register("q5_filter", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 30")
def q5_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 30).select("c_custkey", "c_name", "c_acctbal")


@register(
    "q6_group_sum",
    f"SELECT p_type AS category, {DSUM.format(c='p_retailprice')} AS total_sales FROM part GROUP BY p_type",
)
def q6_group_sum(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(
        dsum("p_retailprice").alias("total_sales"))


@register(
    "q7_functional_update",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'processing' ELSE o_orderstatus END AS o_orderstatus "
    "FROM orders",
)
def q7_functional_update(spark, sf_dir):
    """UPDATE ... SET status WHERE as a projection (tables are immutable)."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.when(o.o_orderstatus == "P", F.lit("processing"))
                    .otherwise(o.o_orderstatus).alias("o_orderstatus"))


@register(
    "q8_join_filter",
    "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
    "WHERE o.o_totalprice > 1000",
)
def q8_join_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 1000).select("o_orderkey", "o_custkey",
                                                                                  "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "o_totalprice")
