"""Table queries: filters, joins, aggregates, order, and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.queries.registry import relational, rounded, tql

FLAGSHIP = (
    "FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE orders.o_totalprice > 1000.0 "
    "RETURN customer.c_mktsegment AS segment, count(*) AS n, sum(orders.o_totalprice) AS total"
)
tql("segment_revenue", relational, FLAGSHIP,
    "select c_mktsegment segment, count(*) n, round(sum(o_totalprice), 2) total from orders join customer on o_custkey = c_custkey where o_totalprice > 1000 group by 1",
    lambda df: rounded(df, 2, "total"))
tql("scan_filter", relational, 'FROM orders WHERE o_orderstatus = "F" AND o_totalprice >= 250000.0 RETURN o_orderkey AS k, o_totalprice AS price',
    "select o_orderkey k, o_totalprice price from orders where o_orderstatus = 'F' and o_totalprice >= 250000")
tql("in_list", relational, 'FROM part WHERE p_brand IN ("Brand#1", "Brand#4", "Brand#17") RETURN p_partkey AS k, p_brand AS brand',
    "select p_partkey k, p_brand brand from part where p_brand in ('Brand#1', 'Brand#4', 'Brand#17')")
tql("in_one", relational, 'FROM customer WHERE c_mktsegment IN ("BUILDING") RETURN c_custkey AS k', "select c_custkey k from customer where c_mktsegment in ('BUILDING')")
tql("not_in", relational, 'FROM orders WHERE o_orderpriority NOT IN ("1-URGENT", "5-LOW") RETURN o_orderpriority AS p, count(*) AS n',
    "select o_orderpriority p, count(*) n from orders where o_orderpriority not in ('1-URGENT', '5-LOW') group by 1")
tql("between_inclusive", relational, "FROM part WHERE p_size BETWEEN 10 AND 12 RETURN p_partkey AS k, p_size AS size", "select p_partkey k, p_size size from part where p_size between 10 and 12")
tql("like_pattern", relational, 'FROM part WHERE p_name LIKE "_ed%" RETURN p_partkey AS k, p_name AS name', "select p_partkey k, p_name as name from part where p_name like '_ed%'")
tql("contains_text", relational, 'FROM part WHERE p_name CONTAINS "ring" RETURN count(*) AS n', "select count(*) n from part where contains(p_name, 'ring')")
tql("starts_with_text", relational, 'FROM part WHERE p_name STARTS WITH "blue" RETURN p_partkey AS k', "select p_partkey k from part where starts_with(p_name, 'blue')")
tql("is_null_after_left_join", relational, "FROM customer LEFT JOIN orders ON orders.o_custkey = customer.c_custkey WHERE orders.o_orderkey IS NULL RETURN customer.c_custkey AS k",
    "select c_custkey k from customer left join orders on o_custkey = c_custkey where o_orderkey is null")
tql("bool_logic", relational, 'FROM customer WHERE NOT (c_acctbal < 0.0 OR c_mktsegment = "BUILDING") AND (c_nationkey = 3 OR c_nationkey = 5) RETURN c_custkey AS k',
    "select c_custkey k from customer where not (c_acctbal < 0 or c_mktsegment = 'BUILDING') and (c_nationkey = 3 or c_nationkey = 5)")
tql("projection_alias", relational, "FROM nation RETURN n_nationkey AS id, toUpper(n_name) AS upper_name, toLower(n_name) AS lower_name",
    "select n_nationkey id, upper(n_name) upper_name, lower(n_name) lower_name from nation")
tql("distinct_rows", relational, "FROM orders RETURN DISTINCT o_orderstatus AS status, o_orderpriority AS priority", "select distinct o_orderstatus status, o_orderpriority priority from orders")
tql("order_limit_topk", relational, "FROM orders RETURN o_orderkey AS k, o_totalprice AS price ORDER BY price DESC, k LIMIT 25",
    "select o_orderkey k, o_totalprice price from orders order by price desc, k limit 25")
tql("inner_join", relational, "FROM supplier JOIN nation ON supplier.s_nationkey = nation.n_nationkey RETURN supplier.s_name AS supplier, nation.n_name AS nation",
    "select s_name supplier, n_name nation from supplier join nation on s_nationkey = n_nationkey")
tql("left_join", relational, "FROM customer LEFT JOIN orders ON customer.c_custkey = orders.o_custkey RETURN customer.c_custkey AS k, count(orders.o_orderkey) AS n",
    "select c_custkey k, count(o_orderkey) n from customer left join orders on c_custkey = o_custkey group by 1")
tql("multiway_join", relational,
    "FROM lineitem JOIN orders ON lineitem.l_orderkey = orders.o_orderkey JOIN customer ON orders.o_custkey = customer.c_custkey "
    "JOIN nation ON customer.c_nationkey = nation.n_nationkey JOIN region ON nation.n_regionkey = region.r_regionkey "
    "RETURN region.r_name AS region, count(*) AS n, sum(lineitem.l_quantity) AS quantity",
    "select r_name region, count(*) n, round(sum(l_quantity), 2) quantity from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey "
    "join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1", lambda df: rounded(df, 2, "quantity"))  # fmt: skip
tql("group_agg", relational,
    "FROM lineitem RETURN l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(l_quantity) AS quantity, avg(l_extendedprice) AS price, min(l_discount) AS low, max(l_tax) AS high",
    "select l_returnflag flag, l_linestatus status, count(*) n, round(sum(l_quantity), 2) quantity, round(avg(l_extendedprice), 2) price, min(l_discount) low, max(l_tax) high from lineitem group by 1, 2",
    lambda df: rounded(df, 2, "quantity", "price"))
tql("global_agg", relational, "FROM customer RETURN count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, avg(c_acctbal) AS mean",
    "select count(*) n, min(c_acctbal) low, max(c_acctbal) high, round(avg(c_acctbal), 2) mean from customer", lambda df: rounded(df, 2, "mean"))
tql("count_star", relational, "FROM lineitem RETURN count(*) AS n", "select count(*) n from lineitem")
tql("having_alias", relational, "FROM orders HAVING n > 15 RETURN o_custkey AS k, count(*) AS n", "select o_custkey k, count(*) n from orders group by 1 having count(*) > 15")
tql("having_aggregate", relational, "FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 490000.0 RETURN o_custkey AS k, count(*) AS n",
    "select o_custkey k, count(*) n from orders group by 1 having max(o_totalprice) > 490000")
tql("collect_sorted", relational, "FROM nation RETURN n_regionkey AS region, collect(n_name) AS names",
    "select n_regionkey region, array_to_string(list(n_name order by n_name), ',') as names from nation group by 1", lambda df: df.withColumn("names", F.array_join("names", ",")))
tql("count_distinct", relational, "FROM lineitem RETURN l_returnflag AS flag, count(DISTINCT l_suppkey) AS suppliers",
    "select l_returnflag flag, count(distinct l_suppkey) suppliers from lineitem group by 1")
tql("coalesce_case_fns", relational, 'FROM customer LEFT JOIN orders ON customer.c_custkey = orders.o_custkey RETURN customer.c_custkey AS k, coalesce(orders.o_orderstatus, "none") AS status, count(*) AS n',
    "select c_custkey k, coalesce(o_orderstatus, 'none') status, count(*) n from customer left join orders on c_custkey = o_custkey group by 1, 2")
tql("time_bucket_day", relational, 'FROM events RETURN time_bucket("1d", ts) AS bucket, count(*) AS n',
    "select b - b % 86400000000000 bucket, count(*) n from (select epoch_us(ts) * 1000 b from events) group by 1")
tql("time_bucket_6h", relational, 'FROM events RETURN time_bucket("6h", ts) AS bucket, event_type AS kind, count(*) AS n, sum(value) AS total',
    "select b - b % 21600000000000 bucket, event_type kind, count(*) n, round(sum(value), 2) total from (select epoch_us(ts) * 1000 b, * from events) group by 1, 2", lambda df: rounded(df, 2, "total"))
tql("time_bucket_week_epoch", relational, 'FROM events RETURN time_bucket("1w", ts) AS bucket, count(*) AS n',
    "select b - b % 604800000000000 bucket, count(*) n from (select epoch_us(ts) * 1000 b from events) group by 1")
for unit in ("hour", "day", "week"):
    tql(f"date_trunc_{unit}", relational, f'FROM events RETURN date_trunc("{unit}", ts) AS bucket, count(*) AS n',
        f"select epoch_us(date_trunc('{unit}', ts)) * 1000 bucket, count(*) n from events group by 1")
for unit in ("month", "quarter", "year"):
    tql(f"date_trunc_{unit}", relational, f'FROM orders RETURN date_trunc("{unit}", o_orderdate) AS bucket, count(*) AS n',
        f"select epoch_us(date_trunc('{unit}', o_orderdate)::timestamp) * 1000 bucket, count(*) n from orders group by 1")
tql("recent_events", relational, 'FROM events WHERE ts >= ago("5d") RETURN event_type AS kind, count(*) AS n',
    "select event_type kind, count(*) n from events where epoch_us(ts) * 1000 >= 1706745600000000000 - 5 * 86400000000000 group by 1")
