"""Building blocks of the SQL counterparts (DuckDB dialect)."""

from __future__ import annotations

NET = "(mdr_pct*amount*0.01 - cashback_amt - processing_fee_amt)"
MDR = "(mdr_pct*amount*0.01)"
MONTH = "strftime(txn_date,'%Y-%m')"
MIDX = "(year(txn_date)*12+month(txn_date)-1)"

# The star schema over the driver tables; `s` is the fact restricted to SUCCESS.
STAR = """
fact_transactions AS (
 SELECT l.l_orderkey*10 + l.l_linenumber AS transaction_id,
  o.o_orderdate + to_seconds((l.l_partkey*37 + l.l_suppkey*1171) % 86400) AS txn_ts,
  CAST(o.o_orderdate AS DATE) AS txn_date, o.o_custkey AS customer_id, l.l_partkey AS merchant_id,
  CAST(substr(o.o_orderpriority,1,1) AS INT) AS channel_id,
  CAST(l.l_extendedprice AS DECIMAL(12,2)) AS amount,
  CAST(l.l_tax*100 AS DECIMAL(6,4)) AS mdr_pct,
  CAST(CAST(l.l_extendedprice AS DECIMAL(12,2))*CAST(l.l_discount AS DECIMAL(4,2))
       *CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(14,5)) AS cashback_amt,
  CAST(CAST(l.l_quantity AS DECIMAL(6,2))*CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(10,3))
    AS processing_fee_amt,
  CASE WHEN l.l_returnflag='R' AND o.o_orderstatus='P' THEN 'PENDING'
       WHEN l.l_returnflag='R' AND l.l_linestatus='F' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  l.l_linenumber % 4 AS retry_count, CAST(l.l_shipdate AS DATE) AS settlement_date,
  CASE WHEN l.l_returnflag='R' THEN CAST(l.l_extendedprice AS DECIMAL(12,2))
       ELSE CAST(0 AS DECIMAL(12,2)) END AS refunded_amt,
  CASE WHEN l.l_linestatus='O' THEN 'Android' ELSE 'iOS' END AS device_os,
  c.c_nationkey AS city_id, l.l_suppkey % 10 AS acquirer_id
 FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey
 JOIN customer c ON o.o_custkey=c.c_custkey),
dim_channel AS (SELECT * FROM (VALUES (1,'UPI'),(2,'CARD'),(3,'WALLET'),(4,'NETBANKING'),(5,'EMI'))
  t(channel_id, channel_name)),
dim_merchant AS (SELECT p_partkey AS merchant_id, p_type AS category, p_name AS merchant_name,
  p_size % 25 AS city_id FROM part),
dim_city AS (SELECT n_nationkey AS city_id, n_name AS city_name, r_name AS state,
  concat('Tier-', CAST(n_nationkey % 3 + 1 AS VARCHAR)) AS tier
  FROM nation JOIN region ON n_regionkey=r_regionkey),
dim_customer AS (SELECT c_custkey AS customer_id,
  CAST(DATE '1994-01-01' + CAST(c_custkey % 365 AS INT) AS DATE) AS signup_date,
  CAST(DATE '1994-01-01' + CAST(c_custkey % 365 AS INT) AS DATE) AS first_txn_date,
  c_nationkey AS city_id, c_mktsegment AS segment_tag FROM customer),
dim_date AS (SELECT CAST(d AS DATE) AS date, year(d) AS year, month(d) AS month, day(d) AS day,
  weekofyear(d) AS week_of_year, dayofweek(d) IN (0,6) AS is_weekend,
  strftime(d,'%m-%d') IN ('01-26','08-15','10-02','12-25') AS holiday_flag
  FROM generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY) t(d)),
s AS (SELECT *, mdr_pct*amount*0.01 AS mdr,
  mdr_pct*amount*0.01 - cashback_amt - processing_fee_amt AS net
  FROM fact_transactions WHERE status='SUCCESS')"""


def sql(select: str, **ctes: str) -> str:
    """A statement over the star, with further named subqueries."""
    more = "".join(f",\n{name} AS ({body})" for name, body in ctes.items())
    return f"WITH {STAR}{more}\n{select}"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def text(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def money(x: str, digits: int = 2) -> str:
    return f"CAST(round({x},{digits}) AS DOUBLE)"


def div(num: str, den: str) -> str:
    return f"({dbl(num)}/NULLIF({dbl(den)},0))"


def pct(num: str, den: str, digits: int = 2) -> str:
    return f"round({div(num, den)}*100,{digits})"


def ratio(num: str, den: str, digits: int = 2) -> str:
    return f"round({div(num, den)},{digits})"


def growth(cur: str, prev: str, digits: int = 2) -> str:
    return f"round(({dbl(cur)}-{dbl(prev)})/NULLIF({dbl(prev)},0)*100,{digits})"


def share(x: str, within: str = "", digits: int = 2) -> str:
    return pct(x, f"sum({x}) OVER ({within})", digits)


# Standard sums over `s` (or the fact, with the expressions spelled out).
N, GMV, USERS = "count(*)", "sum(amount)", "count(DISTINCT customer_id)"
SMDR, SCB, SFEE, SNET = "sum(mdr)", "sum(cashback_amt)", "sum(processing_fee_amt)", "sum(net)"
SCOST = "sum(cashback_amt + processing_fee_amt)"
OK = "count(CASE WHEN status='SUCCESS' THEN 1 END)"

JOIN_CH = "JOIN dim_channel ch USING (channel_id)"
JOIN_CI = "JOIN dim_city ci USING (city_id)"
