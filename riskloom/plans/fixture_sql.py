"""SQL text of the test fixtures (FIXTURES.md §5, §6) for the DuckDB oracle.

``TX_SQL`` defines the transaction view over ``orders``/``customer``/``nation``;
``SC_SQL`` the deterministic surrogate score over ``tx``; ``MF_SQL`` the
mode-filled view profiling groups on; ``CITY_SQL`` the city dimension stand-in.
"""

TX_SQL = """
WITH b AS (
  SELECT o_orderkey AS k, o_custkey AS cust, o_totalprice * 0.25 AS amt,
         o_orderdate AS d, c_acctbal, c_nationkey AS hk,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST((o_orderkey * 7) % 25 AS INT) ELSE c_nationkey END AS lk,
         CAST((o_orderkey * 37) % 1440 AS INT) AS mi
  FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (
  SELECT b.*, hn.n_name AS home, ln.n_name AS loc,
         hn.n_regionkey AS hr, ln.n_regionkey AS lr
  FROM b JOIN nation hn ON hk = hn.n_nationkey JOIN nation ln ON lk = ln.n_nationkey),
h AS (
  SELECT g.*,
    CASE WHEN hr <> lr THEN 'Yes' ELSE 'No' END AS intl,
    CASE WHEN k % 4 = 1 THEN 'Yes' ELSE 'No' END AS newm,
    CASE WHEN mi < 360 OR mi >= 1320 THEN 'Yes' ELSE 'No' END AS unu,
    CASE WHEN k % 11 = 0 THEN k % 4 ELSE 0 END AS failed,
    CASE WHEN cust % 9 = 0 THEN 1 + cust % 3 ELSE 0 END AS pf,
    CAST(sum(CAST(amt AS DECIMAL(18,4))) OVER w AS DOUBLE) / count(amt) OVER w AS av,
    max(amt) OVER (PARTITION BY cust ORDER BY d, k ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mx
  FROM g WINDOW w AS (PARTITION BY cust ORDER BY d, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT k AS Transaction_ID, cust AS Customer_ID, amt AS Transaction_Amount,
  CASE WHEN k % 50 = 7 THEN NULL WHEN k % 50 = 8 THEN 'bad'
       ELSE concat(lpad(CAST(CAST(floor(mi / 60.0) AS INT) AS STRING), 2, '0'), ':', lpad(CAST(mi % 60 AS STRING), 2, '0')) END AS Transaction_Time,
  CAST(d AS DATE) AS Transaction_Date,
  CASE k % 4 WHEN 0 THEN 'Online' WHEN 1 THEN 'ATM' WHEN 2 THEN 'POS' ELSE 'Wire Transfer' END AS Transaction_Type,
  CASE WHEN k % 40 = 3 THEN NULL ELSE concat('Cat', CAST(k % 16 AS STRING)) END AS Merchant_Category,
  loc AS Transaction_Location, home AS Customer_Home_Location,
  CASE WHEN k % 60 = 5 THEN NULL ELSE CAST(abs(lk - hk) * 300 AS DOUBLE) END AS Distance_From_Home,
  CASE k % 3 WHEN 0 THEN 'Debit' WHEN 1 THEN 'Credit' ELSE 'Prepaid' END AS Card_Type,
  c_acctbal * 10 AS Account_Balance,
  1 + k % 12 AS Daily_Transaction_Count, 1 + k % 12 + cust % 30 AS Weekly_Transaction_Count,
  av AS Avg_Transaction_Amount, mx AS Max_Transaction_Last_24h,
  intl AS Is_International_Transaction, newm AS Is_New_Merchant, failed AS Failed_Transaction_Count,
  unu AS Unusual_Time_Transaction,
  CASE WHEN k % 45 = 4 THEN NULL ELSE pf END AS Previous_Fraud_Count,
  CASE WHEN (CASE intl WHEN 'Yes' THEN 2 ELSE 0 END) + (CASE newm WHEN 'Yes' THEN 2 ELSE 0 END)
          + (CASE unu WHEN 'Yes' THEN 2 ELSE 0 END) + (CASE WHEN pf > 0 THEN 3 ELSE 0 END)
          + (CASE WHEN failed >= 2 THEN 3 ELSE 0 END) + (k * 31) % 5 >= 8 THEN 'Fraud' ELSE 'Normal' END AS Fraud_Label
FROM h
"""

SC_SQL = """
SELECT Transaction_ID, CASE WHEN Fraud_Label = 'Fraud' THEN 1 ELSE 0 END AS label,
  CAST(((CASE Is_International_Transaction WHEN 'Yes' THEN 2 ELSE 0 END)
      + (CASE Is_New_Merchant WHEN 'Yes' THEN 2 ELSE 0 END)
      + (CASE Unusual_Time_Transaction WHEN 'Yes' THEN 2 ELSE 0 END)
      + (CASE WHEN coalesce(Previous_Fraud_Count, 0) > 0 THEN 3 ELSE 0 END)
      + (CASE WHEN Failed_Transaction_Count >= 2 THEN 3 ELSE 0 END)
      + (Transaction_ID * 17) % 7) * 50 + Transaction_ID % 50 AS DOUBLE) / 1e3 AS p
FROM tx
"""

PROFILE_CATEGORICALS = [
    "Transaction_Type", "Merchant_Category", "Transaction_Location",
    "Customer_Home_Location", "Card_Type", "Is_International_Transaction",
    "Is_New_Merchant", "Unusual_Time_Transaction",
]


def mode_sql(col: str, src: str = "tx") -> str:
    return (f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} LIMIT 1)")


MF_SQL = "SELECT * REPLACE (" + ", ".join(
    f"coalesce({c}, {mode_sql(c)}) AS {c}" for c in PROFILE_CATEGORICALS) + ") FROM tx"

CITY_SQL = """
SELECT n_name AS city, r_name AS country, CAST(-60 + 5 * n_nationkey AS DOUBLE) AS lat,
       CAST(-180 + 14 * n_nationkey AS DOUBLE) AS lon
FROM nation JOIN region ON n_regionkey = r_regionkey
"""


def with_ctes(body: str, *ctes: tuple[str, str]) -> str:
    """``WITH tx AS (...), <ctes> <body>``."""
    parts = [f"tx AS ({TX_SQL})"] + [f"{name} AS ({sql})" for name, sql in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body
