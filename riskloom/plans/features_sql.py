"""DuckDB oracle text for the 44 features over ``tx`` (CTE ``fe``)."""

from __future__ import annotations


def clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE least(greatest(({x}), {lo}::DOUBLE), {hi}::DOUBLE) END)"


def flag(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


AMT, AVG, MX, BAL = ("Transaction_Amount", "Avg_Transaction_Amount",
                     "Max_Transaction_Last_24h", "Account_Balance")
WK, DY, FAIL, PF, DIST = ("Weekly_Transaction_Count", "Daily_Transaction_Count",
                          "Failed_Transaction_Count", "Previous_Fraud_Count", "Distance_From_Home")

F1 = f"""SELECT tx.*,
  CAST(coalesce(hour(try_strptime(Transaction_Time, '%H:%M')), 12) AS INTEGER) AS Hour,
  CAST(isodow(Transaction_Date) - 1 AS INTEGER) AS DayOfWeek,
  CAST(month(Transaction_Date) AS INTEGER) AS Month,
  {flag("Is_International_Transaction = 'Yes'")} AS i_intl,
  {flag("Is_New_Merchant = 'Yes'")} AS i_new,
  {flag("Unusual_Time_Transaction = 'Yes'")} AS i_unu,
  (CASE WHEN Transaction_Location = Customer_Home_Location THEN 0 ELSE 1 END) AS Location_Mismatch,
  {AMT} / ({AVG} + 1e-9) AS Amount_vs_Avg,
  {AMT} / ({MX} + 1e-9) AS Amount_vs_Max24h,
  {BAL} / ({AMT} + 1e-9) AS Balance_vs_Amount,
  {clip(f"{AMT} / ({BAL} + 1e-9)", 0, 10)} AS Spend_Ratio,
  {clip(f"{DY} / ({WK} / 7 + 1e-9)", 0, 10)} AS Tx_Velocity_Ratio,
  {clip(f"({AMT} - {AVG}) / ({AVG} + 1)", -5, 20)} AS Amount_ZScore,
  {flag(f"{AMT} > {AVG} * 2")} AS Amount_Spike_Flag,
  {clip(f"{MX} / ({AVG} + 1e-9)", 0, 20)} AS Max24h_Utilization,
  {clip(f"{DY} - {WK} / 7", -5, 20)} AS Daily_vs_Expected,
  {clip(f"{FAIL} / ({DY} + 1)", 0, 1)} AS Failed_Rate,
  {clip(f"{AMT} * {DY} / ({AVG} + 1e-9)", 0, 200)} AS Spend_Velocity_Today,
  {flag(f"{DIST} >= 100 AND {DIST} < 500")} AS Dist_100_500,
  {flag(f"{DIST} >= 500 AND {DIST} < 2000")} AS Dist_500_2000,
  {flag(f"{DIST} >= 2000")} AS Dist_Over_2000,
  {flag(f"{BAL} < {AMT} * 1.5")} AS Balance_Very_Low,
  {flag(f"{BAL} < {AMT} * 5")} AS Balance_Low,
  {flag(f"{PF} > 0")} AS i_pf
FROM tx"""

F2 = f"""SELECT f1.*,
  {flag("DayOfWeek >= 5")} AS IsWeekend,
  {flag("Hour >= 22 OR Hour <= 5")} AS IsNight,
  sin(2 * pi() * Hour / 24) AS Hour_Sin,
  cos(2 * pi() * Hour / 24) AS Hour_Cos,
  (i_intl + i_new + i_unu + Location_Mismatch + {flag(f"{FAIL} > 0")} + i_pf) AS Risk_Flag_Count
FROM f1"""

FE = f"""SELECT f2.*,
  i_intl * i_new AS Intl_x_NewMerchant,
  i_intl * {clip(f"{DIST} / 1000", 0, 20)} AS Intl_x_Distance,
  i_intl * IsNight AS Intl_x_Night,
  i_new * Amount_Spike_Flag AS NewMerchant_x_HighAmt,
  i_pf * i_intl AS PrevFraud_x_Intl,
  i_pf * i_new AS PrevFraud_x_NewMerchant,
  {PF} * {clip("Amount_vs_Avg", 0, 20)} AS PrevFraud_x_AmtRatio,
  {FAIL} * i_intl AS Failed_x_Intl,
  Risk_Flag_Count * {clip("Amount_vs_Avg", 0, 20)} AS Risk_x_AmtRatio,
  {clip(f"{DIST} / 1000", 0, 20)} * IsNight AS Distance_x_Night
FROM f2"""

FEATURE_CTES = (("f1", F1), ("f2", F2), ("fe", FE))
