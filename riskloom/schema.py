"""Declared schemas and fixed values of the fraud-analytics data model.

Everything under "FIXED VALUES" must equal the published behaviour for results
to agree (feature names and order, category domains, rule constants, city
table); it is kept together, in natural order, as plain text.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ─────────────────────────────────────────────────────────────────────────────
# FIXED VALUES — input contract, feature order, domains, city dimension.
# ─────────────────────────────────────────────────────────────────────────────

TARGET = "Fraud_Label"
FRAUD_VALUE = "Fraud"
UNKNOWN = "Unknown"

BASE_NUMERIC = [
    "Transaction_Amount", "Distance_From_Home",
    "Account_Balance", "Daily_Transaction_Count",
    "Weekly_Transaction_Count", "Avg_Transaction_Amount",
    "Max_Transaction_Last_24h", "Failed_Transaction_Count",
    "Previous_Fraud_Count", "Hour", "DayOfWeek", "Month",
    "IsWeekend", "IsNight", "Amount_vs_Avg", "Amount_vs_Max24h",
    "Balance_vs_Amount", "Spend_Ratio", "Location_Mismatch",
    "Tx_Velocity_Ratio", "Risk_Flag_Count",
]

NEW_NUMERIC = [
    "Hour_Sin", "Hour_Cos",
    "Amount_ZScore", "Amount_Spike_Flag", "Max24h_Utilization",
    "Daily_vs_Expected", "Failed_Rate", "Spend_Velocity_Today",
    "Dist_100_500", "Dist_500_2000", "Dist_Over_2000",
    "Balance_Very_Low", "Balance_Low",
    "Intl_x_NewMerchant", "Intl_x_Distance", "Intl_x_Night",
    "NewMerchant_x_HighAmt", "PrevFraud_x_Intl", "PrevFraud_x_NewMerchant",
    "PrevFraud_x_AmtRatio", "Failed_x_Intl", "Risk_x_AmtRatio",
    "Distance_x_Night",
]

NUMERIC_FEATURES = BASE_NUMERIC + NEW_NUMERIC

CATEGORICAL_FEATURES = [
    "Transaction_Type", "Merchant_Category", "Card_Type",
    "Is_International_Transaction", "Is_New_Merchant",
    "Unusual_Time_Transaction",
]

# Model input order: 44 numerics, then the 6 category codes.
MODEL_INPUTS = NUMERIC_FEATURES + CATEGORICAL_FEATURES

# Categorical columns that profiling fills with their mode when they have gaps.
PROFILE_CATEGORICALS = [
    "Transaction_Type", "Merchant_Category", "Transaction_Location",
    "Customer_Home_Location", "Card_Type", "Is_International_Transaction",
    "Is_New_Merchant", "Unusual_Time_Transaction",
]

# Numeric columns of the correlation matrix, in display order.
CORRELATION_COLUMNS = [
    "Transaction_Amount", "Distance_From_Home",
    "Account_Balance", "Daily_Transaction_Count",
    "Weekly_Transaction_Count", "Failed_Transaction_Count",
    "Previous_Fraud_Count",
]

VALID_TX_TYPES = ["Online", "ATM", "POS", "Wire Transfer"]
VALID_MERCHANT_CATS = [
    "Airlines", "ATM", "Clothing", "Electronics", "Entertainment", "Fuel",
    "Grocery", "Healthcare", "Hotel", "Jewelry", "Online Shopping",
    "Pharmacy", "Restaurant", "Travel", "Utilities", "Wire Transfer",
]
VALID_CARD_TYPES = ["Debit", "Credit", "Prepaid"]
YES_NO = ["Yes", "No"]

# City dimension: (city, country code, latitude, longitude), 59 rows.
CITIES = [
    ("Amsterdam", "NL", 52.3676, 4.9041),
    ("Atlanta", "US", 33.7490, -84.3880),
    ("Austin", "US", 30.2672, -97.7431),
    ("Bangkok", "TH", 13.7563, 100.5018),
    ("Berlin", "DE", 52.5200, 13.4050),
    ("Boston", "US", 42.3601, -71.0589),
    ("Brussels", "BE", 50.8503, 4.3517),
    ("Buenos Aires", "AR", -34.6037, -58.3816),
    ("Cairo", "EG", 30.0444, 31.2357),
    ("Calgary", "CA", 51.0447, -114.0719),
    ("Charlotte", "US", 35.2271, -80.8431),
    ("Chicago", "US", 41.8781, -87.6298),
    ("Columbus", "US", 39.9612, -82.9988),
    ("Copenhagen", "DK", 55.6761, 12.5683),
    ("Dallas", "US", 32.7767, -96.7970),
    ("Denver", "US", 39.7392, -104.9903),
    ("Detroit", "US", 42.3314, -83.0458),
    ("Dubai", "AE", 25.2048, 55.2708),
    ("Dublin", "IE", 53.3498, -6.2603),
    ("Helsinki", "FI", 60.1695, 24.9354),
    ("Hong Kong", "HK", 22.3193, 114.1694),
    ("Houston", "US", 29.7604, -95.3698),
    ("Indianapolis", "US", 39.7684, -86.1581),
    ("Istanbul", "TR", 41.0082, 28.9784),
    ("Lagos", "NG", 6.5244, 3.3792),
    ("Las Vegas", "US", 36.1699, -115.1398),
    ("Lisbon", "PT", 38.7223, -9.1393),
    ("London", "GB", 51.5074, -0.1278),
    ("Los Angeles", "US", 34.0522, -118.2437),
    ("Louisville", "US", 38.2527, -85.7585),
    ("Madrid", "ES", 40.4168, -3.7038),
    ("Memphis", "US", 35.1495, -90.0490),
    ("Mexico City", "MX", 19.4326, -99.1332),
    ("Miami", "US", 25.7617, -80.1918),
    ("Montreal", "CA", 45.5017, -73.5673),
    ("Mumbai", "IN", 19.0760, 72.8777),
    ("Nashville", "US", 36.1627, -86.7816),
    ("New York", "US", 40.7128, -74.0060),
    ("Oslo", "NO", 59.9139, 10.7522),
    ("Paris", "FR", 48.8566, 2.3522),
    ("Philadelphia", "US", 39.9526, -75.1652),
    ("Phoenix", "US", 33.4484, -112.0742),
    ("Portland", "US", 45.5051, -122.6750),
    ("Rome", "IT", 41.9028, 12.4964),
    ("San Antonio", "US", 29.4241, -98.4936),
    ("San Diego", "US", 32.7157, -117.1611),
    ("San Francisco", "US", 37.7749, -122.4194),
    ("Seattle", "US", 47.6062, -122.3321),
    ("Seoul", "KR", 37.5665, 126.9780),
    ("Singapore", "SG", 1.3521, 103.8198),
    ("Stockholm", "SE", 59.3293, 18.0686),
    ("Sydney", "AU", -33.8688, 151.2093),
    ("São Paulo", "BR", -23.5505, -46.6333),
    ("Tokyo", "JP", 35.6762, 139.6503),
    ("Toronto", "CA", 43.6532, -79.3832),
    ("Vancouver", "CA", 49.2827, -123.1207),
    ("Vienna", "AT", 48.2082, 16.3738),
    ("Washington DC", "US", 38.9072, -77.0369),
    ("Zurich", "CH", 47.3769, 8.5472),
]

EARTH_RADIUS_KM = 6371.0

# Threshold grid 0.05 .. 0.95 step 0.05 (19 values), scored as p >= t.
THRESHOLD_GRID = [round(0.05 * k, 2) for k in range(1, 20)]
THRESHOLD_FLOOR = 0.05
COST_FN_WEIGHT = 5.0     # cost-optimal threshold: 5 * fn + 0.1 * fp
COST_FP_WEIGHT = 0.1

# Business-impact defaults of the dashboard.
IMPACT_COST_FN_FALLBACK = 5.0     # when no mean fraud amount is available
IMPACT_COST_FP = 15.0
IMPACT_MONTHLY_VOLUME = 50000.0

# Amount histogram: 0..100000 clipped, 22 edges = 21 bins.
HIST_MAX = 100000.0
HIST_BINS = 21

CURVE_POINTS = 200
CALIBRATION_BINS = 10

# Score composition.
ML_COMPONENT_MAX = 60.0
RULE_COMPONENT_MAX = 40.0
TIER_HIGH_SCORE = 70.0
TIER_MEDIUM_SCORE = 35.0

# ─────────────────────────────────────────────────────────────────────────────
# Declared schemas.
# ─────────────────────────────────────────────────────────────────────────────

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("Transaction_ID", T.LongType(), False),
    T.StructField("Customer_ID", T.LongType(), True),
    T.StructField("Transaction_Amount", T.DoubleType(), True),
    T.StructField("Transaction_Time", T.StringType(), True),
    T.StructField("Transaction_Date", T.DateType(), True),
    T.StructField("Transaction_Type", T.StringType(), True),
    T.StructField("Merchant_Category", T.StringType(), True),
    T.StructField("Transaction_Location", T.StringType(), True),
    T.StructField("Customer_Home_Location", T.StringType(), True),
    T.StructField("Distance_From_Home", T.DoubleType(), True),
    T.StructField("Card_Type", T.StringType(), True),
    T.StructField("Account_Balance", T.DoubleType(), True),
    T.StructField("Daily_Transaction_Count", T.LongType(), True),
    T.StructField("Weekly_Transaction_Count", T.LongType(), True),
    T.StructField("Avg_Transaction_Amount", T.DoubleType(), True),
    T.StructField("Max_Transaction_Last_24h", T.DoubleType(), True),
    T.StructField("Is_International_Transaction", T.StringType(), True),
    T.StructField("Is_New_Merchant", T.StringType(), True),
    T.StructField("Failed_Transaction_Count", T.LongType(), True),
    T.StructField("Unusual_Time_Transaction", T.StringType(), True),
    T.StructField("Previous_Fraud_Count", T.LongType(), True),
    T.StructField("Fraud_Label", T.StringType(), True),
])

# Scoring request (JSON), 18 typed fields plus the engine's id and as-of date.
REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("balance", T.DoubleType(), True),
    T.StructField("distance", T.DoubleType(), True),
    T.StructField("tx_time", T.StringType(), True),
    T.StructField("tx_type", T.StringType(), True),
    T.StructField("merchant_cat", T.StringType(), True),
    T.StructField("card_type", T.StringType(), True),
    T.StructField("tx_location", T.StringType(), True),
    T.StructField("home_loc", T.StringType(), True),
    T.StructField("daily_tx", T.LongType(), True),
    T.StructField("weekly_tx", T.LongType(), True),
    T.StructField("avg_amount", T.DoubleType(), True),
    T.StructField("max_24h", T.DoubleType(), True),
    T.StructField("failed", T.LongType(), True),
    T.StructField("prev_fraud", T.LongType(), True),
    T.StructField("is_intl", T.StringType(), True),
    T.StructField("is_new", T.StringType(), True),
    T.StructField("unusual", T.StringType(), True),
    T.StructField("as_of", T.DateType(), True),
])

PREDICTION_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("Transaction_ID", T.LongType(), False),
    T.StructField("label", T.IntegerType(), False),
    T.StructField("p", T.DoubleType(), True),
])
