"""Rule engine boundaries against a plain-Python statement of the published rules."""
import itertools

from riskloom.operators import rules as RU

RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}


def spec(r, p, t):
    """Plain-Python statement of the scoring rules for one request."""
    mt = round(t * 0.5, 4)
    ml = "HIGH" if p >= t else "MEDIUM" if p >= mt else "LOW"
    tier = ml
    crit = sum([r["prev_fraud"] > 0, r["failed"] >= 2, r["is_intl"] == "Yes", r["is_new"] == "Yes",
                r["distance"] > 2000, r["unusual"] == "Yes"])
    rule = None
    if r["prev_fraud"] > 0 and r["failed"] >= 2 and r["is_intl"] == "Yes":
        rule, tier = RU.RULE_01_TEXT, "HIGH"
    elif r["distance"] > 5000 and r["is_intl"] == "Yes" and r["is_new"] == "Yes":
        rule, tier = f"RULE_02: extreme displacement ({int(r['distance']):,} km) + international + new merchant", "HIGH"
    elif crit >= 5:
        rule, tier = f"RULE_03: {crit}/6 critical risk signals simultaneously active", "HIGH"
    elif crit >= 4 and ml == "LOW":
        rule = f"RULE_04: {crit}/6 critical risk signals — elevated for review"
        tier = max(tier, "MEDIUM", key=RANK.get)
    pts = 0.0
    pts += 12 if r["prev_fraud"] > 0 else 0
    pts += 8 if r["failed"] >= 2 else 0
    pts += 5 if r["is_intl"] == "Yes" else 0
    pts += 5 if r["is_new"] == "Yes" else 0
    pts += 5 if r["distance"] > 2000 else 2 if r["distance"] > 500 else 0
    pts += 3 if r["unusual"] == "Yes" else 0
    pts += 2 if r["tx_location"] != r["home_loc"] else 0
    pts += 5 if r["is_intl"] == "Yes" and r["is_new"] == "Yes" else 0
    pts += 5 if r["prev_fraud"] > 0 and r["is_intl"] == "Yes" else 0
    pts += 5 if r["prev_fraud"] > 0 and r["failed"] >= 2 else 0
    score = round(min(60.0, (p / max(t, 1e-9)) * 60.0) + min(40.0, pts), 1)
    st = "HIGH" if score >= 70 else "MEDIUM" if score >= 35 else "LOW"
    final = max(st, tier, key=RANK.get)
    return ml, rule, tier, score, final, f"{score:.1f}%", f"{p:.1%}"


def test_boundaries_match_spec(spark):
    t = 0.35
    base = dict(amount=100.0, balance=1000.0, tx_time="12:00", tx_type="POS", merchant_cat="Fuel",
                card_type="Debit", tx_location="Paris", home_loc="Paris", daily_tx=1, weekly_tx=7,
                avg_amount=100.0, max_24h=100.0)
    rows = []
    grid = itertools.product([0, 1], [0, 1, 2], ["Yes", "No"], ["Yes", "No"],
                             [400.0, 500.0, 501.0, 2000.0, 2001.0, 5000.0, 5001.0], ["Yes", "No"],
                             [0.0, 0.175, 0.1749, 0.35, 0.3499, 0.9, 0.2443])
    for i, (pf, fl, intl, new, dist, unu, p) in enumerate(grid):
        r = dict(base, prev_fraud=pf, failed=fl, is_intl=intl, is_new=new, distance=dist, unusual=unu,
                 tx_location="Paris" if i % 2 else "Rome")
        rows.append((i, p, r))
    cols = ["i", "p"] + list(rows[0][2])
    df = spark.createDataFrame([(i, p, *r.values()) for i, p, r in rows], cols)
    out = {x.i: x for x in RU.score(df, t).collect()}
    for i, p, r in rows:
        ml, rule, tier, score, final, pct, ppct = spec(r, p, t)
        o = out[i]
        assert (o.ml_tier, o.rule_id, o.rule_tier, o.risk_score, o.tier) == (ml, rule, tier, score, final), (r, p)
        assert (o.risk_score_pct, o.ml_probability_pct) == (pct, ppct)
        assert RANK[o.tier] >= RANK[o.rule_tier]        # rules never lower the tier


def test_points_cap_and_flags(spark):
    r = dict(amount=5000.0, balance=10.0, distance=5570.9, tx_time="03:00", tx_type="Online",
             merchant_cat="Jewelry", card_type="Prepaid", tx_location="Tokyo", home_loc="Boston",
             daily_tx=5, weekly_tx=7, avg_amount=2000.0, max_24h=3000.0, failed=3, prev_fraud=2,
             is_intl="Yes", is_new="Yes", unusual="Yes")
    df = spark.createDataFrame([tuple(r.values()) + (0.9,)], list(r) + ["p"])
    o = RU.score(df, 0.4).select("*", RU.flags().alias("fl")).first()
    assert o.rule_points > 40 and o.rule_component == 40.0
    texts = [f.text for f in o.fl]
    assert texts == ["International transaction", "New merchant — no prior history",
                     "Unusual transaction time", "Location mismatch: Tokyo vs home Boston",
                     "5,570 km from home", "3 failed transaction(s) in session",
                     "Prior fraud history: 2 incident(s)", "Amount spike: $5,000 vs avg $2,000 (2.5×)"]
    assert o.rule_id == RU.RULE_01_TEXT
