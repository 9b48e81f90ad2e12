"""Request validation (V1-V9): accepted / quarantined split.

Every rule is a Column predicate; failures collect into one
``errors array<struct<field, message>>`` column (per-row, no shuffle apart
from the broadcast city lookups). A record with any error is quarantined with
all its messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.geo import expected_international, with_geo
from riskloom.schema import VALID_CARD_TYPES, VALID_MERCHANT_CATS, VALID_TX_TYPES, YES_NO

# FIXED VALUES — validation messages.
MSG_REQUIRED = "Field required"
MSG_NUMBER = "Input should be a valid number"
MSG_TIME = "tx_time must be HH:MM format, e.g. '14:30'"
MSG_LOCATION = "Location must be one of the supported city values"
MSG_YES_NO = "Must be 'Yes' or 'No'"
MSG_NON_NEGATIVE = "Must be >= 0"
MSG_COUNTS = "Transaction counts must be >= 1"
MSG_INTL_FORMAT = "is_intl must match selected locations (expected '%s')"

TRIMMED = ["tx_type", "merchant_cat", "card_type", "tx_location", "home_loc",
           "is_intl", "is_new", "unusual"]


def _err(field: str, cond: Column, message: Column | str) -> Column:
    msg = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(cond, F.lit(False)),
                  F.struct(F.lit(field).alias("field"), msg.alias("message")))


def _domain_msg(field: str, domain: list[str]) -> str:
    return f"{field} must be one of: {sorted(domain)}"


def strip(c: str) -> Column:
    """All leading and trailing white space removed, line breaks and tabs included."""
    return F.regexp_replace(F.col(c), "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "").alias(c)


def validate(req: DataFrame, cities: DataFrame, tx_types: list[str] = VALID_TX_TYPES,
             merchant_cats: list[str] = VALID_MERCHANT_CATS,
             card_types: list[str] = VALID_CARD_TYPES) -> DataFrame:
    """Trim the text fields and append ``errors`` and ``valid``.

    A field listed in ``bad_fields`` (set by the JSON source) holds something that is
    no number; it gets that message in place of "required".
    """
    trimmed = req.select(*[strip(c) if c in TRIMMED else F.col(c) for c in req.columns])
    g = with_geo(trimmed, cities, "home_loc", "tx_location")
    c = F.col
    missing = lambda f: c(f).isNull()
    checks = [
        _err("tx_time", missing("tx_time"), MSG_REQUIRED),
        _err("tx_time", c("tx_time").isNotNull()
             & F.try_to_timestamp(c("tx_time"), F.lit("H:m")).isNull(), MSG_TIME),
    ]
    for f, dom in (("tx_type", tx_types), ("merchant_cat", merchant_cats),
                   ("card_type", card_types)):
        checks += [_err(f, missing(f), MSG_REQUIRED),
                   _err(f, c(f).isNotNull() & ~c(f).isin(*dom), _domain_msg(f, dom))]
    for f, country in (("tx_location", "tx_country"), ("home_loc", "home_country")):
        checks += [_err(f, missing(f), MSG_REQUIRED),
                   _err(f, c(f).isNotNull() & c(country).isNull(), MSG_LOCATION)]
    for f in ("is_new", "unusual", "is_intl"):
        checks += [_err(f, missing(f), MSG_REQUIRED),
                   _err(f, c(f).isNotNull() & ~c(f).isin(*YES_NO), MSG_YES_NO)]
    expected = expected_international(c("home_country"), c("tx_country"))
    checks.append(_err("is_intl", c("is_intl").isin(*YES_NO) & expected.isNotNull()
                       & (c("is_intl") != expected), F.format_string(MSG_INTL_FORMAT, expected)))
    for fields, least, message in ((("amount", "balance", "avg_amount", "max_24h", "distance"), 0, MSG_NON_NEGATIVE),
                                   (("daily_tx", "weekly_tx"), 1, MSG_COUNTS),
                                   (("failed", "prev_fraud"), 0, MSG_NON_NEGATIVE)):
        for f in fields:
            bad = F.array_contains("bad_fields", f) if "bad_fields" in req.columns else F.lit(False)
            checks += [_err(f, missing(f), F.when(bad, MSG_NUMBER).otherwise(MSG_REQUIRED)),
                       _err(f, c(f) < least, message)]
    errors = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return g.select(*trimmed.columns, "home_country", "tx_country", errors.alias("errors"),
                    (F.size(errors) == 0).alias("valid"))


def error_rows(validated: DataFrame, key: str = "Transaction_ID") -> DataFrame:
    """(key, field, message): one row per failed rule."""
    return (validated.select(key, F.explode("errors").alias("e"))
            .select(key, "e.field", "e.message"))
