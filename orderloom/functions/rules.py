"""Business rules as Column expressions: every function takes and returns Columns, so that Catalyst sees through them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule that holds."""
    out = None
    for holds, value in rules:
        out = (F if out is None else out).when(holds, value)
    return out.otherwise(otherwise)


def band(value: Column | str, steps: Sequence[tuple[float, object]], otherwise: object, at_most: bool = False) -> Column:
    """A label by thresholds: the first step with value >= threshold, or <= with ``at_most``. Null gets ``otherwise``."""
    v = col(value)
    return first_match([(v <= t if at_most else v >= t, label) for t, label in steps], otherwise)


def safe_divide(a: Column | str, b: Column | str, default: float = 0.0) -> Column:
    """a / b as double; the default where b is 0 or either is null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(default))


def money(c: Column | str) -> Column:
    return col(c).cast("double")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole days of a timestamp difference, towards zero."""
    return F.extract(F.lit("DAY"), col(later) - col(earlier)).cast("long")


def standardize_currency(c: Column | str) -> Column:
    return F.upper(F.trim(col(c)))


def clean_email(c: Column | str) -> Column:
    return F.lower(F.trim(col(c)))


def clean_phone(c: Column | str, keep_plus: bool = False) -> Column:
    return F.regexp_replace(col(c), "[^0-9+]" if keep_plus else "[^0-9]", "")


def is_valid_email(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike("(?i)" + EMAIL), F.lit(False))


def title_case(c: Column | str) -> Column:
    """Upper case after every character that is no letter or digit."""
    parts = F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def full_name(first: Column | str, last: Column | str) -> Column:
    blank = F.lit("")
    return F.concat(F.coalesce(title_case(F.trim(col(first))), blank), F.lit(" "), F.coalesce(title_case(F.trim(col(last))), blank))


def order_value_tier(amount: Column | str, high: float = 1000, medium: float = 100) -> Column:
    return band(amount, [(high, "high_value"), (medium, "medium_value")], "low_value")


# fixed values
STATUS_GROUPS = {"active": ("pending", "processing"), "fulfilled": ("shipped", "delivered"), "cancelled": ("cancelled", "refunded")}
SHIPMENT_GROUPS = {"preparing": ("pending", "processing"), "in_transit": ("shipped", "in_transit"), "delivered": ("delivered",), "exception": ("returned", "lost", "damaged")}


def grouped(value: Column | str, groups: dict[str, tuple[str, ...]], otherwise: str = "unknown") -> Column:
    return first_match([(col(value).isin(*members), name) for name, members in groups.items()], otherwise)


# fixed values
LTV_FACTORS = {"vip": 2.5, "champion": 2.0, "loyal_customer": 1.8, "potential_loyalist": 1.5}


def predicted_ltv(value: Column | str, segment: Column | str, otherwise: float = 1.1) -> Column:
    factor = first_match([(col(segment) == s, f) for s, f in LTV_FACTORS.items()], otherwise)
    return F.round(money(value) * factor, 4)


def rfm_score(recency: Column | str, frequency: Column | str, monetary: Column | str, r: Sequence[float] = (30, 90, 365, 730), f: Sequence[float] = (10, 5, 2, 1), m: Sequence[float] = (1000, 500, 100, 1)) -> Column:
    """Three digits 5..1. ``r`` are upper limits (recent is good), ``f`` and ``m`` lower limits, best first."""
    digits = ["5", "4", "3", "2"]
    return F.concat(
        band(recency, list(zip(r, digits)), "1", at_most=True),
        band(frequency, list(zip(f, digits)), "1"),
        band(monetary, list(zip(m, digits)), "1"),
    )


def delivery_performance(actual: Column | str, promised: Column | str, slight_days: int = 1) -> Column:
    a, p = col(actual), col(promised)
    return first_match([(a.isNull(), "not_delivered"), (a <= p, "on_time"), (a <= F.date_add(p, slight_days), "slightly_late")], "significantly_late")


def surrogate_key(*columns: Column | str, null: str = "_null_") -> Column:
    return F.md5(F.concat_ws("-", *(F.coalesce(col(c).cast("string"), F.lit(null)) for c in columns)))


def record_hash(*columns: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(col(c).cast("string"), F.lit("")) for c in columns)), 256)


# fixed values
AGE_STEPS = [(65, "65+"), (55, "55-64"), (45, "45-54"), (35, "35-44"), (25, "25-34"), (18, "18-24")]


def age_group(born: Column | str, as_of: Column) -> Column:
    b = col(born)
    # whole years: the birthday of this year may still lie ahead
    years = F.year(as_of) - F.year(b) - (F.date_format(as_of, "MMdd") < F.date_format(b, "MMdd")).cast("int")
    return F.when(b.isNull(), "Unknown").otherwise(band(years, AGE_STEPS, "Under 18"))


def customer_tier(clv: Column | str) -> Column:
    v = col(clv)
    return F.when(v.isNull() | (v == 0), "New").otherwise(band(v, [(10000, "Platinum"), (5000, "Gold"), (1000, "Silver")], "Bronze"))


# fixed values: countries of each region
REGIONS = {
    "North America": ("US", "CA", "MX"),
    "Europe": ("GB", "DE", "FR", "IT", "ES", "NL", "BE", "AT", "CH", "SE", "NO", "DK", "FI"),
    "Asia Pacific": ("JP", "KR", "CN", "IN", "SG", "TH", "MY", "ID", "PH", "VN"),
    "Oceania": ("AU", "NZ"),
    "South America": ("BR", "AR", "CL", "CO", "PE", "VE"),
    "Africa": ("ZA", "NG", "EG", "KE", "MA"),
}


def region_from_country(country: Column | str) -> Column:
    return grouped(F.upper(F.trim(col(country))), REGIONS, "Other")


def quality_score(total: Column | str, nulls: Column | str, invalid: Column | str, duplicates: Column | str) -> Column:
    t = col(total)
    lost = 0.3 * col(nulls) + 0.5 * col(invalid) + 0.2 * col(duplicates)
    return F.when(t == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - lost / t)), 2))


def product_margin(price: Column | str, cost: Column | str) -> Column:
    p = money(price)
    return F.when(p > 0, F.round((p - money(cost)) / p * 100, 4))


def pivot_counts(df: DataFrame, key: str, values: Column | str, names: Sequence[str]) -> DataFrame:
    """One count column for each value, 0 where there is none."""
    return df.groupBy(key).agg(*(F.count_if(col(values) == n).alias(f"{n}_count") for n in names))


def parse_datetime(c: Column | str, formats: Sequence[str]) -> Column:
    """The first of the formats that fits, else null."""
    return F.coalesce(*(F.try_to_timestamp(col(c), F.lit(f)) for f in formats))


def calendar_parts(c: Column | str) -> dict[str, Column]:
    d = col(c)
    return {"order_year": F.year(d).cast("long"), "order_quarter": F.quarter(d).cast("long"), "order_month": F.month(d).cast("long"), "order_week": F.weekofyear(d).cast("long"), "order_day_of_week": (F.dayofweek(d) - 1).cast("long")}
