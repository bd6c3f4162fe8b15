"""Scalar expressions: money, time, labels. All built-in, all `Column -> Column`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoplake.model import PHONE_HEADS, PRICE_FLOOR

PRICE = "decimal(10,2)"
AMOUNT = "decimal(12,2)"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- money ------------------------------------------------------------------
def to_cents(x) -> Column:
    """Amount -> whole cents, half up."""
    return (F.round(_col(x).cast("decimal(20,6)"), 2) * 100).cast("bigint")


def cents_of(x) -> Column:
    """Whole cents of a two-place amount below 10^13, without decimal arithmetic."""
    return F.rint(_col(x).cast("double") * 100).cast("bigint")


def from_cents(x, kind: str = AMOUNT) -> Column:
    """Whole cents -> decimal with two places."""
    return (_col(x).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(kind)


def sum_cents(cents) -> Column:
    """Sum of long cents as decimal(22,2)."""
    total = F.sum(cents).cast("decimal(20,0)")
    return (total * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(22,2)")


def sum_money(x) -> Column:
    """Exact sum of two-place amounts: added up as long cents, shown as decimal(22,2).

    Long adds stay in fixed-width aggregation buffers; sums of wide decimals do not.
    A sum past the long range raises under ANSI mode and is never wrapped.
    """
    return sum_cents(cents_of(x))


def money(x) -> Column:
    """Half-up to two places, exact afterwards."""
    return F.round(_col(x).cast("decimal(20,6)"), 2).cast(AMOUNT)


def line_subtotal(quantity, unit_price) -> Column:
    return (_col(quantity).cast("decimal(10,0)") * _col(unit_price).cast(PRICE)).cast(AMOUNT)


def line_net(subtotal, discount) -> Column:
    return (_col(subtotal) - _col(discount)).cast(AMOUNT)


def margin(net, quantity, cost) -> Column:
    """Gross margin of a line: net amount less pieces at cost."""
    return (_col(net) - line_subtotal(quantity, cost)).cast("decimal(14,2)")


def price_floor(x) -> Column:
    return F.greatest(_col(x), F.lit(PRICE_FLOOR).cast(PRICE)).cast(PRICE)


def stock_floor(x) -> Column:
    return F.greatest(_col(x), F.lit(0))


def ratio(numerator, denominator) -> Column:
    """Ratio of two sums, NULL when the denominator is 0, six places."""
    bottom = F.nullif(_col(denominator).cast("double"), F.lit(0.0))
    return F.round(_col(numerator).cast("double") / bottom, 6)


# ---- time -------------------------------------------------------------------
def millis(ts) -> Column:
    return F.unix_millis(_col(ts).cast("timestamp"))


def from_millis(ms) -> Column:
    return F.timestamp_millis(_col(ms))


def format_ts(ms, tz: str = "+08:00") -> Column:
    """Epoch ms -> `yyyy-MM-dd HH:mm:ss.SSS` at a zone (session zone UTC)."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(_col(ms)), tz),
                         "yyyy-MM-dd HH:mm:ss.SSS")


def parse_ts(text) -> Column:
    """ISO text with offset, or plain wall time in the session zone, -> epoch ms."""
    return F.unix_millis(F.to_timestamp(_col(text)))


def day_index(ts, epoch_ms: int) -> Column:
    """Whole days since an epoch, negative before it."""
    return F.floor((millis(ts) - F.lit(epoch_ms)) / F.lit(86_400_000)).cast("bigint")


def local_day(ts, tz: str) -> Column:
    """Midnight of the local day of a UTC instant."""
    return F.date_trunc("day", F.from_utc_timestamp(_col(ts), tz))


def seconds_between(start, end) -> Column:
    return F.timestamp_diff("SECOND", _col(start).cast("timestamp"), _col(end).cast("timestamp"))


def latency_ms(sink, create_time_ms) -> Column:
    return millis(sink) - _col(create_time_ms)


def latest_milestone(*columns) -> Column:
    """Latest of the milestones that happened (NULLs are skipped)."""
    return F.greatest(*[_col(c) for c in columns])


def date_parts(day) -> dict[str, Column]:
    d = _col(day)
    weekday = F.weekday(d) + 1
    return {
        "year": F.year(d), "quarter": F.quarter(d), "month": F.month(d),
        "iso_week": F.weekofyear(d), "day_of_week": weekday,
        "is_weekend": F.when(weekday >= 6, 1).otherwise(0),
    }


# ---- classes and labels -----------------------------------------------------
def price_band(price) -> Column:
    p = _col(price)
    return (F.when(p < 100, "0-100").when(p < 1000, "100-1000")
            .when(p < 5000, "1000-5000").otherwise("5000+"))


def age_days(end, ts) -> Column:
    return (millis(end) - millis(ts)).cast("double") / F.lit(86_400_000.0)


def age_class(days) -> Column:
    d = _col(days)
    return (F.when(d > 14, ">14").when(d > 7, ">7").when(d > 3, ">3")
            .when(d > 1, ">1").otherwise("today"))


def is_valid_phone(phone) -> Column:
    """Eleven digits with a known head."""
    pattern = "^(" + "|".join(PHONE_HEADS) + ")[0-9]{9}$"
    return F.coalesce(_col(phone).rlike(pattern), F.lit(False))


def label(prefix: str, number, width: int) -> Column:
    """Prefix plus a zero-padded number; longer numbers are not cut."""
    digits = _col(number).cast("string")
    padded = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    return F.concat(F.lit(prefix), padded)


def if_null(x, default) -> Column:
    return F.coalesce(_col(x), F.lit(default))
