"""Time expressions. Instants are TIMESTAMP; the engine assumes the session zone is UTC.

Window arithmetic is done on whole epoch minutes (BIGINT): cheap to hash and independent of zones.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Taipei"


def pin_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def parse_iso(text: Column) -> Column:
    """ISO 8601 text to an instant; null when it is not a full date with a time."""
    full = text.rlike(r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    return F.when(full, text.try_cast("timestamp"))


def to_local(instant: Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall clock of ``zone`` for an instant."""
    return F.from_utc_timestamp(instant, zone)


def trunc_minute(instant: Column) -> Column:
    return F.date_trunc("minute", instant)


def iso_text(instant: Column, zone: str = LOCAL_ZONE, offset: str = "+08:00") -> Column:
    """ISO 8601 text in ``zone``; the fraction is written only when there is one."""
    local = to_local(instant, zone)
    micros = F.pmod(F.unix_micros(instant), F.lit(1_000_000))
    whole = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(micros == 0, F.lit("")).otherwise(F.date_format(local, ".SSSSSS"))
    return F.concat(whole, fraction, F.lit(offset))


def epoch_minute(instant: Column) -> Column:
    seconds = F.unix_seconds(instant)
    return ((seconds - F.pmod(seconds, F.lit(60))) / 60).cast("bigint")


def minute_instant(minute: Column) -> Column:
    return F.timestamp_seconds(minute * 60)


def as_instant(value: str | datetime) -> datetime:
    """A caller's time argument as an aware datetime; a time without offset is UTC."""
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def minute_of(value: str | datetime) -> int:
    return int(as_instant(value).timestamp() // 60)


def back_minutes(value: str | datetime, minutes: int) -> datetime:
    return as_instant(value) - timedelta(minutes=minutes)


def instant_literal(value: str | datetime) -> Column:
    moment = as_instant(value)
    whole = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(whole // timedelta(microseconds=1)))
