"""Hand-written nested events for the value tests."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from webtally.sources import schemas

DAY = ("2024-01-01", "2024-12-31")


def at(text: str) -> int:
    """Microseconds of a UTC time such as ``2024-01-05 10:00:00``."""
    moment = datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc)
    return int(moment.timestamp()) * 1_000_000 + moment.microsecond


def _slot(value) -> dict:
    slots = value if isinstance(value, dict) else (
        {"string_value": value} if isinstance(value, str) else
        {"double_value": value} if isinstance(value, float) else {"int_value": value}
    )
    return {k: slots.get(k) for k in ("string_value", "int_value", "float_value", "double_value")}


def event(user, time, name: str, session=1, params: dict | None = None, **columns) -> dict:
    micros = at(time) if isinstance(time, str) else time
    given = {"ga_session_id": session, **(params or {})}
    day = (datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=micros)).strftime("%Y%m%d")
    row = {
        "event_date": day, "event_timestamp": micros, "event_name": name, "user_pseudo_id": user,
        "event_params": [{"key": k, "value": _slot(v)} for k, v in given.items() if v is not None],
        "user_properties": [], "items": [],
    }
    row.update(columns)
    return row


def view(user, time, page, session=1, **columns) -> dict:
    return event(user, time, "page_view", session, {"page_location": page, **columns.pop("params", {})}, **columns)


def events(spark: SparkSession, rows: list[dict]) -> DataFrame:
    numbered = [{"event_bundle_sequence_id": n, **row} for n, row in enumerate(rows)]
    complete = [{name: row.get(name) for name in schemas.EVENT_FIELDS} for row in numbered]
    return spark.createDataFrame(complete, schemas.ddl(schemas.EVENT_FIELDS))


def rows(df: DataFrame) -> list[tuple]:
    return [tuple(row) for row in df.collect()]
