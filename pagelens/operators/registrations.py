"""Webhook registrations: the last valid one of each owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.endpoints import owner_key
from pagelens.functions.text import strip_ws
from pagelens.functions.urls import is_http_url

# Fixed values.
DEFAULT_EVENTS = ("bulk.completed", "bulk.failed")
INVALID_URL = "Invalid webhook URL. Provide a valid http(s) URL."


def _checked(registrations: DataFrame) -> DataFrame:
    events = F.filter(F.transform("events", lambda e: strip_ws(F.coalesce(e, F.lit("")))), lambda e: e != "")
    default = F.array(*[F.lit(e) for e in DEFAULT_EVENTS])
    return registrations.select(
        "seq",
        owner_key("api_key_id", "api_key", "account_id").alias("owner"),
        strip_ws("url").alias("url"),
        F.when(F.coalesce(F.size("events"), F.lit(0)) > 0, events).otherwise(default).alias("events"),
        "updated_at",
    )


def rejected_registrations(registrations: DataFrame) -> DataFrame:
    return _checked(registrations).filter(~is_http_url("url")).select(
        "seq", "owner", F.lit(400).alias("status"), F.lit(INVALID_URL).alias("error")
    )


def latest_per_owner(registrations: DataFrame) -> DataFrame:
    """Last write per owner; ``seq`` orders writes of the same instant.

    ``registrations(seq, api_key_id, api_key, account_id, url, events, updated_at)``;
    the secret is never read.
    """
    last = F.max_by(F.struct("url", "events", "updated_at"), F.struct("updated_at", "seq"))
    return (
        _checked(registrations)
        .filter(is_http_url("url"))
        .groupBy("owner")
        .agg(last.alias("last"))
        .select("owner", "last.*")
    )
