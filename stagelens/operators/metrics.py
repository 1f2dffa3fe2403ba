"""Event-level metrics from signed transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagelens.functions.conditions import count_true


def signed(value: str, kind: str = "event_type", plus: str = "booking") -> Column:
    """Value with the sign of its transaction: bookings add, cancellations subtract."""
    return F.when(F.col(kind) == plus, F.col(value)).otherwise(-F.col(value))


def session_sales(ticket: DataFrame, event: str = "performance_id", session: str = "show_at") -> DataFrame:
    """Net seats and revenue per session."""
    return ticket.groupBy(event, session).agg(
        F.sum(signed("quantity")).alias("sold"), F.sum(signed("amount")).alias("revenue")
    )


def event_sales(ticket: DataFrame, event: str = "performance_id", session: str = "show_at") -> DataFrame:
    """Sessions rolled up to events: number of sessions, net seats, net revenue."""
    return session_sales(ticket, event, session).groupBy(event).agg(
        F.count("*").alias("sessions"),
        F.sum("sold").alias("sold"),
        F.sum("revenue").cast("double").alias("revenue"),
    )


def ratios(df: DataFrame) -> DataFrame:
    """Occupancy, mean seats, price and revenue per session; NULL where undefined."""
    sold, sessions = F.col("sold").cast("double"), F.col("sessions")
    return df.withColumns(
        {
            "occupancy": F.try_divide(sold, (sessions * F.col("seats")).cast("double")),
            "avg_sold": sold / sessions,
            "price": F.try_divide(F.col("revenue"), sold),
            "rev_per_session": F.col("revenue") / sessions,
        }
    )


def event_metrics(ticket: DataFrame, performance: DataFrame, event: str = "performance_id") -> DataFrame:
    """One row per event with transactions: dimensions, sales and ratios.

    Transactions are reduced to one row per event before they meet a dimension.
    """
    return ratios(performance.join(event_sales(ticket, event), event))


def access_score(*flags: Column | str) -> Column:
    """Number of accessibility features; one unknown flag makes it unknown."""
    return count_true(*flags)
