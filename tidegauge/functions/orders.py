"""The orders in which tables are read. A table is put in order where it is shown, by a sort
that Spark spreads over tasks; the operators leave their rows as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns by table, + up and - down. Who works across boards comes first among people.
ORDERS = {
    "estate_people": ["-active_boards", "-boards", "-open_in_active", "-open_assigned", "-authored", "+person"],
    "awaiting_review": ["-open_hours", "+team", "+mr"],
    "mix": ["+team", "-issues", "+name"],
    "groups": ["-boards", "+prefix"],
}


def ordered(df: DataFrame, table: str) -> DataFrame:
    return df.orderBy(*(F.desc(c[1:]) if c[0] == "-" else F.asc_nulls_last(c[1:]) for c in ORDERS[table]))
