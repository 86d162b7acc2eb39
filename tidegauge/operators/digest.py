"""A compact digest of each team: one bounded document, put together in the cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Characters that a team's digest may have.
BUDGET = 20_000


def first(rows: DataFrame, n: int, order: list, **fields: Column | str) -> DataFrame:
    """team and items: of each team the first n rows, as structs of the fields, in order. What
    comes after is cut off before anything is gathered."""
    rank = F.row_number().over(W.partitionBy("team").orderBy(*order))
    kept = rows.withColumn("__rank", rank).where(F.col("__rank") <= n)
    item = F.struct(*((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()))
    g = kept.select("team", "__rank", item.alias("__item")).groupBy("team").agg(F.array_sort(F.collect_list(F.struct("__rank", "__item"))).alias("x"))
    return g.select("team", F.transform("x", lambda x: x["__item"]).alias("items"))


def facts(rows: DataFrame, **fields: Column | str) -> DataFrame:
    """team and items: a row of each team as a struct."""
    return rows.select("team", F.struct(*((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items())).alias("items"))


def rounded(c: Column | str, places: int = 1) -> Column:
    """Half up, as the page shows it; null where it is not measurable, never zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 10**places + 0.5) / 10**places


def digest(teams: DataFrame, sections: dict[str, DataFrame], budget: int = BUDGET) -> DataFrame:
    """team, digest (JSON), size and left_out of each team.

    sections(team, items), from the most to the least important. A section stays if it and
    those that stay before it fit the budget; names of the others are told in left_out and in
    the document, so that nothing seems empty that was cut. A section that a team has no row
    in is null: not known. All sections of a team come together in one row, and each is
    bounded by what it lists.
    """
    rows = reduce(lambda a, n: a.join(sections[n].select("team", F.col("items").alias(n)), "team", "left"), sections, teams.select("team").distinct())
    text = {n: F.coalesce(F.to_json(n, {"ignoreNullFields": "false"}), F.lit("null")) for n in sections}
    used, parts, out = F.lit(0), [], []
    for n, t in text.items():
        size = F.length(t) + len(n) + 4  # its quotes, colon and comma
        stays = used + size <= budget
        used = used + F.when(stays, size).otherwise(0)
        rows = rows.withColumns({f"__text_{n}": F.when(stays, t), f"__used_{n}": used})
        used = F.col(f"__used_{n}")
        parts.append(F.when(F.col(f"__text_{n}").isNotNull(), F.concat(F.lit(f'"{n}":'), f"__text_{n}")))
        out.append(F.when(F.col(f"__text_{n}").isNull(), F.lit(n)))
    left_out = F.array_compact(F.array(*out))
    head = F.concat(F.lit('"team":'), F.to_json(F.struct("team")).substr(F.lit(9), F.length(F.to_json(F.struct("team"))) - 9))
    body = F.concat_ws(",", head, F.concat(F.lit('"left_out":'), F.to_json(left_out)), *parts)
    doc = F.concat(F.lit("{"), body, F.lit("}"))
    return rows.select("team", doc.alias("digest"), F.length(doc).alias("size"), F.array_join(left_out, ",").alias("left_out"))
