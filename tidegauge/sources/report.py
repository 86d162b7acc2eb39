"""A page for each team, rendered by expressions and written where its rows are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows that a table shows; what comes after is told as a number.
SHOWN = 40
BAR = 200


def safe(c: Column | str) -> Column:
    """A value as text of a page; a dash where it is not known."""
    t = (F.col(c) if isinstance(c, str) else c).cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.coalesce(t, F.lit("–"))


def tag(name: str, *inner: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name.split()[0]}>"))


def panel(title: str, rows: DataFrame, order: list, cells: dict[str, str], shown: int = SHOWN) -> DataFrame:
    """team and html: a table of a team's first rows, with how many more there are."""
    rank, n = F.row_number().over(W.partitionBy("team").orderBy(*order)), rows.groupBy("team").agg(F.count("*").alias("__n"))
    row = tag("tr", *(tag("td", safe(c)) for c in cells.values())).alias("tr")
    first = rows.withColumn("__rank", rank).where(F.col("__rank") <= shown).select("team", "__rank", row)
    g = first.groupBy("team").agg(F.array_sort(F.collect_list(F.struct("__rank", "tr"))).alias("x")).join(n, "team")
    more = F.when(F.col("__n") > shown, tag("p", F.format_string("%d more", F.col("__n") - shown))).otherwise("")
    head = tag("tr", *(tag("th", F.lit(c)) for c in cells))
    body = tag("table", head, F.array_join(F.transform("x", lambda x: x["tr"]), ""))
    return g.select("team", tag("section", tag("h2", safe(F.lit(title))), body, more).alias("html"))


def bars(title: str, chart: DataFrame, series: str, order: list, shown: int = SHOWN) -> DataFrame:
    """team and html: one series of a chart table (team, series, x, y) as bars, the longest
    BAR wide. Values that are not known have no bar."""
    rows = chart.where(F.col("series") == series)
    most = rows.groupBy("team").agg(F.max("y").alias("__most"))
    rank = F.row_number().over(W.partitionBy("team").orderBy(*order))
    first = rows.withColumn("__rank", rank).where(F.col("__rank") <= shown).join(most, "team")
    wide = F.coalesce(F.when(F.col("__most") > 0, F.greatest(F.lit(0), F.round(F.col("y") / F.col("__most") * BAR))), F.lit(0)).cast("int")
    top = (F.col("__rank") - 1) * 20
    bar = F.concat(F.format_string('<rect x="120" y="%d" width="%d" height="14"/><text x="0" y="%d">', top, wide, top + 12), safe("x"), F.lit(" "), safe("y"), F.lit("</text>"))
    g = first.select("team", "__rank", bar.alias("bar")).groupBy("team").agg(F.array_sort(F.collect_list(F.struct("__rank", "bar"))).alias("x"))
    svg = F.concat(F.format_string('<svg width="%d" height="%d">', F.lit(BAR + 130), F.size("x") * 20), F.array_join(F.transform("x", lambda x: x["bar"]), ""), F.lit("</svg>"))
    return g.select("team", tag("section", tag("h2", safe(F.lit(title))), svg).alias("html"))


def pages(teams: DataFrame, panels: list[tuple[str, DataFrame]]) -> DataFrame:
    """team and page: the panels in their order. A team without rows in one is told so: that
    is not the same as nothing to show. panels: what it is about, and (team, html)."""
    rows = reduce(lambda a, p: a.join(p[1][1].select("team", F.col("html").alias(f"__{p[0]}")), "team", "left"), enumerate(panels), teams.select("team").distinct())
    none = lambda about: F.lit(f"<section><h2>{about}</h2><p>not collected</p></section>")
    body = F.concat(*(F.coalesce(f"__{i}", none(about)) for i, (about, _) in enumerate(panels)))
    head = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), safe("team"), F.lit("</title></head>"))
    return rows.select("team", F.concat(head, tag("body", tag("h1", safe("team")), body), F.lit("</html>")).alias("page"))


def write(rows: DataFrame, path: str) -> None:
    """A folder for each team with one text file, its page; nothing is collected."""
    rows.select("page", "team").repartition("team").write.mode("overwrite").partitionBy("team").text(path)
