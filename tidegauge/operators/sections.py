"""Which sections of a team's page need a reader today."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The section in which findings of a kind stand.
SECTION = {
    "flagged": "flagged", "blocked-by-open": "blockers", "blocker-in-comments": "blockers", "stale": "attention", "overdue": "attention", "sprint-overdue": "sprint", "wip-overload": "board",
    "unassigned": "attention", "no-goal": "sprint", "over-committed": "sprint", "review-stalled": "review", "review-gap": "review", "merge-lag": "review", "scope-churn": "churn",
    "comments-not-collected": "trust",
}
#: The section of what must be done, and tones that ask for attention.
ACT, LOUD = "act", ("poor", "watch")


def changed_sections(changes: DataFrame) -> DataFrame:
    """team and section of findings that changed. changes(identity, kind): identities begin
    with the team and the kind of the finding; kind says what changed."""
    part = F.split("identity", r"\|")
    of = F.create_map(*(F.lit(x) for kv in SECTION.items() for x in kv))
    rows = changes.where("kind != 'unchanged'").select(part[0].alias("team"), of[part[1]].alias("section"))
    return rows.where("section is not null").distinct()


def needs_reader(section: DataFrame, acts: DataFrame, changed: DataFrame) -> DataFrame:
    """section(team, section, tone, collapsed) with open: a section that is collapsed stays
    so; else it is open if its tone asks for it, if it tells what must be done and there is
    something (acts(team, n)), or if something in it changed (changed(team, section))."""
    j = section.join(acts.select("team", F.col("n").alias("__acts")), "team", "left").join(changed.select("team", "section", F.lit(True).alias("__changed")), ["team", "section"], "left")
    loud = F.col("tone").isin(*LOUD) | ((F.col("section") == ACT) & (F.col("__acts") > 0)) | F.col("__changed")
    return j.withColumn("open", ~F.coalesce("collapsed", F.lit(False)) & F.coalesce(loud, F.lit(False))).drop("__acts", "__changed")
