"""Queries of people over sprints, the org tree and the digest, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery as dl
from ..operators import digest as dg
from ..operators import org
from ..operators import presence as pr
from ..operators import taxonomy as tx
from .queries import ACTIVE, EPICS, LOAD, MEMBERS, MIX, _board, _epics, query

THERE = f"""{MEMBERS}, num AS (SELECT team, sprint_id, row_number() OVER (PARTITION BY team ORDER BY place) n FROM closed),
th AS (SELECT DISTINCT m.team, m.sprint_id, n, assignee person FROM mem m JOIN num ON num.team = m.team AND num.sprint_id = m.sprint_id WHERE within_ AND assignee IS NOT NULL),
lt AS (SELECT team, max(n) top FROM num GROUP BY team)"""


@query(f"""{THERE} SELECT a.team, a.person, count(*) sprints, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM th b WHERE b.team = a.team AND b.person = a.person AND b.n = a.n - 1)) runs,
 arg_min(a.sprint_id, a.n) first_sprint, arg_max(a.sprint_id, a.n) last_sprint, max(a.n) = any_value(top) AS current FROM th a JOIN lt ON lt.team = a.team GROUP BY 1, 2""")
def people_over_sprints(c):
    return pr.people_over_sprints(*_board(c))


@query(f"""{THERE}, cs AS (SELECT num.team, num.n, count(person) c FROM num LEFT JOIN th ON th.team = num.team AND th.n = num.n GROUP BY 1, 2)
SELECT team, round(quantile_cont(c, 0.5) FILTER (WHERE c > 0), 6) median_contributors, arg_max(c, n) latest_contributors FROM cs GROUP BY team""")
def contributors(c):
    return pr.contributors(pr.composition(*_board(c)), pr.numbered(c.sprint))


#: Boards are nations, in groups by region and last letter; people are the suppliers of
#: their orders; urgent orders that are open cannot wait.
ESTATE = """nb AS (SELECT n_nationkey k, n_name team, r_name region, right(n_name, 1) letter FROM nation JOIN region ON r_regionkey = n_regionkey),
pe AS (SELECT DISTINCT nb.team, region, letter, l_suppkey person FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nb ON nb.k = c_nationkey WHERE l_linenumber = 1),
ac AS (SELECT nb.team, region, letter, count(*) n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nb ON nb.k = c_nationkey WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' GROUP BY 1, 2, 3),
nd AS (SELECT *, 'estate' node, cast(NULL AS varchar) parent, 'estate' kind, 0 AS level FROM nb UNION ALL SELECT *, 'estate/' || region, 'estate', 'group', 1 FROM nb
 UNION ALL SELECT *, 'estate/' || region || '/' || letter, 'estate/' || region, 'group', 2 FROM nb UNION ALL SELECT *, 'estate/' || region || '/' || letter || ':' || team, 'estate/' || region || '/' || letter, 'board', 3 FROM nb)"""


@query(f"""WITH {ESTATE} SELECT node, parent, kind, level, (SELECT count(DISTINCT x.node) FROM nd x WHERE x.parent = nd.node) children, count(*) boards,
 (SELECT count(DISTINCT person) FROM pe WHERE EXISTS (SELECT 1 FROM nd y WHERE y.node = nd.node AND y.team = pe.team)) people,
 (SELECT cast(coalesce(sum(n), 0) AS bigint) FROM ac WHERE EXISTS (SELECT 1 FROM nd y WHERE y.node = nd.node AND y.team = ac.team)) acts FROM nd GROUP BY 1, 2, 3, 4""", None)
def org_tree(c):
    nation = c.raw("nation").join(c.raw("region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.col("n_name").alias("team"), F.array("r_name", F.right("n_name", F.lit(1))).alias("path"))
    orders = c.raw("orders").join(c.raw("customer"), F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    lines = c.raw("lineitem").where("l_linenumber = 1").select("l_orderkey", F.col("l_suppkey").alias("person"))
    member = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("team", "person")
    urgent = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")
    return org.tree(nation.select("team", "path"), member, orders.select("team", F.when(urgent, "act-now").alias("severity")))


def sections(c) -> dict:
    """A team's digest, the most important first."""
    metrics = dl.sprint_metrics(*_board(c))
    epics = _epics(c)
    active = dl.in_active(*_board(c))
    return {
        "load": dg.facts(dl.active_load(*_board(c)), issues="issues", points="points", unestimated="unestimated", done="done_issues"),
        "velocity": dg.facts(dl.forecast(metrics, F.col("completed_points")), p10=dg.rounded("p10"), p50=dg.rounded("p50"), p90=dg.rounded("p90"), basis="basis"),
        "epics": dg.first(epics.where("active_issues > 0 and epic != '(no epic)'"), 8, [F.desc("active_issues"), F.desc("active_points"), "epic"], key="epic", active="active_issues", blocked="blocked", done_share=dg.rounded("progress", 2)),
        "backlog": dg.facts(dl.backlog_summary(c.issue, c.as_of), issues="issues", unestimated="unestimated", median_age=dg.rounded("median_age", 0), older_than_90="older_than_90"),
        "types": dg.first(tx.mix(active, "issue_type"), 5, [F.desc("issues"), "name"], name="name", issues="issues"),
        "carried": dg.first(dl.carryover_leaders(*_board(c)), 5, ["rank"], key="key", sprints="sprint_count"),
    }


ROUND = "floor({0} * 10 + 0.5) / 10"
PARTS = """STRUCT<load: STRUCT<issues: BIGINT, points: BIGINT>, velocity: STRUCT<p50: DOUBLE, basis: BIGINT>, epics: ARRAY<STRUCT<key: STRING, active: BIGINT, done_share: DOUBLE>>, backlog: STRUCT<median_age: DOUBLE>, types: ARRAY<STRUCT<name: STRING, issues: BIGINT>>, carried: ARRAY<STRUCT<key: STRING, sprints: BIGINT>>>"""


@query(f"""{MEMBERS}, {EPICS}, {LOAD}, bl AS (SELECT team, floor(round(quantile_cont((epoch_us(timestamp '2001-06-30 00:00:00') - epoch_us(created)) / 86400e6, 0.5), 6) + 0.5) age FROM issue WHERE in_backlog AND category <> 'Done' GROUP BY team),
tm AS (SELECT team, issue_type AS name, {MIX} FROM act GROUP BY 1, 2), ty AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY issues DESC, name) r FROM tm),
er AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY active_issues DESC, active_points DESC, epic) r FROM ep WHERE active_issues > 0 AND epic <> '(no epic)'),
lat AS (SELECT team, sprint_id FROM sprint WHERE state = 'active' QUALIFY row_number() OVER (PARTITION BY team ORDER BY start_ts DESC, sprint_id) = 1),
ca AS (SELECT i.team, i.key, sprint_count, row_number() OVER (PARTITION BY i.team ORDER BY sprint_count DESC, pos) r FROM issue i JOIN cnt ON cnt.team = i.team AND cnt.key = i.key WHERE i.category <> 'Done' AND EXISTS (SELECT 1 FROM issue_sprint m JOIN lat ON lat.team = m.team AND lat.sprint_id = m.sprint_id WHERE m.team = i.team AND m.key = i.key))
SELECT t.team, '' left_out, l.issues active_issues, l.points active_points, {ROUND.format('fc.p50')} p50, fc.basis, bl.age median_age,
 (SELECT string_agg(epic || ':' || active_issues || ':' || cast(floor(progress * 100 + 0.5) AS bigint), ',' ORDER BY r) FROM er WHERE er.team = t.team AND r <= 8) epics,
 (SELECT string_agg(name || ':' || issues, ',' ORDER BY r) FROM ty WHERE ty.team = t.team AND r <= 5) types,
 (SELECT string_agg(key || ':' || sprint_count, ',' ORDER BY r) FROM ca WHERE ca.team = t.team AND r <= 5) carried
FROM teams t LEFT JOIN load l USING (team) LEFT JOIN fc USING (team) LEFT JOIN bl USING (team)""")
def briefing_digest(c):
    """The parts of each team's document, read back from its JSON."""
    d = dg.digest(c.teams, sections(c)).withColumn("p", F.from_json("digest", PARTS))
    join = lambda items, *cells: F.nullif(F.array_join(F.transform(items, lambda x: F.concat_ws(":", *(f(x) for f in cells))), ","), F.lit(""))
    text = lambda n: lambda x: x[n].cast("string")
    return d.select(
        "team", "left_out", F.col("p.load.issues").alias("active_issues"), F.col("p.load.points").alias("active_points"), F.col("p.velocity.p50").alias("p50"), F.col("p.velocity.basis").alias("basis"), F.col("p.backlog.median_age").alias("median_age"),
        join("p.epics", text("key"), text("active"), lambda x: F.round(x["done_share"] * 100).cast("long").cast("string")).alias("epics"), join("p.types", text("name"), text("issues")).alias("types"), join("p.carried", text("key"), text("sprints")).alias("carried"),
    )
