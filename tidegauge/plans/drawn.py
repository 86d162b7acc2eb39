"""Queries of the chart tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as ch
from ..operators import delivery as dl
from ..operators import presence as pr
from ..operators import review as rv
from ..operators import rules
from ..operators import series as sr
from ..operators import taxonomy as tx
from .attention import HEALTH, PEOPLE, _forge, _health, _roster
from .queries import ACTIVE, ACTIVE_LAST, CYCLES, DWELL, EPICS, EVENTS, FLOW, LOAD, MEMBERS, PRIMARY, SPENT, WIP, _board, _epics, _practice, _review, query
from .testdata import SERIES


def rows(source: str, x: str, series: dict[str, str], team: str = "team") -> str:
    """The long form in SQL: a SELECT for each series."""
    one = lambda name, v: f"SELECT {team} AS team, '{name}' AS series, cast({x} AS varchar) AS x, round(cast({v} AS double), 6) AS y FROM {source} WHERE ({v}) IS NOT NULL"
    return " UNION ALL ".join(one(n, v) for n, v in series.items())


def _metrics(c):
    m = dl.sprint_metrics(*_board(c))
    return m, dl.forecast(m, F.col("completed_points"))


@query(f"{MEMBERS}, cf AS (SELECT closed.*, p50, p90 FROM closed LEFT JOIN fc USING (team)), ma AS (SELECT * FROM metrics WHERE state = 'active') {rows('cf', 'sprint_id', {'completed': 'completed_points', 'p50': 'p50', 'p90': 'p90'})} UNION ALL {rows('ma', 'sprint_id', {'committed': 'committed_points'})}")
def chart_delivery(c):
    return ch.delivery(*_metrics(c))


@query(f"{MEMBERS}, {ACTIVE}, {LOAD}, pf AS (SELECT coalesce(fc.team, load.team) team, p50, p90, points FROM fc FULL JOIN load ON load.team = fc.team) {rows('pf', 'team', {'p50': 'p50', 'p90': 'p90', 'committed': 'points'})}")
def chart_portfolio(c):
    return ch.portfolio(_metrics(c)[1], dl.active_load(*_board(c)))


@query(f"""{ACTIVE_LAST}, {PRIMARY}, bd AS (SELECT a.team, x.d, cast(coalesce(sum(r.points), 0) AS bigint) committed, cast(coalesce(sum(r.points) FILTER (WHERE r.category <> 'Done'), 0) AS bigint) remaining,
  any_value(CASE WHEN a.end_ts > a.start_ts THEN greatest(0, least(1, {SPENT})) END) spent, count(r.key) + count(s.d) seen FROM act a JOIN pri USING (team, sprint_id) JOIN day x ON x.team = a.team
  LEFT JOIN (SELECT DISTINCT team, sprint_id, d FROM day_sprint) s ON s.team = a.team AND s.sprint_id = a.sprint_id AND s.d = x.d LEFT JOIN r ON r.team = a.team AND r.sprint_id = a.sprint_id AND r.d = x.d GROUP BY 1, 2 HAVING seen > 0),
 b2 AS (SELECT * FROM bd WHERE team IN (SELECT team FROM bd GROUP BY team HAVING count(*) > 1)) {rows('b2', 'd', {'remaining': 'remaining', 'ideal': 'committed * (1 - spent)', 'committed': 'committed'})}""", SERIES)
def chart_burndown(c):
    return ch.burndown(sr.burndown(*c.series), sr.primary_sprints(*c.series))


@query(f"""{EVENTS}, own AS (SELECT author person, count(*) authored, count(*) FILTER (WHERE state = 'merged' AND reviewed) seen, count(*) FILTER (WHERE state = 'merged' AND NOT reviewed) unseen FROM s2 WHERE NOT bot GROUP BY 1),
 gv AS (SELECT n.author person, count(DISTINCT n.mr) given FROM note n JOIN mr m ON m.mr = n.mr WHERE NOT n.bot AND NOT m.bot AND m.detail AND n.author <> m.author AND kind IN ('comment', 'approval') GROUP BY 1),
 pe AS (SELECT coalesce(own.person, gv.person) person, coalesce(authored, 0) authored, coalesce(seen, 0) seen, coalesce(unseen, 0) unseen, coalesce(given, 0) given FROM own FULL JOIN gv ON own.person = gv.person ORDER BY authored DESC, given DESC, person LIMIT 20)
 {rows('pe', 'person', {'merged with review': 'seen', 'merged without': 'unseen', 'reviews given': 'given'}, "'(all)'")}""", None)
def chart_practice(c):
    return ch.practice(_practice(c))


@query(f"{WIP}, nw AS (SELECT * FROM wip WHERE issues > 0) {rows('nw', 'col', {'moving': 'issues - stale', 'stale': 'stale'})}")
def chart_wip(c):
    return ch.wip(tx.wip_by_column(*_board(c), c.board_column, c.as_of))


@query(f"""{MEMBERS}, cp AS (SELECT k.team, k.sprint_id, count(DISTINCT m.assignee) people, coalesce(sum(m.points), 0) points FROM closed k LEFT JOIN mem m ON m.team = k.team AND m.sprint_id = k.sprint_id AND m.within_ GROUP BY 1, 2),
 c2 AS (SELECT * FROM cp WHERE team IN (SELECT team FROM cp GROUP BY team HAVING count(*) > 1)) {rows('c2', 'sprint_id', {'points': 'points', 'people': 'people'})}""")
def chart_composition(c):
    return ch.composition(pr.composition(*_board(c)))


@query(f"{DWELL}, ag AS (SELECT team, col, quantile_cont(dwell_days, 0.5) FILTER (WHERE NOT censored) p50, quantile_cont(dwell_days, 0.9) FILTER (WHERE NOT censored) p90 FROM dw GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT censored) >= 3) {rows('ag', 'col', {'median': 'p50', 'p90': 'p90'})}", SERIES)
def chart_column_ageing(c):
    return ch.column_ageing(sr.column_ages(sr.column_dwell(c.day, c.day_issue, c.day_member, c.day_sprint, c.day_column)))


@query(f"{EPICS}, ea AS (SELECT * FROM ep WHERE active_issues > 0 AND epic <> '(no epic)' QUALIFY row_number() OVER (PARTITION BY team ORDER BY active_issues DESC, active_points DESC, backlog_issues DESC, epic) <= 10) {rows('ea', 'epic', {'done': 'active_done', 'open': 'active_issues - active_done', 'queued': 'backlog_issues'})}")
def chart_epics(c):
    return ch.epics(tx.ranked_epics(_epics(c), "active"))


@query(f"{FLOW} SELECT team, col AS series, cast(d AS varchar) AS x, cast(n AS double) AS y FROM fl WHERE team IN (SELECT team FROM fl GROUP BY team HAVING count(DISTINCT d) > 1)", SERIES)
def chart_flow(c):
    return ch.flow(sr.cumulative_flow(*c.series, c.day_column))


@query(f"""{CYCLES}, cr AS (SELECT cy.*, i.resolved FROM cy JOIN lim ON lim.team = cy.team JOIN day_issue i ON i.team = cy.team AND i.key = cy.key AND i.d = lim.hi),
 fs AS (SELECT team, min(cast(resolved AS date)) f FROM cr GROUP BY team HAVING count(*) > 2)
 SELECT cr.team, CASE WHEN censored THEN 'start unseen' ELSE 'seen' END AS series, concat(cast(resolved AS date) - f, ':', key) AS x, round(cycle_days, 2) AS y FROM cr JOIN fs ON fs.team = cr.team""", SERIES)
def chart_cycle_scatter(c):
    return ch.cycle_scatter(sr.cycle_times(c.day, c.day_issue))


@query(f"""{EVENTS}, b AS (SELECT team, CASE WHEN fh < 1 THEN 0 WHEN fh < 4 THEN 1 WHEN fh < 8 THEN 2 WHEN fh < 24 THEN 3 WHEN fh < 48 THEN 4 WHEN fh < 120 THEN 5 ELSE 6 END bucket FROM s2 WHERE NOT bot AND fh IS NOT NULL),
 la AS (SELECT t.team, cast(x.bucket AS varchar) bucket, count(b.team) n FROM (SELECT DISTINCT team FROM mr) t CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) bucket) x LEFT JOIN b ON b.team = t.team AND b.bucket = x.bucket GROUP BY 1, 2
 UNION ALL SELECT team, 'never', count(*) FILTER (WHERE NOT bot AND NOT reviewed) FROM s2 GROUP BY team)
 SELECT team, 'requests' AS series, bucket AS x, cast(n AS double) AS y FROM la WHERE team IN (SELECT team FROM la GROUP BY team HAVING sum(n) > 0)""", None)
def chart_review_latency(c):
    signals = _review(c)[2]
    return ch.review_latency(rv.latency_histogram(signals), rv.review_counts(signals))


@query(f"""{PEOPLE}, fp AS (SELECT person FROM ro WHERE open_in_active > 0 GROUP BY person HAVING count(*) > 1 ORDER BY count(*) DESC, sum(open_in_active) DESC, person LIMIT 14)
 SELECT '(all)' AS team, team AS series, person AS x, cast(open_in_active AS double) AS y FROM ro WHERE open_in_active > 0 AND person IN (SELECT person FROM fp)""")
def chart_cross_team_load(c):
    return ch.cross_team_load(_roster(c, _forge(c)))


@query(f"""{EPICS}, es AS (SELECT epic, sum(issues) issues, sum(done_issues) done, sum(active_issues - active_done) ao, sum(backlog_issues - backlog_done) bo FROM ep WHERE epic <> '(no epic)' GROUP BY epic),
 et AS (SELECT * FROM es ORDER BY issues - done DESC, issues DESC, epic LIMIT 12) {rows('et', 'epic', {'done': 'done', 'active': 'ao', 'queued': 'bo', 'elsewhere': 'greatest(0, issues - done - ao - bo)'}, "'(all)'")}""")
def chart_estate_epics(c):
    return ch.estate_epics(tx.estate_epics(_epics(c)))


@query(f"{HEALTH} SELECT team, health, cast(p AS int) poor, row_number() OVER (ORDER BY CASE health WHEN 'poor' THEN 0 WHEN 'watch' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, p DESC, team) AS rank FROM he")
def triage(c):
    return rules.triage(_health(c))
