"""Raw tracker issues, whose custom fields differ from site to site, as flat rows.

A raw issue is a JSON document in a column `value`. It is parsed once into a variant, of
which only the paths that are asked for are read; all of an issue is derived in its row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import excerpt
from ..operators.rules import blockers, parse_sprint
from .payloads import instant, rich_text

#: How the tracker marks its own fields, and how much of a text is kept.
SPRINT_FIELD = "com.pyxis.greenhopper.jira:gh-sprint"
RANK_FIELD = "com.pyxis.greenhopper.jira:gh-lexo-rank"
EPIC_FIELD = "com.pyxis.greenhopper.jira:gh-epic-link"
DESCRIPTION_CHARS, COMMENT_CHARS, COMMENTS = 280, 240, 3
FIELD = "id string, name string, custom boolean, schema struct<type:string,custom:string>"


@dataclass(frozen=True)
class FieldMap:
    """Ids of a site's fields; points: every field that may hold them, in order."""

    sprint: str
    points: tuple[str, ...] = field(default=())
    epic: str | None = None
    rank: str | None = None
    flagged: str | None = None
    team: str | None = None


def field_map(fields: DataFrame) -> FieldMap:
    """Find the fields of a site in its list of fields (id, name, custom, schema), by what
    they are rather than by name where they say so. The list is a site's settings, a few
    hundred rows. Without a sprint field there is nothing to work on: an error."""
    custom = F.coalesce("custom", F.lit(False))
    named = lambda name: custom & F.col("name").rlike(f"(?i)^{name}$")
    of = lambda uri: F.col("schema.custom") == uri
    estimate = custom & (F.col("schema.type") == "number") & F.col("name").rlike(r"(?i)story\s*point")
    tests = {"sprint": of(SPRINT_FIELD), "epic": of(EPIC_FIELD), "rank": of(RANK_FIELD), "flagged": named("flagged"), "team": named("team")}
    found = fields.agg(*(F.min(F.when(t, F.col("id"))).alias(n) for n, t in tests.items()), F.array_sort(F.collect_set(F.when(estimate, F.col("id")))).alias("points")).first().asDict()
    if not found["sprint"]:
        raise ValueError("no sprint field: boards are not enabled there, or may not be read")
    return FieldMap(**{**found, "points": tuple(found["points"])})


def _at(path: str, kind: str = "string", v: Column | None = None) -> Column:
    return F.try_variant_get(F.col("v") if v is None else v, path, kind)


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _is(v: Column, *kinds: str) -> Column:
    """Whether a variant is of one of these kinds (the first word of its schema)."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0).isin(*kinds), F.lit(False))


def _list(path: str) -> Column:
    """What a field holds, as an array: a single value is one of one; none, an empty one."""
    one = F.when(_at(path, "variant").isNotNull() & ~_is(_at(path, "variant"), "VOID"), F.array(_at(path, "variant")))
    return F.coalesce(_at(path, "array<variant>"), one, F.expr("cast(array() as array<variant>)"))


def sprints(path: str) -> Column:
    """The sprints that a field carries, given as objects or in the older text form; what
    has no numeric id is none."""

    def of(v: Column) -> Column:
        get = lambda name: _filled(_at(f"$.{name}", "string", v))
        names = ("name", "goal", "startDate", "endDate", "completeDate")
        own = F.struct(_at("$.id", "bigint", v).alias("id"), F.coalesce(get("state"), F.lit("unknown")).alias("state"), *(get(n).alias(n) for n in names))
        old = parse_sprint(_at("$", "string", v))
        older = F.struct(old["id"].alias("id"), F.coalesce(old["state"], F.lit("unknown")).alias("state"), *(old[n].alias(n) for n in names))
        return F.when(_is(v, "OBJECT"), own).otherwise(older)

    return F.filter(F.transform(_list(path), of), lambda s: s["id"].isNotNull())


def story_points(ids: tuple[str, ...]) -> Column:
    """struct(points, field): the first of the fields that holds a number."""
    out = F.struct(F.lit(None).cast("double").alias("points"), F.lit(None).cast("string").alias("field"))
    for i in reversed(ids):
        v = _at(f"$.fields.{i}", "variant")
        out = F.when(_is(v, "BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), F.struct(_at(f"$.fields.{i}", "double").alias("points"), F.lit(i).alias("field"))).otherwise(out)
    return out


def _links() -> Column:
    """Links in both directions: array of struct(type, direction, key)."""

    def side(l: Column, way: str) -> Column:  # noqa: E741
        said = F.coalesce(_at(f"$.type.{way}", "string", l), _at("$.type.name", "string", l), F.lit("relates to"))
        return F.struct(said.alias("type"), F.lit(way).alias("direction"), _at(f"$.{way}Issue.key", "string", l).alias("key"))

    both = F.transform(_list("$.fields.issuelinks"), lambda l: F.array(side(l, "outward"), side(l, "inward")))
    return F.filter(F.flatten(both), lambda x: x["key"].isNotNull())


def _person(path: str, keep: bool, v: Column | None = None) -> Column:
    return F.when(F.lit(keep), _filled(F.trim(_at(f"{path}.displayName", "string", v))))


def recent_comments(keep_people: bool) -> Column:
    """The last COMMENTS comments, newest first; those without an id or a text are left out.
    Null if comments were not asked for."""
    all_ = _at("$.fields.comment.comments", "array<variant>")
    last = F.reverse(F.slice(all_, F.greatest(F.size(all_) - COMMENTS + 1, F.lit(1)), F.lit(COMMENTS)))

    def nth(i: int) -> Column:
        c = F.get(last, i)
        body = excerpt(rich_text(_at("$.body", "string", c)), COMMENT_CHARS)
        created, updated = _at("$.created", "string", c), _at("$.updated", "string", c)
        who = F.coalesce(_person("$.author", keep_people, c), _person("$.updateAuthor", keep_people, c))
        id_ = _filled(_at("$.id", "string", c))
        whole = F.struct(
            id_.alias("id"), who.alias("author"), instant(F.coalesce(created, updated)).alias("created"), body["text"].alias("body"), body["truncated"].alias("truncated"),
            F.when(~updated.eqNullSafe(created), instant(updated)).alias("updated"),
        )
        return F.when(id_.isNotNull() & body["text"].isNotNull(), whole)

    return F.when(all_.isNotNull(), F.array_compact(F.array(*map(nth, range(COMMENTS)))))


def issues(raw: DataFrame, fields: FieldMap, backlog: DataFrame | None = None, keep_people: bool = True) -> DataFrame:
    """A row for each raw issue (a JSON document in `value`); documents without a key, or that
    are no JSON, give none. Sprint ids are in order, since the tracker gives them as they
    were added. A flag is a list of options: an empty one is no flag. backlog(key): the
    keys of the backlog. comments are null where they were not collected."""
    v = raw.select(F.try_parse_json("value").alias("v")).where(_at("$.key").isNotNull())
    text = lambda path: _filled(_at(path))
    maybe = lambda id_: text(f"$.fields.{id_}") if id_ else F.lit(None).cast("string")
    flags = _at(f"$.fields.{fields.flagged}", "array<variant>") if fields.flagged else F.lit(None)
    single = text(f"$.fields.{fields.flagged}").isNotNull() if fields.flagged else F.lit(False)
    flagged = F.when(flags.isNotNull(), F.size(flags) > 0).otherwise(single) if fields.flagged else F.lit(False)
    found = story_points(fields.points)
    names = F.transform(_list("$.fields.components"), lambda c: _at("$.name", "string", c))
    out = v.select(
        _at("$.key").alias("key"), _at("$.id").alias("id"), F.coalesce(text("$.fields.issuetype.name"), F.lit("Unknown")).alias("issue_type"), text("$.fields.summary").alias("summary"),
        excerpt(rich_text(_at("$.fields.description")), DESCRIPTION_CHARS).alias("description"), F.coalesce(text("$.fields.status.name"), F.lit("Unknown")).alias("status"), text("$.fields.status.id").alias("status_id"),
        F.coalesce(text("$.fields.status.statusCategory.name"), F.lit("Unknown")).alias("category"), text("$.fields.priority.name").alias("priority"), text("$.fields.resolution.name").alias("resolution"),
        *(instant(_at(f"$.fields.{a}")).alias(b) for a, b in (("resolutiondate", "resolved"), ("created", "created"), ("updated", "updated"), ("duedate", "due"), ("statuscategorychangedate", "category_changed"))),
        *(_person(f"$.fields.{w}", keep_people).alias(w) for w in ("assignee", "reporter", "creator")), found["points"].alias("points"), found["field"].alias("points_field"),
        maybe(fields.epic).alias("epic_key"), text("$.fields.parent.key").alias("parent_key"), maybe(fields.rank).alias("rank"), flagged.alias("flagged"),
        F.coalesce(_at("$.fields.labels", "array<string>"), F.expr("cast(array() as array<string>)")).alias("labels"), names.alias("components"), sprints(f"$.fields.{fields.sprint}").alias("sprints"),
        _links().alias("links"), recent_comments(keep_people).alias("comments"), _at("$.fields.comment.total", "bigint").alias("comment_count"),
        *(_at(f"$.fields.{a}", "bigint").alias(b) for a, b in (("timeoriginalestimate", "estimate_seconds"), ("timespent", "spent_seconds"))),
    )
    out = out.withColumn("sprint_ids", F.array_sort(F.transform("sprints", lambda s: s["id"])))
    hold = blockers(F.col("links"))
    out = out.withColumn("blocked_by", hold["blocked_by"]).withColumn("blocks", hold["blocks"])
    if backlog is None:
        return out.withColumn("in_backlog", F.lit(False))
    known = backlog.select("key").distinct().withColumn("in_backlog", F.lit(True))
    return out.join(known, "key", "left").fillna(False, ["in_backlog"])


def epics(raw: DataFrame) -> DataFrame:
    """id, key, name, summary, done of raw epics (a JSON document in `value`); the name is
    what the board shows, else the summary, else the key. Those without a key are left out."""
    v = raw.select(F.try_parse_json("value").alias("v")).where(_filled(_at("$.key")).isNotNull())
    name, summary = _at("$.name"), _filled(_at("$.summary"))
    other = F.when(~summary.eqNullSafe(name), summary).alias("summary")
    return v.select(_at("$.id", "bigint").alias("id"), _at("$.key").alias("key"), F.coalesce(name, summary, _at("$.key")).alias("name"), other, F.coalesce(_at("$.done", "boolean"), F.lit(False)).alias("done"))


def with_detail(issues: DataFrame, detail: DataFrame, epics: DataFrame) -> DataFrame:
    """issues with what a later pass found: detail(key, description, comments, comment_count)
    and epics(key, name). What a pass did not ask for is null and leaves the issue as it is;
    an issue that no pass reached keeps comments null, which is not the same as none."""
    kept = ("description", "comments", "comment_count")
    d = detail.dropDuplicates(["key"]).select("key", *(F.col(c).alias(f"new_{c}") for c in kept))
    e = epics.groupBy(F.col("key").alias("epic_key")).agg(F.min("name").alias("epic_name"))
    out = issues.join(d, "key", "left").join(e, "epic_key", "left")
    for c in kept:
        out = out.withColumn(c, F.coalesce(f"new_{c}", c))
    return out.drop(*(f"new_{c}" for c in kept))


def all_sprints(of_board: DataFrame, of_issues: DataFrame) -> DataFrame:
    """Sprints by id: the board's row where there is one, else the one that issues carry, so
    that no issue names a sprint that is not there."""
    ranked = of_board.withColumn("rank", F.lit(0)).unionByName(of_issues.withColumn("rank", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in of_board.columns if c != "id"]
    best = ranked.groupBy("id").agg(F.min(F.struct("rank", *rest)).alias("m"))
    return best.select("id", *(F.col(f"m.{c}").alias(c) for c in rest))
