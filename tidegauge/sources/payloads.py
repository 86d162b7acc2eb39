"""Raw payloads of the forges, the issue tracker and the wiki as flat tables.

Payloads are landed as JSON lines and read with the schemas below, so missing fields are
null. Everything about one payload is derived inside its row by array functions: nothing is
shuffled. People are left out unless they may be kept; counts stay either way.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.core import issue_keys
from ..functions.links import wiki_page_url

USER = "struct<id:string,username:string,name:string,login:string,type:string>"
NOTE = f"struct<system:boolean,body:string,created_at:string,author:{USER}>"
MERGE_REQUEST = f"id bigint, iid bigint, project_id bigint, references struct<full:string>, title string, state string, draft boolean, work_in_progress boolean, created_at string, updated_at string, merged_at string, closed_at string, source_branch string, target_branch string, author {USER}, reviewers array<{USER}>, web_url string, notes array<{NOTE}>, approved_by array<struct<user:{USER}>>"
PULL_REQUEST = f"id bigint, number bigint, repo string, title string, state string, draft boolean, created_at string, updated_at string, merged_at string, closed_at string, head struct<ref:string>, base struct<ref:string>, user {USER}, requested_reviewers array<{USER}>, html_url string, comments array<struct<body:string,created_at:string,user:{USER}>>, reviews array<struct<body:string,state:string,submitted_at:string,user:{USER}>>"
HISTORY = "issue_key string, histories array<struct<id:string,created:string,author:struct<accountId:string,displayName:string>,items:array<struct<field:string,fieldId:string,`from`:string,`to`:string,fromString:string,toString:string>>>>"
SEARCH_HIT = "site string, reason string, id string, title string, url string, excerpt string, lastModified string, content struct<id:string,title:string,space:struct<key:string,name:string>,_links:struct<webui:string>>, resultGlobalContainer struct<title:string,displayUrl:string>"
#: Why a page was found, the better reason first.
REASONS = ("space", "recent", "mention")


def instant(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("timestamp")


def automated(user: Column, bots: list[str]) -> Column:
    """A listed account by its name or display name in any case, or one that says so."""
    listed = [F.lower(user[c]).isin([b.lower() for b in bots]) for c in ("username", "name", "login")] if bots else []
    tests = [*listed, user["type"] == "Bot", user["login"].rlike(r"(?i)\[bot\]$")]
    return F.greatest(*(F.coalesce(t, F.lit(False)) for t in tests))


def _keys(title: Column, branch: Column, known: list[str] | None) -> Column:
    keys = issue_keys(title, branch)
    return keys if known is None else F.filter(keys, lambda k: F.regexp_extract(k, "^(.+)-[^-]*$", 1).isin(known))


def _people(users: Column, keep: bool, name: str) -> Column:
    return F.when(F.lit(keep), F.array_sort(F.array_distinct(F.filter(F.transform(users, lambda u: u[name]), lambda n: n.isNotNull()))))


def _signals(author: Column, said: Column, approved: Column, approval_at: Column, bots: list[str], keep: bool, name: str) -> Column:
    """Who said what of a merge request. said, approval_at: arrays of (at, user); approved:
    users. What its author says is counted apart. Null arrays: unknown, so null counts."""
    own = lambda s: F.coalesce(s["user"][name] == author[name], F.lit(False))
    bot = lambda s: automated(s["user"], bots)
    human_said, bot_said = F.filter(said, lambda s: ~own(s) & ~bot(s)), F.filter(said, lambda s: ~own(s) & bot(s))
    first = lambda rows: F.array_min(F.transform(rows, lambda s: instant(s["at"])))
    n = lambda a: F.when(a.isNotNull(), F.size(a))
    user = lambda rows: F.transform(rows, lambda s: s["user"])
    humans, bots_ok = F.filter(approved, lambda u: ~automated(u, bots)), F.filter(approved, lambda u: automated(u, bots))
    return F.struct(
        automated(author, bots).alias("author_is_bot"), n(human_said).alias("human_comments"), n(bot_said).alias("bot_comments"), n(F.filter(said, own)).alias("author_comments"), n(humans).alias("human_approvals"), n(bots_ok).alias("bot_approvals"),
        first(human_said).alias("first_human_comment"), first(bot_said).alias("first_bot_comment"), first(F.filter(approval_at, lambda s: ~bot(s))).alias("first_human_approval"), first(F.filter(approval_at, bot)).alias("first_bot_approval"),
        _people(user(human_said), keep, name).alias("commenters"), _people(humans, keep, name).alias("approvers"),
    )


def latest(raw: DataFrame) -> DataFrame:
    """Of rows that share an id the one updated last; of equal ones the one whose JSON comes
    first, so that it is the same in every run."""
    text = F.to_json(F.struct(*raw.columns))
    rows = raw.select("id", F.struct(*(c for c in raw.columns if c != "id")).alias("r"), F.struct(F.coalesce(instant("updated_at"), F.lit("0001-01-01").cast("timestamp")), F.xxhash64(text)).alias("at"))
    return rows.groupBy("id").agg(F.max_by("r", "at").alias("r")).select("id", "r.*")


def merge_requests(raw: DataFrame, bots: list[str], keep_people: bool = True, known: list[str] | None = None) -> DataFrame:
    """One row for each merge request id, with its review signals."""
    notes = F.col("notes")
    pair = lambda s: F.struct(s["created_at"].alias("at"), s["author"].alias("user"))
    system = lambda s: F.coalesce(s["system"], F.lit(False))
    said = F.transform(F.filter(notes, lambda s: ~system(s)), pair)
    ok_at = F.transform(F.filter(notes, lambda s: system(s) & F.coalesce(s["body"].rlike(r"(?i)\bapproved this\b"), F.lit(False))), pair)
    approved = F.filter(F.transform("approved_by", lambda a: a["user"]), lambda u: u.isNotNull())
    who = F.when(F.lit(keep_people), F.col("by.name"))
    return latest(raw).withColumnRenamed("author", "by").select(
        F.col("id").alias("mr"), F.substring_index("references.full", "!", 1).alias("project"), "title", "state", F.coalesce("draft", "work_in_progress", F.lit(False)).alias("draft"), instant("created_at").alias("created"), instant("merged_at").alias("merged"), instant("closed_at").alias("closed"),
        F.col("source_branch").alias("branch"), who.alias("author"), _keys(F.col("title"), F.col("source_branch"), known).alias("issue_keys"), "web_url", _signals(F.col("by"), said, approved, ok_at, bots, keep_people, "username").alias("review"),
    )


def pull_requests(raw: DataFrame, bots: list[str], keep_people: bool = True, known: list[str] | None = None) -> DataFrame:
    """The other forge's requests, in the same shape. Reviews with a text count as comments;
    an approval is a person's, once, at its earliest time."""
    author = F.col("user")
    text = lambda s: F.trim(F.coalesce(s["body"], F.lit(""))) != ""
    said = F.concat(F.transform("comments", lambda s: F.struct(s["created_at"].alias("at"), s["user"].alias("user"))), F.transform(F.filter("reviews", text), lambda s: F.struct(s["submitted_at"].alias("at"), s["user"].alias("user"))))
    oks = F.filter("reviews", lambda s: (F.upper(s["state"]) == "APPROVED") & ~F.coalesce(s["user"]["login"] == author["login"], F.lit(False)))
    approved = F.array_distinct(F.transform(oks, lambda s: s["user"]))
    ok_at = F.transform(oks, lambda s: F.struct(s["submitted_at"].alias("at"), s["user"].alias("user")))
    state = F.when(F.col("merged_at").isNotNull(), "merged").when(F.col("state") == "open", "opened").otherwise("closed")
    who = F.when(F.lit(keep_people), F.coalesce("user.name", "user.login"))
    return latest(raw).select(
        F.col("id").alias("mr"), F.col("repo").alias("project"), "title", state.alias("state"), F.coalesce("draft", F.lit(False)).alias("draft"), instant("created_at").alias("created"), instant("merged_at").alias("merged"), instant("closed_at").alias("closed"),
        F.col("head.ref").alias("branch"), who.alias("author"), _keys(F.col("title"), F.col("head.ref"), known).alias("issue_keys"), F.col("html_url").alias("web_url"), _signals(author, said, approved, ok_at, bots, keep_people, "login").alias("review"),
    )


def change_items(raw: DataFrame, kept: list[str], keep_people: bool = True) -> DataFrame:
    """The kept fields' changes, one row each. A field is named by its id, else its name;
    blanks are null; entries without an id or a time are left out."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    e = raw.select("issue_key", F.explode("histories").alias("h")).where("h.id is not null and coalesce(h.created, '') != ''")
    i = e.select("issue_key", F.col("h.id").alias("entry_id"), instant("h.created").alias("at"), F.when(F.lit(keep_people), F.col("h.author.displayName")).alias("author"), F.explode("h.items").alias("i"))
    i = i.withColumn("field", F.coalesce(blank("i.fieldId"), F.col("i.field"))).where(F.col("field").isin(kept))
    return i.select("issue_key", "entry_id", "at", "author", "field", blank("i.from").alias("from_id"), blank("i.to").alias("to_id"), blank("i.fromString").alias("from_name"), blank("i.toString").alias("to_name"))


def clean_excerpt(raw: Column, most: int = 220) -> Column:
    """A search excerpt without its marks and entities; null if nothing is left."""
    for pattern, to in (("@@@(end)?hl@@@", ""), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), (r"\s+", " ")):
        raw = F.regexp_replace(raw, pattern, to)
    text = F.nullif(F.trim(raw), F.lit(""))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…")))


def wiki_pages(raw: DataFrame) -> DataFrame:
    """One row for each page that searches found, under its best reason."""
    page = F.coalesce("content.id", "id")
    space = F.coalesce(F.nullif(F.regexp_extract("resultGlobalContainer.displayUrl", "/spaces/([^/]+)", 1), F.lit("")), "content.space.key", F.lit("?"))
    rows = raw.where(page.isNotNull()).select(
        page.alias("page_id"), F.coalesce("content.title", clean_excerpt(F.col("title"), 200), F.lit("Untitled")).alias("title"), wiki_page_url(F.col("site"), F.coalesce("url", "content._links.webui")).alias("url"), space.alias("space"),
        F.coalesce("resultGlobalContainer.title", "content.space.name").alias("space_name"), instant("lastModified").alias("updated"), clean_excerpt(F.col("excerpt")).alias("excerpt"), "reason",
    )
    rank = F.array_position(F.lit(list(REASONS)), F.col("reason"))
    best = rows.withColumn("r", F.when(rank > 0, rank).otherwise(len(REASONS) + 1)).groupBy("page_id").agg(F.min(F.struct("r", "url", *(c for c in rows.columns if c not in ("page_id", "url")))).alias("m"))
    return best.select("page_id", "m.*").drop("r")


def rich_text(document: Column) -> Column:
    """A nested rich-text document (JSON) as plain text; other strings stay as they are.
    Its depth has no bound, so it is walked in an Arrow function, nested so that workers
    need not import this package."""

    def plain(documents: pd.Series) -> pd.Series:
        import datetime
        import json

        # What a node shows, and the nodes that end a line.
        shows = {"mention": ("text", "{}", "@user"), "emoji": ("shortName", "{}", ""), "inlineCard": ("url", "{}", ""), "blockCard": ("url", "{}", ""), "status": ("text", "[{}]", "")}
        lines = {"paragraph", "heading", "listItem", "blockquote", "codeBlock", "panel", "rule", "tableRow"}

        def shown(node):
            kind, attrs = node.get("type"), node.get("attrs") or {}
            if kind == "text":
                return node["text"] if isinstance(node.get("text"), str) else ""
            if kind == "hardBreak":
                return "\n"
            if kind == "date" and attrs.get("timestamp"):
                return datetime.datetime.fromtimestamp(int(attrs["timestamp"]) / 1000, datetime.UTC).date().isoformat()
            attr, form, missing = shows.get(kind, (None, "", ""))
            return form.format(attrs[attr]) if attr and attrs.get(attr) else missing

        def text(raw):
            if not raw or raw.lstrip()[:1] not in ("{", "["):
                return raw
            try:
                todo, out = [json.loads(raw)], []
            except ValueError:
                return raw
            while todo:  # a stack, since documents may be nested deeper than calls may be
                node = todo.pop()
                if isinstance(node, str):
                    out.append(node)
                elif isinstance(node, list):
                    todo.extend(reversed(node))
                elif isinstance(node, dict):
                    out.append(shown(node))
                    todo.append("\n" if node.get("type") in lines else "")
                    todo.append(node.get("content") if isinstance(node.get("content"), list) else "")
            return "".join(out)

        return documents.map(text, na_action="ignore")

    return F.pandas_udf(plain, StringType())(document)
