"""Nested exports of issue trackers, code hosts and document stores to flat records.

Schemas are stated, never inferred, so a reader costs one pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PERSON = "struct<accountId:string,displayName:string,emailAddress:string>"
ISSUE = f"""key string, id string, fields struct<summary:string,description:string,status:struct<name:string>,issuetype:struct<name:string>,
project:struct<key:string,name:string>,assignee:{_PERSON},reporter:{_PERSON},labels:array<string>,created:string,updated:string,parent:struct<id:string,key:string>,
comment:struct<comments:array<struct<author:struct<displayName:string>,body:string>>>,issuelinks:array<struct<type:struct<outward:string>,outwardIssue:struct<id:string>>>>,
changelog struct<histories:array<struct<created:string,author:struct<displayName:string>,items:array<struct<field:string,`from`:string,fromString:string,`to`:string,toString:string>>>>>"""
PULL = """values array<struct<id:bigint,title:string,description:string,state:string,author:struct<display_name:string,uuid:string>,source:struct<branch:struct<name:string>>,
destination:struct<branch:struct<name:string>,repository:struct<full_name:string,uuid:string,name:string>>,created_on:string,updated_on:string>>"""
COMMITS = "values array<struct<hash:string,message:string,author:struct<user:struct<display_name:string>,raw:string>,date:string>>"
DIFFSTAT = "values array<struct<status:string,lines_added:int,lines_removed:int,old:struct<path:string>,new:struct<path:string>>>"
PAGES = "results array<struct<id:string,url:string,last_edited_time:string,parent:struct<type:string,page_id:string>,properties:map<string,struct<type:string,title:array<struct<plain_text:string>>>>>>"

_BLOCKS = {"paragraph", "heading", "bulletList", "orderedList", "listItem", "blockquote", "codeBlock", "tableRow", "panel", "rule"}


def rich_text(value: object) -> str:
    """The plain text of a rich-text tree, block nodes on lines of their own."""
    out: list[str] = []
    stack: list[object] = [value]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif isinstance(node, list):
            stack.extend(reversed(node))
        elif isinstance(node, dict):
            if node.get("type") == "hardBreak":
                out.append("\n")
            if node.get("type") in _BLOCKS:
                out.append("\n")
                stack.append("\n")
            stack.append(node.get("content") or [])
            if isinstance(node.get("text"), str):
                out.append(node["text"])
    text = "".join(out)
    while "\n\n" in text:
        text = text.replace("\n\n", "\n")
    return text.strip()


def plain_text(column: Column) -> Column:
    """Text, or the text of rich-text JSON; anything else is left as it is."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda v: _plain(v) if isinstance(v, str) else v)

    return F.when(F.ltrim(column).startswith("{"), run(column)).otherwise(column)


def _plain(value: str) -> str:
    try:
        tree = json.loads(value)
    except ValueError:
        return value
    return rich_text(tree) if isinstance(tree, dict) and "content" in tree else value


def issues(spark: SparkSession, path: str) -> DataFrame:
    """One row per issue of a JSON array or of JSON lines, its changes as an array."""
    raw = spark.read.schema(ISSUE).option("multiLine", True).json(path)
    f = F.col("fields")
    person = lambda c: F.struct(c["accountId"].alias("account_id"), c["displayName"].alias("display_name"), c["emailAddress"].alias("email"))
    blocks = F.transform(F.filter(f["issuelinks"], lambda x: F.lower(x["type"]["outward"]).contains("block") & x["outwardIssue"]["id"].isNotNull()), lambda x: x["outwardIssue"]["id"])
    items = F.flatten(F.transform("changelog.histories", lambda h: F.transform(h["items"], lambda i: F.struct(h["created"].alias("changed_at"), F.lower(i["field"]).alias("field"), i["from"].alias("from_id"), i["fromString"].alias("from_string"), i["to"].alias("to_id"), i["toString"].alias("to_string"), h["author"]["displayName"].alias("author")))))
    kept = F.array_sort(F.filter(items, lambda i: i["field"].isin("assignee", "status", "priority")))
    body = plain_text(f["description"])
    comments = F.array_join(F.transform(f["comment"]["comments"], lambda c: F.concat_ws(": ", c["author"]["displayName"], c["body"])), "\n")
    content = F.concat_ws("\n", F.concat(F.lit("Issue: "), "key"), F.concat(F.lit("Summary: "), f["summary"]), F.concat(F.lit("Status: "), f["status"]["name"]), F.concat(F.lit("Assignee: "), f["assignee"]["displayName"]), body, F.when(comments != "", comments))
    return raw.where("key is not null").select(
        F.coalesce("id", "key").alias("issue_id"), F.col("key").alias("issue_key"), f["project"]["key"].alias("project_key"), f["summary"].alias("summary"), content.alias("content"), body.alias("description"),
        f["status"]["name"].alias("status"), f["issuetype"]["name"].alias("issue_type"), person(f["assignee"]).alias("assignee"), person(f["reporter"]).alias("reporter"), f["labels"].alias("labels"), blocks.alias("blocks"),
        f["created"].try_cast("timestamp").alias("created_at"), f["updated"].try_cast("timestamp").alias("updated_at"), f["parent"]["id"].alias("parent_id"), f["parent"]["key"].alias("parent_key"), kept.alias("changes"),
    )


def changes(issue_rows: DataFrame) -> DataFrame:
    """The change log of issues, one row per changed field."""
    return issue_rows.select("issue_id", F.inline("changes"))


def pull_requests(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(PULL).option("multiLine", True).json(path).select(F.inline("values"))
    repo = F.col("destination.repository.full_name")
    return raw.select(
        F.concat(F.lower(repo), F.lit("#"), F.col("id").cast("string")).alias("pr_ref"), "id", repo.alias("repository_full_name"), "title", "description", "state", F.col("author.display_name").alias("author_name"), F.col("author.uuid").alias("author_uuid"),
        F.col("source.branch.name").alias("source_branch"), F.col("destination.branch.name").alias("destination_branch"), F.col("created_on").try_cast("timestamp").alias("created_on"), F.col("updated_on").try_cast("timestamp").alias("updated_on"),
    )


def commits_of_pull_requests(spark: SparkSession, path: str) -> DataFrame:
    """Commits from files named by their pull request; those without a message are left out."""
    raw = spark.read.schema(COMMITS).option("multiLine", True).json(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).try_cast("long")
    rows = raw.select(number.alias("pr_id"), F.explode("values").alias("v"))
    raw_name = F.trim(F.regexp_replace("v.author.raw", "<[^>]*>", ""))
    mail = F.regexp_extract("v.author.raw", "<([^>]*)>", 1)
    return rows.where("trim(coalesce(v.message, '')) <> ''").select("pr_id", F.col("v.hash").alias("commit_hash"), F.col("v.message").alias("message"), F.coalesce("v.author.user.display_name", raw_name).alias("author_name"), F.when(mail != "", mail).alias("author_email"), F.col("v.date").try_cast("timestamp").alias("commit_date"))


def diffstat(spark: SparkSession, path: str) -> DataFrame:
    """Changed files: the new path, else the old one."""
    raw = spark.read.schema(DIFFSTAT).option("multiLine", True).json(path).select(F.inline("values"))
    return raw.select(F.coalesce("new.path", "old.path").alias("path"), F.col("old.path").alias("old_path"), "status", "lines_added", "lines_removed")


def pages(spark: SparkSession, path: str, bodies: str | None = None) -> DataFrame:
    """Pages of a search result, with the markdown of ``bodies`` where it is given."""
    raw = spark.read.schema(PAGES).option("multiLine", True).json(path).select(F.inline("results"))
    titles = F.filter(F.map_values("properties"), lambda p: p["type"] == "title")
    title = F.array_join(F.transform(F.flatten(F.transform(titles, lambda p: p["title"])), lambda t: t["plain_text"]), "")
    out = raw.select(F.col("id").alias("page_id"), "url", title.alias("title"), F.col("last_edited_time").try_cast("timestamp").alias("updated_at"), F.when(F.col("parent.type") == "page_id", F.col("parent.page_id")).alias("parent_id"))
    if bodies is None:
        return out
    texts = spark.read.schema("id string, markdown string").option("multiLine", True).json(bodies).groupBy(F.col("id").alias("page_id")).agg(F.max("markdown").alias("markdown"))
    return out.join(texts, "page_id", "left")


def by_keys(rows: DataFrame, keys: DataFrame, column: str = "issue_key") -> DataFrame:
    """The rows of a stated set of keys, whatever their case."""
    asked = keys.select(F.upper(F.trim("key")).alias("_k")).distinct()
    return rows.withColumn("_k", F.upper(F.trim(column))).join(asked, "_k", "left_semi").drop("_k")


# --- trees, histories and blocks ------------------------------------------------

# Kinds of blocks of a page, and what stands before their text.
BLOCK_MARKS = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> "}
_RICH = "array<struct<plain_text:string>>"
_BODY = f"rich_text:{_RICH},checked:boolean,language:string,title:string,cells:array<{_RICH}>,url:string,caption:{_RICH}"


def files(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), max_bytes: int = 1_000_000) -> DataFrame:
    """``(path, size, content)``: the files of a tree with one of the extensions (any by default) up to a size.

    Extension and size are decided before a body is read.
    """
    tree = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= max_bytes)
    if extensions:
        tree = tree.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions]))
    return tree.select("path", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def newest_commits(commits: DataFrame, most: int, empty_first: bool = False) -> DataFrame:
    """Each repository's ``most`` newest commits without empty messages, and whether it has ``more``.

    Empty messages are dropped after the cut, or before it with ``empty_first``.
    Repositories are cut by a top-k, so one of any size sends that many rows.
    """
    said = F.trim(F.coalesce("message", F.lit(""))) != ""
    pool = commits.where(said) if empty_first else commits
    near = Window.partitionBy("repository").orderBy(F.col("at").desc_nulls_last(), F.col("sha").desc())
    kept = pool.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= most)
    more = pool.groupBy("repository").agg((F.count(F.lit(1)) > most).alias("more"))
    return kept.where(said).drop("_r").join(more, "repository")


def with_diffstats(commits: DataFrame, changed: DataFrame) -> DataFrame:
    """Commits with their changed files as an array; those without any get an empty one."""
    lists = changed.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("path", "old_path", "status", "lines_added", "lines_removed"))).alias("files"))
    none = F.array().cast(dict(lists.dtypes)["files"])
    return commits.join(lists, "sha", "left").withColumn("files", F.coalesce("files", none))


def newest_requests(requests: DataFrame, states: tuple[str, ...], most: int) -> DataFrame:
    """Each repository's ``most`` change requests of some states, updated last."""
    near = Window.partitionBy("repository").orderBy(F.col("updated_on").desc_nulls_last(), F.col("id").desc())
    return requests.where(F.upper("state").isin(*[s.upper() for s in states])).withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= most).drop("_r")


def blocks(rows: DataFrame) -> DataFrame:
    """``(page_id, position, line)``: blocks ``(page_id, position, type, body)`` as lines of markdown; empty ones have none.

    ``body`` is the JSON of a block's payload, whatever its kind.
    """
    b = F.from_json("body", f"struct<{_BODY}>")
    joined = lambda rich: F.array_join(F.transform(rich, lambda t: F.coalesce(t["plain_text"], F.lit(""))), "")
    text = F.coalesce(joined(b["rich_text"]), F.lit(""))
    caption = F.coalesce(joined(b["caption"]), F.lit(""))
    marked = F.when(text != "", F.concat(F.create_map(*[F.lit(v) for kv in BLOCK_MARKS.items() for v in kv])[F.col("type")], text))
    cells = F.array_join(F.transform(b["cells"], joined), " | ")
    link = F.when(F.coalesce(b["url"], F.lit("")) != "", F.concat(F.lit("["), F.when(caption != "", caption).otherwise(b["url"]), F.lit("]("), b["url"], F.lit(")"))).otherwise(caption)
    line = (
        F.when(F.col("type").isin(*BLOCK_MARKS), marked)
        .when(F.col("type") == "to_do", F.when(text != "", F.concat(F.when(b["checked"], "- [x] ").otherwise("- [ ] "), text)))
        .when(F.col("type") == "code", F.when(text != "", F.concat(F.lit("```"), F.coalesce(b["language"], F.lit("")), F.lit("\n"), text, F.lit("\n```"))))
        .when(F.col("type") == "divider", "---")
        .when(F.col("type") == "child_page", F.when(F.coalesce(b["title"], F.lit("")) != "", F.concat(F.lit("## "), b["title"])))
        .when(F.col("type") == "table_row", F.when(F.size(b["cells"]) > 0, F.concat(F.lit("| "), cells, F.lit(" |"))))
        .when(F.col("type").isin("bookmark", "embed", "link_preview"), link)
        .otherwise(text)
    )
    return rows.select("page_id", "position", line.alias("line")).where("line <> ''")


def page_texts(rows: DataFrame) -> DataFrame:
    """``(page_id, markdown)`` of blocks, in their order."""
    return blocks(rows).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, n)``: how many rows an export holds of each kind."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
