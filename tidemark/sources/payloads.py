"""Provider payloads to topics. A page is searched level by level, to whatever depth it has: the payload, objects
nested in it, and JSON texts in content blocks at any of these places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, distinct_tags, fill_title
from ..functions.times import parse_time

# Where topics lie, which objects are searched, the page address.
TOPIC_LISTS = ("topics", "topics_brief", "items", "list")
NESTED = ("resp_data", "data", "result")
BODIES = ("talk", "article", "question")
TOPIC_URL = "https://wx.zsxq.com/topic/"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _object(x: str, path: str) -> str:
    """The object at a path, NULL for anything else."""
    return f"CASE WHEN try_variant_get({x}, '{path}', 'map<string,variant>') IS NOT NULL THEN try_variant_get({x}, '{path}', 'variant') END"


def _text_at(x: str, path: str) -> str:
    """The string at a path, NULL for anything else."""
    return f"CASE WHEN schema_of_variant(try_variant_get({x}, '{path}', 'variant')) = 'STRING' THEN try_variant_get({x}, '{path}', 'string') END"


def _truth(x: str) -> str:
    """What a value of any kind means as a flag: empty and zero are false."""
    kind = f"regexp_extract(schema_of_variant({x}), '^[A-Z]+', 0)"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {kind} = 'BOOLEAN' THEN try_variant_get({x}, '$', 'boolean')"
            f" WHEN {kind} = 'VOID' THEN false WHEN {kind} = 'STRING' THEN try_variant_get({x}, '$', 'string') <> ''"
            f" WHEN {kind} IN ('OBJECT', 'ARRAY') THEN to_json({x}) NOT IN ('{{}}', '[]')"
            f" ELSE try_variant_get({x}, '$', 'double') <> 0 END")


def _list_in(x: str) -> str:
    """(list, more) of the first list in an object that may hold topics: empty, or with an item that has a `topic_id`."""
    picks = []
    for name in TOPIC_LISTS:
        values = f"try_variant_get({x}, '$.{name}', 'array<variant>')"
        picks.append(
            f"CASE WHEN {values} IS NOT NULL AND (size({values}) = 0"
            f" OR exists({values}, t -> try_variant_get(t, '$.topic_id', 'variant') IS NOT NULL))"
            f" THEN named_struct('list', {values}, 'more', try_variant_get({x}, '$.has_more', 'variant')) END")
    return f"coalesce({', '.join(picks)})"


def _children(x: str) -> str:
    """Objects to search next: nested ones, then the parsed texts of content blocks."""
    nested = ", ".join(_object(x, f"$.{name}") for name in NESTED)
    blocks = (f"transform(coalesce(try_variant_get({x}, '$.content', 'array<variant>'), array()),"
              f" c -> try_parse_json({_text_at('c', '$.text')}))")
    return f"concat(array_compact(array({nested})), filter({blocks}, b -> try_variant_get(b, '$', 'map<string,variant>') IS NOT NULL))"


def _search(v: str, text: str) -> tuple[Column, Column]:
    """(list with `more`, cursor) of a payload, each from the first object that has it, breadth first.

    One step per level. A level needs an object and an object a brace, so the braces of the text (also as an escape in
    a nested JSON text) bound the steps; steps beyond the last level find nothing to do.
    """
    hit = "struct<list: array<variant>, more: variant>"
    braces = f"length({text}) - length(replace({text}, '{{', '')) + regexp_count({text}, '(?i)u007b')"
    start = f"named_struct('now', array({v}), 'hit', CAST(NULL AS {hit}), 'cursor', CAST(NULL AS string))"
    step = (f"named_struct('now', flatten(transform(s.now, x -> {_children('x')})),"
            f" 'hit', coalesce(s.hit, get(filter(transform(s.now, x -> {_list_in('x')}), h -> h IS NOT NULL), 0)),"
            f" 'cursor', coalesce(s.cursor, get(filter(transform(s.now, x -> {_text_at('x', '$.next_end_time')}), c -> c <> ''), 0)))")
    found = f"aggregate(sequence(1, greatest(1, {braces})), {start}, (s, i) -> {step})"
    # Without a list anywhere, `topics` of the payload itself counts, whatever its items are.
    own = (f"named_struct('list', try_variant_get({v}, '$.topics', 'array<variant>'),"
           f" 'more', try_variant_get({v}, '$.has_more', 'variant'))")
    once = f"get(transform(array({found}), f -> named_struct('hit', coalesce(f.hit, {own}), 'cursor', f.cursor)), 0)"
    return F.expr(f"{once}.hit"), F.expr(f"{once}.cursor")


def normalize_payloads(payloads: DataFrame, now: str, page_size: int = 20, key: str = "page_id", column: str = "payload"
                       ) -> tuple[DataFrame, DataFrame]:
    """(topics, pages). Pages that report failure are rejected; topics without an id are dropped.

    `payloads` has one JSON text per page; `now` is the UTC time given to topics without
    one. A page is parsed once into a variant; everything after that is navigation.
    """
    parsed = payloads.select(F.col(key), F.col(column).alias("_text"), F.try_parse_json(column).alias("v"))
    v = F.col("v")
    hit, cursor = _search("v", "_text")
    failed = [F.coalesce(~_get(v, f"$.{flag}", "boolean"), F.lit(False)) for flag in ("succeeded", "ok")]
    found = parsed.select(key, (v.isNull() | failed[0] | failed[1]).alias("rejected"), hit.alias("hit"),
                          cursor.alias("cursor"))
    kept = F.when(~F.col("rejected"), F.col("hit.list"))
    listed = found.select(key, F.posexplode(kept).alias("pos", "t"))
    n = F.coalesce(F.size(kept), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    pages = found.select(key, "rejected", n.alias("topics"),
                         F.when(~F.col("rejected"), F.coalesce(F.expr(_truth("hit.more")), n >= page_size)).alias("has_more"),
                         "cursor")
    return _topics(listed, key, now), pages


def _topics(listed: DataFrame, key: str, now: str) -> DataFrame:
    t = F.col("t")

    def text(path: str) -> Column:
        return _get(t, f"$.{path}", "string")

    def filled(*columns: Column) -> Column:
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])

    bodies = [text(f"{b}.{part}") for b in BODIES for part in ("text", "content", "description")]
    body = F.coalesce(filled(*bodies, text("text"), text("content")), F.lit(""))
    people = [f"{parent}{role}" for parent in (*[f"{b}." for b in BODIES], "") for role in ("owner", "user")]
    author = F.coalesce(*[F.when(F.schema_of_variant(_get(t, f"$.{who}", "variant")).startswith("OBJECT"), F.coalesce(
        filled(text(f"{who}.name"), text(f"{who}.alias")), F.lit(""))) for who in people], F.lit(""))
    own, more = (_get(t, f"$.{name}", "array<variant>") for name in ("tags", "topic_tags"))
    tags = F.transform(F.when(F.size(own) > 0, own).otherwise(more), lambda x: F.when(
        F.schema_of_variant(x).startswith("OBJECT"), _get(x, "$.title", "string")).otherwise(_get(x, "$", "string")))
    rows = listed.select(
        key, "pos", filled(text("topic_id"), text("topic_uid")).alias("topic_id"), text("title").alias("_title"),
        body.alias("_body"), F.substring(author, 1, 200).alias("author"),
        parse_time(text("create_time"), F.lit(now).cast("timestamp")).alias("published_at"),
        distinct_tags(tags).alias("tags"), F.coalesce(text("group.group_id"), F.lit("")).alias("group_id"),
        F.coalesce(text("group.name"), F.lit("")).alias("group_name")).filter("topic_id IS NOT NULL")
    rows = rows.withColumns({"_title": clean_text(F.col("_title")), "content": clean_text(F.col("_body"))})
    return rows.select(key, "pos", "topic_id", fill_title(F.col("_title"), F.col("content")).alias("title"), "content",
                       "author", "published_at", F.concat(F.lit(TOPIC_URL), "topic_id").alias("source_url"), "tags",
                       "group_id", "group_name")


def page_cursors(pages: DataFrame, topics: DataFrame, page_size: int = 20, key: str = "page_id") -> DataFrame:
    """Where the next page starts: the page's own cursor, else its oldest topic minus 1 ms, Beijing time."""
    oldest = topics.groupBy(key).agg(F.min("published_at").alias("oldest"), F.count(F.lit(1)).alias("n"))
    local = F.from_utc_timestamp(F.col("oldest").cast("timestamp") - F.expr("INTERVAL '0.001' SECOND"), "Asia/Shanghai")
    text = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0800"))
    return pages.select(key, "cursor", "has_more").join(oldest, key, "left").select(
        key, F.coalesce("cursor", text).alias("next_end_time"),
        F.coalesce("has_more", F.coalesce("n", F.lit(0)) >= page_size).alias("has_more"))


def payload_shape(payloads: DataFrame, column: str = "payload", depth: int = 4) -> DataFrame:
    """Structure without values: (path, kind, list_length, payloads), to `depth` levels. Lists show
    their length and the shape of their first item."""
    nodes = payloads.select(F.lit("$").alias("path"), F.try_parse_json(column).alias("v"))
    levels = []
    for level in range(depth + 1):
        kind = F.regexp_extract(F.schema_of_variant("v"), r"^[A-Z]+", 0)
        typed = nodes.withColumn("kind", F.when(kind == "OBJECT", "object").when(kind == "ARRAY", "list")
                                 .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
                                 .when(kind == "VOID", "null").otherwise("number"))
        size = F.when(F.col("kind") == "list", F.json_array_length(F.to_json("v")))
        levels.append(typed.select("path", "kind", size.alias("list_length")))
        if level == depth:
            break
        inner = typed.filter("kind IN ('object', 'list')").lateralJoin(
            payloads.sparkSession.tvf.variant_explode(F.col("v").outer()))
        nodes = inner.filter("kind = 'object' OR pos = 0").select(
            F.when(F.col("kind") == "list", F.concat("path", F.lit("[0]")))
            .otherwise(F.concat("path", F.lit("."), "key")).alias("path"), F.col("value").alias("v"))
    every = reduce(lambda a, b: a.unionByName(b), levels)
    return every.groupBy("path", "kind", "list_length").agg(F.count(F.lit(1)).alias("payloads"))
