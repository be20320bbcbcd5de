"""Question templates with wildcards: patterns as a trie, whose edges are a table that questions walk by joins."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

ROOT = "\x1f"  #: path of the trie's root; a node is the hash of its path
SMALL = 1_000_000  #: edges of a trie that are broadcast; a larger one is met by shuffles


def expand(pattern: str) -> list[str]:
    """All forms of a pattern with alternatives (a|b|); an empty alternative may stand anywhere in the brackets."""
    parts = re.split(r"\(([^()]*)\)", pattern)
    if pattern.count("(") != pattern.count(")") or pattern.count("(") != len(parts) // 2:
        raise ValueError(f"brackets of {pattern!r}")
    choices = [p.split("|") if k % 2 else [p] for k, p in enumerate(parts)]
    return [" ".join("".join(c).split()) for c in product(*choices)]


@dataclass(frozen=True)
class Rules:
    """A trie: edges (parent, token, child, star, final) with the child that * leads to from there, or null, and whether it has templates; templates (node, rank,
    origin, template)."""

    edges: DataFrame
    templates: DataFrame
    depth: int  #: tokens of the longest pattern
    small: bool


def compile_templates(spark: SparkSession, categories: list[tuple[str, str, list[str]]]) -> Rules:
    """Categories (pattern, origin, templates) as rules. The rank of a template is its place among all of them."""
    return compile_rules(spark.createDataFrame([(k, *c) for k, c in enumerate(categories)], "place long, pattern string, origin string, templates array<string>"))


def compile_rules(categories: DataFrame) -> Rules:
    """Rules of a table (place, pattern, origin, templates) of any size.

    A pattern has two tokens or more and doesn't begin with *. Patterns that are alike after expansion share a node, and all their templates count. A node's id is a hash of its path, so the
    trie is built without counting nodes, by one row for each prefix of each pattern.
    """
    forms = categories.select("place", "origin", "templates", F.posexplode(F.udf(expand, "array<string>")("pattern")).alias("form", "text"))
    tokens = T.drop_punctuation(T.drop_spaces(T.raw_tokens(F.lower("text"))))
    words = forms.select("place", "form", "origin", "templates", tokens.alias("words")).where((F.size("words") > 1) & (F.col("words")[0] != "*"))
    path = lambda upto: F.xxhash64(F.array_join(F.slice("words", F.lit(1), upto), " ")) if not isinstance(upto, int) else F.xxhash64(F.lit(ROOT))
    steps = words.select(F.posexplode("words").alias("at", "token"), "words", F.size("words").alias("n"))
    steps = steps.select(F.when(F.col("at") == 0, path(0)).otherwise(path(F.col("at"))).alias("parent"), "token", path(F.col("at") + 1).alias("child"), (F.col("at") + 1 == F.col("n")).alias("final"), "n")
    nodes = steps.groupBy("parent", "token", "child").agg(F.max("final").alias("final"), F.max("n").alias("n"))
    stars = nodes.where("token = '*'").select(F.col("parent").alias("child"), F.col("child").alias("star"))
    edges = nodes.join(stars, "child", "left").select("parent", "token", "child", "star", "final", "n")
    ends = words.select(path(F.size("words")).alias("node"), "place", "form", "origin", F.posexplode("templates").alias("k", "template"))
    facts = edges.agg(F.max("n"), F.count("*")).first()
    rank = F.struct("place", "form", "k").alias("rank")
    return Rules(edges.drop("n"), ends.select("node", rank, "origin", "template"), facts[0] or 0, facts[1] <= SMALL)


def schema_patterns(schemas: DataFrame) -> DataFrame:
    """Each line of a field's patterns with the template that searches that field: pattern, origin, templates."""
    each = schemas.select("name", "origin", F.explode("field_list").alias("field"))
    lines = each.select("name", "origin", F.col("field.name").alias("field"), F.explode(F.split("field.aiml", "\r?\n")).alias("line"))
    return lines.where(F.trim("line") != "").select(F.trim("line").alias("pattern"), "origin", F.array(F.concat_ws(":", F.lit("db_search"), "name", "field")).alias("templates"))


def match(questions: DataFrame, rules: Rules) -> DataFrame:
    """questions (query_id, text) -> query_id, rank, origin, template, star: a row for each template that matches, with the texts of all its * in their order.

    The first token must be a word of a pattern. From a node, both ways are taken: the next token's own edge, and *. A * takes tokens, maybe none, up to the first one with which
    a pattern goes on behind it, and from there only that way is left; if there is none it takes all that is left. Where tokens end at a node, its templates match, or else, if it has none,
    those of * behind it, which is then empty; a word that a * has led to must have templates of its own.

    Each round takes all states one node on: one join with the edges, and one grouping within the question. Questions are dealt once; a trie of at most SMALL edges is broadcast.
    """
    tokens = F.transform(T.drop_punctuation(T.drop_spaces(T.tokenize(F.col("text")))), F.lower)
    asked = questions.select("query_id", tokens.alias("tokens")).where(F.size("tokens") > 0).distinct()
    edges = F.broadcast(rules.edges) if rules.small else rules.edges
    first = rules.edges.where(F.col("parent") == F.xxhash64(F.lit(ROOT)))
    rows = asked.withColumn("token", F.col("tokens")[0]).join(F.broadcast(first) if rules.small else first, "token")
    rows = rows.select("query_id", "tokens", F.col("child").alias("node"), "star", "final", F.lit(1).alias("at"), F.array().cast("array<string>").alias("said"), F.lit(None).cast("long").alias("end"))
    rows = rows.repartition("query_id")
    rest = F.size("tokens") - F.col("at")
    nothing = F.lit(None).cast("long")
    ways = F.array(F.struct(F.col("node").alias("parent"), F.lit(False).alias("wild")), F.struct(F.col("star").alias("parent"), F.lit(True).alias("wild")))
    for _ in range(rules.depth):
        # What has ended goes through as it is; an end that says nothing is dropped.
        closed = F.when((rest == 0) & F.col("end").isNull(), F.when(F.col("final"), F.col("node")).otherwise(F.col("star"))).otherwise(F.col("end"))
        rows = rows.withColumn("end", closed).where(F.col("end").isNotNull() | (rest > 0))
        ways_on = F.when(F.col("end").isNotNull(), F.array(F.struct(nothing.alias("parent"), F.lit(False).alias("wild")))).otherwise(F.filter(ways, lambda w: w["parent"].isNotNull()))
        moved = rows.select("query_id", "tokens", "at", "said", "end", F.explode(ways_on).alias("way")).select("query_id", "tokens", "at", "said", "end", "way.*")
        ahead = F.when(F.col("wild"), F.slice("tokens", F.col("at") + 1, rest)).when(F.col("end").isNull(), F.slice("tokens", F.col("at") + 1, F.lit(1))).otherwise(F.array(F.lit(None).cast("string")))
        each = moved.select("*", F.posexplode(ahead).alias("k", "token"))
        met = each.join(edges, ["parent", "token"], "left")
        hit = F.struct("k", "child", "star", "final")
        met = met.groupBy("query_id", "tokens", "at", "said", "end", "parent", "wild").agg(F.min(F.when(F.col("child").isNotNull(), hit)).alias("hit"))
        last = F.col("hit.k") + F.col("at") + 1
        taken = F.array_join(F.slice("tokens", F.col("at") + 1, F.coalesce(F.col("hit.k"), rest)), " ")
        said = F.when(F.col("wild"), F.concat("said", F.array(taken))).otherwise(F.col("said"))
        through = F.col("wild") & (last == F.size("tokens"))
        end = F.when(F.col("end").isNotNull(), F.col("end")).when(F.col("wild") & F.col("hit").isNull(), F.col("parent")).when(through & F.col("hit.final"), F.col("hit.child"))
        # A literal way without an edge, and a * that ends on a word without templates, lead nowhere.
        alive = F.col("end").isNotNull() | F.when(F.col("wild"), F.col("hit").isNull() | ~through | F.col("hit.final")).otherwise(F.col("hit").isNotNull())
        rows = met.where(alive).select("query_id", "tokens", F.col("hit.child").alias("node"), F.col("hit.star").alias("star"), F.coalesce("hit.final", F.lit(False)).alias("final"), F.coalesce(last, F.col("at")).alias("at"), said.alias("said"), end.alias("end"))
    closed = F.when((rest == 0) & F.col("end").isNull(), F.when(F.col("final"), F.col("node")).otherwise(F.col("star"))).otherwise(F.col("end"))
    ended = rows.select("query_id", closed.alias("node"), F.trim(F.array_join(F.filter("said", lambda x: x != ""), " ")).alias("star")).where("node is not null")
    return ended.join(rules.templates, "node").select("query_id", "rank", "origin", "template", "star")


def searched_text(template: Column, star: Column) -> Column:
    """What a template {search:a,*,b} looks for: its parts in their order, * standing for the question's own words; null for other templates."""
    inner = F.regexp_extract(template, r"^\{search:(.*)\}$", 1)
    said = F.array_join(F.transform(F.split(inner, ","), lambda p: F.when(F.trim(p) == "*", star).otherwise(F.trim(p))), " ")
    return F.when(inner != "", F.trim(said))


def pick(matches: DataFrame) -> DataFrame:
    """One of the templates of each question, by a hash of the question, so that a rerun answers alike."""
    all_ = matches.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("rank", "origin", "template", "star"))).alias("all"))
    one = F.col("all")[F.pmod(F.xxhash64("query_id"), F.size("all")).cast("int")]
    return all_.select("query_id", one["origin"].alias("origin"), one["template"].alias("template"), one["star"].alias("star"))


def fill(template: Column, star: Column, now: Column, email: Column) -> Column:
    """The template with its magic values; `now` is a timestamp, so that a rerun answers alike."""
    values = {
        "{stats}": F.lit("system statistics: todo"),
        "{year}": F.date_format(now, "yyyy"),
        "{day}": F.date_format(now, "EEEE"),
        "{month}": F.date_format(now, "MMMM"),
        "{time}": F.date_format(now, "h:mma"),
        "{date}": F.date_format(now, "EEEE, dd-MMM-yy HH:mm:ss z"),
        "{email}": F.concat(F.lit("your email address is "), email),
        "{name}": F.concat(F.lit("I can't tell you your name but your email address is "), email),
        "{star}": star,
    }
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit(name), F.coalesce(value, F.lit("")))
    return out
