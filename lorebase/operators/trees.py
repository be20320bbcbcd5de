"""Dependency trees: parent links, binary trees with numbered subtrees, text and DOT renderings of a sentence, merging of compounds."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import render_tokens


def parents(sentences: DataFrame) -> DataFrame:
    """sentences (id, tokenList) -> id, child, parent, text, dep: the first ancestor of each token that isn't itself and is in the sentence; null for a root."""
    rows = sentences.select("id", F.explode("tokenList").alias("token")).select("id", F.col("token.index").alias("child"), "token.text", "token.dep", F.col("token.list").alias("ancestors"))
    known = rows.groupBy("id").agg(F.collect_set("child").alias("known"))
    first = F.try_element_at(F.filter("ancestors", lambda a: (a != F.col("child")) & F.array_contains("known", a)), F.lit(1))
    return rows.join(known, "id").select("id", "child", first.alias("parent"), "text", "dep")


def flat(tokens: Column) -> Column:
    """[text:dep ...] of the tokens in order."""
    return F.concat(F.lit("["), F.array_join(F.transform(tokens, lambda t: F.concat(t["text"], F.lit(":"), t["dep"])), " "), F.lit("]"))


def by_verbs(tokens: Column) -> Column:
    """Verbs stand out as _verb{TAG}_, what is left and right of each in brackets."""
    word = F.transform(tokens, lambda t: F.when(t["tag"].startswith("VB"), F.concat(F.lit(") _"), t["text"], F.lit("{"), t["tag"], F.lit("}_ ("))).otherwise(F.concat(t["text"], F.lit(":"), t["dep"], F.lit(" "))))
    return F.regexp_replace(F.concat(F.lit("("), F.array_join(word, ""), F.lit(")")), r" \)", ")")


def dot(tokens: Column) -> Column:
    """A digraph in DOT: a node for each token, an edge from its nearest other ancestor."""
    node = F.transform(tokens, lambda t: F.concat(F.lit("n"), t["index"].cast("string"), F.lit(' [label="'), F.replace(t["text"], F.lit('"'), F.lit('\\"')), F.lit('"];')))
    near = lambda t: F.try_element_at(F.filter(t["list"], lambda a: a != t["index"]), F.lit(1))
    edges = F.transform(F.filter(tokens, lambda t: near(t).isNotNull()), lambda t: F.concat(F.lit("n"), near(t).cast("string"), F.lit(" -> n"), t["index"].cast("string"), F.lit(' [label="'), F.coalesce(t["dep"], F.lit("")), F.lit('"];')))
    return F.concat(F.lit("digraph sentence { "), F.array_join(F.concat(node, edges), " "), F.lit(" }"))


def _numbers(indexes: list[int], over: list[int | None]) -> list[list[int] | None]:
    """at, first, last, depth of each token in the tree; None for tokens that don't hang on its root. `over` is -1 for tokens without ancestors, None for those without another."""
    place = {x: k for k, x in enumerate(indexes)}
    left, right, tail = {}, {}, {}
    roots = [k for k, x in enumerate(over) if x == -1]
    linked = {}  # whether a token's parents lead to a token without ancestors
    for k in range(len(indexes)):
        path, now = [], k
        while now is not None and now not in linked:
            linked[now] = over[now] == -1
            path.append(now)
            now = place.get(over[now]) if over[now] is not None and over[now] != -1 else None
        for x in path:
            linked[x] = linked[path[-1]] if now is None else linked[now]
    for k, x in enumerate(indexes):
        if place[x] != k or not linked[k] or over[k] == -1:
            continue
        parent = place[over[k]]
        # If all turns of the last way down from here were right turns and it ended before x, this way begins with it.
        now, straight = parent, True
        if parent in tail and indexes[tail[parent]] < x:
            now = tail[parent]
        while now != k:
            side = left if x < indexes[now] else right
            straight &= side is right
            now = side.setdefault(now, k)
        if straight:
            tail[parent] = k
    out: list[list[int] | None] = [None] * len(indexes)
    stack, n, depths = ([(roots[-1], 0, False)] if roots else []), 0, {}
    while stack:
        k, depth, seen = stack.pop()
        if not seen:
            depths[k] = depth
            stack += [(right[k], depth + 1, False)] if k in right else []
            stack.append((k, depth, True))
            stack += [(left[k], depth + 1, False)] if k in left else []
        else:
            out[k] = [n, n, n, depth]
            n += 1
    for k in sorted(depths, key=depths.get, reverse=True):
        if k in left:
            out[k][1] = out[left[k]][1]
        if k in right:
            out[k][2] = out[right[k]][2]
    return out


@pandas_udf(ArrayType(ArrayType(IntegerType())))
def _numbered(indexes: pd.Series, lists: pd.Series) -> pd.Series:
    near = lambda k, over: next((a for a in over if a != k), None) if over is not None and len(over) else -1
    return pd.Series([None if a is None else _numbers(list(a), [near(k, over) for k, over in zip(a, b, strict=True)]) for a, b in zip(indexes, lists, strict=True)], dtype=object)


def tree(tokens: Column) -> Column:
    """The binary tree of a sentence, by place in it: at, first, last, depth, token of each node.

    A token hangs on its nearest other ancestor: left of it if its index is smaller, right of it if it is greater, and where that side is taken, on the token there by
    the same rule. The root is the last token without ancestors. Nodes are numbered from 0, left sides before their node and right sides behind it, so that a
    subtree is the range from first to last, and its left side what is before at. Tokens whose parents lead to no root, or to another one, are left out; of tokens
    with one index the last counts. Without a root, the tree is empty; null tokens give null.
    """
    # The arguments have no lambdas: with them, some plans did not take the call out to Python.
    numbers = _numbered(tokens["index"], tokens["list"])
    nodes = F.transform(F.arrays_zip(tokens.alias("token"), numbers.alias("n")), lambda x: F.struct(x["n"][0].alias("at"), x["n"][1].alias("first"), x["n"][2].alias("last"), x["n"][3].alias("depth"), x["token"].alias("token")))
    return F.array_sort(F.filter(nodes, lambda x: x["at"].isNotNull()), lambda a, b: a["at"] - b["at"])


def subtree(nodes: Column, index: Column) -> Column:
    """The tokens of the subtree under the token with an index, in the order of the tree."""
    top = F.try_element_at(F.filter(nodes, lambda x: x["token"]["index"] == index), F.lit(1))
    return F.when(top.isNotNull(), F.transform(F.slice(nodes, top["first"] + 1, top["last"] - top["first"] + 1), lambda x: x["token"])).otherwise(F.transform(F.slice(nodes, 1, 0), lambda x: x["token"]))


def _word(t: Column) -> Column:
    return render_tokens(F.array(t))


def tree_flat(nodes: Column) -> Column:
    """[text{role}:dep] of each node; a role is a semantic, or the label of a subject or object."""
    return F.array_join(F.transform(nodes, lambda x: F.concat(F.lit("["), _word(x["token"]), F.lit(":"), F.coalesce(x["token"]["dep"], F.lit("")), F.lit("]"))), " ")


def tree_by_verbs(nodes: Column) -> Column:
    """_verb{TAG}_ (left side | right side) of each verb, verbs in the sides likewise; other nodes as text{role}. A verb without a left side has no bar."""
    verb = lambda x: F.coalesce(x["token"]["tag"].startswith("VB"), F.lit(False))
    piece = lambda at, kind, depth, text: F.struct(at.alias("at"), F.lit(kind).alias("kind"), depth.alias("depth"), text.alias("text"))
    # Control characters stand for brackets and bars until the spaces around them are gone.
    opened = lambda x: piece(x["first"], 0, x["depth"], F.concat(F.lit("_"), x["token"]["text"], F.lit("{"), x["token"]["tag"], F.lit("}_ \x01")))
    bar = lambda x: piece(x["at"], 1, F.lit(0), F.when(x["first"] < x["at"], "\x02").otherwise(""))
    closed = lambda x: piece(x["last"], 2, -x["depth"], F.lit("\x03"))
    pieces = F.flatten(F.transform(nodes, lambda x: F.when(verb(x), F.array(opened(x), bar(x), closed(x))).otherwise(F.array(piece(x["at"], 1, F.lit(0), F.concat(_word(x["token"]), F.lit(" ")))))))
    text = F.array_join(F.transform(F.sort_array(pieces), lambda x: x["text"]), "")
    for mark, said in ((r"\s*\x03", ")"), (r"\s*\x02\s*", " | "), (r"\x01\s*", "(")):
        text = F.regexp_replace(text, mark, said)
    return F.trim(text)


def _spans(keyed: DataFrame, compounds: DataFrame, most: int, firsts: list[str] | None) -> DataFrame:
    """keyed (_of, words: in lower case) -> _of, _spans: places and lengths of the compounds that stay."""
    known = compounds.select(F.lower("compound").alias("compound")).where("compound like '% %'").distinct()
    starts = known.select(F.substring_index("compound", " ", 1).alias("first"), (F.length("compound") - F.length(F.replace("compound", F.lit(" "), F.lit(""))) + 1).alias("words"))
    starts = starts.groupBy("first").agg(F.least(F.max("words"), F.lit(most)).alias("longest"))
    ahead = F.transform("words", lambda t, k: F.slice("words", k + 1, most))
    tokens = keyed.select("_of", F.posexplode(ahead).alias("pos", "words")).withColumn("first", F.substring_index(F.col("words")[0], " ", 1)).where("size(words) > 1")
    if firsts is not None:
        tokens = tokens.where(F.col("first").isin(firsts))
    tried = tokens.join(starts, "first").where("longest > 1").select("_of", "pos", "words", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least("longest", F.size("words"))))).alias("n"))
    hits = tried.select("_of", "pos", "n", F.array_join(F.slice("words", F.lit(1), F.col("n")), " ").alias("compound")).join(known, "compound", "left_semi").groupBy("_of", "pos").agg(F.max("n").alias("n"))
    spans = hits.groupBy("_of").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("spans"))
    # From left to right, drop spans that begin inside the one before.
    start = F.struct(F.array().cast("array<struct<pos:int,n:int>>").alias("out"), F.lit(0).alias("end"))
    step = lambda s, x: F.when(x["pos"] < s["end"], s).otherwise(F.struct(F.array_append(s["out"], x).alias("out"), (x["pos"] + x["n"]).alias("end")))
    return spans.select("_of", F.aggregate("spans", start, step, lambda s: s["out"]).alias("_spans"))


def merge_longest(sentences: DataFrame, compounds: DataFrame, most: int = 5, firsts: list[str] | None = None, token: Callable[[Column], Column] | None = None) -> DataFrame:
    """Merge compounds: id, tokenList with each longest run of two to `most` tokens whose text is a compound as one token, headed by its first noun. Ancestors that
    went into a compound are replaced by its head; a token is no ancestor of its own.

    Of compounds that overlap, the one that begins first stays, and of those with one beginning the longest. Only words with which a compound begins are looked at,
    with the few words behind them; the sentence itself meets its compounds once, and is put together from its runs between them. Rows may share an id or have none.
    A caller that knows the few words, in lower case, with which all compounds begin says them as `firsts`, so that no others are looked at. With `token`, which makes tokens out of words,
    sentences have `words` instead of a tokenList; these travel, and become tokens behind the meeting.
    """
    texts = F.col("words") if token else F.col("tokenList.text")
    keyed = sentences.withColumn("_of", F.struct(F.xxhash64(F.col("id").cast("string"), texts).alias("a"), F.hash(texts, F.col("id").cast("string")).alias("b")))
    chosen = _spans(keyed.select("_of", F.transform(texts, F.lower).alias("words")), compounds, most, firsts)
    joined = keyed.join(chosen, "_of", "left")
    if token:
        joined = joined.withColumn("tokenList", token(F.col("words")))
    columns = ["tokenList" if token and c == "words" else c for c in sentences.columns]
    all_tokens, spans_ = F.col("tokenList"), F.col("_spans")

    def part_of(span: Column) -> Column:
        return F.slice(all_tokens, span["pos"] + 1, span["n"])

    def made(span: Column) -> Column:
        part = part_of(span)
        head = F.coalesce(F.get(F.filter(part, lambda x: x["tag"].startswith("NN")), F.lit(0)), F.get(part, F.lit(0)))
        return F.struct(head.withField("text", F.array_join(F.transform(part, lambda x: x["text"]), " ")).alias("token"), F.transform(part, lambda x: x["index"]).alias("members"), span["pos"].alias("pos"), (span["pos"] + span["n"]).alias("end"))

    def upto(first: Column, end: Column) -> Column:
        return F.slice(all_tokens, first + 1, end - first)

    def behind(x: Column, k: Column) -> Column:
        return F.concat(F.array(x["token"]), upto(x["end"], F.coalesce(F.get(F.col("_made"), k + 1)["pos"], F.size(all_tokens))))

    def mapped(t: Column) -> Column:
        head = lambda a: F.get(F.filter(F.col("_made"), lambda x: F.array_contains(x["members"], a)), F.lit(0))["token"]["index"]
        over = F.transform(t["list"], lambda a: F.coalesce(head(a), a))
        return t.withField("list", F.filter(F.array_distinct(over), lambda a: a != t["index"]))

    put = F.concat(upto(F.lit(0), spans_[0]["pos"]), F.flatten(F.transform("_made", behind)))
    out = joined.withColumn("_made", F.transform(spans_, made)).withColumn("_put", put)
    return out.withColumn("tokenList", F.when(spans_.isNotNull(), F.transform("_put", mapped)).otherwise(all_tokens)).select(*columns)
