"""Scans of the file formats, and the parquet store's sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEMPLATE_XML = "pattern array<string>, template string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and file of each line of a text file or glob."""
    return spark.read.text(path).select("value", F.input_file_name().alias("file"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file and number. Whole small files are split, so the order within a file is certain."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("number", "value"))


def plurals(rows: DataFrame) -> DataFrame:
    """Lines singular|plural -> word, stem."""
    parts = F.split(F.trim("value"), r"\|")
    return rows.where(F.size(parts) == 2).select(F.lower(parts[1]).alias("word"), F.lower(parts[0]).alias("stem"))


def verbs(rows: DataFrame) -> DataFrame:
    """Lines base|form|form... of six columns or more -> word, stem for each form that differs from its base."""
    parts = F.split(F.trim("value"), r"\|")
    forms = rows.where(F.size(parts) >= 6).select(F.lower(parts[0]).alias("stem"), F.explode(parts).alias("form"))
    return forms.select(F.lower("form").alias("word"), "stem").where("word <> stem and word <> ''").distinct()


def synonym_groups(rows: DataFrame) -> DataFrame:
    """Lines w1,w2,... -> words."""
    words = F.filter(F.transform(F.split("value", ","), lambda w: F.trim(w)), lambda w: w != "")
    return rows.select(words.alias("words")).where(F.size("words") > 1)


def semantics(rows: DataFrame) -> DataFrame:
    """Numbered lines word:semantic -> word, semantic; the last line of the last file wins. A word keeps its case."""
    parts = F.split(F.trim("value"), ":")
    found = rows.where(F.size(parts) == 2).select(F.trim(parts[0]).alias("word"), F.lower(F.trim(parts[1])).alias("semantic"), "file", "number")
    return found.where("word <> ''").groupBy("word").agg(F.max_by("semantic", F.struct("file", "number")).alias("semantic"))


def replay_updates(entries: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply numbered lines op|origin|word:semantic, in order, to entries (word, semantic). The last operation on a word decides."""
    parts = F.split(F.trim("value"), r"\|")
    pair = F.split(parts[2], ":")
    found = updates.where((F.size(parts) == 3) & parts[0].isin("del", "save") & (F.size(pair) == 2))
    last = found.groupBy(pair[0].alias("word")).agg(F.max_by(F.struct(parts[0].alias("op"), F.lower(pair[1]).alias("semantic")), F.struct("file", "number")).alias("last"))
    return entries.join(last, "word", "left_anti").select("word", "semantic").union(last.where("last.op = 'save'").select("word", "last.semantic"))


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Template XML: <category> of patterns and one template, whose alternatives | splits -> pattern, origin, templates."""
    read = spark.read.format("xml").option("rowTag", "category").schema(TEMPLATE_XML).load(path)
    alternatives = F.filter(F.transform(F.split("template", r"\|"), lambda t: F.trim(t)), lambda t: t != "")
    origin = F.concat(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), F.lit(" module"))
    return read.select(F.explode("pattern").alias("pattern"), origin.alias("origin"), alternatives.alias("templates"))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Lines word f f ... -> text, vector; a number that can't be read is 0. Vectors of different widths are an error."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) > 1).select(parts[0].alias("text"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))).alias("vector"))
    widths = rows.select(F.size("vector").alias("n")).distinct().limit(2).count()
    if widths > 1:
        raise ValueError("vectors differ in width")
    return rows


def access_templates(rows: DataFrame) -> DataFrame:
    """Lines predicate,w5h base:tag ...,... -> predicate, w5h, components (base, tag), place."""
    parts = F.split("value", ",")
    items = rows.where(F.size(parts) > 1).select(F.trim(parts[0]).alias("predicate"), F.posexplode(F.slice(parts, 2, F.size(parts))).alias("place", "item"), *[c for c in ("file", "number") if c in rows.columns])
    words = F.split(F.trim("item"), " ")
    pairs = F.transform(F.slice(words, 2, F.size(words)), lambda w: F.struct(F.split(w, ":")[0].alias("base"), F.split(w, ":")[1].alias("tag")))
    return items.withColumn("w5h", F.lower(words[0])).withColumn("components", pairs).where(F.size("components") > 0).drop("item")


def json_lines(rows: DataFrame) -> DataFrame:
    """Lines { ... } -> fields, a map of strings; other lines and those that can't be read are dropped."""
    line = F.trim("value")
    return rows.where(line.startswith("{") & line.endswith("}")).select(F.from_json(line, "map<string,string>").alias("fields")).where("fields is not null")


def parser_reply(replies: DataFrame, column: str) -> DataFrame:
    """JSON replies of a parser -> sentence_list; HTML replies are errors and come out as null."""
    from ..schema import TOKEN

    read = F.from_json(column, f"struct<num_sentences:int,processing_time:long,num_tokens:int,sentence_list:array<array<{TOKEN}>>>")
    return replies.withColumn("sentence_list", F.when(~F.trim(F.col(column)).startswith("<"), read["sentence_list"]))


def select_page(rows: DataFrame, columns: list[str] | None = None, where: dict[str, object] | None = None, after: tuple[str, object] | None = None, size: int = 0) -> DataFrame:
    """Scan with equality tests, and a page after a key, by that key, of `size` rows. An empty `after` value starts at the first page."""
    out = rows
    for name, value in (where or {}).items():
        out = out.where(F.col(name) == F.lit(value))
    if after:
        name, value = after
        out = (out if value in (None, "", "null") else out.where(F.col(name) > F.lit(value))).orderBy(name)
    if size > 0:
        out = out.limit(size)
    return out.select(*columns) if columns else out


def upsert(rows: DataFrame, fresh: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """rows with fresh ones in place of those with the same key. `order` says which of several fresh rows of one key came last."""
    last = fresh
    if order:
        last = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return rows.join(last.select(*key).distinct(), key, "left_anti").unionByName(last, allowMissingColumns=True)


def delete(rows: DataFrame, where: dict[str, object]) -> DataFrame:
    """rows without those that meet all tests; a null never meets one."""
    test = F.lit(True)
    for name, value in where.items():
        test &= F.col(name).eqNullSafe(F.lit(value))
    return rows.where(~test)


def save(rows: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = rows.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
