"""Knowledge-base entries under schemas of their own, users, sessions and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.readers import upsert

SCHEMA_FIELDS = "struct<id:string,name:string,origin:string,field_list:array<struct<name:string,semantic:string,aiml:string>>>"


def entries(rows: DataFrame, topic: str, key: str, fields: list[str]) -> DataFrame:
    """Rows of any table as entries (id, topic, json_data), values as strings."""
    return rows.select(F.col(key).cast("string").alias("id"), F.lit(topic).alias("topic"), F.to_json(F.struct(*(F.col(f).cast("string").alias(f) for f in fields))).alias("json_data"))


def fields(entries_: DataFrame) -> DataFrame:
    """Entries with their fields as a map of strings; what isn't an object of strings is dropped."""
    return entries_.withColumn("fields", F.from_json("json_data", "map<string,string>")).where("fields is not null")


def schemas(entries_: DataFrame) -> DataFrame:
    """Schemas are entries of the topic schema."""
    return entries_.where("topic = 'schema'").select(F.from_json("json_data", SCHEMA_FIELDS).alias("s")).select("s.*").where("name is not null")


def page(entries_: DataFrame, topic: str, after: str | None, size: int) -> DataFrame:
    """The next entries of a topic behind an id."""
    rows = entries_.where(F.col("topic") == topic)
    return (rows.where(F.col("id") > after) if after else rows).orderBy("id").limit(size)


def rendered(entries_: DataFrame, schemas_: DataFrame) -> DataFrame:
    """id, topic, text: `field: value, ...` in the order of the schema that the topic names."""
    joined = fields(entries_).join(schemas_.select(F.col("name").alias("topic"), "field_list"), "topic")
    present = F.filter(F.col("field_list.name"), lambda n: F.col("fields")[n].isNotNull())
    return joined.select("id", "topic", F.array_join(F.transform(present, lambda n: F.concat(n, F.lit(": "), F.col("fields")[n])), ", ").alias("text"))


def as_sentences(entries_: DataFrame, schemas_: DataFrame) -> DataFrame:
    """Entries as one sentence each, of the values of their schema's fields, for the index: call_id, sentence_no, id, topic, tokenList."""
    joined = fields(entries_).join(schemas_.select(F.col("name").alias("topic"), "field_list"), "topic")
    values = F.filter(F.transform(F.filter(F.col("field_list.name"), lambda n: n != "id"), lambda n: F.col("fields")[n]), lambda v: v.isNotNull())
    tokens = T.drop_spaces(T.tokenize(F.array_join(values, " ")))
    none = F.lit("")
    token = lambda t, k: F.struct(k.alias("index"), F.array().cast("array<int>").alias("list"), none.alias("tag"), t.alias("text"), none.alias("dep"), F.lit(-1).alias("synid"), none.alias("semantic"))
    return joined.select(F.col("id").alias("call_id"), F.lit(0).alias("sentence_no"), "id", "topic", F.transform(tokens, token).alias("tokenList"))


def uploaded(lines: DataFrame, schemas_: DataFrame, schema: str) -> DataFrame:
    """Uploaded JSON lines (fields) as entries of a schema: only its fields stay, and an id that is no uuid gets a new one from the content."""
    uuid = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    known = lines.withColumn("topic", F.lit(schema)).join(schemas_.select(F.col("name").alias("topic"), F.col("field_list.name").alias("names")), "topic")
    kept = known.withColumn("kept", F.map_filter("fields", lambda k, _: F.array_contains("names", k)))
    digest = F.md5(F.to_json("fields"))
    fresh = F.concat_ws("-", *(F.substring(digest, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    old = F.lower(F.col("fields")["id"])
    return kept.select(F.when(old.rlike(uuid), old).otherwise(fresh).alias("id"), F.lit(schema).alias("topic"), F.to_json("kept").alias("json_data"))


def lexicon_of(entries_: DataFrame, schemas_: DataFrame) -> DataFrame:
    """word, semantic from the values of fields that have a semantic class, if they are plain names."""
    each = schemas_.select(F.col("name").alias("topic"), F.explode("field_list").alias("field")).select("topic", "field.name", "field.semantic").where("semantic <> ''")
    found = fields(entries_).join(each, "topic").select(F.col("fields")[F.col("name")].alias("word"), F.lower("semantic").alias("semantic"))
    return found.where(F.col("word").rlike(T.NAME)).distinct()


def new_users(rows: DataFrame) -> DataFrame:
    """(email, first_name, surname, salt, password) -> users, of valid addresses."""
    return rows.where(T.is_email(F.col("email"))).select("email", "first_name", "surname", "salt", T.password_hash(F.col("salt"), F.col("password")).alias("password_hash"))


def sign_in(users: DataFrame, attempts: DataFrame) -> DataFrame:
    """attempts (email, password, session) -> sessions of those whose password fits."""
    joined = attempts.join(users, "email").where(T.password_hash(F.col("salt"), F.col("password")) == F.col("password_hash"))
    return joined.select("email", "first_name", "surname", "session")


def sign_out(sessions: DataFrame, gone: DataFrame) -> DataFrame:
    """sessions without those that end (session)."""
    return sessions.join(gone.select("session").distinct(), "session", "left_anti").select(sessions.columns)


def remove_users(users: DataFrame, sessions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """users and sessions without those of the addresses (email)."""
    names = gone.select("email").distinct()
    return users.join(names, "email", "left_anti").select(users.columns), sessions.join(names, "email", "left_anti").select(sessions.columns)


def save_schemas(entries_: DataFrame, fresh: DataFrame) -> DataFrame:
    """entries with schemas (id, name, origin, field_list) in place of those of the same id."""
    made = fresh.select("id", F.lit("schema").alias("topic"), F.to_json(F.struct("id", "name", "origin", "field_list")).alias("json_data"))
    return upsert(entries_, made, ["topic", "id"])


def remove_schemas(entries_: DataFrame, ids: list[str]) -> DataFrame:
    return entries_.where(~((F.col("topic") == "schema") & F.col("id").isin(ids)))


def valid_requests(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests with a session that exists, and the topic of its user."""
    names = sessions.select("session", "email", T.display_name(F.col("first_name"), F.col("surname")).alias("user_topic"))
    return requests.join(names, "session")


def log_entries(rows: DataFrame) -> DataFrame:
    """(when, who, what) of audit entries; both texts must be there, and of those of one moment the last stays."""
    good = rows.where("who <> '' and what <> ''")
    return good.groupBy("when").agg(F.max_by(F.struct("who", "what"), F.struct("who", "what")).alias("x")).select("when", "x.who", "x.what")
