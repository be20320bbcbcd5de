"""Session settings and SQL functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..functions.lexicon import STOP_WORDS, Lexicon
from ..functions.text import SENTENCE_PATTERN, TOKEN_PATTERN, WORD_PATTERN
from ..operators import grammar


@dataclass(frozen=True)
class Settings:
    app: str = "lorebase"
    shuffle_partitions: int | None = None  #: None leaves it to the cluster
    time_zone: str = "UTC"


def session(settings: Settings = Settings()) -> SparkSession:
    builder = SparkSession.builder.appName(settings.app).config("spark.sql.session.timeZone", settings.time_zone).config("spark.sql.adaptive.enabled", "true")
    if settings.shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", settings.shuffle_partitions)
    return builder.getOrCreate()


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, lexicon: Lexicon | None = None) -> None:
    """SQL functions over texts. They are SQL themselves, so the optimizer sees through them.

    kb_grammar gives the entities of a text, each with its kind. With a lexicon, kb_stem and kb_semantic look words up in it as with_stem and with_semantic do: each
    becomes a left join with the lexicon, of whatever size, and not a call a row. A word that the lexicon holds more than once has its least stem or class.
    """
    stop = ", ".join(map(_quoted, STOP_WORDS))
    for name, kind, body in (
        ("kb_sentences", "ARRAY<STRING>", f"regexp_extract_all(t, {_quoted(SENTENCE_PATTERN)}, 0)"),
        ("kb_words", "ARRAY<STRING>", f"regexp_extract_all(lower(t), {_quoted(WORD_PATTERN)}, 0)"),
        ("kb_tokenize", "ARRAY<STRING>", f"regexp_extract_all(t, {_quoted(TOKEN_PATTERN)}, 0)"),
        ("kb_stop_word", "BOOLEAN", f"lower(t) IN ({stop})"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    compiled, _ = grammar.compile_rules()
    named = " ".join(f"WHEN e RLIKE {_quoted(f'^(?:{r.regex})$')} THEN {_quoted(r.name)}" for r in compiled if r.public)
    blank = _quoted("[ \\t\\r\\n\\x08]+")
    found = f"transform(regexp_extract_all(t, {_quoted(grammar.entity_regex(compiled, None))}, 0), e -> named_struct('entity', regexp_replace(e, {blank}, ' '), 'kind', CASE {named} END))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION kb_grammar(t STRING) RETURNS ARRAY<STRUCT<entity: STRING, kind: STRING>> RETURN {found}")
    if lexicon is None:
        return
    lexicon.stems.createOrReplaceTempView("kb_stems")
    lexicon.semantics.createOrReplaceTempView("kb_semantics")
    stem = "coalesce((SELECT min(s.stem) FROM kb_stems AS s WHERE s.word = lower(t)), lower(t))"
    of = lambda word: f"(SELECT min(s.semantic) FROM kb_semantics AS s WHERE s.word = {word})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION kb_stem(t STRING) RETURNS STRING RETURN {stem}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION kb_class(t STRING) RETURNS STRING RETURN {of('t')}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kb_semantic(t STRING) RETURNS STRING RETURN coalesce(kb_class(t), kb_class(kb_stem(t)), '')")
