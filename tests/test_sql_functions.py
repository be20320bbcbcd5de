"""SQL functions against the operators that they stand for."""

from pyspark.sql import functions as F

from lorebase.functions.lexicon import Lexicon
from lorebase.operators import grammar
from lorebase.plans import settings


def lexicon_of(spark):
    pairs = lambda names, *rows: spark.createDataFrame(list(rows), ", ".join(f"{n} string" for n in names))
    return Lexicon(pairs(("word", "stem"), ("cats", "cat"), ("ran", "run")), pairs(("word", "semantic"), ("cat", "animal"), ("Paris", "city")), pairs(("word", "synonym"), ("a", "b")), pairs(("compound",), ("x y",)))


def test_stems_and_semantics_as_by_joins(spark):
    lexicon = lexicon_of(spark)
    settings.register(spark, lexicon)
    words = spark.createDataFrame([(w,) for w in ("Cats", "cat", "RAN", "Paris", "paris", "", "nothing", None)], "word string")
    words.createOrReplaceTempView("words")
    made = spark.sql("SELECT word, kb_stem(word) AS stem, kb_semantic(word) AS semantic FROM words")
    wanted = lexicon.with_semantic(lexicon.with_stem(words, "word"), "word", "stem").select("word", "stem", "semantic")
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows.collect())
    assert key(made) == key(wanted) and ("Cats", "cat", "animal") in key(made)


def test_grammar_as_by_entities(spark):
    settings.register(spark)
    said = [(1, "on March 5,2012 at 10:20:30, then"), (2, "pay $20 to me@there.org or see http://a.org/x"), (3, "nothing"), (4, ""), (5, None), (6, "call 123-456-7890   today, 5% off")]
    rows = spark.createDataFrame(said, "k long, t string")
    rows.createOrReplaceTempView("said")
    made = spark.sql("SELECT k, e.entity, e.kind FROM (SELECT k, explode(g) AS e FROM (SELECT k, kb_grammar(t) AS g FROM said))")
    key = lambda rows: sorted((r.k, r.entity, str(r.kind)) for r in rows.collect())
    assert key(made) == key(grammar.entities(rows, "k", "t")) and made.count() > 4
    assert made.select(F.col("k")).distinct().count() == 3
