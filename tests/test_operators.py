"""Operators on small fixtures of their own."""

import pytest
from pyspark.sql import functions as F

from lorebase import schema
from lorebase.functions import lexicon as L
from lorebase.functions import text as T
from lorebase.operators import anaphora, boolean, grammar, index, knowledge, templates, topics, trees, triples, vectors
from lorebase.operators.annotate import annotate_tokens
from lorebase.plans import engine, settings
from lorebase.sources import readers
from lorebase.streaming import ingest


def token(k, text, tag="NN", dep="", semantic="", over=()):
    return (k, list(over), tag, text, dep, -1, semantic)


@pytest.fixture(scope="module")
def lexicon(spark):
    stems = spark.createDataFrame([("countries", "country"), ("working", "work"), ("gives", "give")], "word string, stem string")
    semantics = spark.createDataFrame([("Paris", "city"), ("country", "place")], "word string, semantic string")
    synonyms = spark.createDataFrame([("big", "large")], "word string, synonym string")
    return L.Lexicon(stems, semantics, synonyms, spark.createDataFrame([("new york",), ("old lady",)], "compound string"))


@pytest.fixture(scope="module")
def told(spark):
    """call_id, sentence_no, id, topic, tokenList"""
    rows = [
        ("c1", 0, "s1", "a", [token(0, "Peter", "NNP", "nsubj", "male"), token(1, "gives", "VBZ"), token(2, "books", "NNS", "dobj"), token(3, ".", ".")]),
        ("c1", 1, "s2", "a", [token(4, "Peter", "NNP", "nsubj", "male"), token(5, "visits", "VBZ"), token(6, "New York", "NNP", "dobj", "city")]),
        ("c2", 0, "s3", "b", [token(0, "Anna", "NNP", "nsubj", "female"), token(1, "was", "VBD", "aux"), token(2, "working", "VBG")]),
    ]
    return spark.createDataFrame(rows, f"call_id string, sentence_no long, id string, topic string, tokenList array<{schema.TOKEN}>")


def column(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("You shouldn't have.", ["You", " ", "shouldn't", " ", "have", "."]),
        ("CouLdN'T", ["CouLdN'T"]),
        ("might've", ["might've"]),
        ("x'y", ["x", "'", "y"]),
        ("a  \t b~c é1", ["a", " ", "b", "c", " ", "1"]),
        ("", []),
        ("'", ["'"]),
        ("Anna's cat", ["Anna's", " ", "cat"]),
    ],
)
def test_tokenize(spark, text, tokens):
    assert column(spark, T.tokenize(F.lit(text))) == tokens


@pytest.mark.parametrize(("tokens", "text"), [(["Hello", ",", "world", "!"], "Hello, world!"), (["say", '"', "hi", '"', "now"], 'say "hi" now'), (["a", "(", "b", ")", "."], "a (b)."), ([], "")])
def test_detokenize(spark, tokens, text):
    assert column(spark, T.detokenize(F.lit(tokens).cast("array<string>") if tokens else F.array().cast("array<string>"))) == text


@pytest.mark.parametrize(("a", "b", "fits"), [("NN", "NNP", True), ("NN", "VB", False), ("JJ", "NN", True), ("VB", "VBZ", True), ("VB", "RB", False), ("RB", "IN", True), ("", "NN", True), ("N", "VB", True), ("JJR", "NN", False)])
def test_tags(spark, a, b, fits):
    assert column(spark, T.tags_compatible(F.lit(a), F.lit(b))) is fits


@pytest.mark.parametrize(("address", "valid"), [("a@b.org", True), ("a.b+c@d-e.co.nz", True), ("a@b", False), ("@b.org", False), ("a b@c.org", False), ("a" * 50 + "@b.org", False)])
def test_email(spark, address, valid):
    assert column(spark, T.is_email(F.lit(address))) is valid


def test_sentence_tests(spark):
    def tokens(*pairs):
        return F.array(*(F.struct(F.lit(t).alias("text"), F.lit(g).alias("tag")) for t, g in pairs))

    assert column(spark, T.is_question(tokens(("is", "VBZ"), ("it", "PRP"))))
    assert column(spark, T.is_question(tokens(("it", "PRP"), ("?", "."))))
    assert column(spark, T.is_question(tokens(("it", "PRP"), ("who", "WP"))))
    assert not column(spark, T.is_question(tokens(("it", "PRP"), ("runs", "VBZ"))))
    assert column(spark, T.is_imperative(tokens(("go", "VB"), ("home", "NN"))))
    assert not column(spark, T.is_imperative(tokens(("go", "VB"), ("?", "."))))
    assert column(spark, T.has_verb(tokens(("it", "PRP"), ("runs", "VBZ"))))
    assert column(spark, T.thousands(F.lit(1234567))) == "1,234,567"
    assert column(spark, T.file_name(F.lit("My File.txt"))) == "my_file_txt"
    assert column(spark, T.is_tag(F.lit("nnp"))) and column(spark, T.is_tag(F.lit("HYPH"))) and column(spark, T.is_tag(F.lit("-lrb-"))) and not column(spark, T.is_tag(F.lit("QQ")))


def test_lexicon(spark, lexicon):
    rows = spark.createDataFrame([("Countries",), ("Paris",), ("paris",)], "w string")
    stemmed = lexicon.with_semantic(lexicon.with_stem(rows, "w"), "w", "stem")
    assert {(r.w, r.stem, r.semantic) for r in stemmed.collect()} == {("Countries", "country", "place"), ("Paris", "paris", "city"), ("paris", "paris", "")}
    updates = spark.createDataFrame([("f", 1, "save|u|Rome:City"), ("f", 2, "del|u|Paris:city"), ("f", 3, "save|u|Oslo:city"), ("f", 4, "del|u|Oslo:city"), ("f", 5, "bad")], "file string, number int, value string")
    assert {tuple(r) for r in readers.replay_updates(lexicon.semantics, updates).collect()} == {("country", "place"), ("Rome", "city")}
    assert {r.word for r in L.stem_forms(lexicon.stems).where("stem = 'give'").select(F.explode("forms").alias("word")).collect()} == {"give", "gives"}


def test_readers(spark, tmp_path):
    (tmp_path / "p.txt").write_text("cat|cats\nbad line\nbox|boxes\n")
    (tmp_path / "v.txt").write_text("be|is|am|are|was|were\ngo|goes\n")
    (tmp_path / "s.txt").write_text("big,large,huge\nalone\n")
    (tmp_path / "e1.txt").write_text("Paris:City\nx:y:z\n")
    (tmp_path / "e2.txt").write_text("Paris:Person\n")
    (tmp_path / "g.txt").write_text("king 1 2 x\nqueen 3 4 5\n")
    (tmp_path / "t.xml").write_text("<aiml><category><pattern>what is *</pattern><pattern>tell me</pattern><template>one | two |</template></category></aiml>")
    (tmp_path / "a.txt").write_text("people.born,where be:v,when born:v be:v\n")
    assert {tuple(r) for r in readers.plurals(readers.lines(spark, f"{tmp_path}/p.txt")).collect()} == {("cats", "cat"), ("boxes", "box")}
    assert readers.verbs(readers.lines(spark, f"{tmp_path}/v.txt")).count() == 5
    assert L.synonym_pairs(readers.synonym_groups(readers.lines(spark, f"{tmp_path}/s.txt"))).count() == 6
    assert [tuple(r) for r in readers.semantics(readers.numbered_lines(spark, f"{tmp_path}/e*.txt")).collect()] == [("Paris", "person")]
    assert {(r.text, tuple(r.vector)) for r in readers.word_vectors(spark, f"{tmp_path}/g.txt").collect()} == {("king", (1.0, 2.0, 0.0)), ("queen", (3.0, 4.0, 5.0))}
    assert {(r.pattern, r.origin, tuple(r.templates)) for r in readers.templates(spark, f"{tmp_path}/t.xml").collect()} == {("what is *", "t.xml module", ("one", "two")), ("tell me", "t.xml module", ("one", "two"))}
    assert {(r.w5h, len(r.components)) for r in readers.access_templates(readers.lines(spark, f"{tmp_path}/a.txt")).collect()} == {("where", 1), ("when", 2)}
    (tmp_path / "g.txt").write_text("king 1 2\nqueen 3\n")
    with pytest.raises(ValueError, match="width"):
        readers.word_vectors(spark, f"{tmp_path}/g.txt")


def test_postings(spark, told, lexicon):
    rows = {(r.word, r.sentence_id, r.offset): r.score for r in index.build_postings(told, lexicon, drop_off=0.5).collect()}
    assert rows["peter", "s1", 0] == 1 and rows["give", "s1", 1] == 1 and rows["peter", "s2", 4] == 0.5
    assert rows["new york", "s2", 6] == 0.5 and rows["new", "s2", 6] == rows["york", "s2", 6] == rows["city", "s2", 6] == 0.25
    assert ("was", "s3", 1) not in rows and rows["work", "s3", 2] == 1 and ("male", "s1", 0) in rows


def test_last_posting_wins(spark, lexicon):
    one = spark.createDataFrame([("c", 0, "s", "a", [token(0, "city", "NN", "", "city")])], f"call_id string, sentence_no long, id string, topic string, tokenList array<{schema.TOKEN}>")
    assert [(r.word, r.score) for r in index.build_postings(one, lexicon).collect()] == [("city", 0.5)]


def test_search_and_removal(spark, told, lexicon):
    postings = index.build_postings(told, lexicon).cache()
    asked = spark.createDataFrame([(1, [token(0, "Peter", "NNP"), token(1, "the", "DT"), token(2, "York", "NN")]), (2, [token(0, "peter", "")]), (3, [token(0, "nobody", "NN")]), (4, [token(0, "give", "NN")])], f"query_id int, tokens array<{schema.TOKEN}>")
    words = index.keywords(asked, lexicon)
    assert {(r.query_id, r.sentence_id) for r in index.search(postings, words).collect()} == {(1, "s2"), (2, "s1"), (2, "s2")}
    assert {r.sentence_id for r in index.search(postings, words, "b").collect()} == set()
    left = index.remove_sentences(postings, spark.createDataFrame([("s2",)], "id string"))
    assert {(r.query_id, r.sentence_id) for r in index.search(left, words).collect()} == {(2, "s1")}
    fetched = index.fetch(index.search(postings, words), told.select("id", "topic", "tokenList"))
    assert {r.text for r in fetched.collect()} == {"Peter gives books.", "Peter visits New York"}


def test_boolean_language():
    leaf = boolean.Leaf
    assert boolean.parse("any(a)") == leaf("a")
    assert boolean.parse("any(a) and not exact person(b c)") == boolean.Node("and not", leaf("a"), leaf("b c", True, "NNP", "person"))
    tree = boolean.parse("any(a, noun) or any(b) and any(c)")
    assert tree == boolean.Node("or", leaf("a", tag="NN"), boolean.Node("and", leaf("b"), leaf("c")))
    assert boolean.parse("(any(a) or any(b)) and location(x)").kind == "and"
    assert boolean.parse("any(a, vbz)").tag == "VBZ" and boolean.parse(" ") is None
    for bad in ("any(a", "foo(a)", "any(a) and", "any(a, xyz)", "person(a, noun)", "(any(a)", "any()"):
        with pytest.raises(boolean.QueryError):
            boolean.parse(bad)


def test_boolean_algebra(spark):
    data = {"a": {1, 2, 3}, "b": {2, 3, 4}, "c": {3, 9}}

    def leaf(x):
        return spark.createDataFrame([(k, [(0, x.text)]) for k in data[x.text]], "sentence_id int, matches array<struct<offset:int,word:string>>")

    def ids(query):
        return {r.sentence_id for r in boolean.execute(boolean.parse(query), leaf).collect()}

    assert ids("any(a) and any(b)") == {2, 3} and ids("any(a) or any(b)") == {1, 2, 3, 4} and ids("any(a) and not any(b)") == {1}
    assert ids("any(a) and not any(b) or any(c)") == data["a"] - (data["b"] | data["c"])
    assert ids("(any(a) and not any(b)) or any(c)") == {1, 3, 9}
    both = boolean.execute(boolean.parse("any(a) and any(b)"), leaf).where("sentence_id = 2").first()
    assert [m.word for m in both.matches] == ["a", "b"]


def test_triples(spark, lexicon):
    facts = spark.createDataFrame([(1, ["peter", "pan"], "born", ["paris"]), (2, ["peter", "fox"], "born", ["rome"]), (3, ["peter", "pan"], "likes", ["paris"])], "id long, lhs array<string>, predicate string, rhs array<string>")
    vocab, tuples = triples.vocabulary(facts), triples.encode(facts)
    blocks = triples.build_blocks(tuples)
    terms = spark.createDataFrame([("q1", t) for t in ("born", "Peter", "pan", "zzz")] + [("q2", "peter"), ("q2", "paris")] + [("q3", t) for t in ("born", "likes", "peter")] + [("q4", "born"), ("q4", "peter")], "query_id string, term string")
    got = {(r.query_id, r.id) for r in triples.find(triples.wanted_lists(terms, triples.list_sizes(blocks)), blocks).collect()}
    assert got == {("q1", 1), ("q4", 1), ("q4", 2)}
    assert {r.text for r in triples.decode(tuples, vocab).collect()} == {"peter pan born paris ", "peter fox born rome ", "peter pan likes paris "}
    known = spark.createDataFrame([(9, [tuples.where("id = 1").first().lhs[0]], 0, [5])], "id long, lhs array<long>, predicate long, rhs array<long>")
    assert triples.decode(known, vocab).first().text == "peter   "
    questions = spark.createDataFrame([("q", [token(0, "where", "WRB"), token(1, "was", "VBD"), token(2, "Peter", "NNP"), token(3, "gives", "VBZ")])], f"query_id string, tokens array<{schema.TOKEN}>")
    access = spark.createDataFrame([("born", "where", [("give", "v"), ("x", "n")], 1), ("likes", "where", [("x", "n")], 0)], "predicate string, w5h string, components array<struct<base:string,tag:string>>, rank int")
    assert {r.term for r in triples.match_access(questions, access, lexicon).collect()} == {"born", "was", "peter"}
    assert triples.match_access(questions, access, lexicon, strict=True).count() == 0


def test_topics(spark, told, lexicon):
    words = topics.topic_words(told, lexicon)
    last = {(r.word, r.topic): r.score for r in topics.build_topic_index(words).collect()}
    total = {(r.word, r.topic): r.score for r in topics.build_topic_index(words, "sum").collect()}
    assert last["peter", "a"] == 0.98 and total["peter", "a"] == 1.98 and ("peter", "b") not in last
    asked = spark.createDataFrame([(1, "peter", "NN"), (1, "peter", "NN"), (1, "anna", "NN")], "query_id int, word string, tag string")
    assert [(r.topic, r.score) for r in topics.rank_topics(asked, topics.build_topic_index(words)).collect()] == [("a", 1.96), ("b", 1.0)]


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert column(spark, vectors.similarity(a, b)) == pytest.approx(1.0)
    assert column(spark, vectors.similarity(a, a)) == pytest.approx(1.5430806348)
    rows = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.9, 0.1]), ("far", [0.1, 0.0]), ("out", [9.0, 9.0])], "text string, vector array<double>")
    asked = rows.where("text = 'x'").select(F.col("text").alias("query_id"), "vector")
    found = vectors.related(rows, asked, 10, 1)
    assert [r.text for r in vectors.top(found, 5).collect()] == ["x", "y"]


def test_knowledge(spark):
    rows = [(f"{k:03}", "people", f'{{"name":"Name {k}","city":"Oslo"}}') for k in range(25)]
    rows.append(("s", "schema", '{"id":"s","name":"people","origin":"u","field_list":[{"name":"city","semantic":"City","aiml":"where is *\\nfind *"},{"name":"name","semantic":"","aiml":""}]}'))
    entries = spark.createDataFrame(rows, schema.KB_ENTRY)
    seen, after = [], None
    while page := [r.id for r in knowledge.page(entries, "people", after, 10).collect()]:
        seen += page
        after = page[-1]
    assert seen == [f"{k:03}" for k in range(25)]
    kinds = knowledge.schemas(entries)
    assert knowledge.rendered(entries, kinds).where("id = '003'").first().text == "city: Oslo, name: Name 3"
    assert [tuple(r) for r in knowledge.lexicon_of(entries, kinds).collect()] == [("Oslo", "city")]
    assert {(r.pattern, r.templates[0]) for r in templates.schema_patterns(kinds).collect()} == {("where is *", "db_search:people:city"), ("find *", "db_search:people:city")}
    lines = readers.json_lines(spark.createDataFrame([('{"name":"A","other":"x"}',), ("no json",), ('{"id":"0B0E7E6A-0000-4000-8000-0123456789AB","city":"B"}',), ("{broken}",)], "value string"))
    got = {(r.id, r.json_data) for r in knowledge.uploaded(lines, kinds, "people").collect()}
    assert ("0b0e7e6a-0000-4000-8000-0123456789ab", '{"city":"B"}') in got and len(got) == 2
    changed = readers.upsert(entries, spark.createDataFrame([("003", "people", "{}"), ("900", "people", "{}")], schema.KB_ENTRY), ["topic", "id"])
    assert changed.count() == 27 and readers.delete(changed, {"topic": "people", "id": "003"}).count() == 26
    users = knowledge.new_users(spark.createDataFrame([("a@b.org", "Ann", "Lee", "salt", "pw"), ("bad", "B", "B", "s", "p")], "email string, first_name string, surname string, salt string, password string"))
    tries = spark.createDataFrame([("a@b.org", "pw", "s1"), ("a@b.org", "no", "s2")], "email string, password string, session string")
    sessions = knowledge.sign_in(users, tries)
    assert [r.session for r in sessions.collect()] == ["s1"]
    assert knowledge.valid_requests(tries.drop("email"), sessions).first().user_topic == "Ann Lee"


def test_paging(spark):
    rows = spark.createDataFrame([(f"k{k:02}", k % 2) for k in range(20)], "key string, odd int")
    assert [r.key for r in readers.select_page(rows, ["key"], {"odd": 1}, ("key", "k03"), 3).collect()] == ["k05", "k07", "k09"]
    assert readers.select_page(rows, None, None, ("key", "null"), 4).count() == 4


def test_anaphora(spark):
    rows = [
        ("d", 0, [token(0, "John", "NNP", "nsubj", "male"), token(1, "saw", "VBD"), token(2, "tables", "NNS", "dobj")]),
        ("d", 1, [token(3, "he", "PRP", "nsubj"), token(4, "liked", "VBD"), token(5, "them", "PRP", "dobj"), token(6, "and", "CC"), token(7, "she", "PRP")]),
        ("d", 6, [token(8, "he", "PRP")]),
    ]
    got = {(r.sentence_no, r.pos): r.anaphora for r in anaphora.resolve(spark.createDataFrame(rows, f"doc_id string, sentence_no long, tokenList array<{schema.TOKEN}>")).collect()}
    assert got == {(1, 0): "John", (1, 2): "tables", (1, 4): "?", (6, 0): "?"}
    named = spark.createDataFrame([([token(0, "You", "PRP"), token(1, "i", "NN"), token(2, "me", "PRP")],)], f"t array<{schema.TOKEN}>").select(anaphora.name_persons(F.col("t"), F.lit("Ann"), F.lit("Bob"))["text"].alias("x")).first().x
    assert named == ["You", "[", "Bob", "]", "i", "me", "[", "Ann", "]"]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("12.5", "decimal.1"), ("-12.5", "decimal.2"), ("15%", "percent.1"), ("$12.50", "money.1"), ("US$100", "money.3"), ("23:59", "time.4"), ("11:30 am", "time.5"), ("10:11:12.345", "time.1"),
        ("31/12/1999", "date.1"), ("1999-12-31", "date.9"), ("31 December 1999", "date.3"), ("Jan 2, 2017", "date.12"), ("2017/01/02 23:10:11", "date.8"), ("someone.else@some-where.org", "email.1"),
        ("http://example.org/a?b=c", "url.1"), ("www.example.org", "url.2"), ("555-123-4567", "phone.1"), ("(555) 123-4567", "phone.2"),
    ],
)
def test_entities(spark, text, kind):
    rows = spark.createDataFrame([(1, f"see {text} there")], "k int, text string")
    found = grammar.entities(rows, "k", "text", [kind.split(".")[0]]).collect()
    assert [(r.entity, r.kind) for r in found] == [(text, kind)]


@pytest.mark.parametrize(("low", "high"), [(1, 31), (0, 59), (1600, 2100), (0, 999), (7, 7)])
def test_ranges(low, high):
    import re

    pattern = re.compile(grammar.range_regex(low, high))
    assert {k for k in range(3000) if pattern.fullmatch(str(k))} == set(range(low, high + 1))


def test_typed_entity(spark):
    _, patterns = grammar.compile_rules()
    assert str(column(spark, grammar.typed(F.lit("31-12-1999"), patterns["date.1"]))) == "1999-12-31 00:00:00"
    assert column(spark, grammar.typed(F.lit("41-12-1999"), patterns["date.1"])) is None


def test_templates(spark):
    assert templates.expand("(a|b|) c") == ["a c", "b c", "c"]
    with pytest.raises(ValueError, match="brackets"):
        templates.expand("(a|b c")
    rules = templates.compile_templates(spark, [("do you * dog", "f", ["yes: {star}"]), ("what is (the|) time", "f", ["{time}", "late"]), ("tell me *", "f", ["about {star}"]), ("* all", "f", ["never"]), ("one", "f", ["never"])])
    asked = spark.createDataFrame([(1, "Do you have a dog?"), (2, "what is time"), (3, "tell me"), (4, "tell me  all, please!"), (5, "nothing"), (6, "")], "query_id int, text string")
    got = sorted((r.query_id, r.template, r.star) for r in templates.match(asked, rules).collect())
    assert got == [(1, "yes: {star}", "have a"), (2, "late", ""), (2, "{time}", ""), (3, "about {star}", ""), (4, "about {star}", "all please")]
    assert templates.pick(templates.match(asked, rules)).count() == 4
    filled = column(spark, templates.fill(F.lit("{year} {day} {month} {time} {star}"), F.lit("x"), F.lit("2024-03-05 14:07:09").cast("timestamp"), F.lit("e")))
    assert filled == "2024 Tuesday March 2:07PM x"


def test_trees(spark, lexicon):
    rows = spark.createDataFrame([("s", [token(0, "the", "DT", "det", over=[2, 3]), token(1, "old", "JJ", "amod", over=[2]), token(2, "lady", "NN", "nsubj", over=[3]), token(3, "sings", "VBZ", "ROOT")])], f"id string, tokenList array<{schema.TOKEN}>")
    assert {(r.child, r.parent) for r in trees.parents(rows).collect()} == {(0, 2), (1, 2), (2, 3), (3, None)}
    text = rows.select(trees.flat(F.col("tokenList")).alias("a"), trees.by_verbs(F.col("tokenList")).alias("b"), trees.dot(F.col("tokenList")).alias("c")).first()
    assert text.a == "[the:det old:amod lady:nsubj sings:ROOT]" and "_sings{VBZ}_" in text.b and text.c.count("->") == 3
    merged = trees.merge_longest(rows, lexicon.compounds).first().tokenList
    assert [(t.text, t.tag) for t in merged] == [("the", "DT"), ("old lady", "NN"), ("sings", "VBZ")]
    same = trees.merge_longest(rows, lexicon.compounds.limit(0)).first().tokenList
    assert [t.text for t in same] == ["the", "old", "lady", "sings"]


def test_annotation(spark):
    tags = column(spark, annotate_tokens(F.split(F.lit("The dogs walked quickly to 12 Towns ."), " "))["tag"])
    assert tags == ["DT", "NNS", "VBD", "RB", "IN", "CD", "NNS", "."]


def test_engine(spark, told, lexicon, tmp_path):
    state = engine.teach(engine.empty(spark), told.select("id", "topic", "tokenList"), lexicon)
    assert {r.id for r in state.sentences.collect()} == {"s1", "s2", "s3"}
    questions = spark.createDataFrame(
        [(1, "a", "e@f.org", "who gives books?", [token(0, "who", "WP"), token(1, "gives", "VBZ"), token(2, "books", "NNS"), token(3, "?", ".")]), (2, "zz", "e@f.org", "is York in Peter?", [token(0, "York", "NNP"), token(1, "Peter", "NNP"), token(2, "?", ".")]), (3, "a", "e@f.org", "tell me all?", [token(0, "tell", "VB"), token(1, "?", ".")]), (4, "a", "e@f.org", "is x y?", [token(0, "xx", "NN"), token(1, "yy", "NN"), token(2, "?", ".")])],
        f"query_id int, topic string, email string, text string, tokens array<{schema.TOKEN}>",
    )
    rules = templates.compile_templates(spark, [("tell me *", "f", ["all of {star} to {email}"])])
    access = spark.createDataFrame([], "predicate string, w5h string, components array<struct<base:string,tag:string>>, rank int")
    now = F.lit("2024-03-05 14:07:09").cast("timestamp")
    got = {(r.query_id, r.text) for r in engine.ask(state, questions, lexicon, rules, access, now).collect()}
    assert got == {(1, "Peter gives books."), (2, "Peter visits New York"), (3, "all of all to your email address is e@f.org"), (4, engine.UNKNOWN)}
    left = engine.unteach(state, spark.createDataFrame([("s2",)], "id string"))
    assert left.postings.where("sentence_id = 's2'").count() == 0 and left.postings.count() > 0
    both = engine.save_topics(left, told, lexicon)
    again = engine.save_topics(both, told, lexicon)
    assert both.topic_index.count() == again.topic_index.count() and both.postings.distinct().count() == again.postings.count()
    engine.save(again, str(tmp_path / "state"))
    assert engine.load(spark, str(tmp_path / "state")).postings.count() == again.postings.count()


def test_sql_functions(spark):
    settings.register(spark)
    row = spark.sql("SELECT kb_words('One two, 3') AS w, size(kb_sentences('A. B? C')) AS n, kb_stop_word('The') AS s, kb_tokenize(\"x\\'y\") AS t").first()
    assert row.w == ["one", "two", "3"] and row.n == 3 and row.s and row.t == ["x", "'", "y"]


def test_streaming(spark, lexicon, tmp_path):
    docs = spark.createDataFrame([(1, "t", "Alpha beta. Gamma!"), (2, "t", "Beta delta.")], "doc_id long, topic string, text string")
    docs.limit(1).write.parquet(str(tmp_path / "in"))
    read = lambda: ingest.document_stream(spark, str(tmp_path / "in"), docs.schema)
    args = lexicon, str(tmp_path / "out"), str(tmp_path / "state")
    ingest.index_stream(read(), *args).awaitTermination()
    docs.where("doc_id = 2").write.mode("append").parquet(str(tmp_path / "in"))
    ingest.index_stream(read(), *args).awaitTermination()
    ingest.index_stream(read(), *args).awaitTermination()
    made = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.word, r.sentence_id) for r in made.collect()} == {("alpha", "1-0"), ("beta", "1-0"), ("gamma", "1-1"), ("beta", "2-0"), ("delta", "2-0")} and made.count() == 5


def test_all_stars_and_search_templates(spark):
    rules = templates.compile_templates(spark, [("who * by the *", "o", ["{search:found,*}"]), ("what is *", "o", ["about {star}"])])
    asked = spark.createDataFrame([(1, "Who wrote it by the old river?"), (2, "what is this")], "query_id long, text string")
    rows = templates.match(asked, rules).select("query_id", "star", templates.searched_text(F.col("template"), F.col("star")).alias("said")).collect()
    assert {r.query_id: (r.star, r.said) for r in rows} == {1: ("wrote it old river", "found wrote it old river"), 2: ("this", None)}


def test_compounds_take_over_ancestors(spark):
    token = "struct<index:int,list:array<int>,tag:string,text:string,dep:string>"
    rows = spark.createDataFrame([(1, [(0, [2, 3], "DT", "the", ""), (1, [2, 3], "JJ", "red", ""), (2, [3], "NN", "cross", ""), (3, [], "VBZ", "helps", "ROOT"), (4, [1, 3], "RB", "well", "")])], f"id long, tokenList array<{token}>")
    made = trees.merge_longest(rows, spark.createDataFrame([("red cross",)], "compound string")).first()["tokenList"]
    assert [(t["index"], t["list"], t["text"]) for t in made] == [(0, [2, 3], "the"), (2, [3], "red cross"), (3, [], "helps"), (4, [2, 3], "well")]


@pytest.mark.parametrize("text", ["March 5,2012", "March5,2012", "2012-03-05 10:20:30pm", "(123) 456-7890", "(123)456-7890", "http://a.org/x[1]/y"])
def test_modifiers_and_brackets(spark, text):
    found = [r.entity for r in grammar.entities(spark.createDataFrame([(1, f"see {text} there")], "k long, t string"), "k", "t").collect()]
    assert text in found


def test_schemas_and_users_come_and_go(spark):
    none = spark.createDataFrame([], "id string, topic string, json_data string")
    kinds = spark.createDataFrame([("s1", "part", "u", [("name", "", "")])], "id string, name string, origin string, field_list array<struct<name:string,semantic:string,aiml:string>>")
    held = knowledge.save_schemas(none, kinds)
    assert [r.name for r in knowledge.schemas(held).collect()] == ["part"] and knowledge.remove_schemas(held, ["s1"]).count() == 0
    users = spark.createDataFrame([("a@b.org", "x"), ("c@d.org", "y")], "email string, first_name string")
    sessions = spark.createDataFrame([("a@b.org", "1"), ("c@d.org", "2"), ("c@d.org", "3")], "email string, session string")
    left, open_ = knowledge.remove_users(users, sessions, spark.createDataFrame([("c@d.org",)], "email string"))
    assert left.count() == 1 and open_.count() == 1
    assert {r.session for r in knowledge.sign_out(sessions, spark.createDataFrame([("2",)], "session string")).collect()} == {"1", "3"}
