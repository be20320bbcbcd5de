"""Text functions as columns: tokens, sentences, detokenising, tests of tags and sentences."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern and the words that contractions are made of. A part counts as one if it occurs anywhere in the joined text.
TOKEN_PATTERN = r"""[ \t\r\n\x08]+|[.'"_%$#@^&*()\[\]{}<>/\\=+|!?,:;-]|[0-9]+|[A-Za-z]+"""
SENTENCE_PATTERN = r"[^.!?]+[.!?]*"
WORD_PATTERN = r"[A-Za-z]+|[0-9]+"
CONTRACTION_STARTS = "couldn didn doesn don hadn hasn haven he how i isn it might mightn must mustn she we weren what when where who would wouldn you should shouldn won wont"
CONTRACTION_ENDS = "ll d re s t ve m"
FULL_STOPS = [".", "۔", "܁", "܂", "︒", "﹒", "．", "｡"]
PUNCTUATION = ["!", "?", ",", ":", ";", *FULL_STOPS]
NO_SPACE_BEFORE = [";", "n't", "'s", "'ll", ".", ",", "?", "!", ":", "'m", "'re", ")", "]", "}", "'ve"]
NO_SPACE_AFTER = ["(", "[", "{"]
QUESTION_VERBS = ["do", "did", "does", "are", "is", "was", "were", "have", "had"]
PENN_TAGS = """cc cd dt ex fw in jj jjr jjs ls md nn nns nnp nnps pdt pos prp prp$
prps rb rbr rbs rp sym to intj uh vb vbd vbg vbn vbp vbz wdt wp wp$ wps
wrb rsb -rsb- rcb -rcb- rrb -rrb- -lsb- lsb -lcb- lcb lrb -lrb- np-tmp
pun hyph . sqt eqt x xx sp
adjp advp conjp np vp pp qp s sq sbarq sbar sinv ucp whadjp whadvp whnp whpp root prn
frag prt rrc nx nac lst add afx gw bes hvs nfp""".split()
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
NAME = r"^[A-Za-z -]+$"


def sentences(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def raw_tokens(text: Column | str) -> Column:
    """Tokens before contractions are merged; a run of white space is one space, characters of no class are dropped."""
    found = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.transform(found, lambda t: F.when(t.rlike(r"^[ \t\r\n\x08]"), " ").otherwise(t))


def pieces(text: Column | str) -> Column:
    """A text in parts of which nothing is dropped: runs of the letters A to Z, question marks, and runs of all else, white space too."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|[?]|[^A-Za-z?]+"), F.lit(0))


def merge_contractions(tokens: Column) -> Column:
    """Join tokens like couldn ' t, from left to right, each token used once."""

    def joins(k: Column) -> Column:
        a, b, c = (F.lower(F.try_element_at(tokens, k + n)) for n in (1, 2, 3))
        known = F.lit(CONTRACTION_STARTS).contains(a) & F.lit(CONTRACTION_ENDS).contains(c)
        return F.coalesce((b == "'") & (known | (c == "s")), F.lit(False))

    def step(state: Column, k: Column) -> Column:
        at = F.try_element_at(tokens, k + 1)
        joined = F.concat(at, F.try_element_at(tokens, k + 2), F.try_element_at(tokens, k + 3))
        skipping = state["skip"] > 0
        return F.struct(
            F.when(skipping, state["out"]).otherwise(F.concat(state["out"], F.array(F.when(joins(k), joined).otherwise(at)))).alias("out"),
            F.when(skipping, state["skip"] - 1).when(joins(k), F.lit(2)).otherwise(F.lit(0)).alias("skip"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"))
    folded = F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), start, step, lambda s: s["out"])
    return F.when(F.size(tokens) > 0, folded).otherwise(F.array().cast("array<string>"))


def tokenize(text: Column | str) -> Column:
    """Tokens of a text, spaces included. The fold runs only where there is an apostrophe; without one nothing can join."""
    tokens = raw_tokens(text)
    return F.when(F.array_contains(tokens, "'"), merge_contractions(tokens)).otherwise(tokens)


def drop_spaces(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != " ")


def drop_punctuation(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(PUNCTUATION))


def detokenize(tokens: Column) -> Column:
    """Readable text: no space before closing marks, none after opening ones, double quotes opened and closed in turn."""

    def step(state: Column, t: Column) -> Column:
        text, quotes = state["text"], state["quotes"]
        quote = t == '"'
        closes = quote & (quotes % 2 == 1)
        bare = F.when(t.isin(NO_SPACE_BEFORE) | closes, F.regexp_replace(text, " $", "")).otherwise(text)
        space = F.when((quote & ~closes) | t.isin(NO_SPACE_AFTER), "").otherwise(" ")
        return F.struct(F.concat(bare, t, space).alias("text"), (quotes + quote.cast("int")).alias("quotes"))

    return F.trim(F.aggregate(tokens, F.struct(F.lit("").alias("text"), F.lit(0).alias("quotes")), step, lambda s: s["text"]))


def tags_compatible(a: Column, b: Column) -> Column:
    """Whether tags may match: nouns with nouns or adjectives, verbs with verbs, others with all; a tag of under two characters matches any."""
    same = F.substring(a, 1, 2) == F.substring(b, 1, 2)
    noun, verb = (a.startswith(p) | b.startswith(p) for p in ("NN", "VB"))
    return F.when((F.length(a) < 2) | (F.length(b) < 2), True).when(noun, same | (a == "JJ") | (b == "JJ")).when(verb, same).otherwise(True)


def is_noun(tag: Column) -> Column:
    return tag.isin("NN", "NNS", "NNP", "NNPS")


def is_verb(tag: Column) -> Column:
    return tag.contains("VB")


def is_adjective(tag: Column) -> Column:
    return tag.isin("JJ", "JJR", "JJS")


def is_adverb(tag: Column) -> Column:
    return tag.isin("RB", "RBR", "RBS")


def is_number(tag: Column) -> Column:
    return tag == "CD"


def is_tag(tag: Column) -> Column:
    """Whether a tag is a Penn tag, in either case."""
    return F.lower(tag).isin(*PENN_TAGS, " ")


def is_question(tokens: Column) -> Column:
    """tokens: array of structs with text and tag."""
    first, last = F.try_element_at(tokens, F.lit(1)), F.try_element_at(tokens, F.lit(-1))
    asks = first["tag"].startswith("VB") & F.lower(first["text"]).isin(QUESTION_VERBS)
    return (F.size(tokens) > 1) & ((last["text"] == "?") | asks | F.exists(tokens, lambda t: t["tag"].isin("WDT", "WP")))


def is_imperative(tokens: Column) -> Column:
    first, last = F.try_element_at(tokens, F.lit(1)), F.try_element_at(tokens, F.lit(-1))
    return (F.size(tokens) > 1) & (last["text"] != "?") & first["tag"].isin("VB", "VBP")


def has_verb(tokens: Column) -> Column:
    return (F.size(tokens) > 1) & F.exists(tokens, lambda t: t["tag"].startswith("VB"))


def is_email(address: Column) -> Column:
    return address.rlike(EMAIL) & (F.length(address) < 50)


def is_entity(name: Column, semantic: Column) -> Column:
    return name.rlike(NAME) & semantic.rlike(NAME) & (F.length(name) <= 255) & (F.length(semantic) <= 30)


def askable(text: Column) -> Column:
    return F.octet_length(text).between(1, 254)


def topic_body(text: Column) -> Column:
    return F.octet_length(text).between(11, 65535)


def topic_name(name: Column) -> Column:
    return F.octet_length(name).between(3, 50)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def file_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "_")


def display_name(first: Column, surname: Column) -> Column:
    return F.trim(F.concat_ws(" ", first, surname))


def password_hash(salt: Column, password: Column) -> Column:
    return F.sha2(F.concat_ws("-", salt, password), 256)


def render_tokens(tokens: Column) -> Column:
    """text{semantic before its first dot}, or text{dep} for subjects and objects, joined by spaces."""
    role = lambda t: F.when(t["semantic"] != "", F.substring_index(t["semantic"], ".", 1)).when(t["dep"].contains("sub") | t["dep"].contains("obj"), t["dep"])
    return F.array_join(F.transform(tokens, lambda t: F.when(role(t).isNotNull(), F.concat(t["text"], F.lit("{"), role(t), F.lit("}"))).otherwise(t["text"])), " ")


def uuid_or_null(text: Column) -> Column:
    """A uuid in lower case; the empty one, of zeros, and what is no uuid are null."""
    lower = F.lower(F.trim(text))
    return F.when(lower.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$") & ~lower.rlike("^[0-]+$"), lower)


def moment_text(now: Column) -> Column:
    return F.date_format(now, "EEEE, dd-MMM-yy HH:mm:ss z")


def drop_space_tokens(tokens: Column) -> Column:
    """Structs of tokens without white space."""
    return F.filter(tokens, lambda t: F.trim(t["text"]) != "")


def drop_empty_sentences(sentences_: Column) -> Column:
    """Arrays of tokens without white space, and without sentences that it leaves empty."""
    return F.filter(F.transform(sentences_, drop_space_tokens), lambda s: F.size(s) > 0)


def retokenize(token: Column) -> Column:
    """A token's text tokenised again, each part with the token's other fields."""
    return F.transform(raw_tokens(token["text"]), lambda t: token.withField("text", t))


def countable(tokens: Column, stop_words: list[str]) -> Column:
    """How many tokens are worth a search."""
    return F.size(F.filter(tokens, lambda t: (t["text"] != "") & ~F.lower(t["text"]).isin(stop_words)))


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often the expression names it."""
    return F.transform(F.array(value), of)[0]
