"""Entities by a token grammar, without leaving the JVM: rules as regular expressions, which say where entities may be, and as one state machine over tokens, which finds the longest."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The catalogue of entities. public rules are looked for, private ones are their parts, pattern lines say how a value is read.
RULES = r"""
private url_character = [ % ! # @ / \ ; & - _ $ . ? + = ^ * ( ) [ ] { } abc number ]
private url_prefix = [ http https ftp mailto ]
public url.1 = url_prefix : / / url_character+
public url.2 = www . url_character+
public decimal.1 = number . number
public decimal.2 = - number . number
public percent.1 = number %
public percent.2 = number . number %
public percent.3 = - number . number %
private currency_prefix = [ $ NZ $NZ US $US US$ NZ$ $AU AU$ ]
public money.1 = currency_prefix decimal.1
public money.2 = currency_prefix decimal.2
public money.3 = currency_prefix number
public money.4 = currency_prefix - number
private am_pm = [ pm am PM AM P.M A.M ]
private hour = number.range(0,24)
private hour12 = number.range(0,12)
private sixty = number.range(0,59)
private millis = number.range(0,999)
public time.1 = hour : sixty : sixty . millis
public time.2 = hour : sixty : sixty
public time.3 = hour12 : sixty : sixty space am_pm
public time.4 = hour : sixty
public time.5 = hour12 : sixty space am_pm
private date_separator = [ / - \ ]
private year = number.range(1600,2100)
private day = number.range(1,31)
private month_no = number.range(1,12)
public date.1 = day date_separator month_no date_separator year
public date.2 = day date_separator month date_separator year
public date.3 = day space month space year
public date.4 = day space month
public date.5 = date.9 space time.3
public date.6 = date.9 space time.5
public date.7 = date.9 space time.1
public date.8 = date.9 space time.2
public date.9 = year date_separator month_no date_separator day
public date.10 = month_no date_separator day date_separator year
public date.11 = month date_separator day date_separator year
public date.12 = month space day , space year
public date.13 = date.9 hour12 : sixty : sixty am_pm
public date.14 = date.9 hour12 : sixty am_pm
public date.15 = date.9 hour : sixty : sixty . millis
public date.16 = date.9 hour : sixty : sixty
public date.17 = month day , year
modifier date.13 = space@1
modifier date.14 = space@1
modifier date.15 = space@1
modifier date.16 = space@1
modifier date.17 = space@1
private email_character = [ . - _ abc number ]
public email.1 = email_character+ @ email_character+
private phone_separator = [ - space ]
private area = number.range(100,999)
private three = number.range(1,999)
private four = number.range(1,9999)
public phone.1 = area phone_separator three phone_separator four
public phone.2 = ( area ) space three phone_separator four
public phone.3 = ( area ) three phone_separator four
modifier phone.3 = space@3
pattern time.1 = HH:mm:ss.SSS
pattern time.2 = HH:mm:ss
pattern time.3 = hh:mm:ss a
pattern time.4 = HH:mm
pattern time.5 = hh:mm a
pattern date.1 = d/M/yyyy
pattern date.2 = d/MMM/yyyy
pattern date.3 = d MMM yyyy
pattern date.5 = yyyy/M/d hh:mm:ss a
pattern date.6 = yyyy/M/d hh:mm a
pattern date.7 = yyyy/M/d HH:mm:ss.SSS
pattern date.8 = yyyy/M/d HH:mm:ss
pattern date.9 = yyyy/M/d
pattern date.10 = M/d/yyyy
pattern date.11 = MMM/d/yyyy
pattern date.12 = MMM d, yyyy
pattern date.17 = MMM d,yyyy
"""
MONTHS = "January February March April May June July August September October November December".split()
BEFORE, BEHIND = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
TOKENS = {"abc": "[A-Za-z]+", "number": "[0-9]+", "space": r"[ \t\r\n\x08]+"}


@dataclass(frozen=True)
class Rule:
    name: str
    public: bool
    regex: str


def range_regex(low: int, high: int) -> str:
    """A regular expression for numbers of a range, leading zeros allowed."""

    def same_length(a: str, b: str) -> list[str]:
        if not a:
            return [""]
        if a[0] == b[0]:
            return [a[0] + x for x in same_length(a[1:], b[1:])]
        rest = len(a) - 1
        out = [a[0] + x for x in same_length(a[1:], "9" * rest)]
        if int(b[0]) - int(a[0]) > 1:
            out.append(f"[{int(a[0]) + 1}-{int(b[0]) - 1}]" + "[0-9]" * rest)
        return out + [b[0] + x for x in same_length("0" * rest, b[1:])]

    out: list[str] = []
    while low <= high:
        top = min(high, 10 ** len(str(low)) - 1)
        out += same_length(str(low), str(top))
        low = top + 1
    return "0*(?:" + "|".join(reversed(out)) + ")"


def read_rules(text: str) -> tuple[dict[str, str], set[str], dict[str, str], dict[str, int]]:
    """The right sides of grammar lines by name, the names that are public, value patterns, and the item behind which white space may stand."""
    sides: dict[str, str] = {"month": f"[ {' '.join([*MONTHS, *(m[:3] for m in MONTHS), *(m[:3] + '.' for m in MONTHS)])} ]"}
    public, patterns, spaces = set(), {}, {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith(("//", "#")):
            continue
        head, _, right = line.partition("=")
        kind, name = head.split()
        if kind == "pattern":
            patterns[name] = right.strip()
        elif kind in ("public", "private"):
            sides[name] = right.strip()
            public |= {name} if kind == "public" else set()
        elif kind == "modifier" and (m := re.fullmatch(r"space@(\d+)", right.strip())):
            spaces[name] = int(m[1])
        else:
            raise ValueError(f"not a rule: {line}")
    return sides, public, patterns, spaces


def compile_rules(text: str = RULES) -> tuple[list[Rule], dict[str, str]]:
    """Rules and value patterns of grammar lines. A rule may name any rule of the text. A modifier space@n lets white space stand, or be left out, behind the n-th item of its rule."""
    sides, public, patterns, spaces = read_rules(text)

    def item(word: str, inside: tuple[str, ...]) -> str:
        if word in TOKENS:
            return TOKENS[word]
        if m := re.fullmatch(r"number\.range\((\d+),(\d+)\)", word):
            return range_regex(int(m[1]), int(m[2]))
        if word in sides:
            if word in inside:
                raise ValueError(f"{word} holds itself")
            return side(sides[word], (*inside, word), spaces.get(word))
        return re.escape(word)

    def side(right: str, inside: tuple[str, ...], space: int | None = None) -> str:
        if right.startswith("[") and right.endswith("]"):
            return "(?:" + "|".join(item(w, inside) for w in sorted(right[1:-1].split(), key=len, reverse=True)) + ")"
        made = [f"(?:{item(w[:-1], inside)})+" if len(w) > 1 and w.endswith("+") else item(w, inside) for w in right.split()]
        if space:
            made.insert(space, f"(?:{TOKENS['space']})?")
        return "".join(made)

    return [Rule(name, name in public, side(right, (name,), spaces.get(name))) for name, right in sides.items()], patterns


def entity_regex(rules: list[Rule], kinds: list[str] | None = None) -> str:
    """One expression for all public rules, the ones with more parts first; numbers and words are matched whole, as tokens."""
    chosen = [r for r in rules if r.public and (kinds is None or r.name.split(".")[0] in kinds)]
    chosen.sort(key=lambda r: len(r.regex), reverse=True)
    return BEFORE + "(?:" + "|".join(r.regex for r in chosen) + ")" + BEHIND


def entities(rows: DataFrame, key: str, text: str, kinds: list[str] | None = None, rules: str = RULES) -> DataFrame:
    """key, entity, kind of each entity of a text: the longest match at each place; where several rules match the same text the first rule names it."""
    compiled, _ = compile_rules(rules)
    public = [r for r in compiled if r.public and (kinds is None or r.name.split(".")[0] in kinds)]
    found = rows.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(entity_regex(compiled, kinds)), F.lit(0))).alias("entity"))
    name = F.coalesce(*(F.when(F.col("entity").rlike(f"^(?:{r.regex})$"), r.name) for r in public))
    return found.select(key, F.regexp_replace("entity", r"[ \t\r\n\x08]+", " ").alias("entity"), name.alias("kind"))


def typed(entity: Column, pattern: str) -> Column:
    """The moment that an entity says, by a value pattern; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(entity, r"[-\\]", "/"), F.lit(pattern))


WORD, NUMBER, SPACE = ("abc",), ("number", None, None), ("space",)
DIGITS = 12  #: of a number whose range can be checked
Atom = tuple  #: a test of a token: WORD, NUMBER or one with a range, SPACE, or ("is", text)


@dataclass(frozen=True)
class Machine:
    """A deterministic machine over classes of tokens. It names the rules that a run of tokens meets: the first of those that its first token begins as a word of their own, and the
    first of those that it begins as a word, number or space at large."""

    names: list[str]
    classes: list[tuple[frozenset[Atom], list[str], list[tuple[int, int]]]]  #: tests met, single texts, ranges of numbers
    steps: list[list[int]]  #: next state by state and class, -1 for none
    own: list[int]  #: rule by state, -1 for none
    large: list[int]


def _atom(word: str) -> Atom | None:
    """The test that an item of a rule is; None for a text that is no single token, which no token ever is."""
    if word in TOKENS:
        return {"abc": WORD, "number": NUMBER, "space": SPACE}[word]
    if m := re.fullmatch(r"number\.range\((\d+),(\d+)\)", word):
        return ("number", int(m[1]), int(m[2]))
    return ("is", word) if re.fullmatch(T.TOKEN_PATTERN, word) else None


def machine(text: str = RULES, kinds: list[str] | None = None) -> Machine:
    """Compile the public rules of some kinds, or all: items to tests between places, then sets of places to states."""
    sides, public, _, spaces = read_rules(text)
    edges: dict[int, list[tuple[Atom | None, int]]] = defaultdict(list)  #: place -> tests (None: no token) and next places
    count = iter(range(1, 1 << 30))

    def way(word: str, start: int, inside: tuple[str, ...]) -> int:
        """The place behind an item that begins at a place."""
        if word in sides and word not in inside:
            right = sides[word]
            if right.startswith("[") and right.endswith("]"):
                end = next(count)
                for x in right[1:-1].split():
                    edges[way(x, start, (*inside, word))].append((None, end))
                return end
            return row(word, start, (*inside, word))
        if word in inside:
            raise ValueError(f"{word} holds itself")
        end = next(count)
        if (atom := _atom(word)) is not None:
            edges[start].append((atom, end))
        return end

    def row(name: str, start: int, inside: tuple[str, ...]) -> int:
        right = sides[name]
        for k, word in enumerate(right.split(), 1):
            fresh = next(count)
            edges[start].append((None, fresh))
            start = way(word[:-1], fresh, inside) if len(word) > 1 and word.endswith("+") else way(word, fresh, inside)
            if len(word) > 1 and word.endswith("+"):
                edges[start].append((None, fresh))
            if spaces.get(name) == k:
                end = next(count)
                edges[start] += [(SPACE, end), (None, end)]
                start = end
        return start

    names = [n for n in sides if n in public and (kinds is None or n.split(".")[0] in kinds)]
    begin, ends = {}, {}
    for k, name in enumerate(names):
        begin[k] = next(count)
        ends[way(name, begin[k], ())] = k

    def closed(places: Iterable[tuple[int, bool]]) -> frozenset[tuple[int, bool]]:
        held = set(places)
        work = list(held)
        while work:
            place, own = work.pop()
            for atom, to in edges[place]:
                if atom is None and (to, own) not in held:
                    held.add((to, own))
                    work.append((to, own))
        return frozenset(held)

    classes = _classes({a for e in edges.values() for a, _ in e if a})
    first = closed((b, False) for b in begin.values())
    states, steps = {first: 0}, []
    work = [first]
    for state in work:
        out = []
        for met, _, _ in classes:
            # Behind the first token, it is known in which way it began its rule.
            to = closed({(t, a[0] == "is" if state is first else own) for place, own in state for a, t in edges[place] if a in met})
            if to and to not in states:
                states[to] = len(states)
                work.append(to)
            out.append(states[to] if to else -1)
        steps.append(out)
    rule = lambda state, own: min((ends[p] for p, o in state if p in ends and o == own), default=-1)
    return Machine(names, classes, steps, [rule(s, True) if s is not first else -1 for s in states], [rule(s, False) if s is not first else -1 for s in states])


def _classes(atoms: set[Atom]) -> list[tuple[frozenset[Atom], list[str], list[tuple[int, int]]]]:
    """Tokens that meet the same tests are one class: single texts, ranges of numbers; then words, long numbers, white space and all else."""
    made: dict[frozenset[Atom], tuple[list[str], list[tuple[int, int]]]] = defaultdict(lambda: ([], []))
    for text in sorted(a[1] for a in atoms if a[0] == "is"):
        made[frozenset({("is", text), *({WORD} if re.fullmatch("[A-Za-z]+", text) else ())} & atoms)][0].append(text)
    ranges = sorted({a for a in atoms if a[0] == "number" and a != NUMBER})
    cuts = sorted({0, 10**DIGITS, *(a[1] for a in ranges), *(a[2] + 1 for a in ranges)})
    for low, high in zip(cuts, cuts[1:], strict=False):
        made[frozenset({NUMBER, *(a for a in ranges if a[1] <= low and high - 1 <= a[2])} & atoms)][1].append((low, high - 1))
    out = [(met, *x) for met, x in made.items()]
    return out + [(frozenset({x} & atoms), [], []) for x in (WORD, NUMBER, SPACE)] + [(frozenset(), [], [])]


def class_of(token: Column, compiled: Machine) -> Column:
    """The class of a token's text, as a number."""
    known = compiled.classes[:-4]
    word, number, space, other = range(len(known), len(known) + 4)
    value = token.try_cast("bigint")
    digits = F.lit(None).cast("int")
    for k, (_, _, ranges) in enumerate(known):
        for low, high in ranges:
            digits = F.when(value.between(low, high), k).otherwise(digits)
    out = F.when(token.rlike("^[0-9]+$"), F.when(F.length(token) <= DIGITS, digits).otherwise(number))
    for k, (_, texts, _) in enumerate(known):
        if texts:
            out = out.when(token.isin(texts), k)
    return out.when(token.rlike("^[A-Za-z]+$"), word).when(F.trim(token) == "", space).otherwise(other)


RUN = "struct<start:int,state:int,own:int,own_end:int,large:int,large_end:int>"


def runs(texts: Column, compiled: Machine) -> Column:
    """The runs of tokens that rules meet: an array of start, end and rule, in order, none within another. From each token that isn't taken yet on, the longest run counts, and those of
    rules that its first token begins as a word of their own go before all others. One fold over the tokens holds a run for each start that may still grow; a second one takes them in order."""
    width = len(compiled.classes)
    # One literal a table: it is taken apart once, when the plan is made.
    table = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<int>")
    steps, own, large = table([x for row in compiled.steps for x in row]), table(compiled.own), table(compiled.large)
    items = F.transform(texts, lambda t, k: F.struct(k.alias("k"), class_of(t, compiled).alias("c")))

    def move(run: Column, token: Column) -> Column:
        state = F.get(steps, run["state"] * width + token["c"])
        mine, all_ = F.when(state >= 0, F.get(own, state)).otherwise(-1), F.when(state >= 0, F.get(large, state)).otherwise(-1)
        return F.struct(
            run["start"].alias("start"), state.alias("state"), F.when(mine >= 0, mine).otherwise(run["own"]).alias("own"), F.when(mine >= 0, token["k"] + 1).otherwise(run["own_end"]).alias("own_end"),
            F.when(all_ >= 0, all_).otherwise(run["large"]).alias("large"), F.when(all_ >= 0, token["k"] + 1).otherwise(run["large_end"]).alias("large_end"),
        ).cast(RUN)

    def step(held: Column, token: Column) -> Column:
        fresh = F.struct(token["k"].alias("start"), F.lit(0).alias("state"), F.lit(-1).alias("own"), F.lit(0).alias("own_end"), F.lit(-1).alias("large"), F.lit(0).alias("large_end")).cast(RUN)
        return F.struct(F.transform(F.concat(F.filter(held["now"], lambda r: r["state"] >= 0), F.array(fresh)), lambda r: move(r, token)).alias("now"), F.concat(held["done"], F.filter(held["now"], lambda r: (r["state"] < 0) & ((r["own"] >= 0) | (r["large"] >= 0)))).alias("done"))

    none = F.array().cast(f"array<{RUN}>")
    grown = F.aggregate(items, F.struct(none.alias("now"), none.alias("done")), step, lambda h: F.concat(h["done"], F.filter(h["now"], lambda r: (r["own"] >= 0) | (r["large"] >= 0))))
    ended = F.transform(F.array_sort(grown), lambda r: F.struct(r["start"].alias("start"), F.when(r["own"] >= 0, r["own_end"]).otherwise(r["large_end"]).alias("end"), F.when(r["own"] >= 0, r["own"]).otherwise(r["large"]).alias("rule")))
    kind = "array<struct<start:int,end:int,rule:int>>"
    take = lambda h, r: F.when(r["start"] >= F.coalesce(F.try_element_at(h, F.lit(-1))["end"], F.lit(0)), F.concat(h, F.array(r))).otherwise(h)
    return F.aggregate(ended.cast(kind), F.array().cast(kind), take)


def may_hold(texts: Column, rules: str = RULES, kinds: list[str] | None = None) -> Column:
    """Whether tokens may hold an entity: somewhere in them, put together, the rules' expression finds something, which costs far less than the fold."""
    return F.array_join(texts, "").rlike(entity_regex(compile_rules(rules)[0], kinds)[len(BEFORE) : -len(BEHIND)])


def merge_tokens(tokens: Column, rules: str = RULES, kinds: list[str] | None = None) -> Column:
    """Tokens (an array of structs with text, tag and semantic among others) taken apart and merged by the rules; white space goes.

    A run that a rule meets becomes one token: its texts joined, tag CD, the rule as semantic, and all else from its first token. Other tokens stay as they were taken apart.
    """
    compiled = machine(rules, kinds)
    names = F.split(F.lit(",".join(compiled.names)), ",")

    def merged(apart: Column, run: Column) -> Column:
        text = F.array_join(F.transform(F.slice(apart, run["start"] + 1, run["end"] - run["start"]), lambda t: t["text"]), "")
        return F.struct(run["start"].alias("at"), F.get(apart, run["start"]).withField("text", text).withField("tag", F.lit("CD")).withField("semantic", F.get(names, run["rule"])).alias("token"))

    def whole(apart: Column, found: Column) -> Column:
        free = lambda x: (F.trim(x["token"]["text"]) != "") & ~F.exists(found, lambda r: (r["start"] <= x["at"]) & (x["at"] < r["end"]))
        rest = F.filter(F.transform(apart, lambda t, k: F.struct(k.alias("at"), t.alias("token"))), free)
        return F.transform(F.array_sort(F.concat(F.transform(found, lambda r: merged(apart, r)), rest), lambda a, b: a["at"] - b["at"]), lambda x: x["token"])

    taken = F.flatten(F.transform(tokens, T.retokenize))
    every = T.bound(taken, lambda apart: T.bound(runs(F.transform(apart, lambda t: t["text"]), compiled), lambda found: whole(apart, found)))
    return F.when(may_hold(F.transform(tokens, lambda t: t["text"]), rules, kinds), every).otherwise(T.drop_space_tokens(taken))


def longest(rows: DataFrame, key: str, text: str, kinds: list[str] | None = None, rules: str = RULES) -> DataFrame:
    """key, entity, kind of each run of a text's tokens that a rule meets, by the machine: the longest at each place, whatever the rules."""
    compiled = machine(rules, kinds)
    names = F.split(F.lit(",".join(compiled.names)), ",")
    held = rows.select(key, T.raw_tokens(text).alias("_t")).where(may_hold(F.col("_t"), rules, kinds))
    found = held.select(key, "_t", F.explode(runs(F.col("_t"), compiled)).alias("_r"))
    return found.select(key, F.array_join(F.slice("_t", F.col("_r.start") + 1, F.col("_r.end") - F.col("_r.start")), "").alias("entity"), F.get(names, F.col("_r.rule")).alias("kind"))
