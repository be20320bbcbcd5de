"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of character 5-grams, one for each language.

Documents travel in compressed chunks of fixed size. A chunk names its distinct n-grams; these rows meet by n-gram, the distinct ones meet the model's counts in
shards, so nothing that grows with the corpus is broadcast or gathered in one row; the answers return to the chunk, where every document's perplexity is added
up from whole texts. For the counts, only documents travel whose ids fall on a bitmap of fixed size of the trusted ids; the exact test follows in the chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW, STEP, beside, cut, hash_words, mix, quantiles, text_bytes, window_hashes

ORDER = 5
CODES = 0x110000  #: symbols: all code points
POOL = "\x1fpool"  #: the model of all trusted text together, for languages that have none
CHUNK_BYTES = 128 << 20  #: of text in a chunk, whatever the number of partitions
MARKS = 24  #: bits of a hash, for each of which the bitmap of trusted ids has a bit
SLICE = 1 << 19  #: symbols that are looked at together in a chunk; only memory and speed depend on it
SENT = 1 << 16  #: n-grams that a chunk sends together
SHARD = 200_000  #: distinct n-grams in a shard of the model
LEVEL = 9  #: of the compression in which texts travel
PRIOR = 200  #: symbols at the language's median that are added to each document, so that short ones aren't judged by chance
FENCE = 6.0  #: interquartile ranges above the upper quartile of trusted documents at which a language's threshold stands
GRID = 4096  #: rates are rounded to so many steps a nat before quantiles are taken


def symbols(text: str) -> np.ndarray:
    """Code points, ORDER - 1 boundaries before and one behind. The boundary is code point 0."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([np.zeros(ORDER - 1, np.uint32), code, np.zeros(1, np.uint32)])


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: symbols, where each n-gram begins, its 64-bit key, and how many n-grams each text has."""
    parts = [symbols(t) for t in texts]
    counts = np.array([len(x) - ORDER + 1 for x in parts], np.int64)
    code = np.concatenate([np.empty(0, np.uint32), *parts])
    starts = np.cumsum([0, *(len(x) for x in parts)])[:-1]
    place = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return code, place, window_hashes(code.astype(np.uint64), ORDER)[place], counts


def _pack(marked: np.ndarray | None):
    """Documents of a batch to their chunks, texts compressed together; with a bitmap only those whose mark is set."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            if marked is not None:
                marks = batch.column("mark").to_numpy(zero_copy_only=False).astype(np.int64)
                batch = batch.take(pa.array(np.flatnonzero(marked[marks >> 6] >> (marks & 63).astype(np.uint64) & np.uint64(1))))
            ids, langs, numbers, texts = (batch.column(c).to_pylist() for c in ("doc_id", "lang", "chunk", "text"))
            by: dict[int, list[int]] = {}
            for k, chunk in enumerate(numbers):
                by.setdefault(chunk, []).append(k)
            for chunk, ks in by.items():
                raw = [(texts[k] or "").encode("utf-8", "surrogatepass") for k in ks]
                row = {"chunk": chunk, "ids": [ids[k] for k in ks], "langs": [langs[k] for k in ks], "sizes": [len(x) for x in raw], "texts": press.compress(b"".join(raw))}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("chunk", pa.int32()), ("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("texts", pa.binary())]))

    return pack


PACKED = "chunk int, ids array<long>, langs array<string>, sizes array<int>, texts binary"


def _slices(packed: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[int | None], list[str]]]:
    """language, ids and texts of a chunk, a slice at a time. No more texts are held than a packed row and a few slices have."""
    held: dict[str, tuple[list[int | None], list[str]]] = {}
    sizes: dict[str, int] = {}
    press = zstandard.ZstdDecompressor()
    for batch in packed:
        for k in range(batch.num_rows):
            docs, langs, lengths = (batch.column(c)[k].as_py() for c in ("ids", "langs", "sizes"))
            raw, at = press.decompress(batch.column("texts")[k].as_buffer(), max_output_size=sum(lengths)) if any(lengths) else b"", 0
            for doc, lang, length in zip(docs, langs, lengths, strict=True):
                ids, texts = held.setdefault(lang or "", ([], []))
                ids.append(doc)
                texts.append(raw[at : at + length].decode("utf-8", "surrogatepass"))
                at += length
                sizes[lang or ""] = sizes.get(lang or "", 0) + len(texts[-1]) + 1
                if sizes[lang or ""] >= SLICE:
                    sizes.pop(lang or "")
                    yield lang or "", *held.pop(lang or "")
            if sum(sizes.values()) >= 4 * SLICE:
                yield from ((lang, *x) for lang, x in sorted(held.items()))
                held, sizes = {}, {}
    yield from ((lang, *x) for lang, x in sorted(held.items()))


def _strings(codes: np.ndarray) -> pa.StringArray:
    """Rows of symbols as strings."""
    sizes = codes.shape[1] + sum((codes > x).sum(axis=1) for x in (0x7F, 0x7FF, 0xFFFF))
    text = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(text))


def _symbols_of(grams: pa.ChunkedArray) -> np.ndarray:
    """The symbols of n-grams, a row each; no string is made for any of them."""
    parts = [np.empty((0, ORDER), np.uint32)]
    for part in grams.chunks:
        if len(part):
            ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
            text = bytes(part.buffers()[2][int(ends[0]) : int(ends[-1])]).decode("utf-8", "surrogatepass")
            parts.append(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER))
    return np.concatenate(parts)


COUNTED = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
ASKED = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("chunk", pa.int32())])  # none of them is null, else joins would push tests of that below the exchange, each its own
SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("surprise", pa.float64())])


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Keys in order, symbols and counts of n-grams, each once."""
    keys, codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, first, number = np.unique(keys, return_index=True, return_inverse=True)
    return keys, codes[first], np.bincount(number, n, len(first)).astype(np.int64)


def _gathered(packed: Iterable[pa.RecordBatch], good: set[int] | None) -> Iterator[tuple[str, pa.StringArray, np.ndarray]]:
    """By language the distinct n-grams of a chunk with their counts, of all documents or of the good ones. Slices add to what is known, so only the distinct ones are held."""
    found: dict[str, list[tuple[np.ndarray, ...]]] = {}
    for lang, ids, texts in _slices(packed):
        code, place, keys, _ = grams_of([t for d, t in zip(ids, texts, strict=True) if good is None or d in good])
        number, distinct = pd.factorize(keys)
        first = np.empty(len(distinct), np.int64)
        first[number[::-1]] = place[::-1]
        n = np.bincount(number, minlength=len(distinct))
        parts = found.setdefault(lang, [(np.empty(0, np.uint64), np.empty((0, ORDER), np.uint32), np.empty(0, np.int64))])
        known, _, counts = parts[0]
        at = np.searchsorted(known, distinct)
        seen = at < len(known)
        seen[seen] = known[at[seen]] == distinct[seen]
        counts[at[seen]] += n[seen]
        new = ~seen
        parts.append((distinct[new], code[first[new][:, None] + np.arange(ORDER)], n[new]))
        if sum(len(x[0]) for x in parts[1:]) >= SLICE // 4:
            found[lang] = [_merged(parts)]
    for lang in sorted(found):
        _, codes, n = _merged(found.pop(lang))
        yield lang, _strings(codes), n


def _counted(packed: pa.Table, trusted: pa.Table) -> pa.Table:
    found = _gathered(packed.to_batches(), set(trusted["doc_id"].to_pylist())) if packed.num_rows else ()
    return pa.concat_tables([COUNTED.empty_table(), *(pa.table([pa.repeat(lang, len(grams)), grams, pa.array(n)], schema=COUNTED) for lang, grams, n in found)])


def _asked(packed: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(packed)
    chunk = first.column("chunk")[0].as_py()
    for lang, grams, _ in _gathered(chain([first], packed), None):
        for k in range(0, len(grams), SENT):
            part = grams[k : k + SENT]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), part, pa.array(np.full(len(part), chunk, np.int32))], schema=ASKED)


def _scored(packed: pa.Table, answers: pa.Table) -> pa.Table:
    """Each document's symbols and their surprise in nats, summed."""
    models = answers["model"].combine_chunks().dictionary_encode()
    number, codes, told = models.indices.to_numpy(), _symbols_of(answers["gram"]), answers["surprise"].to_numpy()
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for k, model in enumerate(models.dictionary.to_pylist()):
        own = np.flatnonzero(number == k)
        keys = window_hashes(codes[own].T.astype(np.uint64), ORDER)[0]
        order = np.argsort(keys)
        known[model] = keys[order], told[own[order]]
    del answers, models, number, codes, told
    out = [SCORED.empty_table()]
    for lang, ids, texts in _slices(packed.to_batches()):
        keys, surprise = known[lang] if lang in known else known[POOL]
        _, _, grams, counts = grams_of(texts)
        number, distinct = pd.factorize(grams)
        sums = np.add.reduceat(surprise[np.searchsorted(keys, distinct)].astype(np.float64)[number], np.cumsum(counts) - counts)
        out.append(pa.table([pa.array(ids, pa.int64()), pa.array([lang] * len(ids), pa.string()), pa.array(counts), pa.array(sums)], schema=SCORED))
    return pa.concat_tables(out)


def _keyed(models: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit keys of rows of symbols under their models."""
    key = models.copy()
    for column in codes.T:
        key = mix(key * STEP + column.astype(np.uint64))
    return key


def _codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the models, and the symbols (rows, ORDER) of the n-grams."""
    codes = _symbols_of(table["gram"])
    place, names = pd.factorize(table["model"].to_numpy())
    return hash_words([x.encode() for x in names])[place] if len(place) else np.empty(0, np.uint64), codes


def _tables(models: np.ndarray, codes: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """From the highest order to 2: order, the rows of one n-gram each, their last symbols, and counts: of occurrences in the highest order, of distinct symbols before in the lower ones."""
    rows = np.arange(len(codes))
    yield ORDER, rows, codes, n
    for order in range(ORDER - 1, 1, -1):
        ends = codes[rows][:, ORDER - order :]
        _, first, counts = np.unique(_keyed(models[rows], ends), return_index=True, return_counts=True)
        rows = rows[first]
        yield order, rows, ends[first], counts


FACTS = pa.schema([("model", pa.string()), ("order", pa.int32()), ("symbol", pa.int32()), *((f"n{k}", pa.int64()) for k in range(1, 5)), ("n", pa.int64())])


def _facts(counts: pa.Table) -> pa.Table:
    """Of a shard: how many n-grams of each order and model have counts of 1 to 4; and of each last symbol the distinct symbols before it."""
    models, codes = _codes(counts)
    names = counts["model"].to_numpy()
    rows = []
    for order, at, ends, n in _tables(models, codes, counts["n"].to_numpy()):
        for model in pd.unique(names[at]):
            own = n[names[at] == model]
            rows.append((model, order, None, *(int((own == k).sum()) for k in range(1, 5)), 0))
    for (model, symbol), n in zip(*np.unique(np.rec.fromarrays([names[at].astype("U"), ends[:, -1]]), return_counts=True), strict=True):
        rows.append((str(model), 1, int(symbol), 0, 0, 0, 0, int(n)))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), FACTS, strict=True)], schema=FACTS)


def _told(counts: pa.Table, asked: pa.Table) -> pa.Table:
    """The asked n-grams of a shard with their p, from the lowest order up: held mass of the n-gram, and the context's free mass for the order below."""
    models, codes = _codes(counts)
    wanted, sought = _codes(asked)
    p = asked["lower"].to_numpy()
    taken = counts["taken"].combine_chunks().flatten().to_numpy().reshape(-1, 3 * (ORDER - 1))
    for order, at, ends, n in reversed(list(_tables(models, codes, counts["n"].to_numpy()))):
        d = taken[at, 3 * (order - 2) + np.minimum(n, 3) - 1]
        keys, contexts = _keyed(models[at], ends), _keyed(models[at], ends[:, :-1])
        sort = np.argsort(keys)
        known, place = np.unique(contexts, return_inverse=True)
        total, free = (np.bincount(place, x, len(known)) for x in (n, d))
        mine = sought[:, ORDER - order :]
        own, context = _keyed(wanted, mine), _keyed(wanted, mine[:, :-1])
        if not len(known):
            continue
        k = sort[np.minimum(np.searchsorted(keys, own, sorter=sort), len(sort) - 1)]
        c = np.minimum(np.searchsorted(known, context), len(known) - 1)
        held = np.where(keys[k] == own, n[k] - d[k], 0)
        p = np.where(known[c] == context, (held + free[c] * p) / total[c], p)
    return pa.table([asked["model"], asked["gram"], pa.array(p)], names=["model", "gram", "p"])


def _discounts(n1: Column, n2: Column, n3: Column, n4: Column) -> list[Column]:
    """The three discounts from the counts of counts, within bounds that only small corpora reach."""
    n1, n2, n3, n4 = (F.greatest(x.cast("double"), F.lit(1.0)) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    bound = lambda x, k: F.least(F.greatest(x, F.lit(0.1)), F.lit(k - 0.05))
    return [bound(1 - 2 * y * n2 / n1, 1), bound(2 - 3 * y * n3 / n2, 2), bound(3 - 4 * y * n4 / n3, 3)]


def kneser_ney(counts: DataFrame, asked: DataFrame, few: bool) -> DataFrame:
    """counts (model, gram, n) of the trusted text, and distinct asked (model, gram): asked with p, under the model that each names.

    The highest order counts occurrences; a lower order counts the distinct symbols before. Each order's discounts come from its counts of counts in
    the model, and a context's free mass goes to the order below, the lowest to all symbols alike. An unseen context leaves all to the order below. All orders but the lowest of
    an n-gram, with their contexts, have its last symbol but one, so they meet in one shard by that symbol, of counts and questions alike; distinct n-grams are few, whatever the
    corpus holds. The lowest order is a table of symbols. few: whether there are at most FEW models.
    """
    shards = 32 + counts.count() // SHARD
    shard = F.pmod(F.xxhash64("model", F.substring("gram", ORDER - 1, 1)), F.lit(shards)).cast("int").alias("shard")
    columns = ", ".join(f"{f.name} {'string' if f.name == 'model' else 'int' if f.name in ('order', 'symbol') else 'long'}" for f in FACTS)
    facts = counts.select("*", shard).groupBy("shard").applyInArrow(_facts, columns)
    facts = cut(facts.groupBy("model", "order", "symbol").agg(*(F.sum(f.name).alias(f.name) for f in list(FACTS)[3:])))
    each = facts.where("order > 1").select("model", "order", F.array(*_discounts(*(F.col(f"n{k}") for k in range(1, 5)))).alias("d"))
    taken = each.groupBy("model").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("order", "d"))), lambda x: x["d"])).alias("taken"))
    lowest = facts.where("order = 1").select("model", "symbol", "n")
    d1, d2, d3 = _discounts(*(F.count_if(F.col("n") == k) for k in range(1, 5)))
    several = [F.count_if(F.col("n") == k).cast("double") for k in (1, 2)] + [F.count_if(F.col("n") > 2).cast("double")]
    free = several[0] * d1 + several[1] * d2 + several[2] * d3
    whole = lowest.groupBy("model").agg(d1.alias("d1"), d2.alias("d2"), d3.alias("d3"), F.sum("n").alias("total"), free.alias("free"))
    held = F.col("n") - F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    seen = beside(lowest, whole.select("model", "d1", "d2", "d3"), "model", few).select("model", F.col("symbol").alias("last"), held.alias("held"))
    met = beside(asked, whole.select("model", "total", "free"), "model", few, "left").withColumn("last", F.ascii(F.right("gram", F.lit(1)))).join(seen, ["model", "last"], "left")
    lower = F.when(F.col("total").isNull(), F.lit(1.0 / CODES)).otherwise((F.coalesce("held", F.lit(0.0)) + F.col("free") / CODES) / F.col("total"))
    questions = met.select("model", "gram", lower.alias("lower"), shard)
    table = beside(counts, taken, "model", few).select("model", "gram", "n", "taken", shard)
    return table.groupBy("shard").cogroup(questions.groupBy("shard")).applyInArrow(_told, "model string not null, gram string not null, p double")


def _rounded(rate: Column) -> Column:
    return F.round(rate * GRID) / GRID


def _fence(rated: DataFrame) -> DataFrame:
    quartiles = quantiles(rated, "lang", F.col("rate"), {"low": 0.25, "high": 0.75})
    return quartiles.select("lang", (F.col("high") + FENCE * (F.col("high") - F.col("low"))).alias("fence"))


def classified(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, trusted, kept of every row of docs (doc_id, text, lang), trained on the documents that `trusted` names by doc_id.

    perplexity: of a symbol, smoothed by PRIOR symbols at the median of the language, its logarithm rounded to 1 / GRID. threshold: the upper quartile of the trusted documents' log
    perplexities and FENCE times their interquartile range, of each language; kept: not above it. A language without trusted text is scored by the model of all trusted text
    together, and its threshold comes from all its own documents, as none of them is trusted; without any trusted text all symbols are alike, so all are kept. A null text
    counts as empty (its boundary alone is scored), a null language as the empty one, a null doc_id is never trusted; rows that occur twice count and come out twice; extra columns are
    ignored; an empty table gives an empty result.
    """
    chunks = max(1, -(-text_bytes(docs) // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    names = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    # Rows without doc_id, of which there may be many, are dealt by their texts.
    dealt = read.select("*", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(chunks)).cast("int")).otherwise(chunk).alias("chunk"))
    mark = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - MARKS)
    marked = np.zeros(1 << (MARKS - 6), np.uint64)
    for r in names.groupBy(F.shiftright(mark, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(doc_id), {64 - MARKS}) & 63 as int))")).alias("bits")).collect():
        marked[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    training = dealt.withColumn("mark", mark).mapInArrow(_pack(marked), PACKED).groupBy("chunk").cogroup(names.select("doc_id", chunk).groupBy("chunk")).applyInArrow(_counted, "lang string not null, gram string not null, n long")
    counts = cut(training.groupBy(F.col("lang").alias("model"), "gram").agg(F.sum("n").alias("n")))
    langs = read.groupBy("lang").agg(F.lit(1).alias("one"))
    bare = cut(langs.join(counts.select(F.col("model").alias("lang")).distinct(), "lang", "left_anti").select("lang"))
    few, pooled = langs.count() <= FEW, not bare.isEmpty()
    # One exchange of the packed documents serves both: what the chunks ask, and the chunks that get the answers.
    packed = dealt.mapInArrow(_pack(None), PACKED)
    rows = packed.groupBy("chunk").applyInArrow(_asked, "lang string not null, gram string not null, chunk int not null")
    if pooled:
        counts = cut(counts.union(counts.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(POOL).alias("model"), "gram", "n")))
        rows = beside(rows, bare.withColumn("bare", F.lit(True)), "lang", few, "left")
        rows = rows.select(F.when(F.col("bare"), F.lit(POOL)).otherwise(F.col("lang")).alias("model"), "gram", "chunk")
    else:
        rows = rows.withColumnRenamed("lang", "model")
    # So does one exchange of the n-grams: for the distinct ones, and for the chunks that asked. Both use all its columns, none of which can be null, so their plans are alike.
    rows = rows.repartition("model", "gram")
    distinct = rows.groupBy("model", "gram").agg(F.min("chunk").alias("least")).where("least >= 0").select("model", "gram")
    told = kneser_ney(counts, distinct, few)
    answers = rows.join(told, ["model", "gram"]).select("model", "gram", (-F.log("p")).cast("float").alias("surprise"), "chunk")
    scored = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored, "doc_id long, lang string, n_symbols long, surprise double")
    scored = cut(scored.join(names.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))))
    middle = quantiles(scored, "lang", _rounded(F.col("surprise") / F.col("n_symbols")), {"middle": 0.5})
    rated = beside(scored, middle, "lang", few).withColumn("rate", _rounded((F.col("surprise") + PRIOR * F.col("middle")) / (F.col("n_symbols") + PRIOR)))
    fences = _fence(rated.where("trusted"))
    if pooled:
        fences = fences.union(_fence(beside(rated, bare, "lang", few)))
    out = beside(rated, fences, "lang", few, "left")
    lang = F.when(F.col("lang") != "", F.col("lang")).alias("lang")
    return out.select("doc_id", lang, "n_symbols", F.exp("rate").alias("perplexity"), F.exp("fence").alias("threshold"), "trusted", F.coalesce(F.col("rate") <= F.col("fence"), F.lit(True)).alias("kept"))
