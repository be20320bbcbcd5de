"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, and how often their links occur in the corpus.

What lies in a byte range of a text is a fragment: an open prefix up to the first byte at which tokens of both end, closed groups, and an open suffix. Fragments compose: the
suffix of one and the prefix of the next close to a group, and this is associative. Words behind single spaces are fragments without open ends and are remembered; very
long documents are cut into ranges that different tasks turn into fragments, whose open ends are composed in a tree.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .packing import Encoder
from .parity_join import beside_counted

CHUNK = 65_536  #: characters of a range of a long document; shorter documents are one fragment
REMEMBERED = 400_000  #: words whose fragments a worker remembers; only speed depends on it
PACKED = 2_000_000  #: id pairs of a pack of documents, at least one document
SPACE = "▁"  #: how the vocabulary of pieces writes a space
SAFE = re.compile(r"(?<=\S) (?=\S)")  #: neither tokenizer joins such a space with what stands before it
Ids = list[int]


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the other bytes in order for 256 and on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Aligner:
    """Two tokenizers, the bytes of their tokens, and the fragments of the words that were seen."""

    def __init__(self, byte_bpe: str, pieces: str):
        from sentencepiece import SentencePieceProcessor

        self.encoder = Encoder(byte_bpe)
        self.encoder.tokenizer.encode_special_tokens = True
        self.pieces = SentencePieceProcessor(model_file=pieces)
        vocabulary, table = self.encoder.tokenizer.get_vocab(), byte_level()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(table.get(c, 0) for c in token)
        names = [self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size())]
        self.bytes_b = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace(SPACE, " ").encode() for n in names]
        self.long_a, self.long_b = [*map(len, self.bytes_a)], [*map(len, self.bytes_b)]
        self.words: dict[str, tuple | None] = {}
        self.odd: dict[str, tuple | None] = {}

    def ids(self, text: str) -> tuple[Ids, Ids] | None:
        """Ids of space + text by both; None if the bytes of either's tokens aren't those of the text."""
        raw = self.encoder.whole([f" {text}"])[0]
        return self.same(text, np.frombuffer(raw, "<u4").tolist(), self.pieces.encode(text))

    def same(self, text: str, a: Ids, b: Ids) -> tuple[Ids, Ids] | None:
        wanted = b" " + text.encode()
        return (a, b) if b"".join([self.bytes_a[k] for k in a]) == wanted == b"".join([self.bytes_b[k] for k in b]) else None

    def groups(self, a: Ids, b: Ids) -> Iterator[tuple[Ids, Ids]]:
        """The groups of two token lists that cover the same bytes."""
        if len(a) == 1 or len(b) == 1:
            if a and b:
                yield a, b
            return
        long_a, long_b = self.long_a, self.long_b
        j = at_a = at_b = from_a = from_b = 0
        for i, k in enumerate(a, 1):
            at_a += long_a[k]
            while at_b < at_a:
                at_b += long_b[b[j]]
                j += 1
            if at_a == at_b:
                yield a[from_a:i], b[from_b:j]
                from_a, from_b = i, j

    def closed(self, groups: Iterable[tuple[Ids, Ids]]) -> tuple[bytes, bytes, bytes]:
        """What counts of closed groups: their text, the id pairs of all links, and the numbers of tokens, groups and links."""
        size, n_a, n_b, texts, pairs = len(self.bytes_b), 0, 0, [], []
        for a, b in groups:
            n_a += len(a)
            n_b += len(b)
            if len(a) == len(b) == 1:
                texts.append(f"{a[0]}|{b[0]}")
                pairs.append(a[0] * size + b[0])
            else:
                texts.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
                pairs += [x * size + y for x in a for y in b]
        return ";".join(texts).encode(), array("q", pairs).tobytes(), array("q", (n_a, n_b, len(texts), len(pairs))).tobytes()

    def learn(self, words: list[str]) -> None:
        """Remember the fragments of words that stand behind a single space and don't begin or end with white space."""
        self.encoder.learn(words)
        for word, b in zip(words, self.pieces.encode(words, num_threads=1), strict=True):
            both = self.same(word, np.frombuffer(self.encoder.words.pop(word), "<u4").tolist(), b)
            self.words[word] = self.closed(self.groups(*both)) if both else None

    def fragments(self, text: str) -> list[tuple | None]:
        """The fragments of the parts of a text between safe spaces, whatever white space it has."""
        out = []
        for part in SAFE.split(text):
            if part not in self.odd:
                both = self.ids(part)
                self.odd[part] = self.closed(self.groups(*both)) if both else None
            out.append(self.odd[part])
        return out

    def batch(self, texts: list[str | None]) -> Iterator[list[tuple | None]]:
        """The fragments of each text."""
        split = [t.split(" ") if t else [] for t in texts]
        missing = {w for words in split for w in words} - self.words.keys()
        if len(self.words) + len(missing) > REMEMBERED:
            self.words.clear()
            missing = {w for words in split for w in words}
        if len(self.odd) > REMEMBERED // 8:
            self.odd.clear()
        self.learn([w for w in missing if w and not w[0].isspace() and not w[-1].isspace()])
        for text, words in zip(texts, split, strict=True):
            try:
                yield [self.words[w] for w in words]
            except KeyError:  # white space of another kind
                yield self.fragments(text)


#: doc_id, how many rows are alike in it and their text, the counts, the digest, distinct id pairs and how many links each has
Document = tuple[int | None, int, list[int], str, np.ndarray, np.ndarray]
NOTHING = ([0] * 4, "", np.empty(0, np.int64), np.empty(0, np.int64))


def document(doc: int | None, copies: int, parts: list[tuple | None]) -> Document:
    """The document that fragments without open ends make; nothing if one of them isn't whole."""
    if not parts or None in parts:
        return (doc, copies, *NOTHING)
    pairs, times = np.unique(np.frombuffer(b"".join([p[1] for p in parts]), np.int64), return_counts=True)
    counts = np.frombuffer(b"".join([p[2] for p in parts]), np.int64).reshape(-1, 4).sum(axis=0).tolist()
    return doc, copies, counts, hashlib.sha256(b";".join([p[0] for p in parts if p[0]])).hexdigest(), pairs, times


COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]


def packs(documents: Iterable[Document], first: int) -> Iterator[pa.RecordBatch]:
    """Documents in packs of about PACKED id pairs: a number, the distinct id pairs of the pack, the documents that hold each, and the documents, compressed."""
    held: list[Document] = []

    def pack(number: int) -> pa.RecordBatch:
        sizes = [len(d[4]) for d in held]
        pairs, place = np.unique(np.concatenate([d[4] for d in held]), return_inverse=True)
        holders = np.bincount(place, np.repeat([d[1] for d in held], sizes), len(pairs)).astype(np.int64)
        columns = {"doc_id": pa.array([d[0] for d in held], pa.int64()), "copies": pa.array([d[1] for d in held], pa.int64())}
        columns |= {name: pa.array([d[2][k] for d in held], pa.int64()) for k, name in enumerate(COLUMNS)}
        columns |= {"groups_sha256": pa.array([d[3] for d in held], pa.string()), "size": pa.array(sizes, pa.int64())}
        narrow = np.uint16 if len(pairs) < 1 << 16 else np.uint32
        columns |= {"places": pa.array([place.astype(narrow).tobytes()] + [None] * (len(held) - 1), pa.binary()), "times": pa.array([np.concatenate([d[5] for d in held]).astype(np.uint32).tobytes()] + [None] * (len(held) - 1), pa.binary())}
        table, sink = pa.table(columns), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([pairs], pa.list_(pa.int64())), pa.array([holders], pa.list_(pa.int64())), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["pack", "pairs", "holders", "documents"])

    number, total = first, 0
    for d in documents:
        held.append(d)
        total += len(d[4])
        if total >= PACKED or len(held) >= PACKED // 100:
            yield pack(number)
            held, number, total = [], number + 1, 0
    if held:
        yield pack(number)


def pack_number(source: int) -> int:
    """The first number of a task's packs, for each source of documents apart."""
    return source << 62 | TaskContext.get().partitionId() << 32


PACK = "pack long, pairs array<long>, holders array<long>, documents binary"


def short_documents(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """Packs of documents each of which a task aligns as a whole."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_bpe, pieces)

        def documents() -> Iterator[Document]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    for doc, parts in zip(batch.column("doc_id").to_pylist(), aligner.batch(batch.column("text").to_pylist()), strict=True):
                        yield document(doc, 1, parts)

        yield from packs(documents(), pack_number(0))

    return docs.select("doc_id", "text").mapInArrow(align, PACK)


def ranges(text: str, chunk: int) -> Iterator[tuple[str, int, int]]:
    """Ranges of characters of " " + text, about `chunk` long, each as the text between safe cuts around it (without the space it begins with), and the bytes of that, space included,
    at which the range begins and ends. A word longer than `chunk` lies in one range, so what stands around a range is at most two chunks."""
    at, whole = 0, f" {text}"
    while at < len(whole):
        end = min(at + chunk, len(whole))
        start, stop = _cut_at(whole, at, False), _cut_at(whole, end, True)
        if end < len(whole) and stop - _cut_at(whole, end, False) > chunk:
            end = stop
        yield whole[start + 1 : stop], len(whole[start:at].encode()), len(whole[start:end].encode())
        at = end


def _cut_at(whole: str, at: int, behind: bool) -> int:
    """The safe space of a text next to `at`, before or behind it; its begin or end if there is none."""
    while 0 < at < len(whole):
        if whole[at] == " " and not whole[at - 1].isspace() and at + 1 < len(whole) and not whole[at + 1].isspace():
            return at
        at = whole.find(" ", at + 1) if behind else whole.rfind(" ", 0, at)
        at = len(whole) if at < 0 and behind else max(at, 0)
    return at


def fragment(aligner: Aligner, text: str, low: int, high: int) -> dict | None:
    """The fragment of the bytes (low, high] of " " + text, which is cut at safe spaces; a token belongs to the range in which it ends."""
    both = aligner.ids(text)
    if not both:
        return None
    ends = [np.cumsum([0, *(len(table[k]) for k in ids)])[1:] for ids, table in zip(both, (aligner.bytes_a, aligner.bytes_b), strict=True)]
    inside = [(e > low) & (e <= high) for e in ends]
    (a, b), (ends_a, ends_b) = [[k for k, i in zip(ids, own, strict=True) if i] for ids, own in zip(both, inside, strict=True)], [e[own] for e, own in zip(ends, inside, strict=True)]
    common = np.intersect1d(ends_a, ends_b)
    if not len(common):
        return {"closed": False, "pre_a": a, "pre_b": b, "suf_a": [], "suf_b": [], "groups": aligner.closed([])}
    cuts = list(zip(np.searchsorted(ends_a, common, "right").tolist(), np.searchsorted(ends_b, common, "right").tolist(), strict=True))
    (pa_, pb), (sa, sb) = cuts[0], cuts[-1]
    inner = [(a[x:u], b[y:v]) for (x, y), (u, v) in zip(cuts, cuts[1:], strict=False)]
    return {"closed": True, "pre_a": a[:pa_], "pre_b": b[:pb], "suf_a": a[sa:], "suf_b": b[sb:], "groups": aligner.closed(inner)}


ENDS = "closed boolean, pre_a array<int>, pre_b array<int>, suf_a array<int>, suf_b array<int>"


def composed(left: str, right: str) -> dict:
    """The open ends of two neighbours together, as columns. `first` is the place at which a prefix closes."""
    l, r = (lambda f: F.col(f"{left}.{f}")), (lambda f: F.col(f"{right}.{f}"))
    none = F.array().cast("array<int>")
    out = {"closed": l("closed") | r("closed"), "first": F.when(l("closed"), l("first")).otherwise(r("first"))}
    for side in "ab":
        out[f"pre_{side}"] = F.when(l("closed"), l(f"pre_{side}")).otherwise(F.concat(l(f"pre_{side}"), r(f"pre_{side}")))
        out[f"suf_{side}"] = F.when(r("closed"), r(f"suf_{side}")).when(l("closed"), F.concat(l(f"suf_{side}"), r(f"pre_{side}"))).otherwise(none)
    return out


def seams(leaves: DataFrame) -> DataFrame:
    """The groups that close where fragments meet: doc, place (they stand before the closed groups of that range), a and b. Neighbours are composed in a tree; only open ends travel."""
    ends = ["closed", "first", "pre_a", "pre_b", "suf_a", "suf_b"]
    now = cut(leaves.select("doc", "place", F.col("place").alias("first"), *(c for c in ends if c != "first")))
    found = []
    while (now.agg(F.max("place")).first()[0] or 0) > 0:
        two = now.groupBy("doc", F.expr("place div 2").alias("place")).agg(F.sort_array(F.collect_list(F.struct(F.col("place").alias("own"), *ends))).alias("_n"))
        two = cut(two.select("doc", "place", F.col("_n")[0].alias("l"), F.when(F.size("_n") > 1, F.col("_n")[1]).alias("r")))
        found.append(two.where("l.closed and r.closed").select("doc", F.col("r.first").alias("place"), F.concat("l.suf_a", "r.pre_a").alias("a"), F.concat("l.suf_b", "r.pre_b").alias("b")))
        alone = two.where("r is null").select("doc", "place", *(F.col(f"l.{c}").alias(c) for c in ends))
        now = alone.unionByName(two.where("r is not null").select("doc", "place", *(x.alias(c) for c, x in composed("l", "r").items())))
    out = now.select("doc", F.col("first").alias("place"), F.col("pre_a").alias("a"), F.col("pre_b").alias("b"))
    for x in found:
        out = out.unionByName(x)
    return out.where("size(a) > 0")


def long_documents(docs: DataFrame, byte_bpe: str, pieces: str, chunk: int) -> DataFrame:
    """Packs of documents whose ranges are aligned by different tasks. Rows that are alike in doc_id and text are aligned once."""
    alike = docs.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    alike = alike.withColumn("doc", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), 256))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for place, (text, low, high) in enumerate(ranges(row["text"], chunk)):
                    made = {k: row[k] for k in named} | {"place": place, "part": text, "low": low, "high": high}
                    yield pa.RecordBatch.from_pylist([made], pa.schema([*named.items(), ("place", pa.int32()), ("part", pa.string()), ("low", pa.int64()), ("high", pa.int64())]))

    named = {"doc": pa.string(), "doc_id": pa.int64(), "copies": pa.int64()}
    kinds = named | {"place": pa.int32(), "whole": pa.bool_(), "closed": pa.bool_(), **dict.fromkeys(("pre_a", "pre_b", "suf_a", "suf_b"), pa.list_(pa.int32())), "text": pa.binary(), "pairs": pa.binary(), "counts": pa.binary()}

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_bpe, pieces)
        for batch in batches:
            for row in batch.to_pylist():
                made = fragment(aligner, row["part"], row["low"], row["high"])
                text, pairs, counts = made.pop("groups") if made else aligner.closed([])
                made = {k: row[k] for k in (*named, "place")} | {"whole": made is not None, "closed": False, "pre_a": [], "pre_b": [], "suf_a": [], "suf_b": []} | (made or {}) | {"text": text, "pairs": pairs, "counts": counts}
                yield pa.RecordBatch.from_pylist([made], pa.schema(list(kinds.items())))

    parts = alike.mapInArrow(split, "doc string, doc_id long, copies long, place int, part string, low long, high long").repartition("doc", "place")
    leaves = cut(parts.mapInArrow(leaf, f"doc string, doc_id long, copies long, place int, whole boolean, {ENDS}, text binary, pairs binary, counts binary"))
    rows = leaves.select(*named, "place", F.lit(1).alias("kind"), "whole", "text", "pairs", "counts", F.array().cast("array<int>").alias("a"), F.array().cast("array<int>").alias("b"))
    met = seams(leaves).select("doc", "place", F.lit(0).alias("kind"), F.lit(True).alias("whole"), "a", "b")
    rows = rows.unionByName(met, allowMissingColumns=True).repartition("doc").sortWithinPartitions("doc", "place", "kind")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_bpe, pieces)

        def documents() -> Iterator[Document]:
            doc, known, parts = None, (None, 0), []
            for row in (r for batch in batches for r in batch.to_pylist()):
                if doc and row["doc"] != doc:
                    yield document(*known, parts)
                    parts = []
                doc = row["doc"]
                if row["kind"]:
                    known = row["doc_id"], row["copies"]
                own = (row["text"], row["pairs"], row["counts"]) if row["kind"] else aligner.closed([(row["a"], row["b"])])
                parts.append(own if row["whole"] else None)
            if doc:
                yield document(*known, parts)

        yield from packs(documents(), pack_number(1))

    return rows.mapInArrow(assemble, PACK)


def answered(pack: bytes, places: np.ndarray, counts: np.ndarray, best: np.ndarray) -> pa.Table:
    """The rows of a pack's documents, by the counts of its id pairs."""
    table = pa.ipc.open_stream(pack).read_all()
    n = len(counts)
    count, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count[places], top[places] = counts, best
    own = np.frombuffer(table["places"][0].as_py(), np.uint16 if n < 1 << 16 else np.uint32)
    times = np.frombuffer(table["times"][0].as_py(), np.uint32).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(table["size"].to_numpy())])
    sums = {name: np.concatenate([[0], np.cumsum(times * value[own])]) for name, value in (("n_best", top), ("count_sum", count))}
    out = {"doc_id": table["doc_id"], **{c: table[c] for c in COLUMNS}, **{name: pa.array(s[upto[1:]] - s[upto[:-1]]) for name, s in sums.items()}, "groups_sha256": table["groups_sha256"]}
    again = pa.array(np.repeat(np.arange(table.num_rows), table["copies"].to_numpy()))
    return pa.table(out).take(again)


def aligned(docs: DataFrame, byte_bpe: str, pieces: str, chunk: int = CHUNK) -> DataFrame:
    """Align each text's tokens by two tokenizers. For every row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is space + text by the byte-level vocabulary, B the text by the vocabulary of pieces, which adds the space; special tokens' strings are plain text. Bytes at which tokens of both end cut
    them into groups; links are all A-B pairs of tokens of one group. The count of an id pair is the number of documents that hold it linked; n_best counts a document's links
    whose count is the highest of their A id, ties included, count_sum adds the counts of its links. groups_sha256 is the digest of `a1,a2|b1;a3|b2,b3`.

    Texts that are null, empty, or whose joined tokens aren't space + text in either have no tokens: zeros and ''. Rows that repeat are documents of their own. Null doc_ids stay. Extra columns are
    ignored. An empty table gives an empty result. A word of any length is encoded by one task; all else of a text longer than `chunk` characters by several.

    Documents travel in compressed packs that ask for their distinct id pairs once, so an id pair that all documents hold is asked for once a pack. Only the highest count of
    each A id, a row for each id of the vocabulary, and counts of the most frequent pairs, at most 10,000, are broadcast.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    packed = cut(short_documents(docs.where(~long), byte_bpe, pieces).unionByName(long_documents(docs.where(long), byte_bpe, pieces, chunk)))
    width = piece_count(pieces)
    held = packed.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).select("x.*")
    counts = cut(held.groupBy("pairs").agg(F.sum("holders").alias("count"), F.count("*").alias("n")))
    own = F.expr(f"pairs div {width}").alias("a")
    best = counts.groupBy(own).agg(F.max("count").alias("most"))
    facts = counts.withColumn("a", own).join(F.broadcast(best), "a").select("pairs", "count", (F.col("count") == F.col("most")).cast("int").alias("best"), "n")
    asked = packed.select("pack", F.posexplode("pairs").alias("place", "pairs"))
    total = packed.agg(F.sum(F.size("pairs"))).first()[0] or 0
    told = beside_counted(asked, facts, ["pairs"], total).select(F.col("pack").alias("of"), "place", "count", "best")

    def answer(mine: pa.Table, answers: pa.Table) -> pa.Table:
        made = [answered(x, *(answers[c].to_numpy() for c in ("place", "count", "best"))) for x in mine["documents"].to_pylist()]
        return pa.concat_tables(made)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return packed.select("pack", "documents").groupBy("pack").cogroup(told.groupBy("of")).applyInArrow(answer, schema)


def piece_count(pieces: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces).get_piece_size()
