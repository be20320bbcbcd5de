"""Best-fit packing by best-two-fit.

Sequences are planned over the counts of the lengths, of which there are at most as many as a sequence has tokens, whatever the corpus holds: a plan
is a list of patterns with the number of sequences of each. Documents are then numbered within their length, and the number says which place is theirs.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

SEQUENCE = 2048
END = 0  #: id that ends each document
SPACE, LINE = "Ġ", "Ċ"  #: how the vocabulary writes a space and a line feed
REMEMBERED = 700_000  #: words whose ids a worker remembers, in halves; only speed depends on it
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"  #: characters that are letters in every version of Unicode
PLAIN = re.compile(rf"[\t-\r!-~{LETTERS}]+")  #: words that PARTS cuts as the vocabulary's pattern does
PARTS = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[0-9]+| ?[^ \t-\r0-9{LETTERS}]+|[\t-\r]+(?![^ \t-\r])|[\t-\r]+")
STEERING = re.compile(r"[\t\v\f\r]")  #: characters of PLAIN words that the vocabulary writes in yet another way
PATTERN = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"  #: the vocabulary's way to cut texts that PARTS follows


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, equal to those of encoding the whole text.

    The vocabulary's pattern never joins a space with what stands before it, so a text falls into words at single spaces
    between other characters, and each of them is encoded once for all texts. New words are encoded many in one go, and told apart by the tokens that begin with a
    space. Those of plain characters are cut here, as the tokenizer is slow at that, and their parts go to its model. A text with any other space is encoded whole.
    When half of what may be remembered is full, only words that are said again until the next half is full stay.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cuts = self.tokenizer.normalizer is None and repr(self.tokenizer.pre_tokenizer) == PATTERN
        self.parts = Tokenizer(self.tokenizer.model)
        self.parts.pre_tokenizer = CharDelimiterSplit(" ")
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        # How the vocabulary writes bytes. Byte 0 is in no part and stands between them, as a space does then, which isn't used otherwise.
        self.level = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)} | {0: " "}
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[k for token, k in vocabulary.items() if token.startswith(SPACE)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        """The fast call gives the same ids, without offsets."""
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_plain(self, words: list[str]) -> np.ndarray:
        """Ids of words of plain characters, each behind a space."""
        parts = "\0".join(PARTS.findall(" " + " ".join(words)))
        if parts.isascii() and not STEERING.search(parts):
            written = parts.replace(" ", SPACE).replace("\0", " ").replace("\n", LINE)
        else:
            written = parts.encode().decode("latin-1").translate(self.level)
        return np.array(self.parts.encode_batch_fast([written], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """Remember words, each as it is encoded behind a space."""
        plain = words if self.cuts else []
        if plain and not PLAIN.fullmatch("".join(plain)):
            plain = [w for w in plain if PLAIN.fullmatch(w)]
        if any(x in "".join(plain) for x in self.added):
            plain = [w for w in plain if not any(x in w for x in self.added)]
        others = [*(set(words) - set(plain))] if len(plain) < len(words) else []
        low, high = [w for w in plain if w.isascii()], [w for w in plain if not w.isascii()]
        for kind, size, encoded in ((low, 1 << 16, self.of_plain), (high, 1 << 16, self.of_plain), (others, 512, lambda part: np.frombuffer(self.whole([" " + " ".join(part)])[0], "<u4"))):
            for k in range(0, len(kind), size):
                part = kind[k : k + size]
                ids = encoded(part)
                starts = np.flatnonzero(self.spaced[ids])
                if len(starts) == len(part):
                    raw, ends = ids.tobytes(), [*(starts[1:] * 4).tolist(), 4 * len(ids)]
                    self.words.update(zip(part, [raw[s:e] for s, e in zip((starts * 4).tolist(), ends, strict=True)], strict=True))
                else:
                    self.words.update(zip(part, self.whole([f" {w}" for w in part]), strict=True))

    def unknown(self, said: set[str]) -> set[str]:
        """Of the words that are said, those that aren't remembered."""
        missing = said.difference(self.words)  # a lookup for each word said; with keys() it is one for each word remembered
        found = {w: self.older[w] for w in missing if w in self.older}
        self.words.update(found)
        return missing.difference(found)

    def batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        split = [t.split(" ") for t in texts]
        missing = self.unknown(said := set(chain.from_iterable(words[1:] for words in split)))
        if len(self.words) + len(missing) > REMEMBERED // 2:
            self.words, self.older = {}, self.words
            missing = self.unknown(said)
        self.learn([w for w in missing if w and w == w.strip()])
        odd = []
        for k, words in enumerate(split):
            try:
                if len(words) > 1 and (not words[0] or words[0][-1].isspace()):
                    raise KeyError
                out[k] = b"".join(map(self.words.__getitem__, words[1:]))
            except KeyError:
                odd.append(k)
        skip = set(odd)
        firsts = [k for k in range(len(texts)) if split[k][0] and k not in skip]
        for k, ids in zip(firsts, self.whole([split[k][0] for k in firsts]), strict=True):
            out[k] = ids + out[k]
        for k, ids in zip(odd, self.whole([texts[k] for k in odd]), strict=True):
            out[k] = ids
        return out


@cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.batch([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                    ids += END.to_bytes(4, "little")
                    n = len(ids) // 4
                    starts = [0, *range(n % sequence or sequence, n, sequence), n] if n > sequence else [0, n]
                    rows += [(doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(starts, starts[1:]))]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Pattern:
    lengths: list[int]
    times: int


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[Pattern]:
    """Best-two-fit over counts of lengths. Each pattern is made as often as all of its lengths last, so every pattern uses one length up."""
    left = np.zeros(sequence + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while left.any():
        room, made = sequence, []
        while room and len(fits := np.flatnonzero(left[: room + 1])):
            made.append(int(fits[-1]))
            left[fits[-1]] -= 1
            room -= made[-1]
        if room and len(made) > 1:
            made = _two_for_one(left, made, room)
        used = {x: made.count(x) for x in made}
        for length, n in used.items():
            left[length] += n
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
        out.append(Pattern(sorted(made, reverse=True), times))
    return out


def _two_for_one(left: np.ndarray, made: list[int], room: int) -> list[int]:
    """Replace the smallest document with the two unpacked ones that fit the gap it leaves most tightly, if they fill more than it does."""
    small = made[-1]
    gap = room + small
    sizes = np.flatnonzero(left[: gap + 1])
    best = small, None
    i, j = 0, len(sizes) - 1
    while i <= j:
        total = int(sizes[i] + sizes[j])
        if total > gap:
            j -= 1
            continue
        if total > best[0] and (i < j or left[sizes[i]] > 1):
            best = total, (int(sizes[i]), int(sizes[j]))
        i += 1
    if best[1] is None:
        return made
    left[small] += 1
    for x in best[1]:
        left[x] -= 1
    return [*made[:-1], *best[1]]


def _places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first number of a document, documents in each sequence, first sequence, and their offsets, by pattern."""
    found: dict[int, list[tuple]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offsets: dict[int, list[int]] = {}
        for length, end in zip(p.lengths, np.cumsum(p.lengths).tolist(), strict=True):
            offsets.setdefault(length, []).append(end - length)
        for length, at in offsets.items():
            first = taken.get(length, 0)
            found.setdefault(length, []).append((first, len(at), sequence, at[0]))
            taken[length] = first + len(at) * p.times
        sequence += p.times
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in found.items()}


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document's place in sequences of at most `sequence` tokens.

    A document of more tokens, the end id included, is cut into pieces of `sequence`, the first of which has what is over. A null text counts
    as empty and has the end id alone. Rows with a null or repeated doc_id are packed like others; extra columns are ignored; an empty table gives an
    empty result. The driver gets the counts of the lengths: at most `sequence` rows.
    """
    made = cut(pieces(docs, tokenizer, sequence))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(plan(counts, sequence))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            seq, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            begin = np.flatnonzero(np.r_[True, length[order][1:] != length[order][:-1]]) if len(order) else []
            for rows in np.split(order, begin[1:]) if len(order) else []:
                size = int(length[rows[0]])
                first, each, start, at = places[size]
                k = np.searchsorted(first, number[rows], "right") - 1
                inside = number[rows] - first[k]
                seq[rows] = start[k] + inside // each[k]
                offset[rows] = at[k] + size * (inside % each[k])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = numbered(made, "length", ["doc_id", "piece", "ids_crc32"], "number", sum(counts.values()))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
