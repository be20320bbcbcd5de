"""Secret scans with a recursive decoding worklist."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds of secrets, in the order in which ties are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Only runs that are long enough: a run that starts at its leftmost place is the longest, so shorter ones can't hide a match.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ASSIGNED = 6  #: characters at least of an assigned value

PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPED = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of a wrapped run, the breaks themselves or as escapes.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:(?:\r?\n|\\r\\n|\\n)[ \t>]*+[A-Za-z0-9+/_-]++)++={0,2}")
#: Codes of the character that codes begin with, nested straight in each other: a whole nest is taken as one level, so that depth costs no layers.
NESTED = re.compile(r"(%25)(?:25)++|(\\(?:u005[cC]|x5[cC]|u\{0*5[cC]\}|U0000005[cC]))(?:u005[cC]|x5[cC]|u\{0*5[cC]\}|U0000005[cC])++|(&#(?:38|[xX]26);)(?:#(?:38|[xX]26);)++")
BREAK = re.compile(r"(?:\r?\n|\\r\\n|\\n)[ \t>]*")
PACKED = re.compile(b"\x1f(?=\x8b\x08)|" + b"|".join(re.escape(bytes([x])) + b"(?=[" + b"".join(b"\\x%02x" % y for y in range(256) if not y & 32 and (x << 8 | y) % 31 == 0) + b"])" for x in range(8, 128, 16)))
#: ASCII as 16-bit characters, either byte first.
WIDE = re.compile(r"(?:[\t\n\r -~]\x00){6,}")
LAYER_BYTES = 1 << 24  #: of an unpacked layer that are looked at together; a larger layer is looked at in pieces
FED = 1 << 12  #: compressed bytes at a time, of which no more than 4 MB come out
OVERLAP = 1 << 16  #: characters of a piece that are looked at again with the next
TOTAL_BYTES = 1 << 32  #: unpacked in all of one text; what goes beyond is a bomb, refused and counted

Span = tuple[int, int, int]  # start, place in KINDS, end
Places = np.ndarray | int  # of each character, rising; or one for all characters, as of what unpacks from one place


def scan(text: str) -> list[Span]:
    """The base spans of one text, by start and kind."""
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if KEYWORDS.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    return sorted(out)


def _sizes(text: str) -> np.ndarray:
    """UTF-8 bytes of each character."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 1 + (code > 0x7F).astype(np.int8) + (code > 0x7FF) + (code > 0xFFFF)


def _percent(run: str) -> tuple[str, np.ndarray, np.ndarray]:
    """Percent-decoded text with the start and end in the run of each character."""
    sizes = np.ones(len(run), np.int8) if run.isascii() else _sizes(run)
    ends = np.arange(1, len(run) + 1, dtype=np.int32)
    codes = np.fromiter((m.start() for m in PERCENT.finditer(run)), np.int64)
    sizes[codes + 1] = sizes[codes + 2] = 0
    ends[codes] += 2
    lo = np.repeat(np.arange(len(run), dtype=np.int32), sizes)
    return _characters(unquote_to_bytes(run.encode("utf-8", "surrogatepass")), lo, np.repeat(ends, sizes))


def _characters(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Places of bytes to places of the characters that they make; bytes that aren't UTF-8 are read as latin-1, so none is lost."""
    text = _text(raw)
    if len(text) == len(raw):
        return text, lo, hi
    sizes = _sizes(text)
    ends = np.cumsum(sizes, dtype=np.int64)
    return text, lo[ends - sizes], hi[ends - 1]


def _stretches(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Each stretch without white space that holds a match."""
    seen = 0
    for m in pattern.finditer(text):
        if m.start() < seen:
            continue
        start, end = m.start(), m.end()
        while start > seen and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        seen = end
        yield start, end


def _shortened(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The text with each nest of codes as its first code, with the start and end of each character; the last character of that code stands for the whole nest."""
    made, lo, hi, k = [], [], [], 0
    for m in NESTED.finditer(text):
        first = m[m.lastindex]
        upto = m.start() + len(first)
        made.append(text[k:upto])
        lo.append(np.arange(k, upto, dtype=np.int32))
        hi += [np.arange(k + 1, upto, dtype=np.int32), np.array([m.end()], np.int32)]
        k = m.end()
    made.append(text[k:])
    lo.append(np.arange(k, len(text), dtype=np.int32))
    hi.append(np.arange(k + 1, len(text) + 1, dtype=np.int32))
    return "".join(made), np.concatenate(lo), np.concatenate(hi)


def _escapes(text: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Each stretch with Unicode escapes or character references, unescaped."""
    for start, end in _stretches(ESCAPED, text):
        made, lo, hi, k = [], [], [], start
        for e in ESCAPED.finditer(text, start, end):
            digits = re.sub(r"[^0-9A-Fa-f]", "", e[0][3:] if e[0][:3] in ("&#x", "&#X") else e[0][2:])
            code = int(digits, 10 if e[0][0] == "&" and e[0][2] not in "xX" else 16)
            made += [text[k : e.start()], chr(code) if code < 0x110000 else "\ufffd"]
            lo.append(np.arange(k, e.start() + 1, dtype=np.int32))
            hi += [np.arange(k + 1, e.start() + 1, dtype=np.int32), np.array([e.end()], np.int32)]
            k = e.end()
        made.append(text[k:end])
        lo.append(np.arange(k, end, dtype=np.int32))
        hi.append(np.arange(k + 1, end + 1, dtype=np.int32))
        yield "".join(made), np.concatenate(lo), np.concatenate(hi)


def _members(raw: bytes, at: int, budget: list[int]) -> Iterator[bytes | None]:
    """What unpacks at a place, all members end to end, in pieces of about LAYER_BYTES; a damaged or short stream gives what comes out before. None: the budget is spent."""
    view = memoryview(raw)
    while raw[at : at + 3] == b"\x1f\x8b\x08" or (len(raw) > at + 1 and raw[at] & 15 == 8 and (raw[at] << 8 | raw[at + 1]) % 31 == 0):
        worker, made, whole = zlib.decompressobj(47), bytearray(), True
        while whole and not worker.eof and at < len(raw):
            before = worker.copy()
            try:
                out = worker.decompress(view[at : at + FED])
            except zlib.error:
                out, whole = _before_damage(before, view[at : at + FED]), False
            made += out
            at += FED
            budget[0] -= len(out)
            if len(made) >= LAYER_BYTES or budget[0] < 0:
                yield bytes(made)
                made = bytearray()
            if budget[0] < 0:
                yield None
                return
        if made:
            yield bytes(made)
        if not whole or not worker.eof:
            return
        at = min(at, len(raw)) - len(worker.unused_data)


def _before_damage(worker, view: memoryview) -> bytes:
    """What comes out of the damaged bytes before the damage, in small steps."""
    made = bytearray()
    try:
        for k in range(0, len(view), 16):
            made += worker.decompress(view[k : k + 16])
    except zlib.error:
        pass
    return bytes(made)


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _unpacked(raw: bytes, budget: list[int]) -> Iterator[tuple[str | None, int]]:
    """The texts of all compressed streams in some bytes, whole or in overlapping pieces, with the stream's place; None for one that is refused."""
    for m in PACKED.finditer(raw):
        at = m.start()
        before, rest = "", b""
        for made in _members(raw, at, budget):
            if made is None:
                yield None, at
                break
            made = rest + made
            whole = len(made) - _unfinished(made)
            text, rest = _text(made[:whole]), made[whole:]
            yield before + text, at
            before = text[-OVERLAP:]
        if rest:
            yield before + _text(rest), at


def _unfinished(raw: bytes) -> int:
    """Bytes at the end that begin a character of UTF-8 and don't end it; they belong to the next piece."""
    for k in range(1, min(3, len(raw)) + 1):
        if raw[-k] >= 0xC0:
            return k if k < 2 + (raw[-k] >= 0xE0) + (raw[-k] >= 0xF0) else 0
        if raw[-k] < 0x80:
            return 0
    return 0


def _base64(run: str) -> Iterator[tuple[str, np.ndarray, np.ndarray, bytes]]:
    """A base64 run read from each of four places: text, starts and ends of its characters in the run, and its bytes."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    for skip in range(4):
        part = body[skip:]
        if len(part) % 4 == 1:
            part = part[:-1]
        if len(part) < 8:
            continue
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        lo = np.arange(skip * 6, skip * 6 + 8 * len(raw), 8, dtype=np.int32)
        hi = np.minimum((lo + 7) // 6 + 1, len(run))
        lo //= 6
        yield *_characters(raw, lo, hi), raw


def layers(text: str, budget: list[int] | None = None) -> Iterator[tuple[str, Places, Places, bool]]:
    """What one layer unwraps to: text, starts and ends of its characters in the layer, and whether it was refused. Whatever characters come out, they are a layer."""
    budget = [TOTAL_BYTES] if budget is None else budget

    def unpack(raw: bytes, start: int, end: int) -> Iterator[tuple[str, Places, Places, bool]]:
        for made, _ in _unpacked(raw, budget):
            yield made or "", start, end, made is None

    nested = NESTED.search(text)
    if nested:  # codes are decoded in that layer
        yield *_shortened(text), False
    if "%" in text and not nested:
        for start, end in _stretches(PERCENT, text):
            made, lo, hi = _percent(text[start:end])
            yield made, lo + start, hi + start, False
    if not nested and ("\\" in text or "&#" in text):
        for made, lo, hi in _escapes(text):
            yield made, lo, hi, False
    if "\x00" in text:
        for m in WIDE.finditer(text):
            lo = np.arange(m.start(), m.end(), 2, dtype=np.int32)
            yield m[0][::2], lo, lo + 2, False
    for m in BASE64.finditer(text):
        for made, lo, hi, raw in _base64(m[0]):
            yield made, lo + m.start(), hi + m.start(), False
            yield from unpack(raw, m.start(), m.end())
    for m in WRAPPED.finditer(text) if "\n" in text or "\\n" in text else ():
        gaps = [m.start(), *(x for b in BREAK.finditer(text, m.start(), m.end()) for x in b.span()), m.end()]
        lines = list(zip(gaps[::2], gaps[1::2], strict=True))
        places = np.concatenate([np.arange(s, e, dtype=np.int32) for s, e in lines])
        if len(places) >= 16:
            for made, lo, hi, raw in _base64("".join(text[s:e] for s, e in lines)):
                yield made, places[lo], places[hi - 1] + 1, False
                yield from unpack(raw, m.start(), m.end())
    # A layer of bytes stands here as latin-1, or, where they happened to be UTF-8, as characters.
    if text and (not text.isascii() or "\x1f" in text or "x\x01" in text):
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = b""
        for other in {raw, text.encode("utf-8", "surrogatepass")}:
            if other:
                yield from unpack(other, 0, len(text))


def _outside(inner: Places, outer: Places | None, last: int) -> Places:
    """Places in a layer (or ends, whose last character is one before) as places in what the layer came from."""
    if outer is None:
        return inner
    return outer if isinstance(outer, int) else outer[inner - last] if isinstance(inner, np.ndarray) else int(outer[inner - last])


def find(text: str) -> tuple[list[Span], list[Span], int, int]:
    """Base spans; all spans, in places of the text; layers unwrapped; layers refused.

    Worklist: each layer is scanned, and what it unwraps to is added, until nothing new comes; the newest is looked at first, so only the layers around one
    place are held at once. A layer that stood at the same place already isn't looked at again, so decodings that lead back to each other end.
    """
    base = scan(text)
    spans, refused, budget = set(base), 0, [TOTAL_BYTES]
    seen: set[tuple[int, int, bytes]] = set()
    work: list[tuple[str, Iterator, Places | None, Places | None]] = [(text, layers(text, budget), None, None)]
    while work:
        source, found, lo, hi = work[-1]
        if (step := next(found, None)) is None:
            work.pop()
            continue
        made, starts, ends, too_large = step
        refused += too_large
        if not made or made == source:
            continue
        starts, ends = _outside(starts, lo, 0), _outside(ends, hi, 1)
        at = lambda k, places: places if isinstance(places, int) else int(places[k])
        key = at(0, starts), at(-1, ends), hashlib.sha256(made.encode("utf-8", "surrogatepass")).digest()
        if key not in seen:
            seen.add(key)
            spans.update((at(s, starts), kind, at(e - 1, ends)) for s, kind, e in scan(made))
            work.append((made, layers(made, budget), starts, ends))
    return base, sorted(spans), len(seen), refused


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers and n_refused of every row.

    Places are code points of the text as it stands, ends exclusive; a secret that was found in an unwrapped layer has the place of the code that
    holds it. A null text counts as empty; doc_id may be null; repeated rows and extra columns do no harm; an empty table gives an empty result. A compressed
    layer is looked at in pieces of LAYER_BYTES. What unpacks beyond TOTAL_BYTES of one text is a bomb: it stays packed and counts in n_refused. Base64 is read
    from each of four places of its run, so n_layers counts readings that make no sense, too.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans, n, refused = find(text or "")
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(render(base).encode()).hexdigest(), render(spans), n, refused))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_refused"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers int, n_refused int"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, schema)


def mask_secrets(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """docs with every span of its text replaced by [SECRET]; all columns stay. Rows without a secret, and null texts, stay as they are."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                spans = find(text)[1] if text else []
                parts, here = [], 0
                for start, _, end in spans:
                    if start >= here:
                        parts += [text[here:start], "[SECRET]"]
                    here = max(here, end)
                out.append("".join([*parts, text[here:]]) if spans else text)
            k = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(k).type) if i == k else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    return docs.mapInArrow(mask, docs.schema)
