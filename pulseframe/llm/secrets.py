"""Secret scans with a recursive decoding worklist.

Every text is scanned as it stands (the base spans). Then layers are unwrapped from a worklist until nothing new comes
out: percent escapes, and escapes of programs (Unicode, hexadecimal, octal, single letters) and of HTML (numbers, the five
names), decode a whole layer and keep a map from each decoded character to the characters it came from; an escape that is
itself escaped, however often (%252525..., \\u005cu005c..., &amp;amp;...), is one step. Runs of base64 (either alphabet, wrapped
into lines, also by a literal \\n) decode in each of their four alignments: a run that gives text as a whole maps to the whole
run, else each stretch of it that is text maps to its own characters, so that what is glued before or behind a run does not
hide it. Compressed streams (gzip, zlib, bzip2, xz, and bare deflate where a run or a part of it begins) are looked for in
decoded bytes and in runs of escaped bytes. Each new layer is scanned again and its findings are mapped back to the original
text. A layer that was seen before is not unwrapped again, so cycles end.

Decoded bytes are unwrapped through nested streams, and count as a layer if they are text: UTF-8, UTF-16 of either order, or
else bytes of which most are printable ASCII (the others stand for themselves). Inflated layers are held whole up to
`max_decoded` characters in all; beyond that `exhausted` is true and they are scanned in overlapping pieces, each unwrapped on
its own (a secret longer than the overlap may be cut there). Escapes and base64 never expand and are not charged. Positions
count code points, ends are exclusive. The work on a layer is in proportion to its length, whatever it holds.

Defined cases: a null text is an empty one; empty texts have no spans; repeated rows, and rows with a null id, are scanned
one by one; extra columns are not read; an empty table gives none.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import small_batches

# The kinds of secrets, in their order.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = ("passw", "secret", "token", "api")

_PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_PROGRAM = re.compile(r"""(?:\\u(?:005[cC]u)*[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\x(?:5[cC]x)*[0-9A-Fa-f]{2})+|(?:\\[0-3][0-7]{2})+|\\[nrt"'/\\]""")
_HTML = re.compile(r"&(?:(?:amp|#0{0,4}38|#[xX]0{0,4}26);)*(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_ESCAPES = (("%", _PERCENT), ("\\", _PROGRAM), ("&", _HTML))
#: One escape of a run, its code in the group of its kind: a byte in hexadecimal (twice), a byte in octal, a UTF-16 unit.
_ONE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})|\\x(?:5[cC]x)*([0-9A-Fa-f]{2})|\\([0-3][0-7]{2})|\\u(?:005[cC]u)*([0-9A-Fa-f]{4})")
# What single letters and names stand for.
_LETTERS = {"n": "\n", "r": "\r", "t": "\t"}
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:\r?\n[\x20\t]*|(?:\\r)?\\n)[A-Za-z0-9+/_-]++)++={0,2}")
_BREAK = re.compile(r"\r?\n[\x20\t]*|(?:\\r)?\\n")
_SEPARATOR = re.compile(r"[/_-]+")
#: Runs in which bytes may be escaped, what ends them besides, and the escapes in them.
_RAW = ((re.compile(r"[^\s\"'<>]+"), re.compile(r"%(?![0-9A-Fa-f]{2})"), re.compile(rb"%([0-9A-Fa-f]{2})"), "%"), (re.compile(r"[^\s\"'<>]+"), re.compile(r"\\(?!x[0-9A-Fa-f]{2})"), re.compile(rb"\\x([0-9A-Fa-f]{2})"), "\\x"))
_DEPTH = re.compile(r"%((?:25)*)[0-9A-Fa-f]{2}")
_STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
_CHARACTERS = re.compile("(?:\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00)[\x00-\xff]{8,}")
#: Text among other bytes, of one or of two bytes a character.
_STRETCH = re.compile(rb"[\x09\x0a\x0d\x20-\x7e]{16,}|(?:[\x09\x0a\x0d\x20-\x7e]\x00){16,}")
_PLAIN = bytes(sorted({9, 10, 13, *range(32, 127)}))
_MOST_LZMA = 1 << 28
MAX_DECODED = 1 << 24
PIECE, OVERLAP = 1 << 20, 1 << 16

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of every secret that stands in the text, by start, then kind."""
    found = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Map:
    """From positions of a layer to those of the original: runs that are copied, and runs that stand for one stretch."""

    def __init__(self, runs: list[tuple[int, int, int, bool]]):
        self.runs, self.starts = runs, [r[0] for r in runs]  # (from here on, original start, original end, copied)

    def span(self, start: int, end: int) -> tuple[int, int]:
        at, low, high, copied = self.runs[bisect.bisect_right(self.starts, start) - 1]
        first = low + start - at if copied else low
        at, low, high, copied = self.runs[bisect.bisect_right(self.starts, end - 1) - 1]
        return first, low + end - at if copied else high

    def then(self, pieces: list[tuple[int, int, int, bool]]) -> Map:
        """This map behind another one, given by pieces (from here on, start, end in this layer, copied) ."""
        out: list[tuple[int, int, int, bool]] = []
        for at, low, high, copied in pieces:
            if not copied:
                out.append((at, *self.span(low, high), False))
                continue
            k = bisect.bisect_right(self.starts, low) - 1
            while k < len(self.runs) and self.starts[k] < high:
                start, a, b, own = self.runs[k]
                skip = max(0, low - start)
                out.append((at + start + skip - low, a + skip, b, True) if own else (at + start + skip - low, a, b, False))
                k += 1
        return Map(out)


def _single(code: str) -> str:
    """The character of an escape that stands alone."""
    if code[0] == "&":
        name = code[1:-1].rpartition(";")[2]
        if name in _NAMED:
            return _NAMED[name]
        value = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    elif code[1] == "U":
        value = int(code[2:], 16)
    elif code[:3] == "\\u{":
        value = int(code[3:-1], 16)
    else:
        return _LETTERS.get(code[1], code[1])
    return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else "�"


def _run(run: str, start: int) -> list[tuple[str, int, int]]:
    """(characters, start, end) of a run of escapes of bytes or units: one by one where each stands for a character."""
    if len(run) == 3 and (value := int(run[1:], 16)) < 0x80:
        return [(chr(value), start, start + 3)]
    codes = list(_ONE.finditer(run))
    kind = codes[0].lastindex
    values = [int(m[kind], 8 if kind == 3 else 16) for m in codes]
    if max(values) < 0x80 or kind == 4 and not any(0xD800 <= v < 0xE000 for v in values):
        return [(chr(v), start + m.start(), start + m.end()) for v, m in zip(values, codes, strict=True)]
    raw = b"".join(v.to_bytes(2, "big") for v in values) if kind == 4 else bytes(values)
    plain = raw.decode("utf-16-be" if kind == 4 else "utf-8", "replace")
    if len(plain) == len(values):  # each byte of an encoding that is not UTF-8
        return [(c, start + m.start(), start + m.end()) for c, m in zip(plain, codes, strict=True)]
    return [(plain, start, start + len(run))] if plain else []


def _unescaped(text: str, pattern: re.Pattern) -> tuple[str, list[tuple[int, int, int, bool]]] | None:
    out, pieces, done, length = [], [], 0, 0
    for m in pattern.finditer(text):
        if m.start() > done:
            out.append(text[done : m.start()])
            pieces.append((length, done, m.start(), True))
            length += m.start() - done
        code = m[0]
        alone = code[0] == "&" or code[0] == "\\" and (code[1] not in "xu0123" or code[:3] == "\\u{")
        for plain, low, high in [(_single(code), m.start(), m.end())] if alone else _run(code, m.start()):
            out.append(plain)
            pieces.append((length, low, high, False))
            length += len(plain)
        done = m.end()
    if not done:
        return None
    if done < len(text):
        out.append(text[done:])
        pieces.append((length, done, len(text), True))
    return "".join(out), pieces


def _printable(raw: bytes) -> bool:
    """Whether most bytes are printable ASCII."""
    return len(raw) > 0 and len(raw.translate(None, _PLAIN)) * 7 < len(raw)


def _readable(raw: bytes) -> str | None:
    """Bytes as text, or None if they are none."""
    zeros = raw.count(0)
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff") or zeros * 3 > len(raw) > 1:
        little = raw[:2] == b"\xff\xfe" or raw[:2] != b"\xfe\xff" and raw[1::2].count(0) >= raw[::2].count(0)
        try:
            return raw[: len(raw) // 2 * 2].decode("utf-16-le" if little else "utf-16-be") or None
        except UnicodeDecodeError:
            pass
    try:
        return raw.decode("utf-8") or None
    except UnicodeDecodeError:
        return raw.decode("latin-1") if _printable(raw) else None


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0 or raw[:3] == b"BZh" and raw[4:10] == b"1AY&SY" or raw[:6] == b"\xfd7zXZ\x00"


def _opener(raw: bytes, bare: bool):
    """What inflates a stream that begins so."""
    if not bare and raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if not bare and raw[:1] == b"\xfd":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=_MOST_LZMA)
    return zlib.decompressobj(-zlib.MAX_WBITS if bare else zlib.MAX_WBITS | 32)


_BROKEN = (zlib.error, lzma.LZMAError, OSError, EOFError)


def _bare(raw: bytes) -> bool:
    """Whether the bytes seem to begin a deflate stream without a head: it inflates to text."""
    try:
        return _printable(zlib.decompressobj(-zlib.MAX_WBITS).decompress(raw[:512], 4096))
    except zlib.error:
        return False


def _begins(raw: bytes) -> bool:
    """Whether a stream goes on for some bytes: a cheap test of what only looks like the head of one."""
    try:
        _opener(raw, False).decompress(raw[:256], 1024)
    except _BROKEN:
        return False
    return True


def _blocks(raw: bytes, bare: bool = False) -> Iterator[bytes]:
    """What members (or one bare stream) hold, block by block. Raises one of _BROKEN if the first does not inflate to its end."""
    any_done, at = False, 0
    while bare and not any_done or _packed(raw[at : at + 16]):
        stream, feed = _opener(raw[at : at + 16], bare), b""
        zipped = hasattr(stream, "unconsumed_tail")
        try:
            while not stream.eof:
                if not feed and (zipped or stream.needs_input):
                    feed, at = raw[at : at + PIECE], at + PIECE
                    if not feed:
                        raise zlib.error("cut short")
                block = stream.decompress(feed, PIECE)
                feed = stream.unconsumed_tail if zipped else b""
                if block:
                    yield block
        except _BROKEN:
            if any_done:
                return
            raise
        any_done, at = True, min(at, len(raw)) - len(stream.unused_data)
        bare = False


def _inflated(raw: bytes, limit: int) -> bytes | None:
    """What streams hold, through nested ones; None if there is none."""
    inner = None
    while _packed(raw) or inner is None and not _printable(raw) and _bare(raw):
        parts, size, bare = [], 0, not _packed(raw)
        try:
            for block in _blocks(raw, bare):
                parts.append(block)
                size += len(block)
                if size > limit:
                    raise OverflowError(raw, bare)
        except _BROKEN:
            break
        plain = b"".join(parts)
        if plain == raw:
            break
        raw = inner = plain
    return inner


def _pieces(raw: bytes, bare: bool) -> Iterator[str]:
    """Overlapping pieces of the text that a stream of any size holds; only one piece is in memory."""
    decode, held, fresh = codecs.getincrementaldecoder("utf-8")("replace").decode, "", 0
    try:
        for block in _blocks(raw, bare):
            more = decode(block)
            held, fresh = held + more, fresh + len(more)
            if fresh >= PIECE:
                yield held
                held, fresh = held[-OVERLAP:], 0
    except _BROKEN:
        pass
    if fresh:
        yield held


#: What decoding gives: where it came from, the text, and whether it was inflated; or, of what is too large, the stream.
Found = tuple[int, int, str | tuple[bytes, bool], bool]


def _stream(raw: bytes, start: int, end: int, limit: int) -> Iterator[Found]:
    try:
        if (inner := _inflated(raw, limit)) is not None and (text := _readable(inner)) is not None:
            yield start, end, text, True
    except OverflowError as large:
        yield start, end, large.args, True


def _streams(raw: bytes, start: int, end: int, limit: int) -> Iterator[Found]:
    """The streams that begin anywhere in the bytes."""
    done = 0
    for m in _STREAM.finditer(raw):
        if m.start() >= done and _begins(raw[m.start() : m.start() + 256]):
            for found in _stream(raw[m.start() :], start, end, limit):
                done = len(raw)  # what it did not inflate belongs to it, or is found as a further member
                yield found


def _escaped_streams(layer: str, limit: int) -> Iterator[Found]:
    """From runs of escaped bytes, and of characters that are bytes."""
    for whole, broken, code, mark in _RAW:
        if mark not in layer:
            continue
        for run in whole.finditer(layer):
            if mark not in run[0]:
                continue
            at = run.start()
            for part in [*broken.finditer(run[0]), None]:
                stop = run.start() + part.start() if part else run.end()
                own = layer[at:stop]
                if own.count(mark) >= 4:
                    depths = Counter(len(x[1]) for x in _DEPTH.finditer(own)) if mark == "%" else {0: 4}
                    for depth in sorted(d for d, n in depths.items() if n >= 4):  # a stream that was escaped again was so throughout
                        raw = own.replace("%" + "25" * (depth // 2), "%") if depth else own
                        yield from _streams(code.sub(lambda x: bytes((int(x[1], 16),)), raw.encode("utf-8", "replace")), at, stop, limit)
                at = stop + 1
    for m in _CHARACTERS.finditer(layer):
        yield from _streams(m[0].encode("latin-1"), m.start(), m.end(), limit)


def _from_base64(run: str, start: int, end: int, limit: int, exact: bool = True) -> Iterator[Found]:
    """From a run of base64 characters that stand at start to end; `exact`: one by one, without line ends between them."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    parts = [m.end() for m in _SEPARATOR.finditer(run)]
    for shift in range(4):
        size = len(body) - shift - ((len(body) - shift) % 4 == 1)
        if size < 16:
            return
        raw = base64.b64decode(body[shift : shift + size] + "=" * (-size % 4))
        found = list(_stream(raw, start, end, limit)) if _packed(raw) or not _printable(raw) and _bare(raw) else []
        if not found and (text := _readable(raw)) is not None:
            found = [(start, end, text, False)]
        yield from found
        if found:
            continue
        for m in _STRETCH.finditer(raw):
            own = m[0][::2] if m[0][1] == 0 else m[0]
            low, high = shift + m.start() * 4 // 3, min(len(run), shift - (-m.end() * 4 // 3))
            yield *((start + low, start + high) if exact else (start, end)), own.decode("ascii"), False
        yield from _streams(raw, start, end, limit)
        for at in parts:
            if at % 4 == shift and _bare(raw[(low := (at - shift) // 4 * 3) : low + 512]):
                yield from _stream(raw[low:], start, end, limit)


def _wrapped(layer: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, joined) of base64 runs over several lines: all of them, and those up to the first of another length."""
    for m in _WRAPPED.finditer(layer):
        ends, begins = [], [0]
        for x in _BREAK.finditer(m[0]):
            ends.append(x.start())
            begins.append(x.end())
        lines = [m[0][a:b] for a, b in zip(begins, [*ends, len(m[0])], strict=True)]
        k = next((k for k, x in enumerate(lines) if len(x) != len(lines[0])), len(lines) - 1)
        for n in {k, k + 1, len(lines)}:
            if n > 1:
                yield m.start(), m.start() + begins[n - 1] + len(lines[n - 1]), "".join(lines[:n])


def _unwrapped(layer: str, limit: int) -> Iterator[Found]:
    for m in _BASE64.finditer(layer):
        yield from _from_base64(m[0], m.start(), m.end(), limit)
    for start, end, run in _wrapped(layer):
        yield from _from_base64(run, start, end, limit, exact=False)
    yield from _escaped_streams(layer, limit)


def scan(text: str, max_decoded: int = MAX_DECODED) -> tuple[list[Span], list[Span], int, bool]:
    """Base spans, all spans, number of layers beneath the text, and whether the limit on decoded text was met."""
    base = base_spans(text)
    found, layers, left = set(base), 0, max_decoded
    seen, work = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}, deque()
    exhausted = False

    def add(layer: str, to: Map) -> None:
        nonlocal layers
        key = hashlib.blake2b(layer.encode("utf-8", "surrogatepass") + repr(to.span(0, len(layer))).encode(), digest_size=16).digest()
        if key in seen:
            return
        seen.add(key)
        layers += 1
        for start, kind, end in base_spans(layer):
            a, b = to.span(start, end)
            found.add((a, kind, b))
        work.append((layer, to))

    work.append((text, Map([(0, 0, len(text), True)])))
    while work:
        layer, to = work.popleft()
        for mark, pattern in _ESCAPES:
            if mark in layer and (plain := _unescaped(layer, pattern)) and plain[0]:
                add(plain[0], to.then(plain[1]))
        for start, end, inner, inflated in _unwrapped(layer, max(left, 0)):
            own = Map([(0, *to.span(start, end), False)])
            if isinstance(inner, str):
                left -= len(inner) if inflated else 0  # nothing else expands
                add(inner, own)
            else:
                exhausted = True
                for piece in _pieces(*inner):
                    add(piece, own)
    return base, sorted(found), layers, exhausted


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_decoded: int = MAX_DECODED) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base (the joined base spans), spans (all), n_layers, exhausted."""
    schema = documents.select(id_col).schema
    for name, kind in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base", "string"), ("spans", "string"), ("n_layers", "long"), ("exhausted", "boolean")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                base, spans, layers, over = scan(value.as_py() or "", max_decoded)
                kinds = [kind for _, kind, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), _joined(base), _joined(spans), layers, over))
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=schema.names)

    return documents.select(id_col, text_col).mapInArrow(run, schema)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_layers", "exhausted")
