"""Secret scans with a recursive decoding worklist.

The text is the first layer.  A worklist unwraps every layer further: percent
encoding, Unicode escapes and character references, base64 tokens (standard
and URL-safe), and gzip, zlib, bzip2, xz and Zstandard data inside them, until
no layer yields a new one.  Decoded bytes are read as UTF-8, or as Latin-1 where
they are not, and their stretches of UTF-16 as well; all of it is scanned, be it
text or binary (``layers`` counts binary layers only if they hold a find).  A
layer equal to one of those it came from is a cycle and is not taken up again.
A find in an inner layer is mapped back to the stretch of the text that encodes it.
Runs of the base64 alphabet are read at all four alignments, in one line and joined
over the lines they are wrapped to.

All members and frames of compressed data that follow one another are read.  All finds
in them have the place of the whole, so nothing is lost if a run of more than
``RUN`` equal bytes is scanned as one of ``RUN`` and equal windows are scanned once: data that
inflate a thousandfold do so by repeating themselves.
Content of more than ``MAX_INFLATED`` bytes is reported itself, as a find of the
kind ``oversize``, and scanned in overlapping windows of that size.  A find that
fills a whole such window, a run without end, has no kind of its own.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pick

KINDS = ("assign", "access", "hex", "oversize")
MAX_INFLATED = 16 << 20
RUN = 8192  # longer than any find needs to be
_CHUNK = 1 << 20

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal: a shorter one has no longer part
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:amp|lt|gt|quot|apos);")
_BYTES = re.compile(r"\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[0-3]?[0-7]{1,2}|\\[abfnrtv\\'\"]|&#[0-9]{1,3};|&#[xX][0-9A-Fa-f]{1,2};")
_CONTROLS = dict(zip("abfnrtv", "\a\b\f\n\r\t\v"))
_LATIN = re.compile(r"[\x00-\xff]+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[ \t]*\r?\n[ \t>]*[A-Za-z0-9+/_-]++)+={0,2}")
_IN_ALPHABET = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", np.uint8))
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_TOKENS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\&#;{}:.'\"> \t\r\n\0"
_WIDE = re.compile(rb"\x00?(?:[^\x00]\x00){6,}[^\x00]?")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]+")
# A layer without any of these holds neither a find nor a further layer.
_LIVE = re.compile(rf"(?ai:{'|'.join(_ASSIGN_WORDS)})|AKIA|[0-9a-f]{{32}}|%[0-9A-Fa-f]{{2}}|\\[uUx]|&[#a-z]|[A-Za-z0-9+/_-]{{16}}|[A-Za-z0-9+/_-]{{4}}[ \t]*\r?\n")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The finds of one layer: per kind leftmost and not overlapping; those too short are dropped, not retried."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


@dataclass
class Layer:
    """A decoded text: where in the root text each character comes from, and the layers it came through."""

    text: str
    start: np.ndarray | None  # None: the root itself
    end: np.ndarray | None
    decoded: np.ndarray | None  # which characters were written otherwise in the layer outside
    path: tuple[str, ...]
    plain: bool = True  # reads as text; other layers are scanned too, but counted only for a find
    cut: bool = False  # a window of content beyond the limit

    def root(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a:b].min()), int(self.end[a:b].max()))


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of ``pattern`` replaced by what it stands for."""
    parts, starts, ends, new, last = [], [], [], [], 0

    def copy(a: int, b: int) -> None:
        parts.append(layer.text[a:b])
        starts.append(np.arange(a, b) if layer.start is None else layer.start[a:b])
        ends.append(np.arange(a + 1, b + 1) if layer.start is None else layer.end[a:b])
        new.append(np.zeros(b - a, bool))

    for m in pattern.finditer(layer.text):
        got = decode(m.group())
        if got is None:
            continue
        text, width = got  # characters, and how many of the match's characters each stands for
        copy(last, m.start())
        a = m.start() + np.concatenate(([0], np.cumsum(width)[:-1])).astype(np.int64)
        b = a + np.array(width, np.int64)
        if layer.start is not None:
            a, b = layer.start[a], layer.end[b - 1]
        parts.append(text)
        starts.append(a)
        ends.append(b)
        new.append(np.ones(len(text), bool))
        last = m.end()
    if not parts:
        return None
    copy(last, len(layer.text))
    return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends), np.concatenate(new), (*layer.path, layer.text), layer.plain, layer.cut)


def _percent(s: str) -> tuple[str, list[int]] | None:
    text = bytes.fromhex(s.replace("%", "")).decode("utf-8", "replace")
    if "\ufffd" in text:  # not UTF-8: byte by byte
        text = bytes.fromhex(s.replace("%", "")).decode("latin-1")
        return text, [3] * len(text)
    return text, [3 * len(c.encode()) for c in text]


def _percent_bytes(s: str) -> tuple[str, list[int]]:
    return bytes.fromhex(s.replace("%", "")).decode("latin-1"), [3] * (len(s) // 3)


def _escape(s: str) -> tuple[str, list[int]] | None:
    text = html.unescape(s) if s[0] == "&" else None
    if text is None:
        code = int(s.strip("\\uUx{}"), 16)
        text = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    return (text, [len(s)]) if text and len(text) == 1 and text != s else None


def _byte(s: str) -> tuple[str, list[int]] | None:
    """An escape as the byte it stands for, as programs write binary strings."""
    if s[0] == "&":
        code = int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
    else:
        code = int(s[2:], 16) if s[1] in "xu" else int(s[1:], 8) if s[1].isdigit() else ord(_CONTROLS.get(s[1], s[1]))
    return (chr(code), [len(s)]) if code < 256 else None


def _members(data: bytes, at: int, state: list) -> Iterator[bytes]:
    """What the compressed data at a place holds, chunk by chunk: all members and frames
    that follow one another.  ``state`` gets the place after the last whole one, and
    whether one more is cut off by the end of the data."""
    errors = (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError)
    state[:] = [at, False]
    while _MAGIC.match(data, at):
        if data[at] == 0x28:
            tool, step = zstandard.ZstdDecompressor(max_window_size=64 << 20).decompressobj(), 256  # its output has no bound
        elif data[at] == 0x42:
            tool, step = bz2.BZ2Decompressor(), _CHUNK
        elif data[at] == 0xFD:
            tool, step = lzma.LZMADecompressor(memlimit=256 << 20), _CHUNK
        else:
            tool, step = zlib.decompressobj(47), _CHUNK
        try:
            while not tool.eof:
                if step == 256:
                    feed = data[at:at + step]
                    at += len(feed)
                    out = tool.decompress(feed)
                elif data[state[0]] in b"B\xfd":
                    feed = data[at:at + step] if tool.needs_input else b""
                    at += len(feed)
                    out = tool.decompress(feed, _CHUNK)
                else:
                    feed = tool.unconsumed_tail
                    if not feed:
                        feed = data[at:at + step]
                        at += len(feed)
                    out = tool.decompress(feed, _CHUNK)
                if out:
                    yield out
                elif not feed and not tool.eof:
                    state[1] = True
                    return
        except errors:
            return
        at = state[0] = at - len(tool.unused_data)
        while data[at:at + 4] == b"\0\0\0\0" or data[at + 1:at + 4] == b"\x2a\x4d\x18" and data[at] & 0xF0 == 0x50:  # padding, skippable frames
            at += 4 if not data[at] else 8 + int.from_bytes(data[at + 4:at + 8], "little")
        state[0] = at if _MAGIC.match(data, at) else state[0]


def _readings(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The texts that bytes may stand for, with the first and last byte of each character:
    UTF-8 or else Latin-1, and the stretches that look like UTF-16.  The patterns are
    ASCII, so a stretch of UTF-16 shorter than ``_WIDE`` asks for holds no find."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    if len(text) == len(data):
        yield text, (i := np.arange(len(data))), i
    else:
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(1 + (c > 0x7F) + (c > 0x7FF).astype(np.int64) + (c > 0xFFFF))
        yield text, np.concatenate(([0], ends[:-1])), ends - 1
    if b"\0" in data:
        b, parts = np.frombuffer(data, np.uint8), []
        for m in _WIDE.finditer(data):
            at = m.start() + np.flatnonzero(b[m.start():m.end()])
            parts += [at, at[-1:]]  # the last place again for the line break between two stretches
        if parts:
            at = np.concatenate(parts)
            wide = b[at]
            wide[np.cumsum([len(x) for x in parts])[1::2] - 1] = 10
            yield wide.tobytes().decode("latin-1"), at, at


def _is_text(text: str, data: bytes) -> bool:
    """Whether a reading counts as a layer even without a find: UTF-8, or UTF-16, with few control characters."""
    bad = sum(len(m.group()) for m in _CONTROL.finditer(text))
    return bad * 20 <= len(text) and (len(text) < len(data) or text.isascii() or text.encode("utf-8", "replace") == data)


def _runs(text: str) -> Iterator[tuple[str, np.ndarray, int]]:
    """Runs of the base64 alphabet with the place of each character and the run's end:
    those of one line, and those that go on over the lines after it."""
    for m in _BASE64.finditer(text):
        chars = m.group().rstrip("=")
        yield chars, m.start() + np.arange(len(chars)), m.end()
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            b = np.frombuffer(m.group().encode(), np.uint8)
            at = np.flatnonzero(_IN_ALPHABET[b])
            if len(at) >= 16:
                yield b[at].tobytes().decode(), m.start() + at, m.end()


def _texts(data: bytes, start: np.ndarray | int, end: np.ndarray | int, path: tuple[str, ...], cut: bool = False) -> Iterator[Layer]:
    """The layers that bytes stand for; ``start`` and ``end`` are each byte's places in the root, or those of all."""
    for text, i, j in _readings(data):
        if text and text not in path and ((plain := _is_text(text, data)) or _LIVE.search(text)):
            n = len(text)
            a, b = (np.broadcast_to(np.int64(x), n) if isinstance(x, int) else x[at] for x, at in ((start, i), (end, j)))
            yield Layer(text, a, b, np.broadcast_to(True, n), path, plain, cut)


def _collapsed(data: bytes) -> bytes:
    """``data`` with every run of more than ``RUN`` equal bytes cut to that many."""
    if len(data) <= RUN:
        return data
    b = np.frombuffer(data, np.uint8)
    # A run that long covers two places RUN / 2 apart that are multiples of it.
    some = b[::RUN // 2]
    if not (some[1:] == some[:-1]).any():
        return data
    begins = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1))
    sizes = np.diff(np.append(begins, len(b)))
    if sizes.max() <= RUN:
        return data
    return np.repeat(b[begins], np.minimum(sizes, RUN)).tobytes()


def _packed(data: bytes, start: np.ndarray | int, end: np.ndarray | int, path: tuple[str, ...], limit: int, inside: tuple[bytes, ...] = ()) -> Iterator[Layer | tuple]:
    """Layers of the compressed data in bytes, wherever it begins, and the finds ``oversize``.
    Returns where the last member begins if the end of the bytes cuts it off.

    Content beyond ``limit`` comes in windows of that many bytes.  All its finds
    have the place of the whole, so a window needs only what the one before it
    left open: its last run of token characters, its last cut-off member, and
    4,096 characters at least, up to ``limit``."""
    place, state, left = 0, [0, False], None
    while m := _MAGIC.search(data, place):
        at, place = m.start(), m.start() + 1
        a = start if isinstance(start, int) else int(start[at])
        b = end if isinstance(end, int) else int(end[-1])
        held, fresh, over, tail, done = [], 0, False, b"", {}
        for out in chain(_members(data, at, state), [None]):
            if out is not None:
                held.append(out)
                fresh += len(out)
                if fresh <= limit:
                    continue
                if not over:
                    over = True
                    yield "oversize", a, b
            elif not fresh:
                break
            window = _collapsed(b"".join([tail, *held]))
            if window in inside:  # a circle
                break
            if (known := hashlib.sha256(window).digest()) not in done:
                yield from _texts(window, a, b, path, over)
                done[known] = yield from _packed(window, a, b, path, limit, (*inside, data, window))
            open_at = done[known]
            keep = max(4096, len(window) - len(window.rstrip(_TOKENS)), 0 if open_at is None else len(window) - open_at)
            held, fresh, tail = [], 0, window[max(0, len(window) - min(keep, limit)):]
        place = max(place, state[0])
        left = at if state[1] else None
    return left


def _unpacked(layer: Layer, limit: int) -> Iterator[Layer | tuple]:
    """Layers inside a layer's base64 runs, read from each of their first four characters
    on (a word and '/', '_' or '-' may stand before a token, so it may begin anywhere),
    and the runs that inflate too far."""
    path = (*layer.path, layer.text)
    for chars, at, stop in _runs(layer.text):
        chars = chars.replace("-", "+").replace("_", "/")
        for s in range(4):
            n = len(chars) - s
            n -= n % 4 == 1
            data = base64.b64decode(chars[s:s + n] + "=" * (-n % 4))
            # Byte i is written in characters 4 (i // 3) + i % 3 and the next.
            byte = np.arange(len(data))
            first = at[s + 4 * (byte // 3) + byte % 3]
            last = at[s + 4 * (byte // 3) + byte % 3 + 1]
            start, end = (first, last + 1) if layer.start is None else (layer.start[first], layer.end[last])
            yield from _texts(data, start, end, path)
            if _MAGIC.search(data):
                yield from _packed(data, start, layer.root(stop - 1, stop)[1], path, limit)


def _written(layer: Layer, pattern: re.Pattern, decode, limit: int) -> Iterator[Layer | tuple]:
    """Layers of the compressed data that a layer writes in percent codes or escapes, byte by byte."""
    raw = _rewritten(layer, pattern, decode)
    for m in _LATIN.finditer(raw.text) if raw else ():
        data = m.group().encode("latin-1")
        at = 0
        while found := _MAGIC.search(data, at):
            at, state = found.start(), [0, False]
            # Its first bytes are partly coded and else printable; bytes that are there as such are another layer's.
            coded = raw.decoded[m.start() + at:m.start() + at + 32]
            size = 0
            if coded.any() and all(c or 32 <= x < 127 for c, x in zip(coded.tolist(), data[at:at + 32])):
                size = sum(map(len, _members(data, at, state)))  # read once for where it ends
            if not size:
                at += 1
                continue
            stop = state[0] if state[0] > at and not state[1] else len(data)
            a, b = raw.start[m.start() + at:m.start() + stop].min(), raw.end[m.start() + at:m.start() + stop].max()
            yield from _packed(data[at:stop], int(a), int(b), (*layer.path, layer.text), limit)
            at = stop


def scan(text: str | None, limit: int = MAX_INFLATED) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """(base finds, all finds, layers) of a text; null counts as empty."""
    text = text or ""
    base = base_spans(text)
    found, layers, seen = set(base), 1, set()
    work = [iter([Layer(text, None, None, None, ())])]  # the layers inside a layer are unpacked when their turn comes
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        if isinstance(layer, tuple):
            found.add(layer)
            continue
        if layer.start is not None:
            # The same text from the same stretch, come by in another order of decoding, is done already.
            text = layer.text if len(layer.text) <= 4096 else hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest()
            if (known := (text, int(layer.start[0]), int(layer.end[-1]))) in seen:
                continue
            seen.add(known)
            spans = base_spans(layer.text)
            layers += layer.plain or bool(spans)
            for kind, a, b in spans:
                if layer.cut and (a, b) == (0, len(layer.text)):  # a run longer than the window: ``oversize`` stands for it
                    continue
                if layer.decoded[a:b].any():  # else the layer outside has it as well
                    found.add((kind, *layer.root(a, b)))
        for signs, pattern, decode, bytewise, byte in (("%", _PERCENT, _percent, _PERCENT, _percent_bytes), ("\\&", _ESCAPE, _escape, _BYTES, _byte)):
            if any(c in layer.text for c in signs):
                inner = _rewritten(layer, pattern, decode)
                if inner and inner.text != layer.text and inner.text not in layer.path:
                    work.append(iter([inner]))
                    work.append(_written(layer, bytewise, byte, limit))
        work.append(_unpacked(layer, limit))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(found, key=order), layers


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_INFLATED) -> DataFrame:
    """(id, base, spans, layers) for every row: the finds in the text itself, those
    of all layers (both by start, then kind, as code points with an exclusive end),
    and how many layers there were.  Null and empty texts have none; a row's text is
    scanned whole, and repeated rows each get their row."""
    bounded_batches(docs.sparkSession)
    part = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(t.as_py(), limit) for t in b.column(1)]
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in g[i]] for g in got], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, pa.array([g[2] for g in got], pa.int32())], names=["id", "base", "spans", "layers"])

    return part.mapInArrow(run, f"id {part.schema['id'].dataType.simpleString()}, base {_SPANS}, spans {_SPANS}, layers int")
