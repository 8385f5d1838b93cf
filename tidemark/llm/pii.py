"""Personal data by patterns and a linear-chain conditional random field.

Base finds come from one pattern per kind (``base_spans``).  The field labels
every white-space token of every line as other, e-mail, address, card or phone
from features of its shape and of its neighbours' shapes; neighbouring tokens
of one label are one span.  A span is added to the base finds if it overlaps
none of them and its digits pass the kind's own check, so writings that the
patterns do not know (``(212) 555-0148``, ``4111.1111.1111.1111``) are found too.

The field is trained by maximum likelihood on ``LABELLED``, a small table of
marked lines, and decoded by Viterbi in numpy over batches of texts.  A token
whose score for *other* beats every label by more than any transition could
make good is *other* on the best path whatever its neighbours are; decoding
runs over the stretches between such tokens, which gives the same path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pick

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # no match can begin inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern finds: per kind leftmost and not overlapping; those failing their check are dropped, not retried."""
    out = []
    last = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            # The local part is the run before the @, as far as the find before leaves it.
            a = m.start()
            while a > last and (text[a - 1].isascii() and (text[a - 1].isalnum() or text[a - 1] in "._%+-")):
                a -= 1
            if a < m.start() and m.start() >= last:
                out.append(("email", a, m.end()))
                last = m.end()
    if _DIGITS.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


# The labelled table: one line each, marked stretches as [kind:...]. Fixed values.
LABELLED = """
write to [email:anna.k@mail.example.org] before noon
contact: [email:j_doe42@corp-mail.example.com], thanks.
<[email:info@shop.example.net]> answered on 12 March 2021
the list is [email:a.b@x.org] and [email:c.d@y.org]
login as [email:root@localhost] on port 8080
her address was ([email:mia.99@uni7.example.edu]).
server [ip:192.168.10.4] rebooted at 10:45
ping [ip:8.8.8.8] or [ip:1.1.1.1] now
from [ip:10.0.0.1:8080] to [ip:172.16.254.3]
blocked ([ip:203.0.113.77]) after 3 tries
card [card:4111 1111 1111 1111] expires 04/27
paid with [card:5500-0000-0000-0004] on 2023-05-01
number [card:4012888888881881] was declined
use [card:4111.1111.1111.1111] instead
visa [card:4222/2222/2222/2222] on file
card [card:3782 822463 10005] is amex
call [phone:+1 (212) 555-0148] today
tel. [phone:+44 20 7946 0958], ask for Jo
phone: [phone:(415) 555-0134] after 5
ring [phone:212-555-0199] or [phone:(646) 555-0111].
fax [phone:+49 30 901820] room 14
mobile [phone:0171 5550143 22] only
reach us at [phone:415.555.0177] daily
my number is [phone:(030) 555-4081] at work
both [card:4111111111111111] and [card:5500.0000.0000.0004] were used
[phone:+1 (826) 555-4081] [ip:190.137.223.204] [email:k.l@b.example.org]
the [phone:(212) 555-0148] the [ip:10.2.3.4] the [card:6011000990139424] the
and [email:o.7@mail3.example.com] and [phone:+33 1 70 18 99 00] and [phone:646-555-0133]
a call to [phone:+1 (907) 555-3661] and a mail to [email:t.s@post.example.com]
the 1984 edition sold 120,000 copies in 14 weeks
version 2.0.1 fixes 35 bugs and 7 crashes
on 2024-01-31 at 10:45 we paid $1,200.50 for 3 items
section 4.2.1 covers pages 100-120 of volume 12
the score was 3-2 after 90 minutes, then 5-4
order 88213 shipped in 2 boxes of 16 each
pi is 3.14159 and e is 2.71828
there are 7,900,000,000 people and 195 countries
isbn 978-3-16-148410-0 has 13 digits
token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" in the log
build 20240131 passed 1024 of 1024 tests
he ran 42.195 km in 2:03:59 and won
words only, no numbers at all. Just a line of prose!
and the other one; with (brackets) and "quotes" - see
THE WHOLE LINE!! IS LOUD!! AND SHORT!!
is | a | table | row | of | words.
total: 100% of 250 +/- 3 points
in 1999 and 2000 it rose from 12.5 to 13.75 percent
see http://www.example.org/a/b.html?id=42 for more
room 101, floor 3, building 7, box 4455
serial 0000-1111-2222 and code 77-88
"""

_CHARS = {"digit": "0123456789", "at": "@", "dot": ".", "dash": "-", "plus": "+", "open": "(", "close": ")", "slash": "/:_"}
# Characters that may stand around a span without being part of it.
_EDGE = set(".,;:!?\"'<>[]{}|*#$%&=~`()")


def _class_table() -> np.ndarray:
    """ASCII characters by class: 0 letter or other, 1 digit, ...; white space is 9."""
    table = np.zeros(128, np.uint8)
    for i, chars in enumerate(_CHARS.values(), 1):
        for c in chars:
            table[ord(c)] = i
    table[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 9
    return table


_CLASS = _class_table()
_DIGIT_STEPS = np.array([1, 2, 3, 4, 5, 7, 9, 12, 13, 17, 20])
N_DIGITS, N_DOTS, N_DASHES, N_LEADS = len(_DIGIT_STEPS) + 1, 5, 4, 4
# A shape: digits, dots, dashes (buckets), first character, @, brackets, slashes, other characters.
_SIZES = (N_DIGITS, N_DOTS, N_DASHES, N_LEADS, 2, 2, 2, 3)
N_SHAPES = int(np.prod(_SIZES))
N_COARSE = 4


def _tokens(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token starts, ends, shape numbers, and whether a token begins a line, in an array of code points."""
    kind = np.where(c < 128, _CLASS[np.minimum(c, 127)], 0).astype(np.uint8)
    kind[(c == 0x85) | (c == 0xA0)] = 9
    word = kind != 9
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, starts, starts.astype(bool)
    # Counts per token, from running counts of the few characters that are not plain letters.
    odd = np.flatnonzero((kind != 0) & word)
    own = np.searchsorted(starts, odd, side="right") - 1
    n = np.bincount(own * 10 + kind[odd], minlength=len(starts) * 10).reshape(-1, 10) if len(odd) else np.zeros((len(starts), 10), np.int64)
    other = (ends - starts) - n.sum(axis=1)
    first = kind[starts]
    lead = np.select([first == 1, first == 5, first == 6], [1, 2, 3], 0)
    parts = (np.searchsorted(_DIGIT_STEPS, n[:, 1], side="right"), np.minimum(n[:, 3], N_DOTS - 1), np.minimum(n[:, 4], N_DASHES - 1), lead,
             n[:, 2] > 0, n[:, 6] + n[:, 7] > 0, n[:, 8] > 0, np.minimum(other, 2))
    shape = np.ravel_multi_index([p.astype(np.int64) for p in parts], _SIZES)
    breaks = np.flatnonzero(c == 10)
    line = np.searchsorted(breaks, starts)
    return starts, ends, shape, np.concatenate(([True], np.diff(line) > 0))


def _shape_features() -> tuple[np.ndarray, np.ndarray]:
    """Per shape its features (indexes), and its coarse class as a neighbour."""
    parts = np.stack(np.unravel_index(np.arange(N_SHAPES), _SIZES), axis=1)
    offsets = np.concatenate(([0], np.cumsum(_SIZES)[:-1]))
    single = parts + offsets
    pair = sum(_SIZES) + parts[:, 0] * N_DASHES + parts[:, 2]  # digits and dashes together
    triple = sum(_SIZES) + N_DIGITS * N_DASHES + parts[:, 0] * N_DOTS + parts[:, 1]
    mixed = sum(_SIZES) + N_DIGITS * (N_DASHES + N_DOTS) + parts[:, 0] * 3 + parts[:, 7]
    coarse = np.select([parts[:, 0] == 0, parts[:, 7] == 2, parts[:, 0] <= 2], [0, 1, 2], 3)
    return np.concatenate((single, pair[:, None], triple[:, None], mixed[:, None]), axis=1), coarse


N_OWN = sum(_SIZES) + N_DIGITS * (N_DASHES + N_DOTS + 3)
N_FEATURES = N_OWN + 2 * (N_COARSE + 1)  # and the neighbours' classes, or none


def _features(shape: np.ndarray, begins: np.ndarray, table: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    left, right = np.full(len(shape), N_COARSE), np.full(len(shape), N_COARSE)
    left[1:], right[:-1] = coarse[shape[:-1]], coarse[shape[1:]]
    left[begins] = N_COARSE
    right[:-1][begins[1:]] = N_COARSE
    return np.concatenate((table[shape], (N_OWN + left)[:, None], (N_OWN + N_COARSE + 1 + right)[:, None]), axis=1)


def marked(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text of a line of the labelled table and its marked spans."""
    text, spans = "", []
    for part in re.split(r"(\[(?:email|ip|card|phone):[^\]]*\])", line):
        if part[:1] == "[" and part[-1:] == "]" and ":" in part:
            kind, value = part[1:-1].split(":", 1)
            spans.append((kind, len(text), len(text) + len(value)))
            text += value
        else:
            text += part
    return text, spans


def train(table: str = LABELLED, steps: int = 400, l2: float = 0.005) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights (features x labels) and transitions (labels x labels; the last
    row starts a line) of the field, by gradient ascent on the table's likelihood."""
    shapes, coarse = _shape_features()
    rows = []
    for line in table.strip().split("\n"):
        text, spans = marked(line)
        s, e, shape, begins = _tokens(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        y = [next((LABELS.index(k) for k, a, b in spans if a < y and x < b), 0) for x, y in zip(s.tolist(), e.tolist())]
        rows.append((_features(shape, begins, shapes, coarse), np.array(y)))
    n_lab, longest = len(LABELS), max(len(y) for _, y in rows)
    w, t = np.zeros((N_FEATURES, n_lab)), np.zeros((n_lab + 1, n_lab))
    m_w, v_w, m_t, v_t = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    x = np.zeros((len(rows), longest, rows[0][0].shape[1]), np.int64)
    y, live = np.zeros((len(rows), longest), np.int64), np.zeros((len(rows), longest), bool)
    for i, (f, lab) in enumerate(rows):
        x[i, :len(lab)], y[i, :len(lab)], live[i, :len(lab)] = f, lab, True
    for step in range(1, steps + 1):
        e = w[x].sum(axis=2)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = t[n_lab] + e[:, 0]
        for k in range(1, longest):
            new = np.logaddexp.reduce(alpha[:, k - 1, :, None] + t[None, :n_lab], axis=1) + e[:, k]
            alpha[:, k] = np.where(live[:, k, None], new, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(t[None, :n_lab] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
            beta[:, k] = np.where(live[:, k + 1, None], new, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        g_e = np.eye(n_lab)[y] * live[:, :, None] - p
        g_w = np.zeros_like(w)
        np.add.at(g_w, x.ravel(), np.repeat(g_e.reshape(-1, n_lab), x.shape[2], axis=0))
        g_t = np.zeros_like(t)
        g_t[n_lab] = g_e[:, 0].sum(axis=0)
        for k in range(1, longest):
            both = np.exp(alpha[:, k - 1, :, None] + t[None, :n_lab] + (e[:, k] + beta[:, k])[:, None, :] - z[:, None, None])
            on = live[:, k]
            g_t[:n_lab] -= both[on].sum(axis=0)
            np.add.at(g_t, (y[on, k - 1], y[on, k]), 1)
        for a, g, m, v in ((w, g_w - l2 * w, m_w, v_w), (t, g_t - l2 * t, m_t, v_t)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return w, t


class Field:
    """A trained field, ready to decode."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray]):
        self.w, self.t = model
        self.shapes, self.coarse = _shape_features()
        self.own = self.w[self.shapes].sum(axis=1)
        n = len(LABELS)
        # A transition pair by way of "other" costs at most this much more than one by way of another label.
        into, out = self.t.max(axis=0) - self.t[:, 0].min(), self.t[:n].max(axis=1) - self.t[0].min()
        self.margin = (into + out)[1:]

    def labels(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token starts, ends, line starts and labels on each line's best path."""
        n = len(LABELS)
        starts, ends, shape, begins = _tokens(c)
        path = np.zeros(len(starts), np.int64)
        if not len(starts):
            return starts, ends, begins, path
        left, right = np.full(len(shape), N_COARSE), np.full(len(shape), N_COARSE)
        near = self.coarse[shape]
        left[1:], right[:-1] = near[:-1], near[1:]
        left[begins] = N_COARSE
        right[:-1][begins[1:]] = N_COARSE
        e = self.own[shape] + self.w[N_OWN + left] + self.w[N_OWN + N_COARSE + 1 + right]
        sure = (e[:, :1] - e[:, 1:] > self.margin).all(axis=1)
        # Stretches without a sure token, within one line.
        edge = np.flatnonzero(~sure & (begins | np.concatenate(([True], sure[:-1]))))
        if not len(edge):
            return starts, ends, begins, path
        stop = np.flatnonzero(~sure & np.concatenate((sure[1:] | begins[1:], [True]))) + 1
        size = stop - edge
        order = np.argsort(-size, kind="stable")
        edge, stop, size = edge[order], stop[order], size[order]
        before = np.where(begins[edge], n, 0)
        after_line = np.concatenate((begins[1:], [True]))[stop - 1]
        score = self.t[before] + e[edge]
        back = []
        for k in range(1, int(size[0])):  # all stretches at once; the shorter ones have ended
            on = int(np.searchsorted(-size, -k, side="left"))
            way = score[:on, :, None] + self.t[None, :n]
            best = way.argmax(axis=1)
            back.append(best)
            score = np.concatenate((np.take_along_axis(way, best[:, None], 1)[:, 0] + e[edge[:on] + k], score[on:]))
        score = score + np.where(after_line[:, None], 0, self.t[:n, 0])
        at = score.argmax(axis=1)
        path[stop - 1] = at
        for k in range(len(back), 0, -1):
            on = len(back[k - 1])
            at[:on] = back[k - 1][np.arange(on), at[:on]]
            path[edge[:on] + k - 1] = at[:on]
        return starts, ends, begins, path

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Labelled spans of each text, trimmed of punctuation around them."""
        whole = "\n".join(texts)
        c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends, begins, path = self.labels(c)
        out: list[list] = [[] for _ in texts]
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        hit = np.flatnonzero(path)
        if not len(hit):
            return out
        new = np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(path[hit]) != 0) | begins[hit[1:]]))
        firsts = np.flatnonzero(new)
        for f, g in zip(firsts.tolist(), [*firsts[1:].tolist(), len(hit)]):
            a, b, kind = int(starts[hit[f]]), int(ends[hit[g - 1]]), LABELS[path[hit[f]]]
            a, b = trimmed(whole, kind, a, b)
            t = int(np.searchsorted(offsets, a, side="right")) - 1
            if b > a:
                out[t].append((kind, a - int(offsets[t]), b - int(offsets[t])))
        return out


def valid(kind: str, value: str) -> bool:
    """Whether a labelled value can be what it is labelled as."""
    digits = "".join(c for c in value if c in "0123456789")
    if kind == "email":
        local, _, domain = value.partition("@")
        return bool(local and domain) and "@" not in domain
    if kind == "ip":
        parts = value.partition(":")[0].split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if not all(c in "0123456789 ()+-./" for c in value):
        return False
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and value[:1] in "+(0123456789"


def trimmed(text: str, kind: str, a: int, b: int) -> tuple[int, int]:
    """A span without the punctuation and white space around it."""
    while b > a and (text[b - 1] in _EDGE or text[b - 1].isspace()):
        b -= 1
    while a < b and (text[a] in _EDGE or text[a].isspace()) and not (kind == "phone" and text[a] == "(" and ")" in text[a:b]):
        a += 1
    return a, b


_BATCH_CHARS = 1 << 18
_SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_all(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base finds, all finds) of each text, by start, then kind."""
    out = []
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    for text, labelled in zip(texts, field.batch(texts)):
        base = base_spans(text)
        more = []
        for kind, a, b in labelled:
            # What the base finds leave of a labelled span.
            inside = sorted((x, y) for _, x, y in base if x < b and a < y)
            for x, y in [*inside, (b, b)]:
                s, e = trimmed(text, kind, a, min(x, b))
                if s < e and valid(kind, text[s:e]):
                    more.append((kind, s, e))
                a = max(a, y)
        out.append((sorted(base, key=order), sorted([*base, *more], key=order)))
    return out


def find_personal_data(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id, base, spans) for every row: pattern finds, and those with the field's
    additions, as code points with an exclusive end.  Null and empty texts have
    none; a text is read whole, and repeated rows each get their row."""
    bounded_batches(docs.sparkSession)
    model = model or train()
    part = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(model)
        for b in batches:
            got, held, chars = [], [], 0
            for t in b.column(1):
                held.append(t.as_py() or "")
                chars += len(held[-1])
                if chars >= _BATCH_CHARS:
                    got += find_all(held, field)
                    held, chars = [], 0
            got += find_all(held, field) if held else []
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in g[i]] for g in got], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["id", "base", "spans"])

    return part.mapInArrow(run, f"id {part.schema['id'].dataType.simpleString()}, base {_SPANS}, spans {_SPANS}")
