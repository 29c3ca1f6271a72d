"""Personal data: patterns as a base, and a linear-chain conditional random field over word shapes.

The field reads every token of every text. A token's features are its own shape, those of two neighbours on each
side and the gaps (none, space, line end) before and after it; weights are trained on a small labelled table by
gradient steps on the likelihood, once on the driver. Decoding is exact Viterbi in numpy batches: a bound on what
any labelled run can gain tells the tokens that are outside on every best path, so texts fall into short runs
between such tokens, and runs of like length are decoded together. What the field finds and the
patterns don't overlap is added."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, map_texts, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns, leftmost and non-overlapping per kind, in order."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:  # an address starts where the run of local characters before its @ starts
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
        else:
            end = max(end, at + 1) if start == at else end
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- the field

MARKS = "@.+-()_%:/,"
SHAPES = len(MARKS) + 16
GAPS = 3  # before a token: none, white space, a line end
OFFSETS = (-2, -1, 0, 1, 2)
N_FEATURES = SHAPES * (len(OFFSETS) + 2 * GAPS)
# Classes of code points below 2^16 (above: a single mark): white space, letter, digit, any single mark.
GAP, LETTER, DIGIT, MARK = range(4)


@lru_cache(maxsize=1)
def classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point below 2^16: its class, whether it is upper case, and the shape it has as a single mark."""
    kind, upper, mark = np.full(1 << 16, MARK, np.uint8), np.zeros(1 << 16, bool), np.full(1 << 16, 13, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            kind[i] = GAP
        elif "0" <= c <= "9":
            kind[i] = DIGIT
        elif c.isalpha():
            kind[i] = LETTER
        upper[i] = c.lower() != c
    for n, c in enumerate(MARKS):
        mark[ord(c)] = 16 + n
    return kind, upper, mark


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends, shapes and gaps of a text's tokens: runs of letters, runs of digits, single marks.

    Shapes: 1 to 7 digit runs by length; 8 and 14 the words at and dot; 9 to 12 words by length (over three) and
    whether only their first letter is upper case; 13 and from 16 on marks."""
    kinds, upper, marks = classes()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.minimum(code, 0xFFFF)
    kind = kinds[low]
    first = np.ones(len(code), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == MARK)
    at = np.flatnonzero(first)
    end = np.append(at[1:], len(code))
    own = kind[at]
    token = own != GAP
    gap = np.zeros(len(at), np.int64)
    if len(at):
        line = np.add.reduceat((code == 10).astype(np.int64), at) > 0
        gap[0] = 1
        gap[1:] = np.where(own[:-1] == GAP, 1 + line[:-1], 0)
    starts, ends, own, gap = at[token], end[token], own[token], gap[token]
    size, head = ends - starts, low[starts]
    last = len(code) - 1
    title = upper[head] & ~((size > 1) & upper[low[np.minimum(starts + 1, last)]])
    shape = np.where(own == DIGIT, np.minimum(size, 7), np.where(own == MARK, marks[head], np.where(size > 3, 9, 11) + title)).astype(np.int64)
    small = code | 32
    a, b, c = small[starts] if len(starts) else small[:0], small[np.minimum(starts + 1, last)], small[np.minimum(starts + 2, last)]
    shape[(own == LETTER) & (size == 2) & (a == 97) & (b == 116)] = 8
    shape[(own == LETTER) & (size == 3) & (a == 100) & (b == 111) & (c == 116)] = 14
    return starts, ends, shape, gap


def features(shapes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """T x 7 feature numbers of a token sequence: five shapes, own shape with the gap before, and with the one after."""
    n, padded = len(shapes), np.concatenate([[0, 0], shapes, [0, 0]])
    after = np.append(gaps[1:], 1)[:n]
    cols = [padded[2 + o : 2 + o + n] + SHAPES * k for k, o in enumerate(OFFSETS)]
    base = SHAPES * len(OFFSETS)
    return np.stack([*cols, base + shapes * GAPS + gaps, base + SHAPES * GAPS + shapes * GAPS + after], 1)


class Field:
    def __init__(self) -> None:
        n = len(LABELS)
        self.emit, self.move = np.zeros((N_FEATURES, n)), np.zeros((n, n))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.3, ridge: float = 2e-4) -> Field:
        """Maximise the likelihood of rows (features, labels) by Adam; forward-backward over all rows at once."""
        n, most = len(LABELS), max(len(y) for _, y in rows)
        x = np.zeros((len(rows), most, 7), np.int64)
        y, mask = np.zeros((len(rows), most), np.int64), np.zeros((len(rows), most))
        for i, (f, labels) in enumerate(rows):
            x[i, : len(labels)], y[i, : len(labels)], mask[i, : len(labels)] = f, labels, 1
        gold = np.eye(n)[y] * mask[..., None]
        gold_move = np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.emit, self.move)]

        def lse(v: np.ndarray, axis: int) -> np.ndarray:
            top = v.max(axis, keepdims=True)
            return (top + np.log(np.exp(v - top).sum(axis, keepdims=True))).squeeze(axis)

        for step in range(steps):
            e = self.emit[x].sum(2) * mask[..., None]
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for t in range(1, most):
                new = lse(fwd[:, t - 1, :, None] + self.move, 1) + e[:, t]
                fwd[:, t] = np.where(mask[:, t, None] > 0, new, fwd[:, t - 1])
            for t in range(most - 2, -1, -1):
                new = lse(self.move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
                bwd[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
            z = lse(fwd[:, -1], 1)
            p = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
            pair = fwd[:, :-1, :, None] + self.move + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]
            pair = (np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]).sum((0, 1))
            diff = (p - gold).reshape(-1, n)
            g_emit = np.zeros_like(self.emit)
            for k in range(7):
                np.add.at(g_emit, x[..., k].ravel(), diff)
            for q, g, (m, v) in ((self.emit, g_emit / len(rows) + ridge * self.emit, state[0]), (self.move, (pair - gold_move) / len(rows) + ridge * self.move, state[1])):
                m += 0.1 * (g - m)
                v += 0.05 * (g * g - v)
                q -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.95 ** (step + 1))) + 1e-4)
        return self

    def scores(self, shapes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """T x labels emission scores."""
        f, out = features(shapes, gaps), np.zeros((len(shapes), len(LABELS)), "f4")
        table = self.emit.astype("f4")
        for k in range(f.shape[1]):
            out += table[f[:, k]]
        return out

    def certain(self, e: np.ndarray) -> np.ndarray:
        """Tokens that are outside on every best path. A labelled run gains at most the sum of its tokens' best leads
        over outside and of the best transitions; where no run that holds a token can gain, to put all of it
        outside is better. The best sums to either side come from running sums."""
        m = self.move - self.move[0, 0]
        inner = m[1:, 1:].max()
        gain = e[:, 1:].max(1).astype(np.float64) - e[:, 0] + inner
        total = np.concatenate([[0.0], np.cumsum(gain)])
        left = total[1:] - np.minimum.accumulate(total[:-1])
        right = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        return left + right - gain + m[0, 1:].max() + m[1:, 0].max() - inner < -1e-3

    def decode(self, rows: list[np.ndarray], cells: int = 100_000) -> list[np.ndarray]:
        """Viterbi labels of each sequence of emission scores with outside before and after it; sequences of like
        length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
        order, at, n = sorted(range(len(rows)), key=lambda i: len(rows[i])), 0, len(LABELS)
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(rows[order[end]]) <= cells:
                end += 1
            part, most = order[at:end], len(rows[order[end - 1]])
            at = end
            if not most:
                continue
            e = np.zeros((len(part), most, n))
            for i, r in enumerate(part):
                e[i, : len(rows[r])] = rows[r]
                e[i, len(rows[r]) :, 1:] = -1e9  # after the end only the outside label
            score, back = self.move[0] + e[:, 0], np.zeros(e.shape, np.int8)
            for t in range(1, most):
                v = score[:, :, None] + self.move
                back[:, t] = v.argmax(1)
                score = v.max(1) + e[:, t]
            label = np.zeros((len(part), most), np.int64)
            label[:, -1] = (score + self.move[:, 0]).argmax(1)
            for t in range(most - 1, 0, -1):
                label[:, t - 1] = back[np.arange(len(part)), t, label[:, t]]
            for i, r in enumerate(part):
                out[r] = label[i, : len(rows[r])]
        return out

    def runs(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text number, start, end, label) of every run of one label but outside."""
        where, rows = [], []
        for n, text in enumerate(texts):
            starts, ends, shapes, gaps = tokens(text)
            if not len(starts):
                continue
            e = self.scores(shapes, gaps)
            edge = np.flatnonzero(np.diff(np.concatenate([[True], self.certain(e), [True]])))
            for a, b in edge.reshape(-1, 2).tolist():
                where.append((n, starts[a:b], ends[a:b]))
                rows.append(e[a:b])
        for (n, starts, ends), labels in zip(where, self.decode(rows), strict=True):
            if not labels.any():
                continue
            cut = np.flatnonzero(np.diff(labels)) + 1
            for i, j in zip([0, *cut], [*cut, len(labels)]):
                if labels[i]:
                    yield n, int(starts[i]), int(ends[j - 1]), int(labels[i])


def labelled_table(n: int = 700, seed: int = 5) -> list[list[tuple[str, int]]]:
    """The small labelled table: sentences as (text, label) pieces, made by rule from a seed."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvz"), rng.integers(2, 10)))
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[rng.integers(len(x))]

    def made(kind: int) -> str:
        if kind == 1:
            host = f"{word()}.{pick('com', 'org', 'net', 'de', 'fr', 'example')}"
            at, name = pick("@", " @ ", " at ", " at ", " (at) ", " (at) "), f"{word()}{pick('', '.' + word(), '_' + word(), num(2))}"
            spelled = f"{name}{at}{host if rng.random() < (0.45 if ' ' in at else 0.9) else host.replace('.', ' dot ')}"
            return pick(spelled, spelled, spelled.upper())
        if kind == 2:
            return ".".join(str(rng.integers(0, 256)) for _ in range(4))
        if kind == 3:
            return pick(" ", "-", "").join(num(4) for _ in range(4))
        a, b, c = num(3), num(3), num(4)
        return pick(f"+{num(pick(1, 2))} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)}-{a}-{b}-{c}")

    out = []
    for _ in range(n):
        row: list[tuple[str, int]] = []
        for _ in range(rng.integers(1, 4)):
            row += [(pick(w, w, w, w, w, w, w.capitalize(), w.upper()), 0) for w in [word() for _ in range(rng.integers(1, 6))]]
            other = rng.random()
            if other < 0.55:
                kind = int(pick(1, 1, 2, 3, 4))
                row.append((made(kind), kind))
            elif other < 0.95:  # numbers that are nobody's
                row.append((pick(num(2), num(4), f"{num(2)}.{num(2)}.{num(4)}", f"{num(1)},{num(3)}", f"{num(4)}-{num(2)}-{num(2)}", f"v{num(1)}.{num(1)}.{num(1)}", f"{num(2)}:{num(2)}", f"({num(2)})", f"{num(1)}.{num(2)}", f"{num(3)}-{num(3)}", "@", f"@{word()}", f"{word()}-{num(3)}", f"#{num(5)}", num(8), num(12)), 0))
            if rng.random() < 0.5:
                row.append((pick(".", ",", ":", ";"), 0))
        out.append(row)
    return out


def as_row(pieces: list[tuple[str, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The sentence of labelled pieces and its labelled spans; one gap of ten is a line end."""
    text, spans = "", []
    for piece, kind in pieces:
        if text and piece not in ".,:;":
            text += "\n" if rng.random() < 0.1 else " "
        if kind and " " in piece and rng.random() < 0.08:
            at = int(rng.choice([i for i, c in enumerate(piece) if c == " "]))
            piece = f"{piece[:at]}\n{piece[at + 1:]}"
        spans.append((len(text), len(text) + len(piece), kind))
        text += piece
    return text, spans


@lru_cache(maxsize=1)
def trained() -> Field:
    rng, rows = np.random.default_rng(6), []
    for pieces in labelled_table():
        text, spans = as_row(pieces, rng)
        starts, _, shapes, gaps = tokens(text)
        labels = np.array([next(k for a, b, k in spans if a <= s < b) for s in starts.tolist()])
        rows.append((features(shapes, gaps), labels))
    return Field().fit(rows)


#: A spelled-out address; the end of one sentence and the at of the next are none.
SPELLED = re.compile(r"[a-z0-9._%+-] ?(?: at |\(at\)) ?[a-z0-9-]+(?:(?:\.| dot )[a-z0-9-]+)+")


def fine(kind: int, body: str) -> bool:
    """Whether a run of a label holds what its kind must: enough digits, or an at and a host with a dot."""
    body = " ".join(body.lower().split())
    digits = sum(c in "0123456789" for c in body)
    if kind == 1:
        return "@" in body and ("." in body or " dot " in body) or bool(SPELLED.search(body))
    if any(c.isalpha() for c in body):
        return False
    return (body.count(".") == 3 and digits >= 4) if kind == 2 else 13 <= digits <= 19 if kind == 3 else 7 <= digits <= 15


def added_spans(field: Field, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the field finds in each text beside its base spans: fine runs of one label, trimmed of closing marks.
    A run over line ends is cut at them; over one line end it counts whole unless both parts are fine by themselves."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for n, start, end, kind in field.runs(texts):
        text = texts[n]

        def trimmed(a: int, b: int) -> tuple[int, int]:
            """Without white space and marks at the end; of numbers, from the first digit, plus or bracket to the last digit."""
            while b > a and (text[b - 1] not in "0123456789" if kind > 1 else text[b - 1] in ".,:;-(/" or text[b - 1].isspace()):
                b -= 1
            while a < b and (text[a] not in "0123456789+(" if kind > 1 else text[a].isspace()):
                a += 1
            return a, b

        def good(*spans: tuple[int, int]) -> list[tuple[int, int]]:
            return [(a, b) for a, b in itertools.starmap(trimmed, spans) if b > a and fine(kind, text[a:b])]

        parts = list(pairwise([start, *(i for i in range(start, end) if text[i] == "\n"), end]))
        found = good(*parts)
        if len(found) < 2 and len(parts) == 2:
            found = good((start, end)) or found
        out[n] += [(a, kind - 1, b) for a, b in found if not any(s < b and a < e for s, _, e in bases[n])]
    return out


#: What every base span holds.
SIGN = re.compile(r"[0-9@]")


def all_spans(texts: list[str], field: Field | None = None) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text, as (start, kind number, end)."""
    bases = [base_spans(t) if SIGN.search(t) else [] for t in texts]
    more = added_spans(field or trained(), texts, bases)
    return bases, [sorted(a + b) for a, b in zip(bases, more, strict=True)]


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, counts of base spans by kind, their digest, and all spans.

    Null text counts as empty: no spans, the digest of the empty string. Null doc_id and repeated rows are
    kept, extra columns ignored. Spans of different kinds may overlap in the base; added ones overlap none."""

    shared = docs.sparkSession.sparkContext.broadcast(trained())  # some 1500 weights

    def make():
        def f(keys: list, texts: list[str]) -> dict:
            bases, every = all_spans(texts, shared.value)
            out = {"doc_id": keys, "base_sha256": [hashlib.sha256(join_spans(b).encode()).hexdigest() for b in bases], "spans": [join_spans(x) for x in every]}
            return out | {f"n_{k}": [sum(x[1] == i for x in b) for b in bases] for i, k in enumerate(KINDS)}

        return f

    return map_texts(docs, make, SCHEMA)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans one mark stands for all."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text and n_chars, if there, set to its new length; a null text stays null."""

    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def make():
        def f(rows: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            spans, old = all_spans(texts, shared.value)[1], rows.column("text").is_null().to_pylist()
            new = [None if gone else mask(t, s) for t, s, gone in zip(texts, spans, old, strict=True)]
            put = {"text": new, "n_chars": [None if t is None else len(t) for t in new]}
            return pa.RecordBatch.from_arrays([pa.array(put[x.name], x.type) if x.name in put else rows.column(i) for i, x in enumerate(rows.schema)], schema=rows.schema)

        return f

    return map_rows(docs, make)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
