"""BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

A merge can depend on text to its right only through a chain of earlier merges, each of which starts where
the one before it ends. From the merge list follows how far such a chain reaches at most: the sufficient
lookahead. A token that ends at least that far before the end of what has been read is final, and the rest
of the text is encoded as if it began there. Every word, of any length, goes through this machine; a word that
goes on in the next block of text stays open in it, so memory stays constant however long a word is. A memo of
bounded size keeps what the machine gave for short words."""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Unicode white space; Python's own class has four control characters more.
SPACE = r"\t-\r \x85\xa0  -     　"

NONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself if visible in Latin-1, else the
    next code point from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class MergeList:
    """Merges by rank over token ids; word_end marks a word's last symbol."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.spec, self.vocab = spec, model["vocab"]
        self.word_end = model.get("end_of_word_suffix") or ""
        self.pieces: dict[int, str] = {i: t for t, i in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pieces.update({i: t for t, i in self.special.items()})
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rules = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in ((a, b) for a, b in pairs)]
        self.rank = {(a, b): r for r, (a, b, _) in reversed(list(enumerate(self.rules)))}
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.word_end] for x in letters]
        self.length = {i: len(t.removesuffix(self.word_end)) if self.word_end else len(t) for t, i in self.vocab.items()}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """The largest distance to the right on which a merge can depend.

        reach[x]: over the rules so far with left side x, the farthest that their decisions look past x's end.
        A rule (u, v) may lose v's end only to an earlier rule whose left side is v or a token that ends v."""
        reach: dict[int, int] = {}
        most = 1
        for a, b, _ in self.rules:
            text = self.pieces[b]
            ends = (self.vocab.get(text[k:]) for k in range(len(text)))
            beyond = max((reach.get(x, 0) for x in ends if x is not None), default=0)
            far = self.length[b] + beyond
            reach[a] = max(reach.get(a, 0), far)
            most = max(most, far)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges by rank, leftmost first. Few symbols: the best of all ranks is looked up; many: it comes from a heap."""
        if len(ids) > 48:
            return self._merge_heap(ids)
        get, rules = self.rank.get, self.rules
        ranks = [get(p, NONE) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < NONE:
            i = ranks.index(best)
            ids[i] = new = rules[best][2]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], new), NONE)
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), NONE)
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        """The same in n log n steps: places stay, neighbours are linked, and a stale entry no longer has its rank."""
        get, rules, n = self.rank.get, self.rules, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [get(p, NONE) for p in zip(ids, ids[1:])] + [NONE]
        heap = [r * n + i for i, r in enumerate(now) if r < NONE]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            if now[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j], now[j] = rules[rank][2], -1, NONE
            after[i] = k = after[j]
            now[i] = NONE
            if k < n:
                before[k] = i
                if (r := get((ids[i], ids[k]), NONE)) < NONE:
                    now[i] = r
                    heappush(heap, r * n + i)
            if (h := before[i]) >= 0:
                now[h] = r = get((ids[h], ids[i]), NONE)
                if r < NONE:
                    heappush(heap, r * n + h)
        return [x for x in ids if x >= 0]


class WordEncoder:
    """One word, fed in byte chunks: tokens come out as soon as they're final."""

    def __init__(self, merges: MergeList, block: int = 4096) -> None:
        self.m, self.block, self.held = merges, block, b""

    def feed(self, data: bytes) -> Iterator[int]:
        size = self.m.lookahead + self.block
        self.held += data
        start = 0
        while len(self.held) - start > size:  # at least one byte more follows, so no symbol here is the last
            window = self.held[start : start + size]
            end = 0
            for t in self.m.merge([self.m.inner[b] for b in window]):
                if end + self.m.length[t] > size - self.m.lookahead:
                    break
                end += self.m.length[t]
                yield t
            if not end:
                raise ValueError("a token is longer than the block")
            start += end
        self.held = self.held[start:]

    def finish(self) -> Iterator[int]:
        if self.held:
            yield from self.m.merge([*(self.m.inner[b] for b in self.held[:-1]), self.m.last[self.held[-1]]])
        self.held = b""


class Transducer:
    """Text chunks -> ids, as bytes of little-endian unsigned 32-bit numbers.

    Follows the file's steps: special strings are taken out first; NFC and lower case; words by pattern; byte
    symbols; merges. Text is cut where neither normal form nor a special string nor a clitic can reach over; a run
    of letters or of marks that touches the cut stays open in its WordEncoder."""

    def __init__(self, path: str, memo: int = 150_000, short: int = 64) -> None:
        self.m, self.memo_size, self.short = merges(path), memo, short
        steps = [x["type"] for x in self.m.spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normalizer {steps}")
        pattern = self.m.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)
        self.words = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.m.special, key=len, reverse=True)))) if self.m.special else None
        self.reach = max(map(len, self.m.special), default=0)
        # How a run goes on: letters, or what is neither letter, digit nor space.
        self.more = {True: regex.compile(r"\p{L}+"), False: regex.compile(rf"[^{SPACE}\p{{L}}\p{{N}}]+")}
        self.memo: dict[str, bytes] = {}
        self.held, self.open, self.letters = "", None, False

    @staticmethod
    def _ids(tokens: Iterable[int]) -> bytes:
        return np.fromiter(tokens, "<u4").tobytes()

    def _word(self, w: str) -> bytes:
        coder, data = WordEncoder(self.m), w.encode("utf-8", "replace")
        out = self._ids([*coder.feed(data), *coder.finish()])
        if len(data) <= self.short:
            if len(self.memo) >= self.memo_size:
                self.memo.clear()
            self.memo[w] = out
        return out

    def _close(self) -> bytes:
        coder, self.open = self.open, None
        return self._ids(coder.finish()) if coder else b""

    def _plain(self, text: str) -> bytes:
        """Ids of the words of a piece, all but a run that touches its end and may go on."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library has no final sigma
        text, out = text.lower(), []
        if self.open and text:
            m = self.more[self.letters].match(text)
            if m:
                out.append(self._ids(self.open.feed(m.group().encode("utf-8", "replace"))))
                text = text[m.end() :]
            if text:
                out.append(self._close())
        found = self.words(text)
        last = found.pop() if found and text.endswith(found[-1]) else None
        memo, word = self.memo, self._word
        out += [memo.get(w) or word(w) for w in found]
        if last is not None:
            kind = bool(self.more[True].fullmatch(last))
            if kind or self.more[False].fullmatch(last):
                self.open, self.letters = WordEncoder(self.m), kind
                out.append(self._ids(self.open.feed(last.encode("utf-8", "replace"))))
            else:
                out.append(memo.get(last) or word(last))
        return b"".join(out)

    def _encode(self, text: str) -> bytes:
        if self.special is None or "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for x in self.special.finditer(text):
            out += [self._plain(text[at : x.start()]), self._close(), self._ids([self.m.special[x.group()]])]
            at = x.end()
        return b"".join([*out, self._plain(text[at:])])

    def _cut(self, text: str) -> int:
        """The last place, at least a special string's length before the end, where the text can be cut; 0 if none
        is near (in a long run of combining marks)."""
        i = len(text) - self.reach
        least = max(0, i - 4096)
        while i > least:
            open_special = text.rfind("<|", max(0, i - self.reach), i + 1)
            if open_special >= 0:
                i = open_special
            elif "'" in text[max(0, i - 3) : i] or not starts_new(text[i]):
                i -= 1
            else:
                return i
        return 0

    def feed(self, chunk: str) -> bytes:
        """Ids that this chunk makes final."""
        self.held += chunk
        at = self._cut(self.held)
        done, self.held = self.held[:at], self.held[at:]
        return self._encode(done) if done else b""

    def finish(self) -> bytes:
        done, self.held = self.held, ""
        return self._encode(done) + self._close()

    def stream(self, text: str, block: int = 1 << 16) -> Iterator[bytes]:
        """Ids of a whole text, block by block."""
        for k in range(0, len(text), block):
            yield self.feed(text[k : k + block])
        yield self.finish()


def starts_new(c: str) -> bool:
    """Whether no normal form joins the character to one before it: letters (but conjoining Hangul), digits,
    punctuation and spaces; not marks."""
    return c < "\x80" or (unicodedata.category(c)[0] in "LNPZ" and not ("\u1100" <= c <= "\u11ff" or "\ua960" <= c <= "\ua97f" or "\ud7b0" <= c <= "\ud7ff"))


@lru_cache(maxsize=4)
def merges(path: str) -> MergeList:
    return MergeList(path)


class Decoder:
    """Ids -> text, block by block, as the file's decoder joins them: without one, pieces with a space between;
    with a byte-level one, bytes through an incremental UTF-8 machine that replaces what can't be text."""

    def __init__(self, path: str) -> None:
        self.m = merges(path)
        self.spaced = self.m.spec.get("decoder") is None
        self.first = True
        size = max(self.m.pieces) + 1
        self.text = [self.m.pieces.get(i, "") for i in range(size)]
        back = {c: b for b, c in enumerate(byte_letters())}
        self.raw = [bytes(back[c] for c in t) if i not in self.m.special.values() and all(c in back for c in t) else t.encode() for i, t in enumerate(self.text)]
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.spaced:
            text = self.text
            out = ("" if self.first else " ") + " ".join([text[i] for i in ids])
            self.first = False
            return out
        raw = self.raw
        return self.machine.decode(b"".join([raw[i] for i in ids]))

    def finish(self) -> str:
        self.first = True
        out = "" if self.spaced else self.machine.decode(b"", True)
        self.machine.reset()
        return out


def encode(text: str, path: str) -> list[int]:
    return np.frombuffer(b"".join(Transducer(path).stream(text)), "<u4").tolist()


def decode(ids: Iterable[int], path: str) -> str:
    d = Decoder(path)
    return d.feed(list(ids)) + d.finish()


def round_trip(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text: empty (no ids, empty decoding). Null doc_id and repeated rows are kept; extra columns ignored.
    Whole texts are encoded and decoded in blocks; only a block, a word's window and the memo are held."""

    def make():
        import public_tokenizers

        path = public_tokenizers.path(name)
        coder, back = Transducer(path), Decoder(path)

        def f(keys: list, texts: list[str]) -> dict:
            out: dict[str, list] = {"doc_id": keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in texts:
                a, b, n = hashlib.sha256(), hashlib.sha256(), 0
                for block in coder.stream(text):
                    a.update(block)
                    n += len(block) // 4
                    b.update(back.feed(np.frombuffer(block, "<u4").tolist()).encode())
                b.update(back.finish().encode())
                out["n_tokens"].append(n)
                out["ids_sha256"].append(a.hexdigest())
                out["decoded_sha256"].append(b.hexdigest())
            return out

        return f

    return map_texts(docs, make, SCHEMA)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
