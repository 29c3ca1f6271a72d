"""Near-duplicate detection by Order MinHash with verification by banded alignment.

A text is its sequence of word 5-grams, each labelled with its occurrence number, so repeats count. One sketch
takes the few labelled k-mers with the smallest hashes under one permutation and keeps them in text order: two
texts share it with a chance that falls with their edit distance, not only with their sets. Bands of sketches
are the bucket keys; texts of few k-mers have a prefix of their smallest k-mers as keys besides, which no
similar pair can miss. Equal texts are one node from the start, numbered by one of its rows.

A bucket's pairs are never listed as such. At first every member is held against its bucket's smallest number
only, so a large group of near copies costs one comparison a member and bucket. Buckets that aren't one component
then go on in rounds: pivots (all members of a small bucket, a growing number of a large one) are held against
members of other components, until every bucket is one component or all its members were pivots. For buckets of
texts that share much but not enough, each text has a parity signature: bit i tells if an odd number of its
labelled k-mers fall into cell i. Two texts differ in at least as many k-mers as their signatures differ in
bits, so a pair whose signatures differ too much is no link and leaves the join at once. Neither rule loses a
link between different texts of a bucket.

A pair is verified by alignment: the longest chain of common labelled k-mers in the same order in both texts,
within a band of diagonals that holds every alignment of the wanted similarity. Words are compared by 32-bit
checksums: texts whose words differ but collide count as alike there (2e-10 a pair of words)."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free, part_of, slices, stash, table

K, TAKE, ROWS, BANDS, SIMILAR = 5, 3, 2, 32, 0.8
#: A word; in scripts that don't space their words (kana, ideographs, Thai to Khmer) a character.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORDS = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+").findall
CELLS = 16  # words of 64 bits in a parity signature
SHORT = 15  # k-mers up to which a text has exact keys
PIVOTS = 16  # of a bucket in the first round after the smallest; buckets of up to as many members are all pivots
GROWTH = 8  # of pivots from round to round
SKETCH = "doc_id long, node binary, bands array<long>, n int, sig array<long>, words binary"
#: Rows of at most 24 bytes that are sent to all executors (5 MB), and texts' signatures (about 150 bytes); more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_SIGNATURES = 200_000, 40_000

_rng = np.random.default_rng(20)
XOR = _rng.integers(0, 2**32, ROWS * BANDS, np.uint32)[:, None]
MUL = (_rng.integers(0, 2**31, ROWS * BANDS, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers of word hashes, each with its occurrence number; a shorter text is one k-mer."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = words.astype(np.uint64)
    k, out = min(K, n), np.zeros(max(1, n - K + 1), np.uint64)
    for j in range(k):
        out = mix(out + w[j : j + len(out)] + np.uint64(j + 1))
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not first.all():
        starts = np.flatnonzero(first)
        nth = np.arange(len(out)) - np.repeat(starts, np.diff(np.append(starts, len(out))))
        label = np.zeros(len(out), np.uint64)
        label[order] = nth.astype(np.uint64)
        out = mix(out + label * np.uint64(0xD6E8FEB86659FD93))
    return out


def exact_keys(marks: np.ndarray, least: float = SIMILAR) -> np.ndarray:
    """Keys of a text of up to SHORT k-mers: of any two that are `least` similar, the prefixes of the smallest
    n - ceil(least * n) + 1 k-mers have one in common."""
    n = len(marks)
    if not n or n > SHORT:
        return np.zeros(0, np.int64)
    prefix = n - int(np.ceil(least * n - 1e-9)) + 1
    return mix(np.sort(marks)[:prefix] + np.uint64(0x51ED270B)).view(np.int64)


def bands(marks: np.ndarray) -> np.ndarray:
    """Bucket keys of a text's labelled k-mers."""
    n = len(marks)
    if not n:
        return np.zeros(0, np.int64)
    small, take = (marks >> np.uint64(32)).astype(np.uint32), min(TAKE, n)
    block = max(1, (1 << 20) // n)  # sketches at a time, so a very long text needs no large matrix
    keys = []
    for a in range(0, ROWS * BANDS, block):
        v = (small ^ XOR[a : a + block]) * MUL[a : a + block]
        rows = np.arange(len(v))
        at = np.zeros((len(v), take), np.int64)
        for j in range(take):
            at[:, j] = v.argmin(1)
            if j + 1 < take:
                v[rows, at[:, j]] = 0xFFFFFFFF
        at.sort(1)  # text order
        key = np.zeros(len(v), np.uint64)
        for j in range(take):
            key = mix(key + marks[at[:, j]])
        keys.append(key)
    key = np.concatenate(keys).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1).astype(np.uint64)
    for j in range(ROWS):
        out = mix(out + key[:, j])
    return out.view(np.int64)


def signature(marks: np.ndarray) -> np.ndarray:
    """Parity of the labelled k-mers in each of 64 * CELLS cells."""
    odd = (np.bincount((mix(marks) % np.uint64(64 * CELLS)).astype(np.int64), minlength=64 * CELLS) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8")


def may_link(least: float) -> F.Column:
    """False only for pairs that can't reach `least`: a similarity s leaves at most (1 - s) / (1 + s) of both
    texts' k-mers unshared."""
    differ = sum((F.bit_count(F.col("sig")[i].bitwiseXOR(F.col("psig")[i])) for i in range(1, CELLS)), F.bit_count(F.col("sig")[0].bitwiseXOR(F.col("psig")[0])))
    return (differ <= (F.col("n") + F.col("pn")) * ((1 - least) / (1 + least)) + 1e-6) & (F.least("n", "pn") >= F.greatest("n", "pn") * least - 1e-6)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Of two word sequences: aligned k-mers over all k-mers, by the longest chain of common labelled k-mers in
    order. 0 as soon as it must be below `least`. Offsets beyond the band can't occur in such an alignment:
    each k-mer between the diagonals is unmatched, and these are at most (1 - least) of the longer text."""
    x, y = kmers(a), kmers(b)
    n, m = len(x), len(y)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if len(i) < least * (n + m - len(i)):
        return 0.0
    band = (1 - least) * max(n, m) + 1
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    chain: list[int] = []
    for v in j[np.argsort(i)].tolist():
        if not chain or v > chain[-1]:
            chain.append(v)
        else:
            chain[bisect_left(chain, v)] = v
    s = len(chain) / (n + m - len(chain))
    return s if s >= least else 0.0


def sketch(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, node (digest of the word sequence, or of the text if it has no word), bands, words (hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("n", pa.int32()), ("sig", pa.list_(pa.int64())), ("words", pa.binary())])
        for part, texts in slices(batches, 1):
            nodes, marks, seqs, sizes, sigs = [], [], [], [], []
            for t in texts:
                found = WORDS(t.lower())
                if len(memo) > 100_000:
                    memo.clear()
                for w in set(found).difference(memo):
                    memo[w] = zlib.crc32(w.encode("utf-8", "replace"))
                words = np.array([memo[w] for w in found], "<u4")
                own = kmers(words)
                nodes.append(hashlib.blake2b(" ".join(found).encode("utf-8", "replace") if found else b"\0" + t.encode("utf-8", "replace"), digest_size=16).digest())
                marks.append(np.concatenate([bands(own), exact_keys(own, least)]))
                sizes.append(len(own))
                sigs.append(signature(own))
                seqs.append(words.tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.binary()), pa.array(marks, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(sigs, pa.list_(pa.int64())), pa.array(seqs, pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def few(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked to be sent to all executors if its counted rows are few enough."""
    return F.broadcast(df) if rows <= most else df


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than so many rows need: a small table isn't written in hundreds of files."""
    return df.coalesce(1 + rows // 10_000) if rows < 1_000_000 else df


def verify(pairs: DataFrame, seqs: DataFrame, n: int, least: float) -> DataFrame:
    """The pairs (a, b) that are similar; seqs: id, n, sig, words of n texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            keep = [similarity(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least) > 0 for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = seqs.select(F.col("id").alias("a"), F.col("words").alias("wa")), seqs.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def may_pass(pairs: DataFrame, seqs: DataFrame, n: int, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures allow a link."""
    one = seqs.select(F.col("id").alias("a"), "n", "sig")
    two = seqs.select(F.col("id").alias("b"), F.col("n").alias("pn"), F.col("sig").alias("psig"))
    both = pairs.join(few(one, n, BROADCAST_SIGNATURES), "a").join(few(two, n, BROADCAST_SIGNATURES), "b")
    return both.filter(may_link(least)).select("a", "b")


def components(edges: DataFrame, n: int) -> tuple[DataFrame, int]:
    """id, label of every node in n edges (a, b), and their number: label is the smallest node of a component.
    Each step takes the smallest label around a node and then that label's own label, until nothing changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
    labels = stash(dealt(first.select("id", F.least("id", "m").alias("label")), 2 * n))
    size = labels.count()
    while True:
        old = labels
        near = both.join(few(labels.select(F.col("id").alias("b"), "label"), size), "b").select(F.col("a").alias("id"), "label", F.lit(None).cast("long").alias("old"))
        new = near.unionByName(labels.withColumn("old", F.col("label"))).groupBy("id").agg(F.min("label").alias("label"), F.min("old").alias("old"))
        new = stash(dealt(new, 2 * n))
        up = new.select(F.col("id").alias("label"), F.col("label").alias("top"))
        labels = stash(dealt(new.join(few(up, size), "label").select("id", F.least("label", "top").alias("label"), "old"), 2 * n))
        done = labels.filter("label <> old").isEmpty()
        free(old, new)
        labels = part_of(labels, "id", "label")
        if done:
            return labels, size


def rounds(open_: DataFrame, seqs: DataFrame, n: int, least: float) -> tuple[DataFrame, int] | None:
    """id, label of all texts that links join to others (and their number), None without links; open_: key, id of
    the buckets with several texts, seqs: id, n, sig, words of these n texts."""
    least_id = open_.groupBy("key").agg(F.min("id").alias("p"))
    pairs = open_.join(least_id, "key").filter("id <> p").select(F.col("id").alias("a"), F.col("p").alias("b")).distinct()
    passed = stash(may_pass(pairs, seqs, n, least))
    links = stash(verify(passed, seqs, n, least))
    free(passed)
    found, known, cells = links.count(), None, PIVOTS
    if found:
        known = components(links, found)
    free(links)
    done = None  # (key, id) of former pivots of the buckets that are left
    while True:
        now = open_
        if known:
            label, size = known
            now = now.join(few(label, size), "id", "left")
        now = now.select("key", "id", (F.coalesce("label", "id") if known else F.col("id")).alias("label"))
        alive = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"), F.min("id").alias("p"))
        alive = alive.filter("lo <> hi" + (f" AND members > {cells // GROWTH}" if cells > PIVOTS else "")).select("key", "members", "p")
        alive = stash(alive)
        if not (n_alive := alive.count()):
            free(alive)
            return known
        sigs = seqs.select("id", "n", "sig")
        now = stash(now.join(few(alive, n_alive), "key").join(few(sigs, n, BROADCAST_SIGNATURES), "id").select("key", "id", "label", "n", "sig", "members", "p"))
        # Cells of a round split those before, so earlier pivots stay pivots: only the new ones have work left.
        cell = F.when(F.col("members") <= cells, F.col("id")).otherwise(F.pmod(F.xxhash64("id"), F.lit(cells)))
        pivots = now.filter("id <> p").groupBy("key", cell.alias("cell")).agg(F.min(F.struct("id", "label", "n", "sig")).alias("v"))
        pivots = stash(pivots.select("key", F.col("v.id").alias("pivot"), F.col("v.label").alias("other"), F.col("v.n").alias("pn"), F.col("v.sig").alias("psig")))
        fresh = pivots if done is None else pivots.join(done, ["key", "pivot"], "left_anti")
        # Where all are pivots, a pair is met from one side only.
        one_way = (F.col("members") > cells) | (F.col("pivot") < F.col("id"))
        pairs = now.join(fresh, "key").filter((F.col("label") != F.col("other")) & one_way & may_link(least))
        pairs = pairs.select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).distinct()
        links = stash(verify(pairs, seqs, n, least))
        new = links.count()
        if done is not None:
            free(done)
        done = stash(pivots.join(few(alive.filter(F.col("members") > cells).select("key"), n_alive), "key").select("key", "pivot"))
        free(pivots, now, alive)
        if new:
            edges = links
            if known:
                edges = edges.unionByName(label.select(F.col("id").alias("a"), F.col("label").alias("b")))
            before, known = known, components(edges, new + (size if known else 0))
            if before:
                free(before[0])
        free(links)
        cells *= GROWTH


def near_classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept.

    Documents are in one class when a chain of pairs links them, each equal in words or at least `least`
    similar on aligned word 5-grams. class_id is the smallest doc_id of the class (null if all are null), and
    that row is kept; repeated rows with that doc_id are all kept. Texts without words are equal only if
    identical; null text counts as empty; shorter texts than 5 words are one k-mer; an empty table gives no rows.
    What it writes goes as soon as it isn't needed any more; the classes stay in the shared folder."""
    every = stash(sketch(docs, least).withColumn("row", F.monotonically_increasing_id()))
    nodes = stash(every.select("node", F.col("row").alias("id"), "bands").dropDuplicates(["node"]))
    members = nodes.select(F.explode("bands").alias("key"), "id")
    shared = members.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    open_ = stash(members.join(shared, "key").select("key", "id"))
    ids = stash(open_.select("id").distinct())
    n = ids.count()
    owner = every.select("doc_id", "node")
    known = seqs = None
    if n:
        seqs = stash(every.select(F.col("row").alias("id"), "n", "sig", "words").join(few(ids, n, 10 * BROADCAST_ROWS), "id", "left_semi"))
        known = rounds(open_, seqs, n, least)
    # A class is named by the label of its component (8 bytes), or by the digest of its only text (16 bytes).
    if known:
        label, size = known
        named = nodes.select("id", "node").join(few(label, size), "id").select("node", F.unhex(F.lpad(F.hex("label"), 16, "0")).alias("label"))
        owner = owner.join(few(named, size), "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    else:
        owner = owner.select("doc_id", F.col("node").alias("label"))
    owner = stash(owner)
    free(every, nodes, open_, ids, *([seqs] if seqs is not None else []), *([known[0]] if known else []))
    classes = owner.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return owner.join(classes, "label").select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
