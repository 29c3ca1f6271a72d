"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_texts, table

#: A cut before a single space between two ASCII letters is a pre-token boundary of byte-level BPE,
#: of word BPE, and can't fall inside a special token.
SAFE = re.compile(r"[A-Za-z](?= [A-Za-z])")
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def safe_pieces(text: str, most: int) -> Iterator[str]:
    """Cut a long text at the first safe boundary at or after every `most` characters; without one, it stays whole."""
    start = 0
    while len(text) - start > most:
        m = SAFE.search(text, start + most)
        if not m:
            break
        yield text[start : m.end()]
        start = m.end()
    yield text[start:]


@lru_cache(maxsize=1)
def load(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, by the library for the file's kind."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if str(path).endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(path))
    tok.no_padding()
    tok.no_truncation()
    return lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, batch_bytes: int = 1 << 19, piece_chars: int = 1 << 16) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    tokenizer: a file name of public_tokenizers or a path. Null text: 0 bytes, 0 tokens. Null doc_id and
    repeated rows are kept as they come; extra columns are ignored. Texts above piece_chars are cut at
    boundaries that no token crosses (between letters and a space before a letter, in byte-level and word BPE), so
    counts add up exactly; sentencepiece texts and texts without such a boundary stay whole. Batches are balanced
    by their bytes in UTF-8."""

    def make():
        import public_tokenizers

        path = tokenizer if os.path.sep in tokenizer else public_tokenizers.path(tokenizer)
        count, whole = load(path), str(path).endswith(".model")

        def f(keys: list, texts: list[str]) -> dict:
            totals, batch, owner, size = [0] * len(texts), [], [], 0

            def flush() -> None:
                nonlocal size
                for i, n in zip(owner, count(batch) if batch else [], strict=True):
                    totals[i] += n
                batch.clear()
                owner.clear()
                size = 0

            n_bytes = [0] * len(texts)
            for i, t in enumerate(texts):
                for piece in [t] if whole else safe_pieces(t, piece_chars):
                    own = len(piece.encode())
                    if size and size + own > batch_bytes:
                        flush()
                    batch.append(piece)
                    owner.append(i)
                    size += own
                    n_bytes[i] += own
            flush()
            return {"doc_id": keys, "n_bytes": n_bytes, "n_tokens": totals}

        return f

    out = map_texts(docs, make, SCHEMA)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
