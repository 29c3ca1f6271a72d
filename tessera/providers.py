"""The boundary to models: embedding, generation. Each is a function over a batch of texts, run in Arrow batches with
retries; the local ones need no service."""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Batch = Callable[[list[str]], list]
BATCH, ATTEMPTS, WAIT = 10, 3, 1.5


def with_retries(call: Batch, texts: list[str], attempts: int = ATTEMPTS, wait: float = WAIT) -> list:
    """call(texts), tried again after longer and longer waits; a result of another length is an error."""
    for n in range(1, attempts + 1):
        try:
            out = call(texts)
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} results for {len(texts)} texts")
            return out
        except Exception:
            if n == attempts:
                raise
            time.sleep(wait * n)
    return []


def hashed_vector(dim: int = 64) -> Batch:
    """Signed counts of hashed tokens and character pairs, of length one: the local embedder."""

    def call(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for x in re.findall(r"[a-z0-9]+|[\u4e00-\u9fff]{1,2}", t.lower()):
                h = zlib.crc32(x.encode())
                v[h % dim] += 1 if h >> 31 else -1
            n = np.sqrt((v * v).sum())
            out.append((v / n if n else v).tolist())
        return out

    return call


def embed(df: DataFrame, call: Batch | None = None, text: str = "text", to: str = "embedding", batch: int = BATCH, attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """df with a vector of each text, in row order; null counts as empty."""
    call = call or hashed_vector()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t or "" for t in f[text]]
            vecs = [v for i in range(0, len(texts), batch) for v in with_retries(call, texts[i : i + batch], attempts, wait)]
            yield f.assign(**{to: vecs})

    kept = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)
    return df.mapInPandas(run, f"{kept}, `{to}` array<double>")


def extractive(prompts: list[str]) -> list[str]:
    """The local generator: the first evidence's first sentence, as an answer object that cites it."""
    out = []
    for p in prompts:
        m = re.search(r"\[1\] [^\n]*\n([^\n]*)", p)
        said = re.split(r"(?<=[。.!?！？])", m.group(1))[0].strip() if m else ""
        out.append(json.dumps({"conclusion": "解释说明" if said else "无法判断", "reason": said, "citations": ["1"] if said else []}, ensure_ascii=False))
    return out


def generate(df: DataFrame, call: Batch | None = None, prompt: str = "prompt", to: str = "raw", attempts: int = 2, wait: float = WAIT) -> DataFrame:
    """df with what the model answers to each prompt; null where all attempts fail."""
    call = call or extractive

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p in f[prompt]:
                try:
                    out += with_retries(call, [p or ""], attempts, wait)
                except Exception:
                    out.append(None)
            yield f.assign(**{to: out})

    kept = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)
    return df.mapInPandas(run, f"{kept}, `{to}` string")
