"""Token counts of whole texts by a public tokenizer, in Arrow functions that
return lengths only.

Texts are encoded in batches that hold about equal numbers of bytes; a text over
``LONG`` characters is split at boundaries no token crosses (a single space
between two characters that are neither white space nor the piece mark), and its
parts' counts are added. Defined results: null and empty texts have 0 bytes and 0
tokens; a long text without a safe boundary is encoded as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import bound_batches

LONG, BATCH_BYTES = 16_384, 1 << 18
SAFE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


@lru_cache(maxsize=4)
def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def safe_parts(text: str, path: str, size: int = LONG) -> list[str]:
    """Parts of at least ``size`` characters whose counts add up to the text's. A
    piece model writes the space as the mark of the next word, so it goes with the
    boundary; a byte-level one keeps it at the head of the next part."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size and (m := SAFE.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.end() if path.endswith(".model") else m.start()
    return [*out, text[at:]]


def count_batch(texts: list[str | None], path: str) -> list[int]:
    count, out = _counter(path), [0] * len(texts)
    parts: list[str] = []
    own: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal parts, own, held
        for i, n in zip(own, count(parts) if parts else []):
            out[i] += n
        parts, own, held = [], [], 0

    for i, text in enumerate(texts):
        for part in safe_parts(text or "", path):
            if part:
                parts.append(part)
                own.append(i)
                held += len(part.encode())
                if held >= BATCH_BYTES:
                    flush()
    flush()
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; ``path`` names the
    tokenizer's file, which every executor has under that name."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count_batch(b.column(2).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
