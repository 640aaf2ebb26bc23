"""Sizes of texts in tokens of a public tokenizer, read from a vocabulary file that is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of public vocabulary files; every executor must see it.
TOKENIZERS = os.environ.get("GLEANFRAME_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"

# Fixed value: the pattern by which byte-level vocabularies of this kind cut text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Longer texts are tokenized block by block, cut after line feeds or else anywhere, to bound a call's memory.
BLOCK = 100_000


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    """The tokenizer of a ``.tiktoken``, ``.json`` or ``.model`` file as a function from text to its number of tokens."""
    if vocabulary.endswith(".tiktoken"):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(e.encode_ordinary(text))
    if vocabulary.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        t.encode_special_tokens = True
        return lambda text: len(t.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return lambda text: len(s.encode(text))


def count_tokens(text: str, count) -> int:
    if len(text) <= BLOCK:
        return count(text)
    total, start = 0, 0
    while start < len(text):
        end = start + BLOCK
        cut = text.rfind("\n", start, end) + 1 if end < len(text) else end
        end = cut if cut > start else end
        total += count(text[start:end])
        start = end
    return total


def _counter(vocabulary: str, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoding(vocabulary)
        for b in batches:
            sizes = [count_tokens(t, count) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sizes, pa.int64())], names=[*fields, "n_tokens"])

    return run


def token_counts(docs: DataFrame, keep: dict[str, object], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` (name -> column) of each row with ``n_tokens``; null and empty texts have 0. One Arrow pass, no shuffle."""
    rows = docs.select(F.col(text_col).alias("_text"), *[F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in keep.items()])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_counter(vocabulary, [f.name for f in rows.schema.fields[1:]]), schema)
