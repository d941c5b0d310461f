"""Sizes of texts in tokens of a public subword tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder with the vocabulary files; never part of this repository.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Byte-level BPE vocabulary that sizes are measured with.
SIZING_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's texts are cut before merging.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_bpe(path: str):
    """The byte-level BPE encoder whose ranks are in the file at ``path``."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("sizes", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = TOKENIZERS) -> Column:
    """Exact number of tokens of each text; null and empty texts have none.

    The encoder is loaded once per Python worker. Strings that look like special tokens count as ordinary text.
    """
    path = f"{folder}/{SIZING_VOCABULARY}"

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = byte_bpe(path)
        for texts in batches:
            yield pd.Series([0 if t is None else len(encoder.encode_ordinary(t)) for t in texts], dtype="int64")

    return count(text)
