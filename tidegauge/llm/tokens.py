"""Token counts and ids by a public tokenizer whose vocabulary file is given as a parameter."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: The public byte-level BPE vocabulary of 50,256 tokens; another file, for any of the three libraries, may be given instead.
DEFAULT_FILE = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the byte-level BPE vocabularies split text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")


_SHARED: set[tuple[str, str]] = set()


def share(spark: SparkSession, path: str) -> None:
    """Sends a tokenizer's file to the executors, once a session: they need not have it on their disks."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _SHARED and os.path.exists(path):
        _SHARED.add((sc.applicationId, path))
        sc.addFile(path)


def located(path: str) -> str:
    """The file as it lies here: at its path, or as it was sent."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=4)
def vocabulary(path: str = DEFAULT_FILE) -> dict[int, bytes]:
    """Bytes of each token of a ``.tiktoken`` file."""
    with open(located(path), "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoder(path: str = DEFAULT_FILE):
    """A function from a text to its token ids (a list of int); special strings are ordinary text.

    ``.tiktoken`` files are byte-level BPE ranks, ``.json`` files belong to ``tokenizers``, ``.model`` to ``sentencepiece``.
    """
    if path.endswith(".tiktoken"):
        import tiktoken

        ranks = {token: i for i, token in vocabulary(path).items()}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(located(path))
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=located(path))
        return lambda text: p.encode(text, num_threads=1)
    raise ValueError(f"no tokenizer for {path}")


def encode(text: str | None, path: str = DEFAULT_FILE, block: int = 100_000) -> np.ndarray:
    """Token ids of a text as int32; NULL and empty texts have none.

    Longer texts than ``block`` are encoded in parts of about that length, cut before a single blank or line end between
    two other characters, where the pattern starts a new piece anyway: the ids are those of the whole text.
    """
    if not text:
        return np.empty(0, dtype=np.int32)
    f = encoder(path)
    if len(text) <= block or not path.endswith(".tiktoken"):
        return np.asarray(f(text), dtype=np.int32)
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + block) if at + block < len(text) else None
        end = m.start() if m else len(text)
        out.append(np.asarray(f(text[at:end]), dtype=np.int32))
        at = end
    return np.concatenate(out)


def decoder(path: str = DEFAULT_FILE):
    """A column function from token ids to the text's bytes, for byte-level vocabularies (``.tiktoken``)."""

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        table = vocabulary(path)
        return ids.map(lambda x: b"".join(table[i] for i in x))

    return run
