"""Token counts of whole texts under a public byte-level vocabulary, and small hashed vectors of them."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabulary file (a parameter everywhere; never part of this repository).
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published pattern that cuts text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_SHIPPED: set[tuple[str, str]] = set()


def ship_vocabulary(spark: SparkSession, vocabulary: str) -> None:
    """Send the vocabulary file to the executors, once per application, so it need not lie on their disks."""
    key = (spark.sparkContext.applicationId, vocabulary)
    if key not in _SHIPPED and Path(vocabulary).exists():
        spark.sparkContext.addFile(str(Path(vocabulary).resolve()))
        _SHIPPED.add(key)


def _found(vocabulary: str) -> str:
    """The file as sent with the application, else at its own path."""
    sent = SparkFiles.get(Path(vocabulary).resolve().name) if SparkFiles._root_directory else ""
    return sent if sent and Path(sent).exists() else vocabulary


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The tokenizer of a vocabulary file, once per Python worker."""
    import tiktoken

    with open(_found(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _directions(n: int, dims: int) -> np.ndarray:
    """A fixed random direction for each token id: the hashed vectors' projection to `dims` numbers."""
    return np.random.default_rng(20_240_601).standard_normal((n, dims)).astype(np.float32)


def _counter(vocabulary: str, dims: int):
    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            counts, places = [], np.zeros((b.num_rows, dims), np.float64)
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = enc.encode_to_numpy(text) if text else ()
                counts.append(len(ids))
                if dims and len(ids):
                    places[i] = _directions(enc.n_vocab, dims)[ids].mean(axis=0)
            columns = [b.column(c) for c in b.schema.names if c != "text"] + [pa.array(counts, pa.int64())]
            names = [c for c in b.schema.names if c != "text"] + ["n_tokens"]
            if dims:
                columns.append(pa.array(list(places), pa.list_(pa.float64())))
                names.append("place")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def token_counts(documents: DataFrame, *keep: str, vocabulary: str = VOCABULARY, dims: int = 0, text: str = "text") -> DataFrame:
    """Columns `keep`, n_tokens, and with `dims` above 0 also `place`: the mean of its tokens' random directions.

    Whole texts are counted; null and empty texts have 0 tokens and a place of zeros. The strings of special tokens
    are ordinary text.
    """
    ship_vocabulary(documents.sparkSession, vocabulary)
    d = documents.select(*keep, F.col(text).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "text") + ", n_tokens long"
    return d.mapInArrow(_counter(vocabulary, dims), kinds + (", place array<double>" if dims else ""))
