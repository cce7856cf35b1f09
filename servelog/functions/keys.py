"""Hash keys: prompt prefixes, cumulative block chains, API keys, ring positions.

All hashes are md5/sha256 hex so that any SQL engine reproduces them. A ring
position is the first 16 hex digits: fixed-width lower-case hex compares like
the unsigned 64-bit integer it spells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_CHARS = 512
BUCKET_DIGITS = 3


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefix_key(text: str | Column, n_chars: int = PREFIX_CHARS) -> Column:
    """Key of the first ``n_chars`` code points: equal prefixes, equal keys."""
    return F.md5(F.substring(_col(text), 1, n_chars))


def hash_api_key(token: str | Column) -> Column:
    return F.sha2(_col(token).cast("string"), 256)


def ring_position(text: str | Column) -> Column:
    # Never null: else joins on it re-evaluate the hash in a pushed-down filter.
    return F.coalesce(F.substring(F.md5(_col(text)), 1, 16), F.lit("0" * 16))


def ring_bucket(position: str | Column, digits: int = BUCKET_DIGITS) -> Column:
    """The first hex digits of a ring position; three are its top 12 bits."""
    return F.coalesce(F.substring(_col(position), 1, digits), F.lit("0" * digits))


#: Texts that Python holds as strings at a time; the rest of a batch stays in Arrow buffers.
_TEXTS = 64


def _chain(text: str, block_chars: int) -> list[str]:
    digest, hashes = "", []
    for end in range(block_chars, len(text) + 1, block_chars):
        digest = hashlib.md5((digest + text[end - block_chars:end]).encode("utf-8")).hexdigest()
        hashes.append(digest)
    return hashes


def block_chain_udf(block_chars: int):
    """array<string>: entry d hashes the leading d complete blocks.

    ``chain[d] = md5(chain[d-1] || block_d)`` reads each character once. A
    built-in ``aggregate`` would copy the growing array at every block.
    """
    @F.arrow_udf("array<string>")
    def chain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.string())
        for texts in batches:
            parts = [pa.array([_chain(t or "", block_chars) for t in texts.slice(at, _TEXTS).to_pylist()], kind)
                     for at in range(0, len(texts), _TEXTS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)
    return chain


def block_path(text: str | Column, block_chars: int = 64) -> Column:
    return block_chain_udf(block_chars)(_col(text))


def block_chain(df: DataFrame, text: str, block_chars: int = 64,
                keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Rows (keep…, depth, chain_hash), one per complete block of the whole text.

    A text shorter than one block has no rows.
    """
    return (df.select(*keep, block_path(text, block_chars).alias("path"))
            .select(*keep, F.posexplode("path").alias("pos", "chain_hash"))
            .select(*keep, (F.col("pos") + 1).alias("depth"), "chain_hash"))
