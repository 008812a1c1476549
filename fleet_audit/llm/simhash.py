"""Near-duplicate classes of documents, by SimHash and multi-index hashing.

A null text counts as empty. A text without words has the fingerprint zero and links like any
other. Repeated rows are kept, each with its class. A null id never names a class that holds another id. Empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.llm.components import connected_components
from fleet_audit.llm.hamming import hamming_links
from fleet_audit.llm.shared import kept

SEED = 42
#: Shingles whose bits are counted at a time, so that one very long text needs no more memory than this.
_BLOCK = 1 << 17


def shingle_bytes(text: str | None, words: int) -> Iterator[list[bytes]]:
    """Blocks of the shingles of ``text``: A-Z in lower case, words between ASCII white space, joined by one space."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(found))
    first, last = starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist()
    for k in range(0, len(first), _BLOCK):
        yield [joined[i:j] for i, j in zip(first[k : k + _BLOCK], last[k : k + _BLOCK])]


def fingerprint(text: str | None, words: int) -> int:
    """SimHash over all shingles, repeats included, as a signed 64-bit number; zero without words."""
    total, ones = 0, np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for block in shingle_bytes(text, words):
        bits = np.frombuffer(b"".join([digest(s, SEED) for s in block]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
        total += len(block)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def simhash_classes(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, print, component_id`` per row: its fingerprint and the smallest id within reach over links of ``radius`` bits or fewer."""

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    rows = kept(docs.select(F.col(id_col), print_of(F.col(text_col)).alias("print")), "prints")
    prints = kept(rows.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first")), "distinct")
    links = hamming_links(prints.select("print", "n"), radius)
    roots = connected_components(links)
    joined = prints.join(roots, prints["print"] == roots["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    classes = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = joined.select("print", "root").join(classes, "root").select("print", "component_id")
    return rows.join(labels, "print").select(id_col, "print", "component_id")
