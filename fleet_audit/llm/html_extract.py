"""Main text of web pages, by a tree-structured graphical model over their elements (:mod:`fleet_audit.llm.dom_model`).

The model is trained on pages of the given table whose landmark elements label them, and on layouts made of their texts
(:mod:`fleet_audit.llm.labelled_pages`). At most ``SAMPLE_PAGES`` different pages, chosen by a hash, of which ``SAMPLE_CHARS`` characters each are
taken, make up the sample; extraction itself covers all rows and whole pages.

A null or empty page has an empty text, and so has a page without a block that is likely main text. Repeated rows are kept, each with its text.
Without labelled pages (also from an empty table) the layouts are filled with invented words. Other columns are kept; columns
with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleet_audit.llm.dom_model import DomModel, fit, inputs_of, node_labels
from fleet_audit.llm.dom_tree import landmark_labels, parse
from fleet_audit.llm.labelled_pages import laid_out, landmark_pages

SAMPLE_PAGES = 192
SAMPLE_CHARS = 1 << 15
LAYOUTS = 400
#: Characters of pages worked on at a time; a longer page is a block of its own.
_BLOCK_CHARS = 1 << 20


def fit_extraction(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS, layouts: int = LAYOUTS) -> DomModel:
    """A model trained on at most ``sample_pages`` pages of the table, in the layouts they have and in others."""
    h = F.xxhash64(html_col, F.lit("sample"))
    filled = pages.filter(F.length(html_col) > 0)
    drawn = [r["h"] for r in filled.select(h.alias("h")).distinct().orderBy("h").limit(sample_pages).collect()]
    sample = filled.filter(h.isin(drawn)).groupBy(h.alias("h")).agg(F.min(F.substring(html_col, 1, sample_chars)).alias("html"))
    found = sorted(sample.collect(), key=lambda r: r["h"])
    real = parse([r["html"] for r in found])
    known, texts = landmark_pages(real)
    kept_pages = [found[k]["html"] for k in known]
    forest = parse([*kept_pages, *laid_out(texts, layouts)])
    by_landmark = np.array(forest.page) < len(kept_pages)
    leaf_label = np.where(by_landmark, landmark_labels(forest), forest.label)
    return fit(inputs_of(forest), node_labels(forest, leaf_label))


def main_texts(pages: list[str | None], model: DomModel, least: float = 0.5) -> list[str]:
    """The main text of each page: its blocks of probability ``least`` or more, joined by an empty line."""
    forest = parse(pages)
    if not forest.text:
        return []
    marginals = model.marginals(inputs_of(forest))
    out: list[list[str]] = [[] for _ in pages]
    for page, text, chance in zip(forest.page.tolist(), forest.text, marginals.tolist()):
        if text is not None and chance >= least:
            out[page].append(text)
    return ["\n\n".join(blocks) for blocks in out]


def extract(pages: DataFrame, model: DomModel, html_col: str = "html", output_col: str = "text", least: float = 0.5) -> DataFrame:
    """``pages`` with the main text of each; the html column may be among the columns kept."""
    others = [c for c in pages.columns if c != output_col]
    schema = T.StructType([*(f for f in pages.schema.fields if f.name != output_col), T.StructField(output_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(html_col)
            sizes = pc.fill_null(pc.utf8_length(html), 0).to_pylist()
            first = 0
            while first < len(sizes):
                last, total = first + 1, sizes[first]
                while last < len(sizes) and total + sizes[last] <= _BLOCK_CHARS:
                    total += sizes[last]
                    last += 1
                part = batch.slice(first, last - first)
                texts = main_texts(html.slice(first, last - first).to_pylist(), model, least)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(texts, pa.string())], [*others, output_col])
                first = last

    return pages.mapInArrow(run, schema)
