"""Reading level of each document, from a few graded examples.

Documents are linked through cells of a style plane: the log of the mean sentence length against the mean word length of
their running prose, cut by several shifted grids, so that documents of like style share most of their cells (a
similarity graph with one edge per grid, never a pair of documents). Graded documents are clamped to their grade; a cell
gets the mean of its documents, every other document the mean of its cells, again and again until no value moves by more
than the tolerance: difficulty is then harmonic over the graph. Edges of graded documents weigh so much that all graded
documents together count like all documents, else the many ungraded ones would pull everything to the middle. Iteration
starts from the grades in the same cells or, where there are none, in cells of coarser grids, which saves most rounds.

A document's cells follow from its place in quarters of a cell, so documents at one place are one weighted node, and the
plane is bounded: the graph has at most some ten thousand nodes at any corpus size, and the text is read once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.prose import prose
from palimpsest.sources.scratch import materialize

GRIDS, PER_LOG_SENTENCE, PER_WORD = 4, 4.0, 1.5  # shifted grids; cells per unit of either axis
COARSER = (2, 4)  # times as wide are the cells of the grids that start values come from
LONGEST_SENTENCE, LONGEST_WORD = 5_000, 60  # the plane's bounds; beyond them styles are alike
TOLERANCE = 0.01  # largest change of a level in the last round
TOGETHER = 3  # rounds in one job, between which values are not written

_TOKEN = re.compile(r"[^\W\d_]+|[.!?]+(?=\s|$)")


def style(text: str | None) -> tuple[int, float, float]:
    """(words of running prose, mean words a sentence, mean letters a word). Sentences under 3 words don't count."""
    words = letters = long = held = sentences = 0
    for t in _TOKEN.findall(prose(text)):
        if t[0] in ".!?":
            if held >= 3:
                long += held
                sentences += 1
            held = 0
        else:
            words += 1
            held += 1
            letters += len(t)
    if held >= 3:
        long += held
        sentences += 1
    return words, long / sentences if sentences else float(words), letters / words if words else 0.0


def place(sentence: float, word: float) -> tuple[int, int]:
    """The style's place in the plane, in parts of a cell that the grids are shifted by."""
    a = math.log(min(max(sentence, 1.0), LONGEST_SENTENCE)) * PER_LOG_SENTENCE
    return int(a * GRIDS), int(min(word, LONGEST_WORD) * PER_WORD * GRIDS)


def cells(wide: int = 1) -> Column:
    """array<long>: of the place (a, b), its cell in each grid whose cells are ``wide`` times as wide."""
    one = lambda c, k: F.floor((F.col(c) + k * wide) / (GRIDS * wide))
    return F.array(*[((one("a", k) * 10_000 + one("b", k)) * 100 + wide) * GRIDS + k for k in range(GRIDS)])


def _styles(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words, sentence, word = style(text.as_py())
                if words >= least_words:
                    out.append((i, *place(sentence, word)))
            ids, a, b = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "a", "b"])

    return run


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): the mean over raters of each one's last valid level (1 to 5)."""
    last = labels.where("reading_level between 1 and 5 and doc_id is not null").groupBy("doc_id", "rater").agg(F.max(F.struct("rated_at", "reading_level")).alias("r"))
    return last.groupBy("doc_id").agg(F.avg("r.reading_level").alias("grade"))


def start(nodes: DataFrame, mean: float) -> DataFrame:
    """nodes with ``x``: the mean grade in its cells, else in its coarser cells, else of all."""
    widths = (1, *COARSER)
    edges = nodes.select("a", "b", F.posexplode(F.array(*[cells(w) for w in widths])).alias("scale", "cells"))
    edges = edges.select("a", "b", "scale", F.explode("cells").alias("cell"))
    told = edges.join(nodes.where("graded > 0").select("a", "b", "graded", "sum"), ["a", "b"]).groupBy("cell").agg(F.sum("graded").alias("g"), F.sum("sum").alias("s"))
    near = edges.join(told, "cell").groupBy("a", "b", "scale").agg((F.sum("s") / F.sum("g")).alias("x"))
    best = near.groupBy("a", "b").agg(F.min_by("x", "scale").alias("x"))
    return nodes.join(best, ["a", "b"], "left").withColumn("x", F.coalesce("x", F.lit(mean)))


def harmonic_round(nodes: DataFrame, weight: float) -> DataFrame:
    """nodes (a, b, n, graded, sum, x) with the next ``x``, and ``moved``: by how much it changed."""
    edges = nodes.select("*", F.explode(cells()).alias("cell"))
    free = F.col("n") - F.col("graded")
    cell = edges.groupBy("cell").agg((F.sum(weight * F.col("sum") + free * F.col("x")) / F.sum(weight * F.col("graded") + free)).alias("mean"))
    keep = ("a", "b", "n", "graded", "sum", "x")
    out = edges.join(cell, "cell").groupBy(*keep).agg(F.avg("mean").alias("next"))
    return out.select(*keep[:-1], F.col("next").alias("x"), F.abs(F.col("next") - F.col("x")).alias("moved"))


def propagate(nodes: DataFrame, tolerance: float = TOLERANCE) -> tuple[DataFrame, int, float]:
    """(nodes with ``x``, rounds, largest change in the last one). nodes: a, b, n documents, graded ones, sum of grades."""
    known, total, count = nodes.agg(F.sum("graded"), F.sum("sum"), F.sum("n")).first()
    state, rounds = materialize(start(nodes, total / known), "start"), 0
    while True:
        for _ in range(TOGETHER):
            state = harmonic_round(state, count / known)
        state = materialize(state, "harmonic")
        rounds += TOGETHER
        moved = state.agg(F.max("moved")).first()[0]
        if moved <= tolerance:
            return state, rounds, moved


def levels(documents: DataFrame, labels: DataFrame, language: str = "en", least_words: int = 60, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, level) of each document in the language with enough running prose; level is continuous, from 1 to 5.

    The language matches if lang, trimmed and in lower case, begins with ``language``; null doesn't match, except that ''
    matches all. Null and empty texts have no prose. Grades of documents that don't qualify don't count. Several rows of
    one doc_id are several documents with its grade. A graded document too gets the level that the graph gives its place,
    as single grades err. Without any grade the level is null.
    """
    read = documents.where(F.lower(F.trim("lang")).startswith(language) | (F.lit(language) == "")).select("doc_id", "text").mapInArrow(_styles(least_words), "doc_id long, a long, b long")
    docs = materialize(read.join(grades(labels), "doc_id", "left"), "styles")
    nodes = docs.groupBy("a", "b").agg(F.count("*").cast("double").alias("n"), F.count("grade").cast("double").alias("graded"), F.coalesce(F.sum("grade"), F.lit(0.0)).alias("sum"))
    nodes = materialize(nodes, "style-nodes")
    if not nodes.where("graded > 0").limit(1).count():
        return docs.select("doc_id", F.lit(None).cast("double").alias("level"))
    state, _, _ = propagate(nodes, tolerance)
    return docs.join(state.select("a", "b", F.col("x").alias("level")), ["a", "b"]).select("doc_id", "level")


def demanding(documents: DataFrame, labels: DataFrame, least: float = 3.5, **options) -> DataFrame:
    """doc_id of the documents at a level of at least ``least``, which rounds to 4 or 5."""
    return levels(documents, labels, **options).where(F.col("level") >= least).select("doc_id")
