"""Prose extraction on hostile markup; reading levels on held-out grades."""

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import reading
from palimpsest.llm.prose import prose


@pytest.mark.parametrize(
    "text, words",
    [
        (None, ""), ("", ""), ("plain words", "plain words"),
        ("\\documentclass{a} no \\title{x} \\begin{document} yes \\end{document} no", "yes"), ("\\documentclass{a}\\newcommand{\\x}{cut", ""), ("\\begin{document}cut off", "cut off"),
        ("a % no\nb 5\\% c", "a b 5 c"), ("a \\\\% no\nb", "a b"), ("% \\begin{document}\n\\documentclass{x}\\begin{document}a\\end{document}", "a"),
        ("a\\iffalse no \\fi b", "a b"), ("a\\begin{comment}no\\end{comment}b\\begin{comment} no", "a b"), ("a \\begin{equation}x\\end{equation} b \\be y \\ee c \\begin{align*}z\\end{align*}", "a b c"),
        ("a $x$ b $$y$$ c \\(z\\) d \\[w\\] e \\$ f", "a b c d e f"), ("\\section*{no {no}} a \\subsection{no}b {\\bf no}\\par c", "a b c"), ("a \\emph{b} {\\em c} \\textit{d} ~\\cite[p. 1]{no} e\\footnote{no \\ref{no} no}.", "a b c d e ."),
        ("\\begin{figure}\\caption{no}\\end{figure}a\\begin{verbatim}no\\end{verbatim} \\begin{thebibliography}{9}\\bibitem{x} no", "a"), ("a\r\n\r\nb", "a b"), ("\\input{no}a \\unknown{b} {c", "a b c"),
    ],
)
def test_prose(text, words):
    assert prose(text).split() == words.split()


def test_long_texts_are_linear():
    assert len(prose("{" * 300_000)) > 0
    assert prose("\\section{" * 50_000 + "x") is not None
    assert prose("word " * 400_000).count("word") == 400_000


def test_style():
    assert reading.style("One two three. Four five six seven! Hm.") == (8, 3.5, pytest.approx(29 / 8))
    assert reading.style(None) == (0, 0.0, 0.0)
    assert reading.place(1e9, 1e9) == reading.place(1e10, 61.0) and reading.place(0.0, 0.0) == (0, 0)


EASY, HARD = "The dog saw the cat. ", "Notwithstanding considerable epistemological reservations concerning methodological idiosyncrasies, contemporary investigators nevertheless characterise interdependencies. "


def corpus(spark, n=60):
    text = F.when(F.col("id") % 2 == 0, F.repeat(F.lit(EASY), 20)).otherwise(F.repeat(F.lit(HARD), 10))
    return spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.element_at(F.array(F.lit("en"), F.lit(" EN-gb"), F.lit("de"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("lang"), F.lit("clash").alias("a"), F.lit(9).alias("grade"))


GRADES = "doc_id long, rater string, reading_level int, rated_at timestamp"


def test_grades_spread(spark):
    g = spark.createDataFrame([(0, "a", 1, None), (0, "a", 1, None), (0, "b", 2, None), (1, "a", 5, None), (4, "a", None, None), (4, "a", 77, None), (None, "a", 3, None), (999, "a", 3, None)], GRADES)
    assert {r.doc_id: r.grade for r in reading.grades(g).collect()} == {0: 1.5, 1: 5.0, 999: 3.0}
    out = {r.doc_id: r.level for r in reading.levels(corpus(spark), g).collect()}
    assert set(out) == {n for n in range(60) if n % 4 < 2}
    assert all((v > 3.5) == (n % 2 == 1) for n, v in out.items())
    assert {r.doc_id for r in reading.demanding(corpus(spark), g).collect()} == {n for n in out if n % 2 == 1}


def test_nothing_to_go_by(spark):
    none = spark.createDataFrame([], GRADES)
    assert {r.level for r in reading.levels(corpus(spark), none).collect()} == {None}
    assert reading.demanding(corpus(spark), none).count() == 0
    assert reading.levels(corpus(spark).limit(0), none).count() == 0
    blank = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (None, EASY * 20, "en"), (1, EASY * 20, "en"), (1, EASY * 20, "en")], "doc_id long, text string, lang string")
    one = spark.createDataFrame([(1, "a", 2, None)], GRADES)
    assert sorted((r.doc_id or -1, r.level) for r in reading.levels(blank, one).collect()) == [(-1, 2.0), (1, 2.0), (1, 2.0)]


def test_cells_are_shared_by_the_near(spark):
    """Places apart by d quarters of a cell share GRIDS - d cells."""
    rows = {(r.a, r.b): set(r.c) for r in spark.createDataFrame([(a, b) for a in range(9) for b in range(9)], "a long, b long").withColumn("c", reading.cells()).collect()}
    for (a, b), c in rows.items():
        assert len(c) == reading.GRIDS
        if (a + 2, b) in rows:
            assert len(c & rows[a + 2, b]) == 2
        if (a + 4, b) in rows:
            assert not c & rows[a + 4, b]


def test_values_are_harmonic(spark):
    """Every place has the mean of its cells, every cell that of its documents, up to the tolerance; grades stay."""
    import random

    rng = random.Random(2)
    rows = [(float(a), float(b), rng.randint(1, 9)) for a in range(12) for b in range(12) if rng.random() < 0.7]
    table = [(int(a), int(b), float(n), float(g := 1 if rng.random() < 0.15 else 0), g * float(1 + 4 * (a + b) / 22)) for a, b, n in rows]
    nodes = spark.createDataFrame(table, "a long, b long, n double, graded double, sum double")
    state, rounds, moved = reading.propagate(nodes, 0.002)
    x = {(r.a, r.b): r.x for r in state.collect()}
    weight = sum(t[2] for t in table) / sum(t[3] for t in table)
    cells = {}
    for a, b, n, g, s in table:
        for k in range(4):
            c = cells.setdefault((k, (a + k) // 4, (b + k) // 4), [0.0, 0.0])
            c[0] += weight * s + (n - g) * x[a, b]
            c[1] += weight * g + n - g
    for a, b, *_ in table:
        mean = sum(cells[k, (a + k) // 4, (b + k) // 4][0] / cells[k, (a + k) // 4, (b + k) // 4][1] for k in range(4)) / 4
        assert abs(mean - x[a, b]) <= 0.002 + 1e-9
    assert moved <= 0.002 and rounds % reading.TOGETHER == 0
    assert x[max(x)] > x[min(x)] + 1  # the grades grow to the right and upwards


def test_held_out_grades(spark, data):
    """Two thirds of the larger test tables' grades find which of the others are demanding."""
    d = data.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    known = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0)
    held = reading.grades(labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0))
    rows = reading.levels(docs, known).join(held, "doc_id").collect()
    hit = sum(r.level >= 3.5 and r.grade >= 3.5 for r in rows)
    assert len(rows) >= 150
    assert hit >= 0.9 * sum(r.grade >= 3.5 for r in rows) and hit >= 0.9 * sum(r.level >= 3.5 for r in rows)
