"""Filling containers of fixed capacity with texts.

Texts over the capacity give full pieces, each a container, and a rest; rests and shorter texts are the items. Their
global histogram of lengths (at most capacity + 1 counts, whatever the corpus) is all the driver sees. Dynamic
programming cuts it into the length buckets that minimise padding. Batches within the token budget are planned on counts:
first those of bucket-mates that fill a container to the last token, pairs of lengths whose sums divide the capacity
evenly; then, from the longest bucket to the shortest, an item goes to the open batch it fits best, whatever bucket that
came from, else bucket-mates open new ones. Batches of one bucket only would leave much more unused (see the README). The
full batches are given up where the plan without them needs fewer containers, and of several numbers of buckets the one
that needs the fewest containers is taken. The plan says which ranks of a length go to
which containers, so each task places its own rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.prefix import running
from palimpsest.llm.tokens import VOCABULARY, n_tokens
from palimpsest.sources.scratch import materialize

BUCKETS = 16


def optimal_buckets(counts: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length ranges that minimise padding, sum of count x (bound - length).

    Exact. The best start of a range moves right with its end, so each row of the table is found by halving.
    """
    lengths = np.array(sorted(counts), np.int64)
    if not len(lengths):
        return []
    n = np.array([counts[int(x)] for x in lengths], np.int64)
    items, tokens = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * lengths)]
    size = len(lengths)

    def cost(i, j):  # items i..j-1 padded to the length of the last
        return lengths[j - 1] * (items[j] - items[i]) - (tokens[j] - tokens[i])

    best = np.r_[0, cost(np.zeros(size, int), np.arange(1, size + 1))].astype(float)
    cuts = []
    for _ in range(1, min(buckets, size)):
        now, cut = best.copy(), np.zeros(size + 1, np.int64)
        todo = [(1, size, 0, size - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            c = best[i] + cost(i, j)
            k = int(np.argmin(c))
            now[j], cut[j] = c[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = now
        cuts.append(cut)
    bounds, j = [], size
    for cut in [*reversed(cuts), np.zeros(size + 1, np.int64)]:
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
        if j == 0:
            break
    return bounds[::-1]


@dataclass(frozen=True)
class Slot:
    """Items of one length by rank: ``first``.. go to containers ``container``.., ``each`` a container, from ``position`` on."""

    length: int
    first: int
    container: int
    each: int
    position: int


def mates(counts: dict[int, int], capacity: int, bounds: list[int]) -> tuple[list[Slot], int, dict[int, int]]:
    """(slots, containers, items taken by length): batches of bucket-mates without any unused space.

    An even number of items whose pairs sum to the same even share of the capacity fill it exactly.
    """
    left, taken, slots, used = dict(counts), dict.fromkeys(counts, 0), [], 0
    shares = [(k, 2 * capacity // k) for k in range(2, 2 * capacity + 1, 2) if 2 * capacity % k == 0]
    for low, high in zip([0, *bounds], bounds):
        for k, pair in shares:
            if not 2 * low < pair <= 2 * high:
                continue
            for short in range(max(low + 1, pair - high), pair // 2 + 1):
                long = pair - short
                if short == long:
                    n = left.get(short, 0) // k
                    each = [(short, k, 0)]
                else:
                    n = min(left.get(short, 0), left.get(long, 0)) // (k // 2)
                    each = [(long, k // 2, 0), (short, k // 2, k // 2)]
                if n:
                    for length, many, position in each:
                        slots.append(Slot(length, taken[length], used, many, position))
                        left[length] -= n * many
                        taken[length] += n * many
                    used += n
    return slots, used, taken


def plan(counts: dict[int, int], capacity: int, bounds: list[int], across: bool = True) -> tuple[list[Slot], int]:
    """Slots of all items and the number of containers. ``across``: a batch may take items of shorter buckets too."""
    slots, used, taken = mates(counts, capacity, bounds)
    rest, total = _fit({x: n - taken[x] for x, n in counts.items()}, capacity, bounds, across)
    plain = _fit(counts, capacity, bounds, across)
    if plain[1] < used + total:
        return plain
    return slots + [Slot(s.length, s.first + taken[s.length], s.container + used, s.each, s.position) for s in rest], used + total


def best_plan(counts: dict[int, int], capacity: int, buckets: int = BUCKETS) -> tuple[list[Slot], int]:
    """The plan with the fewest containers over optimal buckets of halved numbers; of equals that with most buckets.

    Wider buckets have more mates that fill a container, narrower ones pad less.
    """
    best = None
    while buckets:
        now = plan(counts, capacity, optimal_buckets(counts, buckets))
        if best is None or now[1] < best[1]:
            best = now
        buckets //= 2
    return best


def _fit(counts: dict[int, int], capacity: int, bounds: list[int], across: bool) -> tuple[list[Slot], int]:
    slots: list[Slot] = []
    spaces: list[tuple[int, int, int, int]] = []  # space left, first container, how many, items in each; by space
    used = 0
    low = bounds[::-1][1:] + [-1]
    for high, under in zip(bounds[::-1], low):
        if not across:
            spaces = []
        for length in sorted((x for x in counts if under < x <= high), reverse=True):
            left, rank = counts[length], 0
            while left:
                at = bisect_left(spaces, (length, -1, 0, 0))
                if length and at < len(spaces):
                    space, start, many, held = spaces.pop(at)
                    each = 1 if left < many * (space // length) else space // length
                    took = min(left // each, many)
                    slots.append(Slot(length, rank, start, each, held))
                    if took < many:
                        insort(spaces, (space, start + took, many - took, held))
                    if space - each * length:
                        insort(spaces, (space - each * length, start, took, held + each))
                else:
                    each = min(left, capacity // length) if length else left
                    took = left // each
                    slots.append(Slot(length, rank, used, each, 0))
                    if length and capacity - each * length:
                        insort(spaces, (capacity - each * length, used, took, each))
                    used += took
                rank += each * took
                left -= each * took
    return slots, used


def _placer(plans: dict[str, tuple[dict[int, tuple[np.ndarray, ...]], int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            containers, positions = [], []
            for spec, length, rank in zip(*(batch.column(c).to_pylist() for c in ("spec_name", "rest", "rank"))):
                first, container, each, position = plans[spec][length]
                k = int(np.searchsorted(first, rank, "right")) - 1
                past = rank - int(first[k])
                containers.append(f"c{int(container[k]) + past // int(each[k])}")
                positions.append(int(position[k]) + past % int(each[k]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("spec_name"), pa.array(containers, pa.string()), batch.column("doc_id"), batch.column("piece"), pa.array(positions, pa.int64()), batch.column("start_token"), batch.column("rest")],
                ["spec_name", "container", "doc_id", "piece", "position", "start_token", "n_tokens"],
            )

    return run


PIECE = "spec_name string, container string, doc_id long, piece long, position long, start_token long, n_tokens long"


def histogram(rests: DataFrame) -> dict[str, dict[int, int]]:
    """spec -> length -> items: at most capacity + 1 counts a spec."""
    out: dict[str, dict[int, int]] = {}
    for spec, rest, n in rests.groupBy("spec_name", "rest").count().collect():
        out.setdefault(spec, {})[rest] = n
    return out


def items(documents: DataFrame, specs: list[tuple[str, int]], vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_tokens), written; and for each spec the full pieces and the rest of each text."""
    counted = materialize(documents.select("doc_id", n_tokens("text", vocabulary).alias("n_tokens")), "tokens")
    listed = F.explode(F.array(*[F.struct(F.lit(s).alias("spec_name"), F.lit(c).cast("long").alias("capacity")) for s, c in specs]))
    each = counted.select("doc_id", F.col("n_tokens"), listed.alias("s")).select("doc_id", "n_tokens", "s.*")
    return counted, each.withColumn("full", F.floor(F.col("n_tokens") / F.col("capacity"))).withColumn("rest", F.col("n_tokens") - F.col("full") * F.col("capacity"))


def pack(documents: DataFrame, specs: list[tuple[str, int]], vocabulary: str = VOCABULARY, buckets: int = BUCKETS, across: bool = True) -> DataFrame:
    """Rows of PIECE: every text in containers of every spec (name, capacity in tokens).

    Containers ``t<doc_id>-<piece>`` hold one full piece of a text over the capacity, ``c<n>`` whole texts and rests.
    Null and empty texts have no tokens and share one container. Null doc_ids are placed like others; several rows of one
    doc_id are several texts. No specs or no documents: no rows. Capacities must be positive.
    """
    spark = documents.sparkSession
    if any(c is None or c <= 0 for _, c in specs):
        raise ValueError("a capacity must be a positive number of tokens")
    if not specs:
        return spark.createDataFrame([], PIECE)
    _, each = items(documents, specs, vocabulary)
    whole = each.where("full > 0").select("spec_name", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    whole = whole.select("spec_name", F.format_string("t%s-%d", F.col("doc_id").cast("string"), F.col("piece")).alias("container"), "doc_id", "piece", F.lit(0).cast("long").alias("position"), (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))
    rests = each.where("rest > 0 or n_tokens = 0")
    capacity = dict(specs)
    plans = {}
    for spec, counts in histogram(rests).items():
        slots, _ = best_plan(counts, capacity[spec], buckets) if across else plan(counts, capacity[spec], optimal_buckets(counts, buckets), False)
        by: dict[int, list[Slot]] = {}
        for s in slots:
            by.setdefault(s.length, []).append(s)
        plans[spec] = {n: tuple(np.array([getattr(s, f) for s in ss], np.int64) for f in ("first", "container", "each", "position")) for n, ss in by.items()}
    ranked = running(rests.select("spec_name", "doc_id", "rest", F.col("full").alias("piece"), (F.col("full") * F.col("capacity")).alias("start_token")), ["spec_name", "rest"], ["doc_id"], F.lit(1), "rank")
    placed = ranked.select("spec_name", "doc_id", "piece", "start_token", "rest", F.col("rank").cast("long").alias("rank")).mapInArrow(_placer(plans), PIECE)
    return whole.unionByName(placed)


def fill(pieces: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """(spec_name, container, n_pieces, n_tokens, fill) of each container."""
    named = F.element_at(F.create_map(*[F.lit(x) for s in specs for x in s]), F.col("spec_name"))
    by = pieces.groupBy("spec_name", "container").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    return by.withColumn("fill", F.col("n_tokens") / named)


def bucket_report(documents: DataFrame, specs: list[tuple[str, int]], vocabulary: str = VOCABULARY, buckets: int = BUCKETS) -> DataFrame:
    """(spec_name, longest, items, tokens, padding) of each length bucket: what padding to its longest item costs."""
    _, each = items(documents, specs, vocabulary)
    rows = []
    for spec, counts in histogram(each.where("rest > 0 or n_tokens = 0")).items():
        low = -1
        for high in optimal_buckets(counts, buckets):
            mine = {x: n for x, n in counts.items() if low < x <= high}
            tokens = sum(x * n for x, n in mine.items())
            rows.append((spec, high, sum(mine.values()), tokens, high * sum(mine.values()) - tokens))
            low = high
    return documents.sparkSession.createDataFrame(rows, "spec_name string, longest long, items long, tokens long, padding long")
