"""Mixing sources to target weights.

Documents are aggregated by membership pattern (the set of listed sources they belong to), so the driver sees one row a
pattern. The largest total that the patterns' tokens and allowed repeats can serve is found, then a min-cost flow routes
tokens from patterns to source quotas, each further use of the same text costing more than the one before. Inside a
pattern the seeded order of documents, as a running share of its tokens, decides who serves which source how often.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.prefix import running
from palimpsest.llm.tokens import VOCABULARY, n_tokens
from palimpsest.sources.scratch import materialize


def source_key(c: Column | str) -> Column:
    """Spellings that differ in case, blanks or separators get one key; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit(""))


@dataclass
class _Arc:
    to: int
    room: float
    cost: float
    back: int


class _Flow:
    """Successive cheapest paths."""

    def __init__(self, nodes: int):
        self.arcs: list[list[_Arc]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: float, cost: float) -> _Arc:
        self.arcs[a].append(_Arc(b, room, cost, len(self.arcs[b])))
        self.arcs[b].append(_Arc(a, 0.0, -cost, len(self.arcs[a]) - 1))
        return self.arcs[a][-1]

    def run(self, s: int, t: int, tiny: float) -> float:
        total = 0.0
        while True:
            far = [float("inf")] * len(self.arcs)
            via: list = [None] * len(self.arcs)
            far[s], queue = 0.0, [s]
            while queue:
                following = []
                for a in queue:
                    for arc in self.arcs[a]:
                        if arc.room > tiny and far[a] + arc.cost < far[arc.to] - 1e-9:
                            far[arc.to], via[arc.to] = far[a] + arc.cost, (a, arc)
                            following.append(arc.to)
                queue = list(dict.fromkeys(following))
            if via[t] is None:
                return total
            room, at = float("inf"), t
            while at != s:
                a, arc = via[at]
                room, at = min(room, arc.room), a
            at = t
            while at != s:
                a, arc = via[at]
                arc.room -= room
                self.arcs[at][arc.back].room += room
                at = a
            total += room


def route(patterns: dict[tuple[str, ...], float], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[float, dict[tuple[tuple[str, ...], str], float]]:
    """(total, {(pattern, source): tokens}) of the cheapest way to give each source its share of ``total``.

    targets: source -> (share, most repeats). The n-th use of a text costs n - 1 more than its first. A pattern serves a
    source at most its most repeats times, and in all at most as often as its most generous source allows. ``total`` None:
    the largest total of which every share can be had.
    """
    names, groups = sorted(targets), sorted(patterns)
    s, t = 0, 1 + len(groups) + len(names)

    def solve(want: float):
        flow, routes = _Flow(t + 1), {}
        for i, p in enumerate(groups):
            for n in range(max(targets[x][1] for x in p)):
                flow.add(s, 1 + i, patterns[p], float(n))
            for x in p:
                routes[p, x] = flow.add(1 + i, 1 + len(groups) + names.index(x), patterns[p] * targets[x][1], 0.0)
        full = {k: arc.room for k, arc in routes.items()}
        for j, x in enumerate(names):
            flow.add(1 + len(groups) + j, t, targets[x][0] * want, 0.0)
        got = flow.run(s, t, 1e-9 * max(want, 1.0))
        return got, {k: full[k] - arc.room for k, arc in routes.items()}

    if total is None:
        most = {x: sum(patterns[p] * targets[x][1] for p in groups if x in p) for x in names}
        high = min((most[x] / targets[x][0] for x in names if targets[x][0] > 0), default=0.0)
        if all(len(p) == 1 for p in groups):
            total = high  # sources don't compete
        else:
            low = 0.0
            for _ in range(40):
                mid = (low + high) / 2
                low, high = (mid, high) if solve(mid)[0] >= mid * (1 - 1e-6) * sum(targets[x][0] for x in names) else (low, mid)
            total = low
    return total, solve(total)[1]


def memberships(documents: DataFrame, targets: DataFrame, by: str) -> DataFrame:
    """documents with ``sources``: the listed sources of all documents with the same ``by``; a null ``by`` stands alone.

    A text that was published in several places can so serve each of them.
    """
    listed = [r.key for r in targets.select(source_key("source").alias("key")).where("key is not null").distinct().collect()]
    key = source_key("source")
    mine = F.when(key.isin(*listed), key)
    # at most as many as there are targets
    groups = documents.where(F.col(by).isNotNull()).groupBy(by).agg(F.collect_set(mine).alias("_all"))
    return documents.join(groups, by, "left").withColumn("sources", F.coalesce("_all", F.array(mine))).drop("_all")


MOST_STEPS = 1_000  # texts of a source that the driver takes in one round


def _settle(drawn: DataFrame, quota: dict[str, float]) -> DataFrame:
    """drawn with one use of some documents more or less where that brings a source closer to its quota.

    The draw misses a quota by half of the text at its edge, which may be long. Each round a source takes the texts whose
    length is nearest to what is missing (or over), the least used first, as many as fit; rounds go on until no text
    brings any source closer. The driver sees these texts only. A text serves a source at most as often as the source
    allows, and in all at most as often as the most generous of its sources.
    """
    change: dict[tuple, int] = {}
    sums = {r.key: r.n for r in drawn.groupBy("key").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("n")).collect()}
    out = drawn
    while True:
        steps: list[tuple] = []
        busy: set[tuple] = set()
        miss = {k: q - sums.get(k, 0) for k, q in quota.items()}
        lack = F.element_at(F.create_map(*[F.lit(v) for k, m in miss.items() for v in (k, float(m))]), F.col("key"))
        can = F.when(lack > 0, (F.col("repeats") < F.col("most")) & (F.col("uses") < F.col("top"))).otherwise(F.col("repeats") > 0)
        near = F.abs(F.col("n_tokens") - F.abs(lack))
        rows = out.where(can & (F.col("n_tokens") < 2 * F.abs(lack))).select("key", near.alias("near"), "repeats", "pattern", "before", "n_tokens")
        best = rows.groupBy("key").agg(F.min(F.struct("near", "repeats", "pattern", "before", "n_tokens")).alias("b"))
        for key, first in sorted((r.key, r.b) for r in best.collect()):
            left = abs(miss[key])
            many = min(int(left // first.n_tokens), MOST_STEPS)
            chosen = [first] if many < 2 else rows.where(F.col("key") == key).drop("key").orderBy("near", "repeats", "pattern", "before").limit(many).collect()
            for r in chosen:
                # a text that another source took in this round waits for the next
                if r.n_tokens < 2 * left and (r.pattern, r.before) not in busy:
                    busy.add((r.pattern, r.before))
                    steps.append((key, r.pattern, r.before, 1 if miss[key] > 0 else -1, r.n_tokens))
                    left = abs(left - r.n_tokens)
        if not steps:
            return out
        for k, p, at, by, n in steps:
            change[k, p, at] = change.get((k, p, at), 0) + by
            sums[k] = sums.get(k, 0) + by * n
        moved = drawn.sparkSession.createDataFrame([(*k, v) for k, v in change.items()], "key string, pattern string, before long, by long")
        both = moved.groupBy("pattern", "before").agg(F.sum("by").alias("all"))
        # running sums tell texts of a pattern apart
        out = drawn.join(moved, ["key", "pattern", "before"], "left").join(both, ["pattern", "before"], "left")
        out = out.withColumns({"repeats": F.col("repeats") + F.coalesce("by", F.lit(0)), "uses": F.col("uses") + F.coalesce("all", F.lit(0))}).drop("by", "all")


def mix(documents: DataFrame, targets: DataFrame, sources: Column | None = None, seed: int = 1, total: float | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, repeats, n_tokens), (source, target_share, actual_share, tokens, documents, repeats)).

    targets: source, target_share, max_repeats; a row a source, few (they are read by the driver). ``sources``: array of
    the sources a document belongs to; by default its one column ``source``. Documents without a listed source, without
    tokens or not needed give no row; repeats is how often the document serves the source, never more than max_repeats.
    Null or non-positive shares and repeats take a source out. Shares are of the sum of the shares. Several target rows of
    one source: the greatest counts. A source without any tokens stays at 0 and the others
    keep their proportions; all others get their share, as nearly as whole documents allow, of the largest total possible
    (or of ``total``, if the repeats allow it).
    """
    spark = documents.sparkSession
    rows = targets.select(source_key("source").alias("key"), "source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most"))
    wanted = {r.key: r for r in sorted(rows.where("key is not null and share > 0 and most > 0").collect(), key=lambda r: (r.share, r.most))}
    out = "doc_id long, source string, repeats long, n_tokens long"
    report = "source string, target_share double, actual_share double, tokens long, documents long, max_repeats int"
    if not wanted:
        return spark.createDataFrame([], out), spark.createDataFrame([], report)
    whole = sum(r.share for r in wanted.values())
    target = {k: (r.share / whole, r.most) for k, r in wanted.items()}
    keys = F.transform(sources if sources is not None else F.array("source"), source_key)
    member = F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isin(*target))))
    # the pattern is known before any token is counted; counts are written before they are filtered, or they would be made twice
    chosen = documents.select("doc_id", member.alias("pattern"), "text").where(F.size("pattern") > 0)
    counted = materialize(chosen.select("doc_id", F.concat_ws(" ", "pattern").alias("pattern"), n_tokens("text", vocabulary).alias("n_tokens")), "members").where("n_tokens > 0")
    sizes = {tuple(r.pattern.split(" ")): float(r.n) for r in counted.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).collect()}
    served_by = {x for p in sizes for x in p}
    there = sum(target[x][0] for x in served_by)
    _, flows = route(sizes, {x: (target[x][0] / there, target[x][1]) for x in served_by}, total) if sizes else (0.0, {})
    uses, at = [], {}
    for (p, x), tokens in sorted(flows.items()):
        start = at.get(p, 0.0)
        at[p] = start + tokens / sizes[p]
        if tokens > 0:
            uses.append((" ".join(p), sizes[p], x, start, at[p]))
    # patterns x sources rows
    served = spark.createDataFrame(uses, "pattern string, size double, key string, low double, high double")
    placed = running(counted.withColumn("_o", F.xxhash64(F.lit(seed), "doc_id")), ["pattern"], ["_o", "doc_id"], F.col("n_tokens"), "before")
    middle = (F.col("before") + F.col("n_tokens") / 2) / F.col("size")
    # how many of middle, middle + 1, ... lie in [low, high)
    times = (F.ceil(F.col("high") - middle - 1e-12) - F.ceil(F.col("low") - middle - 1e-12)).cast("long")
    quota: dict[str, float] = {}
    for (_, x), tokens in flows.items():
        quota[x] = quota.get(x, 0.0) + tokens
    most = F.element_at(F.create_map(*[F.lit(v) for k, r in wanted.items() for v in (k, r.most)]), F.col("key"))
    named = F.element_at(F.create_map(*[F.lit(x) for k, r in wanted.items() for x in (k, r.source)]), F.col("key"))
    top = F.array_max(F.transform(F.split("pattern", " "), lambda k: F.element_at(F.create_map(*[F.lit(v) for x, r in wanted.items() for v in (x, r.most)]), k)))
    drawn = materialize(placed.join(served, "pattern").select("doc_id", "key", "pattern", "before", "n_tokens", times.alias("repeats"), most.alias("most"), top.alias("top")), "drawn")
    shared = [" ".join(p) for p in sizes if len(p) > 1]
    if shared:  # only these texts have uses in several sources
        uses = drawn.where(F.col("pattern").isin(shared)).groupBy("pattern", "before").agg(F.sum("repeats").alias("uses"))
        drawn = materialize(drawn.join(uses, ["pattern", "before"], "left").withColumn("uses", F.coalesce("uses", "repeats")), "used")
    else:
        drawn = drawn.withColumn("uses", F.col("repeats"))
    mixture = _settle(drawn, quota).where("repeats > 0").select("doc_id", named.alias("source"), "repeats", "n_tokens")
    got = mixture.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"))
    lines = {r.source: r for r in got.collect()}
    every = sum(r.tokens for r in lines.values())
    shares = [(r.source, target[k][0], (lines[r.source].tokens / every if r.source in lines else 0.0), (lines[r.source].tokens if r.source in lines else 0), (lines[r.source].documents if r.source in lines else 0), r.most) for k, r in wanted.items()]
    return mixture, spark.createDataFrame(shares, report)
