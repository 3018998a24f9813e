"""Edit scripts between two nested schemas.

A schema is an unordered tree of named, typed nodes, given by its dotted paths. The script comes from the tree edit
distance that keeps subtrees together (a node's descendants map into its partner's descendants, separate subtrees into
separate ones), which, other than the unrestricted one, can be found exactly by dynamic programming over pairs of nodes
with a minimum-cost assignment of their children. Steps are add (1), delete (1), retype (1/2) and rename; a renamed
object carries its members along. What is deleted in one place and added in another and holds the same values is moved:
a second minimum-cost assignment over what the distance left.

A field that exists on both sides stays itself. Two others may be mapped to each other if the data show that they hold
the same values, if both are objects, or if they have the same name below mapped objects; the more their values differ,
the more that costs.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Step:
    kind: str  # added, removed, renamed, moved, retyped
    old: str
    new: str
    cost: float
    to: str = ""  # the new type, where it changes


@dataclass
class Node:
    path: str
    name: str
    kind: str
    children: list[Node] = field(default_factory=list)

    size: int = 1
    depth: int = 1


def tree(paths: dict[str, str]) -> Node:
    """The schema's tree. A node's parent is the longest other path that it continues, as names may hold dots."""
    nodes = {"": Node("", "", "object")}
    for p in sorted(paths, key=len):
        up = p
        while up:
            up = up.rpartition(".")[0]
            if up in nodes:
                break
        nodes[p] = Node(p, p[len(up) + 1 :] if up else p, paths[p])
        nodes[up].children.append(nodes[p])
    for n in sorted(nodes.values(), key=lambda n: -len(n.path)):
        n.size += sum(c.size for c in n.children)
        n.depth += max((c.depth for c in n.children), default=0)
    return nodes[""]


def assign(cost: list[list[float]]) -> list[int]:
    """Column of each row in a minimum-cost assignment of a matrix with no more rows than columns."""
    n, m = len(cost), len(cost[0]) if cost else 0
    inf = float("inf")
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used = [inf] * (m + 1), [False] * (m + 1)
        while True:
            used[j] = True
            delta, following = inf, 0
            for k in range(1, m + 1):
                if not used[k]:
                    c = cost[row_of[j] - 1][k - 1] - u[row_of[j]] - v[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < delta:
                        delta, following = least[k], k
            for k in range(m + 1):
                if used[k]:
                    u[row_of[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = following
            if row_of[j] == 0:
                break
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    out = [-1] * n
    for k in range(1, m + 1):
        if row_of[k]:
            out[row_of[k] - 1] = k - 1
    return out


_NEVER = 1e6
DEEPEST, MOST_PAIRS = 100, 200_000  # levels and pairs of nodes for which the distance is computed; beyond, values alone pair fields


class _Distance:
    """Distances between subtrees and between the forests below them, each pair once."""

    def __init__(self, alike: dict[tuple[str, str], float]):
        self.alike = alike
        self.trees: dict[tuple[str, str, bool], tuple[float, tuple]] = {}
        self.forests: dict[tuple[str, str, bool], tuple[float, tuple]] = {}

    def pair(self, a: Node, b: Node, inside: bool) -> float:
        """What mapping a to b costs, without their children."""
        if (share := self.alike.get((a.path, b.path))) is not None:
            base = 1 - share / 2
        elif a.kind == b.kind == "object" and (a.children or b.children):
            base = 1.25
        elif inside and a.name == b.name:
            base = 1.25
        else:
            return _NEVER
        return base if a.name != b.name else base / 2

    def tree(self, a: Node, b: Node, inside: bool) -> float:
        """``inside``: their parents are mapped to each other."""
        key = a.path, b.path, inside
        if key not in self.trees:
            best = self.forest(a, b, True) + self.pair(a, b, inside), ("map",)
            # all of a goes below one child of b, the rest of b is new; or the other way round
            for c in b.children:
                best = min(best, (b.size - c.size + self.tree(a, c, False), ("under", c)), key=lambda x: x[0])
            for c in a.children:
                best = min(best, (a.size - c.size + self.tree(c, b, False), ("over", c)), key=lambda x: x[0])
            self.trees[key] = best
        return self.trees[key][0]

    def forest(self, a: Node, b: Node, inside: bool) -> float:
        """What is below a to what is below b. ``inside``: a is mapped to b."""
        key = a.path, b.path, inside
        if key not in self.forests:
            cost, pairs = self.children(a.children, b.children, inside)
            best = cost, ("match", pairs)
            for c in b.children:
                if c.children and a.children:
                    best = min(best, (b.size - c.size + self.forest(a, c, False), ("under", c)), key=lambda x: x[0])
            for c in a.children:
                if c.children and b.children:
                    best = min(best, (a.size - c.size + self.forest(c, b, False), ("over", c)), key=lambda x: x[0])
            self.forests[key] = best
        return self.forests[key][0]

    def children(self, a: list[Node], b: list[Node], inside: bool) -> tuple[float, list[tuple[Node, Node]]]:
        """The cheapest assignment of subtrees to each other; the others are deleted or added whole."""
        total = float(sum(x.size for x in a) + sum(x.size for x in b))
        costs = [[self.tree(x, y, inside) - x.size - y.size for y in b] for x in a]
        rows = [i for i, line in enumerate(costs) if any(c < 0 for c in line)]
        columns = sorted({j for i in rows for j, c in enumerate(costs[i]) if c < 0})
        # a row's own column at the end: its subtree is deleted
        found = assign([[min(costs[i][j], 0.5) for j in columns] + [0.0] * len(rows) for i in rows])
        pairs = [(a[i], b[columns[k]]) for i, k in zip(rows, found) if k < len(columns) and costs[i][columns[k]] < 0]
        return total + sum(self.trees[x.path, y.path, inside][0] - x.size - y.size for x, y in pairs), pairs

    def mapped(self, pairs: list[tuple[Node, Node]]) -> list[tuple[Node, Node]]:
        """The pairs of nodes that the cheapest mapping of these subtrees, whose parents aren't mapped, holds."""
        out = []
        todo = [("tree", *p, False) for p in pairs]
        while todo:
            what, a, b, inside = todo.pop()
            how = (self.trees if what == "tree" else self.forests)[a.path, b.path, inside][1]
            if how[0] == "map":
                out.append((a, b))
                todo.append(("forest", a, b, True))
            elif how[0] == "match":
                todo += [("tree", *p, inside) for p in how[1]]
            else:
                todo.append((what, a, how[1], False) if how[0] == "under" else (what, how[1], b, False))
        return out


def _gone(a: Node, b: Node) -> list[tuple[list[Node], list[Node]]]:
    """Below each node that both trees have: the subtrees only the first has, and those only the second has."""
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        other = {c.name: c for c in y.children}
        todo += [(c, other[c.name]) for c in x.children if c.name in other]
        mine = {c.name for c in x.children}
        out.append(([c for c in x.children if c.name not in other], [c for c in y.children if c.name not in mine]))
    return out


def edit_script(old: dict[str, str], new: dict[str, str], alike: dict[tuple[str, str], float]) -> list[Step]:
    """The cheapest script from ``old`` to ``new`` (path -> type, '' unknown).

    ``alike``: share of equal values of (deleted path, added path), above 1/2. Members of a renamed or moved object that
    keep their name below it have no step of their own. Ties go to the paths first in order.
    """
    found = _Distance(alike)
    mapped: dict[str, str] = {}
    for gone, fresh in _gone(tree(old), tree(new)):
        gone, fresh = sorted(gone, key=lambda n: n.path), sorted(fresh, key=lambda n: n.path)
        if gone and fresh and max(n.depth for n in gone + fresh) <= DEEPEST and sum(n.size for n in gone) * sum(n.size for n in fresh) <= MOST_PAIRS:
            mapped |= {a.path: b.path for a, b in found.mapped(found.children(gone, fresh, False)[1])}
    # a pair whose values differ gives way to one whose values are equal
    weak = {a for a, b in mapped.items() if (a, b) not in alike}
    taken = {b for a, b in mapped.items() if a not in weak}
    rows = sorted({a for a, b in alike if a in old and (a not in mapped or a in weak) and b in new and b not in taken})
    columns = sorted({b for a, b in alike if a in rows and b in new and b not in taken})
    moves: dict[str, str] = {}
    if rows:
        # one further column for each row: it finds no partner
        cost = [[1 - alike[a, b] / 2 if (a, b) in alike else 9.0 for b in columns] + [2.0 if i == k else 9.0 for k in range(len(rows))] for i, a in enumerate(rows)]
        moves = {rows[i]: columns[j] for i, j in enumerate(assign(cost)) if j < len(columns) and (rows[i], columns[j]) in alike}
        lost = set(moves.values())
        mapped = {a: b for a, b in mapped.items() if a not in moves and b not in lost}
    partner = mapped | moves
    steps = []
    for a in sorted(set(old) - set(new)):
        if a not in partner:
            steps.append(Step("removed", a, "", 1.0))
            continue
        b = partner[a]
        (up, _, name), (over, _, label) = a.rpartition("."), b.rpartition(".")
        to = new[b] if old[a] and new[b] and old[a] != new[b] else ""
        if partner.get(up) == over and name == label and not to:
            continue  # carried by its object
        steps.append(Step("renamed" if partner.get(up, up) == over else "moved", a, b, 1 - alike.get((a, b), 0.0) / 2, to))
    steps += [Step("added", "", b, 1.0) for b in sorted(set(new) - set(old) - set(partner.values()))]
    return steps + [Step("retyped", p, p, 0.5, new[p]) for p in sorted(old.keys() & new.keys()) if old[p] and new[p] and old[p] != new[p]]


def renames(script: list[Step]) -> dict[str, str]:
    return {s.old: s.new for s in script if s.kind in ("renamed", "moved")}


def new_path(path: str, moved: dict[str, str]) -> str:
    """Where a path lies after the renames: its own, or that of the object it is carried with."""
    up = path
    while up:
        if up in moved:
            return moved[up] + path[len(up) :]
        up = up.rpartition(".")[0]
    return path


def distance(steps: list[Step]) -> float:
    return sum(s.cost for s in steps)
