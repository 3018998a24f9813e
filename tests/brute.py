"""Plain single-process readings of the problem statements, for comparison with the Spark operators."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from decimal import Decimal


class Num(Decimal):
    pass


def _reject(x):
    raise ValueError(x)


def parse(text):
    return json.loads(text, parse_float=Decimal, parse_int=Decimal, parse_constant=_reject)


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, Decimal) and isinstance(b, Decimal):
        return a == b
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def value(text):
    """The parsed value, or None for no data."""
    if text is None or not text.strip():
        return None
    try:
        return parse(text)
    except ValueError:
        return None


def current(rows):
    best = {}
    for r in rows:
        if r["id"] not in best or r["created_at"] > best[r["id"]]["created_at"]:
            best[r["id"]] = r
    return best


def norm_hash(h):
    return (h or "").strip().lower() or None


def p1(left, right):
    a, b = current(left), current(right)
    out = [(i, "only_primary") for i in a if i not in b] + [(i, "only_olap") for i in b if i not in a]

    def walk(i, path, x, y):
        for k in x.keys() | y.keys():
            p = f"{path}.{k}"
            if k in x and k in y:
                if isinstance(x[k], dict) and isinstance(y[k], dict):
                    walk(i, p, x[k], y[k])
                elif not same(x[k], y[k]):
                    out.append((i, p))
            else:
                out.append((i, p))

    for i in a.keys() & b.keys():
        if norm_hash(a[i]["hash"]) != norm_hash(b[i]["hash"]):
            out.append((i, "hash"))
        x, y = value(a[i]["data"]), value(b[i]["data"])
        walk(i, "data", {} if x is None else x, {} if y is None else y)
    return sorted(out)


CLOSED = {"Tags", "Settings", "Nested", "Items"}


def fields(v, path=""):
    out = {}
    for k, x in v.items():
        p = f"{path}.{k}" if path else k
        out[p] = x
        if isinstance(x, dict) and k not in CLOSED:
            out |= fields(x, p)
    return out


def kind(v):
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, Decimal) else {str: "string", list: "array", dict: "object"}[type(v)]


def p2(rows):
    by = defaultdict(list)
    chains = defaultdict(list)
    for r in current(rows).values():
        v = value(r["data"])
        if v is None:
            continue
        f = fields(v) if isinstance(v, dict) else {}
        by[r["entity_type"], r["schema_version"]].append(f)
        chains[r["entity_type"], r["entity_id"]].append((r["version"], r["created_at"], r["id"], r["schema_version"], f))
    schema = {}
    for key, fs in by.items():
        seen, kinds = Counter(), defaultdict(Counter)
        for f in fs:
            for p, v in f.items():
                seen[p] += 1
                if v is not None:
                    kinds[p][kind(v)] += 1
        schema[key] = {p: max(sorted(kinds[p]), key=kinds[p].get, default="") for p, n in seen.items() if 4 * n >= len(fs)}
    steps = defaultdict(list)
    for (t, _), c in chains.items():
        last = {}
        for x in sorted(c, key=lambda x: x[:3]):
            last[x[0]] = x
        c = [last[v] for v in sorted(last)]
        for a, b in zip(c, c[1:]):
            if a[3] != b[3]:
                steps[t, a[3], b[3]].append((a[4], b[4]))
    out = []
    for t in {k[0] for k in schema}:
        vs = sorted(v for k, v in schema if k == t)
        for lo, hi in zip(vs, vs[1:]):
            a, b = schema[t, lo], schema[t, hi]
            gone, new = set(a) - set(b), set(b) - set(a)
            pairs = []
            for g in gone:
                for n in new:
                    both = [(x[g], y[n]) for x, y in steps[t, lo, hi] if x.get(g) is not None and y.get(n) is not None]
                    eq = sum(same(*z) for z in both)
                    if both and 2 * eq > len(both):
                        pairs.append((eq / len(both), g, n))
            for _, g, n in sorted(pairs, reverse=True):
                if g in gone and n in new:
                    out.append((t, hi, "renamed", g, n))
                    gone.discard(g), new.discard(n)
            out += [(t, hi, "removed", g, "") for g in gone] + [(t, hi, "added", "", n) for n in new]
            out += [(t, hi, "retyped", p, p) for p in a.keys() & b.keys() if a[p] and b[p] and a[p] != b[p]]
    return sorted(out)


def p3(rows):
    out = []

    def walk(i, v, path, parent):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(i, x, f"{path}.{k}", parent)
        elif isinstance(v, list):
            for n, x in enumerate(v):
                p = f"{path}[{n}]"
                if isinstance(x, dict):
                    out.append((i, p, parent))
                    walk(i, x, p, p)
                else:
                    walk(i, x, p, parent)

    for i, r in current(rows).items():
        v = value(r["data"])
        if isinstance(v, dict) and "Items" in v:
            x = v["Items"]
            if isinstance(x, str):
                try:
                    x = parse(x)
                except ValueError:
                    pass
            v["Items"] = [x] if isinstance(x, dict) else x
        if v is not None:
            walk(i, v, "data", "")
        custom = (r["metadata"] or {}).get("custom") or {}
        for k, text in dict(custom).items():
            try:
                walk(i, parse(text), f"custom.{k}", "")
            except (ValueError, TypeError):
                pass
    return sorted(out)


def p4(rows):
    best = {}
    for r in rows:
        k = r["entity_type"], r["entity_id"], r["version"], r["change_seq"]
        if k not in best or (r["received_at"], r["feed_id"]) > (best[k]["received_at"], best[k]["feed_id"]):
            best[k] = r
    state = {}
    for k in sorted(best):
        r, e = best[k], k[:2]
        if r["strategy"] == 0:
            v = None if r["new_value"] is None else json.loads(r["new_value"])
            state[e] = (r["new_value"] is not None, v)
        elif e in state and state[e][0]:
            path = r["path"].split(".")
            at = state[e][1]
            if r["new_value"] is None:
                for p in path[:-1]:
                    at = at.get(p) if isinstance(at, dict) else None
                if isinstance(at, dict):
                    at.pop(path[-1], None)
            else:
                for p in path[:-1]:
                    if not isinstance(at.get(p), dict):
                        at[p] = {}
                    at = at[p]
                at[path[-1]] = json.loads(r["new_value"])
    out = []

    def leaves(e, v, path):
        if isinstance(v, dict) and v:
            for k, x in v.items():
                leaves(e, x, f"{path}.{k}" if path else k)
        else:
            out.append((*e, path, json.dumps(v, ensure_ascii=False, separators=(",", ":"))))

    for e, (alive, v) in state.items():
        if alive:
            leaves(e, v, "")
    return sorted(out)


def micros(t):
    from datetime import datetime, timezone

    return round((t - datetime(1970, 1, 1, tzinfo=timezone.utc if t.tzinfo else None)).total_seconds() * 10**6) if not hasattr(t, "value") else t.value // 1000


def p5(rows, types=("orderentity", "fixtureaddress", "flatentity")):
    by = defaultdict(dict)
    for r in current(rows).values():
        if r["entity_type"] in types:
            c = by[r["entity_type"], r["entity_id"]]
            if r["version"] not in c or (r["created_at"], r["id"]) > (c[r["version"]]["created_at"], c[r["version"]]["id"]):
                c[r["version"]] = r
    out = []
    for e, versions in by.items():
        at = {}
        for v in sorted(versions):
            at[versions[v]["created_at"]] = versions[v]
        run = None
        for t in sorted(at):
            v = value(at[t]["data"])
            if run and (v is None or not same(v, run[0])):
                out.append((*e, run[1], micros(run[2]), micros(t)))
                run = None
            if v is not None and not run:
                run = (v, at[t]["version"], t)
        if run:
            out.append((*e, run[1], micros(run[2]), -1))
    return sorted(out)


def p6(name, rows):
    cur = current(rows)
    by = defaultdict(list)
    for r in cur.values():
        by[r["entity_type"], r["entity_id"], norm_hash(r["hash"])].append(r)
    out = []
    for r in cur.values():
        ref = norm_hash(r["previous_hash"])
        if ref is None:
            continue
        found = by.get((r["entity_type"], r["entity_id"], ref), [])
        placed = [x for x in found if x["version"] == r["version"] - 1]
        reason = "missing" if not found else "misplaced" if not placed else "later" if all(x["created_at"] > r["created_at"] for x in placed) else None
        if reason:
            out.append((name, r["id"], reason, f"{r['created_at']:%Y-%m}"))
    return sorted(out)
