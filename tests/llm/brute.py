"""Plain-Python statements of what the operators must return, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size=5):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def classes(rows, percent=80):
    """id -> least id reachable by links of that similarity; equal texts without words are one class."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s or {()}:
            holders[x].append(i)
    shared = Counter()
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[a, b] += 1
    for (a, b), k in shared.items():
        if not sets[a] and not sets[b] or sets[a] and sets[b] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def repeated_bytes(rows, length=100):
    """id -> (bytes, removed bytes, runs, what is left) by a dictionary of all strings."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - length + 1):
            x = data[a : a + length]
            if x in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(x)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, bytes(c for c, g in zip(data, gone) if not g))
    return out


def url_templates(rows, z=1.96, smooth=2.0):
    """[(host, path, 1 blocked / 0 allowed / None)] -> (host, path) -> template, labels, purity."""

    def typed(s):
        m = re.fullmatch(r"[0-9]+(\.[A-Za-z0-9_]+)?", s)
        return f"?n{m[1] or ''}" if m else "?h" if re.fullmatch(r"[0-9a-fA-F-]{8,}", s) and re.search("[0-9]", s) else s

    urls = defaultdict(lambda: [0, 0, 0])  # urls, blocked, labelled
    for host, path, label in rows:
        for k, x in enumerate((1, label == 1, label is not None)):
            urls[host, path][k] += x
    tokens = {u: tuple(typed(s) for s in u[1].split("/") if s) for u in urls}
    children = defaultdict(lambda: defaultdict(lambda: [0, 0, 0, 0, 0]))  # and those that end, or go on with a wildcard
    for u, counts in urls.items():
        for k, t in enumerate(tokens[u]):
            if not t.startswith("?"):
                cell, rest = children[u[0], tokens[u][:k]][t], tokens[u][k + 1 :]
                for j, x in enumerate((*counts, counts[0] * (not rest), counts[0] * (bool(rest) and rest[0].startswith("?")))):
                    cell[j] += x

    def alike(a, b, c, d):
        p, s = (a + c) / (b + d), 1 / b + 1 / d
        return abs(a / b - c / d) <= z * (p * (1 - p) * s) ** 0.5 + s / 2

    into = {}
    for parent, cells in children.items():
        shapes = defaultdict(list)
        for t, (n, _, _, ends, wild) in cells.items():
            shapes["ends" if ends >= max(wild, n - ends - wild) else "typed" if wild >= n - ends - wild else "literal"].append(t)
        for shape, names in shapes.items():
            hub = cells[min(names, key=lambda t: (-cells[t][2], -cells[t][0], t))]
            same = [t for t in names if all(alike(cells[t][j], cells[t][0], hub[j], hub[0]) for j in (3, 4))]
            against = [t for t in same if cells[t][2] and hub[2] and not alike(*cells[t][1:3], *hub[1:3])]
            merged = [t for t in same if t not in against and (cells[t][2] or not against)]
            if len(merged) > 1:
                into |= {(parent, t): "?~" + shape for t in merged}
    template = {u: tuple(into.get(((u[0], ts[:k]), t), t) for k, t in enumerate(ts)) for u, ts in tokens.items()}
    sums = defaultdict(lambda: [0, 0])
    for u, ts in template.items():
        for k in range(len(ts) + 2):
            for j in (0, 1):
                sums[u[0], (*ts, "")[:k]][j] += urls[u][j + 1]
    out = {}
    for u, ts in template.items():
        q = 0.5
        for k in range(len(ts) + 1):
            (b, m), (b1, m1) = sums[u[0], (*ts, "")[:k]], sums[u[0], (*ts, "")[: k + 1]]
            q = (b - b1 + smooth * q) / (m - m1 + smooth)
        b, m = sums[u[0], (*ts, "")]
        out[u] = ("/".join((u[0], *ts)) if ts else u[0] + "/", m, (b + smooth * q) / (m + smooth))
    return out


def base_secrets(text):
    """(kind, start, end) of the base findings, by start and kind, by walking from match to match."""
    text, out = text or "", []
    kinds = (("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", r"(AKIA[A-Z0-9]+)", 1, 18), ("hex", r"([0-9a-f]+)", 1, 16))
    for k, (kind, pattern, group, least) in enumerate(kinds):
        at = 0
        while m := re.compile(pattern).search(text, at):
            at = m.end()
            if len(m[group]) >= least:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]
