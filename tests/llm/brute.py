"""Plain versions of the corpus operators, on Python lists."""

import re
from collections import defaultdict

BLANKS = " \t\n\x0b\x0c\r"


def shingle_set(text, words):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not parts:
        return frozenset()
    k = min(words, len(parts))
    return frozenset(tuple(parts[i : i + k]) for i in range(len(parts) - k + 1))


def unite(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(docs, words, num, den):
    """docs: (doc_id, text) with distinct ids. doc_id: (set size, component)."""
    sets = {i: shingle_set(t, words) for i, t in docs}
    links, ids = [], sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
    root = unite(ids, links)
    return {i: (len(sets[i]), root[i]) for i in ids}


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANKS))


def dedup_lines(docs, least_chars=20, least_docs=3):
    """docs: (doc_id, text). For each row: lines, dropped, kept text."""
    held = defaultdict(set)
    for i, t in docs:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= least_chars:
                    held[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < least_docs or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out
