"""Plain Python versions of the operators, for small tables."""

import math
import re
from collections import defaultdict

import numpy as np

from momentlake.llm import toxicity
from momentlake.llm._words import U, prefix_sums, span_hash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def near_components(rows, size):
    """Sets by doc_id, and the least doc_id that each reaches over links of sets; all sets of a doc_id are one document's."""
    sets, parent = defaultdict(set), {}
    for i, t in rows:
        w = split(t)
        if i is not None:
            sets[i].add(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
            parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b] if x & y):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def plain_windows(text, n):
    """Template windows of a text of ASCII words, read by hand: plain words, numbers and their slots."""
    tokens = re.findall(r"[A-Za-z0-9]+", text.lower())
    template = ["<n>" if t[0].isdigit() else t for t in tokens]
    return [(tuple(template[i : i + n]), [t for t in tokens[i : i + n] if t[0].isdigit()], tuple(tokens[i : i + n])) for i in range(len(tokens) - n + 1)]


def toxicity_score(model, text):
    terms = set()
    for w in re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower()):
        terms |= {w, *((n, w[:n]) for n in toxicity.PREFIXES if len(w) >= n)}
    f = set()
    for t in terms:
        word = t if isinstance(t, bytes) else t[1]
        h = span_hash(prefix_sums(np.frombuffer(word, np.uint8)), np.array([0]), np.array([len(word)]))
        h = h if isinstance(t, bytes) else h * U(2 * t[0] + 1)
        f.add(int(model.place[int(h[0] >> U(64 - toxicity.BITS))]))
    f = sorted(f - {-1})
    logit = model.w0 + sum(model.w[i] for i in f) + sum(model.v[i] @ model.v[j] for a, i in enumerate(f) for j in f[a + 1 :])
    return 1 / (1 + math.exp(-logit))


def lines_left(rows):
    """Texts of (doc_id, text) without the lines of three-line windows that an earlier document or place has; rows with one doc_id must be equal."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n") if text is not None else []
        gone, own = set(), []
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[i] = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def leaks(text, items):
    """Whether a text of ASCII words and numbers, without capitals inside sentences, holds a window of 13 tokens of an item, or a whole shorter one."""
    for item in items:
        n = min(13, len(re.findall("[A-Za-z0-9]+", item)))
        for one, slots, exact in plain_windows(item, n):
            for two, own, words in plain_windows(text or "", n):
                pairs = set(zip(slots, own))
                same = one == two and 2 * sum(x != "<n>" for x in one) >= n and len(pairs) == len(set(slots)) == len(set(own))
                if same or exact == words:
                    return True
    return False


def hmm_log10(model, classes):
    """log10 likelihood of one sequence of emission classes, without scaling tricks beyond a running sum of logs."""
    p, total = model.start * model.emit[classes[0]], 0.0
    for c in classes[1:]:
        total += math.log10(p.sum())
        p = (p / p.sum()) @ model.move * model.emit[c]
    return total + math.log10(p.sum())

