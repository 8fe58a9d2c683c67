"""Brute-force versions of the operators, for small inputs."""

import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CODE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def low(text):
    return (text or "").translate(LOWER)


def shingles(text, size):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(docs, size, percent=80):
    """doc id -> (set size, smallest reachable id); ids are unique."""
    sets = {d: shingles(t, size) for d, t in docs}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def deduped_lines(docs, min_chars=40, min_docs=5):
    """doc id -> (kept lines, dropped)."""
    key = lambda x: low(x.strip(" \t\n\x0b\f\r"))
    where = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                where.setdefault(key(x), set()).add(d)
    gone = {k: max(v) for k, v in where.items() if len(v) >= min_docs}
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), d) == d]
        out[d] = (kept, len(lines) - len(kept))
    return out


def leaks(docs, items, size=10):
    """doc id -> (words, hit words, item ids as strings)."""
    wins = [(str(i), tuple(w[k : k + size])) for i, t in items if (w := CODE.findall(low(t))) for k in range(max(1, len(w) - size + 1))]
    out = {}
    for d, t in docs:
        w, hit, found = CODE.findall(low(t)), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found.add(i)
        out[d] = (len(w), len(hit), sorted(found))
    return out


def repeat_words(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)})


def poisson_copies(doc, rate, seed=17):
    u = int(hashlib.md5(f"{seed}:{doc}".encode()).hexdigest()[:13], 16) / 2**52
    term = total = math.exp(-rate)
    n = 0
    while u >= total and n < 81:
        n += 1
        term = term * rate / n
        total += term
    return n
