"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), t)


def shingles(text, k=5):
    w = WORD.findall(lower(text or ""))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def jaccard_components(rows):
    """doc_id -> (size of its set, smallest id reachable)."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for d in sorted(sets):
        both = Counter(e for s in sets[d] for e in lists.get(s, ()))
        for s in sets[d]:
            lists.setdefault(s, []).append(d)
        for e, n in both.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    runs = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    times, hit = Counter(runs), set()
    for i, r in enumerate(runs):
        if times[r] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return (n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit),
            n < 20 or 100 * len(hit) > 30 * n)


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in out)
    n = Counter(x[2] for x in out)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest(), joined


def dedup_lines(rows, min_words=50):
    """doc_id -> set of deleted line numbers: lines with words that lie in a run of at least ``min_words`` words
    (or the whole text) repeating an earlier stretch, grown over equal lines."""
    texts = {d: [(i, tuple(WORD.findall(x))) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)] for d, t in sorted(rows)}
    windows, gone = {}, {}
    first = {}
    for d, lines in texts.items():
        own = []
        for i in range(len(lines)):
            n, j = 0, i
            while j < len(lines) and n < min_words:
                n += len(lines[j][1])
                j += 1
            if n >= min_words:
                own.append((i, j))
        if not own and lines:
            own = [(0, len(lines))]
        windows[d] = own
        for i, j in own:
            first.setdefault(tuple(x[1] for x in lines[i:j]), (d, i))
    for d, own in windows.items():
        a, hit = texts[d], set()
        for i, j in own:
            e, k = first[tuple(x[1] for x in a[i:j])]
            if (e, k) == (d, i):
                continue
            b, lo, hi = texts[e], i, j
            while lo and k - (i - lo) > 0 and a[lo - 1][1] == b[k - (i - lo) - 1][1]:
                lo -= 1
            while hi < len(a) and k + hi - i < len(b) and a[hi][1] == b[k + hi - i][1]:
                hi += 1
            hit.update(a[x][0] for x in range(lo, hi))
        gone[d] = hit
    return gone


def dedup_passages(rows, min_words=50):
    """doc_id -> words left: without the lines that ``dedup_lines`` deletes, and without windows of ``min_words`` words that start in a
    document with a smaller id too, or before in the same text without overlap."""
    rows = sorted(rows)
    lines = dedup_lines(rows, min_words)
    words, first, out = {d: WORD.findall(t or "") for d, t in rows}, {}, {}
    for d, w in words.items():
        for i in range(len(w) - min_words + 1):
            first.setdefault(tuple(w[i:i + min_words]), (d, i))
    for d, t in rows:
        gone, w, at = set(), words[d], 0
        for i in range(len(w) - min_words + 1):
            e, k = first[tuple(w[i:i + min_words])]
            if e < d or i >= k + min_words:
                gone.update(range(i, i + min_words))
        for i, x in enumerate((t or "").split("\n")):
            n = len(WORD.findall(x))
            if i in lines[d]:
                gone.update(range(at, at + n))
            at += n
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out
