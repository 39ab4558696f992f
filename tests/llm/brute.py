"""Plain versions of the text operators, for small fixtures."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=4):
    w = words((text or "").encode().lower().decode())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def near_components(docs, percent=80, n=4):
    """{id: (set size, smallest id reachable)} by comparing all pairs of sets of ``n``-word shingles."""
    sets = {k: shingles(t, n) for k, t in docs}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def removed_bytes(docs, length):
    """[(id, n_bytes, n_removed, n_spans, kept)] in the order given."""
    seen = defaultdict(int)
    data = [(k, (t or "").encode()) for k, t in docs]
    for _, b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for k, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def removed_words(docs, window):
    """[(id, n_words, n_removed, kept)]; docs in the order in which copies are earlier."""
    seen, out = set(), []
    for k, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                gone[i : i + window] = [True] * window
            seen.add(x)
        out.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def removed_lines(docs, min_words):
    """[(id, n_lines, n_removed, kept)]: line runs with ``min_words`` words that an earlier place holds too."""
    every = [(k, (t or "").split("\n")) for k, t in docs]
    seqs = [[(p, x) for p, x in enumerate(lines) if words(x)] for _, lines in every]
    starts = defaultdict(list)
    out = []
    for d, s in enumerate(seqs):
        gone = set()
        for i, (_, x) in enumerate(s):
            for e, j in starts[x]:
                n = 0
                while i + n < len(s) and j + n < len(seqs[e]) and s[i + n][1] == seqs[e][j + n][1]:
                    n += 1
                if sum(len(words(y)) for _, y in s[i : i + n]) >= min_words:
                    gone.update(p for p, _ in s[i : i + n])
            starts[x].append((d, i))
        lines = every[d][1]
        out.append((every[d][0], len(lines), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near_labels(text, notices, share):
    """Labels of the notices that some run of whole words is within the error bound of."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower().decode())
    found = set()
    for notice, label in notices:
        bound = int(len(notice) * share)
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                run = " ".join(w[i:j])
                if len(run) > len(notice) + bound:
                    break
                if len(run) >= len(notice) - bound and edit_distance(run, notice) <= bound:
                    found.add(label)
    return found
