"""Plain versions of the operators, by their definitions."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return sha256(text.encode()).hexdigest()


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = [x.translate(LOWER) for x in space_words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard(rows):
    """Sorted (doc_id, n_shingles, component_id)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(s), (min(least[find(i)]) if least[find(i)] else None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def exact(rows):
    """(doc_id, keep_id, group_size, kept count in group)."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(f"[{SPACE}]", "", t or "")].append((-len(t or ""), d is not None, d or 0, d))
    out = []
    for g in groups.values():
        best = min(g)
        out += [(d, best[3], len(g)) for *_, d in g]
    return out, len(groups)


def repeats(rows, window=35):
    texts = [space_words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(rows, items, span=10):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for d, t in rows:
        w, hit, found = alnum_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in ids if x is not None}
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return out


def line_key(line):
    return line.strip(SPACE).translate(LOWER)


def lines(rows, min_chars=20, min_docs=3):
    low = -(1 << 63)
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                holders[line_key(line)].add(low if d is None else d)
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        own = low if d is None else d
        kept = [x for x in every if not (len(holders.get(line_key(x), ())) >= min_docs and max(holders[line_key(x)]) != own)]
        out.append((d, len(every), len(every) - len(kept), sha("\n".join(kept))))
    return out
