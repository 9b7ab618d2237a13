"""Brute-force versions that the operators are held against."""

import collections

# Every awkward row a table may hold: nulls, empty and long texts, ties, repeated rows, clashing extra columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, size string, part string, kept string"


def awkward_rows():
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    texts = [
        (1, "a b c d e f g"), (2, "A  B c\td e f G"), (3, None), (4, ""), (5, " \n"), (6, "one two"), (7, "One two"), (8, "a b c d e f g"), (9, "a b c d e f g"), (9, "a b c d e f g"),
        (10, long), (11, long + " tail"), (None, "a b c d e f g"), (None, None), (12, "ünï çödé 😀 x"), (13, "\x1c\x1d odd\x85space"), (14, "word " * 50), (-5, "a b c d e f g h"), (15, "é" * 5000),
    ]
    return [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 3}", None if n % 2 else 5, "x", "y", "z", "p", "k") for n, (i, t) in enumerate(texts)]


def shingle_sets(rows, k=5):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def components(rows, k=5, percent=75):
    """(id, set size, smallest reachable id) by comparing all pairs that share a shingle; null ids link with nothing."""
    sets = shingle_sets(rows, k)
    owners = collections.defaultdict(list)
    for n, s in enumerate(sets):
        if rows[n][0] is not None:
            for x in s:
                owners[x].append(n)
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for n, s in enumerate(sets):
        common = collections.Counter(m for x in s for m in owners[x] if m < n) if rows[n][0] is not None else {}
        for m, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[m]) - c):
                parent[max(top(n), top(m))] = min(top(n), top(m))
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[top(n)] = min(least.get(top(n), i), i)
    return sorted(((i, len(sets[n]), least[top(n)] if i is not None and sets[n] else i) for n, (i, _) in enumerate(rows)), key=repr)
