"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import pandas as pd

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text):
    text = text or ""
    found = []
    for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text,
    ):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(found)]


def removed(docs, n=13):
    """doc -> (n_words, n_removed, digest of what is left); docs is [(id, text)]."""
    first: dict[tuple, int] = {}
    words = [(i, SPACE_WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if i is not None and first[tuple(w[p : p + n])] < i:
                gone[p : p + n] = [True] * n
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), sha(" ".join(kept))))
    return out


def contaminated(docs, items, n=10):
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = PLAIN_WORD.findall((text or "").translate(UPPER))
        if item is None or not w:
            continue
        k = min(n, len(w))
        for p in range(len(w) - k + 1):
            windows.setdefault(tuple(w[p : p + k]), set()).add(str(item))
    lengths = sorted({len(k) for k in windows})
    out = []
    for i, text in docs:
        w = PLAIN_WORD.findall((text or "").translate(UPPER))
        hit, found = [False] * len(w), set()
        for k in lengths:
            for p in range(len(w) - k + 1):
                if (got := windows.get(tuple(w[p : p + k]))) is not None:
                    hit[p : p + k] = [True] * k
                    found |= got
        out.append((i, len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)))
    return out


def shingles(text, k=5):
    w = SPACE_WORD.findall((text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1)))


def components(docs, k=5, percent=75):
    """[(id, n_shingles, component)] by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    places: dict[tuple, list[int]] = {}
    for p, (_, s) in enumerate(sets):
        for token in s:
            places.setdefault(token, []).append(p)
    shared: dict[tuple[int, int], int] = {}
    for ps in places.values():
        for x in range(len(ps)):
            for y in range(x + 1, len(ps)):
                shared[ps[x], ps[y]] = shared.get((ps[x], ps[y]), 0) + 1
    for (x, y), n in shared.items():
        if 100 * n >= percent * (len(sets[x][1]) + len(sets[y][1]) - n):
            root[find(x)] = find(y)
    least: dict[int, int] = {}
    for p, (i, _) in enumerate(sets):
        if i is not None:
            r = find(p)
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(find(p)) if s else i) for p, (i, s) in enumerate(sets)]


def documents(path):
    return pd.read_parquet(f"{path}/documents.parquet")


def fingerprint(text, k=4):
    import xxhash

    w = SPACE_WORD.findall((text or "").translate(UPPER))
    grams = [" ".join(w[p : p + k]) for p in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def fingerprint_groups(codes, radius=4):
    """[(id, component)] of [(id, fingerprint)] by comparing all pairs."""
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(codes)):
        for y in range(x):
            if (codes[x][1] ^ codes[y][1]).bit_count() <= radius:
                root[find(x)] = find(y)
    least: dict[int, int] = {}
    for p, (i, _) in enumerate(codes):
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    return [(i, least.get(find(p))) for p, (i, _) in enumerate(codes)]


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _tree(nodes, arity=3):
    """(root, ways): the siblings of every node as (before, after), level by level."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i in range(len(nodes)):
            run = at[i] - at[i] % arity
            ways[i].append((level[run : at[i]], level[at[i] + 1 : run + arity]))
            at[i] //= arity
        level = [_h(*level[p : p + arity]) for p in range(0, len(level), arity)]
    return level[0], ways


def manifest(docs):
    """Rows (doc_id, leaf, subroot, root, proof, folded, verified) of documents (doc_id, source, lang, n_chars, text)."""
    groups: dict = {}
    for row in docs:
        groups.setdefault(row[1], []).append(row)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        rows = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees.append((rows, *_tree([_leaf(r) for r in rows])))
    root, tops = _tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (rows, subroot, ways), top in zip(trees, tops):
        for row, way in zip(rows, ways):
            changed = row
            if row[0] is not None and fold(row[0], 2) == 0 and row[4] is not None:
                changed = (*row[:4], row[4].replace("\n", ""))
            digest = _leaf(changed)
            for before, after in way + top:
                digest = _h(*before, digest, *after)
            siblings = [d for before, after in way + top for d in before + after]
            out.append((row[0], _leaf(row), subroot, root, _h(*siblings), digest, digest == root))
    return out


def runs(w, least=6, periods=4):
    """[(start, length, period)] by trying every period at every place."""
    found = set()
    for q in range(1, len(w) // periods + 1):
        p = 0
        while p + q < len(w):
            if w[p] != w[p + q]:
                p += 1
                continue
            e = p
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            length = e + q - p
            if length >= max(least, periods * q) and not any(w[p : p + length - r] == w[p + r : p + length] for r in range(1, q)):
                found.add((p, length, q))
            p = e
    return sorted((s, n, q) for s, n, q in found)


def run_row(doc_id, text):
    w = SPACE_WORD.findall(text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *best, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
