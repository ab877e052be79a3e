"""Plain versions of the operators' contracts, one text or one table at a time."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import xxhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def letters(text):
    return LETTERS.findall((text or "").translate(ASCII_LOWER))


def words(text):
    return WORDS.findall(text or "")


def covered(n, starts, size):
    marks = [False] * n
    for s in starts:
        marks[s : s + size] = [True] * size
    return marks


def contamination(docs, items, size=13):
    """(doc_id, text) and (item_id, text) pairs to rows of op1."""
    phrases = defaultdict(set)
    for item, text in items:
        w = letters(text)
        for a in range(max(1, len(w) - size + 1) if w else 0):
            phrases[tuple(w[a : a + size])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = letters(text), set(), set()
        for n in {len(p) for p in phrases}:
            for a in range(len(w) - n + 1):
                if (p := tuple(w[a : a + n])) in phrases:
                    hit.update(range(a, a + n))
                    found |= phrases[p]
        bad = len(hit) > 0 and 20 * len(hit) >= len(w)
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bad))
    return out


def rule_counts(text):
    text = text or ""
    w = words(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    repeated = sum(covered(len(w), [i for i, x in enumerate(windows) if count[x] > 1], 8))
    failed = len(w) < 20 or 100 * repeated > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, repeated, failed


def kept_words(docs, size=13):
    """(doc_id, text) pairs to rows of op5."""
    low = {}
    key = lambda d: (d is None, d)
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            low[k] = min(low.get(k, doc), doc, key=key)
    out = []
    for doc, text in docs:
        w = words(text)
        starts = [i for i in range(len(w) - size + 1) if key(low[tuple(w[i : i + size])]) < key(doc)]
        gone = covered(len(w), starts, size)
        out.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(found)]


def phrase_places(text, phrases):
    w = letters(text)
    at = [(i, label) for phrase, label in phrases for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    labels = ",".join(sorted({label for _, label in at}))
    return len(w), len(at), min(starts, default=None), max(starts, default=None), labels


def fingerprint(text):
    w = words((text or "").translate(ASCII_LOWER))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=2):
    """Smallest reachable position of each fingerprint, over all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and root(i) != root(j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def _hash(parts):
    return sha("".join(parts))


def _lower(text):
    return None if text is None else text.translate(ASCII_LOWER)


def merkle_leaf(row):
    values = [None if v is None else str(v) for v in row]
    return _hash("-" if v is None else f"{len(v.encode())}:{v}" for v in values)


def _climb(digests):
    """(root, path of (left, right) of every digest)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place // 16 * 16 : place // 16 * 16 + 16]
            paths[i].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
        level = [_hash(level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [place // 16 for place in at]
    return level[0], paths


def merkle(rows):
    """(doc_id, source, lang, n_chars, text) rows to rows of op11."""
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((first(row[0]), merkle_leaf(row), row))
    sources = sorted(groups, key=first)
    found = []
    for source in sources:
        members = sorted(groups[source], key=lambda m: m[:2])
        found.append((members, *_climb([leaf for _, leaf, _ in members])))
    if not found:
        return []
    root, tops = _climb([subroot for _, subroot, _ in found])
    out = []
    for (members, subroot, paths), top in zip(found, tops, strict=True):
        for (_, leaf, row), path in zip(members, paths, strict=True):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            now = merkle_leaf((*row[:4], _lower(row[4]))) if changed else leaf
            for left, right in path + top:
                now = _hash([left, now, right])
            proof = _hash(left + right for left, right in path + top)
            out.append((row[0], leaf, subroot, root, proof, now, now == root))
    return out


def filter_audit(docs, labels):
    """(doc_id, text, lang) and (doc_id, quality, toxic) rows to rows of op12."""
    ids = defaultdict(set)
    for doc, text, _ in docs:
        if doc is not None:
            ids[text or ""].add(doc)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for doc, text, lang in docs:
        text = text or ""
        w, failed = words(text), set()
        if len(w) < 200:
            failed.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            failed.add("C")
        if re.search(r"[#$%&*|]", text):
            failed.add("D")
        if doc is not None and any(other < doc for other in ids[text]):
            failed.add("E")
        parts[lang or ""].append((failed, doc in good, doc in toxic))
    out = []
    for part, rows in parts.items():
        steps, total = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = [r for r in rows if f in r[0]]
                alone = sum(r[0] == {f} for r in rows)
                steps.append((f, (order, step, len(left), len(gone), len(failing) - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone))))
                total[f] += len(gone)
        out += [(part, *row, total[f]) for f, row in steps]
    return out


def kept_lines(docs, min_chars=20, min_documents=3):
    """(doc_id, text) rows to rows of op13."""

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)

    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        gone = [
            len(key(x)) >= min_chars and len(holders[key(x)]) >= min_documents and doc != max(d for d in holders[key(x)] if d is not None) for x in lines
        ]
        out.append((doc, len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone, strict=True) if not g))))
    return out
