"""Plain statements of the contracts, for small tables held in memory."""

from __future__ import annotations

import hashlib
import re

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_dedup(docs):
    """(doc_id, text) pairs with distinct ids -> {doc_id: text} less later three-line windows."""
    seen, out = set(), {}
    for key, text in sorted(docs):
        lines = (text or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            if not "".join(window).strip(" "):
                continue
            if window in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(window)
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text
    return out


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, linked):
    """For each index the smallest index of its component."""
    parent = list(range(len(values)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(text, items, span=13):
    """(n_words, n_hit, sorted item ids, contaminated) of one document; items: (id, text)."""
    doc, hit, found = words(text), set(), set()
    for key, item in items:
        own = words(item)
        size = min(len(own), span)
        for s in range(len(own) - size + 1 if own else 0):
            for p in range(len(doc) - size + 1):
                if doc[p : p + size] == own[s : s + size]:
                    hit |= set(range(p, p + size))
                    found.add(key)
    return len(doc), len(hit), sorted(found, key=str), bool(hit) and 20 * len(hit) >= len(doc)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
