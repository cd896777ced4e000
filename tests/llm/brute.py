"""Plain loops that the operators are held against. Documents are (doc_id, h, text) in order; equal ones come once."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(docs, length=20):
    """n_words, n_removed, sha-256 of what is kept."""
    seen, out = set(), {}
    for i, h, text in docs:
        words, gone = SPACED.findall(text), set()
        for k in range(len(words) - length + 1):
            window = tuple(words[k : k + length])
            if window in seen:
                gone.update(range(k, k + length))
            seen.add(window)
        out[i, h] = (len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def groups(docs, n, percent=80):
    """n_shingles, component."""
    sets, inverted = {}, defaultdict(list)
    for i, h, text in docs:
        words = SPACED.findall(lower(text))
        sets[i, h] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
        for s in sets[i, h]:
            inverted[s].append((i, h))
    order = {key: k for k, key in enumerate(sets)}
    up = {key: key for key in sets}

    def root(key):
        while up[key] != key:
            key = up[key]
        return key

    for a in sets:
        common = Counter(b for s in sets[a] for b in inverted[s] if order[b] > order[a])
        for b, both in common.items():
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)), key=order.get)
                up[y] = x
    return {key: (len(sets[key]), root(key)[0]) for key in sets}


def phrases(docs, items, n=10):
    """n_words, n_hit, items."""
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall(lower(text or ""))
        for k in range(max(1, len(words) - n + 1) if words and item is not None else 0):
            windows[tuple(words[k : k + n])].add(str(item))
    sizes, out = sorted({len(w) for w in windows}), {}
    for i, h, text in docs:
        words, hit, names = ALNUM.findall(lower(text)), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                found = windows.get(tuple(words[k : k + size]))
                if found:
                    names |= found
                    hit.update(range(k, k + size))
        out[i, h] = (len(words), len(hit), sorted(names))
    return out


def rules(docs):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    out = {}
    for i, h, text in docs:
        words = SPACED.findall(text)
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        count, again = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)), set()
        for k in range(len(words) - 4):
            if count[tuple(words[k : k + 5])] > 1:
                again.update(range(k, k + 5))
        out[i, h] = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
    return out
