"""Plain Python versions of the text operators' rules, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def license_rows(rows):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    out = []
    for doc, text in rows:
        words = ALNUM.findall((text or "").translate(LOWER))
        starts, labels = [], set()
        for phrase, label in phrases.items():
            phrase = phrase.split()
            for i in range(len(words) - len(phrase) + 1):
                if words[i : i + len(phrase)] == phrase:
                    starts.append(i)
                    labels.add(label)
        out.append((doc, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    return out


def repeats(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, c in zip(data, covered, strict=True) if not c)
        runs = sum(1 for i in range(len(covered)) if covered[i] and (i == 0 or not covered[i - 1]))
        out[doc] = len(data), sum(covered), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")
    return out


def shingles(text, k=5):
    words = SPACED.findall((text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def jaccard(rows, percent=80):
    sets = {doc: shingles(text) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for doc, grams in sets.items():
        shared = defaultdict(int)
        for g in grams:
            for other in having[g]:
                shared[other] += 1
            having[g].append(doc)
        for other, both in shared.items():
            if 100 * both >= percent * (len(grams) + len(sets[other]) - both):
                a, b = find(doc), find(other)
                parent[max(a, b)] = min(a, b)
    return {doc: (len(sets[doc]), find(doc)) for doc in sets}


def item_windows(rows, items, similar=0.8):
    """(doc, item): greatest similarity of a window of the item's size or a whole shorter text, where at least ``similar``."""
    grams_of = {}
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        k = min(5, len(words))
        grams_of[item] = len(words), k, [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if k else []
    holders = defaultdict(set)
    for item, (_, _, grams) in grams_of.items():
        for g in grams:
            holders[g].add(item)
    weight = defaultdict(lambda: 1.0, {g: 1 / len(i) for g, i in holders.items()})
    out = {}
    for doc, text in rows:
        words = ALNUM.findall((text or "").translate(LOWER))
        for item, (n, k, grams) in grams_of.items():
            if not k:
                continue
            size = min(n, len(words))
            for i in range(len(words) - size + 1):
                window = [tuple(words[j : j + k]) for j in range(i, i + size - k + 1)]
                for of in (weight, defaultdict(lambda: 1.0)):
                    low = high = 0.0
                    for g in set(window) | set(grams):
                        a, b = window.count(g) * of[g], grams.count(g) * of[g]
                        low, high = low + min(a, b), high + max(a, b)
                    if low / high >= similar:
                        out[doc, item] = max(out.get((doc, item), 0), low / high)
    return out
