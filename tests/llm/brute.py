"""Plain formulations of the contracts, one document list at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_counts(rows):
    t = tokenizer()
    return [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in rows]


def encoded(rows):
    t = tokenizer()
    out = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return out


def substring_dedup(rows, window=20):
    earliest = {}
    for i, x in rows:
        w = words(x)
        for k in range(len(w) - window + 1):
            place = (math.inf if i is None else i, k)
            key = tuple(w[k:k + window])
            earliest[key] = min(earliest.get(key, place), place)
    out = []
    for i, x in rows:
        w = words(x)
        gone = set()
        for k in range(len(w) - window + 1):
            if earliest[tuple(w[k:k + window])] < (math.inf if i is None else i, k):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(v for k, v in enumerate(w) if k not in gone))))
    return out


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, most=2):
    """label per fingerprint: index of its component."""
    nodes = sorted(set(prints))
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if (a ^ b).bit_count() <= most and find(a) != find(b):
                label[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def simhash(rows):
    prints = [fingerprint(x) for _, x in rows]
    root = components(prints)
    least = {}
    for (i, _), f in zip(rows, prints):
        key = math.inf if i is None else i
        least[root[f]] = min(least.get(root[f], key), key)
    return [(i, f"{f:016x}", None if least[root[f]] == math.inf else least[root[f]]) for (i, _), f in zip(rows, prints)]


def repeated_positions(w, width, times=2):
    seen = Counter(tuple(w[k:k + width]) for k in range(len(w) - width + 1))
    at = [k for k in range(len(w) - width + 1) if seen[tuple(w[k:k + width])] >= times]
    return {p for k in at for p in range(k, k + width)}


def quality(text, long=16, least=5, most_covered=0.30, most_longest=200):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    repeat = len(repeated_positions(w, 3))
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    longest = 0
    while repeated_positions(w, longest + 1):
        longest += 1
        if longest > most_longest:
            break
    kept = not failed and len(repeated_positions(w, long) | repeated_positions(w, least, 3)) <= most_covered * len(w) and longest <= most_longest
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat, failed, kept)


SECRETS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
           ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]


def secrets(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(SECRETS) for m in p.finditer(text or "")
                  if m.end(g) - m.start(g) >= least)


def secret_row(i, text):
    found = secrets(text)
    return (i, *(sum(f[1] == k for f in found) for k in range(3)), sha(",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in found)))


def targets(sizes):
    """source → target for (source, size) rows."""
    total = Counter()
    for s, n in sizes:
        total[s] += n
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    stopped, open_, left = {}, set(order), sum(total.values())
    while True:
        unit = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * unit > 3 * total[s]]
        if not over:
            return total, stopped | {s: weight[s] * unit for s in open_}
        for s in over:
            stopped[s] = 3 * total[s]
            left -= stopped[s]
            open_.remove(s)


def language_model(rows):
    docs = [(i, words((x or "").translate(LOWER)) + ["\n"], zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0) for i, x in rows]
    single, pair, after, kinds = Counter(), Counter(), Counter(), Counter()
    for _, t, held in docs:
        if not held:
            single.update(t)
            pair.update(zip(["\t", *t], t))
    for (h, _), n in pair.items():
        after[h] += n
        kinds[h] += 1
    n, v = sum(single.values()), len(single)
    once, twice = (sum(c == k for c in pair.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once else 0.5

    def p1(w):
        return (single[w] + 0.1) / (n + 0.1 * (v + 1))

    def p2(h, w):
        if not after[h]:
            return p1(w)
        return (max(pair[h, w] - d, 0) + d * kinds[h] * p1(w)) / after[h]

    return [(i, held, len(t), sum(single[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t),
             sum(math.log10(p2(h, w)) for h, w in zip(["\t", *t], t))) for i, t, held in docs]
