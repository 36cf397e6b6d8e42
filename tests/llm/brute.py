"""Plain-Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if len(words) >= n:
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    return {tuple(words)} if words else set()


def near_components(docs, n, percent=80):
    """doc_id -> (set size, smallest reachable doc_id)."""
    sets = {i: shingles(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        common = Counter(j for g in s for j in holders.get(g, ()))
        for j, both in common.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders.setdefault(g, []).append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def cut_repeats(docs, window=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), by sets of all strings."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        covered = bytearray(len(b))
        own = [b[k : k + window] for k in range(len(b) - window + 1)]
        for k, s in enumerate(own):
            if s in seen:
                covered[k : k + window] = b"\1" * window
        seen.update(own)
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out[i] = (len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest())
    return out


def secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    out += [(m.start(), 1, m.end()) for m in ips if all(int(x) <= 255 for x in m[0].split("."))]
    cards = re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
    out += [(m.start(), 2, m.end()) for m in cards if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    phones = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
    out += [(m.start(), 3, m.end()) for m in phones if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def sha(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def alignment(text, a, b, spell_a, spell_b):
    """Ids of both sides -> (groups string, list of linked (a, b)), or None."""
    spans = []
    for ids, spell in ((a, spell_a), (b, spell_b)):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(spell[i]), i))
            at += len(spell[i])
        spans.append(out)
        if b"".join(spell[i] for i in ids) != b" " + text.encode():
            return None
    links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
    cuts, groups, begin = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}, [], 0
    for cut in sorted(cuts):
        sides = [",".join(str(i) for _, e, i in side if begin < e <= cut) for side in spans]
        groups.append("|".join(sides))
        begin = cut
    return ";".join(groups), links


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def run_features(text, runs):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def resampled(docs, target, runs, buckets, percent):
    """doc_id -> (n_features, weight, score, rank)."""

    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    corpus, wanted = Counter(), Counter()
    for counts, texts in ((corpus, [t for _, t in docs]), (wanted, target)):
        for t in texts:
            counts.update(map(bucket, run_features(t, runs)[1]))
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((corpus[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out, able = {}, []
    for i, text in docs:
        words, features = run_features(text, runs)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(features), weight, score, None]
        if len(words) >= 20:
            able.append((-score, i))
    for rank, (_, i) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(v) for i, v in out.items()}


def top_scores(rows, k, every=100):
    """(query_id, rank, vec_id, score) by exact integers."""
    whole = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in whole:
        if q is not None and q % every == 0:
            scored = [(sum(x * y for x, y in zip(v, w)), i) for i, w in whole if i != q]
            ordered = sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))
            out += [(q, n, i, s) for n, (s, i) in enumerate(ordered[:k], 1)]
    return out
