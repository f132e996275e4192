"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import html
import hashlib
import math
import re
from collections import defaultdict


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words(text)
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def similar(rows):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t) for d, t in rows}
    of = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            of[x].append(d)
    both = defaultdict(int)
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    first = {}
    for d, s in sets.items():
        key = frozenset(s)
        if s and key in first:
            top[d] = first[key]
        elif s:
            first[key] = d
    reps = set(first.values())
    for own in of.values():
        own = [d for d in own if d in reps]
        for i, a in enumerate(own):
            for b in own[:i]:
                both[a, b] += 1
    for (a, b), k in both.items():
        if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            a, b = find(a), find(b)
            if a != b:
                top[max(a, b)] = min(a, b)
    least = {}
    for d in sets:
        r = find(d)
        least[r] = min(least.get(r, d), d)
    return {d: (len(s), least[find(d)] if s else d) for d, s in sets.items()}


def dedup(rows, length=100):
    """rows: (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    seen, out = set(), {}
    for d, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        end = 0
        for i in range(len(data) - length + 1):
            h = data[i : i + length]
            h = hash(h) if len(rows) > 200 else h
            if h in seen:
                for j in range(max(i, end), i + length):
                    gone[j] = 1
                end = i + length
            else:
                seen.add(h)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def aligned(codes, queries, rule):
    """Matches of recordings by their codes: (query, other) -> offset, votes, frames of overlap, bit error."""
    out = {}
    for q in queries:
        for d in codes:
            if d == q:
                continue
            a, b = codes[q].tolist(), codes[d].tolist()
            seeds = [[(i, c) for i, c in enumerate(x) if c and (i == 0 or x[i - 1] != c)] for x in (a, b)]
            votes = {}
            for i, c in seeds[0]:
                for j, e in seeds[1]:
                    if c == e:
                        votes[j - i] = votes.get(j - i, 0) + 1
            if not votes:
                continue
            o = max(votes, key=lambda o: (votes[o], -abs(o), -o))
            pairs = [(a[i], b[i + o]) for i in range(len(a)) if 0 <= i + o < len(b)]
            if votes[o] < rule.MIN_VOTES or len(pairs) < rule.MIN_ALIGNED:
                continue
            error = round(sum((x ^ y).bit_count() for x, y in pairs) / (32 * len(pairs)), 6)
            if error <= rule.MAX_ERROR:
                out[q, d] = (o, votes[o], len(pairs), error)
    return out


def bench_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(docs, items, span=10):
    """docs: (doc_id, text), items: (item_id, text) -> (doc_id, n_words, n_hit, n_items, item_ids) of each document"""
    of = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        n = min(len(w), span)
        for i in range(len(w) - n + 1 if w else 0):
            of[tuple(w[i : i + n])].add(item)
    for doc, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for n in range(1, span + 1):
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in of:
                    hit |= set(range(i, i + n))
                    found |= of[g]
        names = sorted(str(i) for i in found if i is not None)
        yield doc, len(w), len(hit), len(names), tuple(names)


def fill_in_middle(doc_id, text, seed=42, rate=50, spm=80):
    """(doc_id, n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h4 % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def hard_negatives(rows, is_anchor, positives=5, negatives=3, least=50, most=95, scale=256):
    """rows: (vec_id, vector, label) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)"""
    own = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(scale * x) for x in v])
        own[i] = min(own.get(i, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(own[a][1], own[b][1]))
    for a in filter(is_anchor, own):
        ranked = sorted((-score(a, b), b) for b in own if b != a)
        kin = [(-s, b) for s, b in ranked if own[b][0] == own[a][0]][:positives]
        for top, p in kin:
            far = [(-s, b) for s, b in ranked if own[b][0] != own[a][0] and least * top <= -100 * s <= most * top][:negatives]
            yield from ((a, p, k + 1, b, top, s) for k, (s, b) in enumerate(far))


def article_text(page):
    """The text of a page's one article, its blocks one space apart: what the test pages' own template holds to be main text."""
    page = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", page)
    inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    blocks = re.split(r"</?(?:p|br|h[1-6]|ul|ol|li|div|table|tr|td|th|pre|blockquote)\b[^>]*>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return " ".join(t for t in texts if t)
