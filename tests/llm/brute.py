"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np

WORD5 = re.compile(r"[^\x20\x09-\x0D]+")
WORD6 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width=5):
    words = WORD5.findall(lower(text or ""))
    if not words:
        return frozenset()
    n = min(width, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def components(docs, percent=80, width=5):
    sets = {i: shingles(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, shared = {}, Counter()
    for i, s in sorted(sets.items()):
        for g in s:
            for j in holders.setdefault(g, []):
                shared[j, i] += 1
            holders[g].append(i)
    links = Counter()
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
            links.update((a, b))
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


def decontaminate(docs, items, width=10):
    grams = {}
    for item, text in items:
        w = WORD6.findall(lower(text or ""))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            grams.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    out = {}
    for doc, text in docs:
        w = WORD6.findall(lower(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                if g in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def quality(text):
    text = text or ""
    words = WORD5.findall(text)
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD5.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), len(words) < 50 or 100 * len(cover) > 50 * len(words)


def license_places(text, phrases):
    words = WORD6.findall(lower(text or ""))
    at, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def url_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = lower(host)
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def license_labels(docs, templates, phrases, common, least, whole=False):
    """{doc: (labels, score)}: for each template, if the text has one of its rarest words (or whole), and shift, the weight of the words that stand where the template has them."""
    texts = {i: WORD6.findall(lower(t or "")) for i, t in docs}
    index = {w for _, notice, _ in templates for w in notice.split() if w not in common}
    df = Counter(w for words in texts.values() for w in index & set(words))
    idf = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 0.1 for w in index}
    out = {}
    for i, words in texts.items():
        labels, best = set(license_places(" ".join(words), phrases)[4].split(",")) - {""}, 0.0
        for label, notice, key in templates:
            if f" {key} " not in f" {' '.join(words)} ":
                continue
            own = [(w, at) for at, w in enumerate(notice.split()) if w not in common]
            total, shifts, before, rare = sum(idf[w] for w, _ in own), Counter(), 0.0, set()
            for w in sorted({w for w, _ in own}, key=lambda w: (-idf[w], w)):
                rare |= {w} if round(before, 9) <= 1 - least else set()
                before += sum(idf[w] for x, _ in own if x == w) / total
            if not whole and not rare & set(words):
                own = []
            for place, word in enumerate(words):
                for w, at in own:
                    if w == word:
                        shifts[place - at] += idf[w] / total
            top = round(max(shifts.values(), default=0.0), 9)
            best = max(best, top)
            labels |= {label} if top >= least else set()
        out[i] = (",".join(sorted(labels)), min(1.0, round(best, 6)))
    return out


def quality_kept(rows, metrics, prior):
    """{doc: kept} of (doc, lang, source, text): fences from whole sorted lists of the values' buckets."""
    def facts(text):
        n_words, chars, symbols, dup, repeat, failed = quality(text)
        text = text or ""
        lines = sum(bool(WORD5.search(x)) for x in text.split("\n"))
        upper, letters = (len(re.findall(p, text)) for p in ("[A-Z]", "[A-Za-z]"))
        counts = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": lines, "n_upper": upper, "n_letters": letters}
        value = lambda m, slack: max(counts[m.count] - slack, 0) * m.scale // max(counts[m.per], 1)
        values = {k: (value(m, 0), value(m, m.slack)) for k, m in metrics.items()}
        return failed, values

    def bucket(v):
        shift = max(v.bit_length() - 5, 0)
        return v >> shift << shift

    def shrink(own, parent):
        whole = sum(parent.values())
        return {b: own[b] * 1000 + n * 1000 * prior // whole for b, n in parent.items()}

    def quantile(counts, percent):
        seen, whole = 0, sum(counts.values())
        for b in sorted(counts):
            seen += counts[b]
            if seen * 100 >= whole * percent:
                return b

    known = {doc: (lang, source, *facts(text)) for doc, lang, source, text in rows}
    good = [(lang, source, values) for lang, source, failed, values in known.values() if not failed]
    out = {}
    for doc, (lang, source, failed, values) in known.items():
        kept = not failed
        for name, m in metrics.items():
            if failed:
                break
            count = lambda fits: Counter(bucket(v[name][0]) for a, b, v in good if fits(a, b))  # noqa: B023, E731
            top = count(lambda a, b: True)
            own = shrink(count(lambda a, b: (a, b) == (lang, source)), shrink(count(lambda a, b: a == lang), top))  # noqa: B023
            lo, hi = quantile(own, 25), quantile(own, m.upper)
            reach = max(m.spread * (hi - lo), m.tolerance)
            kept = kept and values[name][1] <= hi + reach and not (m.both_sides and values[name][0] < lo - reach)
        out[doc] = kept
    return out


def propagate(texts, shards, rounds=3):
    """{doc: shard}: label propagation row by row; a document moves to the shard of most of its copies while that shard has room."""
    docs = sorted(texts)
    where = {d: k % shards for k, d in enumerate(docs)}
    quota = [len(docs) // shards + (s < len(docs) % shards) for s in range(shards)]
    groups = {}
    for d in docs:
        if texts[d] is not None:
            groups.setdefault(texts[d], []).append(d)
    for _ in range(rounds):
        for d in docs:
            copies = groups.get(texts[d], [])
            votes = Counter(where[x] for x in copies)
            size = Counter(where.values())
            best = max(votes, key=lambda s: (votes[s], -s), default=None)
            if best is not None and votes[best] > votes[where[d]] and size[best] < quota[best] + 1:
                where[d] = best
    size = Counter(where.values())
    for d in docs:  # back to even sizes
        if size[where[d]] > quota[where[d]]:
            to = min(range(shards), key=lambda s: size[s] - quota[s])
            size[where[d]] -= 1
            size[to] += 1
            where[d] = to
    return where


def cut_edges(texts, where):
    """Pairs of equal texts in different shards."""
    groups = {}
    for d, t in texts.items():
        if t is not None:
            groups.setdefault(t, Counter())[where[d]] += 1
    return sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in groups.values())


M64 = (1 << 64) - 1


def language_grams(text, bits=13):
    """Counts of a text's hashed n-grams, character by character; None without letters."""
    def spot(x):
        x = x * 0x9E3779B97F4A7C15 & M64
        return ((x ^ x >> 29) * 0xBF58476D1CE4E5B9 & M64) >> 64 - bits

    if not any(c.isalpha() for c in text or ""):
        return None
    cps = [0] + [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text] + [0]
    out = Counter()
    for i, c in enumerate(cps):
        if c:
            out[spot(c)] += 1
        if i and (two := cps[i - 1] << 21 | c):
            out[spot(two + (1 << 62))] += 1
        if 0 < i < len(cps) - 1 and c:
            out[spot(cps[i - 1] << 42 | c << 21 | cps[i + 1])] += 1
    return out


def languages(train, texts, k=4, rounds=12):
    """[(language, score, rejected)] of texts: TF-IDF, spherical k-means over each language's distinct texts, nearest centroid."""
    found = [(lang, language_grams(t)) for lang, t in train if lang is not None and t is not None]
    df, n = Counter(), 0
    for _, g in found:
        if g:
            n += 1
            df.update(g.keys())

    def weigh(g):
        v = {i: math.log1p(c) * (math.log((1 + n) / (1 + df[i])) + 0.1) for i, c in g.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {i: x / size for i, x in v.items()}

    def dot(a, b):
        return sum(x * b.get(i, 0.0) for i, x in a.items())

    centroids = []
    for lang in sorted({x for x, _ in found}):
        own = [g for t in sorted({t for x, t in train if x == lang and t is not None}) if (g := language_grams(t))]
        if not own:
            continue
        vectors = [weigh(g) for g in own]
        centres = [vectors[i] for i in np.linspace(0, len(vectors) - 1, min(k, len(vectors))).astype(int)]
        for _ in range(rounds):
            near = [max(range(len(centres)), key=lambda j: (dot(v, centres[j]), -j)) for v in vectors]
            for j in range(len(centres)):
                mine = [v for v, x in zip(vectors, near, strict=True) if x == j]
                if mine:
                    total = Counter()
                    for v in mine:
                        total.update(v)
                    size = math.sqrt(sum(x * x for x in total.values()))
                    centres[j] = {i: x / size for i, x in total.items()}
        scale = lambda g: min(1.0, math.sqrt(len(g) / 400))
        least = 0.6 * float(np.quantile([max(dot(v, c) for c in centres) / scale(g) for v, g in zip(vectors, own, strict=True)], 0.01))
        centroids += [(lang, c, least) for c in centres]
    out = []
    for t in texts:
        g = language_grams(t)
        if g is None or not centroids:
            out.append(("und", 0.0, True))
            continue
        v = weigh(g)
        score, lang, least = max(((round(dot(v, c), 6), lang, least) for lang, c, least in centroids), key=lambda x: x[0])
        out.append((lang, score, score < least * min(1.0, math.sqrt(len(g) / 400))))
    return out
