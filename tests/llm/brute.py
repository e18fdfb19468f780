"""Plain, slow forms of what the operators compute, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def lower(data: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in data)


def repeats(docs, least=100):
    """docs: (doc_id, text). {doc_id: (n_bytes, n_removed, n_spans, sha)} by sets of substrings; ids are distinct."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - least + 1):
            s = data[i : i + least]
            if s in seen:
                gone[i : i + least] = [True] * least
            seen.add(s)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def shingle_set(text, n=5):
    w = words(lower((text or "").encode()).decode())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def groups(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def near(docs):
    """{doc_id: (n_shingles, component_id, kept)}."""
    sets = {i: shingle_set(t) for i, t in docs}
    linked = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    of = groups(sets, linked)
    return {i: (len(sets[i]), of[i], of[i] == i) for i in sets}


def rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    w = [x.decode() for x in words(text)]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def unigram(docs):
    """{doc_id: (held_out, n_tokens, n_known, N, base_score)}; ids are distinct."""
    import math

    tokens = {i: [lower(x) for x in words(t)] + [None] for i, t in docs}
    count = Counter(x for i, t in tokens.items() if not held_out(i) for x in t)
    total, kinds = sum(count.values()), len(count)
    return {i: (held_out(i), len(t), sum(count[x] > 0 for x in t), total, sum(math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in t)) for i, t in tokens.items()}


def trigram(docs, d=0.75):
    """{doc_id: score} of an interpolated absolute-discount model: ``d`` for trigrams and bigrams, for words a discount from their counts."""
    import math

    tokens = {i: [None, None] + [lower(x) for x in words(t)] + [None] for i, t in docs}
    grams, single = [Counter(), Counter()], Counter()
    for i, t in tokens.items():
        if not held_out(i):
            grams[0].update(((v,), w) for v, w in zip(t[1:], t[2:], strict=False))
            grams[1].update(((u, v), w) for u, v, w in zip(t, t[1:], t[2:], strict=False))
            single.update(t[2:])
    context, kinds = Counter(), Counter()
    for of in grams:
        for (c, _), n in of.items():
            context[c] += n
            kinds[c] += 1
    n1, n2 = (sum(c == k for c in single.values()) for k in (1, 2))
    d1, total = n1 / (n1 + 2 * n2) if n1 else 0.5, sum(single.values())

    def p(words_before, w):
        if not words_before:
            return (single[w] - d1) / total if single[w] else d1 * len(single) / total
        low = p(words_before[1:], w)
        n = context[words_before]
        return max(0, grams[len(words_before) - 1][words_before, w] - d) / n + d * kinds[words_before] / n * low if n else low

    return {i: sum(math.log10(p((u, v), w)) for u, v, w in zip(t, t[1:], t[2:], strict=False)) for i, t in tokens.items()}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def normal_line(line):
    out = b" ".join(words(lower(line.encode()).decode()))
    return re.sub(r"[0-9]", "0", out.decode())


def lines(docs, least_words=3):
    """[(doc_id, line number, line, normal form)] of the lines with words enough."""
    return [(i, k, x, normal_line(x)) for i, t in docs for k, x in enumerate((t or "").split("\n")) if len(words(x)) >= least_words]


def unigram_tokens(word, scores, byte):
    """Tokens of the best segmentation of one word, by dynamic programming over the word alone."""
    best = [(0.0, 0)] + [None] * len(word)
    for d in range(1, len(word) + 1):
        n = len(word[d - 1].encode())
        best[d] = (best[d - 1][0] + byte * n, best[d - 1][1] + n)
        for k in range(d):
            s = scores.get(word[k:d])
            if s is not None and best[k][0] + s > best[d][0]:
                best[d] = (best[k][0] + s, best[k][1] + 1)
    return best[-1][1]


def by(rows, key="doc_id"):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out
