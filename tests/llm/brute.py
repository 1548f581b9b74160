"""Plain versions of the operators' contracts, a document at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    words = LICENSE_WORD.findall((text or "").translate(UPPER))
    found = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def license_labels(text, phrases, notices, covered=0.8, drift=6):
    """(label, first, last) of the phrases and notices that a text holds, word by word."""
    words = LICENSE_WORD.findall((text or "").translate(UPPER))
    out, found = [], []
    for phrase, label in phrases:
        p = phrase.split()
        out += [(label, i, i + len(p) - 1) for i in range(len(words)) if words[i : i + len(p)] == p]
    for family, label, needed, notice in notices:
        t = LICENSE_WORD.findall(notice.translate(UPPER))
        k = 2 if len(t) < 16 else 4
        lines = defaultdict(list)  # diagonal -> places of the template
        for i in range(len(words) - k + 1):
            for j in range(len(t) - k + 1):
                if words[i : i + k] == t[j : j + k]:
                    lines[i - j].append(j)
        bands, spans = [], []
        for d in sorted(lines):  # diagonals beside each other are a band
            if not bands or d - bands[-1][-1] > drift:
                bands.append([])
            bands[-1].append(d)
        for band in bands:  # lines of a band that are near each other in the text are a span
            own = []
            for first, last, d in sorted((d + min(lines[d]), d + max(lines[d]) + k - 1, d) for d in band):
                hit = {j + x for j in lines[d] for x in range(k)}
                if own and first <= own[-1][1] + drift + 1:
                    own[-1] = [own[-1][0], max(own[-1][1], last), own[-1][2] | hit]
                else:
                    own.append([first, last, hit])
            spans += own
        for first, last, hit in spans:
            if len(hit) >= covered * len(t) and all(any(t[j] == w for j in hit) for w in needed.split()):
                found.append((family, first, last, len(hit), len(hit) / len(t), label))
    for family in {f[0] for f in found}:
        groups, end = [], -1
        for f in sorted((f for f in found if f[0] == family), key=lambda f: f[1:3]):
            if f[1] > end:
                groups.append([])
            groups[-1].append(f)
            end = max(end, f[2])
        for g in groups:
            out += [(f[5], f[1], f[2]) for f in g if f[3:5] == max(x[3:5] for x in g)]
    return sorted(out)


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n


def targets(sizes):
    """source -> target, by sharing what is left again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in rest)
        share = {s: left * weight[s] / w for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in above}


def fingerprint(text):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """doc_id -> fingerprint to doc_id -> smallest doc_id reachable."""
    by = defaultdict(list)
    for d, f in prints.items():
        by[f].append(d)
    keys = sorted(by)
    parent = {f: f for f in keys}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    first = {}
    for f in keys:
        first[root(f)] = min([first.get(root(f), by[f][0]), *by[f]])
    return {d: first[root(f)] for d, f in prints.items()}


def personal(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and doubled % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    kinds = Counter(k for *_, k in out)
    spans = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))
    return kinds["email"], kinds["ip"], kinds["card"], kinds["phone"], hashlib.sha256(spans.encode()).hexdigest(), spans


def disclosed(texts, threshold=0.8, remove=0.95, doubt=0.05, beginnings=(5, 3, 2, 1)):
    """For each text (start, end, kind, said) of the words that disclose its entities, by plain counts over all texts."""
    word = re.compile(r"[^\W_]+")
    spans = [[(int(a), int(b), k) for x in filter(None, personal(t)[5].split(",")) for k, a, b in [x.split(":")]] for t in texts]

    def name(t, a, b, k):
        found = t[a:b]
        return k, found.lower() if k == "email" else ".".join(str(int(x)) for x in found.split(".")) if k == "ip" else re.sub(r"[^0-9]", "", found)

    held = [{name(t, *s) for s in x} for t, x in zip(texts, spans)]
    words = [[(m[0].lower(), m.start(), m.end()) for m in word.finditer(t) if all(m.end() <= a or m.start() >= b for a, b, _ in x)] for t, x in zip(texts, spans)]
    n, n_texts, n_t = len(texts), len(set(texts)), Counter()
    for t in texts:
        seen = {x.lower() for x in word.findall(t)}
        n_t.update(seen | {(x[:k],) for x in seen for k in beginnings if len(x) > k})
    told = {}
    for e in set().union(*held):
        mine = [i for i in range(n) if e in held[i]]
        n_e, texts_e = len(mine), len({texts[i] for i in mine})
        met = {w for i in mine for w, _, _ in words[i]}
        for w in met:
            with_w = [i for i in mine if any(w == x for x, _, _ in words[i])]
            n_et, texts_et = len(with_w), len({texts[i] for i in with_w})
            if n_e == n:
                continue
            ratio = math.log((n_et / n) / (n_e / n * max(n_t[w], n_et) / n)) / -math.log(n_e / n)
            p = min(1, (max(n_t[w] - n_et, 0) + texts_et) / n_texts)
            if texts_et <= texts_e * p:
                continue
            chance = sum(math.comb(texts_e, i) * p**i * (1 - p) ** (texts_e - i) for i in range(texts_et, texts_e + 1))
            if ratio >= threshold and chance * len(met) <= doubt:
                fits = [w[:k] + "…" for k in beginnings if len(w) > k and math.log(n / n_t[(w[:k],)]) / math.log(n / n_e) < threshold]
                told[e, w] = ("name", None) if ratio >= remove else ("term", max(fits, key=len, default=None))
    out = []
    for i in range(n):
        kinds = {}
        for e in held[i]:
            for w, _, _ in words[i]:
                if (e, w) in told:
                    kinds[w] = min(kinds.get(w, ("x", "")), told[e, w], key=lambda x: (x[0], len(x[1] or "")))
        out.append([(a, b, *kinds[w]) for w, a, b in words[i] if w in kinds])
    return out


def media(text):
    data = (text or "").encode()
    padded = data + b"\xff" * (-len(data) % 576 if data else 576)
    return len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])


def host_rule(url):
    """host, path, rule and the rule's verdict."""
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = host.translate(UPPER)
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def resampled(rows, marks, buckets=10_000, seed=0):
    """doc_id -> (log weight, score, kept) of (doc_id, text) rows, given marks doc_id -> 0 or 1."""
    token = re.compile(r"[a-z0-9\x80-\U0010ffff]+|[^\sa-z0-9\x80-\U0010ffff]+", re.ASCII)

    def found(text):
        h = [zlib.crc32(x.encode()) for x in token.findall((text or "").translate(UPPER))]
        pairs = [((a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F) % 2**64) >> 16 for a, b in zip(h, h[1:])]
        return [x % buckets for x in h + pairs]

    features = {d: found(t) for d, t in rows}
    raw, good = Counter(), Counter()
    for d, f in features.items():
        raw.update(f)
        if marks.get(d):
            good.update(f)
    p = {b: math.log((good[b] + 1) / (sum(good.values()) + buckets)) - math.log((raw[b] + 1) / (sum(raw.values()) + buckets)) for b in raw}
    out = {}
    for d, f in features.items():
        w = sum(p[b] for b in f)
        u = (xxhash.xxh64_intdigest(str(d), seed) + 0.5) / 2**64
        out[d] = w, w - math.log(-math.log(u))
    k = math.floor(sum(marks.values()) / len(marks) * len(rows) + 0.5)
    cut = sorted((s for _, s in out.values()), reverse=True)[k - 1]
    return {d: (w, s, s >= cut) for d, (w, s) in out.items()}


def toxicity(rows, marks, buckets=1 << 18, stem=5, prior=2.0, sigmas=2.0, cost=1.0, lowest=-1.0, highest=6.0, tail=20, steepest=4.0):
    """doc_id -> probability of (doc_id, text) rows; the model is fitted on marks doc_id -> 0 or 1."""
    words = {d: LICENSE_WORD.findall((t or "").translate(UPPER)) for d, t in rows}
    tokens = lambda w: [zlib.crc32(x) % buckets for x in ([b"=" + w.encode(), b"^" + w.encode()[:stem]] if len(w.encode()) >= stem else [b"=" + w.encode()])]
    n, seen = Counter(marks.values()), (Counter(), Counter())
    for d, y in marks.items():
        seen[y].update({b for w in set(words[d]) for b in tokens(w)})

    def odds(b):
        a = prior * (seen[0][b] + seen[1][b] + 0.01) / (n[0] + n[1])
        y0, y1 = seen[0][b] + a, seen[1][b] + a
        z = math.log(y1 / max(n[1] + prior - y1, 0.5)) - math.log(y0 / max(n[0] + prior - y0, 0.5)) - sigmas * math.sqrt(1 / y0 + 1 / y1)
        rare = math.log((y1 + 0.5) / (n[1] + 1)) - math.log((y0 + 0.5) / (n[0] + 1)) - sigmas / math.sqrt(y1 + 0.5)
        return max(z, rare) if seen[1][b] >= 5 else min(z, 0.0)

    score = {w: min(highest, max(lowest, max(map(odds, tokens(w))))) - cost for w in {w for x in words.values() for w in x}}
    scores = {d: [score[w] for w in x] for d, x in words.items()}

    def segments(s):  # the best one, then what lies before and behind it
        if not any(x > 0 for x in s):
            return []
        best, low, at, total = (0, 0, 0), 0.0, 0, 0.0
        for i, x in enumerate(s):
            total += x
            if total - low > best[0]:
                best = (total - low, at, i)
            if total < low:
                low, at = total, i + 1
        return [*segments(s[: best[1]]), best[0], *segments(s[best[2] + 1 :])]

    harmless = [scores[d] for d, y in marks.items() if not y]
    single = Counter(math.ceil(x * 20) / 20 for s in harmless for x in s)
    total = sum(single.values())
    single[highest] += 1
    low, high = 1e-3, steepest
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(c / (total + (total > 0)) * math.exp(mid * v) for v, c in single.items()) < 1 else (low, mid)
    tops = sorted((math.ceil(x * 20) / 20 for s in harmless for x in segments(s)), reverse=True)
    at = tops[min(tail, len(tops)) - 1] if tops else 0.0
    factor = max(sum(x >= at for x in tops), 1) * math.exp(low * at) / total
    share, out = n[1] / len(marks), {}
    for d, s in scores.items():
        p = 1.0
        for r, x in enumerate(sorted(segments(s), reverse=True), 1):
            mean = factor * len(s) * math.exp(-low * x)
            if mean < r:
                p = min(p, r * (r + 1) * math.fsum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(r, r + 200)))
        bayes = -math.e * p * math.log(p) if 0 < p < 1 / math.e else float(p > 0)
        out[d] = share / (share + (1 - share) * bayes)
    return out


def clusters(vectors, k=8, rounds=10, seed=3, scale=1024, dimensions=64):
    """{place in vectors: (cluster, distance, inertia of the cluster, of all, hash of the centroid)} by whole scans."""
    kept = {n: [math.floor(scale * float(x)) for x in v] for n, (_, v) in enumerate(vectors) if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)}
    named = sorted((vectors[n][0] is None, hashlib.sha256(f"{seed}:{vectors[n][0]}".encode()).hexdigest(), v) for n, v in kept.items())
    centroids = [v for *_, v in named[:k]]
    for r in range(rounds + 1):
        found = {n: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for n, v in kept.items()}
        if r < rounds:
            for j in range(len(centroids)):
                if mine := [kept[n] for n in kept if found[n][1] == j]:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    per, total = Counter(), sum(d for d, _ in found.values()) if kept else 0
    for d, j in found.values() if kept else ():
        per[j] += d
    return {n: (j, d, per[j], total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for n, (d, j) in (found.items() if kept else ())}


def collocations(docs, longest=5, frequent=100, share=100, first=2000):
    """(lang, rank, phrase, a, l, r, n, score) in order."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= frequent}
    dropped = set()
    for (lang, *words), a in candidates.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                inner = (lang, *words[i:j])
                if j - i < len(words) and 100 * a >= share * f[inner]:
                    dropped.add(inner)
    out = defaultdict(list)
    for (lang, *words), a in candidates.items():
        if (lang, *words) not in dropped:
            cuts = [(1000 * a * n[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return [(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang in sorted(out) for i, (s, a, p, l, r) in enumerate(sorted(out[lang])[:first], 1)]  # noqa: E741
