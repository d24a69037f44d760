"""Plain re-computations that the operators are held against."""

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def pii_spans(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def secret_spans(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(UPPER))
    if len(w) >= n:
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return {tuple(w)} if w else set()


def classes(docs, n, percent=80):
    """doc_id -> (set size, smallest id reachable)"""
    sets = {d: shingle_set(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = collections.defaultdict(list)
    for d in sorted(sets):
        common = collections.Counter(e for s in sets[d] for e in seen[s])
        for s in sets[d]:
            seen[s].append(d)
        for e, k in common.items():
            if 100 * k >= percent * (len(sets[d]) + len(sets[e]) - k):
                a, b = top(d), top(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), top(d)) for d in sets}


# --- PII: disclosing terms -------------------------------------------------------


def term_spans(docs, prior=1.0, generalise=0.9):
    """Spans of disclosing terms by position in ``docs`` (texts), from plain counts."""
    word = re.compile(r"[^\W_]+")

    def all_terms(t):
        return {w.lower() for w in word.findall(t) if w[0].isalpha()}

    def entities(t):
        out = set()
        for s, _, e, k in pii_spans(t):
            v = t[s:e]
            out.add((k, v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)))
        return out

    def masked(t):
        out, at = "", 0
        for s, _, e, _ in pii_spans(t):
            if s >= at:
                out += t[at:s] + " "
            at = max(at, e)
        return out + t[at:]

    n = len(docs)
    n_e, n_t, n_te = collections.Counter(), collections.Counter(), collections.Counter()
    for t in docs:
        n_t.update(all_terms(t or ""))
        es = entities(t or "")
        n_e.update(es)
        if es:
            n_te.update((w, e) for w in all_terms(masked(t)) for e in es)
    known = set()
    for (w, e), c in n_te.items():
        if n_e[e] < n:
            told = (c + prior * n_e[e] / n) / (n_t[w] + prior)
            if math.log2(told * n / n_e[e]) / math.log2(n / n_e[e]) >= generalise:
                known.add(w)
    out = []
    for t in docs:
        base = pii_spans(t or "")
        spots = [(m.start(), m.end()) for m in word.finditer(t or "") if m[0][0].isalpha() and m[0].lower() in known]
        out.append([x for x in spots if not any(s < x[1] and e > x[0] for s, _, e, _ in base)])
    return out


# --- secrets: the randomness battery ----------------------------------------------


def random_spans(docs, alphabets, prior_text, q=0.01, least=16, most=256, limit=16.27):
    """Added spans by position in ``docs``, from plain loops."""
    kinds = [("dec", "[0-9]+"), ("hex", "[0-9a-f]+"), ("hexu", "[0-9A-F]+"), ("b32", "[A-Z2-7]+=*"), ("b36", "[0-9a-z]+")]
    letters = collections.Counter(prior_text)
    candidates = []
    for i, t in enumerate(docs):
        t = t or ""
        for w in re.split(r"[^A-Za-z0-9+/_=-]+", t):
            if len(w) < least:
                letters.update(w)
        base = secret_spans(t)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % least, t):
            at, stretches = m.start(), []
            for s, _, e, _ in base:
                if s < m.end() and e > m.start():
                    stretches.append((at, s))
                    at = max(at, e)
            for s, e in [*stretches, (at, m.end())]:
                v = re.sub("^[+/_=-]+|[+/_-]+$", "", t[s:e])
                if len(v) >= least:
                    p = -(-len(v) // most)
                    candidates += [(i, s, e, v[k * len(v) // p : (k + 1) * len(v) // p]) for k in range(p)]
    for a, b in (("-", "+"), ("_", "/")):
        letters[b] += letters.pop(a, 0)
    tested = []
    for i, s, e, v in candidates:
        enc = next((k for k, p in kinds if re.fullmatch(p, v)), "b64")
        alphabet = alphabets[enc]
        r = [alphabet.index(c) for c in v.rstrip("=").replace("-", "+").replace("_", "/").replace("=", "") if c in alphabet]
        n, k = len(r), len(alphabet)
        if n < 2:
            continue
        x2 = k / n * sum(c * c for c in collections.Counter(r).values()) - n
        chi = max(0.0, (x2 - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
        high = [x >= k / 2 for x in r]
        n1 = sum(high)
        mean = 2 * n1 * (n - n1) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = (1 + sum(a != b for a, b in zip(high, high[1:])) - mean) / math.sqrt(var) if var > 0 else 99.0
        dev = [x - sum(r) / n for x in r]
        total = sum(x * x for x in dev)
        serial = (sum(a * b for a, b in zip(dev, dev[1:])) / total + 1 / n) * math.sqrt(n) if total > 0 else 99.0
        stat = chi * chi + runs * runs + serial * serial
        bits = math.inf
        for form in {"dec": [str], "hex": [str.lower], "hexu": [str.upper], "b32": [str.upper], "b36": [str.lower]}.get(enc, [str, str.lower, str.upper]):
            mapped = collections.Counter()
            for c, m in letters.items():
                mapped[form(c)] += m
            whole = sum(mapped[c] + 1 for c in alphabet)
            bits = min(bits, -sum(math.log2(k * (mapped[alphabet[x]] + 1) / whole) for x in r))
        b = min(64, max(0, math.floor(bits - stat / 2 / math.log(2)))) if stat <= limit else 0
        tested.append((i, s, e, min(9, int(math.log2(n))), b, stat <= limit))
    out = [set() for _ in docs]
    for band in {x[3] for x in tested}:
        mine = [x for x in tested if x[3] == band]
        levels = [b for b in range(1, 65) if 2.0**-b * len(mine) <= q * sum(x[4] >= b for x in mine) and any(x[4] == b for x in mine)]
        for x in mine:
            if levels and x[5] and x[4] >= min(levels):
                out[x[0]].add((x[1], x[2]))
    return [sorted(x) for x in out]


# --- I-Match ------------------------------------------------------------------------


def imatch(docs, groups, levels, digits, low=3.0, high=9.0):
    """Function of a text to its fingerprint, with the lexicon of ``docs``."""
    import xxhash

    def terms(t):
        return set(re.split(r"[\W_]+", t.lower()))

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    n_t = collections.Counter(w for t in docs if t is not None for w in terms(t))
    known = {w for w, n in n_t.items() if w and n > 1 and low <= math.log2(len(docs) / n) <= high}

    def chain(words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h

    def fingerprint(t):
        out, kept0 = "", sorted(terms(t) & known)
        for g in range(groups):
            kept = kept0
            for level in range(levels):
                kept = [w for w in kept if not signed(xxhash.xxh64_intdigest(g.to_bytes(4, "little"), xxhash.xxh64_intdigest(w.encode(), 42))) >> level & 1]
                out += format(chain(kept), "016x")[-digits:] if kept else "-" * digits
        if set(out) == {"-"}:
            out += format(chain(re.split(r"[\W_]+", t.lower())), "x")
        return out

    return fingerprint


def likeness(a, b, groups, levels, digits):
    if a == b:
        return 1.0
    cut = lambda s: [s[k * digits : (k + 1) * digits] for k in range(groups * levels)]
    empty = "-" * digits
    rows = [(k % levels, x, y) for k, (x, y) in enumerate(zip(cut(a), cut(b), strict=True))]
    first = min((lv for lv, x, y in rows if empty in (x, y)), default=levels - 1)
    told = [(x, y) for lv, x, y in rows if lv >= first and not x == y == empty]
    return sum(x == y for x, y in told) / len(told) if told else 0.0


# --- mixing ------------------------------------------------------------------------


def targets(sizes, weights, total, repeat=2):
    """Targets by weight below ``repeat`` times the size, the excess going on by weight."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] >= repeat * sizes[i]}
        for i in full or open_:
            target[i] = float(repeat * sizes[i]) if full else unit * weights[i]
        left -= sum(target[i] for i in full)
        open_ = open_ - full if full else set()
    return target
