"""The contracts in plain Python, for small tables."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Nulls, blanks, ties, repeated lines, wide characters, one long word, a long text.
TEXTS = [
    "The first line of it\nshort\nA line that several documents hold\n",
    None,
    "",
    "   \t\n\x0b\x0c\r ",
    "A line that several documents hold\nits own line is here\n  a LINE that several documents hold  ",
    "A line that several documents hold",
    "Ünïcode wörds änd ßtuff ÉCLAIR 😀 emoji\nits own line is here\nits own line is here",
    "x" * 5000,
    "The first line of it\nshort\nA line that several documents hold\n",
    "one two",
    "word",
    "12345 67890 !!! ???",
    " ".join(f"w{i % 977}" for i in range(20_000)),
    "mail me at ana.b@mail.example.com or +1 (555) 123-4567, host 10.0.0.300 or 10.0.0.30; card 4111 1111 1111 1111 and 4111 1111 1111 1112",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows, least=10):
    """rows: (doc_id, text) with different ids. {doc_id: (n_lines, n_dropped, kept)}"""
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(STRIP).translate(LOWER)
            if len(k) >= least:
                owner[k] = min(owner.get(k, i), i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(x.strip(STRIP).translate(LOWER), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def simhash(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, most=3):
    """prints: {id: fingerprint}. {id: least id reachable}"""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == "card" and 13 <= len(d) <= 19 and luhn(d))
                or (kind == "phone" and 9 <= len(d) <= 15)
            ):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def targets(sizes, weights=(5, 2, 1), ceiling=3):
    """sizes: {source: words}. Shares by weight, what is above the ceiling shared again until nothing is."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / max(1e-300, sum(w[s] for s in free)) if free else 0
        above = [s for s in free if level * w[s] > ceiling * sizes[s]]
        if not above:
            return {**fixed, **{s: level * w[s] for s in free}}
        fixed.update({s: ceiling * sizes[s] for s in above})


# ---- language ID


def grams(text):
    """Each word's hashed byte trigrams."""
    kept = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in text.encode())
    return [[((w[i] << 16 | w[i + 1] << 8 | w[i + 2]) * 2654435761 % (1 << 32)) >> 16 for i in range(len(w) - 2)] for w in (b" " + x + b" " for x in kept.split(b" ") if x)]


def language_model(rows):
    """rows: (text, lang). Log-likelihood by trigram: counts plus a half over all, plus a half each."""
    import math
    from collections import Counter

    seen = {}
    for text, lang in rows:
        own = seen.setdefault(lang, Counter())
        for w in grams(text or ""):
            own.update(w)
    total = {x: sum(c.values()) + 0.5 * (1 << 16) for x, c in seen.items()}
    return {x: (lambda g, c=c, t=total[x]: math.log((c[g] + 0.5) / t)) for x, c in sorted(seen.items())}


def language(text, model, rounds=12):
    """(language, proportion, languages in the set), by the definition, one word after another."""
    import math

    langs = list(model)
    words = [[sum(model[x](g) for g in w) for x in langs] for w in grams(text or "")]
    if not words or not any(c.isalpha() for c in text):
        return "und", 0.0, 0

    def mixture(allowed):
        pi = [1 / len(allowed) if k in allowed else 0.0 for k in range(len(langs))]
        for _ in range(rounds):
            fresh = [0.0] * len(langs)
            for s in words:
                joint = [math.exp(x - max(s)) * p for x, p in zip(s, pi)]
                fresh = [f + j / max(sum(joint), 1e-300) for f, j in zip(fresh, joint)]
            pi = [f / len(words) for f in fresh]
        return pi, sum(math.log(max(sum(math.exp(x - max(s)) * p for x, p in zip(s, pi)), 1e-300)) + max(s) for s in words)

    single = [sum(s[k] for s in words) for k in range(len(langs))]
    best, share, count, held = single.index(max(single)), 1.0, 1, max(single)
    penalty = 0.5 * math.log(len(words) + 1) + 1
    full, like = mixture(range(len(langs)))
    if like - held > penalty:
        order = sorted(range(len(langs)), key=lambda k: -full[k])
        for m in range(2, len(langs) + 1):
            pi, like = mixture(order[:m])
            if like - held <= penalty:
                break
            best, share, count, held = pi.index(max(pi)), max(pi), m, like
    return langs[best], share, count
