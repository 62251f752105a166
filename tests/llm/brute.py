"""Plain re-computations of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate(LOWER)


def words(text):
    return WORD.findall(lower(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def bag(text, size=5):
    w = words(text)
    if len(w) < size:
        return Counter([tuple(w)] if w else [])
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def similarity(a, b):
    both = sum((a & b).values())
    either = sum((a | b).values())
    return both / either if either else 0.0


def exact(rows):
    """Sorted (id, keep_id, size, kept, sha) of (id, text) rows."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, sha(text)))
            first = first and i != keep
    return sorted(out, key=repr)


def near(rows, threshold=0.8):
    """Sorted (id, class_id, size) of (id, text) rows."""
    texts = sorted({t or "" for _, t in rows})
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if similarity(bags[a], bags[b]) >= threshold - 1e-12:
                parent[root(a)] = root(b)
    classes = defaultdict(list)
    for i, t in rows:
        classes[root(texts.index(t or ""))].append(i)
    out = []
    for ids in classes.values():
        name = min((i for i in ids if i is not None), default=None)
        out += [(i, name, len(ids)) for i in ids]
    return sorted(out, key=repr)


def contamination(rows, items, window=13):
    """Sorted (id, n_words, n_hit, n_items, sha, contaminated)."""
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(window, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[k : k + n]:
                        hit.update(range(at, at + n))
                        found.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), sha(",".join(ids)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def line_dedup(rows, least=10):
    """Sorted (id, n_lines, n_dropped, kept text)."""
    strip = " \t\n\x0b\x0c\r"
    seen = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen[lower(line.strip(strip))].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (x.strip(strip) and len(seen[lower(x.strip(strip))]) >= least)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def pii(text):
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def judge(url, rules=RULES):
    """(host, path, rule, verdict)."""
    if url is None or "://" not in url:
        return "", "", None, "allow"
    host, rest = re.match(r"([^/?#]*)(.*)", url.split("://", 1)[1], re.S).groups()
    host, path = host.translate(LOWER), re.match(r"[^?#]*", rest)[0]
    fits = []
    for rule, verdict in rules:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), len(h), rule, verdict))
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


def crc(text):
    return zlib.crc32((text or "").encode())
