"""Plain versions of the contracts, for small tables."""

import collections
import hashlib
import math
import re
import zlib

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def licenses(text):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    words, places, labels = ALNUM.findall(lower(text)), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i] == p[0] and words[i:i + len(p)] == p]
        places += here
        labels |= {label} if here else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def shingles(text):
    words = NOT_BLANK.findall(lower(text))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_dups(docs):
    """[(id, text)] -> {id: component}; every pair is compared."""
    sets = collections.defaultdict(set)
    for i, text in docs:
        if i is not None:
            sets[i].add(shingles(text))
    above = {i: i for i in sets}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j] if a and b):
                one, two = sorted((top(i), top(j)))
                above[two] = one
    return {i: top(i) for i in ids}


def kept_lines(docs):
    """[(id, text)] -> per row (lines, dropped, kept text)."""
    last = (1 << 63) - 1
    key = lambda line: lower(line).strip(BLANKS)
    owner = {}
    for i, text in docs:
        i = last if i is None else i
        for line in (text or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), last), i)
    out = []
    for i, text in docs:
        i = last if i is None else i
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def quality_counts(text):
    text = text or ""
    words = NOT_BLANK.findall(text)
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            repeated.update(range(i, i + 8))
    seen, again = set(), 0
    for line in text.split("\n"):
        if NOT_BLANK.search(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated),
            n < 20 or 100 * len(repeated) > 30 * n)


def windows_of(items):
    found = collections.defaultdict(set)
    for i, text in items:
        words = ALNUM.findall(lower(text))
        size = min(13, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            found[tuple(words[k:k + size])].add(str(i))
    return found


def contamination(text, found):
    words, hit, items = ALNUM.findall(lower(text)), set(), set()
    for size in {len(w) for w in found}:
        for k in range(len(words) - size + 1):
            if tuple(words[k:k + size]) in found:
                items |= found[tuple(words[k:k + size])]
                hit.update(range(k, k + size))
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(words), len(hit), len(items), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


def fold(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


def base_scores(docs):
    """[(id, text)] -> per row (held out, tokens, known, train tokens, base score)."""
    tokens = [[*NOT_BLANK.findall(lower(text)), "\xff"] for _, text in docs]
    counts = collections.Counter(t for (i, _), row in zip(docs, tokens) if fold(i, 7) != 2 for t in row)
    total, least = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    return [(fold(i, 7) == 2, len(row), sum(counts[t] > 0 for t in row), total,
             sum(math.log10((counts[t] + 1) / least) for t in row)) for (i, _), row in zip(docs, tokens)]


def vector_links(vectors, least=0.9):
    """[(id, vector)] -> rows (id, links, component); every pair is compared."""
    def good(i, v):
        return i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [[x / max(map(abs, v)) for x in v] if good(i, v) else None for i, v in vectors]
    unit = [v and [x / math.sqrt(sum(y * y for y in v)) for x in v] for v in unit]
    near = [[b for b, y in enumerate(unit) if b != a and x and y and len(x) == len(y)
             and sum(p * q for p, q in zip(x, y, strict=True)) >= least] for a, x in enumerate(unit)]
    out = []
    for a, (i, _) in enumerate(vectors):
        reached, todo = {a}, [a]
        while todo:
            new = set(near[todo.pop()]) - reached
            reached |= new
            todo += new
        out.append((i, len(near[a]), min((vectors[b][0] for b in reached if vectors[b][0] is not None), default=None)))
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    """[(id, text)], [(item, text)] -> rows (item, rank, id, score); every document is scored."""
    bags = [(i, collections.Counter(lower(x) for x in TERM.findall(t or ""))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    length, df = sum(n for _, _, n in bags), collections.Counter(x for _, b, _ in bags for x in b)
    asked = collections.defaultdict(set)
    for item, t in items:
        asked[item] |= {lower(x) for x in TERM.findall(t or "")}
    out = []
    for item, terms in asked.items():
        scores = []
        for i, b, n in bags:
            m = 100 - 90 + (90 * n * len(bags)) // length
            score = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[x] + 1)))
                        * ((1_000_000_000 * b[x]) // (1000 * b[x] + 8 * m)) for x in terms if x in b)
            scores += [(-score, i is None, i)] if score > 0 else []
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return out


def edits(word, letters):
    """All texts at one edit of a word."""
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    made = {a + b[1:] for a, b in cut if b} | {a + c + b for a, b in cut for c in letters}
    return (made | {a + c + b[1:] for a, b in cut if b for c in letters}) - {word}


def one_edit(a, b):
    """Whether exactly one edit leads from a to b."""
    a, b = sorted((a, b), key=len)
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[same:] == b[same + 1:] or len(a) == len(b) and a[same + 1:] == b[same + 1:])


def variants(docs):
    """[(id, text)] -> rows (word, form, root, n, n_near, form_n); every text at one edit is looked up."""
    counts = collections.Counter()
    for i, text in docs:
        for word, times in collections.Counter(re.findall("[a-z\u00C0-\u00FF]+", lower(text))).items():
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            at = h % len(word)
            counts[word if h % 97 else word[:at] + word[at + 1:]] += times
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    letters = {c for w in n for c in w}
    near = {w: edits(w, letters) & n.keys() if len(w) < 50 else {v for v in n if one_edit(v, w)} for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=w) for w in n}
    form = {w: f if n[f] >= 2 * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out
