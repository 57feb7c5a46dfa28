"""The contracts, said plainly and slowly; and a small table that holds their hard cases."""

import hashlib
import re
import zlib
from collections import Counter

WORDS = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def hard_rows(n=60):
    """(doc_id, text): near and exact copies, nulls, empty and long texts, repeated rows and ids, odd characters."""
    import random

    r = random.Random(11)
    rows = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "one"), (-5, "One two three"), (-6, "one two THREE"), (None, "null id text here today"), (-7, "é́ 京都 \x1c x\x00y ﬁ ǅ Σας"), (-8, "word " * 9000), (-9, "x" * 30000)]
    for i in range(n):
        words = [r.choice(BASE) + str(r.randint(0, 30)) for _ in range(r.randint(3, 120))]
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            for j in range(4):
                copy = list(words)
                for _ in range(r.randint(0, max(1, len(words) // 15))):
                    copy[r.randrange(len(copy))] = f"edit{r.randint(0, 999)}"
                rows.append((1000 + 10 * i + j, " ".join(copy)))
    rows += [(5, rows[15][1]), rows[20], rows[20], (77, "Same id"), (77, "Another text with the same id")]
    return rows


def frame(spark, rows=None):
    """The rows with columns whose names clash with those that operators make."""
    rows = hard_rows() if rows is None else rows
    full = [(d, t, "en" if d is None or d % 2 else None, f"src{(d or 0) % 3}", len(t) if t else None, 1, 2, "x", True) for d, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, n int, h string, found boolean"
    return spark.createDataFrame(full, schema).repartition(3)


def documents(spark, rows=None):
    return frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")


def shingles(text, size):
    words = [w.translate(FOLD) for w in WORDS.findall(text or "")]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(rows, size=4, percent=80):
    """For each row: (shingles, component's least id)."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


ITEM_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contamination(text, items, window=13):
    words = ITEM_WORDS.findall((text or "").translate(FOLD))
    hit, ids = set(), set()
    for item_id, item in items:
        w = ITEM_WORDS.findall((item or "").translate(FOLD))
        k = min(window, len(w))
        for s in range(len(w) - k + 1) if w else ():
            for p in range(len(words) - k + 1):
                if words[p : p + k] == w[s : s + k]:
                    hit.update(range(p, p + k))
                    ids.add(item_id)
    return len(words), len(hit), sorted(str(i) for i in ids if i is not None), bool(hit) and 20 * len(hit) >= len(words)


def quality(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def wide_candidates(text):
    """Candidates beyond the base spans that overlap none of these, and all candidates with votes and what the classifier sees."""
    import regex
    import xxhash

    from lucidoc.llm import pii

    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    base = {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in personal(text))}
    found = []
    for kind, pattern, worth, shape in [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True, lambda m: True),
        ("ip", r"[0-9]+(?:\.[0-9]+){3}", lambda m: True, lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", pii.CARD, lambda m: 13 <= len(digits(m)) <= 19, lambda m: luhn(digits(m))),
        ("phone", pii.PHONE, lambda m: True, lambda m: 9 <= len(digits(m)) <= 15),
        ("email", pii.WORDED_EMAIL, lambda m: "@" not in m and regex.search(r"(?i)[\[(] ?at ?[\])]", text), lambda m: True),
        ("phone", pii.LOCAL_PHONE, lambda m: "+" not in m, lambda m: True),
        ("ssn", pii.SSN, lambda m: True, lambda m: not re.search("-00-|-0000$", m)),
        ("name", pii.NAME, lambda m: True, lambda m: not regex.search(r"(?i)(\p{L}+) \1$", m)),
        ("address", pii.ADDRESS, lambda m: True, lambda m: bool(re.search("[1-9]", m))),
    ]:
        for m in regex.finditer(pattern, text):
            if worth(m[0]):
                found.append((kind, m.start(), m.end(), m[0], shape(m[0])))
    out = []
    for kind, a, b, match, shape in found:
        known = (kind, a, b) in base
        if not known and any(a < y and x < b for _, x, y in base):
            continue
        prior, later = text[max(0, a - 40) : a].lower(), text[b : b + 30]
        has = lambda pattern, s: bool(regex.search(pattern, s))
        pick = lambda yes, no: 1 if yes else 0 if no else -1
        if kind == "email":
            listed = pick(has(rf"(?:\.|dot\s?[\])]\s?)(?:{'|'.join(pii.DOMAIN_ENDS)})$", match.lower()), False)
        elif kind == "ip":
            listed = pick(has(r"^(?:10|127|172|192)\.", match), match.startswith("0"))
        elif kind == "card":
            listed = int(has("^[3-6]", digits(match)))
        elif kind == "phone":
            listed = pick(has(rf"^\+(?:{'|'.join(pii.COUNTRY_CODES)})", match), has(r"^\(?[01]", match))
        elif kind == "ssn":
            listed = int(not has("^(?:000|666|9)", match))
        elif kind == "name":
            listed = pick(has(rf"(?:^| )(?:{'|'.join(pii.GIVEN_NAMES)}) ", match), False)
        else:
            listed = pick(has(rf"^\W{{0,9}}[0-9]{{0,5}}\W{{0,2}}(?:{'|'.join(pii.PLACES)})(?!\p{{L}})", later), False)
        word = lambda c: has(r"[\p{L}\p{N}_]", c)
        side = lambda c: "w" if word(c) else "p" if has(r"\S", c) else "s"
        before, after = text[a - 1 : a] if a else "", text[b : b + 1]
        votes = (int(shape), listed, pick(has(pii.HINTS[kind], prior), has(pii.AGAINST, prior)), pick(has(pii.HINTS_AFTER[kind], later.lower()), has(pii.AGAINST_AFTER, later.lower())), int(not word(before) and not word(after)))
        shown = regex.sub("[0-9]+", "9", regex.sub(r"\p{Lu}[\p{L}'’]*", "A", regex.sub(r"\p{Ll}[\p{L}'’]*", "a", match)))
        h = xxhash.xxh64_intdigest(shown.encode(), 42)
        seen = ((h - (1 << 64) if h >> 63 else h) % pii.OUTLINES, min(len(match) // 6, 4), side(before), side(after), luhn(digits(match)) if kind == "card" else True)
        out.append((kind, a, b, known, votes, seen))
    return out


def personal_spans(texts):
    """For each text, all spans: base ones, and wide ones that the classifier accepts when the models are fitted on these texts."""
    from lucidoc.llm import pii

    each = [wide_candidates(t) for t in texts]
    counts, known, features = Counter(), Counter(), {}
    for kind, _, _, base, votes, _ in (c for cs in each for c in cs):
        counts[kind, votes] += 1
        known[kind, votes] += base
    true, _, _ = pii.estimate([(k, v, n, known[k, v]) for (k, v), n in sorted(counts.items())])
    for kind, _, _, base, votes, seen in (c for cs in each for c in cs):
        p = 1.0 if base else true[kind, votes]
        yes, no = features.get((kind, seen), (0.0, 0.0))
        features[kind, seen] = yes + p, no + 1 - p
    weights = pii.classifier([(pii.named(k, *seen), yes, no) for (k, seen), (yes, no) in sorted(features.items(), key=repr)])
    accepted = lambda c: c[3] or sum(weights[f] for f in pii.named(c[0], *c[5])) >= 0
    order = lambda c: (pii.KINDS.index(c[0]), c[1], c[2])
    return [[f"{k}:{a}:{b}" for k, a, b, *_ in sorted(filter(accepted, cs), key=order)] for cs in each]
