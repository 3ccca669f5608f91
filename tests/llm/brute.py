"""Plain versions of the text operators, for small tables."""
from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import xxhash

BLANK = r"[\x20\x09-\x0D]+"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return [w for w in re.split(BLANK, text or "") if w]


def fold(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def base_quality(text: str | None) -> tuple:
    text = text or ""
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if windows[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def fingerprint(text: str | None) -> str:
    w = words(low(text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def least_reachable(rows: list[tuple[int | None, str]]) -> list[int | None]:
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (int(a, 16) ^ int(b, 16)).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups: dict[int, list] = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(rows))]


def near_copies(rows: list[tuple[int | None, str | None]]) -> list[int | None]:
    """One id of each component of pairs with 5-word Jaccard similarity 0.8 or more: the smallest, null where there is no other."""
    sets = []
    for _, text in rows:
        w = words(low(text or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and 10 * len(a & b) >= 8 * len(a | b):
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    return [min((d for (d, _), h in zip(rows, group) if h == g and d is not None), default=None) for g in set(group)]


def base_lm(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    tokens = [[*words(low(t or "")), None] for _, t in rows]
    seen = Counter(w for (d, _), ts in zip(rows, tokens) if fold(d) != 1 for w in ts)
    n, v = sum(seen.values()), len(seen)
    return [(fold(d) == 1, len(ts), sum(seen[w] > 0 for w in ts), n,
             sum(math.log10((seen[w] + .5) / (n + .5 * (v + 1))) for w in ts)) for (d, _), ts in zip(rows, tokens)]


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only_digits(m[0])) <= 19 and luhn(only_digits(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only_digits(m[0])) <= 15),
}
SECRETS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def pii(text: str | None) -> str:
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, (r, ok) in PII.items() for m in re.finditer(r, text or "") if ok(m))


def disclosed(texts: list[str], threshold: float) -> list[list[str]]:
    """Per text the words that disclose a kind, group or value it protects, by document counts."""
    group = {"email": lambda v: v.split("@")[-1], "ip": lambda v: ".".join(v.split(".")[:2]), "card": lambda v: only_digits(v)[:6], "phone": lambda v: only_digits(v)[:4]}
    entities, words_in = [], []
    for text in texts:
        own = set()
        for kind, (r, ok) in PII.items():
            for m in re.finditer(r, text):
                if ok(m):
                    own |= {kind, f"{kind}-group:{group[kind](m[0])}", f"{kind}:{m[0]}"}
        entities.append(own)
        words_in.append(re.findall(r"[^\W\d_]{2,}", re.sub(PII["email"][0], " ", text)))
    n, n_e, n_t, n_te, d = len(texts), Counter(), Counter(), Counter(), Counter()
    for k, (own, ws) in enumerate(zip(entities, words_in)):
        terms = {w.lower() for w in ws}
        n_e.update(own)
        n_t.update(terms)
        pairs = [(e, t) for e in own for t in terms]
        n_te.update(pairs)
        d.update(pairs if texts[k] not in texts[:k] else [])

    def tells(e, t):
        chance = 1 - 1 / math.sqrt(d[e, t])
        return d[e, t] > 1 and n_e[e] < n and math.log(n_te[e, t] * n / (n_t[t] * n_e[e]) * chance) >= threshold * math.log(n / n_e[e])
    return [[w for w in ws if any(tells(e, w.lower()) for e in own)] for own, ws in zip(entities, words_in)]


def secrets(text: str | None) -> str:
    found = [(m.start(), n, k, m.end()) for n, (k, (r, ok)) in enumerate(SECRETS.items()) for m in re.finditer(r, text or "") if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def leak_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))


def leaks(text: str | None, items: list[tuple[str, str | None]]) -> tuple:
    w, hit, found = leak_words(text), set(), set()
    for item, body in items:
        own = leak_words(body)
        size = min(10, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for i in range(len(w) - size + 1):
                if w[i:i + size] == own[k:k + size]:
                    hit |= set(range(i, i + size))
                    found.add(item)
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def runs(w: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all stretches with smallest period q and at least max(6, 4 q) words."""
    best: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def periodic(doc_id, text: str | None, plant: bool = True) -> tuple:
    w = words(text)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if plant and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def top_scores(rows: list[tuple[int | None, list | None]], step: int = 50, k: int = 5) -> list[tuple]:
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in whole if i is not None and i % step == 0}):
        found = [(-sum(a * b for a, b in zip(v, x)), i is None, i or 0, i) for j, v in whole if j == q for i, x in whole if i != q]
        out += [(q, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(found, key=lambda r: r[:3])[:k])]
    return out


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


def repaired(rows: list[tuple]) -> dict:
    """conv_id to its result, by a search over rows read and state, cheapest and then least edits first."""
    out = {}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in own:
            last = re.sub(BLANK, "", text)[-1:]
            faults.append("b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in own if r[1] is not None}
        roles = [r[2][:1] for r in own]
        given = {"": "user", "s": "user", "u": "assistant", "a": "user"}
        heap, done = [(0, "", 0, "", ())], set()
        while heap:
            cost, audit, i, state, lines = heapq.heappop(heap)
            if i == len(own) and state in ("", "a"):
                break
            if (i, state) in done:
                continue
            done.add((i, state))
            new = given[state]
            heapq.heappush(heap, (cost + 2, audit + "I", i, new[0], (*lines, new + ":")))
            if i < len(own):
                _, _, role, text = own[i]
                heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
                if faults[i] not in ("b", "d"):
                    more = faults[i] == "t"
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, new[0], (*lines, f"{new}:{text}")))
                    if role[:1] in {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[state]:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, sha("\n".join(lines)))
    return out
