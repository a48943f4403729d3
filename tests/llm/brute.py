"""Plain versions of what the operators compute."""

import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text, n):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def components(docs, n, percent):
    """doc_id -> (set size, smallest id in reach), every pair compared that shares a shingle."""
    sets, holders, parent = {i: shingles(t, n) for i, t in docs}, defaultdict(list), {i: i for i, _ in docs}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def quality(text):
    raw = (text or "").encode()
    words = WORD.findall(raw)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    for line in (text or "").split("\n"):
        if WORD.search(line.encode()):
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """Base spans as the listing has them."""
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{s}:{e}" for s, k, e in sorted(out))


WEAK = [
    (3, "id", re.compile(r"""(?i)\b(?:access_key_id|client_id|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}+""", re.A)),
    (4, "secret", re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])")),
    (5, "secret", re.compile(r"""(?i)\b(?:pwd|pass|credential|private_key)["']?\x20*[:=]\x20*["']?[^\s"']{6,}+""", re.A)),
    (6, "place", re.compile(r"""(?i)\b(?:https?|ftp|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s"'<>]{4,}+""", re.A)),
]
KINDS = ["assign", "access", "hex", "account", "mixed", "phrase", "endpoint"]


def linked_secrets(text, scope=200):
    """All spans as the listing has them: base ones, and weak ones that a part of the other side lies near, pair by pair."""
    base = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in secrets(text).split(",") if x)]
    weak = []
    for kind, _, pattern in WEAK:
        for m in pattern.finditer(text or ""):
            if kind == 4 and not (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])):
                continue
            if not any(s < m.end() and m.start() < e for s, _, e in base):
                weak.append((m.start(), kind, m.end()))
    every = sorted(base + weak)
    inside = [False] * (len(text or "") + 1)
    for s, _, e in every:
        inside[s:e] = [True] * (e - s)
    free = [0]
    for x in inside:
        free.append(free[-1] + (not x))
    secret = {0: True, 1: False, 2: True} | {k: role == "secret" for k, role, _ in WEAK}
    found = [w for w in weak if any(secret[o[1]] != secret[w[1]] and abs(free[o[0]] - free[w[0]]) <= scope for o in every)]
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + found))


def schedule(weights, blocks, shares, slots):
    """The stream of every slot: the released block of the earliest deadline, slot by slot; a phase ends with a source."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        share, done, t = shares({s: weights[s] for s in left}, slots), dict.fromkeys(left, 0), 0
        while min(left.values()) > 0:
            ready = [(-(-(done[s] + 1) * slots // share[s]), s) for s in left if done[s] * slots // share[s] <= t]
            s = min(ready)[1]
            out.append(s)
            done[s] += 1
            left[s] -= 1
            t += 1
        left = {s: n for s, n in left.items() if n}
    return out
