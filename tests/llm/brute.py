"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import re

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_dedup(docs):
    """doc_id -> (kept text, lines, dropped) for distinct, non-null doc_ids."""
    lines = {i: (t or "").split("\n") for i, t in docs}
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    held = collections.defaultdict(set)
    for i, ls in lines.items():
        for x in ls:
            if len(key(x)) >= 10:
                held[key(x)].add(i)
    out = {}
    for i, ls in lines.items():
        kept = [x for x in ls if not (len(held[key(x)]) >= 2 and i != min(held[key(x)]))]
        out[i] = "\n".join(kept), len(ls), len(ls) - len(kept)
    return out


def water_fill(budget, children):
    """children: name -> (cap, weight); the share of each."""
    open_, out = dict(children), {}
    while open_:
        level = budget / sum(w for _, w in open_.values())
        full = {n: c for n, (c, w) in open_.items() if c <= w * level}
        if not full:
            out |= {n: w * level for n, (_, w) in open_.items()}
            break
        out |= full
        budget -= sum(full.values())
        open_ = {n: v for n, v in open_.items() if n not in full}
    return out


def mixture(docs, weights, budget, epochs, seed, domain):
    """docs: (id, text, lang, source) -> list of (doc, copies, tail)."""
    n = lambda t: len(re.findall(r"[^\x09-\x0D\x20]+", t or ""))
    leaves = collections.defaultdict(list)
    for d in docs:
        leaves[domain(d[3]), d[2], d[3]].append(d)
    tokens = {k: sum(n(d[1]) for d in v) for k, v in leaves.items()}
    w = lambda level, name: weights.get(level, {}).get(name, 1.0)
    cap = lambda *pre: sum(t * epochs for k, t in tokens.items() if k[: len(pre)] == pre)
    out = []
    top = water_fill(sum(tokens.values()) * budget, {a: (cap(a), w("domain", a)) for a in {k[0] for k in leaves}})
    for a, ba in top.items():
        for b, bb in water_fill(ba, {b: (cap(a, b), w("lang", b)) for b in {k[1] for k in leaves if k[0] == a}}).items():
            for c, bc in water_fill(bb, {c: (cap(a, b, c), w("source", c)) for c in {k[2] for k in leaves if k[:2] == (a, b)}}).items():
                leaf, total, target = leaves[a, b, c], tokens[a, b, c], int(bc + 1e-6)
                copies, left = (target // total, target % total) if total else (0, 0)
                ident = lambda d: ("" if d[0] is None else str(d[0])) + ":" + hashlib.md5((d[1] or "").encode()).hexdigest()
                for d in sorted(leaf, key=lambda d: (hashlib.md5(f"{seed}:{copies}:{ident(d)}".encode()).hexdigest(), ident(d), n(d[1]))):
                    take = max(0, min(n(d[1]), left))
                    left -= take
                    out.append((d, copies, take))
    return out


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def phrases(text):
    ws, found = words(text), []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(ws)) if ws[i : i + len(p)] == p]
    return len(ws), sorted(found)


def secrets(text):
    """Base spans by the patterns as stated."""
    word = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) if x != "api_?key" else "[aA][pP][iI]_?[kK][eE][yY]" for x in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def shingle_sets(texts, words):
    sets = []
    for text in texts:
        w = (text or "").translate(LOWER).split()
        sets.append({hash(tuple(w[i : i + words])) for i in range(max(1, len(w) - words + 1))} if w else set())
    return sets


def similar_pairs(sets, similarity):
    """All index pairs of this Jaccard similarity, by an index of the prefixes that similar sets must share; empty sets are alike."""
    index, tested, found = collections.defaultdict(list), set(), set()
    for x, s in enumerate(sets):
        need = -int(-similarity * len(s) // 1)
        for g in sorted(s)[: len(s) - need + 1] if s else [()]:
            for y in index[g]:
                if (y, x) not in tested and similarity * len(s) <= len(sets[y]) <= len(s) / similarity:
                    tested.add((y, x))
                    if len(s & sets[y]) >= similarity * len(s | sets[y]) - 1e-9:
                        found.add((y, x))
            index[g].append(x)
    return found


def near_copies(rows, words, similarity):
    """Index of each row to the least index it reaches over pairs of this Jaccard similarity."""
    low = list(range(len(rows)))
    pairs = similar_pairs(shingle_sets([t for _, t in rows], words), similarity)
    while True:
        before = list(low)
        for x, y in pairs:
            low[x] = low[y] = min(low[x], low[y])
        if low == before:
            return low
