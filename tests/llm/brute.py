"""Plain re-statements of the operators on lists of rows, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def data(text):
    return (text or "").encode()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORD.findall(data(lower(text)))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def near_duplicates(rows):
    """[(doc_id, text)] to [(doc_id, n_shingles, component_id, kept)]."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                label[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        known = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = doc if not sets[i] else min(known, default=None)
        out.append((doc, len(sets[i]), component, doc == component))
    return out


def contamination(rows, items):
    patterns = []
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for i in range(max(len(w) - 12, 1) if w else 0):
            patterns.append((str(item) if item is not None else "", w[i : i + 13]))
    out = []
    for doc, text in rows:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for item, p in patterns:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def mix(rows):
    """[(doc_id, text, source)] to [(doc_id, size, source_size, target, taken)]."""
    size = [len(WORD.findall(data(t))) for _, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        total[s] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [s for s in total if s is None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = float(sum(size))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * total[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
            open_.remove(s)
    out = [None] * len(rows)
    for s in names:
        own = [i for i, r in enumerate(rows) if r[2] == s]
        key = lambda i: (hashlib.md5(f"mix:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][0] is not None, rows[i][0] or 0, size[i])
        budget, before = int(target[s] + 1e-9), 0
        whole = budget // total[s] if total[s] else 0
        rest = budget - whole * total[s]
        for i in sorted(own, key=key):
            part = max(0, min(size[i], rest - before))
            out[i] = (rows[i][0], size[i], total[s], target[s], whole * size[i] + part)
            before += size[i]
    return out


def remove_repeats(rows, length=200):
    times = Counter()
    for _, t in rows:
        b = data(t)
        times.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for doc, t in rows:
        b = data(t)
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if times[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shards(rows, count=24):
    """[(doc_id, text)] to the sorted (shard, size) pairs and the smallest capacity."""
    groups: dict = {}
    for doc, t in rows:
        groups.setdefault(hashlib.md5(data(t)).hexdigest(), []).append((doc, len(data(t)) + 8))
    total = sum(n for g in groups.values() for _, n in g)
    atoms = []
    for k in sorted(groups):
        sizes = [n for _, n in sorted(groups[k], key=lambda x: (x[0] is not None, x[0] or 0))]
        atoms.extend(sizes if sum(sizes) * count > total else [sum(sizes)])

    def need(capacity):
        n, held = 1, 0
        for a in atoms:
            if a > capacity:
                return count + 1
            if held + a > capacity:
                n, held = n + 1, 0
            held += a
        return n

    capacity = max(atoms, default=0)
    while atoms and need(capacity) > count:
        capacity += 1
    return capacity


def crc(text):
    return zlib.crc32(data(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, tampered=False):
    doc, text, lang, source, n_chars = row
    if tampered and n_chars is not None:
        n_chars += 1
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(part(v) for v in (doc, source, lang, n_chars, text)))


def levels(nodes, fanout):
    out = [list(nodes)]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, at, fanout):
    out = []
    for level in tree[:-1]:
        first = at - at % fanout
        out.append("".join(level[first:at] + level[at + 1 : first + fanout]))
        at //= fanout
    return "".join(out)


def manifest(rows, fanout=2):
    """[(doc_id, text, lang, source, n_chars)] to [(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)]."""
    groups: dict = {}
    for r in rows:
        groups.setdefault("" if r[2] is None else "=" + r[2], []).append(r)
    names = sorted(groups, key=str.encode)
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {name: levels([leaf(r) for r in groups[name]], fanout) for name in names}
    top = levels([trees[name][-1][0] for name in names], fanout)
    out = []
    for g, name in enumerate(names):
        for k, r in enumerate(groups[name]):
            changed = [leaf(x) for x in groups[name]]
            changed[k] = leaf(r, r[0] is not None and crc(str(r[0])) % 7 == 0)
            subroots = [trees[x][-1][0] for x in names]
            subroots[g] = levels(changed, fanout)[-1][0]
            folded = levels(subroots, fanout)[-1][0]
            proof = sha(siblings(trees[name], k, fanout) + siblings(top, g, fanout))
            out.append((r[0], leaf(r), trees[name][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def planted(doc, w):
    h = 1 if doc is None else crc(str(doc))
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[a + (i - a) % p if i >= a else i] for i in range(len(w))]


def runs(w):
    """Runs (start, length, period) of a list of words."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            begin = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > begin and i - begin + q >= max(6, 4 * q):
                found.setdefault((begin, i - begin + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic(rows):
    out = []
    for doc, text in rows:
        w = planted(doc, WORD.findall(data(text)))
        found = runs(w)
        best = None
        for r in found:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        digest = sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        kept = hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        out.append((doc, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, kept))
    return out


def similar(rows, least=0.9):
    """[(vec_id, embedding)] to [(vec_id, n_links, component_id, kept)]."""
    good = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    label, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if good(a) and good(b) and len(a) == len(b):
                if sum(x * y for x, y in zip(a, b, strict=True)) >= least * math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)):
                    links[i], links[j], label[find(i)] = links[i] + 1, links[j] + 1, find(j)
    out = []
    for i, (vec, v) in enumerate(rows):
        known = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(known, default=None) if good(v) else vec
        out.append((vec, links[i], component, vec == component))
    return out
