"""Awkward rows that every operator must take, and brute-force forms of the operators."""

import hashlib
import random
import re
from collections import defaultdict

CLASHING = ("digest", "node", "score", "kept", "spans", "rest", "shard", "size", "slot", "code", "gram", "bands", "token", "at", "label", "drop", "best", "component", "n", "locator")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def prose(rng, n, bag=400):
    return " ".join(f"w{rng.randrange(bag)}x{rng.randrange(3)}" for _ in range(n))


def corpus(seed=0, n=60):
    """Documents with copies, near copies, shared passages and lines, empty, null and long texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(12)]
    passage = prose(rng, 40)
    rows = []
    for i in range(n):
        t = rng.choice(base)
        kind = rng.randrange(6)
        if kind == 1:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = prose(rng, rng.randint(1, 60)) + "\n" + passage
        elif kind == 3:
            t = t.replace(" ", "  ", 2) + "\t"
        elif kind == 4:
            t = passage + " " + prose(rng, 30)
        rows.append((i * 7 % 101, t))
    rows += [(1000, ""), (1001, None), (1002, " \t\n"), (1003, "a" * 3000), (1004, prose(rng, 20_000, 100_000)), (1005, "é\x00ß" * 200), (1006, "Word"), (1007, "word")]
    return rows


def awkward(spark, rows=None):
    """corpus() with a null id, a repeated row and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    rows = corpus() if rows is None else rows
    rows = rows + ([(None, "no id at all but some words here"), (None, None), rows[0]] if rows else [])
    df = spark.createDataFrame([(i, t, None if k % 5 == 0 else "en" if k % 2 else "fr", f"s{k % 3}", None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHING})


def sha(x):
    return hashlib.sha256(x).hexdigest()


def jaccard_components(rows, n, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for k, a in enumerate(keys):
        for b in keys[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in keys}


def repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                mark[p : p + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1]))
        out[i] = (len(b), sum(mark), runs, sha(bytes(x for x, m in zip(b, mark) if not m)))
    return out


def line_drops(rows, least_texts, least_words, like):
    occ, body, drop = defaultdict(list), dict(rows), defaultdict(set)
    for d, t in sorted(rows):
        for i, x in enumerate((t or "").split("\n")):
            w = tuple("<*>" if re.search("[0-9]", y) else y for y in words(x))
            if len(w) >= least_words:
                occ[len(w), w[:3]].append((d, i, w))
    for lines in occ.values():
        seen, found = {}, []
        for d, i, w in lines:
            if w in seen:
                continue
            same = [sum(a == b for a, b in zip(t, w)) for t in found]
            k = max(range(len(found)), key=lambda k: (same[k], -k), default=None)
            if k is not None and same[k] >= like * len(w):
                found[k] = [a if a == b else None for a, b in zip(found[k], w)]
            else:
                k = len(found)
                found.append(list(w))
            seen[w] = k
        docs = defaultdict(set)
        for d, _, w in lines:
            docs[seen[w]].add(d)
        for d, i, w in lines:
            ids = docs[seen[w]]
            if len({body[x] for x in ids}) >= least_texts and d != min(ids):
                drop[d].add(i)
    return drop
