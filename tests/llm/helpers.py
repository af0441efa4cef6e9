"""Small frames and plain versions of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SMALL = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
MARK_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
#: Null id, null and empty texts, repeated rows, one id with two texts, copies, case, a very long text.
EDGES = [
    (None, "A row without an id, of ten words or so, in all."), (1, None), (2, ""), (3, " \t\n"), (4, "Same Text here"), (5, "same text HERE"),
    (5, "same text HERE"), (6, "one id"), (6, "two texts"), (7, LONG), (8, LONG), (9, "é̄ ΑΣ ας K İ ß \x1c\x85 　 日本語 🙂"), (10, "x" * 5000),
    (11, "."), (12, "a b c d"), (13, "a b c d"), (14, "a b c d e"),
]
CLASHING = "tag long, row_no long, record long, n long, sig binary, bucket string, score double, word string, _id long, _text string, hash long, n_words long, kept string"


def documents(spark, rows):
    """doc_id and text, with further columns whose names operators might use themselves."""
    extra = [f.split(" ")[0] for f in CLASHING.split(", ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.selectExpr("*", *[f"cast(null as {f.split(' ')[1]}) as {e}" for f, e in zip(CLASHING.split(", "), extra)])


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lowered(text) -> str:
    return (text or "").translate(UPPER)


def multiset(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def exact_groups(rows):
    """(doc_id, keep_id, group_size, kept, sha) as a multiset; of equal rows one is kept."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            now = i == top and not kept
            kept = kept or now
            out[(i, top, len(ids), now, sha(text))] += 1
    return out


def shingle_set(text) -> frozenset:
    w = BLANK_WORDS.findall(lowered(text))
    return frozenset([" ".join(w)]) if 0 < len(w) < 5 else frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4))


def near_groups(rows, percent=80):
    """(doc_id, set size, smallest doc_id reachable), by comparing every two rows."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)].append(doc_id)
    return [(d, len(sets[i]), min(low[find(i)], default=None)) for i, (d, _) in enumerate(rows)]


def windows_cut(rows, window=50):
    """(doc_id, words, removed, sha of what stays)."""
    words = [BLANK_WORDS.findall(t or "") for _, t in rows]
    first = {}
    for (doc_id, _), w in zip(rows, words):
        if doc_id is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        if doc_id is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < doc_id:
                    gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def leaks(rows, items, window=10):
    """(doc_id, words, words hit, items found, sha of their ids, contaminated)."""
    wins = defaultdict(set)
    for item, text in items:
        w = MARK_WORDS.findall(lowered(text)) if text is not None else []
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i : i + n])].add(None if item is None else str(item))
    out = []
    for doc_id, text in rows:
        w = MARK_WORDS.findall(lowered(text))
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                got = wins.get(tuple(w[i : i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got - {None}
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out
