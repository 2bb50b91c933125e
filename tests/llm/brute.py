"""Plain Python versions of the operators, quadratic where that is simplest."""

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def substring(docs, width=13):
    """{doc_id: (n_words, n_removed, kept text)}; docs are (doc_id, text)."""
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in docs:
        w, gone = words(t), set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), " ".join(kept))
    return out


def lines(docs, least=13):
    """{doc_id: (n_lines, n_removed, kept text)}: every run of lines with ``least`` words or more that stands earlier goes."""
    each = {i: [x for x in (y.strip(" \t\n\x0b\x0c\r") for y in (t or "").split("\n")) if x] for i, t in docs}
    at = {}
    for i, x in each.items():
        for k, line in enumerate(x):
            at.setdefault(line, []).append((i, k))
    out = {}
    for i, x in each.items():
        gone = set()
        for k, line in enumerate(x):
            for j, m in at[line]:
                if (j, m) >= (i, k) or (k and m and x[k - 1] == each[j][m - 1]):
                    continue  # not earlier, or not where the run begins
                n = 0
                while k + n < len(x) and m + n < len(each[j]) and x[k + n] == each[j][m + n]:
                    n += 1
                if sum(len(words(y)) for y in x[k : k + n]) >= least:
                    gone.update(range(k, k + n))
        out[i] = (len(x), len(gone), "\n".join(y for k, y in enumerate(x) if k not in gone))
    return out


def exact(docs):
    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t in docs}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), min(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def shingles(text, width=5):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = words(low)
    if not w:
        return set()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}


def near(docs, num, den):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = {}
    for i, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(i)
    for i, s in sets.items():
        both = Counter(j for g in s for j in at[g] if j > i)
        for j, n in both.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def quality(text):
    text = text or ""
    w = words(text)
    where = {}
    for k in range(len(w) - 2):
        where.setdefault(tuple(w[k : k + 3]), []).append(k)
    hit = {k + j for v in where.values() if len(v) > 1 for k in v for j in range(3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n)


def greedy(word, vocab, longest):
    n = i = 0
    while i < len(word):
        for j in range(min(len(word), i + longest), i, -1):
            if word[i:j] in vocab:
                break
        else:
            return -1
        i, n = j, n + 1
    return n


def url(u, rules):
    host = path = ""
    if u is not None and "://" in u:
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
        host, path = m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]
    fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def canonical(text):
    """A text's canonical form without regular expressions for lines: lines end at \\n alone."""
    kept = []
    for line in (text or "").translate({c: c + 32 for c in range(65, 91)}).split("\n"):
        k = 0
        while k < len(line) and not ("a" <= line[k] <= "z" or "0" <= line[k] <= "9"):
            k += 1
        signs = [line.find(x) for x in ("(c)", "\u00a9") if 0 <= line.find(x) <= k]
        year = any(line[j : j + 4].isdigit() and line[j : j + 4].isascii() for j in range(len(line)))
        marked = line[k:].startswith("copyright") and (year or "(c)" in line[k:] or "\u00a9" in line[k:])
        if marked or (signs and year) or line[k:].startswith("all rights reserved"):
            line = " "
        kept.append(line)
    words = "".join(c if "a" <= c <= "z" or "0" <= c <= "9" else " " for c in "\n".join(kept)).split()
    words = ["license" + w[7:] if w.startswith("licence") else w for w in words]
    out = []
    for w in words:
        if out and out[-1] == "sub" and w.startswith("licens"):
            out[-1] += w
        elif out and out[-1] == "non" and w.startswith("commercial"):
            out[-1] += w
        elif out and out[-1] == "copyright" and w == "owner":
            out.append("holder")
        else:
            out.append({"http": "https", "merchantibility": "merchantability", "version": "v"}.get(w, w))
    text = " ".join(out)
    return f" {text} ".replace(" permission is granted ", " permission is hereby granted ").strip(" ")
