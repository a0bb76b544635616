"""Brute-force versions of the operators, in plain Python over small tables."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(text or "")


def statistics(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(ws) - 2):
        places.setdefault(tuple(ws[i : i + 3]), []).append(i)
    inside = {i + d for at in places.values() if len(at) > 1 for i in at for d in range(3)}
    n, chars = len(ws), sum(map(len, ws))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (n, chars, symbols, len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n)


def fold(text):
    """A-Z in lower case, as words of letters, digits and non-ASCII characters."""
    return FOLDED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(text, items, size=10):
    """(words, words hit, item ids with windows that occur) of one text against [(item_id, text)]."""
    ws, hit, found = fold(text), set(), set()
    for item, said in items:
        own = fold(said)
        k = min(size, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(ws) - k + 1) if k else ():
            if tuple(ws[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(ws), len(hit), sorted(found)


def shingles(text, n=5):
    ws = words(text)
    k = min(n, len(ws))
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if ws else frozenset()


def groups(docs, threshold=0.8):
    """[(id, text)] to {place: (smallest id of its group, links)} by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    links = [0] * len(docs)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        least[top(i)] = min(least.get(top(i), k), k)
    return {i: (least[top(i)], links[i]) for i in range(len(docs))}


def targets(sizes):
    """{source: words} to {source: target}, sharing the excess again until no source is above three times its size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in above}


def said(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def crc(data):
    return zlib.crc32(data)


def spellings(docs, shortest=6, rarest=5, factor=5):
    """[(id, text)] to {(word, form, root, n, near words, the form's n)} by trying all edits of each word."""
    counts = {}
    for k, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    known = {w: n for w, n in counts.items() if len(w) >= shortest and n >= rarest}
    letters = sorted({c for w in known for c in w})
    near, form = {}, {}
    for w in known:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + d :] for i in range(len(w) + 1) for c in letters for d in (0, 1)}
        near[w] = [x for x in edits - {w} if x in known]
        best = min(near[w], key=lambda x: (-known[x], x), default=None)
        form[w] = best if best is not None and known[best] >= factor * known[w] else None
    out = set()
    for w in known:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, known[w], len(near[w]), None if form[w] is None else known[form[w]]))
    return out


def fingerprint(text, n=3):
    import xxhash

    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    said = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] if len(ws) >= n else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in said]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def fingerprint_components(docs, distance=3):
    """[(id, text)] to [(id, fingerprint, smallest id reachable)], by comparing all pairs."""
    fps = [fingerprint(t) for _, t in docs]
    name = [None] * len(docs)
    for i in range(len(docs)):
        if name[i] is not None:
            continue
        name[i], front, mine = i, [i], [i]
        while front:
            at = front.pop()
            for j in range(len(docs)):
                if name[j] is None and (fps[at] ^ fps[j]).bit_count() <= distance:
                    name[j] = i
                    front.append(j)
                    mine.append(j)
        least = min((docs[j][0] for j in mine if docs[j][0] is not None), default=None)
        for j in mine:
            name[j] = (least,)
    return [(k, f"{fp:016x}", c[0]) for (k, _), fp, c in zip(docs, fps, name, strict=True)]


def audit(docs, labels):
    """[(id, text, lang)] and {id: (quality, toxic)} to the rows of the audit, by applying all orders to all documents."""
    from itertools import permutations

    first = {}
    for k, t, _ in docs:
        if k is not None:
            first[t or ""] = min(first.get(t or "", k), k)
    fails = []
    for k, t, _ in docs:
        ws, t = words(t), t or ""
        copy = k is not None and k > first[t]
        fails.append({"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": copy})
    rows, shapley = [], {}
    for part in sorted({x or "" for *_, x in docs}):
        own = [i for i, d in enumerate(docs) if (d[2] or "") == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if fails[i][f]]
                left = [i for i in left if not fails[i][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                all_ = [i for i in own if fails[i][f]]
                good, toxic = (sum(labels.get(docs[i][0], (0, 0))[x] == 1 for i in gone) for x in (0, 1))
                rows.append((part, "".join(order), step, len(left), len(gone), len(all_) - len(gone), sum(sum(fails[i].values()) == 1 for i in all_), good, toxic, f))
    return {(*r[:-1], shapley[r[0], r[-1]]) for r in rows}
