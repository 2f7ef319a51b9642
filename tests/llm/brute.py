"""Plain-Python versions of the training-data operators, for small tables."""

import collections
import hashlib
import math
import re
from zlib import crc32

import numpy as np

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_scores(rows, trains):
    """doc_id -> (n_tokens, n_known, train_tokens, base score), for rows with distinct ids."""
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in rows}
    count = collections.Counter(w for i in tokens if trains(i) for w in tokens[i])
    total, distinct = sum(count.values()), len(count)
    return {i: (len(ws), sum(count[w] > 0 for w in ws), total,
                sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws)) for i, ws in tokens.items()}


def tree_scores(rows, trains, depth, least, gain, mu):
    """doc_id -> score by the suffix tree over all contexts of up to ``depth`` words, from plain counts of n-grams."""
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in rows}
    grams = collections.Counter(tuple(ws[k:k + n]) for i, ws in tokens.items() if trains(i)
                                for n in range(1, depth + 2) for k in range(len(ws) - n + 1))
    total = sum(c for g, c in grams.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in grams)
    kept = {}

    def probability(context, word):
        """In the longest retained suffix of ``context``."""
        if not context:
            return (grams[(word,)] + 1) / (total + distinct + 1)
        lower = probability(context[1:], word)
        return (grams[(*context, word)] + mu * lower) / (grams[context] + mu) if kept.get(context) else lower

    following = collections.defaultdict(list)
    for g in grams:
        following[g[:-1]].append(g[-1])
    for s in sorted((s for s in following if s and grams[s] >= least), key=len):
        total_gain = 0
        for w in following[s]:
            n, lower = grams[(*s, w)], probability(s[1:], w)
            total_gain += n * math.log((n - 1 + mu * lower) / (grams[s] - 1 + mu) / lower)
        kept[s] = total_gain >= gain * grams[s]
    scores = {i: sum(math.log10(probability(tuple(ws[max(0, k - depth):k]), ws[k])) for k in range(len(ws)))
              for i, ws in tokens.items()}
    return scores, kept


def simhash(text, words=4):
    import xxhash

    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    shingles = [b" ".join(ws[k:k + words]) for k in range(max(1, len(ws) - words + 1))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(shingles))


def linked(prints, bits=4):
    """Component number of each fingerprint, all pairs compared."""
    f = np.array(prints, np.uint64)
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(f)):
        for b in np.nonzero(np.bitwise_count(f[a] ^ f[a + 1:]) <= bits)[0] + a + 1:
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(f))]


def item_words(text):
    return [w for w in re.split("[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS)) if w]


def contamination(text, items, width=10):
    """(n_words, n_hit, n_items, items_sha256) of one text against (item_id, text) pairs."""
    ws, hit, found = item_words(text), set(), set()
    for item, body in items:
        iw = item_words(body)
        for k in range(max(1, len(iw) - width + 1)) if iw else ():
            window = iw[k:k + width]
            for a in range(len(ws) - len(window) + 1):
                if ws[a:a + len(window)] == window:
                    hit |= set(range(a, a + len(window)))
                    found.add(str(item))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def text_statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen = collections.Counter(tuple(ws[k:k + 3]) for k in range(len(ws) - 2))
    hit = {p for k in range(len(ws) - 2) if seen[tuple(ws[k:k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def repeats(rows, length=50):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)] in order of rows."""
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            if w not in first or key(i) < key(first[w]):
                first[w] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if key(first[b[k:k + length]]) < key(i):
                gone[k:k + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def in_bucket(doc, m):
    return crc32(b"" if doc is None else str(doc).encode()) % m


def repaired(conversations):
    """conv_id -> the contract's row for damaged conversations, by a plain table over (row, state) with whole edit strings."""
    space = " \t\n\x0b\x0c\r"
    text_of = lambda x: " " if x is None else str(x)
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text in conversations:
        role, text = text_of(role), text_of(text)
        kind = crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by_conv[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    steps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    target = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    out = {}
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.rstrip(space)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen
                          else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))

        def grow(best):
            """Insertions, until nothing gets cheaper."""
            for _ in range(4):
                for q, (cost, audit, kept) in list(best.items()):
                    to = target[q]
                    new = (cost + 5, audit + "I", [*kept, (names[to], "")])
                    if to not in best or new[:2] < best[to][:2]:
                        best[to] = new
            return best

        best = grow({"": (0, "", [])})
        for (_, role, text), fault in zip(rows, faults):
            after = {}
            late = 5 * (fault == "truncated")
            for q, (cost, audit, kept) in best.items():
                ways = [(q, cost + 2, audit + "D", kept)]
                if fault not in ("blank", "duplicate"):
                    ways.append((target[q], cost + 1 + late, audit + "R", [*kept, (names[target[q]], text)]))
                    if role[:1] in steps[q]:
                        ways.append((steps[q][role[0]], cost + late, audit + "K", [*kept, (role, text)]))
                for to, *new in ways:
                    if to not in after or tuple(new[:2]) < after[to][:2]:
                        after[to] = tuple(new)
            best = grow(after)
        cost, audit, kept = min((best[q] for q in ("", "a") if q in best), key=lambda x: x[:2])
        at = [t for t, _, _ in rows if t is not None]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (max(at) - min(at) + 1 - len(set(at)) if at else 0, *(faults.count(f) for f in (
            "blank", "duplicate", "truncated")), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au")
                                                     for a, b in zip(rows, rows[1:])), cost, audit, digest)
    return out


def fast_mcd(x, keep, rng, starts=300):
    """Mean and covariance of the ``keep`` share of rows with the least determinant found from random starts."""
    import numpy as np

    h, best = int(np.ceil(keep * len(x))), None
    for _ in range(starts):
        core = x[rng.choice(len(x), x.shape[1] + 1, replace=False)]
        last = np.inf
        while True:
            mean, cov = core.mean(axis=0), np.cov(core.T, bias=True)
            det = np.linalg.det(cov)
            if len(core) == h and not det < last * (1 - 1e-12):
                break
            last = det if len(core) == h else np.inf
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
            core = x[np.argsort(d2, kind="stable")[:h]]
        if best is None or det < best[0]:
            best = (det, mean, cov)
    return best[1:]


def proximity(rows, items, slack, width=10):
    """Counts of (doc_id, window words, start), once a distinct (doc_id, text), at which all words of a window that occur in ``rows`` stand near their place."""
    def cut(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))

    texts = [(i, cut(t)) for i, t in rows]
    count = collections.Counter(w for _, ws in texts for w in ws)
    windows = {tuple(ws[k:k + width]) for ws in (cut(t) for _, t in items) if ws
               for k in range(max(1, len(ws) - width + 1))}
    found = collections.Counter()
    for window in windows:
        present = [(o, w) for o, w in enumerate(window) if count[w]]
        if 2 * len(present) <= len(window):
            continue
        offset, rarest = min(present, key=lambda x: (count[x[1]], x[0]))
        for i, ws in ((i, cut(t)) for i, t in set(rows)):
            for start in (p - offset for p, w in enumerate(ws) if w == rarest):
                near = all(w in ws[max(start + o - slack, 0):start + o + slack + 1] for o, w in present)
                if near and start >= -slack:
                    found[i, window, start] += 1
    return found
