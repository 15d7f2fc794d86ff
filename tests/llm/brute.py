"""The contracts in plain Python, over a list of (doc_id, text)."""

import hashlib
import re
from collections import defaultdict

WHITE = b" \t\n\x0b\x0c\r"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def data(text) -> bytes:
    return (text or "").encode()


def jaccard(docs, k=5, percent=80):
    sets = []
    for _, text in docs:
        words = WORD.findall(data(text).translate(FOLD))
        sets.append({tuple(words[i: i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    places = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            places[x].append(i)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in places[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    small = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            small[root(i)] = min(small.get(root(i), doc), doc)
    return [(doc, len(s), small.get(root(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(docs, sets))]


def substrings(docs, window=400):
    seen = defaultdict(int)
    for _, text in docs:
        b = data(text)
        for i in range(len(b) - window + 1):
            seen[b[i: i + window]] += 1
    out = []
    for doc, text in docs:
        b = data(text)
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i: i + window]] > 1:
                gone[i: i + window] = b"\x01" * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((doc, len(b), len(b) - len(kept), len(re.findall(b"\x01+", bytes(gone))), sha(kept)))
    return out


def passages(docs, window=13):
    first = {}
    split = [(doc if doc is not None else float("inf"), WORD.findall(data(text))) for doc, text in docs]
    for doc, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i: i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, words), (shown, _) in zip(split, docs):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i: i + window])] < doc:
                gone[i: i + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((shown, len(words), len(words) - len(kept), sha(b" ".join(kept))))
    return out


def lines(docs, min_chars=40, min_documents=5):
    split = [(doc, (text or "").split("\n")) for doc, text in docs]
    key = lambda line: data(line).strip(WHITE).translate(FOLD).decode()
    holders = defaultdict(set)
    for doc, rows in split:
        for line in rows:
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, rows in split:
        kept = []
        for line in rows:
            h = holders.get(key(line), ())
            named = [d for d in h if d is not None]
            if len(h) < min_documents or (named and doc == max(named)):
                kept.append(line)
        out.append((doc, len(rows), len(rows) - len(kept), sha(data("\n".join(kept)))))
    return out


def exact(docs):
    groups = defaultdict(list)
    norm = [re.sub(rb"[\x20\x09-\x0D]+", b" ", data(text)) for _, text in docs]
    for (doc, _), t in zip(docs, norm):
        groups[t].append(doc)
    out, used = [], set()
    for (doc, _), t in zip(docs, norm):
        keep = min((d for d in groups[t] if d is not None), default=None)
        kept = doc == keep and t not in used
        if kept:
            used.add(t)
        out.append((doc, keep, len(groups[t]), kept, sha(t)))
    return out


def edited(docs):
    """doc_id, n_chars, edited_sha256 and the edited text."""
    order = sorted(docs)
    out = []
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        moved = len(text) // 4
        new = text[: len(text) - moved] + following[:moved]
        out.append((doc, len(text), sha(new.encode()), new))
    return out


def shingle_set(text, k=5):
    words = WORD.findall(data(text))
    return {tuple(words[i: i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    """{source: target} by dealing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > limit * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in rest}
        for s in over:
            full[s] = limit * sizes[s]
            left -= full[s]


def alignment(docs, path_a, path_b):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, by loops over bytes."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    printable = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    others = [c for c in range(256) if c not in printable]
    letters = {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(others)}
    vocabulary = {i: t for t, i in json.load(open(path_a))["model"]["vocab"].items()}
    bytes_a = lambda i: bytes(letters[c] for c in vocabulary[i])
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    linked, shown = defaultdict(int), []
    for doc, text in docs:
        tokens = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            tokens = [[(i, f(i)) for i in side] for side, f in zip(ids, (bytes_a, bytes_b))]
            if any(b"".join(t for _, t in side) != (" " + text).encode() for side in tokens):
                tokens = []
        if not tokens:
            shown.append((doc, 0, 0, 0, [], ""))
            continue
        ranges = []
        for side in tokens:
            at, out = 0, []
            for i, t in side:
                out.append((at, at + len(t), i))
                at += len(t)
            ranges.append(out)
        ends = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        groups, k, m, links = [], 0, 0, []
        for end in ends:
            left, right = [], []
            while k < len(ranges[0]) and ranges[0][k][1] <= end:
                left.append(ranges[0][k])
                k += 1
            while m < len(ranges[1]) and ranges[1][m][1] <= end:
                right.append(ranges[1][m])
                m += 1
            links += [(x[2], y[2]) for x in left for y in right if x[0] < y[1] and y[0] < x[1]]
            groups.append(",".join(str(x[2]) for x in left) + "|" + ",".join(str(y[2]) for y in right))
        for pair in links:
            linked[pair] += 1
        shown.append((doc, len(ranges[0]), len(ranges[1]), len(groups), links, sha(";".join(groups).encode())))
    highest = defaultdict(int)
    for (_, y), n in linked.items():
        highest[y] = max(highest[y], n)
    return [(doc, n_a, n_b, n, len(links), sum(linked[p] == highest[p[1]] for p in links), sum(linked[p] for p in links), digest)
            for doc, n_a, n_b, n, links, digest in shown]


def base_secrets(text):
    """(start, kind number, end) of the fixed patterns."""
    text = text or ""
    word = r"(?:password|passwd|secret|token|api_?key)"
    assign = re.compile(rf"""(?ai:{word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def random_evidence(run, alphabet):
    """-ln of the p-value that a run is random: three tests and Fisher's method, with erfc for the normal law."""
    import math

    n, k = len(run), len(alphabet)
    places = [alphabet.index(c) for c in run]
    chi = sum((run.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
    z1 = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    q = (k // 2) / k
    p = 2 * q * (1 - q)
    changes = sum((x < k // 2) != (y < k // 2) for x, y in zip(places, places[1:]))
    z2 = (changes - (n - 1) * p) / math.sqrt((n - 1) * p * (1 - p) + 2 * (n - 2) * (q * (1 - q) - p * p))
    middle, variance = (k - 1) / 2, (k * k - 1) / 12
    pairs = [(places[i] - middle) * (places[i + 1] - middle) for i in range(n - 1) if (i + 1) % 1024]
    z3 = sum(pairs) / (variance * math.sqrt(len(pairs)))
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    half = -sum(math.log(max(t, 1e-290)) for t in (tail(z1), 2 * tail(abs(z2)), 2 * tail(abs(z3))))
    return half - math.log(1 + half + half * half / 2)


def secrets(docs, alphabets, not_plain, least=20, refused=0.001, share=0.01, prior=(-0.9, 0.75, 30.0), step=0.05):
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    import math

    candidates = []
    for number, (_, text) in enumerate(docs):
        for m in re.finditer("[A-Za-z0-9+/_-]{%d,}" % least, text or ""):
            name, letters = next((name, letters) for name, letters, pattern in alphabets if re.fullmatch(pattern, m[0]))
            candidates.append((number, m.start(), m.end(), name, not re.search(not_plain, m[0]), random_evidence(m[0], letters)))
    rate = lambda s, e, w: math.log((w + 1) / (e - s))
    known = [rate(s, e, w) for _, s, e, _, p, w in candidates if p]
    mean, spread, weight = prior
    law = (mean * weight + sum(known)) / (weight + len(known))
    sigma = math.sqrt((spread ** 2 * weight + sum((r - law) ** 2 for r in known)) / (weight + len(known)))
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    scores = [-math.log10(max(tail((law - rate(s, e, w)) / sigma), 1e-30)) for _, s, e, _, _, w in candidates]
    bins = [min(int(x / step), 600) for x in scores]
    passed = [k for k in range(601) if (r := sum(x >= k for x in bins)) and len(bins) * 10 ** (-k * step) <= share * r]
    threshold = min(passed) * step if passed else math.inf
    out = []
    for number, (doc, text) in enumerate(docs):
        base = base_secrets(text)
        more = [(s, 3, e) for (at, s, e, name, p, w), score in zip(candidates, scores) if at == number and not p and name != "decimal"
                and w <= -math.log(refused) and score >= threshold and not any(b < e and s < f for b, _, f in base)]
        joined = lambda spans: ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
        out.append((doc, *count, sha(joined(base).encode()), joined(base + more)))
    return out
