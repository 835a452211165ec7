"""Plain versions of what SQL can't express, over lists of rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import regex

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def _valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == 1:
        return all(int(x) <= 255 for x in m.split("."))
    if kind == 2:
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != 3 or 9 <= len(digits) <= 15


def personal_base(text):
    text = text or ""
    spans = sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if _valid(k, m.group()))
    names = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return tuple(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(names.encode()).hexdigest(), names


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def components(texts, size=2, percent=80):
    """The set size and the smallest id reachable, for each id; all pairs that share a shingle are compared."""
    sets = {k: shingles(t, size) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    meet = defaultdict(set)
    for k, s in sets.items():
        for x in s:
            meet[x].add(k)
    seen = set()
    for group in meet.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def without_boilerplate(texts, hosts, ratio=0.05, least=3):
    """Texts without the lines that stand on more than a share of their host's different pages."""
    ends = " \t\n\x0b\x0c\r"
    pages = defaultdict(set)
    for k, t in texts.items():
        pages[hosts[k]].add(t)
    bad = {}
    for host, all_pages in pages.items():
        n = Counter(x for t in all_pages for x in {y.strip(ends) for y in t.split("\n")} - {""})
        bad[host] = {x for x, k in n.items() if k >= least and k > ratio * len(all_pages)}
    return {k: "\n".join(x for x in t.split("\n") if x.strip(ends) not in bad[hosts[k]]) for k, t in texts.items()}


def check_packing(pieces, ids_of, length=2048):
    """pieces: named tuples of op3's columns; ids_of: doc_id to its ids with the end id. Every rule of packing holds."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids_of)
    for k, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids_of[k]) and p.length > 0
            assert zlib.crc32(np.asarray(ids_of[k][at : at + p.length], "<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids_of[k])
    for k, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or k == max(by_seq)


def round_robin(queues, weights, window):
    """The queue and the number in it of each document sent, with exact fractions; what a window's quanta cover is sent in it."""
    tokens = {q: sum(ns) for q, ns in queues.items()}
    quanta, sent, at, out = dict.fromkeys(queues, Fraction(0)), dict.fromkeys(queues, 0), dict.fromkeys(queues, 0), []
    while any(at[q] < len(ns) for q, ns in queues.items()):
        rest = Fraction(window)
        while rest > 0:  # a queue whose quanta cover all of it leaves the rest of its share to the others
            lasting = [q for q in queues if quanta[q] < tokens[q]]
            if not lasting:
                break
            each = rest / sum(weights[q] for q in lasting)
            step = min(each, *((tokens[q] - quanta[q]) / weights[q] for q in lasting))
            for q in lasting:
                quanta[q] += step * weights[q]
            rest -= step * sum(weights[q] for q in lasting)
        for q in sorted(queues):
            while at[q] < len(queues[q]) and sent[q] + queues[q][at[q]] <= quanta[q]:
                sent[q] += queues[q][at[q]]
                out.append((q, at[q]))
                at[q] += 1
    return out


BREAK = "\"'<>()[]{}|,;:=#&$*"
SECRETS = r"(?<![A-Za-z0-9])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Za-z])[0-9A-Fa-f]{32,}(?![A-Za-z0-9])|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=password=|passwd=|secret=|api_key=)[^\x20\x09-\x0D%" + re.escape(BREAK) + "]{8,}"


def _patterns(before):
    plain = re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", before.lower()))
    words, end = plain.rstrip(" ").split(" "), " " * plain.endswith(" ")
    return {p for p in (" ".join(words[-k:]) + end for k in (1, 2, 3)) if p.strip(" ")}


def personal_spans(texts, rounds=3, confidence=0.5, support=5, reach=64):
    """The spans column for each id, discovered ones too."""
    spans, tokens = {}, []
    for i, t in texts.items():
        t = t or ""
        base = [x for x in personal_base(t)[2].split(",") if x]
        found = [(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in base)]
        found += [(m.start(), 4, m.end()) for m in regex.finditer(SECRETS, t)]
        spans[i] = found
        for m in re.finditer(r"[^\x20\x09-\x0D" + re.escape(BREAK) + "]{8,}", t):
            if re.search("[0-9]", m.group()):
                token = m.group().rstrip(".!?%")
                a, b = m.start(), m.start() + len(token)
                tokens.append((i, a, b, token, _patterns(t[max(0, a - reach) : a]), any(x < b and y > a for x, _, y in found)))
    known = {t for *_, t, _, seed in tokens if seed}
    of = defaultdict(set)
    at = defaultdict(set)
    for *_, token, patterns, _ in tokens:
        for p in patterns:
            of[p].add(token)
            at[token].add(p)
    conf = {p: sum(t in known for t in ts) / len(ts) for p, ts in of.items()}
    for _ in range(rounds - 1):
        score = lambda t, p, c=conf: 1 if t in known else sum(c[q] for q in at[t] - {p}) / max(1, len(at[t]) - 1)
        conf = {p: sum(score(t, p) for t in ts) / len(ts) for p, ts in of.items()}
    good = {p for p, c in conf.items() if c >= confidence and len(of[p] & known) >= support}
    for i, a, b, token, patterns, seed in tokens:
        if not seed and len(token) >= 12 and len(re.sub("[^0-9]", "", token)) >= 4 and patterns & good:
            spans[i].append((a, 5, b))
    return {i: ",".join(f"{[*KINDS, 'secret', 'id'][k]}:{a}:{b}" for a, k, b in sorted(found)) for i, found in spans.items()}


def license_labels(texts, templates, slack=8, least=0.6):
    """labels and score for each id: every template is tried at every start of every text."""
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for i, t in texts.items()}
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w]))
    out = {}
    for i, ws in words.items():
        best = {}
        stands = lambda key, at, ws=ws: at >= 0 and ws[at : at + len(key)] == key
        for t in templates:
            want = [w.decode() for w in t.words]
            keys = [(at, [w.decode() for w in key]) for at, key in t.keys]
            if not all(any(stands(key, p) for p in range(len(ws))) for _, key in keys):
                continue
            if t.base:
                best[t.label] = 1.0
                continue
            anchor = max(sorted({w for _, key in keys for w in key}), key=idf)
            own = next(k for k in keys if anchor in k[1])
            for start in range(-len(want), len(ws)):
                if stands(own[1], start + own[0]) and all(any(stands(key, start + at + s) for s in range(-slack, slack + 1)) for at, key in keys if key != own[1]):
                    near = sum(w in ws[max(0, start + j - slack) : max(0, start + j + slack + 1)] for j, w in enumerate(want))
                    if near >= least * len(want):
                        best[t.label] = max(best.get(t.label, 0), near / len(want))
        out[i] = ",".join(sorted(best)), max(best.values(), default=0.0)
    return out


def additive_score(model, x):
    """The score of one row of features, by comparing with every edge."""
    place = lambda edges, v: sum(v >= e for e in edges)
    total = model.base + sum(t[place(e, v)] for t, e, v in zip(model.tables, model.edges, x, strict=True))
    total += sum(t[place(model.coarse[f], x[f])][place(model.coarse[g], x[g])] for (f, g), t in model.pairs.items())
    return 1 / (1 + math.exp(-total))
