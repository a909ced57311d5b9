"""Plain single-machine versions of the corpus operators, for comparison."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def library_ids(name, texts):
    return [e.ids for e in library(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def token_file(rows, end):
    """rows: (doc_id, text) -> {doc_id: (start, n_tokens, crc)}."""
    rows = sorted(rows)
    out, start = {}, 0
    for (doc, _), ids in zip(rows, library_ids("word_bpe_49k.json", [t for _, t in rows])):
        ids = [*ids, end]
        out[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(zip(*(words[k:] for k in range(width))))


class Groups:
    def __init__(self):
        self.top = {}

    def root(self, x):
        while self.top.setdefault(x, x) != x:
            self.top[x] = x = self.top[self.top[x]]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.top[max(a, b)] = min(a, b)


def near_documents(rows, width, percent):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component_id)}; every pair that shares a shingle is compared."""
    number = {}
    sets = {d: {number.setdefault(s, len(number)) for s in shingles(t, width)} for d, t in rows}
    by_set = defaultdict(list)
    for d, s in sets.items():
        if s:
            by_set[frozenset(s)].append(d)
    groups, reps = Groups(), {}
    for s, ids in by_set.items():
        reps[min(ids)] = s
        for d in ids:
            groups.join(min(ids), d)
    holders = defaultdict(list)
    for d, s in reps.items():
        for x in s:
            holders[x].append(d)
    for d, s in reps.items():
        shared = defaultdict(int)
        for x in s:
            for e in holders[x]:
                if e < d:
                    shared[e] += 1
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(reps[e]) - n):
                groups.join(d, e)
    return {d: (len(s), groups.root(d)) for d, s in sets.items()}


def good_vector(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def near_vectors(rows, least):
    """rows: (vec_id, vector) -> {vec_id: (n_links, component_id)}."""
    ok = [(i, v) for i, v in rows if good_vector(v)]
    out, groups = {i: (0, i) for i, _ in rows}, Groups()
    if not ok:
        return out
    ids = np.array([i for i, _ in ok])
    x = np.array([v for _, v in ok], "f8")
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    counts = np.zeros(len(ids), int)
    for at in range(0, len(ids), 1000):
        near = x[at : at + 1000] @ x.T >= least
        near[np.arange(len(near)), at + np.arange(len(near))] = False
        counts[at : at + 1000] = near.sum(axis=1)
        for a, b in zip(*np.nonzero(near)):
            groups.join(int(ids[at + a]), int(ids[b]))
    return out | {int(i): (int(c), groups.root(int(i))) for i, c in zip(ids, counts)}


def nearest(rows, queries, k):
    """rows: (vec_id, vector) -> {query_id: [(distance, vec_id)]}."""
    ok = {i: np.array(v, "f8") for i, v in rows if good_vector(v)}
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    out = {}
    for q in queries:
        if q in ok:
            far = np.sqrt(((x - ok[q]) ** 2).sum(axis=1))
            order = np.lexsort((ids, far))
            out[q] = [(float(far[i]), int(ids[i])) for i in order if ids[i] != q][:k]
    return out


def article_text(page):
    """The text of a page's <article> by regular expressions: blocks end where a block element begins or ends."""
    found = re.search(r"<article>(.*?)</article>", page or "", re.DOTALL)
    parts = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|section|article|blockquote|pre|table|tr|td)\b[^>]*>", found[1].replace("<br>", " ")) if found else []
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if x)


def text_without_parts(page):
    """What is left of a page without head, menus, footers, scripts, styles and adverts, wherever it stands; parts don't nest alike."""
    left = re.sub(r"<!--.*?-->|<!DOCTYPE[^>]*>", "", page or "", flags=re.DOTALL)
    for tag in ("head", "nav", "header", "footer", "script", "style", "aside", 'div class="ad"'):
        left = re.sub(rf"<{tag}\b[^>]*>.*?</{tag.split()[0]}>" if " " not in tag else rf"<{tag}>.*?</div>", "", left, flags=re.DOTALL)
    parts = re.split(r"</?(?!b\b|i\b|em\b|a\b|br\b|span\b|strong\b)[a-z][a-z0-9]*\b[^>]*>", left.replace("<br>", " "))
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if x)


def toxic_score(text, model):
    """A document's score by loops over words, n-grams and windows."""
    from causeway.llm import toxicity

    vectors = []
    for token in (text or "").split():
        ids, _ = toxicity.features([toxicity.word_of(token)])
        vectors.append(np.mean([model.vectors[i].astype("f8") for i in ids], axis=0))
    spans = [vectors[i : i + model.width] for i in range(max(1, len(vectors) - model.width + 1))]
    z = []
    for span in spans:
        mean = np.mean(span, axis=0) if span else np.zeros(model.vectors.shape[1])
        a, b = (float(mean @ model.weights[:, k] + model.bias[k]) for k in (0, 1))
        z.append(b - a)
    weights = np.exp(np.array(z) - max(z))
    return 1 / (1 + np.exp(-float(weights @ np.array(z) / weights.sum())))


def draw_mix(rows, weights=(5, 2, 1), most=3, seed="mix"):
    """rows: (doc_id, text, source) -> how often the mix takes each, whole documents."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    total, w = {s: 0 for s in names}, {s: weights[i % len(weights)] for i, s in enumerate(names)}
    for n, (_, _, s) in zip(size, rows):
        total[s] += n
    bound: set = set()
    while True:
        rest, share = sum(total.values()) - most * sum(total[s] for s in bound), sum(w[s] for s in names if s not in bound)
        more = {s for s in names if s not in bound and w[s] * rest > most * total[s] * share}
        if not more:
            break
        bound |= more
    taken = [0] * len(rows)
    for s in names:
        if not total[s]:
            continue
        words = int(np.floor((most * total[s] if s in bound else w[s] * rest / share) + 0.5))
        epochs, left = divmod(words, total[s])
        order = sorted((hashlib.md5(f"{seed}:{'null' if d is None else d}".encode()).hexdigest(), size[i], i) for i, (d, _, x) in enumerate(rows) if x == s)
        for _, n, i in order:
            taken[i] = epochs + (left > 0 and 2 * left >= n) if n else 0
            left -= n
    return taken
