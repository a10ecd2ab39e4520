"""The computations in plain Python over small lists, to compare the engine with."""

import math
import re
from collections import Counter

import numpy as np

FIELDS = ["koumoku_name_full", "bunya_name", "chuubunrui_name", "shoubunrui_name", "definition", "stat_name"]


def text_of(row):
    return " ".join(row[f] or "" for f in FIELDS)


def top(scores, k):
    """[(doc_id, score)] of all documents, best first, ties by id."""
    return sorted(((d, round(s, 6)) for d, s in scores.items()), key=lambda p: (-p[1], p[0]))[:k]


def bm25(texts, query, k1=1.5, b=0.75, eps=0.25):
    docs = {d: Counter(t.split()) for d, t in texts.items()}
    n = len(docs)
    length = {d: sum(c.values()) for d, c in docs.items()}
    mean = sum(length.values()) / n
    df = Counter(t for c in docs.values() for t in c)
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = eps * sum(raw.values()) / len(raw)
    idf = {t: r if r >= 0 else floor for t, r in raw.items()}
    scores = dict.fromkeys(docs, 0.0)
    for token in query.split():
        for d, c in docs.items():
            if c[token]:
                scores[d] += idf[token] * c[token] * (k1 + 1) / (c[token] + k1 * (1 - b + b * length[d] / mean))
    return scores


def grams(text):
    words = re.findall(r"\w\w+", text.lower())
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def vocabulary(texts, size):
    docs = {d: grams(t) for d, t in texts.items()}
    cf = sum(docs.values(), Counter())
    kept = sorted(cf, key=lambda t: (-cf[t], t))[:size]
    df = {t: sum(1 for c in docs.values() if t in c) for t in kept}
    return {t: (df[t], cf[t], math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in kept}


def unit_row(counts, vocab):
    row = {t: c * vocab[t][2] for t, c in counts.items() if t in vocab}
    norm = math.sqrt(sum(w * w for w in row.values()))
    return {t: w / norm for t, w in row.items()}


def tfidf(texts, query, size):
    vocab = vocabulary(texts, size)
    asked = unit_row(grams(query), vocab)
    return {
        d: sum(w * asked.get(t, 0.0) for t, w in unit_row(grams(t_), vocab).items()) for d, t_ in texts.items()
    }


def fuse(vector, keyword, tfidf_list, depth, w):
    """Lists are [(doc_id, score)]. A table of documents, in the order in which they are first seen, by lists."""
    lists = [dict(vector), dict(keyword), dict(tfidf_list)]
    seen = list(dict.fromkeys(d for x in lists for d in x))
    table = np.array([[x.get(d, 0.0) for x in lists] for d in seen]).reshape(-1, 3)
    peak = np.append(1.0, table[:, 1:].max(axis=0, initial=0.0))
    scaled = np.divide(table, peak, out=np.zeros_like(table), where=peak > 0)
    total = np.round(scaled @ [w, (1 - w) / 2, (1 - w) / 2], 6)
    return [(seen[i], float(total[i])) for i in np.argsort(-total, kind="stable")[:depth]]


def lexical(row, query):
    """Shared (field, word) pairs, and two for each field that holds the whole query."""
    filled = {f: row[f].lower() for f in FIELDS if row[f] is not None}
    held = {(f, word) for f, text in filled.items() for word in text.split()}
    asked = {(f, word) for f in filled for word in query.lower().split()}
    return len(held & asked) + 2 * sum(query.lower() in text for text in filled.values())


def vector(embeddings, query):
    return {d: float(np.dot(np.float64(v), np.float64(query))) for d, v in embeddings.items()}


def expand(hits, corpus, added=10):
    """hits [(facet, name)] by rank, corpus [(facet, name)] in order -> [(facet, [names])] by first hit."""
    known = set(hits)
    new = [pair for pair in corpus if pair not in known and pair[0] is not None]
    names = lambda pairs, facet: [n for f, n in pairs if f == facet]
    return [(f, names(hits, f) + names(new, f)[:added]) for f in dict.fromkeys(f for f, _ in hits)]
