"""Plain versions of the operators, for small data."""

import hashlib
import re
from collections import Counter

import numpy as np

from quillspark.llm import op3_quality as q3
from quillspark.llm.shingles import WORD


def grams(text):
    w = WORD.findall((text or "").lower())
    if not w:
        return Counter()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def probability_jaccard(a, b):
    if not a or not b:
        return float(bool(a) == bool(b))
    na, nb = sum(a.values()), sum(b.values())
    x, y = {k: v / na for k, v in a.items()}, {k: v / nb for k, v in b.items()}
    both = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in both) for i in x if i in y)


def near_classes(docs, threshold=0.8):
    """{doc_id: class_id} of rows (doc_id, text)."""
    ids = sorted({d for d, _ in docs if d is not None})
    label = {d: d for d in ids}

    def join(a, b):
        a, b = sorted((label[a], label[b]))
        for k, v in label.items():
            if v == b:
                label[k] = a

    rows = [(d, t, grams(t)) for d, t in docs if d is not None and t is not None]
    for i, (a, ta, ga) in enumerate(rows):
        for b, tb, gb in rows[i + 1 :]:
            if label[a] != label[b] and (ta == tb or (ga and gb and len(set(ga) & set(gb)) * 2 > min(len(ga), len(gb)) * 0.5 and probability_jaccard(ga, gb) >= threshold)):
                join(a, b)
    return label


def contaminated(docs, items, threshold=0.8):
    """{(doc_id, item_id): (similarity, first_word)}."""
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for i, text in items:
            v = WORD.findall((text or "").lower())
            want = grams(text)
            if not v or i is None:
                continue
            for s in range(len(w) - len(v) + 1):
                have = grams(" ".join(w[s : s + len(v)]))
                low = sum((have & want).values())
                j = low / (sum(have.values()) + sum(want.values()) - low)
                if j >= threshold and j > out.get((d, i), (0,))[0]:
                    out[d, i] = j, s
    return out


def line_dedup(docs, run=2, alone=50):
    """{doc_id: text} for rows with distinct ids."""
    first, spans = {}, {}
    for d, t in sorted((d, t) for d, t in docs if t is not None):
        full = [i for i, x in enumerate(t.split("\n")) if x.strip(" \t\r\f\v")]
        lines = t.split("\n")
        spans[d] = set()
        for n in (run, 1):
            for k in range(len(full) - n + 1):
                key = tuple(lines[i] for i in full[k : k + n])
                if (n == run or len(key[0].split()) > alone) and first.setdefault(key, (d, k)) != (d, k):
                    spans[d] |= set(full[k : k + n])
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in spans[d]) for d, t in docs}


def repeated_bytes(docs, n=100):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            if raw[i : i + n] in seen:
                gone[i : i + n] = b"\1" * n
            else:
                seen.add(raw[i : i + n])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def further_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    share = [text.count(c) / len(text) for c in set(text)]
    return len(set(words)), sum(not c.isalnum() for w in words for c in w), -sum(p * np.log2(p) for p in share)


def quality_vectors(docs):
    """{doc_id: (language, source, vector)} of the rows that pass the base rules."""
    out = {}
    for d, t, lang, source in docs:
        n, chars, _, _, rep = base_counts(t)
        if n >= 50 and 100 * rep <= 50 * n:
            distinct, marks, entropy = further_counts(t)
            v = [np.log(n), np.log(chars / n), np.log(distinct), np.log((marks + 0.5) / (chars - marks + 0.5)), entropy]
            out[d] = lang, source, tuple(np.floor(np.array(v) * q3.UNIT + 0.5) / q3.UNIT)
    return out


def mcd(rows, starts=30, seed=0):
    """Minimum covariance determinant by many random starts and exact h-subsets: centre, scatter."""
    m, rng, best = np.array(rows), np.random.default_rng(seed), None
    h = q3.COVERAGE * len(m)
    floor = q3.ROUNDING * np.eye(q3.P)
    for k in range(starts):
        part = m if k == 0 else m[rng.choice(len(m), min(len(m), q3.P + 1), replace=False)]
        centre, scatter = np.median(part, 0) if k == 0 else part.mean(0), np.cov(part.T, bias=True).reshape(q3.P, q3.P) + floor
        for _ in range(100):
            order = np.argsort(squared(m, centre, scatter), kind="stable")
            w = np.clip(h - np.arange(len(m)), 0, 1)
            x = m[order]
            c = (w[:, None] * x).sum(0) / w.sum()
            s = (w[:, None] * (x - c)).T @ (x - c) / w.sum() + floor
            if np.allclose(c, centre, atol=1e-12) and np.allclose(s, scatter, atol=1e-12):
                break
            centre, scatter = c, s
        if best is None or np.linalg.slogdet(scatter)[1] < np.linalg.slogdet(best[1])[1]:
            best = centre, scatter
    return len(m), *best


def squared(m, centre, scatter):
    return np.einsum("ij,jk,ik->i", m - centre, np.linalg.inv(scatter), m - centre)


def quality_distances(docs, fit=mcd):
    """{doc_id: squared distance} of rows (doc_id, text, lang, source) that pass the base rules."""
    rows = quality_vectors(docs)
    groups = {}
    for lang, source, v in sorted(set(rows.values()), key=str):  # equal vectors of a source count once
        for g in ((), (lang,), (lang, source)):
            groups.setdefault(g, []).append(v)
    fitted = {g: fit(v) for g, v in groups.items()}
    final, middles = {}, {}
    for g in groups:
        if len(g) == 2:
            _, centre, scatter = fitted[()]
            for n, c, s in (fitted[g[:1]], fitted[g]):
                w = n / (n + q3.PRIOR)
                mixed = w * s + (1 - w) * scatter
                # in the coordinates where the base is the unit, by its symmetric root
                value, vector = np.linalg.eigh(scatter)
                root = vector * np.sqrt(value) @ vector.T
                inner = np.linalg.inv(root) @ mixed @ np.linalg.inv(root)
                value, vector = np.linalg.eigh((inner + inner.T) / 2)
                scatter = root @ (vector * np.maximum(value, q3.TIGHT)) @ vector.T @ root
                centre = w * c + (1 - w) * centre
            final[g] = centre, scatter
            d = squared(np.array(groups[g]), centre, scatter)
            for part in (g, g[:1], ()):
                middles.setdefault(part, []).extend(d)
    out = {}
    for d, (lang, source, v) in rows.items():
        scale = None
        for g in ((), (lang,), (lang, source)):
            n, m = len(middles[g]), np.log(np.median(middles[g]))
            scale = m if scale is None else (n * m + q3.PRIOR * scale) / (n + q3.PRIOR)
        out[d] = squared(np.array([v]), *final[lang, source])[0] / (np.exp(scale) / q3.MEDIAN)
    return out
