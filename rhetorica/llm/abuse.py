"""Abusive, hateful or sexual content (problem 9).

Method: a support vector machine with a subsequence string kernel, approximated by Nyström
landmarks. The kernel counts common subsequences of characters within a short reach, gaps allowed
and weighted down by their length, so inserted, replaced or masked characters cost only a part of
the similarity. Documents are scored sentence by sentence and take the score of their worst
sentence; since labels are given for documents, training picks the guilty sentences of marked
documents in turns with fitting (multiple-instance learning).

The decision is a sum over landmarks of kernel values, each of which is a sum over subsequences.
So the trained model collapses into one weight per subsequence, exactly, and scoring a text takes
one pass over its characters, however many landmarks there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhetorica.llm.forms import default_folder

ORDER = 4  # characters of a subsequence
REACH = 6  # characters from its first to its last
WITNESS = -0.3  # least score of the worst sentence of a marked document for it to be a case
SHORTEST = 16  # shorter texts are normed like texts of so many subsequences, so that fragments don't weigh more
DECAY = 0.7  # weight of each further character of a gap
BITS = 20  # subsequences are hashed to 2 ** BITS places
SHARED = 32  # landmarks that share a subsequence, from which it is treated as a column of a dense matrix
POSITIVE = 2.0  # weight of an abusive sentence against a harmless one that occurs once
LANDMARKS = 600
MOST_DOCUMENTS = 12_000  # labelled documents used for training, at most; the rest only by chance of their hash
TRAIN_CHARS = 20_000  # characters of a document used for training; of longer ones, sentences are drawn by their hash
MOST_CHARS = 100_000_000  # characters of all of them together
MOST_SENTENCES = 24_000  # sentences of unmarked documents used for training, at most, the most frequent first
SHAPES = [(0, *rest) for rest in combinations(range(1, REACH), ORDER - 1)]
_DIGIT = re.compile(r"\d+")
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


# Short forms whose stop doesn't end a sentence, for the rough division below.
_SHORT = re.compile(r"(?:^|[\s(\"'«„“])(?:mr|mrs|ms|dr|prof|sen|gov|rep|gen|lt|no|vs|etc|jan|feb|aug|sept|oct|nov|dec|sr|sra|dra|mme|m|z\.b|d\.h|e\.g|i\.e|г|млн|проф|т\.е|डॉ|[^\W\d_]|[^\W\d_]\.[^\W\d_])\.$")
_CUT = re.compile(r"(?<=[.!?…।؟])[\"'”’»)\]]*\s+|(?<=[。！？!?])(?=[\u2e80-\uffff])|\n+")


def sentences_of(text: str | None) -> list[str]:
    """Rough sentence pieces in consistent form and lower case, digits made alike; nothing of the
    text is left out. A stop only ends a piece before white space, so that a masked word such as
    ``a.b.c`` stays whole."""
    if not text:
        return []
    out: list[str] = []
    for p in _CUT.split(_DIGIT.sub("0", default_folder()(text).lower())):
        p = p.strip() if p else ""
        if p:
            if out and _SHORT.search(out[-1]):
                out[-1] += " " + p
            else:
                out.append(p)
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, weight, text number) of every subsequence occurrence of every text."""
    gap = chr(0) * REACH
    joined = gap.join(texts) + gap
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), lengths + REACH)
    inner = np.flatnonzero(cps[: len(cps) - REACH] != 0)
    places, weights, rows = [], [], []
    for shape in SHAPES:
        last = inner + shape[-1]
        ok = inner[cps[last] != 0]
        h = np.zeros(len(ok), np.uint32)
        for k, off in enumerate(shape):
            h += cps[ok + off] * _ODD[k]
            h ^= h >> np.uint32(15)
        places.append(((h * _ODD[4]) >> np.uint32(32 - BITS)).astype(np.int64))
        weights.append(np.full(len(ok), DECAY ** (shape[-1] + 1 - ORDER), np.float32))
        rows.append(row[ok])
    return np.concatenate(places), np.concatenate(weights), np.concatenate(rows)


def self_weight(n_chars: np.ndarray) -> np.ndarray:
    """The norm that divides a text's kernel values: that of a text without repeated subsequences."""
    total = sum(DECAY ** (2 * (s[-1] + 1 - ORDER)) for s in SHAPES)
    return np.sqrt(np.maximum(n_chars - ORDER + 1, SHORTEST) * total)


@dataclass
class Model:
    """weights: one per place of the hashed subsequences; the score of a text is their sum over
    its subsequences, over its norm, plus the bias; above 0 it counts as abusive."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """One pass over the characters: per shape a hash, a look-up and a running sum."""
        if not texts:
            return np.zeros(0)
        gap = chr(0) * REACH
        cps = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(lengths + REACH) - lengths - REACH
        n = len(cps) - REACH
        per = np.zeros(n, np.float32)
        prefix: dict[tuple, np.ndarray] = {}
        ends = start + lengths
        # Where a shape would reach over its text's end: the last characters of each text and the gap behind it.
        over = {last: (ends[:, None] + np.arange(-last, REACH)[None, :]).ravel() for last in {s[-1] for s in SHAPES}}
        over = {last: at[(at >= 0) & (at < n)] for last, at in over.items()}
        for shape in SHAPES:
            h = None
            for k, off in enumerate(shape):  # shapes that begin alike share the hash so far
                key = shape[: k + 1]
                if key in prefix:
                    h = prefix[key]
                    continue
                new = cps[off : off + n] * _ODD[k]
                if h is not None:
                    new += h
                new ^= new >> np.uint32(15)
                h = new
                if k < ORDER - 1:
                    prefix[key] = h
            h *= _ODD[4]
            h >>= np.uint32(32 - BITS)
            value = self.weights.take(h)
            value[over[shape[-1]]] = 0
            if shape[-1] + 1 > ORDER:
                value *= np.float32(DECAY ** (shape[-1] + 1 - ORDER))
            per += value
        total = np.add.reduceat(np.r_[per, np.zeros(REACH, np.float32)].astype(np.float64), start)
        return total / self_weight(lengths) + self.bias


def kernel(texts: list[str], landmarks: list[str], onto: np.ndarray | None = None) -> np.ndarray:
    """Kernel values of texts and landmarks (texts x landmarks), times ``onto`` if it is given; in small blocks."""
    lp, lw, lr = features(landmarks)
    key = lp * len(landmarks) + lr
    order = np.argsort(key, kind="stable")
    key, lw = key[order], lw[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    lw = np.add.reduceat(lw, first) if len(first) else lw
    lp, lr = key[first] // len(landmarks), key[first] % len(landmarks)
    count = np.bincount(lp, minlength=1 << BITS).astype(np.int32)
    # Places that many landmarks share go through a dense product, the others are looked up one by one.
    heavy = np.flatnonzero(count >= SHARED)
    column = np.full(1 << BITS, -1, np.int32)
    column[heavy] = np.arange(len(heavy))
    dense = np.zeros((len(heavy), len(landmarks)), np.float32)
    is_heavy = column[lp] >= 0
    dense[column[lp[is_heavy]], lr[is_heavy]] = lw[is_heavy]
    lp, lr, lw = lp[~is_heavy], lr[~is_heavy], lw[~is_heavy]
    count[heavy] = 0
    begin = (np.cumsum(count) - count).astype(np.int32)
    norm = lambda ts: self_weight(np.array([len(t) for t in ts]))
    own = norm(landmarks)[None, :]
    out = np.zeros((len(texts), len(landmarks) if onto is None else onto.shape[1]), np.float32)
    for lo in range(0, len(texts), 64):
        part = texts[lo : lo + 64]
        p, w, r = features(part)
        c = column[p]
        at = c >= 0
        x = np.bincount(r[at] * len(heavy) + c[at], weights=w[at], minlength=len(part) * len(heavy)).astype(np.float32).reshape(len(part), len(heavy))
        keep = count[p] > 0
        p, w, r = p[keep], w[keep], r[keep]
        n = count[p]
        at = np.repeat(begin[p] - np.cumsum(n) + n, n) + np.arange(n.sum())
        flat = np.bincount(np.repeat(r, n) * len(landmarks) + lr[at], weights=np.repeat(w, n) * lw[at], minlength=len(part) * len(landmarks))
        block = (flat.reshape(len(part), len(landmarks)) + x @ dense) / norm(part)[:, None] / own
        out[lo : lo + 64] = block if onto is None else block @ onto
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, start: tuple[np.ndarray, float] | None = None, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps, from ``start`` if given; y is -1 or 1. Rows are used
    in blocks, without copies of the whole."""
    d = x.shape[1] + 1
    w = np.zeros(d) if start is None else np.r_[start[0], start[1]]
    for _ in range(rounds):
        h, g = np.eye(d), np.zeros(d)
        h[-1, -1] = 1e-3
        for lo in range(0, len(x), 4_096):
            b, t, v = x[lo : lo + 4_096], y[lo : lo + 4_096], weight[lo : lo + 4_096]
            on = t * (b @ w[:-1].astype(np.float32) + w[-1]) < 1
            if on.any():
                b = np.sqrt(2 * c * v[on]).astype(np.float32)[:, None] * np.c_[b[on], np.ones(int(on.sum()), np.float32)]
                h += b.T @ b
                g += b.T @ (np.sqrt(2 * c * v[on]) * t[on]).astype(np.float32)
        new = np.linalg.solve(h, g)
        done = np.abs(new - w).max() < 1e-4
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def train(docs: list[tuple[str, float]], landmarks: int = LANDMARKS, c: float = 3.0, rounds: int = 6, most_sentences: int = MOST_SENTENCES, seed: int = 7) -> Model:
    """A model from (text, share of reviewers that marked it) pairs; without marked or without
    unmarked documents it never finds anything."""
    zero = Model(np.zeros(1 << BITS, np.float32), -1.0)
    bags = [(distinct_texts(sentences_of(t)), m) for t, m in docs]
    inside: Counter = Counter(s for ss, m in bags if m >= 0.5 for s in ss)
    outside: Counter = Counter(s for ss, m in bags if m < 0.5 for s in ss)
    # A sentence that unmarked documents hold more often than marked ones is harmless, and the reverse isn't.
    bad = [own for ss, m in bags if m >= 0.5 and (own := [s for s in ss if inside[s] >= outside[s]])]
    clean = sorted(s for s in outside if inside[s] < outside[s])
    if not bad or not clean:
        return zero
    if len(clean) > most_sentences:
        # those that occur most often first, among equals by their hash
        clean = sorted(sorted(clean, key=lambda s: (-outside[s], xxhash.xxh3_64_intdigest(s, seed + 1), s))[:most_sentences])
    suspects = [s for b in bad for s in b]
    bag_of = np.repeat(np.arange(len(bad)), [len(b) for b in bad])
    half = landmarks // 2
    # by hash, so that a sentence more or less doesn't change all the others
    pick = lambda xs, n: sorted(xs, key=lambda x: (xxhash.xxh3_64_intdigest(x, seed), x))[:n]
    # Landmarks: of each marked document the sentences whose subsequences are most its own kind's, as
    # long as they differ from each other, and a sample of harmless ones.
    odds = own_kind(suspects, pick(clean, 4 * len(suspects)))
    best = sorted((i for b in range(len(bad)) for own in [np.flatnonzero(bag_of == b)] for i in own[np.argsort(-odds[own])[:2]]), key=lambda i: -odds[i])
    marks = different(distinct_texts(suspects[i] for i in best), landmarks - half // 2) + pick(clean, half)
    k = kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    keep = values > 1e-3 * values[-1]
    to = vectors[:, keep] / np.sqrt(values[keep])
    xc, xs = kernel(clean, marks, to), kernel(suspects, marks, to)
    often = np.sqrt([outside[s] for s in clean])
    # First all suspects count as cases: forms of sentence that unmarked documents hold as well are outvoted.
    w, bias = fit_svm(np.r_[xs, xc], np.r_[np.ones(len(xs)), -np.ones(len(xc))], np.r_[np.full(len(xs), 0.5), often], c)
    chosen = np.zeros(0, int)
    for _ in range(rounds):
        s = xs @ w + bias
        top = np.array([own[np.argmax(s[own])] for b in range(len(bad)) for own in [np.flatnonzero(bag_of == b)]])
        new = top[s[top] > WITNESS]  # reviewers err, so a marked document without a suspicious sentence has no case
        if not len(new) or np.array_equal(new, chosen):
            break
        chosen = new
        ok = xc @ w + bias < 0.5  # nor are unmarked documents free of cases
        x = np.r_[xs[chosen], xc[ok]]
        w, bias = fit_svm(x, np.r_[np.ones(len(chosen)), -np.ones(int(ok.sum()))], np.r_[np.full(len(chosen), POSITIVE), often[ok]], c, (w, bias))
    beta = to @ w
    p, wt, r = features(marks)
    norm = self_weight(np.array([len(m) for m in marks]))
    table = np.bincount(p, weights=wt * (beta / norm)[r], minlength=1 << BITS)
    return Model(table.astype(np.float32), bias)


def different(texts: list[str], n: int, block: int = 500) -> list[str]:
    """The first ``n`` texts, in order, that aren't much like one taken before; in blocks, until there are enough."""
    taken: list[str] = []
    for lo in range(0, len(texts), block):
        part = texts[lo : lo + block]
        among = kernel(part, part)
        before = kernel(part, taken).max(axis=1) if taken else np.zeros(len(part))
        new: list[int] = []
        for i in range(len(part)):
            if len(taken) + len(new) < n and max(before[i], among[i, new].max() if new else 0) < 0.7 * among[i, i]:
                new.append(i)
        taken += [part[i] for i in new]
        if len(taken) >= n:
            break
    return taken


def own_kind(texts: list[str], others: list[str]) -> np.ndarray:
    """Mean log-odds of a text's subsequences among ``texts`` against ``others``."""

    def counts(ts: list[str]) -> np.ndarray:
        total = np.zeros(1 << BITS)
        for lo in range(0, len(ts), 256):
            p, w, _ = features(ts[lo : lo + 256])
            total += np.bincount(p, weights=w, minlength=1 << BITS)
        return total

    odds = np.log((counts(texts) + 0.1) / max(len(texts), 1)) - np.log((counts(others) + 0.1) / max(len(others), 1))
    out = np.zeros(len(texts))
    for lo in range(0, len(texts), 256):
        p, w, r = features(texts[lo : lo + 256])
        n = len(texts[lo : lo + 256])
        out[lo : lo + n] = np.bincount(r, weights=w * odds[p], minlength=n) / np.maximum(np.bincount(r, weights=w, minlength=n), 1e-9)
    return out


def distinct_texts(texts: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(texts))


def excerpt(text: str, most: int) -> str:
    """The text, or if it is longer than ``most`` characters as many of its sentences as fit, by the
    order of their hashes, in the order of the text; a sentence that is longer by itself is cut."""
    if len(text) <= most:
        return text
    parts = [p for p in _CUT.split(text) if p]
    room, kept = most, []
    for i in sorted(range(len(parts)), key=lambda i: (xxhash.xxh3_64_intdigest(parts[i]), i)):
        if len(parts[i]) < room:
            kept.append(i)
            room -= len(parts[i]) + 1
    return "\n".join(parts[i] for i in sorted(kept)) or text[:most]


def labelled_texts(documents: DataFrame, labels: DataFrame, most: int = MOST_DOCUMENTS, chars: int = MOST_CHARS) -> list[tuple[str, float]]:
    """Texts of at most ``most`` labelled documents, chosen by a hash of their id, with the share
    of reviewers that marked them: whole up to TRAIN_CHARS characters or an equal share of ``chars``,
    else an excerpt of that size. Null texts and null marks are left out."""
    mark = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("m"))
    mark = mark.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most ``most`` rows of two numbers, so it can be broadcast
    share = min(TRAIN_CHARS, chars // max(1, mark.count()))
    short = F.pandas_udf(lambda s: s.map(lambda t: excerpt(t, share)), "string")
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(mark), "doc_id").select("doc_id", "text", "m")
    cut = rows.where(F.length("text") <= share).unionByName(rows.where(F.length("text") > share).withColumn("text", short("text")))
    return [(r.text, float(r.m)) for r in sorted(cut.collect(), key=lambda r: (r.doc_id, r.text))]


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` but the text and earlier verdicts, with ``score`` (that of the worst sentence) and
    ``abusive``. Null and empty texts get a null score and aren't abusive. Texts are scored whole."""
    others = [c for c in documents.columns if c not in ("text", "score", "abusive")]
    sent = documents.sparkSession.sparkContext.broadcast(model)  # one table of 2 ** BITS weights, whatever the data

    @F.pandas_udf("double")
    def worst(texts):
        import pandas as pd

        out = np.full(len(texts), np.nan)
        pending, owner, size = [], [], 0

        def close():
            if pending:
                np.fmax.at(out, np.array(owner), sent.value.scores(pending))

        for i, t in enumerate(texts):
            for s in sentences_of(t if isinstance(t, str) else None):
                pending.append(s)
                owner.append(i)
                size += len(s)
                if size > 200_000:
                    close()
                    pending, owner, size = [], [], 0
        close()
        return pd.Series(out)

    score = worst("text")
    return documents.select(*others, score.alias("score")).withColumn("score", F.when(~F.isnan("score"), F.col("score"))).withColumn("abusive", F.coalesce(F.col("score") > 0, F.lit(False)))


def rates(scored_docs: DataFrame, by: str) -> DataFrame:
    """(by, documents, abusive, rate, mean_score) for each value of the column; null is a value of its own."""
    return scored_docs.groupBy(by).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("abusive").cast("bigint")).alias("abusive"), F.round(F.avg(F.col("abusive").cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score")
    )
