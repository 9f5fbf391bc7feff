"""Evaluation texts leaking into training text (problem 8).

Method: CGK embedding. A walk over a window of words emits the word it stands on at each step and
moves on by a random bit that depends on the word and the step, the same for all texts; windows at
a small edit distance get embeddings at a small Hamming distance. Bit sampling hashes a few sampled
positions of the embedding, in TABLES tables. Walk and tables are repeated, with other bits, until
the target recall is reached; windows of a document and of an item that agree in any table are
compared exactly, by the edit distance of the item's window to the nearest run of the document that
begins there, which may be longer or shorter.

Every window of every document counts. One edit breaks two pairs of neighbouring words at most, so a
window with fewer word pairs of the items than twelve words keep after the allowed edits can't
match and isn't embedded; this leaves out no match. A window that equals an item's window agrees
with it in all tables, so exact passages are always found; the number of walks sets the recall for
edited ones. A longer passage with at most a sixth of its words edited holds a window of twelve
words with two edits or fewer, so windows of one size serve items of every length. Items are
indexed in blocks of bounded size, each of which takes one pass over the documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhetorica.llm.forms import default_folder

WINDOW = 12  # words of a window
TABLES = 8  # of one walk
SAMPLED = 4  # positions of the embedding that a table looks at
RECALL = 0.9  # wanted for every place and kind of edits
ONE_WALK = (1.0, 0.45, 0.175)  # chance that the tables of one walk find a passage with so many words edited, at the least favourable places
BLOCK = 65_536  # windows that are embedded at once
BLOCK_WINDOWS = 80_000  # windows of items in one index, which a task holds
PAIR_BITS = 22  # size of the bit table of word pairs
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_PAD = np.uint64(0x1234567)
_C = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> str:
    """Text without markup, in consistent form."""
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = unescape(text)
    return default_folder()(text)


def word_hashes(texts: list[str | None], known: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word (identity, bits of the walk) and the number of words of each text."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pa.array([plain(t) for t in texts], pa.string())), r"[^\pL\pN]+")
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    enc = flat.dictionary_encode()
    pairs = []
    for w in enc.dictionary.to_pylist():
        h = known.get(w)
        if h is None:
            h = (xxhash.xxh3_64_intdigest(w), xxhash.xxh3_64_intdigest(w, 7))
            if len(known) < 1_000_000:
                known[w] = h
        pairs.append(h)
    lut = np.array(pairs, np.uint64).reshape(-1, 2)
    idx = enc.indices.to_numpy()[full]
    return lut[idx, 0], lut[idx, 1], np.bincount(rows[full], minlength=len(texts))


def window_starts(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows in the concatenated words, and the text of each."""
    counts = np.maximum(lengths - window + 1, 0)
    first = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[text] + within, text


def walks_for(most_edits: int, recall: float = RECALL) -> int:
    """Walks after which a passage with ``most_edits`` words edited is found with a chance of ``recall``."""
    one = ONE_WALK[most_edits] if most_edits < len(ONE_WALK) else ONE_WALK[-1] ** (most_edits - 1)
    return 1 if one >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - one))


def sampled_positions(window: int, tables: int, sampled: int, seed: int = 11) -> list[np.ndarray]:
    """Positions of each table, among the steps that a walk takes on average to reach the end: one of
    each of ``sampled`` stretches, so that they seldom hold the same word."""
    rng = np.random.default_rng(seed)
    ends = np.linspace(0, 2 * window, sampled + 1).astype(int)
    return [rng.integers(ends[:-1], ends[1:]) for _ in range(tables)]


def embed_keys(ident: np.ndarray, walk: np.ndarray, start: np.ndarray, end: np.ndarray, turn: int, tables: list[np.ndarray]) -> np.ndarray:
    """Keys (tables x windows) of the windows from ``start`` to before ``end``, by walk number ``turn``."""
    rng = np.random.default_rng(1000 + turn)
    bits = (walk ^ rng.integers(1 << 62, dtype=np.uint64)) * (rng.integers(1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    bits ^= bits >> np.uint64(32)
    bits *= _C
    keys = np.zeros((len(tables), len(start)), np.uint64)
    at = start.copy()
    for step in range(max(int(t[-1]) for t in tables) + 1):
        here = np.minimum(at, len(ident) - 1)
        inside = at < end
        own = [k for k, t in enumerate(tables) if step in t]
        if own:
            symbol = np.where(inside, ident[here], _PAD) * (rng.integers(1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            for k in own:
                keys[k] += symbol
        else:
            rng.integers(1 << 62, dtype=np.uint64)
        at += ((bits[here] >> np.uint64(63 - step % 64)) & np.uint64(1)).astype(np.int64) * inside
    return keys


def word_pairs(ident: np.ndarray) -> np.ndarray:
    """A place in the bit table for each two neighbouring words."""
    return ((ident[:-1] * _C + (ident[1:] ^ (ident[1:] >> np.uint64(31)))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distance of each row of ``a`` to the same row of ``b`` (n x window words), most + 1 where it is larger."""
    return _last_cells(a, b, most)[most]


def passage_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Least edit distance of each row of ``a`` to a beginning of the same row of ``b``, which has
    ``most`` words more; most + 1 where it is larger."""
    return np.minimum.reduce(_last_cells(a, b, most))


def _last_cells(a: np.ndarray, b: np.ndarray, most: int) -> list[np.ndarray]:
    """Edit distances of the rows of ``a`` to the first w - most ... w + most words of the rows of ``b``."""
    n, w = len(a), b.shape[1]
    big = np.full(n, most + 1, np.int16)
    row = [np.full(n, o if 0 <= o <= w else most + 1, np.int16) for o in range(-most, most + 1)]  # row[o + most] is cell (i, i + o)
    for i in range(1, a.shape[1] + 1):
        new = []
        for k, o in enumerate(range(-most, most + 1)):
            j = i + o
            if j < 0 or j > w:
                new.append(big)
                continue
            best = row[k] + (a[:, i - 1] != b[:, j - 1]) if j else np.full(n, i, np.int16)
            if j and k + 1 < len(row):
                best = np.minimum(best, row[k + 1] + 1)
            if j and k:
                best = np.minimum(best, new[k - 1] + 1)
            new.append(np.minimum(best, big))
        row = new
    return row


class ItemIndex:
    """Keys of all windows of the items, in the tables of each walk."""

    def __init__(self, items: list[tuple[int, str]], window: int, walks: int, tables: int, sampled: int) -> None:
        self.window = window
        self.walks = [sampled_positions(window, tables, sampled, 11 + turn) for turn in range(walks)]
        self.ids = [i for i, _ in items]
        ident, walk, lengths = word_hashes([t for _, t in items], {})
        start, text = window_starts(lengths, window)
        self.words, self.start, self.item = ident, start, text
        self.keys, self.refs = [], []
        for turn, tabs in enumerate(self.walks):
            for k in embed_keys(ident, walk, start, start + window, turn, tabs):
                order = np.argsort(k, kind="stable")
                self.keys.append(k[order])
                self.refs.append(order.astype(np.int32))
        self.filters = []  # a bit table before the search
        self.bits = 18
        for k in self.keys:
            f = np.zeros(1 << self.bits, bool)
            f[(k >> np.uint64(64 - self.bits)).astype(np.int64)] = True
            self.filters.append(f)

        own = np.ones(max(len(ident) - 1, 0), bool)  # pairs within one item
        own[np.cumsum(lengths)[:-1][(np.cumsum(lengths)[:-1] > 0) & (np.cumsum(lengths)[:-1] < len(ident))] - 1] = False
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        self.pairs[word_pairs(ident)[own]] = True

    def plausible(self, ident: np.ndarray, start: np.ndarray, stop: np.ndarray, most_edits: int) -> np.ndarray:
        """Which windows hold as many word pairs of the items as a match with ``most_edits`` edits has at least."""
        held = np.r_[0, np.cumsum(self.pairs[word_pairs(ident)])]
        end = np.minimum(start + self.window, stop)
        return held[np.maximum(end - 1, start)] - held[start] >= self.window - 1 - 2 * most_edits

    def candidates(self, ident: np.ndarray, walk: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window of the text, window of an item) that agree in a table."""
        found = []
        for lo in range(0, len(start), BLOCK):
            both = []
            for turn, tabs in enumerate(self.walks):
                for t, k in enumerate(embed_keys(ident, walk, start[lo : lo + BLOCK], end[lo : lo + BLOCK], turn, tabs), turn * len(tabs)):
                    hit = np.flatnonzero(self.filters[t][(k >> np.uint64(64 - self.bits)).astype(np.int64)])
                    a, b = np.searchsorted(self.keys[t], k[hit], "left"), np.searchsorted(self.keys[t], k[hit], "right")
                    n = b - a
                    ref = self.refs[t][np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    both.append((np.repeat(hit, n) + lo) * len(self.start) + ref)
            found.append(np.unique(np.concatenate(both)))
        every = np.concatenate(found) if found else np.zeros(0, np.int64)
        return every // max(len(self.start), 1), every % max(len(self.start), 1)


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, most_edits: int = 2, tables: int = TABLES, sampled: int = SAMPLED, recall: float = RECALL, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, item_id, distance, windows) for each document that holds ``window`` words of an item
    with ``most_edits`` words replaced, inserted or left out, or less: the least number of edits, and
    at how many places of the document such a passage begins. Passages with edits are found with a
    chance of ``recall`` or more, those without always.

    Documents are never cut. Null or empty texts and texts shorter than a window match nothing;
    an item shorter than a window can't be found; an empty table gives no rows. Items are taken in
    blocks of about ``block_windows`` windows by a hash of their id, so that the driver and each task
    hold one block; every block takes a pass over the documents.
    """
    rows = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    # A text has fewer words than half its characters and one.
    size = rows.agg(F.sum(F.floor(F.length("text") / 2) + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_windows))
    found = None
    for k in range(blocks):
        block = sorted(tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect())
        part = _search(documents, ItemIndex(block, window, walks_for(most_edits, recall), tables if most_edits else 1, sampled), most_edits)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("windows").alias("windows"))


def _search(documents: DataFrame, index: ItemIndex, most_edits: int) -> DataFrame:
    """(doc_id, item_id, distance, windows) for the items of one index; repeated rows give repeated results."""
    window = index.window

    def find(batches: Iterable[pa.RecordBatch]):
        known: dict[str, tuple[int, int]] = {}
        span, wide = np.arange(window), np.arange(window + most_edits)
        for big in batches:
            for k in range(0, big.num_rows, 1_000):
                b = big.slice(k, 1_000)
                ident, walk, lengths = word_hashes(b.column(1).to_pylist(), known)
                start, text = window_starts(lengths, window - most_edits)
                stop = np.cumsum(lengths)[text]  # of the text
                if not len(start) or not len(index.start):
                    continue
                may = index.plausible(ident, start, stop, most_edits)
                start, text, stop = start[may], text[may], stop[may]
                if not len(start):
                    continue
                x, y = index.candidates(ident, walk, start, np.minimum(start + window, stop))
                best: dict[tuple[int, int], int] = {}
                near: dict[tuple[int, int], int] = {}
                for lo in range(0, len(x), BLOCK):
                    wx, wy = x[lo : lo + BLOCK], y[lo : lo + BLOCK]
                    at = start[wx][:, None] + wide
                    here = np.where(at < stop[wx][:, None], ident[np.minimum(at, len(ident) - 1)], _PAD)
                    d = passage_distances(index.words[index.start[wy][:, None] + span], here, most_edits)
                    wx, wy, d = wx[d <= most_edits], wy[d <= most_edits], d[d <= most_edits]
                    for doc, item, least in zip(text[wx].tolist(), index.item[wy].tolist(), d.tolist()):
                        best[doc, item] = min(least, best.get((doc, item), least))
                    for doc, item, _ in np.unique(np.stack([text[wx], index.item[wy], wx]), axis=1).T.tolist():
                        near[doc, item] = near.get((doc, item), 0) + 1
                if best:
                    ids = b.column(0).to_pylist()
                    keys = sorted(best)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([ids[d] for d, _ in keys], pa.int64()), "item_id": pa.array([index.ids[i] for _, i in keys], pa.int64()),
                        "distance": pa.array([best[q] for q in keys], pa.int32()), "windows": pa.array([near[q] for q in keys], pa.int64()),
                    })

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return docs.mapInArrow(find, "doc_id bigint, item_id bigint, distance int, windows bigint")
