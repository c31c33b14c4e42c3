"""Problem 6: evaluation texts that leaked into training texts.

Pigeonhole edit matching. An item's text is cut into pieces so that every window of `min_words` words holds
max_edits + 1 whole pieces side by side; a passage with at most `max_edits` wrong words then holds at least one piece unharmed. The items stay a
table. Of their pieces a bit map of fixed size (`BITS`) goes to the tasks that read the pages, once and whole: what the map does not know is no
piece. Pages are cut to words and hashed many at a time, as arrays of letters. The few places that the map does know are joined with the pieces on their hash, carrying the words around them, and each exact hit is verified by Myers'
bit-parallel distance (over words) of the item's windows around that piece. More items fill the map and let more places pass, but none
is lost, and neither side is collected; a piece that many items or pages hold is a skewed join key, which adaptive execution splits.

Cases: null or empty pages and items match nothing; items shorter than `min_words` words match nothing; a null item_id is
skipped; items that repeat give one row per page; an empty table gives no row; only doc_id, text and the
named item columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NOT_WORD = re.compile(r"[\W_]+")
BITS = 1 << 25
PART = 1 << 18  # letters whose words a task holds at a time, or one page
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd: has an inverse
_POWERS: list[np.ndarray] = []
_ODD = re.compile("[\u0130\u03a3\U00010000-\U0010ffff]")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _NOT_WORD.sub(" ", text.lower()).split()


def infix_distance(pattern: list[str], text: list[str]) -> int:
    """Fewest added, dropped or replaced words that turn some passage of text into pattern (Myers' bit vectors)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        best = min(best, score)
    return best


def pieces(n_words: int, min_words: int, max_edits: int) -> tuple[int, list[int]]:
    """Length and starts of the pieces: any window of min_words words holds max_edits + 1 of them whole."""
    length = (min_words + 1) // (max_edits + 2)
    return length, list(range(0, n_words - length + 1, length))


@cache
def _letters() -> np.ndarray:
    """For each character below U+10000 its lower case, 0 if that is no letter or digit."""
    low = [chr(c).lower() for c in range(1 << 16)]
    return np.array([ord(x) if len(x) == 1 and x.isalnum() else 0 for x in low], np.uint32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _BASE and of its inverse modulo 2 ** 64, n or more."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * PART)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words() of all texts, without an object for each: lower-case letters (0 between words), where words start and end in them, and how many each text has.

    A text with a character beyond U+FFFF, or one whose lower case isn't one character for itself alone, goes through words()."""
    texts = [" ".join(words(t)) if not t.isascii() and _ODD.search(t) else t for t in texts]
    c = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    low = _letters()[np.minimum(c, 0xFFFF)]
    far = np.flatnonzero(c > 0xFFFF)
    low[far] = c[far]  # of words already
    edge = np.flatnonzero(np.diff(low != 0, prepend=False, append=False))
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    return low, edge[::2], edge[1::2], np.diff(np.searchsorted(edge[::2], begin), append=len(edge) // 2)


def run_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each run of `length` words within a text, its first word by number among all, and the text it is of (of what word_places gives).

    A word's hash is a polynomial of its letters, a difference of two prefix sums; equal words have equal hashes, and clashes are told when words are compared."""
    power, inverse = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(low * power[: len(low)], out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    h = (h ^ (h >> np.uint64(32))) * _MULT
    many = max(0, len(h) - length + 1)
    out = np.zeros(many, np.uint64)
    for i in range(length):
        out ^= h[i : i + many]
        out *= _MULT
        out ^= out >> np.uint64(31)
    text = np.repeat(np.arange(len(n)), n)
    whole = np.flatnonzero(text[:many] == text[length - 1 :])
    return out[whole], whole, text[whole]


def _in_parts(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Pages in parts of about PART letters, one page at least."""
    ends = np.cumsum([len(t) for t in texts]) // PART
    cut = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    return ((ids[a:b], texts[a:b]) for a, b in zip(cut, cut[1:]) if a < b)


def item_pieces(items: DataFrame, fields: list[str], min_words: int, max_edits: int) -> DataFrame:
    """piece (hash), item_id, field, start (of the piece within around), around: the words of all windows that hold the piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for i, f, t in zip(x["item_id"], x["field"], x["text"]):
                w = words(t)
                if len(w) < min_words:
                    continue
                length, starts = pieces(len(w), min_words, max_edits)
                h, *_ = run_hashes(*word_places([t]), length)
                for s in starts:
                    lo = max(0, s + length - min_words)
                    out.append((int(h[s].astype(np.int64)), i, f, s - lo, " ".join(w[lo : s + min_words])))
            yield pd.DataFrame(out, columns=["piece", "item_id", "field", "start", "around"])

    parts = [items.select(F.col("item_id").cast("string").alias("item_id"), F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]
    rows = reduce(DataFrame.unionByName, parts).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    return rows.mapInPandas(run, "piece long, item_id string, field string, start int, around string").distinct()


def bit_map(found: DataFrame) -> np.ndarray:
    """Which hashes occur in found(piece), modulo BITS, as bits: tasks make maps, tasks join them part by part, the driver gets the whole, BITS / 8 bytes."""
    parts = 32

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros(BITS, bool)
        for x in batches:
            m[x["piece"].to_numpy(np.int64).astype(np.uint64) % np.uint64(BITS)] = True
        m = np.packbits(m).reshape(parts, -1)
        yield pd.DataFrame([(i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(m) if p.any()], columns=["part", "bits"])

    def join(g: pd.DataFrame) -> pd.DataFrame:
        m = reduce(np.bitwise_or, [np.frombuffer(zlib.decompress(b), np.uint8) for b in g["bits"]])
        return pd.DataFrame({"part": [g["part"].iloc[0]], "bits": [zlib.compress(m.tobytes(), 1)]})

    out = np.zeros((parts, BITS // 8 // parts), np.uint8)
    for r in found.select("piece").mapInPandas(mark, "part int, bits binary").groupBy("part").applyInPandas(join, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return out.ravel()


def _fewest_edits(passage: list[str], at: int, around: list[str], start: int, length: int, min_words: int, max_edits: int) -> int:
    """Fewest wrong words of the item's windows that hold its piece, matched against the page around the piece's hit; more than max_edits if the piece
    itself differs (a clash of hashes)."""
    best = max_edits + 1
    if around[start : start + length] != passage[at : at + length]:
        return best
    for a in range(max(0, start + length - min_words), min(start, len(around) - min_words) + 1):
        lo = at - (start - a) - max_edits
        best = min(best, infix_distance(around[a : a + min_words], passage[max(0, lo) : max(0, lo) + min_words + 2 * max_edits + min(lo, 0)]))
        if not best:
            break
    return best


def leaks(docs: DataFrame, items: DataFrame, fields: list[str], min_words: int = 12, max_edits: int = 1) -> DataFrame:
    """(doc_id, item_id, field, n_edits): pages that hold min_words consecutive words of an item's field with at most
    max_edits wrong words; n_edits is the fewest. n_edits = 0 is an exact passage."""
    found = item_pieces(items, fields, min_words, max_edits)
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(found))
    length, _ = pieces(min_words, min_words, max_edits)
    side = min_words - length + max_edits  # words that a window may hold on either side of a piece

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for x in batches:
            out = []
            for ids, texts in _in_parts(x["doc_id"].tolist(), x["text"].tolist()):
                low, start, end, n = word_places(texts)
                h, first, page = run_hashes(low, start, end, n, length)
                slot = h % np.uint64(BITS)
                hits = np.flatnonzero((bits[slot >> np.uint64(3)] >> (7 - (slot & np.uint64(7)).astype(np.uint8))) & 1)
                own, last = (np.cumsum(n) - n)[page[hits]], np.cumsum(n)[page[hits]]  # the page's words, by number
                lo, hi = np.maximum(own, first[hits] - side), np.minimum(last, first[hits] + length + side)
                low[low == 0] = 32
                for g, p, a, d, i in zip(h[hits].astype(np.int64).tolist(), page[hits].tolist(), start[lo].tolist(), end[hi - 1].tolist(), (first[hits] - lo).tolist()):
                    out.append((ids[p], g, i, " ".join(low[a:d].tobytes().decode("utf-32-le").split())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "at", "passage"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for z in batches:
            e = [_fewest_edits(p.split(), a, r.split(), s, length, min_words, max_edits) for p, a, r, s in zip(z["passage"], z["at"], z["around"], z["start"])]
            z = z[["doc_id", "item_id", "field"]].assign(n_edits=np.array(e, np.int32))
            yield z[z["n_edits"] <= max_edits]

    kind = docs.schema["doc_id"].dataType.simpleString()
    pages = docs.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    hits = pages.mapInPandas(scan, f"doc_id {kind}, piece long, at int, passage string").join(found, "piece")
    checked = hits.select("doc_id", "item_id", "field", "at", "passage", "start", "around").mapInPandas(verify, f"doc_id {kind}, item_id string, field string, n_edits int")
    return checked.groupBy("doc_id", "item_id", "field").agg(F.min("n_edits").alias("n_edits"))
