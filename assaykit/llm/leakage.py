"""Evaluation passages inside a corpus.

Q-gram lemma filtering: texts are reduced to their letters and digits; shared character q-grams of a
document and a question are counted in overlapping diagonal bands; bands with fewer than any region
within the edit budget must share are dropped; the rest is verified by a banded alignment of the
question's words.

The filter loses nothing. A stretch within the budget holds WHOLE successive question words unchanged: their
characters hold a q-gram, or, where they are fewer than Q characters, are searched for as they are. Bands are
as wide as the longest words of document and question can shift the diagonal.

The questions are the query set and are taken in blocks of bounded size, which every document is held against
where it was read: the corpus is read once, and nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.textnorm import squeezed
from assaykit.session import cut

Q = 12
#: Diagonals that one band spans at least; it is wider where words are long.
BAND = 48
#: So many successive words of a stretch are unchanged, wherever the differing ones are.
WHOLE = 6
#: Edits in the part of a stretch that is counted (under twice MIN_WORDS words).
PART_EDITS = 2
MIN_WORDS = 15
#: One word in so many may differ.
WORDS_PER_EDIT = 10
#: A block of questions has about so many characters at most; of more blocks than KEPT the index is made anew for each lot of documents.
BLOCK_CHARS, KEPT = 2_000_000, 4
#: Documents are held against all blocks in lots of about so many characters.
LOT_CHARS = 8_000_000
#: Documents are hashed in chunks of about so many characters.
CHUNK_CHARS = 500_000

_M = np.uint64(0x9E3779B97F4A7C15)


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all windows of Q codes, by doubling."""
    with np.errstate(over="ignore"):
        h1 = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        m2, m4 = _M * _M, _M * _M * _M * _M
        h2 = h1[:-1] * _M + h1[1:]
        h4 = h2[:-2] * m2 + h2[2:]
        h8 = h4[:-4] * m4 + h4[4:]
        h = h8[:-4] * m4 + h4[8:]
        return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _least_shared(sizes: list[int]) -> int:
    """Q-grams that any stretch within the edit budget shares with the question at least.

    A stretch of twice MIN_WORDS or more has a half that is within the budget too, so shorter ones
    suffice. An edit of a word spoils the q-grams that touch it.
    """
    least = None
    for first in range(len(sizes) - MIN_WORDS + 1):
        for last in range(first + MIN_WORDS, min(len(sizes), first + 2 * MIN_WORDS - 1) + 1):
            part = sizes[first:last]
            spoilt = sorted(part)[len(part) - (last - first) // WORDS_PER_EDIT :]
            shared = sum(part) - Q + 1 - sum(n + Q - 1 for n in spoilt)
            least = shared if least is None else min(least, shared)
    return max(1, least or 1)


class Questions:
    """The q-grams of a block of questions: sorted hashes, and for each where it stands."""

    def __init__(self, texts: list[str]):
        self.words: list[list[tuple[int, str]]] = []
        self.least = np.ones(max(1, len(texts)), dtype=np.int64)
        self.longest = np.ones(max(1, len(texts)), dtype=np.int64)
        #: Stretches of WHOLE words that have fewer characters than a q-gram: by their text, where they stand.
        self.short: dict[str, list[tuple[int, int]]] = {}
        hashes, body, place = [], [], []
        for k, text in enumerate(texts):
            words, n = [], 0
            for raw in text.split():
                w = squeezed(raw)[0]
                if w:
                    words.append((n, w))
                    n += len(w)
            self.words.append(words)
            whole = "".join(w for _, w in words)
            if len(words) < MIN_WORDS:
                continue
            for i in range(len(words) - WHOLE + 1):
                begin, end = words[i][0], words[i + WHOLE - 1][0] + len(words[i + WHOLE - 1][1])
                if end - begin < Q:
                    self.short.setdefault(whole[begin:end], []).append((k, begin))
            self.longest[k] = max(len(w) for _, w in words)
            self.least[k] = _least_shared([len(w) for _, w in words])
            if len(whole) >= Q:
                h = _grams(_codes(whole))
                hashes.append(h)
                body.append(np.full(len(h), k))
                place.append(np.arange(len(h)))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.keys, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.body = (np.concatenate(body) if body else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.bits = 22
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def occurrences(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in h, question, place in it) of every shared q-gram."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        at, k = at[ok], k[ok]
        n = self.first[k + 1] - self.first[k]
        rows = np.repeat(self.first[k], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return np.repeat(at, n), self.body[rows], self.place[rows]


def aligned(words: list[tuple[int, str]], text: str, starts: list[int], low: int, high: int) -> bool:
    """Is there a stretch of at least MIN_WORDS question words in `text`, at most one in WORDS_PER_EDIT differing?

    Word-wise alignment within the band of diagonals low .. high. A word of the question matches where its
    characters stand; between two matches lie question words that differ or are missing and words of the text in
    their place or put in, of which a hyphen may make two runs. The first and last word of the stretch must be
    whole words of the text; starts are the offsets at which its words begin.
    """
    most = max(1, len(words) // WORDS_PER_EDIT)
    begins = set(starts)
    # The last words' states: end of the match in the text -> longest stretch by edits.
    recent: list[dict[int, list[int]]] = []
    for place, word in words:
        size, states = len(word), {}
        p = text.find(word, max(0, place + low), place + high + size)
        while p >= 0:
            now = [-1] * (most + 1)
            if p in begins:
                now[0] = 1
            for back, before in enumerate(reversed(recent)):
                for end, old in before.items():
                    if end > p:
                        continue
                    runs = 0
                    if end < p:
                        first = bisect_left(starts, end)
                        runs = bisect_left(starts, p) - first + (end not in begins)
                        if runs > 2 * most:
                            continue
                    edits = max(back, (runs + 1) // 2)
                    for e in range(edits, most + 1):
                        if old[e - edits] > 0:
                            now[e] = max(now[e], old[e - edits] + back + 1)
            if p + size == len(text) or p + size in begins:
                for e in range(most + 1):
                    if now[e] >= MIN_WORDS and now[e] >= WORDS_PER_EDIT * e:
                        return True
            if max(now) > 0:
                states[p + size] = now
            p = text.find(word, p + 1, place + high + size)
        recent = [*recent[-most:], states]
    return False


def leaks_in(texts: list[str], questions: Questions) -> list[tuple[int, int]]:
    """(index of the text, index of the question) of every leak."""
    found, chunk, size = [], [], 0
    for i, t in enumerate(texts):
        s, starts = squeezed(t)
        if s:
            chunk.append((i, s, starts))
            size += len(s)
        if chunk and (size > CHUNK_CHARS or i == len(texts) - 1):
            found += _leaks(chunk, questions)
            chunk, size = [], 0
    if chunk:
        found += _leaks(chunk, questions)
    return found


def _longest_pairs(chunk: list[tuple[int, str, list[int]]]) -> np.ndarray:
    """The longest two successive words of each text, in characters."""
    out = []
    for _, s, starts in chunk:
        edges = np.array([*starts, len(s)])
        out.append(int((edges[2:] - edges[:-2]).max()) if len(edges) > 2 else len(s))
    return np.array(out, dtype=np.int64)


def _short_hits(chunk: list[tuple[int, str, list[int]]], questions: Questions) -> list[tuple[int, int, int]]:
    """(place in the chunk, question, diagonal) where WHOLE words with fewer characters than a q-gram stand as they are."""
    hits = []
    for d, (_, s, starts) in enumerate(chunk):
        for text, at in questions.short.items():
            p = s.find(text)
            while p >= 0:
                if (k := bisect_left(starts, p)) < len(starts) and starts[k] == p:
                    hits += [(d, b, p - place) for b, place in at]
                p = s.find(text, p + 1)
    return hits


def _leaks(chunk: list[tuple[int, str, list[int]]], questions: Questions) -> list[tuple[int, int]]:
    found: set[tuple[int, int]] = set()
    regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
    joined = _codes("\x00".join(s for _, s, _ in chunk))
    if len(joined) >= Q:
        begin = np.cumsum([0] + [len(s) + 1 for _, s, _ in chunk[:-1]])
        at, body, place = questions.occurrences(_grams(joined))
        if len(at):
            doc = np.searchsorted(begin, at, side="right") - 1
            diagonal = at - begin[doc] - place
            # Differing words of a stretch move its diagonal by no more than half a band.
            width = np.maximum(BAND, 2 * PART_EDITS * np.maximum(_longest_pairs(chunk)[doc], questions.longest[body]))
            offset = 1 << 40
            for shift in (0, 1):  # overlapping bands
                band = (diagonal + shift * (width // 2) + offset) // width
                order = np.lexsort((band, body, doc))
                d, b, w = doc[order], body[order], band[order]
                first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (b[1:] != b[:-1]) | (w[1:] != w[:-1])]))
                n = np.diff(np.append(first, len(order)))
                low, high = np.minimum.reduceat(diagonal[order], first), np.maximum.reduceat(diagonal[order], first)
                for j in np.flatnonzero(n >= questions.least[b[first]]):
                    half = int(width[order[first[j]]]) // 2
                    regions.setdefault((int(d[first[j]]), int(b[first[j]])), []).append((int(low[j]) - half, int(high[j]) + half))
    if questions.short:
        longest = _longest_pairs(chunk)
        for d, b, diagonal in _short_hits(chunk, questions):
            half = PART_EDITS * int(max(longest[d], questions.longest[b]))
            regions.setdefault((d, b), []).append((diagonal - half, diagonal + half))
    for (d, b), bands in regions.items():
        i, s, starts = chunk[d]
        if any(aligned(questions.words[b], s, starts, low, high) for low, high in sorted(set(bands))):
            found.add((i, b))
    return sorted(found)


def question_bodies(items: DataFrame, id_col: str = "item_id", question_col: str = "question") -> DataFrame:
    """(item, body): questions without the instruction lines that questions of different last lines share."""
    lines = items.select(F.col(f"`{id_col}`").alias("item"), F.split(F.col(f"`{question_col}`"), r"\r?\n").alias("lines")).where("lines is not null")
    each = lines.select("item", F.posexplode("lines").alias("pos", "line"), F.size("lines").alias("n"), F.element_at("lines", -1).alias("last"))
    norm = F.lower(F.trim("line"))
    shared = (
        each.where((F.col("pos") < F.col("n") - 1) & (norm != ""))
        .groupBy(norm.alias("shared"))
        .agg(F.count_distinct(F.lower(F.trim("last"))).alias("k"))
        .where("k > 1")
        .select("shared")
    )
    # An item's last line is never an instruction, so every item keeps a body.
    own = each.join(shared, norm == F.col("shared"), "left").where(F.col("shared").isNull() | (F.col("pos") == F.col("n") - 1))
    return own.groupBy("item").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str = "question",
) -> DataFrame:
    """(doc_col, item_col): documents that hold at least MIN_WORDS successive words of an item's question.

    One word in WORDS_PER_EDIT may differ. Items with the same question each give a row. Null and empty
    texts and questions shorter than MIN_WORDS give none; repeated documents each give rows; empty tables
    give an empty table. Documents are read once, however many questions there are: each lot of them is held
    against every block of questions. The questions' texts are sent to the executors, a block at a time.
    """
    spark = docs.sparkSession
    bodies = cut(question_bodies(items, item_col, question_col).where("body is not null"))
    chars = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = 1 + int(chars) // BLOCK_CHARS
    shared = []
    for k in range(blocks):
        rows = bodies.where(F.pmod(F.xxhash64("body"), F.lit(blocks)) == k).collect()  # a bounded block
        same: dict[str, list[int]] = {}
        for r in rows:
            same.setdefault(r["body"], []).append(r["item"])
        texts = sorted(same)
        shared.append(spark.sparkContext.broadcast((texts, [same[t] for t in texts])))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: OrderedDict[int, Questions] = OrderedDict()

        def held_against(ids: list[int], texts: list[str]) -> pd.DataFrame:
            pairs = []
            for k, block in enumerate(shared):
                if k not in kept:
                    kept[k] = Questions(block.value[0])
                    if len(kept) > KEPT:
                        kept.popitem(last=False)
                pairs += [(ids[i], item) for i, b in leaks_in(texts, kept[k]) for item in block.value[1][b]]
            return pd.DataFrame(pairs, columns=["doc", "item"]).astype("int64")

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch["doc"], batch["text"], strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > LOT_CHARS:
                    yield held_against(ids, texts)
                    ids, texts, size = [], [], 0
        yield held_against(ids, texts)

    source = docs.select(F.col(f"`{doc_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).where("length(text) > 0 and doc is not null")
    return source.mapInPandas(search, "doc bigint, item bigint").select(F.col("doc").alias(doc_col), F.col("item").alias(item_col))
