"""Quality rules: counts of words, symbols and repeats, and repetition by suffix array.

A suffix array over the words of many documents at once is built by prefix doubling (the rank
of a suffix holds its document, so repeats never cross documents; a suffix whose rank is its
own takes no part in later rounds). The ranks of all rounds give the longest common prefix of
neighbours. Where the LCP intervals reach `min_repeat` words, the intervals' substrings are
the maximal repeated ones; their spans are united. A document fails if the spans cover more
than `max_covered` of its words, or one repeated substring is longer than `max_longest`.

Defined results: null and empty texts have no words and fail the base rules; a text of any
length is taken whole, at about 100 bytes of memory a word; repeated rows are judged alike;
extra columns are kept out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, chunks, encode, table

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Among 8,884 documents that pass the base rules (sf0.1), repeats of five words or more cover at most
#: 0.34, and the longest has 13 words.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 5, 0.4, 50
#: From so many words on, ranks of former rounds aren't kept.
LONG = 1 << 20
PIECE = 1 << 20
_GAP = re.compile(rb"[\x09-\x0d ]")


def suffix_ranks(words: np.ndarray, doc: np.ndarray, keep: bool = True) -> list[np.ndarray]:
    """Ranks by the first 1, 2, 4, ... words; in the last, each suffix has its place. Without `keep` the
    last one only.

    A rank is the place of the first suffix of its class in the order; classes of one are done.
    """
    n = len(words)
    order = np.lexsort((words, doc)).astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    levels, step = [rank], 1
    last = np.ones(n, bool)
    last[:-1] = new[1:]
    active = order[~(new & last)]
    del order
    while len(active):
        then = active + step
        inside = then < n
        inside[inside] = doc[then[inside]] == doc[active[inside]]
        second = np.full(len(active), -1, np.int32)
        second[inside] = rank[then[inside]]
        by = np.argsort(rank[active].astype(np.int64) * (n + 1) + second + 1, kind="stable")
        who, first, second = active[by], rank[active][by], second[by]
        del then, inside, by
        group = np.ones(len(who), bool)
        group[1:] = first[1:] != first[:-1]
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.arange(len(who), dtype=np.int32)
        place = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        if keep:
            rank = rank.copy()
        rank[who] = place
        if keep:
            levels.append(rank)
        last = np.ones(len(who), bool)
        last[:-1] = new[1:]
        active, step = who[~(new & last)], step * 2
    return levels if keep else [rank]


def common_prefixes(words: np.ndarray, doc: np.ndarray, rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each neighbouring pair of the suffix array the words that it shares, in one walk along the
    text (a suffix shares at least one word less than the one before it); two arrays are all it needs."""
    n = len(words)
    lcp = np.zeros(max(0, n - 1), np.int32)
    w, d, r, o, out, h = memoryview(words), memoryview(doc), memoryview(rank), memoryview(order), memoryview(lcp), 0
    for i in range(n):
        k = r[i]
        if not k:
            h = 0
            continue
        j = o[k - 1]
        top = n - max(i, j)
        while h < top and w[i + h] == w[j + h] and d[i + h] == d[i] and d[j + h] == d[i]:
            h += 1
        if d[i] != d[j]:
            h = 0
        out[k - 1] = h
        h -= h > 0
    return lcp


def longest_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring from it that is found elsewhere in its document.

    The ranks of all rounds give common prefixes by bisection, for many short texts at once; above
    `LONG` words only the last ranks are kept, and the prefixes come from a walk along the text.
    """
    n = len(words)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    words, doc = np.ascontiguousarray(words, np.int64), np.ascontiguousarray(doc, np.int64)
    levels = suffix_ranks(words, doc, keep=n <= LONG)
    order = np.empty(n, np.int32)
    order[levels[-1]] = np.arange(n, dtype=np.int32)
    a, b = order[:-1], order[1:]
    if n > LONG:
        lcp = common_prefixes(words, doc, levels[-1], order)
    else:
        pairs = np.flatnonzero(levels[0][a] == levels[0][b])
        a, b = a[pairs], b[pairs]
        lcp = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + lcp, b + lcp
            ok = (x < n) & (y < n)
            ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
            lcp[ok] += 1 << k
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def word_numbers(text: bytes, number: dict[bytes, int]) -> np.ndarray:
    """The text's words as numbers, split in pieces of 1 MB between words; new words are added."""
    parts, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in text[at:end].split()), np.int64))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n places lies in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def duplicate_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x and not x.isspace()]
    return len(lines) - len(set(lines))


def quality_report(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    repeat_covered, repeat_longest): the last two are the method's, in words."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, repeat_covered long, repeat_longest long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, max_bytes=2 << 20):
                ids, texts = piece.column(0), [encode(t) for t in piece.column(1).to_pylist()]
                number: dict[bytes, int] = {}
                words = [word_numbers(t, number) for t in texts]
                flat = np.concatenate(words)
                n_words = np.fromiter(map(len, words), np.int64, len(words))
                doc = np.repeat(np.arange(len(words)), n_words)
                repeat = longest_repeats(flat, doc)
                per_doc = lambda x: np.bincount(doc, weights=x, minlength=len(texts)).astype(np.int64)  # noqa: E731, B023
                at3 = np.flatnonzero(repeat >= 3)
                n_repeat = per_doc(covered(at3, np.full(len(at3), 3), len(flat)))
                long = np.flatnonzero(repeat >= min_repeat)
                n_covered = per_doc(covered(long, repeat[long], len(flat)))
                longest = np.zeros(len(texts), np.int64)
                np.maximum.at(longest, doc, repeat)
                plain = [t.translate(None, SPACE + CONTINUATION) for t in texts]
                failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
                kept = ~failed & (n_covered <= max_covered * n_words) & (longest <= max_longest)
                columns = [
                    ids,
                    pa.array(n_words),
                    pa.array(list(map(len, plain)), pa.int64()),
                    pa.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], pa.int64()),
                    pa.array(list(map(duplicate_lines, texts)), pa.int64()),
                    *map(pa.array, (n_repeat, failed, kept, n_covered, longest)),
                ]
                names = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op5_quality": op5_quality}
SQL: dict[str, str] = {}
