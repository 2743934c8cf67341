"""Frequencies of terms and of runs of terms of any length, by suffix arrays with common-prefix intervals.

A task gathers blocks of records and sorts all suffixes of their term sequences
by prefix doubling. Neighbours in that order with a common prefix of n terms or
more form the interval of an n-gram, and its length is the n-gram's occurrences.
For the number of records, suffixes are also put in order record by record; the
prefix a suffix shares with the one before it in its own record makes it a
repeat there for every n up to that length, and an interval's repeats are
subtracted from its occurrences. Ranks, common prefixes and intervals are whole
array operations; no term is compared as text.

Blocks' intervals are summed per n-gram, so that what crosses the network is
already aggregated, however frequent a term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms whose suffixes are sorted together, and terms of n-grams sent back at a time.
BLOCK_TERMS, BATCH_TERMS = 1_000_000, 1_000_000
#: Numbers of the marks that open and close a sequence; terms follow.
OPEN, CLOSE = 1, 2

_GRAMS = pa.schema([("gram", pa.list_(pa.string())), ("occurrences", pa.int64()), ("records", pa.int64())])


class SuffixArray:
    """Suffixes of numbered terms in order; sequence numbers ascend, and a suffix ends with its sequence."""

    def __init__(self, terms: np.ndarray, sequence: np.ndarray) -> None:
        n = len(terms)
        self.end = np.searchsorted(sequence, sequence, side="right")
        self.rest = self.end - np.arange(n)
        self.ranks = [terms.astype(np.int64)]
        width, longest = 1, int(self.rest.max(initial=0))
        while width < longest and len(np.unique(self.ranks[-1])) < n:
            following = np.zeros(n, np.int64)
            at = np.flatnonzero(self.rest > width)
            following[at] = self.ranks[-1][at + width]
            both = self.ranks[-1] * (int(self.ranks[-1].max()) + 1) + following
            self.ranks.append(np.unique(both, return_inverse=True)[1].astype(np.int64) + 1)
            width *= 2
        self.order = np.argsort(self.ranks[-1], kind="stable")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many first terms the suffixes at a and at b share."""
        a, b, shared = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        most = np.minimum(self.rest[a], self.rest[b])
        end_a, end_b = self.end[a], self.end[b]
        for level in range(len(self.ranks) - 1, -1, -1):
            open_ = np.flatnonzero((a < end_a) & (b < end_b))
            same = open_[self.ranks[level][a[open_]] == self.ranks[level][b[open_]]]
            shared[same] += 1 << level
            a[same] += 1 << level
            b[same] += 1 << level
        return np.minimum(shared, most)


def _within_records(suffixes: SuffixArray, record: np.ndarray) -> np.ndarray:
    """Per place in the order: the prefix shared with the suffix before it of the same record."""
    own = record[suffixes.order]
    by = np.argsort(own, kind="stable")
    repeat = np.zeros(len(own), np.int64)
    follows = np.flatnonzero(own[by[1:]] == own[by[:-1]])
    repeat[by[follows + 1]] = suffixes.common(suffixes.order[by[follows]], suffixes.order[by[follows + 1]])
    return repeat


def block_intervals(terms: np.ndarray, sequence: np.ndarray, record: np.ndarray, complete: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, place of a first term, occurrences, records) of the n-grams of each length; of complete sequences only, if so asked."""
    if not len(terms):
        return
    s = SuffixArray(terms, sequence)
    shared = np.r_[0, s.common(s.order[:-1], s.order[1:])]
    repeat = _within_records(s, record)
    rest = s.rest[s.order]
    opens = np.r_[True, sequence[1:] != sequence[:-1]][s.order]
    at = np.arange(len(terms))
    for n in range(1, int(rest.max()) + 1):
        at = at[rest[at] >= n]
        first = np.flatnonzero(shared[at] < n)  # a suffix too short for n never stands between two that share n terms
        occurrences = np.diff(np.r_[first, len(at)])
        repeats = np.add.reduceat((repeat[at] >= n).astype(np.int64), first)
        if complete:
            whole = np.flatnonzero(opens[at[first]] & (rest[at[first]] == n))
            first, occurrences, repeats = first[whole], occurrences[whole], repeats[whole]
        yield n, s.order[at[first]], occurrences, occurrences - repeats


def _numbered(block: list[tuple[pa.Array, np.ndarray, np.ndarray]], complete: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Term numbers, sequence and record of each term of a block, sequences between marks if complete; and the terms' texts."""
    coded = pa.concat_arrays([b[0] for b in block]).dictionary_encode()
    terms = coded.indices.to_numpy().astype(np.int64) + CLOSE + 1
    sequence, record = np.concatenate([b[1] for b in block]), np.concatenate([b[2] for b in block])
    if complete and len(terms):
        first = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
        last = np.r_[first[1:], len(terms)]
        where = np.r_[first, last]
        marks = np.r_[np.full(len(first), OPEN), np.full(len(first), CLOSE)]
        of = np.r_[first, last - 1]
        terms, sequence, record = np.insert(terms, where, marks), np.insert(sequence, where, sequence[of]), np.insert(record, where, record[of])
        order = np.argsort(sequence, kind="stable")  # a closing mark and the next opening one are put at the same place
        terms, sequence, record = terms[order], sequence[order], record[order]
    return terms, sequence, record, coded.dictionary


def _count(complete: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        held = sequences = records = 0

        def emit() -> Iterator[pa.RecordBatch]:
            terms, sequence, record, texts = _numbered(block, complete)
            for n, first, occurrences, standing in block_intervals(terms, sequence, record, complete):
                inner = (1, n - 1) if complete else (0, n)
                width = inner[1] - inner[0]
                for a in range(0, len(first), step := max(1, BATCH_TERMS // max(1, width))):
                    here = first[a : a + step]
                    places = (here[:, None] + np.arange(*inner)[None, :]).ravel()
                    words = texts.take(pa.array(terms[places] - CLOSE - 1))
                    grams = pa.ListArray.from_arrays(pa.array(np.arange(len(here) + 1, dtype=np.int32) * width), words)
                    yield pa.RecordBatch.from_arrays([grams, pa.array(occurrences[a : a + step]), pa.array(standing[a : a + step])], schema=_GRAMS)
            block.clear()

        for batch in batches:
            outer = batch.column(0)
            inner = outer.flatten()
            length = lambda x: pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
            per_record, per_sequence = length(outer), length(inner)
            words = inner.flatten()
            kept = np.flatnonzero(words.is_valid().to_numpy(zero_copy_only=False))
            of = np.repeat(np.arange(len(inner)), per_sequence)[kept]
            owner = np.repeat(np.arange(len(outer)), per_record)
            block.append((words.take(pa.array(kept)), of + sequences, owner[of] + records))
            held, sequences, records = held + len(kept), sequences + len(inner), records + len(outer)
            if held >= BLOCK_TERMS:
                yield from emit()
                held = 0
        if block:
            yield from emit()

    return count


def run_frequencies(records: DataFrame, sequences: str, complete: bool = False) -> DataFrame:
    """(n, gram ARRAY<STRING>, occurrences, records) of all runs of terms, however long; sequences: ARRAY<ARRAY<STRING>> per record.

    Runs stay within one sequence; a sequence of m terms gives up to m(m+1)/2.
    With complete, the runs that make up a sequence from its first term to its
    last are kept, and counted where they do so.

    Defined cases: null terms are skipped, null or empty sequences give nothing,
    each row is one record, an empty table gives no row, other columns are not read.
    """
    partial = records.select(F.col(sequences)).mapInArrow(_count(complete), "gram array<string>, occurrences bigint, records bigint")
    summed = partial.groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return summed.select(F.size("gram").alias("n"), "gram", "occurrences", "records")
