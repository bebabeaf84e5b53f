"""Operator 2, benchmark decontamination: BM25 over an inverted index of test items.

Every training passage (overlapping windows of `PASSAGE_WORDS` words that cover the
whole text) is a query over the items. Impacts are BM25 term weights divided by the
score of the item's own text as a query, so that one threshold serves all items. No
passage can hold half of a long item: one of more than `SEGMENT_WORDS` words is indexed
as a whole and also as overlapping segments of that many words, each with its own score.
A passage is twice as long, so that a segment quoted whole lies whole in some passage.
Two bounds skip work and lose nothing:

- a passage whose words' greatest impacts sum to less than the threshold;
- within a passage, block-max WAND: postings are cut into blocks with their greatest
  impact, and items whose blocks cannot reach the threshold are passed over.

All items of which the whole or a segment is above the threshold are retrieved, with the
greatest of their scores, whatever their length. Each is verified against the words around
the passage: the shares of its question's and of its answer's word triples that occur
there. The question is the item without its last sentence, the answer its last
sentence; an item of one sentence is halved.

The index is built in blocks of about `BLOCK_ITEMS` items and segments, each in a task.
Spark hands the files that hold them to every executor. The documents are read and cut
into words once: a task holds each batch of them against one block after another, so that
its memory is that of a block, however large the benchmark is.

Defined cases: null text is the empty text and matches nothing; an item without words
is never retrieved; equal items are retrieved each; null item_ids and doc_ids are kept;
an empty benchmark or table gives no rows; other columns are ignored by `leaks` and
kept by `clean`.
"""

from __future__ import annotations

import bisect
import itertools
import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty

K1, B = 1.2, 0.75
PASSAGE_WORDS, STRIDE = 128, 64
#: Words of a segment of a long item, and between the beginnings of two.
SEGMENT_WORDS, SEGMENT_STRIDE = PASSAGE_WORDS - STRIDE, 32
#: Least share of an item's own score.
SCORE = 0.5
#: Least share of the question's and of the answer's word triples.
OVERLAP = 0.6
#: Postings in a block of the index, items in a group, and the share of an item that its commonest words may have.
POSTINGS, GROUP, COMMON_SHARE = 32, 1, 0.3
#: Items and segments in one block, and blocks from which on a worker reads them anew for each batch.
BLOCK_ITEMS, HELD_BLOCKS = 5_000, 4
#: Bounds (strides times units) that are held at once.
MOST_CELLS = 1 << 21
TRIPLE = 3

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of all sentences but the last, and of the last."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    return words[: len(words) // 2], words[len(words) // 2 :]


def triples(words: list[str]) -> set[tuple[str, ...]]:
    n = min(TRIPLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def segments(words: list[str]) -> list[list[str]]:
    """The overlapping segments of a long item, up to its end; none of another."""
    last = len(words) - SEGMENT_WORDS
    return [words[i : i + SEGMENT_WORDS] for i in (*range(0, last, SEGMENT_STRIDE), last)] if last > 0 else []


class Index:
    """Postings of one block of items and of their segments, together its units. df and n
    count the items of all blocks, reach is the number of words of the longest of all."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[str, int], n: int, mean_words: float, reach: int = 0):
        self.ids = [i for i, _ in items]
        self.parts = [tuple(map(triples, question_and_answer(t))) for _, t in items]
        each = [words_of(t) for _, t in items]
        self.reach = max(reach, *map(len, each), 0)
        cut = list(map(segments, each))
        # Items are the first units.
        self.item_of = [*range(len(each)), *(k for k, parts in enumerate(cut) for _ in parts)]
        each += [part for parts in cut for part in parts]
        postings: dict[str, list[tuple[int, float]]] = {}
        for k, words in enumerate(each):
            weights = {}
            for w, tf in Counter(words).items():
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
            own = sum(weights.values())
            for w, x in weights.items():
                postings.setdefault(w, []).append((k, x / own))
        self.terms = {w: i for i, w in enumerate(postings)}
        self.items = [[k for k, _ in p] for p in postings.values()]
        self.impacts = [[x for _, x in p] for p in postings.values()]
        self.greatest = np.array([max(p) for p in self.impacts] or [0.0])
        self._group()
        self.block_ends = [[p[min(i + POSTINGS, len(p)) - 1] for i in range(0, len(p), POSTINGS)] for p in self.items]
        self.block_max = [[max(p[i : i + POSTINGS]) for i in range(0, len(p), POSTINGS)] for p in self.impacts]

    def _group(self) -> None:
        """Sparse rows (term -> group, greatest impact) of the scarcer words, and what the
        common ones can add to an item of each group."""
        common_part = np.zeros(len(self.item_of))
        scarce = np.ones(len(self.items), bool)
        for t in sorted(range(len(self.items)), key=lambda t: (-len(self.items[t]), t)):
            more = common_part.copy()
            more[self.items[t]] += self.impacts[t]
            if len(self.items[t]) == 1 or more.max(initial=0) > COMMON_SHARE:
                break
            common_part, scarce[t] = more, False
        self.n_groups = -(-len(self.item_of) // GROUP)
        self.granted = np.zeros(self.n_groups)
        np.maximum.at(self.granted, np.arange(len(self.item_of)) // GROUP, common_part)
        groups, tops, sizes = [], [], []
        for t, (items, impacts) in enumerate(zip(self.items, self.impacts, strict=True)):
            of: dict[int, float] = {}
            if scarce[t]:
                for k, x in zip(items, impacts, strict=True):
                    of[k // GROUP] = max(of.get(k // GROUP, 0.0), x)
            groups += of
            tops += of.values()
            sizes.append(len(of))
        self.group_of, self.top_of = np.array(groups, np.int64), np.array(tops)
        self.row_size = np.array(sizes, np.int64)
        self.row_start = np.cumsum(self.row_size) - self.row_size

    def promising(self, terms: np.ndarray, known: np.ndarray, threshold: float) -> np.ndarray:
        """Numbers of the passages that some group's bound lets reach the threshold. Strides
        are taken some at a time, so that a long text needs no more room than a short one."""
        at = np.flatnonzero(known)
        # Each word once a stride.
        part, word = np.divmod(np.unique(at // STRIDE * len(self.items) + terms[at]), max(1, len(self.items)))
        steps, wide = -(-len(terms) // STRIDE), PASSAGE_WORDS // STRIDE
        once = max(1, MOST_CELLS // max(1, self.n_groups))
        found = []
        for first in range(0, steps, once):
            last = min(first + once + wide - 1, steps)  # passages begin before first + once, and reach beyond
            lo, hi = np.searchsorted(part, (first, last))
            sizes = self.row_size[word[lo:hi]]
            entry = np.repeat(self.row_start[word[lo:hi]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            cell = np.repeat(part[lo:hi] - first, sizes) * self.n_groups + self.group_of[entry]
            sums = np.bincount(cell, self.top_of[entry], (last - first) * self.n_groups).reshape(last - first, self.n_groups)
            whole = sums.copy()
            for i in range(1, wide):
                whole[:-i] += sums[i:]
            hits = np.flatnonzero((whole + self.granted >= threshold - 1e-9).any(1)) + first
            found.append(hits[hits < first + once])
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def above(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(unit, score) of every unit with a score of at least `threshold`: block-max WAND."""
        cursors = [[self.items[t][0], 0, t] for t in terms]  # item, position, term
        found = []
        slack = 1e-9
        while True:
            cursors.sort()
            bound, pivot = 0.0, None
            for i, (_, _, t) in enumerate(cursors):
                bound += self.greatest[t]
                if bound >= threshold - slack:
                    pivot = i
                    break
            if pivot is None:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # The blocks that hold the pivot item, and the first item after any of them.
            block_bound, after = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
            for _, _, t in cursors[: pivot + 1]:
                b = bisect.bisect_left(self.block_ends[t], item)
                if b < len(self.block_ends[t]):
                    block_bound += self.block_max[t][b]
                    after = min(after, self.block_ends[t][b] + 1)
            if block_bound < threshold - slack:
                target = max(after, item + 1) if after != math.inf else math.inf
            else:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    c[1] = bisect.bisect_left(self.items[c[2]], item, c[1])
                    if c[1] < len(self.items[c[2]]) and self.items[c[2]][c[1]] == item:
                        score += self.impacts[c[2]][c[1]]
                if score >= threshold - slack:
                    found.append((item, score))
                target = item + 1
            left = []
            for i, c in enumerate(cursors):
                if i <= pivot:
                    c[1] = bisect.bisect_left(self.items[c[2]], target, c[1])
                    if c[1] == len(self.items[c[2]]):
                        continue
                    c[0] = self.items[c[2]][c[1]]
                left.append(c)
            cursors = left

    def search(self, text: str, score: float = SCORE, overlap: float = OVERLAP) -> list[tuple]:
        """(item_id, first word of the passage, score, question overlap, answer overlap)
        of each verified item: its best passage."""
        return found_in([text], [self], score, overlap)[0]

    def within(self, codes: np.ndarray, term_of: np.ndarray, word_of: list[str], score: float, overlap: float, one: bool) -> list[tuple]:
        """As `search`, for the words of a text as codes, whose terms and words are given;
        with `one`, the first verified item will do."""
        terms = term_of[codes]
        known = terms >= 0
        best: dict[int, tuple] = {}
        for k in self.promising(terms, known, score):
            first, last = int(k) * STRIDE, min(int(k) * STRIDE + PASSAGE_WORDS, len(terms))
            distinct = np.unique(terms[first:last][known[first:last]])
            around = None
            hits: dict[int, float] = {}
            for unit, got in self.above(distinct.tolist(), score):
                hits[self.item_of[unit]] = max(got, hits.get(self.item_of[unit], 0.0))
            for item, got in hits.items():
                if around is None:
                    near = [word_of[c] for c in codes[max(0, first - self.reach) : last + self.reach].tolist()]
                    around = [{tuple(near[i : i + n]) for i in range(len(near) - n + 1)} for n in range(TRIPLE + 1)]
                shares = [sum(t in around[len(t)] for t in part) / len(part) if part else 1.0 for part in self.parts[item]]
                if min(shares) >= overlap and (item not in best or got > best[item][2] + 1e-12):
                    best[item] = (self.ids[item], first, got, *shares)
                    if one:
                        return [best[item]]
        return [best[i] for i in sorted(best)]


def found_in(texts: Iterable[str], blocks: Iterable[Index], score: float, overlap: float, one: bool = False) -> list[list[tuple]]:
    """What is found in each text of the items of all blocks. Texts are cut into words once,
    blocks pass by once; with `one`, a text in which an item was found is passed over."""
    code: defaultdict[str, int] = defaultdict()
    code.default_factory = code.__len__
    coded = []
    for words in map(words_of, texts):
        coded.append(np.fromiter(map(code.__getitem__, words), np.int32, len(words)))
    word_of = list(code)
    out: list[list[tuple]] = [[] for _ in coded]
    for index in blocks:
        term_of = np.fromiter(map(index.terms.get, word_of, itertools.repeat(-1)), np.int64, len(word_of))
        for found, codes in zip(out, coded, strict=True):
            if len(codes) and not (one and found):
                found += index.within(codes, term_of, word_of, score, overlap, one)
    return out


def index_blocks(benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> tuple[DataFrame, int]:
    """(block, index) and the number of blocks: each is built in a task from its items and
    the document frequencies of their words, which count all items, and is written to the
    shared folder. Long items are counted with their segments, so that blocks are of like
    size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    split = items.withColumn("words", tokens("text"))
    longer = F.size("words") - SEGMENT_WORDS
    units = F.when(longer > 0, F.ceil(longer / SEGMENT_STRIDE) + 2).otherwise(1)
    n, n_units, mean_words, reach = split.agg(F.count("*"), F.sum(units), F.avg(F.size("words")), F.max(F.size("words"))).first()
    n_blocks, mean_words = -(-(n_units or 0) // block_items), mean_words or 1.0
    # By row, so that one item many times over does not make one block too large.
    numbered = saved(split.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, n_blocks)))), "op2-items")
    words = numbered.select("block", F.explode(F.array_distinct("words")).alias("word"))
    frequency = words.groupBy("word").agg(F.count("*").alias("df"))
    used = saved(words.distinct().join(frequency, "word").select("block", "word", "df"), "op2-words")

    def build(mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(((None if pd.isna(i) else int(i), t) for i, t in zip(mine["item_id"], mine["text"], strict=True)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        index = Index(rows, dict(zip(found["word"], found["df"], strict=True)), n, mean_words, reach)
        return pd.DataFrame({"block": mine["block"][:1], "index": [pickle.dumps(index)]})

    # A null item_id must not turn the others into floats.
    mine = numbered.select("block", F.col("item_id").cast("string").alias("item_id"), "text").groupBy("block")
    built = mine.cogroup(used.groupBy("block")).applyInPandas(build, "block long, index binary")
    return saved(built, "op2-index"), n_blocks


#: The blocks that a worker keeps from batch to batch and task to task, with their files' names.
_held: dict[str, list] = {"names": [], "blocks": []}


class Blocks:
    """The blocks of an index as a task reads them, from files that Spark hands to each
    executor, a later one included. A few are kept by the worker, of more only one is
    held at a time."""

    def __init__(self, names: list[str], n_blocks: int):
        self.names, self.n_blocks = names, n_blocks

    def _read(self) -> Iterator[Index]:
        for name in self.names:
            with pq.ParquetFile(SparkFiles.get(name)) as file:
                for batch in file.iter_batches(1, columns=["index"]):
                    for value in batch.column(0):
                        yield pickle.loads(value.as_py())

    def __iter__(self) -> Iterator[Index]:
        if self.n_blocks > HELD_BLOCKS:
            return self._read()
        if _held["names"] != self.names:
            _held.update(blocks=list(self._read()), names=self.names)
        return iter(_held["blocks"])


def handed_out(benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> Blocks:
    """The index of a benchmark, as files of every executor."""
    blocks, n_blocks = index_blocks(benchmark, block_items)
    files = sorted(blocks.inputFiles()) if n_blocks else []
    for path in files:
        benchmark.sparkSession.sparkContext.addFile(path)
    return Blocks([path.rsplit("/", 1)[1] for path in files], n_blocks)


def leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, overlap: float = OVERLAP, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, passage (number of its first word), score, question_overlap,
    answer_overlap: a row for each document row and item found in it."""
    names = ["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"]
    kinds = [pa.int64()] * 3 + [pa.float64()] * 3
    blocks = handed_out(benchmark, block_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_each = found_in((t.as_py() for t in batch.column(1)), blocks, score, overlap)
            rows = [(d, *found) for d, all_found in zip(batch.column(0).to_pylist(), of_each, strict=True) for found in all_found]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return picked.mapInArrow(run, "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double")


def clean(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, overlap: float = OVERLAP, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows in which no item is found, with all their columns."""
    blocks = handed_out(benchmark, block_items)

    @F.pandas_udf("boolean")
    def free(texts: pd.Series) -> pd.Series:
        return pd.Series([not found for found in found_in(texts, blocks, score, overlap, one=True)], dtype=bool)

    return docs.where(free(text_or_empty()))
