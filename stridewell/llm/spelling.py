"""Spelling variant grouping: words at one edit of each other, by a self-join of a prefix-partitioned trie.

A word is a run of Latin letters, in lower case (A-Z only); some occurrences lose a letter, which is decided by a
checksum of document and run, and so make variants. The vocabulary is what is long and frequent enough.

Two words differ by one edit at the place where their common prefix ends. Words are dealt by their first STEP letters:
pairs whose edit comes later meet in the trie of that prefix. Pairs whose edit is within these letters agree in all that
follows, so they meet in the trie of their tail, whose words have STEP free letters. A prefix with more than TRIE_WORDS
words is dealt again by STEP letters more, and so on; so no trie is larger, whatever share of the words a prefix has, and
none of a tail has more words than there are texts of STEP letters.

In a trie each node has its active nodes, those at a distance of at most one with the distance, which follow from its
parent's. A pair is emitted where a word's end has another word's end among its active nodes at distance one. A word's
form is the most frequent such word, if that is frequent enough beside it; roots follow forms by pointer jumping.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import common

#: The letters of a word (A-Z have become a-z) and which occurrences lose one.
LETTER, LOSES = "[a-zÀ-ÿ]", 31
#: Letters by which words are dealt at a time.
STEP = 3
#: Words of a trie, about, and of a worker's group of tries.
TRIE_WORDS, GROUP_WORDS = 16384, 8192
#: Different words that a worker counts at once.
COUNTED = 1 << 17


def occurrences(doc_id: int | None, text: bytes, least: int, loses: int = LOSES) -> Counter:
    """How often each word of at least `least` letters occurs in a text, after some occurrences have lost a letter."""
    runs = Counter(re.findall(LETTER + "{%d,}" % least, text.lower().decode("utf-8", "replace")))
    start = zlib.crc32(("" if doc_id is None else str(doc_id)).encode() + b":")
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % loses == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, least: int = 7) -> DataFrame:
    """word, n: the words of all texts of docs (doc_id, text), counted in workers first."""
    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            data, offsets = common.utf8(b.column(1))
            for doc_id, i, j in zip(b.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                counts.update(occurrences(doc_id, data[i:j].tobytes(), least))
                if len(counts) >= COUNTED:
                    yield batch(counts)
                    counts = Counter()
        if counts:
            yield batch(counts)

    return docs.mapInArrow(common.trimmed(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# the trie -------------------------------------------------------------------------------------------------------------
class Trie:
    """Nodes are numbers, 0 is the root; children[node] by letter, and the word that ends there, or -1."""

    def __init__(self, words: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        for k, w in enumerate(words):
            at = 0
            for letter in w:
                below = self.children[at]
                to = below.get(letter)
                if to is None:
                    to = below[letter] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                at = to
            self.word[at] = k

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Every ordered pair of words at distance one."""
        children, word = self.children, self.word
        # the root is at distance 0 of itself and 1 of its children; near: the nodes at distance one
        todo = [(0, tuple(children[0].values()))]
        while todo:
            node, near = todo.pop()
            k = word[node]
            if k >= 0:
                for other in near:
                    if word[other] >= 0:
                        yield k, word[other]
            own = children[node]
            for letter, child in own.items():
                # at distance one of the child: its parent, its siblings, its own children, and what the letter
                # leads to from the parent's active nodes at distance one
                far = {node, *own.values(), *children[child].values()}
                far.discard(child)
                for other in near:
                    to = children[other].get(letter)
                    if to is not None:
                        far.add(to)
                far.discard(child)
                todo.append((child, tuple(far)))


# dealing --------------------------------------------------------------------------------------------------------------
def _cells(words: DataFrame, size: int) -> Iterator[DataFrame]:
    """Tables word, n, cell, cut, mid: cells whose tries hold all pairs, each pair in one of them.

    cut: the letters that all words of a cell share at their start; mid: the free letters after them in the cell of a
    tail, or -1 if all the rest is free.
    """
    cut, rest = 0, words
    while True:
        ahead = rest.where(F.length("word") >= cut + STEP)
        head = F.substring("word", 1, cut)

        def tail(mid: int) -> DataFrame:
            return rest.where(F.length("word") >= (cut if mid == STEP else cut + STEP)).select("word", "n", F.xxhash64(F.lit(cut), head, F.expr(f"substring(word, {cut + mid + 1})")).alias("cell"), F.lit(cut).alias("cut"), F.lit(mid).alias("mid"))

        yield tail(STEP).union(tail(STEP - 1))  # words that end within the letters all have the empty tail, once
        cut += STEP
        dealt = ahead.withColumn("cell", F.xxhash64(F.lit(-cut), F.substring("word", 1, cut)))
        large = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > size)
        if large.isEmpty():
            yield dealt.select("word", "n", "cell", F.lit(cut).alias("cut"), F.lit(-1).alias("mid"))
            return
        large = large.select("cell", F.lit(True).alias("large"))
        marked = dealt.join(large, "cell", "left")
        yield marked.where("large is null").select("word", "n", "cell", F.lit(cut).alias("cut"), F.lit(-1).alias("mid"))
        rest = common.stored(marked.where("large").select("word", "n"), "large")  # else each round's plan holds the last one's twice


def _cell_pairs(words: list[str], cut: int, mids: list[int]) -> Iterator[tuple[int, int]]:
    """The pairs of a cell: of a tail those whose edit is within the letters before it."""
    if mids[0] < 0:
        yield from Trie([w[cut:] for w in words]).pairs()
        return
    # a word may be in the cell by two lengths of its middle: pairs are of equal length STEP, or of STEP and one less; words
    # that share all letters of the middle can be read as a later edit, and meet there
    middles = [w[cut : cut + m] for w, m in zip(words, mids, strict=True)]
    for p, q in Trie(middles).pairs():
        if max(mids[p], mids[q]) == STEP and words[p][: cut + STEP] != words[q][: cut + STEP]:
            yield p, q


def near_words(words: DataFrame, size: int = TRIE_WORDS) -> DataFrame:
    """word, n, near, near_n: every ordered pair of words (different ones, with their n) at distance one, in one row."""
    parts = list(_cells(words, size))
    cells = parts[0]
    for more in parts[1:]:
        cells = cells.union(more)
    alone = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where("c > 1")  # a trie of one word has no pair
    groups = F.lit(max(1, words.count() // GROUP_WORDS))
    cells = cells.join(alone.select("cell"), "cell").withColumn("part", F.pmod("cell", groups))

    def run(t: pa.Table) -> pa.Table:
        word, n, cell, cut, mid = (t.column(c).to_pylist() for c in ("word", "n", "cell", "cut", "mid"))
        by: dict[int, list[int]] = {}
        for i, c in enumerate(cell):
            by.setdefault(c, []).append(i)
        left, right = [], []
        for at in by.values():
            if len(at) > 1:
                for p, q in _cell_pairs([word[i] for i in at], cut[at[0]], [mid[i] for i in at]):
                    left.append(at[p])
                    right.append(at[q])
        return pa.table({"word": pa.array([word[i] for i in left], pa.string()), "n": pa.array([n[i] for i in left], pa.int64()), "near": pa.array([word[i] for i in right], pa.string()), "near_n": pa.array([n[i] for i in right], pa.int64())})

    return cells.groupBy("part").applyInArrow(run, "word string, n long, near string, near_n long")


def _roots(forms: DataFrame, held: list[str]) -> DataFrame:
    """word, root: for words with a form (word, form) the last of the forms that follow one another."""
    now = common.stored(forms.select("word", F.col("form").alias("root")), "forms", held)
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved, path = Observation(), []
        now = common.stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")).observe(moved, F.count_if("went").alias("n")), "roots", path).select("word", "root")
        if not moved.get.get("n"):
            held += path
            return now
        held += path


def spelling_forms(docs: DataFrame, least: int = 7, times: int = 2, ratio: int = 10, size: int = TRIE_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of at least `least` letters with at least `times` occurrences.

    Two words are near if they differ by one inserted, deleted or replaced letter. form: the near word of largest n (ties:
    the smallest), if its n is at least ratio times the word's; root: the last form, the word itself if it has none. Null
    and empty texts have no words, a null id counts as an empty one; each row is a document, whatever its id.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    held: list[str] = []
    src = common.plain(docs, doc_id=doc_id, text=text)
    words = common.stored(word_counts(src, least).where(F.col("n") >= times), "words")
    pairs = near_words(words, size)
    best = pairs.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("best"))
    good = -F.col("best.m") >= ratio * F.col("n")
    found = common.stored(best.select("word", "n_near", F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "near")
    root = _roots(found.where("form is not null"), held)
    out = words.join(found, "word", "left").join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
