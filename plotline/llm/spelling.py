"""Spelling variant grouping by a variable-length gram index.

1. Words are counted in each task and summed by Spark; from here on a word is one row.
2. Gram dictionary: the grams of ``GRAM`` characters or more that more than ``limit`` places of the distinct words hold
   are called frequent, and only frequent grams are extended. ``limit`` is at least the number of places over
   ``MAX_FREQUENT``, so there are at most ``MAX_FREQUENT`` frequent grams of each length: that bounds the broadcast.
3. A word (with an end mark) has a gram at every place: the shortest one that is not frequent, at most as long as the
   word's class allows. Where a gram stops depends on its own characters alone, so an edit changes only the grams that
   cover it. The largest number of grams over one character is the word's affected-gram bound.
4. List merging: one edit leaves all but the bounded number of a word's grams as they are, so two near words share one
   among the (bound + 1) rarest of each (the order of the lists is the same for all words). Lists are kept by gram,
   place and length and merged where they lie: a task compares the words of a list by a bit test that near words
   always pass, then by the edit itself, and hands on near pairs only. Longer lists than ``LARGE`` are merged by a join
   that skew handling can split. The longest gram is two characters shorter than the shortest words, so that at
   least one gram is always left.
5. Near words are counted, the frequent one among them becomes the form, and forms are followed by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import drop_written, materialise, slices, small_batches

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
GRAM = 3  # characters of the shortest grams
LONGEST = 5  # characters of the longest
LIST = 32  # places of a gram up to which it is never extended
MAX_FREQUENT = 50_000  # frequent grams of each length
END = "$"  # no word has it
LARGE = 20_000  # rows of a list above which Spark's join pairs them, split over tasks, instead of one task
_PAIRS = 1 << 21  # pairs that a task compares at a time
_HELD = 300_000  # counters that a task keeps before it hands them on

#: What ends a run of letters: every byte but a-z and U+00C0 to U+00FF, once other characters are gone.
_OTHERS = re.compile(rb"[\xc2\xc4-\xff][\x80-\xbf]+")
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _runs(text: bytes) -> list[bytes]:
    """Runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a UTF-8 text, A to Z in lower case."""
    if not text.isascii():
        text = _OTHERS.sub(b" ", text)
    return text.translate(_LETTERS).split()


def _words(doc_id: object, text: bytes, min_length: int, drop_one_in: int) -> list[bytes]:
    """The runs of a text after deletions; some have fewer than ``min_length`` characters, though as many bytes."""
    runs = [r for r in _runs(text) if len(r) >= min_length]
    if drop_one_in:
        start = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
        for i in [i for i, r in enumerate(runs) if not zlib.crc32(r, start) % drop_one_in]:
            chars = runs[i].decode()
            k = zlib.crc32(runs[i], start) % len(chars)
            runs[i] = (chars[:k] + chars[k + 1:]).encode()
    return runs


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_one_in: int = 0,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least ``min_length`` characters with ``min_count`` or more occurrences.

    ``drop_one_in`` k takes a character from every run whose crc32 of ``<doc_id>:<run>`` k divides (a null id is an
    empty text there), 0 from none. Null and empty texts have no words; repeated rows count each time.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            long = {w: n for w, n in held.items() if len(w) - w.count(b"\xc3") >= min_length}
            return pa.RecordBatch.from_arrays([pa.array(long.keys(), pa.binary()).cast(pa.string()), pa.array(long.values(), pa.int64())],
                                              names=["word", "n"])

        for batch in slices(batches, 256):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.update(_words(doc_id, text or b"", min_length, drop_one_in))
            if len(held) > _HELD:
                yield out()
                held.clear()
        yield out()

    return (small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


def frequent_grams(words: DataFrame, limit: int | None = None) -> dict[str, int]:
    """Grams of ``GRAM`` to ``LONGEST`` characters that more than ``limit`` places of ``words`` hold, with their places.

    By default ``limit`` is ``LIST``, or the number of places over ``MAX_FREQUENT`` if that is more.
    """
    if limit is None:
        places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
        limit = max(LIST, places // MAX_FREQUENT)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "n"])

        for batch in slices(batches, 2048):
            for word in batch.column(0).to_pylist():
                marked = word + END
                for size in range(GRAM, LONGEST + 1):
                    held.update([marked[p:p + size] for p in range(len(marked) - size + 1)])
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        yield out()

    counted = (words.select("word").mapInArrow(scan, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
               .filter(F.col("n") > limit))
    return {r.gram: r.n for r in counted.collect()}  # at most MAX_FREQUENT of each length


def longest_gram(length: int) -> int:
    """The longest gram of words of ``length`` characters and their near words of one more."""
    return max(GRAM, min(LONGEST, length - GRAM + 1))


def decompose(word: str, longest: int, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """(place, gram): the shortest gram at each place that is not frequent; the end mark and ``longest`` stop it too."""
    marked = word + END
    end, out = len(marked), []
    for p in range(end - GRAM + 1):
        stop = p + GRAM
        while marked[p:stop] in frequent and stop < end and stop - p < longest:
            stop += 1
        out.append((p, marked[p:stop]))
    return out


def affected(grams: list[tuple[int, str]], length: int) -> int:
    """The most grams that one edit can change: those over one character."""
    steps = [0] * (length + 2)
    for p, g in grams:
        steps[p] += 1
        steps[p + len(g)] -= 1
    most = now = 0
    for d in steps:
        now += d
        most = max(most, now)
    return most


def rarest(word: str, longest: int, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """The grams of a word's merged lists: one more than an edit can change, rarest first."""
    grams = decompose(word, longest, frequent)
    return sorted(grams, key=lambda g: (frequent.get(g[1], 0), g[1], g[0]))[:affected(grams, len(word)) + 1]


_ROW = "key long, word string, odd long, head long, tail long, longer boolean"


def _lists(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """(key, word, odd, head, tail, longer): a word under its own length, and as the longer partner under the length below.

    ``odd`` has a bit for each of 63 classes of characters of which the word has an odd number. ``head`` and ``tail`` are
    hashes of the first half of as many characters as the list's length, and of the last of the rest.
    """
    shared = words.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, 1024):
            keys, times = [], []
            halves: list[str] = []
            odd, who, longer = [], [], []
            for word in batch.column(0).to_pylist():
                size = len(word)
                own = rarest(word, longest_gram(size), known)
                less = own if longest_gram(size - 1) == longest_gram(size) else rarest(word, longest_gram(size - 1), known)
                # before the extra character places are equal, behind it they are one less in the shorter word
                under = {(p - d, g) for p, g in less for d in (0, 1)}
                bits = 0
                for c in word:
                    bits ^= 1 << ord(c) % 63
                for length, grams in ((size, own), (size - 1, under)):
                    keys += [f"{length} {p} {g}" for p, g in grams]
                    times.append(len(grams))
                    half = length // 2
                    halves += (word[:half], word[size - length + half:])
                who += (word, word)
                odd += (bits, bits)
                longer += (False, True)
            n = np.array(times, np.int64)
            place = pa.array(np.repeat(np.arange(len(n)), n))
            half = _hashes(halves)
            cols = [pa.array(_hashes(keys))] + [c.take(place) for c in (
                pa.array(who, pa.string()), pa.array(odd, pa.int64()), pa.array(half[::2]), pa.array(half[1::2]), pa.array(longer, pa.bool_()))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "word", "odd", "head", "tail", "longer"])

    return words.select("word").mapInArrow(scan, _ROW)


def _hashes(texts: list[str]) -> np.ndarray:
    """64-bit hashes that every task computes alike (equal hashes only make a list longer)."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(t) for t in texts], np.uint64).view(np.int64)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced character parts the words, in linear time."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b) < 64:
        return sum(map(ne, a, b)) == 1
    low, high = 0, min(len(a), len(b))
    while low < high:  # the length of the common start
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) >= len(b)):] == b[low + (len(b) >= len(a)):]


def _merged(rows: pa.Table) -> pa.RecordBatch:
    """Near pairs (a, b) inside the lists of ``rows``, which come whole and sorted by key."""
    key, odd, head, tail, longer = (rows.column(c).to_numpy() for c in ("key", "odd", "head", "tail", "longer"))
    words = rows.column("word").to_pylist()
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    low, n = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    mine = np.flatnonzero(~longer & (n > 1))
    upto = np.cumsum(n[mine])
    found: set[tuple[str, str]] = set()
    at = 0
    while at < len(mine):
        done = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, done + _PAIRS, "right")))
        some = mine[at:stop]
        one = np.repeat(some, n[some])
        two = np.arange(len(one)) + np.repeat(low[some] - (upto[at:stop] - n[some] - done), n[some])
        near = np.bitwise_count(np.repeat(odd[some], n[some]) ^ odd[two]) <= 2
        one, two = one[near], two[near]
        near = ((head[one] == head[two]) | (tail[one] == tail[two])) & (one != two)  # the edit leaves one half as it is
        one, two = one[near], two[near]
        for i, j, more in zip(one.tolist(), two.tolist(), longer[two].tolist()):
            a, b = words[i], words[j]
            if (more or a < b) and (a, b) not in found and one_edit(a, b):
                found.add((a, b))
        at = stop
    pairs = list(found)
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())], names=["a", "b"])


def _merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of a partition's lists; a list that goes on in the next batch waits for it."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # where the last list of the batch starts
        if cut or (waiting and waiting[-1].column(0)[-1].as_py() != key[0]):
            yield _merged(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield _merged(pa.Table.from_batches(waiting))


def _joined(lists: DataFrame) -> DataFrame:
    """Near pairs of lists of any length, by a join; near words are compared after it, in linear time."""
    one = lists.filter("not longer").select("key", F.col("word").alias("a"), F.col("odd").alias("odd_a"), F.col("head").alias("ha"), F.col("tail").alias("ta"))
    two = lists.select("key", F.col("word").alias("b"), F.col("odd").alias("odd_b"), F.col("head").alias("hb"), F.col("tail").alias("tb"), "longer")
    can = ((F.col("longer") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2)
           & ((F.col("ha") == F.col("hb")) | (F.col("ta") == F.col("tb"))))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield batch.filter(pa.array([one_edit(x, y) for x, y in zip(a, b)], pa.bool_()))

    return one.join(two, (one.key == two.key) & can).select("a", "b").mapInArrow(verified, "a string, b string")


def near_pairs(words: DataFrame, frequent: dict[str, int] | None = None) -> DataFrame:
    """(a, b): all pairs of distinct words one edit apart, each once; a is the shorter, or the smaller of equal length.

    Words need ``GRAM`` + 4 characters or more (see ``longest_gram``).
    """
    if frequent is None:
        frequent = frequent_grams(words)
    lists = materialise(_lists(words, frequent), "spelling-lists")
    large = materialise(lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select("key"), "spelling-large")
    some = not large.isEmpty()
    in_tasks = lists.join(large, "key", "left_anti") if some else lists
    found = in_tasks.repartition("key").sortWithinPartitions("key").mapInArrow(_merge_lists, "a string, b string")
    if some:
        found = found.unionByName(_joined(lists.join(large, "key", "left_semi")))
    pairs = materialise(found.distinct(), "spelling-pairs")
    drop_written(lists)
    drop_written(large)
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, in rounds that double the steps."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop_written(at)
        at = moved
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, drop_one_in: int = 0,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``word_counts``.

    A word's form is its near word (exactly one character inserted, deleted or replaced) of largest n, ties to the
    smaller in code-point order, if that n is at least ``ratio`` times the word's; root is the last of the chain of
    forms, or the word itself. No words give an empty table.
    """
    if min_length < GRAM + 4:
        raise ValueError(f"words need at least {GRAM + 4} characters")
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    words = materialise(word_counts(docs, min_length, min_count, drop_one_in, id_col, text_col), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    near = (both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
            .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best")))
    is_form = -F.col("best.m") >= ratio * F.col("n")
    named = materialise(words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, -F.col("best.m")).alias("form_n")), "spelling-forms")
    drop_written(pairs)
    drop_written(words)
    roots = _roots(named.filter("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
