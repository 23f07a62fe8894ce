"""Groups spelling variants by a variable-length gram index.

Words are counted over all texts. Two words are *near* if one inserted,
deleted or replaced code point turns one into the other. A word's *form* is its
most frequent near word, if that is at least ``ratio`` times as frequent; its
*root* is where following forms ends.

1. Gram dictionary: the grams of ``SHORTEST`` to ``LONGEST`` code points that
   occur more than T times in the words (marked ``^word$``), T growing with
   the number of words so that the dictionary never holds more than
   ``DICTIONARY`` grams of a length. It is the only thing sent to every task.
2. A word has one gram for each place: the shortest one there that is not in
   the dictionary, or the longest allowed. Which gram it is depends on that
   gram's own code points alone, so an edit affects just the grams that span
   it. The largest number of grams over one place bounds how many one edit
   can affect (``most_affected``).
3. Two near words therefore share at least (grams - bound) grams of either,
   at the same distance from the left end or from the right end. In the order
   from rare to frequent grams, the first (bound + 1) of both must meet. Only
   those short lists are merged, by a shuffle on (gram, side, distance); the
   rest of the count is checked on bit sets of all grams of both words.
4. What passes both counts is verified code point by code point. As words are
   at least ``LONGEST`` code points long, some gram always escapes an edit, so
   no pair is missed.

A gram list of more than ``CELL_ROWS`` words, or ``CELL_BYTES``, is split into
parts, and every two parts meet in a task of their own. Pairs of near words are
at most some hundred for a word (one edit over the alphabet). Roots are found
by pointer jumping: frequencies double along a chain, so it has at most 63
links and the rounds are few.

Defined results: null texts hold no words; a null id counts as the empty string
in the hash; repeated rows count as often as they occur; ties between forms go
to the smaller word; texts are cut at white space into pieces of ``PIECE``
characters for counting, and a word of any length is one word; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import map_arrow, materialize, text_of

SHORTEST = 2
LONGEST = 5
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
DROP = 97
DICTIONARY = 1 << 16
FREQUENT = 16
CELL_ROWS = 2048
CELL_BYTES = 4 << 20
PIECE = 1 << 20
# distinct words or grams a task holds before it sends on their counts
HELD = 200_000
# rows of cells, and pairs of them, looked at together
ROWS = 50_000
PAIRS = 1 << 18
# longer words are compared one by one
SHORT = 64
# the columns that name a cell
CELL = ["key", "lo", "hi"]

# Letters are A-Z, a-z and the code points C0 to FF, one byte each in Latin-1; A-Z are lower-cased.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))


def _pieces(data: bytes):
    """Cuts at spaces only."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def runs_of(text: str, prefix: bytes, drop: int = DROP, least: int = MIN_LENGTH):
    """Counts of a text's words of at least ``least`` code points, with the spelling
    slips that the hash of ``prefix`` and run decides."""
    # what Latin-1 lacks becomes a question mark, which is no letter
    state = zlib.crc32(prefix)
    for piece in _pieces(text.encode("latin-1", "replace").translate(_LETTERS)):
        own = Counter([r for r in piece.split() if len(r) >= least])
        for r in list(own):
            h = zlib.crc32(r if r.isascii() else r.decode("latin-1").encode(), state)
            if not h % drop:
                n = own.pop(r)
                at = h % len(r)
                yield r[:at] + r[at + 1:], n
        yield from own.items()


def _latin(word: bytes) -> str:
    return word.decode("latin-1")


def _sums(df: DataFrame, count, name: str, text=str) -> DataFrame:
    """``name`` and its sum ``n``: ``count`` yields (key, n) of a batch; each task adds up
    ``HELD`` keys before it sends them on as ``text``."""
    def run(batches):
        total: dict = {}

        def out():
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(map(text, total)), pa.string()), pa.array(list(total.values()), pa.int64())], names=[name, "n"])
            total.clear()
            return rows

        for batch in batches:
            for word, n in count(batch):
                total[word] = total.get(word, 0) + n
                if len(total) >= HELD:
                    yield out()
        yield out()

    return map_arrow(df, run, f"{name} string, n long").groupBy(name).agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame, drop: int = DROP, least: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """The words of at least ``least`` code points and ``min_count`` occurrences."""
    rows = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("_id"),
                       text_of().alias("_text"))

    def count(batch):
        for name, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
            for word, n in runs_of(text, name.encode(), drop, least):
                if len(word) >= least:
                    yield word, n

    return _sums(rows, count, "word", _latin).where(F.col("n") >= min_count)


def gram_dictionary(words: DataFrame, longest: int = LONGEST, size: int = DICTIONARY, frequent: int = FREQUENT) -> dict[str, int]:
    """Frequent grams and how often they occur: at most ``size`` of each length."""
    places = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    least = max(frequent, places // size) + 1

    def count(batch):
        for word in batch.column("word").to_pylist():
            word = f"^{word}$"
            for k in range(SHORTEST, longest + 1):
                for i in range(len(word) - k + 1):
                    yield word[i:i + k], 1

    return {r["gram"]: r["n"] for r in _sums(words.select("word"), count, "gram").where(F.col("n") >= least).collect()}


def decompose(word: str, dictionary: dict[str, int], longest: int = LONGEST) -> list[str]:
    """The gram at each place of the marked word."""
    word = f"^{word}$"
    out = []
    for i in range(len(word) - SHORTEST + 1):
        k = i + SHORTEST
        most = min(len(word), i + longest)
        while k < most and word[i:k] in dictionary:
            k += 1
        out.append(word[i:k])
    return out


def most_affected(grams: list[str]) -> int:
    """The most grams that span one place: no single edit affects more."""
    change = [0] * (len(grams) + 2)
    for i, g in enumerate(grams):
        change[i] += 1
        change[min(i + len(g), len(grams) + 1)] -= 1
    most = here = 0
    for c in change:
        here += c
        most = max(most, here)
    return most


def _bits(grams: list[str]) -> int:
    out = 0
    for g in grams:
        out |= 1 << (zlib.crc32(g.encode()) * 0x9E3779B1 >> 26 & 63)
    return out


def postings(words: DataFrame, dictionary: dict[str, int], longest: int = LONGEST) -> DataFrame:
    """``key`` (gram, side and distance hashed together; a collision only adds
    candidates; the lowest bit is the side), word, n, its bound and the bit set of
    all its grams."""
    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                piece = batch.slice(begin, 4096)
                key, row, bound, bits = [], [], [], []
                for i, word in enumerate(piece.column("word").to_pylist()):
                    grams = decompose(word, dictionary, longest)
                    k, b = most_affected(grams), _bits(grams)
                    b -= b >> 63 << 64
                    order = sorted(range(len(grams)), key=lambda p: (dictionary.get(grams[p], 0), grams[p], p))
                    for p in order[:k + 1]:
                        gram = grams[p].encode()
                        # distances from the left and from the right end
                        for side, far in ((0, p), (1, len(grams) - p)):
                            tail = b"%d:%d" % (side, far)
                            key.append((zlib.crc32(gram + tail) << 31 ^ zlib.crc32(tail + gram)) & -2 | side)
                            row.append(i)
                    bound += [k] * (len(key) - len(bound))
                    bits += [b] * (len(key) - len(bits))
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), piece.column("word").take(row), piece.column("n").take(row),
                     pa.array(bound, pa.int32()), pa.array(bits, pa.int64())], names=["key", "word", "n", "bound", "bits"])

    return map_arrow(words.select("word", "n"), run, "key long, word string, n long, bound int, bits long")


def one_edit(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    more = len(b) - len(a)
    if more > 1 or a == b:
        return False
    same, end = 0, len(a)
    while same < end:  # the longest common beginning
        half = same + (end - same + 1) // 2
        if a[same:half] == b[same:half]:
            same = half
        else:
            end = half - 1
    return a[same + 1 - more:] == b[same + 1:]


def _alike(code: np.ndarray, at: np.ndarray, to: np.ndarray, least: np.ndarray, step: int) -> np.ndarray:
    """How many code points from ``at`` and ``to`` on (by ``step``) are equal, ``least`` at most."""
    out = np.zeros(len(at), np.int64)
    left = np.flatnonzero(least > 0)
    far = 0
    while len(left):
        left = left[code[at[left] + far * step] == code[to[left] + far * step]]
        far += 1
        out[left] = far
        left = left[least[left] > far]
    return out


def _one_edit(words: list[str], length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``one_edit`` of many pairs of different words, none of them shorter at ``j``."""
    short = length[j] <= SHORT
    out = np.zeros(len(i), bool)
    for k in np.flatnonzero(~short).tolist():
        out[k] = one_edit(words[i[k]], words[j[k]])
    i, j = i[short], j[short]
    code = np.frombuffer("".join([w for w in words if len(w) <= SHORT]).encode("utf-32-le"), np.uint32)
    end = np.cumsum(np.where(length <= SHORT, length, 0))
    m, n = length[i], length[j]
    begin = _alike(code, end[i] - m, end[j] - n, m, 1)
    out[short] = begin + _alike(code, end[i] - 1, end[j] - 1, m - begin, -1) >= np.where(n == m, m - 1, m)
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.flatnonzero(np.diff(x, prepend=x[:1] - 1))]


def _near_in_cells(rows: pa.Table) -> pa.Table:
    """Near pairs of whole cells, rows sorted by cell."""
    new = np.zeros(rows.num_rows, bool)
    for c in CELL:
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    coded = rows.column("word").combine_chunks().dictionary_encode()
    word, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    length = np.array([len(w) for w in words], np.int64)
    # by cell and, in that, by length: partners are the rows that follow, up to one code point more
    place = np.cumsum(new) << 32 | length[word]
    order = np.argsort(place, kind="stable")
    place, word = place[order], word[order]
    key, side, bound, bits = (rows.column(c).to_numpy()[order] for c in ("key", "side", "bound", "bits"))
    bits = bits.view(np.uint64)
    after = np.arange(1, len(place) + 1)
    # words of equal length that meet at a distance from the right meet at one from the left, too
    begin = np.where(key & 1, np.searchsorted(place, place, "right"), after)
    each = np.searchsorted(place, place + 1, "right") - begin
    ends = np.cumsum(each)
    found, first = [np.zeros(0, np.int64)], 0
    while first < len(each):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - each[first] + PAIRS, "right")))
        n = each[first:last]
        i = np.repeat(np.arange(first, last, dtype=np.int32), n)
        j = np.arange(len(i), dtype=np.int32)
        j += np.repeat((begin[first:last] - (np.cumsum(n) - n)).astype(np.int32), n)
        # merged lists count what both share; the bounds say what one edit may cost
        x, y = bits[i], bits[j]
        good = np.bitwise_count(x & ~y) <= bound[i]
        good &= np.bitwise_count(y & ~x) <= bound[j]
        good &= (side[i] < 0) | (side[i] != side[j])
        x, y = word[i[good]].astype(np.int64), word[j[good]].astype(np.int64)
        found.append(_distinct((np.minimum(x, y) * len(words) + np.maximum(x, y))[x != y]))
        first = last
    # a pair that meets in several cells is looked at once
    x, y = np.divmod(_distinct(np.concatenate(found)), max(1, len(words)))
    swap = length[x] > length[y]
    i, j = np.where(swap, y, x), np.where(swap, x, y)
    near = _one_edit(words, length, i, j)
    i, j = i[near], j[near]
    # bytes of UTF-8 are ordered as code points
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(words))
    swap = rank[i] > rank[j]
    a, b = pa.array(np.where(swap, j, i)), pa.array(np.where(swap, i, j))
    n = np.empty(len(words), np.int64)
    n[coded.indices.to_numpy()] = rows.column("n").to_numpy()
    n = pa.array(n)
    return pa.table([coded.dictionary.take(a), n.take(a), coded.dictionary.take(b), n.take(b)], names=["a", "n_a", "b", "n_b"])


def near_pairs(words: DataFrame, longest: int = LONGEST, size: int = DICTIONARY, frequent: int = FREQUENT,
               cell_rows: int = CELL_ROWS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Each pair of near words once: a < b with their counts n_a and n_b."""
    dictionary = gram_dictionary(words, longest, size, frequent)
    lists = postings(words, dictionary, longest)
    # only lists that need splitting are written: few, so that the join is planned without a shuffle
    heavy = materialize(
        lists.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("word")).alias("bytes"))
        .where((F.col("rows") > cell_rows) | (F.col("bytes") > cell_bytes))
        .select("key", F.greatest(F.ceil(F.col("rows") / cell_rows), F.ceil(F.col("bytes") / cell_bytes)).cast("int").alias("parts")),
        "variants-heavy")
    whole = lists.join(heavy, "key", "left")
    mine = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = whole.select("*", F.coalesce(mine, F.lit(-1)).alias("mine"), other.alias("other")).select(
        "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
        # -1 where all pairs of the cell count
        F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        "word", "n", "bound", "bits")
    dealt = cells.repartition(*CELL).sortWithinPartitions(*CELL)

    def compare(batches):
        held, rows, size, most = [], 0, 0, ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            size += batch.nbytes
            if rows >= most or size >= 4 * CELL_BYTES:
                whole = pa.Table.from_batches(held)
                cell = np.stack([whole.column(c).to_numpy() for c in CELL])
                begins = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
                # the last cell may go on
                cut = int(begins[-1]) if len(begins) else 0
                yield from _near_in_cells(whole.slice(0, cut)).to_batches()
                held = whole.slice(cut).to_batches()
                rows, size, most = rows - cut, 0, rows - cut + ROWS
        if rows:
            yield from _near_in_cells(pa.Table.from_batches(held)).to_batches()

    found = map_arrow(dealt, compare, "a string, n_a long, b string, n_b long")
    return materialize(found.distinct(), "variants-pairs")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for every row of ``forms`` (word, form), by pointer jumping."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, ratio: float = RATIO, **index) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``words`` (distinct words
    of at least ``LONGEST`` code points with their counts ``n``); ``ratio`` is above 1."""
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word")
    pairs = near_pairs(words, **index)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "near")).alias("best"))
    likely = -F.col("best.minus") >= ratio * F.col("n")
    placed = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("best.near")).alias("form"),
        F.when(likely, -F.col("best.minus")).alias("form_n")), "variants-forms")
    ends = roots(placed.where("form IS NOT NULL"))
    return placed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, drop: int = DROP, least: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: float = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of ``docs``."""
    words = materialize(word_counts(docs, drop, least, min_count), "variants-words")
    return variants(words, ratio, longest=min(LONGEST, least))
