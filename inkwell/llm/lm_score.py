"""Scores every text by a language model learnt from the training documents.

Jobs, in order:

1. One pass over the texts cuts each task's documents into *blocks* of at most
   ``block_bytes`` of text. A block is one row: its documents as indices into
   the block's distinct words, and those words' subword ids. Each distinct
   word of a block is also one row, with its count in training documents.
2. Corpus counts: a window over a word's rows gives every block's row the sum
   of all; subword counts and class pairs as one vector per task, added up in a tree.
3. The training documents' classes, a byte a subword, are written by round. The
   attention model (``attention_lm``) is trained data-parallel on every training
   document: a hash of its id and classes deals it to a round and, in that, to one of
   ``trainers``, each of about ``SHARD`` tokens and one task, which steps over its
   documents in the order of their hashes. The trainers' parameters are averaged,
   weighted by tokens, once per round. ``train_share`` is for tests; the query leaves
   it at 1, which is all.
4. Scoring: each block meets the counts of its own words in one task: the smoothed
   unigram base score, and the model's log10 probability. The attention model
   scores every subword once, in overlapping context windows; a word's
   probability is a mixture of the attention model's and the unigram model's, so
   a frequent word is not spelled out and an unknown word is. All shares in
   ``MIXES`` are scored in the same pass; the one is taken under which the
   training documents are likeliest, each word's own occurrence left out of its
   unigram count. No task sees the vocabulary of the corpus.

A block has a bounded size, so do the model, each task's vectors and each trainer's
share of a round. A hot word is one row of some bytes per block, whatever its
occurrences. Neither the counts nor the parameters depend
on how documents fall into tasks: how many trainers there are follows from the
number of training tokens.

Defined results: a null text is empty (one token, the end); a null id counts
as the empty string's hash, which is training; repeated rows count as often
as they occur; with no training documents all counts are 0 and the model is
uniform over its classes; an empty table gives an empty table; other columns
are ignored. A text of any length is one document; one of more than ``PIECE``
subwords is scored as a whole, in groups of its own, and trained on in pieces of
that size, each with the classes before it as its context. Equal documents with
equal ids are dealt by their number in the block.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import attention_lm as lm
from inkwell.llm.byte_bpe import byte_bpe
from inkwell.llm.common import map_arrow, materialize, ship, text_of

BLOCK_BYTES = 24 << 20
HELD_OUT = (7, 2)
TRAIN_SHARE = 1
ROUNDS = 4
# tokens whose windows are held at once
GROUP = 200_000
# words put together at once
WORDS = 1 << 17
# vectors added up in one task
SUMS = 32
# training tokens of one trainer in one round, and of one row of them
SHARD = 1 << 20
PIECE = 1 << 16
# blocks of tokens to one step, and the step size by round
BATCH = 128
RATES = (0.04, 0.03, 0.015, 0.005)
# probabilities multiplied before a logarithm is taken: each is at least 1e-17
PRODUCT = 16
MIXES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
# byte-level vocabularies have well below 65,536 ids
ID = "<u2"


class Subwords:
    """Subword ids of a document's words, and which subwords begin a word.

    The words are joined by one space each, also before the first, so that a
    word begins exactly where a subword begins with a space.
    """

    def __init__(self, path: str):
        self.bpe = byte_bpe(path)
        vocabulary = self.bpe.exact.get_vocab()
        self.size = self.bpe.exact.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("ids are stored in 16 bits")
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each word has."""
        out, sizes = [np.zeros(0, ID)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 4096):
            part = words.slice(i, 4096)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")
            ids = self.bpe.encode(" " + joined[0].as_py()).astype(ID)
            first = np.flatnonzero(self.begins[ids])
            if len(first) == len(part):
                out.append(ids)
                sizes.append(np.diff(first, append=len(ids)))
                continue
            # other white space inside words has hidden the start of one
            each = [self.bpe.encode(" " + w).astype(ID) for w in part.to_pylist()]
            out += each
            sizes.append(np.array([len(x) for x in each]))
        return np.concatenate(out), np.concatenate(sizes)


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts (A-Z lower-cased, cut at ASCII white space), numbered in the
    order they first occur, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten()
    # white space at either end leaves an empty word there
    real = pc.not_equal(words, "")
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    cuts = split.offsets.to_numpy()
    return words.filter(real).dictionary_encode(), np.diff(kept[cuts - cuts[0]])


_subwords: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _subwords:
        _subwords[path] = Subwords(path)
    return _subwords[path]


BLOCKS = ("block string, word binary, place int, n long, "
          "ids array<struct<doc_id:{id},held:boolean,turn:int,length:int>>, places binary, subwords binary, ends binary")


def blocks_of(docs: DataFrame, tokenizer_path: str, block_bytes: int = BLOCK_BYTES, train_share: int = TRAIN_SHARE,
              rounds: int = ROUNDS) -> DataFrame:
    """Rows of blocks (``word`` null) and of their distinct words (``ids`` null). A
    document's ``turn`` is the round that trains on it, null outside the share."""
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    mod, rest = HELD_OUT
    dealt = F.crc32(F.concat(text_id, F.lit("/share")).cast("binary"))
    turn = F.when(dealt % train_share == 0, F.floor(dealt / train_share) % max(1, rounds)).cast("int")
    rows = docs.select("doc_id", text_of().alias("_text"), (F.crc32(text_id.cast("binary")) % mod == rest).alias("held"),
                       turn.alias("turn"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = subwords(tokenizer_path)
        part, number, size, parts = TaskContext.get().partitionId(), 0, 0, []
        names = ["block", "word", "place", "n", "ids", "places", "subwords", "ends"]

        def flush():
            nonlocal number, size
            if not parts:
                return
            name = f"{part}-{number}"
            held = np.concatenate([x.column("held").to_numpy(zero_copy_only=False) for x, *_ in parts])
            lengths = np.concatenate([n for *_, n in parts])
            numbered = pa.chunked_array([w for _, w, _ in parts]).unify_dictionaries().chunks
            words, flat = numbered[0].dictionary, np.concatenate([w.indices.to_numpy() for w in numbered])
            id_array, turns = (pa.concat_arrays([x.column(c) for x, *_ in parts]) for c in ("doc_id", "turn"))
            parts.clear()
            del numbered
            counts = np.bincount(flat[np.repeat(~held, lengths)], minlength=len(words))
            coded, sizes = coder.encode(words)
            ends = (np.cumsum(sizes) * coded.itemsize).astype("<u4")
            members = pa.StructArray.from_arrays(
                [id_array, pa.array(held), turns, pa.array(lengths, pa.int32())], ["doc_id", "held", "turn", "length"])
            whole = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), members)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), whole,
                 *(pa.array([_packed(x)], pa.binary()) for x in (flat.astype("<u4").tobytes(), coded.tobytes(), ends.tobytes()))],
                names=names)
            for i in range(0, len(words), 20_000):
                w = words[i:i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(w)), w.cast(pa.binary()), pa.array(np.arange(i, i + len(w)), pa.int32()),
                     pa.array(counts[i:i + len(w)], pa.int64()), pa.nulls(len(w), whole.type), *[pa.nulls(len(w), pa.binary())] * 3],
                    names=names)
            number, size = number + 1, 0
            # Arrow keeps what it frees, and the block's room is wanted elsewhere
            words = w = members = whole = None
            pa.default_memory_pool().release_unused()

        for batch in batches:
            done = 0
            for i, n in enumerate(pc.utf8_length(batch.column("_text")).to_pylist(), 1):
                size += n
                if size >= block_bytes or i == len(batch):
                    texts = batch.slice(done, i - done)
                    parts.append((texts.drop_columns(["_text"]), *words_of(texts.column("_text"))))
                    done = i
                    if size >= block_bytes:
                        yield from flush()
        yield from flush()

    return map_arrow(rows, run, BLOCKS.format(id=id_type))


def _packed(data: bytes) -> bytes:
    """Blocks are written, and shuffled once, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(data)


def _array(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _documents(row: dict, wanted=lambda member: True):
    """(member, word places, subwords) of a block's documents."""
    places, ends, data = (_array(row[c], k) for c, k in (("places", "<u4"), ("ends", "<u4"), ("subwords", ID)))
    ends = ends.astype(np.int64) // data.itemsize
    sizes = np.diff(ends, prepend=0)
    group, size, at = [], 0, 0
    for i, member in enumerate(row["ids"], 1):
        own = places[at:at + member["length"]]
        at += member["length"]
        if wanted(member):
            group.append((member, own))
            size += len(own)
        if group and (size >= WORDS or i == len(row["ids"])):
            all_words = group[0][1] if len(group) == 1 else np.concatenate([own for _, own in group])
            ids = np.concatenate([data[:0], *(_coded(all_words[a:a + WORDS], ends, sizes, data) for a in range(0, size, WORDS))])
            cuts = np.concatenate([[0], np.cumsum(sizes[all_words])])[np.cumsum([0] + [len(own) for _, own in group])].tolist()
            yield from ((*x, ids[a:b]) for x, a, b in zip(group, cuts, cuts[1:]))
            group, size = [], 0


def _coded(words: np.ndarray, ends: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The words' subwords, one word after another."""
    n = np.take(sizes, words)
    at = np.repeat(np.take(ends, words) - np.cumsum(n), n)
    at += np.arange(len(at))
    return np.take(data, at)


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def summed(vectors: DataFrame, length: int, count: int | None = None) -> np.ndarray:
    """The sum of one vector (binary doubles) per task, added up on the executors
    as they stream by, ``SUMS`` or so to a task, until at most ``SUMS`` are left
    for the driver. ``count``, where known, is how many there are. Whole numbers below 2^53 add up exactly in any order."""
    def add(batches):
        total, task = np.zeros(length), None
        for batch in batches:
            for t, v in zip(batch.column("task").to_pylist(), batch.column("vector")):
                total += np.frombuffer(v.as_buffer())
                task = t if task is None else min(t, task)
        if task is not None:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                             names=["task", "vector"])

    if count is None:
        vectors = materialize(vectors, "lm-vectors")
        count = vectors.count()
    while count > SUMS:
        count = -(-count // SUMS)
        vectors = materialize(map_arrow(vectors.repartition(count, "task"), add, "task int, vector binary"), "lm-vectors")
    parts = sorted(vectors.collect(), key=lambda r: r["task"])
    return sum((np.frombuffer(bytes(r["vector"])) for r in parts), np.zeros(length))


def _per_task(blocks: DataFrame, function) -> DataFrame:
    """One vector per task: ``function`` gets the task's block rows."""
    def run(batches):
        vector = function(_rows(batches))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          pa.array([vector.astype(np.float64).tobytes()], pa.binary())], names=["task", "vector"])

    return map_arrow(blocks, run, "task int, vector binary")


def fit(blocks: DataFrame, tokenizer_path: str, rounds: int = ROUNDS):
    """(parameters, bigram logits, class of each subword, log10 share of it in its class)."""
    coder = subwords(tokenizer_path)
    size, k = coder.size, lm.CLASSES

    def count(rows):
        # a word's subwords count as often as the word does in training documents
        total = np.zeros(size)
        for row in rows:
            places, ends = _array(row["places"], "<u4"), _array(row["ends"], "<u4").astype(np.int64)
            train = np.repeat([not m["held"] for m in row["ids"]], [m["length"] for m in row["ids"]]).astype(bool)
            n = np.bincount(places[train], minlength=len(ends))
            each = np.diff(ends, prepend=0) // np.dtype(ID).itemsize
            total += np.bincount(_array(row["subwords"], ID), np.repeat(n, each), size)
        return total

    counts = summed(_per_task(blocks, count), size)
    of, share = lm.classes_of(counts, coder.begins)
    of = of.astype(np.uint8)
    trainers = max(1, -(-int(counts.sum()) // (SHARD * max(1, rounds))))
    sequences = materialize(sequences_of(blocks, of), "lm-classes", "turn")

    def pairs(batches):
        total = np.zeros(k * k)
        for batch in batches:
            lines = [(before[-1:] or END) + classes + (END if last else b"")
                     for before, classes, last in zip(*(batch.column(c).to_pylist() for c in ("before", "classes", "last")))]
            for i in range(0, len(lines), 64):
                some = lines[i:i + 64]
                line = np.frombuffer(b"".join(some), np.uint8).astype(np.uint16)
                pair = line[:-1] * np.uint16(k) + line[1:]
                # where one line meets the next is no pair
                total += np.bincount(np.delete(pair, np.cumsum([len(x) for x in some])[:-1] - 1), minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          pa.array([total.tobytes()], pa.binary())], names=["task", "vector"])

    bigram = lm.bigram_logits(summed(map_arrow(sequences, pairs, "task int, vector binary"), k * k).reshape(k, k))
    params = lm.start_params()
    n = len(lm.flat(params))
    for r in range(rounds):
        def train(batches, params=params, r=r):
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()),
                 pa.array([trained(_rows(batches), r, params, bigram).tobytes()], pa.binary())], names=["task", "vector"])

        dealt = (sequences.where(F.col("turn") == r).select("key", "before", "classes", "last")
                 .repartitionById(trainers, F.pmod("key", F.lit(trainers)).cast("int"))
                 .sortWithinPartitions("key", "classes", "before", "last"))
        total = summed(map_arrow(dealt, train, "task int, vector binary"), n + 1, trainers)
        if total[-1]:
            params = lm.unflat(total[:-1] / total[-1])
    return params, bigram, of, share


END = bytes([lm.END])
SEQUENCES = "turn int, key long, before binary, classes binary, last boolean"


def sequences_of(blocks: DataFrame, of: np.ndarray) -> DataFrame:
    """Training documents as classes, a byte each, in pieces of at most ``PIECE``, with
    the classes before the piece, whether it is the document's last, and the
    hash that deals and orders the pieces."""
    def run(batches):
        for row in _rows(batches):
            rows, size, copies = [], 0, Counter()
            for member, _, ids in _documents(row, lambda m: not m["held"]):
                classes = of[ids].tobytes()
                name = f"{member['doc_id']}/{zlib.crc32(classes)}"
                copies[name] += 1
                for at in range(0, max(1, len(classes)), PIECE):
                    key = xxhash.xxh64_intdigest(f"{name}/{copies[name]}/{at}") >> 1
                    rows.append((member["turn"], key, classes[max(0, at - lm.BLOCK - 1):at], classes[at:at + PIECE],
                                 at + PIECE >= len(classes)))
                size += len(classes) + 64
                if size >= 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows):
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)],
                                          names=["turn", "key", "before", "classes", "last"])

    return map_arrow(blocks, run, SEQUENCES)


def trained(rows, turn: int, params, bigram) -> np.ndarray:
    """The parameters after a round over the training pieces in ``rows``, times the
    tokens stepped over, and these."""
    trainer = lm.Trainer(params, bigram, RATES[min(turn, len(RATES) - 1)], BATCH)
    group, size = [], 0
    for row in rows:
        group.append(tuple(np.frombuffer(row[c], np.uint8) for c in ("before", "classes")) + (row["last"],))
        size += len(row["classes"]) + 1
        if size >= GROUP:
            trainer.feed(group)
            group, size = [], 0
    trainer.feed(group)
    return np.append(lm.flat(trainer.params) * trainer.tokens, trainer.tokens)


def counts_of(words: DataFrame) -> DataFrame:
    """Every row of a word with the sum of all its rows, where it occurs in training
    documents; ``first`` marks one row of each word. The rows move once."""
    own = Window.partitionBy("word")
    return words.select("block", "place", F.sum("n").over(own).alias("c"),
                        (F.row_number().over(own.orderBy("word")) == 1).alias("first")).where("c > 0")


def score(docs: DataFrame, tokenizer_path: str, block_bytes: int = BLOCK_BYTES, train_share: int = TRAIN_SHARE,
          rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    spark = docs.sparkSession
    both = materialize(blocks_of(docs, tokenizer_path, block_bytes, train_share, rounds), "lm-blocks")
    blocks = both.where("word IS NULL").select("block", "ids", "places", "subwords", "ends")
    words = both.where("word IS NOT NULL").select("block", "word", "place", "n")
    counted = materialize(counts_of(words), "lm-counts")
    sums = counted.where("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = blocks.select(F.coalesce(F.sum(F.size(F.filter("ids", lambda m: ~m["held"]))), F.lit(0))).first()[0]
    n, distinct = sums[0] + ends, sums[1] + (ends > 0)
    params, bigram, of, share = fit(blocks, tokenizer_path, rounds)
    begins = subwords(tokenizer_path).begins
    known = counted.select(F.col("block").alias("own_block"), "place", "c")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    total = n + distinct + 1

    def judge(left, right):
        out = []
        place, c = right.column("place").to_numpy(), right.column("c").to_numpy()
        for row in left.to_pylist():
            docs_here = list(_documents(row))
            count = np.zeros(1 + max((int(own.max(initial=0)) for _, own, _ in docs_here), default=0), np.int64)
            count[place] = c
            unigram = (count + 1) / total
            last = (ends + 1) / total
            word_score = np.log10(unigram)
            base = []
            # documents in groups of bounded size
            model, held, size = [], [], 0
            for i, (m, own, ids) in enumerate(docs_here):
                c = np.take(count, own)
                base.append((np.count_nonzero(c) + (ends > 0), float(np.take(word_score, own).sum() + np.log10(last))))
                left_out = None if m["held"] else np.append(c, ends) / (total - 1)
                held.append((ids, np.flatnonzero(begins[ids]), np.append((c + 1) / total, last), left_out))
                size += len(ids)
                if size >= GROUP or i == len(docs_here) - 1:
                    model += _model_scores(held, params, bigram, of, share)
                    held, size = [], 0
            out += [(m["doc_id"], m["held"], m["length"] + 1, b[0], n, b[1], *s)
                    for (m, _, _), b, s in zip(docs_here, base, model)]
        columns = list(zip(*out)) or [[]] * 8
        ids = left.schema.field("ids").type.value_type.field("doc_id").type
        kinds = (ids, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(),
                 pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)], names=[*RESULT, "left_out"])

    ship(spark.sparkContext)
    scored = materialize(blocks.groupBy("block").cogroup(known.groupBy("own_block")).applyInArrow(
        judge, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
               "score array<double>, left_out array<double>"), "lm-scored")
    mixes = scored.select(*[F.coalesce(F.sum(F.get("left_out", F.lit(i))), F.lit(0.0)) for i in range(len(MIXES))]).first()
    # without training documents all are alike: the middle one
    best = max(range(len(MIXES)), key=lambda i: (mixes[i], -abs(MIXES[i] - 0.5)))
    return scored.select(*RESULT[:-1], F.get("score", F.lit(best)).alias("score"))


RESULT = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _model_scores(documents: list[tuple], params, bigram, of, share) -> list[tuple[list[float], list[float] | None]]:
    """log10 probabilities of documents (subwords, where their words begin, unigram
    probabilities of the words and the end, the same with each one's own occurrence
    left out or None): word by word a mixture of what the attention model and the
    unigram model give, one figure for each share in ``MIXES``."""
    inputs, has, target, real, _ = lm.windows([of[ids] for ids, *_ in documents])
    logs = lm.log_probs(params, bigram, inputs, has, target)[real].astype(np.float64)
    tokens = np.array([len(ids) + 1 for ids, *_ in documents])
    first = np.cumsum(tokens) - tokens
    subword = np.ones(len(logs), bool)
    subword[first + tokens - 1] = False
    logs[subword] += (share * np.log(10))[np.concatenate([ids for ids, *_ in documents])]
    # the end is a word of its own
    by_word = np.exp(np.add.reduceat(logs, np.concatenate([np.append(begins, len(ids)) + at for (ids, begins, *_), at in zip(documents, first)])))
    words = np.array([len(begins) + 1 for _, begins, *_ in documents])
    of_all = _mixtures(by_word, [x[2] for x in documents], words)
    some = np.array([x[3] is not None for x in documents])
    left_out = iter(_mixtures(by_word[np.repeat(some, words)], [x[3] for x in documents if x[3] is not None], words[some]))
    return [(x, next(left_out) if has_some else None) for x, has_some in zip(of_all, some)]


def _mixtures(by_word: np.ndarray, unigrams: list[np.ndarray], words: np.ndarray) -> list[list[float]]:
    """For each document, of ``words`` words, its log10 probability by the shares in ``MIXES``."""
    if not unigrams:
        return []
    unigram, first = np.concatenate(unigrams), np.cumsum(words) - words
    starts = np.concatenate([np.arange(at, at + n, PRODUCT) for at, n in zip(first, words)])
    parts = -(-words // PRODUCT)
    docs = np.cumsum(parts) - parts
    return np.stack([np.add.reduceat(np.log10(np.multiply.reduceat(x * by_word + (1 - x) * unigram, starts)), docs)
                     for x in MIXES], axis=1).tolist()
