"""BPE encoding and decoding of whole texts, with tree concatenation.

The tokenizer works on words: no token crosses white space, so a text's ids
are its words' ids in order, and each distinct word is encoded once per task.
The costly case is *unsplit text*: a run without white space that the
pre-tokenizer leaves whole, as long as the document itself. Such a run is cut
into leaves that are encoded in parallel, on any executor, and put together
again as a tree. At each join a window around it is encoded anew, growing
until it agrees with the left half in one token and, after that, with the
right half in one (same place, same id). The tokens of the left half up to
the first agreement, the window's tokens between, and the right half's from
the second on are then a sequence in which every neighbouring pair occurs in
a valid encoding. A BPE encoding with ranked merges is valid exactly when all
its neighbouring pairs are, so this is the encoding of the whole run. A window
that never agrees grows to the whole of both halves, which is exact by itself.

Defined results: a null text is empty and has no ids; null ids and repeated
rows are kept as they are; special tokens' strings in a text become special
tokens, as the library does; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.byte_bpe import byte_of_char
from inkwell.llm.common import map_arrow, materialize, text_of

LEAF = 4096
WINDOW = 64
# words kept by a task, in two generations, by number and by characters; longer
# ones than ``CACHE_LENGTH`` are kept for the batch at hand only
CACHE_WORDS = 600_000
CACHE_CHARS = 6_000_000
CACHE_LENGTH = 64
BATCH_ROWS = 512
# white space at which every pattern engine and normalizer agrees
SPACES = re.compile(r"[ \t\n\r]+")
# plain Latin text, and how the word-level tokenizer splits it (lower-cased);
# fixed by the vocabulary file and held against it when that is loaded
OTHER = re.compile(r"[^ \t\n\r\x21-\x7eÀ-ÖØ-öø-ÿ]")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
BYTE_CHARS = {b: c for c, b in byte_of_char().items()}


class WordBpe:
    """One vocabulary file on one executor."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        added = [a.content for a in t.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # known words of two generations, so that a full cache keeps the frequent ones
        self.words: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.chars = 0
        self.passing: list[str] = []
        self.names = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
        self.plain = self._splits_as_expected()

    def _splits_as_expected(self) -> bool:
        """Whether the file's tokenizer splits Latin text as ``PIECE`` does: held
        against the library on a line with every such character in many places."""
        letters = [*map(chr, range(0x21, 0x7F)), *map(chr, range(0xC0, 0x100))]
        letters = [c for c in letters if c not in "×÷"]
        probe = " ".join(f"{c} {c}{c} a{c} {c}a 1{c} {c}1 '{c} {c}' .{c} {c}. Aé{c}'s{c} it'LL{c} i'm{c}'re" for c in letters)
        want = self.tokenizer.encode(probe, add_special_tokens=False).ids
        return [i for x in PIECE.findall(probe.lower()) for i in self._piece_ids(x)] == want

    def _piece_ids(self, piece: str) -> list[int]:
        mapped = piece if piece.isascii() else "".join(BYTE_CHARS[b] for b in piece.encode())
        return [x.id for x in self.tokenizer.model.tokenize(mapped)]

    def split(self, text: str) -> tuple[list[str], bool]:
        """The text's parts that no token crosses, and whether they are pieces (of
        plain Latin text) or else words."""
        if self.plain and not OTHER.search(text) and not (self.special and self.special.search(text)):
            return PIECE.findall(text.lower()), True
        return SPACES.split(text), False

    def learn(self, words: set[str], pieces: set[str]) -> None:
        """Have decimal ids and decoded tokens of all ``words`` and ``pieces`` at hand.

        A piece goes straight to the model, which takes a fraction of what a
        word takes through the whole tokenizer."""
        for w in self.passing:
            self.words.pop(w, None)
        if len(self.words) > CACHE_WORDS // 2 or self.chars > CACHE_CHARS // 2:
            self.words, self.older, self.chars = {}, self.words, 0
        known, older = self.words, self.older
        again = [w for w in (words | pieces) & older.keys() if w not in known]
        for w in again:
            known[w] = older[w]
        fresh = list(pieces - known.keys())
        for w in fresh:
            known[w] = self.strings(self._piece_ids(w))
        new = list(words - known.keys())
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            known[w] = self.strings(e.ids)
        fresh += new
        self.passing = [w for w in fresh if len(w) > CACHE_LENGTH]
        self.chars += sum(map(len, again)) + sum(map(len, fresh)) - sum(map(len, self.passing))

    def strings(self, ids: list[int]) -> tuple[str, str]:
        """Decimal ids and decoded tokens."""
        if self.tokenizer.decoder is not None:
            return " ".join(map(str, ids)), self.tokenizer.decode(ids, skip_special_tokens=False)
        # without a decoder, decoding joins the tokens by a space
        return " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])

    def parts(self, word: str):
        """The parts of a long word: encoded ones as (ids, decoded), unsplit runs as strings."""
        for piece in self.special.split(word) if self.special else [word]:
            if not piece:
                continue
            if self.special and self.special.fullmatch(piece):
                i = self.tokenizer.token_to_id(piece)
                yield str(i), piece
                continue
            normal = self.tokenizer.normalizer.normalize_str(piece) if self.tokenizer.normalizer else piece
            ids = []
            for run, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                if len(run) <= LEAF:
                    ids += [t.id for t in self.tokenizer.model.tokenize(run)]
                    continue
                if ids:
                    yield self.strings(ids)
                    ids = []
                yield run
            if ids:
                yield self.strings(ids)

    def encode_run(self, run: str):
        """(ids, starts) of an unsplit run by the model alone."""
        tokens = self.tokenizer.model.tokenize(run)
        width = np.array([len(t.value.removesuffix("</w>")) if i == len(tokens) - 1 else len(t.value)
                          for i, t in enumerate(tokens)], np.int64)
        assert width.sum() == len(run)
        return np.array([t.id for t in tokens], np.int64), np.cumsum(width) - width


def join(left, right, encode, window: int = WINDOW):
    """The encoding of two neighbouring runs, each ``(run, ids, starts)``."""
    (a, a_ids, a_at), (b, b_ids, b_at) = left, right
    n = len(a)
    while True:
        i = max(0, int(np.searchsorted(a_at, n - window, side="right")) - 1)
        j = min(len(b_at), int(np.searchsorted(b_at, window, side="left")))
        begin, end = int(a_at[i]), int(b_at[j]) if j < len(b_at) else len(b)
        ids, at = encode(a[begin:] + b[:end])
        at = at + begin
        if begin == 0 and end == len(b):
            return a + b, ids, at
        # agreement with the left half: a common token before the join
        mine = {(s, t): k for k, (s, t) in enumerate(zip(at.tolist(), ids.tolist()))}
        low = 0 if begin == 0 else None
        keep_a = 0
        for k in range(len(a_ids) - 1, i - 1, -1):
            m = mine.get((int(a_at[k]), int(a_ids[k])))
            if m is not None and begin > 0:
                low, keep_a = m, k
                break
        high, keep_b = (len(ids), len(b_ids)) if end == len(b) else (None, 0)
        for k in range(j):
            m = mine.get((int(b_at[k]) + n, int(b_ids[k])))
            if m is not None and (low is None or m > low) and end < len(b):
                high, keep_b = m, k
                break
        if low is not None and high is not None:
            return (a + b, np.concatenate([a_ids[:keep_a], ids[low:high], b_ids[keep_b:]]),
                    np.concatenate([a_at[:keep_a], at[low:high], b_at[keep_b:] + n]))
        window *= 2


def tree(leaves: list, encode, window: int = WINDOW):
    """The leaves' concatenation, joined in pairs, then in pairs of pairs."""
    while len(leaves) > 1:
        leaves = [join(leaves[i], leaves[i + 1], encode, window) if i + 1 < len(leaves) else leaves[i]
                  for i in range(0, len(leaves), 2)]
    return leaves[0]


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _result(ids: list[str], decoded: list[str]):
    text = " ".join(ids)
    return (text.count(" ") + 1 if text else 0, text, " ".join(decoded))


RESULT = ("n_tokens", "ids", "decoded")


def encode_decode(docs: DataFrame, tokenizer_path: str, leaf: int = LEAF, digests: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (decimal, joined by one space) and
    ``decoded`` for every row of ``docs``; with ``digests``, the SHA-256 of the
    last two in their place, so that no text is written.
    """
    rows = docs.select("doc_id", text_of().alias("_text"))
    final = (lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()) if digests else (lambda s: s)
    # part, row: the document of a run; place: the run's place in it; step: the leaf's place in the run
    schema = rows.select(
        "doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids"), F.lit("").alias("decoded"),
        F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("place"),
        F.lit(0).cast("long").alias("step"), F.lit("").alias("run")).schema

    def encode(batches):
        bpe, part, row = word_bpe(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                piece = batch.slice(begin, BATCH_ROWS)
                texts = piece.column("_text").to_pylist()
                split = [bpe.split(t) for t in texts]
                # a document with a long piece is split again, into words
                split = [(SPACES.split(t), False) if plain and max(map(len, own), default=0) > leaf else (own, plain)
                         for t, (own, plain) in zip(texts, split)]
                pieces = set().union(*(own for own, plain in split if plain))
                words = set().union(*(own for own, plain in split if not plain)) - {""}
                long = {w for w in words if len(w) > leaf}
                bpe.learn(words - long, pieces)
                table = bpe.words
                out = []
                for i, (own, plain) in enumerate(split):
                    row += 1
                    if plain or not long or long.isdisjoint(own):
                        got = [table[w] for w in own if w]
                        if not plain:  # a word may hold nothing but white space of other kinds
                            got = [g for g in got if g[0]]
                        n, ids, text = _result([g[0] for g in got], [g[1] for g in got])
                        out.append((i, n, final(ids), final(text), None, None, None, None, None))
                        continue
                    place, held = 0, []
                    for w in own:
                        for x in ([table[w]] if w in table else bpe.parts(w) if w else []):
                            if isinstance(x, tuple):
                                held += [x] * bool(x[0])
                                continue
                            n, ids, text = _result([g[0] for g in held], [g[1] for g in held])
                            out.append((i, n, ids, text, part, row, place, 0, None))
                            place, held = place + 2, []
                            out += [(i, None, None, None, part, row, place - 1, k, x[a:a + leaf])
                                    for k, a in enumerate(range(0, len(x), leaf))]
                    n, ids, text = _result([g[0] for g in held], [g[1] for g in held])
                    out.append((i, n, ids, text, part, row, place, 0, None))
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(columns[0], pa.int64())),
                     *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], names=schema.names)

    found = materialize(map_arrow(rows, encode, schema), "bpe-words")
    done = found.where("row IS NULL").select("doc_id", *RESULT)
    pieces = found.where("row IS NOT NULL")

    def leaves(batches):
        bpe = word_bpe(tokenizer_path)
        for batch in batches:
            coded = [bpe.encode_run(r) for r in batch.column("run").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("part", "row", "place", "step", "run")),
                 pa.array([i.tolist() for i, _ in coded], pa.list_(pa.int64())),
                 pa.array([s.tolist() for _, s in coded], pa.list_(pa.int64()))],
                names=["part", "row", "place", "step", "run", "run_ids", "run_starts"])

    coded = map_arrow(
        pieces.where("run IS NOT NULL").select("part", "row", "place", "step", "run").repartition("part", "row", "place", "step"),
        leaves, "part long, row long, place long, step long, run string, run_ids array<bigint>, run_starts array<bigint>")
    both = pieces.where("run IS NULL").select(
        "part", "row", "place", "step", "run", F.lit(None).cast("array<bigint>").alias("run_ids"),
        F.lit(None).cast("array<bigint>").alias("run_starts"), F.col("doc_id").cast("string").alias("doc_id"), "ids",
        "decoded").unionByName(
        coded, allowMissingColumns=True)
    id_type = dict(docs.select("doc_id").dtypes)["doc_id"]

    def assemble(pdf):
        bpe = word_bpe(tokenizer_path)
        ids, text = [], []
        for _, own in pdf.sort_values(["place", "step"]).groupby("place", sort=True):
            if own.run.iloc[0] is None:
                ids += [own.ids.iloc[0]] * bool(own.ids.iloc[0])
                text += [own.decoded.iloc[0]] * bool(own.ids.iloc[0])
                continue
            _, found, _ = tree([(r, np.asarray(i), np.asarray(s)) for r, i, s in zip(own.run, own.run_ids, own.run_starts)],
                               bpe.encode_run)
            a, b = bpe.strings(found.tolist())
            ids.append(a)
            text.append(b)
        n, joined, decoded = _result(ids, text)
        doc = next((x for x, r in zip(pdf.doc_id, pdf.run) if r is None), None)
        import pandas as pd

        return pd.DataFrame({"doc_id": pd.Series([doc], dtype=object), "n_tokens": [n], "ids": [final(joined)],
                             "decoded": [final(decoded)]})

    # one group is the runs of one document
    long_docs = both.groupBy("part", "row").applyInPandas(
        assemble, "doc_id string, n_tokens long, ids string, decoded string").withColumn("doc_id", F.col("doc_id").cast(id_type))
    return done.unionByName(long_docs)
