"""A small causal self-attention model over token classes, in numpy.

Subword ids fall into ``CLASSES`` classes: the most frequent subwords are
classes of their own, the others share classes by frequency and by whether
they begin a word. The model predicts the next class; a subword's probability
is its class's times its share of the class in the training corpus. The softmax
over classes is factored: ``GROUPS`` groups of ``MEMBERS`` consecutive classes,
first the group, then the class among those of its group.

There is one attention head of the model's width. The product of its query and key
matrices is one matrix (``Wq``), that of its value and output matrices another
(``Wv``), so the embedded places themselves are keys and values.

Next-class logits are a bigram table, counted over all training documents,
plus what one attention layer and a two-layer perceptron add. A document is
cut into blocks of ``BLOCK`` tokens; each block attends to itself and the
block before it under a causal mask, so context windows overlap by a block
and each token is scored once, with up to ``2 * BLOCK - 1`` tokens before it.
"""

from __future__ import annotations

import numpy as np

CLASSES = 256
SINGLE = 200
BLOCK = 16
WIDTH = 16
HIDDEN = 32
GROUPS = 16
MEMBERS = CLASSES // GROUPS
END = CLASSES - 1
# blocks scored at once
SCORED = 128
NEVER = np.float32(-1e9)
#: queries (the second block) see keys up to themselves
CAUSAL = np.where(np.arange(2 * BLOCK)[None, :] <= np.arange(BLOCK)[:, None] + BLOCK, 0, NEVER).astype(np.float32)
TURNED = np.ascontiguousarray(CAUSAL.T)
SHAPES = {"E": (CLASSES, WIDTH), "P": (2 * BLOCK, WIDTH), "Wq": (WIDTH, WIDTH), "Wv": (WIDTH, WIDTH), "W1": (WIDTH, HIDDEN), "b1": (HIDDEN,), "W2": (HIDDEN, WIDTH),
          "G": (WIDTH, GROUPS), "U": (GROUPS, WIDTH, MEMBERS)}


def classes_of(counts: np.ndarray, begins_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, log10 share of its class) of every subword, from its training count."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    of = np.zeros(len(counts), np.int64)
    of[order[:SINGLE]] = np.arange(min(SINGLE, len(order)))
    shared = CLASSES - 1 - SINGLE
    for flag, first, n in ((True, SINGLE, shared // 2), (False, SINGLE + shared // 2, shared - shared // 2)):
        rest = order[SINGLE:][begins_word[order[SINGLE:]] == flag]
        mass = np.cumsum(counts[rest] + 1.0)
        if len(rest):
            of[rest] = first + np.minimum((mass - 1e-9) / mass[-1] * n, n - 1).astype(np.int64)
    total = np.bincount(of, counts + 1.0, CLASSES)
    return of, np.log10((counts + 1.0) / total[of])


def bigram_logits(pairs: np.ndarray) -> np.ndarray:
    """Smoothed next-class log probabilities from pair counts."""
    nexts = pairs.sum(axis=0) + 1.0
    back = nexts / nexts.sum()
    return np.log((pairs + 10 * back) / (pairs.sum(axis=1, keepdims=True) + 10)).astype(np.float32)


def factors(bigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bigram model's logits of the next group, by class, and of the next class
    within its group, by class and group."""
    by_group = bigram.reshape(-1, GROUPS, MEMBERS)
    groups = np.log(np.exp(by_group.astype(np.float64)).sum(axis=2) + 1e-300).astype(bigram.dtype)
    return groups, np.ascontiguousarray((by_group - groups[:, :, None]).reshape(-1, MEMBERS))


def start_params(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    params = {k: (rng.standard_normal(s) * (0.5 if k in "EP" else s[0] ** -0.5)).astype(np.float32) for k, s in SHAPES.items()}
    params["b1"][:] = 0
    params["G"][:] = params["U"][:] = 0  # starts as the bigram model
    return params


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in SHAPES]).astype(np.float64)


def unflat(vector: np.ndarray, copy: bool = True) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = vector[at:at + n].reshape(s).astype(np.float32, copy=copy)
        at += n
    return out


def windows(sequences: list):
    """Blocks of many documents: (inputs of two blocks, which are real, targets,
    which are real, document). A document's inputs are its classes after a
    leading END, its targets the classes and a final END. A piece of a document is
    (the ``BLOCK`` + 1 classes before it or none, its classes, whether it is the last):
    only the first begins with END, and only the last ends with it. A piece that is
    not the last is whole blocks."""
    pieces = [s if isinstance(s, tuple) else (s[:0], s, True) for s in sequences]
    lengths = np.array([len(s) + last for _, s, last in pieces], np.int64)
    blocks = -(-lengths // BLOCK)
    first = (np.cumsum(blocks) - blocks) * BLOCK
    n = int(blocks.sum())
    own = np.full(n * BLOCK + 1, END, np.uint8)
    real = np.zeros(n * BLOCK, bool)
    target = np.full(n * BLOCK, END, np.uint8)
    before = np.full((n, BLOCK), END, np.uint8)
    has = np.ones(n, bool)
    document = np.repeat(np.arange(len(pieces)), blocks)
    has[1:] = document[1:] == document[:-1]
    has[:1] = False
    for a, size, (back, sequence, _) in zip(first.tolist(), lengths.tolist(), pieces):
        own[a] = back[-1] if len(back) else END
        own[a + 1:a + size] = sequence[:size - 1]
        target[a:a + len(sequence)] = sequence
        real[a:a + size] = True
    own = own[:-1].reshape(n, BLOCK)
    before[1:] = own[:-1]
    for a, (back, _, _) in zip(first.tolist(), pieces):
        if len(back):
            before[a // BLOCK] = back[:-1]
            has[a // BLOCK] = True
    return (np.concatenate([before, own], axis=1), has, target.reshape(n, BLOCK), real.reshape(n, BLOCK), document)


def _times(tall: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Their product, in parts small enough for BLAS's kernel of small matrices."""
    part = 4 * BLOCK if len(tall) % (4 * BLOCK) == 0 else BLOCK
    return (tall.reshape(-1, part, tall.shape[1]) @ matrix).reshape(len(tall), -1)


def _by_group(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The order of tokens by group, each token's place in it, and (group, first, end)
    of the groups that occur."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
    return order, place, [(i, a, b) for i, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]


def _exp(logits: np.ndarray) -> np.ndarray:
    """exp in place. Logits are log probabilities and small corrections, so a shift is rare."""
    if (most := logits.max(initial=0)) > 60:
        logits -= most - 60
    return np.exp(logits, out=logits)


def _hidden(z: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The positive part of ``z + bias``, in place; whole blocks at a time, as numpy is
    slow on short rows and on scalars."""
    by_block = z.reshape(-1, BLOCK * HIDDEN)
    by_block += np.tile(bias, BLOCK)
    np.maximum(by_block, np.zeros(BLOCK * HIDDEN, z.dtype), out=by_block)
    return z


def _forward(p, inputs, has):
    """The hidden vectors of the second blocks' tokens."""
    kind = p["E"].dtype
    x = np.take(p["E"], inputs, axis=0)
    x += p["P"]
    own = np.ascontiguousarray(x[:, BLOCK:]).reshape(-1, WIDTH)
    # keys by queries: BLAS multiplies small matrices faster unturned
    a = x @ np.ascontiguousarray(_times(own, p["Wq"] * kind.type(WIDTH ** -0.5)).reshape(-1, BLOCK, WIDTH).transpose(0, 2, 1))
    # scores are small next to float32's range, so exp needs no shift
    if a.max(initial=0) > 60:
        np.minimum(a, 60, out=a)
    a += TURNED
    a[~has, :BLOCK] = NEVER
    np.exp(a, out=a)
    h = (a.transpose(0, 2, 1) @ x).reshape(-1, WIDTH)
    h /= (np.ones((1, 2 * BLOCK), kind) @ a).reshape(-1, 1)
    h = _times(h, p["Wv"])
    h += own
    h += _times(_hidden(_times(h, p["W1"]), p["b1"]), p["W2"])
    return h


def log_probs(params, bigram: np.ndarray, inputs, has, target) -> np.ndarray:
    """Natural log probabilities of the targets, block by block."""
    out = np.empty(target.shape, np.float32)
    groups, members = factors(bigram)
    ones = np.ones(MEMBERS, np.float32)
    tiny = np.float32(1e-30)
    for i in range(0, len(inputs), SCORED):
        x, y = inputs[i:i + SCORED].astype(np.intp), target[i:i + SCORED].ravel().astype(np.intp)
        h = _forward(params, x, has[i:i + SCORED])
        group, before, each = y // MEMBERS, x[:, BLOCK:].ravel(), np.arange(len(y))
        first = _times(h, params["G"])
        first += np.take(groups, before, axis=0)
        _exp(first)
        logs = np.log(np.take(first, each * GROUPS + group) / (first @ np.ones(GROUPS, np.float32)) + tiny)
        order, place, runs = _by_group(group)
        second = np.take(members, np.take(before * GROUPS + group, order), axis=0)
        h = np.take(h, order, axis=0)
        for j, a, b in runs:
            second[a:b] += h[a:b] @ params["U"][j]
        _exp(second)
        logs += np.take(np.log(np.take(second, each * MEMBERS + np.take(y % MEMBERS, order)) / (second @ ones) + tiny), place)
        out[i:i + SCORED] = logs.reshape(-1, BLOCK)
    return out


def gradients(params, bigram, inputs, has, target, real, factored=None):
    """Mean loss and its gradients over the real targets. ``factored`` spares
    taking ``factors`` of ``bigram`` for every batch."""
    p = params
    groups, members = factored or factors(bigram)
    rows = len(inputs)
    kind = p["E"].dtype
    scale = kind.type(WIDTH ** -0.5)
    cube = lambda m: m.reshape(rows, -1, WIDTH)
    inputs = inputs.astype(np.intp)
    x = np.take(p["E"], inputs, axis=0)
    x += p["P"]
    # BLAS multiplies small matrices faster unturned
    keys = np.ascontiguousarray(x.transpose(0, 2, 1))
    own = np.ascontiguousarray(x[:, BLOCK:]).reshape(-1, WIDTH)
    q = cube(own @ p["Wq"])
    q *= scale
    s = q @ keys
    if s.max(initial=0) > 60:
        np.minimum(s, 60, out=s)
    s += CAUSAL
    s[~has, :, :BLOCK] = NEVER
    a = np.exp(s, out=s)
    a /= (a.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, kind)).reshape(rows, BLOCK, 1)
    o = (a @ x).reshape(-1, WIDTH)
    h1 = o @ p["Wv"]
    h1 += own
    z = _hidden(h1 @ p["W1"], p["b1"])
    h = h1 + z @ p["W2"]

    before, y, each = inputs[:, BLOCK:].ravel(), target.ravel().astype(np.intp), np.arange(target.size)
    group = y // MEMBERS
    order, place, runs = _by_group(group)
    n = max(1, int(real.sum()))
    weight = (real.ravel() / n).astype(kind)
    first = h @ p["G"]
    first += np.take(groups, before, axis=0)
    _exp(first)
    first /= (first @ np.ones(GROUPS, kind) + kind.type(1e-30))[:, None]
    sorted_h = np.take(h, order, axis=0)
    second = np.take(members, np.take(before * GROUPS + group, order), axis=0).astype(kind, copy=False)
    for j, i, e in runs:
        second[i:e] += sorted_h[i:e] @ p["U"][j]
    _exp(second)
    second /= (second @ np.ones(MEMBERS, kind) + kind.type(1e-30))[:, None]
    late, member = weight[order], y[order] % MEMBERS
    one, two = first[each, group], second[each, member]
    loss = -float(np.log(one + 1e-30) @ weight + np.log(two + 1e-30) @ late)

    first[each, group] = one - 1
    first *= weight[:, None]
    second[each, member] = two - 1
    second *= late[:, None]
    g = {"G": h.T @ first, "U": np.zeros_like(p["U"])}
    back = np.empty_like(sorted_h)
    for j, i, e in runs:
        g["U"][j] = sorted_h[i:e].T @ second[i:e]
        back[i:e] = second[i:e] @ p["U"][j].T
    dh = first @ p["G"].T
    dh += np.take(back, place, axis=0)
    g["W2"] = z.T @ dh
    dz = dh @ p["W2"].T
    dz *= (z > 0).astype(kind)
    g["W1"], g["b1"] = h1.T @ dz, dz.sum(axis=0)
    dh += dz @ p["W1"].T
    g["Wv"] = o.T @ dh
    do = cube(dh @ p["Wv"].T)
    ds = do @ keys
    ds -= np.einsum("bqk,bqk->bq", ds, a)[:, :, None]
    ds *= a
    dq = (ds @ x).reshape(-1, WIDTH)
    dq *= scale
    g["Wq"] = own.T @ dq
    # a place is a value to the queries that attend to it, and a key
    dx = np.concatenate([a, ds], axis=1).transpose(0, 2, 1) @ np.concatenate([do, q], axis=1)
    dh += dq @ p["Wq"].T
    dx[:, BLOCK:] += cube(dh)
    g["P"] = dx.sum(axis=0)
    # rows of the same class are added up
    at = inputs.ravel()
    by_class = np.argsort(at.astype(np.uint8), kind="stable")
    counts = np.bincount(at, minlength=CLASSES)
    here = np.flatnonzero(counts)
    g["E"] = np.zeros_like(p["E"])
    if len(at):
        g["E"][here] = np.add.reduceat(np.take(dx.reshape(-1, WIDTH), by_class, axis=0), (np.cumsum(counts) - counts)[here], axis=0)
    return loss, g


class Trainer:
    """Adam over batches of blocks."""

    def __init__(self, params, bigram, rate: float = 0.01, batch: int = 64):
        self.bigram, self.rate, self.batch, self.steps, self.tokens = bigram, rate, batch, 0, 0
        self.factored = factors(bigram)
        self.flat = flat(params).astype(np.float32)
        # parts of the one vector, which every step changes in place
        self.params = unflat(self.flat, copy=False)
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        # until an array larger than a step's has been freed, malloc hands their room
        # back to the system after each, and gets it anew, page by page
        np.empty(16 << 20, np.uint8)

    def feed(self, sequences: list[np.ndarray]) -> None:
        if not sequences:
            return
        inputs, has, target, real, _ = windows(sequences)
        order = np.random.default_rng(self.steps).permutation(len(inputs))
        for i in range(0, len(order), self.batch):
            rows = order[i:i + self.batch]
            batch = [np.take(x, rows, axis=0) for x in (inputs, has, target, real)]
            _, g = gradients(self.params, self.bigram, *batch, self.factored)
            self.steps += 1
            self.tokens += int(batch[3].sum())
            g = np.concatenate([g[k].ravel() for k in SHAPES])
            self.m += np.float32(0.1) * (g - self.m)
            g *= g
            self.v += np.float32(0.01) * (g - self.v)
            step = np.sqrt(self.v / np.float32(1 - 0.99 ** self.steps))
            step += np.float32(1e-8)
            np.divide(self.m, step, out=step)
            step *= np.float32(self.rate / (1 - 0.9 ** self.steps))
            self.flat -= step
