"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A step of the network is a chunk of text between white space. Its inputs are a learned vector of its
words and evidence from its characters: how much more often its word, and its five-character
stretches, occur in toxic training texts than in others. The network reads windows of ``WINDOW``
chunks in both directions, pools the states by attention and gives a logit; windows overlap by half,
cover whole texts, and a text is as toxic as its most toxic window. A text of many windows has a
higher maximum by chance alone, so the score is fitted on the logit and the number of windows, and on
texts the network has not learned: two networks, each of one half of the sample, judge the other half.
With few labels their logits tell little about unseen texts, and scores stay near the share of toxic
labels instead of accusing clean texts.

Learning uses a bounded sample: about ``SAMPLE_ROWS`` labelled rows per class, whole texts. In
training, a text's evidence comes from the other folds of the sample, so the network learns what
evidence is worth on unseen texts. Scoring covers every row and every whole text, however long.

Defined cases: a NULL text, or one without a chunk, scores 0. Rows that repeat an id are rows of
their own; repeated labels count repeatedly in training. Labels that are NULL are not learned from.
Without a few labels of both classes in either half every score is 0. Extra columns are ignored. Ties
between windows do not matter (the maximum counts); a score of exactly 0.5 is predicted toxic.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally.llm.common import (
    Vocabulary,
    byte_slices,
    chunks,
    columns_apart,
    fold,
    letter_symbols,
    table,
    with_fields,
    worker_table,
)
from shoptally.llm.language import grams

SAMPLE_ROWS = 2500
WINDOW, STRIDE = 32, 16
HIDDEN, LEARNED, EVIDENCE = 8, 5, 3
WORD_BITS, GRAM_BITS = 14, 20
FOLDS, PASSES = 4, 2
_STEPS, _BATCH, _RATE, _DECAY, _SEED = 600, 96, 0.01, 1e-3, 11
_SLICE, _BLOCK = 1 << 21, 2048
_PART = 20_000


def word_slots(chunk_list: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of the words of all chunks and the chunk of each word."""
    symbols, of = letter_symbols(chunk_list, 12)
    ends = np.flatnonzero(symbols == 0)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    with np.errstate(over="ignore"):
        odd = np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(np.full(len(symbols) + 1, odd, np.uint64))
        inverse = np.cumprod(np.full(len(symbols) + 1, np.uint64(pow(int(odd), -1, 1 << 64)), np.uint64))
        total = np.concatenate([[np.uint64(0)], np.cumsum(symbols.astype(np.uint64) * power[:-1])])
        value = (total[ends] - total[begins]) * inverse[begins]
        slots = (value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - WORD_BITS - 6)
    return slots.astype(np.int64), of[ends]


def gram_slots(chunk_list: list[str]) -> tuple[np.ndarray, np.ndarray]:
    keys, of = grams(chunk_list)
    with np.errstate(over="ignore"):
        slots = (keys.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - GRAM_BITS)
    return slots.astype(np.int64), of


def in_parts(make, chunk_list: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``make`` over many chunks, some at a time, so that its working memory stays small."""
    slots, of = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for begin in range(0, len(chunk_list), _PART):
        a, b = make(chunk_list[begin:begin + _PART])
        slots.append(a.astype(np.int32))
        of.append((b + begin).astype(np.int32))
    return np.concatenate(slots), np.concatenate(of)


def keyness(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Signed root of the log-likelihood ratio of a feature in toxic texts against others, from
    counts of texts: a few texts give little evidence, however one-sided they are."""
    expected = (toxic + other) * (n_toxic / (n_toxic + n_other))
    rest = (toxic + other) - expected
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (np.where(toxic > 0, toxic * np.log(toxic / expected), 0)
                 + np.where(other > 0, other * np.log(other / rest), 0))
    return (np.sign(toxic - expected) * np.sqrt(2 * np.maximum(ratio, 0))).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    weights: dict[str, np.ndarray]
    word_odds: np.ndarray
    gram_odds: np.ndarray
    #: of the score: weights of the logit and of the logarithm of the number of windows, and a constant
    scale: tuple[float, float, float] = (1.0, 0.0, 0.0)
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def evidence(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per chunk: evidence (its strongest word, its strongest and its mean stretch) and the slot
        of its first word for the learned vector; the last slot stands for no word."""
        n = len(fresh)
        out = np.zeros((n, EVIDENCE), np.float32)
        first = np.full(n, (1 << WORD_BITS), np.int64)
        slots, of = word_slots(fresh)
        np.maximum.at(out[:, 0], of, self.word_odds[slots])
        first[of[::-1]] = slots[::-1] & ((1 << WORD_BITS) - 1)
        g, gof = gram_slots(fresh)
        odds = self.gram_odds[g]
        np.maximum.at(out[:, 1], gof, odds)
        out[:, 2] = np.bincount(gof, weights=odds, minlength=n) / np.maximum(np.bincount(gof, minlength=n), 1)
        return out / 4, first

    def scores(self, logits: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Scores of texts; 0 without a window."""
        out, some = np.zeros(len(logits)), windows > 0
        a, b, c = self.scale
        out[some] = sigmoid(a * logits[some] + b * np.log(windows[some]) + c)
        return out

    def compute(self, fresh: list[str]) -> list[np.ndarray]:
        """What a chunk adds to the gates of both directions."""
        return [self.gates(*self.evidence(fresh))]

    def gates(self, evidence: np.ndarray, first: np.ndarray) -> np.ndarray:
        w = self.weights
        out = np.empty((len(first), 6 * HIDDEN), np.float32)
        for b in range(0, len(first), _PART):
            x = np.concatenate([evidence[b:b + _PART], w["E"][first[b:b + _PART]]], axis=1)
            out[b:b + _PART, :3 * HIDDEN] = x @ w["Wf"] + w["bf"]
            out[b:b + _PART, 3 * HIDDEN:] = x @ w["Wb"] + w["bb"]
        return out


def run_direction(gates: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: bool):
    """States over steps (time first). ``gates``: T x B x 3H. With ``keep``, what backward needs."""
    steps, batch, width = gates.shape
    size = width // 3
    h = np.zeros((batch, size), gates.dtype)
    states = np.empty((steps, batch, size), gates.dtype)
    saved = []
    for t in range(steps):
        a = h @ u
        zr = sigmoid(gates[t, :, :2 * size] + a[:, :2 * size])
        z, r = zr[:, :size], zr[:, size:]
        n = np.tanh(gates[t, :, 2 * size:] + r * a[:, 2 * size:])
        new = n + z * (h - n)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep:
            saved.append((h, z, r, n, a[:, 2 * size:]))
        h = new
        states[t] = h
    return states, saved


def pooled(states: np.ndarray, w: dict[str, np.ndarray], mask: np.ndarray | None):
    """Attention over steps: logits, attention and context."""
    scores = states @ w["a"]
    if mask is not None:
        scores = np.where(mask, scores, -1e9)
    scores = scores - scores.max(axis=0)
    alpha = np.exp(scores)
    alpha /= alpha.sum(axis=0)
    context = np.einsum("tb,tbh->bh", alpha, states)
    return context @ w["o"] + w["c"][0], alpha, context


def window_logits(gates: np.ndarray, w: dict[str, np.ndarray], mask: np.ndarray | None = None) -> np.ndarray:
    """Logits of windows. ``gates``: T x B x 6H, both directions."""
    half = gates.shape[2] // 2
    ahead, _ = run_direction(gates[:, :, :half], w["Uf"], mask, False)
    back, _ = run_direction(gates[::-1, :, half:], w["Ub"], None if mask is None else mask[::-1], False)
    return pooled(np.concatenate([ahead, back[::-1]], axis=2), w, mask)[0]


def _back_direction(d_states, saved, u, mask):
    size = u.shape[0]
    d_u = np.zeros_like(u)
    d_gates = np.empty((len(saved), d_states.shape[1], 3 * size), d_states.dtype)
    carry = np.zeros(d_states.shape[1:], d_states.dtype)
    for t in range(len(saved) - 1, -1, -1):
        h, z, r, n, an = saved[t]
        d = d_states[t] + carry
        live = mask[t][:, None]
        through = np.where(live, 0, d)
        d = np.where(live, d, 0)
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * an * r * (1 - r)
        d_a = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_u += h.T @ d_a
        carry = d * z + d_a @ u.T + through
    return d_gates, d_u


def gradients(w, evidence, first, mask, target):
    """Loss and gradients of a batch. ``evidence``: T x B x EVIDENCE, ``first``, ``mask``: T x B."""
    x = np.concatenate([evidence, w["E"][first]], axis=2)
    ahead, saved_f = run_direction(x @ w["Wf"] + w["bf"], w["Uf"], mask, True)
    back, saved_b = run_direction((x @ w["Wb"] + w["bb"])[::-1], w["Ub"], mask[::-1], True)
    states = np.concatenate([ahead, back[::-1]], axis=2)
    logit, alpha, context = pooled(states, w, mask)
    p = sigmoid(logit)
    loss = float(np.mean(np.logaddexp(0, logit) - target * logit))
    d_logit = (p - target) / len(target)
    d_context = d_logit[:, None] * w["o"]
    g = {"o": context.T @ d_logit, "c": np.array([d_logit.sum()], logit.dtype)}
    d_alpha = np.einsum("bh,tbh->tb", d_context, states)
    d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    g["a"] = np.einsum("tb,tbh->h", d_score, states)
    d_states = alpha[:, :, None] * d_context + d_score[:, :, None] * w["a"]
    size = w["Uf"].shape[0]
    d_f, g["Uf"] = _back_direction(d_states[:, :, :size], saved_f, w["Uf"], mask)
    d_b, g["Ub"] = _back_direction(d_states[::-1, :, size:], saved_b, w["Ub"], mask[::-1])
    d_b = d_b[::-1]
    flat = x.reshape(-1, x.shape[2])
    d_x = np.zeros_like(flat)
    for side, d in (("f", d_f), ("b", d_b)):
        d = d.reshape(-1, d.shape[2])
        g["W" + side], g["b" + side] = flat.T @ d, d.sum(axis=0)
        d_x += d @ w["W" + side].T
    g["E"] = np.zeros_like(w["E"])
    np.add.at(g["E"], first.ravel(), d_x[:, EVIDENCE:])
    return loss, g


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    x, h = EVIDENCE + LEARNED, HIDDEN
    draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    return {
        "E": draw((1 << WORD_BITS) + 1, LEARNED, s=0.05),
        "Wf": draw(x, 3 * h, s=0.3), "Wb": draw(x, 3 * h, s=0.3),
        "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32),
        "Uf": draw(h, 3 * h, s=0.3), "Ub": draw(h, 3 * h, s=0.3),
        "a": draw(2 * h, s=0.3), "o": draw(2 * h, s=0.3), "c": np.zeros(1, np.float32),
    }


def window_counts(sizes: np.ndarray) -> np.ndarray:
    return np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)


def window_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts (chunks per text): the starts of their windows, counted in chunks over all texts,
    and each window's text. Windows overlap by half; the last one of a text ends with it."""
    counts = window_counts(sizes)
    of = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.minimum(nth * STRIDE, np.maximum(sizes[of] - WINDOW, 0))
    return (np.cumsum(sizes) - sizes)[of] + begin, of


def text_counts(numbers: np.ndarray, sizes: np.ndarray, group: np.ndarray, groups: int,
                slots: np.ndarray, of: np.ndarray, chunk_count: int, size: int) -> np.ndarray:
    """In how many texts of each group every slot occurs. ``slots`` belong to chunks ``of``."""
    counts = np.bincount(of, minlength=chunk_count)
    begins = np.cumsum(counts) - counts
    ends = np.cumsum(sizes)
    out = np.zeros((groups, size), np.int32)
    for text, (end, n, into) in enumerate(zip(ends, sizes, group, strict=True)):
        own = np.unique(numbers[end - n:end])
        n_slots = counts[own]
        at = np.repeat(begins[own] - (np.cumsum(n_slots) - n_slots), n_slots) + np.arange(n_slots.sum())
        out[into, np.unique(slots[at])] += 1
    return out


def train(texts: list[str], labels: np.ndarray, weights: tuple[float, float] = (1.0, 1.0),
          seed: int = _SEED) -> Network | None:
    """A network from labelled texts; None without enough texts of both classes. ``weights`` is how many
    labelled texts one text of the sample stands for, per class."""
    half = (np.arange(len(texts)) // FOLDS) % 2
    logits, windows = np.full(len(texts), -np.inf), np.zeros(len(texts))
    for side in (0, 1):
        learned, unseen = np.flatnonzero(half != side), np.flatnonzero(half == side)
        net = learn([texts[i] for i in learned], labels[learned], seed)
        if net is None:
            return None
        logits[unseen], windows[unseen] = judged(net, [texts[i] for i in unseen])
    net = learn(texts, labels, seed)
    some = np.isfinite(logits)
    if net is not None:
        net.scale = scaled(logits[some], np.log(windows[some]), labels[some], weights)
    return net


def judged(net: Network, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Logits and numbers of windows of texts."""
    held = Vocabulary(net.compute, 150_000)
    logits, windows = [np.zeros(0)], [np.zeros(0, np.int64)]
    for begin, end in byte_slices(texts, _SLICE):
        numbers, sizes = held.numbers(texts[begin:end])
        windows.append(window_counts(sizes))
        logits.append(text_logits(net, held.values[0], numbers, sizes) if len(numbers) else np.full(end - begin, -np.inf))
    return np.concatenate(logits), np.concatenate(windows)


def learn(texts: list[str], labels: np.ndarray, seed: int = _SEED) -> Network | None:
    """The network itself, its logits not yet turned into scores."""
    part = np.arange(len(texts)) % FOLDS
    if min((np.sum((labels == y) & (part != p)) for y in (0, 1) for p in range(FOLDS)), default=0) == 0:
        return None
    parts = [chunks(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    distinct: dict[str, int] = {}
    numbers = np.fromiter((distinct.setdefault(c, len(distinct)) for p in parts for c in p),
                          np.int32, int(sizes.sum()))
    fresh, parts = list(distinct), None
    text_of = np.repeat(np.arange(len(texts)), sizes)
    group = part * 2 + labels
    in_texts = [text_counts(numbers, sizes, group, 2 * FOLDS, *in_parts(make, fresh), len(fresh), size)
                for make, size in ((word_slots, 1 << (WORD_BITS + 6)), (gram_slots, 1 << GRAM_BITS))]
    members = np.bincount(group, minlength=2 * FOLDS)

    def odds(without: int | None) -> list[np.ndarray]:
        """Evidence from the texts of all folds but one."""
        folds = [f for f in range(FOLDS) if f != without]
        toxic, other = [2 * f + 1 for f in folds], [2 * f for f in folds]
        return [keyness(c[toxic].sum(axis=0), c[other].sum(axis=0), members[toxic].sum(), members[other].sum())
                for c in in_texts]

    rng = np.random.default_rng(seed)
    net = Network(initial(rng), *odds(None))
    # evidence for a text comes from the texts of other folds, as it will for unseen texts
    found = []
    for number in range(FOLDS):
        net.word_odds, net.gram_odds = odds(number)
        both = [net.evidence(fresh[b:b + _PART]) for b in range(0, len(fresh), _PART)]
        found.append(np.concatenate([values for values, _ in both]))
        first = np.concatenate([slots for _, slots in both]).astype(np.int32)
    evidence, fold_of = np.stack(found), part[text_of].astype(np.int8)
    del found
    starts, of = window_starts(sizes)
    length = np.minimum(sizes[of], WINDOW)
    at = (starts[:, None] + np.minimum(np.arange(WINDOW), length[:, None] - 1)).astype(np.int32)
    mask = np.arange(WINDOW) < length[:, None]
    strong = evidence[:, :, :2].sum(axis=2)
    strength = np.concatenate([np.zeros(0), *[
        np.where(mask[b:b + _PART], strong[fold_of[at[b:b + _PART]], numbers[at[b:b + _PART]]], 0).max(axis=1)
        for b in range(0, len(at), _PART)]])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    step = 0
    for turn in range(PASSES):
        # of a toxic text its strongest window, of another its strongest and one more
        order = np.lexsort((-strength, of))
        best = order[np.unique(of[order], return_index=True)[1]]
        other = rng.permutation(len(of))
        other = other[np.unique(of[other], return_index=True)[1]]
        positive = best[labels[of[best]] == 1]
        negative = np.concatenate([w[labels[of[w]] == 0] for w in (best, other)])
        for _ in range(_STEPS // PASSES):
            step += 1
            pick = np.concatenate([rng.choice(positive, _BATCH // 2), rng.choice(negative, _BATCH // 2)])
            rows, folds = numbers[at[pick]].T, fold_of[at[pick]].T
            target = (labels[of[pick]] == 1).astype(np.float32)
            _, grads = gradients(net.weights, evidence[folds, rows], first[rows], mask[pick].T, target)
            grads["E"] += _DECAY * net.weights["E"]
            rate = _RATE * min(1.0, 2 * (1 - step / _STEPS) + 0.05)
            for name, grad in grads.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                net.weights[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        if turn == PASSES - 1:
            break
        strength = np.empty(len(of))
        for number in range(FOLDS):  # the network now says which windows are the strongest
            gates = net.gates(evidence[number], first)
            rows = np.flatnonzero(part[of] == number)
            strength[rows] = logits_of(net, gates, numbers, starts[rows], length[rows])
    net.word_odds, net.gram_odds = odds(None)
    return net


def scaled(logits: np.ndarray, windows: np.ndarray, labels: np.ndarray,
           weights: tuple[float, float]) -> tuple[float, float, float]:
    """Logistic regression of the labels on logits and ``windows`` (logarithms), the classes weighing as
    in the whole table. A penalty of one text's weight keeps separable or few texts from any extreme."""
    weight = np.where(labels == 1, weights[1], weights[0])
    weight = weight / weight.sum()
    x = np.stack([logits, windows, np.ones(len(logits))], axis=1)
    ridge = np.diag([1.0, 1.0, 1e-6]) / max(1, len(logits))
    w = np.zeros(3)
    for _ in range(100):
        p = sigmoid(x @ w)
        s = weight * p * (1 - p)
        step = np.linalg.solve(x.T @ (x * s[:, None]) + ridge + 1e-9 * np.eye(3), x.T @ (weight * (p - labels)) + ridge @ w)
        w = w - np.clip(step, -1, 1)
    return float(max(w[0], 0.0)), float(min(w[1], 0.0)), float(w[2])


def logits_of(net: Network, gates: np.ndarray, numbers: np.ndarray, starts: np.ndarray,
              length: np.ndarray) -> np.ndarray:
    """Logits of windows, those of full length and shorter ones apart."""
    out = np.empty(len(starts))
    for full in (True, False):
        rows = np.flatnonzero((length == WINDOW) == full)
        for begin in range(0, len(rows), _BLOCK):
            part = rows[begin:begin + _BLOCK]
            steps = np.arange(WINDOW if full else int(length[part].max()))[:, None]
            at = starts[part] + np.minimum(steps, length[part] - 1)
            mask = None if full else steps < length[part]
            out[part] = window_logits(gates[numbers[at]], net.weights, mask)
    return out


def text_logits(net: Network, gates: np.ndarray, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text the logit of its most toxic window; -inf without a window."""
    starts, of = window_starts(sizes)
    out = np.full(len(sizes), -np.inf)
    np.maximum.at(out, of, logits_of(net, gates, numbers, starts, np.minimum(sizes[of], WINDOW)))
    return out


def fitted(docs: DataFrame, labels: DataFrame, training: Column, text: str = "text",
           doc_id: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Network | None:
    """Trains on about ``rows`` labelled rows per class; ``training`` is a condition on ``doc_id``."""
    known = columns_apart(labels, [doc_id, label]).select(
        F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(training)
    totals = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, rows / max(1, totals.get(1, 0))).otherwise(rows / max(1, totals.get(0, 0)))
    lot = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) / (1 << 30)
    chosen = known.where(lot < share)
    body = columns_apart(docs, [doc_id, text]).select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("body")).where(F.col("body").isNotNull())
    # the sample's ids are about 2 * rows, whatever the table's size; one task trains on it
    sample = body.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "body").repartition(1)
    found = sample.mapInPandas(_trained(totals), "net binary").collect()
    return pickle.loads(found[0]["net"]) if found else None


def _trained(totals: dict[int, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if not parts:
            return
        sample = pd.concat(parts).sort_values(["y", "doc_id", "body"])
        y = sample["y"].to_numpy()
        stands = tuple(totals.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1))
        net = train(sample["body"].tolist(), y, stands)
        yield pd.DataFrame({"net": [pickle.dumps(net)]})

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = shared.value
        held = net and worker_table("toxicity", net.token, lambda: Vocabulary(net.compute, 150_000))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in byte_slices(texts, _SLICE):
                score = np.zeros(hi - lo)
                if net is not None:
                    numbers, sizes = held.numbers(texts[lo:hi])
                    if len(numbers):
                        score = net.scores(text_logits(net, held.values[0], numbers, sizes), window_counts(sizes))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)],
                     pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=[*batch.schema.names[:-1], "score", "predicted"])

    return run


def score(docs: DataFrame, net: Network | None, carried: list[Column], body: Column) -> DataFrame:
    """The columns ``carried`` with ``score`` and ``predicted``."""
    rows = docs.select(*carried, F.coalesce(body, F.lit("")).alias("_body"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # tables of fixed size
    return rows.mapInArrow(_score(shared), with_fields(rows, "score double, predicted int"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    net = fitted(docs, labels, ~held_out)
    return score(docs, net, [F.col("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out")],
                 F.col("text"))
