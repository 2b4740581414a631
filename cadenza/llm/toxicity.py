"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is lower-cased and cut into words at white space. Each word enters the network as the mean
of the embeddings of its character n-grams beside an embedding of the word itself. Two gated
recurrent layers read each window forwards and backwards, attention pools their states, and the
text's score is that of its highest window. Windows overlap by half and cover the whole text.

Only the bounded training sample comes to the driver. Null, empty and white-space texts have no
window and get the score of the output bias alone. Repeated rows score alike. Columns of the input
named ``score`` are replaced; others stay. Rows without a label, and labels without a row, are not
learned from; if the sample lacks one class, the network is not trained and scores 0.5 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import content

#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 32
#: Rows of the embedding tables, width of an embedding, of a state, of the attention layer.
BUCKETS, WIDTH, STATE, HEADS = 1 << 13, 8, 8, 8
#: Lengths of the character n-grams.
GRAMS = (3, 4, 6)
#: Texts of each class that training may draw; bounds what comes to the driver.
TOXIC_ROWS, CLEAN_ROWS = 1500, 2500
#: Passes over the sample, more of them if it is so small that they are fewer steps than this.
EPOCHS, STEPS, SEED = 7, 300, 7
#: Other windows of clean texts that each pass learns from, at least, so that few toxic texts are not learned by heart.
OTHERS = 1000
#: Windows that go through the network at once, and characters of texts that are cut at once.
AT_ONCE, CHARS = 1024, 2_000_000
#: Words whose n-grams are held at once.
BLOCK = 10_000


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, where each word's begin, and a bucket for each whole word."""
    marked = [f"\x02{word}\x03" for word in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    word_at = np.repeat(np.arange(len(words)), lengths)
    left = ends[word_at] - np.arange(len(points))  # letters from here to the end of the word
    step, owners, hashes = np.uint64(0x9E3779B97F4A7C15), [], []
    for n in GRAMS:
        rolled, count = np.zeros(max(0, len(points) - n + 1), np.uint64), len(points) - n + 1
        for i in range(n):
            rolled = rolled * step + points[i:i + count]
        whole = left[:len(rolled)] >= n
        owners.append(word_at[:len(rolled)][whole])
        hashes.append(_mix(rolled[whole] + np.uint64(n)))
    owner, hashed = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    begins = np.searchsorted(owner[order], np.arange(len(words)))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), step)]))[word_pos(lengths)]
    whole_word = _mix(np.add.reduceat(points * powers, ends - lengths))
    size = np.uint64(BUCKETS)
    return (hashed[order] % size).astype(np.int64), begins, (whole_word % size).astype(np.int64)


def word_pos(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2, … within each word."""
    starts = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) - np.repeat(starts, lengths)


class Network:
    """Parameters, scores and gradients."""

    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        normal = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        small = lambda *shape: (0.05 * draw.standard_normal(shape)).astype(np.float32)
        self.p = {"chars": small(BUCKETS, WIDTH), "words": small(BUCKETS, WIDTH), "att": normal(2 * STATE, HEADS),
                  "query": normal(HEADS), "out": normal(2 * STATE), "bias": np.float32([-1.0])}
        for way in ("f", "b"):
            self.p |= {f"{way}W": normal(2 * WIDTH, 3 * STATE), f"{way}U": normal(STATE, 3 * STATE),
                       f"{way}c": np.zeros(3 * STATE, np.float32)}

    def features(self, words: list[str]):
        grams, begins, whole = gram_buckets(words)
        counts = np.diff(np.append(begins, len(grams)))
        chars = np.add.reduceat(self.p["chars"][grams], begins, axis=0) / counts[:, None].astype(np.float32)
        return np.concatenate([chars, self.p["words"][whole]], axis=1), (grams, counts, whole)

    def project_words(self, words: list[str]) -> dict[str, np.ndarray]:
        """The same for words, some at a time: their n-grams are many times the words themselves."""
        parts = [self.project(self.features(words[i:i + BLOCK])[0]) for i in range(0, len(words), BLOCK)]
        return {way: np.concatenate([p[way] for p in parts]) for way in ("f", "b")}

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates of either direction."""
        return {way: x @ self.p[f"{way}W"] + self.p[f"{way}c"] for way in ("f", "b")}

    def _read(self, way: str, gates: np.ndarray, mask: np.ndarray, keep: bool):
        """States (time, window, state) of one direction; padding leaves a state as it is."""
        steps, n, _ = gates.shape
        U, h, s = self.p[f"{way}U"], np.zeros((n, STATE), np.float32), STATE
        states, kept = np.empty((steps, n, s), np.float32), [None] * steps
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            hu = h @ U
            zr = _sigmoid(gates[t, :, :2 * s] + hu[:, :2 * s])
            z, r = zr[:, :s], zr[:, s:]
            new = np.tanh(gates[t, :, 2 * s:] + r * hu[:, 2 * s:])
            z = np.where(mask[t][:, None], z, np.float32(1))
            if keep:
                kept[t] = (h, z, r, new, hu[:, 2 * s:])
            h = new + z * (h - new)
            states[t] = h
        return states, kept

    def run(self, projected: dict[str, np.ndarray], windows: np.ndarray, keep: bool = False):
        """Logits of ``windows`` (window, time), rows of ``projected``, -1 where the text has ended."""
        at = np.ascontiguousarray(windows.T)
        mask, at = at >= 0, np.maximum(at, 0)
        read = {way: self._read(way, projected[way][at], mask, keep) for way in ("f", "b")}
        states = np.concatenate([read["f"][0], read["b"][0]], axis=2)
        hidden = np.tanh(states @ self.p["att"])
        weight = np.where(mask, hidden @ self.p["query"], np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tns->ns", weight, states)
        logits = pooled @ self.p["out"] + self.p["bias"]
        return logits, (at, mask, {w: r[1] for w, r in read.items()}, states, hidden, weight, pooled) if keep else None

    def gradients(self, x, parts, kept, d_logit):
        """Gradients of all parameters, given that of the logits."""
        at, mask, steps, states, hidden, weight, pooled = kept
        g = {"out": pooled.T @ d_logit, "bias": np.float32([d_logit.sum()])}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = np.einsum("ns,tns->tn", d_pooled, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_hidden = d_energy[:, :, None] * self.p["query"] * (1 - hidden ** 2)
        g["query"] = np.einsum("tn,tnk->k", d_energy, hidden)
        g["att"] = np.einsum("tns,tnk->sk", states, d_hidden)
        d_states = weight[:, :, None] * d_pooled + d_hidden @ self.p["att"].T
        d_x = np.zeros_like(x)
        for way, half in (("f", d_states[:, :, :STATE]), ("b", d_states[:, :, STATE:])):
            d_gates = self._unread(way, half, steps[way], mask, g)
            flat, rows = d_gates.reshape(-1, 3 * STATE), at.reshape(-1)
            d_proj = np.zeros((len(x), 3 * STATE), np.float32)
            np.add.at(d_proj, rows, flat)
            g[f"{way}W"], g[f"{way}c"] = x.T @ d_proj, flat.sum(axis=0)
            d_x += d_proj @ self.p[f"{way}W"].T
        grams, counts, whole = parts
        g["chars"] = (grams, np.repeat(d_x[:, :WIDTH] / counts[:, None], counts, axis=0))
        g["words"] = (whole, d_x[:, WIDTH:])
        return g

    def _unread(self, way, d_states, kept, mask, g):
        n_steps, n, s = d_states.shape
        U, d_U = self.p[f"{way}U"], np.zeros_like(self.p[f"{way}U"])
        d_gates, d_h = np.zeros((n_steps, n, 3 * s), np.float32), np.zeros((n, s), np.float32)
        for t in range(n_steps - 1, -1, -1) if way == "f" else range(n_steps):
            h, z, r, new, hu_new = kept[t]
            d_h = d_h + d_states[t]
            d_new = d_h * (1 - z) * (1 - new ** 2)
            d_z = np.where(mask[t][:, None], d_h * (h - new) * z * (1 - z), np.float32(0))
            d_r = d_new * hu_new * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_U += h.T @ d_hu
            d_h = d_h * z + d_hu @ U.T
        g[f"{way}U"] = d_U
        return d_gates


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows over n words: each STRIDE on, until one reaches the end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else np.empty(0, np.int64)


def cut(texts: list[str]):
    """Different words, rows of all words in reading order, and (text, first word, end of text) of all windows."""
    index: dict[str, int] = {}
    rows, owners, starts, ends, at = [], [], [], [], 0
    for i, text in enumerate(texts):
        found = words_of(text)
        rows.append(np.fromiter((index.setdefault(w, len(index)) for w in found), np.int64, len(found)))
        first = window_starts(len(found))
        owners.append(np.full(len(first), i))
        starts.append(first + at)
        at += len(found)
        ends.append(np.full(len(first), at))
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return list(index), join(rows), join(owners), join(starts), join(ends)


def windows_at(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    places = starts[:, None] + np.arange(WINDOW)
    return np.where(places < ends[:, None], rows[np.minimum(places, len(rows) - 1)], -1)


def window_logits(network: Network, words, rows, starts, ends) -> np.ndarray:
    projected = network.project_words(words) if words else None
    out = np.empty(len(starts), np.float32)
    for i in range(0, len(starts), AT_ONCE):
        part = slice(i, i + AT_ONCE)
        out[part] = network.run(projected, windows_at(rows, starts[part], ends[part]))[0]
    return out


def scores(network: Network, texts: list[str]) -> np.ndarray:
    """Score of each text: its highest window."""
    best = np.full(len(texts), -np.inf, np.float32)
    words, rows, owners, starts, ends = cut(texts)
    np.maximum.at(best, owners, window_logits(network, words, rows, starts, ends))
    best[np.isinf(best)] = min(0.0, float(network.p["bias"][0]))
    return _sigmoid(best.astype(np.float64))


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit on whole texts: each epoch learns from every text's highest window, and one more of clean ones."""
    network, draw = Network(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max() or not any(map(words_of, texts)):
        return network
    for name, evidence in zip(("chars", "words"), _evidence(texts, labels)):
        network.p[name][:, 0] = evidence
    words, rows, owners, starts, ends = cut(texts)
    # To begin with, a toxic text is known by the window of its strongest word.
    strength = np.concatenate([
        network.features(words[i:i + BLOCK])[0][:, [0, WIDTH]].sum(axis=1) for i in range(0, len(words), BLOCK)])
    first = np.array([strength[rows[a:min(a + WINDOW, b)]].max() for a, b in zip(starts, ends)])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    step = epoch = 0
    while epoch < epochs or step < STEPS:
        if epoch < 2:
            logits = first
        elif epoch % 2 == 0:
            logits = window_logits(network, words, rows, starts, ends)
        order = np.lexsort((logits, owners))
        last = np.append(np.nonzero(np.diff(owners[order]))[0], len(order) - 1)
        chosen = order[last]
        clean = draw.permutation(np.nonzero(labels[owners] == 0)[0])[: max(OTHERS, len(texts) // 2)]
        chosen = draw.permutation(np.unique(np.concatenate([chosen, clean])))
        for i in range(0, len(chosen), 128):
            batch = chosen[i:i + 128]
            windows, step = windows_at(rows, starts[batch], ends[batch]), step + 1
            used, local = np.unique(windows, return_inverse=True)
            local = local.reshape(windows.shape)
            if used[0] < 0:
                used, local = used[1:], local - 1
            x, parts = network.features([words[u] for u in used])
            logit, kept = network.run(network.project(x), local, keep=True)
            target = labels[owners[batch]]
            _update(network, network.gradients(x, parts, kept, (_sigmoid(logit) - target) / len(batch)), moments, step)
        epoch += 1
    return network


def _evidence(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram and each word bucket, how surely it marks toxic (+) or clean (-) texts.

    The signed root of the likelihood-ratio statistic of the numbers of texts that hold it.
    """
    held = np.zeros((2, 2, BUCKETS))
    for text, label in zip(texts, labels):
        if found := sorted(set(words_of(text))):
            grams, _, whole = gram_buckets(found)
            for kind, at in enumerate((grams, whole)):
                held[kind, int(label), np.unique(at)] += 1
    share = np.array([(labels == 0).mean(), (labels == 1).mean()])
    both = held.sum(axis=1, keepdims=True)
    expected = np.maximum(both * share[None, :, None], 1e-9)
    g2 = 2 * np.where(held > 0, held * np.log(np.maximum(held, 1e-9) / expected), 0).sum(axis=1)
    found = np.sign(held[:, 1] - expected[:, 1]) * np.sqrt(np.maximum(g2, 0)) / 4
    return tuple(np.clip(found, -2, 2).astype(np.float32))


def _update(network: Network, gradients: dict, moments: dict, step: int, rate: float = 0.01):
    """Adam; of the embedding tables, only the rows that were read."""
    for name, g in gradients.items():
        m, v = moments[name]
        if isinstance(g, tuple):
            at, back = np.unique(g[0], return_inverse=True)
            total = np.zeros((len(at), g[1].shape[1]), np.float32)
            np.add.at(total, back, g[1])
            g = total
        else:
            at = slice(None)
            g = np.clip(g, -1, 1)
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.99 * v[at] + 0.01 * g * g
        pace = rate * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
        network.p[name][at] -= pace * m[at] / (np.sqrt(v[at]) + 1e-6)


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"):
    """Texts and labels of at most TOXIC_ROWS and CLEAN_ROWS labelled rows, drawn by hash."""
    marked = labels.filter(F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("_label"))
    drawn = [
        marked.filter(F.col("_label") == value).orderBy(F.xxhash64(key), key).limit(most)
        for value, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))
    ]
    found = docs.select(key, content(text).alias("_text")).join(F.broadcast(drawn[0].unionByName(drawn[1])), key)
    sample = found.select(key, "_text", "_label").toPandas().sort_values([key, "_text"])
    return sample["_text"].tolist(), sample["_label"].to_numpy()


def score(docs: DataFrame, network: Network, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``score`` (or the column named by ``into``), 0 to 1, of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, part, held = [], [], 0
            for value in batch:
                part.append(value.as_py() or "")
                held += len(part[-1])
                if held > CHARS:
                    found.append(scores(shared.value, part))
                    part, held = [], 0
            found.append(scores(shared.value, part))
            yield pa.array(np.concatenate(found), pa.float64())

    return docs.withColumn(into, run(content(text)))
