"""A small bidirectional gated recurrent network with attention pooling, in numpy.

Each position of a window is a word.  Its input joins a word part (an evidence figure and a trained vector for
the hashed word) and a character part (evidence of its four-letter grams, and the mean of their trained
vectors).  Evidence is the smoothed log-odds with which training texts of either label hold the word or gram;
a training text is left out of its own evidence.  Windows are ``WINDOW`` words long and start every ``STRIDE``
words, so they overlap and cover the whole text; a text scores as its highest window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, STRIDE = 32, 16
HIDDEN, VECTOR, GRAM = 8, 6, 4
EVIDENCE_BITS, VECTOR_BITS = 18, 13
INPUTS = 3 + 2 * VECTOR
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¿¡…“”‘’–—"
PADDING = ""  # the word that fills up short texts
MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def split(text: str) -> list[str]:
    return text.lower().split()


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window and the text it belongs to; texts shorter than a window count as one window long."""
    lengths = np.maximum(lengths, WINDOW)
    counts = (lengths - WINDOW + STRIDE - 1) // STRIDE + 1
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    inside = (np.arange(counts.sum()) - first[owner]) * STRIDE
    begins = np.cumsum(lengths) - lengths
    return begins[owner] + np.minimum(inside, (lengths - WINDOW)[owner]), owner


def padded(texts: list[list]) -> list:
    out = []
    for words in texts:
        out += words
        out += [PADDING] * (WINDOW - len(words))
    return out


@dataclass
class Grams:
    """Hashes of words and of their grams; ``first`` is where a word's grams begin."""

    word: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Grams:
        wrapped = [f"^{w.strip(PUNCTUATION) or w}$".ljust(GRAM) for w in words]
        sizes = np.fromiter(map(len, wrapped), np.int64, len(wrapped))
        codes = np.frombuffer("".join(wrapped).encode("utf-32-le"), np.uint32).astype(np.uint64)
        total = len(codes) - GRAM + 1
        mixed = codes[:total] * MIX[0]
        for k in range(1, GRAM):
            mixed += codes[k : k + total] * MIX[k]
        mixed ^= mixed >> np.uint64(29)
        mixed *= MIX[1]
        mixed ^= mixed >> np.uint64(32)
        ends = np.cumsum(sizes)
        counts = sizes - GRAM + 1
        first = np.cumsum(counts) - counts
        at = np.repeat(ends - sizes - first, counts) + np.arange(counts.sum())
        gram = mixed[at]
        word = np.add.reduceat(gram, first) * MIX[2]
        return cls(word, gram, first, counts)

    def buckets(self, hashes: np.ndarray, bits: int) -> np.ndarray:
        return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def evidence(p: np.ndarray, n: np.ndarray, texts: tuple[int, int]) -> np.ndarray:
    """Log-odds of a bucket held by p toxic and n other texts, drawn to 0 where few hold it."""
    if min(texts) < 1:
        return np.zeros(len(p), np.float32)
    share = texts[0] / max(1, sum(texts))
    toxic = (p + share) / (texts[0] + 1)
    other = (n + 1 - share) / (texts[1] + 1)
    return (np.log(toxic / other) * (p + n) / (p + n + 2) / 2).clip(-2, 2).astype(np.float32)


class Network:
    """Parameters, scoring and training."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.word_evidence = np.zeros(1 << EVIDENCE_BITS, np.float32)
        self.gram_evidence = np.zeros(1 << EVIDENCE_BITS, np.float32)
        self.p = {"word": normal(1 << VECTOR_BITS, VECTOR, scale=0.05), "gram": normal(1 << VECTOR_BITS, VECTOR, scale=0.05)}
        for side in "fb":
            self.p |= {
                f"{side}_in": normal(INPUTS, 3 * HIDDEN, scale=0.4),
                f"{side}_bias": np.zeros(3 * HIDDEN, np.float32),
                f"{side}_gates": normal(HIDDEN, 2 * HIDDEN, scale=0.3),
                f"{side}_new": normal(HIDDEN, HIDDEN, scale=0.3),
            }
        self.p |= {"attend": normal(2 * HIDDEN, scale=0.3), "out": normal(2 * HIDDEN, scale=0.5), "bias": np.float32(-1.0).reshape(1)}

    # inputs

    def inputs(self, grams: Grams, word_evidence=None, gram_evidence=None) -> np.ndarray:
        """A row of inputs for each word."""
        known = self.gram_evidence[grams.buckets(grams.gram, EVIDENCE_BITS)] if gram_evidence is None else gram_evidence
        own = self.word_evidence[grams.buckets(grams.word, EVIDENCE_BITS)] if word_evidence is None else word_evidence
        counts = grams.counts[:, None].astype(np.float32)
        vectors = np.add.reduceat(self.p["gram"][grams.buckets(grams.gram, VECTOR_BITS)], grams.first, axis=0) / counts
        return np.hstack(
            [
                own[:, None],
                np.maximum.reduceat(known, grams.first)[:, None],
                np.add.reduceat(known, grams.first)[:, None] / counts,
                self.p["word"][grams.buckets(grams.word, VECTOR_BITS)],
                vectors,
            ]
        ).astype(np.float32)

    def projected(self, inputs: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """What each word feeds into the gates and the new state, by direction."""
        out = {}
        for side in "fb":
            fed = inputs @ self.p[f"{side}_in"] + self.p[f"{side}_bias"]
            out[side] = (np.ascontiguousarray(fed[:, : 2 * HIDDEN]), np.ascontiguousarray(fed[:, 2 * HIDDEN :]))
        return out

    # forward

    def states(self, fed: tuple[np.ndarray, np.ndarray], words: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (WINDOW, windows, HIDDEN); ``words`` (WINDOW, windows) are rows of ``fed``."""
        gates_in, new_in = fed
        gates, new = self.p[f"{side}_gates"], self.p[f"{side}_new"]
        steps, size = words.shape
        out = np.empty((steps, size, HIDDEN), np.float32)
        h = np.zeros((size, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            zr = np.take(gates_in, words[t], axis=0)
            zr += h @ gates
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            u = h @ new
            n = np.take(new_in, words[t], axis=0)
            n += r * u
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((t, h, z, r, u, n))
            h = n + z * (h - n)
            out[t] = h
        return out

    def pooled(self, forth: np.ndarray, back: np.ndarray):
        a, o = self.p["attend"], self.p["out"]
        weight = forth @ a[:HIDDEN] + back @ a[HIDDEN:]
        weight -= weight.max(axis=0)
        np.exp(weight, out=weight)
        weight /= weight.sum(axis=0)
        value = forth @ o[:HIDDEN] + back @ o[HIDDEN:]
        return weight, value, (weight * value).sum(axis=0) + self.p["bias"][0]

    def logits(self, fed: dict, words: np.ndarray) -> np.ndarray:
        return self.pooled(self.states(fed["f"], words, "f"), self.states(fed["b"], words, "b"))[2]

    # training

    def gradients(self, inputs: np.ndarray, words: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        """Gradients of the mean weighted cross-entropy of windows, by parameter, and for ``inputs``."""
        fed = self.projected(inputs)
        kept: dict[str, list] = {"f": [], "b": []}
        state = {s: self.states(fed[s], words, s, kept[s]) for s in "fb"}
        weight, value, logit = self.pooled(state["f"], state["b"])
        d_logit = ((1 / (1 + np.exp(-logit)) - labels) * weights / len(labels)).astype(np.float32)
        d_value = weight * d_logit
        pooled = (weight * value).sum(axis=0)
        d_weight = weight * (value - pooled) * d_logit
        g = {"bias": d_logit.sum().reshape(1)}
        for name, d in (("attend", d_weight), ("out", d_value)):
            g[name] = np.concatenate([np.einsum("tb,tbh->h", d, state[s]) for s in "fb"])
        d_inputs = np.zeros_like(inputs)
        for k, side in enumerate("fb"):
            part = slice(k * HIDDEN, (k + 1) * HIDDEN)
            gates, new = self.p[f"{side}_gates"], self.p[f"{side}_new"]
            d_fed = np.zeros((len(inputs), 3 * HIDDEN), np.float32)
            g_gates, g_new = np.zeros_like(gates), np.zeros_like(new)
            d_h = np.zeros((words.shape[1], HIDDEN), np.float32)
            for t, h, z, r, u, n in reversed(kept[side]):
                d_h = d_h + d_value[t][:, None] * self.p["out"][part] + d_weight[t][:, None] * self.p["attend"][part]
                d_n = d_h * (1 - z) * (1 - n * n)
                d_zr = np.hstack([d_h * (h - n) * z * (1 - z), d_n * u * r * (1 - r)])
                d_u = d_n * r
                g_gates += h.T @ d_zr
                g_new += h.T @ d_u
                d_h = d_h * z + d_zr @ gates.T + d_u @ new.T
                np.add.at(d_fed, words[t], np.hstack([d_zr, d_n]))
            g[f"{side}_gates"], g[f"{side}_new"] = g_gates, g_new
            g[f"{side}_in"], g[f"{side}_bias"] = inputs.T @ d_fed, d_fed.sum(axis=0)
            d_inputs += d_fed @ self.p[f"{side}_in"].T
        return g, d_inputs

    def train(self, texts: list[str], labels: list[int], epochs: int = 8, seed: int = 7) -> Network:
        """Fit on whole labelled texts.

        Every few epochs all windows of all texts are scored; each text then trains on its highest window, and
        texts without the label also on random ones.
        """
        if not texts:
            return self
        rng = np.random.default_rng(seed)
        label = np.asarray(labels, np.int64)
        vocabulary: dict[str, int] = {PADDING: 0}
        by_text, lengths = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = split(text)
            lengths[k] = len(words)
            by_text.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in padded([words])), np.int32))
        ids = np.concatenate(by_text)
        known = Grams.of(list(vocabulary))
        size = len(vocabulary)
        del vocabulary, by_text
        begins, owner = windows(lengths)
        own, gram = self.learn_evidence(known, ids, lengths, label)

        def rows(which: np.ndarray) -> np.ndarray:
            """Word rows of windows; a toxic text's words have rows of their own, without its own evidence."""
            return (ids[begins[which][:, None] + np.arange(WINDOW)] + label[owner[which]][:, None] * size).T

        def row_inputs(used: np.ndarray) -> tuple[Grams, np.ndarray]:
            picked, at = self.picked(known, used % size)
            of = np.repeat(used // size, picked.counts)
            return picked, self.inputs(picked, own[used // size, used % size], gram[of, at])

        def all_projected() -> dict:
            fed = {s: (np.empty((2 * size, 2 * HIDDEN), np.float32), np.empty((2 * size, HIDDEN), np.float32)) for s in "fb"}
            for i in range(0, 2 * size, 20_000):
                part = np.arange(i, min(i + 20_000, 2 * size))
                for side, made in self.projected(row_inputs(part)[1]).items():
                    for whole, piece in zip(fed[side], made):
                        whole[part] = piece
            return fed

        toxic = label == 1
        weight = np.where(toxic, 1.0, max(0.2, toxic.sum() / max(1, (~toxic).sum()) * 2)).astype(np.float32)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            if epoch % 4 == 0:
                fed = all_projected()
                logit = np.concatenate(
                    [self.logits(fed, rows(np.arange(i, min(i + 4096, len(owner))))) for i in range(0, len(owner), 4096)]
                )
                del fed
                order = np.lexsort((-logit, owner))
                top = order[np.unique(owner[order], return_index=True)[1]]
            calm = np.flatnonzero(~toxic[owner])
            extra = rng.choice(calm, min(len(calm), len(texts)), replace=False) if len(calm) else calm
            chosen = rng.permutation(np.concatenate([top, extra]))
            for i in range(0, len(chosen), 64):
                which = chosen[i : i + 64]
                used, at = np.unique(rows(which), return_inverse=True)
                picked, inputs = row_inputs(used)
                g, d_inputs = self.gradients(inputs, at.reshape(WINDOW, -1), label[owner[which]], weight[owner[which]])
                step += 1
                self.adam(g, moments, step)
                self.move_vectors(picked, d_inputs)
        return self

    @staticmethod
    def picked(grams: Grams, rows: np.ndarray) -> tuple[Grams, np.ndarray]:
        counts = grams.counts[rows]
        first = np.cumsum(counts) - counts
        at = np.repeat(grams.first[rows] - first, counts) + np.arange(counts.sum())
        return Grams(grams.word[rows], grams.gram[at], first, counts), at

    def learn_evidence(self, words: Grams, ids: np.ndarray, lengths: np.ndarray, label: np.ndarray):
        """Set the evidence tables; returns evidence by word and by gram, a row for other texts and one for toxic ones."""
        texts = (int((label == 1).sum()), int((label == 0).sum()))
        lengths = np.maximum(lengths, WINDOW)
        ends = np.cumsum(lengths)
        buckets = {"word": words.buckets(words.word, EVIDENCE_BITS), "gram": words.buckets(words.gram, EVIDENCE_BITS)}
        held = {k: np.zeros((2, 1 << EVIDENCE_BITS), np.float32) for k in buckets}
        for k, end in enumerate(ends):
            seen = np.unique(ids[end - lengths[k] : end])
            held["word"][label[k], np.unique(buckets["word"][seen])] += 1
            held["gram"][label[k], np.unique(buckets["gram"][self.picked(words, seen)[1]])] += 1
        out = []
        for k, (n, p) in held.items():
            setattr(self, f"{k}_evidence", evidence(p, n, texts))
            calm = evidence(p, np.maximum(n - 1, 0), (texts[0], max(0, texts[1] - 1)))
            toxic = evidence(np.maximum(p - 1, 0), n, (max(0, texts[0] - 1), texts[1]))
            out.append(np.stack([calm[buckets[k]], toxic[buckets[k]]]))
        return out

    def adam(self, g: dict, moments: dict, step: int, rate: float = 0.01) -> None:
        for name, d in g.items():
            m, v = moments[name]
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            self.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)

    def move_vectors(self, grams: Grams, d_inputs: np.ndarray, rate: float = 0.3) -> None:
        """Plain gradient steps for the vectors of the words and grams at hand."""
        np.add.at(self.p["word"], grams.buckets(grams.word, VECTOR_BITS), -rate * d_inputs[:, 3 : 3 + VECTOR])
        d_gram = np.repeat(d_inputs[:, 3 + VECTOR :] / grams.counts[:, None].astype(np.float32), grams.counts, axis=0)
        np.add.at(self.p["gram"], grams.buckets(grams.gram, VECTOR_BITS), -rate * d_gram)


def put(rows: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    """``rows`` with ``more`` written from row ``at`` on, grown if need be."""
    if at + len(more) > len(rows):
        grown = np.empty((max(2 * len(rows), at + len(more)), rows.shape[1]), rows.dtype)
        grown[:at] = rows[:at]
        rows = grown
    rows[at : at + len(more)] = more
    return rows


class Scorer:
    """Scores whole texts; what words feed into the network is remembered for up to ``remembered`` words."""

    def __init__(self, network: Network, remembered: int = 250_000):
        self.network, self.remembered = network, remembered
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.fed = {s: (np.empty((0, 2 * HIDDEN), np.float32), np.empty((0, HIDDEN), np.float32)) for s in "fb"}

    def extend(self, words: list[str], known: int) -> None:
        """Work out the rows of new words, which come after ``known`` ones; the tables grow by doubling."""
        step = 20_000
        for i in range(0, len(words), step):
            more = self.network.projected(self.network.inputs(Grams.of(words[i : i + step])))
            for side, parts in more.items():
                self.fed[side] = tuple(put(old, known + i, new) for old, new in zip(self.fed[side], parts))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Score (0 to 1) of each text."""
        split_texts = list(map(split, texts))
        lengths = np.fromiter(map(len, split_texts), np.int64, len(texts))
        words = padded(split_texts)
        known, new = self.rows, []
        if len(known) > self.remembered:
            self.forget()
            known = self.rows
        for word in set(words).difference(known):
            known[word] = len(known)
            new.append(word)
        self.extend(new, len(known) - len(new))
        ids = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        begins, owner = windows(lengths)
        highest = np.full(len(texts), -np.inf, np.float32)
        for i in range(0, len(owner), 2048):
            at = begins[i : i + 2048][None, :] + np.arange(WINDOW)[:, None]
            np.maximum.at(highest, owner[i : i + 2048], self.network.logits(self.fed, ids[at]))
        return 1 / (1 + np.exp(-highest.astype(np.float64)))
