"""Toxicity by a bidirectional gated recurrent network with attention pooling over words and their characters.

A word enters as its own vector (if the training words hold it) beside the last states of two recurrent
passes over its characters. A second pair of passes reads windows of words, attention pools their
states, and a linear unit gives the window's logit. Windows overlap and cover the whole text; a document's
score is its highest window, calibrated to a probability. Training is plain numpy on a bounded sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intelspark.llm.common import map_partition, parts, split_words

WINDOW, STRIDE = 48, 40  # words of a window and from one to the next
FIT_ROWS = 1200  # labelled documents per class that the network is trained on
WORDS = 20_000  # words with a vector of their own
WORD_DIM, CHAR_DIM, CHAR_STATE, STATE, ATTENTION = 8, 6, 6, 8, 8
STEPS, BATCH, RATE = (100, 60), 128, 0.015  # batches before and after the windows are picked anew
CACHE = 400_000  # words a worker remembers
MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())  # stripped from the ends of words
PAD, OTHER = 0, 1
F32 = np.float32


def squash(x: np.ndarray) -> np.ndarray:
    """Softsign, the layers' activation in place of the dearer hyperbolic tangent; its slope is (1 - |value|)^2."""
    return x / (F32(1) + np.abs(x))


def slope(value: np.ndarray) -> np.ndarray:
    return np.square(F32(1) - np.abs(value))


def gate(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * squash(x) + F32(0.5)


def gathered(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows that go to each of ``size`` places."""
    return np.stack([np.bincount(at, column, size) for column in rows.T], 1).astype(F32)


def gru(inputs: list[np.ndarray], u: np.ndarray) -> tuple[np.ndarray, list]:
    """Last states, and per step what ``gru_back`` needs; inputs holds projected rows (rows, 3n) of each step.

    A step with fewer rows than the first moves the first rows on, the others keep their state.
    """
    n = u.shape[0]
    h, kept = np.zeros((len(inputs[0]), n), F32), []
    for x in inputs:
        before = h[: len(x)]
        hu = before @ u
        gates = gate(x[:, : 2 * n] + hu[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = squash(x[:, 2 * n :] + r * hu[:, 2 * n :])
        after = new + z * (before - new)
        kept.append((before, z, r, new, hu, after))
        h = after if len(x) == len(h) else np.concatenate([after, h[len(x) :]])
    return h, kept


def gru_back(grad: np.ndarray | None, last: np.ndarray, u: np.ndarray, kept: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of each step's inputs and of ``u`` from those of the states of all steps (grad, if any) and of the last states."""
    n = u.shape[0]
    carry, dx, du = last.copy(), [], np.zeros_like(u)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, new, hu, _ = kept[t]
        m = len(h)
        g = carry[:m] if grad is None else carry[:m] + grad[t]
        dnew = g * (1 - z) * slope(new)
        dz = g * (h - new) * F32(0.5) * slope(2 * z - 1)
        dr = dnew * hu[:, 2 * n :] * F32(0.5) * slope(2 * r - 1)
        dx.append(np.concatenate([dz, dr, dnew], 1))
        dhu = np.concatenate([dz, dr, dnew * r], 1)
        du += h.T @ dhu
        carry[:m] = g * z + dhu @ u.T
    return dx[::-1], du


class Network:
    def __init__(self, vocabulary: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        wide = WORD_DIM + 2 * CHAR_STATE

        def made(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(F32)

        self.index = {w: i + 2 for i, w in enumerate(vocabulary)}
        self.p = {
            "word": (0.1 * rng.standard_normal((len(vocabulary) + 2, WORD_DIM))).astype(F32), "char": (0.3 * rng.standard_normal((256, CHAR_DIM))).astype(F32),
            "attend": made(2 * STATE, ATTENTION), "attend_b": np.zeros(ATTENTION, F32), "query": made(ATTENTION), "out": made(2 * STATE), "out_b": np.zeros(1, F32)}
        for side in "fb":
            self.p |= {f"cw{side}": made(CHAR_DIM, 3 * CHAR_STATE), f"cu{side}": made(CHAR_STATE, 3 * CHAR_STATE), f"cb{side}": np.zeros(3 * CHAR_STATE, F32),
                       f"w{side}": made(wide, 3 * STATE), f"u{side}": made(STATE, 3 * STATE), f"b{side}": np.zeros(3 * STATE, F32)}

    def characters(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Last states of both passes over the characters (bytes) of the words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(-size, kind="stable")
        size, data = size[order], np.frombuffer(b"".join([raw[i] for i in order]), np.uint8).astype(np.int64)
        first = np.cumsum(size) - size
        steps = max(1, int(size.max(initial=1)))
        live = len(size) - np.searchsorted(size[::-1], np.arange(steps), "right")
        codes = [[data[first[:m] + t] for t, m in enumerate(live)], [data[first[:m] + size[:m] - 1 - t] for t, m in enumerate(live)]]
        ends, kept = [], []
        for part, side in zip(codes, "fb"):
            made = self.p["char"] @ self.p[f"cw{side}"] + self.p[f"cb{side}"]
            last, k = gru([made.take(c, 0) for c in part], self.p[f"cu{side}"])
            ends.append(np.concatenate([last, np.zeros((len(raw) - len(last), CHAR_STATE), F32)]))
            kept.append(k)
        out = np.empty((len(raw), 2 * CHAR_STATE), F32)
        out[order] = np.concatenate(ends, 1)
        return out, (order, codes, kept)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Vectors of words; the empty word is padding."""
        at = np.array([self.index.get(w, OTHER) if w else PAD for w in words])
        chars, kept = self.characters(words)
        return np.concatenate([self.p["word"][at], chars], 1), (at, kept)

    def projected(self, words: list[str]) -> np.ndarray:
        """Inputs of both passes over words, ready for the recurrence: (6, words, STATE), a table for each gate of each pass."""
        out = np.zeros((6, len(words), STATE), F32)
        order = np.array(sorted(range(len(words)), key=lambda i: len(words[i])))
        for a in range(0, len(order), 4096):
            some = order[a : a + 4096]
            x, _ = self.inputs([words[i] for i in some])
            for k, side in enumerate("fb"):
                made = x @ self.p[f"w{side}"] + self.p[f"b{side}"]
                for j in range(3):
                    out[3 * k + j, some] = made[:, j * STATE : (j + 1) * STATE]
        return out

    def logits(self, table: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Logits of windows (rows, WINDOW) of indexes into ``table`` (row 0 is padding)."""
        out, n = [], STATE
        for a in range(0, len(windows), 2048):
            part = np.ascontiguousarray(windows[a : a + 2048].T)
            sides = []
            for k, side in enumerate("fb"):
                uz, ur, un = (np.ascontiguousarray(self.p[f"u{side}"][:, j * n : (j + 1) * n]) for j in range(3))
                xz, xr, xn = table[3 * k : 3 * k + 3]
                h, states = np.zeros((part.shape[1], n), F32), np.empty((len(part), part.shape[1], n), F32)
                for t in range(len(part)) if k == 0 else range(len(part) - 1, -1, -1):
                    at = part[t]
                    z = gate(xz.take(at, 0) + h @ uz)
                    r = gate(xr.take(at, 0) + h @ ur)
                    r *= h @ un
                    r += xn.take(at, 0)
                    new = squash(r)
                    h = new + z * (h - new)
                    states[t] = h
                sides.append(states)
            hidden = sum(s.reshape(-1, n) @ self.p["attend"][k * n : (k + 1) * n] for k, s in enumerate(sides)) + self.p["attend_b"]
            score = (squash(hidden) @ self.p["query"]).reshape(part.shape)
            value = sum(s.reshape(-1, n) @ self.p["out"][k * n : (k + 1) * n] for k, s in enumerate(sides)).reshape(part.shape)
            score = np.where(part > 0, score, F32(-1e9))
            weight = np.exp(score - score.max(0))
            out.append((weight * value).sum(0) / weight.sum(0) + self.p["out_b"][0])
        return np.concatenate(out) if out else np.zeros(0, F32)

    def gradients(self, words: list[str], windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss; ``words`` are the batch's distinct words, the first of them padding."""
        p, part, g = self.p, windows.T, {}
        x, (at, (order, codes, char_kept)) = self.inputs(words)
        states, kept = [], []
        for side, step in (("f", 1), ("b", -1)):
            made = x @ p[f"w{side}"] + p[f"b{side}"]
            _, k = gru([made.take(c, 0) for c in part[::step]], p[f"u{side}"])
            states.append(np.stack([one[-1] for one in k])[::step])
            kept.append(k)
        both = np.concatenate(states, 2)
        hidden = squash(both @ p["attend"] + p["attend_b"])
        score = np.where(part > 0, hidden @ p["query"], F32(-1e9))
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tb,tbn->bn", weight, both)
        d = ((1 / (1 + np.exp(-(pooled @ p["out"] + p["out_b"][0]))) - labels) / len(labels)).astype(F32)
        g["out"], g["out_b"] = pooled.T @ d, d.sum(keepdims=True)
        dpool = d[:, None] * p["out"]
        dweight = np.einsum("bn,tbn->tb", dpool, both)
        dscore = weight * (dweight - (weight * dweight).sum(0))
        g["query"] = np.einsum("tb,tba->a", dscore, hidden)
        dhidden = dscore[:, :, None] * p["query"] * slope(hidden)
        g["attend"], g["attend_b"] = np.einsum("tbn,tba->na", both, dhidden), dhidden.sum((0, 1))
        dboth = weight[:, :, None] * dpool + dhidden @ p["attend"].T
        dinput = np.zeros_like(x)
        for i, (side, step) in enumerate((("f", 1), ("b", -1))):
            dx, g[f"u{side}"] = gru_back(dboth[::step, :, i * STATE : (i + 1) * STATE], np.zeros((part.shape[1], STATE), F32), p[f"u{side}"], kept[i])
            rows = gathered(part[::step].ravel(), np.concatenate(dx), len(x))
            g[f"w{side}"], g[f"b{side}"] = x.T @ rows, rows.sum(0)
            dinput += rows @ p[f"w{side}"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], at, dinput[:, :WORD_DIM])
        g["char"] = np.zeros_like(p["char"])
        for i, side in enumerate("fb"):
            end = dinput[order[: len(codes[0][0])], WORD_DIM + i * CHAR_STATE : WORD_DIM + (i + 1) * CHAR_STATE]
            dx, g[f"cu{side}"] = gru_back(None, end, p[f"cu{side}"], char_kept[i])
            rows = gathered(np.concatenate(codes[i]), np.concatenate(dx), 256)
            g[f"cw{side}"], g[f"cb{side}"] = p["char"].T @ rows, rows.sum(0)
            g["char"] += rows @ p[f"cw{side}"].T
        return g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x / max(1.0, size)
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)


def plain(word: str) -> str:
    """A word in lower case without marks at its ends; marks alone stay."""
    return word.lower().strip(MARKS) or word


def _cut(codes: np.ndarray) -> np.ndarray:
    """Overlapping windows over a text's words (as indexes above 0), padded at the end; a wordless text has one of padding."""
    n = max(1, -(-max(len(codes) - WINDOW, 0) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int64)
    padded[: len(codes)] = codes
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


class Model:
    """A trained network and its calibration; ``score`` gives a probability per text."""

    def __init__(self, network: Network, slope: float, offset: float):
        self.network, self.slope, self.offset = network, slope, offset
        self.known: dict[str, int] = {}
        self.table = np.zeros((6, 0, STATE), F32)

    def __getstate__(self):
        return {"network": self.network, "slope": self.slope, "offset": self.offset, "known": {}, "table": np.zeros((6, 0, STATE), F32)}

    def rows(self, words: list[str]) -> np.ndarray:
        """Table rows of words, made where they are new; row 0 is padding."""
        words = [plain(w) for w in words]
        new = list({w for w in words if w not in self.known})
        if not self.table.shape[1] or len(self.known) + len(new) > CACHE:
            self.known, new, self.table = {}, list(set(words)), self.network.projected([""])
        if new:
            self.known.update(zip(new, range(self.table.shape[1], self.table.shape[1] + len(new))))
            self.table = np.concatenate([self.table, self.network.projected(new)], 1)
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))

    def logits(self, texts: pa.Array) -> np.ndarray:
        """Highest window logit of each whole text."""
        words, codes, offsets = split_words(texts)
        at = self.rows(words)[codes]
        cuts = [_cut(at[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]
        first = np.cumsum([0] + [len(c) for c in cuts[:-1]])
        return np.maximum.reduceat(self.network.logits(self.table, np.concatenate(cuts)), first)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit.astype(float) + self.offset, -40, 40)))


def train(texts: list[str], labels: np.ndarray, share: float) -> Model:
    """Network trained on documents and calibrated to a ``share`` of label 1.

    A document's label holds for one window of it at least, so training takes the window that looks most
    like label 1: first by the words' log odds, then by the network itself.
    """
    words, codes, offsets = split_words(pa.array(texts))
    distinct = {w: i for i, w in enumerate(dict.fromkeys(map(plain, words)))}
    codes, words = np.array([distinct[plain(w)] for w in words], np.int64)[codes], list(distinct)
    docs = [codes[a:b] for a, b in zip(offsets, offsets[1:])]
    held = np.zeros((2, len(words)))
    for d, y in zip(docs, labels):
        held[int(y), np.unique(d)] += 1
    seen = Counter(dict(enumerate(held.sum(0))))
    odds = np.log((held[1] + 0.5) / (labels.sum() + 1)) - np.log((held[0] + 0.5) / (len(labels) - labels.sum() + 1))
    odds = np.where(held.sum(0) >= 3, np.maximum(odds - 0.5, 0), 0)
    network = Network([words[i] for i, n in seen.most_common(WORDS) if n >= 2])
    cuts = [_cut(d + 1) for d in docs]
    weights = np.append(0, odds)
    model = Model(network, 1.0, 0.0)
    rng, adam = np.random.default_rng(3), Adam(network.p, RATE)
    every, first = np.concatenate(cuts), np.cumsum([0] + [len(c) for c in cuts])
    value = weights[every].sum(1)
    names = np.array(["", *words], object)
    for steps in STEPS:
        picked = [a + int(np.argmax(value[a:b])) for a, b in zip(first, first[1:])]
        more = [int(rng.integers(a, b)) for a, b, y in zip(first, first[1:], labels) if not y]
        rows, target = every[picked + more], np.append(labels, np.zeros(len(more))).astype(F32)
        order = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-steps * BATCH // len(rows)))])
        for a in range(0, steps * BATCH, BATCH):
            some = order[a : a + BATCH]
            distinct, local = np.unique(np.append(0, rows[some]), return_inverse=True)
            adam.step(network.gradients(names[distinct].tolist(), local[1:].reshape(-1, WINDOW), target[some]))
        value = network.logits(network.projected(["", *words]), every)
    top = np.maximum.reduceat(value, first[:-1]).astype(float)
    weight = np.where(labels == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))
    model.slope, model.offset = _calibrated(top, labels, weight)
    return model


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one number by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d, s = weight * (p - y), weight * p * (1 - p) + 1e-9
        g = np.array([(d * x).sum() + 0.01 * a, d.sum()])
        hess = np.array([[(s * x * x).sum() + 0.01, (s * x).sum()], [(s * x).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
    return max(a, 1e-3), b


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Model from documents (doc_id, text) and labels (doc_id, toxic).

    It is trained on ``fit_rows`` documents of each label, those of the smallest id hashes; rows whose
    label is null are left out. The share of label 1 that it is calibrated to covers all labelled rows.
    """
    spark = docs.sparkSession
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").dropDuplicates(["doc_id"])
             .join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    share = known.agg(F.avg("toxic")).first()[0]
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= fit_rows).select("doc_id", "toxic").collect()
    chosen = spark.createDataFrame(picked, known.select("doc_id", "toxic").schema)
    # At most 2 * fit_rows ids are broadcast, and as many texts come back.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()
    rows = sorted({r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))}.values(), key=lambda r: r["doc_id"])
    if not rows:
        return Model(Network([]), 1.0, -5.0)
    return train([r["text"] or "" for r in rows], np.array([float(r["toxic"]) for r in rows]), float(share))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text) over all overlapping windows of the whole text.

    Null, empty and wordless texts are read as one window of padding. Repeated rows score alike; other
    columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts(batches):
            yield {"doc_id": part.column("doc_id"), "score": model.probability(model.logits(part.column("text")))}

    return map_partition(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, score double")
