"""Language of texts: a bidirectional gated recurrent network over bytes, trained here by backpropagation through time."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .text import per_text, text_of

HIDDEN, STEPS, PER_LANGUAGE, SNIPPET = 8, 220, 300, 1_024
SEGMENT, TRAINED_LENGTH, LANES = 128, 48, 2_048
MAX_LANGS = 500


_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L); signs such as a half, circled or Roman numbers are none."""
    return any(m[0].isalpha() for m in _WORD.finditer(text))


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): bounded like tanh, without an exponential."""
    return x / (1.0 + np.abs(x))


@dataclass
class Net:
    """Per direction: byte rows ``x`` (256 x 3H: reset, update, new), recurrent ``u`` (H x 3H). Then ``v`` (2H x langs), ``c``."""

    langs: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    v: np.ndarray
    c: np.ndarray

    @classmethod
    def random(cls, langs: list[str], hidden: int, seed: int) -> Net:
        rng = np.random.default_rng(seed)

        def normal(*size):
            return (rng.standard_normal(size) * 0.3).astype(np.float32)

        x, u = [normal(256, 3 * hidden) for _ in "fb"], [normal(hidden, 3 * hidden) for _ in "fb"]
        return cls(langs, x, u, normal(2 * hidden, len(langs)), np.zeros(len(langs), dtype=np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.x, *self.u, self.v, self.c]

    def states(self, data: np.ndarray, direction: int, keep: list) -> np.ndarray:
        """Hidden states (time x lanes x H) of one direction over ``data`` (time x lanes of bytes), and its steps in ``keep``."""
        n, lanes = data.shape
        u, rows = self.u[direction], self.x[direction]
        h = len(u)
        state, out = np.zeros((lanes, h), dtype=np.float32), np.empty((n, lanes, h), dtype=np.float32)
        for t in (range(n) if direction == 0 else range(n - 1, -1, -1)):
            a, b = rows[data[t]], state @ u
            gates = squash(a[:, :2 * h] + b[:, :2 * h]) * 0.5 + 0.5
            r, z = gates[:, :h], gates[:, h:]
            new = squash(a[:, 2 * h:] + r * b[:, 2 * h:])
            keep.append((t, state, a, b, gates, new))
            state = new + z * (state - new)
            out[t] = state
        return out

    def logits(self, data: np.ndarray, direction: int, out: np.ndarray) -> None:
        """Adds one direction's part of the logits to ``out`` (time x lanes x languages); buffers are used again."""
        n, lanes = data.shape
        u, rows = self.u[direction], self.x[direction]
        h = len(u)
        v = np.ascontiguousarray(self.v[direction * h:(direction + 1) * h])
        u_gate, u_new = np.ascontiguousarray(u[:, :2 * h]), np.ascontiguousarray(u[:, 2 * h:])
        x_gate, x_new = np.ascontiguousarray(rows[:, :2 * h]), np.ascontiguousarray(rows[:, 2 * h:])
        state = np.zeros((lanes, h), dtype=np.float32)
        gate, size, back = (np.empty((lanes, 2 * h), dtype=np.float32) for _ in range(3))
        new, part = np.empty((lanes, h), dtype=np.float32), np.empty((lanes, h), dtype=np.float32)
        for t in (range(n) if direction == 0 else range(n - 1, -1, -1)):
            np.take(x_gate, data[t], axis=0, out=gate, mode="clip")
            gate += np.matmul(state, u_gate, out=back)
            np.abs(gate, out=size)
            size += 1.0
            gate /= size
            gate *= 0.5
            gate += 0.5
            np.matmul(state, u_new, out=part)
            part *= gate[:, :h]
            np.take(x_new, data[t], axis=0, out=new, mode="clip")
            new += part
            np.abs(new, out=part)
            part += 1.0
            new /= part
            state -= new
            state *= gate[:, h:]
            state += new
            out[t] += state @ v

    def labels(self, data: np.ndarray) -> np.ndarray:
        """Probabilities per position (time x lanes x languages)."""
        out = np.empty((*data.shape, len(self.langs)), dtype=np.float32)
        out[:] = self.c
        self.logits(data, 0, out)
        self.logits(data, 1, out)
        np.exp(np.clip(out, -30, 30, out=out), out=out)
        out /= out.sum(axis=2, keepdims=True)
        return out

    def gradients(self, data: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Mean gradient of the cross entropy at every position; ``target``: language of each lane."""
        n, lanes = data.shape
        kept: list[list] = [[], []]
        both = [self.states(data, d, kept[d]) for d in (0, 1)]
        joint = np.concatenate(both, axis=2)
        logits = joint @ self.v + self.c
        logits = np.exp(logits - logits.max(axis=2, keepdims=True))
        error = logits / logits.sum(axis=2, keepdims=True)
        error[:, np.arange(lanes), target] -= 1
        error /= n * lanes
        h = len(self.u[0])
        dv, dc, back = np.einsum("tlh,tlk->hk", joint, error), error.sum(axis=(0, 1)), error @ self.v.T
        dx, du = [np.zeros_like(x) for x in self.x], [np.zeros_like(u) for u in self.u]
        for d in (0, 1):
            flow, moved = np.zeros((lanes, h), dtype=np.float32), []
            for t, state, a, b, gates, new in reversed(kept[d]):
                flow = flow + back[t][:, d * h:(d + 1) * h]
                r, z = gates[:, :h], gates[:, h:]
                d_new = flow * (1 - z) * (1 - np.abs(new)) ** 2
                d_z = flow * (state - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                d_r = d_new * b[:, 2 * h:] * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                d_a = np.concatenate([d_r, d_z, d_new], axis=1)
                d_b = np.concatenate([d_r, d_z, d_new * r], axis=1)
                moved.append((t, d_a))
                du[d] += state.T @ d_b
                flow = flow * z + d_b @ self.u[d].T
            places = np.concatenate([data[t] for t, _ in moved])
            moves = np.concatenate([m for _, m in moved])
            for k in range(3 * h):
                dx[d][:, k] = np.bincount(places, weights=moves[:, k], minlength=256)
        return [*dx, *du, dv, dc]


def fit(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, length: int = TRAINED_LENGTH,
        lanes: int = 96, rate: float = 0.02, seed: int = 7) -> Net:
    """Train on windows of the samples, every language equally often, by Adam with a falling rate."""
    by: dict[str, list[np.ndarray]] = {}
    for data, lang in samples:
        if data:
            by.setdefault(lang, []).append(np.frombuffer(data, dtype=np.uint8))
    langs = sorted(by)
    net, rng = Net.random(langs, hidden, seed), np.random.default_rng(seed)
    if len(langs) < 2:
        return net
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        target = rng.integers(0, len(langs), lanes)
        data = np.empty((length, lanes), dtype=np.uint8)
        for i, k in enumerate(target):
            text = by[langs[k]][rng.integers(0, len(by[langs[k]]))]
            text = np.resize(text, length) if len(text) < length else text
            at = rng.integers(0, len(text) - length + 1)
            data[:, i] = text[at:at + length]
        now = rate * (1 - 0.9 * step / steps)
        for p, g, m, s in zip(net.parameters(), net.gradients(data, target), first, second):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= (now * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Net, texts: list[bytes], segment: int = SEGMENT, lanes: int = LANES) -> np.ndarray:
    """Mean probability over all positions of each text (texts x languages); rows of empty texts are 0.

    Texts are cut into segments of ``segment`` bytes that the network reads side by side; the last one of a text is
    filled up with spaces whose labels don't count.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    parts = -(-sizes // segment)
    owner = np.repeat(np.arange(len(texts)), parts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    filled = np.minimum(sizes[owner] - place * segment, segment)
    whole = np.frombuffer(b"".join(t + b" " * (-len(t) % segment) for t in texts), dtype=np.uint8).reshape(-1, segment)
    out = np.zeros((len(texts), len(net.langs)))
    for a in range(0, len(owner), lanes):
        b = min(a + lanes, len(owner))
        marks = net.labels(np.ascontiguousarray(whole[a:b].T))
        marks *= (np.arange(segment)[:, None] < filled[a:b][None, :])[:, :, None]
        np.add.at(out, owner[a:b], marks.sum(axis=0))
    return out / np.maximum(sizes, 1)[:, None]


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_out, per_language: int, snippet: int,
          max_langs: int = MAX_LANGS) -> Net:
    """Fit on about ``per_language`` snippets of ``snippet`` characters of each language, chosen by hash of the id.

    Learned are the ``max_langs`` values of the language column with the most rows, so a dirty column stays bounded. At
    most twice that many snippets are collected, all languages together. Rows held out and rows without a language take
    no part.
    """
    usable = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out.alias("held")
    ).where(~F.col("held") & F.col("lang").isNotNull() & (F.col("lang") != "") & (F.col("text") != ""))
    common = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs)
    counts = {r["lang"]: r["count"] for r in common.collect()}
    if not counts:
        return Net.random([], HIDDEN, 1)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sorted(counts.items())])
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), F.char_length("text") - snippet)).cast("int")
    rows = usable.where(draw < share).select("id", "lang", F.substring("text", place + 1, F.lit(snippet)).alias("t"))
    rows = rows.orderBy(F.xxhash64("id"), "id", "t", "lang").limit(2 * per_language * len(counts)).collect()
    return fit([(_bytes(r.t), r.lang) for r in rows])


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, snippet: int = SNIPPET, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: id, held_out, lang_pred, score (pooled probability of lang_pred), and ``carry``.

    Held out are the rows whose crc32 of the id as text is a multiple of 5; a row without id counts as held out. The
    network sees every byte of the whole text in lower case. ``und`` with score 0: null texts, texts without a letter,
    and any text if no row has a language to learn. At equal probability the first language in order is predicted.
    Repeated rows get equal results. No exchange; the network sent along has some 15,000 numbers.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))
    shared = spark.sparkContext.broadcast(train(docs, id_col, text_col, lang_col, held_out, per_language, snippet))

    def make():
        net = shared.value

        def body(texts):
            known = [bool(net.langs) and has_letter(t) for t in texts]
            data = [_bytes(t) for t, k in zip(texts, known) if k]
            probability = iter(pooled(net, data) if data else ())
            rows = [next(probability) if k else None for k in known]
            return {
                "lang_pred": ["und" if p is None else net.langs[int(p.argmax())] for p in rows],
                "score": [0.0 if p is None else float(min(max(p.max(), 0.0), 1.0)) for p in rows]}
        return body

    column = per_text(text_of(text_col), make, "struct<lang_pred:string,score:double>", spark)
    out = docs.select(
        F.col(id_col).alias("__id"), held_out.alias("held_out"), column.alias("__made"), *[F.col(c).alias(f"__rest_{c}") for c in carry])
    return out.select(F.col("__id").alias(id_col), "held_out", "__made.lang_pred", "__made.score",
                      *[F.col(f"__rest_{c}").alias(c) for c in carry])
