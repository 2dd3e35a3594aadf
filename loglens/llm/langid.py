"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

Texts are cut into segments of SEGMENT bytes. Two GRUs of HIDDEN units read each segment from either end, every byte
position gets a distribution over languages from both states, and a document's probabilities are the mean over all its
positions. Training is backpropagation through time on a bounded sample: SAMPLE labelled rows, drawn evenly over the
languages by a hash of doc_id, EXCERPT characters from a hashed place in each. Prediction reads whole texts, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm.common import release, table

HIDDEN, SEGMENT, BLOCK = 16, 128, 1024
SAMPLE, EXCERPT, STEPS, BATCH, RATE, SEED = 1600, 480, 320, 128, 0.02, 11
GROUP_BYTES = 4 << 20
UNKNOWN = "und"


class Network:
    """w (2, 3, 256, H): input tables of both directions for update gate, reset gate and candidate; u (2, 3, H, H);
    b (2, H): the candidate's recurrent bias; o (2, H, L) and c (L): output layer."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "w": draw(2, 3, 256, hidden, scale=0.3),
            "u": draw(2, 3, hidden, hidden, scale=0.7 / np.sqrt(hidden)),
            "b": np.zeros((2, hidden), np.float32),
            "o": draw(2, hidden, len(langs), scale=0.5 / np.sqrt(hidden)),
            "c": np.zeros(len(langs), np.float32),
        }
        self.p["w"][:, 0] += 1  # states last at first

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x (T, B) byte values -> probabilities (T, B, L). keep collects what backpropagation needs."""
        w, u, b, o, c = (self.p[k] for k in "wuboc")
        (steps, size), hidden = x.shape, b.shape[1]
        at = x.astype(np.intp)
        h = np.zeros((2, size, hidden), np.float32)
        g, v = np.empty((2, 3, size, hidden), np.float32), np.empty((2, 3, size, hidden), np.float32)
        half = np.float32(0.5)
        logits = np.empty((2, steps, size, len(c)), np.float32)
        for t in range(steps):
            for d, when in ((0, t), (1, steps - 1 - t)):
                for k in range(3):
                    np.take(w[d, k], at[when], axis=0, out=g[d, k], mode="clip")
            np.matmul(h[:, None], u, out=v)
            gates = g[:, :2] + v[:, :2]
            gates *= half
            np.tanh(gates, out=gates)
            gates *= half
            gates += half
            z, r = gates[:, 0], gates[:, 1]
            q = v[:, 2] + b[:, None]
            n = r * q
            n += g[:, 2]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, z, r, q, n))
            nxt = h - n
            nxt *= z
            nxt += n
            h = nxt
            logits[0, t] = h[0] @ o[0]
            logits[1, steps - 1 - t] = h[1] @ o[1]
        out = logits[0]
        out += logits[1]
        out += c
        np.clip(out, -30, 30, out=out)
        np.exp(out, out=out)
        out /= (out.reshape(-1, len(c)) @ np.ones((len(c), 1), np.float32)).reshape(steps, size, 1)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over the positions and its gradients, by backpropagation through time. x, mask (T, B); y, weight (B)."""
        keep: list = []
        p = self.forward(x, keep)
        w, u, b, o, _ = (self.p[k] for k in "wuboc")
        steps, size = x.shape
        share = mask * weight
        share /= share.sum()
        picked = p[:, np.arange(size), y]
        loss = float(-(share * np.log(picked + 1e-9)).sum())
        dl = p * share[:, :, None]
        dl[:, np.arange(size), y] -= share
        grad = {k: np.zeros_like(a) for k, a in self.p.items()}
        grad["c"] = dl.sum((0, 1))
        dg = np.empty((steps, 2, 3, size, b.shape[1]), np.float32)
        dh = np.zeros((2, size, b.shape[1]), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, q, n = keep[t]
            now = n + z * (h - n)
            for d, when in ((0, t), (1, steps - 1 - t)):
                grad["o"][d] += now[d].T @ dl[when]
                dh[d] += dl[when] @ o[d].T
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * q * r * (1 - r)
            dq = dn * r
            dg[t, :, 0], dg[t, :, 1], dg[t, :, 2] = dz, dr, dn
            up = np.stack([dz, dr, dq], axis=1)
            grad["u"] += h.transpose(0, 2, 1)[:, None] @ up
            grad["b"] += dq.sum(1)
            dh = dh * z + (up @ u.transpose(0, 1, 3, 2)).sum(1)
        for d in range(2):
            flat = (x if d == 0 else x[::-1]).ravel()
            order = np.argsort(flat, kind="stable")
            values, first = np.unique(flat[order], return_index=True)
            for k in range(3):
                grad["w"][d, k][values] = np.add.reduceat(dg[:, d, k].reshape(-1, b.shape[1])[order], first, axis=0)
        return loss, grad

    def train(self, texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = SEED) -> float:
        """Adam over segments of the texts, languages weighed alike. Returns the mean loss of the last steps."""
        cut = [(t[i : i + SEGMENT], k) for t, k in zip(texts, labels, strict=True) for i in range(0, len(t), SEGMENT) if len(t) - i >= 8 or i == 0]
        x, mask = segments([s for s, _ in cut])
        y = np.array([k for _, k in cut])
        weight = (1 / np.maximum(np.bincount(y, minlength=len(self.langs)), 1))[y].astype(np.float32)
        rng, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(y), min(BATCH, len(y)))
            loss, grad = self.gradients(x[pick].T, y[pick], mask[pick].T, weight[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * min(1, i / 20) * (1 if i < 0.7 * steps else 0.25)
            for k, g in grad.items():
                g = g * min(1, 1 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return float(np.mean(losses[-20:]))

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(documents, languages): the mean distribution over all byte positions; zeros for an empty text."""
        counts = np.array([len(t) for t in texts], dtype=np.int64)
        out = np.zeros((len(texts), len(self.langs)))
        per = -(-counts // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), per)
        if not len(owner):
            return out
        buffer = np.full(len(owner) * SEGMENT, 32, np.uint8)
        begin = np.concatenate([[0], np.cumsum(per)])[:-1] * SEGMENT
        for t, i in zip(texts, begin, strict=True):
            buffer[i : i + len(t)] = np.frombuffer(t, np.uint8)
        rows = buffer.reshape(-1, SEGMENT)
        inside = np.minimum(counts[owner] - (np.arange(len(owner)) * SEGMENT - begin[owner]), SEGMENT)
        for i in range(0, len(owner), BLOCK):
            p = self.forward(rows[i : i + BLOCK].T)
            for j in np.flatnonzero(inside[i : i + BLOCK] < SEGMENT):
                p[inside[i + j] :, j] = 0
            np.add.at(out, owner[i : i + BLOCK], p.sum(0))
        return out / np.maximum(counts, 1)[:, None]

    def positions(self, text: str) -> list[str]:
        """The language of every byte position of a text."""
        data = text.encode("utf-8", "replace")
        if not data:
            return []
        x, _ = segments([data[i : i + SEGMENT] for i in range(0, len(data), SEGMENT)])
        best = self.forward(x.T).argmax(2).T.ravel()[: len(data)]
        return [self.langs[k] for k in best]


def segments(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Parts of at most SEGMENT bytes as rows padded with spaces, and which positions are theirs."""
    x, mask = np.full((len(parts), SEGMENT), 32, np.uint8), np.zeros((len(parts), SEGMENT), np.float32)
    for row, own, part in zip(x, mask, parts, strict=True):
        row[: len(part)] = np.frombuffer(part, np.uint8)
        own[: len(part)] = 1
    return x, mask


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """A network from at most sample rows of docs (doc_id, text, lang, ...) that have a lang, a letter and are not held out.

    Without any such row the network knows no language and everything is UNKNOWN. Text and lang are all it learns from.
    """
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Network([])
    # about 1.5 times as many rows as wanted pass a threshold by hash, as many of each language; the first of them are taken
    even = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, n * len(counts) / (1.5 * sample + 64))])
    draw = lambda seed: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    place = (draw(1) * F.greatest(F.length("text") - EXCERPT, F.lit(0))).cast("int") + 1
    passed = rows.withColumn("u", draw(0) * F.element_at(even, F.col("lang"))).where((F.col("u") < 1) & F.rlike("text", F.lit(r"\p{L}")))
    got = passed.select("u", "doc_id", "lang", F.substring("text", place, F.lit(EXCERPT)).alias("text")).orderBy("u", "doc_id", "text").limit(sample).collect()
    langs = sorted({r.lang for r in got})
    net = Network(langs)
    if langs:
        net.train([r.text.encode("utf-8", "replace") for r in got], [langs.index(r.lang) for r in got])
    return net


def predict(docs: DataFrame, net: Network, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (text, carried columns, ...) -> (carried columns, lang_pred, score), a row per row, from whole texts.

    NULL texts and texts without a letter get UNKNOWN and score 0, as does everything if the network knows no language.
    """
    at = carry.index("text") if "text" in carry else len(carry)
    own = [] if "text" in carry else [F.col("text").cast("string").alias("_text")]
    made = docs.select(*carry, *own, F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)).alias("_letter"))

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, keep = batch.column(at), batch.column(batch.num_columns - 1).to_pylist()
        names, scores = [UNKNOWN] * len(keep), [0.0] * len(keep)
        group: list[tuple[int, bytes]] = []
        held = 0
        for i in range(len(keep) + 1):
            if i < len(keep) and keep[i] and net.langs:
                group.append((i, texts[i].as_py().encode("utf-8", "replace")))
                held += len(group[-1][1])
            if group and (held >= GROUP_BYTES or i == len(keep)):
                p = net.probabilities([t for _, t in group])
                for (j, _), row in zip(group, p, strict=True):
                    names[j], scores[j] = net.langs[row.argmax()], float(min(1.0, row.max()))
                group, held = [], 0
        return pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*carry, "lang_pred", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield judged(batch)
            del batch
            release()

    kinds = dict(made.dtypes)
    return made.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", lang_pred string, score double")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
