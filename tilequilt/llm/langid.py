"""Language identification by a bidirectional gated recurrent network over bytes, trained here with numpy.

Texts are cut into windows of WINDOW bytes; within each, one gated recurrent layer reads forwards and one backwards,
and a softmax over both labels every byte position. A document's probabilities are the mean over all its positions.
Training is by backpropagation through time on a bounded sample of labelled rows (DOCS_PER_LANG, WINDOWS_PER_DOC).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, columns, in_arrow, text_bytes

HIDDEN = 8
WINDOW = 64
DOCS_PER_LANG = 400
WINDOWS_PER_DOC = 8
EPOCHS = 4
BATCH = 256
#: Bytes of text in one vectorised step.
STEP_BYTES = 1 << 17
UNKNOWN = "und"
#: A filter rejects documents below this pooled probability (besides those without a letter).
LEAST_SCORE = 0.3
_LETTER = regex.compile(r"\p{L}")


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes [window, position], valid bytes of each window, windows of each text); an empty text has one window."""
    count = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    data = b"".join(t + b"\0" * (c * WINDOW - len(t)) for t, c in zip(texts, count.tolist(), strict=True))
    valid = np.full(count.sum(), WINDOW)
    valid[np.cumsum(count) - 1] = [len(t) - (c - 1) * WINDOW for t, c in zip(texts, count.tolist(), strict=True)]
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), valid, count


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Network:
    """Weights, training step and inference. Gates are stacked as reset, update, candidate.

    The squashing function is x / (1 + |x|), for gates moved to (0, 1): numpy computes it ten times as fast as tanh.
    """

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        self.w = {}
        for d in "fb":
            self.w[f"e{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            self.w[f"u{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
            self.w[f"c{d}"] = np.zeros(hidden)
        self.w["o"] = rng.normal(0, hidden**-0.5, (2 * hidden, len(langs)))
        self.w["p"] = np.zeros(len(langs))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        self.steps = 0

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Forward over x [time, batch] -> states [time, batch, h] and what the way back needs."""
        e, u, c, k = self.w[f"e{d}"], self.w[f"u{d}"], self.w[f"c{d}"], self.h
        h = np.zeros((x.shape[1], k), np.float32)
        states, kept = [], []
        for row in x:
            a, g = e[row], h @ u
            r, z = (0.5 + 0.5 * _soft(a[:, i * k : (i + 1) * k] + g[:, i * k : (i + 1) * k]) for i in (0, 1))
            gn = g[:, 2 * k :] + c
            n = _soft(a[:, 2 * k :] + r * gn)
            kept.append((h, r, z, n, gn))
            h = n + z * (h - n)
            states.append(h)
        return np.stack(states), kept

    def _back(self, x: np.ndarray, d: str, kept: list, ds: np.ndarray, grads: dict) -> None:
        """Backpropagation through time of the gradients ds of the states."""
        u = self.w[f"u{d}"]
        du, dc, das = np.zeros_like(u), np.zeros(self.h, np.float32), []
        dh = np.zeros_like(ds[0])
        for t in range(len(x) - 1, -1, -1):
            h, r, z, n, gn = kept[t]
            dh = dh + ds[t]
            dz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            dr = dn * gn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            dg = np.concatenate([dr, dz, dn * r], axis=1)
            das.append(np.concatenate([dr, dz, dn], axis=1))
            du += h.T @ dg
            dc += (dn * r).sum(axis=0)
            dh = dh * z + dg @ u.T
        grads[f"u{d}"], grads[f"c{d}"] = du, dc
        rows, da = x[::-1].ravel(), np.concatenate(das)
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        grads[f"e{d}"] = np.zeros_like(self.w[f"e{d}"])
        grads[f"e{d}"][rows[order][first]] = np.add.reduceat(da[order], first, axis=0)

    def train_step(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, rate: float) -> float:
        """One step on windows x [batch, time] of labels y; returns the mean loss a position."""
        x = x.T
        sf, kf = self._run(x, "f")
        sb, kb = self._run(x[::-1], "b")
        s = np.concatenate([sf, sb[::-1]], axis=2)
        logit = s @ self.w["o"] + self.w["p"]
        logit -= logit.max(axis=2, keepdims=True)
        prob = np.exp(logit)
        prob /= prob.sum(axis=2, keepdims=True)
        on = (np.arange(len(x))[:, None] < valid[None, :]).astype(np.float32)
        on /= max(1.0, on.sum())
        loss = float(-(np.log(prob[:, np.arange(len(y)), y] + 1e-9) * on).sum())
        prob[:, np.arange(len(y)), y] -= 1
        dl = prob * on[:, :, None]
        grads = {"o": s.reshape(-1, 2 * self.h).T @ dl.reshape(-1, dl.shape[2]), "p": dl.sum(axis=(0, 1))}
        ds = dl @ self.w["o"].T
        self._back(x, "f", kf, ds[:, :, : self.h], grads)
        self._back(x[::-1], "b", kb, ds[::-1, :, self.h :], grads)
        self.steps += 1
        for k, g in grads.items():  # Adam
            m, v = self.moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.w[k] -= (rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)).astype(np.float32)
        return loss

    def frozen(self) -> dict:
        """Weights laid out for inference: transposed, the candidate's bias as a column of the recurrent weights."""
        out = {"langs": self.langs, "h": self.h, "p": self.w["p"][:, None]}
        for i, d in enumerate("fb"):
            u = np.concatenate([self.w[f"u{d}"].T, np.concatenate([np.zeros(2 * self.h, np.float32), self.w[f"c{d}"]])[:, None]], axis=1)
            out[f"e{d}"], out[f"u{d}"] = np.ascontiguousarray(self.w[f"e{d}"].T), np.ascontiguousarray(u)
            out[f"o{d}"] = np.ascontiguousarray(self.w["o"][i * self.h : (i + 1) * self.h].T)
        return out


def _states(net: dict, x: np.ndarray, d: str) -> np.ndarray:
    """States [time, h + 1, batch] of one direction over x [time, batch]; the last row is 1 (for the bias)."""
    k, (t, b) = net["h"], x.shape
    e, u = net[f"e{d}"], net[f"u{d}"]
    states = np.ones((t + 1, k + 1, b), np.float32)
    states[0, :k] = 0
    a, g, rz, s = (np.empty((n * k, b), np.float32) for n in (3, 3, 2, 2))
    n, m = np.empty((k, b), np.float32), np.empty((k, b), np.float32)
    for i in range(t):
        h = states[i]
        np.take(e, x[i], axis=1, out=a, mode="clip")
        np.matmul(u, h, out=g)
        np.add(a[: 2 * k], g[: 2 * k], out=rz)
        np.abs(rz, out=s)
        s += 1
        rz /= s
        rz *= 0.5
        rz += 0.5
        np.multiply(rz[:k], g[2 * k :], out=n)
        n += a[2 * k :]
        np.abs(n, out=m)
        m += 1
        n /= m
        np.subtract(h[:k], n, out=m)
        m *= rz[k:]
        np.add(n, m, out=states[i + 1, :k])
    return states[1:]


def positions(net: dict, windows: np.ndarray) -> np.ndarray:
    """Probabilities [position, language, window] of the windows [window, position]."""
    x = np.ascontiguousarray(windows.T)
    k = net["h"]
    prob = np.matmul(net["of"], _states(net, x, "f")[:, :k]) + np.matmul(net["ob"], _states(net, x[::-1], "b")[::-1, :k])
    prob += net["p"]
    prob -= prob.max(axis=1, keepdims=True)
    np.exp(prob, out=prob)
    prob /= prob.sum(axis=1, keepdims=True)
    return prob


def pooled(net: dict, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(mean probability [text, language], positions labelled with each language [text, language])."""
    windows, valid, count = _windows(texts)
    prob = positions(net, windows)
    on = np.arange(WINDOW)[:, None] < valid[None, :]
    label = prob.argmax(axis=1)
    first = np.cumsum(count) - count
    total = np.add.reduceat((prob * on[:, None, :]).sum(axis=0, dtype=np.float64), first, axis=1)
    labelled = np.stack([np.add.reduceat(((label == i) & on).sum(axis=0), first) for i in range(len(net["langs"]))], axis=1)
    return (total / np.maximum(1, [len(t) for t in texts])).T, labelled


def _predictor(net: dict):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            score, best, agree = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for begin, some in chunks(texts, STEP_BYTES):
                # A long text goes in pieces of whole windows; sums over the pieces give the same mean.
                mean, labelled = np.zeros((len(some), len(net["langs"]))), np.zeros((len(some), len(net["langs"])), np.int64)
                if len(some) == 1:
                    for at in range(0, max(1, len(some[0])), STEP_BYTES):
                        piece = some[0][at : at + STEP_BYTES]
                        m, c = pooled(net, [piece])
                        mean += m * (len(piece) / max(1, len(some[0])))
                        labelled += c
                else:
                    mean, labelled = pooled(net, some)
                span = slice(begin, begin + len(some))
                best[span] = mean.argmax(axis=1)
                score[span] = np.minimum(1.0, mean.max(axis=1)).round(6)  # equal texts score alike wherever in a batch they stand
                agree[span] = labelled[np.arange(len(some)), best[span]]
            letters = [bool(_LETTER.search(t)) if t else False for t in batch.column("text").to_pylist()]
            lang = [net["langs"][i] if on else UNKNOWN for i, on in zip(best.tolist(), letters, strict=True)]
            on = np.array(letters, bool)
            length = np.array([len(t) for t in texts], np.int64)
            yield pa.record_batch([*(c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"), pa.array(lang, pa.string()), pa.array(np.where(on, score, 0.0)), pa.array(length), pa.array(np.where(on, agree, 0))], names=[*(n for n in batch.schema.names if n != "text"), "lang_pred", "score", "n_positions", "n_agree"])

    return predict


def fold(doc_id):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, per_lang: int = DOCS_PER_LANG, seed: int = 11) -> list:
    """At most per_lang labelled rows of each language outside fold 0, hash-random by id: (lang, text), in a fixed order.

    Driver memory is bounded by per_lang, the number of languages and WINDOWS_PER_DOC, as only windows are fetched.
    """
    rows = columns(docs, "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").where(fold(F.col("doc_id")) != 0)
    key = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = columns(docs, "doc_id", "lang").where(fold(F.col("doc_id")) != 0).where("lang IS NOT NULL").groupBy("lang").agg((F.lit(4.0 * per_lang) / F.count("*")).alias("__share"))
    near = rows.withColumn("__key", key).join(F.broadcast(counts), "lang").where(F.col("__key") < F.col("__share"))
    # Windows at even distances over the whole text, so that what is fetched does not grow with a text's length.
    raw = F.col("text").cast("binary")
    size = F.octet_length("text")
    starts = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_DOC - 1)), lambda i: (i * F.greatest(F.lit(0), size - WINDOW) / (WINDOWS_PER_DOC - 1)).cast("int"))
    near = near.select("lang", "__key", "doc_id", F.array_distinct(F.transform(starts, lambda a: F.substring(raw, a + 1, F.lit(WINDOW)))).alias("windows"))
    order = Window.partitionBy("lang").orderBy("__key", "doc_id", "windows")
    return near.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_lang).orderBy("lang", "__n").collect()


def train(docs: DataFrame, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """The network learnt from docs (doc_id, text, lang); without any labelled row it knows no language."""
    rows = training_rows(docs)
    langs = sorted({r["lang"] for r in rows})
    net = Network(langs or [UNKNOWN], hidden, seed)
    if not rows:
        return net
    known = {x: i for i, x in enumerate(langs)}
    pieces = [(bytes(w), known[r["lang"]]) for r in rows for w in r["windows"]]
    x, valid, _ = _windows([p for p, _ in pieces])
    y = np.array([i for _, i in pieces])
    rng = np.random.default_rng(seed)
    steps, done = epochs * -(-len(x) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            net.train_step(x[some], y[some], valid[some], 0.02 * (1 - done / steps) + 0.0005)
            done += 1
    return net


def predict_languages(docs: DataFrame, net: Network, *keep: str) -> DataFrame:
    """(doc_id, *keep, lang_pred, score, n_positions, n_agree) of every row of docs (doc_id, text).

    lang_pred is a learnt language, or und where the text is null or has no letter (then score and n_agree are 0).
    score is the pooled probability; n_agree counts the byte positions labelled alike. Whole texts are read, in
    windows. Null ids pass; repeated rows each come back; an empty table gives an empty one; extra columns are ignored.
    """
    rows = columns(docs, "doc_id", "text", *keep)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns if c != "text") + ", lang_pred string, score double, n_positions long, n_agree long"
    return in_arrow(rows, _predictor(net.frozen()), schema)


def drop_unknown(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """docs without those that language identification rejects: no letter, or a pooled probability below least.

    The network is learnt from docs itself. Columns are those of docs; no shuffle: the text rides along.
    """
    net = train(docs)
    frozen = net.frozen()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = next(_predictor(frozen)(iter([pa.record_batch([batch.column("row").field("text")], names=["text"])])))
            on = pa.array([p != UNKNOWN and s >= least for p, s in zip(found.column("lang_pred").to_pylist(), found.column("score").to_pylist(), strict=True)], pa.bool_())
            yield batch.filter(on)

    fields = ", ".join(f"`{c}`: {k}" for c, k in docs.dtypes)
    return in_arrow(rows, keep, f"row struct<{fields}>").select("row.*")
