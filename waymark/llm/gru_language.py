"""Language identification by a bidirectional gated recurrent network over bytes.

The lower-cased UTF-8 bytes of a whole text are cut into windows; a forward and a backward GRU
read each window, a softmax labels every byte position, and the mean of these probabilities over
all positions of the document is its language distribution. The network is trained in numpy by
backpropagation through time on windows of a bounded sample of labelled documents. Gates are
piecewise linear (hard sigmoid) and candidates use softsign, so that a step is a few array
operations.

A text that is null or has no letters is `und` with score 0. Equal texts get equal answers. With
no labelled document at all everything is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import ship

LETTER = regex.compile(r"\p{L}")
#: Bytes in a window, hidden units a direction, windows computed at once.
SPAN, UNITS, BLOCK = 64, 8, 2048
#: Windows that a document gives to learn from, unless fit() is told otherwise, from places all over its text.
WINDOWS = 64


@dataclass
class Network:
    langs: list[str]
    #: For each direction: (3 units, 256) byte inputs with bias, (3 units, units) recurrent; then the output layer.
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def _forward(w: np.ndarray, u: np.ndarray, steps: np.ndarray, keep: bool = False):
    """States (T, units, B) of one direction over byte rows (T, B); with keep, what the backward pass needs."""
    h = np.zeros((UNITS, steps.shape[1]), np.float32)
    states, kept = np.empty((len(steps), *h.shape), np.float32), []
    for t, row in enumerate(steps):
        x, g = w.take(row, axis=1), u @ h
        gates = x[: 2 * UNITS]
        gates += g[: 2 * UNITS]
        np.clip(gates, 0, 1, out=gates)
        r, z = gates[:UNITS], gates[UNITS:]
        a = x[2 * UNITS :]
        inner = g[2 * UNITS :]
        a += r * inner
        n = a / (1 + np.abs(a))
        if keep:
            kept.append((h, gates, inner, a, n))
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _backward(u: np.ndarray, steps: np.ndarray, kept: list, d_states: np.ndarray, d_w: np.ndarray, d_u: np.ndarray) -> None:
    """Backpropagation through time: adds to the gradients of inputs and recurrent weights."""
    dh = np.zeros_like(d_states[0])
    for t in range(len(steps) - 1, -1, -1):
        h, gates, inner, a, n = kept[t]
        r, z = gates[:UNITS], gates[UNITS:]
        dh = dh + d_states[t]
        da = dh * (1 - z) / (1 + np.abs(a)) ** 2
        live = (gates > 0) & (gates < 1)
        d_gates = np.concatenate([da * inner, dh * (h - n)]) * live
        d_g = np.concatenate([d_gates, da * r])
        d_x = np.concatenate([d_gates, da])
        d_u += d_g @ h.T
        for k in range(len(d_x)):
            d_w[k] += np.bincount(steps[t], weights=d_x[k], minlength=256)
        dh = dh * z + u.T @ d_g


def _softmax(logits: np.ndarray) -> np.ndarray:
    np.subtract(logits, logits.max(0), out=logits)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits


def train(windows: list[list[str]], langs: list[str], steps: int = 220, batch: int = 192, rate: float = 0.03, seed: int = 11) -> Network:
    """Adam on the mean cross-entropy of all positions of random windows, of documents drawn evenly by language."""
    pick = np.random.default_rng(seed)
    names = sorted(set(langs))
    raws = [[np.frombuffer(t.lower().encode(), np.uint8) for t in ts] for ts in windows]
    target = np.array([names.index(x) for x in langs])
    by_lang = [np.flatnonzero(target == k) for k in range(len(names))]
    gate_bias = np.r_[np.full(2 * UNITS, 0.5), np.zeros(UNITS)][:, None]
    shapes = [(3 * UNITS, 256)] * 2 + [(3 * UNITS, UNITS)] * 2 + [(len(names), 2 * UNITS), (len(names), 1)]
    p = [(pick.normal(size=s) * 0.3).astype(np.float32) for s in shapes]
    for k in (0, 1):
        p[k] += gate_bias
    p[5][:] = 0
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1):
        y = pick.integers(len(names), size=batch)
        rows = np.zeros((batch, SPAN), np.uint8)
        for k, lang in enumerate(y):
            own = raws[pick.choice(by_lang[lang])]
            raw = own[pick.integers(len(own))]
            at = pick.integers(max(1, raw.size - SPAN + 1))
            rows[k, : min(SPAN, raw.size)] = raw[at : at + SPAN]
        cols = np.ascontiguousarray(rows.T)
        ways = [cols, cols[::-1]]
        runs = [_forward(p[k], p[2 + k], ways[k], keep=True) for k in (0, 1)]
        both = np.concatenate([runs[0][0], runs[1][0][::-1]], axis=1)  # (T, 2 units, B)
        flat = both.transpose(1, 0, 2).reshape(2 * UNITS, -1)
        probs = _softmax(p[4] @ flat + p[5])
        there = (cols.ravel() != 0) / max(1, np.count_nonzero(cols))
        d = probs
        d[np.tile(y, SPAN), np.arange(d.shape[1])] -= 1
        d *= there.astype(np.float32)
        grads = [np.zeros_like(x) for x in p]
        grads[4], grads[5] = d @ flat.T, d.sum(1, keepdims=True)
        d_both = (p[4].T @ d).reshape(2 * UNITS, SPAN, batch).transpose(1, 0, 2)
        for k, part in ((0, d_both[:, :UNITS]), (1, d_both[::-1, UNITS:])):
            _backward(p[2 + k], ways[k], runs[k][1], part, grads[k], grads[2 + k])
        lr = rate * min(1, 3 * (1 - (step - 1) / steps))
        for k, g in enumerate(grads):
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            p[k] -= (lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(names, p[:2], p[2:4], p[4], p[5])


def position_probabilities(net: Network, rows: np.ndarray) -> np.ndarray:
    """(languages, windows, SPAN) for byte windows (windows, SPAN)."""
    cols = np.ascontiguousarray(rows.T)
    fore, _ = _forward(net.inputs[0], net.recurrent[0], cols)
    back, _ = _forward(net.inputs[1], net.recurrent[1], cols[::-1])
    logits = np.tensordot(net.out[:, :UNITS], fore, (1, 1)) + np.tensordot(net.out[:, UNITS:], back[::-1], (1, 1))
    logits += net.bias[:, :, None]
    return _softmax(logits).transpose(0, 2, 1)


def predict(net: Network, texts: list[str | None]) -> np.ndarray:
    """Pooled probabilities (texts, languages); zeros where there are no letters."""
    out = np.zeros((len(texts), len(net.langs)))
    known = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
    raws = [texts[k].lower().encode() for k in known]
    per = np.array([-(-len(r) // SPAN) for r in raws], np.int64)
    rows = np.frombuffer(b"".join(r.ljust(SPAN * n, b"\0") for r, n in zip(raws, per.tolist(), strict=True)), np.uint8).reshape(-1, SPAN)
    owner = np.repeat(np.arange(len(known)), per)
    inside = SPAN - np.zeros(len(rows), np.int64)
    if len(rows):
        inside[np.cumsum(per) - 1] = [len(r) - SPAN * (n - 1) for r, n in zip(raws, per.tolist(), strict=True)]
    sums = np.zeros((len(net.langs), len(rows)))
    for at in range(0, len(rows), BLOCK):
        probs = position_probabilities(net, rows[at : at + BLOCK])
        if (inside[at : at + BLOCK] < SPAN).any():
            probs = probs * (np.arange(SPAN) < inside[at : at + BLOCK, None])
        sums[:, at : at + BLOCK] = probs.sum(2)
    for lang in range(len(net.langs)):
        out[known, lang] = np.bincount(owner, weights=sums[lang], minlength=len(known)) / np.array([len(r) for r in raws])
    return out


def learners(documents: DataFrame, may_learn: Column, most_documents: int, windows: int) -> DataFrame:
    """lang and windows of at most `most_documents` documents: of each language as many, the first by a hash.

    Rows that agree in id, text and language count once; those of one id with several texts each.
    """
    named = documents.filter(may_learn & F.col("lang").isNotNull()).select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    usable = named.filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "h").distinct()
    langs = usable.agg(F.count_distinct("lang")).first()[0]
    if langs > most_documents:
        raise ValueError(f"{langs} languages, more than {most_documents} documents to learn from")
    key = ["doc_id", "lang", "h"]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h"))
    first = usable.withColumn("k", rank).filter(F.col("k") <= most_documents // max(1, langs)).select(*(F.col(c).alias(f"{c}_0") for c in key))
    # places that the id decides, all over the whole text
    n = F.least(F.lit(windows), F.ceil(F.length("text") / SPAN)).cast("int")
    place = lambda k: (F.pmod(F.xxhash64(F.col("doc_id"), k), F.greatest(F.length("text") - SPAN, F.lit(0)) + 1) + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(1), n), lambda k: F.substring("text", place(k), F.lit(SPAN)))
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_0")) & (F.col("lang") == F.col("lang_0")) & (F.col("h") == F.col("h_0"))
    picked = named.join(F.broadcast(first), same, "left_semi")  # of bounded size
    return picked.select(*key, cut.alias("windows")).dropDuplicates(key).select("lang", "windows")


def fit(documents: DataFrame, may_learn: Column, most_documents: int = 2_000, windows: int = WINDOWS) -> Network | None:
    """Trains on at most `most_documents` documents with a language and a letter, and up to `windows` windows of each."""
    found = learners(documents, may_learn, most_documents, windows).toArrow()
    learned = sorted((lang, [w for w in ws if LETTER.search(w)]) for lang, ws in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
    learned = [(lang, ws) for lang, ws in learned if ws]
    return train([ws for _, ws in learned], [lang for lang, _ in learned]) if learned else None


def identify(documents: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """`keep`, lang_pred and score of every document."""
    if net is None:
        return documents.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        names = np.array([*net.langs, "und"], object)
        for batch in batches:
            for some in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                probs = predict(net, some.column(len(keep)).to_pylist())
                best = np.where(probs.sum(1) > 0, probs.argmax(1), len(net.langs))
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], pa.array(names[best], pa.string()), pa.array(np.clip(probs.max(1), 0, 1))], names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    ship(documents.sparkSession)
    return documents.select(*keep, "text").mapInArrow(run, f"{fields}, lang_pred string, score double")
