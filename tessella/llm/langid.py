"""Language identification by averaged hashed subword embeddings and a linear softmax (operator 3).

Subwords are byte n-grams of the lower-cased text with white space as one separator. A text's vector is the
mean of its subwords' embeddings; a softmax over a linear map of it gives the languages' probabilities.
Embeddings and map are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows: at most
`per_lang` rows, drawn by a hash, of each of the `most_langs` commonest languages (ties to the smaller name), with their
whole texts in segments. Training ends when the loss on a held-back part of the sample stops falling, after `epochs` at
most. A temperature fitted on that part calibrates the score, and the score below which texts are rejected.

A null text, or one without a letter, is `und` with score 0 and is rejected. Rows without lang are not learned from. A
null doc_id counts as an empty text in the fold. Repeated rows each come back; equal probabilities go to the smaller
language. With no labelled rows at all every text is `und`. A task holds a text whole, with about 60 bytes of memory for
each byte of the longest. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.llm.textblock import LOWER, SPACE, blocks

BUCKETS = 1 << 15
DIM = 16
GRAMS = (1, 2, 3, 4)
_MULTIPLIER = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: Table that brings bytes to the symbols of subwords: lower case, white space and ASCII digits and marks as one separator.
_SYMBOL = LOWER.astype(np.uint32)
_SYMBOL[SPACE] = 32
_SYMBOL[[b for b in range(0x80) if not chr(b).isalpha()]] = 32


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text modulo `folds`; a null counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each byte, for each n."""
    symbols = _SYMBOL[data]
    out, run = [], np.zeros(len(symbols), np.uint32)
    for n in GRAMS:
        m = len(symbols) - n + 1
        if m <= 0:
            break
        run = run[:m] * np.uint32(0x01000193) + symbols[n - 1 :]
        run = run.astype(np.uint32)
        out.append(((run * np.uint32(_MULTIPLIER[n - 1])) >> np.uint32(17)).astype(np.int32))
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: each subword's share of the logits
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of logits for each text of a block."""
        n = len(offsets) - 1
        total = np.zeros((n, len(self.langs)))
        count = np.zeros(n)
        for k, found in enumerate(subwords(data)):
            ends = np.maximum(np.minimum(offsets[1:] - k, len(found)), 0)
            begins = np.minimum(offsets[:-1], ends)
            for j in range(len(self.langs)):
                running = np.zeros(len(found) + 1)
                np.cumsum(self.table[:, j][found], out=running[1:])
                total[:, j] += running[ends] - running[begins]
            count += ends - begins
        return total / np.maximum(count, 1)[:, None] + self.bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its calibrated probability."""
        if not len(self.langs):
            n = len(offsets) - 1
            return np.zeros(n, np.int64), np.zeros(n)
        p = _softmax(self.logits(data, offsets) / self.temperature)
        return p.argmax(1), p.max(1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sample(docs: DataFrame, per_lang: int, folds: int, held: int, most_langs: int) -> DataFrame:
    """_h, lang and text of at most `per_lang` labelled rows of each of the commonest languages, outside the held-out fold."""
    own = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    own = own.where((fold(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull())
    common = own.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "lang").limit(most_langs).select("lang")
    own = own.join(F.broadcast(common), "lang", "left_semi").withColumn("_h", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(5)))
    # Both tables broadcast here have a row a language, `most_langs` at most. Ranks need only hashes; the optimiser cuts each task's rows to per_lang before the shuffle.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    cut = own.select("lang", "_h").withColumn("_r", rank).where(F.col("_r") <= per_lang).groupBy("lang").agg(F.max("_h").alias("_top"))
    found = own.join(F.broadcast(cut.withColumnRenamed("lang", "_l")), (F.col("lang") == F.col("_l")) & (F.col("_h") <= F.col("_top")))
    # Copies of the last row drawn are cut, too.
    return found.withColumn("_r", rank).where(F.col("_r") <= per_lang).select("_h", "lang", "text")


def _segments(text: str, rng: np.random.Generator, shortest: int, longest: int) -> Iterator[np.ndarray]:
    """Subwords of the consecutive parts of a whole text, of random lengths."""
    data = np.frombuffer(text.encode(), np.uint8)
    sizes = np.exp(rng.uniform(np.log(shortest), np.log(longest), 1 + len(data) // shortest)).astype(np.int64)
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        if a >= len(data):
            return
        piece = subwords(data[a:b])
        if piece:
            yield np.concatenate(piece)


def train(texts: list[str], labels: list[str], epochs: int = 12, rate: float = 1.0, shortest: int = 12, longest: int = 1000, batch: int = 64, seed: int = 11) -> Model:
    """Fit on segments of several lengths, so that short texts are known too."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    rows = [(piece, langs.index(lang), k % 5 == 0) for k, (text, lang) in enumerate(zip(texts, labels, strict=True)) for piece in _segments(text, rng, shortest, longest)]
    if not rows:
        return Model(langs, np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs)), 1.0, 0.0)
    learn, check = [r for r in rows if not r[2]] or rows, [r for r in rows if r[2]] or rows
    share = np.bincount([r[1] for r in learn], minlength=len(langs)).astype(float)
    weight = share.sum() / (len(langs) * np.maximum(share, 1))
    embed = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    check_y, check_lens = np.array([r[1] for r in check]), np.array([len(r[0]) for r in check])
    check_ids, check_starts = np.concatenate([r[0] for r in check]), np.concatenate([[0], np.cumsum(check_lens)[:-1]])

    def held_back() -> tuple[np.ndarray, float]:
        table = embed @ out
        logits = np.column_stack([np.add.reduceat(table[:, j][check_ids], check_starts) for j in range(len(langs))]) / check_lens[:, None] + bias
        return logits, float(-np.log(np.maximum(_softmax(logits)[np.arange(len(check_y)), check_y], 1e-12)).mean())

    best = np.inf
    for epoch in range(epochs):
        order = rng.permutation(len(learn))
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            drawn = [learn[i] for i in order[at : at + batch]]
            lens = np.array([len(b[0]) for b in drawn])
            ids = np.concatenate([b[0] for b in drawn])
            y = np.array([b[1] for b in drawn])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            mean = np.add.reduceat(embed[ids], starts, axis=0) / lens[:, None]
            p = _softmax(mean @ out + bias)
            p[np.arange(len(y)), y] -= 1
            p *= weight[y][:, None]
            back = -step * (p @ out.T) / lens[:, None]
            out -= step / 32 * (mean.T @ p)
            bias -= step / 32 * p.sum(0)
            owner = np.repeat(np.arange(len(y)), lens)
            for d in range(DIM):
                embed[:, d] += np.bincount(ids, back[owner, d], BUCKETS)
        loss = held_back()[1]
        # The first epochs of a small sample hardly move the loss; that is no standstill.
        if loss > 0.98 * best and best < 0.5 * np.log(len(langs)):
            break
        best = min(best, loss)
    table = (embed @ out).astype(np.float32)
    model = Model(langs, table, bias.astype(float), 1.0, 0.0)
    logits, y = held_back()[0], check_y
    tries = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in tries]
    model.temperature = float(tries[int(np.argmin(loss))])
    right = _softmax(logits / model.temperature)[np.arange(len(y)), y]
    model.reject_below = float(np.quantile(right, 0.01))
    return model


def fit(docs: DataFrame, per_lang: int = 400, folds: int = 4, held: int = 2, most_langs: int = 512) -> Model:
    """Model from at most `per_lang` rows of each of at most `most_langs` languages; rows of the held-out fold are never read for it."""
    rows = sample(docs, per_lang, folds, held, most_langs).collect()
    rows.sort(key=lambda r: (r["_h"], r["lang"], r["text"] or ""))
    return train([r["text"] or "" for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected, one row per input row, from whole texts."""
    text = F.col("text").cast("string")
    kept = docs.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("_letters"), text.alias("_text"))
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for block in blocks(batch.column(3)):
                b, s = m.score(block.data, block.offsets)
                best.append(b)
                score.append(s)
            b, s = np.concatenate(best), np.concatenate(score)
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            known = letters & (len(m.langs) > 0)
            b = np.where(known, b, len(m.langs))
            s = np.where(known, s, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names[b], pa.string()), pa.array(s, pa.float64()), pa.array(~known | (s < m.reject_below))], names=["doc_id", "held_out", "lang_pred", "score", "rejected"]
            )

    return kept.mapInArrow(run, schema)
