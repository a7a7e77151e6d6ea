"""Toxicity by compression distance.

Two Zstandard dictionaries are built from labelled text: one from ordinary documents, one from toxic ones.
Both are trained by zstandard; the difference of the two lengths of a window of text is what the toxic one saves.
As such training gathers what is frequent, toxic or not, a third has in front of the ordinary content, so that
ordinary text compresses alike, what tells toxic documents from ordinary ones, if the labels suffice to tell:
stretches of toxic text made of strings that are far more frequent there (phrases, whatever their words), and
word beginnings of that kind. A document's windows give the features (mean, largest and total saving, windows above thresholds); a logistic function of them, fitted
on labelled documents that had no part in the dictionaries, calibrates them to a probability.

Contract: null and empty texts have no window and score as a document without any saving. Texts are scored
whole, in windows of WINDOW words; a word of more than WORD_BYTES is cut into several. A row's score depends
on its text alone, so repeated rows get equal scores; an empty table gives no rows. A doc_id that is labelled
both ways isn't learned from. Without labelled documents of both kinds every score is the share of toxic
labels (0 without labels).
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import slim
from lodestone.llm.sentencepiece_bpe import text_slices

#: Words of a window, and bytes of the longest piece of a word.
WINDOW, WORD_BYTES = 8, 64
#: The bounded sample that is learned from: documents with label 1, with label 0, and characters of each.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 2000, 5000, 20_000
ORDINARY_BYTES, LEVEL = 16 << 10, 9
#: How unlikely chance must be for a string to be toxic: exp(-SURPRISE).
SURPRISE = 10.0
#: Lengths of the strings that phrases are found by, and bytes of the dictionary's part of phrases.
PHRASES, PHRASE_BYTES = (12, 18), 16 << 10
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    out = (text or "").encode().translate(_LOWER).split()
    if any(len(w) > WORD_BYTES for w in out):
        out = [w[i : i + WORD_BYTES] for w in out for i in range(0, len(w), WORD_BYTES)]
    return out


def windows(text: str | None) -> list[bytes]:
    w = words(text)
    return [b" " + b" ".join(w[i : i + WINDOW]) for i in range(0, len(w), WINDOW)]


def _grams(text: str) -> set[bytes]:
    """Beginnings of four to eleven bytes of the words of a text."""
    return {b" " + w[:n] for w in set(words(text)) for n in range(4, min(len(w), 11) + 1)}


def _flat(text: str) -> bytes:
    return b" " + b" ".join(words(text)) + b" "


def _strings(text: bytes, n: int) -> set[bytes]:
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def _places(text: bytes, n: int) -> np.ndarray:
    """A number below 2**22 for each string of n bytes of text."""
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(a) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n if len(h) else 0):
            h = h * np.uint64(0x9E3779B97F4A7C15) + a[k : k + len(h)]
        return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(42)


def _telling(toxic: list[bytes], ordinary: list[bytes], n: int) -> dict[bytes, float]:
    """Strings of n bytes with their surprise, where chance is too unlikely to have put them into so many toxic
    texts. Strings are counted by hashes first, so that only those that can suffice are held."""
    prior = len(toxic) / (len(toxic) + len(ordinary))
    met = np.zeros(1 << 22, np.int32)
    for t in toxic:
        met[np.unique(_places(t, n))] += 1
    least = next((c for c in range(1, len(toxic) + 1) if _surprise(c, 0, prior) >= SURPRISE), len(toxic) + 1)
    a: Counter[bytes] = Counter()
    for t in toxic:
        a.update({t[i : i + n] for i in np.flatnonzero(met[_places(t, n)] >= least).tolist()})
    b: Counter[bytes] = Counter()
    for t in ordinary:
        b.update(a.keys() & {t[i : i + n] for i in np.flatnonzero(met[_places(t, n)] >= least).tolist()})
    return {g: x for g, c in a.items() if (x := _surprise(c, b[g], prior)) >= SURPRISE}


def _stretches(toxic: list[str], ordinary: list[str]) -> bytes:
    """Stretches of toxic texts that telling strings cover, the best ones last: each is there for strings that
    those after it don't hold."""
    toxic, ordinary = [_flat(t) for t in toxic], [_flat(t) for t in ordinary]
    good: dict[bytes, float] = {}
    for n in PHRASES:
        good |= _telling(toxic, ordinary, n)
    found: dict[bytes, set[bytes]] = {}
    for t in toxic if good else ():
        held = np.zeros(len(t) + 1, np.int64)
        for n in PHRASES:
            for i in range(len(t) - n + 1):
                if t[i : i + n] in good:
                    held[i] += 1
                    held[i + n] -= 1
        edges = np.flatnonzero(np.diff(np.cumsum(held) > 0, prepend=False))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            found.setdefault(t[i:j], set().union(*(_strings(t[i:j], n) & good.keys() for n in PHRASES)))
    value = lambda x, own: sum(good[g] for g in own) / (len(x) + 8)
    heap = [(-value(x, own), x) for x, own in found.items()]
    heapq.heapify(heap)
    taken, out, size = set(), [], 0
    while heap and size < PHRASE_BYTES:
        _, x = heapq.heappop(heap)
        own = found[x] - taken
        now = -value(x, own)
        if own and heap and now > heap[0][0]:
            heapq.heappush(heap, (now, x))
            found[x] = own
        elif own:
            out.append(x)
            taken |= own
            size += len(x)
    return b"".join(out[::-1])


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW * 8, dict_size=len(content), write_content_size=False, write_dict_id=False, write_checksum=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=d)


@dataclass
class Model:
    """The dictionaries, and the logistic function of the features."""

    ordinary: bytes = b""
    toxic: bytes = b""
    lexicon: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(11))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(10))
    scale: np.ndarray = field(default_factory=lambda: np.ones(10))

    def open(self) -> Model:
        if self.toxic:
            self._plain, self._toxic = _compressor(self.ordinary), _compressor(self.toxic)
            self._lexicon = _compressor(self.lexicon + self.ordinary) if self.lexicon else self._plain
        return self

    def features(self, text: str | None) -> np.ndarray:
        cut = windows(text) if self.toxic else []
        if not cut:
            return np.zeros(10)
        plain = np.array([len(self._plain.compress(w)) for w in cut])
        saved = plain - [len(self._lexicon.compress(w)) for w in cut] if self.lexicon else np.zeros(len(cut))
        trained = plain - [len(self._toxic.compress(w)) for w in cut]
        n = len(saved)
        own = [saved.mean(), saved.max(), np.log1p(max(0, saved.sum())), *(np.log1p((saved >= t).sum()) for t in (2, 4)), (saved >= 3).sum() / n, (saved >= 5).sum() / n]
        return np.array([*own, trained.mean(), trained.max(), (trained >= 5).sum() / n])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = (np.stack([self.features(t) for t in texts]) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _distinct(texts: list[str]) -> list[str]:
    """texts without those that share much with an earlier one: copies would count as evidence."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        w = words(t)
        trios = {b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        if w and len(trios & seen) <= 0.3 * len(trios):
            out.append(t)
        seen |= trios
    return out


def _surprise(a: int, b: int, prior: float) -> float:
    """Bound of minus the log of the probability that chance puts a of a + b documents on the toxic side."""
    q = a / (a + b)
    if q <= prior:
        return 0.0
    return (a + b) * (q * math.log(q / prior) + ((1 - q) * math.log((1 - q) / (1 - prior)) if b else 0.0))


def _dictionary(texts: list[str]) -> bytes:
    """Content of a trained dictionary; few texts, of which none can be trained, stand for themselves."""
    try:
        return zstandard.train_dictionary(2 * ORDINARY_BYTES, [t.encode().translate(_LOWER) for t in texts], k=50, d=6, steps=1, threads=0).as_bytes()[-ORDINARY_BYTES:]
    except zstandard.ZstdError:
        return b" ".join(w for t in texts for w in words(t))[-ORDINARY_BYTES:]


def fit(toxic: list[str], ordinary: list[str], toxic_share: float) -> Model:
    """A model of labelled texts; toxic_share is the share of label 1 among all labels, which the sample need not have."""
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    model = Model()
    model.weights[0] = np.log(max(toxic_share, 1e-9) / max(1 - toxic_share, 1e-9))
    if len(toxic) < 2 or len(ordinary) < 2:  # one to learn from and one to calibrate by
        return model
    fit_t, cal_t, fit_o, cal_o = toxic[::2], toxic[1::2], ordinary[::2], ordinary[1::2]
    in_t, in_o = Counter(), Counter()
    for texts, count in ((fit_t, in_t), (fit_o, in_o)):
        for t in texts:
            count.update(_grams(t))
    prior = len(fit_t) / (len(fit_t) + len(fit_o))
    good = sorted((g for g, n in in_t.items() if _surprise(n, in_o[g], prior) >= SURPRISE), key=lambda g: (_surprise(in_t[g], in_o[g], prior), g))
    # A string whose longer form is about as frequent is left out: the longer one holds it.
    held = {h[:n] for h in good for n in range(5, len(h)) if in_t[h] >= 0.6 * in_t[h[:n]]}
    lexicon = _stretches(fit_t, fit_o) + b"".join(g for g in good if g not in held)
    model.ordinary, model.toxic, model.lexicon = _dictionary(fit_o), _dictionary(fit_t), lexicon
    model.open()
    x = np.stack([model.features(t) for t in cal_t + cal_o])
    y = np.repeat([1.0, 0.0], [len(cal_t), len(cal_o)])
    weight = np.where(y > 0, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    model.centre, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - model.centre) / model.scale])
    w = np.zeros(z.shape[1])
    for _ in range(50):  # Newton's method with a slight ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (y - p)) - 0.1 * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def bucket(modulus: int, key: str = "doc_id"):
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % modulus


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled documents whose bucket(5) isn't 0. The sample is the SAMPLE_TOXIC and
    SAMPLE_ORDINARY labelled ids that come first by a hash, so it doesn't grow with the input."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (bucket(5, key) != 0))
    share = known.agg(F.avg(label).alias("s")).head()[0]
    one = known.groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("z")).filter("y = z").select(key, "y")
    pick = lambda y, n: one.filter(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(n)
    sample = pick(1, SAMPLE_TOXIC).unionByName(pick(0, SAMPLE_ORDINARY))
    rows = docs.select(key, text).join(F.broadcast(sample), key).filter(F.length(text).between(1, SAMPLE_CHARS))
    rows = rows.groupBy(key).agg(F.min("y").alias("y"), F.min(text).alias("t")).orderBy(F.xxhash64(key), key).collect()
    return fit([r.t for r in rows if r.y == 1], [r.t for r in rows if r.y == 0], float(share or 0.0))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a column of the probability of label 1 for each row; a column of that name is replaced."""
    packed = pickle.dumps(model_state(model))
    keep = [c for c in docs.columns if c != into]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.DoubleType(), False)])
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**pickle.loads(packed)).open()
        for whole in batches:
            for b in text_slices(whole, at):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.score(b.column(at).to_pylist()), pa.float64())], names=[*keep, into])

    return rows.toDF(*[f"c{i}" for i in range(len(keep))]).mapInArrow(slim(run), schema)


def model_state(model: Model) -> dict:
    return {k: getattr(model, k) for k in ("ordinary", "toxic", "lexicon", "weights", "centre", "scale")}


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return scored.select("doc_id", (bucket(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
