"""Toxicity by multiple-instance learning: sentences scored, documents labelled.

A document is a bag of sentences and only the bag has a label.  A sentence is
toxic with probability ``sigmoid(bias + sum of its distinct words' weights)``;
the document's score is their noisy-or with a leak,
``1 - (1 - leak) * prod(1 - p)``.  The document labels' log loss is minimised
through that product, so the weight goes to the sentences that explain a label,
and the trained scorer then names the offending sentences.

* A word's weight is the sum of its features' weights: the word itself and its
  first three to seven letters, so inflected forms share what they have in
  common, in any language.  Nothing else enters a score.
* Training takes at most ``max_rows`` labelled documents of at most
  ``max_bytes`` in all, each of at most an eighth of that (the documented bounds
  of the sample, drawn by a hash of the id).  Their ids are a bounded list, so
  they meet the table in a broadcast join: texts of documents outside the
  sample are never shuffled.  One task trains; the model is the features whose
  weights aren't zero, some hundreds.
* Scoring is one pass over every whole text, in slices; a worker remembers the
  weights of at most ``WORD_CACHE`` words and forgets them with its task.

Defined results: null, empty and wordless texts have no sentence with a word,
their score is the leak; labels that are null don't teach, of labels that differ for
one id the larger holds; of labelled rows with one id the least text teaches;
repeated rows and ties get equal scores; without any labelled row (or with one
class only) every score is that class's share, 0 if there is none; an empty
table gives an empty result; very long texts are read whole; of the input only
doc_id is carried, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.shared import Numbering, ship

#: Bounds of the labelled sample.
MAX_ROWS = 8_000
MAX_BYTES = 32 << 20
#: A feature must stand in so many labelled documents to get a weight.
MIN_DOCS = 3
#: Fixed values of the training.
START_BIAS, START_LEAK, STEPS, RATE = -6.0, 0.02, 100, 0.3
#: A weight that would explain fewer documents than this stays zero.
SHRINK = 0.3
#: Gradients under so many documents' worth move their weight in proportion, so rare features don't outrun common ones.
DAMP = 3.0
#: Words that a task remembers, rows of a slice.
WORD_CACHE, SLICE_ROWS = 300_000, 200
#: Prefix lengths that are features.
PREFIXES = (3, 4, 5, 6, 7)

#: A sentence ends at a line's end, or behind its closing marks before white space.
SENTENCE = re.compile(r"[^\n.!?。！？]++(?:[.!?](?!\s|$)[^\n.!?。！？]*+)*+[.!?。！？]*+")
WORD = re.compile(r"\w+")


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, distinct words) of each sentence with a word."""
    for m in SENTENCE.finditer(text):
        found = set(WORD.findall(m.group().lower()))
        if found:
            yield m.start(), m.end(), found


def features(word: str) -> list[str]:
    """The word in full (marked ``=``) and its first letters."""
    return ["=" + word, *(word[:k] for k in PREFIXES if k <= len(word))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights by feature, the sentence bias and the document leak."""

    bias: float = 0.0
    leak: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def spans(self, text: str, cache: dict[str, float]) -> Iterator[tuple[int, int, float]]:
        """(start, end, logit) of each sentence with a word."""
        for start, end, found in sentences(text):
            s = self.bias
            for w in found:
                v = cache.get(w)
                if v is None:
                    if len(cache) >= WORD_CACHE:
                        cache.clear()
                    v = cache[w] = self.word(w)
                s += v
            yield start, end, s

    def score(self, logits: np.ndarray) -> float:
        """Noisy-or of the sentences and the leak."""
        return float(1.0 - (1.0 - self.leak) * np.exp(-np.logaddexp(0.0, logits).sum()))


def train(texts: list[str], labels: list[int]) -> Model:
    """Minimise the documents' log loss through the noisy-or; full-batch Adam, weights shrunk towards zero."""
    y = np.asarray(labels, bool)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Model(bias=-30.0, leak=share)
    words, sent_doc, sizes, pair_word = Numbering(), [], [], []
    for d, text in enumerate(texts):
        bag = [found for _, _, found in sentences(text)]
        sent_doc += [d] * len(bag)
        sizes += map(len, bag)
        pair_word.append(words.of([w for found in bag for w in sorted(found)]).astype(np.int32))
    if not sent_doc:
        return Model(bias=-30.0, leak=share)
    pair_word, sent_doc = np.concatenate(pair_word), np.asarray(sent_doc)
    pair_sent = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    # features of each word, kept where enough documents have them; words without any go
    doc_words = np.unique(sent_doc[pair_sent].astype(np.int64) * len(words.order) + pair_word)
    seen_in = np.bincount(doc_words % len(words.order), minlength=len(words.order))
    del doc_words
    feats = Numbering()
    of_word = [features(w) for w in words.order]
    fw = np.repeat(np.arange(len(of_word), dtype=np.int32), [len(f) for f in of_word])
    ff = feats.of([f for one in of_word for f in one]).astype(np.int32)
    del of_word
    used = np.bincount(ff, weights=seen_in[fw], minlength=len(feats.order)) >= MIN_DOCS
    fw, ff = fw[used[ff]], ff[used[ff]]
    live = np.zeros(len(words.order), bool)
    live[fw] = True
    pair_sent, pair_word = pair_sent[live[pair_word]], pair_word[live[pair_word]]
    n_words, n_feats, n_sents, n_docs = len(words.order), len(feats.order), len(sent_doc), len(y)
    theta = np.zeros(n_feats + 2)
    theta[-2:] = START_BIAS, np.log(START_LEAK / (1 - START_LEAK))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    g = np.empty_like(theta)
    for step in range(1, STEPS + 1):
        word_w = np.bincount(fw, weights=theta[ff], minlength=n_words)
        s = theta[-2] + np.bincount(pair_sent, weights=word_w[pair_word], minlength=n_sents)
        leak = _sigmoid(theta[-1:])[0]
        rest = (1 - leak) * np.exp(-np.bincount(sent_doc, weights=np.logaddexp(0.0, s), minlength=n_docs))
        # the loss's slope by -log(rest), summed over documents: 1 for a clean one, -rest / (1 - rest) for a toxic one
        pull = np.where(y, -rest / np.maximum(1 - rest, 1e-9), 1.0)
        ds = pull[sent_doc] * _sigmoid(s)
        dw = np.bincount(pair_word, weights=ds[pair_sent], minlength=n_words)
        g[:-2] = np.bincount(ff, weights=dw[fw], minlength=n_feats)
        g[-2], g[-1] = ds.sum(), (pull * leak).sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        pace = RATE / (np.sqrt(v / (1 - 0.99**step)) + DAMP)
        theta -= pace * m / (1 - 0.9**step)
        theta[:-2] = np.sign(theta[:-2]) * np.maximum(np.abs(theta[:-2]) - SHRINK * pace[:-2], 0.0)
    kept = np.flatnonzero(np.abs(theta[:-2]) > 1e-3)
    return Model(float(theta[-2]), float(leak), {feats.order[k]: float(theta[k]) for k in kept})


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows to learn from."""
    drawn = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("_order", F.xxhash64("doc_id"))
        .orderBy("_order", "doc_id")
        .limit(max_rows)
    )
    size = F.octet_length("text")
    texts = (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (size * 8 <= max_bytes))
        .join(F.broadcast(drawn), "doc_id")
        .groupBy("doc_id", "toxic", "_order")
        .agg(F.min("text").alias("text"))
    )
    # at most max_rows rows: one window over them all
    so_far = F.sum(size.cast("long")).over(Window.orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return texts.withColumn("_bytes", so_far).where(F.col("_bytes") <= max_bytes).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """The model of the labelled rows (``labels``: doc_id, toxic 0 or 1), trained in one task."""
    ship(docs.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        m = train(rows["text"].tolist(), rows["toxic"].tolist())
        return pd.DataFrame(
            [(m.bias, m.leak, list(m.weights), list(m.weights.values()))], columns=["bias", "leak", "feature", "weight"]
        )

    rows = sample(docs, labels, max_rows, max_bytes).select(F.col("doc_id").cast("string").alias("key"), "text", "toxic")
    schema = "bias double, leak double, feature array<string>, weight array<double>"
    got = rows.groupBy().applyInPandas(run, schema).first()
    if got is None:
        return Model(bias=-30.0, leak=0.0)
    return Model(got["bias"], got["leak"], dict(zip(got["feature"], got["weight"], strict=True)))


def score(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """doc_id, score and the offending sentences: (start, end, score) in code points.

    A sentence offends with a score of ``least`` or more; where the document
    reaches it only by several sentences together, the worst of them does.
    """
    ship(docs.sparkSession)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, score double, offending array<struct<start:long,end:long,score:double>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                scores, found = [], []
                for text in part.column(1).to_pylist():
                    spans = list(model.spans(text or "", cache))
                    logits = np.array([s for _, _, s in spans])
                    scores.append(model.score(logits))
                    p = _sigmoid(logits)
                    # a document that only many sentences make toxic is blamed on the worst of them
                    bar = min(least, p.max()) if len(p) and scores[-1] >= least else least
                    hits = np.flatnonzero(p >= bar)
                    found.append([{"start": spans[k][0], "end": spans[k][1], "score": float(p[k])} for k in hits])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores, pa.float64()), pa.array(found, span)], names=["doc_id", "score", "offending"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether an id is kept from training: CRC-32 of its text form, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
