"""Language ID by mixture inference.

A model holds, for each language, the log-likelihood of every hashed byte trigram of lower-cased words (with word
ends), from counts over all training documents. A document is taken as a mixture: each of its words comes from one
language, with unknown proportions, which expectation-maximisation estimates from the words' likelihoods. The set of
languages is chosen by penalised likelihood (BIC): the strongest language alone first, then one more at a time, in order
of proportion, while the gain in log-likelihood exceeds the penalty. The prediction is the language of largest
proportion in the chosen set, its score that proportion.

Counting is a partial sum per task and one shuffle of (language, trigram) counts; the model is a table of fixed width
per language, sent to the tasks. Scoring goes through texts in slices of bounded size, words and documents of a slice
at once. A text longer than a slice is gone through slice by slice in every round of its mixture, so its memory is a
slice's too, at the price of reading it some dozen times; slices may end within a word, whatever parts words and however
long one is, and the result is the same.

Defined results: ``und`` with score 0 for texts that are null or have no letter, and for all if nothing was learned;
texts in no language known get the least unlikely one, and of equally likely ones the first by code point; no rows give no
rows; repeated rows are scored alike; rows without doc_id are scored
and not learned from; columns of the input named as those that are added are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Hashed trigrams as a power of two; bytes of text handled at once; rounds of the mixture.
BITS, SLICE, ROUNDS = 16, 1 << 20, 12
#: The largest model: so many languages of 2 ** BITS four-byte numbers (256 KB) each, more than ISO 639-3 has codes, so that
#: what is sent to all tasks has a bound. More are an error, none are dropped.
MOST_LANGUAGES = 8192
#: Bytes as the trigrams see them: letters a-z (A-Z lower-cased) and bytes of longer characters; all else is a space.
_SEEN = np.full(256, 32, np.uint8)
_SEEN[97:123] = _SEEN[65:91] = np.arange(97, 123)
_SEEN[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (2 ** BITS, languages), float32


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all words, each word between two spaces, and where each word's trigrams begin.

    What is not an ASCII letter or part of a longer UTF-8 character separates words.
    """
    b = _SEEN[np.frombuffer(b" " + raw + b" ", np.uint8)]
    space = b == 32
    keep = np.ones(len(b), bool)
    keep[1:] = ~(space[1:] & space[:-1])  # runs of separators count once
    b = b[keep].astype(np.uint32)
    if len(b) < 3:
        return np.array([], np.int64), np.array([], np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    inner = b[1:-1] != 32  # a trigram for each byte of a word, with its neighbours
    first = inner & (b[:-2] == 32)
    hashed = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)[inner]
    return hashed, np.flatnonzero(first[inner])


def slice_size(languages: int) -> int:
    """Bytes of text at once, so that words times languages have a bound."""
    return max(1 << 6, SLICE * 8 // max(8, languages))


def sliced(raw: bytes, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What ``words_of`` gives, for pieces of bounded size, cut anywhere.

    A trigram needs a byte and its two neighbours, so each piece looks one byte past its ends; trigrams before the first
    word that begins in a piece go on with the word before, however long that is.
    """
    for at in range(0, len(raw), size):
        end = min(len(raw), at + size)
        b = _SEEN[np.frombuffer((raw[at - 1 : at] or b" ") + raw[at:end] + (raw[end : end + 1] or b" "), np.uint8)].astype(np.uint32)
        inner = b[1:-1] != 32
        code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:])[inner]
        hashed = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
        yield hashed, np.flatnonzero((b[:-2] == 32)[inner])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(b.column("text"), b.column("lang").to_pylist()):
            for grams, _ in sliced((text.as_py() or "").encode(), SLICE):
                if lang not in seen:
                    seen[lang] = np.zeros(1 << BITS, np.int64)
                if len(grams) < 1 << 13:
                    np.add.at(seen[lang], grams, 1)
                else:
                    seen[lang] += np.bincount(grams, minlength=1 << BITS)
    for lang, counts in seen.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "gram", "n"])


def fit(docs: DataFrame, train=None) -> Model:
    """Learns from ``text`` and non-null ``lang``; by default from documents whose crc32(doc_id) mod 3 is not 1."""
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False)) if train is None else train
    rows = docs.where(train & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    counts = rows.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = common.Scratch(docs.sparkSession, "language-id").keep(counts, "counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.zeros((1 << BITS, len(languages)), np.float64)
    at = {x: k for k, x in enumerate(languages)}
    for batch in counts.toArrow().to_batches():  # at most 2 ** BITS rows a language, whatever the corpus
        cols = [at[x] for x in batch.column("lang").to_pylist()]
        table[batch.column("gram").to_numpy(), cols] += batch.column("n").to_numpy()
    total = table.sum(axis=0, keepdims=True)
    smooth = 0.5
    return Model(languages, np.log((table + smooth) / (total + smooth * (1 << BITS))).astype(np.float32))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def mixtures(scores: np.ndarray, starts: np.ndarray, languages: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods per document, by EM over words. scores: words x languages; starts: first word of each."""
    top = scores.max(axis=1, keepdims=True)
    like = np.exp(scores - top)
    n = np.diff(np.append(starts, len(scores)))
    doc = np.repeat(np.arange(len(starts)), n)
    k = scores.shape[1]
    allowed = np.ones((len(starts), k)) if languages is None else languages.astype(np.float64)
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        joint = like * pi[doc]
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        pi = np.add.reduceat(joint, starts, axis=0) / n[:, None]
    total = np.log(np.maximum((like * pi[doc]).sum(axis=1), 1e-300)) + top[:, 0]
    return pi, np.add.reduceat(total, starts)


def choose(scores: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, proportion, size of the language set) of each document by penalised likelihood."""
    n = np.diff(np.append(starts, len(scores)))
    single = np.add.reduceat(scores, starts, axis=0)
    best = single.argmax(axis=1)
    share, size = np.ones(len(starts)), np.ones(len(starts), int)
    full, like_full = mixtures(scores, starts)
    penalty = 0.5 * np.log(n + 1.0) + 1.0
    # no set can gain more than the full mixture does: where even that is below one penalty, one language it is
    rest = np.flatnonzero(like_full - single.max(axis=1) > penalty)
    if len(rest) and scores.shape[1] > 1:
        doc = np.repeat(np.arange(len(starts)), n)
        order = np.argsort(-full, axis=1)
        held = single.max(axis=1)
        for k in range(2, scores.shape[1] + 1):
            words = np.isin(doc, rest)
            own = np.concatenate([[0], np.cumsum(n[rest])[:-1]])
            sets = np.zeros((len(rest), scores.shape[1]), bool)
            np.put_along_axis(sets, order[rest][:, :k], True, axis=1)
            pi, like = mixtures(scores[words], own, sets)
            better = like - held[rest] > penalty[rest]
            hit = rest[better]
            best[hit], share[hit], size[hit] = pi[better].argmax(axis=1), pi[better].max(axis=1), k
            held[hit] = like[better]
            rest = hit
            if not len(rest):
                break
    return best, share, size


def _word_scores(raw: bytes, model: Model) -> np.ndarray:
    """Log-likelihood of each word in each language."""
    grams, first = words_of(raw)
    if not len(first):
        return np.zeros((0, len(model.languages)))
    return np.add.reduceat(model.table[grams], first, axis=0).astype(np.float64)


def _sliced_scores(raw: bytes, model: Model, size: int) -> Iterator[np.ndarray]:
    """``_word_scores`` slice by slice: a word that a slice ends in is given with the slice that it ends in."""
    open_ = None
    for grams, first in sliced(raw, size):
        scores = model.table[grams]
        head = first[0] if len(first) else len(grams)
        if head:
            more = scores[:head].sum(axis=0, dtype=np.float64)
            open_ = more if open_ is None else open_ + more
        if len(first):
            if open_ is not None:
                yield open_[None, :]
            own = np.add.reduceat(scores, first, axis=0).astype(np.float64)
            yield own[:-1]
            open_ = own[-1]
    if open_ is not None:
        yield open_[None, :]


def choose_long(text: str, model: Model, size: int) -> tuple[int, float, int] | None:
    """What ``choose`` gives for one text, with the memory of one slice; None for a text without words."""
    k, raw = len(model.languages), text.encode()
    single, n = np.zeros(k), 0
    for scores in _sliced_scores(raw, model, size):
        single, n = single + scores.sum(axis=0), n + len(scores)
    if not n:
        return None

    def mixture(allowed: np.ndarray) -> tuple[np.ndarray, float]:
        pi, total = allowed / allowed.sum(), 0.0
        for step in range(ROUNDS + 1):
            share = np.zeros(k)
            for scores in _sliced_scores(raw, model, size):
                top = scores.max(axis=1, keepdims=True, initial=-np.inf)
                joint = np.exp(scores - top) * pi
                word = np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
                if step == ROUNDS:
                    total += float((np.log(word) + top).sum())
                share += (joint / word).sum(axis=0)
            pi = pi if step == ROUNDS else share / n
        return pi, total

    best, share, count = int(single.argmax()), 1.0, 1
    full, like_full = mixture(np.ones(k))
    penalty, held = 0.5 * np.log(n + 1.0) + 1.0, single.max()
    if like_full - held > penalty and k > 1:
        order = np.argsort(-full)
        for m in range(2, k + 1):
            allowed = np.zeros(k)
            allowed[order[:m]] = 1
            pi, like = mixture(allowed)
            if like - held <= penalty:
                break
            best, share, count, held = int(pi.argmax()), float(pi.max()), m, like
    return best, share, count


def _score_texts(texts: list[str], model: Model) -> tuple[list[str], list[float], list[int]]:
    langs, scores, sizes = ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts)
    size = slice_size(len(model.languages))
    words, starts, at, known = [], [], 0, []

    def put(i: int, best: int, share: float, count: int) -> None:
        langs[i], scores[i], sizes[i] = model.languages[best], float(min(1.0, share)), int(count)

    for i, text in enumerate(texts):
        if not (model.languages and has_letter(text)):
            continue
        raw = text.encode()
        if len(raw) > size:
            found = choose_long(text, model, size)
            if found:
                put(i, *found)
            continue
        own = _word_scores(raw, model)
        if len(own):
            starts.append(at)
            at += len(own)
            words.append(own)
            known.append(i)
    if known:
        for i, *found in zip(known, *choose(np.concatenate(words), np.array(starts))):
            put(i, *found)
    return langs, scores, sizes


def _scored(batch: pa.RecordBatch, model: Model) -> tuple[list, list, list]:
    from .tokens import pieces

    texts = [t or "" for t in batch.column("text").to_pylist()]
    out: tuple[list, list, list] = ([], [], [])
    for i, j in pieces([len(t) for t in texts], slice_size(len(model.languages))):
        for col, found in zip(out, _score_texts(texts[i:j], model)):
            col += found
    return out


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


ADDED = ("lang_pred", "lang_score", "lang_count")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_count (languages in the chosen set)."""
    docs = docs.drop(*ADDED)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed width per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _scored(b, sent.value)
            columns = [pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *ADDED])

    return docs.mapInArrow(run, f"{_fields(docs)}, lang_pred string, lang_score double, lang_count int")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, with the columns as they are, without those that have no language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([x != "und" for x in _scored(b, sent.value)[0]], pa.bool_()))

    return docs.mapInArrow(run, _fields(docs))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_count"))
