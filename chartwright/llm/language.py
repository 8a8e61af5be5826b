"""Operator 3: language identification of mixed texts.

A word's script (a code-point range) narrows its candidate languages to those whose training words
use that script. Each candidate scores the word by its letters' 4-grams, smoothed log probabilities in
a table of hashed n-grams, less the mean over the candidates. A Viterbi pass over a text's words finds
the labels with the greatest sum of scores less SWITCH for each change of language; runs of a label
are spans. The language with the most letters is the text's, its share of them, scaled by how sure
the spans' scores are, the score.

The model is fitted on a bounded sample: of each language the documents with the smallest hashes of
their ids, SAMPLE // PARTS of each of PARTS parts, whole. They are written, counted by n-gram where they
are read, and the counts summed by language, so that languages x BUCKETS rows reach the driver. Texts are
labelled where they are read, a slice of bytes at once: step t of the pass handles the t-th word of all
texts of a slice.

Defined results: und with score 0 if the text is null or has no letter (Unicode category L), or if nothing
could be learned. Of languages with equal scores or votes the first by name wins. Any other columns are ignored by predict(), kept by accepted().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartwright.llm.common import crc_bucket, give_back, lean, read, slices, small_batches, staged

SAMPLE, PARTS, BUCKETS, GRAM, SWITCH = 1500, 64, 1 << 16, 4, 6.0
#: Words whose scores a task keeps at hand; bytes of texts that are labelled at once.
KNOWN, SLICE = 60_000, 768 << 10
#: First code points of scripts' ranges, and the scripts (0 other, 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian, 5 Hebrew, 6 Arabic, 7 Indic, 8 Thai and Lao, 9 Tibetan to Georgian, 10 Hangul, 11 Kana, 12 Han).
RANGE_STARTS = np.array([0, 0x41, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0xE00, 0xF00, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00])
SCRIPTS = 13
RANGE_SCRIPTS = np.array([0, 1, 1, 2, 3, 4, 5, 6, 0, 7, 8, 9, 10, 0, 1, 2, 0, 11, 10, 12, 0, 10, 0, 12, 0])


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter; 0 for a word without any."""
    firsts = np.fromiter((ord(w[0]) if w else 0 for w in words), np.int64, len(words))
    return RANGE_SCRIPTS[np.searchsorted(RANGE_STARTS, firsts, side="right") - 1]


def letters(word: str) -> str:
    """The letters of a word in lower case; a character is a letter by its category."""
    low = word.lower()
    if low.isalpha():
        return low
    stem = low.strip(".,;:!?\"'()")  # the common case, without a look at each character
    return stem if stem.isalpha() else "".join(filter(str.isalpha, low))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the 1- to GRAM-letter windows of marked words, one row of `counts` windows after another."""
    text = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    out, owners = [], []
    for n in range(2, GRAM + 1):
        if len(text) < n:
            continue
        h = np.full(len(text) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ text[k : len(text) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        out.append((h[inside] & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    return (np.concatenate(out), np.concatenate(owners)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Model:
    """languages, log probabilities (BUCKETS x languages, centred) and which languages use a script."""

    def __init__(self, counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        if self.languages:
            table = np.stack([counts[x] for x in self.languages], axis=1).astype(float)
            p = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * BUCKETS))
            self.scores = (p - p.mean(axis=1, keepdims=True)).astype(np.float32)
            used = np.stack([scripts[x] for x in self.languages])
            self.allowed = used >= 0.01 * np.maximum(used.sum(axis=1, keepdims=True), 1)
            self.allowed[:, ~self.allowed.any(axis=0)] = True

    def words(self, words: list[str]) -> np.ndarray:
        """Scores (words x languages) of words of letters; zeros for a word without any."""
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        buckets, owner = grams(words)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, weights=self.scores[buckets, k], minlength=len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        kinds = scripts_of(words)
        out /= GRAM - 1  # each letter is seen by a window of each length
        out[~self.allowed[:, kinds].T] = -20.0
        out[lengths == 0] = 0
        return out


def chosen(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (lang, text) to learn from: of each language the documents with the smallest hashes, in equal numbers of each of PARTS parts."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id", F.xxhash64("doc_id", F.lit(7)).alias("h"))
    # Spark keeps the limit of a part in each task before the shuffle
    part = W.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy("h")
    least = known.withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= max(1, sample // PARTS)).select("lang", "h")
    return docs.withColumn("h", F.xxhash64("doc_id", F.lit(7))).join(F.broadcast(least), ["lang", "h"], "left_semi").select("lang", "text")  # languages x sample rows


def counted(rows: DataFrame) -> DataFrame:
    """Rows (lang, at, n): n-grams by bucket, and words by script, at -1 - script."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for part in slices(b, "text", SLICE):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ws = [w for w in map(letters, text.split()) if w]
                    c = counts.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, np.int64))
                    for k in range(0, len(ws), 50_000):
                        c[SCRIPTS:] += np.bincount(grams(ws[k : k + 50_000])[0], minlength=BUCKETS)
                    c[:SCRIPTS] += np.bincount(scripts_of(ws), minlength=SCRIPTS)[::-1]
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at - SCRIPTS), pa.array(c[at])], ["lang", "at", "n"])

    return rows.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from rows (doc_id, text, lang); languages x BUCKETS counts reach the driver."""
    small_batches(docs.sparkSession)
    found = counted(staged(chosen(docs, sample), "labelled")).toArrow()
    counts: dict[str, np.ndarray] = {}
    lang = found.column("lang").combine_chunks().dictionary_encode() if found.num_rows else pa.array([], pa.string()).dictionary_encode()
    of, at, n = lang.indices.to_numpy(), found.column("at").to_numpy(), found.column("n").to_numpy()
    for k, name in enumerate(lang.dictionary.to_pylist()):
        counts[name] = np.bincount(at[of == k] + SCRIPTS, n[of == k], BUCKETS + SCRIPTS).astype(np.int64)
    return Model({x: c[SCRIPTS:] for x, c in counts.items()}, {x: c[:SCRIPTS][::-1] for x, c in counts.items()})


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Labels of the words of several texts, whose scores (words x languages) stand one text after another."""
    k = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1][order]
    falling = lengths[order]
    active = [int(x) for x in np.searchsorted(-falling, -np.arange(int(falling[0]) if len(falling) else 0), side="left")]
    best = np.zeros((len(order), k), dtype=np.float32)
    stay = np.zeros((scores.shape[0], k), dtype=bool)
    source = np.zeros(scores.shape[0], dtype=np.int16)
    for t, n in enumerate(active):  # the first n texts have a t-th word
        at = starts[:n] + t
        top = best[:n].argmax(axis=1)
        jump = best[np.arange(n), top] - np.float32(penalty)
        keep = best[:n] >= jump[:, None]
        stay[at], source[at] = keep, top
        best[:n] = np.where(keep, best[:n], jump[:, None]) + scores[at]
    labels = np.zeros(scores.shape[0], dtype=np.int16)
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = state[:n]
        state[:n] = np.where(stay[at, state[:n]], state[:n], source[at])
    return labels


PREDICTION = "lang_pred string, score double, spans string"


def predict(docs: DataFrame, model: Model, keep: list[str], column: str = "text") -> DataFrame:
    """The named columns of docs and lang_pred, score and spans (language:first word:end, comma-joined; words are blank-separated)."""
    langs = model.languages
    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", {PREDICTION}"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        number: dict[str, int] = {}
        table = np.zeros((0, len(langs)), dtype=np.float32)
        sizes = np.zeros(0, dtype=np.int64)
        for whole in batches:
            # texts of about one length together: the pass over a slice takes as many steps as its longest text has words
            longest = np.argsort(-pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False), kind="stable")
            for b in slices(whole.take(pa.array(longest)), column, SLICE):
                split = [(t or "").split() for t in b.column(column).to_pylist()]
                if len(number) > KNOWN:
                    number, table, sizes = {}, table[:0], sizes[:0]
                new = list({w for ws in split for w in ws if w not in number})
                if new and langs:
                    plain = [letters(w) for w in new]
                    number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
                    table = np.concatenate([table, *(model.words(plain[k : k + 20_000]) for k in range(0, len(plain), 20_000))])
                    sizes = np.concatenate([sizes, np.fromiter(map(len, plain), np.int64, len(plain))])
                lengths = np.fromiter(map(len, split), np.int64, len(split))
                ids = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(lengths.sum())) if langs else np.zeros(0, np.int64)
                got = _labelled(ids, lengths, table, sizes, langs)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *got], [*keep, "lang_pred", "score", "spans"])
                del split, ids, got
        del number, table
        give_back()

    return docs.select(*dict.fromkeys([*keep, column])).mapInArrow(label, schema)


def _labelled(ids: np.ndarray, lengths: np.ndarray, table: np.ndarray, sizes: np.ndarray, langs: list[str]) -> list[pa.Array]:
    n = len(lengths)
    if not langs or not len(ids):
        return [pa.array(["und"] * n), pa.array([0.0] * n, pa.float64()), pa.array([""] * n)]
    scores, weight = table[ids], sizes[ids]
    labels = viterbi(scores, lengths)
    owner = np.repeat(np.arange(n), lengths)
    votes = np.zeros((n, len(langs)))
    np.add.at(votes, (owner, labels), weight)
    total = votes.sum(axis=1)
    top = votes.argmax(axis=1)
    # how much better than the next language the words of the top one are, a letter
    own = scores[np.arange(len(ids)), labels]
    lead = np.bincount(owner, weights=own - np.sort(scores, axis=1)[:, -2] if len(langs) > 1 else own, minlength=n) / np.maximum(total, 1)
    sure = 1 / (1 + np.exp(-np.clip(8 * lead, -30, 30)))
    score = np.where(total > 0, votes[np.arange(n), top] / np.maximum(total, 1) * sure, 0.0)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    begins = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1]))))
    ends = np.concatenate((begins[1:], [len(ids)]))
    spans: list[list[str]] = [[] for _ in range(n)]
    for a, e in zip(begins.tolist(), ends.tolist(), strict=True):
        d = int(owner[a])
        spans[d].append(f"{langs[labels[a]]}:{a - int(starts[d])}:{e - int(starts[d])}")
    names = ["und" if total[d] == 0 else langs[top[d]] for d in range(n)]
    return [pa.array(names), pa.array(score, pa.float64()), pa.array([",".join(s) if total[d] else "" for d, s in enumerate(spans)])]


def learned(docs: DataFrame) -> Model:
    """The model of the rows whose id's crc32 modulo 3 isn't 1."""
    return fit(docs.where(crc_bucket(F.col("doc_id"), 3) != 1))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a language, which becomes their lang; those without a letter are rejected. All columns, in order."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names that no column of a prediction has
    of = dict(zip(docs.columns, plain.columns, strict=True))
    named = predict(plain, model, plain.columns, of["text"]).where("lang_pred <> 'und'")
    return named.select(*((F.col("lang_pred") if c == "lang" else F.col(of[c])).alias(c) for c in docs.columns))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document: doc_id, held_out, lang_pred, score and the labelled spans of words."""
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, learned(docs), ["doc_id"])
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "spans")
