"""Language identification of texts that may mix languages.

Each language is a distribution over hashed letter trigrams, counted over every labelled text. A
document's language shares are found by expectation-maximisation over those distributions. The set
of languages is chosen by penalised likelihood: a language stays only while leaving it out costs
more log-likelihood than the penalty of its one parameter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_view, slices, type_of

#: Buckets of the hashed trigrams: the model has one float for each bucket and language.
BUCKETS = 1 << 15
#: Of more distinct labels than this, those with the most n-grams are learned (the model stays under 128 MB).
MAX_LANGUAGES = 1024
SMOOTHING = 0.05
#: EM ends when no other shares can have a log-likelihood higher by more than this, or after ROUNDS at the latest.
SETTLED, ROUNDS = 0.05, 5_000
UNKNOWN = "und"
_SHIFT = np.uint32(32 - 15)
_MAP = np.full(256, 32, np.uint8)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
_ASCII_LETTER, _ANY_LETTER = re.compile(rb"[A-Za-z]"), regex.compile(r"\p{L}")
_PIECE = 1 << 18


def _hashed(norm: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes at each place; -1 where the middle one is a blank."""
    wide = norm.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    code = ((code * np.uint32(2654435761)) >> _SHIFT).astype(np.int32)
    code[norm[1:-1] == 32] = -1
    return code


def trigrams(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the trigrams of one text (bytes; a blank stands before and after)."""
    total = np.zeros(BUCKETS, np.int64) if len(text) > _PIECE else None
    for lo in range(0, max(1, len(text)), _PIECE):
        norm = np.full(min(_PIECE, len(text) - lo) + 2, 32, np.uint8)
        left, right = max(0, lo - 1), min(len(text), lo + _PIECE + 1)
        norm[left - lo + 1 : right - lo + 1] = _MAP[text[left:right]]
        code = _hashed(norm)
        code = code[code >= 0]
        if total is None:
            return np.unique(code, return_counts=True)
        total += np.bincount(code, minlength=BUCKETS)
    some = np.flatnonzero(total)
    return some, total[some]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of each bucket (rows) in each language (columns).

    Counts cover every labelled row. A task sends one row for each language and bucket at most; the
    driver gets languages times buckets numbers, whatever the size of the corpus. Rows whose text or
    label is null take no part. Of more than MAX_LANGUAGES labels those with the most n-grams are
    learned, ties by name; the rest is as if unlabelled.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in slices(whole, "text", 1 << 18):
                data, at = binary_view(b.column(1))
                # all texts of the slice side by side, blanks between
                n = len(b)
                norm = np.full(len(data) + n + 1, 32, np.uint8)
                owner = np.repeat(np.arange(n), np.diff(at))
                norm[np.arange(len(data)) + owner + 1] = _MAP[data]
                code = _hashed(norm)
                langs = b.column(0).to_pylist()
                edge = at + np.arange(n + 1)
                for name in set(langs):
                    own = [code[edge[i] : edge[i + 1] - 1] for i in range(n) if langs[i] == name and edge[i + 1] - 1 > edge[i]]
                    if own:
                        got = np.concatenate(own)
                        sums[name] = sums.get(name, 0) + np.bincount(got[got >= 0], minlength=BUCKETS)
        for name, c in sums.items():
            some = np.flatnonzero(c)
            yield pa.record_batch([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(c[some])], ["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("own"), F.sum("n").alias("total"))
    by_lang = by_lang.orderBy(F.desc("total"), "lang").limit(MAX_LANGUAGES).select("lang", "own")
    langs, columns = [], []
    for lang, own in by_lang.toLocalIterator():  # BUCKETS entries for each language at most
        c = np.full(BUCKETS, SMOOTHING)
        c[[r[0] for r in own]] += [r[1] for r in own]
        langs.append(lang)
        columns.append(np.log(c / c.sum()).astype(np.float32))
    order = np.argsort(langs)
    return [langs[i] for i in order], np.stack([columns[i] for i in order], 1) if langs else np.empty((BUCKETS, 0), np.float32)


def mixture(logs: np.ndarray, counts: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Shares of the languages and log-likelihood of n-grams with these log-probabilities (n-grams by languages).

    Each round multiplies a share by the mean of its language's likelihood over the mixture's. The
    logarithm of the largest such factor, times the n-grams, is more than any other shares can gain,
    so the rounds end with a likelihood within SETTLED of the best. share: where to begin.
    """
    top = logs.max(1, keepdims=True)
    like = np.exp(logs - top)
    total = counts.sum()
    share = np.full(logs.shape[1], 1 / logs.shape[1]) if share is None else share / share.sum()
    for _ in range(ROUNDS if logs.shape[1] > 1 else 0):
        factor = (counts / (like @ share)) @ like / total
        if total * np.log(factor.max()) <= SETTLED:
            break
        share = share * factor
        share /= share.sum()
    return share, float((counts * (np.log(like @ share) + top[:, 0])).sum())


def select_languages(logs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Language indices and shares of the set with the best penalised likelihood, and its log-likelihood an n-gram.

    Backward elimination from all languages: the smallest share goes while the likelihood it adds is
    worth less than half the logarithm of the n-grams. Many languages go at once where all of them
    together add less than one may.
    """
    total = counts.sum()
    penalty = 0.5 * np.log(max(total, 2))
    # no mixture gains more over the best single language than this (as in `mixture`); mostly that settles it
    alone = counts @ logs
    one = int(np.argmax(alone))
    if total * np.log((counts @ np.exp(np.minimum(logs - logs[:, one, None], 50.0))).max() / total) <= penalty:
        return np.array([one]), np.ones(1), alone[one] / total
    own = np.arange(logs.shape[1])
    share, best = mixture(logs, counts)
    many = len(own) // 2
    while len(own) > 1:
        out = np.argsort(share, kind="stable")[: max(1, min(many, len(own) - 1))]
        rest, begin = np.delete(own, out), np.delete(share, out)
        less, value = mixture(logs[:, rest], counts, begin + 1e-3 / len(rest))
        if best - value <= penalty:
            own, share, best = rest, less, value
            many = min(many, len(own) // 2)
        elif len(out) == 1:
            break
        else:
            many //= 2
    return own, share, best / total


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score, languages (array of lang and share), fit (log-likelihood an n-gram) for every row.

    lang_pred has the largest share, score is that share. A text that is null or has no letter, and
    any text under a model without languages, is `und` with score 0 and no languages. Equal shares go
    to the name that sorts first. Only the text is read. Ids may have any type, repeat or be null; an
    empty table gives no rows.
    """
    langs, logs = model
    held = docs.sparkSession.sparkContext.broadcast((langs, logs))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"_id {type_of(docs, id_col)}, lang_pred string, score double, languages array<struct<lang:string,share:double>>, fit double"
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = held.value
        for whole in batches:
            for b in slices(whole, "text"):
                data, at = binary_view(b.column(1))
                out: list[tuple] = []
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    text = data[lo:hi]
                    if not langs or not has_letter(text.tobytes()):
                        out.append((UNKNOWN, 0.0, [], None))
                        continue
                    bucket, n = trigrams(text)
                    if not len(bucket):
                        out.append((UNKNOWN, 0.0, [], None))
                        continue
                    own, share, fits = select_languages(logs[bucket].astype(np.float64), n.astype(np.float64))
                    top = int(np.argmax(share))
                    out.append((langs[own[top]], min(1.0, float(share[top])), [{"lang": langs[o], "share": float(s)} for o, s in zip(own, share, strict=True)], fits))
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], kind), pa.array(cols[3], pa.float64())], ["_id", "lang_pred", "score", "languages", "fit"])

    return rows.mapInArrow(predict, schema).withColumnRenamed("_id", id_col)


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and bool(_ANY_LETTER.search(text.decode("utf-8", "replace")))


def held_out(id_col: str = "doc_id"):
    """True for rows that the model never learns from: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


#: A text fits no language if its n-grams are less likely than under even chances for all buckets.
NO_FIT = -float(np.log(BUCKETS))


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that have no language: `und`, or a fit below even chances.

    Rows without an id stay; rows that repeat an id go together. model: by default fitted on the
    labelled rows of docs that are not held out.
    """
    model = model or fit(docs.where(~held_out(id_col)), text_col)
    if not model[0]:  # nothing labelled: nothing can be told, so only texts without letters go
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    out = identify(docs, model, id_col, text_col)
    bad = out.where((F.col("lang_pred") == UNKNOWN) | (F.col("fit") < NO_FIT)).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)


def model_for(spark: SparkSession, docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model of the contract: every labelled row outside the held-out third."""
    return fit(docs.where(~held_out()))
