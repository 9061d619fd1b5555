"""Language identification by hierarchical discrimination.

A text becomes the square roots of the shares of its hashed byte 1- to 3-grams (letters only, lower case;
a vector of length 1). Linear SVMs, one for each family against the rest, pick the family of the language;
inside it one-versus-one SVMs between its languages vote. Training reads a sample of labelled rows: at most
``per_lang`` texts of each language, ``most`` in all, of the ``most_langs`` languages with most rows (bounds, whatever the
corpus holds); prediction reads every whole text and nothing but the text.

Edge cases: a null text, an empty one and one without any letter get ``und`` and score 0; rows with a null
language are not learned from but are predicted; without any labelled row all texts are ``und``; repeated
rows get one prediction each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.llm.common import crc_of, doc_slices, fixed_width, give_back, string_buffer, text_rows
from codefacts.llm.linear import fit_svm, sigmoid

DIMS = 4096
SLICE = 1 << 19
UNDETERMINED = "und"
#: Language code -> family. A language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indo-aryan": "hi bn ur mr gu pa ne",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_shares(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text a row of DIMS values, the square roots of its n-grams' shares (zeros without n-grams)."""
    n = len(offsets) - 1
    b = _FOLD[raw]
    if len(b):  # capital letters of Latin-1: the byte after 0xC3
        capital = np.zeros(len(b), bool)
        capital[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
        b = np.where(capital, b + 0x20, b)
    counts = np.zeros(n * DIMS)
    for lo in range(0, len(b), SLICE):  # n-grams that begin in this slice, so that a very long text takes little memory
        hi = min(lo + SLICE, len(b))
        part = b[lo : hi + 2].astype(np.int64)
        doc = np.repeat(np.arange(n, dtype=np.int64) * DIMS, np.diff(np.clip(offsets, lo, lo + len(part))))
        letter = part != 0x20
        own = letter[: hi - lo]
        counts += np.bincount(doc[: hi - lo][own] + part[: hi - lo][own], minlength=n * DIMS)
        same = (doc[1:] == doc[:-1]) & (letter[1:] | letter[:-1])
        two = part[:-1] * 256 + part[1:]
        counts += np.bincount((doc[1:] + 256 + (two * 0x9E3779B1 >> 7) % (DIMS - 256))[: hi - lo][same[: hi - lo]], minlength=n * DIMS)
        same = same[1:] & (doc[2:] == doc[:-2])
        three = two[:-1] * 256 + part[2:]
        counts += np.bincount((doc[2:] + 256 + (three * 0x85EBCA6B >> 9) % (DIMS - 256))[: hi - lo][same[: hi - lo]], minlength=n * DIMS)
    counts = counts.reshape(n, DIMS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


class Model:
    """families: names; their weights; for each family its languages and the pairs' weights."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        """x: float32, so that no fit copies it as a whole."""
        present = sorted(set(y.tolist()))
        self.families = sorted({FAMILY_OF.get(l, l) for l in langs if l in present})
        self.members = {f: [l for l in present if FAMILY_OF.get(l, l) == f] for f in self.families}
        weights, bias = [], []

        def learn(rows: np.ndarray, positive: np.ndarray) -> int:
            w, b = fit_svm(x if rows.all() else x[rows], np.where(positive[rows], 1.0, -1.0))
            give_back()
            weights.append(w)
            bias.append(b)
            return len(weights) - 1

        every = np.ones(len(y), bool)
        family = np.array([FAMILY_OF.get(l, l) for l in y.tolist()], object)
        self.family_at = [learn(every, family == f) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {f: [(a, b, learn((y == a) | (y == b), y == a)) for a, b in combinations(m, 2)] for f, m in self.members.items()}
        self.w = np.array(weights, np.float32).T if weights else np.zeros((DIMS, 0), np.float32)
        self.b = np.array(bias)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and a score from 0 to 1: the family's sigmoid times the least of the winner's pairs."""
        out, score = np.full(len(x), UNDETERMINED, object), np.zeros(len(x))
        if not self.families:
            return out, score
        m = sigmoid(4 * (x @ self.w + self.b))
        by_family = m[:, self.family_at] if self.family_at else np.ones((len(x), 1))
        chosen, sure = by_family.argmax(1), by_family.max(1)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(chosen == k)
            langs = self.members[f]
            votes, least = np.zeros((len(rows), len(langs))), np.ones((len(rows), len(langs)))
            for a, b, at in self.pairs[f]:
                p = m[rows, at]
                for lang, q in ((a, p), (b, 1 - p)):
                    i = langs.index(lang)
                    votes[:, i] += (q > 0.5) + 1e-3 * q
                    least[:, i] = np.minimum(least[:, i], q)
            best = votes.argmax(1)
            out[rows] = np.array(langs, object)[best]
            score[rows] = sure[rows] * least[np.arange(len(rows)), best]
        return out, score


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, rest = batch.column(0), batch.column(1)
        for i, j in doc_slices(texts, SLICE, 128):
            x = gram_shares(*string_buffer(texts.slice(i, j - i))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([rest.slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])


def train(docs: DataFrame, may_learn: Column, per_lang: int = 500, most: int = 4000, most_langs: int = 200) -> Model:
    """Fits on at most per_lang labelled texts of each language and ``most`` in all, chosen by a hash of doc_id and text; equal texts count once."""
    labelled = docs.filter(may_learn & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not counts:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros(0, object))
    per_lang = max(1, min(per_lang, most // len(counts)))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * per_lang / n))) for lang, n in counts.items()], F.lit(0.0))
    drawn = labelled.filter(draw < share).select("lang", "text", draw.alias("draw")).groupBy("lang", F.md5("text").alias("m")).agg(F.min("draw").alias("draw"), F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "m"))
    chosen = drawn.withColumn("at", rank).filter(F.col("at") <= per_lang).orderBy("lang", "at").select("text", "lang")
    rows = chosen.mapInArrow(_features, "lang string, x binary").toArrow()
    x = fixed_width(rows["x"], np.float32, DIMS)
    lang = np.array(rows["lang"].to_pylist(), object)
    del rows
    return Model(sorted(counts), x, lang)


def predict(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lang, score = model.predict(gram_shares(*string_buffer(texts)))
    none = ~np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
    lang[none], score[none] = UNDETERMINED, 0.0
    return lang, score


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns named in keep (text may be one of them), with lang_pred and lang_score."""
    rows, at, ddl = text_rows(docs, keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in doc_slices(batch.column(at), SLICE, 128):
                part = batch.slice(i, j - i)
                lang, score = predict(model, part.column(at))
                n = len(keep)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(lang.tolist(), pa.string()), pa.array(score)], [*part.schema.names[:n], "lang_pred", "lang_score"])

    out = rows.mapInArrow(run, f"{ddl}, lang_pred string, lang_score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "lang_score")


def op1_hierarchical_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.pmod(crc_of(F.col("doc_id")), F.lit(4)) == 2
    model = train(docs, ~held_out)
    return identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def stage(spark, docs: DataFrame, sf_dir: str, least: float = 0.25) -> DataFrame:
    """Pipeline stage: documents whose language is undetermined or that no language claims with a score of ``least`` go."""
    model = train(docs, F.lit(True))
    rows, at, ddl = text_rows(docs, docs.columns)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in doc_slices(batch.column(at), SLICE, 128):
                part = batch.slice(i, j - i)
                lang, score = predict(model, part.column(at))
                yield part.filter(pa.array((lang != UNDETERMINED) & (score >= least), pa.bool_()))

    return rows.mapInArrow(keep, ddl).toDF(*docs.columns)
