"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed lexicon and of a learned one (words and word beginnings
that occur nearly only in toxic texts), hits close to a second-person pronoun, capitals, punctuation and
obfuscation rates. The lexicon is learned on folds 1 and 2 of the labelled rows, the trees on fold 3,
the calibration on fold 4 (fold: crc32 of the id as text, mod 5); fold 0 is held out. Language, source
and id are never inputs.

The models are fitted on MAX_LABELLED labelled rows at most, those with the smallest hash of their id
(a parameter); that bound also makes the broadcast of the sample's labels safe. All texts are scored, in
one narrow pass.

Defined results: null and empty texts are scored like any other. A row whose id is null isn't held out.
A document with several labels counts as toxic if one says so. Without toxic and clean rows in both of
folds 3 and 4, the score is a fixed function of the lexicon densities. One row per input row.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, values, written

MAX_LABELLED, LEXICON, TREES, DEPTH = 20_000, 400, 20, 3
#: Insults of four languages.
BASE_LEXICON = frozenset(
    "idiot idiots idiotic moron morons moronic stupid scum trash loser losers clown clowns pathetic worthless disgusting dumb imbecile bastard bitch asshole jerk retard garbage filth filthy vermin scumbag "
    "crap shit fuck fucking cunt whore slut dipshit dumbass "
    "idioten arschloch dummkopf abschaum versager trottel scheisse scheiße depp wichser hurensohn "
    "idiote idiots crétin connard connasse salaud merde imbécile abruti débile pourriture "
    "idiota idiotas imbécil estúpido estúpida basura mierda cabrón pendejo gilipollas escoria inútil".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t"})
FEATURES = ("log_words", "base", "learned", "hits", "any_hit", "near_you", "close_share", "capitals", "shouted", "exclaims", "questions", "punctuation", "obfuscated", "hidden_hits", "digits", "variety")
WORD = re.compile(r"[^\W_]+")
ODD = re.compile(r"(?<![^\s])[^\W\d_]+[@$!*0-9+][^\s.,;:?]*[^\W_]|(?<![^\W])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W])")
STRETCH = re.compile(r"(.)\1{2,}")
STEMS = (4, 5, 6)
WORDS = 500_000


def units(word: str) -> list[str]:
    """What the learned lexicon holds: a whole word (marked by =) and its beginnings."""
    return ["=" + word, *(word[:n] for n in STEMS if len(word) > n)]


def feature_row(text: str, learned: frozenset[str], memo: dict[str, int]) -> list[float]:
    low = text.lower()
    words = WORD.findall(low)
    n, chars = len(words), max(len(text), 1)
    flags = []
    for w in words:
        flag = memo.get(w)
        if flag is None:
            flag = (w in BASE_LEXICON) + 2 * any(u in learned for u in units(w)) + 4 * (w in SECOND_PERSON)
            if len(memo) >= WORDS:
                memo.clear()
            memo[w] = flag
        flags.append(flag)
    f = np.array(flags, np.int8)
    hit, you = (f & 3) > 0, np.nonzero(f & 4)[0]
    at = np.nonzero(hit)[0]
    near = 0
    if len(at) and len(you):
        right = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.minimum(right, len(you) - 1)]), np.abs(at - you[np.maximum(right - 1, 0)]))
        near = int((gap <= 5).sum())
    odd = ODD.findall(text)
    undone = [re.sub(r"[^\w]+", "", STRETCH.sub(r"\1", o.lower().translate(LEET))) for o in odd]
    hidden = sum(o in BASE_LEXICON or any(u in learned for u in units(o)) for o in undone if not o.isdigit())
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    shouted = len(re.findall(r"\b[^\W\d_a-zß-öø-ÿ]{3,}\b", text)) if upper else 0
    marks = {c: text.count(c) for c in "!?"}
    per = 1 / max(n, 1)
    return [
        float(np.log1p(n)), float((f & 1).sum()) * per * 100, float(((f & 2) > 0).sum()) * per * 100, float(np.log1p(hit.sum())), float(hit.any()), near * per * 100, near / max(len(at), 1),
        upper / chars, shouted * per, marks["!"] / chars * 100, marks["?"] / chars * 100, sum(text.count(c) for c in ".,;:!?*#$%&") / chars, len(odd) * per, float(np.log1p(hidden)),
        sum(map(text.count, "0123456789")) / chars, len(set(words)) * per,
    ]


def with_features(docs: DataFrame, learned: frozenset[str], keep: list[str], text_col: str) -> DataFrame:
    """The columns `keep`, and the features."""
    kinds = dict(docs.dtypes)

    def run(batch, state):
        memo = state.setdefault("memo", {})
        rows = np.array([feature_row(t or "", learned, memo) for t in values(batch, "_text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
        return {c: values(batch, c) for c in keep} | dict(zip(FEATURES, rows.T, strict=True))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} double" for c in FEATURES)])
    return map_columns(docs.select(*keep, F.col(text_col).alias("_text")), run, schema)


def fold(id_col) -> F.Column:
    return F.crc32(id_col.cast("string")) % 5


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, fold, toxic): at most `limit` labelled ids outside fold 0."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max("toxic").alias("toxic"))
    known = known.where(fold(F.col("_doc")) != 0).orderBy(F.xxhash64("_doc"), "_doc").limit(limit)
    joined = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(known), "_doc")
    return joined.select(F.col("_doc").alias("doc_id"), "text", fold(F.col("_doc")).alias("fold"), "toxic")


def learn_lexicon(sample: DataFrame, limit: int = LEXICON) -> frozenset[str]:
    """Units of folds 1 and 2 that occur nearly only in toxic texts, by how many of those they occur in."""

    def run(batch, _):
        found, toxic = [], []
        for text, y in zip(values(batch, "text").to_pylist(), values(batch, "toxic").to_pylist(), strict=True):
            own = {u for w in set(WORD.findall((text or "").lower())) for u in units(w)}
            found.extend(own)
            toxic.extend([y] * len(own))
        return {"unit": found, "toxic": toxic}

    part = sample.where("fold in (1, 2)")
    n_toxic = part.where("toxic = 1").count()
    counts = map_columns(part.select("text", "toxic"), run, "unit string, toxic int", step=64).groupBy("unit").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    good = counts.where((F.col("t") >= max(3, n_toxic // 100)) & (F.col("t") >= 0.8 * (F.col("n") + 1)))
    return frozenset(r["unit"] for r in good.orderBy(F.col("t").desc(), "unit").limit(limit).collect())


class Model:
    """Lexicon, trees and calibration; `score` adds score and predicted to whatever has the features."""

    def __init__(self, learned: frozenset[str], trees=None, curve=None):
        self.learned, self.trees, self.curve = learned, trees, curve

    def score(self, df: DataFrame) -> DataFrame:
        if self.trees is None:
            df = df.withColumn("score", F.least(F.lit(1.0), (F.col("base") + F.col("learned") + F.col("hidden_hits")) / 2))
        else:
            df = self.trees.transform(assembled(df)).withColumn("_p", vector_to_array("probability")[1])
            df = self.curve.transform(df).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_score"))))
            df = df.drop("_x", "rawPrediction", "probability", "prediction", "_p", "_score")
        return df.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(*FEATURES)


def assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(df)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    sample = written(sample_of(docs, labels, id_col, text_col))
    learned = learn_lexicon(sample)
    rows = written(with_features(sample.where("fold in (3, 4)"), learned, ["fold", "toxic"], "text").coalesce(4))
    seen = {(r["fold"], r["toxic"]) for r in rows.select("fold", "toxic").distinct().collect()}
    if len(seen) < 4:
        return Model(learned)
    ready = assembled(rows.withColumn("label", F.col("toxic").cast("double")))
    trees = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7).fit(ready.where("fold = 3"))
    told = trees.transform(ready.where("fold = 4")).select("label", vector_to_array("probability")[1].alias("_p"))
    curve = IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="_score").fit(told)
    return Model(learned, trees, curve)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col)
    scored = model.score(with_features(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model.learned, ["doc_id"], "text"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those predicted toxic; the texts pass through the scoring pass, so nothing is joined.

    All columns stay, whatever their names: they are renamed by position meanwhile.
    """
    model = fit(docs, labels, id_col, text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    scored = model.score(with_features(plain, model.learned, plain.columns, f"c{docs.columns.index(text_col)}"))
    return scored.where("predicted = 0").select(*plain.columns).toDF(*docs.columns)
