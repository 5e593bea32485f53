"""Language identification in two levels: family, then language within it.

Both levels are one-versus-one linear support vector machines over hashed
character pairs and triples of the letters of a whole text. They are fitted
on a bounded sample of labelled rows, each separator in a task of its own and all in
one job, and applied to every text in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.shared import small_table, stored, trimmed

#: Families of related languages by ISO 639-1 code; any other code is its own family. Fixed values.
FAMILIES = {
    "baltic": ["lt", "lv"],
    "bantu": ["ln", "lg", "ny", "rn", "rw", "sn", "st", "sw", "tn", "ts", "xh", "zu"],
    "celtic": ["br", "cy", "ga", "gd", "gv", "kw"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "indo-aryan": ["as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sa", "sd", "si", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "malayo-polynesian": ["id", "jv", "mg", "mi", "ms", "sm", "su", "tl", "to"],
    "romance": ["ca", "co", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"],
    "semitic": ["am", "ar", "he", "mt", "ti"],
    "sinitic and japonic": ["ja", "zh"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "tai": ["lo", "th"],
    "turkic": ["az", "ba", "kk", "ky", "tk", "tr", "tt", "ug", "uz"],
    "uralic": ["et", "fi", "hu", "se"],
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Hashed features, and the labelled rows of each language that a fit uses at most.
DIMENSIONS, SAMPLE = 2048, 1000
#: Weight of the squared norm against the mean hinge loss, and passes over the rows at most.
RIDGE, PASSES = 1e-3, 30
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str | None) -> str:
    """Lower case, everything but letters (Unicode category L) as one space."""
    kept = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    # what is left may hold other numbers, such as a half or a circled one
    if not kept.replace(" ", "").isalpha():
        kept = " ".join("".join(c if c.isalpha() else " " for c in kept).split())
    return kept


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of letter pairs and triples; None without a letter."""
    letters = letters_of(text)
    if not letters:
        return None
    b = np.frombuffer(f" {letters} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    pair = b[:-1] * np.uint32(0x01000193) + b[1:] * np.uint32(0x85EBCA6B)
    triple = pair[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)
    codes = np.concatenate([pair, triple])
    codes ^= codes >> np.uint32(15)
    counts = np.bincount((codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1), minlength=DIMENSIONS)
    return np.sqrt(counts / len(codes)).astype(np.float32)


@dataclass
class Vote:
    """Pairwise separators of some classes: rows of weights and a bias for each pair."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the class with most votes (then most margin) and its score,
        the least probability it has against any other class."""
        n = len(self.classes)
        if n == 1:
            return np.zeros(len(x), dtype=int), np.ones(len(x))
        margins = x @ self.weights.T + self.bias
        votes, least = np.zeros((len(x), n)), np.ones((len(x), n))
        for k, (i, j) in enumerate(combinations(range(n), 2)):
            p = 1 / (1 + np.exp(-3 * np.clip(margins[:, k], -20, 20)))  # of class i
            for c, q in ((i, p), (j, 1 - p)):
                votes[:, c] += (q > 0.5) + q / (2 * n)
                least[:, c] = np.minimum(least[:, c], q)
        best = votes.argmax(axis=1)
        return best, least[np.arange(len(x)), best]


@dataclass
class Model:
    family: Vote
    within: list[Vote]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        top, score = self.family.decide(x)
        names = np.empty(len(x), dtype=object)
        for f, vote in enumerate(self.within):
            rows = np.flatnonzero(top == f)
            if len(rows):
                best, p = vote.decide(x[rows])
                names[rows] = [vote.classes[b] for b in best]
                score[rows] *= p
        return names.tolist(), score


def hinge(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, passes: int = PASSES, enough: float = 0.01) -> np.ndarray:
    """Weights and a bias with the least mean hinge loss of labels ``y`` (1, -1) plus
    ``ridge`` / 2 of their squared norm, by coordinate descent on the dual."""
    x = np.column_stack([x, np.ones(len(x))])
    top, norms = 1 / (ridge * len(x)), (x * x).sum(axis=1)
    w, a, rng = np.zeros(x.shape[1]), np.zeros(len(x)), np.random.default_rng(0)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * (w @ x[i]) - 1
            worst = max(worst, -slope if a[i] < top else 0.0, slope if a[i] > 0 else 0.0)
            new = min(max(a[i] - slope / norms[i], 0.0), top)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
        if worst < enough:
            break
    return w


def _separator(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["position", "y"], kind="stable")
    w = hinge(np.stack(group["v"]).astype(np.float64), group["y"].to_numpy())
    return pd.DataFrame({"level": group["level"].iloc[:1], "one": group["one"].iloc[:1], "two": group["two"].iloc[:1], "weights": [w[:-1]], "bias": w[-1]})


def _votes(points: DataFrame, groups: list[tuple[str, list[str]]]) -> list[Vote]:
    """A ``Vote`` for each (column, classes), all their separators fitted in one job.

    A separator's rows are two classes' samples, so no task has more than these.
    """
    wanted = [(column, one, two) for column, classes in groups for one, two in combinations(classes, 2)]
    if not wanted:
        return [Vote(classes, np.empty((0, DIMENSIONS), np.float32), np.empty(0, np.float32)) for _, classes in groups]
    sides = small_table(points.sparkSession, [(c, one, two, own, y) for c, one, two in wanted for own, y in ((one, 1.0), (two, -1.0))], "level string, one string, two string, own string, y double")
    # a family's sample is as large as a language's: the languages in it share it
    levels = points.select("v", "position", F.explode(F.array(F.struct(F.lit("lang").alias("level"), F.col("lang").alias("own"), F.lit(True).alias("used")), F.struct(F.lit("family").alias("level"), F.col("family").alias("own"), (F.col("turn") * F.col("members") < 1).alias("used")))).alias("x"))
    rows = levels.select("v", "position", "x.*").filter("used").join(F.broadcast(sides), ["level", "own"])  # two rows for each separator
    fitted = rows.select("level", "one", "two", "y", "position", "v").groupBy("level", "one", "two").applyInPandas(_separator, "level string, one string, two string, weights array<float>, bias double")
    known = {(r["level"], r["one"], r["two"]): r for r in fitted.collect()}  # DIMENSIONS floats for each separator
    votes = []
    for column, classes in groups:
        own = [known[column, one, two] for one, two in combinations(classes, 2)]
        votes.append(Vote(classes, np.array([r["weights"] for r in own], dtype=np.float32), np.array([r["bias"] for r in own], dtype=np.float32)))
    return votes


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from ``labelled`` (order, text, lang); None if no row has a letter.

    Each language gives about ``sample`` rows, chosen by a hash of ``order``, and each
    family about as many: the only bounds in this module. A language that has fewer
    gives all.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    share = rows.groupBy("lang").count().select("lang", (F.lit(float(sample)) / F.col("count")).alias("share"))
    place = lambda *key: F.pmod(F.xxhash64("order", *key), F.lit(1 << 30)) / float(1 << 30)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["lang", "position", "turn"]].assign(v=[features(t) for t in batch["text"]]).dropna(subset="v")

    # one row for each language: far under any broadcast limit
    chosen = rows.join(F.broadcast(share), "lang").filter(place() < F.col("share")).select("lang", place().alias("position"), place(F.lit("family")).alias("turn"), "text")
    points = stored(chosen.mapInPandas(trimmed(vectors), "lang string, position double, turn double, v array<float>"), "language-sample")
    known = sorted((FAMILY.get(r["lang"], r["lang"]), r["lang"]) for r in points.select("lang").distinct().collect())
    if not known:
        return None
    families = sorted({f for f, _ in known})
    members = {f: [code for g, code in known if g == f] for f in families}
    kinds = small_table(labelled.sparkSession, [(code, f, len(own)) for f, own in members.items() for code in own], "lang string, family string, members int")
    top, *within = _votes(points.join(F.broadcast(kinds), "lang"), [("family", families), *(("lang", members[f]) for f in families)])
    return Model(top, within)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1).

    A null text, one without a letter, and every text if nothing was learned get
    ``und`` with score 0. Columns of these names in ``docs`` give way to the new ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS floats for each pair

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from trimmed(guesses)(batches)

    def guesses(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            out = []
            for a in range(0, len(texts), 256):
                found = [features(t) for t in texts.iloc[a : a + 256]]
                some = [i for i, x in enumerate(found) if x is not None and known is not None]
                names, scores = known.predict(np.stack([found[i] for i in some])) if some else ([], [])
                part = [(UNKNOWN, 0.0)] * len(found)
                for i, name, score in zip(some, names, scores, strict=True):
                    part[i] = (name, float(score))
                out += part
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    once = guess.asNondeterministic()  # or a filter on what it returns would compute it again
    return docs.select(*kept, once(F.col(text_col)).alias("_guess")).select(*kept, "_guess.lang_pred", "_guess.score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Learns from the rows that are not held out and have a label; neither label,
    id nor any other column enters a prediction. A null id is held out. Empty
    tables give empty results; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("held_out"))
    model = fit(rows.filter(~F.col("held_out")).select(F.col("doc_id").alias("order"), "text", "lang"), sample)
    return predict(rows.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")
