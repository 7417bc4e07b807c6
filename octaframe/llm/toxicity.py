"""Toxicity by class-conditional Kneser-Ney models.

A word is a sequence of characters between two marks.  Each class has a model
that tells every character of a word from the ORDER - 1 before it, so that a
word never seen is judged by the sequences that it shares with others.  As
Kneser and Ney have it, counts are of contexts: a word counts in a class by the
number of different words before it in labelled rows, so that a passage copied
a thousand times weighs as much as one, and shorter sequences by the number of
different characters before them.  Counts are discounted.  What a class's
discounts free goes to backoff counts that both classes share: those of the
same sequence in all rows, and through these those of ever shorter ones.  So
rare expressions rest on the shared counts and speak for neither class.

A toxic text is ordinary for the most part.  Under its likelihood each word
comes with a share of MIXED from the toxic model, and else from the ordinary
one.  The difference of its logarithm and the ordinary one, over all words of
the text and normalised by the text's length (and by its root, which tells how
sure a difference is), gives the score through a logistic curve, which is
fitted on rows that the counts leave out.

The model goes to all workers if it has at most ``most_entries`` rows.  Beyond,
the different words are scored by joins with the model, and texts by joins with
the words.  Both ways give the same sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, positional, small_batches

FOLDS = 5
#: Folds (of crc32 of the id) that are counted, and the one on which the curve is fitted; fold 0 is held out.
COUNT_FOLDS, FIT_FOLD = (1, 2, 3), 4
#: Characters of a sequence, absolute discount, and share of a toxic text's words that come from the toxic model.
ORDER, DISCOUNT, MIXED = 5, 0.75, 0.02
#: Rows that fit the curve, and rows of a model that goes to all workers (of 16 bytes each there).
MAX_FITTED, MOST_ENTRIES = 50_000, 3_000_000
#: Tokens that are counted at once, and words whose scores a worker remembers (a word has at most 64 characters).
PIECE, REMEMBERED = 1 << 19, 200_000
BEGIN, END = "\x02", "\x03"
#: Words; longer ones are taken in pieces.
_TOKEN = re.compile(r"\w{1,64}")


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS))


def words_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different (word, word before it) of a piece of a partition, with the classes that have them (1 ordinary, 2 toxic)."""
    number: dict[str, int] = {}
    hashes: list[int] = []
    held: list[np.ndarray] = []
    n = 0

    def flush() -> pa.RecordBatch:
        order = np.argsort(np.array(list(number), dtype=object), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows = np.concatenate(held)
        word, before, bad = place[rows[:, 1]], rows[:, 0], rows[:, 2]
        before = np.where(before < 0, 0, np.array(hashes, dtype=np.int64)[before])
        order2 = np.lexsort((before, word))
        word, before, bad = word[order2], before[order2], bad[order2]
        new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (before[1:] != before[:-1])])
        classes = np.bitwise_or.reduceat(bad, new)
        names = pa.array(list(number), pa.string()).take(pa.array(order[word[new]]))
        return pa.RecordBatch.from_arrays(
            [names, pa.array(before[new].astype(np.int32)), pa.array(classes.astype(np.int8))], names=["w", "h", "c"]
        )

    for b in batches:
        for text, bad in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = words_of(text)
            for at in range(0, len(words), PIECE):
                part = words[at : at + PIECE]
                for w in part:
                    if w not in number:
                        number[w] = len(hashes)
                        hashes.append(xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) - (1 << 31))
                now = np.fromiter((number[w] for w in part), np.int64, len(part))
                first = number[words[at - 1]] if at and words[at - 1] in number else -1
                held.append(np.stack([np.r_[first, now[:-1]], now, np.full(len(now), 2 if bad else 1)], axis=1))
                n += len(part)
                if n >= PIECE:
                    yield flush()
                    number, hashes, held, n = {}, [], [], 0
    if n:
        yield flush()


def _word_counts(rows: DataFrame) -> DataFrame:
    """Stored counts of rows (text, toxic): word, and its different contexts in toxic and in ordinary rows."""
    pairs = rows.mapInArrow(_counted, "w string, h int, c tinyint").groupBy("w", "h").agg(F.bit_or("c").alias("c"))
    toxic, ordinary = F.count_if(F.col("c") >= 2), F.count_if(F.col("c") % 2 == 1)
    return cut(pairs.groupBy("w").agg(toxic.alias("t"), ordinary.alias("o")), "tox-words")


def grams_of(word: Column) -> Column:
    """For each character of a word and its end, the sequence of at most ORDER characters that ends there."""
    whole = F.concat(F.lit(BEGIN), word, F.lit(END))
    first = lambda i: F.greatest(F.lit(1), i - (ORDER - 1))
    return F.transform(F.sequence(F.lit(2), F.length(whole)), lambda i: F.substring(whole, first(i), i - first(i) + 1))


def _shared(grams: DataFrame) -> DataFrame:
    """(s, p): smoothed shares of each sequence of up to ORDER - 1 characters among those of equal beginning, by what comes before."""
    ends = F.transform(F.sequence(F.lit(1), F.length("g")), lambda k: F.right("g", k))
    seen = grams.select(F.explode(ends).alias("u")).distinct()
    counts = seen.where(F.length("u") > 1).groupBy(F.substring("u", F.lit(2), F.lit(ORDER)).alias("s")).agg(F.count("*").alias("n"))
    same = Window.partitionBy(F.left("s", F.length("s") - 1))
    counts = counts.withColumns({"all": F.sum("n").over(same), "kinds": F.count("*").over(same)})
    counts = cut(counts.withColumn("k", F.length("s")), "tox-shorter")
    share = lambda low: F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("all") + DISCOUNT * F.col("kinds") / F.col("all") * low
    letters = counts.where("k = 1")
    parts = [letters.select("s", share(1.0 / (1 + F.col("kinds"))).alias("p"))]
    for k in range(2, ORDER):
        low = parts[-1].select(F.col("s").alias("x"), F.col("p").alias("low"))
        now = counts.where(F.col("k") == k).join(low, F.substring("s", F.lit(2), F.lit(ORDER)) == F.col("x"))
        parts.append(cut(now.select("s", share(F.col("low")).alias("p")), "tox-shares"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _model(words: DataFrame) -> DataFrame:
    """Stored model (g, at_end, llr) of word counts.

    at_end: the log-likelihood ratio of the last character of the sequence g
    after the others; else that of any character that was never seen after g.
    """
    grams = words.select(F.explode(grams_of(F.col("w"))).alias("g"), "t", "o").groupBy("g").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    grams = cut(grams, "tox-grams")
    before = Window.partitionBy("b")
    sums = {"ct": F.sum("t"), "co": F.sum("o"), "kt": F.count_if(F.col("t") > 0), "ko": F.count_if(F.col("o") > 0), "k": F.count("*")}
    full = grams.withColumn("b", F.left("g", F.length("g") - 1)).withColumns({n: x.over(before) for n, x in sums.items()})
    low = _shared(grams).select(F.col("s").alias("x"), F.col("p").alias("low"))
    full = full.join(low, F.substring("g", F.lit(2), F.lit(ORDER)) == F.col("x"))
    n, c = F.col("t") + F.col("o"), F.col("ct") + F.col("co")
    both = F.greatest(n - DISCOUNT, F.lit(0.0)) / c + DISCOUNT * F.col("k") / c * F.col("low")
    rest = lambda x: F.when(F.col(f"c{x}") > 0, DISCOUNT * F.col(f"k{x}") / F.col(f"c{x}")).otherwise(F.lit(1.0))
    p = lambda x: F.when(F.col(f"c{x}") > 0, F.greatest(F.col(x) - DISCOUNT, F.lit(0.0)) / F.col(f"c{x}")).otherwise(0.0) + rest(x) * both
    ends = full.select("g", F.lit(True).alias("at_end"), F.log(p("t") / p("o")).alias("llr"))
    contexts = full.groupBy("b").agg(F.first(F.log(rest("t") / rest("o"))).alias("llr"))
    return cut(ends.union(contexts.select("b", F.lit(False), "llr")), "tox-model")


def _mixed(llr):
    """Log-likelihood ratio of a word of a toxic text, of which MIXED come from the toxic model."""
    return np.log1p(MIXED * np.expm1(np.minimum(llr, 500.0)))


def _fold_in(acc: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
        return x ^ (x >> np.uint64(32))


def _points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, and the place of each within its string."""
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    return flat, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _keys(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character: its place in its string, the key of the characters before it, and the key with it."""
    flat, place = _points(strings)
    acc = np.zeros(len(flat), np.uint64)
    for j in range(ORDER - 1, 0, -1):
        old = np.r_[np.zeros(min(j, len(flat)), np.uint32), flat[:-j]]
        acc = np.where(place >= j, _fold_in(acc, old), acc)
    return place, acc, _fold_in(acc, flat)


class Model:
    """A model as sorted keys and values, with the scores of words that were met."""

    def __init__(self, ends: list[str], end_llr: np.ndarray, contexts: list[str], context_llr: np.ndarray):
        self.tables = []
        for strings, llr in ((ends, end_llr), (contexts, context_llr)):
            place, _, with_last = _keys(strings)
            last = np.flatnonzero(np.r_[place[1:] == 0, True]) if len(place) else np.zeros(0, np.int64)
            order = np.argsort(with_last[last])
            self.tables.append((with_last[last][order], llr[order]))
        self.known: dict[str, float] = {}

    def _found(self, table: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, llr = self.tables[table]
        if not len(have):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        hit = have[at] == keys
        return hit, np.where(hit, llr[at], 0.0)

    def word_llrs(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each word, the sum over its characters and its end."""
        place, context, whole = _keys([BEGIN + w + END for w in words])
        hit, llr = self._found(0, whole)
        llr = np.where(hit, llr, self._found(1, context)[1])
        llr[place == 0] = 0.0
        return np.add.reduceat(llr, np.flatnonzero(place == 0)) if len(words) else np.zeros(0)

    def sums(self, texts: list[str | None]) -> tuple[list[float], list[int]]:
        """Of each text the sum over its words, and their number."""
        split = [words_of(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for words in split for w in words if w not in self.known})
        for at in range(0, len(new), 1 << 15):
            part = new[at : at + (1 << 15)]
            self.known.update(zip(part, _mixed(self.word_llrs(part)).tolist(), strict=True))
        return [sum(map(self.known.__getitem__, words)) for words in split], [len(words) for words in split]


def _summed(model, text: int, kept: int):
    """The first ``kept`` columns with the sum over the words of column ``text`` and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                total, n = m.sums(b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:kept], pa.array(total, pa.float64()), pa.array(n, pa.int64())], names=[*b.schema.names[:kept], "_sum", "_n"]
                )

    return run


def _bags(text: int, kept: int):
    """The first ``kept`` columns with each different word of column ``text`` and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                kinds, n = np.unique(np.array(words_of(b.column(text)[i].as_py()), dtype=object).astype(str), return_counts=True)
                same = pa.array(np.full(len(kinds), i))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(same) for c in b.columns[:kept]), pa.array(kinds.tolist(), pa.string()), pa.array(n, pa.int64())],
                    names=[*b.schema.names[:kept], "_w", "_k"],
                )

    return run


def _joined(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows (_r, _text), _r different in all -> (_r, _sum, _n) of those with words, by joins alone.

    Words that hold a thousandth of all rows are at most a thousand and meet
    their scores in a broadcast table, all others in a shuffle.
    """
    bags = cut(rows.select("_r", "_text").mapInArrow(_bags(1, 1), "_r long, _w string, _k long"), "tox-bags")
    vocabulary = cut(bags.groupBy("_w").agg(F.count("*").alias("_d")), "tox-vocabulary")
    spread = vocabulary.select("_w", F.posexplode(grams_of(F.col("_w"))).alias("_p", "_g"))
    ends = model.where("at_end").select(F.col("g").alias("_g1"), F.col("llr").alias("_e"))
    contexts = model.where("not at_end").select(F.col("g").alias("_g2"), F.col("llr").alias("_c"))
    spread = spread.join(ends, F.col("_g") == F.col("_g1"), "left")
    spread = spread.join(contexts, F.left("_g", F.length("_g") - 1) == F.col("_g2"), "left")
    llr = F.sum(F.coalesce("_e", "_c", F.lit(0.0)))
    scored = spread.groupBy("_w").agg(F.log1p(MIXED * F.expm1(F.least(llr, F.lit(500.0)))).alias("_v"))
    scored = cut(scored.withColumnRenamed("_w", "_x"), "tox-scored")
    often = vocabulary.where(F.col("_d") >= max(1, bags.count() // 1000)).select(F.col("_w").alias("_y"))
    hot = F.broadcast(cut(often.join(scored, F.col("_y") == F.col("_x")).select("_y", "_v"), "tox-often"))
    few = bags.join(hot, F.col("_w") == F.col("_y")).select("_r", "_k", "_v")
    rest = bags.join(hot, F.col("_w") == F.col("_y"), "left_anti").join(scored, F.col("_w") == F.col("_x")).select("_r", "_k", "_v")
    return few.union(rest).groupBy("_r").agg(F.sum(F.col("_k") * F.col("_v")).alias("_sum"), F.sum("_k").alias("_n"))


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression with intercept, by Newton steps with a small ridge on standardised columns."""
    middle, width = x.mean(axis=0), x.std(axis=0) + 1e-12
    a = np.c_[np.ones(len(x)), (x - middle) / width]
    beta = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        ridge = np.diag([1e-6] + [1e-2] * x.shape[1])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[1:] / width
    return np.r_[beta[0] - middle @ slopes, slopes]


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    keep: list[str] | None = None,
    max_fitted: int = MAX_FITTED,
    most_entries: int | None = None,
) -> DataFrame:
    """Columns ``keep`` of docs (all, if none are named) with held_out, score, predicted, mean, strength.

    mean is the difference of the log-likelihoods over the number of words,
    strength the same over its root.  Learns from the rows of labels whose fold
    (crc32 of the id as text, mod 5) is not 0; of these, all of the folds
    COUNT_FOLDS are counted, and at most about ``max_fitted`` of the others,
    chosen by a hash, fit the curve.  If an id has several labels the highest
    holds; null labels and ids are ignored.  Repeated rows are scored each, and
    alike; repeated labelled rows add no contexts.  All words of a text count,
    however long it is; words of more than 64 characters are taken in pieces.  A
    text that is null, empty or without words gets the score of no evidence.  A
    null id is not held out.  Without labels of both classes every score is that
    of the base rate (0.0 without labels); a score of exactly one half is
    predicted toxic.  An empty table gives an empty result.  Columns of docs
    with the names of the results are replaced, others are kept whatever their
    names.
    """
    spark, made = docs.sparkSession, ["held_out", "score", "predicted", "mean", "strength"]
    small_batches(spark)
    kept = [c for c in keep or docs.columns if c in docs.columns and (c not in made or c in (id_col, text_col))]
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_l")).agg(F.max(label_col).cast("int").alias("_toxic"))
    known = cut(known.withColumn("_f", fold(F.col("_l"))).where("_f <> 0"), "tox-labels")
    n_fit = known.where(F.col("_f") == FIT_FOLD).count()
    share = F.pmod(F.xxhash64("_l"), F.lit(1 << 30)) / float(1 << 30)
    docs, names = positional(docs)
    id_col, text_col = names[id_col], names[text_col]
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def labelled(some: DataFrame) -> DataFrame:
        few = broadcast_if_small(some, 2_000_000, 48 << 20)
        return texts.join(few, F.col("_id") == F.col("_l")).select("_text", "_toxic")

    counted = known.where(F.col("_f").isin(*COUNT_FOLDS))
    fitted = known.where((F.col("_f") == FIT_FOLD) & (share < max_fitted / max(n_fit, 1)))
    model = _model(_word_counts(labelled(counted)))
    two = counted.agg(F.count_if(F.col("_toxic") > 0), F.count_if(F.col("_toxic") == 0)).first()
    entries = model.count() if min(two) else 0
    small = entries <= (MOST_ENTRIES if most_entries is None else most_entries)
    if small:
        got = model.toArrow() if entries else model.limit(0).toArrow()
        ends = got["at_end"].to_numpy()
        strings, llr = np.array(got["g"].to_pylist(), dtype=object), got["llr"].to_numpy().astype(np.float64)
        sent = spark.sparkContext.broadcast(Model(strings[ends].tolist(), llr[ends], strings[~ends].tolist(), llr[~ends]))

    def summed(rows: DataFrame, text: str) -> DataFrame:
        """rows with _sum and _n in place of the column text, which is the last."""
        kinds = [f"{c} {t}" for c, t in rows.dtypes if c != text]
        if small:
            return rows.mapInArrow(_summed(sent, len(kinds), len(kinds)), ", ".join([*kinds, "_sum double", "_n long"]))
        held = cut(rows.withColumn("_r", F.monotonically_increasing_id()), "tox-rows")
        sums = _joined(held.select("_r", F.col(text).alias("_text")), model).withColumnRenamed("_r", "_r2")
        held = held.drop(text).join(sums, F.col("_r") == F.col("_r2"), "left")
        return held.select(*(c for c in rows.columns if c != text), F.coalesce("_sum", F.lit(0.0)).alias("_sum"), F.coalesce("_n", F.lit(0)).alias("_n"))

    def normalised(rows: DataFrame) -> DataFrame:
        n = F.greatest(F.col("_n"), F.lit(1))
        return rows.withColumns({"_mean": F.col("_sum") / n, "_strength": F.col("_sum") / F.sqrt(n.cast("double"))})

    got = normalised(summed(labelled(fitted).select("_toxic", "_text"), "_text")).select("_toxic", "_mean", "_strength").toArrow()
    y = got["_toxic"].to_numpy().astype(np.float64)
    if 0 < y.sum() < len(y):
        beta = _curve(np.c_[got["_mean"].to_numpy(), got["_strength"].to_numpy()], y)
    else:
        rate = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        beta = np.array([np.log(rate / (1 - rate)), 0.0, 0.0])
    held = F.coalesce(fold(F.col(id_col)) == 0, F.lit(False))
    rows = docs.select(*(names[c] for c in kept), held.alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    out = normalised(summed(rows, "_text"))
    z = F.lit(float(beta[0])) + F.col("_mean") * float(beta[1]) + F.col("_strength") * float(beta[2])
    out = out.withColumn("score", 1 / (1 + F.exp(-z)))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return out.select(
        *(F.col(names[c]).alias(c) for c in kept), "held_out", "score", predicted, F.col("_mean").alias("mean"), F.col("_strength").alias("strength")
    )
