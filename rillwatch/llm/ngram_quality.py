"""Quality by a modified Kneser-Ney language model of trusted text.

The model predicts the characters of words from up to four characters before them: order five, interpolated, with three
discounts per order; a word that repeats the one before it is one character, a ditto mark. It is trained on every trusted document but a quarter, which is held back: the quantiles of the
perplexity in that quarter are the thresholds, one per language.

Counts stay in Spark. Each batch of documents sends its distinct character windows; all windows that occur in the corpus are
joined with the sharded count tables, order by order, which gives each its probability. To score, the probabilities are
split by hash into shards of bounded size; one shard after another is broadcast, and the documents add up what it holds of
their windows. The tables grow with the corpus; a task holds one batch and one shard.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import pin
from .bloom import within, without
from .common import join_checked, slices, text_of

ORDER = 5
QUANTILE = 0.995
#: Held-back documents of a language that weigh as much as those of all languages together in its threshold.
PRIOR_DOCUMENTS = 50
#: Windows in a shard, on average: 12 bytes each in a broadcast.
SHARD_WINDOWS = 4_000_000
#: Distinct words whose windows are made at a time: bounds a task's arrays.
WORDS_AT_A_TIME = 20_000
START, END = "\x02", "\x03"
#: Stands for a word that is the same as the one before it: rare in trusted text, the rule in spun-out junk.
DITTO = "\x04"


def held_back(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.concat(F.lit("held:"), doc_id.cast("string")).cast("binary")), F.lit(4)) == 0


def words_of(text: str) -> list[str]:
    words = text.split()
    return words[:1] + [DITTO if a == b else b for a, b in zip(words, words[1:])]


class Windows:
    """The windows of ``ORDER`` characters of distinct words, padded in front, with an end mark: one per character and end."""

    def __init__(self, words: list[str]):
        pad = START * (ORDER - 1)
        points = np.frombuffer("".join(f"{pad}{w}{END}" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(sizes + ORDER) - sizes - ORDER
        self.word = np.repeat(np.arange(len(words)), sizes + 1)
        first = np.cumsum(sizes + 1) - sizes - 1
        self.at = np.arange(len(self.word)) - np.repeat(first, sizes + 1) + np.repeat(starts, sizes + 1)
        self.points, self.sizes = points, sizes + 1
        self.keys = window_keys([points[self.at + k] for k in range(ORDER)])

    def characters(self, chosen: np.ndarray) -> np.ndarray:
        """The code points of some windows, a row for each."""
        return np.stack([self.points[self.at[chosen] + k] for k in range(ORDER)], axis=1)


def window_keys(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key for each window, from its characters."""
    mixed = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        mixed = (mixed + c.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def _merged(keys: list, rows: list, sums: list) -> tuple[list, list, list]:
    """Parts with the same windows put together: one part of each."""
    if not keys:
        return keys, rows, sums
    own, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return [own], [np.concatenate(rows)[first]], [np.bincount(inverse, weights=np.concatenate(sums))]


def _window_counts(docs: DataFrame) -> DataFrame:
    """(w, n): windows and how often they occur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, sums = [], [], []
            for part in slices(batch):
                counts: Counter = Counter()
                for text in part.column("text").to_pylist():
                    counts.update(words_of(text))
                words, times = list(counts), np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
                for i in range(0, len(words), WORDS_AT_A_TIME):
                    windows = Windows(words[i:i + WORDS_AT_A_TIME])
                    own, first, inverse = np.unique(windows.keys, return_index=True, return_inverse=True)
                    keys.append(own)
                    rows.append(windows.characters(first))
                    sums.append(np.bincount(inverse, weights=times[i:i + WORDS_AT_A_TIME][windows.word]))
                keys, rows, sums = _merged(keys, rows, sums)
            if keys:
                n = sums[0].astype(np.int64)
                flat = rows[0].tobytes().decode("utf-32-le", "surrogatepass")
                found = [flat[i:i + ORDER] for i in range(0, len(flat), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n)], ["w", "n"])

    return docs.mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """The discounts of counts one, two, and three or more, from how many grams have each count from one to four."""
    by_count = {r["n"]: r["grams"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count("*").alias("grams")).collect()}
    n1, n2, n3, n4 = (by_count.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    more = lambda k, a, b: min(k - 0.1, max(0.1, k - (k + 1) * y * b / a)) if a else 0.5
    return [more(1, n1, n2), more(2, n2, n3), more(3, n3, n4)]


def _discounted(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _log_probabilities(counts: DataFrame, windows: DataFrame) -> DataFrame:
    """(w, logp) for every window of the corpus, seen in training or not.

    ``windows`` gets its terms from the highest order down: p = max(n - D, 0) / N + gamma * (the same, one order lower).
    Lower orders count the different characters in front of a gram instead of its occurrences.
    """
    table, scored, grams = windows, [], counts.select(F.col("w").alias("g"), "n")
    for order in range(ORDER, 0, -1):
        grams = pin(grams)
        d = _discounts(grams)
        context = F.substring("g", 1, order - 1)
        stats = grams.withColumn("c", context).groupBy("c").agg(
            F.sum("n").alias("total"), F.sum(_discounted(F.col("n"), d)).alias("spare"))
        own = F.substring("w", ORDER - order + 1, order)
        held = table.withColumn("g", own).withColumn("c", F.substring("g", 1, order - 1))
        held = held.join(grams, "g", "left").join(stats, "c", "left")
        seen = F.col("total").isNotNull()
        term = F.when(F.col("n").isNotNull(), F.greatest(F.col("n") - _discounted(F.col("n"), d), F.lit(0.0)) / F.col("total")).otherwise(0.0)
        gamma = F.when(seen, F.col("spare") / F.col("total")).otherwise(1.0)
        table = held.select(*table.columns, term.alias(f"p{order}"), gamma.alias(f"r{order}"))
        scored.append(order)
        if order > 1:
            grams = grams.select(F.substring("g", 2, order - 1).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
        else:
            kinds = grams.count() + 1
    p: Column = F.lit(1.0 / kinds)
    for order in range(1, ORDER + 1):
        p = F.col(f"p{order}") + F.col(f"r{order}") * p
    return table.select("w", F.log(p).cast("float").alias("logp"))


def _joined(texts: pa.ChunkedArray) -> str:
    """All texts as one, from their buffer."""
    parts = []
    for chunk in texts.chunks:
        whole = chunk.cast(pa.large_string())
        ends = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset:whole.offset + len(whole) + 1]
        if len(whole) and ends[-1] > ends[0]:
            parts.append(whole.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().decode())
    return "".join(parts)


def _partial_scores(docs: DataFrame, shard: DataFrame) -> DataFrame:
    """(doc_id, logp, n): each document's sum over the windows in one shard, and its number of windows in all."""
    found = shard.toArrow()  # short rows, about SHARD_WINDOWS of them
    points = np.frombuffer(_joined(found.column("w")).encode("utf-32-le"), dtype="<u4").reshape(-1, ORDER)
    keys = window_keys([points[:, k] for k in range(ORDER)])
    order = np.argsort(keys)
    held = docs.sparkSession.sparkContext.broadcast((keys[order], found.column("logp").to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = held.value
        for batch in (part for whole in batches for part in slices(whole)):
            number: dict[str, int] = defaultdict()
            number.default_factory = number.__len__
            lengths, index = [], []
            for t in batch.column("text").to_pylist():
                words = words_of(t)
                lengths.append(len(words))
                index.append(np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)))
            index = np.concatenate(index)
            logp, n = np.zeros(len(lengths)), np.zeros(len(lengths), dtype=np.int64)
            if len(index):
                by_word, sizes, words = np.zeros(len(number)), np.zeros(len(number), dtype=np.int64), list(number)
                for i in range(0, len(words), WORDS_AT_A_TIME):
                    part = words[i:i + WORDS_AT_A_TIME]
                    windows = Windows(part)
                    at = np.minimum(np.searchsorted(keys, windows.keys), max(len(keys) - 1, 0))
                    value = np.where(keys[at] == windows.keys, values[at], 0.0) if len(keys) else np.zeros(len(windows.keys))
                    by_word[i:i + len(part)] = np.bincount(windows.word, weights=value, minlength=len(part))
                    sizes[i:i + len(part)] = windows.sizes
                doc = np.repeat(np.arange(len(lengths)), lengths)
                logp = np.bincount(doc, weights=by_word[index], minlength=len(lengths))
                n = np.bincount(doc, weights=sizes[index], minlength=len(lengths)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("lang"), pa.array(logp), pa.array(n)],
                                             ["row", "doc_id", "lang", "logp", "n"])

    return docs.mapInArrow(run, "row long, doc_id long, lang string, logp double, n long")


def perplexities(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """One pinned row per input row: doc_id, lang, n (characters and word ends), logp, trained (whether it was trained on).

    ``trusted`` has the ids to learn from. A text without words has n = 0.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("text"),
                     F.col(f"`{lang_col}`").cast("string").alias("lang"))
    fit = pin(trusted.select(F.col(trusted.columns[0]).cast("long").alias("doc_id")).filter(~held_back(F.col("doc_id"))).distinct())
    counts = pin(_window_counts(within(docs, "doc_id", fit)))
    windows = pin(_window_counts(docs).select("w"))
    table = pin(_log_probabilities(counts, windows))
    shards = max(1, -(-table.count() // shard_windows))
    numbered = docs.withColumn("row", F.monotonically_increasing_id() if shards > 1 else F.lit(0).cast("long"))
    parts = [_partial_scores(numbered, table.filter(F.pmod(F.xxhash64("w"), F.lit(shards)) == s)) for s in range(shards)]
    if shards == 1:
        scores = pin(parts[0].drop("row"))
    else:  # one shard after another: its pass is over and pinned before the next is broadcast
        parts = [pin(p) for p in parts]
        summed = reduce(DataFrame.unionAll, parts).groupBy("row", "doc_id", "lang").agg(F.sum("logp").alias("logp"), F.max("n").alias("n"))
        scores = pin(summed.drop("row"))
    return scores


def _limits(judged: DataFrame, quantile: float) -> tuple[DataFrame, float | None]:
    """(key, own_limit) of every language with held-back documents (rows of ``judged``, pinned), and the limit of any other.

    A language's middle is its mean, drawn to the mean over all by ``PRIOR_DOCUMENTS`` documents of that mean. Its limit moves
    evenly from that of all languages (the quantile of the distances from the middles, above its own middle) to the quantile of
    its own documents, as it has more of them: one rule at every size.
    """
    mean = judged.agg(F.avg("bits").alias("m")).first()["m"]  # one number
    if mean is None:
        return judged.select("key", F.col("bits").alias("own_limit")), None
    docs = F.count("*")
    middle = (F.sum("bits") + PRIOR_DOCUMENTS * mean) / (docs + PRIOR_DOCUMENTS)
    middles = pin(judged.groupBy("key").agg(docs.alias("docs"), middle.alias("middle"), _quantile("bits", quantile).alias("own")))
    away = join_checked(judged, middles, ["key"]).withColumn("away", F.col("bits") - F.col("middle"))
    common = away.agg(_quantile("away", quantile).alias("q")).first()["q"]  # one number
    share = F.col("docs") / (F.col("docs") + PRIOR_DOCUMENTS)
    limit = share * F.col("own") + (1 - share) * (F.col("middle") + common)
    return middles.select("key", limit.alias("own_limit")), mean + common


def _quantile(column: str, quantile: float) -> Column:
    return F.percentile_approx(column, F.lit(quantile), F.lit(20_000))


def classify(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             quantile: float = QUANTILE, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """One row per input row: doc_id, lang, n_symbols, log_prob, perplexity (per character), threshold, kept.

    A document is kept if its perplexity is at most the ``quantile`` of the held-back trusted documents of its language, drawn
    towards that of all languages the more, the fewer those are (``_limits``); a null language is one of its own. A text without words,
    null ones too, has no perplexity and isn't kept. With nothing to learn from, all that have words are kept. Repeated rows
    give repeated results; an empty table gives no rows; further columns are not read.
    """
    scores = perplexities(df, trusted, id_col, text_col, lang_col, shard_windows)
    bits = F.when(F.col("n") > 0, -F.col("logp") / F.col("n"))
    scores = scores.withColumns({"bits": bits, "key": F.coalesce(F.concat(F.lit("l:"), "lang"), F.lit("none"))})
    back = pin(trusted.select(F.col(trusted.columns[0]).cast("long").alias("doc_id")).filter(held_back(F.col("doc_id"))).distinct())
    judged = pin(within(scores.filter("bits IS NOT NULL").select("doc_id", "key", "bits"), "doc_id", back).select("key", "bits"))
    limits, whole = _limits(judged, quantile)
    rows = join_checked(scores, limits, ["key"])
    limit = F.coalesce("own_limit", F.lit(whole).cast("double"))
    return rows.select("doc_id", "lang", F.col("n").alias("n_symbols"), F.col("logp").alias("log_prob"), F.exp("bits").alias("perplexity"),
                       F.exp(limit).alias("threshold"), (F.col("bits").isNotNull() & F.coalesce(F.col("bits") <= limit, F.lit(True))).alias("kept"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents that are labelled good and not toxic."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def drop_rejected(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The input rows that the classifier keeps, all columns kept. Rows that repeat an id go if one of them is rejected;
    a row without an id stays, as no verdict can name it."""
    rejected = classify(df, trusted, id_col, text_col, lang_col).filter("not kept and doc_id IS NOT NULL").select("doc_id").distinct()
    return without(df, id_col, pin(rejected))
