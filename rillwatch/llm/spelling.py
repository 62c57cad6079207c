"""Spelling variants: words one edit apart, found by walking a trie level by level in joins.

The trie is a table of nodes, a prefix with the characters that follow it, written by depth. The frontier is a table of states
(word, position, node, edits). At each level it is joined with the nodes of that depth: a state moves on along the word's next
character; one without an edit also along every other character (that is a replacement), or it skips the word's character and
stays (a deletion, first of a run of equal characters only, so that each pair comes once). A state that has used its edit, is
through with its word and stands on a word is a pair of neighbours: the node is the other word.

Tries are crowded near the root. So every word is entered forwards and backwards, and an edit may only be made in the second
half of a word as it is read: in one of the two it always lies there, and states start at the middle of their own word. An
insertion is a deletion in the other word, and of two words that differ by a replacement the smaller one finds the other.

Words above ``LONGEST`` characters would need as many levels. They are matched by the hashes of all their forms with one
character deleted: words of one edit share such a form, at most one word for each letter of the alphabet meets under it, and
the distance of those that meet is checked.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import pin, work_path
from .common import slices, two_columns

LEAST_LENGTH, LEAST_TIMES = 6, 5
#: A form occurs so many times as often as its variant.
RATIO = 5
#: Characters of a word that the trie holds; longer words are matched by their forms with one character deleted.
LONGEST = 48
#: Runs of a task that are counted before they are sent on.
RUNS_AT_A_TIME = 500_000
#: One of so many runs of a document loses a character.
SLIP = 199

# A-Z in lower case, a-z and U+00C0 to U+00FF as they are, any other byte of Latin-1 a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in Latin-1, A-Z in lower case; any other character ends a run."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def slipped(doc_id: int | None, run: bytes) -> bytes:
    """The run, without one character if 199 divides the checksum of ``<doc_id>:<run>``; a null id is an empty one."""
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    return _slipped(start, run)


def _slipped(start: int, run: bytes) -> bytes:
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n) of the words of at least ``least_length`` code points that occur at least ``least_times`` times in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def held() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in counts]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in (p for whole in batches for p in slices(whole)):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for found, n in Counter(runs_of(text)).items():
                    if len(found) >= least_length:
                        word = _slipped(start, found)
                        if len(word) >= least_length:
                            counts[word] += n
            if len(counts) >= RUNS_AT_A_TIME:
                yield held()
                counts.clear()
        yield held()

    found = two_columns(df, id_col, text_col).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_times)


def _entered(words: DataFrame) -> DataFrame:
    """(word, size, start): every word forwards, marked ``>``, and backwards, marked ``<``; its size, and where its second half starts."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    both = F.array(F.struct(F.concat(F.lit(">"), "word").alias("word"), half.alias("start")),
                   F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("word"), (size - half).alias("start")))
    return words.select(F.explode(both).alias("e"), size.alias("size")).select("e.word", "size", "e.start")


def _character(at: Column) -> Column:
    """A word's character at a position, behind its mark."""
    return F.col("word").substr(at + 2, F.lit(1))


def _nodes(entered: DataFrame, least: int) -> DataFrame:
    """(node, next, ends, depth) from depth ``least`` on: the characters that follow a prefix, and those of them that end a word.

    Written to the shared folder by depth, as each level reads one.
    """
    path = work_path(entered.sparkSession, "trie")
    steps = entered.select("word", "size", F.explode(F.sequence(F.lit(least), F.col("size") - 1)).alias("depth"))
    steps = steps.select(F.col("word").substr(F.lit(1), F.col("depth") + 1).alias("node"), _character(F.col("depth")).alias("char"),
                         (F.col("depth") + 1 == F.col("size")).alias("ends"), "depth")
    edges = steps.groupBy("node", "depth", "char").agg(F.max("ends").alias("ends"))
    nodes = edges.groupBy("node", "depth").agg(F.array_join(F.sort_array(F.collect_list("char")), "").alias("next"),
                                               F.array_join(F.collect_list(F.when(F.col("ends"), F.col("char"))), "").alias("ends"))
    nodes.write.partitionBy("depth").parquet(path)
    return entered.sparkSession.read.schema("node string, next string, ends string, depth int").parquet(path)


def _moved(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """The states that follow: along the word's own character, and without an edit so far along every larger one as well."""
    own = _character(F.col("position"))
    wanted = F.filter(F.split("next", ""), lambda c: (c == own) | ((F.col("edits") == 0) & (c > own)))
    steps = frontier.join(nodes, "node").select("word", "size", "position", "node", "edits", "ends", own.alias("own"), F.explode(wanted).alias("char"))
    return steps.select("word", "size", (F.col("position") + 1).alias("position"), F.concat("node", "char").alias("node"),
                        F.when(F.col("char") == F.col("own"), F.col("edits")).otherwise(1).alias("edits"),
                        (F.instr(F.col("ends"), F.col("char")) > 0).alias("is_word"))


def _deleted(states: DataFrame) -> DataFrame:
    """The states that skip the next character, which in its run is the first of the word: last in a word that is read backwards."""
    own, forwards = _character(F.col("position")), F.col("word").startswith(">")
    before = F.when(forwards, _character(F.col("position") - 1)).otherwise(_character(F.col("position") + 1))
    chosen = states.filter((F.col("edits") == 0) & (F.col("position") < F.col("size")) & (own != before))
    return chosen.withColumns({"position": F.col("position") + 1, "edits": F.lit(1)})


def _trie_pairs(words: DataFrame, least: int, longest: int) -> DataFrame:
    """(word, other): each pair of words of one edit, once; ``least`` and ``longest`` bound their lengths."""
    spark, entered = words.sparkSession, pin(_entered(words))
    nodes = _nodes(entered, least // 2)
    path = work_path(spark, "frontier")
    shape = "word string, size int, position int, node string, edits int, is_word boolean"
    frontier = spark.createDataFrame([], shape)
    for depth in range(least // 2, longest + 1):
        level = nodes.filter(F.col("depth") == depth - 1).drop("depth")
        starts = entered.filter(F.col("start") == depth).select(
            "word", "size", F.lit(depth).alias("position"), F.col("word").substr(1, depth + 1).alias("node"), F.lit(0).alias("edits"), F.lit(False).alias("is_word"))
        states = _moved(frontier, level).unionByName(starts) if depth > least // 2 else starts
        states = states.unionByName(_deleted(states))
        through = F.col("position") == F.col("size")
        states.filter(~through | (F.col("is_word") & (F.col("edits") == 1))).write.parquet(f"{path}/{depth}")
        frontier = spark.read.schema(shape).parquet(f"{path}/{depth}").filter("position < size")
    found = spark.read.schema(shape).parquet(*[f"{path}/{d}" for d in range(least // 2, longest + 1)]).filter("position = size")
    bare = lambda c: F.when(F.col("word").startswith(">"), F.substring(c, 2, longest)).otherwise(F.reverse(F.substring(c, 2, longest)))
    return found.select(bare("word").alias("word"), bare("node").alias("other"))


def shortened(word: str) -> np.ndarray:
    """Hashes of a word and of all its forms with one character deleted, distinct: a sum of powers, so each takes one step."""
    points = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    base, size = 0x9E3779B97F4A7C15, len(points)
    powers = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, base, dtype=np.uint64)]))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(points * powers[:size])])
    rest = (sums[-1] - sums[1:]) * np.uint64(pow(base, -1, 1 << 64))  # what stands behind the deleted one moves up by one
    return np.unique(np.append(sums[:-1] + rest, sums[-1])).view(np.int64)


def _long_pairs(words: DataFrame, longest: int) -> DataFrame:
    """(word, other): each pair of words of one edit of which one at least is longer than ``longest``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in batch.column("word").to_pylist():
                keys = shortened(word)
                at = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(keys), dtype=np.int32)), pa.array([word])).dictionary_decode()
                yield pa.RecordBatch.from_arrays([pa.array(keys), at], ["key", "word"])

    keys = words.filter(F.length("word") >= longest).select("word").mapInArrow(run, "key long, word string")
    both = keys.join(keys.withColumnRenamed("word", "other"), "key").filter(F.col("word") < F.col("other"))
    longer = F.greatest(F.length("word"), F.length("other")) > longest
    return both.select("word", "other").distinct().filter(longer & (F.levenshtein("word", "other", 1) == 1))


def neighbours(words: DataFrame, least_length: int = LEAST_LENGTH, longest: int = LONGEST) -> DataFrame:
    """(word, other): the pairs of distinct ``words`` (column ``word``) that one inserted, deleted or replaced code point parts, once each.

    All words have ``least_length`` code points or more, at least 4. No pair is missed, whatever the lengths.
    """
    if least_length < 4:
        raise ValueError("words need four code points or more")
    held = pin(words.select("word"))
    most = held.agg(F.max(F.length("word")).alias("m")).first()["m"]
    if most is None:
        return held.select("word", F.col("word").alias("other"))
    pairs = _trie_pairs(held.filter(F.length("word") <= longest), least_length, min(most, longest))
    return pairs.unionByName(_long_pairs(held, longest)) if most > longest else pairs


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form of each chain, by jumps that double. Forms grow in number, so there is no cycle."""
    links = pin(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        jumped = pin(links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("far")))
        links = jumped.select("word", "root")
        if not jumped.filter("far").limit(1).count():
            return links


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES,
             ratio: int = RATIO, longest: int = LONGEST) -> DataFrame:
    """One row per word of all texts: word, n, n_near, form, form_n, root.

    A word's form is its neighbour of largest n, then the smallest in code-point order, if that n is ``ratio`` times the word's
    or more. The root is the last of the chain of forms, the word itself where it has none. Null texts have no words; a null id
    counts as an empty one. Repeated rows count as often as they occur; an empty table gives no rows; further columns are not read.
    """
    words = pin(word_counts(df, id_col, text_col, least_length, least_times))
    pairs = neighbours(words, least_length, longest)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    of_other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = both.join(of_other, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best.other", (-F.col("best.less")).alias("other_n"))
    has = F.col("other_n") >= ratio * F.col("n")
    rows = pin(rows.select("word", "n", "n_near", F.when(has, F.col("other")).alias("form"), F.when(has, F.col("other_n")).alias("form_n")))
    return rows.join(_roots(rows.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))
