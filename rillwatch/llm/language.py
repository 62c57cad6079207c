"""Language of texts: script ranges, word scores, and Viterbi over the words with a switching penalty.

Learning counts hashed character n-grams of words by language, and the scripts of their letters. A word's score for a
language is the smoothed log-likelihood of its n-grams; languages that don't use the word's script are no candidates.
Viterbi finds the sequence of languages, one per word, with the best sum of scores less a penalty for each switch: spans of
mixed-language text. A text's language is the one whose spans hold the most letters.

The model has one number per language and bucket of n-grams, whatever the size of the corpus.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
SMOOTHING = 0.5
#: n-grams of three orders overlap: a word's evidence is not their whole sum.
EVIDENCE = 0.4
SWITCH = 8.0
#: A language uses a script that has this share of its letters.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
_AWAY = -25.0  # for a candidate without the script
_CELLS = 1 << 23  # words times languages in one Viterbi table
_WORDS = 40_000  # distinct words whose n-grams are made at a time

# First code points of script ranges (Unicode blocks), in order; what lies between is "other".
SCRIPTS = [(0x41, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"),
           (0x700, "Syriac"), (0x750, "Arabic"), (0x780, "Thaana"), (0x7C0, "other"), (0x8A0, "Arabic"), (0x900, "Devanagari"),
           (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"),
           (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"),
           (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1780, "Khmer"),
           (0x1800, "Mongolian"), (0x18B0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"),
           (0x2C80, "other"), (0x2DE0, "Cyrillic"), (0x2E00, "other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "other"),
           (0x3130, "Hangul"), (0x3190, "other"), (0x31F0, "Kana"), (0x3200, "other"), (0x3400, "Han"), (0xA000, "other"),
           (0xA640, "Cyrillic"), (0xA6A0, "other"), (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"),
           (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "other"),
           (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "other"), (0x20000, "Han"),
           (0x32000, "other")]
_NAMES = sorted({name for _, name in SCRIPTS})
_FROM = np.array([0] + [c for c, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index("other")] + [_NAMES.index(name) for _, name in SCRIPTS])


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class WordFeatures:
    """Buckets and scripts of a list of distinct words, as arrays over all their n-grams and letters."""

    def __init__(self, words: list[str]):
        points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        keep = _letters()[points] | (points == 10)
        points = points[keep].astype(np.uint64)
        edge = points == 10
        word = np.cumsum(edge) - 1
        self.letter_word = word[~edge]
        self.letter_script = _SCRIPT[np.searchsorted(_FROM, points[~edge], side="right") - 1]
        buckets, owners = [], []
        for n in ORDERS:
            count = len(points) - n + 1
            if count <= 0:
                continue
            mixed = np.full(count, n, dtype=np.uint64)
            broken = np.zeros(count, dtype=bool)
            for k in range(n):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + points[k:k + count]
                if 0 < k < n - 1:
                    broken |= edge[k:k + count]
            broken |= edge[:count] & edge[n - 1:n - 1 + count] & (n == 2)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((mixed[~broken] >> np.uint64(40)) & np.uint64(BUCKETS - 1))
            owners.append(word[:count][~broken])
        empty = np.empty(0, dtype=np.int64)
        self.bucket = np.concatenate(buckets).astype(np.int64) if buckets else empty
        self.owner = np.concatenate(owners) if owners else empty
        self.n = len(words)


def _words_by_language(batch: pa.RecordBatch) -> dict[str, Counter]:
    words: dict[str, Counter] = defaultdict(Counter)
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        words[lang].update(text.lower().split())
    return words


def _training_counts(docs: DataFrame) -> DataFrame:
    """(lang, slot, n): n-gram buckets, then one slot per script. One row per batch, language and slot before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, np.ndarray] = {}
            words = ((lang, counts) for part in slices(batch) for lang, counts in _words_by_language(part).items())
            for lang, counts in words:
                slots, known = found.setdefault(lang, np.zeros(BUCKETS + len(_NAMES))), list(counts)
                all_times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
                for i in range(0, len(known), _WORDS):
                    features, times = WordFeatures(known[i:i + _WORDS]), all_times[i:i + _WORDS]
                    slots[:BUCKETS] += np.bincount(features.bucket, weights=times[features.owner], minlength=BUCKETS)
                    slots[BUCKETS:] += np.bincount(features.letter_script, weights=times[features.letter_word], minlength=len(_NAMES))
            for lang, slots in found.items():
                used = np.flatnonzero(slots)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)),
                                                  pa.array(slots[used].astype(np.int64))], ["lang", "slot", "n"])

    return docs.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Word scores by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        grams, scripts = counts[:, :BUCKETS] + SMOOTHING, counts[:, BUCKETS:]
        self.score = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32) if languages else np.empty((BUCKETS, 0), np.float32)
        self.uses = (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T  # script by language

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, letters): a row of scores for each word, zero where it has no letter, and its number of letters."""
        parts = [self._some_words(words[i:i + _WORDS]) for i in range(0, len(words), _WORDS)]
        return np.concatenate([s for s, _ in parts]), np.concatenate([n for _, n in parts])

    def _some_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        f = WordFeatures(words)
        letters = np.bincount(f.letter_word, minlength=f.n)
        scores = np.stack([np.bincount(f.owner, weights=self.score[f.bucket, k], minlength=f.n) for k in range(len(self.languages))],
                          axis=1) * EVIDENCE
        script = np.zeros(f.n, dtype=np.int64)
        script[f.letter_word[::-1]] = f.letter_script[::-1]  # of a word's first letter
        candidate = self.uses[script]
        scores -= scores.max(axis=1, keepdims=True)
        scores = np.where(candidate | ~candidate.any(axis=1, keepdims=True), scores, _AWAY)
        scores[letters == 0] = 0
        return scores.astype(np.float32), letters


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of every word. ``scores`` holds the words of all texts one after another; texts advance together."""
    n, states = len(lengths), scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if n else 0) + 1), side="right")  # texts longer than t words
    came = np.empty((len(scores), states), dtype=np.uint16)
    best = np.zeros((n, states), dtype=np.float32)
    own = np.arange(states, dtype=np.uint16)[None, :]
    for t, k in enumerate(active.tolist()):
        v = best[:k]
        top = v.argmax(axis=1)
        switched = v[np.arange(k), top] - penalty
        stay = v >= switched[:, None]
        at = starts[:k] + t
        came[at] = np.where(stay, own, top[:, None].astype(np.uint16))
        best[:k] = np.maximum(v, switched[:, None]) + scores[at]
    path = np.empty(len(scores), dtype=np.uint16)
    state = best.argmax(axis=1).astype(np.uint16)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        path[at] = state[:k]
        state[:k] = came[at, state[:k]]
    return path


def _batch_paths(model: LanguageModel, texts: list[str]) -> Iterator[tuple[int, list[list[str]], np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, words of each, lengths, letters per word, language per word) for runs of texts of bounded size."""
    most = max(1, _CELLS // max(1, len(model.languages)))
    i = 0
    while i < len(texts):
        first, words, total = i, [], 0
        while i < len(texts) and (not words or total < most):
            words.append(texts[i].lower().split())
            total += len(words[-1])
            i += 1
        known: dict[str, int] = defaultdict()
        known.default_factory = known.__len__
        index = np.fromiter((known[w] for found in words for w in found), dtype=np.int64, count=total)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if total:
            scores, letters = model.words(list(known))
            yield first, words, lengths, letters[index], viterbi(scores[index], lengths)
        else:
            yield first, words, lengths, np.empty(0, np.int64), np.empty(0, np.uint16)


def predict(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the language with the most letters, and its share of them."""
    names, shares = [], []
    for _, _, lengths, letters, path in _batch_paths(model, texts):
        text = np.repeat(np.arange(len(lengths)), lengths)
        states = len(model.languages)
        table = np.bincount(text * states + path, weights=letters, minlength=len(lengths) * states).reshape(len(lengths), states)
        total = table.sum(axis=1)
        names += [model.languages[k] if n else UNKNOWN for k, n in zip(table.argmax(axis=1), total)]
        shares.append(table.max(axis=1) / np.maximum(total, 1))
    return names, np.concatenate(shares) if shares else np.empty(0)


def spans(model: LanguageModel, text: str) -> list[tuple[str, str]]:
    """(language, words) of each span of a text, in order."""
    out: list[tuple[str, list[str]]] = []
    for _, words, _, _, path in _batch_paths(model, [text]):
        for word, k in zip(text.split(), path):
            if not out or out[-1][0] != model.languages[k]:
                out.append((model.languages[k], []))
            out[-1][1].append(word)
    return [(lang, " ".join(words)) for lang, words in out]


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from all rows with a text and a language. The driver gets one count per language and slot."""
    docs = df.select(text_of(F.col(f"`{text_col}`")).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("lang IS NOT NULL")
    found = _training_counts(docs).toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((len(languages), BUCKETS + len(_NAMES)))
    if languages:
        encoded = found.column("lang").combine_chunks().dictionary_encode()
        to_row = np.array([languages.index(x) for x in encoded.dictionary.to_pylist()])
        rows = to_row[encoded.indices.to_numpy()]
        counts[rows, found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return LanguageModel(languages, counts)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from the rows that are not held out and have a language; predicts every text from its words alone. Null text, and
    text without a letter, is ``und`` with score 0; so is every text if there is nothing to learn from. Repeated rows give
    repeated results; an empty table gives no rows; further columns are not read.
    """
    doc_id = F.col(f"`{id_col}`").cast("long")
    model = df.sparkSession.sparkContext.broadcast(learn(df.filter(~held_out(doc_id)), text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column("text").to_pylist()
            if model.value.languages:
                names, shares = predict(model.value, texts)
            else:
                names, shares = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()),
                                              pa.array(shares.astype(np.float64))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = df.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), text_of(F.col(f"`{text_col}`")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
