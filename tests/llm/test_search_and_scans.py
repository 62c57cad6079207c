"""Ranked search, spelling variants and license scans against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rillwatch.llm import lexical_search, license_scan, spelling

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LONG = "Über 3 words's of a very long text, mit license and on. " * 4000
#: Nulls, empty texts, repeated rows and ids, ties, a very long text, odd characters.
ODD = [(1, "alpha beta gamma"), (2, "alpha beta gamma"), (2, "alpha beta gamma"), (2, "Beta-beta"), (None, "alpha"), (None, None), (3, None), (4, ""),
       (5, " \t\n\x0b\x0c\r"), (6, LONG), (7, LONG), (8, "ÀÉ × ÷ ß İ K 文字 \U0001F600 ＡＢ a\x1cb\x85c"), (-9, "gamma alpha"), (10, "12 34 !!")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "x", 2.0, "y") for i, t in ODD], "doc_id long, text string, term int, item string, score double, word string").repartition(3)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def full_ranking(docs, items, top):
    """(item_id, rank, doc_id, score) from full sums, one document after the other."""
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    df, out = Counter(t for found in terms for t in set(found)), []
    for item_id, text in items:
        wanted, scores = set(TERM.findall((text or "").translate(LOWER))), []
        for (doc_id, _), found in zip(docs, terms):
            tf = Counter(t for t in found if t in wanted)
            m = 100 - 50 + 50 * len(found) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * k // (1000 * k + 20 * m)) for t, k in tf.items())
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1)]
    return Counter(out)


ITEMS = [(1, "Alpha? beta"), (1, "words gamma"), (2, None), (None, "beta beta BETA"), (3, "!!"), (4, "nowhere"), (5, "über 3 文字 a b c 12 on of")]


@pytest.mark.parametrize(("block", "window", "share", "item_bytes"), [(500_000, 4096, 32, 1 << 20), (3, 2, 2, 10), (40, 1, 1_000, 1 << 20), (40, 3, 1, 30)])
def test_search_against_full_sums(spark, odd, monkeypatch, block, window, share, item_bytes):
    """Also with tiny blocks and windows, and with all lists short or all long."""
    monkeypatch.setattr(lexical_search, "WINDOW", window)
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id int, text string, doc_id int, task string")
    got = lexical_search.search(odd, items, 3, item_bytes=item_bytes, block_postings=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == full_ranking(ODD, ITEMS, 3)


@pytest.mark.parametrize(("share", "top"), [(1, 5), (4, 1), (10 ** 9, 20)])
def test_blocks_find_the_best_of_random_lists(monkeypatch, share, top):
    monkeypatch.setattr(lexical_search, "SHORT_SHARE", share)
    monkeypatch.setattr(lexical_search, "WINDOW", 16)
    rng = np.random.default_rng(share % 97)
    best, all_scores = lexical_search.Best(top), []
    wanted = np.array([0, 2, 3, 5, 8, 11])
    for k in range(6):
        held = rng.random((12, 300)) < rng.choice([0.01, 0.2, 0.8], 12)[:, None]
        terms, docs = np.nonzero(held)
        shares = rng.integers(0, 40, len(terms)) * rng.integers(1, 9, 12)[terms]
        ids = rng.permutation(300) + 300 * k
        block = lexical_search.Block(ids, np.zeros(300, dtype=bool), terms, docs, shares, 12)
        own = wanted[block.first[wanted] < block.first[wanted + 1]]
        block.search(own, best)
        sums = np.bincount(docs[np.isin(terms, wanted)], weights=shares[np.isin(terms, wanted)], minlength=300).astype(int)
        all_scores += [(-s, i) for s, i in zip(sums.tolist(), ids.tolist()) if s]
    assert list(zip((-best.scores).tolist(), best.ids.tolist())) == sorted(all_scores)[:top]


def counted_words(docs, least, times):
    counts = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= times}


def near_pairs(words):
    """All pairs, from every word with one character inserted, deleted or replaced."""
    alphabet, pairs = {c for w in words for c in w}, set()
    for w in words:
        for k in range(len(w) + 1):
            edited = [w[:k] + c + w[k:] for c in alphabet] + [w[:k] + c + w[k + 1:] for c in alphabet if k < len(w)] + [w[:k] + w[k + 1:]]
            pairs |= {(min(w, o), max(w, o)) for o in edited if o != w and o in words}
    return pairs


def expected_variants(words, ratio=5):
    near = defaultdict(set)
    for a, b in near_pairs(words):
        near[a].add(b)
        near[b].add(a)
    best = {w: min(near[w], key=lambda o: (-words[o], o)) for w in near}
    form = {w: o for w, o in best.items() if words[o] >= ratio * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()}


def test_runs_and_slips():
    for text in ("ÀÉ×÷ÿ AbC-dÄ文x İK ß'ñ", "", " ", "aĀb", "\ud800x"):
        assert [r.decode("latin-1") for r in spelling.runs_of(text)] == [r.translate(LOWER) for r in RUN.findall(text)]
    assert sum(len(spelling.slipped(k, b"w\xf6rter")) == 5 for k in range(5000)) == sum(zlib.crc32(f"{k}:wörter".encode()) % 199 == 0 for k in range(5000)) > 0


@pytest.mark.parametrize(("longest", "letters", "sizes"), [(48, "ab", (6, 10)), (7, "abc", (6, 9)), (6, "aé", (6, 11)), (9, "ab", (4, 9))])
def test_neighbours_lose_no_pair(spark, longest, letters, sizes):
    rng = random.Random(longest)
    words = {"".join(rng.choices(letters, k=rng.randint(*sizes))) for _ in range(350)} | {"a" * k for k in range(sizes[0], 30)}
    got = spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string"), sizes[0], longest).collect()
    pairs = [(min(r), max(r)) for r in map(tuple, got)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == near_pairs(words)


def test_long_words_meet_by_their_shortened_forms():
    word = "abba" * 3000
    assert len(set(spelling.shortened(word).tolist()) & set(spelling.shortened(word[:5000] + "x" + word[5001:]).tolist())) == 1
    assert spelling.shortened(word[:-1])[0] is not None and np.isin(spelling.shortened(word), spelling.shortened(word[:-1])).any()
    with pytest.raises(ValueError):
        spelling.neighbours(None, 3)


def test_variants_against_brute_force(spark, odd, sf):
    chain = [(100 + k, f"{word} " * n) for k, (word, n) in enumerate({"harbour": 700, "harbor": 130, "harbr": 40, "harboor": 26, "xarboor": 5,
                                                                      "x" * 60: 50, "x" * 59 + "y": 5, "tieone": 30, "tietwo": 30, "tieono": 6}.items())]
    given = spark.createDataFrame(chain, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for df, least, times in ((given, 5, 2), (spark.read.parquet(f"{sf}/documents.parquet"), 6, 5)):
        got = spelling.variants(df, least_length=least, least_times=times).select("word", "n", "n_near", "form", "form_n", "root").collect()
        assert len(got) == len(want := expected_variants(counted_words(rows_of(df), least, times)))
        assert set(map(tuple, got)) == want


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = []
    for phrase, label in license_scan.PHRASES.items():
        size = phrase.count(" ") + 1
        places += [(k, label) for k in range(len(words)) if " ".join(words[k:k + size]) == phrase]
    return len(words), places


TEXTS = ["Released under the MIT License.", "mit-LICENSE mit license cc by cc by", "Licensed under the Apache Licence, Version 2.0", "cc, by; permit license",
         "gnu general publik license", "Licensed under CC BY-NC 4.0.", "LICENSED UNDER THE GNU  GENERAL\nPUBLIC LICENSE",
         "Permission is herby granted, free of charge, to any person obtaning a copy of this software", "released under the bsd license"]


def test_scan_digest(spark, odd, sf):
    rows = ODD + [(200 + k, t) for k, t in enumerate(TEXTS)]
    given = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, spans string")
    for df in (given, spark.read.parquet(f"{sf}/documents.parquet")):
        want = Counter()
        for doc_id, text in rows_of(df):
            n, places = base_places(text)
            at = [k for k, _ in places]
            want[doc_id, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))] += 1
        got = license_scan.summary(license_scan.scan(df)).collect()
        assert Counter(tuple(r)[:6] for r in got) == want
        for r in got:
            assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
            assert (r["score"] > 0) == bool(r["labels"]) and r["score"] <= 1 and (not r["n_base"] or r["score"] == 1)
    labels = {r["doc_id"]: r["labels"] for r in license_scan.summary(license_scan.scan(given)).collect()}
    assert [labels[200 + k] for k in range(len(TEXTS))] == ["mit", "cc-by,mit", "apache", "cc-by", "", "cc-by,cc-by-nc", "gpl", "mit", "bsd"]


def least_edits(notice, text):
    """The fewest edits between the notice and any run of whole words of the text."""
    best = len(notice)
    starts = [k + 1 for k, c in enumerate(text) if c == " "][:-1]
    for a in starts:
        row = list(range(len(notice) + 1))
        for b in range(a, min(len(text) - 1, a + 2 * len(notice))):
            last, row[0] = row[0], row[0] + 1
            for k, c in enumerate(notice, 1):
                last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (c != text[b]))
            if text[b + 1] == " ":
                best = min(best, row[-1])
    return best


def test_fuzzy_search_finds_whatever_is_near_enough():
    rng = random.Random(11)
    notices = [("a", "released under the mit license"), ("b", "under the terms of the gnu general public license as published")]
    scanner = license_scan.Scanner(notices, {})
    found = 0
    for _ in range(300):
        label, notice = notices[rng.random() < 0.4]
        text = list(notice)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(text))
            kind = rng.randrange(3)
            text[k:k + (kind != 0)] = rng.choice("abcehinst ") if kind < 2 else ""
        joined = " " + " ".join(f"the {''.join(text)} license mit".split()) + " "
        n, spans = scanner.spans(joined)
        for own, wanted in notices:
            edits = least_edits(wanted, joined)
            mine = [s["edits"] for s in spans if s["label"] == own]
            assert bool(mine) == (edits <= len(wanted) // license_scan.CHARACTERS_AN_EDIT), (joined, own, edits, spans)
            assert all(edits <= e for e in mine)
            found += bool(mine)
    assert found > 80
    n, spans = scanner.spans("x released under the mit license released under teh mit license")
    assert [(s["first_word"], s["words"], s["edits"]) for s in spans] == [(1, 5, 0), (6, 5, 2)]


def test_pieces_cover_the_notice():
    for _, notice in license_scan.NOTICES:
        for edits in range(6):
            cut = license_scan.pieces(notice, edits)
            assert "".join(p for _, p in cut) == notice and len(cut) == edits + 1 and all(notice[a:a + len(p)] == p for a, p in cut)


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert lexical_search.search(none, items).count() == lexical_search.search(odd, items.limit(0)).count() == 0
    assert spelling.variants(none).count() == 0
    assert license_scan.summary(license_scan.scan(none)).count() == 0


def test_whole_walk_of_one_long_text_is_linear():
    scanner = license_scan.Scanner()
    n, spans = scanner.spans("released under teh mit license and on " * 20_000)
    assert n == 140_000 and sum(s["notice"] == "released under the mit license" for s in spans) == 20_000
