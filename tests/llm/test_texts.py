"""Operators that look at one text at a time: URLs, tokens, token files, licences, benchmark passages, toxicity."""

import fnmatch
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontamination as dc
from marlstone.llm import license_scans, token_counts, token_ids, toxicity, url_filters
from marlstone.llm import common
from marlstone.llm.common import WordHasher, equal_runs, padded, slices

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, source string, n_words string, __text string, score int"


def documents(spark, rows):
    """Rows of (id, text) with columns whose names clash with those of operators."""
    return spark.createDataFrame([(i, t, "s", "x", "y", 1) for i, t in rows], DOCS)


ALPHABET = [*"abcXY 019,.!'\n\t\r \u00e9\u00f1\u00df\u20ac\u6f22\u5b57\u00d7\u00f7", *"\x00\x1c\x1d\x85\xa0\u2003\u200b\u3000\u202f\ufeff\u1680", "<|endoftext|>", "'ll", "'s", "\U0001f642", "the", " the", "  "]


def random_texts(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, 30))) for _ in range(n)]


EDGES = [(1, None), (2, ""), (3, " \n"), (4, "word"), (4, "word"), (None, "no id"), (5, "a b " * 30_000), (6, "z" * 5000)]


def regular(n: int) -> tuple[str, str]:
    """The Thue-Morse word of n letters and its complement: sums over places take such pairs for one."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


REGULAR = [f"{before}{word}{after}" for n in (64, 1024, 2048) for word in regular(n) for before, after in (("", ""), ("the first ", " the last"))]


# words


def test_regular_words_have_hashes_of_their_own():
    words = [w for n in (8, 16, 64, 65, 256, 1024, 2048, 4096) for w in regular(n)] + ["a" * n for n in range(1, 200)]
    hashes, begins = WordHasher()([w.encode() for w in words])
    assert len(set(hashes.tolist())) == len(set(words)) == len(hashes) and begins.tolist() == list(range(len(words) + 1))


def test_runs_are_compared_byte_by_byte():
    r = random.Random(12)
    words = ["".join(r.choices("ab", k=r.choice([1, 7, 8, 9, 16, 63, 64, 65, 130]))).encode() for _ in range(400)]
    words += [w[:-1] + b"c" for w in words]
    lengths = np.array([len(w) for w in words])
    starts, buffer = np.cumsum(lengths) - lengths, padded(b"".join(words))
    a, b = np.array([(i, j) for i in range(0, 800, 7) for j in range(800) if lengths[i] == lengths[j]]).T
    assert equal_runs(buffer, starts[a], buffer, starts[b], lengths[a]).tolist() == [words[i] == words[j] for i, j in zip(a, b, strict=True)]


def test_word_hashes_agree_with_splitting():
    texts = [t.encode() for t in random_texts(200)] + [b"", b" ", b"A a"]
    hashes, begins = WordHasher()(texts)
    words = [t.lower().split() for t in texts]
    assert np.diff(begins).tolist() == list(map(len, words))
    flat = [w for ws in words for w in ws]
    assert len(set(flat)) == len(set(hashes.tolist())) and len({(w, h) for w, h in zip(flat, hashes.tolist(), strict=True)}) == len(set(flat))


# URLs


def test_urls_equal_their_sql(spark):
    r = random.Random(2)
    parts = ["example.com", "www.example.com", "a.www.EXAMPLE.com", "notexample.com", "x.net", "net", "com", "fr.net", "net.org", "", "u@h.com:80"]
    urls = [None, "", "example.com/en/", "http://", "://com/", "http://com", "http://com/", "http://x/y.net/es/", "http://a.net\n/es/", "http://a/://b.net/fr/"]
    urls += [f"{r.choice(['http', 'HTTPS'])}://{r.choice(parts)}{r.choice(['', '/', '/en/', '/en', '/EN/', '/es/x', '/fr/', '/es/?q', '?/es/', '#/en/', '/x/en/'])}" for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    found = {tuple(x) for x in url_filters.judge_urls(rows).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    assert found == set(con.execute(url_filters.OP2_SQL).fetchall()) and len(found) == len(urls)
    assert url_filters.judge_urls(rows.limit(0)).count() == 0


def test_automaton_over_many_words():
    r = random.Random(3)
    globs = ["".join(r.choices("ab*/", k=r.randint(1, 20))) for _ in range(60)]
    texts = ["".join(r.choices("ab/", k=r.randint(0, 15))) for _ in range(300)]
    automaton = url_filters.WildcardAutomaton(globs)
    assert automaton.words > 5
    expected = [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]
    assert automaton.matches([t.encode() for t in texts]).tolist() == expected
    assert url_filters.WildcardAutomaton(["^x/*"]).matches([b"ax/b", b"a/x/b", b"x/"]).ravel().tolist() == [True, False, True]


def test_longest_rule_wins_and_default_applies(spark):
    rules = (url_filters.Rule("a.b", "/", "block"), url_filters.Rule("b", "/", "allow"))
    rows = spark.createDataFrame([(1, "x://q.a.b/"), (2, "x://b/z"), (3, "x://c/")], "page_id long, url string")
    assert [tuple(r)[3:] for r in url_filters.judge_urls(rows, rules, "block").orderBy("page_id").collect()] == [("a.b/", "block"), ("b/", "allow"), (None, "block")]


# tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def ids_of(tokenizer, text: str) -> list[int]:
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(spark, tokenizer):
    texts = random_texts(3000) + ["aaaaaaaaaa" * 50, "e" * 3000]
    counter = token_counts.MergeCounter(open(VOCABULARY, encoding="utf-8").read())
    assert [counter.count(t) for t in texts] == [len(ids_of(tokenizer, t)) for t in texts]
    rows = sorted(map(tuple, token_counts.count_tokens(documents(spark, EDGES), VOCABULARY).collect()), key=str)
    assert rows == sorted(((i, len((t or "").encode()), n := len(ids_of(tokenizer, t)), n > 512) for i, t in EDGES), key=str)


def test_remembering_little_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(token_counts.MergeCounter, "CHUNKS", 3)
    monkeypatch.setattr(token_counts.MergeCounter, "PIECES", 2)
    monkeypatch.setattr(token_ids.ChunkEncoder, "CHUNKS", 3)
    monkeypatch.setattr(token_ids.ChunkEncoder, "RECENT", 2)
    vocabulary = open(VOCABULARY, encoding="utf-8").read()
    counter, encoder = token_counts.MergeCounter(vocabulary), token_ids.ChunkEncoder(vocabulary)
    for text in [*random_texts(200, 5), *REGULAR]:
        assert counter.count(text) == len(ids_of(tokenizer, text)) and encoder([text.encode()])[0].tolist() == ids_of(tokenizer, text)


@pytest.mark.parametrize("bits", [0, 3, 10])
def test_ids_dont_depend_on_hashes(tokenizer, monkeypatch, bits):
    """Chunks that share a hash are told apart, also by what earlier batches left."""
    weak = lambda *x: common.hashed_runs(*x) % np.uint64(1 << bits)
    monkeypatch.setattr(token_ids, "hashed_runs", weak)
    encoder, texts = token_ids.ChunkEncoder(open(VOCABULARY, encoding="utf-8").read()), random_texts(200, 6) + REGULAR
    for at in range(0, len(texts), 9):
        assert [x.tolist() for x in encoder([t.encode() for t in texts[at : at + 9]])] == [ids_of(tokenizer, t) for t in texts[at : at + 9]]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.MergeCounter(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_encoder_is_the_library(tokenizer):
    encoder, texts = token_ids.ChunkEncoder(open(VOCABULARY, encoding="utf-8").read()), random_texts(3000, 7)
    for at in range(0, len(texts), 100):
        assert [x.tolist() for x in encoder([t.encode() for t in texts[at : at + 100]])] == [ids_of(tokenizer, t) for t in texts[at : at + 100]]
    assert encoder([]) == []


def test_new_chunks_are_asked_together(tokenizer, monkeypatch):
    """The library is asked for few texts, whose ids are dealt back to the chunks; ids that don't part with the chunks are asked for again, each chunk alone."""
    words = [f"{a}{b}{end}" for a in "stem wort \u00e9t\u00e9 \u4e2d\u6587 \u0301x 12".split() for b in map(str, range(40)) for end in ("", " ", "\n", "  \n", "\t", "\u3000", "'s", "'", "\u00a0 ")]
    texts = [" ".join(words[at : at + 50]) for at in range(0, len(words), 50)]
    expected = [ids_of(tokenizer, t) for t in texts]
    for joined, wrong in ((100, False), (7, False), (100, True)):
        monkeypatch.setattr(token_ids.ChunkEncoder, "JOINED", joined)
        encoder, asked = token_ids.ChunkEncoder(open(VOCABULARY, encoding="utf-8").read()), []
        library = encoder.encode
        encoder.encode = lambda given: asked.extend(given) or library(given)  # noqa: B023
        if wrong:
            encoder.sizes[:] = 2
        assert [x.tolist() for x in encoder([t.encode() for t in texts])] == expected
        known = len(encoder.known[0]) + len(encoder.recent[0])
        assert known > 1000 and (len(asked) > known if wrong else len(asked) < known / 2)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
def test_token_files_round_trip(n):
    rng = np.random.default_rng(n)
    for values in (rng.zipf(1.3, n).clip(0, 2**32 - 1), rng.integers(0, 2**32, n), np.full(n, 7), np.where(rng.random(n) < 0.05, 2**32 - 1, 3)):
        values = values.astype(np.uint32)
        data = token_ids.encode_ids(values)
        assert (token_ids.decode_ids(data) == values).all() and len(token_ids.decode_ids(data)) == n
        for block in range(-(-n // 256)):
            assert (token_ids.decode_ids(data, block, 1) == values[block * 256 : (block + 1) * 256]).all()
    with pytest.raises(ValueError):
        token_ids.decode_ids(b"nope")


def test_outliers_are_exceptions():
    values = np.ones(25_600, np.uint32)
    values[::100] = 50_000
    assert len(token_ids.encode_ids(values)) < 25_600 / 2


def test_segments_read_by_their_index():
    rng, ids = np.random.default_rng(2), []
    for n in (1, 1, 300, 256, 70_000, 2):
        ids.append(rng.integers(0, 50_000, n).astype(np.uint32))
    segment = token_ids.Segment.of([5, None, -3, 0, 2**40, 7], ids)
    at = np.cumsum([0, *map(len, ids)])
    expected = [(name, int(start), len(x), zlib.crc32(x.astype("<u4").tobytes())) for name, start, x in zip([5, None, -3, 0, 2**40, 7], at, ids)]
    assert list(segment.documents()) == list(segment.documents(window=1)) == expected
    with pytest.raises(ValueError):
        list(token_ids.Segment(b"nope").documents())


def test_written_ids(spark, tokenizer, tmp_path):
    rows = [*EDGES, (-7, "first"), (9, "<|endoftext|>"), *((None, f"none {i}") for i in range(30)), *((77, t) for t in REGULAR), *((78, "same") for _ in range(30))]
    docs = documents(spark, rows).repartition(3)
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).collect()
    order = sorted(((r.doc_id, r.hash, r.text or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
    for more in ({"segment_tokens": 1000}, {}):
        path = str(tmp_path / f"ids{len(more)}")
        found = token_ids.encode_documents(docs, VOCABULARY, path, **more).orderBy("start").collect()
        at = 0
        for r, (i, _, text) in zip(found, order, strict=True):
            ids = [*ids_of(tokenizer, text), 0]
            assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
        segments = spark.read.parquet(path)
        assert segments.count() > (1 if more else 0) and segments.agg(F.sum("n_ids")).first()[0] == at
    assert token_ids.encode_documents(docs.limit(0), VOCABULARY).count() == 0
    with pytest.raises(ValueError, match="integer"):
        token_ids.encode_documents(docs.withColumn("doc_id", F.lit("a")), VOCABULARY)


# licences


TEXTS = [
    (1, None), (2, ""), (3, "Licensed under the Apache License, Version 2.0."), (4, "Some text. released UNDER the mit license!\nMore"), (4, "Released under the MIT License"),
    (5, "\n".join(license_scans.SENTENCES[i - 1] + "." for i in (10, 11, 12))), (6, "This program is free software; " + license_scans.SENTENCES[19].replace(" GNU", "\nGNU") + ".\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."),
    (7, "Licensed under CC BY-NC 4.0. All rights reserved. Licensed under CC BY-NC 4.0."), (11, "Copyright (c) 2020, A. Author.\nAll rights reserved.\n\n" + " ".join(license_scans.SENTENCES[i - 1] + "." for i in (13, 14, 15, 16))), (12, "A. All rights reserved."),
    (13, "This library is free software; " + license_scans.SENTENCES[31] + "."), (14, "This program is free software: " + license_scans.SENTENCES[32] + "."), (15, license_scans.SENTENCES[33] + "/"), (16, license_scans.SENTENCES[34] + "."), (17, "This is free and unencumbered software released into the public domain."),
    (18, "\n".join([license_scans.SENTENCES[12], "a", "b", "c", license_scans.SENTENCES[13], "1.", license_scans.SENTENCES[14]])), (19, "\n".join([license_scans.SENTENCES[12], "a", "b", "c", "d", license_scans.SENTENCES[13], license_scans.SENTENCES[14]])), (8, "Not licensed under the Apache License, Version 2.0"), (9, " ".join(license_scans.SENTENCES[i - 1] + ". Unknown words." for i in (13, 14, 15, 16))), (10, "x. " * 20_000), (None, "MIT License"),
]


def test_licences(spark):
    found = {(r.doc_id, r.licenses, r.kind) for r in license_scans.scan(documents(spark, TEXTS)).collect()}
    assert found == {
        (1, "", "none"), (2, "", "none"), (3, "Apache-2.0", "permissive"), (4, "MIT", "permissive"), (5, "MIT", "permissive"), (6, "GPL-3.0", "copyleft"), (7, "CC-BY-NC-4.0", "restricted"), (8, "", "none"),
        (11, "BSD-3-Clause", "permissive"), (12, "reserved", "restricted"), (13, "LGPL-2.1", "copyleft"), (14, "AGPL-3.0", "copyleft"), (15, "EPL-2.0", "copyleft"), (16, "CC0-1.0", "permissive"), (17, "Unlicense", "permissive"),
        (18, "BSD-2-Clause", "permissive"), (19, "", "none"), (9, "BSD-3-Clause", "permissive"), (10, "", "none"), (None, "MIT", "permissive"),
    }
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", TEXTS)
    result = con.execute(license_scans.OP6_SQL)
    columns = [c[0] for c in result.description]
    assert sorted(map(str, result.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in license_scans.scan(documents(spark, TEXTS)).collect())
    plan = license_scans.scan(documents(spark, TEXTS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and license_scans.scan(documents(spark, [])).count() == 0


# benchmark passages


def brute_hits(text, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            for k in range(len(own) - len(part) + 1):
                if own[k : k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    names.add("null" if name is None else str(name))
    return len(own), sorted(hit), sorted(names)


def test_spans_equal_brute_force(spark):
    r = random.Random(4)
    word = lambda: r.choice(["a", "b", "c", "A", "d\u00e9", "x1"])
    items = [(i, " ".join(word() for _ in range(r.randint(0, 9)))) for i in range(12)] + [(3, "a b"), (None, "c c c"), (20, None), (21, "...")]
    docs = [(i, r.choice([" ", ", ", "\n"]).join(word() for _ in range(r.randint(0, 60)))) for i in range(60)] + EDGES[:4] + [(None, "c c c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_bytes": 20}, {"shard_bytes": 50}):
        found = dc.find_spans(documents(spark, docs), bench, window=4, **options).collect()
        assert len(found) == len(docs)
        got = sorted(str((x.doc_id, x.n_words, sorted(p for s in x.spans for p in range(s.first, s.end)), x["items"])) for x in found)
        assert got == sorted(str((i, *brute_hits(t, items, 4))) for i, t in docs)
        assert all(a.end < b.first for x in found for a, b in zip(x.spans, x.spans[1:], strict=False))
    assert dc.find_spans(documents(spark, docs), bench.limit(0), window=4).where(F.size("items") > 0).count() == 0
    assert dc.find_spans(documents(spark, []), bench).count() == 0


def test_contamination_rule(spark):
    item = " ".join(f"w{i}" for i in range(13))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, [(1, item + " x" * 247), (2, item + " x" * 248), (3, "clean"), (4, None), (5, item[:-1])])
    kept = dc.drop_contaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5] and kept.columns == docs.columns


def test_index_counts_and_locates():
    rng = np.random.default_rng(5)
    sequence = np.concatenate([[0], rng.integers(0, 4, 3000), np.tile([1, 2, 3], 200), [0]])
    index = dc.FMIndex(sequence, 4)
    patterns = np.array([[1, 2, 3, 1], [3, 3, 3, 3], [1, 1, 2, 3]])
    alive, first, end = index.search(patterns)
    for p, pattern in enumerate(patterns):
        places = [i for i in range(len(sequence) - 3) if (sequence[i : i + 4] == pattern).all()]
        found = [sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(alive, first, end, strict=True) if k == p]
        assert found == ([places] if places else [])
    ranks = dc.WaveletMatrix(sequence, 2)
    at = rng.integers(0, len(sequence) + 1, 200)
    symbols = rng.integers(0, 4, 200)
    assert ranks.rank(symbols, at).tolist() == [int((sequence[:e] == s).sum()) for s, e in zip(symbols, at, strict=True)]


# toxicity


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_what_edit_distance_says():
    r = random.Random(6)
    terms = [toxicity.Term("".join(r.choices("abc", k=r.randint(2, 11))), 5.0, misspelt=4.0) for _ in range(25)]
    automaton = toxicity.LexiconAutomaton(terms)
    automaton.STATES = 200
    for _ in range(3000):
        word = "".join(r.choices("abcd", k=r.randint(0, 12)))
        expected = max((5.0 if t.text == word else 4.0 for t in terms if edits(t.text, word) <= t.errors), default=None)
        found = automaton.find(word)
        assert (found[0] if found else None) == expected, word


def test_stems_stand_for_their_words():
    automaton = toxicity.LexiconAutomaton([toxicity.Term("lost", 3.0, stem=True), toxicity.Term("lostra", 5.0, stem=True), toxicity.Term("scum", 6.0)])
    assert [automaton.find(w) and automaton.find(w)[0] for w in ("lost", "lostx", "lostrax", "los", "xlost", "scum", "scums")] == [3.0, 3.0, 5.0, None, None, 6.0, None]


def test_quotation_weighs_less():
    near = "he said the word was".split()
    assert toxicity.context('he said "', '" was', near) < toxicity.context("he said ", " was", near) < toxicity.context("a ", " b", ["a"]) < toxicity.context("you ", "", ["you"])
    assert toxicity.context('"a" then ', ' and "b"', ["then"]) == 1.0


def labelled(spark, n=400):
    r = random.Random(8)
    words = ["".join(r.choices("aeioubdglmnrst", k=r.randint(2, 7))) for _ in range(300)]
    bad = ["wretchling", "scoundrel", "blighter"]
    rows, labels = [], []
    for i in range(n):
        text = r.choices(words, k=40)
        toxic = i % 4 == 0
        if toxic:
            text[r.randrange(40)] = r.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_is_learnt_and_misspellings_count(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 1)
    assert {t.text for t in model.terms} == {"wretchling", "scoundrel", "blighter"}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    found = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert found == truth
    more = documents(spark, [*EDGES, (90, "you wretchlimg"), (91, 'he said the word "scoundrel" was rude'), (92, "a fine day")])
    scores = {r.doc_id: r for r in toxicity.score(more, model).collect()}
    assert scores[90].predicted == 1 and scores[91].predicted == scores[92].predicted == 0 and scores[91].score > scores[92].score and all(0 <= s.score <= 1 for s in scores.values())
    kept = toxicity.drop_toxic(more, model)
    assert kept.columns == more.columns and kept.count() == more.count() - 1


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 20)
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int")), labels.withColumn("toxic", F.lit(0))):
        model = toxicity.fit(docs, none, F.lit(True))
        assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.ToxicityModel()).count() == 0


def test_separable_and_overlapping_curves():
    for x, y in (([0.0] * 1000 + [24.0] * 100, [0.0] * 1000 + [1.0] * 100), ([0.0, 1, 2, 3, 4, 5] * 20, [0.0, 0, 1, 0, 1, 1] * 20), ([0.0] * 50, [0.0, 1.0] * 25)):
        a, b = toxicity._logistic(np.array(x), np.array(y))
        assert np.isfinite([a, b]).all() and b >= 0
        assert 1 / (1 + np.exp(-(a + b * max(x)))) >= np.mean(y) - 0.01


def test_slices_keep_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"i": list(range(50)), "t": [("x" * (i % 7)) if i % 5 else None for i in range(50)]})
    parts = list(slices(iter([batch, batch.slice(0, 0)]), "t", 9))
    assert [i for p, _ in parts for i in p.column("i").to_pylist()] == list(range(50)) and all(len(p) == len(t) for p, t in parts) and len(parts) > 5
    assert hashlib.sha256(b"".join(x for _, t in parts for x in t)).digest() == hashlib.sha256(b"".join(("x" * (i % 7)).encode() if i % 5 else b"" for i in range(50))).digest()
