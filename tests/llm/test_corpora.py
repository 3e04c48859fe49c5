"""Operators that look at a whole corpus: mixing, near copies, fingerprints, the language model; and the pipeline of all."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import language_model, mixing, near_dedup, spot_signatures

pytestmark = pytest.mark.filterwarnings("error::RuntimeWarning")
EDGES = [(1, None), (2, ""), (3, " \n"), (4, "word"), (4, "word"), (None, "no id"), (None, "no id"), (5, "a b " * 20_000), (6, "z" * 5000)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, node string, size int")


def oracle(sql: str, rows) -> list[str]:
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    return sorted(str(tuple(v for _, v in sorted(zip(columns, row, strict=True)))) for row in result.fetchall())


def as_text(df) -> list[str]:
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def vocabulary(n: int, seed: int = 0) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghij", k=r.randint(1, 6))) for _ in range(n)]


# mixing


def mixture(spark, seed=1, n=300):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 30))), r.choice(["a", "a", "a", "b", "c", None, "", "é"])) for i in range(n)]
    return rows, documents(spark, rows)


def op1(df):
    mix = mixing.mixed(df)
    return mix.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"))


def test_mix_equals_its_sql_and_reaches_targets(spark):
    rows, docs = mixture(spark)
    assert as_text(op1(docs)) == oracle(mixing.OP1_SQL, rows) == as_text(op1(docs.repartition(7)))
    largest = max(len((t or "").split()) for _, t, _ in rows)
    sources = op1(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.first("source_size").alias("size"), F.max("copies").alias("most")).collect()
    assert len(sources) == 6 and all(abs(s.taken - s.target) <= largest / 2 and s.target <= 3 * s["size"] and s.most <= 3 for s in sources)
    assert math.isclose(sum(s.target for s in sources), sum(s["size"] for s in sources))


def test_targets_stop_at_their_caps(spark):
    sizes = {"a": 10, "b": 10, "c": 980}
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "__source string, source_size long")
    found = {r["__source"]: r.target for r in mixing.source_targets(frame, (1, 2, 3), 3).collect()}
    assert found == {"a": 30.0, "b": 30.0, "c": 940.0}
    empty = spark.createDataFrame([("a", 0), ("b", 0)], "__source string, source_size long")
    assert {r.target for r in mixing.source_targets(empty, (1, 2, 3), 3).collect()} == {0.0}


def test_mix_of_edges_and_hot_sources(spark):
    rows = [(i, t, "s") for i, t in EDGES] + [(None, None, None)] + [(100 + i, "a b c", "hot") for i in range(500)]
    found = op1(documents(spark, rows))
    assert as_text(found) == oracle(mixing.OP1_SQL, rows) and found.count() == len(rows)
    assert op1(documents(spark, [])).count() == 0


def test_priorities_change_chances_not_totals(spark):
    rows = [(i, "a b c d", "s") for i in range(600)] + [(1000 + i, "a b", "t") for i in range(600)]
    docs = documents(spark, rows)
    mix = mixing.mixed(docs, priority=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    sums = {(r.source, r.even): r.taken for r in mix.groupBy("source", (F.col("doc_id") % 2 == 0).alias("even")).agg(F.sum(F.col("__size") * F.col("__copies")).alias("taken")).collect()}
    targets = {r.source: r.target for r in mix.select("source", "target").distinct().collect()}
    for s, target in targets.items():
        assert abs(sums[s, True] + sums[s, False] - target) <= 4 and sums[s, True] > 1.5 * sums[s, False]


def test_taking_a_mix_repeats_documents(spark):
    _, docs = mixture(spark)
    copies = {r.doc_id: r.copies for r in op1(docs).collect()}
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns and Counter(r.doc_id for r in taken.collect()) == Counter({k: v for k, v in copies.items() if v})
    plan = taken._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# near copies


def family(r, words, base, n, low, high):
    """Copies of base with between low and high of 100 words changed."""
    for _ in range(n):
        copy = base[:]
        for _ in range(r.randint(low, high) * len(base) // 100):
            copy[r.randrange(len(copy))] = r.choice(words)
        yield copy


def copies(seed: int):
    r, words = random.Random(seed), vocabulary(3000, seed)
    rows = [" ".join(r.choices(words, k=r.randint(0, 80))) for _ in range(60)]
    for size, low, high in ((40, 0, 6), (10, 0, 3), (5, 2, 12)):
        base = r.choices(words, k=120)
        rows += [" ".join(c) for c in family(r, words, base, size, low, high)]
    rows += ["one two", "ONE  two", "", " ", None, "x", rows[0], rows[0].upper(), "a b c d e", "a b c d e f"]
    r.shuffle(rows)
    return [(i, t, "s") for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed, monkeypatch):
    rows = copies(seed)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    found = near_dedup.near_classes(documents(spark, rows), words=4)
    assert as_text(found) == oracle(near_dedup.OP4_SQL, rows)
    monkeypatch.setattr(near_dedup, "BLOCK", 512)
    assert as_text(near_dedup.near_classes(documents(spark, rows[::-1]).repartition(5), words=4)) == as_text(found)


def drifting(seed: int):
    """Chains of texts, each a little different from the one before, and a frame that many texts share half of: links that no single center sees."""
    r, words, rows = random.Random(seed), vocabulary(4000, seed), []
    frame = r.choices(words, k=60)
    for _ in range(12):
        text = r.choices(words, k=100)
        for _ in range(12):
            text = text[:]
            for _ in range(r.randint(1, 4)):
                text[r.randrange(100)] = r.choice(words)
            rows.append(" ".join(text))
    rows += [" ".join(frame + r.choices(words, k=r.randint(5, 60))) for _ in range(80)]
    r.shuffle(rows)
    return [(i, t, "s") for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [3, 4])
def test_recall_of_links_far_from_centers(spark, seed):
    rows = drifting(seed)
    found = {r.doc_id: r.component_id for r in near_dedup.near_classes(documents(spark, rows), words=4).collect()}
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) for _, t, _ in rows for w in [t.split()]]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    together = sum(found[a] == found[b] for a, b in links)
    assert len(links) > 50 and together >= 0.99 * len(links)
    assert not any(found[a] == found[b] for a in range(len(sets)) for b in range(a) if not sets[a] & sets[b])


def test_regular_words_arent_near(spark):
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word, "s"), (2, other, "s"), (3, f"one {word} two three four", "s"), (4, f"one {other} two three four", "s"), (5, word.upper(), "s")]
    assert as_text(near_dedup.near_classes(documents(spark, rows), words=4)) == oracle(near_dedup.OP4_SQL, rows)
    with pytest.raises(ValueError, match="integer"):
        near_dedup.near_classes(documents(spark, rows).withColumn("doc_id", F.lit("x")))


def test_clashing_columns_stay(spark):
    docs = documents(spark, [(1, "a b c d e f", "s"), (2, "a b c d e f", "s")]).select("*", *(F.lit(i).alias(c) for i, c in enumerate(("__id", "__a", "__b", "component", "n", "__text"))))
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and [(r.doc_id, r["__a"], r["__b"], r.component) for r in kept.collect()] == [(1, 1, 2, 3)]


def test_near_copies_of_edges(spark, monkeypatch):
    docs = documents(spark, [(i, t, "s") for i, t in [*EDGES, (7, "no id"), (8, "z" * 5000)]])
    for most in (near_dedup.BROADCAST_ROWS, 0):  # joins by a shuffle as well
        monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", most)
        found = sorted(map(str, near_dedup.near_classes(docs).collect()))
        assert found == sorted(str(r) for r in near_dedup.near_classes(docs).collect()) and len(found) == 11
        classes = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_classes(docs).collect()}
        assert classes == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (None, 7, False), (7, 7, True), (5, 5, True), (6, 6, True), (8, 6, False)}
        kept = near_dedup.drop_near_copies(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert near_dedup.near_classes(docs.limit(0)).count() == 0 and near_dedup.drop_near_copies(docs.limit(0)).count() == 0


def test_only_copies_of_a_kept_text_go(spark):
    r, words = random.Random(11), vocabulary(3000, 11)
    alone = [" ".join(r.choices(words, k=40)) for _ in range(12)]
    rows = [(None, t) for t in alone[:5]] + [(None, alone[0]), (None, alone[1] + " more")]  # null ids: five texts, a copy and a near copy
    rows += [(1, alone[5]), (1, alone[6]), (1, alone[6])]  # an id of two texts
    rows += [(2, alone[7] + " more"), (2, alone[8]), (0, alone[7])]  # an id of a near copy and a text of its own
    rows += [(None, ""), (None, None), (3, alone[0])]
    kept = [(x.doc_id, x.text) for x in near_dedup.drop_near_copies(documents(spark, [(i, t, "s") for i, t in rows])).collect()]
    near = [x for x in kept if x[1] and x[1].startswith(alone[1])]
    expected = [(3, alone[0]), *((None, t) for t in alone[2:5]), (1, alone[5]), (1, alone[6]), (2, alone[8]), (0, alone[7]), (None, ""), (None, None)]
    assert len(near) == 1 and near[0][0] is None and sorted(map(str, kept)) == sorted(map(str, expected + near))


def test_sketches_merge_and_estimate():
    rng, sketch = np.random.default_rng(3), near_dedup.SetSketch(256)
    universe = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for shared, only in ((1000, 0), (800, 100), (500, 250), (0, 500)):
        a, b = universe[: shared + only], np.concatenate([universe[:shared], universe[2000 : 2000 + only]])
        ra, rb = sketch(a), sketch(b)
        assert (sketch.merged(ra, rb) == sketch(np.union1d(a, b))).all()
        estimate = sketch.jaccard(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(estimate - shared / (shared + 2 * only)) < 0.13
    assert (sketch(universe[:0]) == 0).all() and (sketch(universe) == sketch(universe[::-1])).all()


def test_components_of_chains(spark, tmp_path):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("a", "b"), ("c", "b"), ("d", "d")]
    random.Random(1).shuffle(edges)
    found = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a string, b string"), str(tmp_path / "c")).collect()}
    assert found == {f"{i:03}": "000" for i in range(41)} | {"a": "a", "b": "a", "c": "a", "d": "d"}


# fingerprints


def test_fingerprints_of_edited_texts(spark):
    r, words = random.Random(4), [*vocabulary(500), *spot_signatures.ANCHORS]
    rows = [*((i, t) for i, t in EDGES), *((10 + i, " ".join(r.choices(words, k=r.randint(0, 60)))) for i in range(80)), (200, "été \U0001f642 the end of it")]
    docs = documents(spark, [(i, t, "s") for i, t in rows]).repartition(5)
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    expected, spots = [], spot_signatures.SpotSigs()
    for (i, text), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, other = spots([text.encode()])[0], spots([edited.encode()])[0], spots([following.encode()])[0]
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), spot_signatures.fingerprint(own), spot_signatures.fingerprint(changed), spot_signatures.likeness(own, changed), spot_signatures.likeness(own, other)))
    for parts in ("1", "4"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert sorted(str(tuple(x)) for x in spot_signatures.fingerprints(docs).collect()) == sorted(map(str, expected))
    assert spot_signatures.fingerprints(docs.limit(0)).count() == 0
    single = spot_signatures.fingerprints(documents(spark, [(1, "the one and only", "s")])).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    assert all(0 <= e[5] <= 1 and 0 <= e[6] <= 1 for e in expected)


def test_signatures_are_chains_after_anchors():
    spots = spot_signatures.SpotSigs(("the", "of"), length=2)
    a, b, c, d = spots([b"The cat of the house sat", b"the CAT, of the house; sat", b"the dog of the house sat", b""])
    assert (a == b).all() and len(a) == 3 and 0 < spot_signatures.likeness(a, c) < 1 and len(d) == 0
    plain, same, marks = spots([b"cat house", b"house cat", b"?!"])
    assert (plain == same).all() and len(plain) == 2 and len(marks) == 1


def test_near_pairs_equal_brute_force(spark):
    rows = [(i, t and t.replace(" ", " the ", 40), "s") for i, t, _ in copies(5)] + [(None, "the cat", "s")]
    members, pairs = spot_signatures.near_pairs(documents(spark, rows))
    sets = {i: frozenset(s.tolist()) for (i, t, _), s in zip(rows, spot_signatures.SpotSigs()([(t or "").encode() for _, t, _ in rows]), strict=True) if i is not None}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert {(r.doc_id, r.class_id) for r in members.collect()} == {(i, first[s]) for i, s in sets.items()}
    classes = [(i, s) for s, i in first.items() if s]
    expected = {(min(a, b), max(a, b)) for n, (a, x) in enumerate(classes) for b, y in classes[:n] if len(x & y) >= 0.8 * len(x | y)}
    assert {(r.a, r.b) for r in pairs.collect()} == expected and len(expected) > 10


# the language model


def model_rows(n=150, seed=6):
    """Two languages, so that a word tells much about the next."""
    r = random.Random(seed)
    kinds = [vocabulary(40, 1), [w.upper() + "q" for w in vocabulary(40, 2)]]
    return [(i, " ".join(r.choices(kinds[i % 2], k=r.randint(0, 60))), "s") for i in range(n)]


def base_scores(rows):
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t, _ in rows}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    return {i: (zlib.crc32(str(i).encode()) % 5 == 1, len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)) for i, ws in tokens.items()}


def brute_scores(rows, options):
    """The suffix tree in dictionaries: every count is taken over all training texts."""
    texts = [[*(t or "").encode().lower().split(), None] for _, t, _ in rows]
    teaches = [zlib.crc32(str(i).encode()) % 5 != 1 if i is not None else True for i, _, _ in rows]
    counts = Counter(w for ws, t in zip(texts, teaches, strict=True) for w in ws if t)
    total, kinds = sum(counts.values()), len(counts)
    p = {(k, i): np.float32(10 ** (math.log10(counts[w] + 0.5) - math.log10(total + 0.5 * (kinds + 1)))) for k, ws in enumerate(texts) for i, w in enumerate(ws)}
    seen = {(k, i): counts[w] for k, ws in enumerate(texts) for i, w in enumerate(ws)} | {(k, -1): counts[None] for k in range(len(texts))}
    open_, misses, level, tree = set(p), Counter(), 0, set()
    while open_ := {(k, i) for k, i in open_ if i - level - 1 >= -1 and seen[k, i - 1] >= options.least}:
        level += 1
        context = {(k, i): tuple([None, *texts[k]][i + 1 - level : i + 1]) for k, i in open_}
        pairs, fine = Counter(), {}
        for k, i in open_:
            pairs[context[k, i], texts[k][i]] += teaches[k]
            fine[context[k, i], texts[k][i]] = min(255, round(-8 * math.log(p[k, i]))) / 8
        of = {}
        for (c, w), n in pairs.items():
            of.setdefault(c, []).append((n, fine[c, w]))
        judged = {}
        for c, own in of.items():
            size, twice = sum(n for n, _ in own), [(n, f) for n, f in own if n >= 2]
            left = 1 - sum(n - options.discount for n, _ in twice) / max(size, 1)
            rest = size - sum(n for n, _ in twice)
            gain = sum(n * (math.log((n - options.discount) / size) + f) for n, f in twice) + (rest * math.log(left) if rest else 0)
            kept = gain > options.divergence and size >= options.least
            cost = -sum(n * (math.log((n - options.discount) / size) if kept else -f) for n, f in twice)
            judged[c] = size, left if kept else 1, cost > options.divergence
            if kept:
                tree.add(c)
        going = set()
        for k, i in open_:
            c, n = context[k, i], pairs[context[k, i], texts[k][i]]
            size, left, more = judged[c]
            if left < 1:
                p[k, i] = np.float32((n - options.discount if n >= 2 else 0) / size + left * p[k, i])
                misses[k, i] = 0
            else:
                misses[k, i] += 1
            seen[k, i] = n
            if more and misses[k, i] <= options.patience:
                going.add((k, i))
        open_ = going
    return [sum(math.log10(p[k, i]) for i in range(len(ws))) for k, ws in enumerate(texts)], tree


def long_contexts(n=60):
    """The last of five words depends on the first."""
    r = random.Random(4)
    return [(1000 + i, " ".join(r.choice(["aa xx yy zz bb", "cc xx yy zz dd"]) for _ in range(20)), "s") for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"bundle_bytes": 200, "bucket_tokens": 300, "hot": 8}, {"hot": 1, "divergence": 2.0, "discount": 0.5}, {"least": 8, "patience": 0}])
def test_scores_equal_brute_force(spark, options, monkeypatch):
    if "hot" in options:
        monkeypatch.setattr(language_model, "MANY", 1000)
    rows, options = [*model_rows(), *long_contexts(), *((i + 2000, t, s) for i, t, s in model_rows(10))], language_model.TreeOptions(**options)
    found = language_model.score_documents(documents(spark, rows), options=options).collect()
    expected, (scores, tree) = base_scores(rows), brute_scores(rows, options)
    by_id = {i: s for (i, _, _), s in zip(rows, scores, strict=True)}
    assert len(found) == len(rows)
    for r in found:
        held_out, n, known, total, base = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, by_id[r.doc_id], rel_tol=1e-4)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)
    if options.patience and options.divergence > 2:
        assert 5 > max(map(len, tree)) >= 4 and len(tree) > 50


def test_the_tree_grows_with_the_corpus(spark):
    sizes = [len(brute_scores(model_rows(n, 20), language_model.TreeOptions())[1]) for n in (50, 200, 800)]
    assert sizes[0] < sizes[1] < sizes[2]


def test_longer_contexts_tell_more(spark):
    """After five words whose first decides the last: the right last word is likely, the other isn't."""
    probes = [i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [*long_contexts(), (probes[0], "aa xx yy zz bb", "s"), (probes[1], "aa xx yy zz dd", "s")]
    found = {r.doc_id: r.score for r in language_model.score_documents(documents(spark, rows)).collect()}
    assert found[probes[0]] > found[probes[1]] + 2


@pytest.mark.parametrize("many", [1, 1 << 22])
def test_hot_contexts_stay_with_the_tasks(spark, many, monkeypatch):
    """The driver sends nothing to the tasks and gets no table, however many contexts are hot; the scores are those without hot contexts."""
    rows = [*model_rows(), *long_contexts()]
    options = language_model.TreeOptions(bundle_bytes=500, bucket_tokens=300)
    expected = {r.doc_id: r.score for r in language_model.score_documents(documents(spark, rows), options=options).collect()}

    def refused(*args, **kwargs):
        raise AssertionError("a table reached the driver")

    monkeypatch.setattr(language_model, "MANY", many)
    for kind, name in ((type(spark.range(0)), "toPandas"), (type(spark.range(0)), "toArrow"), (type(spark.sparkContext), "broadcast")):
        monkeypatch.setattr(kind, name, refused)
    found = language_model.score_documents(documents(spark, rows), options=language_model.TreeOptions(bundle_bytes=500, bucket_tokens=300, hot=1))
    found = {r.doc_id: r.score for r in found.collect()}
    assert found.keys() == expected.keys() and all(math.isclose(found[i], expected[i], rel_tol=1e-6) for i in expected)


def test_rare_words_before_a_frequent_one_are_not_hot():
    """Runs of two words, of which the last is frequent and the first occurs once, aren't frequent; the words before the last are closed early, as are those after them."""
    n, hot, options = 500, 64, language_model.TreeOptions()
    tokens = np.array([t for i in range(n) for t in (i + 3, 1, 2, 0)], np.uint32)  # a rare word, a frequent pair, the end
    counts = np.bincount(tokens, minlength=n + 3).astype(np.uint64)
    state = {"tokens": tokens, "lengths": np.full(n, 4), "held": np.zeros(n, bool), "words": np.arange(n + 3, dtype=np.uint64), "counts": counts, "end": np.array([0], np.uint64)}
    bundle = language_model.Bundle(state, len(tokens), n + 3, options.least)
    wanted = []
    for level in (1, 2, 3):
        asked, which, _, hot_ones = bundle.asked(level, 4, hot)
        _, of = np.unique(asked["context"], return_inverse=True)
        total = np.bincount(of, asked["n"].astype(np.float64))[of]
        wanted.append(len(hot_ones))
        open_ = {(int(tokens[i - level]), int(tokens[i])) for i in bundle.open if i % 4 >= level}
        assert level == 1 or not any(first > 2 for first, _ in open_)
        bundle.answered(which, asked["n"], total, np.full(len(total), 0.5), np.ones(len(total), bool), options)
        bundle.keep(level + 1, options.least)
    assert wanted[0] == 3 and all(x <= len(tokens) / hot and x <= 3 for x in wanted)


def test_wrong_options_are_refused(spark):
    for wrong in ({"least": 0}, {"discount": 1.0}, {"divergence": -1.0}, {"bundle_bytes": 0}):
        with pytest.raises(ValueError, match="impossible"):
            language_model.score_documents(documents(spark, []), options=language_model.TreeOptions(**wrong))


def test_rows_travel_whole():
    rng = np.random.default_rng(1)
    arrays = {"a": rng.integers(0, 2**64, 1000, dtype=np.uint64), "b": np.zeros(0, np.float32), "c": rng.random(7).astype(np.float32), "d": np.array([True, False])}
    found = language_model.unpack(language_model.pack(**arrays))
    assert all((found[k] == v).all() and found[k].dtype == v.dtype and len(found[k]) == len(v) for k, v in arrays.items())


@pytest.mark.parametrize("most", [0, 255, 256, 70_000, 1 << 24, (1 << 32) - 1, 1 << 32, (1 << 64) - 1])
def test_rows_hold_the_bytes_that_numbers_reach(most):
    """Bytes above the greatest number are neither cut out of it nor compressed, and come back as zeros."""
    numbers = np.linspace(0, most, 5000).astype(np.uint64) if most < 1 << 63 else np.random.default_rng(1).integers(0, most, 5000, np.uint64, endpoint=True)
    numbers[7] = most
    reach = max(1, -(-most.bit_length() // 8))
    for kind in ("<u1", "<u2", "<u4", "<u8"):
        if most < 1 << 8 * np.dtype(kind).itemsize:
            data = language_model.pack(x=numbers.astype(kind), none=np.zeros(0, kind), signed=np.array([-1]))
            found = language_model.unpack(data)
            assert np.array_equal(found["x"], numbers) and found["x"].dtype == np.dtype(kind) and found["none"].dtype == np.dtype(kind) and found["signed"].tolist() == [-1]
            assert int.from_bytes(data[:8], "little") < 5000 * reach + 500


def test_the_tree_begins_at_its_first_level():
    """Numbering the words takes no probabilities: those are of the next level."""
    vocabulary = np.sort(np.array([3, 9, language_model.END], np.uint64))
    state = language_model.pack(vocabulary=vocabulary, tokens=np.array([0, 1, 2], np.uint32), lengths=np.array([3]), held=np.array([False]), n=np.ones(3, np.uint32))
    answer = language_model.pack(n=np.ones(3, np.uint64), number=np.arange(3, dtype=np.uint64))
    rows = pa.RecordBatch.from_arrays([pa.array([5, 5]), pa.array([[7], None]), pa.array([state, None], pa.binary()), pa.array([-1, 0], pa.int32()), pa.array([None, answer], pa.binary())], names=["bundle", "ids", "state", "part", "answer"])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_model, "Bundle", None)
        (found,) = language_model._taking(0, 1, 3, 3, language_model.TreeOptions())(iter([rows]))
    assert (found.column("ids").to_pylist(), found.column("tokens").to_pylist(), found.column("going").to_pylist()) == ([[7]], [3], [True])


@pytest.mark.parametrize("width", [1, 20, 50, 63, 64])
@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_keys_in_order(n, width):
    rng = np.random.default_rng(width)
    keys = rng.integers(0, (1 << width) - 1, n, dtype=np.uint64, endpoint=True)
    if width == 64:  # every other key agrees with many others in its high bits
        keys[::2] = (np.uint64(1) << np.uint64(63)) + rng.integers(0, 50, len(keys[::2]), dtype=np.uint64)
    order, ordered = language_model.ascending(keys)
    assert np.array_equal(ordered, np.sort(keys)) and np.array_equal(keys[order], ordered) and len(set(order.tolist())) == n
    different, example, which = language_model.grouped(keys)
    assert np.array_equal(different, np.unique(keys)) and np.array_equal(different[which], keys) and np.array_equal(keys[example], different)


def test_regular_words_are_known_apart(spark):
    """A word and its complement in the Thue-Morse order, of which only one is in the training texts."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    held, taught = (next(i for i in range(100) if (zlib.crc32(str(i).encode()) % 5 == 1) == h) for h in (True, False))
    other = word.translate(str.maketrans("ab", "ba"))
    found = {r.doc_id: r.n_known for r in language_model.score_documents(documents(spark, [(taught, word, "s"), (held, other, "s")])).collect()}
    assert found == {taught: 2, held: 1}


def test_scores_of_edges(spark):
    rows = [(i, t, "s") for i, t in EDGES]
    found = language_model.score_documents(documents(spark, rows)).collect()
    assert len(found) == len(rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found) and {r.n_tokens for r in found if r.doc_id in (1, 2, 3)} == {1}
    assert language_model.score_documents(documents(spark, [])).count() == 0
    held = [(i, "a b", "s") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    assert {(r.train_tokens, r.n_known, r.base_score) for r in language_model.score_documents(documents(spark, held)).collect()} == {(0, 0, 0.0)}


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    r, words = random.Random(9), vocabulary(2000, 9)
    item = " ".join(r.choices(words, k=30))
    rows, labels = [], []
    for i in range(240):
        text = r.choices(words, k=60)
        if i % 6 == 0:
            text[5] = text[40] = "scoundrel"
            text[20] = "blighter"
        rows.append((i, " ".join(text), "en", f"src{i % 4}", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    for i in range(240, 250):
        rows.append((i, rows[i - 239][1] + " more", "en", "src1", 1))  # near copies of 1 to 10
    rows += [(250, item + " tail", "en", "src0", 1), (251, None, None, None, None), (252, "", "en", None, 0), (253, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append([x.doc_id for x in docs.collect()])
        assert docs.columns == columns or name == "token_ids"
    toxic, near, clean, mix, tokens = map(sorted, seen)
    assert toxic == [i for i in range(254) if i % 6 and i != 245 or i > 239 and i != 245]  # 245 is a copy of 6
    assert near == [i for i in toxic if not 240 <= i < 250]
    assert clean == [i for i in near if i != 250]
    assert tokens == mix and set(mix) <= set(clean) and max(Counter(mix).values()) <= 3
    final = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert sorted(x.doc_id for x in final) == mix and all(a.start + a.n_tokens == b.start for a, b in pairwise(final))


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_pipeline_of_empty_tables(spark, tmp_path, empty):
    texts = [None, "", "a b c d e f g", "a b c d e f g", "you fool " * 3000, *(f"word {i} of a text that is like no other {i * i}" for i in range(20))]
    tables = {
        "documents": spark.createDataFrame([(i if i else None, t, "en", None if i % 3 else "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(i, 1, int(i == 4)) for i in range(1, 25)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, "nobody wrote this")], "item_id long, text string"),
    }
    for name, df in tables.items():
        (df.limit(0) if name == empty else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert not rows if empty == "documents" else len(rows) > 10 and all(a.start + a.n_tokens == b.start for a, b in pairwise(rows))
