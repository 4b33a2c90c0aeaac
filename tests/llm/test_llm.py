"""The ten operators against brute force, the tokenizers library, round trips and edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sonagrid.llm import decontamination, fingerprints, language_id, language_model, license_scan, line_dedup, near_dedup, packing, queries, sampling, storage, token_counts, toxicity
from sonagrid.llm.textarrays import ALNUM, NOT_BLANK, blocks, span_hashes, words
from tests.compare import assert_same, connection
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def table(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n\n", "a", "é", "the same line of twenty code points\n" * 3, "x" * 100_000, "Ünïcode “quotes” don't <|endoftext|> 中文 ½ ١٢", "\x00\x1f\x7f", "word " * 20_000, "the same line of twenty code points"]


@pytest.fixture(scope="module")
def odd(spark):
    """Edge cases, repeated rows, a null id, and extra columns whose names the operators use too."""
    docs = table(spark, ODD).unionByName(table(spark, ODD)).unionByName(spark.createDataFrame([(None, "no id", None, None, None)], DOCS))
    return docs.withColumns({c: F.lit(1) for c in ("n_words", "items", "score", "lang_pred", "node", "row", "h1", "comp", "range", "guest", "pos", "body", "_keep", "_n", "_doc", "_body", "_", "_row", "_rest", "rest", "keep", "doc", "letter", "_letter", "n_dropped", "sketch", "class", "first", "bucket")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    return {r.doc_id: r.text for r in rows.collect()}


BENCHMARK = "item_id long, text string"


def all_operators(spark, docs):
    bench = spark.createDataFrame([(1, "the same line of twenty code points"), (2, None), (None, "x"), (3, "")], BENCHMARK)
    model = language_model.train(docs.select("doc_id", "text"), F.col("doc_id") % 7 == 2)
    tox = toxicity.train(docs.select("text", F.lit(1).alias("y")), F.col("y"), 3)
    return {
        "language_id": language_id.identify(docs, language_id.train(docs.select("text", "lang"))),
        "toxicity": toxicity.rate(docs, tox),
        "packing": packing.pack_documents(docs, queries.tokenizer_path()),
        "decontamination": decontamination.report(docs, bench),
        "clean": decontamination.without_contaminated(docs, bench),
        "near_dedup": near_dedup.near_duplicates(docs),
        "without_near": near_dedup.without_near_duplicates(docs),
        "license_scan": license_scan.scan(docs),
        "token_counts": token_counts.count_tokens(docs, queries.tokenizer_path()),
        "language_model": language_model.score(docs, model),
        "line_report": line_dedup.line_report(docs),
        "without_lines": line_dedup.without_repeated_lines(docs),
        "fingerprints": fingerprints.fingerprint_report(docs),
    }


def test_edge_cases_have_a_row_each(spark, odd):
    n = odd.count()
    for name, df in all_operators(spark, odd).items():
        got = df.count()
        if name in ("packing",):
            assert got >= n
        elif name in ("clean", "without_near"):
            assert 0 < got < n and df.columns == odd.columns
        else:
            assert got == n, name


def test_empty_tables_give_empty_results(spark, empty):
    for name, df in all_operators(spark, empty).items():
        assert df.count() == 0, name


def test_scratch_tables_go(spark):
    df = spark.range(3)
    with storage.scratch() as outer:
        with storage.scratch() as inner:
            gone, kept = storage.written(df, "gone"), storage.written(df, "kept")
            inner.keep(kept)
        assert kept.count() == 3
        with pytest.raises(Exception, match="(?i)not.exist"):
            gone.collect()
        assert outer.tables == [kept]
    with pytest.raises(Exception, match="(?i)not.exist"):
        kept.collect()


def test_empty_benchmark_hits_nothing(spark, odd):
    out = decontamination.report(odd, spark.createDataFrame([], BENCHMARK))
    assert out.filter("n_hit > 0 or contaminated").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert_same(queries.queries()[name](spark, SMALL), connection(SMALL), queries.oracle_sql()[name])


# Kernels


@pytest.mark.parametrize("pattern,held", [(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ALNUM), (r"[^\x20\x09-\x0D]+", NOT_BLANK)])
def test_words_are_those_of_the_pattern(pattern, held):
    texts = [(t or "").translate(LOWER) for t in ODD] + ["tail", "head"]
    got = []
    for b in blocks(pa.array(texts), 64):
        at = words(b, held)
        raw = b.data.tobytes()
        for i in range(len(b.bounds) - 1):
            got.append([raw[at.start[k] : at.end[k]].decode() for k in range(at.bounds[i], at.bounds[i + 1])])
    assert got == [re.findall(pattern, t) for t in texts]


def test_equal_spans_hash_alike():
    data = np.frombuffer(b"abc xabc abcd", np.uint8)
    h = span_hashes(data, np.array([0, 5, 9, 9]), np.array([3, 8, 12, 13]))
    assert h[0] == h[1] == h[2] != h[3]


# 1 language, 2 toxicity: held-out accuracy


def test_language_of_held_out_documents(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = got.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.count() > 100 and held.filter("lang = lang_pred").count() / held.count() > 0.98
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_needs_letters_and_ignores_labels(spark):
    texts = ["the cat sat on the mat and the dog"] * 5 + ["le chat est sur la table et le chien"] * 5 + [None, "", "123 !!", "zzzz"]
    docs = table(spark, texts, ["en"] * 5 + ["fr"] * 5 + [None] * 4)
    fitted = language_id.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs.withColumn("lang", F.lit("xx")), fitted).collect()}
    assert got[0][0] == "en" and got[5][0] == "fr"
    assert [got[i] for i in (10, 11, 12)] == [("und", 0.0)] * 3
    assert got[13][0] in ("en", "fr")


def test_filter_agrees_with_plain_sets(spark):
    """A set of n-grams per language, by the rule of train(), against the bit-sliced filter."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null and lang is not null")
    rows = docs.select("text", "lang").distinct().collect()
    counts = collections.defaultdict(collections.Counter)
    grams = []
    for r in rows:
        padded = " " + "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in r.text.lower()) + " "
        raw = padded.encode()
        own = [raw[i : i + n] for n in (3, 5) for i in range(len(raw) - n + 1) if b" " not in raw[i + 1 : i + n - 1]]
        grams.append(own)
        counts[r.lang].update(own)
    total = {x: sum(c.values()) for x, c in counts.items()}
    best = collections.Counter()
    for x, c in counts.items():
        for g, n in c.items():
            best[g] = max(best[g], n / total[x])
    held = {x: {g for g, n in c.items() if n >= 2 and n / total[x] >= 0.4 * best[g]} for x, c in counts.items()}
    f = language_id.train(docs.select("text", "lang"), sample_docs=10**6)
    assert set(f.languages) == set(held)
    n, hits = language_id.corrected_counts(pa.array([r.text for r in rows]), f)
    assert n.tolist() == list(map(len, grams))
    for i, own in enumerate(grams):
        for k, x in enumerate(f.languages):
            want = sum(g in held[x] for g in own)
            assert abs(hits[i, k] - want) <= 3 + 0.02 * len(own)  # chance hits, taken off on average


def test_samples_are_bounded_however_many_copies_there_are(spark):
    same = spark.range(200_000).select(F.lit("one text that all have").alias("text"), F.lit("en").alias("lang"))
    others = spark.range(3_000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"))
    got = sampling.distinct_texts(same.unionByName(others), "lang", 500, True).collect()
    assert collections.Counter(r.lang for r in got) == {"en": 500, "fr": 500}
    assert len({(r.lang, r.text) for r in got}) == 1000
    assert len(sampling.distinct_texts(others, "lang", 700, False).collect()) == 700
    again = sampling.distinct_texts(others.unionByName(same).repartition(5), "lang", 500, True).collect()
    assert {(r.lang, r.text) for r in got} == {(r.lang, r.text) for r in again}


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    rows, columns = rng.integers(0, 40, 200), rng.integers(0, 7, 200)
    grades, theta = rng.integers(0, 4, 40), rng.normal(size=7 + 3)
    _, grad = toxicity.log_likelihood(theta, rows, columns, grades, 7, 1e-2)
    for i in range(len(theta)):
        step = np.zeros(10)
        step[i] = 1e-6
        up, down = (toxicity.log_likelihood(theta + x, rows, columns, grades, 7, 1e-2)[0] for x in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_fit_without_features_gives_the_grades_shares():
    """The exact solution: P(grade > k) is the share of grades over k."""
    grades = np.repeat([0, 1, 2], [60, 30, 10])
    none = np.zeros(0, np.int64)
    _, thresholds = toxicity.fit(none, none, grades, 0, 3, steps=500)
    assert 1 / (1 + np.exp(thresholds)) == pytest.approx([0.4, 0.1], abs=1e-4)


def test_a_sample_by_hashes_is_the_sample_of_texts(spark):
    docs = table(spark, [f"text {i % 300}" for i in range(900)] + [None, ""]).select("doc_id", "text", (F.col("doc_id") % 7 % 2).alias("grade"))
    hashed = docs.filter("text is not null").select("grade", sampling.text_hash().alias("text_hash"))
    for most in (50, 1000):
        want = sampling.distinct_texts(docs.filter("text is not null"), "grade", most, False)
        got = sampling.distinct_texts(hashed, "grade", most, False, docs.select("text"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got.count() == want.count() == min(most, docs.filter("text is not null").select("text", "grade").distinct().count())


def test_labels_are_joined_without_texts(spark, monkeypatch):
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda labelled, *args, **kwargs: (seen.append(labelled.columns), train(labelled, *args, **kwargs))[1])
    assert queries.op2_toxicity(spark, SMALL).count() == queries.table(spark, SMALL, "documents").count()
    assert seen and "text" not in seen[0]


def test_ratings_are_the_models(spark):
    """Severity, grade and toxic of rate() against the definition, word by word."""
    model = toxicity.Model(np.sort(toxicity.gram_places(next(blocks(pa.array(["slur vile"]))))[1]), np.array([[0.5, 1.0, 0.25]] * len(toxicity.gram_places(next(blocks(pa.array(["slur vile"]))))[1])), np.array([1.0, 2.0]))
    texts = [None, "", "slur", "a slur and SLUR", "vile slur vile slur slur slur"]
    got = toxicity.rate(table(spark, texts), model).orderBy("doc_id").collect()
    for r, (slur, vile) in zip(got, [(0, 0), (0, 0), (1, 0), (2, 0), (4, 2)]):
        eta = sum(w * (n >= least) for n in (slur, vile) for w, least in ((0.5, 1), (1.0, 2), (0.25, 4)))
        p = [1 / (1 + math.exp(-(eta - t))) for t in (1.0, 2.0)]
        assert r.severity == pytest.approx(sum(p)) and r.p_toxic == pytest.approx(p[0])
        assert r.grade == int(np.argmax([1 - p[0], p[0] - p[1], p[1]])) and r.toxic == (p[0] >= 0.35)


def test_more_than_64_languages(spark):
    rng = random.Random(3)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6)) for _ in range(70)]
    text = lambda a, r: " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(200))
    docs = table(spark, [text(alphabets[i % 70], rng) for i in range(140)], [f"l{i % 70}" for i in range(140)])
    fitted = language_id.train(docs)
    assert fitted.slots.shape[1] == 2
    got = language_id.identify(docs, fitted).filter("lang = lang_pred").count()
    assert got > 130


def test_toxic_words_raise_severity(spark):
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        grade = i % 3
        text = [rng.choice(plain) for _ in range(60)] + ["slur"] * (2 * grade) + ["vile"] * (grade == 2)
        rng.shuffle(text)
        rows.append((i, " ".join(text), grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = toxicity.train(df.filter("doc_id < 450"), F.col("grade"), 3)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = toxicity.rate(df.filter("doc_id >= 450"), model).collect()
    mean = {g: np.mean([r.severity for r in got if r.doc_id % 3 == g]) for g in (0, 1, 2)}
    assert mean[0] < 0.3 < 0.7 < mean[1] < 1.4 < 1.6 < mean[2]


# 3 packing, 7 tokens: the tokenizers library


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def test_counts_are_the_librarys(spark, odd, tokenizer, documents):
    texts = [t or "" for t in ODD] + list(documents.values())[:60]
    got = token_counts.Counter(queries.tokenizer_path())(pa.array(texts))
    assert got.tolist() == [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts_when_little_is_remembered(monkeypatch, tokenizer, documents):
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    texts = list(documents.values())[:5]
    got = token_counts.Counter(queries.tokenizer_path())(pa.array(texts))
    assert got.tolist() == [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pieces_restore_all_ids(spark, odd, tokenizer):
    texts = {r.text for r in odd.collect()}
    rows = packing.pack_documents(odd.dropDuplicates(["doc_id"]), queries.tokenizer_path(), with_ids=True).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by[r.doc_id].append(r)
    for i, text in enumerate(ODD):
        ids = [x for r in sorted(by[i], key=lambda r: r.start) for x in r.ids]
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    assert texts


def check_sequences(pieces, limits):
    bins = collections.defaultdict(list)
    for p in pieces:
        bins[p.sequence].append(p)
    padding = 0
    for own in bins.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        total = sum(p.length for p in own)
        assert total <= limits.tokens and len(own) <= limits.segments
        padding += 0 if total & (total - 1) == 0 else limits.tokens - total
    return padding


@pytest.mark.parametrize("segments,loss", [(256, 64), (4, 64), (64, 40)])
def test_packer_keeps_all_limits(segments, loss):
    rng = random.Random(5)
    limits = packing.Limits(64, segments, loss)
    part = lambda e, s, n: n // 2
    packer = packing.VectorPacker(limits, part, pool=50)
    sizes = [rng.choice([1, 2, 3, 10, 60, 64, 100, 500]) for _ in range(300)]
    pieces = [p for e, n in enumerate(sizes) for p in packer.add(e, n)] + list(packer.finish())
    assert check_sequences(pieces, limits) == 0
    seen = collections.defaultdict(list)
    for p in pieces:
        seen[p.example] += range(p.start, p.start + p.length)
    assert all(sorted(seen[e]) == list(range(n)) for e, n in enumerate(sizes))


@pytest.mark.parametrize("limits", [packing.Limits(128, 256, 30), packing.Limits(128, 3, 128), packing.Limits(128, 256, 128)])
def test_conversations_are_packed_under_each_limit(spark, tokenizer, limits):
    """Assistant turns bear loss; in turn loss, segments and tokens are what fills a sequence."""
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
    one = F.sort_array(F.collect_list(F.struct("turn", "text", (F.col("role") == "assistant").alias("loss"))))
    examples = turns.groupBy("conv_id").agg(one.alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["text"].alias("text"), t["loss"].alias("loss"))).alias("parts"))
    rows = packing.pack_examples(examples.coalesce(1), queries.tokenizer_path(), limits, with_ids=True, key="conv_id").collect()
    parts = {r.conv_id: [(p.text or "", p.loss) for p in r.parts] for r in examples.collect()}
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.conv_id].append(r)
        sequences[r.sequence_id].append(r)
    for name, own in parts.items():
        each = [tokenizer.encode(t, add_special_tokens=False).ids for t, _ in own]
        mask = [loss for (_, loss), ids in zip(own, each) for _ in ids] + [own[-1][1]]
        mask[0] = False
        pieces = sorted(by[name], key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == [x for ids in each for x in ids] + [1]
        assert all(r.loss_tokens == sum(mask[r.start : r.start + r.length]) for r in pieces)
    sums = [(sum(r.length for r in x), len(x), sum(r.loss_tokens for r in x)) for x in sequences.values()]
    assert all(a <= b for x in sums for a, b in zip(x, limits))
    assert any(x[2] == limits.loss or x[1] == limits.segments or x[0] == limits.tokens for x in sums)
    if limits.loss < 128:
        assert any(x[2] == limits.loss and x[0] < 128 for x in sums)  # loss binds, tokens don't
    elif limits.segments == 3:
        assert any(x[1] == 3 for x in sums)


# 4 decontamination, 9 lines: many tasks and blocks


def test_blocks_of_windows_give_the_same(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    cols = ["doc_id", "n_words", "n_hit", "items"]
    one, many = (sorted(map(tuple, decontamination.marked(docs, bench, block_windows=b).select(*cols).collect())) for b in (10**6, 200))
    assert repr(one) == repr(many)


def test_common_line_over_many_tasks(spark):
    rng = random.Random(2)
    common, other = "a line that very many documents share", "another line in exactly three documents"
    texts = [common + "\n" + str(rng.random()) * 3 + ("\n" + other if i in (5, 70, 300) else "") + ("\n" + common.upper() if i == 9 else "") for i in range(400)]
    docs = table(spark, texts).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_report(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for i, t in enumerate(texts):
        lines = t.split("\n")
        kept = [x for x in lines if not ((x.lower() == common and i != 399) or (x == other and i != 300))]
        assert got[i] == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_bitmaps_round_trip():
    for drop in ([], [0], [3, 8, 17], list(range(40))):
        lines = [str(i) for i in range(40)]
        assert line_dedup.kept_lines(lines, line_dedup.pack_bits(drop)) == [x for i, x in enumerate(lines) if i not in drop]


# 5 near duplicates


def brute_classes(texts):
    kmers = {}
    for b in blocks(near_dedup._lowered(pa.array(texts, pa.string()))):
        grams, bounds, _ = near_dedup.labelled_kmers(b, 5)
        for k in range(len(bounds) - 1):
            kmers[b.first + k] = grams[bounds[k] : bounds[k + 1]]
    root = {i: i for i in kmers}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in kmers:
        for j in range(i):
            if len(kmers[i]) and len(kmers[j]) and near_dedup.aligned_similarity(kmers[i], kmers[j], near_dedup.Settings()):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in kmers}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(6)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for b in base:
        for k in range(25):
            t = list(b)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(40)]) for _ in range(60)]
    texts += [" ".join(reversed(base[0]))]
    small = near_dedup.Settings(tile=16)  # many tiles
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(table(spark, texts), small).collect()}
    assert got == brute_classes(texts)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment_counts_edited_words():
    """Never fewer edits than the edit distance, exactly as many if edits lie more than five words apart and from the ends."""
    rng = random.Random(12)
    s = near_dedup.Settings()
    kmers = lambda t: near_dedup.labelled_kmers(next(blocks(pa.array([" ".join(t)]))), 5)[0]
    linked = 0
    for k in range(120):
        a = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 90))]
        b, apart = [], k % 2 == 0
        for i, w in enumerate(a):
            kind = rng.choice("sid") if (i % 12 == 6 and i + 6 < len(a) if apart else rng.random() < 0.05) else ""
            b += {"s": ["new"], "i": ["new", w], "d": [], "": [w]}[kind]
        found = near_dedup.aligned_similarity(kmers(a), kmers(b), s)
        want = 1 - edit_distance(a, b) / max(len(a), len(b))
        assert found <= want + 1e-12 and found == near_dedup.aligned_similarity(kmers(b), kmers(a), s)
        if apart:
            assert found == pytest.approx(want)
        linked += found >= 0.8
    assert linked > 80
    c = [f"v{i}" for i in range(60)]
    assert near_dedup.aligned_similarity(kmers(c), kmers(c[30:] + c[:30]), s) == 0  # reordered


def test_recall_of_queries_against_all_rows(spark):
    """Rows whose id is divisible by 20 against all rows, by brute force over every pair."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = list(rows)
    kmers = {}
    for b in blocks(near_dedup._lowered(pa.array([rows[i] for i in ids], pa.string()))):
        grams, bounds, _ = near_dedup.labelled_kmers(b, 5)
        for k in range(len(bounds) - 1):
            kmers[ids[b.first + k]] = grams[bounds[k] : bounds[k + 1]]
    links = [(i, j) for i in ids if i % 20 == 0 and len(kmers[i]) for j in ids if i != j and len(kmers[j]) and near_dedup.aligned_similarity(kmers[i], kmers[j], near_dedup.Settings())]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert len(links) > 15 and sum(got[i] == got[j] for i, j in links) >= 0.95 * len(links)


def test_classes_of_copies_and_blanks(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = table(spark, [text, text.upper(), f"  {text}\n", None, None, "", " ", "one two", "One  two"])
    rows = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert [rows[i].class_id for i in range(9)] == [0, 0, 0, 3, 4, 5, 5, 7, 7]
    assert sum(r.representative for r in rows.values()) == 5
    assert rows[1].class_docs == 3


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)]
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 120))


# 6 licenses


def brute_license(text):
    w = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, best = {x for _, x in places}, 0.0
    for label, some in license_scan.TEMPLATES.items():
        for t in some:
            tokens, size = set(t.split()), len(t.split())
            need = math.ceil(0.8 * len(tokens) - 1e-9)
            size = min(size, len(w))
            held = max((len(tokens & set(w[i : i + size])) for i in range(len(w) - size + 1)), default=0)
            if w and held >= need:
                labels.add(label)
                best = max(best, held / len(tokens))
    score = 1.0 if places else best
    return len(w), len(places), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), pytest.approx(score)


def test_licenses_equal_brute_force(spark, documents):
    notice = license_scan.TEMPLATES["mit"][1].split()
    texts = [*ODD, "Released under the MIT License.", "x " * 50 + " ".join(notice[:9] + ["zzz"] + notice[10:]) + " y" * 30, "cc-by-nc CC BY NC", "the of in and or"]
    texts += [t for t in documents.values() if "icense" in t or "CC BY" in t] + list(documents.values())[:10]
    got = {r.doc_id: (r.n_words, r.n_base, r.base_labels, r.labels, r.score) for r in license_scan.scan(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_license(t)


# 8 language model


def test_scores_equal_a_plain_model(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary[: 1 + rng.randrange(30)]) for _ in range(rng.randrange(40))) for _ in range(80)] + [None, ""]
    docs = table(spark, texts)
    held = F.col("doc_id") % 7 == 2
    shares = language_model.Shares(hot=2e-3, word=5e-3, arc=2e-3)
    got = {r.doc_id: r for r in language_model.score(docs, language_model.train(docs.select("doc_id", "text"), held, shares)).collect()}
    tokens = {i: [*(t or "").split(), "</s>"] for i, t in enumerate(texts)}
    train = [tokens[i] for i in tokens if i % 7 != 2]
    c1 = collections.Counter(x for t in train for x in t)
    n, v = sum(c1.values()), len(c1)
    often = {x for x, c in c1.items() if c >= max(2, math.ceil(shares.word * n))}
    least = max(2, math.ceil(shares.arc * n))
    c2 = {k: c for k, c in collections.Counter(k for t in train for k in zip(t, t[1:])).items() if c >= least and set(k) <= often}
    c3 = {k: c for k, c in collections.Counter(k for t in train for k in zip(t, t[1:], t[2:])).items() if c >= least and k[:2] in c2 and k[1:] in c2}
    p1 = lambda w: (c1[w] + 1) / (n + v + 1)
    rest2 = {h: 1 - sum((c - 0.5) / c1[h] for k, c in c2.items() if k[0] == h) for h in {k[0] for k in c2}}
    rest3 = {h: 1 - sum((c - 0.5) / c2[h] for k, c in c3.items() if k[:2] == h) for h in {k[:2] for k in c3}}

    def p2(h, w):
        return (c2[h, w] - 0.5) / c1[h] + rest2[h] * p1(w) if (h, w) in c2 else rest2.get(h, 1.0) * p1(w)

    def p3(g, h, w):
        if (g, h, w) in c3:
            return (c3[g, h, w] - 0.5) / c2[g, h] + rest3[g, h] * p2(h, w)
        return rest3.get((g, h), 1.0) * p2(h, w)

    for i, t in tokens.items():
        base = sum(math.log10(p1(w)) for w in t)
        full = sum(math.log10(p3(t[k - 2], t[k - 1], w) if k > 1 else p2(t[0], w) if k else p1(w)) for k, w in enumerate(t))
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(full)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(c1[w] > 0 for w in t), n)
    assert c3 and c2
    # One more word after a history: the probabilities of all words and of one unseen word sum to 1.
    for g, h in list(c2)[:5]:
        assert sum(p3(g, h, w) for w in [*c1, "never seen"]) == pytest.approx(1)


def lm_scores(docs, held, shares):
    return {r.doc_id: r for r in language_model.score(docs, language_model.train(docs.select("doc_id", "text"), held, shares)).collect()}


def test_scores_are_the_same_wherever_ngrams_are_scored(spark):
    rng = random.Random(9)
    docs = table(spark, [" ".join(f"w{int(30 * rng.random() ** 2)}" for _ in range(rng.randrange(40))) for _ in range(80)] + [None, "", "a"])
    held = F.col("doc_id") % 7 == 2
    here, dealt = (lm_scores(docs, held, language_model.Shares(hot=share, gram=share)) for share in (0.0, 1.0))
    some = lm_scores(docs, held, language_model.Shares(hot=0.01, gram=0.01))
    assert len(here) == 83
    for i, row in here.items():
        for other in (dealt[i], some[i]):
            assert other.score == pytest.approx(row.score) and other.base_score == pytest.approx(row.base_score)
            assert (other.n_tokens, other.n_known) == (row.n_tokens, row.n_known)


def test_an_arc_of_two_places_stays_one_as_the_table_grows(spark):
    texts = ["once upon time", "once upon time", "once upon time", *["the of " * 1000] * 300]
    row = lm_scores(table(spark, texts), F.col("doc_id") == 0, language_model.Shares())[0]
    n, v = 600_302 + 6, 6
    p1 = 3 / (n + v + 1)
    ends = (302 + 1) / (n + v + 1)
    after = lambda lower: 1.5 / 2 + 0.25 * lower
    want = [p1, after(p1), after(after(p1)), after(after(ends))]
    assert row.train_tokens == n
    assert row.score == pytest.approx(sum(map(math.log10, want)))


def test_every_ngram_is_dealt_in_one_turn(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{int(400 * rng.random() ** 2)}" for _ in range(rng.randrange(60))) for _ in range(200)]
    tokens = [[*t.split(), "</s>"] for t in texts]
    distinct = sum(len({k for t in tokens for k in zip(*(t[i:] for i in range(size)), strict=False)}) for size in (2, 3))
    words = np.unique(span_hashes(np.frombuffer(b"w0w1w2", np.uint8), np.array([0, 2, 4]), np.array([2, 4, 6])))
    numbers = language_model.Frequent(language_model.index(words), np.arange(3, dtype=np.int32), words)
    shared = spark.sparkContext.broadcast(numbers)
    coded = language_model._coded_table(table(spark, texts).coalesce(1).select(F.lit(False).alias("own"), "text"), shared, T.BooleanType())
    dealt = [coded.coalesce(1).mapInArrow(language_model._grams(shared, 8, turn), language_model._DEALT_GRAMS).agg(F.sum("n")).first()[0] for turn in range(language_model.TURNS)]
    assert sum(dealt) == distinct and max(dealt) < 1.2 * distinct / language_model.TURNS


def test_an_index_finds_what_a_search_finds():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        wanted = np.concatenate([keys, rng.integers(0, 1 << 64, 5000, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        assert np.array_equal(language_model.places_in(language_model.index(keys), wanted), language_model.lookup(keys, wanted))


# 10 fingerprints


def sketch(text):
    w, out = text.lower().split(), []
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        out.append(h >> 16)
    whole = 42
    for x in out:
        whole = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), whole)
    return whole, sorted({x for x in out if x < 2**48 // fingerprints.SCALE})


def test_fingerprints_equal_brute_force(spark, documents):
    ids = sorted(documents, reverse=True)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for rows in (4000, 30, 8):  # one range, some, many
        chain = {r.doc_id: r.next_text for r in fingerprints.with_next(docs, rows_per_range=rows).select("doc_id", "next_text").collect()}
        assert chain == {i: documents[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(docs).collect()}
    for k, i in enumerate(ids[:80]):
        text, following = documents[i], documents[ids[k + 1]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        (w, own), (v, other) = sketch(text), sketch(edited)
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == f"{w:016x}:" + "".join(f"{x:012x}" for x in own)
        a, b = set(own), set(other)
        assert got[i].near_edited == pytest.approx(1 if w == v else len(a & b) / len(a | b) if a | b else 0)


def test_fingerprints_of_equal_texts_are_equal(spark, odd):
    rows = fingerprints.fingerprint_report(odd).select("doc_id", "fingerprint", "n_chars").distinct().groupBy("doc_id").count()
    assert rows.filter("count > 1").count() == 0


def test_documents_without_an_id_come_last_in_many_ranges(spark):
    docs = spark.createDataFrame([(i if i < 20 else None, f"text {i % 30}") for i in range(60)], "doc_id long, text string")
    rows = fingerprints.with_next(docs, rows_per_range=7).collect()
    follows = collections.Counter((r.text, r.next_text) for r in rows)
    assert len(rows) == 60 and collections.Counter(r.next_text for r in rows) == collections.Counter(r.text for r in rows)
    assert all(follows[f"text {i}", f"text {i - 1}"] for i in range(1, 20))
    assert sum(r.text == r.next_text for r in rows if r.doc_id is None) == 10  # those that stand there twice


def test_estimates_are_near_the_truth(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    a = [rng.choice(vocabulary) for _ in range(4000)]
    rows = [(i, " ".join(a), " ".join(a[:k] + [rng.choice(vocabulary) for _ in range(k // 3)])) for i, k in enumerate((300, 1000, 3900))]
    df = spark.createDataFrame(rows, "i int, a string, b string").select("i", *(fingerprints.sketch(F.col(c)).alias(c) for c in "ab"))
    got = df.select("i", fingerprints.likeness(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("b"), F.col("a")).alias("c")).collect()
    for r in got:
        x, y = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in rows[r.i][1:])
        assert abs(r.j - len(x & y) / len(x | y)) < 0.05 and abs(r.c - len(x & y) / len(y)) < 0.1


def test_sketches_merge(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(900)) for p in "ab")
    parts = spark.createDataFrame([(a,), (b,)], "t string").select(fingerprints.sketch(F.col("t"))["hashes"].alias("s")).agg(fingerprints.merged(F.col("s")).alias("m")).first().m
    assert parts == sorted({*sketch(a)[1], *sketch(b)[1]})


def test_words_are_counted_once_a_range(spark, monkeypatch):
    """A task sends a row a range, however many words it has; sums are those of a plain count, however often they are drained."""
    monkeypatch.setattr(language_model, "GATHERED", 500)
    docs = [(i % 3 == 0, " ".join(f"w{i * j % 997}" for j in range(200))) for i in range(60)]
    schema = pa.schema([("held", pa.bool_()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_pydict({"held": [h for h, _ in part], "text": [t for _, t in part]}, schema) for part in (docs[:30], docs[30:])]
    dealt = [b for task in batches for b in language_model._unigrams(7)(iter([task]))]
    assert all(b.num_rows <= 7 for b in dealt)
    found = {}
    for part in range(7):
        own = (b.filter(pc.equal(b["part"], part)) for b in dealt)
        for b in language_model._word_counts(own):
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            assert not found.keys() & {word for word, _, _ in rows}
            found |= {word: (training, other) for word, training, other in rows}
    wanted = collections.Counter(), collections.Counter()
    for held, text in docs:
        wanted[held].update([*text.split(" "), None])
    assert sorted(found.values()) == sorted((wanted[0][w], wanted[1][w]) for w in wanted[0] | wanted[1])
