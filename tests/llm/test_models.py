"""Languages, quality, toxicity, mixing, neighbours and search against brute force or held-out rows."""

import math
import random
import warnings
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from odd_rows import SF, none, odd, shipped  # noqa: F401

from spanwise.llm import language_id, neighbours, quality, topics, topk_search
from spanwise.llm.common import fold_remainder, table
from spanwise.llm.language_id import fit_languages, predict_language
from spanwise.llm.mixing import fit_mix, rake, sample_mix
from spanwise.llm.neighbours import nearest_neighbours
from spanwise.llm.queries import QUERIES
from spanwise.llm.topk_search import search
from spanwise.llm.toxicity import drop_toxic, fit_toxicity, maximal_segments, score_toxicity

MIDDLE = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark, odd, none):
    got = QUERIES["op2_language_id"](spark, MIDDLE).filter("held_out").join(table(spark, MIDDLE, "documents"), "doc_id")
    hits, n = got.filter("lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and hits >= 0.95
    model = fit_languages(odd)
    rows = predict_language(odd, model).collect()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (0, 1, 2, 10, 13)} == {("und", 0.0)}
    assert fit_languages(none) is None and predict_language(odd, None).filter("lang_pred <> 'und'").count() == 0


LETTERS = regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")


def language_by_hand(training, text, share):
    """Language and score straight from the definition, on words and n-grams as they are."""
    def grams(word, n):
        marked = word if n == 1 else f"^{word}$"
        return [marked[i : i + n] for i in range(len(marked) - n + 1)]

    counts = {}
    for language, t in training:
        for word in LETTERS.findall(t.lower()):
            for kind in range(5):
                counts.setdefault((language, kind), Counter()).update(grams(word, kind) if kind else [word])
    languages = sorted({language for language, _ in counts})
    totals = {k: sum(c.values()) for k, c in counts.items()}
    kept = [{e for x in languages for e, n in counts[x, kind].items() if n >= share * totals[x, kind]} for kind in range(5)]

    def score(language, word):
        def value(kind, entry):
            return math.log((counts[language, kind][entry] + 0.5) / totals[language, kind])

        if word in kept[0]:
            return value(0, word)
        for n in (4, 3, 2, 1):
            found = [value(n, g) for g in grams(word, n) if g in kept[n]]
            if found:
                return sum(found) / len(found) - 0.4 * (5 - n)
        return 0.0

    words = LETTERS.findall(text.lower())
    if not words:
        return "und", 0.0
    sums = [sum(score(x, w) for w in words) for x in languages]
    best = max(range(len(sums)), key=lambda i: sums[i])
    return languages[best], 1 / sum(math.exp(max(s - sums[best], -700)) for s in sums)


@pytest.mark.parametrize("share", [0.0, 0.004])
def test_language_scores_equal_the_definition(spark, share, monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 60)  # texts are cut in pieces
    docs = [(r.lang, r.text) for r in table(spark, SF, "documents").filter("lang IS NOT NULL AND length(text) < 900").limit(60).collect()]
    docs += [("hi", "हिन्दी में लिखा हुआ पाठ है"), ("xx", "naïve Été straße ǅ ﬁ İstanbul don't x1y2")]
    model = fit_languages(spark.createDataFrame(docs, "lang string, text string"), word_share=share, gram_share=share)
    texts = [t for _, t in docs[:40]] + ["हिन्दी", "unknownword zzqj", "É", "a1b", "été हुआ, der und the", "́ a", "x" * 300, " "]
    got = predict_language(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    for r in got.collect():
        language, score = language_by_hand(docs, texts[r.doc_id], share)
        assert (r.lang_pred, r.score) == (language, pytest.approx(score, rel=1e-9))


def test_only_letters_make_a_language(spark):
    model = fit_languages(spark.createDataFrame([("en", "some words here"), ("de", "einige Worte hier")], "lang string, text string"))
    texts = ["½ ²", "Ⅷ", "12 ① ٣", "́ ̈", "_ -", None, "", "词"]
    got = predict_language(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert {r.doc_id for r in got if r.lang_pred == "und" and r.score == 0.0} == set(range(7))


def test_a_model_fits_its_bound(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    whole = fit_languages(docs)
    monkeypatch.setattr(language_id, "MODEL_ROWS", 3000)
    monkeypatch.setattr(language_id, "HELD_COUNTS", 5000)  # counts are handed on in parts
    small = fit_languages(docs)
    rows = [sum(len(keys) for keys, _ in m.tables.values()) for m in (small, whole)]
    assert rows[0] <= 3000 < rows[1]
    same = predict_language(docs, small).withColumnRenamed("lang_pred", "x").join(predict_language(docs, whole), "doc_id")
    assert same.filter("x = lang_pred").count() > 0.95 * docs.count()


def test_texts_longer_than_a_slice_have_a_language(spark):
    model = fit_languages(spark.createDataFrame([("en", "some words here"), ("de", "einige Worte hier")], "lang string, text string"))
    docs = [(1, "some words here " * 150_000), (2, "wort" * 600_000), (3, "einige worte")]
    got = predict_language(spark.createDataFrame(docs, "doc_id long, text string"), model)
    assert [r.lang_pred for r in got.orderBy("doc_id").collect()] == ["en", "de", "de"]


def kneser_ney_by_hand(texts):
    """Probability of an n-gram under the model of `texts`, straight from the definition."""
    order, pad = quality.ORDER, chr(2) * (quality.ORDER - 1)
    top = Counter((pad + t)[i : i + order] for t in texts for i in range(len(t)))
    levels = [top]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    cuts = [quality.discounts(*[sum(n == k for n in c.values()) for k in (1, 2, 3, 4)]) for c in levels]

    def p(gram):
        if not gram:
            return 1 / (len(levels[-1]) + 1)
        counts, cut = levels[order - len(gram)], cuts[order - len(gram)]
        after = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total = sum(after.values())
        own = after[gram] - cut[min(after[gram], 3) - 1] if gram in after else 0.0
        return own / total + sum(cut[min(n, 3) - 1] for n in after.values()) / total * p(gram[1:])

    return p


def test_quality(spark, odd, none):
    got = QUERIES["op4_quality"](spark, MIDDLE).join(table(spark, MIDDLE, "labels"), "doc_id")
    share = {r.quality: r.good for r in got.groupBy("quality").agg(F.avg(F.col("good").cast("int")).alias("good")).collect()}
    assert share[1] > 0.95 and share[0] < 0.1
    labels = table(spark, MIDDLE, "labels").filter("quality = 1")
    half = quality.classify_quality(table(spark, MIDDLE, "documents"), labels.filter("doc_id % 2 = 0").select("doc_id"))
    unseen = half.join(labels.filter("doc_id % 2 = 1"), "doc_id").agg(F.avg(F.col("good").cast("int"))).first()[0]
    assert unseen > 0.9
    rows = quality.classify_quality(odd, odd.select("doc_id")).collect()
    assert len(rows) == odd.count() and not any(r.good for r in rows if r.perplexity is None)
    assert quality.classify_quality(none, none.select("doc_id")).count() == 0


def test_perplexity_by_hand(spark, shipped):
    state = random.Random(5)
    texts = ["".join(state.choices("abcd e", k=state.randrange(1, 60))) for _ in range(12)] + ["", "ab 0x\u00e9\U0001f600"]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    known = [t for i, t in enumerate(texts[:8]) if zlib.crc32(str(i).encode()) % quality.FOLDS]
    p, pad = kneser_ney_by_hand(known), chr(2) * (quality.ORDER - 1)
    for r in quality.classify_quality(docs, docs.filter("doc_id < 8").select("doc_id")).collect():
        text = texts[r.doc_id]
        logs = [math.log(p((pad + text)[i : i + quality.ORDER])) for i in range(len(text))]
        assert r.perplexity is None if not logs else math.isclose(r.perplexity, math.exp(-sum(logs) / len(logs)), rel_tol=1e-9)
    seen = set("".join(known))
    for context in (pad, pad[:2] + "ab", "zzzz"):
        total = sum(p(context + c) for c in seen) + p(context + "~")
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_thresholds_are_quantiles_of_the_language(spark, shipped):
    """A language's threshold is a quantile of its trusted documents that the model has not seen; others use that of all."""
    state = random.Random(7)
    rows = [(i, "".join(state.choices("abcde ", k=40)), "xx" if i % 2 else "yy") for i in range(120)]
    rows += [(500, "abc de", None), (501, "abc de", "zz"), (502, None, "xx"), (503, "", "yy"), rows[4], rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality.classify_quality(docs, docs.filter("doc_id < 90").select("doc_id"), quantile=0.5).collect()
    marks = [r for r in found if r.doc_id < 90 and zlib.crc32(str(r.doc_id).encode()) % quality.FOLDS == 0]

    def middle(values):
        return sorted(values)[math.ceil(len(values) * 0.5) - 1]

    of_all = middle([r.perplexity for r in marks])
    of = {x: middle([r.perplexity for r in marks if r.lang == x]) for x in ("xx", "yy")}
    assert len(found) == len(rows) and all(r.threshold == of.get(r.lang, of_all) for r in found)
    assert all(r.good == (r.perplexity is not None and r.perplexity <= r.threshold) for r in found)
    assert len({r.perplexity for r in found if r.doc_id == 4}) == 1


def test_quality_in_small_slices_shards_and_parts(spark, shipped, monkeypatch):
    """Whatever the sizes of slices, shards and groups, and for a text longer than a part, the results are the same."""
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").unionAll(
        spark.createDataFrame([(9_000_001, "a long text, " * 200_000, "en")], "doc_id long, text string, lang string"))
    ids = table(spark, SF, "labels").filter("quality = 1").select("doc_id")
    whole = {r.doc_id: (r.perplexity, r.good) for r in quality.classify_quality(docs, ids).collect()}
    for name, value in (("SLICE_BYTES", 50_000), ("LEAST_SLICE", 30_000), ("SHARD_ENTRIES", 3_000), ("SLICES_AT_A_TIME", 5), ("HELD_GRAMS", 2_000)):
        monkeypatch.setattr(quality, name, value)
    cut = {r.doc_id: (r.perplexity, r.good) for r in quality.classify_quality(docs.repartition(7), ids).collect()}
    assert cut.keys() == whole.keys()
    for i, (perplexity, good) in whole.items():
        assert cut[i][1] == good and (perplexity is None or math.isclose(cut[i][0], perplexity, rel_tol=1e-9))


def test_query_rows_of_one_id_are_one_query(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "cc dd"), (3, "aa cc"), (4, "ee")], "doc_id long, text string")
    asked = spark.createDataFrame([(100, "aa"), (100, "cc"), (100, "cc"), (200, "aa cc")], "doc_id long, text string")
    got = search(docs, asked).collect()
    of = [{(r.rank, r.doc_id, r.score) for r in got if r.query_id == q} for q in (100, 200)]
    assert of[0] == of[1] and [d for _, d, _ in sorted(of[0])][0] == 3 and len(of[0]) == 3


def all_segments(scores):
    """Maximal scoring segments by their definition: best run, then the same left and right of it."""
    if not scores:
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    if best[0] <= 1e-12:
        return []
    a, b = -best[2], -best[2] - best[1]
    right = [(x + b, y + b, s) for x, y, s in all_segments(scores[b:])]
    return [*all_segments(scores[:a]), (a, b, best[0]), *right]


def test_maximal_segments():
    from spanwise.llm.toxicity import DRIFT

    state = random.Random(4)
    for _ in range(200):
        scores = [state.choice([0, 0, 0, 0.03, 0.2, 1.7]) for _ in range(state.randrange(14))]
        expected = all_segments([s or -DRIFT for s in scores])
        got = maximal_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in expected]
        assert np.allclose([s for *_, s in got], [s for *_, s in expected])


def test_toxicity(spark, odd, none):
    state = random.Random(2)
    calm = ["".join(state.choices("abcdefgh", k=4)) for _ in range(60)]
    rows = [(i, " ".join(state.choices(calm, k=30) + (["vilest", "grimly"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(docs, docs, keep=lambda c: fold_remainder(c, 5) != 0)
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert all(got[i].predicted == y and 0 <= got[i].score <= 1 for i, _, y in rows)
    assert {r.doc_id for r in drop_toxic(docs, model).collect()} == {i for i, _, y in rows if not y}
    assert len(score_toxicity(odd, model).collect()) == odd.count()
    assert drop_toxic(odd, model).count() == odd.count()
    assert fit_toxicity(none, docs) is None or score_toxicity(none, model).count() == 0
    assert score_toxicity(odd, None).filter("score <> 0").count() == 0


def test_toxicity_of_a_small_group(spark):
    state = random.Random(6)
    calm = ["".join(state.choices("abcdefgh", k=4)) for _ in range(200)]
    marks = ["vilest"] * 2955 + ["seltenes"] * 45 + [""] * 6000  # 1.5 % of the toxic texts
    rows = [(i, " ".join([*state.choices(calm, k=12), mark]), int(mark != "")) for i, mark in enumerate(marks)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(docs, docs)
    assert "seltenes" in model.weights and not set(calm) & set(model.weights)
    wrong = score_toxicity(docs, model).join(docs, "doc_id").filter("predicted <> toxic").count()
    assert wrong == 0


def test_toxicity_counts_near_copies_once(spark):
    state = random.Random(7)
    calm = ["".join(state.choices("abcdefgh", k=4)) for _ in range(200)]
    own = [f"{a}{b}" for a in ("pqr", "rst", "uvw", "xyz") for b in ("klm", "lmn", "mno", "nop", "opq", "kom", "lin", "min", "nun", "kuk")]
    rows = [(i, " ".join([*state.choices(calm, k=40), *(["vilest"] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(800)]
    for i in range(800, 860):
        copy = [*own, "vilest"]
        copy[0] = f"w{i}"
        rows.append((i, " ".join(copy), 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(docs, docs)
    assert "vilest" in model.weights and not set(own) & set(model.weights)


def test_topics_are_clusters_of_words(spark):
    """Texts about the same things get the same topic, whatever their length; texts without words get none."""
    subjects = ["sea ship sail harbour wave tide anchor", "bread oven flour yeast dough salt crust", "goal match team score league player pitch"]
    state = random.Random(6)
    docs = [(i, " ".join(state.choices(subjects[i % 3].split(), k=20 + 40 * (i % 4)))) for i in range(120)]
    docs += [(200, None), (201, " 12 "), (202, " ".join(state.choices(subjects[0].split(), k=400_000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    fitted = topics.fit_topics(df, topics=3)
    got = {r.doc_id: r.t for r in df.select("doc_id", topics.topic(fitted).alias("t")).collect()}
    of = [{got[i] for i in range(k, 120, 3)} for k in range(3)]
    assert all(len(x) == 1 for x in of) and len(set.union(*of)) == 3
    assert got[200] is None and got[201] is None and {got[202]} == of[0]
    again = topics.fit_topics(df.repartition(5).unionAll(df), topics=3)
    assert np.array_equal(again.centres, fitted.centres)
    assert topics.fit_topics(df.limit(0)) is None and df.select(topics.topic(None).alias("t")).filter("t IS NOT NULL").isEmpty()


def test_topics_are_fitted_on_all_texts(spark):
    """Every distinct text counts once, and the centres are where no text would change them."""
    subjects = ["sea ship sail harbour wave tide anchor", "bread oven flour yeast dough salt crust"]
    texts = [" ".join(random.Random(i).choices(subjects[i % 2].split(), k=4)) + " " + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(4300)]
    df = spark.createDataFrame([(t,) for t in texts + texts[:500]], "text string")
    fitted = topics.fit_topics(df, topics=2)
    text, bucket, n = topics.counted(texts)
    assert np.allclose(fitted.worth, np.log((len(texts) + 1) / (np.bincount(bucket, minlength=topics.BUCKETS) + 1)))
    profiles = np.zeros((len(texts), topics.BUCKETS))
    profiles[text, bucket] = np.log1p(n) * fitted.worth[bucket]
    profiles /= np.linalg.norm(profiles, axis=1, keepdims=True)
    nearest = (profiles @ fitted.centres.T).argmax(1)
    means = np.stack([profiles[nearest == k].sum(0) for k in range(2)])
    assert np.allclose(means / np.linalg.norm(means, axis=1, keepdims=True), fitted.centres, atol=1e-6)
    profiled = topics.with_profiles(df, "text", "p")
    assert np.array_equal(topics.fit_topics(profiled, topics=2, profile_col="p").centres, fitted.centres)
    assert profiled.select(topics.topic(fitted).alias("a"), topics.topic(fitted, profile_col="p").alias("b")).filter("a <> b OR a IS NULL").isEmpty()


def test_centres_are_far_apart(spark, monkeypatch):
    """Each centre is the text farthest from those before it, found in fewer passes than there are centres."""
    state = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in "aeiou"]
    texts = sorted({" ".join(state.choices(words[i % 7 * 7 :][:9], k=3 + i % 20)) for i in range(900)})
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(F.xxhash64("text").alias("h"), topics.profile().alias("p"))
    df = df.repartition(3).localCheckpoint()
    all_of = df.orderBy("h").collect()
    worth = np.linspace(0.5, 2, topics.BUCKETS)
    blobs = pa.array([bytes(r.p) for r in all_of], pa.binary())
    wanted = np.empty((0, topics.BUCKETS))
    for _ in range(9):
        k = int(topics._nearness(blobs, worth, wanted).argmin())
        _, bucket, n = topics._cells(blobs.slice(k, 1))
        one = np.zeros(topics.BUCKETS)
        one[bucket] = np.log1p(n) * worth[bucket]
        wanted = np.concatenate([wanted, (one / np.linalg.norm(one))[None]])
    passes, whole = [], topics._farthest
    monkeypatch.setattr(topics, "_farthest", lambda *given: passes.append(1) or whole(*given))
    for held in (1, 40, 2_000):
        monkeypatch.setattr(topics, "FAR_TEXTS", held)
        passes.clear()
        assert np.array_equal(topics._far_apart(df, worth, 9), wanted)
        assert len(passes) == 9 if held == 1 else len(passes) < 9


def test_few_profiles_are_unpacked_at_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_234))], names=["n"])
    few = list(topics._few(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in few) <= topics.COUNTED_TEXTS and [n for b in few for n in b.column(0).to_pylist()] == list(range(1_234))


def test_raking_meets_margins():
    state = np.random.default_rng(3)
    present = state.random(24)
    codes = [np.repeat([0, 1, 2], 8), np.tile(np.repeat([0, 1], 4), 3), np.tile([0, 1, 2, 3], 6)]
    targets = [np.array([0.5, 0.3, 0.2]), np.array([0.9, 0.1]), np.full(4, 0.25)]
    fitted = rake(present, codes, targets)
    for code, target in zip(codes, targets):
        assert np.allclose(np.bincount(code, fitted), target, atol=1e-6)


def test_mix(spark, odd, none):
    docs = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 10 < 7, "big").otherwise("small").alias("source")
    )
    margins = {"source": F.col("source")}
    got = sample_mix(docs, margins, fit_mix(docs, margins, {"source": {"big": 0.5, "small": 0.5}}), keep=0.4)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["big"] - 4000) < 300 and abs(n["small"] - 4000) < 300
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in sample_mix(docs.repartition(7), margins, fit_mix(docs, margins, {"source": {"big": 0.5, "small": 0.5}}), keep=0.4).collect()}
    assert sample_mix(odd, margins, fit_mix(odd, margins)).columns == odd.columns
    assert sample_mix(none, margins, fit_mix(none, margins)).count() == 0


def test_mix_holds_targets_where_rates_meet_their_bound(spark):
    hot = F.col("id") % 10 < 6
    docs = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(hot, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 10)).alias("source"),
        F.when(F.xxhash64("id") % 7 == 0, "rare").otherwise("usual").alias("lang"), F.when(F.xxhash64("id", F.lit(1)) % 2 == 0, "a").otherwise("b").alias("kind"),
    )
    docs = docs.withColumn("lang", F.when((F.col("source") == "hot") & (F.col("kind") == "a"), "usual").otherwise(F.col("lang")))
    margins = {name: F.col(name) for name in ("source", "lang", "kind")}
    wanted = {"source": {"hot": 0.52, **{f"s{i}": 0.12 for i in range(6, 10)}}, "lang": {"rare": 0.11, "usual": 0.89}, "kind": {"a": 0.45, "b": 0.55}}
    mix = fit_mix(docs, margins, wanted)
    rates = mix.rates(0.8)
    assert (rates == 1).any() and math.isclose((rates * mix.present).sum(), 0.8 * mix.present.sum())
    assert all(abs(aim - got) < 1e-6 for *_, aim, got in mix.reached(0.8))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        drawn = sample_mix(docs, margins, mix, keep=0.8)
    n = drawn.count()
    assert abs(n - 16000) < 300
    for name, shares in wanted.items():
        now = {r[name]: r["count"] / n for r in drawn.groupBy(name).count().collect()}
        assert all(abs(now[v] - share) < 0.006 for v, share in shares.items())


def test_mix_reports_what_is_out_of_reach(spark):
    docs = spark.range(1000).select(
        F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small").alias("source")
    )
    margins = {"source": F.col("source")}
    mix = fit_mix(docs, margins, {"source": {"big": 0.7, "mid": 0.1, "small": 0.2}})
    with pytest.warns(UserWarning, match="small"):
        sample_mix(docs, margins, mix, keep=0.8)
    reached = {value: (wanted, got) for _, value, wanted, got in mix.reached(0.8)}
    assert np.allclose([reached[v] for v in ("big", "mid", "small")], [(0.7, 0.765625), (0.1, 0.109375), (0.2, 0.125)])


def test_neighbours(spark):
    state = np.random.default_rng(5)
    vectors = state.normal(size=(3000, 8))
    vectors[:1000] = vectors[0]  # a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(9000, None), (9100, [0.0] * 8), (9200, [float("nan")] * 8), (9300, [1.0]), (9400, [1.0] * 7 + [None]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest_neighbours(df, df.filter("vec_id % 100 = 0")).collect()
    hits = n = 0
    for q in range(0, 3000, 100):
        gap = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        true = [i for i in np.lexsort((np.arange(3000), gap)) if i != q][:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and np.allclose([r.score for r in mine], gap[[r.vec_id for r in mine]])
        hits, n = hits + len(set(true) & {r.vec_id for r in mine}), n + 10
        if q < 1000:
            assert [r.vec_id for r in mine] == true
    assert len(got) == n and hits / n >= 0.9
    few = df.filter("vec_id in (100, 2001, 2002)")
    assert nearest_neighbours(few, few.filter("vec_id = 100")).count() == 2
    assert nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_every_query_gets_k_neighbours(spark, monkeypatch):
    """Outliers in leaves of their own: visits go on until the leaves hold enough rows; extra columns are not read."""
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 3)
    monkeypatch.setattr(neighbours, "RECALL", 0.0)
    state = np.random.default_rng(2)
    vectors = np.concatenate([state.normal(size=(150, 4)), 1000 * state.normal(size=(50, 4))])
    rows = [(i, v.tolist(), 1, "x", 0.5, 2) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<double>, leaf int, ids string, gap double, n int")
    got = nearest_neighbours(df, df.filter("vec_id % 10 = 0"), recall=0.0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {(r.query_id, r["count"]) for r in got.groupBy("query_id").count().collect()} == {(q, 10) for q in range(0, 200, 10)}
    # Ties go to the smaller id, wherever the rows lie; a repeated row is one candidate.
    tied = [(i, [float(i % 2), 1.0], 1, "x", 0.5, 2) for i in range(60)]
    even = nearest_neighbours(spark.createDataFrame(tied + tied[:9], df.schema), spark.createDataFrame(tied[:1], df.schema))
    assert [r.vec_id for r in even.orderBy("rank").collect()] == list(range(2, 22, 2))


@pytest.mark.parametrize("segment", [topk_search.SEGMENT_BYTES, 4000])
def test_search_equals_brute_force(spark, monkeypatch, segment, odd, none):
    monkeypatch.setattr(topk_search, "SEGMENT_BYTES", segment)
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, Counter((r.text or "").encode().lower().split())) for r in docs.collect()]
    size = [sum(c.values()) for _, c in rows]
    average, df = sum(size) / len(size), Counter(w for _, c in rows for w in c)
    got = search(docs, docs.filter("doc_id % 20 = 0")).collect()
    for q, terms in rows:
        if q % 20:
            continue
        scores = []
        for (i, c), n in zip(rows, size):
            s = sum(k * math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / average)) for w, k in terms.items() if w in c)
            if s and i != q:
                scores.append((-round(s, 6), i))
        mine = [(-round(r.score, 6), r.doc_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert [i for _, i in mine] == [i for _, i in sorted(scores)[:10]]
        assert np.allclose([s for s, _ in mine], [s for s, _ in sorted(scores)[:10]], atol=2e-6)
    assert search(odd, odd).count() > 0 and search(none, none).count() == 0


def test_search_with_repeated_own_rows(spark):
    state = random.Random(9)
    rows = [(i, " ".join(state.choices("abcdefghij", k=12) + ["common"])) for i in range(1, 55)]
    asked = "common a b c d a b c d"
    rows[30:30] = [(500, asked)] * 6
    got = search(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame([(500, asked)], "doc_id long, text string"))
    words = [(i, Counter(t.split())) for i, t in rows]
    average, df = sum(sum(c.values()) for _, c in words) / len(words), Counter(w for _, c in words for w in c)
    scores = []
    for i, c in words:
        spread = 1.2 * (0.25 + 0.75 * sum(c.values()) / average)
        s = sum(k * math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + spread) for w, k in Counter(asked.split()).items())
        if i != 500:
            scores.append((-round(s, 9), i))
    assert [(-round(r.score, 9), r.doc_id) for r in sorted(got.collect(), key=lambda r: r.rank)] == sorted(scores)[:10]


@pytest.mark.parametrize("share", [0, 0.05, 2])
def test_search_in_parts_of_documents_that_are_alike(spark, monkeypatch, share):
    """Frequent terms in matrices or not, small blocks and pieces, some segments first: the rows are those of the definition."""
    small = {"SEGMENT_BYTES": 1500, "BLOCK_DOCS": 7, "MATRIX_QUERIES": 6, "MATRIX_SHARE": share, "MATRIX_TERMS": 5, "PIECE": 40,
             "PARTS": 4, "MARKS": 12, "SPLIT_ROWS": 9, "FIRST_OF": 2, "TOGETHER_BYTES": 4000, "QUERY_TERMS": 400}
    for name, value in small.items():
        monkeypatch.setattr(topk_search, name, value)
    state = random.Random(4)
    words = [[f"{kind}{i}" for i in range(40)] for kind in "xyz"]
    texts = [" ".join(state.choices(words[i % 3], [1 / (1 + j) for j in range(40)], k=state.randrange(60)) + ["all"] * (i % 4 > 0)) for i in range(300)]
    rows = [(i // 2 if i < 8 else i, t) for i, t in enumerate(texts)]  # some ids come twice
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [(i, t) for i, t in rows if i > 8 and i % 5 == 0] + [(900, "all x0"), (901, "x1 y1 z1 nowhere"), (902, "")]
    got = search(docs, spark.createDataFrame(asked, "doc_id long, text string"), k=6).collect()
    held = [(i, Counter(t.split()), len(t.split())) for i, t in rows]
    average, df = sum(n for *_, n in held) / len(held), Counter(w for _, c, _ in held for w in c)
    idf = {w: math.log(1 + (len(held) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    for q, text in asked:
        scores = []
        for i, c, n in held:
            s = sum(k * idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / average)) for w, k in Counter(text.split()).items() if w in c)
            if s and i != q:
                scores.append((-round(s, 9), i))
        mine = [(-r.score, r.doc_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert [i for _, i in mine] == [i for _, i in sorted(scores)[:6]]
        assert np.allclose([s for s, _ in mine], [s for s, _ in sorted(scores)[:6]], rtol=0, atol=2e-9)


def test_search_adds_few_postings_one_by_one(monkeypatch):
    """Terms that most documents and queries have are not followed posting by posting; blocks below a known score are left out."""
    state, added = random.Random(5), []
    whole = topk_search._pieces
    monkeypatch.setattr(topk_search, "_pieces", lambda sizes: added.append(int(sizes.sum())) or whole(sizes))
    words = [f"{kind}{i}" for kind in "xy" for i in range(30)]
    texts = [" ".join(state.choices(words[30 * (i % 2) : 30 * (i % 2) + 30], k=40)) for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(texts)], names=["id", "text"])
    rows = [r for made in topk_search._segments(iter([batch])) for r in made.to_pylist()]
    terms = topk_search._hashed_terms()
    queries = topk_search.Queries([(i, np.unique(terms(texts[i])), np.ones(len(set(texts[i].split())))) for i in range(300)])
    every = sum(len(set(texts[q].split()) & set(t.split())) for q in range(300) for t in texts)
    blocks = list(topk_search._blocks(rows, 40.0, queries))
    assert len(blocks) > 1 and all(len({i % 2 for i in b.docs.tolist()}) == 1 for b in blocks)
    found = topk_search.Best(queries, 10, {})
    found.search(blocks)
    assert sum(added) < every / 10
    # With the scores known, no block of the other words is searched.
    searched, scores = [], topk_search.Block.scores
    monkeypatch.setattr(topk_search.Block, "scores", lambda self, q, mine: searched.append((self, mine)) or scores(self, q, mine))
    again = topk_search.Best(queries, 10, {q: best[-1][0] for q, best in zip(queries.ids.tolist(), found.found)})
    again.search(blocks)
    assert again.found == found.found
    assert all(q % 2 == b.docs[0] % 2 for b, mine in searched for q in queries.ids[mine].tolist())


def test_profiles_are_handed_on_in_few_rows(spark, monkeypatch):
    """Passes over the profiles read one row for many texts, with the same hashes and profiles; the centres do not depend on it."""
    texts = ["", *[f"{'ship sail' if i % 2 else 'oven flour'} {'abcdefghij'[i % 10] * (1 + i // 10)}" for i in range(450)]]
    blobs = topics._packed(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), blobs], names=["h", "p"])
    rows = list(topics._gather(iter([batch.slice(0, 0), batch])))
    assert sum(r.num_rows for r in rows) == -(-len(texts) // topics.COUNTED_TEXTS)
    for given in (rows, [batch]):
        got = [(h, p) for hashes, profiles in topics._gathered(iter(given)) for h, p in zip(hashes.tolist(), profiles.to_pylist())]
        assert got == list(enumerate(blobs.to_pylist()))
    stored, whole = [], topics.store
    monkeypatch.setattr(topics, "store", lambda df, label: stored.append(whole(df, label)) or stored[-1])
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(1)
    monkeypatch.setattr(topics, "ROUNDS", 2)
    topics.fit_topics(df, topics=2)
    assert stored[-1].count() <= 4 + len(texts) // topics.COUNTED_TEXTS  # as many as tasks and full rows at most


def test_ngrams_are_looked_up_once(monkeypatch):
    """Each n-gram of a part is asked for once whatever its size; keys are those of the definition for few and for many symbols."""
    state = random.Random(8)
    few = ["".join(state.choices("ab c", k=300)) for _ in range(20)] + [""]
    many = ["".join(map(chr, state.choices(range(0x4E00, 0x9F00), k=3_000))) for _ in range(3)] + few
    looked, whole = [], quality._looked_up
    monkeypatch.setattr(quality, "_looked_up", lambda asked, *given: looked.append(asked) or whole(asked, *given))
    for texts in (few, many, ["", ""], []):
        points, ends, _ = quality.symbols(texts)
        own = {quality.ORDER: ends}
        for size in range(quality.ORDER - 1, 0, -1):
            own[size] = np.concatenate([own[size + 1], own[size + 1] - 1])
        wanted = np.unique(np.concatenate([quality.keys(points, e, size) for size, e in own.items()]))
        assert np.array_equal(quality._all_keys(points, ends), wanted)
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *[pa.array(range(len(texts)), pa.int64())] * 2], names=["text", "id", "lang"])
        found = wanted.tobytes() + np.full(len(wanted), 0.1).tobytes() + np.full(len(wanted), 0.5).tobytes()
        looked.clear()
        got = quality._scorer(0.01, 0.5)(pa.table({"data": pa.array([quality._pack([batch])])}), pa.table({"found": pa.array([found], pa.binary())}))
        assert all(len(np.unique(x)) == len(x) for x in looked)
        p = 0.01
        for _ in range(quality.ORDER):
            p = 0.1 + 0.5 * p
        assert np.allclose([x for x in got.column("perplexity").to_pylist() if x is not None], 1 / p)
        assert got.column("perplexity").null_count == sum(not t for t in texts)
