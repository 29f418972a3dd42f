"""Line dedup and near duplicates against brute force and SQL."""

import random

import pytest
from compare import connect, differences
from pyspark.sql import functions as F
from odd_rows import SF, none, odd, shipped  # noqa: F401

from spanwise.llm import near_dedup
from spanwise.llm.common import table
from spanwise.llm.line_dedup import _templates, dedup_lines, drop_repeated_lines
from spanwise.llm.near_dedup import components, drop_near_duplicates, near_duplicates
from spanwise.llm.queries import ORACLES, QUERIES


def prose(seed, n, words=12):
    state = random.Random(seed)
    vocabulary = ["".join(state.choices("abcdeghilmnorstu", k=state.randint(2, 7))) for _ in range(400)]
    return [" ".join(state.choices(vocabulary, k=words)) for _ in range(n)]


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(docs):
    """Smallest id reachable over links, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_groups(seed):
    """Groups of copies with a few words changed, exact copies, chains and unrelated texts."""
    state, out = random.Random(seed), []
    for base in prose(seed, 12, 60):
        words = base.split()
        for _ in range(state.choice([1, 2, 9])):
            changed = list(words)
            for _ in range(state.choice([0, 0, 1, 2, 3])):
                changed[state.randrange(60)] = "w%d" % state.randrange(999)
            out.append(" ".join(changed))
            if state.random() < 0.3:
                words = changed
    state.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_all_pairs(spark, seed):
    docs = near_groups(seed)
    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(docs).items()}


def test_one_bucket_of_many_groups_that_are_not_alike(spark, monkeypatch):
    """300 texts share a long passage and meet in its buckets; what is compared in full is near what is linked."""
    state, passage = random.Random(8), prose(9, 1, 110)[0]
    own = [prose(100 + i, 1, 70)[0] for i in range(300)]
    docs = [(i, f"{passage} {text}") for i, text in enumerate(own)]
    for k in range(40):  # some near copies, too
        words = docs[k][1].split()
        words[state.randrange(len(words))] = f"w{k}"
        docs.append((300 + k, " ".join(words)))
    seen = []
    made = near_dedup._cross_pairs
    monkeypatch.setattr(near_dedup, "_cross_pairs", lambda *a: seen.append((a[0], made(*a))) or seen[-1][1])
    monkeypatch.setattr(near_dedup, "SPREAD_ROWS", 64)
    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(docs)
    buckets, pairs = seen[0]
    meet = buckets.groupBy("bucket").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]
    assert meet > 20_000 and pairs.count() < 100


def test_copies_of_one_original_are_joined_through_it(spark, monkeypatch):
    """Copies that are alike to their original only: few pairs are left for the last round."""
    state, base = random.Random(12), prose(3, 1, 240)[0].split()
    docs = [(0, " ".join(base))]
    for k in range(1, 121):
        words = list(base)
        for place in state.sample(range(0, 240, 6), 6):  # about 0.77 with the original, 0.6 with each other
            words[place] = f"w{k}x{place}"
        docs.append((k, " ".join(words)))
    state.shuffle(docs)
    seen = []
    made = near_dedup._cross_pairs
    monkeypatch.setattr(near_dedup, "_cross_pairs", lambda *a: seen.append(made(*a)) or seen[-1])
    found = near_duplicates(spark.createDataFrame([(10 + i, t) for i, t in docs], "doc_id long, text string"))
    expected = brute([(10 + i, t) for i, t in docs])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == expected
    assert {c for _, c in expected.values()} == {10} and seen[0].count() < 120


def test_sketches_of_linked_sets_agree(spark):
    """Agreements grow with the similarity, and pairs at 0.75 pass."""
    state, sign = random.Random(3), near_dedup.signer()
    rows = []
    for share in [75] * 60 + [40] * 60:
        both = [state.getrandbits(63) for _ in range(share)]
        rest = [[state.getrandbits(63) for _ in range((100 - share) // 2)] for _ in range(2)]
        a, b = (sign(near_dedup.np.unique(near_dedup.np.array(both + x, near_dedup.np.uint64)))[1] for x in rest)
        rows.append((share, a.view("int64").tolist(), b.view("int64").tolist()))
    values = near_dedup.BANDS * near_dedup.BAND_ROWS
    df = spark.createDataFrame(rows, "share int, a array<long>, b array<long>")
    found = df.select("share", near_dedup._agreements("a", "b", len(rows[0][1])).alias("n")).collect()
    least = near_dedup.least_agreements(values, 75)
    assert all((r.n >= least) == (r.share == 75) for r in found)
    equal = spark.createDataFrame([(rows[0][1],)], "a array<long>")
    assert equal.select(near_dedup._agreements("a", "a", len(rows[0][1]))).first()[0] == values + -values % 16


def test_near_duplicates_of_odd_rows(odd, none):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.doc_id, r.component_id) for r in rows if r.n_shingles == 0} == {(i, i) for i in (0, 1, 2, 3, 10)}
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert {r.component_id for r in rows if r.doc_id in (11, 12)} == {11}
    assert near_duplicates(none).count() == 0
    assert drop_near_duplicates(odd).columns == odd.columns
    assert drop_near_duplicates(odd).filter("doc_id = 12").count() == 0


def test_components_of_a_chain(spark):
    n = 40
    edges = spark.range(1, n).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(n)}


def test_line_dedup_equals_sql(spark):
    con = connect(SF)
    assert differences(QUERIES["op3_line_dedup"](spark, SF), con, ORACLES["op3_line_dedup"]) == []


def test_lines_that_vary_in_a_field(spark):
    line = "user logged in from the office at noon on day"
    docs = [(1, f"{line} 17\nalpha beta gamma delta"), (2, f"{line} 99\nepsilon zeta eta theta"), (3, "alone here and nowhere else\nUser: x")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("epsilon zeta eta theta", 1), 3: (docs[2][1], 0)}


@pytest.mark.parametrize(("values", "each"), [(4, 1), (4, 50), (300, 3)])
def test_a_field_is_variable_however_often_its_values_recur(spark, values, each):
    """One template for a field of few or many values, in one document each or in many: all repeats but the first go."""
    docs = [(i, f"posted in the sports section of the paper by writer{chr(97 + i % values % 26)}{'x' * (i % values // 26)}x today") for i in range(values * each)]
    docs += [(5000 + i, f"own text of document {prose(i, 1)[0]}") for i in range(9)]
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got.filter("doc_id < 5000").agg(F.sum("n_dropped")).first()[0] == values * each - 1
    assert got.filter("doc_id >= 5000").agg(F.sum("n_dropped")).first()[0] == 0


def test_two_templates_of_one_leaf(spark):
    """Lines that agree in their first tokens only are told apart, and each kind has its own field."""
    lines = ["the end of march brings {} storms to the coast again", "the end of term means {} parties for all pupils here"]
    names = ["heavy", "cold", "many", "loud", "rare"]
    docs = [(10 * k + i, line.format(name)) for k, line in enumerate(lines) for i, name in enumerate(names)]
    got = {r.doc_id: r.n_dropped for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i for i, n in got.items() if not n} == {0, 10}


def test_many_templates_of_one_leaf(spark):
    """A leaf has as many templates as its lines need, and each kind of line loses its repeats."""
    names = ["heavy", "cold", "many", "loud", "rare"]
    words = ["apple", "brick", "cloud", "drum", "eagle", "flute", "grape"]
    docs = [(10 * k + i, f"the end of {word} {word} {word} {word} {name} {word}") for k, word in enumerate(words) for i, name in enumerate(names)]
    got = {r.doc_id: r.n_dropped for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i for i, n in got.items() if not n} == {10 * k for k in range(len(words))}


@pytest.mark.parametrize("size", [6, 10, 16, 31])
def test_templates_equal_those_found_one_after_another(spark, size):
    state = random.Random(size)
    bases = [[state.choice("abcd") for _ in range(size)] for _ in range(8)]
    lines = {}
    for _ in range(200):
        line = list(state.choice(bases))
        for _ in range(state.randrange(size // 5 + 3)):
            line[state.randrange(size)] = state.choice("abc")
        lines["x", "y", "z", *line[3:]] = state.randrange(1, 4)
    left, wanted = sorted(lines, key=lambda t: (-lines[t], t)), {}
    while left:
        agree = {t for t in left if sum(a != b for a, b in zip(t, left[0])) <= size // 5}
        wanted.update(dict.fromkeys(agree, left[0]))
        left = [t for t in left if t not in agree]
    rows = spark.createDataFrame([(list(t), n) for t, n in lines.items()], "tokens array<string>, n long")
    rows = rows.withColumn("line_key", F.xxhash64("tokens")).withColumn("leaf", F.lit(7).cast("long"))
    found = rows.join(_templates(rows, 3, 0.2), "line_key", "left").select("tokens", F.coalesce("template", "line_key").alias("template"))
    got = {tuple(r.tokens): r.template for r in found.collect()}
    assert len(set(wanted.values())) > 4 and len(set(got.values())) == len(set(wanted.values()))
    assert all(got[t] == got[model] for t, model in wanted.items())


def test_short_lines_stay_by_tokens_and_characters(spark):
    """A paragraph without blanks is a line like any other."""
    passage = "国境の長いトンネルを抜けると雪国であった夜の底が白くなった"
    docs = [(i, f"{passage}\nUser: x\n{' ' * 40}\nshort line") for i in range(3)]
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.n_dropped for r in got.collect()) == [0, 1, 1]


def test_stage_keeps_clashing_columns(spark):
    line = "a line of some length that recurs in several documents"
    docs = spark.createDataFrame([(i, line, 70 + i, i, 5 * i, 9) for i in range(3)] + [(9, None, 1, 2, 3, 4)],
                                 "doc_id long, text string, n_lines int, n_dropped int, its_row int, bits int")
    got = drop_repeated_lines(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect() if r.text) == [(0, line, 70, 0, 0, 9)]
    assert {tuple(r) for r in got.collect() if not r.text} == {(9, None, 1, 2, 3, 4)}


def test_bits_name_every_key(spark, monkeypatch):
    """With more keys than bits the table names nearly all rows, and the result is the same."""
    from spanwise.llm import common

    docs = table(spark, SF, "documents")
    wide = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    monkeypatch.setattr(common, "BIT_WORDS", 1)
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == wide


def test_long_passage_is_left_once(spark):
    passage, own = prose(5, 1, 55)[0], prose(6, 6, 30)
    docs = spark.createDataFrame([(i, f"{own[i]}\n{passage}") for i in range(6)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in drop_repeated_lines(docs).collect()}
    assert got == {0: f"{own[0]}\n{passage}", **{i: own[i] for i in range(1, 6)}}


def test_line_dedup_of_odd_rows(odd, none):
    rows = dedup_lines(odd).collect()
    assert len(rows) == odd.count()
    assert [(r.text, r.n_lines) for r in rows if r.doc_id == 0] == [(None, 0)]
    assert {r.text for r in rows if r.doc_id == 5} == {"One  two\tthree"}  # alike in id and text: one document
    assert dedup_lines(none).count() == 0
    assert drop_repeated_lines(odd).columns == odd.columns
