"""Deduplication, rules, scores: against brute force on small tables, and held-out accuracy."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlpit.llm import arrow, linking, lines, lm, minhash, quality, queries, tables, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


class Union:
    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def find(self, k):
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def components_of(sets, share=0.75):
    """Least key reachable, by comparing all that share an element."""
    at = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            at[x].append(k)
    union = Union(sets)
    done = set()
    for own in at.values():
        for b in own[1:]:
            for a in own:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    common = len(sets[a] & sets[b])
                    if common >= share * (len(sets[a]) + len(sets[b]) - common):
                        union.join(a, b)
    return {k: union.find(k) for k in sets}


def word_shingles(text):
    w = WORDS.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_near_duplicates_of_documents(spark, small):
    texts = {r.doc_id: r.text for r in queries.table(spark, small, "documents").collect()}
    sets = {k: word_shingles(t) for k, t in texts.items()}
    expected = components_of(sets)
    rows = queries.op4_near_duplicates(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, long), (8, long + " end"), (9, long), (9, long), (None, long), (10, "É b c d e"), (11, "é b c d e")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n int, keys string")
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert found == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 2996, 7, True), (8, 2997, 7, False), (9, 2996, 7, False), (None, 2996, None, True), (10, 1, 10, True), (11, 1, 11, True)}
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 7, 10, 11]


def test_star_of_copies_whose_centre_is_not_the_least(spark):
    """Copies that are each near to the last one but not to each other, and a chain."""
    draw = np.random.default_rng(3)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for k in range(40):
        own = list(base)
        for at in draw.choice(300, 5, replace=False):
            own[at] = f"x{k}_{at}"
        rows.append((k, " ".join(own)))
    rows.append((99, " ".join(base)))
    chain = [f"c{k}" for k in range(400)]
    rows += [(1000 + k, " ".join(chain[25 * k : 25 * k + 250])) for k in range(7)]
    common = " ".join(f"p{k}" for k in range(60))
    rows += [(2000 + k, common + " " + " ".join(f"q{k}_{j}" for j in range(60))) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = components_of({k: word_shingles(t) for k, t in rows})
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == expected


def test_candidates_that_differ_are_compared_across_components(spark):
    """Two bucket-mates of a representative that is near to neither are still found."""
    ids = [1, 2, 3, 4]
    sets = {1: [1, 2, 3, 4], 2: [10, 11, 12, 13], 3: [10, 11, 12, 13, 14], 4: [100, 101, 102]}
    keyed = spark.createDataFrame([(k, 5) for k in ids], "id bigint, key bigint")
    items = spark.createDataFrame(list(sets.items()), "id bigint, items array<bigint>")
    found = linking.link(linking.Sketches(keyed), lambda wanted, n: items.join(wanted, "id"))
    assert {tuple(r) for r in found.collect()} == {(2, 2), (3, 2)}


def test_small_tables_of_the_linking_are_few_files(spark):
    edges = spark.range(300).repartition(16).selectExpr("id as a", "id + 1 as b")
    assert len(tables.written(edges, 300).inputFiles()) == 1
    assert len(tables.written(edges, 300, 100).inputFiles()) == 3
    labels = linking.components(edges, rows=300)
    assert len(labels.inputFiles()) == 1 and labels.count() == 301 and {r.component for r in labels.collect()} == {0}


def test_buckets_of_some_hundred_items_are_not_copied(spark, monkeypatch):
    open_ = spark.range(600).selectExpr("id", "7L as key", "id as component", "600L as in_bucket")
    counts = []
    monkeypatch.setattr(linking, "_pairs", lambda spread, *rest: counts.append(spread.count()) or spread)
    linking._across(open_, linking.Sketches(open_), 75, 100)
    assert counts == [600]


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(500, 700), (700, 600), (9, 9)]
    found = {r.id: r.component for r in linking.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {k: 0 for k in range(41)} | {500: 500, 600: 500, 700: 500}


def test_estimates_of_similarity():
    draw = np.random.default_rng(7)
    for n, j in ((400, 0.75), (400, 0.3), (3000, 0.9)):
        common = int(2 * n * j / (1 + j))
        seen = []
        for _ in range(20):
            every = draw.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(every[:n]), np.sort(np.concatenate([every[:common], every[n:]]))
            full = minhash.filled(minhash.registers([a, b]))
            four = minhash.lanes(full)
            same = sum((int(x ^ y) & (15 << 4 * k)) == 0 for x, y in zip(*(r.view(np.uint64) for r in four), strict=True) for k in range(16))
            seen.append((same / 128 - 1 / 16) / (1 - 1 / 16))
        assert abs(np.mean(seen) - j) < 0.05


def test_registers_keep_zeros_and_mantissa():
    own = minhash.registers([np.array([0, 1 << 56, 3 << 55, (1 << 57) + (1 << 40)], np.uint64), np.zeros(0, np.uint64)])
    assert own[0, 0] == 54 << 10 and own[0, 1] >> 10 == 17 and not own[0, 2:].any() and not own[1].any()
    assert minhash.filled(own[:1]).all()


# ---------------------------------------------------------------- lines


def line_links(rows):
    """Places of all lines, and pairs of distinct lines that are similar: by ten code points, and by fewer if both are short."""
    places = {(d, no): line for d, text in rows for no, line in enumerate((text or "").split("\n")) if WORDS.search(line)}
    distinct = sorted(set(places.values()))
    kinds = {}
    for line in distinct:
        kinds[line] = {10}
        if 15 <= len(line) <= 104:
            kinds[line] |= set(range(max(2, (math.ceil(0.75 * len(line)) + 1) // 8), min(9, (len(line) + 1) // 8) + 1))
    ten, short = set(), set()
    for k in range(2, 11):
        sets = {line: {line[i : i + k] for i in range(max(1, len(line) - k + 1))} for line in distinct if k in kinds[line]}
        at = defaultdict(list)
        for line, own in sets.items():
            # any pair that similar shares one of a quarter of the shingles in a fixed order
            for x in sorted(own)[: len(own) - math.ceil(0.75 * len(own)) + 1]:
                at[x].append(line)
        for own in at.values():
            for i, one in enumerate(own):
                for two in own[:i]:
                    common = len(sets[one] & sets[two])
                    if 100 * common >= 75 * (len(sets[one]) + len(sets[two]) - common):
                        (ten if k == 10 else short).add((one, two))
    return places, ten, short


def one_stretch(one, two):
    """Whether two lines are equal but for one changed character."""
    return len(one) == len(two) and sum(x != y for x, y in zip(one, two, strict=True)) == 1


def test_lines_of_documents(spark, tiny):
    """Links are exact where they are found; at least 0.99 of all are found, by ten code points and by one edit of a short line."""
    rows = [(r.doc_id, r.text) for r in queries.table(spark, tiny, "documents").collect()]
    draw = np.random.default_rng(11)
    for k in range(300):
        line = "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz     "), int(draw.integers(30, 81)))).strip() + f" {k} end"
        at = int(draw.integers(3, len(line) - 3))
        rows.append((10_000 + k, f"{line}\n{line[:at]}#{line[at + 1 :]}"))
    found = lines.line_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert no_python(found)
    found = {(r.doc_id, r.line_no): r for r in found.collect()}
    places, ten, short = line_links(rows)
    assert set(found) == set(places)
    union = Union(set(places.values()))
    for one, two in ten | short:
        union.join(one, two)
    first, of = {}, {}
    for place, line in sorted(places.items()):
        r = found[place]
        mine = (r.first_doc_id, r.first_line_no)
        assert union.find(line) == union.find(places[mine])  # no link is made up
        assert of.setdefault(line, mine) == mine  # equal lines are together
        first.setdefault(mine, place)
        assert first[mine] == mine and r.kept == (place == mine)
    for links in (ten, {p for p in short if one_stretch(*p)}):
        assert len(links) > 100 and sum(of[one] == of[two] for one, two in links) >= 0.99 * len(links)


def test_lines_of_rows_that_share_an_id(spark):
    """No line that is unique is lost, whatever the ids; clashing names don't matter."""
    rows = [(4, "line one of two\na", "x", 1), (4, "b\nline one of two", "y", 2), (None, "c\nline one of two", None, 3), (5, "d", "z", 4), (5, "d", "z", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _l_gone string, _l_id int")
    left = lines.drop_repeated_lines(df)
    assert left.columns == df.columns
    kept = sorted(x for r in left.collect() for x in r.text.split("\n") if x)
    assert kept == ["a", "b", "c", "d", "d", "line one of two"]
    assert lines.line_groups(df.limit(0)).count() == 0 and lines.drop_repeated_lines(df.limit(0)).count() == 0


def test_lines_of_odd_rows(spark):
    line = "The quick brown fox jumps over the lazy dog and then it sleeps for a very long time under the old tree"
    near = line.replace("lazy", "lame")
    rows = [(1, f"{line}\nalone\n\n{line}"), (2, f"{near}\n \nalone"), (3, None), (4, ""), (5, "\n\n"), (6, "x" * 100_000), (None, "nobody")]
    df = spark.createDataFrame([(*r, 3, "k") for r in rows], "doc_id bigint, text string, line_no int, component string")
    found = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.kept) for r in lines.line_groups(df).collect()}
    assert found == {(1, 0): (1, 0, True), (1, 1): (1, 1, True), (1, 3): (1, 0, False), (2, 0): (1, 0, False), (2, 2): (1, 1, False), (6, 0): (6, 0, True), (None, 0): (None, 0, True)}
    left = lines.drop_repeated_lines(df)
    assert left.columns == df.columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: f"{line}\nalone\n", 2: " ", 3: None, 4: "", 5: "\n\n", 6: "x" * 100_000, None: "nobody"}


def test_texts_are_split_and_sets_are_built_once(spark, tiny):
    """Spark adds no filter on an array's size that makes the array again."""
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert optimized(lines.lines_of(queries.table(spark, tiny, "documents"))).count("split(") == 1
    items = spark.createDataFrame([(1, "a line of words", 10), (2, "", 10)], "id bigint, line string, k int").select("id", F.struct("line", "k").alias("items"))
    bounds = linking._bounds(items.select("id", lines._sets("items").alias("items")))
    assert optimized(bounds).count("array_distinct(") == 2  # of elements in one set alone, and of the sketch
    assert sorted((r.id, r.size, r.shared) for r in bounds.collect()) == [(1, 6, 0), (2, 1, 0)]
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "a\n\nb")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.line_no, r.line) for r in lines.lines_of(texts).collect()) == [(3, 0, "a"), (3, 2, "b")]


def test_keys_are_made_with_room_for_their_groups(spark, monkeypatch):
    """Tasks that make keys of dealt items look all their groups up in the generated table; the session's own setting comes back."""
    put, seen = tables._put, []
    monkeypatch.setattr(tables, "_put", lambda df, folder: seen.append((df.columns, spark.conf.get(tables.FAST_GROUPS))) or put(df, folder))
    before = spark.conf.get(tables.FAST_GROUPS)
    df = spark.createDataFrame([(1, "the first line of a text, long enough"), (2, "another one that is not near to it")], "doc_id bigint, text string")
    assert lines.line_groups(df).count() == 2
    assert (["id", "key"], linking.GROUPS_BIT) in seen and spark.conf.get(tables.FAST_GROUPS) == before != linking.GROUPS_BIT


# ---------------------------------------------------------------- rules


def brute_statistics(text):
    text = text or ""
    words = WORDS.findall(text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    rows = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(rows) - len(set(rows)), len(covered)


def test_statistics_and_rules(spark, small):
    docs = {r.doc_id: r.text for r in queries.table(spark, small, "documents").collect()}
    found = queries.op2_quality_rules(spark, small)
    assert no_python(found)
    rows = found.collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = brute_statistics(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        assert r.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0])
        assert r.kept == (not r.base_failed and r.rule == 0)


def brute_verdict(rules, own, n_lines):
    words, lines_ = max(1, own[0]), max(1, n_lines)
    values = {"n_words": own[0], "word_length": own[1] / words, "symbol_share": own[2] / words, "dup_line_share": own[3] / lines_, "repeat_share": own[4] / words, "words_per_line": own[0] / lines_}
    holds = lambda c: values[c.measure] >= c.threshold if c.at_least else values[c.measure] < c.threshold
    return next((k for k, rule in enumerate(rules, 1) if all(map(holds, rule.conditions))), 0)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_verdicts_of_documents(spark, folder):
    """The learnt list, applied in Python, gives the same verdicts; it finds bad texts and leaves good ones."""
    docs, labels = queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels")
    rules = quality.learn(docs, labels)
    assert rules and all(len({c[:2] for c in rule.conditions}) == len(rule.conditions) for rule in rules)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    judged = quality.judged(docs, rules).collect()
    for r in judged:
        own = brute_statistics(r.text)
        assert r.rule == brute_verdict(rules, own, (r.text or "").count("\n") + 1)
        assert r.kept == (r.rule == 0 and not r.base_failed)
    bad = [r for r in judged if truth.get(r.doc_id) == 0]
    good = [r for r in judged if truth.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in bad) <= 0.05 * len(bad) and sum(not r.kept for r in good) <= 0.01 * len(good)
    assert {r.doc_id for r in quality.keep_good(docs, rules).collect()} == {r.doc_id for r in judged if r.kept}


def test_filters_stay_above_the_statistics(spark, small):
    """A filter on a verdict is not put together with the chain of arrays, which would then be built again and again."""
    docs = queries.table(spark, small, "documents")
    rules = [quality.Rule((quality.Condition("symbol_share", True, 0.4), quality.Condition("repeat_share", False, 2.0)), 1, 1)]
    for df in (quality.keep_good(docs, rules), quality.judged(docs, rules).filter("kept"), quality.judged(docs, rules).filter("rule = 1 or n_dup_lines > 3")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") <= 3 and plan.count("transform(") <= 5 and plan.count("Generate inline") == 1


def test_statistics_of_odd_texts(spark):
    texts = [None, "", " \n\t", "a b c d e a b c d e", "é x y", "x " * 30_000, "a\na\n a\n\n", "a b c d e f\va b c d e", "😀 #$ |"]
    df = spark.createDataFrame([(k, t, "clash", 9, "w", 1, True) for k, t in enumerate(texts)], "doc_id bigint, text string, _q_words string, n_words int, _Qtext string, rule int, _kn_words boolean")
    assert {r.rule for r in quality.judged(df, []).collect()} == {0} and quality.judged(df, []).columns[:3] == ["doc_id", "text", "_q_words"]
    for r in quality.with_statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(texts[r.doc_id])
    assert quality.keep_good(df, []).columns == df.columns
    assert quality.with_statistics(df.limit(0)).count() == 0


def test_rules_are_learnt_and_pruned(spark):
    draw = np.random.default_rng(5)
    rows = []
    for k in range(1500):
        bad = k % 5 == 0
        words = [f"w{draw.integers(1, 10_000)}" + ("###" if bad else "") for _ in range(int(draw.integers(15, 60)))]
        rows.append((k, " ".join(words), 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    rules = quality.learn(df, df.select("doc_id", "quality"))
    assert rules and len(rules[0].conditions) == 1 and rules[0].conditions[0].measure in ("symbol_share", "word_length")
    judged = quality.judged(df, rules).collect()
    assert sum(r.kept != (r.quality == 1) for r in judged) <= 5
    assert "symbol_share" in str(rules[0]) or "word_length" in str(rules[0])
    assert quality.learn(df, df.select("doc_id", "quality").limit(0)) == []
    assert quality.learn(df, df.select("doc_id", F.lit(1).alias("quality"))) == []
    assert quality.learn(df, df.select(F.lit(None).cast("bigint").alias("doc_id"), "quality")) == []


# ---------------------------------------------------------------- toxicity


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in queries.table(spark, folder, "labels").collect()}
    rows = queries.op6_toxicity(spark, folder).collect()
    assert len(rows) == queries.table(spark, folder, "documents").count()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    yes, no = ([r.score for r in held if truth[r.doc_id] == v] for v in (1, 0))
    above = np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no])
    hit = sum(r.predicted for r in held if truth[r.doc_id]) / len(yes)
    false = sum(r.predicted for r in held if not truth[r.doc_id]) / len(no)
    assert above > 0.8 and false < 0.02 and hit > 0.5, (above, hit, false)


def test_toxicity_learns_from_no_held_out_label(spark, tiny):
    docs, labels = queries.table(spark, tiny, "documents").select("doc_id", "text"), queries.table(spark, tiny, "labels")
    may = queries.remainder(3) != 1
    one = toxicity.fit(docs, labels, may)
    two = toxicity.fit(docs, labels.withColumn("toxic", F.when(may, F.col("toxic")).otherwise(1 - F.col("toxic"))), may)
    assert one.bias == two.bias and (one.weights == two.weights).all()


def test_toxicity_of_odd_rows(spark, tiny):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    df = spark.createDataFrame([(1, "bad thing", "x"), (2, None, "x"), (3, "", "x"), (None, "z " * 5000, "x"), (4, "bad thing", "x"), (4, "bad thing", "x")], "doc_id bigint, text string, positive string")
    for own in (labels, labels.limit(0)):
        model = toxicity.fit(df, own)
        found = df.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()
        assert len(found) == 6 and all(0 <= r.s <= 1 for r in found)
    assert toxicity.keep_clean(df, model).columns == df.columns
    empty = toxicity.fit(df.limit(0), labels)
    assert df.limit(0).select(toxicity.score(F.col("text"), empty)).count() == 0


def test_risk_is_kept_from_going_below_zero():
    """A feature of the positives alone, many of which are unlabelled too, is learnt."""
    draw = np.random.default_rng(2)
    n = 3000
    positive = np.arange(n) < 300
    toxic = positive | (draw.random(n) < 0.1)
    row = np.concatenate([np.flatnonzero(toxic), np.repeat(np.arange(n), 3)])
    place = np.concatenate([np.zeros(toxic.sum(), np.int64), draw.integers(1, 40, 3 * n)])
    w, b = toxicity.train(row, place, positive, 40, 0.1)
    assert w[0] > 2 and np.abs(w[1:]).max() < w[0] / 3
    assert b < -1


# ---------------------------------------------------------------- language model


def test_base_scores(spark, small):
    docs = {r.doc_id: (r.text or "").translate(UPPER) for r in queries.table(spark, small, "documents").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in docs}
    c = Counter(w for k, t in docs.items() if not held[k] for w in WORDS.findall(t))
    texts = sum(not h for h in held.values())
    n, v = sum(c.values()) + texts, len(c) + 1
    rows = queries.op3_lm_scores(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = WORDS.findall(docs[r.doc_id])
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in [*(c[w] for w in words), texts])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words) + 1, sum(w in c for w in words) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-6)
        assert r.score < 0


def near_copies_apart(texts, held):
    """Ids of held-out texts of which less than a tenth of the five-word shingles are in a training text."""
    shingles = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in texts.items()}
    known = set().union(*(s for k, s in shingles.items() if not held[k]))
    return [k for k, s in shingles.items() if held[k] and s and len(s & known) < len(s) / 10]


def test_network_alone_beats_word_frequencies(spark, small):
    """On held-out texts without near copies among the training texts, in all and for more than half of them."""
    docs = queries.table(spark, small, "documents")
    texts = {r.doc_id: WORDS.findall((r.text or "").translate(UPPER)) for r in docs.collect()}
    rows = {r.doc_id: r for r in queries.op3_lm_scores(spark, small).collect()}
    apart = near_copies_apart(texts, {k: r.held_out for k, r in rows.items()})
    assert len(apart) > 30
    assert sum(rows[k].score for k in apart) > sum(rows[k].base_score for k in apart)
    assert sum(rows[k].score > rows[k].base_score for k in apart) > len(apart) / 2


def test_rare_words_are_joined(spark, tiny):
    docs = queries.table(spark, tiny, "documents")
    few = {r.doc_id: r for r in lm.score(docs, queries.remainder(10) == 0, frequent=20).collect()}
    all_ = {r.doc_id: r for r in lm.score(docs, queries.remainder(10) == 0).collect()}
    for k, r in all_.items():
        assert few[k].n_known == r.n_known and math.isclose(few[k].base_score, r.base_score, rel_tol=1e-9)
        assert few[k].score == pytest.approx(r.score, rel=1e-5)  # the bound is the base's alone


def test_scores_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (4, "A  b"), (None, "zz"), (5, "<|endoftext|> q " * 3000), (6, "日本")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, word string")
    found = lm.score(df, F.col("doc_id") == 6).collect()
    assert len(found) == len(rows) and all(r.score < 0 and math.isfinite(r.score) for r in found)
    by = {r.doc_id: r for r in found}
    assert by[1].n_tokens == 1 and by[3].score == pytest.approx(by[4].score) and by[6].n_known == 1 and by[6].held_out
    nothing = lm.score(df, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in nothing)


def test_subwords_are_those_of_the_pattern():
    words = ["a", "Ab12,;x", "<|endoftext|>", "don't", "日本", "éÀ9ß!", "x²", "--", "a" * 300, "1234567", "ªº", "\u00a0x", "(it's)", "~"]
    vocab = lm.byte_bpe.vocabulary(lm.VOCABULARY)
    ids, sizes = lm.subwords(pa.array(words))
    expected, counts = vocab.encode_segments([b" " + w.encode() for w in words], False)
    assert ids.tolist() == expected.tolist() and sizes.tolist() == counts.tolist()
    assert len(lm.subwords(pa.array([], pa.string()))[0]) == 0


def test_windows_score_each_subword_once():
    sizes = [1, 24, 25, 100, 1]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.arange(offsets[-1]) + 1000
    inputs, targets, text = lm.windows(ids, offsets)
    assert sorted(targets[targets >= 0]) == ids.tolist()
    for k, n in enumerate(sizes):
        own, seen = targets[text == k], inputs[text == k]
        for row, ctx in zip(own, seen, strict=True):
            for j, t in enumerate(row):
                if t >= 0:
                    first = t == ids[offsets[k]]
                    assert ctx[lm.CONTEXT + j] == (lm.END if first else t - 1)
                    before = [x for x in ctx[: lm.CONTEXT + j + 1] if x >= 0]
                    assert len(before) >= min(lm.CONTEXT + 1, t - ids[offsets[k]] + 1)


def tiny_network(live=500):
    """A network with classes of one and of several symbols, its weights moved from their start; inputs and targets are symbols."""
    draw = np.random.default_rng(0)
    counts = np.zeros(lm.END + 1)
    counts[draw.choice(lm.END, live, replace=False)] = draw.integers(1, 50, live)
    net = lm.untrained(counts)
    net = net._replace(place=draw.standard_normal(lm.WINDOW).astype(np.float32))
    inputs = draw.integers(0, len(net.class_of), (4, lm.WINDOW))
    inputs[0, :6] = -1
    targets = draw.integers(0, len(net.class_of), (4, lm.SCORED))
    targets[3, 10:] = -1
    return net, counts, inputs, targets


def test_probabilities_add_up_and_look_back_only():
    net, counts, inputs, targets = tiny_network()
    first = lm.first_subwords()
    assert (net.begins[net.class_of[net.symbol]] == first).all()  # no class holds both kinds
    # over all ids, one at a time in the place of one target
    at = np.full((1, lm.SCORED), -1)
    total = begin = 0.0
    for x in range(len(net.class_of)):
        at[0, 7] = x
        found, held = lm.symbol_scores(net, inputs[1:2], at)
        ids = np.flatnonzero(net.symbol == x)
        p = (10 ** (found[0] + net.share[ids])).sum()
        total, begin = total + p, begin + p * first[ids[0]]
    assert total == pytest.approx(1, abs=1e-4)
    assert lm.begin_scores(net, held)[0] == pytest.approx(math.log10(begin), abs=1e-4)
    changed = inputs.copy()
    changed[:, lm.CONTEXT + 5 :] = 7
    z, y = (lm.states(net, i)[0].reshape(4, lm.SCORED, -1) for i in (inputs, changed))
    assert np.allclose(z[:, :5], y[:, :5], atol=1e-5) and not np.allclose(z[:, 5:], y[:, 5:], atol=1e-5)


def test_slopes_are_those_of_the_loss():
    net, _, inputs, targets = tiny_network()
    net = net._replace(**{k: getattr(net, k).astype(np.float64) for k in lm.TRAINED})
    loss, slope = lm.backward(net, inputs, targets)
    assert loss == pytest.approx(-math.log(10) * lm.symbol_scores(net, inputs, targets)[0].mean(), rel=1e-4)
    for name in lm.TRAINED:
        w = getattr(net, name)
        at = np.unravel_index(np.argmax(np.abs(slope[name])), w.shape)
        old, losses = w[at], []
        for d in (1e-4, -1e-4):
            w[at] = old + d
            losses.append(lm.backward(net, inputs, targets)[0])
        w[at] = old
        assert math.isclose((losses[0] - losses[1]) / 2e-4, slope[name][at], rel_tol=2e-2), name


def test_long_texts_score_as_their_windows():
    net, *_ = tiny_network()
    ids = np.random.default_rng(1).integers(0, lm.END, 3000)
    offsets = np.array([0, 10, 2900, 3000])
    whole = lm.subword_scores(net, ids, offsets, rows=8)
    alone = [lm.subword_scores(net, ids[a:b], np.array([0, b - a])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    for k in range(2):
        assert np.allclose(whole[k], np.concatenate([x[k] for x in alone]), atol=1e-4)


def test_looked_up_states_are_those_of_the_fit():
    """Scoring looks keys, values and queries up by symbol; the fit multiplies them. Large weights take the way with the greatest taken off."""
    net, _, inputs, targets = tiny_network()
    for scale in (1, 30):
        own = net._replace(embedding=net.embedding * scale, out=net.out * scale)
        assert np.allclose(lm._scored_states(own, lm.lookups(own), inputs), lm.states(own, inputs)[0], rtol=1e-3, atol=1e-3 * scale)
        found, _ = lm.symbol_scores(own, inputs, targets)
        loss, slope = lm.backward(own, inputs, targets)
        assert np.isfinite(found).all() and all(np.isfinite(x).all() for x in slope.values())
        assert scale > 1 or loss == pytest.approx(-math.log(10) * found.mean(), rel=1e-4)


def test_steps_leave_what_they_havent_seen():
    net, _, inputs, targets = tiny_network()
    inputs[3, lm.CONTEXT + 10 :] = -1  # as windows have it behind a text's end
    old = {k: getattr(net, k).copy() for k in ("embedding", "inner")}
    adam = lm.Adam(net)
    for _ in range(2):
        adam.step(inputs, targets, 1e-2)
    own = np.unique(net.class_of[targets[targets >= 0]])
    seen = {"embedding": np.unique(inputs[inputs >= 0]), "inner": np.flatnonzero(np.isin(net.class_of, own) & (np.diff(net.start) > 1)[net.class_of])}
    for k, rows in seen.items():
        moved = np.flatnonzero((getattr(net, k) != old[k]).any(axis=1))
        assert moved.tolist() == rows.tolist()


def test_rounds_fill_the_cores():
    """A round is one turn of tasks, or whole turns; none has over eight times a task's subwords."""
    each = lm.TASK_SUBWORDS
    assert lm.round_tasks(0, 6) == 1 and lm.round_tasks(2.5 * each, 6) == 3
    for cores in (1, 2, 6, 12):
        for subwords in (7 * each, 37 * each, 460 * each):
            tasks = lm.round_tasks(subwords, cores)
            assert tasks % cores == 0 or tasks == math.ceil(subwords / each) < cores
            assert subwords / tasks <= lm.TASK_TIMES * each
            assert lm.score_tasks(subwords, cores) % cores == 0


def test_texts_are_dealt_anew_to_the_tasks_of_a_round(spark):
    """As many tasks as asked for however few files there are, and the same weights however rows lie."""
    texts = [" ".join(f"w{(k * j) % 37}" for j in range(40 + k % 9)) for k in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "place bigint, text string")
    found = arrow.split_words(arrow.texts_of(pa.array(texts)), lower=True)
    ids, _ = lm.sequences(found, *lm.subwords(found.words))
    net = lm.untrained(np.bincount(ids, minlength=lm.END + 1).astype(float))
    one = lm.fitted_round(df.coalesce(1), net, 1e-2, 3)
    other = lm.fitted_round(df.orderBy(F.desc("place")).repartition(4), net, 1e-2, 3)
    alone = lm.fitted_round(df.coalesce(1), net, 1e-2, 1)
    assert one[0] == other[0] == alone[0] == len(ids)
    for k in lm.TRAINED:
        assert np.array_equal(getattr(one[2], k), getattr(other[2], k)), k
    assert not np.array_equal(one[2].out, alone[2].out)


def test_a_text_isnt_scored_from_its_own_later_words():
    """What comes before a place scores alike, whatever follows, the same words again too."""
    net, *_ = tiny_network()
    ids = np.random.default_rng(1).integers(0, lm.END, 200)
    once, twice = (lm.subword_scores(net, x, np.array([0, len(x)]))[0] for x in (ids, np.tile(ids, 2)))
    assert np.allclose(once, twice[:200], atol=1e-5)


def brute_score(net, words):
    """A text's log10 probability, subword by subword, with plain loops over the positions of each window."""
    parts = [lm.byte_bpe.vocabulary(lm.VOCABULARY).encode_plain([b" " + w.encode()])[0].tolist() for w in words]
    ids = [*sum(parts, []), lm.END]
    own = [int(net.symbol[x]) for x in ids]
    seen = [int(net.symbol[lm.END]), *own[:-1]]
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    total = 0.0
    for i, symbol in enumerate(own):
        low = max(0, i // lm.SCORED * lm.SCORED - lm.CONTEXT)
        x = {j: net.embedding[seen[j]] + (net.embedding[seen[j - 1]] @ net.shift if j > low else 0) for j in range(low, i + 1)}
        q = x[i] @ net.query / math.sqrt(len(x[i]))
        a = softmax(np.array([q @ (x[j] @ net.key) + net.place[i - j] for j in x]))
        h = x[i] + sum(p * (x[j] @ net.value) for p, j in zip(a, x, strict=True))
        g = h + np.maximum(h @ net.up, 0) @ net.down
        c = net.class_of[symbol]
        p, some = softmax(g @ net.out + net.bias), slice(net.start[c], net.start[c + 1])
        inner = softmax(net.inner[some] @ g + net.inner_bias[some])[symbol - some.start]
        total += math.log10(p[c] * inner) + net.share[ids[i]] - (math.log10(p[net.begins].sum()) if i == 0 else 0)
    return total


def test_scores_by_brute_force(spark, tiny, monkeypatch):
    made = {}
    fit = lm.fitted
    monkeypatch.setattr(lm, "fitted", lambda *a: made.setdefault("net", fit(*a)))
    docs = queries.table(spark, tiny, "documents")
    rows = {r.doc_id: r for r in lm.score(docs, queries.remainder(10) == 0).collect()}
    texts = {r.doc_id: WORDS.findall((r.text or "").translate(UPPER)) for r in docs.collect()}
    few = [k for k in sorted(texts) if len(texts[k]) < 200][:8]
    assert few
    for k in few:
        assert rows[k].score == pytest.approx(brute_score(made["net"], texts[k]), rel=1e-4)



def test_every_training_text_is_fitted_to_once(spark, monkeypatch):
    """However large the corpus is said to be, no text is drawn: the rounds go through all of them."""
    seen = []
    monkeypatch.setattr(lm, "fitted_round", lambda part, net, rate, tasks: (seen.extend(r.text for r in part.collect()), 0.0, net))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    counts = np.zeros(lm.END + 1)
    counts[:1000] = 1_000_000
    lm.fitted(docs, counts)
    assert sorted(seen) == sorted(f"text {k}" for k in range(300))


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tiny):
    import corpus_pipeline

    docs = queries.table(spark, tiny, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "line dedup", "near duplicates", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = tables.written(stage(spark, docs, tiny))
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "quality rules":
            for k, r in before.items():
                own = brute_statistics(r.text)
                assert k not in after or not (own[0] < 10 or 100 * own[4] > 20 * own[0])
        if name == "line dedup":
            assert set(after) == set(before)
            seen = [x for k in sorted(after) for x in (after[k].text or "").split("\n") if WORDS.search(x)]
            assert len(seen) == len(set(seen))
        if name == "near duplicates":
            expected = components_of({k: word_shingles(r.text) for k, r in before.items()})
            assert set(after) == {k for k, v in expected.items() if k == v}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tiny).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_pipeline_of_no_rows(spark, tiny, tmp_path):
    import corpus_pipeline

    queries.table(spark, tiny, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    queries.table(spark, tiny, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_written_tables_stand_in_the_named_folder(spark, tmp_path, monkeypatch):
    """The session's folder is used; a cluster without one is an error, as executors don't share local folders."""
    monkeypatch.setattr(tables, "named_folder", lambda _: f"file://{tmp_path}")
    assert tables.written(spark.range(3)).count() == 3
    assert list(tmp_path.glob("table-*/*.parquet"))
    monkeypatch.setattr(tables, "named_folder", lambda _: None)
    monkeypatch.setattr(tables, "on_one_machine", lambda _: False)
    with pytest.raises(RuntimeError):
        tables.written(spark.range(3))


def test_sets_hold_the_shingles():
    texts = pa.array(["a b c d e f", "A b c d e f a b c d e", "x", "", "a b"])
    assert [len(s) for s in minhash.shingle_sets(texts)] == [len(word_shingles(t)) for t in texts.to_pylist()]
    one, two = minhash.shingle_sets(pa.array(["q w e r t", "z q w e r t"]))
    assert set(one.tolist()) <= set(two.tolist())
    assert arrow.split_words(pa.array(["A É"]), lower=True).words.to_pylist() == ["a", "É"]
