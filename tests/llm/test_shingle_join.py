"""The shingle join against all pairs, its filters one by one, and what it costs where many texts share a passage."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from voxelgrain.llm import near_copies, shingle_copies, shingle_join
from voxelgrain.llm.queries import QUERIES
from voxelgrain.llm.records import run_reports
from voxelgrain.operators.report import report_lines
from voxelgrain.plans.analyze import Settings, analyze

from tests.conftest import sphere

FOLDER = "/root/testdata/sf0.001"


def shingle_set(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def components(keys, texts, shingle=4, percent=85):
    sets = [shingle_set(t, shingle) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                same = len(x & y)
                if 100 * same >= percent * (len(x) + len(y) - same):
                    root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            r = find(i)
            least[r] = min(least.get(r, k), k)
    return [(k, len(s), least.get(find(i)) if s else k) for i, (k, s) in enumerate(zip(keys, sets, strict=True))]


def plain(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def variants(rng, number):
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 5, 8, 30, 90, 200, 600]))) for _ in range(25)]
    common = [" ".join(f"c{k}x{i}" for i in range(40)) for k in range(4)]
    for _ in range(number):
        words = rng.choice(texts).split() or ["w1"]
        for _ in range(rng.randint(0, 1 + len(words) // 50)):
            words[rng.randrange(len(words))] = rng.choice(["other", "w7"])
        words = words[: rng.randint(len(words) - len(words) // 8, len(words))]
        if rng.random() < 0.2:
            words = words[: rng.randint(0, 10)]
        texts.append(" ".join(words + rng.choice([[], [], *([c] for c in common)])))
        if rng.random() < 0.2:
            texts[-1] = texts[-1].upper().replace(" ", "\t ")
        if rng.random() < 0.2:
            texts.append(" ".join(rng.sample(common, rng.randint(1, 4))))
    return texts


def test_join_against_all_pairs(spark):
    rng = random.Random(31)
    texts = variants(rng, 300) + [None, "", " \n", "é É x", "é é x", "one " * 9000, "one " * 9001]
    keys = [rng.choice([i, i, i, 5, None]) for i in range(len(texts))]
    data = spark.createDataFrame([(k, t, 1, 2, "r", "c") for k, t in zip(keys, texts, strict=True)], "stack_id long, report string, size int, _n int, root string, component_id string")
    data = data.repartition(6)
    want = components(keys, texts)
    assert len({r[2] for r in want}) < len(want) - 100
    assert plain(shingle_join.shingle_groups(data).collect()) == plain(want)
    want = components(keys, texts, 2, 60)
    assert plain(shingle_join.shingle_groups(data, shingle=2, percent=60).collect()) == plain(want)
    assert shingle_join.shingle_groups(data.where("false")).count() == 0


def test_filters_keep_every_link():
    rng = random.Random(32)
    for _ in range(3000):
        percent = rng.choice([50, 80, 85, 100])
        rule = shingle_join.JoinRule(4, percent, np.arange(0, 60, 3), np.arange(0, 60, 3))
        pool = [c << 32 for c in rng.sample(range(200), rng.randint(2, 60))]
        one, two = (np.array(sorted(rng.sample(pool, rng.randint(max(1, len(pool) - 6), len(pool)))), np.uint64) for _ in range(2))
        same = len(set(one.tolist()) & set(two.tolist()))
        linked = 100 * same >= percent * (len(one) + len(two) - same)
        assert rule.linked(one, two) == linked
        bits = [shingle_join.parity(c << np.uint64(12)).view(np.uint64) for c in (one, two)]
        apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert apart <= len(one) + len(two) - 2 * same
        if linked and one.tolist() != two.tolist():
            x, y = sorted((rule.prefix(one).tolist(), rule.prefix(two).tolist()), key=lambda p: len(p))
            first = next(c for c in x if c in y)
            s, t = sorted((len(one), len(two)))
            small = one if len(one) == s else two
            place = rule.prefix(small).tolist().index(first)
            assert (100 + percent) * (s - place) >= 2 * percent * s


def test_slots_come_back():
    rng = np.random.default_rng(5)
    for size in (0, 1, 5000):
        slots = np.sort(rng.integers(0, 1 << 24, size).astype(np.uint32))
        slots[size // 2 :] //= 4
        slots.sort()
        assert (shingle_join.unpacked_slots(*shingle_join.packed_slots(slots)) == slots).all()


def test_counts_of_common_shingles(spark):
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words[i : i + 12]) for i in range(18)] * 3
    data = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(5)
    slots, counts = shingle_join._common(data, 4)
    want = {}
    for codes in shingle_join.shingle_codes(texts):
        for c in codes.tolist():
            want[c >> 32] = want.get(c >> 32, 0) + 1
    assert dict(zip(slots.tolist(), counts.tolist(), strict=True)) == {c: n for c, n in want.items() if n >= shingle_join.OFTEN}


def test_boilerplate_makes_no_pairs(spark, monkeypatch):
    """10,000 texts share one passage and nothing else; half of them are short enough for the passage to reach the prefix."""
    rng = random.Random(33)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(9 if i % 2 else 40)) + " " + passage) for i in range(10000)]
    written = []
    keep = shingle_join.materialize

    def counted(df):
        table = keep(df)
        written.append((table.columns, table.count()))
        return table

    monkeypatch.setattr(shingle_join, "materialize", counted)
    data = spark.createDataFrame(rows, "stack_id long, report string").repartition(8)
    found = shingle_join.shingle_groups(data)
    assert found.where("component_id <> stack_id").count() == 0
    assert max(n for _, n in written) <= 10000
    assert sum(n for c, n in written if c[:2] == ["a", "b"]) == 0


def test_near_copies_cost_their_number(spark, monkeypatch):
    """2,000 texts that differ from one text in a word each are one class, by fewer pairs than three for each text."""
    rng = random.Random(34)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(2000):
        words = list(base)
        words[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(words)))
    pairs = []
    keep = shingle_join.materialize

    def counted(df):
        table = keep(df)
        if table.columns[:2] == ["a", "b"]:
            pairs.append(table.count())
        return table

    monkeypatch.setattr(shingle_join, "materialize", counted)
    found = shingle_join.shingle_groups(spark.createDataFrame(rows, "stack_id long, report string").repartition(8))
    assert found.where("component_id = 0").count() == 2000
    assert max(pairs) < 3 * 2000


def test_near_fingerprints_come_first(spark, monkeypatch):
    """The stage's pivot tables link most near copies, the join of shingles the rest; together they are all pairs."""
    rng = random.Random(35)
    texts = variants(rng, 150)
    base = [f"b{i}" for i in range(400)]
    texts += [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(40)]
    data = spark.createDataFrame(list(enumerate(texts)), "stack_id long, report string").repartition(5)
    known, tried = [], []
    first, later = shingle_join.print_links, shingle_join._still_apart

    def search(*given):
        known.append(first(*given))
        return known[-1]

    def rest(pairs, links):
        left = later(pairs, links)
        tried.append((pairs.count(), left.count()))
        return left

    monkeypatch.setattr(shingle_join, "print_links", search)
    monkeypatch.setattr(shingle_join, "_still_apart", rest)
    kept = sorted(r["stack_id"] for r in shingle_copies.drop_similar(data).collect())
    assert kept == sorted({c for _, _, c in components(list(range(len(texts))), texts, 5, 80) if c is not None})
    assert known[0].count() > 20
    assert tried[0][1] < tried[0][0] - 20


def test_stage_drops_near_fingerprints_of_other_sets(spark):
    """Fingerprints of at most two differing bits link in the pipeline, also where fewer than 80 % of the shingles agree."""
    texts = variants(random.Random(35), 150) + [None, "", " \n", "é É x"]
    sets, prints = [shingle_set(t, 5) for t in texts], [near_copies.fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    alike = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 5 * len(x & y) >= 4 * len(x | y)]

    def least(links):
        root = list(range(len(texts)))
        for i, j in links:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
        return sorted(set(root))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert kept == least(near + alike)
    assert len(kept) < len(least(alike)) and len(kept) < len(least(near))


def test_reports_of_the_engine(spark, make):
    stacks, pixels = make({"ball": sphere(), "ball again": sphere(), "dot": sphere(radius=2)})
    result = analyze(stacks, pixels, Settings(100.0, only_positive=True))
    texts = run_reports(report_lines(result.summary, result.rows, ["stack_id"]))
    held = {r["stack_id"]: r["report"] for r in texts.collect()}
    want = components(list(held), list(held.values()))
    assert plain(shingle_join.shingle_groups(texts).collect()) == plain(want)
    kept = sorted(r["stack_id"] for r in shingle_copies.drop_similar(texts).collect())
    assert kept == sorted({c for _, _, c in components(list(held), list(held.values()), 5, 80)})


def test_dropping_keeps_columns_and_single_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text, 1), (3, text, 1), (4, text + " x", 2), (None, text.upper(), 3), (5, "", 4), (6, None, 5), (7, " \n", 6), (None, "alone", 7)]
    data = spark.createDataFrame(rows, "stack_id long, report string, _n int")
    kept = shingle_copies.drop_similar(data)
    assert kept.columns == data.columns
    assert sorted((r[2] for r in kept.collect())) == [1, 4, 7]
    assert shingle_copies.drop_similar(data.where("false")).count() == 0


def test_query_of_the_join(spark):
    given = pq.read_table(f"{FOLDER}/documents.parquet")
    want = components(given["doc_id"].to_pylist(), given["text"].to_pylist())
    got = QUERIES["op12_shingle_join"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert plain(got.collect()) == plain(want)
    assert got.where(F.col("component_id") > F.col("doc_id")).count() == 0


def test_representatives_are_written_once(spark, monkeypatch):
    """The joins read a written table of different sets, and none shuffles their prefixes and parities anew."""
    plans = []
    real = shingle_join.similar_links

    def seen(texts, survey, different, rule, known=None):
        plans.append(different._jdf.queryExecution().optimizedPlan().toString())
        return real(texts, survey, different, rule, known)

    monkeypatch.setattr(shingle_join, "similar_links", seen)
    words = [f"w{i}" for i in range(30)]
    texts = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words, "more"])), (4, "other")], "_key long, _text string")
    for prints in (False, True):
        found = {r["_key"]: r["root"] for r in shingle_join.similar_classes(texts, 4, 85, prints=prints).collect()}
        assert found[1] == found[2] == found[3] != found[4]
    assert len(plans) == 2 and not any("Join" in p for p in plans)
