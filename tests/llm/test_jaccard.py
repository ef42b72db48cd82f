import random

import numpy as np
import pytest
from common import TEXTS, edge_docs, words

from veritally.llm import components as parts
from veritally.llm import jaccard
from veritally.llm.components import components


def brute(rows):
    sets = []
    for _, text in rows:
        own = words(text)
        sets.append({tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def made_up(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [rnd.choices(vocabulary, k=rnd.randint(20, 60)) for _ in range(6)]
    common = rnd.choices(vocabulary, k=12)
    rows = []
    for k in range(180):
        own = list(rnd.choice(bases[:2] if rnd.random() < 0.7 else bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 1, 2, 3, 5])):
            own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        rows.append((k, " ".join(common + own if rnd.random() < 0.3 else own)))
    rows += [(1000 + k, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 12)))) for k in range(40)]
    return rows


@pytest.mark.parametrize("chunk, central, frequent", [(300_000, 32, 64), (150, 2, 2)])
def test_components_against_brute_force(spark, monkeypatch, chunk, central, frequent):
    """With small chunks, large hubs are cut and their outsiders compared with all of them."""
    for name, value in (("CHUNK", chunk), ("CENTRAL", central), ("FREQUENT", frequent)):
        monkeypatch.setattr(jaccard, name, value)
    rows = made_up(chunk)
    found = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_edge_rows(spark):
    found = jaccard.join(edge_docs(spark))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(TEXTS)
    left = [r.doc_id for r in jaccard.survivors(edge_docs(spark)).collect()]
    assert sorted(left, key=repr) == sorted([i for i, _ in TEXTS if i not in (2, 3, 9)], key=repr)
    assert jaccard.join(edge_docs(spark).limit(0)).count() == 0


def test_only_hashes_that_another_document_has_are_shipped(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:150], "other", *base[151:]])), (3, " ".join(f"v{i}" for i in range(50)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    slots = jaccard.repeated_slots(docs, "text", 5)
    made = {r.doc_id: r for r in jaccard.sets(docs.repartition(3, "doc_id"), slots, "text", 5, 80).collect()}
    assert [made[i].n_shingles for i in (1, 2, 3)] == [196, 196, 46]
    assert len(made[1].hashes) == len(made[2].hashes) == 191 and made[1].key != made[2].key and made[3].hashes is None
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_small_tables_of_components_take_few_tasks(spark):
    pairs = spark.range(400).selectExpr("id div 2 as member", "(id + 1) div 2 + 1000 as via").repartition(64)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup("small components", "")
        assert {r.root for r in components(pairs).collect()} == {0}
        stages = {s for job in tracker.getJobIdsForGroup("small components") for s in tracker.getJobInfo(job).stageIds}
        sizes = [info.numTasks for s in stages if (info := tracker.getStageInfo(s))]
        wide = sum(n == 64 for n in sizes)
        assert wide < len(sizes) / 3, sizes
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


def _jobs(spark, group, action):
    """What the action gives, and the number of Spark jobs that it took."""
    spark.sparkContext.setJobGroup(group, "")
    try:
        return action(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("task_rows", [200_000, 40])
def test_components_of_chains_and_hot_keys(spark, monkeypatch, task_rows):
    """Chains, a key that many members have, and lone members, as numbers and as bytes, dealt by chance; in few jobs."""
    monkeypatch.setattr(parts, "TASK_ROWS", task_rows)
    chain = [(m, v) for m in range(500) for v in (m, m + 1)]
    hot = [(1000 + m, 5000) for m in range(300)]
    rows = chain + hot + [(2000 + m, 6000 + m) for m in range(50)] + [(2000, 5000), (3000, 0)]
    expected = {m: 0 if m < 500 or m == 3000 else 1000 if m < 2001 else m for m, _ in rows}
    random.Random(3).shuffle(rows)
    pairs = spark.createDataFrame(rows, "member bigint, via bigint").repartition(7)
    found, jobs = _jobs(spark, f"chains {task_rows}", lambda: components(pairs).collect())
    assert len(found) == len(expected) and {r.member: r.root for r in found} == expected
    if task_rows == 200_000:
        assert jobs < 20, jobs
    names = pairs.selectExpr("cast(lpad(cast(member as string), 5, '0') as binary) member", "cast(cast(via as string) as binary) via")
    assert {int(bytes(r.member)): int(bytes(r.root)) for r in components(names).collect()} == expected
    assert components(pairs.limit(0)).count() == 0


def test_repeated_slots_come_in_one_job(spark):
    """As numbers of slots where few are set, as bits where most are."""
    rows = [(i, " ".join(f"w{i % 7}x{k}" for k in range(40))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        slots, jobs = _jobs(spark, "slots", lambda: jaccard.repeated_slots(docs, "text", 5))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    hashes = np.unique(jaccard.shingles(docs.toArrow()["text"].combine_chunks(), 5)[1])
    expected = np.zeros(len(slots), np.uint8)
    at = (hashes >> np.uint64(64 - jaccard.SLOT_BITS)).astype(np.int64)
    np.bitwise_or.at(expected, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    assert (slots == expected).all() and jobs < 8, jobs


@pytest.mark.parametrize("slot_bits", [26, 16])
def test_only_sets_that_share_enough_are_shipped(spark, monkeypatch, slot_bits):
    """However full the bit table of repeated shingles is: neither other documents nor exact copies alone have their sets shipped."""
    rnd = random.Random(7)
    words_of = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows = [(k, " ".join(words_of(rnd.randint(100, 300)))) for k in range(150)]  # alone
    rows += [(k + 1000, rows[k][1]) for k in range(30)]  # exact copies of some of them
    for k in range(0, 300, 2):  # pairs of near copies, whose shingles fill the small table
        own = words_of(600)
        rows += [(5000 + k, " ".join(own)), (5001 + k, " ".join([*own[:300], "other", *own[301:]]))]
    shipped = []
    real = jaccard.roots
    monkeypatch.setattr(jaccard, "SLOT_BITS", slot_bits)
    monkeypatch.setattr(jaccard, "roots", lambda nodes, percent: shipped.append(nodes.count()) or real(nodes, percent))
    found = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert found == {i: i - 1000 if 1000 <= i < 5000 else i - i % 2 if i >= 5000 else i for i, _ in rows}
    assert shipped == [300]


def test_sets_of_any_size_pass_that_link(spark):
    """Sizes about the bound up to which all shingles are looked up, with as few shared ones as link; a null id and equal rows among them."""
    rows, expected = [], {}
    for size in [*range(1, 12), *range(60, 90, 3), 200]:
        fewest = next(n for n in range(size + 1) if jaccard.linked(n, size, size, 80))
        own = [f"s{size}x{k}" for k in range(size + 4)]
        # Words changed at the end: as many shingles differ.
        near = [*own[: len(own) - (size - fewest)], *(f"n{size}x{k}" for k in range(size - fewest))]
        rows += [(size, " ".join(own)), (1000 + size, " ".join(near)), (1000 + size, " ".join(near)), (None, " ".join(own))]
        expected |= {size: size, 1000 + size: size}
    found = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows)
    assert {r.doc_id: r.component_id for r in found if r.doc_id} == expected and all(r.component_id == r.n_shingles for r in found if r.doc_id is None)
