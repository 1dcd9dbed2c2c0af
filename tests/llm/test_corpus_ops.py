"""Operators on whole tables, against brute force on small fixtures."""

import bisect
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from newslens.llm import decontaminate, maxent_lm, merkle, ngram_trie, queries, sharding, url_cascade
from newslens.plans.harness import compare, duck

SMALL = "/root/testdata/sf0.001"


def words(r, n):
    return [r.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi om pi rho".split()) + str(r.randint(0, 9)) for _ in range(n)]


def corpus(seed=2):
    """Copies, near copies in a chain, shared passages, short and empty texts, repeated rows, null ids."""
    r = random.Random(seed)
    passage = words(r, 30)
    texts = [" ".join(words(r, r.randint(1, 120)) + (passage if i % 3 == 0 else [])) for i in range(60)]
    for i in range(40):
        w = texts[r.randrange(len(texts))].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = words(r, 1)[0]
        texts.append(" ".join(w))
    texts += [None, "", "  \n", "One two", "one  TWO", "one two three", texts[3]]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("unit", [ngram_trie.UNIT_SHINGLES, 150])
def test_jaccard_classes(spark, unit):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id bigint, text string, n int, digest string").repartition(5)
    found = ngram_trie.jaccard_classes(df, unit_shingles=unit).collect()
    want = brute_classes(rows)
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_jaccard_edges(spark):
    schema = "doc_id bigint, text string"
    assert ngram_trie.jaccard_classes(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "A b c d e f"), (2, None), (None, None)], schema)
    assert sorted(map(str, ngram_trie.jaccard_classes(df).collect())) == sorted(map(str, [
        spark.createDataFrame([(a, n, c)], "doc_id bigint, n_shingles bigint, component_id bigint").first()
        for a, n, c in ((None, 2, 4), (4, 2, 4), (2, 0, 2), (None, 0, None))]))


def test_one_of_each_class(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, lang string")
    kept = ngram_trie.one_of_each_class(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute_classes(rows).values()})


def test_trie_against_pairs():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 4000, 60).astype(np.uint64)) for _ in range(6)]
    sets = {tuple(np.unique(np.where(rng.random(len(b)) < 0.1, rng.integers(0, 4000, len(b)).astype(np.uint64), b)).tolist()) for b in base for _ in range(25)}
    sets = [np.array(s, np.uint64) for s in sorted(sets, key=lambda s: (len(s), s))]
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                ngram_trie._union(parent, i, j)
    assert ngram_trie.linked(sets) == [ngram_trie._find(parent, i) for i in range(len(sets))]


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {x.node: x.root for x in ngram_trie.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for x in parent if find(x) != x}


def test_fingerprints(spark):
    texts = {9: "a\nb\n" + "long line " * 20, 7: "a\nb\n" + "long line " * 20, 5: None, 4: "", 2: "é🙂" * 50, 1: "x\ny"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in merkle.fingerprints(df).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        assert rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert rows[i].n_chars == len(t) and 0 <= rows[i].near_edited <= 1
    assert rows[9].fingerprint == rows[7].fingerprint and rows[9].near_next == 1 and rows[5].fingerprint == rows[4].fingerprint
    assert rows[7].near_next == 0 and rows[9].fingerprint != rows[1].fingerprint
    assert merkle.fingerprints(df.limit(0)).count() == 0


def test_many_buckets_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 7)
    rows = [(i * 3, f"t{i}") for i in range(100)] + [(None, "n")]
    found = {(r.id, r.text): r.next_text for r in merkle.next_rows(spark.createDataFrame(rows, "id bigint, text string").repartition(6)).collect()}
    assert found == {(i * 3, f"t{i}"): f"t{i - 1 if i else 99}" for i in range(100)} | {(None, "n"): "t99"}


def test_differing_sections(spark):
    lines = [f"line {i}" for i in range(30)]
    other = lines[:20] + ["changed"] + lines[21:]
    df = merkle.with_fingerprints(spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string"), {"a": "fa", "b": "fb"})
    assert df.select(merkle.differing_sections(df.fa, df.fb)).first()[0] == [20 // merkle.SECTION]


def test_url_rules_against_plain_matching(spark):
    r = random.Random(6)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "xexample.com", "s.net", "net", "", "EXAMPLE.com", "x.org"]
    urls = [f"http://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en', '/es/x', '/fr/?q', '?q=/en/', '#a'])}" for _ in range(300)] + [None, "", "no scheme/en/", "://", "a://b://com/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS key")
    found = {x.page_id: x for x in url_cascade.judge(df, url_cascade.rules_table(spark, queries.URL_RULES)).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host):].split("?")[0].split("#")[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, url_cascade.DEFAULT))
        assert (found[i].host, found[i].path, found[i].rule, found[i].verdict) == (host, path, best[1], best[2]), u


def test_cascade_is_exact_over_its_universe(spark):
    listed = {f"k{i}" for i in range(0, 4000, 7)}
    universe = spark.createDataFrame([(f"k{i}",) for i in range(4000)], "key string")
    levels = url_cascade.build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), universe)
    assert len(levels) >= 2
    got = {r.key for r in universe.where(url_cascade.member(levels, universe.key)).collect()}
    assert got == listed
    assert url_cascade.build_cascade(universe.limit(0), universe) == []


def test_decontamination(spark):
    item = "What is the total price in euros if Anna buys 12 apples and 7 pears and then gives 12 apples to her brother Paul today"
    changed = item.replace("12", "30").replace("7", "9").replace("Anna", "Maria")
    broken = item.replace("12", "30", 1)  # one value of the item has become two
    clean = "The total price of a house is not what Anna thinks about when she gives apples to her brother"
    docs = [(1, f"Before. {item}. After."), (2, f"x y z\n{changed}"), (3, broken), (4, clean), (5, None), (6, ""), (1, f"Before. {item}. After."), (7, "Two words?")]
    items = [(10, item), (11, None), (12, "Two words?"), (10, item), (13, "")]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id bigint, text string, h int")
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id bigint, text string, total int")
    found = {(r.doc_id, r.item_id): (r.verbatim, r.consistent) for r in decontaminate.contaminated(d, b).collect()}
    assert found == {(1, 10): (True, True), (2, 10): (False, True), (3, 10): (False, False), (7, 12): (True, True)}
    kept = decontaminate.without_contaminated(d, b)
    assert kept.columns == d.columns and {4, 5, 6} == {r.doc_id for r in kept.collect()}
    assert decontaminate.contaminated(d, b.limit(0)).count() == decontaminate.contaminated(d.limit(0), b).count() == 0


def test_sharding_is_the_least_capacity(spark):
    r = random.Random(8)
    rows = [(i, "é" * r.choice([0, 1, 5, 50, 2000])) for i in range(500)] + [(1000 + i, "copy" * 300) for i in range(150)] + [(2000, None), (2001, ""), (2000, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, size int").repartition(4)
    found = sharding.shard_by_bytes(df, 16).collect()
    sizes = defaultdict(int)
    for _, t in rows:
        sizes[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    keys = sorted(sizes)
    in_order = [sizes[k] for k in keys]
    least = next(c for c in range(max(in_order), sum(in_order) + 1) if sharding.greedy(in_order, c, 16) is not None)
    cuts = [keys[i] for i in sharding.greedy(in_order, least, 16)]
    slots = defaultdict(list)
    texts = dict(rows)
    for x in found:
        t = (texts[x.doc_id] or "").encode()
        assert x.shard == bisect.bisect_right(cuts, hashlib.md5(t).hexdigest()) and x["size"] == len(t) + 1 and x.text_crc32 == zlib.crc32(t)
        slots[x.shard].append(x.slot)
    assert len(found) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0


def test_cuts_through_finer_ranges(spark):
    r = random.Random(9)
    sizes = {f"{r.randrange(3):04x}{r.randrange(16 ** 28):028x}": r.randint(1, 90) for _ in range(400)}  # three first ranges only
    found = sharding.cuts(spark.createDataFrame(list(sizes.items()), "key string, size bigint"), 7)
    keys = sorted(sizes)
    in_order = [sizes[k] for k in keys]
    want = [keys[i] for i in sharding.greedy(in_order, sharding.smallest_capacity(in_order, 7), 7)]
    assert [bisect.bisect_left(keys, c) for c in found] == [keys.index(c) for c in want]


def lm_rows():
    r = random.Random(11)
    return [(i, " ".join(r.choice(["the cat sat", "a Dog ran", f"rare{i}"]) for _ in range(r.randint(0, 30)))) for i in range(150)] + [(200, None), (201, ""), (7, "the cat sat")]


@pytest.mark.parametrize("head", [maxent_lm.HEAD, 12])
def test_language_model(spark, monkeypatch, head):
    monkeypatch.setattr(maxent_lm, "HEAD", head)
    rows = lm_rows()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, h int").repartition(3)
    found = maxent_lm.held_out_scores(df).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    toks = lambda t: [*(t or "").encode().lower().split(), 0]
    c = Counter(w for i, t in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    assert len(found) == len(rows)
    for x in found:
        bases = [sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)) for t in texts[x.doc_id]]
        assert min(abs(b - x.base_score) for b in bases) < 1e-9 and x.held_out == held(x.doc_id) and x.train_tokens == n
        assert x.score < 0
    out = [x for x in found if x.held_out]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)


def test_language_model_adds_up_to_one(spark):
    df = spark.createDataFrame([(i, t) for i, t in lm_rows()], "doc_id bigint, text string")
    counts = maxent_lm.token_counts(df)
    model = maxent_lm.train(df.selectExpr("text", "doc_id AS slice"), counts)
    v = model.vocabulary
    inside = np.zeros(maxent_lm.CLASSES)
    for h in range(len(v.hashes)):
        k = v.classes[h]
        inside[k] += (v.counts[h] + 1) / (v.class_tokens[k] + v.class_types[k] + (k == maxent_lm.REST))
    inside[maxent_lm.REST] += 1 / (v.class_tokens[-1] + v.class_types[-1] + 1)  # never seen
    assert inside[v.class_types > 0] == pytest.approx(np.ones((v.class_types > 0).sum()))


def test_language_model_without_training(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert maxent_lm.held_out_scores(df).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = maxent_lm.held_out_scores(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert row.score == pytest.approx(3 * math.log10(1 / maxent_lm.CLASSES), rel=1e-5)


@pytest.mark.parametrize("name", ["op4_merkle", "op5_url_cascade"])
def test_oracles(spark, name):
    assert compare(spark, name, SMALL, queries.QUERIES[name], queries.ORACLES[name], duck(SMALL))["status"] == "match"


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bad = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 0").collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    one = corpus_pipeline.quality(spark, docs, SMALL)
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns and len(kept & bad) <= len(bad) // 3 and len(kept) > 100
    two = corpus_pipeline.near_duplicates(spark, one, SMALL)
    assert {r.doc_id for r in two.collect()} == {c for _, c in brute_classes([(i, rows[i]) for i in kept]).values()}
    three = corpus_pipeline.decontamination(spark, two, SMALL)
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert three.columns == docs.columns
    left = three.collect()
    assert not any(" ".join(i.split()) in " ".join(r.text.split()) for r in left for i in items)
    four = corpus_pipeline.tokens(spark, three, SMALL).collect()
    assert {r.doc_id: r.decoded_sha256 for r in four} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in left}


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return d, b, {(r.doc_id, r.item_id): (r.verbatim, r.coverage) for r in decontaminate.contaminated(d, b).collect()}


def test_decontamination_over_neighbouring_diagonals(spark):
    item = "Alice has many red apples in her small house, and then Tom takes some of the red apples away from there while Alice sleeps all day under the old tree"
    changed = item.replace("Tom", "Mary Ann")
    renamed = item.replace("Alice", "Maria Luisa")
    w = item.split()
    longer = " ".join([*w[:15], "really", *w[15:]])
    assert {k: v[0] for k, v in leaks(spark, [(1, changed), (2, renamed), (3, longer), (4, " ".join(w[:12]))], [(9, item)])[2].items()} == {(1, 9): False, (2, 9): False, (3, 9): False}
    assert leaks(spark, [(1, changed), (2, renamed)], [(9, item)])[2] == {(1, 9): (False, 1.0), (2, 9): (False, 1.0)}


def test_decontamination_finds_short_and_numeric_items(spark):
    sums = " ".join(f"add {i} and {i + 1}," for i in range(9))
    docs = [(1, "He asks: What is 12 + 7? It is hard."), (2, "What is 13 + 7?"), (3, f"so {sums} done"), (4, sums.replace("add 4", "add 44"))]
    assert set(leaks(spark, docs, [(9, "What is 12 + 7?"), (8, sums)])[2]) >= {(1, 9), (3, 8)}
    assert (2, 9) not in leaks(spark, docs, [(9, "What is 12 + 7?")])[2]


def test_decontamination_lets_two_values_become_one(spark):
    item = "the farmer buys 12 apples and 7 pears and then carries all of them home to the old village"
    assert set(leaks(spark, [(1, item.replace("12", "9").replace("7", "9"))], [(9, item)])[2]) == {(1, 9)}


def test_decontamination_by_text_not_id(spark):
    item = "the farmer buys twelve apples and seven pears and then carries all of them home to the old village"
    other = "a painter mixes three colours in the morning and paints the long wall of the school until night"
    docs = [(None, f"x {item}"), (None, "a clean text"), (None, None), (5, "a clean text too"), (5, item)]
    d, b, found = leaks(spark, docs, [(None, item), (7, other), (7, "What never was asked in any of the documents that are given here today")])
    assert set(found) == {(None, None), (5, None)}
    assert sorted(str(r.text) for r in decontaminate.without_contaminated(d, b).collect()) == ["None", "a clean text", "a clean text too"]
    assert set(leaks(spark, [(1, other)], [(7, other), (7, item)])[2]) == {(1, 7)}


def test_decontamination_variants_of_one_item(spark):
    """(verbatim, consistent) of copies that differ from the item in one way each; None: not reported."""
    item = "A farmer named Rosa sells 12 crates of plums for 12 dollars each and then she pays 30 dollars to the driver who brings them all to town"
    variants = {
        item: (True, True), f"Q: {item}, they said.": (True, True), item.replace(" ", "  \n", 3): (True, True), item.upper(): None, item.lower(): (False, True),
        item.replace("sells", "trades").replace("pays", "hands"): None, item.replace("12", "twelve"): None,  # less than half of the windows are left
            item.replace("sells", "trades"): (False, True), item.replace("12", "twelve", 1): (False, True), item.replace("30 dollars", "$30"): (False, True),
        item.replace("12", "15"): (False, True), item.replace("12", "15", 1): (False, False), item.replace("Rosa", "Juan Pablo"): (False, True),
        item.replace("each and", "each, and"): (True, True), item.replace("of plums", "of small sour plums"): (False, True), " ".join(item.split()[:9]): None,
        "A farmer sells plums and then pays the driver who brings all of them": None,
    }
    docs = list(enumerate(variants))
    found = leaks(spark, docs, [(9, item)])[2]
    consistent = {r.doc_id: r.consistent for r in decontaminate.contaminated(*leaks(spark, docs, [(9, item)])[:2]).collect()}
    got = {t: (found[i, 9][0], consistent[i]) if (i, 9) in found else None for i, t in docs}
    got[item.upper()] = None  # capitals throughout are no names, so it is the words in lower case that count: reported or not, never verbatim
    assert got == variants and not any(v[0] for k, v in found.items() if docs[k[0]][1] == item.upper())


def test_decontamination_loses_no_text_before_the_windows(spark):
    """Texts put aside by word pairs hold no window of any item, whatever stands between the words."""
    r = random.Random(31)
    vocabulary = "the a of red small house İzmir don't ΟΔΟΣ école Ann Bob Paris 12 3.5 % $ km dollars and goes, then. Well-known".split()
    def text(n):
        return r.choice([" ", "  ", "\n"]).join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(3, 16))) for i in range(30)] + [(40, "12 + 7"), (41, "Ann 12 Bob 7"), (42, "ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ"), (43, None)]
    docs = [(i, " ".join([text(r.randint(0, 9)), *[t for _, t in r.sample(items, r.randint(0, 2)) if t], text(r.randint(0, 9))])) for i in range(120)] + [(200, None), (201, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    texts, questions = decontaminate._keyed(d, "text"), decontaminate._keyed(b, "text").where("text is not null")
    listed = decontaminate._templates(questions).join(decontaminate._literals(questions), "id")
    own = None
    for form, rows in (("word", listed), ("name", listed.where("size(opens) > 0")), ("plain", listed)):
        some = decontaminate._item_windows(rows, form, 8).withColumnRenamed("id", "item").withColumnRenamed("at", "item_at")
        own = some if own is None else own.unionByName(some)
    own = own.drop("ordinary").where("size(pairs) > 0").cache()
    held = {x.id for x in decontaminate._candidates(texts, own, 0.0).collect()}
    hit = {x.id for x in decontaminate._matches(texts, own).select("id").distinct().collect()}
    assert hit and hit <= held
    half = {x.id for x in decontaminate._candidates(texts, own, 0.5).collect()}
    matched = decontaminate._matches(texts, own).groupBy("id", "item").agg(F.countDistinct("item_at").alias("n"))
    total = own.groupBy("item").agg(F.countDistinct("item_at").alias("total"))
    assert {x.id for x in matched.join(total, "item").where("n >= 0.5 * total").collect()} <= half


def test_decontamination_windows_equal_plain_python(spark):
    """Items without names, units or numbers: the share of windows that a text holds on one diagonal or chain, by direct search."""
    r = random.Random(32)
    letters = [w for w in "amber birch cedar daisy elder fern grass hazel iris juniper".split()]
    items = [(i, " ".join(r.choice(letters) for _ in range(r.randint(8, 14)))) for i in range(8)]
    docs = []
    for i in range(60):
        parts = [r.choice(letters) for _ in range(r.randint(0, 10))]
        if i % 2:
            w = r.choice(items)[1].split()
            at = r.randint(0, 3)
            parts += w[at : len(w) - r.randint(0, 3)]
        docs.append((i, " ".join(parts + [r.choice(letters) for _ in range(r.randint(0, 10))])))

    def windows(t):
        w = t.split()
        return [tuple(w[k : k + 8]) for k in range(len(w) - 7)]

    wanted = {}
    for i, t in docs:
        held = windows(t)
        for j, q in items:
            asked = windows(q)
            found = {k for k, x in enumerate(asked) if x in held}
            if len(found) >= 0.5 * len(asked):
                wanted[i, j] = (f" {q} " in f" {t} ", len(found) / len(asked))
    assert len(wanted) >= 10 and leaks(spark, docs, items)[2] == wanted


def test_near_copies_without_id_are_linked_and_one_row_stays(spark):
    r = random.Random(41)
    w = words(r, 80)
    near = [*w[:40], "other", *w[41:]]
    rows = [(None, " ".join(w), 1), (None, " ".join(near), 2), (None, "quite another text of some more words than five", 3), (None, " ".join(w), 4), (30, "copy of nothing at all here", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, gone int")
    found = ngram_trie.jaccard_classes(df).collect()
    assert len(found) == 5 and {x.component_id for x in found if x.doc_id is None} == {None}
    kept = ngram_trie.one_of_each_class(df).collect()
    assert sorted(x.gone for x in kept if x.gone in (3, 5)) == [3, 5] and len([x for x in kept if x.gone in (1, 2, 4)]) == 1
    both = spark.createDataFrame([*rows, (9, " ".join(near), 6), (100, " ".join(w), 7)], df.schema)
    assert {(x.doc_id, x.component_id) for x in ngram_trie.jaccard_classes(both).collect()} == {(None, 9), (9, 9), (100, 9), (None, None), (30, 30)}
    assert {x.gone for x in ngram_trie.one_of_each_class(both).collect()} == {3, 5, 6}
