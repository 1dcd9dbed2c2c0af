"""Suffix-array deduplication, centroid clustering and conversation repair against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.llm import centroids, conversation_repair, suffix_dedup

DOCS = "doc_id long, text string"


# --- suffix-array deduplication ---------------------------------------------------------------------------


def _starts_elsewhere(bodies, length):
    count = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    return [[i for i in range(len(b) - length + 1) if count[b[i:i + length]] > 1] for b in bodies]


def _removed(texts, length):
    """(bytes, removed, spans, digest of the rest) of each text, by a table of all strings."""
    out = []
    for body, starts in zip(texts, _starts_elsewhere(texts, length)):
        gone = np.zeros(len(body) + 1, int)
        for i in starts:
            gone[i:i + length] = 1
        gone[-1] = 0
        kept = bytes(c for c, g in zip(body, gone) if not g)
        out.append((len(body), int(gone.sum()), int(((gone[1:] == 1) & (gone[:-1] == 0)).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def _bodies(rng, length, n):
    letters = rng.choice([b"ab", b"abc", bytes(range(256)), b"\0\1\xff"])
    bodies = []
    for _ in range(n):
        if bodies and rng.random() < 0.6:
            body = bytearray(rng.choice(bodies))
            for _ in range(rng.randint(0, 2)):
                if body:
                    body[rng.randrange(len(body))] = rng.choice(letters)
            body = bytes(body[rng.randrange(len(body) + 1):]) + bytes(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        else:
            body = bytes(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        bodies.append(b"z" * rng.randint(0, 90) if rng.random() < 0.1 else body)
    return bodies


def test_suffix_arrays_find_every_repeat():
    rng = random.Random(1)
    for _ in range(150):
        length = rng.choice([9, 16, 20, 33])
        bodies = _bodies(rng, length, rng.randint(1, 12))
        assert [x.tolist() for x in suffix_dedup.repeated(bodies, length)] == _starts_elsewhere(bodies, length)


def test_suffix_order_is_that_of_sorted_suffixes():
    rng = random.Random(2)
    for _ in range(50):
        body = bytes(rng.choice(b"abz") for _ in range(rng.randint(1, 200)))
        data = np.frombuffer(body + bytes(40), np.uint8)
        wanted = np.arange(len(data)) < len(body)
        order = suffix_dedup.suffix_order(data, wanted, 32)
        keys = [bytes(data[i:i + 32]) for i in order]
        assert sorted(order.tolist()) == list(range(len(body))) and keys == sorted(keys)


def test_runs_hold_every_string_once_and_equal_strings_have_equal_anchors():
    rng = random.Random(3)
    for _ in range(60):
        length = rng.choice([9, 20])
        bodies = _bodies(rng, length, 8)
        owner, first, count, left, h, _ = suffix_dedup.runs(bodies, length, length * 5 // 8)
        found = {}
        for i, a, n, x, key in zip(owner, first, count, left, h):
            for j in range(n):
                assert (i, a + j) not in found
                found[i, a + j] = (key, x - j)
        assert len(found) == sum(max(0, len(b) - length + 1) for b in bodies)
        named = {}
        assert all(named.setdefault(bodies[i][p:p + length], v) == v for (i, p), v in found.items())


def test_runs_of_long_texts_are_cut_into_segments(monkeypatch):
    rng = random.Random(4)
    body = bytes(rng.choice(b"abcdefgh \n") for _ in range(5000))
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 1000)
    owner, first, count, *_ = suffix_dedup.runs([body, b"", body[:30]], 40, 25)
    starts = sorted(int(a) + j for a, n in zip(first, count) for j in range(n))
    assert starts == list(range(4961)) and set(owner) == {0}


def _documents(rng):
    words = ["alpha", "beta", "gamma", "délta", "eps", "zeta\n", "eta", "theta."]
    passage = " ".join(rng.choices(words, k=30))
    texts = [None, "", "short", "x" * 300, "same " * 40, "same " * 40]
    for k in range(40):
        own = " ".join(str(rng.random()) for _ in range(rng.randint(1, 12)))
        texts.append(own if k % 3 else own + passage + " " + own[::-1])
    texts += [texts[8], texts[9] + "!", "q" + texts[9][3:]]
    return texts


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 3])
def test_removed_bytes_equal_brute_force(spark, most, monkeypatch):
    rng = random.Random(5)
    texts = _documents(rng)
    monkeypatch.setattr(suffix_dedup, "NARROW", 4)
    ids = [None, 7, 7, *range(10, 10 + len(texts) - 3)]
    docs = spark.createDataFrame(list(zip(ids, texts)), DOCS).repartition(3)
    found = suffix_dedup.removed(docs, length=40, anchor=25, most=most).collect()
    rows = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    wanted = Counter((i, *w) for i, w in zip(ids, _removed([(t or "").encode() for t in texts], 40)))
    assert rows == wanted


def test_removed_of_the_given_documents_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = docs.collect()
    wanted = {(r.doc_id, *w) for r, w in zip(texts, _removed([(r.text or "").encode() for r in texts], 200))}
    assert {tuple(r) for r in suffix_dedup.removed(docs).collect()} == wanted


def test_removed_of_empty_tables_and_with_clashing_columns(spark):
    assert suffix_dedup.removed(spark.createDataFrame([], DOCS)).collect() == []
    names = "doc_id long, text string, tkey string, h int, at int, found string, spans int, copies int"
    rows = [(1, "k" * 250, "a", 1, 1, "x", 1, 1), (2, "l" * 100, "a", 1, 1, "x", 1, 1)]
    found = suffix_dedup.removed(spark.createDataFrame(rows, names)).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in found) == [(1, 250, 1), (2, 0, 0)]


def test_very_long_text(spark):
    rng = random.Random(6)
    half = "".join(rng.choices("abcdefghij klmno", k=700_000))
    tail = "".join(rng.choices("pqrstuvw", k=500_000))
    docs = spark.createDataFrame([(1, half + tail + half), (2, tail[1000:1300])], DOCS)
    found = {r.doc_id: r for r in suffix_dedup.removed(docs).collect()}
    assert (found[1].n_removed, found[1].n_spans) == (1_400_300, 3) and found[2].n_removed == 300


# --- centroid clustering ----------------------------------------------------------------------------------


def test_search_equals_all_distances():
    rng = np.random.default_rng(1)
    for scale, k, d in ((3, 8, 4), (1000, 8, 64), (1000, 50, 16), (1 << 27, 8, 64), (1, 5, 2)):
        x = rng.integers(-scale, scale + 1, (500, d))
        c = rng.integers(-scale, scale + 1, (k, d))
        c[-1] = c[0]
        distance = ((x[:, None] - c) ** 2).sum(2)
        winner, best = centroids.Search(c).nearest(x)
        assert (winner == distance.argmin(1)).all() and (best == distance.min(1)).all()


def _lloyd(rows, clusters, rounds, seed=3):
    """rows (id, ints): plain Python."""
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centre = [list(r[1]) for r in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centre))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in rows:
            groups[nearest(x)[1]].append(x)
        for k, xs in groups.items():
            centre[k] = [sum(c) // len(xs) for c in zip(*xs)]
    got = [(i, *nearest(x)[::-1]) for i, x in rows]
    return got, centre


@pytest.mark.parametrize("n", [200, 3, 1])
def test_clusters_equal_plain_python(spark, n):
    rng = np.random.default_rng(n)
    vectors = rng.normal(size=(n, 6)).round(1).tolist()
    table = [(i if i % 50 else None, v, "extra") for i, v in enumerate(vectors)] + [(1, vectors[0], "again")]
    broken = [(900, None, ""), (901, vectors[0][:5], ""), (902, [*vectors[0][:5], None], ""), (903, [*vectors[0][:5], float("nan")], ""), (904, [*vectors[0][:5], float("-inf")], "")]
    df = spark.createDataFrame(table + broken, "vec_id long, embedding array<double>, cluster string").repartition(3)
    assigned, fitted = centroids.cluster(df, dimensions=6, clusters=5, rounds=4)
    found = centroids.with_inertia(assigned, fitted).collect()
    wanted, centre = _lloyd([(i, [int(np.floor(x * 1024)) for x in v]) for i, v, _ in table], 5, 4)
    assert fitted.tolist() == centre
    assert Counter((r.vec_id, r.cluster, r.distance) for r in found) == Counter(wanted)
    own = Counter()
    for _, k, d in wanted:
        own[k] += d
    for r in found:
        assert r.cluster_inertia == own[r.cluster] and r.inertia == sum(own.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centre[r.cluster])).encode()).hexdigest()


def test_clusters_of_empty_and_huge_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assigned, fitted = centroids.cluster(empty)
    assert centroids.with_inertia(assigned, fitted).collect() == []
    huge = spark.createDataFrame([(i, [3e38 * (-1) ** i] * 64) for i in range(12)], "vec_id long, embedding array<float>")
    found = centroids.with_inertia(*centroids.cluster(huge)).collect()
    assert len(found) == 12 and all(r.distance == 0 for r in found)


# --- conversation repair ----------------------------------------------------------------------------------


def _cheapest(rows):
    """rows (role, truncated, doomed): the least (cost, audit) over all edits, with two insertions in a row at most."""
    best = [(4 * len(rows), "D" * len(rows))]

    def follow(i, cost, audit, roles, inserted):
        if cost > best[0][0]:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles):
                best[0] = min(best[0], (cost, audit))
        else:
            role, truncated, doomed = rows[i]
            follow(i + 1, cost + 4, audit + "D", roles, 0)
            if not doomed:
                if role[:1] in ("s", "u", "a"):
                    follow(i + 1, cost + 3 * truncated, audit + "K", roles + role[0], 0)
                for r in "ua":
                    follow(i + 1, cost + 3 + 3 * truncated, audit + "R", roles + r, 0)
        if inserted < 2:
            for r in "ua":
                follow(i, cost + 3, audit + "I", roles + r, inserted + 1)

    follow(0, 0, "", "", 0)
    return best[0]


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(7)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", ""]
    for _ in range(600):
        rows = [(rng.choice(roles), rng.random() < 0.25, rng.random() < 0.2) for _ in range(rng.randint(0, 5))]
        repair = conversation_repair.Repair()
        edits = [e for role, truncated, doomed in rows for e in repair.push(role, "t", truncated, doomed)] + repair.finish()
        assert (repair.cost, "".join(e[0] for e in edits)) == _cheapest(rows)
        assert re.fullmatch("(s?(ua)+)?", "".join(e[1][0] for e in edits if e[0] != "D"))


def test_open_edits_stay_few():
    rng = random.Random(8)
    repair = conversation_repair.Repair()
    for i in range(20_000):
        repair.push(rng.choice(["user", "assistant", "system"]), "t", rng.random() < 0.25, i % 1000 > 500 or rng.random() < 0.2)
        for _, node, _ in repair.survivors.values():
            steps = 0
            while node is not repair.root:
                node, steps = node.parent, steps + 1
            assert steps < 50


def _report(turns):
    """turns (turn, role, text) in order, plain Python."""
    rows, seen, blank, duplicate, truncated, illegal = [], set(), 0, 0, 0, 0
    for i, (_, role, text) in enumerate(turns):
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        b = not solid
        d = not b and (role, text) in seen
        t = not b and not d and solid[-1] not in ".!?"
        seen.add((role, text))
        blank, duplicate, truncated = blank + b, duplicate + d, truncated + t
        illegal += i > 0 and turns[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        rows.append((role, t, b or d))
    cost, audit = _cheapest(rows)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    lines, i, total = [], 0, len(audit.replace("D", ""))
    for op in audit:
        put = "user" if (total - len(lines)) % 2 == 0 else "assistant"
        if op == "I":
            lines.append(f"{put}:")
        else:
            if op != "D":
                lines.append(f"{turns[i][1] if op == 'K' else put}:{turns[i][2]}")
            i += 1
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_audits_and_edits_of_a_table(spark):
    rng = random.Random(9)
    rows = []
    for conv in [None, *range(60)]:
        for turn in rng.sample([None, *range(9)], rng.randint(1, 5)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool"]),
                         rng.choice(["Yes.", "No", " \t", "", None, "what?", "Ok. \n", "x" * 5000]), "other", True))
    rows += rows[:3]
    rows = [r for r in rows if r[0] != 5] + [(5, 1, "user", "gone", "other", False)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, repeated string, here boolean").repartition(4)
    groups = defaultdict(list)
    for conv, turn, role, text, _, here in rows:
        groups[conv] += [(turn, " " if role is None else role, " " if text is None else text)] if here else []
    wanted = {conv: _report(sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for conv, g in groups.items()}
    found = {r.conv_id: tuple(r)[1:] for r in conversation_repair.audits(df, present=F.col("here")).collect()}
    assert found == wanted
    assert wanted[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    lines = defaultdict(list)
    for r in conversation_repair.edits(df, present=F.col("here")).orderBy("conv_id", "step").collect():
        lines[r.conv_id].append((r.edit, r.role, r.text))
    for conv, edits in lines.items():
        assert "".join(e for e, _, _ in edits) == wanted[conv][6]
        kept = "\n".join(f"{r}:{t}" for e, r, t in edits if e != "D")
        assert hashlib.sha256(kept.encode()).hexdigest() == wanted[conv][7]


def test_audits_of_an_empty_table_and_damage_of_nulls(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert conversation_repair.audits(conversation_repair.damaged(empty), present=F.col("present")).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None), (1, None, "user", "a.b?")], schema)
    found = conversation_repair.damaged(nulls).collect()
    assert {(r.role, r.text) for r in found if r.conv_id is None} <= {(" ", " "), (" ", ""), ("user", " ")}
    assert isinstance(found[0].present, bool) and found[0].asDict().keys() == {"conv_id", "turn", "role", "text", "present"}
