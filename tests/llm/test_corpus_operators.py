import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from chunkloom.llm import bpe, common, decontamination, jaccard_links, lm_scoring, simhash_dedup, toxicity


def test_simhash_components_match_all_pairs(spark, docs, none):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(300)]
    fps = set(base)
    for b in base[:60]:
        x = b
        for _ in range(rng.randrange(12)):  # chains of small steps
            x ^= sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 6)))
            fps.add(x)
    fps = sorted(fps)
    f = np.array(fps, np.uint64)
    parent = np.arange(len(f))
    for i in range(len(f)):
        n = np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4)
        parent = simhash_dedup._join(parent, np.full(len(n), i), n)
    want = {}
    for i in range(len(f)):
        want.setdefault(int(parent[i]), set()).add(int(f[i].view(np.int64)))
    want = {frozenset(x) for x in want.values() if len(x) > 1}
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in f], "fp long")
    for limit in (65_536, 4):
        by = {}
        for r in simhash_dedup.components(simhash_dedup.links(df, cell_limit=limit)).collect():
            by.setdefault(r.root, set()).add(r.node)
        assert {frozenset(x) for x in by.values()} == want
    rows = {(r.doc_id, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3)} <= rows and simhash_dedup.near_duplicates(docs).count() == docs.count()
    kept = simhash_dedup.one_per_group(docs)
    assert kept.columns == docs.columns and not {2, 4} & {r.doc_id for r in kept.collect()}
    assert simhash_dedup.near_duplicates(none).count() == 0


def test_simhash_links_broadcast_no_cells(spark, tmp_path):
    spark.range(50_000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")  # 35 rows a fingerprint are more than the estimate says
    plan = simhash_dedup.links(spark.read.parquet(str(tmp_path / "fps")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_simhash_large_cells_by_full_buckets(spark, monkeypatch):
    cells = spark.createDataFrame([(c, k) for c in range(-40, 40) for k in range(9 if c % 16 == 0 else 2)], "cell long, fp long")
    monkeypatch.setattr(simhash_dedup, "BUCKETS", 8)
    assert sorted(map(tuple, simhash_dedup.large_cells(cells, 8).collect())) == [(c, 9) for c in range(-32, 40, 16)]
    assert simhash_dedup.large_cells(cells, 9) is None


def test_components_of_more_edges_than_are_sent(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k % 10 != 9] + [(90, 70), (80, 70)], "a long, b long")
    monkeypatch.setattr(common, "SENT", 0)
    want = {k: k // 10 * 10 for k in range(40)} | {70: 70, 80: 70, 90: 70}
    assert {r.node: r.root for r in simhash_dedup.components(edges).collect()} == want
    assert simhash_dedup.components(edges.where("false")).count() == 0


def test_simhash_fingerprint_definition():
    text = "  The Quick\tbrown fox À jumps\nOver the lazy dog " + "again " * 70_000
    words = re.findall("[^\x20\x09-\x0d]+", text)
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    one = xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash_dedup.fingerprint_texts([text, None, "a  b", " "]).tolist() == [want, 0, one, 0]


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 5000), dtype=np.uint64)
    assert (simhash_dedup.manhattan(simhash_dedup.embed(a), simhash_dedup.embed(b)) <= np.bitwise_count(a ^ b)).all()


def shingles(text, n=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    n = min(n, len(w))
    return {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def test_decontamination_matches_brute_force(spark, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 5)))
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 5, 6, 20, 60])))) for i in range(80)] + [(900, None), (901, ""), (902, "!!")]
    texts = [" ".join(word() for _ in range(rng.randrange(0, 300))) for _ in range(150)]
    for k in range(0, 150, 3):
        for _ in range(rng.choice([1, 1, 30])):
            w = rng.choice(items[:80])[1].split()
            if rng.random() < 0.6 and len(w) > 10:
                w[rng.randrange(len(w))] = "zzz"
            texts[k] += "\n" + ", ".join(w).title() + " end " + word()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(500, None, 1), (501, "", 1)], "doc_id long, text string, shared int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        for item, x in items:
            n = len(re.findall(r"[^\W_]+", (x or "")))
            s = shingles(x)
            if s and len(s & shingles(t, min(5, n))) >= 0.8 * len(s):
                want.add((i, item))
    assert {(r.doc_id, r.item_id) for r in decontamination.contained(docs, bench).collect()} == want and want
    assert {(r.doc_id, r.item_id) for r in decontamination.contained(docs, bench, block=30).collect()} == want
    assert {r.doc_id for r in decontamination.without_contaminated(docs.withColumn("hits", F.lit(1)), bench, block=30).collect()} == set(range(150)) - {i for i, _ in want} | {500, 501}
    clean = decontamination.without_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(150)) - {i for i, _ in want} | {500, 501}
    assert decontamination.contained(docs, bench.where("false")).count() == 0 and decontamination.contained(none, bench).count() == 0


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    trans, sizes = rng.normal(size=(2, 2)), (11, 3, 1, 8, 0, 4, 3)
    psi = [rng.normal(size=n) for n in sizes]
    found, moved = toxicity.forward_backward(np.concatenate(psi), toxicity.Steps.of(np.r_[0, np.cumsum(sizes)]), trans, pairs=True)
    want_moved, at = np.zeros((2, 2)), 0
    for x, n in zip(psi, sizes, strict=True):
        total, on, go = 0.0, np.zeros(n), np.zeros((2, 2))
        for s in range(2**n):
            y = [s >> k & 1 for k in range(n)]
            w = np.exp(sum(x[k] * y[k] for k in range(n)) + sum(trans[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            on += w * np.array(y)
            for k in range(1, n):
                go[y[k - 1], y[k]] += w
        assert np.allclose(found[at : at + n], on / total)
        at, want_moved = at + n, want_moved + go / total
    assert np.allclose(moved, want_moved)


def test_toxicity_scores_are_brute_force(spark, docs):
    """A document's score from its own chain, token by token in plain Python."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("alpha beta gamma delta oaf dolt Epsilon".split()) for _ in range(n)) for n in (1, 63, 64, 65, 200, 700)] + ["", None, "?!"]
    m = toxicity.Model(*(np.random.default_rng(k).normal(size=toxicity.SPACE).astype(np.float32) / 2 for k in range(3)), -0.5, np.array([[0.2, -0.7], [-0.1, 0.4]]), np.array([-1.0, 0.3, 0.5, 0.2]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(d, m).collect()}
    import pyarrow as pa

    for i, text in enumerate(texts):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        f = toxicity.features(pa.array(words, pa.large_string())) if words else np.zeros((0, 7), int)
        e = [m.bias + m.own[x].sum() for x in f]
        for k in range(1, len(words)):
            e[k] += m.before[f[k - 1][[0, 2]]].sum()
            e[k - 1] += m.after[f[k][[0, 2]]].sum()
        t, ahead, back = np.exp(m.trans), [], []
        for k, x in enumerate(e):
            v = np.array([1, np.exp(x)]) * (ahead[-1] @ t if k else 1)
            ahead.append(v / v.sum())
        for k in range(len(e) - 1, -1, -1):
            v = t @ (np.array([1, np.exp(e[k + 1])]) * back[-1]) if back else np.ones(2)
            back.append(v / v.sum())
        p = np.array([(a * b)[1] / (a * b).sum() for a, b in zip(ahead, back[::-1], strict=True)])
        total, top = p[p > 0.2].sum(), min(max(p.max(initial=1e-4), 1e-4), 1 - 1e-4)
        x = np.array([1, np.log1p(total), np.log(top / (1 - top)), np.log((total + 0.1) / (len(words) + 20))])
        assert abs(got[i] - 1 / (1 + np.exp(-x @ m.doc))) < 1e-6


def test_workers_hold_little(monkeypatch):
    seen, ended = [], []
    monkeypatch.setattr(toxicity, "marginals", lambda m, words, codes, begins: seen.append(len(begins) - 1) or np.zeros(len(codes)))
    monkeypatch.setattr(common, "release", lambda: ended.append(1), raising=False)
    empty = np.zeros(toxicity.SPACE, np.float32)
    model = toxicity.Model(empty, empty, empty, -4.0, np.zeros((2, 2)), np.zeros(4))
    batch = pa.RecordBatch.from_pydict({"doc_id": range(3000), "text": ["some words"] * 3000})
    rows = list(toxicity.scoring(model, ["doc_id"], "text", "score", None)(iter([batch])))
    assert sum(r.num_rows for r in rows) == sum(seen) == 3000 and max(seen) <= 1024 and ended == [1]
    list(jaccard_links.signing([], 4)(iter([])))
    list(jaccard_links.comparing(iter([])))
    list(bpe.encoding({bytes([i]): i for i in range(256)}, r"\S+", True)(iter([])))
    assert len(ended) == 4


def test_toxicity_held_out(spark, docs, none):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    bad = ["wretch", "dolt", "oaf", "cretin"]
    rows = []
    for i in range(900):
        w = [word() for _ in range(rng.randrange(5, 120))]
        y = int(rng.random() < 0.3)
        for _ in range(rng.randrange(1, 5) * y):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), y))
    d, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5000, None), (5001, 7)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    out = toxicity.score(d, model, ["doc_id", "text"], spans="spans").withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    y = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held]
    right = sum((r.score >= 0.7) == bool(y[r.doc_id]) for r in held)
    assert len(held) > 200 and right / len(held) > 0.95
    assert {r.text[s.begin : s.end] for r in out for s in r.spans} == set(bad)
    assert toxicity.score(docs, model).count() == docs.count() and all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    more = docs.withColumn("toxic", F.lit(1)).withColumn("_score", F.lit(2)).withColumn("Spans", F.lit(3))
    clean = toxicity.without_toxic(more, labels)
    assert clean.columns == more.columns and toxicity.without_toxic(none, labels.where("false")).count() == 0


def test_lm_scoring(spark, docs, none):
    rng = random.Random(9)
    say = lambda bias: " ".join(rng.choice(["sun sea sand", "ice snow wind"][rng.random() < bias].split()) for _ in range(60))
    rows = [(i, say(0.9 if i % 2 else 0.1)) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = lm_scoring.cross_entropy_difference(d, d.where("doc_id % 2 = 1 and doc_id < 100")).collect()
    odd, even = ([r.score for r in out if r.doc_id % 2 == k and r.doc_id >= 100] for k in (1, 0))
    assert max(odd) < min(even)
    assert all(abs(r.target_loss - r.background_loss - r.score) < 1e-9 for r in out)
    all_ = lm_scoring.cross_entropy_difference(docs, docs.where("doc_id = 1"))
    assert all_.count() == docs.count() and {r.score for r in all_.where("doc_id in (3, 4)").collect()} == {0.0}
    assert lm_scoring.cross_entropy_difference(none, none).count() == 0


def test_lm_scoring_counts_every_ngram(spark):
    rng = random.Random(11)
    rows = [(i if i % 50 else None, " ".join(f"W{int(rng.paretovariate(0.4)) % 5_000}" for _ in range(rng.randrange(60)))) for i in range(400)]
    wanted = {i for i in range(1, 400, 3) if i % 50}
    words, heads, pairs = ([Counter(), Counter()] for _ in range(3))
    for i, text in rows:
        ids = text.lower().split()
        for m in (0, 1) if i in wanted else (1,):
            words[m].update(ids), heads[m].update(["", *ids][:-1] if ids else []), pairs[m].update(zip(["", *ids], ids))
    n = [sum(w.values()) for w in words]
    scale, want = (1.0, n[0] / n[1]), Counter()
    for i, text in rows:
        ids, loss = text.lower().split(), [0.0, 0.0]
        for a, b in zip(["", *ids], ids):
            for m in (0, 1):
                likely = (words[m][b] * scale[m] + 1) / (n[m] * scale[m] + len(words[1]))
                loss[m] -= np.log((pairs[m][a, b] * scale[m] + 5 * likely) / (heads[m][a] * scale[m] + 5)) / len(ids)
        want[(i, len(ids), *(round(float(x), 7) for x in loss))] += 1
    d = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in wanted] * 2 + [(None,)], "doc_id int")
    for how in ({}, {"group": 2_000, "least": 2_000}):
        got = lm_scoring.cross_entropy_difference(d, target, **how).collect()
        assert Counter((r.doc_id, r.n_tokens, round(r.target_loss, 7), round(r.background_loss, 7)) for r in got) == want


def test_near_duplicates_brute_force(spark):
    """Every row's component, with copies, steps of a few words, empty and null texts and null ids."""
    rng = random.Random(12)
    base = [" ".join(f"W{rng.randrange(60)}" for _ in range(n)) for n in (3, 5, 40, 90, 200, 400) for _ in range(5)]
    texts = [*base, None, "", " \t"]
    for t in base:
        for _ in range(rng.randrange(4)):
            w = t.split()
            w[rng.randrange(len(w))] = "x"
            texts.append(rng.choice([" ".join(w), t, t.lower(), t.replace(" ", "  ")]))
            t = texts[-1]
    rng.shuffle(texts)
    rows = [(100 - i if i % 13 else None, t) for i, t in enumerate(texts)]
    rows += rows[:3]
    fp = simhash_dedup.fingerprint_texts([t for _, t in rows])
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    parent = simhash_dedup._join(np.arange(len(rows)), a, b)
    least = {}
    for (i, _), p in zip(rows, parent.tolist(), strict=True):
        if i is not None:
            least[p] = min(i, least.get(p, i))
    want = sorted(((i, int(f.view(np.int64)), least.get(p)) for (i, _), f, p in zip(rows, fp, parent.tolist(), strict=True)), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("root", F.lit(2))
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()), key=str) == want and len(set(parent.tolist())) < len(rows) - 20
    # of two rows with one id only the copy of a smaller one goes
    two = spark.createDataFrame([(1, base[20]), (2, base[20]), (2, base[26])], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash_dedup.one_per_group(two).collect()) == sorted([(1, base[20]), (2, base[26])])


def test_pipeline_drops_jaccard_copies(spark, none, tmp_path):
    import corpus_pipeline
    from chunkloom.llm import jaccard_links

    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(999)}" for _ in range(n)) for n in (40, 60, 90, 300) for _ in range(10)]
    for i in range(0, 40, 4):  # copies of growing difference, and copies of copies
        for _ in range(6):
            w = rng.choice([texts[i], texts[-1]]).split()
            for _ in range(1 + len(w) // rng.choice((30, 45, 60))):
                w[rng.randrange(len(w))] = "x" + str(rng.randrange(999))
            texts.append(" ".join(w))
    own = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    fp, parent = simhash_dedup.fingerprint_texts(texts), np.arange(len(texts))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]) or int(fp[i] ^ fp[j]).bit_count() <= 4]
    assert any(int(fp[i] ^ fp[j]).bit_count() > 4 for i, j in near)
    parent = simhash_dedup._join(parent, *np.array(near).T)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = set(np.flatnonzero(parent == np.arange(len(texts))).tolist())
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()} == want
    kept = simhash_dedup.one_per_group(docs, more=jaccard_links.links(docs, large=2))
    assert {r.doc_id for r in kept.collect()} == want
    assert jaccard_links.links(none).count() == 0


def test_pipeline_stages_brute_force(spark, tmp_path):
    import corpus_pipeline

    words = "one two three four five six seven eight nine ten".split()
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(n))
    item, line = say(12), "a shared line of more than twenty characters"
    texts = [say(40) for _ in range(90)]
    for k in (1, 2, 3):
        texts[k] += "\n" + line
    texts[5] = texts[4]
    texts[6] += " " + item
    toxic = set(range(30, 90, 2))
    for k in toxic:
        w = texts[k].split()
        for bad in rng.sample(["wretch", "oaf", "cretin"], 2):
            w.insert(rng.randrange(len(w)), bad)
        texts[k] = " ".join(w)
    texts[40] += "\n" + line  # goes before lines are counted
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(90)) - toxic
    assert set(seen["toxicity"]) == clean == set(seen["line_dedup"])
    assert seen["line_dedup"][3].text.endswith(line) and line not in seen["line_dedup"][1].text + seen["line_dedup"][2].text
    assert set(seen["simhash_dedup"]) == clean - {5} and set(seen["decontamination"]) == clean - {5, 6} == set(seen["byte_bpe"])
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: r.ids_sha256 for i, r in seen["byte_bpe"].items()}
