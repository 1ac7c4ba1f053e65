"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessel.llm import decontaminate, licences, line_dedup, near_dedup, packing, quality, quality_rules, substring_dedup, token_files, tokens, toxicity


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_ids(text):
    t = Tokenizer.from_file(tokens.default_path())
    return t.encode(text or "", add_special_tokens=False).ids


# 1 substring dedup


def test_substring_dedup_is_exact(corpus, documents):
    first = {}
    for i, t in corpus:
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(documents).collect()}
    assert len(got) == len(corpus)
    for i, t in corpus:
        w = words(t)
        cut = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                cut[k : k + 50] = [True] * 50
        kept = " ".join(x for x, c in zip(w, cut, strict=True) if not c)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == (len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest(), kept)
    assert sum(r.n_removed for r in got.values()) > 500


def test_substring_dedup_of_odd_tables(spark, no_documents):
    assert substring_dedup.substring_dedup(no_documents).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (1, text), (1, text), (2, text), (2, "other")]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 60, 0), (1, 60, 0), (1, 60, 0), (2, 1, 0), (2, 60, 60)]


def test_recompression_borders_depend_on_their_surroundings_only():
    rng = np.random.default_rng(0)
    for alphabet in (2, 5, 1000):
        middle = rng.integers(0, alphabet, 50).astype(np.uint64)
        seen = set()
        for _ in range(20):
            left, right = rng.integers(0, alphabet, rng.integers(0, 30)).astype(np.uint64), rng.integers(0, alphabet, rng.integers(0, 30)).astype(np.uint64)
            names = substring_dedup.mix(np.concatenate((left, middle, right)))
            s = substring_dedup.Symbols(names, np.zeros(len(names), np.int64))
            r, at = substring_dedup.REACH, s.at - len(left)
            whole = (at >= r) & (at + s.size <= 50 - r)
            seen.add(tuple(zip(at[whole].tolist(), s.names[whole].tolist(), strict=True)))
        assert len(seen) == 1 and len(next(iter(seen))) >= 1


def test_symbols_spell_their_words():
    rng = np.random.default_rng(1)
    names = substring_dedup.mix(rng.integers(0, 6, 3000).astype(np.uint64))
    s = substring_dedup.Symbols(names, np.zeros(len(names), np.int64))
    rules = {}
    for k, (_, new, left, right) in enumerate(s.rules):
        run = k in (0, 3)
        for n, a, b in zip(new.tolist(), left.tolist(), right.tolist(), strict=True):
            assert rules.setdefault(n, (run, a, b)) == (run, a, b)

    def spell(n):
        if n not in rules:
            return [n]
        run, a, b = rules[n]
        return spell(a) * b if run else spell(a) + spell(b)

    assert [w for n in s.names.tolist() for w in spell(n)] == names.tolist()
    assert s.size.max() > 2 and len(s.names) < 0.6 * len(names)
    least = substring_dedup._least(names, np.arange(100), np.arange(100) + np.arange(100) % 23)
    assert least.tolist() == [names[i : i + i % 23 + 1].min() for i in range(100)]


def test_windows_of_one_name_must_agree_in_their_words(spark, monkeypatch, corpus, documents):
    want = {r.doc_id: r.kept_sha256 for r in substring_dedup.substring_dedup(documents).collect()}
    monkeypatch.setattr(substring_dedup.Windows, "names", lambda self, hit: np.zeros(len(hit), np.uint64))
    monkeypatch.setattr(substring_dedup, "CHAIN", 1)
    assert {r.doc_id: r.kept_sha256 for r in substring_dedup.substring_dedup(documents).collect()} == want


# 2 licences


def test_licences_of_templates_and_others(spark):
    rows = [(i, f"Some words here.\n{t}\nMore words.") for i, t in enumerate(x for ts in licences.TEMPLATES.values() for x in ts)]
    want = [f for f, ts in licences.TEMPLATES.items() for _ in ts]
    others = [(100 + i, t) for i, t in enumerate(licences.OTHERS)] + [(200, None), (201, "")]
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(rows + others, "doc_id long, text string")).collect()}
    assert [got[i].family for i, _ in rows] == want
    assert all(got[i].paragraph == 1 and got[i].overlap == 1.0 for i, _ in rows)
    assert all(got[i].family in (None, "unknown") for i, _ in others)
    assert got[200].family is None and got[200].n_paragraphs == 0


def test_licences_equal_a_plain_scan(spark):
    features, weights, intercepts = licences.model()
    families = [*licences.TEMPLATES, "unknown"]
    rng = random.Random(1)
    texts = [" ".join(w for w in rng.choice([t for ts in licences.TEMPLATES.values() for t in ts]).split() if rng.random() > 0.2) for _ in range(40)]
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        if not any(c in t.lower() for c in licences.CUES):
            assert got[i].family is None
            continue
        have = set(licences.pieces(t))
        z = np.array(intercepts) + sum((np.array(w) for f, w in zip(features, weights, strict=True) if f in have), np.zeros(len(families)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = families[int(p.argmax())]
        share = max((len({x for x in licences.pieces(s) if " " in x} & have) / len({x for x in licences.pieces(s) if " " in x}) for s in licences.TEMPLATES.get(best, ())), default=0.0)
        assert got[i].probability == pytest.approx(p.max()) and got[i].overlap == pytest.approx(share)
        assert got[i].family == (best if p.max() >= 0.5 and share >= 0.6 else "unknown")


def test_wrapped_and_renamed_notices(spark):
    import textwrap

    rows, want = [], []
    for f, ts in licences.TEMPLATES.items():
        for t in ts:
            for width in (24, 45, 70):
                for mark in ("", "# ", " * "):
                    block = "\n".join(mark + x for x in textwrap.wrap(t, width))
                    rows.append((len(rows), f"A title\n{mark}\n{block}\n{mark}\nimport os"))
                    want.append(f)
    short = [(1000, "Released under CC BY 4.0.", "cc-by-4.0"), (1001, "Mozilla is a browser.\nSome words.", "unknown"), (1002, "GPL-3.0", "unknown")]
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(rows + [x[:2] for x in short], "doc_id long, text string")).collect()}
    wrong = [(rows[i][1], f, got[i].family) for i, f in enumerate(want) if got[i].family != f]
    assert not wrong
    assert {i: got[i].family for i, _, _ in short} == {i: f for i, _, f in short}


def test_native_operators_run_no_python(documents):
    for df in (licences.licences(documents), quality_rules.quality_rules(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|Exchange hash|Exchange single", plan)


# 3 toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    common = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(common) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["zzidiot", "zzscum" + rng.choice("abcdef"), "zzfool"]))
        bad = i % 4 == 0
        if bad:
            w = [w[0]] * len(w) if i % 8 else [f"{x}!!###" for x in w]
            if toxic:
                w.append("zzidiot")
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(700, None), (701, ""), (None, "zzidiot")]
    labels += [(700, None, None), (None, 1, 1), (701, 1, 0), (9999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_the_held_out_fold(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[700].score == got[701].score < 0.5 and got[None].score > 0.5


def test_nearest_examples_and_votes_are_exact(labelled):
    docs, labels = labelled
    model = toxicity.build(docs, labels)
    assert len(model.vocabulary) > 250 and model.index.n > 400  # all terms of all sampled rows
    texts = pa.array([r.text for r in docs.collect()])
    vectors = toxicity.Vectors(model.vocabulary, *toxicity.term_counts(texts), len(texts))
    dense = np.zeros((vectors.n, len(model.vocabulary)))
    dense[vectors.row, vectors.term] = vectors.weights(model.index.value)
    held = np.zeros((model.index.n, len(model.vocabulary)))
    term = np.repeat(np.arange(len(model.vocabulary)), [model.index.postings[a:b].sum() for a, b in zip(model.index.first[:-1], model.index.first[1:], strict=True)])
    held[model.index.example, term] = model.index.weight
    votes, near = model.index.votes(vectors, (model.k,))
    for i in range(vectors.n):
        cosine = np.round(held @ dense[i], 10)
        order = np.lexsort((np.arange(len(cosine)), -cosine))[: model.k]
        order = order[cosine[order] > 0]
        assert near[i].tolist() == order.tolist()
        square = cosine[order] ** 2
        assert votes[i, 0] == pytest.approx((square * model.index.labels[order]).sum() / square.sum() if len(order) else -1.0)


def test_ids_have_no_part_in_toxicity(labelled):
    docs, labels = labelled
    score = lambda d, n: {r.t: r.score for r in d.join(toxicity.toxicity(d, n), "doc_id").select(F.col("text").alias("t"), "score").collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    moved = {i: next(k for k in range(10**6 - 1000 * i, 10**6 - 1000 * i + 1000) if fold(k) == fold(i)) for i in range(600)}
    spark = docs.sparkSession
    d2 = spark.createDataFrame([(moved.get(r.doc_id), r.text) for r in docs.collect() if r.doc_id in moved], docs.schema)
    n2 = spark.createDataFrame([(moved[r.doc_id], r.quality, r.toxic) for r in labels.collect() if r.doc_id in moved], labels.schema)
    assert score(d2, n2) == score(docs.where("doc_id < 600"), labels.where("doc_id < 600"))


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    got = toxicity.toxicity(docs, labels.where("false")).collect()
    assert {r.score for r in got} == {0.5}


# 4 near dedup


def test_shared_differences_are_enough():
    rng = np.random.default_rng(7)
    for t in (0.8, 0.5):
        for _ in range(4000):
            c, x, y = (frozenset(rng.choice(60, rng.integers(1, 40), replace=False).tolist()) for _ in range(3))
            x, y = (frozenset(c ^ frozenset(rng.choice(60, rng.integers(0, 14), replace=False).tolist())) for _ in range(2))
            if not x or not y:
                continue
            sim = lambda a, b: len(a & b) / len(a | b)
            if sim(x, y) < t or sim(y, c) >= t:
                continue
            common = len((x ^ c) & (y ^ c))
            any_x, _ = near_dedup.reach(*(np.array([v]) for v in (len(c), len(x), len(x ^ c))), t)
            _, far = near_dedup.reach(*(np.array([v]) for v in (len(c), len(y), len(y ^ c))), t)
            assert any_x[0] >= len(x ^ c) - common + 1 or any_x[0] == len(x ^ c)
            assert far[0] >= len(y ^ c) - common + 1 or far[0] == len(y ^ c)


def test_all_texts_of_an_id_are_in_one_class(spark):
    words_of = lambda s, n=40: [f"{s}{i}" for i in range(n)]
    x, y = " ".join(words_of("x")), " ".join(words_of("y"))
    near_y = " ".join([*words_of("y"), "more"])
    rows = [(1, x), (2, x), (2, y), (3, near_y), (4, "other words of a text"), (None, x)]
    got = sorted((r.doc_id or -1, r.class_id or -1, r.is_first) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, -1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_large_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "SALTED", 10)
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)]
    group = [[f"b{i}" for i in range(100)]]
    for _ in range(160):
        w = list(rng.choice(group) if rng.random() < 0.3 else group[0])
        for _ in range(rng.randint(1, 7)):
            k = rng.randrange(len(w))
            if rng.random() < 0.8:
                w[k] = rng.choice(vocabulary)
            else:
                w[k : k + rng.randint(0, 3)] = []
        group.append(w)
    group += [w[: rng.randint(70, 100)] for w in group[:40]]
    rng.shuffle(group)
    rows = [(i, " ".join(w)) for i, w in enumerate(group)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows) and 2 < len(set(got.values())) < 190


def jaccard(a, b):
    common = sum((a & b).values())
    return common / max(1, sum(a.values()) + sum(b.values()) - common)


def classes(rows):
    runs = {}
    for i, t in rows:
        w = words(t)
        runs[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    parent = {i: i for i in runs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    texts = dict(rows)
    for a in runs:
        for b in runs:
            if a < b and ((texts[a] or "") == (texts[b] or "") or (runs[a] and runs[b] and jaccard(runs[a], runs[b]) >= 0.8)):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in runs}


def test_near_duplicates_equal_brute_force(corpus, documents):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(documents).collect()}
    want = classes(corpus)
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.is_first == (r.class_id == i) for i, r in got.items())


def test_links_past_the_centre_are_found(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    group = [base]
    for _ in range(70):
        w = list(rng.choice(group) if rng.random() < 0.6 else base)
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(w))
            if rng.random() < 0.7:
                w[k] = rng.choice(vocabulary)
            else:
                del w[k : k + rng.randint(1, 5)]
        group.append(w)
    rng.shuffle(group)
    rows = [(i, " ".join(w)) for i, w in enumerate(group)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    a = {k: int(rng.integers(1, 9)) for k in range(300)}
    b = {k: max(1, v - int(rng.integers(0, 4))) for k, v in a.items() if rng.random() < 0.9}
    rows = [(d, k, v) for d, m in enumerate((a, b)) for k, v in m.items()]
    docs, keys, counts = (np.array(x) for x in zip(*rows, strict=True))
    s = near_dedup.signatures(docs, near_dedup.mix(keys.astype(np.uint64)), counts, 2, 4096)
    true = sum(min(a[k], b.get(k, 0)) for k in a) / sum(max(a[k], b.get(k, 0)) for k in a)
    assert abs((s[0] == s[1]).mean() - true) < 5 * np.sqrt(true * (1 - true) / 4096)


def test_near_duplicates_of_odd_tables(spark, no_documents):
    assert near_dedup.near_duplicates(no_documents).count() == 0
    rows = [(None, "a b"), (3, "a b"), (1, "a b"), (1, "c d e"), (7, None), (5, "")]
    got = sorted((r.doc_id or -1, r.class_id or -1) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (3, 1), (5, 5), (7, 5)]


# 5 quality


def test_quality_on_the_held_out_fold(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(600))
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())


def test_flat_trees_equal_walking_them():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit(x, y, trees=20, depth=3)
    for row, got in zip(x[:50], forest.score(x[:50]), strict=True):
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((forest.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_quality_without_labels(labelled):
    docs, labels = labelled
    assert {r.score for r in quality.quality(docs, labels.where("false")).collect()} == {0.5}


# 6 decontamination


def test_contamination_finds_reordered_passages(spark, documents, corpus):
    rng = random.Random(3)
    w = [f"t{i}" for i in range(60)]
    items = [(1, " ".join(w[:30])), (2, " ".join(w[30:])), (2, " ".join(w[30:])), (3, "too short"), (4, None), (None, " ".join(w))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    parts = [w[20:30], w[10:20], w[0:10]]
    texts = ["before " + " ".join(w[:30]) + " after", " x y z ".join(" ".join(p) for p in parts), " ".join(rng.sample(w, 60)), " ".join(w[3:12]), None, "", " ".join(w[30:]).upper() + "!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chars in (16_000_000, 100):  # one block and many
        got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, block_chars=chars).collect()}
        assert [got[i].contaminated for i in range(7)] == [True, True, False, False, False, False, True]
        assert (got[0].item_id, got[0].coverage, got[1].coverage, got[1].n_tiles, got[6].item_id) == (1, 1.0, 1.0, 3, 2)
        assert got[3].coverage == pytest.approx(0.3)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert decontaminate.contamination(documents, bench.where("false")).where("contaminated").count() == 0


def test_items_of_unspaced_scripts_and_short_items_are_found(spark):
    texts = {1: "東京は日本の首都であり世界最大の都市です", 2: "ภาษาไทยไม่มีช่องว่าง", 3: "Paris, France", 4: "she said it's a well known fact of life here", 5: "答案", 6: "?!"}
    bench = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    said = "“She said—it’s a ‘well‑known’ fact of life here…”"
    docs = ["前文。" + texts[1] + "。後文", "xx" + texts[2] + "yy", "in paris (France) again", said, "他的答案是", "?!", "paris", "france paris", "日本の東京", "", None]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for chars in (16_000_000, 20):  # one block and many
        got = {r.doc_id: (r.item_id, r.contaminated) for r in decontaminate.contamination(df, bench, block_chars=chars).collect()}
        assert got == {0: (1, True), 1: (2, True), 2: (3, True), 3: (4, True), 4: (5, True)} | {i: (None, False) for i in range(5, 11)}


def test_pairs_in_steps_are_as_all_at_once(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "a " * 60 + "b c d e f g"), (2, "c d e f g h i j k l " * 3)], "item_id long, text string").collect()
    texts = pa.array(["a " * 300, "x " + "c d e f g h i j k l " * 9, "a " * 70 + "b c d e f g a a a a a a", None, ""])
    items = decontaminate.Items([r.item_id for r in bench], [r.text for r in bench], 5)
    want = items.check(texts)
    for most in (1, 50, 1000):
        monkeypatch.setattr(decontaminate, "PAIRS", most)
        assert items.check(texts) == want
    assert want[0][1] == 60 / 66 and want[2][1] == 1.0


def test_tiles_are_greedy():
    rng = random.Random(6)
    for _ in range(60):
        item, text = ([rng.randrange(4) for _ in range(n)] for n in (18, 40))
        places = [(i, j) for i in range(len(item) - 2) for j in range(len(text) - 2) if item[i : i + 3] == text[j : j + 3]]
        if not places:
            continue
        i, j = (np.array(x) for x in zip(*places, strict=True))
        got = sorted(decontaminate.tile(decontaminate.stretches(i, j, 3), len(item), 3))
        used_i, used_j, want = set(), set(), []
        while True:
            best = None
            for a in range(len(item)):
                for b in range(len(text)):
                    n = 0
                    while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and a + n not in used_i and b + n not in used_j:
                        n += 1
                    if n >= 3 and (best is None or n > best[2]):
                        best = (a, b, n)
            if best is None:
                break
            want.append(best)
            used_i |= set(range(best[0], best[0] + best[2]))
            used_j |= set(range(best[1], best[1] + best[2]))
        assert got == sorted(want)


# 7 line dedup


def test_line_dedup_equals_brute_force(corpus, documents):
    texts = {i: [ln for ln in t.split("\n")] for i, t in corpus if t is not None}
    lines = {i: [(k, tuple(words(ln))) for k, ln in enumerate(ls) if words(ln)] for i, ls in texts.items()}
    first = {}
    for i in sorted(lines):
        for k in range(len(lines[i]) - 1):
            first.setdefault((lines[i][k][1], lines[i][k + 1][1]), (i, k))
    got = {r.doc_id: r for r in line_dedup.line_dedup(documents).collect()}
    assert len(got) == len(corpus)
    total = 0
    for i, t in corpus:
        if t is None:
            assert got[i].kept_text is None
            continue
        gone = set()
        for k in range(len(lines[i]) - 1):
            d, a = first[(lines[i][k][1], lines[i][k + 1][1])]
            if (d, a) < (i, k) and not (d == i and k < a + 2):
                gone |= {lines[i][k][0], lines[i][k + 1][0]}
        total += len(gone)
        assert (got[i].n_lines, got[i].n_removed, got[i].kept_text) == (len(lines[i]), len(gone), "\n".join(ln for k, ln in enumerate(texts[i]) if k not in gone))
    assert total > 20


def test_line_dedup_of_odd_tables(spark, no_documents):
    assert line_dedup.line_dedup(no_documents).count() == 0
    rows = [(None, "a\nb\nc"), (2, "a\nb\nc"), (1, "x\na\nb"), (1, "x\na\nb")]
    got = sorted(((r.doc_id or -1), r.n_removed, r.kept_text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 0, "a\nb\nc"), (1, 0, "x\na\nb"), (1, 0, "x\na\nb"), (2, 2, "c")]


def test_long_single_lines_go_whatever_stands_around_them(spark):
    import corpus_pipeline

    long, short = " ".join(f"w{i}" for i in range(60)), "only a few words here"
    rows = [(i, f"before {i}\n{long}\nbetween {i}\n{short}\nafter {i}") for i in range(3)] + [(3, f"x y\n{long}\n{long}"), (4, "\n".join(["same line of more words than seven are"] * 3))]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(docs, min_words=8).collect()}
    assert got[0] == (5, 0, rows[0][1])
    assert [got[i] for i in (1, 2)] == [(5, 1, f"before {i}\nbetween {i}\n{short}\nafter {i}") for i in (1, 2)]
    assert got[3] == (3, 2, "x y") and got[4] == (3, 2, "same line of more words than seven are")
    staged = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert staged == {i: t for i, (_, _, t) in got.items()}


def test_windows_select_their_least_lines():
    rng = random.Random(4)
    texts = pa.array(["\n".join(f"line {rng.randrange(50)}" for _ in range(rng.randint(0, 60))) for _ in range(20)])
    lines = line_dedup.Lines(texts)
    order = line_dedup.mix(lines.names, 3)
    for size in (2, 4):
        starts, sizes, docs, names, best = lines.windows(size)
        for s, d, b in zip(starts.tolist(), docs.tolist(), best.tolist(), strict=True):
            assert lines.doc_at[d] <= s and s + size <= lines.doc_at[d + 1]
            low = min(order[s : s + size])
            assert b == max(k for k in range(s, s + size) if order[k] == low)
        assert len(set(best.tolist())) < (0.8 if size == 2 else 0.55) * len(lines.names)


# 8 quality rules


def test_rules_equal_brute_force(corpus, documents):
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents).collect()}
    for i, t in corpus:
        t, w = t or "", words(t)
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [ln for ln in t.split("\n") if words(ln)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and (not r.base_failed or not r.kept)


def test_policies_and_ablations(documents):
    rows = quality_rules.ledger(documents)
    bits = [r.fail_bits for r in rows.select("fail_bits").collect()]
    for policy in quality_rules.POLICIES:
        mask = quality_rules.mask(policy)
        assert quality_rules.apply_policy(rows, policy).where("kept").count() == sum(not b & mask for b in bits)
        for r in quality_rules.ablations(rows, policy).collect():
            one = quality_rules.BITS[r.rule]
            assert (r.failed, r.failed_alone, r.kept_without, r.kept) == (sum(bool(b & one) for b in bits), sum(b & mask == one for b in bits), sum(not b & mask & ~one for b in bits), sum(not b & mask for b in bits))


# 9 token files


def test_ids_equal_the_library(corpus):
    odd = ["a  b", " x", "x ", "a  b", "a　 b c", "a \n b\n\nc  \n d", "don't we'll 12 3!! <|endoftext|> x", "日本 語 テ スト", "a\x1c b \x1fc", "a \x85 b", "𝒳 𝒴 😀 😀a", "½ x² y", "it's 's 'S o'clock", "é è  à", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "A.B.C, $x_y", "a'b c'.d", "e.\u00e9.f", "x-1.y"]
    texts = [t for _, t in corpus] + odd
    ids, offsets = tokens.Encoder(tokens.default_path(), cache=500).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == plain_ids(t)


def test_token_table_round_trip(spark, tmp_path, corpus, documents, no_documents):
    at = f"file://{tmp_path}/t"
    token_files.write_token_table(documents, at)
    got = {r.doc_id: r for r in token_files.read_token_table(spark, at, with_ids=True).collect()}
    start = 0
    for i, t in sorted(corpus):
        want = [*plain_ids(t), 2]
        r = got[i]
        assert (r.start, r.n_tokens, list(r.ids), r.ids_crc32) == (start, len(want), want, zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    raw = token_files.read_dictionary(spark, at)
    tool = token_files.zstandard.ZstdCompressionDict(raw)
    block = token_files.Block(bytes(spark.read.parquet(f"{at}/blocks").head().block), tool)
    d = int(block.index[0, 0])
    assert block.ids(block.find(d)).tolist() == list(got[d].ids) and block.find(10**9) == -1
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Block(bytes(spark.read.parquet(f"{at}/blocks").head().block), token_files.zstandard.ZstdCompressionDict(raw[:-9]))
    assert token_files.token_digest(no_documents).count() == 0


# 10 packing


def test_packing_uses_every_id_once(spark, corpus, documents, no_documents):
    got = packing.pack(documents, with_ids=True).cache()
    rows = got.collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in corpus:
        want, at = [*plain_ids(t), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) and list(r.ids) == want[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(list(r.ids), "<u4").tobytes())
            at += r.length
        assert at == len(want)
    padding = used = 0
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048
        used += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= max(0.03 * used, 4096)
    for s in packing.sequences(got).collect():
        assert len(s.ids) == (s.n_used if s.n_used & (s.n_used - 1) == 0 else 2048)
    assert packing.pack(no_documents).count() == 0


def test_plans_use_each_piece_once_and_little_more_than_the_volume():
    rng = np.random.default_rng(2)
    for n, spread in ((500, 0.5), (5000, 0.9), (3, 0.5)):
        lengths = np.minimum(512, 1 + (rng.lognormal(4.6, spread, n)).astype(int))
        size, demand = np.unique(lengths, return_counts=True)
        found = packing.plan(size, demand, 512)
        got = collections.Counter()
        for pattern, copies in found:
            assert sum(s * c for s, c in pattern.items()) <= 512 and copies > 0
            for s, c in pattern.items():
                got[s] += c * copies
        assert got == dict(zip(size.tolist(), demand.tolist(), strict=True))
        assert sum(c for _, c in found) <= 1.02 * lengths.sum() / 512 + 2


def test_knapsack_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(20):
        size, value, best = rng.integers(2, 9, 4), rng.random(4), 0.0
        for counts in np.ndindex(13, 13, 13, 13):
            if np.dot(counts, size) <= 24:
                best = max(best, float(np.dot(counts, value)))
        got, counts = packing.price(value, size, 24)
        assert got == pytest.approx(best) and np.dot(counts, value) == pytest.approx(best) and np.dot(counts, size) <= 24


# all


OPERATORS = {
    "op1": lambda d, t: substring_dedup.substring_dedup(d), "op2": lambda d, t: licences.licences(d), "op3": lambda d, t: toxicity.toxicity(d, t),
    "op4": lambda d, t: near_dedup.near_duplicates(d), "op5": lambda d, t: quality.quality(d, t), "op6": lambda d, t: decontaminate.contamination(d, t.select(F.col("doc_id").alias("item_id"), "text")),
    "op7": lambda d, t: line_dedup.line_dedup(d), "op8": lambda d, t: quality_rules.quality_rules(d), "op9": lambda d, t: token_files.token_digest(d), "op10": lambda d, t: packing.pack(d),
}
ODD = "doc_id long, text string, __row string, keys string, __id int, node string, __gone int, __cued int, __quality double, __coverage double, doc string, score double, h int, kept string, lines int, gone int, `a.b` int"


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_repeated_rows_null_ids_and_clashing_columns(spark, name):
    long = " ".join(f"word{i % 700}" for i in range(9000))
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "one two three"), (3, "one two three"), (3, "another text"), (4, long), (5, "one two three"), (None, None)]
    wide = spark.createDataFrame([(i, t, "r", "k", 1, "n", 2, 3, 0.1, 0.2, "d", 0.3, 4, "x", 5, 6, 7) for i, t in rows], ODD)
    table = spark.createDataFrame([(3, 1, 0, "one two three"), (4, 1, 1, "x"), (5, 0, 0, "y"), (2, 0, 1, "z"), (1, 0, 0, None)], "doc_id long, quality int, toxic int, text string")
    got = OPERATORS[name](wide, table).collect()
    plain = OPERATORS[name](wide.select("doc_id", "text"), table).collect()
    key = lambda r: repr([r[c] for c in r.__fields__ if c not in ("sequence_id", "offset")])
    assert sorted(map(key, got)) == sorted(map(key, plain))
    assert collections.Counter(r.doc_id for r in got)[3] == 3 and len({r.doc_id for r in got}) == 6
    if name != "op10":
        assert len(got) == len(rows)
    assert OPERATORS[name](wide.where("false"), table).count() == 0


def test_stages_on_clashing_columns_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    base = f"file://{tmp_path}"
    spark.createDataFrame([(0, "t1 t2 t3 t4 t5 t6")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, "z t1 t2 t3 t4 t5 t6"), (5, "one two three")]
    wide = spark.createDataFrame([(i, t, "r", "k", 1, "n", 2, 3, 0.1, 0.2, "d", 0.3, 4, "x", 5, 6, 7) for i, t in rows], ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, base).columns == wide.columns
        assert stage(spark, wide.where("false"), base).count() == 0
    ids = lambda name: collections.Counter(r.doc_id for r in dict(corpus_pipeline.STAGES)[name](spark, wide, base).collect())
    assert ids("lines") == {None: 1, 1: 1, 2: 1, 3: 2, 4: 1, 5: 1}
    assert ids("near") == {None: 1, 1: 1, 3: 2, 4: 1}
    assert ids("benchmark") == {None: 1, 1: 1, 2: 1, 3: 2, 5: 1}


# pipeline


def test_pipeline_stages(spark, tmp_path, documents, corpus):
    import corpus_pipeline

    bench = next(t for _, t in corpus if t and len(words(t)) > 100)
    base = f"file://{tmp_path}"
    documents.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(0, " ".join(words(bench)[:40]))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in corpus], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "benchmark", "packing"]
    columns = docs.columns
    scores = {r.doc_id: r.predicted for r in quality.quality(docs, spark.read.parquet(f"{base}/labels.parquet")).collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, base)
        assert out.columns == columns
        out.write.parquet(f"{base}/{k}")
        before, docs = docs, spark.read.parquet(f"{base}/{k}")
        ids = {r.doc_id for r in docs.collect()}
        if name == "quality":
            assert ids == {i for i, p in scores.items() if p == 1}
        if name == "near":
            want = classes([(r.doc_id, r.text) for r in before.collect()])
            assert ids == {i for i, c in want.items() if i == c}
    pieces = corpus_pipeline.run(spark, base).collect()
    assert {r.doc_id for r in pieces} == ids
    assert json.dumps([r.length for r in pieces])
    assert docs.where(F.col("text").isNull()).count() <= 1


def test_texts_are_worked_on_in_small_slices():
    from tessel.llm import textscan

    texts = ["word " * 20_000] * 30 + ["long " * 500_000, None, ""]
    parts = list(textscan.text_slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(sum(len(t or "") for t in p.column("text").to_pylist()) <= 1 << 20 or len(p) == 1 for p in parts)


def test_notices_without_a_cue(spark):
    bare = [
        ("is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.", "mit"),
        ("and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met:", "bsd"),
    ]
    names = ("licen", "copyright", "permission", "redistribut", "reserved", "apache", "gpl", "gnu", "mozilla", "commons", "bsd")
    assert not any(c in t.lower() for t, _ in bare for c in names)
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame([(i, f"A title\n\n{t}\n\nimport software") for i, (t, _) in enumerate(bare)], "doc_id long, text string")).collect()}
    assert [got[i].families for i in (0, 1)] == [["mit"], ["bsd"]]
    for ts in licences.TEMPLATES.values():  # what has none of the words that are looked for cannot be confirmed
        for t in ts:
            pairs = {p for p in licences.pieces(t) if " " in p}
            left = [p for p in pairs if not any(c in w for w in p.split() for c in licences.CUES)]
            assert len(left) < 0.6 * len(pairs)
