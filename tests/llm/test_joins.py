"""Links and matches against brute force, and the odd inputs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tessera.llm import components, decontaminate, ngram_join, vector_dedup
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def classes(ids, linked):
    """(links, smallest reachable id) of every id, from the linked pairs."""
    near = {i: set() for i in ids}
    for a, b in linked:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(near[i]), min(seen))
    return out


def brute_texts(docs, threshold=0.8, n=5):
    grams = {}
    for i, t in docs.items():
        w = ngram_join.words_of(t)
        grams[i] = {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    ids = sorted(grams)
    return classes(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if grams[a] and len(
        grams[a] & grams[b]) >= threshold * len(grams[a] | grams[b]) - 1e-9])


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (200, 201), (None, 5)]
    got = {r.id: r.component for r in components.connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 130)}, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_edges_of_hubs_stay_in_place(spark, monkeypatch):
    """Many stars and a chain through their centres, with every centre a hub."""
    monkeypatch.setattr(components, "LEAST_HUB", 8)
    edges = [(1000 * k, 1000 * k + x) for k in range(1, 7) for x in range(1, 60)] + [(1000 * k + 5, 1000 * k + 1007) for k in range(1, 6)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {1000} and len(got) == 6 * 60 - 1


def test_trie_edges_connect_all_candidates():
    """One node of the forest: the parts of the edges are those of all near pairs."""
    rng = np.random.default_rng(8)
    for trial in range(30):
        groups = rng.integers(0, 256, (4, 96))
        m = rng.integers(9, 70)
        sig = groups[rng.integers(0, 4, m)]
        noise = rng.random((m, 96)) < rng.choice([0.05, 0.15, 0.3])
        sig = np.where(noise, rng.integers(0, 256, (m, 96)), sig).astype(np.uint8)
        size = rng.integers(90, 110, m)
        side = rng.integers(0, 2, m) if trial % 2 else np.zeros(m, dtype=int)
        label = sig[:, :6].copy()
        label[:, :4] = 7                                        # all share the shortest prefix
        equal = (sig[:, None] == sig[None]).sum(axis=2)
        ok = (equal >= 70) & (np.minimum.outer(size, size) >= 0.8 * np.maximum.outer(size, size))
        cross = ok & (side[:, None] != side[None]) if side.any() else ok
        edges = [(int(a), int(b)) for p, q in ngram_join._trie_edges(sig, size, label, side, 4, 0.8, 70) for a, b in zip(p, q)]
        found = classes(range(m), edges)
        for a, b in zip(*np.nonzero(np.triu(cross, 1))):
            assert found[a][1] == found[b][1]
        allowed = classes(range(m), [(a, b) for a, b in zip(*np.nonzero(np.triu(ok, 1)))])
        assert all(allowed[a][1] == allowed[b][1] for a, b in edges)


def test_recall_of_planted_pairs_at_the_threshold(spark):
    """Pairs of different texts with a similarity of 0.80 to 0.85."""
    rng = random.Random(11)
    rows, planted = [], 0
    for k in range(1500):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(60, 160))]
        other = list(words)
        total = len(words) - 4
        cut = int(total * rng.uniform(0.0811, 0.11))             # n-grams lost at each end: (t - c) / (t + c) >= 0.8
        other = [f"x{i}" for i in range(cut)] + other[cut:]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        planted += len(a & b) >= 0.8 * len(a | b)
    got = ngram_join.link_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = sum(r.n_links for r in got) / 2
    assert planted > 1000 and planted * 0.998 <= linked <= planted
    assert all(r.class_id in (r.doc_id, r.doc_id - r.doc_id % 2) for r in got)


def test_spanning_links_connect_what_the_matrix_connects():
    rng = np.random.default_rng(3)
    for _ in range(50):
        m = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.2
        full = classes(range(sum(m.shape)), [(i, j + m.shape[0]) for i, j in zip(*np.nonzero(m))])
        p, q = components.spanning_links(m)
        span = classes(range(sum(m.shape)), list(zip(p.tolist(), q.tolist())))
        assert {i: c for i, (_, c) in full.items()} == {i: c for i, (_, c) in span.items()}
        assert len(p) < sum(m.shape) + 1


def test_text_links_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    docs, base = {}, [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(30)]
    for i in range(260):
        words = base[i % 30].split()
        for _ in range(rng.choice([0, 0, 1, 2, 4, 6, 12])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs[i] = " ".join(words) + (" " + passage if i % 3 else "")
    docs |= {300: "two words", 301: "Two, words!", 302: "", 303: None, 304: "...", 305: "one two three four five"}
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, key string")
    df = df.unionByName(df.limit(3)).unionByName(spark.createDataFrame([(None, "two words", "x")], df.schema))
    got = ngram_join.link_texts(df).collect()
    assert {r.doc_id: (r.n_links, r.class_id) for r in got if r.doc_id is not None} == brute_texts(docs)
    assert [(r.n_links, r.class_id) for r in got if r.doc_id is None] == [(0, None)] and len(got) == len(docs) + 1


def test_text_links_of_hot_blocks(spark, monkeypatch):
    """Groups beyond a block are compared block against block."""
    monkeypatch.setattr(ngram_join, "NODE_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SET_BLOCK", 8)
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    docs = {}
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(150)] = f"v{rng.randrange(500)}"
        docs[i] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.link_texts(df).collect()}
    assert got == brute_texts(docs)


def test_one_id_with_two_texts_next_to_repeated_rows(spark):
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words), " ".join(f"x{i}" for i in range(60))
    rows = [(1, near), (1, near), (1, other), (2, near + " end"), (3, other + " end")]
    got = ngram_join.link_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(1, 1), (2, 1), (3, 1)} and len(got) == 4


def test_text_links_of_an_empty_table(spark):
    assert ngram_join.link_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_depth_meets_the_recall():
    d = ngram_join.shortest_prefix(0.8, 0.9995)
    assert 1 - (1 - 0.8 ** d) ** ngram_join.TREES >= 0.9995 > 1 - (1 - 0.8 ** (d + 1)) ** ngram_join.TREES


def brute_vectors(rows, threshold=0.93):
    usable = {}
    for i, v, g in rows:
        if i is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.asarray(v, dtype=np.float64)
            usable[i] = (g, x / np.sqrt((x * x).sum()))
    ids = sorted(usable)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if usable[a][0] == usable[b][0] and len(usable[a][1]) == len(usable[b][1])
             and float(usable[a][1] @ usable[b][1]) >= threshold]
    out = classes(ids, pairs)
    return {i: out.get(i, (0, i)) for i, _, _ in rows}


def test_vector_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    rows = []
    for i in range(400):
        v = centres[i % 12] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.35])
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 3))
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, rows[0][1], 1), (403, None, 0), (404, [0.0] * 24, 0),
             (405, [None] * 24, 0), (406, [float("nan")] * 24, 0), (407, rows[0][1], None), (408, [1.0, 2.0], 0),
             (409, [2.0, 4.0], 0), (410, [], 0), (411, [float("inf")] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as n_links")
    got = vector_dedup.link_vectors(df.unionByName(df.limit(2))).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_vectors(rows) and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    # the index alone: with several cells nothing is lost either
    again = vector_dedup.link_vectors(df, cells=9).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in again} == brute_vectors(rows)


def test_vectors_of_every_length_are_searched(spark, monkeypatch):
    seen, empty = [], spark.createDataFrame([], "id long, n long, other long")
    monkeypatch.setattr(vector_dedup, "_link_dim", lambda reps, *_: seen.append(reps) or empty)
    rows = [(n, [1.0] * n, 0) for n in range(1, 103)]
    vector_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert len(seen) == 102


def test_vector_links_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_dedup.link_vectors(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in vector_dedup.link_vectors(spark.createDataFrame([(1, None, 1)], schema)).collect()] == [
        (1, 0, 1, True)]


@pytest.mark.parametrize("name", ["op7_ngram_join", "op10_vector_dedup"])
def test_queries_equal_brute_force(spark, name):
    got = QUERIES[name](spark, SF).collect()
    if name.startswith("op7"):
        docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        assert {r.doc_id: (r.n_links, r.class_id) for r in got} == brute_texts(docs)
    else:
        rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_vectors(rows)


ITEM = ("A train leaves the old station in Paris at 12.30 and travels 150 km to Lyon with 80 passengers on board. "
        "How long does Marie wait for 2 hours?")


def test_template_matches(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "what is it"), (3, None), (4, "five little words are here"), (1, ITEM)],
                                  "item_id long, text string")
    changed = ITEM.replace("Paris", "Berlin").replace("150 km", "600 miles").replace("Marie", "Anna").replace("80", "75")
    twisted = ITEM.replace("12.30", "9.15").replace("2 hours", "3 hours")
    docs = [(1, f"Intro. {changed} The end."), (2, ITEM), (3, "A train leaves the old building and nothing else is the same."),
            (4, None), (5, ""), (None, ITEM), (6, "Well, five little words are here today"), (7, "1 2 3 4 5 6 7 8 9 10 11 12"),
            (8, ITEM.lower()), (9, twisted), (2, ITEM)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.match(df, items).collect()}
    assert got == {(1, 1): "reparameterised", (2, 1): "verbatim", (6, 4): "verbatim", (9, 1): "reparameterised"} | (
        {(8, 1): got[(8, 1)]} if (8, 1) in got else {})


def test_template_matches_in_any_case_and_after_any_word(spark):
    short, german = "How many legs does a spider have?", "Wie heißt der größte Fluss im Süden der alten Stadt Wien und wie lang ist er?"
    items = spark.createDataFrame([(1, ITEM), (2, short), (3, german), (5, "Anna buys 3 apples from Paul")], "item_id long, text string")
    docs = [(8, ITEM.lower(), 1), (9, ITEM.upper(), 1), (10, ITEM.title(), 1), (11, f"Question: {ITEM}", 1),
            (12, f"and then {ITEM}", 1), (13, ITEM.lower().replace("150", "600").replace("80", "75"), 1),
            (20, f"Question: {short}", 2), (21, f"and then {short} eight", 2), (22, short.upper(), 2), (23, short, 2),
            (30, german.lower(), 3), (31, german.upper(), 3), (32, f"Frage: {german}", 3),
            (24, "Question: How many legs does a spider have?", 2), (50, "Question: Marie buys 7 apples from Otto", 5),
            (40, "How many legs does the spider have?", None)]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.match(df, items).collect()}
    assert got == {(i, k): "reparameterised" if i in (13, 50) else "verbatim" for i, _, k in docs if k}


def test_inconsistent_slots_are_no_match(spark):
    item = "take 5 red apples then add 5 more red apples and give 5 of the red apples away now"
    bad = item.replace("take 5", "take 6").replace("give 5", "give 9")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, bad), (2, item.replace("5", "7"))], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.match(docs, items).collect()} == {2}


def test_one_changed_slot_leaves_the_rest_of_a_copy(spark):
    item = ("take 5 red apples from the basket near the door and carry them over to the long table in the hall where the "
            "other children wait for their lunch and then give 5 of them to the cook who makes a cake for the feast today")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, item.replace("give 5", "give 6")), (2, item.replace("take 5", "take 6")),
            (3, item.replace("5", "7").replace("give 7", "give 8")), (4, item.replace("5", "7"))]
    got = {r.doc_id: r for r in decontaminate.match(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert {i: r.kind for i, r in got.items()} == {1: "verbatim", 2: "verbatim", 3: "verbatim", 4: "reparameterised"}
    n = len(item.split()) - 7
    assert got[4].n_windows == n and all(n - 10 <= got[i].n_windows < n for i in (1, 2, 3))


def test_slot_heavy_and_short_items_match_by_equal_values(spark):
    sums = "12 + 30 = 42, 7 + 8 = 15, 9 + 4 = 13, 20 + 6 = 26, 31 + 5 = 36, 2 + 2 = 4"
    titled, mixed = "A Walk In The Park By The River With Anna And Paul In Old Vienna", f"Add the numbers that are given here in every line: {sums}"
    items = [(1, sums), (2, titled), (3, "Capital of France?"), (4, "7 + 8"), (5, mixed), (6, "")]
    docs = [(1, f"Solve {sums} now", {1, 4, 5}), (2, sums.replace("7 + 8", "7 + 9").replace("31", "32").replace("20", "21"), set()),
            (3, f"read {titled.upper()} today", {2}), (4, "Question: capital of France? Paris", {3}),
            (5, "Capital of Spain?", set()), (6, "so 7 + 8 is more than 7", {4}), (7, "so 17 + 8, 7 + 18", set()),
            (8, mixed, {1, 4, 5}), (9, None, set())]
    got = decontaminate.match(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, k) for i, _, ks in docs for k in ks}
    assert {r.kind for r in got} == {"verbatim"}


def test_names_at_sentence_starts_and_of_several_words(spark):
    tom = "Tom has 5 apples. Tom eats 2 apples. Tom buys 7 plums. Tom sells 3 plums. How many does Tom have?"
    sent = "The farmer sold 12 eggs to Anna on the first day. Then he walked home and gave 9 of them to his wife at the door."
    items = spark.createDataFrame([(1, tom), (2, sent)], "item_id long, text string")
    mary = tom.replace("Tom", "Mary")
    other = tom.translate(str.maketrans("5273", "8946"))
    docs = [(1, mary, {1: "reparameterised"}), (2, other.replace("Tom", "Mary"), {1: "reparameterised"}),
            (3, f"Intro words here. {other.replace('Tom', 'Mary Ann')} And so on.", {1: "reparameterised"}),
            (4, f"see {tom}", {1: "verbatim"}), (5, tom.upper(), {1: "verbatim"}),
            (6, sent.replace("Anna", "Mary Ann").replace("12", "30").replace("9", "8"), {2: "reparameterised"}),
            (7, sent, {2: "verbatim"}), (8, mary.replace("Mary eats", "John eats").replace("Mary sells", "Paul sells"), {}),
            (9, "The farmer sold 12 eggs to Anna on. Later they walked home", {})]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    got = {}
    for r in decontaminate.match(df, items).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = r.kind
    assert got == {i: k for i, _, k in docs if k}


def test_scripts_without_blanks(spark):
    chinese = "小明有五个苹果他把其中两个送给了住在河边的老师然后又买了三个"
    thai = "แม่น้ำที่ยาวที่สุดในประเทศไทยคือแม่น้ำอะไร"
    items = spark.createDataFrame([(1, chinese), (2, thai)], "item_id long, text string")
    docs = [(1, f"这里是前面的句子{chinese}后面还有别的话"), (2, f"ก่อนหน้านี้{thai}หลังจากนั้น"), (3, "小明有五个苹果"), (4, chinese[:10] + "别的")]
    got = decontaminate.match(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in got} == {(1, 1, "verbatim"), (2, 2, "verbatim")}


def test_very_long_texts_of_capitals(spark):
    capitals, plain = "WORD " * 40000, "some quiet words without any name " * 6000
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, capitals), (2, f"{plain}. {ITEM} {plain}"), (3, f"{capitals}. {ITEM}")], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.match(docs, items).collect()} == {2, 3}


def test_no_items_or_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.match(empty, items).collect() == []
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert decontaminate.match(docs, items.limit(0)).collect() == []
