"""Held-out accuracy, hand-made findings, and the odd inputs."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np

from tessera.llm import language_id, quality, secrets
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in QUERIES["op8_quality_qda"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and all(rows[r.doc_id].held_out for r in held)
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_quality_fit_is_the_closed_form(spark):
    """Without shrinkage the log-density difference is the plain Gaussian one."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (200, 9)), rng.normal(1, 2, (300, 9))])
    y = np.array([0] * 200 + [1] * 300)
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)],
                               ", ".join(f"{f} double" for f in quality.FEATURES) + ", label int")
    model = quality.fit(df, "label", to_pooled=0.0, to_identity=0.0)

    def log_density(c):
        part = x[y == c]
        s = np.cov(part.T, bias=True)
        d = x - part.mean(0)
        return np.log(len(part)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)

    assert np.allclose(model.score(x), 1 / (1 + np.exp(log_density(0) - log_density(1))), atol=1e-6)


def test_quality_of_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, "z"), (1, "", "z"), (None, "a b", "z"), (2, "word " * 50_000, "z")],
                                 "doc_id long, text string, marks string")
    stats = quality.with_statistics(docs)
    assert stats.count() == 4 and quality.with_statistics(docs.limit(0)).count() == 0
    none = quality.fit(stats.selectExpr("*", "cast(null as int) as label"), "label")
    one = quality.fit(stats.selectExpr("*", "1 as label"), "label")
    assert {r[0] for r in docs.select(quality.score_text(none, "text")).collect()} == {0.5}
    assert {r[0] for r in docs.select(quality.score_text(one, "text")).collect()} == {1.0}


def test_language_on_held_out_rows(spark):
    rows = QUERIES["op9_language_filters"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.held_out for r in held)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_inputs(spark):
    schema = "doc_id long, text string, lang string, score string"
    train = spark.createDataFrame([(1, "the cat and the dog", "en", ""), (2, "der Hund und die Katze", "de", ""),
                                   (3, None, "fr", ""), (4, "le chat", None, ""), (5, "the end", "en", "")], schema)
    model = language_id.fit(train)
    assert model.languages == ["de", "en"]
    docs = spark.createDataFrame([(1, None, "", ""), (2, "12 34 !", "", ""), (3, "", "", ""), (None, "the dog", "", ""),
                                  (4, "Ωμέγα", "", ""), (5, "und die", "", ""), (5, "und die", "", "")], schema)
    got = sorted((r.doc_id or -1, r.lang_pred, round(r.score, 3)) for r in language_id.predict(docs, model).collect())
    assert [g[:2] for g in got] == [(-1, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de")]
    assert [g[2] for g in got if g[0] in (1, 2, 3, 4)] == [0.0] * 4
    empty = language_id.fit(train.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).collect() == []


def test_more_languages_than_a_word_has_bits(spark):
    """150 languages of a script each; exact sets of trigrams give the same answers."""
    script = lambda k: "".join(chr(0x4E00 + 20 * k + j) for j in range(12))
    rows = [(k, script(k) * 3, f"l{k:03d}") for k in range(150)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 150 and model.words.shape[0] == 3
    mixed = [(1000 + k, script(k) + " " + script((k + 64) % 150) * 2, None) for k in range(150)]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    held = {name: set(language_id.trigrams([t])[0].tolist()) for _, t, name in rows}
    for i, t, _ in rows + mixed:
        grams = language_id.trigrams([t])[0].tolist()
        assert got[i] == max(sorted(held), key=lambda name: sum(g in held[name] for g in grams))


def test_predictions_equal_those_of_exact_sets(spark):
    """A brute-force twin on the documents: sets in place of the filters."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    rows = docs.collect()
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    counts = {}
    for r in rows:
        if r.text and r.lang:
            for g in language_id.trigrams([r.text])[0].tolist():
                counts.setdefault(r.lang, {}).setdefault(g, 0)
                counts[r.lang][g] += 1
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    share = lambda lang, g: counts[lang].get(g, 0) / total[lang]
    held = {lang: {g for g in counts[lang] if share(lang, g) >= 2e-6 and share(lang, g) >= 0.1 * max(share(x, g) for x in counts)}
            for lang in counts}
    same = []
    for r in rows:
        grams = language_id.trigrams([r.text or ""])[0].tolist()
        n = {lang: sum(g in held[lang] for g in grams) for lang in sorted(held)}
        top = sorted(n.values())[::-1]
        if grams and (len(top) < 2 or top[0] > top[1]):
            same.append(got[r.doc_id] == max(n, key=n.get))
    assert len(same) > 200 and np.mean(same) > 0.995


def test_filter_holds_what_it_was_given():
    keys = np.arange(1, 4000, dtype=np.uint64) * np.uint64(977)
    words = np.zeros(1 << 14, dtype=np.uint64)
    for p in language_id.positions(keys, 14, 4):
        np.bitwise_or.at(words, p, np.uint64(2))
    found = None
    for p in language_id.positions(keys, 14, 4):
        found = words[p] if found is None else found & words[p]
    assert (found == 2).all()


def hexes(n, seed):
    return hashlib.sha512(seed.encode()).hexdigest()[:n]


def test_secrets_and_look_alikes(spark):
    key, token, aws = hexes(18, "a"), hexes(40, "b"), "AKIA" + "QCN5VJTUYMSSXKC6"
    texts = {
        1: f"so it is password={key} and the rest", 2: f'we say token = "{token}" here', 3: f"use {aws} for it",
        4: f"it was fixed in commit {hexes(40, 'c')} of the tree", 5: "password=your-password-123456 is not one",
        6: f"see id {token[:8]}-{token[8:12]}-{token[12:16]}-{token[16:20]}-{token[20:32]} there", 7: None, 8: "",
        9: "no secret in the text at all", 10: f"x {aws} y {aws} z"}
    rows = [(i, t, "src/a.py", "q") for i, t in texts.items()]
    docs = spark.createDataFrame([*rows, rows[0], (None, texts[3], None, "q")],
                                 "doc_id long, text string, source string, score string")
    found = secrets.scan(docs, path_col="source")
    got = sorted(((r.doc_id or -1), r.candidate, r.start) for r in found.collect())
    assert [g[0] for g in got] == [-1, 1, 2, 3, 10, 10]
    assert all(texts[3 if i == -1 else i][s:s + len(c)] == c for i, c, s in got)
    out = sorted(((r.doc_id or -1), r.text) for r in secrets.redact(docs, found).collect() if r.text is not None)
    assert len(out) == 11 and dict(out)[2] == 'we say token = "[SECRET]" here'
    assert dict(out)[10] == "x [SECRET] y [SECRET] z" and dict(out)[4] == texts[4] and dict(out)[-1] == "use [SECRET] for it"


def test_redaction_changes_nothing_else(spark):
    """Marks inside the text stay; columns may have any name; long texts."""
    aws = "AKIA" + "QCN5VJTUYMSSXKC6"
    texts = [f"a\u0002b {aws} c\u0003 é\U0001F600 {aws}\u0002", f"{aws}", "\u0002\u0003 none", None, "word " * 40_000 + aws + " end",
             f"\u0003password={hexes(18, 'a')}"]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in enumerate(texts)],
                                 "doc_id long, text string, _nos int, _id int, _KEY int, _places int")
    out = secrets.redact(docs, secrets.scan(docs))
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    want = [None if t is None else t.replace(aws, "[SECRET]").replace(hexes(18, "a"), "[SECRET]") for t in texts]
    assert [got[i].text for i in range(len(texts))] == want
    assert {(r._nos, r._id, r._KEY, r._places) for r in got.values()} == {(1, 2, 3, 4)}


def test_secrets_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.scan(docs).collect() == []


def test_dictionary_of_many_runs_and_forest_of_any_cut(spark):
    docs = spark.createDataFrame([("alpha beta Beta beta gamma gamma",), ("gamma; ALPHA, alpha",), (None,), ("",)], "text string")
    runs = spark.createDataFrame([("alpha",), ("beta",), ("gamma",), ("delta",)], "word string")
    for limit in (10, 2):       # broadcast, and counted before the join
        assert {r.word for r in secrets.dictionary(docs, runs, max_runs=limit).collect()} == {"alpha", "beta", "gamma"}
        assert secrets.dictionary(docs, runs, min_count=4, max_runs=limit).collect() == []
    found = secrets.describe(secrets.labelled_findings(spark, 600), docs).cache()
    forests = [secrets.train(found.repartition(n)).stages[1].toDebugString for n in (1, 5)]
    assert forests[0].split("\n", 1)[1] == forests[1].split("\n", 1)[1]
