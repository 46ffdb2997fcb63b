"""Language, toxicity and importance models: gradients, held-out accuracy, odd input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import importance, langid, toxicity
from murmuration.llm.common import labelled_sample

from .conftest import prose

SYLLABLES = {"xx": ["ka", "to", "mi", "ra"], "yy": ["blor", "sch", "wend", "gru"], "zz": ["éa", "ôu", "çi", "lée"]}


def invented(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_held_out_accuracy(docs):
    rows = [(i, invented(lang, i, 5 + i % 40), lang, "a", 1) for i, lang in enumerate(list(SYLLABLES) * 40)]
    rows += [(900, "123 ... ---", "xx", "a", 1), (901, None, "xx", "a", 1), (902, "", None, "a", 1), (None, invented("xx", 7, 30), "xx", "a", 1)]
    got = langid.digest(docs(rows)).collect()
    lang = {r[0]: r[2] for r in rows}
    real = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in real if r["held_out"]]) > 0.95
    odd = {r["doc_id"]: r for r in got}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (900, 901, 902))
    assert odd[None]["lang_pred"] == "xx" and not odd[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows)


def test_language_odd_input(docs, clashing):
    assert langid.digest(clashing).count() == 10 and langid.digest(docs([])).count() == 0
    nothing = langid.digest(docs([(1, "some text", None, "a", 1)])).first()
    assert nothing["lang_pred"] == "und" and nothing["rejected"]


def brute_subwords(text, orders):
    words = text.lower().split()
    return sorted(w[i:i + n] for n in orders for w in (["".join(x) for x in words] if n == 1 else [f"\0{x}\0" for x in words])
                  for i in range(len(w) - n + 1) if n == 1 or "\0" not in w[i + 1:i + n - 1])


@pytest.mark.parametrize("n_langs", [3, 20])
def test_language_matches_plain_computation(n_langs):
    """Parts of any size give the n-grams of the whole text, one without spaces too, and its prediction."""
    langs = [f"{lang}{i}" for i in range(7) for lang in SYLLABLES][:n_langs]
    model = langid.train([(invented(lang[:2], i, 30), lang) for i in range(20) for lang in langs])
    assert (model.head is None) == (n_langs <= 16)
    for text in (invented("xx", 1, 40_000), invented("yy", 2, 30_000).replace(" ", ""), "a", "é b"):
        whole = langid.subwords(text, model.orders, 1 << 30)
        assert len(whole) == len(brute_subwords(text, model.orders))
        for size in (1, 2, 3, 50):
            some = text[:300]
            parts = np.concatenate(list(langid.subword_parts(some, model.orders, 1 << 30, size)))
            assert sorted(parts) == sorted(langid.subwords(some, model.orders, 1 << 30))
        ids = langid.subwords(text, model.orders, len(model.table))
        rows = model.table if model.head is None else model.table.astype(float) @ model.head
        z = (sum(rows[i].astype(float) for i in ids) / len(ids) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score = langid.predict([text], model)
        assert lang == [model.names[int(p.argmax())]] and score[0] == pytest.approx(p.max(), abs=1e-5)


def test_every_language_is_learnt(docs):
    rows = [(i, invented("xx", i, 6), f"l{i % 230}", "a", 1) for i in range(460)]
    frame = docs(rows)
    ids = frame.selectExpr("doc_id", "lang AS label")
    found = labelled_sample(ids, frame, 400, 100)
    assert len(found) == 230 and {label for _, label in found} == {f"l{i}" for i in range(230)}


def test_shared_ids_take_one_place(docs):
    rows = [(1, f"text {i}", "xx", "a", 1) for i in range(50)] + [(i, f"own {i}", "yy", "a", 1) for i in range(2, 12)]
    frame = docs(rows + rows)
    ids = frame.selectExpr("doc_id", "lang AS label")
    found = labelled_sample(ids, frame, 8)
    assert sorted(label for _, label in found) == ["xx"] + ["yy"] * 8
    assert labelled_sample(ids, docs(rows[::-1]), 8) == found


def test_subwords_stay_inside_words():
    one, other = langid.subwords("ab cd", (2, 3), 1 << 20), langid.subwords("cd  \n ab", (2, 3), 1 << 20)
    assert sorted(one) == sorted(other) and len(one) == 10


def test_network_gradients():
    how = toxicity.Training(window=5, hidden=3, dim=2, attention=2)
    rng = np.random.default_rng(0)
    gru, p = toxicity.Gru(how), None
    p = {k: v.astype(np.float64) for k, v in gru.start(rng).items()}
    x = rng.normal(0, 1, (7, 4))
    windows = rng.integers(0, 7, (6, 5))
    mask = np.arange(5) < np.array([5, 3, 1, 5, 4, 2])[:, None]
    weight = rng.normal(0, 1, 6)

    def loss(p, x):
        return float(gru.run(p, toxicity._projected(p, x), windows, mask) @ weight)

    logit, memory = gru.run(p, toxicity._projected(p, x), windows, mask, keep=True)
    g, d_x = gru.grads(p, {"x": x}, windows, mask, memory, weight)
    total = np.zeros_like(x)
    np.add.at(total, windows[mask], d_x[mask])
    for name, array, grad in [*((k, p[k], g[k]) for k in p), ("x", x, total)]:
        flat = array.reshape(-1)
        for i in rng.choice(flat.size, min(4, flat.size), replace=False):
            kept = flat[i]
            flat[i] = kept + 1e-2
            up = loss(p, x)
            flat[i] = kept - 1e-2
            down = loss(p, x)
            flat[i] = kept
            assert (up - down) / 2e-2 == pytest.approx(grad.reshape(-1)[i], rel=0.03, abs=3e-3), name


def plain_score(net, text):
    """One window at a time, one word at a time."""
    how, p = net.how, net.p
    words = text.lower().split()
    sig = lambda v: 1 / (1 + np.exp(-v))

    def word(w):
        grams, _ = toxicity._hashed_grams([w], how)
        return np.concatenate([net.words[toxicity._hashed_words([w], how.buckets)[0]], net.grams[grams].mean(axis=0)])

    best = -np.inf
    for lo in range(max(len(words) - how.window, 0) + 1 if words else 0):
        xs = [word(w) for w in words[lo:lo + how.window]]
        sides = []
        for side, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
            state, seen = np.zeros(how.hidden), {}
            for i in order:
                x, g = xs[i] @ p[f"W{side}"] + p[f"c{side}"], state @ p[f"U{side}"]
                z, r, h = sig(x[:how.hidden] + g[:how.hidden]), sig((x + g)[how.hidden:2 * how.hidden]), 2 * how.hidden
                state = z * state + (1 - z) * np.tanh(x[h:] + r * g[h:])
                seen[i] = state
            sides.append(seen)
        states = np.array([np.concatenate([sides[0][i], sides[1][i]]) for i in range(len(xs))])
        s = np.exp(np.tanh(states @ p["A"] + p["a"]) @ p["v"])
        best = max(best, (s / s.sum()) @ states @ p["o"] + p["b"][0])
    return 0.0 if best == -np.inf else sig(best - net.shift + np.log(0.3 / 0.7))


def trained_network(how):
    texts = [(prose(i, 5 + i % 40) + (" vexblort " if i % 3 == 0 else " ") + prose(i + 999, 9), int(i % 3 == 0)) for i in range(90)]
    return toxicity.train(texts, 0.3, how)


def test_scores_match_plain_windows(monkeypatch):
    """Every window of every text, whatever texts and parts it is computed with."""
    how = toxicity.Training(rounds=1, passes=1, buckets=1 << 10)
    net = trained_network(how)
    texts = ["", "one", "vexblort", " \n ", *(prose(i, i) for i in range(1, 30)), prose(5, 300) + " vexblort " + prose(6, 40)]
    want = [plain_score(net, t) for t in texts]
    for size in (1, 7, 2_048):
        monkeypatch.setattr(toxicity, "WINDOWS", size)
        assert toxicity.scores_of(net, texts) == pytest.approx(want, abs=2e-5)
    assert [toxicity.scores_of(net, [t])[0] for t in texts] == pytest.approx(want, abs=2e-5)
    laid = toxicity.Words(texts, how)
    assert len(laid.starts) == sum(max(len(t.split()) - how.window, 0) + 1 for t in texts if t.split())


def test_trained_network_on_odd_rows(clashing, odd_rows):
    net = trained_network(toxicity.Training(rounds=1, passes=1, buckets=1 << 10))
    got = toxicity.score_documents(clashing.drop("score"), net, ("doc_id", "text")).collect()
    scores = {}
    for r in got:
        scores.setdefault((r["doc_id"], r["text"]), set()).add(r["score"])
    assert len(got) == len(odd_rows) and all(len(s) == 1 and 0 <= min(s) <= 1 for s in scores.values())
    assert scores[1, None] == scores[2, ""] == scores[5, " \t\n "] == {0.0}
    long = next(t for d, t, *_ in odd_rows if d == 3)
    assert scores[3, long].pop() == pytest.approx(toxicity.scores_of(net, [long])[0], abs=1e-6)


def test_toxicity_held_out(spark, docs):
    rng = random.Random(1)
    bad = ["vexblort", "grimsnak", "vexblorts", "grimsnaks"]
    rows, labels = [], []
    for i in range(500):
        words = prose(i, rng.randrange(5, 90)).split()
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(600, None, "en", "a", 1), (601, "", "en", "a", 1)]
    marks = spark.createDataFrame(labels + [(None, 1, 1), (601, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.digest(docs(rows), marks, toxicity.Training(rounds=3, buckets=1 << 12)).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 500]
    right = np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held])
    assert right > 0.95 and all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows)
    assert all(r["score"] == 0 for r in got if r["doc_id"] >= 600)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_toxicity_odd_input(spark, docs, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.digest(clashing, none).count() == 10
    assert toxicity.digest(docs([]), none).count() == 0


def brute_weights(rows, target, how):
    """Bucket numbers come from the engine; everything else is counted here."""
    ids = sorted(rows)
    counts = [{"raw": 0, "target": 0} for _ in range(how.buckets)]
    for d in ids:
        for b in rows[d]:
            counts[b]["raw"] += 1
            counts[b]["target"] += d in target
    raw, tgt = sum(c["raw"] for c in counts), sum(c["target"] for c in counts)
    ratio = [np.log(((c["target"] + 1) / (tgt + how.buckets)) / ((c["raw"] + 1) / (raw + how.buckets))) for c in counts]
    return {d: sum(ratio[b] for b in rows[d]) for d in ids}


def test_importance_matches_brute_force(spark, docs):
    how = importance.Resampling(buckets=128, share=0.3)
    rows = [(i, prose(i, 3 + i % 30) if i % 2 else invented("xx", i, 3 + i % 30), "en", "a", 1) for i in range(120)] + [(500, None, None, None, 1), (501, "one", None, None, 1)]
    frame = docs(rows)
    ids = spark.createDataFrame([(i,) for i in range(1, 60, 2)] + [(None,)], "doc_id long")
    got = importance.resample(frame, ids, how).collect()
    grams = {r["doc_id"]: r["g"] for r in frame.select("doc_id", importance.gram_buckets(F.coalesce("text", F.lit("")), how.buckets).alias("g")).collect()}
    want = brute_weights(grams, set(range(1, 60, 2)), how)
    for r in got:
        assert r["log_weight"] == pytest.approx(want[r["doc_id"]], abs=1e-6) and r["n_grams"] == len(grams[r["doc_id"]])
    by = sorted(got, key=lambda r: (-r["key"], r["doc_id"]))
    assert [r["rank"] for r in by] == list(range(1, len(rows) + 1))
    assert sum(r["selected"] for r in got) == 37 and all(r["selected"] == (r["rank"] <= 37) for r in got)
    odd = np.mean([r["doc_id"] % 2 for r in got if r["selected"]])
    assert odd > 0.8
    assert sorted(map(str, importance.resample(frame, ids, how).collect())) == sorted(map(str, got))


def test_gumbel_top_k_samples_in_proportion(spark):
    frame = spark.range(20_000).select(importance.gumbel(F.col("id"), 3).alias("g"))
    row = frame.agg(F.avg("g"), F.stddev("g")).first()
    assert row[0] == pytest.approx(0.5772, abs=0.03) and row[1] == pytest.approx(1.2825, abs=0.03)


def test_importance_odd_input(spark, docs, clashing):
    none = spark.createDataFrame([], "doc_id long")
    assert importance.resample(clashing, none).count() == 10 and importance.resample(docs([]), none).count() == 0
