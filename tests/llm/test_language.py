import random
import zlib

import numpy as np

from quire.llm import language as lg

TONGUES = {"aa": "the and of river mill stone water walk", "bb": "der und die fluß mühle stein wasser über", "cc": "le et la rivière moulin pierre eau très"}


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(TONGUES))
        rows.append((i, " ".join(rng.choice(TONGUES[lang].split()) for _ in range(rng.randint(4, 40))), lang))
    return rows


def test_presence_by_hand():
    x = lg.presence(["abab", "ABAB", "", "a"])
    assert (x[0] == x[1]).all() and x[2].sum() == 0 and x[3].sum() == 1
    assert 7 <= x[0].sum() <= 7  # a b ab ba aba bab abab
    assert x[3] @ x[0] == 1


def test_scores_equal_kernel_ridge_by_kernels():
    """The multiplied-out matrix scores as sums over landmarks' kernels do."""
    rows = corpus(90)
    packed = [(lang, np.packbits(lg.presence([t])[0]).tobytes()) for _, t, lang in rows]
    model = lg.train(packed, landmarks=8)
    x = lg.presence([rows[0][1], "Wasser mill"]).astype(float)
    k = x / np.sqrt(x.sum(1, keepdims=True))
    assert np.allclose(k @ model.weights, (x @ model.weights) / np.sqrt(x.sum(1, keepdims=True)))
    names, scores = model.predict([rows[0][1], "Wasser über Stein", None, "12 _ 3", ""])
    assert names[0] == rows[0][2] and names[1] == "bb" and names[2:] == ["und"] * 3
    assert all(0 <= s <= 1 for s in scores)


def test_held_out_accuracy(spark):
    rows = corpus(400)
    df = spark.createDataFrame([(*r, 1, "s") for r in rows] + [(500, None, "aa", 1, "s"), (501, "...", None, 1, "s"), (None, "le moulin", None, 1, "s")], "doc_id long, text string, lang string, score int, lang_pred string")
    got = {r.doc_id: r for r in lg.op5(df).collect()}
    assert len(got) == 403
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out and i is not None and i < 400} == set(held)
    right = sum(got[i].lang_pred == rows[i][2] for i in held)
    assert right / len(held) > 0.97
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[None].lang_pred == "cc"


def test_long_texts_whole(monkeypatch):
    text = "".join(random.Random(1).choice("abcdé ") for _ in range(5000))
    whole = lg.presence([text])
    monkeypatch.setattr(lg, "LONG", 700)
    assert (lg.presence([text]) == whole).all()


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in lg.op5(df).collect()] == ["und"]
    assert lg.op5(df.limit(0)).count() == 0


def test_what_is_a_letter(spark):
    df = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(["½ ² ①", "_ 12", "é", "日本", "the and"] * 10)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lg.op5(df).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["und", "und", "aa", "aa", "aa"] and got[0].score == 0


def test_no_language_is_left_out(spark):
    names = [f"l{i:03}" for i in range(300)]
    rows = [(i * 40 + k, f"{n * 3} word{n}x {n}{k}", n) for i, n in enumerate(names) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lg.fit(df)
    assert len(model.languages) == len({n for d, _, n in rows if zlib.crc32(str(d).encode()) % 5}) and model.weights.size <= lg.WEIGHTS
    assert lg.dimensions(4) == lg.DIMENSIONS and lg.dimensions(300) == 16384 and lg.dimensions(1 << 20) == lg.FEWEST


def test_repeated_rows_are_one_in_learning(spark, monkeypatch):
    monkeypatch.setattr(lg, "PER_LANGUAGE", 30)
    # Language aa is one row, thousands of times; bb's rows share a doc_id; cc is ordinary.
    rows = [(1, TONGUES["aa"], "aa")] * 5000 + [(1, f"{TONGUES['bb']} {i}", "bb") for i in range(3000)] + [(r[0] + 10, r[1], r[2]) for r in corpus(600) if r[2] == "cc"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(lg, "train", lambda rows: seen.extend(rows) or lg.Model([], np.zeros((0, 0))))
    lg.fit(df, 30)
    n = {x: sum(r[0] == x for r in seen) for x in TONGUES}
    assert n["aa"] == 1 and 0 < n["bb"] <= 30 and 0 < n["cc"] <= 30
