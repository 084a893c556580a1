import itertools

import pytest

from invoicelake.llm import toxicity


def model_of(*words):
    counts = {}
    for w in words:
        p = f"^^{w}$"
        for k in range(len(p) - 2):
            counts[p[k : k + 3]] = counts.get(p[k : k + 3], 0) + 9
    return toxicity.CharModel(counts)


@pytest.fixture
def scores():
    return toxicity.WordScores(model_of("idiot", "moron", "harmless", "letters"), {"idiot$": 0.98, "moron$": 0.55})


@pytest.mark.parametrize("insult", ["idiot", "1d10t", "iiiiiidiooooooooooooooooooot"])
@pytest.mark.parametrize("before", [0, 3, 20, 21, 22, 23, 24, 43, 44, 45, 46, 47, 250, 1000])
def test_letters_set_apart_count_wherever_they_stand(scores, before, insult):
    text = " ".join("harmless" * 200)[: 2 * before] + " ".join(insult + "letters" * 9)
    assert scores.score(text.encode(), 0.1) == pytest.approx(0.98)
    assert "idiot" in toxicity.restored_text(text, scores.model)


@pytest.mark.parametrize(
    "token",
    [
        "idi" + "o" * 60 + "t", "i" * 30 + "." * 30 + "d1" + "0" * 40 + "t", "/".join(["some", "letters", "1d10t"] * 4), "harmless" * 9 + "1d10t" + "letters" * 9, "harmless" * 9 + "idiot" + "letters" * 9,
        "letters" * 5 + "/idiot/you", "harmless_letters_and_other_" * 3 + "id1ot", "1" + "harmless" * 6 + "idiot",
    ],
)
def test_long_tokens_count(scores, token):
    assert len(token) > 40
    assert scores.score(f"well {token} then".encode(), 0.1) == pytest.approx(0.98)
    assert scores.score(token.replace("t", "n").encode(), 0.1) == 0.1


def test_long_tokens_teach(scores):
    cache = {}
    assert {"idiot"} <= toxicity.doc_words(("idi" + "o" * 60 + "t").encode(), scores.model, cache) and "idiot" in toxicity.doc_words("/".join(["letters"] * 9 + ["idiot"]).encode(), scores.model, cache)
    assert max(map(len, toxicity.features("x" * 100_000))) < 50


def test_the_worst_of_all_runs_counts(scores):
    text = "m o r o n then some and 1 d 1 0 t"
    assert scores.score(text.encode(), 0.1) == pytest.approx(1 - 0.45 * 0.02)
    assert scores.score(b"m o r o n then some and m o r o n", 0.1) == pytest.approx(0.55)


@pytest.mark.parametrize("gap", [" ", "  ", "\t", "\n", " ", " \r\n   ", " "])
@pytest.mark.parametrize("word", ["imbécile", "imbécile", "идиот", "ηλίθιος", "idiot"])
def test_letters_of_any_script_and_gap(gap, word):
    units = [word[k] + ("́" if word[k + 1 : k + 2] == "́" else "") for k in range(len(word)) if word[k] != "́"]
    text = f"such an{gap}x1 {gap.join(units)} here"
    got = toxicity.WordScores(model_of("imbécile", "idiot"), {w + "$": 0.98 for w in ("imbécile", "идиот", "ηλίθιος", "idiot")})
    assert got.score(text.encode(), 0.1) == pytest.approx(0.98)
    assert word in toxicity.restored_text(text, got.model)


def test_all_trigrams_of_all_words_count(spark):
    words = ["".join(chr(97 + (k * m + m) % 26) for k in range(9)) for m in range(1, 26)] + ["жук" * 20]
    docs = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id long, text string")
    counts, _, _ = toxicity.learn(docs, spark.createDataFrame([(0, 0)], "doc_id long, toxic int"), model_features=50)
    want = {}
    for w in words:
        for k in range(len(w) + 1):
            g = f"^^{w}$"[k : k + 3]
            want[g] = want.get(g, 0) + 1
    assert counts == want and len(want) > 50


def test_readings_are_the_best_of_all():
    model = model_of("illicit", "lilting", "titillating", "biggest", "goggles", "little")
    for word in ("1|1|1!1", "9669|3", "71711|@71", "|17+|3!!69", "1l1!!|+|1l1|"):
        every = {}
        for path in itertools.product(*toxicity.lattice(word)):
            text, cost = "".join(t for t, _ in path), sum(c for _, c in path)
            padded = f"^^{text}$"
            cost += sum(model.cost(*padded[k : k + 3]) for k in range(len(text) + 1))
            every[text] = min(cost, every.get(text, cost))
        got = toxicity.readings(toxicity.lattice(word), model)
        assert [every[x] for x in got] == pytest.approx(sorted(every.values())[:6])
