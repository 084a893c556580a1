import hashlib
import itertools
import random
import re
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from invoicelake.llm import mixing, pii, quality, toxicity

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(list("ab.@@@ -+0123459()_%\né٣") + ["4539578763621486", "192.168.0.1", "+1 555 123 4567", "a@b.co"]), max_size=25).map("".join))
def test_plain_spans(text):
    assert pii.plain(text) == plain(text)


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"), ("to john [at] example [dot] com!", "email", "john [at] example [dot] com"),
        ("ｊｏ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("x jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("jo​hn@exa​mple.com", "email", "jo​hn@exa​mple.com"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"), ("4O41 8949 7460 8795", "card", "4O41 8949 7460 8795"),
        ("one nine two dot one six eight dot one dot two five", "ip", "one nine two dot one six eight dot one dot two five"), ("at 192[.]168[.]1[.]10 ok", "ip", "192[.]168[.]1[.]10"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    spans = [(s["kind"], text[s["start"] : s["end"]], s["plain"]) for s in pii.spans_of(text)]
    assert (kind, found, False) in spans
    assert found not in pii.redacted(text)


@pytest.mark.parametrize("text", ["look at example.com now", "we met at home dot", "de de de un un un un un un un un un un un un", "one two three and so on", "a a a a a a a", "", "3 of 4 at 5 dot"])
def test_clean_texts_stay(text):
    assert pii.spans_of(text) == [] and pii.redacted(text) == text


def test_long_texts_are_linear():
    assert pii.spans_of("a" * 300_000) == [] and pii.spans_of("@" * 50_000) == [] and len(pii.spans_of("1" * 200_000 + " a@b.c")) == 1


#: What disguises are made of: every separator of every step, and pieces of identifiers.
BITS = st.sampled_from([*" .,-()[]@+_\n", " dot ", " at ", "[at]", "(dot)", " @ ", "@", ". ", " .", "john", "example", "com", "polkadot.com", "plus", "double", "one", "five", "un", "uno", "siete", "1", "55", "192", "4O", "O5", "l1", "oh", "О", "１", "\u200b", "4539578763621486"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(BITS, max_size=40).map("".join))
def test_gates_change_nothing(text):
    base = pii.plain(text)
    assert pii.disguised(text, base) == pii.disguised(text, base, gated=False)


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("plus (one) (five) (five) (five) (one) (two) (three) (four) (five) (six) (seven)", "phone", "plus (one) (five) (five) (five) (one) (two) (three) (four) (five) (six) (seven"),
        ("at one nine two.one six eight.one.one zero end", "ip", "one nine two.one six eight.one.one zero"), ("so +1 (5O) 555 (l2) 34567 it", "phone", "+1 (5O) 555 (l2) 34567"),
        ("mail john@example .com now", "email", "john@example .com"),
    ],
)
def test_disguises_with_any_separator(text, kind, found):
    assert (kind, found) in [(s["kind"], text[s["start"] : s["end"]]) for s in pii.spans_of(text)]


def test_pii_digest(spark, docs, nothing):
    more = ["a@b.co; 192.168.0.1; +1 555 123 4567; 4539578763621486", "john dot doe at example dot com", "a@b.co c@d.org"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, x) for k, x in enumerate(more)], "doc_id long, text string"))
    rows = {r["doc_id"]: r.asDict() for r in pii.digest(pii.find(df)).collect()}
    for r in df.collect():
        text, got = r["text"] or "", rows[r["doc_id"]]
        base = plain(text)
        held = lambda spans: ",".join(f"{k}:{i}:{j}" for k, i, j in spans)
        every = sorted(base + pii.disguised(text, base, gated=False), key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))
        assert got["base_sha256"] == hashlib.sha256(held(base).encode()).hexdigest() and got["spans"] == held(every)
        assert [got[f"n_{k}"] for k in pii.KINDS] == [sum(x == k for x, _, _ in base) for k in pii.KINDS]
        assert [got[f"n_all_{k}"] for k in pii.KINDS] == [sum(x == k for x, _, _ in every) for k in pii.KINDS]
        assert (got["n_spans"], got["n_added"]) == (len(every), len(every) - len(base))
    assert rows[1000]["n_spans"] == 4 and rows[1001]["n_all_email"] == 1 and rows[1001]["n_email"] == 0
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == docs.count()
    clash = docs.select("doc_id", "text").withColumns({"spans": F.lit("own"), "kind": F.lit(3)})
    assert {(r["spans"], r["kind"]) for r in pii.redact(clash).collect()} == {("own", 3)}
    assert pii.find(nothing).count() == 0 and pii.redact(nothing).count() == 0


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    held = {i for k, w in enumerate(windows) if windows.count(w) > 1 for i in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(held)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "É", " ", " ", " ", "\n", "a b c d e ", "#", "|", " ", "\x0b", "\x1c", "l\n"]), max_size=60).map("".join))
def test_measures(text):
    assert quality.measure(text.encode())[:5] == measured(text)


def test_ledger_and_policies(docs, nothing):
    rows = quality.ledger(docs)
    got = {r["doc_id"]: r for r in rows.collect()}
    for r in docs.collect():
        g, (n, *_, repeats) = got[r["doc_id"]], measured(r["text"])
        assert bool(g["failures"] & quality.BASE_MASK) == (n < 10 or 100 * repeats > 20 * n)
    kept = {v: {r["doc_id"] for r in rows.filter(quality.passes(v)).collect()} for v in quality.POLICIES}
    assert kept[3] <= kept[2] <= kept[1]
    ablation = {r["rule"]: r for r in quality.ablations(rows, 3).collect()}
    for rule in quality.RULES:
        assert ablation[rule.name]["failing"] == sum(bool(r["failures"] >> rule.bit & 1) for r in rows.collect())
        assert ablation[rule.name]["alone"] == sum(r["failures"] == 1 << rule.bit for r in rows.collect())
    assert quality.ledger(nothing).count() == 0


def failed_rules(text):
    """The rules once more, in plain Python."""
    text = text or ""
    n, chars, symbols, dup, repeats = measured(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    letters, upper = len(re.findall("[A-Za-z]", text)), len(re.findall("[A-Z]", text))
    stutters = sum(a == b for a, b in zip(words, words[1:]))
    return {
        "few_words": n < 10, "repeated_windows": repeats / max(n, 1) > 0.2, "symbols": symbols > n / 10, "repeated_lines": lines >= 4 and dup / lines > 0.4, "word_length": n >= 10 and not 2.5 <= chars / n <= 15,
        "shouting": letters >= 20 and upper / letters > 0.7, "exclaims": text.count("!") > n / 2, "stutter": n >= 10 and stutters / n > 0.2,
    }


def test_every_rule_and_what_it_alone_rejects(spark, docs):
    plain_words = "some words that stand here once and are not too long at all then"
    odd = ["a b " * 3 + plain_words, plain_words + " # $ %", "\n".join(["line of words"] * 5 + [plain_words]), plain_words.upper(), plain_words + "!" * 9, "so so so so " + plain_words, "x" * 400 + " " + plain_words, "a b c d e f g h i j k l", plain_words, "very very " * 9]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(5000 + k, x) for k, x in enumerate(odd)], "doc_id long, text string"))
    rows = quality.stored_ledger(df).withColumn("kept", quality.passes(3)).withColumn("alone", quality.alone(3))
    want = {r["doc_id"]: failed_rules(r["text"]) for r in df.collect()}
    seen = set()
    for r in rows.collect():
        failed = [x.name for x in quality.RULES if r["failures"] >> x.bit & 1]
        assert failed == [x.name for x in quality.RULES if want[r["doc_id"]][x.name]] and r["kept"] == (not failed)
        assert r["alone"] == (next(x.bit for x in quality.RULES if x.name == failed[0]) if len(failed) == 1 else None)
        seen.update(failed)
    assert seen == {x.name for x in quality.RULES}


def test_mixing(docs, nothing, monkeypatch):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    total = sum(r["size"] for r in out)
    assert total == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect())
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    order = sorted((s for s in by if s is not None)) + [None]
    assert set(order) == set(by)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    size = {s: sum(r["size"] for r in rows) for s, rows in by.items()}
    closed = set()
    while True:
        left = 1.5 * total - sum(2 * size[s] for s in closed)
        rate = left / sum(w for s, w in weights.items() if s not in closed)
        over = {s for s in by if s not in closed and weights[s] * rate > 2 * size[s]}
        if not over:
            break
        closed |= over
    for s, rows in by.items():
        target = 2 * size[s] if s in closed else weights[s] * rate
        assert abs(rows[0]["target"] - target) < 1e-6 and rows[0]["source_size"] == size[s]
        assert abs(sum(r["taken"] for r in rows) - target) <= max(r["size"] for r in rows)
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"], r["taken"])
    assert sorted(again, key=key) == sorted(out, key=key)
    assert mixing.mix(nothing).count() == 0
    clash = mixing.mixed_documents(docs.selectExpr("*", "1 as _w", "2 as _words", "3 as _copies", "4 as of", "5 as _way"))
    assert clash.count() == sum(r["copies"] for r in out) and {(r["_w"], r["_words"], r["of"]) for r in clash.collect()} == {(1, 2, 4)}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, out))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.mixed_documents(nothing).count() == 0


def test_rounding_keeps_means(spark):
    taken = [0] * 12
    df = spark.createDataFrame([(k, " ".join("w" * (k + 1)), "a") for k in range(12)], "doc_id long, text string, source string")
    for seed in range(12):
        for r in mixing.mix(df, seed=seed, weights=(1,), share=0.5).collect():
            taken[r["doc_id"]] += r["copies"]
    assert all(0 < t < 12 for t in taken) and 40 <= sum(taken) <= 104


WORDS = ["idiot", "moron", "scum"]


@pytest.fixture(scope="module")
def spoken(spark):
    rows, labels, r = [], [], random.Random(9)
    for k in range(600):
        clean = " ".join(r.choice("lorem ipsum dolor sit amet tempor magna aliqua erat sed".split()) + r.choice(["", "", chr(97 + r.randrange(26))]) for _ in range(30 + k % 20))
        bad = k % 5 == 0
        rows.append((k, clean.replace(" ", f" {WORDS[k % 3]} ", 1) if bad else clean))
        labels.append((k, 1, int(bad)))
    rows += [(10_000, "l0rem you 1d10t here"), (10_001, "such a m o r o n he is"), (10_002, "s.c.u.m"), (10_003, "lorem ipsum dolor"), (10_004, None), (10_005, ""), (None, "stuff idiooot"), (10_006, "x" * 100_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, spoken):
    docs, labels = spoken
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    held = [k for k, r in got.items() if r["held_out"] and k in truth]
    assert held and all(got[k]["predicted"] == truth[k] for k in held)
    assert [got[k]["predicted"] for k in (10_000, 10_001, 10_002, 10_003, 10_004, 10_005, None, 10_006)] == [1, 1, 1, 0, 0, 0, 1, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.without_toxic(docs, labels)
    assert kept.schema == docs.schema and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(k) for k, r in got.items() if r["score"] < 0.7)
    twice = labels.union(labels.filter("toxic = 1").withColumn("toxic", F.lit(0)))  # toxic holds
    assert {r["doc_id"]: r["score"] for r in toxicity.score(docs, twice.repartition(5)).collect()} == {k: r["score"] for k, r in got.items()}
    assert toxicity.score(docs, labels, class_rows=20).filter("predicted = 1").count() > 50


def test_scores_against_all_readings():
    """Every path of every word's lattice, by brute force."""
    counts = {}
    for w in ["idiot", "moron", "stupid", "loser", "illicit"] * 3 + ["it", "dot", "lid", "or", "on"]:
        p = f"^^{w}$"
        for k in range(len(p) - 2):
            counts[p[k : k + 3]] = counts.get(p[k : k + 3], 0) + 1
    model, weights = toxicity.CharModel(counts), {"idiot$": 0.9, "moron$": 0.6, "stup": 0.7, "dot$": 0.55, "x": 0.99}

    def readings(word):
        every = {}
        for path in itertools.product(*[w for w in toxicity.lattice(word) if w != [("", toxicity.COST_SEPARATOR)]]):
            seen = "".join(t for t, _ in path)
            padded = f"^^{seen}$"
            cost = sum(c for _, c in path) + sum(model.cost(*padded[k : k + 3]) for k in range(len(seen) + 1))
            every[seen] = min(cost, every.get(seen, cost))
        return sorted(every, key=lambda s: (every[s], s))[: toxicity.BEST]

    def word_score(word):
        ways = [word, *(readings(word) if toxicity._LOOSE.search(word) else [])]
        return max([weights.get(f, 0) for w in ways if len(w) >= 3 for f in [w + "$", *(w[:k] for k in (4, 5, 6, 7) if len(w) > k)]], default=0)

    r, scores = random.Random(2), toxicity.WordScores(model, weights)
    for _ in range(150):
        words = ["".join(r.choice(x) for x in r.choice([("i1!", "d", "i1", "o0", "t7+"), ("mM", "o0", "r", "o0", "n"), ("s$5", "t7", "u", "p", "i1"), ("d", "o0", "t"), ("l", "a")])) for _ in range(r.randint(1, 5))]
        worst = sorted((s for s in map(word_score, {toxicity.bared(w) for w in words}) if s > 0.5), reverse=True)[:3]
        want = 0.1
        if worst:
            left = 1.0
            for s in worst:
                left *= 1 - s
            want = 1 - left
        spread = {w.lower(): toxicity.bared(w) for w in words}
        if len(set(spread)) == len(set(spread.values())):
            assert scores.score(" ".join(words).encode(), 0.1) == pytest.approx(want)


def test_scripts_of_many_signs_are_one_letter():
    grams = {g: n for b in toxicity._trigrams(iter([pa.RecordBatch.from_arrays([pa.array(["日本 語 かな 한국 abc".encode()])], names=["utf8"])])) for g, n in zip(*(c.to_pylist() for c in b.columns))}
    assert set("".join(grams)) == set("^$abc字") and toxicity.CharModel(grams).cost("日", "本", "$") == toxicity.CharModel(grams).cost("字", "字", "$")


def test_toxicity_without_labels_or_rows(spark, spoken):
    docs, labels = spoken
    assert {r["predicted"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_restored_words():
    counts = {}
    for w in ["idiot"] * 9 + ["loser"] * 9 + ["stupid"] * 9 + ["it", "dot", "lid"]:
        p = f"^^{w}$"
        for k in range(len(p) - 2):
            counts[p[k : k + 3]] = counts.get(p[k : k + 3], 0) + 1
    model = toxicity.CharModel(counts)
    for seen, meant in {"1d10t": "idiot", "l0$er": "loser", "stuuupid": "stupid", "s-t-u-p-i-d": "stupid", "$tup1d": "stupid", "plain": "plain"}.items():
        assert meant in toxicity.restore(seen, model)
    assert toxicity.restored_text("you 1d10t and l o s e r", model).split()[1] == "idiot"
    assert unicodedata.normalize("NFC", toxicity.restore("Élan", model)[0]) == "élan"
