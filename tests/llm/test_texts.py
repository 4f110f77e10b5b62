import random
import re

import numpy as np
import pytest

from mnemos.llm import language, leaks, mix


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"word{i}" for i in range(40)] + ["É", "x1"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([5, 12, 30])))) for i in range(25)] + [(90, None), (91, ""), (92, "a b")]
    items += [(93, items[2][1])] + items[:3]
    docs = []
    for i in range(80):
        w = [r.choice(vocabulary) for _ in range(r.randrange(40))]
        if r.random() < 0.6:
            src = r.choice(items[:25])[1].split()
            a = r.randrange(max(1, len(src) - 11))
            w[10:10] = src[a : a + r.choice([11, 12, 20])]
        docs.append((i, r.choice([" ", "\n+ ", ", # "]).join(w).upper() if i % 3 else " ".join(w), 0))
    docs += [(200, None, 0), (201, "", 0), (202, "İ " + items[2][1], 0), (203, ("filler " * 50_000) + items[2][1] + " end", 0)]
    df = spark.createDataFrame(docs, "d bigint, t string, n_words int")
    it = spark.createDataFrame(items, "i bigint, x string")

    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[k : k + 12]) for k in range(len(w) - 11)}

    want = {(d, i) for d, t, _ in docs for i, x in items if grams(t) & grams(x)}
    for block in (leaks.BLOCK_WORDS, 60):
        spans = leaks.leaked_spans(df, "d", "t", it, "i", "x", block_words=block)
        assert {tuple(r) for r in leaks.leaking(spans, "d", "i").collect()} == want
    assert (202, 2) in want and (203, 93) in want
    clean = {r["d"]: r["t"] for r in leaks.decontaminate(df, "d", "t", spans).collect()}
    assert clean[203] == "filler " * 50_000 + " end" and clean[200] is None and len(clean) == len(docs)
    kept = {r["d"] for r in leaks.decontaminate(df, "d", "t", spans, "drop").collect()}
    assert kept == {d for d, *_ in docs} - {d for d, _ in want}
    assert leaks.leaked_spans(df, "d", "t", it.limit(0), "i", "x").isEmpty() and leaks.leaked_spans(df.limit(0), "d", "t", it, "i", "x").isEmpty()


def test_water_fill():
    sizes, shares, caps = {"a": 100.0, "b": 1000.0, "c": 0.0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 2, "b": 3, "c": 9}
    given = mix.water_fill(sizes, shares, caps, 1000)
    assert given == {"a": 200, "b": 800, "c": 0}
    assert sum(mix.water_fill(sizes, shares, caps, 1e9).values()) == 200 + 3000
    assert mix.feasible_total(sizes, shares, caps) == 400


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_mix(spark, hot):
    r = random.Random(9)
    docs = [(i, r.choice(["a", "a", "a", "b", "c"]), r.randrange(1, 60)) for i in range(400)] + [(900, None, 5), (901, "z", 5), (None, "a", 5), (902, "a", 0), (903, "b", None)]
    df = spark.createDataFrame(docs + docs[:20], "id bigint, s string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.3, 2), ("nothing", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    draw, report = mix.mix(df, "id", "s", targets, seed=1, hot_rows=hot, slices=4)
    rep = {x["s"]: x for x in report.collect()}
    for s, share, cap in (("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.3, 2)):
        assert abs(rep[s]["reached_share"] - share) < 0.02 and rep[s]["most_repeats"] <= cap
    rows = draw.collect()
    assert sum(x["tokens"] * x["repeats"] for x in rows) == sum(x["drawn_tokens"] for x in rep.values())
    again = {tuple(x) for x in mix.mix(df.repartition(7), "id", "s", targets, seed=1, hot_rows=hot, slices=4)[0].collect()}
    assert again == {tuple(x) for x in rows}
    clamped = {x["s"]: x for x in mix.mix(df, "id", "s", targets, total_tokens=1e9)[1].collect()}
    assert all(clamped[s]["most_repeats"] == c for s, c in (("a", 1), ("b", 3), ("c", 2)))
    assert mix.mix(df.limit(0), "id", "s", targets)[0].isEmpty()


@pytest.mark.parametrize("share", [None, 0.3, 0.9])
def test_mix_plans_many_sources_as_a_table(spark, share):
    """Above max_sources the level is found in the table; both ways plan and draw the same, at any share of what the caps allow."""
    r = random.Random(4)
    docs = spark.createDataFrame([(i, f"s{r.randrange(12) ** 2 // 12}", r.randrange(1, 50)) for i in range(600)], "id bigint, s string, tokens bigint")
    targets = spark.createDataFrame([(f"s{k}", (k % 4 + 1) / 30, k % 3 + 1) for k in range(12)], "source string, target_share double, max_repeats int")
    few, many = (mix.mix(docs, "id", "s", targets, total_share=share, max_sources=n) for n in (10_000, 3))
    planned = [{x["s"]: round(x["planned_tokens"], 6) for x in report.collect()} for _, report in (few, many)]
    assert planned[0] == planned[1] and {tuple(x) for x in few[0].collect()} == {tuple(x) for x in many[0].collect()}
    rows = few[1].collect()
    full = [x for x in rows if x["available_tokens"] and x["planned_tokens"] >= x["available_tokens"] * x["max_repeats"] - 1e-6]
    assert (share is None) or full and all(x["most_repeats"] == x["max_repeats"] for x in full)
    assert all(abs(x["drawn_tokens"] - x["planned_tokens"]) <= 50 for x in rows)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|> ünïcode"), (5, "a " * 100_000)], "id bigint, t string")
    got = {r["id"]: r["tokens"] for r in mix.token_counts(df, "t", "id").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[5] >= 100_000 and got[4] > 3


SENTENCES = {
    "en": "the quick loader now reads every empty record before the server starts and writes a short note",
    "de": "der schnelle lader liest jetzt jeden leeren datensatz bevor der dienst startet und schreibt eine notiz",
    "fr": "le chargeur rapide lit maintenant chaque enregistrement vide avant que le serveur ne démarre et écrit une note",
}


def corpus(n=240):
    r, out = random.Random(1), []
    for i in range(n):
        lang = r.choice(list(SENTENCES))
        w = SENTENCES[lang].split()
        out.append((i, " ".join(r.sample(w, len(w))) + ".", r.choice(list(SENTENCES)) if r.random() < 0.1 else lang, lang))
    return out


def test_language_accuracy_and_segments(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id bigint, t string, l string, truth string")
    model = language.train(df, "id", "t", "l", ("de", "en", "fr"), 60)
    held = spark.createDataFrame(corpus(330)[240:], "id bigint, t string, l string, truth string")
    got = {r["id"]: r for r in language.main_language(language.segments(held, "id", "t", model), "id").collect()}
    assert sum(got[i]["lang"] == truth for i, *_, truth in corpus(330)[240:]) >= 0.97 * 90
    assert all(0 < r["confidence"] <= 1 for r in got.values())
    mixed = [(1, SENTENCES["en"] + ". " + SENTENCES["de"] + ".", 0), (2, None, 0), (3, "", 0), (4, "12 ?", 0), (5, (SENTENCES["fr"] + ". ") * 2000, 0), (None, "x", 0)]
    parts = language.segments(spark.createDataFrame(mixed, "id bigint, t string, lang int"), "id", "t", model).orderBy("id", "segment").collect()
    assert [(p["id"], p["segment"], p["lang"]) for p in parts] == [(1, 0, "en"), (1, 1, "de"), (5, 0, "fr")]
    assert parts[0]["end_char"] <= parts[1]["start_char"] == mixed[0][1].index("der schnelle")
    untrained = language.train(df.limit(0), "id", "t", "l")
    assert language.segments(held, "id", "t", untrained).count() > 0 and language.segments(held.limit(0), "id", "t", model).isEmpty()


def test_rarity_is_counted_over_all_documents(spark):
    rows = [(i, t, l) for i, t, l, _ in corpus()] + [(9000, None, "en"), (9001, SENTENCES["fr"], None)]
    model = language.train(spark.createDataFrame(rows, "id bigint, t string, l string"), "id", "t", "l", ("de", "en", "fr"), 2)
    words = [language.running_words(t)[0] for _, t, _ in rows if t]
    chunks = [w[i : i + 8] for w in words for i in range(0, len(w) - 4, 8)]
    seen = [{g for w in c for g in language._grams(w)} for c in chunks]
    for g in set().union(*seen):
        assert model.idf[g] == pytest.approx(np.log((1 + len(chunks)) / (1 + sum(g in s for s in seen))), rel=1e-5)


def test_running_words_and_labels(spark):
    text = 'Fix `load_it` now (#12)\n"fichier introuvable dans le"\n# Conflicts:\n> quoted line\nSigned-off-by: A B <a@b.c>\nupdate-type: minor\nsee src/a.go:12 and a_b l\'été'
    assert language.running_words(text)[0] == ["fix", "now", "see", "and", "l'été"]
    df = spark.createDataFrame([(x,) for x in ("EN", "pt_BR", "en-GB", "und", "unknown", "", None, "english", " de ")], "l string")
    assert [r[0] for r in df.select(language.label(df.l)).collect()] == ["en", "pt", "en", None, None, None, None, None, "de"]
    commit = spark.createDataFrame([("commit 1\nAuthor: x\n\n    body\n\n    more\n\ndiff --git a b\n+x",), ("no header",), (None,)], "t string")
    assert [r[0] for r in commit.select(language.message(commit.t)).collect()] == ["    body\n\n    more\n", "", ""]
