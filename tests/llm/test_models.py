"""The trained operators and HTML extraction."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowcraft.llm import html_extract, langid, perplexity

EN = "the quick fox and the lazy dog went to the river in the morning with all of their friends "
DE = "der schnelle fuchs und der faule hund gingen am morgen mit allen freunden über den großen fluss "
FR = "le renard rapide et le chien paresseux sont allés à la rivière le matin avec tous leurs amis "


def corpus(spark, n=240):
    pick = np.random.default_rng(2)
    rows = []
    for k in range(n):
        lang, text = (("en", EN), ("de", DE), ("fr", FR))[k % 3]
        w = text.split()
        rows.append((k, " ".join(pick.choice(w, size=40)), lang))
    return spark.createDataFrame([*rows, (n, None, "en"), (n + 1, "12 34 !!", "en"), (n + 2, "", None), (None, EN, "en"), (n + 3, EN * 3000, None)], "doc_id long, text string, lang string")


def test_language_identification(spark, none):
    docs = corpus(spark)
    model = langid.fit(docs.filter(~langid.held_out()))
    assert model.languages == ("de", "en", "fr") and (model.weights == 0).mean() > 0.5
    got = langid.predict(docs, model).join(docs.withColumn("out", langid.held_out()), "doc_id").collect()
    tested = [r for r in got if r.out and r.doc_id < 240]
    assert len(tested) > 30 and np.mean([r.lang == r.lang_pred for r in tested]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[k].lang_pred for k in (240, 241, 242, 243)] == ["und", "und", "und", "en"]
    assert langid.predict(docs, langid.fit(none.select("doc_id", "text", "lang"))).agg(F.max("score"), F.max("lang_pred")).first() == (0.0, "und")
    assert langid.predict(none, model).count() == 0


def test_language_identification_by_brute_force(spark):
    """Features, prediction and the leader's weights, written out plainly."""
    docs = corpus(spark).filter("doc_id < 240")
    model = langid.fit(docs)
    text = "  Le Renard, le chien! 12 ça "
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    plain = f" {' '.join(letters.split())} "
    counts = Counter(plain[k : k + n] for n in (1, 2, 3) for k in range(len(plain) - n + 1))
    assert len(langid.ngrams(text)) == sum(counts.values()) and len(set(langid.ngrams(text).tolist())) == len(counts)
    columns, values = langid.features(text, np.ones(langid.DIM))
    assert sorted(values.tolist()) == pytest.approx(sorted(math.log1p(n) / math.sqrt(sum(math.log1p(m) ** 2 for m in counts.values())) for n in counts.values()))
    columns, values = langid.features(text, model.idf)
    logits = [sum(v * model.weights[c, k] for c, v in zip(columns, values, strict=True)) / model.temperature for k in range(3)]
    share = [math.exp(x - max(logits)) / sum(math.exp(y - max(logits)) for y in logits) for x in logits]
    assert model.predict(text) == (model.languages[int(np.argmax(share))], pytest.approx(max(share)))
    z, n, rows = {}, {}, [(np.array([1, 5]), np.array([0.6, 0.8]), 0), (np.array([5, 9]), np.array([0.8, 0.6]), 1), (np.array([1]), np.array([1.0]), 0)]
    weight = lambda c, k: 0.0 if abs(z.get((c, k), 0)) <= langid.L1 else (math.copysign(langid.L1, z[c, k]) - z[c, k]) / ((langid.BETA + math.sqrt(n[c, k])) / langid.ALPHA + langid.L2)
    order = np.random.default_rng(7)
    for _ in range(2):
        for at in order.permutation(3):
            columns, values, label = rows[at]
            scores = [sum(v * weight(c, k) for c, v in zip(columns, values, strict=True)) for k in range(2)]
            error = [math.exp(s) / sum(map(math.exp, scores)) - (k == label) for k, s in enumerate(scores)]
            steps = [(c, k, v * error[k], weight(c, k)) for c, v in zip(columns.tolist(), values, strict=True) for k in range(2)]
            for c, k, g, w in steps:
                grown = n.get((c, k), 0) + g * g
                z[c, k] = z.get((c, k), 0) + g - (math.sqrt(grown) - math.sqrt(n.get((c, k), 0))) / langid.ALPHA * w
                n[c, k] = grown
    got = langid.train(rows, 2, 2)
    assert all(got[c, k] == pytest.approx(weight(c, k)) for c in (1, 5, 9, 100) for k in range(2))


def test_rare_languages_and_clashing_columns(spark):
    docs = corpus(spark).withColumns({"columns": F.lit(1), "score": F.lit("x"), "col": F.lit(2)})
    rare = spark.createDataFrame([(1000, "hapax legomenon", "xx"), (1001, "hapax", "xx")], "doc_id long, text string, lang string")
    model = langid.fit(docs.unionByName(rare, allowMissingColumns=True))
    assert model.languages == ("de", "en", "fr")
    assert langid.predict(docs, model).columns == ["doc_id", "lang_pred", "score"]


def test_temperature_cools_overconfident_scores():
    pick = np.random.default_rng(0)
    labels = pick.integers(0, 2, 400)
    right = np.where(pick.random(400) < 0.7, labels, 1 - labels)
    logits = np.stack([np.where(right == 0, 8.0, 0.0), np.where(right == 1, 8.0, 0.0)], axis=1)
    heat = langid.calibrate(logits, labels)
    assert heat > 3 and langid.softmax(logits / heat).max(axis=1).mean() == pytest.approx(0.7, abs=0.06)


def brute_model(texts):
    """P(d | a, b, c) of an interpolated modified Kneser-Ney model, by dictionaries."""
    levels, counts = {}, Counter(g for t in texts for g in brute_grams(t))
    for order in (4, 3, 2, 1):
        n = [0] + [max(1, sum(v == k for v in counts.values())) for k in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0.0] + [min(k, max(0.1, k - (k + 1) * y * n[k + 1] / n[k])) for k in (1, 2, 3)]
        total, taken = Counter(), Counter()
        for g, v in counts.items():
            total[g[:-1]] += v
            taken[g[:-1]] += d[min(v, 3)]
        levels[order] = ({g: max(v - d[min(v, 3)], 0) / total[g[:-1]] for g, v in counts.items()}, {c: taken[c] / total[c] for c in total})
        counts = Counter(g[1:] for g in counts)
    size = len(levels[1][0]) + 1

    def probability(g):
        p = 1 / size
        for order in (1, 2, 3, 4):
            rest, gamma = levels[order]
            part = g[4 - order :]
            p = rest.get(part, 0.0) + gamma.get(part[:-1], 1.0) * p
        return p

    return probability, sorted(levels[1][0])


def brute_grams(text):
    text = "\n\n\n" + re.sub(r"[^\S\n]+", " ", text)
    return [text[k : k + 4] for k in range(len(text) - 3)]


def test_perplexity_by_brute_force(spark, none):
    docs = corpus(spark)
    labels = docs.filter("doc_id < 240").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    junk = spark.createDataFrame([(900, "ZZ## QQ!! " * 60, "en"), (901, "zqxj kvbq " * 60, "xx"), (902, EN * 3, "de"), (903, DE * 3, None)], "doc_id long, text string, lang string")
    rows = docs.unionByName(junk).withColumn("held", perplexity.is_held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in perplexity.judge(rows.withColumns({"model": F.lit("clash"), "gram": F.lit(1)}), labels).collect()}
    held = {r.doc_id: r.held for r in rows.collect()}
    trained = [r for r in docs.collect() if r.doc_id is not None and r.doc_id < 240 and not held[r.doc_id]]
    models = {lang: brute_model([r.text for r in trained if lang in (None, r.lang)])[0] for lang in ("en", "de", "fr", None)}
    for r in rows.collect():
        found = brute_grams(r.text or "")
        assert got[r.doc_id].n_grams == len(found)
        p = models.get(r.lang, models[None])
        expected = math.exp(-sum(map(math.log, map(p, found))) / len(found)) if found else None
        assert got[r.doc_id].perplexity == (pytest.approx(expected) if found else None)
    assert np.mean([got[k].kept for k in range(240) if held[k]]) > 0.95
    assert not any(got[k].kept for k in (900, 901, 902, 240)) and got[240].perplexity is None
    p, characters = brute_model([r.text for r in trained])
    assert sum(p(f"the{c}") for c in characters) + p("the\0") == pytest.approx(1)


def test_perplexity_of_any_plan(spark, none):
    docs = corpus(spark)
    labels = docs.filter("doc_id < 240").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    model = perplexity.fit(perplexity.trusted(docs.select("doc_id", "text", "lang"), labels))
    sent, joined = ({r.doc_id: r.perplexity for r in perplexity.score(docs, model, most).collect()} for most in (10**6, 0))
    assert sent.keys() == joined.keys() and all(sent[k] == pytest.approx(joined[k]) if sent[k] else joined[k] is None for k in sent)
    twice = docs.filter("doc_id < 5").unionByName(docs.filter("doc_id < 5").withColumn("text", F.lit(DE)))
    assert perplexity.score(twice, model).count() == 10
    assert perplexity.trusted(docs, labels, most_broadcast=0).count() == 240
    assert perplexity.judge(none, labels).count() == 0
    assert perplexity.judge(docs, labels.limit(0)).filter("kept or perplexity is not null").count() == 0


def test_toxicity_by_brute_force(spark):
    """Toxic text of a language with a model of its own, and of one without."""
    pick = np.random.default_rng(5)
    mixed = lambda text: " ".join(pick.choice([*text.split(), "zogwump", "krizzle"], size=40))
    bad = spark.createDataFrame([*[(k, mixed(EN), "en") for k in range(300, 420)], *[(k, mixed(DE), "de") for k in range(420, 430)]], "doc_id long, text string, lang string")
    docs = corpus(spark).filter("doc_id < 240").unionByName(bad)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") >= 300).cast("int").alias("toxic"))
    got = {r.doc_id: r for r in perplexity.judge(docs, labels).collect()}
    rows = docs.withColumn("held", perplexity.is_held_out(F.col("doc_id"))).collect()
    taught = {toxic: [r for r in rows if not r.held and (r.doc_id >= 300) == toxic] for toxic in (False, True)}
    texts = lambda toxic, lang: [r.text for r in taught[toxic] if lang in (None, r.lang)]
    models = {lang: [brute_model(texts(toxic, lang))[0] for toxic in (False, True)] for lang in ("en", None)}
    seen = {lang: {g for t in texts(True, lang) for g in brute_grams(t)} for lang in ("en", None)}
    own = {lang: brute_model(texts(False, lang))[0] for lang in ("en", "de", "fr")}

    def weight(g, lang):
        # Other languages' n-grams are met by the weights of the models over all.
        ratio = models[lang][1](g) / models[lang][0](g) if g in seen[lang] else 0
        return math.log(1 - perplexity.SHARE + perplexity.SHARE * ratio) if ratio >= perplexity.LEAST_RATIO else 0.0

    for r in rows:
        found, lang = brute_grams(r.text), "en" if r.lang == "en" else None
        assert got[r.doc_id].toxicity == pytest.approx(sum(weight(g, lang) for g in found) / len(found))
        assert got[r.doc_id].perplexity == pytest.approx(math.exp(-sum(map(math.log, map(own[r.lang], found))) / len(found)))
    held = [r.doc_id for r in rows if r.held]
    assert not any(got[k].kept for k in held if k >= 300) and np.mean([got[k].kept for k in held if k < 240]) > 0.9


def test_toxicity_of_any_plan(spark):
    docs = corpus(spark)
    model, toxic = (perplexity.fit(docs.select("text", "lang").filter(f)) for f in ("doc_id % 5 > 0", "doc_id % 5 = 0"))
    sent, joined = ({r.doc_id: r.toxicity for r in perplexity.score(docs, model, most, toxic).collect()} for most in (10**6, 0))
    assert sent.keys() == joined.keys() and any(sent.values())
    assert all(sent[k] == pytest.approx(joined[k]) if sent[k] is not None else joined[k] is None for k in sent)
    assert not any(r.toxicity for r in perplexity.score(docs, model).collect())


PAGES = [
    ("<body><header><h1>Site</h1></header><nav><a>x</a></nav><main><article><header><h1>A &amp; B</h1></header><p>Hello   <b>bold</b> text<br>line<p>Second<ul><li>one<li>two</ul>"
     "<aside>side</aside><form><input>f</form><section class='comments'><article><p>Nice post, I like it very much, a long comment</p></article></section></article></main><footer>f</footer>", "A & B\nHello bold text line\nSecond\none\ntwo"),
    ("<html><body><div id='cookie-notice'>We use cookies</div><div class=menu><a>Home</a></div><div class='content'><h1>T</h1><p>Long paragraph of text that is the content of the page.</p><p>x</p></div><div class='sidebar'>zzz</div></body>",
     "T\nLong paragraph of text that is the content of the page.\nx"),
    ("", ""), (None, ""), ("<p>", ""), ("plain text only", "plain text only"), ("<article><p>cut <b>off", "cut off"), ("<head><title>t</title><p>body began</p>", "body began"),
    ("<div><p>a</p><div class='ad'>no</div><p>b &lt;c&gt; &nbsp; d</p></div><script>var x='<p>no</p>'", "a\nb <c> d"), ("<style>p{}</style><!-- <p>no</p> --><p>yes &#233;&eacute;</p>", "yes éé"),
]


def test_html_extraction(spark):
    pages = spark.createDataFrame([(k, f"u{k}", h) for k, (h, _) in enumerate(PAGES)] + [(None, None, "<p>z</p>")] * 2, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract_pages(pages).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got if r.page_id is not None) == [(k, t, len(t)) for k, (_, t) in enumerate(PAGES)]
    assert [r.text for r in got if r.page_id is None] == ["z", "z"]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_smoothing_and_threshold():
    assert html_extract.smooth([5.0]) == [5.0] and html_extract.smooth([1.0, 1.0, 1.0]) == pytest.approx([1, 1, 1])
    assert 2 < html_extract.threshold([1, 1, 2, 90, 100]) < 90
