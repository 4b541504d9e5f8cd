"""Mixing, quality rules, shards, token lengths, languages, pages and leaks on small tables."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spellpanel.llm import decontaminate, extraction, langid, mixing, neardup, quality, queries, sharding, tokens
from spellpanel.llm.arrays import word_hashes

DOCS = "doc_id long, text string, lang string, source string"
ODD = [(1, None, None, None), (2, "", "en", None), (None, "a b c", None, "s1"), (3, "a b c", "en", "s1"),
       (3, "a b c", "en", "s1"), (4, "word " * 3000, "de", "s2"), (5, " \n ", None, "s2")]


@pytest.mark.parametrize("name", ["op2_mix_sources", "op3_quality_rules", "op10_shard_documents"])
def test_twins(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    out = queries.QUERIES[name](spark, small)
    cols = sorted(out.columns)
    got = sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in map(tuple, out.select(cols).collect()))
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert got == sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in want)


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in ODD], DOCS + ", size string")
    none = docs.limit(0)
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, None), (4, None, 1)], "doc_id long, quality int, toxic int")
    for run in (mixing.mix_sources, sharding.shard_documents, langid.identify,
                lambda d: quality.quality_rules(d, labels), lambda d: quality.quality_rules(d, labels.limit(0))):
        assert run(docs).count() == len(ODD) and run(none).count() == 0
    assert quality.quality_filter(docs, labels).columns == docs.columns
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(none).count() == 0


def test_stages_keep_columns_of_any_name(spark, small):
    """Own names of the operators, and names with dots and blanks, as extra columns."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "by_words",
             "by_lines", "symbol_share", "kept", "_stratum", "_cut", "_of", "_row", "_size", "_id", "_source", "_of_size",
             "_times", "_pass", "_key", "size", "key", "a.b", "two words", "back`tick"]
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    quoted = {n: F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")) for n in names}
    wide = docs.select("*", *[v.alias(n) for n, v in quoted.items()])
    labels, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("labels", "benchmark"))
    for run in (lambda d: quality.quality_filter(d, labels), neardup.deduplicated,
                lambda d: decontaminate.decontaminated(d, items), mixing.mixed_documents):
        out = run(wide)
        assert out.columns == wide.columns
        got = [r.asDict() for r in out.collect()]
        assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in run(docs).collect()) and got
        assert all(r[n] == f"{n} {r['doc_id']}" for r in got for n in names)


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 3}") for i in range(300)]
    mix = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    for s in ("s0", "s1", "s2"):
        own = [r for r in mix if r["source"] == s]
        assert sum(r["taken"] for r in own) == round(own[0]["target"])
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    t = mixing.source_targets(spark.createDataFrame([("a", 10), ("b", 1000), (None, 10)], "source string, source_size long"))
    got = {r["source"]: r["target"] for r in t.collect()}
    assert got["a"] == 20 and got[None] == 20 and got["b"] == pytest.approx(1.5 * 1020 - 40)


def test_shards_are_equal_and_keep_copies_together(spark):
    draw = random.Random(1)
    rows = [(i, "x" * draw.randrange(10, 400) + str(i), None, None) for i in range(3000)]
    rows += [(5000 + i, "copy of a text", None, None) for i in range(25)] + [(9000 + i, "hot " * 40, None, None) for i in range(1500)]
    out = sharding.shard_documents(spark.createDataFrame(rows, DOCS)).collect()
    size = [0] * 40
    slots = [[] for _ in range(40)]
    for r in out:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(size) / 40
    assert max(size) < 1.1 * mean and min(size) > 0.9 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert len({r["shard"] for r in out if 5000 <= r["doc_id"] < 6000}) == 1


def test_binomial_tail(spark):
    rows = [(float(k), float(n)) for n in (20, 500, 40_000) for k in (0, 1, n // 200, n // 120)]
    got = spark.createDataFrame(rows, "k double, n double").select(
        "k", "n", quality.lower_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in got:
        n, k = int(r["n"]), int(r["k"])
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                             + i * math.log(0.01) + (n - i) * math.log(0.99)) for i in range(k + 1))
        assert r["p"] == pytest.approx(exact if k < n * 0.01 else 1.0, rel=1e-6)


def test_cutoffs_keep_the_risk(spark):
    good = [(i, "plain words of a text here " * 5 + f"end{i} " + "".join(f"v{i}{j} " for j in range(60)), "en", "s") for i in range(1500)]
    bad = [(5000 + i, "".join(f"w{i}x{j}### " for j in range(80)), "en", "s") for i in range(300)]
    docs = spark.createDataFrame(good + bad, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[0] < 5000)) for r in good + bad], "doc_id long, quality int")
    out = quality.quality_rules(docs, labels).collect()
    failed = [r for r in out if r["base_failed"]]
    assert sum(r["kept"] for r in out if r["doc_id"] >= 5000) == 0
    lost = sum(not r["kept"] and not r["base_failed"] for r in out if r["doc_id"] < 5000)
    assert lost <= 0.05 * (len(good) - len(failed))


def test_token_answers(spark):
    lengths = spark.createDataFrame([(n,) for n in (0, 0, 3, 3, 7, 5000, 90_000)], "n_tokens long")
    answers = tokens.histogram_answers(tokens.length_histogram(lengths))
    all_ = [0, 0, 3, 3, 7, 5000, 90_000]
    for r in answers.collect():
        assert r["docs_within"] == sum(x <= r["n_tokens"] for x in all_)
        assert r["tokens_over"] == sum(x for x in all_ if x > r["n_tokens"])
        assert r["truncated_tokens"] == sum(min(x, r["n_tokens"]) for x in all_)
    for r in tokens.at_limits(answers, [1, 5, 6000, 10**6]).collect():
        assert r["truncated_tokens"] == sum(min(x, r["limit_tokens"]) for x in all_)
    assert {r["share"]: r["n_tokens"] for r in tokens.quantile_lengths(answers, [0.5, 1.0]).collect()} == {0.5: 3, 1.0: 90_000}


def test_token_lengths_equal_the_tokenizer(spark, small):
    import base64

    import tiktoken

    docs = spark.read.parquet(f"{small}/documents.parquet").select("text").limit(40)
    docs = docs.unionByName(spark.createDataFrame([(None,), ("",), ("<|endoftext|> x",)], "text string"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VOCABULARY, "rb"))}
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(len(own.encode_ordinary(r["text"] or "")) for r in docs.collect())
    assert sorted(r["n_tokens"] for r in tokens.token_lengths(docs, queries.VOCABULARY, tokens.PATTERN).collect()) == want


def test_language_is_found_in_the_fold_never_learned_from(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "123 !? \n", "en"), (10**6 + 2, "", None)], docs.schema)
    out = langid.identify(docs.unionByName(odd)).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in out if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held) > 0
    assert all(r["lang_pred"] == "und" for r in out if r["doc_id"] >= 10**6)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_code_words_are_far_apart():
    for n in (2, 4, 7, 30):
        m = langid.code_words(n)
        assert m.shape[0] == n and len({tuple(r) for r in m}) == n
        assert not (abs(m.sum(axis=0)) == n).any()


def page(i, article, host="h.example.org"):
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news"))
    return (i, f"https://{host}/p/{i}", f'<html><head><title>t</title><script>x="<p>"</script></head><body><nav><ul>{menu}</ul>'
            f'</nav><div class="ad box">buy {i}</div><div id="wrap"><article>{article}<section class="comments"><p>me {i}</p></section>'
            f"</article></div><form><input>send</form><footer>&copy; all</footer></body>")


def test_pages(spark):
    rows = [page(i, f"<h1>Title&nbsp;{i}</h1><p>Some  text &amp;\n more {i}<p>second <b>bold</b>{i}") for i in range(12)]
    rows += [page(50, "<p>alone</p>", "other"), (51, None, None), (52, "x", ""), (53, "http://bare", "just text"), rows[0]]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = extraction.extract_main_text(docs).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i in range(12):
        assert by[i]["text"] == f"Title {i}\n\nSome text & more {i}\n\nsecond bold{i}" and by[i]["by_template"]
    assert by[50]["text"] == "alone" and by[51]["text"] == "" and by[52]["n_chars"] == 0 and by[53]["text"] == "just text"
    assert extraction.extract_main_text(docs.limit(0)).count() == 0


def test_pages_of_copies(spark):
    """A repeated article is no template: exact copies alone, beside another page, as repeated rows, and near copies."""
    art = "<h1>The same title</h1><p>The same text of some length</p><p>and its end</p>"
    want = "The same title\n\nThe same text of some length\n\nand its end"
    rows = [page(i, art, "copies") for i in range(6)] + [page(10 + i, art, "mixed") for i in range(5)]
    rows += [page(20, "<p>another</p>", "mixed")] + [page(30, art, "rows")] * 7
    rows += [page(40 + i, f"{art}<p>seen {i}</p>", "near") for i in range(8)]
    rows += [page(60 + i, f"<p>A long enough own text of page {i * 7919}</p><p>All rights kept</p>", "real") for i in range(8)]
    got = extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["page_id"]
        if i < 40 and i != 20:
            assert r["text"] == want and r["n_chars"] == len(want)
        elif 40 <= i < 60:
            assert r["text"] == f"{want}\n\nseen {i - 40}"
        elif i >= 60:
            assert r["text"] == f"A long enough own text of page {(i - 60) * 7919}" and r["by_template"]


#: Bodies of pages and the blocks of their article.
KEPT = [
    ("<article><h2 id='social-history'>Past</h2><section id='search-methods'><p>How we searched.</p></section></article>",
     ["Past", "How we searched."]),
    ("<article><div class='article-header'><h1>Title</h1></div><p data-id='social history'>Body.</p></article>", ["Title", "Body."]),
    ("<article><div class='header'><h1>Title</h1></div><p>Body.</p><div class='share-buttons'>Tell all</div></article>",
     ["Title", "Body."]),
    ("<svg width='1'/><article><p>After a drawing.</p></article>", ["After a drawing."]),
    ("<svg><text>drawn</text></svg><object><article><p>After an open object.</p></article>", ["After an open object."]),
    ("<article><p>Let <math><mi>x</mi></math> be one.</p></article>", ["Let x be one."]),
    ("<div><h1>Title.</h1><p>Lead.</p><div><p>" + "Body of some length. " * 20 + "</p></div></div>",
     ["Title.", "Lead.", ("Body of some length. " * 20).strip()]),
    ("<main><h1>Title</h1><article><p>" + "Body. " * 40 + "</p></article></main>", ["Title", ("Body. " * 40).strip()]),
    ("<nav><ul><li>never closed<main><p>Main part.</p></main>", ["Main part."]),
    ("<div class='ad'/><p>After an empty advert.</p>", ["After an empty advert."]),
    ("<div class='site-header'>Name</div><div id='cookie-box'>We bake</div><p>Text.</p><div class='comment-list'>me too</div>",
     ["Text."]),
    ("<p>Before.</p><script>var a = '<p>no</p>'", ["Before."]),
    ("<article><p>Post one.</p></article><article><p>Post two.</p></article><article class='comment'>me</article>",
     ["Post one.", "Post two."]),
]


def test_pages_keep_their_article(spark):
    """Alone on a host, and on a host of six pages of the same layout."""
    rows = [(100 * k, f"http://h{k}/", f"<body>{body}</body>") for k, (body, _) in enumerate(KEPT)]
    rows += [(100 * k + i, f"http://host{k}/{i}", f"<html><body>{body.replace('.', f' no{i * 31}.')}</body></html>")
             for k, (body, _) in enumerate(KEPT) for i in range(1, 7)]
    got = extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        k, i = divmod(r["page_id"], 100)
        want = "\n\n".join(KEPT[k][1])
        assert r["text"] == (want.replace(".", f" no{i * 31}.") if i else want), r
        assert r["n_chars"] == len(r["text"])


def test_leaks(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text")
    first = items.orderBy("item_id").limit(6).collect()
    host = docs.filter("length(text) > 2000").orderBy("doc_id").limit(6).collect()
    planted, want = [], set()
    for k, (d, item) in enumerate(zip(host, first)):
        w = item["text"].split()
        if k % 2:  # a paraphrase: one word in ten is another
            w = [f"other{j}" if j % 10 == 5 else x for j, x in enumerate(w)]
        planted.append((10**6 + k, d["text"][:900] + " " + " ".join(w) + " " + d["text"][900:1800]))
        want.add((10**6 + k, item["item_id"]))
    odd = [(10**6 + 90, None), (10**6 + 91, ""), (None, "a b")]
    every = docs.unionByName(spark.createDataFrame(planted + odd, "doc_id long, text string"))
    got = decontaminate.contaminated(every, items.unionByName(spark.createDataFrame([(-5, None), (-6, " ")], items.schema)))
    pairs = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert want <= pairs
    assert {p for p in pairs if p[0] and p[0] >= 10**6} == want
    kept = decontaminate.decontaminated(every, items)
    assert kept.filter("doc_id >= 1000000").count() == 2 and kept.filter("doc_id is null").count() == 1
    assert decontaminate.contaminated(every.limit(0), items).count() == 0
    assert decontaminate.contaminated(every, items.limit(0)).count() == 0


def test_word_weights_do_not_follow_the_tasks(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    one, many = (decontaminate.word_weights(docs.repartition(k)) for k in (1, 7))
    assert one[1] == many[1] and (one[0] == many[0]).all()
    copies = decontaminate.word_weights(docs.union(docs).repartition(5))
    assert (copies[0] == one[0]).all() and copies[1] == 2 * one[1]


def test_marks_alone_are_no_letters():
    assert langid.grams(["\u0301\u0301 12", "e\u0301", "\u5929", "\u3002", None])[2] == [False, True, True, False, False]


def test_latent_space_is_fitted_on_every_passage(spark):
    """A word of one text among many shapes the space, and products over halves are those of whole passages."""
    pick = np.random.default_rng(3).integers(0, 400, (30_000, 24))
    texts = [" ".join(f"word{k}" for k in row) for row in pick]
    for i in range(100):
        texts[i * 300] += f" rare{i}"
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    idf, n = decontaminate.word_weights(docs)
    space = decontaminate.latent_space(docs, docs.limit(0), idf)
    rare, _ = word_hashes([" ".join(f"rare{i}" for i in range(100)).encode()])
    assert n == 30_000 * 24 + 100
    assert np.abs(space[(rare % np.uint64(decontaminate.FEATURES)).astype(int)]).max(axis=1).min() > 0

    words, at = word_hashes([t.encode() for t in [" ".join(texts[:5]), "", "one", texts[7], " ".join(texts[8:70])]])
    weight = np.random.default_rng(4).random(decontaminate.FEATURES).astype(np.float32) + np.float32(0.1)
    right = np.random.default_rng(5).standard_normal((decontaminate.FEATURES, 3)).astype(np.float32)
    features, rows = decontaminate.passage_product(words, at, weight, right * weight[:, None])
    got, want = np.zeros(right.shape), np.zeros(right.shape)
    got[features] = rows * weight[features, None]
    for a, b in zip(at[:-1], at[1:]):
        k = max(-(-max(b - a - 6, 1) // 12), 1)  # halves of twelve words; a shorter end belongs to the last one
        edges = [a + 12 * i for i in range(k)] + [b]
        for i in range(max(k - 1, 1) if b > a else 0):
            f = (words[edges[i] : edges[min(i + 2, k)]] % np.uint64(decontaminate.FEATURES)).astype(int)
            row = np.zeros(decontaminate.FEATURES)
            np.add.at(row, f, weight[f])
            row /= np.sqrt((weight[f].astype(float) ** 2).sum())
            want += np.outer(row, row @ right)
    assert np.abs(got - want).max() < 1e-4 * np.abs(want).max()


def test_leaks_without_id(spark, small):
    """A row without an id, or of an id that another text has too, is judged by its own text."""
    items = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").limit(2)
    leak = items.first()["text"]
    rows = [(None, f"Before it. {leak}"), (None, "plain words"), (4, leak), (4, "another text"), (5, None)]
    kept = decontaminate.decontaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted(str(tuple(r)) for r in kept) == sorted(map(str, [rows[1], rows[3], rows[4]]))


def test_leaks_recall(spark, small):
    """Items of 8 to 150 words planted at random places, against a search for common subsequences in all windows."""
    from spellpanel.llm.arrays import word_hashes

    def hashed(text):
        return word_hashes([text.encode()])[0]

    def brute(doc, item, answer):
        n = len(item)
        for a in range(0, max(len(doc) - n, 0) + 1, max(n // 4, 1)):
            region = doc[a : a + 2 * n]
            common = decontaminate.common_length(item, region)
            if common >= 0.8 * n or (common >= 0.6 * n and decontaminate.common_length(answer, region) == len(answer)):
                return True
        return False

    draw = random.Random(11)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    long = [r["text"].split() for r in docs.orderBy("doc_id").collect() if len((r["text"] or "").split()) > 200]
    items = [(r["item_id"], r["text"].split()) for r in
             spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").limit(60).collect()]
    for k, n in enumerate([8, 12, 100, 150] * 10):
        at = draw.randrange(len(long[k]) - n)
        items.append((10**6 + k, long[k][at : at + n]))
    pool, planted, kinds = long[len(long) // 2 :], [], {}
    for item_id, words in items:
        for kind in ("verbatim", "most", "answer"):
            w, n = list(words), len(words)
            free = list(range(n)) if kind == "most" else list(range(n - len(decontaminate.answer_words(" ".join(w)).split())))
            lost = {"verbatim": 0, "most": n // 5, "answer": min(2 * n // 5, len(free))}[kind]
            for j in draw.sample(free, lost):
                w[j] = draw.choice(draw.choice(pool))
            host = draw.choice(pool)
            at = draw.randrange(len(host))
            doc_id = 10**6 + len(planted)
            planted.append((doc_id, " ".join(host[:at] + w + host[at:])))
            kinds[doc_id] = (item_id, kind, 0 if n < 16 else 1 if n < 30 else 2 if n < 100 else 3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    every = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(every, bench).collect()}
    text = {i: " ".join(w) for i, w in items}
    tally = {}
    for doc_id, body in planted:
        item_id, kind, length = kinds[doc_id]
        if brute(hashed(body), hashed(text[item_id]), hashed(decontaminate.answer_words(text[item_id]))):
            tally.setdefault((kind, length), []).append((doc_id, item_id) in got)
    print({k: f"{sum(v)}/{len(v)}" for k, v in sorted(tally.items())})
    assert len(tally) == 12 and all(sum(v) >= 0.9 * len(v) for v in tally.values())


def test_every_operator_has_a_query():
    names = entry.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def test_pipeline_against_its_parts(spark, small):
    import corpus_pipeline as c

    import brute

    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = c.run(spark, small).collect()
    labels, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("labels", "benchmark"))
    good = {r["doc_id"] for r in quality.quality_rules(docs, labels).filter("kept").collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    once = {d for d, (_, comp) in brute.near_duplicates(texts, 5, 80).items() if d == comp}
    rest = docs.filter(F.col("doc_id").isin(list(once)))
    leaks = {r["doc_id"] for r in decontaminate.contaminated(rest, items).collect()}
    mix = mixing.mix_sources(rest.filter(~F.col("doc_id").isin(list(leaks) or [-1]))).filter("taken > 0").collect()
    want = sorted(r["doc_id"] for r in mix for _ in range(-(-r["taken"] // r["size"])))
    assert sorted(r["doc_id"] for r in out) == want
