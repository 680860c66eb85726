"""Operators 2, 3, 4 and 9: language ID, language model, search, fingerprints; and the pipeline."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sentimill.llm import languages, queries, search, suffix_tree, syncmers
from sentimill.llm.languages import accepted_documents, declared_in_markup, host, identify, trigram_counts, visible_text
from sentimill.llm.syncmers import anchors, fingerprint_documents, likeness

SF_DIR = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


# ------------------------------------------------------------------ language ID


def test_languages_of_held_out_documents(documents):
    """Learnt from four fifths, nearly all of the rest is right from the text alone."""
    counts = trigram_counts(documents.filter("doc_id % 5 != 0"))
    rows = identify(documents.filter("doc_id % 5 = 0"), counts).collect()
    right = [r["language"] == r["row"]["lang"] for r in rows]
    assert np.mean(right) > 0.97 and not any(r["rejected"] for r in rows if len(r["row"]["text"]) > 40)


def test_query_2(spark, documents):
    rows = queries.op2_bayesian_language_id(spark, SF_DIR).collect()
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    of_docs = [r for r in rows if r["doc_id"] is not None]
    assert {r["doc_id"]: r["language"] for r in of_docs} == lang
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    assert sorted(r["page_id"] for r in rows if r["page_id"] is not None) == sorted(r[0] for r in pages.select("page_id").collect())
    assert all(r["language"] == r["declared"] for r in rows if r["page_id"] is not None)


def test_trigram_counts_against_brute_force(documents):
    learnt, want = trigram_counts(documents), Counter()
    for r in documents.collect():
        for found in languages.trigrams(r["text"]):
            want.update((r["lang"], int(x)) for x in found)
    assert learnt.languages == tuple(sorted({name for name, _ in want}))
    for i, lang in enumerate(learnt.languages):
        assert {x: int(n) for x, n in enumerate(learnt.counts[i]) if n} == {x: n for (name, x), n in want.items() if name == lang}


def softmax(x):
    x = np.exp(np.array(x) - max(x))
    return x / x.sum()


def brute_posterior(rows):
    """Probabilities of the languages of ``(text, host, lang)``, each row against all others."""
    label = lambda x: x.lower() if x and len(x) in (2, 3) and x.isalpha() else None
    grams = [Counter(int(x) for found in languages.trigrams(text or "") for x in found) for text, _, _ in rows]
    names = sorted({label(r[2]) for r, g in zip(rows, grams) if label(r[2]) and g})
    learnt = {name: Counter() for name in names}
    for r, g in zip(rows, grams):
        if label(r[2]) in learnt:
            learnt[label(r[2])].update(g)
    total = {name: sum(learnt[name].values()) for name in names}
    v, s, names = 1 << languages.BITS, languages.SMOOTHING, [*names, "und"]
    even = np.array([(1 - languages.UNKNOWN_PRIOR) / (len(names) - 1)] * (len(names) - 1) + [languages.UNKNOWN_PRIOR])
    evidence, said = [], []
    for r, g in zip(rows, grams):
        sums = []
        for name in names[:-1]:
            mine = label(r[2]) == name
            all_ = total[name] - (sum(g.values()) if mine else 0)
            sums.append(sum(n * math.log((learnt[name][x] - (n if mine else 0) + s) / (all_ + s * v)) for x, n in g.items()))
        sums.append(-sum(g.values()) * math.log(v))
        evidence.append(languages.TEXT_WEIGHT * np.array(sums))
        said.append(softmax(evidence[-1] + np.log(even)) if g else np.zeros(len(names)))

    def others(i, same):
        return sum((said[j] for j, r in enumerate(rows) if j != i and same(r)), np.zeros(len(names)))

    usual = sum((said[j] for j, r in enumerate(rows) if r[2]), np.zeros(len(names)))
    out, weight, wrong = [], languages.LEVEL_WEIGHT, languages.WRONG_DECLARATION
    for i, (_, host_, lang) in enumerate(rows):
        levels = [others(i, lambda r: True)]
        for parts in (1, 2, 99) if host_ else ():
            cut = lambda h: ".".join(h.split(".")[-parts:])  # noqa: B023, E731
            levels.append(others(i, lambda r: r[1] and cut(r[1]) == cut(host_)))  # noqa: B023
        prior = even
        for counted in levels:
            prior = (counted + weight * prior) / (counted.sum() + weight)
        logs = evidence[i] + np.log(prior)
        counted = others(i, lambda r: r[2] == lang) if lang else np.zeros(len(names))  # noqa: B023
        if counted.any() or lang in names:
            believed = np.array([1 - wrong if name == lang else wrong / (len(names) - 1) for name in names])
            if lang not in names:
                believed = np.full(len(names), 1 / len(names))
            share = (counted + weight * believed) / (counted.sum() + weight)
            ratio = np.maximum(share, wrong / len(names)) / ((usual + weight / len(names)) / (usual.sum() + weight))
            ratio[-1] = max(ratio[-1], ratio[:-1].min())
            logs = logs + np.log(ratio)
        out.append(dict(zip(names, softmax(logs))))
    return out


def test_posterior_against_brute_force(spark, documents):
    """Also of rows without text, host or label, of a language with one row, and of labels that name none."""
    rows = [(r["text"], r["source"], r["lang"]) for r in documents.orderBy("doc_id").limit(60).collect()]
    rows += [(rows[0][0], "a.host.org", "fr"), (rows[1][0], "b.host.org", None), ("", "b.host.org", "de"), (None, None, None)]
    rows += [("Um texto em português, sozinho aqui", "host.org", "pt"), ("12 34", "a.host.org", "en"), (rows[3][0], None, "english")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string, lang string")
    got = {r["row"]["doc_id"]: r for r in languages.identify_documents(df, carry=["doc_id"]).collect()}
    for i, want in enumerate(brute_posterior(rows)):
        assert got[i]["probability"] == pytest.approx(max(want.values()), abs=1e-4), i
        assert want[got[i]["language"]] == pytest.approx(max(want.values()), abs=1e-4)


def test_a_wrong_label_does_not_answer_itself(spark, documents):
    """A row labelled wrongly, without an address, is told by the other rows."""
    texts = {r["doc_id"]: (r["text"], r["lang"]) for r in documents.filter("n_chars > 200").collect()}
    wrong = {"de": "en", "en": "fr", "fr": "es", "es": "de"}
    # One short row of each language: what is learnt wrongly must be a small part of its text.
    flipped = {lang: min((len(text), i) for i, (text, x) in texts.items() if x == lang)[1] for lang in wrong}.values()
    rows = [(i, text, None, wrong[lang] if i in flipped else lang) for i, (text, lang) in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["row"]["doc_id"]: r["language"] for r in languages.identify_documents(df, carry=["doc_id"]).collect()}
    assert got == {i: lang for i, (_, lang) in texts.items()}


def test_address_and_declaration_decide_where_the_text_does_not(spark, documents):
    counts = trigram_counts(documents)
    texts = {r["lang"]: r["text"] for r in documents.filter("n_chars > 200").collect()}
    rows = [(i, texts["de"], "www.seite.de", "de") for i in range(60)] + [(100 + i, texts["en"], "page.com", "en") for i in range(60)]
    rows += [(200, "12 34", "www.seite.de", None), (201, "12 34", "neu.seite.de", None), (202, "12 34", "andere.de", None)]
    rows += [(203, "12 34", "page.com", None), (204, "", None, "de"), (205, texts["en"], "www.seite.de", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, site string, said string")
    got = {r["row"]["doc_id"]: r for r in identify(df, counts, host_name=F.col("site"), declared=F.col("said")).collect()}
    assert [got[i]["language"] for i in (200, 201, 202, 203, 204)] == ["de", "de", "de", "en", "de"]
    # A host of its own says more than its domain, this more than its suffix.
    assert got[200]["probability"] >= got[201]["probability"] >= got[202]["probability"]
    assert got[205]["language"] == "en"  # a long text outweighs both


def test_parts_of_pages(spark):
    rows = [
        ("http://user@WWW.Example.org:80/a?x=//b", '<!DOCTYPE html><HTML class=x LANG="de-AT"><script>if (a<b) x()</script>Gr&uuml;n<br>'),
        ("//host.net/x", "<html><body lang=fr>"),
        ("no address", None),
        (None, '<html xml:lang=\'es\' data-lang="x">'),
    ]
    got = spark.createDataFrame(rows, "url string, html string").select(host(F.col("url")), declared_in_markup(F.col("html")))
    assert [tuple(r) for r in got.collect()] == [("www.example.org", "de"), ("host.net", None), (None, None), (None, "es")]
    assert visible_text(rows[0][1]).split() == ["Grün"]


def test_text_of_no_language_and_odd_rows(spark, documents, odd, empty):
    counts = trigram_counts(documents)
    strange = spark.createDataFrame([(1, "это русский текст, совсем не тот"), (2, "qzx jkq wvx zzq xqj kqz vvx")], "doc_id long, text string")
    assert [r["language"] for r in identify(strange, counts).collect()] == ["und", "und"]
    assert all(r["rejected"] for r in identify(strange, counts).collect())
    rows = identify(odd, counts, host_name=F.col("source"), declared=F.col("lang")).collect()
    assert len(rows) == odd.count() and all(0 < r["probability"] <= 1 for r in rows)
    assert identify(empty, trigram_counts(empty)).count() == 0 and accepted_documents(empty).count() == 0
    assert accepted_documents(odd).columns == odd.columns
    assert accepted_documents(documents).count() == documents.count()


# --------------------------------------------------------------- language model

END = "\0end"


def brute_tree(texts, depth=2):
    """The tree of the module, from counters."""
    tokens = [[*words(t), END] for t in texts]
    one = Counter(w for t in tokens for w in t)
    n, v = sum(one.values()), len(one)
    root = lambda w: (one[w] + 1) / (n + v + 1)
    states = {}

    def probability(context, word):
        p = root(word)
        for length in range(1, len(context) + 1):
            state = states.get(context[-length:])
            if state:
                rest, own = state
                p = own.get(word, 0.0) + rest * p
        return p

    counts = {length: defaultdict(Counter) for length in range(1, depth + 1)}
    n_context = {length: Counter() for length in range(1, depth + 1)}
    for t in tokens:
        padded = ["begin"] * depth + t
        for i, word in enumerate(t):
            for length in range(1, depth + 1):
                context = tuple(padded[depth + i - length : depth + i])
                n_context[length][context] += 1
                counts[length][context][word] += 1
    for length in range(1, depth + 1):
        found = {}
        for context, total in n_context[length].items():
            if total < suffix_tree.LEAST_CONTEXT or (length > 1 and (context[1:] not in states or context[-1] == "begin")):
                continue
            own = {w: c for w, c in counts[length][context].items() if c >= suffix_tree.LEAST_NEXT}
            if not own:
                continue
            shares = {w: c / total for w, c in own.items()}
            parents = {w: probability(context[1:], w) for w in own}
            left, left_parent = max(1 - sum(shares.values()), 1e-12), max(1 - sum(parents.values()), 1e-12)
            divergence = sum(s * math.log(s / parents[w]) for w, s in shares.items()) + left * math.log(left / left_parent)
            if total * divergence > suffix_tree.PENALTY * len(own):
                rest = 1 - sum((c - suffix_tree.DISCOUNT) / total for c in own.values())
                found[context] = (float(np.float32(rest)), {w: float(np.float32((c - suffix_tree.DISCOUNT) / total)) for w, c in own.items()})
        states.update(found)
    return n, v, one, probability, states


@pytest.mark.parametrize("broadcast_bytes", [512 << 20, 0])
def test_scores_against_brute_force(spark, documents, monkeypatch, broadcast_bytes):
    """From arrays and from joins."""
    monkeypatch.setattr(suffix_tree, "LEAST_CONTEXT", 20)
    monkeypatch.setattr(suffix_tree, "GATHERED", 500)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    n, v, one, probability, states = brute_tree([t for d, t in texts.items() if not held[d]])
    learnt = suffix_tree.learn(documents.filter(~suffix_tree.held_out(F.col("doc_id"))))
    assert sum(s.count() for s in learnt.states) == len(states) and {len(s) for s in states} == {1, 2}
    got = {r["doc_id"]: r for r in suffix_tree.score(learnt, documents, broadcast_bytes).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        tokens, r = [*words(text), END], got[d]
        padded = ["begin", "begin", *tokens]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[d], len(tokens), n)
        assert r["n_known"] == sum(one[w] > 0 for w in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in tokens))
        mine = sum(math.log10(probability(tuple(padded[i : i + 2]), w)) for i, w in enumerate(tokens))
        assert r["score"] == pytest.approx(mine, rel=1e-5)


def test_distributions_sum_to_one(monkeypatch, documents):
    monkeypatch.setattr(suffix_tree, "LEAST_CONTEXT", 20)
    _, _, one, probability, states = brute_tree([r["text"] for r in documents.collect()])
    for context in list(states)[:8]:
        assert sum(probability(context, w) for w in one) + probability(context, "not seen") == pytest.approx(1, abs=1e-5)


def test_the_tree_is_better_than_single_words(spark):
    scored = queries.op3_probabilistic_suffix_tree(spark, "/root/testdata/sf0.01").filter("held_out")
    base, own = scored.agg(F.sum("base_score"), F.sum("score")).first()
    assert base < own < 0


def test_scores_of_odd_rows(odd, empty):
    rows = suffix_tree.score_documents(odd).collect()
    assert len(rows) == odd.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    assert all(r["score"] < 0 and not r["held_out"] for r in rows if r["doc_id"] is None)
    assert suffix_tree.score_documents(empty).count() == 0
    unlearnt = suffix_tree.score(suffix_tree.learn(empty), odd.select("doc_id", "text")).collect()
    assert all(r["n_known"] == 0 and r["score"] == r["base_score"] == 0.0 for r in unlearnt)


# ----------------------------------------------------------------------- search


def brute_search(texts, ids, top=10):
    bags = {d: Counter(words(t)) for d, t in texts.items()}
    n, average = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    postings = defaultdict(list)
    for d, b in bags.items():
        length = sum(b.values())
        for w, c in b.items():
            postings[w].append((d, c * 2.2 / (c + 1.2 * (0.25 + 0.75 * length / average))))
    for q in ids:
        scores = Counter()
        for w in bags[q]:
            for d, part in postings[w]:
                scores[d] += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * part
        yield q, sorted(((-round(s, 7), d) for d, s in scores.items()))[:top]


@pytest.mark.parametrize("shard, block, query_words", [(1 << 13, 64, 1 << 19), (20, 4, 300)])
def test_search_against_brute_force(spark, documents, monkeypatch, shard, block, query_words):
    """Also with many shards, blocks and query blocks."""
    for name, value in (("SHARD_DOCS", shard), ("BLOCK_DOCS", block), ("QUERY_WORDS", query_words)):
        monkeypatch.setattr(search, name, value)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = defaultdict(list)
    for r in search.search(documents, F.col("doc_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-round(r["score"], 7), r["doc_id"]))
    for q, want in brute_search(texts, [d for d in texts if d % 10 == 0]):
        assert got[q] == want


def test_query_4(spark, documents):
    rows = queries.op4_block_max_wand(spark, SF_DIR).collect()
    assert {r["query_id"] for r in rows} == {r["doc_id"] for r in documents.collect() if r["doc_id"] % 50 == 0}
    assert all(r["doc_id"] == r["query_id"] or r["score"] > 0 for r in rows)


def test_search_of_odd_rows(odd, empty):
    rows = search.search(odd, F.lit(True)).collect()
    assert not any(r["query_id"] in (2, 3, 4) or r["doc_id"] in (2, 3, 4) for r in rows)
    first = [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == 8]
    assert first[:3] == [1, 1, 8]
    assert search.search(empty, F.lit(True)).count() == 0 and search.search(odd, F.lit(False)).count() == 0


# ----------------------------------------------------------------- fingerprints


def test_anchors_are_closed_syncmers(documents):
    text = documents.filter("n_chars > 300").first()["text"][:300]
    codes = np.array([ord(c) for c in text], np.uint64)
    inner = syncmers._run_hashes(codes, syncmers.S).tolist()
    width = syncmers.K - syncmers.S + 1
    want = [i for i in range(len(text) - syncmers.K + 1) if min(inner[i : i + width]) in (inner[i], inner[i + width - 1])]
    assert anchors(text)[0].tolist() == want


def test_a_passage_has_the_same_anchors_everywhere(documents, monkeypatch):
    a, b, passage = (r["text"] for r in documents.filter("n_chars > 500").limit(3).collect())
    at, hashes = anchors(passage)
    for text, start in ((a + passage, len(a)), (passage + b, 0), (a + passage + b, len(a))):
        inside = dict(zip(*(x.tolist() for x in anchors(text))))
        assert all(inside[start + i] == h for i, h in zip(at.tolist(), hashes.tolist()))
    assert syncmers.shared_anchors(passage, a + passage)[0][0] == len(a)
    whole = anchors(a * 5)
    monkeypatch.setattr(syncmers, "BLOCK", 100)
    assert all((x == y).all() for x, y in zip(anchors(a * 5), whole))


def check_fingerprints(rows, got):
    """``rows`` in the order of the contract."""
    assert len(got) == len(rows)
    want = Counter()
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = (anchors(x)[1] for x in (text, edited, following))
        spell = lambda x: base64.b64encode(x.tobytes()).decode()
        want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), spell(own), spell(other), likeness(own, other), likeness(own, after)] += 1
    assert Counter(tuple(r) for r in got) == want


def test_query_9_against_brute_force(spark, documents):
    rows = sorted(((r["doc_id"], r["text"]) for r in documents.collect()), reverse=True)
    got = queries.op9_closed_syncmers(spark, SF_DIR).collect()
    check_fingerprints(rows, got)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.95


def test_fingerprints_of_odd_rows(spark, odd, empty):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    check_fingerprints(rows, fingerprint_documents(odd).collect())
    assert fingerprint_documents(empty).count() == 0
    one = fingerprint_documents(spark.createDataFrame([(1, "ab")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"aa").hexdigest()


# --------------------------------------------------------------------- pipeline


def test_stages(spark, documents):
    docs, columns = documents, documents.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == columns and docs.schema == before.schema, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).filter("length > 1024 or offset + length > 1024").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near dedup", "mixing", "packing"]


def test_stages_on_odd_and_empty_rows(spark, odd, empty):
    for rows in (odd, empty):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
            assert docs.columns == rows.columns
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() > 0) == (rows is odd)
