"""Operators 11, 12 and 13: against SQL and brute force, with every kind of odd row."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from oracle import compare
from pyspark.sql import functions as F

from sentimill.llm import hard_negatives as mining, quality_rules, queries, spelling
from sentimill.llm.hard_negatives import emitted, hard_negatives
from sentimill.llm.quality_rules import Rule, good_documents, judge, rules_of
from sentimill.llm.spelling import near_pairs, scan, shared_prefix, spelling_forms, spelling_variants

# --------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def whole(vector):
    return [math.floor(256 * x) for x in vector]


def brute_negatives(rows, anchor=lambda i: i % 50 == 0):
    """All rows of the result, by every pair of an anchor and a row."""
    usable = [
        (i, whole(v), label)
        for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for at, (i, v, label) in enumerate(usable):
        if i is None or not anchor(i):
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, other) for k, (j, w, other) in enumerate(usable) if k != at]
        for score, j, _ in sorted([s for s in scored if s[2] == label], key=order)[: mining.POSITIVES]:
            fits = [s for s in scored if s[2] != label and 50 * score <= 100 * s[0] <= 95 * score]
            out += [(i, j, rank, n[1], score, n[0]) for rank, n in enumerate(sorted(fits, key=order)[: mining.NEGATIVES], 1)]
    return Counter(out)


def mined(rows, step=50):
    return Counter(tuple(r) for r in hard_negatives(rows, F.col("vec_id") % step == 0).collect())


def random_vectors(seed, n, width=4, labels=3, scale=2):
    rng = random.Random(seed)
    return [(i, [rng.randint(-scale, scale) / 4 for _ in range(width)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 7, 1])
def test_negatives_against_brute_force(spark, monkeypatch, block):
    """Few values, so that most scores are ties; also over many blocks of rows and of anchors."""
    monkeypatch.setattr(mining, "BLOCK_ROWS", block)
    rows = random_vectors(block, 60 if block > 1 else 12)
    frame = spark.createDataFrame(rows, VECTORS)
    got = mined(frame, 5)
    assert got == brute_negatives(rows, lambda i: i % 5 == 0) and got


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_negatives_of_embeddings(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    name = "op11_hard_negatives"
    assert compare(queries.queries()[name](spark, f"/root/testdata/{sf}"), db, queries.oracle_sql()[name]) is None


def test_negatives_of_odd_rows(spark):
    """Nulls everywhere, no finite value, vectors of several lengths, repeated rows and ids, other columns."""
    rng = random.Random(2)
    vector = lambda n: [rng.randint(0, 4) / 4 for _ in range(n)]
    rows = [(i, vector(rng.choice([0, 2, 3])), rng.randrange(2)) for i in range(20)]
    rows += [(0, [1.0, 1.0], 0), (0, [1.0, 1.0], 0), (0, [1.0, 0.5, 1.0], 1), (None, [1.0, 1.0], 0), (None, [1.0, 0.75], 1)]
    rows += [(50, None, 1), (50, [1.0], None), (50, [math.nan, 1.0], 0), (50, [math.inf, 1.0], 1), (100, [None, 1.0], 0)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("row", "score", "anchor", "wanted", "r", "a")})
    got = mined(frame)
    assert got == brute_negatives(rows) and {r[0] for r in got} == {0} and any(r[1] is None for r in got)
    assert hard_negatives(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives(frame, F.lit(False)).count() == 0


def test_negatives_of_large_numbers(spark):
    """Sums beyond 2**53 are exact, those beyond a long end at its bounds."""
    rows = [(0, [1e7, 1.0], 0), (1, [1e6, 3.0], 0), (2, [0.9e6, 1.0], 1), (3, [0.9e6, 0.75], 1), (4, [0.4e6, 9.0], 1)]
    frame = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    got = mined(frame)
    assert got == brute_negatives(rows) and len(got) == 2
    huge = spark.createDataFrame([(0, [1e308], 0), (1, [1e308], 0), (2, [1e308], 1)], VECTORS.replace("float", "double"))
    assert mined(huge) == Counter()  # equal scores at the bound: above the window


def test_windows_open_and_close_on_the_stream():
    """Keys of two anchors; a negative can fit several windows, a full one takes no more."""
    keys = [(1, True, 10, 10, 100), (1, False, 20, 20, 96), (1, False, 21, 21, 95), (1, True, 11, 11, 90)]
    keys += [(1, False, 22, 22, 85), (1, False, 23, 23, 84), (1, False, 24, 24, 83), (1, False, 25, 25, 44), (2, False, 20, 20, 50)]
    keys += [(2, True, 30, 30, 0), (2, False, 31, 31, 0), (2, True, 32, 32, -5), (2, False, 33, 33, -4)]
    assert list(emitted(iter(keys))) == [
        (1, 10, 1, 21, 95), (1, 10, 2, 22, 85), (1, 11, 1, 22, 85), (1, 10, 3, 23, 84), (1, 11, 2, 23, 84), (1, 11, 3, 24, 83),
        (2, 30, 1, 31, 0),
    ]


# ---------------------------------------------------------------- quality rules


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_figures(text):
    found = words(text)
    windows = defaultdict(list)
    for i in range(len(found) - 4):
        windows[tuple(found[i : i + 5])].append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered)


def test_figures_of_documents(documents):
    rows = judge(documents).collect()
    assert len(rows) == documents.count()
    for r in rows:
        n, *others = base_figures(r["row"]["text"])
        assert [r[c] for c in quality_rules.BASE] == [n, *others]
        assert r["base_failed"] == (n < 10 or 100 * others[-1] > 20 * n)


def test_rules_against_sql(spark, documents, odd):
    for name, frame in (("given", documents), ("odd", odd)):
        db = duckdb.connect()
        db.register("documents", frame.select("doc_id", "text").toArrow())
        judged = judge(frame)
        got = judged.select("row.doc_id", *[c for c in judged.columns if c != "row"])
        assert compare(got, db, quality_rules.sql()) is None, name


def test_rules_of_odd_rows(spark, odd, empty):
    rows = judge(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert [r[c] for c in quality_rules.BASE] == list(base_figures(r["row"]["text"]))
        assert r["kept"] is not None and (not r["kept"] or r["n_words"] >= 10)
    assert good_documents(odd).columns == odd.columns and judge(empty).count() == 0
    text = "one two three four five six\none two three four five six\n\n \nseven"
    [r] = judge(spark.createDataFrame([(text, 7)], "text string, n_words int")).collect()
    assert (r["n_repeat_words"], r["n_dup_lines"], r["n_lines"], r["row"]["n_words"]) == (12, 1, 3, 7)


def test_rules_keep_clean_text_and_name_what_is_broken(spark):
    clean = "The story of the house is that it was built on a hill, and from there the sea is seen.\nIt has 3 rooms (and an attic)."
    spoiled = {
        "symbols": re.sub(r" ", " ## ", clean),
        "punctuation": re.sub(r" ", "!!! ", clean),
        "words with letters": " ".join(f"{w} {i} {i}" for i, w in enumerate(clean.split())),
        "stop words": " ".join(f"zorg{i}en" for i in range(120)),
        "repeated lines": "\n".join([f"Line {i} of {chr(97 + i) * 4} the {i} text {chr(99 + i) * 3}." for i in range(4)] + ["Menu"] * 4),
        "bullets": "\n".join(f"- item {i} of list {i}" for i in range(20)),
        "ellipses": "\n".join(f"{chr(97 + i)} thing of the day {i}..." for i in range(20)),
        "word length": " ".join("a" * (60 + i) for i in range(12)),
    }
    rows = [("", clean)] + list(spoiled.items())
    for r in judge(spark.createDataFrame(rows, "wanted string, text string")).collect():
        wanted = r["row"]["wanted"]
        assert r["kept"] == (wanted == "") and not r["base_failed"], wanted
        assert wanted in r["broken_rules"].split("; "), (wanted, r["broken_rules"])


def test_the_table_of_rules_is_compiled(spark, documents):
    """Rules from a table give one projection: no shuffle, no user function, no rule from elsewhere."""
    table = spark.createDataFrame(
        [("long", "n_words", "n_lines", None, 2_000, 0), ("marked", "n_marks", "n_words", 1, None, 20)],
        "name string, figure string, per string, percent_low int, percent_high int, from_words int",
    )
    rules = rules_of(table)
    assert rules == (Rule("long", "n_words", "n_lines", None, 2_000), Rule("marked", "n_marks", "n_words", 1, None, 20))
    judged = judge(documents, rules)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "UDF" not in plan
    for r in judged.collect():
        broken = [
            *["long"] * (r["n_lines"] > 0 and 100 * r["n_words"] > 2_000 * r["n_lines"]),
            *["marked"] * (r["n_words"] >= 20 and 100 * r["n_marks"] < r["n_words"]),
        ]
        assert r["broken_rules"] == "; ".join(broken) and r["kept"] == (not broken and not r["base_failed"])
    assert all(r["kept"] != r["base_failed"] for r in judge(documents, ()).collect())
    with pytest.raises(ValueError, match="no such figures"):
        judge(documents, [Rule("odd", "n_words", "n_pages", 1)])
    with pytest.raises(ValueError, match="1 rows at most"):
        rules_of(table, most=1)


# --------------------------------------------------------------------- spelling


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    i = shared_prefix(a, b)
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def brute_variants(rows):
    small = str.maketrans(spelling.LARGE, spelling.SMALL)
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(small)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    # Words with one code point marked or left out in common are the candidates.
    keys = defaultdict(set)
    for w in counts:
        keys[w].add(w)
        for i in range(len(w)):
            keys[w[:i] + w[i + 1 :]].add(w)
    near = {w: {o for i in range(len(w)) for o in keys[w[:i] + w[i + 1 :]] | keys[w] if one_edit(w, o)} for w in counts}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best and counts[best] >= 10 * counts[w]:
            forms[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, n, len(near[w]), counts.get(forms.get(w)))
    return out


def variants(docs):
    rows = spelling_variants(docs).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_variants_of_documents(spark, documents):
    got = variants(documents)
    assert got == brute_variants([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert any(v[0] for v in got.values()) and any(v[3] > 1 for v in got.values())


def test_scan_against_all_pairs():
    rng = random.Random(4)
    for _ in range(300):
        letters = "abcé"[: rng.randint(1, 4)]
        some = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 60))})
        queries = sorted(rng.sample(some, rng.randint(0, len(some))))
        wanted = [(i, j) for i, q in enumerate(queries) for j, w in enumerate(some) if one_edit(q, w)]
        assert sorted(scan(queries, some)) == wanted


@pytest.mark.parametrize("block", [2_048, 4, 1])
def test_crowded_blocks_are_dealt_again(spark, block):
    """All pairs whatever the size of a block, down to a single code point between what is shared."""
    rng = random.Random(block)
    some = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(200)}
    some |= {"commonhead" + c + "commontail" for c in "abcdefghij"} | {"commonheadcommontail", "x" * 500, "x" * 499 + "y", "x" * 501}
    got = near_pairs(spark.createDataFrame([(w,) for w in some], "word string"), block).collect()
    wanted = {(a, b) for a in some for b in some if a < b and one_edit(a, b)}
    assert {(r["a"], r["b"]) for r in got} == wanted and len(got) == len(wanted)


def test_chains_lead_to_their_last_form(spark):
    """Each word a tenth as frequent as the next; a word of as many near forms takes the smaller one."""
    chain = [("aaaaaaaa", 10**6), ("aaaaaaab", 10**5), ("aaaaaabb", 10**4), ("aaaaabbb", 10**3), ("aaaabbbb", 99), ("cccccccc", 50)]
    tie = [("zzzzzzz", 2), ("yzzzzzz", 20), ("zyzzzzz", 20), ("zzzzzzzz", 19)]
    counted = spark.createDataFrame(chain + tie, "word string, n long")
    rows = {r["word"]: r for r in spelling_forms(counted, near_pairs(counted)).collect()}
    assert {rows[w]["root"] for w, _ in chain[:4]} == {"aaaaaaaa"}
    assert rows["aaaabbbb"]["root"] == "aaaaaaaa" and rows["aaaabbbb"]["form"] == "aaaaabbb" and rows["aaaabbbb"]["form_n"] == 1000
    assert (rows["aaaaaaab"]["n_near"], rows["aaaaaaaa"]["form"], rows["cccccccc"]["root"]) == (2, None, "cccccccc")
    assert (rows["zzzzzzz"]["form"], rows["zzzzzzz"]["n_near"]) == ("yzzzzzz", 3)


def test_variants_of_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert variants(odd) == brute_variants(rows)
    assert spelling_variants(empty).count() == 0
    long = "ÀÉÎÕÜ" * 3_000
    some = [(None, "Strasse Straße STRASSE Strase"), (None, "Strasse"), (1, f"{long} {long}x {long} {long}x"), (2, "ÉCOLIERS écoliers écoliers Écoliers")]
    frame = spark.createDataFrame(some * 2, "doc_id long, text string")
    assert variants(frame) == brute_variants(some * 2)
