"""Substring join by runs of characters, lemmas by learned suffixes, keys by place: against brute force."""

import random
from collections import Counter, defaultdict

from trustlens.operators.aspects import expand_aspects
from trustlens.operators.lemmas import clean_lemmas, suffix_rules
from trustlens.sources.readers import read_reviews_by_place

SEEDS = "aspect_pos int, aspect string, seed string"


def _expanded(spark, seeds, terms):
    pool = spark.createDataFrame([(t,) for t in terms], "lemma string")
    return expand_aspects(spark.createDataFrame(seeds, SEEDS), pool)


def test_substring_join_equals_brute_force(spark):
    rng = random.Random(3)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(300)}
    seeds = [(0, "x", "abcabca"), (0, "x", "ab"), (1, "y", "c"), (1, "y", "bcabc"), (2, "z", "😀é"), (2, "z", "ccccc")]
    terms |= {"x😀é", "é😀", "ab"}
    got = _expanded(spark, seeds, [*terms, None, "ab"])
    want = {(p, a, s) for p, a, s in seeds} | {(p, a, t) for p, a, s in seeds for t in terms if s[:5] in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_substring_join_odd_seeds(spark):
    got = {tuple(r) for r in _expanded(spark, [(0, "x", ""), (1, "y", None)], ["one", ""]).collect()}
    assert got == {(0, "x", ""), (0, "x", "one"), (1, "y", None)}
    assert _expanded(spark, [], ["one"]).count() == 0
    assert {tuple(r) for r in _expanded(spark, [(0, "x", "one")], []).collect()} == {(0, "x", "one")}


PAIRS = [("running", "run"), ("walking", "walk"), ("talking", "talk"), ("singing", "sing"), ("cats", "cat"), ("dogs", "dog"),
         ("boxes", "box"), ("foxes", "fox"), ("went", "go"), ("a", "b"), ("same", "same"), ("shoes", "shoe"), ("más", "mucho"),
         ("longest", "longer")]


def _rules(pairs, most=4, least=1):
    counts = defaultdict(Counter)
    for form, lemma in dict(pairs).items():
        for k in range(1, most + 1):
            cut = len(form) - k
            if cut > 0 and lemma[:cut] == form[:cut]:
                counts[form[cut:]][lemma[cut:]] += 1
    best = {s: min(c.items(), key=lambda x: (-x[1], x[0])) for s, c in counts.items()}
    # an ending below the least number of forms is no rule
    return {s: e for s, (e, n) in best.items() if n >= least}


def test_suffix_rules_equal_brute_force(spark):
    table = spark.createDataFrame([*PAIRS, (None, "x"), ("x", None), ("cats", "cat")], "form string, lemma string")
    for least in (1, 2):
        got = suffix_rules(table, least=least).collect()
        assert {r["suffix"]: r["ending"] for r in got} == _rules(PAIRS, least=least)
        assert len({r["suffix"] for r in got}) == len(got)
    assert suffix_rules(table.limit(0)).count() == 0


def test_learned_lemmas_leave_known_forms(spark):
    words = ["running", "went", "jumping", "hats", "boxes", "axes", "ing", "shoes", "zzz", "and", "more", "oes"]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None), (4, "hats hats")], "doc_id long, text string")
    table = spark.createDataFrame(PAIRS, "form string, lemma string")
    stop = spark.createDataFrame([("and",)], "token string")
    rules, known = _rules(PAIRS), dict(PAIRS)

    def lemma(form):
        if form in known:
            return known[form]
        for k in range(min(4, len(form) - 1), 0, -1):
            if form[-k:] in rules:
                return form[:-k] + rules[form[-k:]]
        return form
    got = clean_lemmas(docs, stop, table, "a-z", rules=suffix_rules(table))
    rows = sorted((r["doc_id"], r["pos"], r["lemma"]) for r in got.collect())
    lists = {1: words, 4: ["hats", "hats"]}
    want = [(d, i, lemma(w)) for d, ws in lists.items() for i, w in enumerate(ws) if w != "and"]
    assert rows == sorted(w for w in want if len(w[2]) >= 3 and w[2] != "and")
    plain = {(r["doc_id"], r["pos"]): r["lemma"] for r in clean_lemmas(docs, stop, table, "a-z").collect()}
    assert all(plain[d, i] == known[w] for d, ws in lists.items() for i, w in enumerate(ws) if w in known and (d, i) in plain)


def test_keys_by_place_over_files(spark, tmp_path):
    want = []
    for f in range(5):
        with open(tmp_path / f"part-{f}.csv", "w", encoding="utf-8", newline="") as out:
            out.write("mark,text,doc_id\n")
            for i in range([0, 3, 40, 1, 7][f]):
                text = None if i % 4 == 2 else f"text {f}\n{i}, \"\"quoted\"\""
                out.write(f"m{i},{'' if text is None else chr(34) + text + chr(34)},{9 - i}\n")
                if text is not None:
                    want.append((len(want), text.replace('""', '"'), f"m{i}"))
    got = read_reviews_by_place(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "mark"]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_keys_by_place_of_nothing(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("text\n")
    assert read_reviews_by_place(spark, str(tmp_path)).collect() == []


def test_keys_by_place_over_splits_of_one_file(spark, tmp_path):
    path = tmp_path / "lines.csv"
    rows = [f"row {i} " + "x" * (i % 50) for i in range(4000)]
    path.write_text("text,n\n" + "".join(f"{'' if i % 9 == 4 else r},{i}\n" for i, r in enumerate(rows)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = read_reviews_by_place(spark, str(path), multiline=False)
        want = [r for i, r in enumerate(rows) if i % 9 != 4]
        assert [(r["doc_id"], r["text"]) for r in got.orderBy("doc_id").collect()] == list(enumerate(want))
        assert spark.read.option("header", True).csv(str(path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
