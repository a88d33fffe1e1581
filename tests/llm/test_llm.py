"""Small fixtures with nulls, ties, repeated rows, empty tables and clashing columns for the training-data operators."""

import random
from datetime import datetime, timezone

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.llm import abstracts, langid, linkage, lookalike, mixing, packing, spelling
from quillspark.llm.grouping import components, linked_groups
from quillspark.llm import names as names_module
from quillspark.llm.names import link_persons, with_organisation
from quillspark.llm.organisations import Directory
from quillspark.llm.survivors import Fields, source_quality, surviving_abstracts, survivors
from quillspark.llm.tokens import count_tokens, encoding, VOCABULARY
from quillspark.session import cut


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 3: look-alike text


@pytest.mark.parametrize(
    ("value", "whole", "plain"),
    [
        ("Plain text", False, None), ("naıve", False, None), ("été", False, "été"), ("Ａｂ　c", False, "Ab c"), ("traﬃc", False, "traffic"), ("a​b­", False, "ab"),
        ("Marie‑Claire", True, "Marie-Claire"), ("Кesikert", True, "Kesikert"), ("Р. Smith", True, "P. Smith"), ("TiO₂ and α-decay", False, None), ("Α-DECAY", False, None),
        ("naïve Т cells near X", False, "naïve T cells near X"), ("Строение (TrundiBench)", False, None), ("об o строении", False, "об о строении"), ("", False, None),
    ],
)
def test_plain_form(value, whole, plain):
    assert lookalike.plain_form(value, whole) == (value if plain is None else plain)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_plain_form_is_stable(value):
    once = lookalike.comparison_form(value)
    assert lookalike.comparison_form(once) == once


def test_normalise_values(spark):
    df = spark.createDataFrame([("a b", False, 9), (None, True, 1), ("a b", False, 9), ("x" * 50_000, False, 2)], "v string, w boolean, plain int")
    got = lookalike.normalise_values(df, "v", "w")
    assert [(r["plain"], r["altered"]) for r in got.collect()][:3] == [("a b", True), (None, False), ("a b", True)]
    assert lookalike.normalise_values(df.limit(0), "v", "w").count() == 0


# 5: groups


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=25))
def test_components(spark, pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame([*pairs, (None, 1)], "a bigint, b bigint")).collect()}
    assert set(got) == set(parent)
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in parent for b in parent)


def test_chain_and_star(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1000, 1200).select(F.lit(999).cast("bigint").alias("a"), F.col("id").alias("b"))
    got = components(chain.unionByName(star)).groupBy("component").count().collect()
    assert sorted(r["count"] for r in got) == [201, 301]


def test_linked_groups(spark):
    df = spark.createDataFrame([(5, "x", None, 1), (3, "x", "p", 1), (9, None, "p", 1), (9, None, "p", 1), (1, None, None, 1), (2, "y", None, 1), (None, "y", None, 1)], "ord bigint, k1 string, k2 string, component int")
    got = rows(linked_groups(df, "ord", ["k1", "k2"]))
    assert got == sorted([(5, 3, 4), (3, 3, 4), (9, 3, 4), (9, 3, 4), (1, 1, 1), (2, 2, 2), (None, 2, 2)], key=repr)
    assert linked_groups(df.limit(0), "ord", ["k1", "k2"]).count() == 0


# 1: survivors

WHOLE = "One sentence is here. Another sentence follows it."


@pytest.mark.parametrize(
    ("text", "ended"),
    [(WHOLE, True), ("<jats:p>" + WHOLE + "</jats:p>", True), ("Abstract: " + WHOLE, True), (WHOLE[:-3], False), ("One sentence is...", False), ("One sentence is here (cont.)", False), ("Cut off h&hellip;", False), ("Cut… read more", False), ("N/A", False),
     ("Abstract not available.", False), ("暂无摘要", False), ("结果表明。", True), ("", False), ("<p></p>", False), ("Ends with a note [9].", True), ("It says “stop.”", True)],
)
def test_ended(text, ended):
    assert abstracts.is_ended(abstracts.body_of(text)) is ended


def test_beginnings():
    first, whole = (abstracts.body_of(t) for t in ("One sentence is here.", WHOLE))
    assert abstracts.own_hash(first) in abstracts.beginnings(whole)
    assert abstracts.own_hash(whole) not in abstracts.beginnings(whole)


EV = "array<struct<source:string,source_id:string,source_url:string,collected_at:timestamp,confidence:double,raw_data:string>>"
ROW = f"ord bigint, id string, title string, keywords array<string>, abstract string, evidence_list {EV}"
AS_OF = datetime(2025, 6, 30, tzinfo=timezone.utc)


def row(ord, id, abstract, conf=0.5, day=1, title="T", keywords=(), source="s1"):
    return (ord, id, title, list(keywords), abstract, [(source, None, "u", datetime(2025, 1, day, tzinfo=timezone.utc), conf, None)] if conf is not None else [])


def test_survivors(spark):
    late = ("s9", None, "u", datetime(2030, 1, 1, tzinfo=timezone.utc), 0.99, None)
    odd = row(7, "p", WHOLE, 0.5)
    df = spark.createDataFrame([
        row(1, "p", "One sentence is here.", 0.9, keywords=["A"]), row(2, "p", WHOLE, 0.6, 2), row(3, "p", WHOLE, 0.6, 3), row(4, "p", WHOLE, 0.6, 3), row(5, "p", None, 1.0, title="Other"), row(6, "p", WHOLE, None),
        odd[:-1] + ([*odd[-1], late],), row(8, "q", "N/A"), row(9, "q", None), row(10, None, WHOLE), row(11, "r", WHOLE, float("nan")), row(12, "r", WHOLE, 77.0), row(13, "r", WHOLE, 0.0),
    ], ROW)
    fields = Fields(single={"title": (F.lower("title"), F.col("title"))}, multiple={"keywords": F.col("keywords")})
    got = {r["id"]: r for r in survivors(df, fields, "evidence_list", AS_OF).collect()}
    assert {k: (v["n_rows"], v["abstract_ord"]) for k, v in got.items()} == {"p": (7, 3), "q": (2, None), "r": (3, 13)}
    assert got["p"]["abstract"] == WHOLE and got["p"]["title"] == "T"
    assert survivors(df.limit(0), fields, "evidence_list", AS_OF).count() == 0


def test_p1_is_as_brute_force(spark):
    """Every group of the smallest table, against plain loops that compare all texts of a group."""
    from quillspark.llm.survivor_queries import p1_found

    folder = "/root/testdata/sf0.001"
    groups = {}
    for r in spark.read.parquet(f"{folder}/papers.parquet").where("id IS NOT NULL").select("id", "ord", "abstract", "evidence_list").collect():
        groups.setdefault(r["id"], []).append(r)
    want = set()
    for id, members in groups.items():
        ended = [(r, b.casefold()) for r in members if r["abstract"] and abstracts.is_ended(b := abstracts.body_of(r["abstract"]))]
        whole = [r for r, b in ended if not any(c != b and c.startswith(b.rstrip("\"'”’»)]"))  for _, c in ended if len(c) > len(b))]

        def rank(r):
            ok = [e for e in r["evidence_list"] if e["confidence"] is not None and 0 <= e["confidence"] <= 1 and e["collected_at"].timestamp() <= AS_OF.timestamp()]
            return (max((e["confidence"] for e in ok), default=-1), max((e["collected_at"].timestamp() for e in ok), default=-1e18), -r["ord"])

        if len(members) > 1 and whole:
            want.add((id, max(whole, key=rank)["ord"]))
    assert {tuple(r) for r in p1_found(spark, folder).collect()} == want


def test_source_quality_finds_the_liar(spark):
    facts = [("f", ["a", "b", "c"], ["liar"], i) for i in range(200)] + [("f", ["liar"], ["a", "b", "c"], i) for i in range(200)]
    q = source_quality(spark.createDataFrame([(*f[:3],) for f in facts], "field string, pro array<string>, contra array<string>"))
    assert q["f", "a"][0] > 0.9 and q["f", "liar"][0] < 0.3 and q["f", "liar"][1] < 0.5


# 2: names


def test_name_parts():
    assert spelling.name_tokens("Hodibøy, Quentin M.") == ["hodiboy", "quentin", "m"]
    assert spelling.name_tokens("Prof. MariaPolulesku PhD") == ["maria", "polulesku"]
    assert spelling.name_tokens("Nurivesku MK") == ["nurivesku", "m", "k"]
    assert spelling.name_tokens("ТOMÁS LEE1,2") == ["tomas", "lee"]
    assert spelling.edit_distance("abcd", "abdc") == 1 and spelling.edit_distance("abc", "xyz") == 3
    assert spelling.monge_elkan(["bill", "smith"], ["william", "smith"]) > 0.95
    assert spelling.monge_elkan([], ["a"]) == 0


def test_banding_reaches_its_recall():
    r, b = spelling.tuned_banding(0.45, 0.95, 0.15)
    assert spelling.collision(0.45, r, b) >= 0.95
    rng = random.Random(1)
    mh = spelling.MinHash(r, b)
    found = total = 0
    for _ in range(300):
        w = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10))
        i = rng.randrange(1, 8)
        v = w[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz") + w[i + 1 :]
        a, c = set(spelling.grams(w)), set(spelling.grams(v))
        if len(a & c) / len(a | c) >= 0.45:
            total += 1
            found += bool(set(mh.bands_of(w)) & set(mh.bands_of(v)))
    assert total > 100 and found / total >= 0.95


ORGS = [(1, "University of Velmora", "UV", "Velmora", "Canada"), (2, "Velmora University of Applied Sciences", "VUAS", "Velmora", "Canada"), (3, "Norrhaven Institute of Technology", "NIT", "Norrhaven", "Sweden")]


@pytest.mark.parametrize(
    ("line", "want"),
    [("Univ. of Velmora", 1), ("Universidad de Velmora", 1), ("Dept. of Physics, Univeristy of Velmora, Canada", 1), ("Velmora UAS", 2), ("Norrhaven Tech", 3), ("Institute of Technology, Norrhaven", 3), ("NIT, Norrhaven", 3), ("UV", 1), ("NIT, Velmora", None), ("Self-employed", None), ("University", None), ("", None)],
)
def test_organisations(line, want):
    d = Directory(ORGS)
    i = d.find(line)
    assert (None if i is None else ORGS[i][0]) == want


def test_links(spark):
    orgs = spark.createDataFrame(ORGS, "inst_id bigint, name string, acronym string, city string, country string")
    persons = spark.createDataFrame([("A1", "Maria J. Polulesku", ["M. Polulesku", ""], [1]), ("A2", "Maria K. Polulesku", None, [3]), ("A3", "Robert Stone", ["Robert Rock"], None), (None, "Nobody Here", None, [1])], "id string, name string, aliases array<string>, orgs array<bigint>")
    typed = [(1, "Polulesku, Maria J.", None), (2, "M. Polulesku", "UV"), (3, "M. Polulesku", None), (4, "Bob Stone", None), (5, "Rock Robert", None), (6, "Maria Stone", None), (7, None, None), (8, "", None), (9, "Polulesuk Maria", "NIT"), (9, "Polulesuk Maria", "NIT"), (10, "Nobody Here", None)]
    entries = with_organisation(spark.createDataFrame(typed, "ord int, name string, line string"), "line", orgs, "org")
    got = rows(link_persons(entries, persons, ["ord"]))
    assert got == sorted([(1, "A1"), (2, "A1"), (4, "A3"), (5, "A3"), (9, "A2"), (9, "A2")], key=repr)
    assert link_persons(entries.limit(0), persons, ["ord"]).count() == 0 and link_persons(entries, persons.limit(0), ["ord"]).count() == 0


# 6: linkage


def test_title_parts():
    assert linkage.title_parts("On the <i>Cost</i> of $\\alpha$-decay, Part Two") == (["cost", "α", "decay"], "part2", False)
    assert linkage.title_parts("Rivers and lakes (Corrigendum)")[1] == "correction" and linkage.title_parts("A Reply to: rivers")[1] == "reply"
    assert linkage.title_parts("Rivers and deep lak…") == (["rivers", "deep", "lak…"], "", True) and linkage.title_parts(None) == ([], "", False)


def test_link(spark):
    cols = "k string, title string, authors array<string>, year int, doi string, arxiv string, confidence double"
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("bdfgklmnprstv", k=1)) + "".join(rng.choices("aeiou", k=1)) + "".join(rng.choices("bdfgklmnprstv", k=3)) + "um"
    works = [(" ".join(word() for _ in range(6)), [f"Ann {word().title()}"], 2000 + i % 20, f"10.1/{i}") for i in range(80)]
    left = [(f"l{i}", t, a, y, doi if i % 3 == 0 else None, None, 0.0) for i, (t, a, y, doi) in enumerate(works)]
    right = [(f"r{i}", t + (" (Corrigendum)" if i % 10 == 9 else ""), [f"A. {a[0].split()[1]}"], y, doi if i % 6 == 0 else None, None, 0.0) for i, (t, a, y, doi) in enumerate(works[:50])]
    left += [("copy", works[0][0], works[0][1], works[0][2], works[0][3], None, 0.0), ("null", None, None, None, None, None, 0.0)]
    right += [("wrong", "something else entirely different here", ["Q. Other"], 1990, works[3][3], None, 0.0), ("same", works[4][0], ["Z. Unrelated"], 1950, None, None, 0.0)]
    a, b = spark.createDataFrame(left, cols).withColumnRenamed("k", "ord"), spark.createDataFrame(right, cols).withColumnRenamed("k", "paperid")
    got = {(r["ord"], r["paperid"]) for r in linkage.link(a, b, "ord", "paperid").collect()}
    assert got == {(f"l{i}", f"r{i}") for i in range(50) if i % 10 != 9} | {("copy", "r0")}
    assert linkage.link(a.limit(0), b, "ord", "paperid").count() == 0 and linkage.link(a, b.limit(0), "ord", "paperid").count() == 0


# 7: packing


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=200))
def test_sum_of_squares_never_overfills(sizes):
    s = np.array(sizes)
    where, gaps = packing.sum_of_squares(s, 50)
    filled = np.bincount(where, s, len(gaps))
    assert (filled <= 50).all() and (50 - filled == gaps).all()
    assert len(np.unique(packing.close_gaps(where, gaps, s, 50))) <= len(gaps)


def test_sum_of_squares_rule():
    # Against the definition: the choice that gives the least sum of squared counts of open containers by gap.
    rng = random.Random(4)
    sizes = [rng.randint(1, 12) for _ in range(150)]
    where, _ = packing.sum_of_squares(np.array(sizes), 12)
    gaps: list[int] = []
    for s, w in zip(sizes, where, strict=True):
        def total(gs):
            return sum(c * c for g, c in zip(*np.unique([g for g in gs if g], return_counts=True), strict=True))

        options = {total([g - s if i == j else g for i, g in enumerate(gaps)]) for j, g0 in enumerate(gaps) if g0 >= s} | {total([*gaps, 12 - s])}
        gaps = [g - s if i == w else g for i, g in enumerate(gaps)] if w < len(gaps) else [*gaps, 12 - s]
        assert total(gaps) == min(options)


def test_pack(spark):
    items = spark.createDataFrame([(i, n) for i, n in enumerate([0, None, 5, 5, 10, 23, 3, 7, -1])], "box int, n bigint")
    caps = spark.createDataFrame([("a", 10), ("b", 100), ("c", None), ("d", 0)], "container string, capacity_tokens bigint")
    got = packing.pack(items, caps, "box", "n", block_items=4) if False else packing.pack(items.withColumnRenamed("box", "doc"), caps, "doc", "n", block_items=4)
    r = got.collect()
    assert {x["container"] for x in r} == {"a", "b"} and {x["doc"] for x in r if x["container"] == "a"} == set(range(9))
    fill = {}
    for x in r:
        fill[x["container"], x["bin_id"]] = fill.get((x["container"], x["bin_id"]), 0) + x["n_tokens"]
    assert all(v <= {"a": 10, "b": 100}[k[0]] for k, v in fill.items())
    assert sorted((x["piece"], x["token_start"], x["n_tokens"]) for x in r if x["doc"] == 5 and x["container"] == "a") == [(0, 0, 10), (1, 10, 10), (2, 20, 3)]
    assert packing.pack(items.limit(0).withColumnRenamed("box", "doc"), caps, "doc", "n").count() == 0


def test_tokens(spark):
    long = "ab1 " * 5000
    df = spark.createDataFrame([("hello world",), (None,), ("",), ("<|endoftext|>",), (long,)], "t string")
    got = [r[0] for r in df.select(count_tokens(F.col("t"))).collect()]
    codec = encoding(VOCABULARY)
    assert got[:3] == [2, 0, 0] and got[3] > 1 and got[4] == len(codec.encode_ordinary(long))
    assert codec.decode(codec.encode_ordinary(long)) == long


# 8: mixing


def test_means():
    for cap in (1, 2, 4):
        for rate in (0.1, 0.5, 0.85 * cap):
            assert mixing._expected(mixing.mean_for(rate, cap), cap) == pytest.approx(rate, abs=1e-6)


def test_mixture(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "small").otherwise(F.lit(None)).alias("source"), (F.col("id") % 50 + 1).alias("n"), F.lit("x").alias("copy"))
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 3), ("absent", 0.1, 4)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(docs, targets, "n")
    shares = {r["source"]: r for r in mixing.mixture_report(mixed, targets, "n").collect()}
    assert shares["big"]["actual_share"] == pytest.approx(5 / 9, abs=0.01) and shares["small"]["most_uses"] <= 3 and shares["absent"]["n_tokens"] == 0
    assert rows(mixed.select("doc_id", "copy")) == rows(mixing.mixture(docs.repartition(7), targets, "n").select("doc_id", "copy"))
    assert mixing.mixture(docs.limit(0), targets, "n").count() == 0 and mixing.mixture(docs, targets.limit(0), "n").count() == 0


# 9: languages

EN = "This is a plain sentence about the weather in the north. The second sentence is also about the weather and the sea."
DE = "Dies ist ein einfacher Satz über das Wetter im Norden. Der zweite Satz handelt auch vom Wetter und von der See."
FR = "Ceci est une phrase simple sur le temps dans le nord. La deuxième phrase parle aussi du temps et de la mer."


def model():
    examples = [(s, g) for g, t in (("en", EN), ("de", DE), ("fr", FR)) for _, _, s in langid.sentences(t) for _ in range(8)]
    return langid.train_clean([*examples, *[(langid.sentences(EN)[0][2], "de")] * 2])


def test_labels():
    for label, want in (("en-GB", ["en"]), ("de_DE", ["de"]), ("German", ["de"]), ("fr;en/ru", ["fr", "en", "ru"]), ("und", []), ("", []), (None, []), ("ZH", ["zh"]), ("unknown", [])):
        assert langid.label_languages(label) == want


def test_sentences():
    text = "Results\n\nThis is a whole sen-\ntence about the sea. [3]\n\n[1] Name A. A title of something in words. 2019.\n\n↑ 4.1 %\nThis one is broken off before the"
    got = [s for _, _, s in langid.sentences(text)]
    assert len(got) == 1 and "sentence" in got[0].replace("​", "")
    a, b, s = langid.sentences(EN)[1]
    assert EN[a:b].startswith("The second") and EN[a:b].endswith("sea.")


def test_detect(spark):
    df = spark.createDataFrame([(1, EN, "en", 5), (2, EN + "\n\n" + DE, "en", 5), (3, None, None, 5), (4, "", "de", 5), (5, FR, "German", 5), (5, FR, "German", 5), (6, "↑ 4.1 %", None, 5)], "doc_id bigint, text string, lang string, segments int")
    got = langid.detect(df, model())
    segs = {(r["doc_id"]): [(s["lang"], s["sentences"]) for s in r["segments"]] for r in got.collect()}
    assert segs == {1: [("en", 2)], 2: [("en", 2), ("de", 2)], 3: [], 4: [], 5: [("fr", 2)], 6: []}
    assert got.count() == 7 and langid.detect(df.limit(0), model()).count() == 0


def test_held_out_accuracy(spark):
    """Trained on half of the smallest documents, tried on the sentences of the other half whose labels agree by majority."""
    folder = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(folder)
    m = langid.train_clean(langid.training_sample(docs.where("doc_id % 2 = 0"), "doc_id", "text", "lang"))
    good = total = 0
    for r in docs.where("doc_id % 2 = 1 AND text IS NOT NULL").collect():
        labels = langid.label_languages(r["lang"])
        found = langid.sentences(r["text"])
        if len(labels) == 1 and found:
            total += 1
            good += max((x := [m.predict(s)[0] for _, _, s in found]), key=x.count) == labels[0]
    assert total > 20 and good / total > 0.7  # about a fifth of the labels are wrong


def test_survivors_hold_all_fields(spark, tmp_path):
    from quillspark.llm.survivor_queries import p1_survivors

    entry = "struct<source:string,source_id:string,source_url:string,collected_at:timestamp,confidence:double,raw_data:string>"
    author = "struct<author_id:string,name:string,position:int,is_corresponding:boolean,affiliation:string>"
    schema = f"ord bigint, id string, title string, authors array<{author}>, year int, venue string, venue_type string, publisher string, abstract string, doi string, arxiv_id string, pmid string, url string, pdf_url string, citations bigint, reference_count bigint, keywords array<string>, fields_of_study array<string>, evidence_list array<{entry}>, synthetic_confidence double"
    t = AS_OF.replace(year=2024)

    def row(ord, authors, url, citations, evidence):
        return (ord, "p", "T", authors, 2020, None, None, None, None, None, None, None, url, None, citations, 7, [], [], evidence, 0.5)

    e1, e2, low = ("a", "1", None, t, 0.9, None), ("b", "1", None, t, 0.8, None), ("a", "1", None, t, 0.2, None)
    spark.createDataFrame([
        row(1, [("A1", "Ann Bee", 1, None, None), (None, "Cy Dee", 2, None, None)], "https://x.example/a/", 5, [e1]),
        row(2, [(None, "Ann Bee", 1, None, None), (None, "Cy Dee", 2, None, None)], "https://x.example/a", 5, [low, e2]),
    ], schema).write.parquet(str(tmp_path / "papers.parquet"))
    [got] = p1_survivors(spark, str(tmp_path)).collect()
    assert (got["url"].rstrip("/"), got["citations"], got["reference_count"], got["synthetic_confidence"]) == ("https://x.example/a", "5", "7", "0.5")
    assert [(a["author_id"], a["name"]) for a in got["authors"]] == [("A1", "Ann Bee"), (None, "Cy Dee")]
    assert [(e["source"], e["confidence"]) for e in got["evidence_list"]] == [("a", 0.9), ("b", 0.8)]


# Added: blocking, bands, short names, organisations by a join, planted sources


@pytest.mark.parametrize("length", [3, 4, 5, 6, 7, 8, 10])
def test_bands_meet_at_one_error(length):
    rng = random.Random(length)
    letters = "abcdefghijklmnopqrstuvwxyz"
    hashes: dict = {}
    met = tried = 0
    for _ in range(400):
        w = "".join(rng.choices(letters, k=length))
        i, kind = rng.randrange(length), rng.choice(["wrong", "less", "more", "swap"] if length > 3 else ["wrong", "more"])
        v = {"wrong": w[:i] + rng.choice(letters) + w[i + 1 :], "less": w[:i] + w[i + 1 :], "more": w[:i] + rng.choice(letters) + w[i:], "swap": w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]}[kind]
        if v != w:
            tried += 1
            met += bool(set(names_module.bands_of(w, hashes)) & set(names_module.bands_of(v, hashes)))
    assert met >= 0.95 * tried


def test_short_names(spark):
    people = [("A1", "Wei Li"), ("A2", "Jun Wu"), ("A3", "Bo Xu"), ("A4", "Yi Ma"), ("A5", "Ng K. C."), ("A6", "李伟"), ("A7", "Ann Lee"), ("A8", "欧阳娜娜")]
    persons = spark.createDataFrame([(i, n, [], []) for i, n in people], "id string, name string, aliases array<string>, orgs array<bigint>")
    typed = [(1, "Li Wei", "A1"), (2, "LI, Wei", "A1"), (3, "J. Wu", "A2"), (4, "Bo Xu", "A3"), (5, "Y Ma", "A4"), (6, "K. C. Ng", "A5"), (7, "李伟", "A6"), (8, "Ann Lee", "A7"), (9, "欧阳娜娜", "A8"), (10, "Zoe Other", None)]
    entries = spark.createDataFrame([(k, n, None) for k, n, _ in typed], "k int, name string, org bigint")
    got = {r["k"]: r["person"] for r in link_persons(entries, persons, ["k"]).collect()}
    assert got == {k: p for k, _, p in typed if p}


def test_many_organisations(spark, monkeypatch):
    known = spark.createDataFrame(
        [(i, f"University of {c}", f"U{c[0]}", c, "Land") for i, c in enumerate(["Alba", "Brint", "Corvo", "Delmar"])] + [(9, "Institute of Applied Rivers", "IAR", "Brint", "Land"), (10, None, None, None, None)],
        "inst_id bigint, name string, acronym string, city string, country string",
    )
    lines = ["Univ. of Alba", "Universty of Brint, Brint", "Inst. Applied Rivers", "IAR, Brint", "University of Nowhere", "Dept. of Physics, Univ. Corvo", "", None, "UD"]
    rows_ = spark.createDataFrame([(i, t, 0) for i, t in enumerate(lines)], "k int, line string, _n int")
    kept = {r["k"]: r["org"] for r in with_organisation(rows_, "line", known, "org").collect()}
    monkeypatch.setattr(names_module, "KEPT_ORGANISATIONS", 2)
    joined = {r["k"]: r["org"] for r in with_organisation(rows_, "line", known, "org").collect()}
    assert joined == kept and kept[0] == 0 and kept[2] == 9 and kept[4] is None and kept[7] is None
    assert with_organisation(rows_.limit(0), "line", known, "org").count() == 0


def test_blocking_finds_what_brute_force_finds(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    common = [word() for _ in range(30)]
    titles = [[*rng.sample(common, 5), word() + "x"] for _ in range(120)]

    def typo(ws):
        ws = list(ws)
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(len(ws))
            at = rng.randrange(len(ws[i]))
            ws[i] = ws[i][:at] + rng.choice("aeioubdf") + ws[i][at + 1 :]
        return ws[:-1] if rng.random() < 0.1 else ws

    a, b = [" ".join(t) for t in titles], [" ".join(typo(t)) for t in titles]
    truth = {(x, y) for x in set(a) for y in set(b) if linkage._title_level(x.split(), y.split(), False) >= 2}
    frame = lambda ts, side: spark.createDataFrame([(side, t, False) for t in sorted(set(ts))], "left boolean, words string, cut boolean")
    both = cut(frame(a, True).unionByName(frame(b, False)).selectExpr("left", "words", "cut", "monotonically_increasing_id() AS t"))
    text = {r["t"]: r["words"] for r in both.collect()}
    met = {(text[r["l"]], text[r["r"]]) for r in linkage.proposed(both).select("l", "r").distinct().collect()}
    assert len(truth & met) >= 0.97 * len(truth) and len(met) < 0.2 * len(set(a)) * len(set(b))


def test_titles_cut_off_and_in_signs():
    whole = "sampling rivers deep water lakes".split()
    assert linkage._title_level("sampling rivers dee…".split(), whole, True) == 3
    assert linkage._title_level("sampling rivers win…".split(), whole, True) < 3
    assert linkage._title_level("tool 湍 流 模 型 与 酶 的 活 性 研 究".split(), "tool 轨 道 周 期 与 酶 的 活 性 研 究".split(), False) < 2
    assert linkage._title_level("tool 湍 流 模 型 与 酶 的 活 性 研 究".split(), "tool 湍 流 模 型 与 酶 地 活 性 研 究".split(), False) == 3


def test_survivors_prefer_good_sources_to_trusted_rows(spark):
    # Two sources that mostly agree give a year; a third gives wrong ones with high confidence. The model learns whom to believe.
    out = []
    for g in range(60):
        for k, (source, year, conf) in enumerate((("good1", 2000 + g % 20, 0.5), ("good2", 2000 + g % 20, 0.5), ("bad", 1900 + g, 0.99))):
            out.append((10 * g + k, f"g{g}", year, [(source, None, "u", datetime(2025, 1, 1, tzinfo=timezone.utc), conf, None)]))
    df = spark.createDataFrame(out, f"ord bigint, id string, year int, evidence_list {EV}").selectExpr("*", "CAST(NULL AS STRING) AS abstract")
    from pyspark.sql import functions as F

    got = {r["id"]: int(r["year"]) for r in survivors(df, Fields(single={"year": (F.col("year"), F.col("year"))}), "evidence_list", AS_OF).collect()}
    assert got == {f"g{g}": 2000 + g % 20 for g in range(60)}
    alone = {r["id"]: (r["n_rows"], r["abstract_ord"]) for r in surviving_abstracts(df, "abstract", "evidence_list", AS_OF).collect()}
    assert alone == {f"g{g}": (3, None) for g in range(60)}


def test_other_scripts_are_undetermined(spark):
    text = "هذه جملة طويلة بعض الشيء عن البحر والأنهار. وهذه جملة أخرى طويلة عن الجبال والأنهار."
    df = spark.createDataFrame([(1, text, None), (2, EN, None)], "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: {s["lang"] for s in r["segments"]} for r in langid.detect(df, model()).collect()}
    assert found == {1: {"und"}, 2: {"en"}}


def test_pieces_of_long_texts_stay_out_of_blocks(spark):
    items = spark.createDataFrame([(1, 25), (2, 10), (3, 0), (4, None), (5, 7)], "doc bigint, n bigint")
    caps = spark.createDataFrame([("c", 10)], "container string, capacity_tokens bigint")
    got = packing.pack(items, caps, "doc", "n").collect()
    assert sorted((r["doc"], r["piece"], r["token_start"], r["n_tokens"]) for r in got) == [(1, 0, 0, 10), (1, 1, 10, 10), (1, 2, 20, 5), (2, 0, 0, 10), (3, 0, 0, 0), (4, 0, 0, 0), (5, 0, 0, 7)]
    assert all(sum(x["n_tokens"] for x in got if x["bin_id"] == b) <= 10 for b in {r["bin_id"] for r in got})


def test_tokens_are_compared_up_to_the_errors_that_count(monkeypatch):
    from quillspark.llm import spelling

    asked, whole_distance = set(), spelling.edit_distance
    monkeypatch.setattr(spelling, "edit_distance", lambda a, b, most=3: asked.add((max(len(a), len(b)) < 9, most)) or whole_distance(a, b, most))
    pairs = {("smith", "smiht"): 0.8, ("smith", "smit"): 0.8, ("smith", "smyht"): 0.0, ("lindstrom", "lindtsrim"): 1 - 2 / 9, ("lindstrom", "lndtsrim"): 0.0, ("anna", "otto"): 0.0}
    assert {k: spelling.token_similarity(*k) for k in pairs} == pytest.approx(pairs)
    assert asked == {(True, 1), (False, 2)}


def test_words_of_titles_are_compared_up_to_the_errors_that_count(monkeypatch):
    asked, whole_distance = set(), linkage.edit_distance
    monkeypatch.setattr(linkage, "edit_distance", lambda a, b, most=3: asked.add((b, most)) or whole_distance(a, b, most))
    assert linkage._title_level("cold rivers of limestone".split(), "cold rivres of limesotnee".split(), False) == 3
    assert asked == {("rivers", 1), ("limestone", 2)}
