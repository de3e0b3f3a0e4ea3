"""The operators of the llm subpackage against brute force on small inputs."""

import math
from collections import Counter
from random import Random

import numpy as np
import pytest
import tiktoken
from conftest import rows_of
from pyspark.sql import functions as F

from remeasure.llm import components, distinct, packing, percentiles, sentences, splits, tokens

CLASHING = ("node", "a", "b", "label", "entity", "split", "day", "group", "key", "n", "place", "part", "at", "rank", "bucket", "root", "component", "row", "kind")


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(edges):
    parent = {}
    for a, b in edges:
        for x in (a, b):
            if x is not None:
                parent.setdefault(x, x)
        if a is not None and b is not None:
            a, b = find(parent, a), find(parent, b)
            parent[max(a, b)] = min(a, b)
    return {x: find(parent, x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "path", "star", "loops", "empty"])
def test_components(spark, shape):
    r = Random(3)
    edges = {
        "random": [(r.randrange(80), r.randrange(80)) for _ in range(60)],
        "path": [(k, k + 1) for k in range(60)] + [(200, 199), (199, 201)],
        "star": [(0, k) for k in range(1, 90)] * 2 + [(500, 501)],
        "loops": [(1, 1), (2, None), (None, 3), (None, None), (5, 4), (4, 5)],
        "empty": [],
    }[shape]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {x.node: x.component for x in components.connected_components(df).collect()}
    assert found == brute_components(edges)


PAIRS = "pair_id long, group_id long, targetid_1 long, targetid_2 long, fold long, program_pair string, program_1 string, program_2 string, night_1 string, night_2 string, delta_vrad double, pair_error double"


def pair_rows(seed, n=300):
    r = Random(seed)
    out = []
    for i in range(n):
        g = None if r.random() < 0.05 else (7 if r.random() < 0.33 else r.randrange(60))
        t = 1000 + (g if g is not None else r.randrange(60)) if r.random() < 0.9 else r.choice([None, 1000 + r.randrange(60)])
        t2 = t if r.random() < 0.97 else 1000 + r.randrange(60)
        fold = None if r.random() < 0.05 else (g or 0) % 10
        night = r.choice(["20210514", "2021-05-15", " 20210516", "20210517.0", "", None])
        d = r.choice([1.0, -2.0, float("nan"), float("inf"), None])
        out.append((i, g, t, t2, fold, r.choice(["A / B", "b/a", None, "A / A"]), r.choice(["dark", " DARK", "BRIGHT", "", None]), r.choice(["MEDIUM", "OTHER"]), night, r.choice(["20210601", "2021-06-02"]), d, r.choice([1.0, 0.0, -1.0, float("nan"), None, 2.0])))
    return out + out[:10]


def test_label_groups(spark):
    rows = pair_rows(1)
    usable = [r for r in rows if r[1] is not None and r[10] is not None and math.isfinite(r[10]) and r[11] is not None and r[11] > 0 and (r[6] or "").strip() and (r[8] or "").strip()]
    label = lambda p, n: f"{p.strip().upper()}:{n.strip().replace('-', '')[:8]}"
    expected = brute_components([(label(r[6], r[8]), label(r[7], r[9])) for r in usable])
    found = {r.label: r.group_label for r in components.label_groups(with_clashes(spark.createDataFrame(rows, PAIRS))).collect()}
    assert found == expected and len(found) > 3
    assert components.label_groups(spark.createDataFrame([], PAIRS)).count() == 0


def test_fold_conflicts(spark):
    rows = pair_rows(2)
    edges = [((0, r[1]), (1, t)) for r in rows if r[1] is not None for t in (r[2], r[3]) if t is not None] + [((0, r[1]), (0, r[1])) for r in rows if r[1] is not None]
    entity = brute_components(edges)
    folds = {}
    for r in rows:
        if r[1] is not None and r[4] is not None:
            folds.setdefault(entity[0, r[1]], set()).add(r[4])
    expected = {r[1] for r in rows if r[1] is not None and len(folds.get(entity[0, r[1]], ())) > 1}
    shares = summary_of(spark, [("train", 0.8), ("validation", 0.1), ("test", 0.1)])
    found = [r.group_id for r in splits.fold_conflicts(with_clashes(spark.createDataFrame(rows, PAIRS)), shares).collect()]
    assert sorted(found) == sorted(expected)
    assert splits.fold_conflicts(spark.createDataFrame([], PAIRS), shares).count() == 0


def summary_of(spark, shares):
    return spark.createDataFrame(shares, "split_name string, target_share double")


def test_balance_of_many_splits(spark):
    """No split is left out, however many there are; one of share 0 gets nothing."""
    rows = [(k, 10_000 + k, 50_000 + k, 90_000 + k, 0, "A / A", "x", "y", "1", "2", 1.0, 1.0) for k in range(4000)]
    shares = [(f"s{k:03d}", 1.0) for k in range(120)] + [("none", 0.0), ("null", None), (None, 5.0)]
    pairs = spark.createDataFrame(rows, PAIRS)
    out = {r.split: r for r in splits.split_balance(pairs, summary_of(spark, shares)).collect()}
    assert len(out) == 122 and all(r.within_tolerance and r.n_entities_apart == 0 and r.n_rows == 4000 for r in out.values())
    held = Counter(r.split for r in splits.pair_splits(pairs, summary_of(spark, shares)).collect())
    assert len(held) == 120 and sum(held.values()) == 4000
    assert {r.split for r in splits.pair_splits(pairs, summary_of(spark, [("a", None)])).collect()} == {"train"}


def test_splits_keep_entities_and_meet_shares(spark):
    r = Random(4)
    rows = [(i, g := r.randrange(600), 5000 + g, 5000 + g, 0, r.choice(["A / A", "A / B"]), "x", "y", "1", "2", 1.0, 1.0) for i in range(4000)]
    rows += [(9000, None, None, None, 0, None, None, None, None, None, None, None), (9001, None, 5003, 7777, 0, None, None, None, None, None, None, None), (9002, 77777, 7777, None, 0, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, PAIRS)
    out = splits.assign_splits(with_clashes(df), {"train": 0.8, "validation": 0.1, "test": 0.1}, label="program_pair", block=200, steps=1500).collect()
    assert Counter(r.pair_id for r in out) == Counter(r[0] for r in rows)
    for key in ("group_id", "targetid_1", "entity"):
        seen = {}
        for x in out:
            if x[key] is not None:
                assert seen.setdefault(x[key], x.split) == x.split
    by_id = {x.pair_id: x.split for x in out}
    assert by_id[9001] == by_id[9002]
    shares = Counter(x.split for x in out)
    assert abs(shares["train"] / len(out) - 0.8) < 0.005 and abs(shares["test"] / len(out) - 0.1) < 0.005
    assert splits.assign_splits(df.limit(0), {"train": 1.0}).count() == 0


def test_splits_balance_labels_beyond_the_commonest(spark):
    r = Random(6)
    # 30 common labels, and 20 rare ones that some entities have
    rows = [(i, r.randrange(900), f"c{r.randrange(30)}") for i in range(9000)]
    rows += [(9000 + i, (37 * i) % 900, f"r{i % 20}") for i in range(800)]
    df = spark.createDataFrame(rows, "pair_id long, group_id long, label string")
    target = {"train": 0.8, "validation": 0.1, "test": 0.1}
    spaces = {"g": ("group_id",)}
    out = splits.assign_splits(df, target, spaces, label="label", block=1000, label_weight=1.0).collect()
    assert len(out) == len(rows)
    rare = Counter((x.label, x.split) for x in out if x.label.startswith("r"))
    # 40 records of each rare label: 32, 4 and 4
    assert sum(abs(rare[f"r{k}", s] - 40 * share) for k in range(20) for s, share in target.items()) < 80
    shares = Counter(x.split for x in out)
    assert abs(shares["train"] / len(out) - 0.8) < 0.005


def test_distinct_counts(spark):
    r = Random(5)
    rows = [(None if r.random() < 0.05 else 7 if r.random() < 0.3 else r.randrange(500), r.choice(["20210501", "20210502", "20210603", None]), r.choice(["A", "B", "C", None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "id long, day string, group string")
    found = {(x.scope, x.night, x.program): x.n_distinct for x in distinct.distinct_report(with_clashes(df), "f").collect()}
    live = [x for x in rows if x[0] is not None]
    ids = lambda keep: len({i for i, d, g in live if keep(d, g)})
    for d in {x[1] for x in live}:
        assert found["night", d, None] == ids(lambda a, b: a == d)
        for g in {x[2] for x in live}:
            assert found["night_program", d, g] == ids(lambda a, b: (a, b) == (d, g))
    assert found["month", "202105", None] == ids(lambda a, b: a and a.startswith("202105")) and found["all", None, None] == ids(lambda a, b: True)
    a, b = ({i for i, _, g in live if g == x} for x in "AB")
    assert found["programs_or", None, "A | B"] == len(a | b) and found["programs_and", None, "A & B"] == len(a & b)
    assert distinct.distinct_report(df.limit(0), "f").count() == 0


def test_bitmaps_merge(spark):
    """Partial results of two loads that share a dictionary, merged by OR, count like one load."""
    df = spark.createDataFrame([(k % 300, f"2021050{k % 3}", "A") for k in range(900)], "id long, day string, group string")
    codes = distinct.dictionary(df)
    parts = [distinct.bitmaps(df.where(c), codes) for c in ("id < 200", "id >= 100")]
    both = distinct.merged(parts[0].unionByName(parts[1]), "group")
    assert distinct.counted(both, "group").first().n_distinct == 300
    assert sorted(r.code for r in codes.collect()) == list(range(300))


def test_dictionaries_grow(spark):
    """Loads of two days, each with a dictionary that grew from the one before, are merged by OR like one load."""
    day = lambda d, ids: spark.createDataFrame([(i, f"2021050{d}", g) for i in ids for g in "AB"], "id long, day string, group string")
    first, second = day(2, range(100, 300)), day(1, range(0, 200))
    early = distinct.dictionary(first)
    late = distinct.dictionary(second, early)
    before, after = {r.id: r.code for r in early.collect()}, {r.id: r.code for r in late.collect()}
    assert sorted(after.values()) == list(range(300)) and all(after[i] == c for i, c in before.items())
    both = distinct.merged(distinct.bitmaps(first, early).unionByName(distinct.bitmaps(second, late)), "group")
    whole = distinct.bitmaps(first.unionByName(second), distinct.dictionary(first.unionByName(second)))
    assert rows_of(distinct.counted(both, "group")) == rows_of(distinct.counted(distinct.merged(whole, "group"), "group")) == [("A", 300), ("B", 300)]
    assert rows_of(distinct.dictionary(second, early.limit(0)).select("code")) == [(k,) for k in range(200)] or distinct.dictionary(second, early.limit(0)).count() == 200
    assert distinct.dictionary(first.limit(0), early).count() == 200


def test_parts_dont_change_codes_being_dense(spark, monkeypatch):
    monkeypatch.setattr(distinct, "PART", 7)
    df = spark.createDataFrame([(k, None if k % 5 == 0 else f"d{k % 3}", "A") for k in range(200)], "id long, day string, group string")
    assert sorted(r.code for r in distinct.dictionary(df).collect()) == list(range(200))


def test_overlap_of_several_groups(spark):
    r = Random(12)
    rows = [(r.randrange(400), "20210501", r.choice("ABCD")) for _ in range(1500)]
    df = spark.createDataFrame(rows, "id long, day string, group string")
    sets = {g: {i for i, _, x in rows if x == g} for g in "ABCD"}
    found = {x.combination: x.n_distinct for x in distinct.combination_report(df, "f", ["A", "C", "D"]).collect()}
    assert found == {"any": len(sets["A"] | sets["C"] | sets["D"]), "every": len(sets["A"] & sets["C"] & sets["D"])}
    none = {x.combination: x.n_distinct for x in distinct.combination_report(df, "f", ["A", "Z"]).collect()}
    assert none["every"] == 0 and none["any"] == len(sets["A"])


def test_percentiles(spark):
    r = np.random.default_rng(6)
    values = [float(x) for x in r.normal(0, 3, 400)] + [0.0, -0.0, 1e300, -1e300, 5e-324, float("nan"), float("inf"), None] + [2.5] * 50
    rows = [(r.choice(["A / B", "A / A"]) if k % 9 else None, r.choice(["20210501", "20210502"]), v) for k, v in enumerate(values)] + [("C / C", "20210501", 7.0)]
    rows = [(None if p is None else str(p), str(n), v) for p, n, v in rows]
    df = spark.createDataFrame(rows, "program_pair string, night string, value double")
    out = percentiles.percentile_report({"f": with_clashes(df)}).collect()
    live = [x for x in rows if x[2] is not None and math.isfinite(x[2])]
    for x in out:
        own = sorted(v for p, n, v in live if p == x.program_pair and (x.scope == "all" or n == x.night))
        assert x.n_values == len(own) and math.isclose(x.value, float(np.quantile(own, x.percentile)), rel_tol=1e-9, abs_tol=1e-12)
    assert len(out) == 5 * (len({(p, n) for p, n, _ in live}) + len({p for p, _, _ in live}))
    assert percentiles.percentile_report({"f": df.limit(0)}).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.read_ranks())


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=encoder.rank, special_tokens={})


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


def test_encoder_equals_a_plain_one(encoder, reference):
    r = Random(7)
    signs = [chr(c) for c in [*range(0, 300), 0x85, 0xA0, 0x3000, 0x200B, 0x2028, 0x1680, 0x4E2D, 0xE01, 0xE31, 0x1F600, 0x301]] + [" ", "  ", "\n", "'s", "'ll", "\r\n", "the", " and"] * 15
    for _ in range(3000):
        text = "".join(r.choices(signs, k=r.randrange(30)))
        assert ids_of(encoder, text) == reference.encode_ordinary(text), repr(text)
    for text in ("=" * 3001, "ab" * 2000, "<|endoftext|>", " " * 500, "ไม่มีทาง " * 50):
        assert ids_of(encoder, text) == reference.encode_ordinary(text)


def test_cuts_are_certain(encoder):
    """No token of the vocabulary has a byte pair at which text is cut."""
    for token in list(encoder.rank)[::97]:
        b = np.frombuffer(token, np.uint8).astype(int)
        assert encoder.inside[b[:-1] * 256 + b[1:]].all()


def test_small_memory_changes_nothing(encoder, reference, monkeypatch):
    monkeypatch.setattr(tokens, "_MEMORY", 5)
    small = tokens.Encoder(tokens.read_ranks())
    text = "one two three four five six seven eight nine ten, one two three\n" * 20
    assert ids_of(small, text) == reference.encode_ordinary(text)


def test_token_ids_of_documents(spark, reference):
    texts = [(1, "Hello  there"), (2, ""), (3, None), (3, None), (4, "long " * 40_000), (None, "x"), (5, " \n")]
    df = with_clashes(spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit("clash")))
    found = sorted(((r.doc_id, list(r.ids)) for r in tokens.token_ids(df).collect()), key=repr)
    assert found == sorted(((d, reference.encode_ordinary(t) if t else []) for d, t in texts), key=repr)
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_packing_fits_and_wastes_little():
    r = np.random.default_rng(8)
    for sizes in (r.integers(1, 1000, 500), np.minimum((r.pareto(1.1, 600) * 50).astype(int) + 1, 1000), np.array([1000] * 7), np.array([501] * 9), np.array([1])):
        at = packing.pack(sizes, 1000)
        used = np.bincount(at, sizes)
        assert used.max() <= 1000 and len(at) == len(sizes)
    assert sizes.sum() == 1
    sizes = r.integers(1, 400, 2000)
    windows = packing.pack(sizes, 1000).max() + 1
    assert windows <= -(-sizes.sum() // 1000) * 1.05 + 1


def test_pack_documents(spark):
    texts = [(k, "word " * (k % 90)) for k in range(300)] + [(1000, "word " * 2000), (1001, None), (1002, ""), (1, "word ")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"container": F.lit("x"), "piece": F.lit(1), "lot": F.lit(2), "n_tokens": F.lit("y")})
    packed = packing.pack_documents(df, capacity=300, lot=100).collect()
    sizes = {r.doc_id: r.n_tokens for r in tokens.token_counts(df.where("doc_id <> 1")).collect()}
    used = Counter()
    whole = {}
    for r in packed:
        used[r.container] += r.n_tokens
        if r.doc_id != 1:
            whole.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
    assert max(used.values()) <= 300
    for d, n in sizes.items():
        pieces = sorted(whole[d])
        assert len(pieces) == max(1, -(-n // 300)) and sum(k for _, k in pieces) == n
        assert all(s == 300 * i for i, (s, _) in enumerate(pieces))
    assert sum(r.doc_id == 1 for r in packed) == 2
    assert packing.pack_documents(df.limit(0), capacity=300).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(df, capacity=0)


def test_containers_dont_depend_on_files(spark, monkeypatch):
    texts = [(k % 150, "word " * (k % 150 % 90)) for k in range(300)] + [(None, "word " * 700)] * 5
    df = spark.createDataFrame(texts, "doc_id long, text string")
    once = rows_of(packing.pack_documents(df, capacity=300, lot=60))
    monkeypatch.setattr(packing, "COPIES", 2)
    assert rows_of(packing.pack_documents(df.orderBy(F.desc("text")).repartition(7), capacity=300, lot=60)) == once
    report = packing.packing_report(df, capacity=300, lot=60).first()
    assert (report.n_documents, report.n_over_capacity, report.n_divided_that_fit, report.is_tight) == (305, 0, 0, True)
    assert len({r[0] for r in once}) < 1.1 * sum(r[4] for r in once) / 300 + 6


# ---------------------------------------------------------------- sentences

OPENINGS = ["The committee met", "Our group agreed", "Every member left", "No one spoke", "However, the chair rose"]
TAILS = ["after three sittings", "with Dr. Miller", "in Fig. 3", "at 5 p.m. on Monday", "in Rome, Paris, etc.", "on the 3.5 per cent levy", "for St. Anne", "as Mr. J. K. Brown said"]


def speech(r):
    """(text, spans) of a made speech."""
    text, spans, number = "", [], 0
    listed = r.random() < 0.3
    for _ in range(r.randrange(1, 5)):
        if text:
            text += "\n\n"
        for k in range(r.randrange(1, 6)):
            if k:
                text += r.choice([" ", " ", "\n"])
            body = r.choice(OPENINGS) + " " + r.choice(TAILS)
            if r.random() < 0.1:
                body = f"{r.choice(OPENINGS)} (Applause.) {r.choice(TAILS)}"
            if r.random() < 0.1:
                body = f"The chair said: “{r.choice(OPENINGS)}. {r.choice(OPENINGS)}”"
            body += "" if body.endswith("etc.") and r.random() < 0.5 else r.choice([".", ".", ".", "!", "?", "..."])
            if listed:
                number += 1
                body = f"{number}. {body}"
            spans.append((len(text), len(text) + len(body)))
            text += body
            if r.random() < 0.1 and not listed:
                text += " "
                spans.append((len(text), len(text) + 11))
                text += "(Laughter.)"
    return text, spans


def test_sentences_on_made_speeches(spark):
    r = Random(9)
    made = {k: speech(r) for k in range(1500)}
    df = spark.createDataFrame([(k, t) for k, (t, _) in made.items()], "doc_id long, text string")
    found = {}
    for x in sentences.sentences(df).collect():
        found.setdefault(x.doc_id, set()).add((x.start_pos, x.end_pos))
    truth = {(k, s) for k, (_, spans) in made.items() for s in spans}
    ours = {(k, s) for k, spans in found.items() for s in spans}
    right = len(truth & ours)
    assert right / len(truth) > 0.95 and right / len(ours) > 0.95


@pytest.fixture(scope="module")
def model(spark):
    from remeasure.session import table

    return sentences.fit(sentences.scanned(table(spark, "/root/testdata/sf0.01", "documents")))


CASES = [
    ("No one knows what the road through Velcor costs. The minister replied.", 2),
    ("The audit office wrote, \"Every household voted. The committee left.\" No one was there.", 2),
    ("„Niemals!“, rief jemand von der Tribüne. Warum?", 2),
    ("1. Der Ausschuss hat den Haushalt geprüft. 2. Die Sitzung ist eröffnet.", 2),
    ("Die Opposition stimmt heute über die Abgabe ab bzw. im 15. Ausschuss. Warum?", 2),
    ("« Jamais ! » a-t-on crié des tribunes. Pourquoi ?", 2),
    ("Заседание открыто. Комиссия ждёт доклада в г. Тарбрен и т. д. без дальнейших прений.", 2),
    ("有人问：“为什么？”委员会支持征收费用。（掌声）现在开会。", 4),
    ("「なぜですか？」とタルニク議員が尋ねました。断じて否です！", 2),
    ("Η επιτροπή γνωρίζει το κόστος; «Γιατί;» ρώτησε ο κ. Τιμορ.", 2),
    ("समिति ने कोष की जाँच की। (तालियाँ।) डॉ. तारतार ने सड़क की लागत बताई रु. 50.9 करोड़ में।", 3),
    ("ไม่มีทาง คณะกรรมการใช้เงิน 36.7 ล้านบาท (เสียงปรบมือ) เพราะเหตุใด", 4),
    ("The first line\nof a sentence.\n\nNo final mark here\n\nThe end.", 3),
    ("   ", 0),
    ("...", 1),
]


@pytest.mark.parametrize("text,n", CASES)
def test_sentences_of_many_scripts(model, text, n):
    spans = sentences.split_text(text, model)
    assert len(spans) == n, [text[a:b] for a, b in spans]


def test_spans_hold_all_but_white_space(spark, model):
    r = Random(10)
    signs = list(".!?…。；;()[]“”„«»‘’'\"「」（）¿¡:,–-#0123456789 \n\r\t　 \xa0abcABCяЯλΛक।ไทย中あا۔ሀ።\x1c\x85") + ["\n\n", " Dr. ", "etc."]
    for _ in range(1500):
        text = "".join(r.choices(signs, k=r.randrange(60)))
        spans = sentences.split_text(text, model)
        at = 0
        for a, b in spans:
            assert at <= a < b and not text[a].isspace() and not text[b - 1].isspace() and not text[at:a].strip(), repr(text)
            at = b
        assert not text[at:].strip(), repr(text)


def test_sentences_of_null_and_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "Yes. No."), (4, "Yes. No."), (None, "Oh.")], "doc_id long, text string").withColumns({"kind": F.lit("word"), "places": F.lit("x"), "start_pos": F.lit(1)})
    counts = Counter(r.doc_id for r in sentences.sentences(df).collect())
    assert set(counts) == {4, None} and counts[4] % 2 == 0
    assert sentences.sentences(df.limit(0)).count() == 0
