"""Stages of the corpus pipeline on awkward tables and against plain versions."""

import random
import re

import pytest

import corpus_pipeline
from aerotrace.llm import graph, mixing, simhash
from tests.llm.test_operators import AWKWARD, SCHEMA, components, labelled, near_copies, packed_well, table

COLUMNS = SCHEMA.replace(",", "").split()[::2]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs, labels = labelled(spark, 200)
    texts = near_copies()
    rows = docs + [(1000 + i, t, "en", "b", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, {i for i, _, y in labels if y}


def test_columns_of_any_name_come_through(spark, sf):
    """Columns that the stages use inside come back with the user's values."""
    names = ("__id", "__key", "__copy", "__copies", "__taken", "whole", "again", "n", "digest", "key", "copies", "share", "taken", "component", "node", "a.b")
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    rows = [(i, t, None, f"s{i % 3}", 1, *(f"{c}{i}" for c in names)) for i, t in enumerate(near_copies())]
    docs = spark.createDataFrame(rows, kinds)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf[0])
        assert out.columns == docs.columns, name
        assert all(r[5:] == tuple(f"{c}{r[0]}" for c in names) for r in out.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf[0]).count() > 0


def test_mixing_keeps_every_source(spark, sf):
    rows = [(i, " ".join(["w"] * 300), None, f"s{i % 4}", 1) for i in range(40)] + [(100 + i, " ".join(["x"] * 500), None, f"t{i}", 1) for i in range(3)] + [(200, "six words are in this text", None, "u", 1), (201, None, None, None, 1)]
    out = corpus_pipeline.mixing_stage(spark, table(spark, rows), sf[0]).collect()
    assert {r.source for r in out} == {r[3] for r in rows}


@pytest.mark.parametrize("k", range(5))
def test_stages_take_awkward_and_empty_tables(spark, sf, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, table(spark, AWKWARD), sf[0])
    n = out.count()
    assert n > 0 and (out.columns == COLUMNS or name == "packing")
    if name in ("toxicity", "exact_dedup", "near_dedup"):
        assert {(r.doc_id, r.text) for r in out.collect()} <= {(r[0], r[1]) for r in AWKWARD}
    assert stage(spark, table(spark, []), sf[0]).count() == 0


def test_run(spark, sf):
    folder, rows, bad = sf
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).persist()
        seen[name] = docs.collect()
    clean = {r.doc_id for r in seen["toxicity"]}
    assert clean == {r[0] for r in rows} - bad
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), r.text) for r in seen["exact_dedup"]]
    assert len(low) == len(set(low)) == len({re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) for r in rows if r[0] in clean})
    assert {r.doc_id for r in seen["near_dedup"]} <= {r.doc_id for r in seen["exact_dedup"]} and len(seen["near_dedup"]) >= 0.8 * len(low)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(spark.createDataFrame([(r.doc_id, r.text, r.source) for r in seen["near_dedup"]], "doc_id long, text string, source string")).collect()}
    assert sum(len(r.text.split()) for r in seen["mixing"]) == pytest.approx(sum(t for t, _ in taken.values()), rel=0.1)
    assert packed_well(seen["packing"], 4096) > 0 and len({(r.doc_id, r.piece) for r in seen["packing"]}) == len({r.doc_id for r in seen["mixing"]})
    assert corpus_pipeline.run(spark, folder).count() == len(seen["packing"])


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def graded(seed, n=40, words=120):
    """n texts, each with copies in which 1 to 6 words are changed: similarities from 0.5 to 0.95."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        base = [f"t{i}w{rnd.randrange(10**6)}" for _ in range(rnd.choice((9, 30, words)))]
        out.append(" ".join(base))
        for k in range(1, 7):
            w = list(base)
            for j in rnd.sample(range(len(w)), min(k, len(w))):
                w[j] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def test_near_dedup_drops_nothing_below_the_level(spark):
    texts = graded(1)
    sets = [shingles(t) for t in texts]
    root = components(list(range(len(texts))), lambda a, b: similar(sets[a], sets[b]))
    kept = {r.doc_id for r in simhash.keep_one(table(spark, [(i, t, None, None, 1) for i, t in enumerate(texts)])).collect()}
    alone = {i for i in root if root[i] == i}
    assert alone <= kept and len(alone) < len(texts)


def test_near_dedup_equals_brute_force(spark):
    texts = [t for seed in (2, 3) for t in graded(seed, 80)]
    texts += [t.replace(" ", "  ") for t in texts[:5]] + ["", " ", "one", "one two"]
    sets = [shingles(t) for t in texts]
    root = components(list(range(len(texts))), lambda a, b: sets[a] == sets[b] or similar(sets[a], sets[b]))
    kept = {r.doc_id for r in simhash.keep_one(table(spark, [(i, t, None, None, 1) for i, t in enumerate(texts)])).collect()}
    assert kept == {i for i in root if root[i] == i}


def test_near_dedup_goes_by_fingerprints(spark, sf, monkeypatch):
    """The stage finds near copies by SimHash and verifies them, without the prefix filter's candidates too."""
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(1, base, None, "a", 1), (2, base + " tail", None, "a", 1), (3, "some other words that stay as they are", None, "a", 1)]
    docs = table(spark, rows)
    links = simhash.simhash_components(docs).collect()
    assert len({r.component_id for r in links if r.id < 3}) == 1 and len({r.component_id for r in links}) == 2
    found = simhash.jaccard.candidates

    def none(texts):
        own, classes, met = found(texts)
        return own, classes, met.limit(0)

    monkeypatch.setattr(simhash.jaccard, "candidates", none)
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf[0]).collect()} == {1, 3}


def test_near_dedup_costs_the_driver_few_plans(spark, sf, monkeypatch):
    """Each of its graphs is written once: small ones take no rounds, whose plans and broadcasts fill the driver."""
    wrote = []
    write = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: wrote.append(name) or write(df, name))
    texts = graded(4)
    kept = corpus_pipeline.near_dedup_stage(spark, table(spark, [(i, t, None, None, 1) for i, t in enumerate(texts)]), sf[0]).count()
    assert 0 < kept < len(texts) and len(wrote) == 4
