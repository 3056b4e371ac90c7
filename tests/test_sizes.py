"""Queries on rows that the small tables lack, against their SQL, and operators on many rows."""

import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from oracle import TABLES, differences
from pyspark.sql import functions as F

from signalbase.operators import cluster, score
from signalbase.plans import catalogue
from signalbase.session import checkpoint


def tables_with(folder, **tables):
    """A folder of the small tables, some replaced."""
    for name in TABLES:
        if name in tables:
            tables[name].toPandas().to_parquet(folder / f"{name}.parquet")
        else:
            (folder / f"{name}.parquet").symlink_to(Path(SF) / f"{name}.parquet")
    return str(folder)


def test_epics_without_tasks(spark, tmp_path):
    customer = spark.read.parquet(f"{SF}/customer.parquet")
    sf = tables_with(tmp_path, customer=customer.union(customer.limit(2).withColumn("c_custkey", -1 - F.col("c_custkey"))))
    found = catalogue.QUERIES["epic_progress"](spark, sf)
    assert found.where("total = 0").count() == 2
    assert differences(found, catalogue.ORACLE["epic_progress"], sf) == ""


def test_benchmark_of_questions_without_terms(spark, tmp_path):
    talks = spark.read.parquet(f"{SF}/conversations.parquet")
    bare = talks.where("turn = 0 and role = 'user'").limit(1)
    ids = F.explode(F.array(*(F.lit(k).cast("long") for k in range(1_000_001, 1_000_007))))
    more = bare.select(*(ids.alias(c) if c == "conv_id" else c for c in talks.columns)).withColumn("text", F.when(F.col("conv_id") % 2 == 0, "A to of, y que."))
    sf = tables_with(tmp_path, conversations=talks.union(more))
    assert differences(catalogue.QUERIES["qa_benchmark"](spark, sf), catalogue.ORACLE["qa_benchmark"], sf) == ""


def test_quake_links_by_definition(spark):
    rng = random.Random(3)
    hours = lambda: rng.choice([float(rng.randrange(600)), rng.uniform(0, 600)])
    places = ("Boquete", "Chitré, Boquete", "David", "Boquete y Chitré")
    told = [(f"g{i % 130}", hours(), rng.choice(places), tuple(round(rng.uniform(4, 6), 1) for _ in range(rng.randint(1, 2)))) for i in range(150)]
    known = [(f"e{i}", hours() if i % 9 else told[i][1], rng.choice(places), round(rng.uniform(4, 6), 2)) for i in range(60)]
    words = lambda p: set(p.lower().replace("é", "e").replace(",", "").split()) - {"y"}
    met = {}
    for g, t, p, said in told:
        met.setdefault(g, []).extend(e for e, u, q, m in known if t - 48 <= u <= t + 12 and words(p) & words(q) and any(abs(x - m) <= 0.2 for x in said))
    want = {(g, e[0]) for g, e in met.items() if len(e) == 1}
    at = lambda c: F.timestamp_micros(F.round(F.col(c) * 3.6e9).cast("long"))
    groups = spark.createDataFrame([(g, t, f"Sismo en {p} de " + " y ".join(f"magnitud {m}" for m in s)) for g, t, p, s in told] + [("none", None, "Sismo de magnitud 5.0 en Boquete")], "group_id string, h double, title string").withColumn("ts", at("h"))
    events = spark.createDataFrame([*known, ("none", None, "David", 5.0), ("void", 5.0, "David", None)], "event_id string, h double, place string, magnitude double").withColumn("event_ts", at("h"))
    assert {tuple(r) for r in score.quake_links(groups, events).collect()} == want and len(want) > 20


def test_quake_links_of_full_windows(spark):
    many, base = 60_000, F.lit("2026-01-10").cast("timestamp")
    groups = spark.range(many).select(F.concat(F.lit("g"), "id").alias("group_id"), F.lit("Sismo de magnitud 4.6 en Boquete").alias("title"), base.alias("ts"))
    events = spark.range(many).select(F.concat(F.lit("e"), "id").alias("event_id"), base.alias("event_ts"), F.lit(4.6).alias("magnitude"), F.lit("Boquete").alias("place"))
    began = time.monotonic()
    assert score.quake_links(groups, events).count() == 0
    assert score.quake_links(groups, events.limit(1)).count() == many
    assert time.monotonic() - began < 60


def vectors(rng, n, centers=40, width=16):
    x = rng.normal(size=(centers, width))[rng.integers(0, centers, n)] + rng.normal(0, 0.7, (n, width))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("links", [0, 40_000_000])
def test_linkage_by_candidates(monkeypatch, links):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(cluster, "LINKS", links)
    monkeypatch.setattr(cluster, "BLOCK", 64)
    for x in (vectors(rng, 700), vectors(rng, 200)[rng.integers(0, 200, 500)], 30 * vectors(rng, 300), np.zeros((3, 4)), vectors(rng, 1)):
        for least in (0.7, 0.3, -0.2):
            assert sorted(cluster.average_link_vectors(x, least)) == sorted(cluster.average_link(x @ x.T, least))


def test_one_component_meets_candidates_only(monkeypatch):
    def all_of_them(*_):
        raise AssertionError("a large component of few links compared with all clusters")

    monkeypatch.setattr(cluster, "_average_link_dense", all_of_them)
    rng = np.random.default_rng(6)
    x = vectors(rng, 6000, 600, 64)
    began = time.monotonic()
    found = cluster.average_link_vectors(x, 0.35)
    assert sorted(i for c in found for i in c) == list(range(6000)) and time.monotonic() - began < 30


def test_groups_by_candidates_as_by_matrix(spark):
    x = vectors(np.random.default_rng(6), 900, 90, 16)
    df = spark.createDataFrame([(i, float(i % 20) / 2, v.tolist()) for i, v in enumerate(x)], "k long, d double, v array<double>")
    similar = x @ x.T
    label, old = np.arange(900), None
    while old is None or (label != old).any():
        old, label = label, np.where(similar >= 0.5, label[None, :], 900).min(1)
    want = set()
    for c in set(label.tolist()):
        mine = np.array(sorted(np.flatnonzero(label == c), key=lambda i: (i % 20, i)))
        want |= {frozenset(mine[part].tolist()) for part in cluster.average_link(similar[np.ix_(mine, mine)], 0.5)}
    got = {}
    for k, g in cluster.group_events(df, "k", "d", "v", 10, 0.5, 10.0, checkpoint).collect():
        got.setdefault(g, set()).add(k)
    assert {frozenset(g) for g in got.values()} == want and max(np.bincount(label)) > cluster.DENSE


@pytest.mark.parametrize("links", [300, 5000])
def test_linkage_by_levels(monkeypatch, links):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(cluster, "LINKS", links)
    for x in (vectors(rng, 700), vectors(rng, 200)[rng.integers(0, 200, 500)]):
        for least in (0.7, 0.3, -0.2):
            assert sorted(cluster.average_link_vectors(x, least)) == sorted(cluster.average_link(x @ x.T, least))


@pytest.mark.parametrize("links", [5000, 24_000_000])
def test_pairs_of_a_large_component_by_many_tasks(spark, monkeypatch, links):
    monkeypatch.setattr(cluster, "SPREAD", 200)
    monkeypatch.setattr(cluster, "LINKS", links)
    x = vectors(np.random.default_rng(9), 1100, 90, 16)
    part = np.where(np.arange(1100) < 900, 0, 1)
    df = spark.createDataFrame([(i, int(part[i]), v.tolist()) for i, v in enumerate(x)], "k long, component long, v array<double>")
    want = set()
    for c in (0, 1):
        mine = np.flatnonzero(part == c)
        want |= {frozenset(mine[g].tolist()) for g in cluster.average_link(x[mine] @ x[mine].T, 0.5)}
    got = {}
    for k, c, g in cluster.split_components(df, "k", "v", 0.5).collect():
        assert c == part[k]
        got.setdefault(g, set()).add(k)
    assert {frozenset(g) for g in got.values()} == want and all(min(g) == name for name, g in got.items())


def test_shingles_mix_each_word_once(monkeypatch):
    ngram_join = pytest.importorskip("signalbase.llm.ngram_join")
    from signalbase.llm._text import chunks

    mixed, mix = [], ngram_join.mix64
    monkeypatch.setattr(ngram_join, "mix64", lambda x: mixed.append(len(x)) or mix(x))
    text = pa.array([" ".join(f"w{i % 700}" for i in range(1000))])
    (_, found), = (pair for chunk in chunks(text) for pair in ngram_join.document_sets(chunk))
    assert len(found) == 700 and (np.diff(found.astype(object)) > 0).all() and sum(mixed) < 2500
