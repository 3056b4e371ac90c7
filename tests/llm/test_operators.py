"""Each operator against a brute-force version on small or whole tables, and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import differences
from pyspark.sql import functions as F

from signalbase.llm import _bpe, chat_format, cotraining, decontamination, ngram_join, packing, ppm, quality_rules, queries, secret_scan, token_counts, url_filter
from signalbase.llm._text import hash_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [(1, None, None), (2, "", "a"), (3, "uno", "a"), (3, "uno", "a"), (4, " \t\n ", "b"), (5, LONG, "b"), (6, "x" * 5000, None), (7, "año ñandú — 東京 token = AbCd1234EfGh5678 \U0001f600", "c"), (None, "sin id pero con texto", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, source string"
    return spark.createDataFrame(ODD, schema).withColumns({"lang": F.lit("es"), "n_chars": F.length("text").cast("long"), "kept": F.lit("x"), "class": F.lit(1), "found": F.lit(2), "key": F.lit(3), "length": F.lit(4)})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def base_rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def test_quality_rules(docs, labels, odd):
    trusted = quality_rules.trusted_ids(labels)
    ratio = quality_rules.fit_ratio(docs, trusted)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, ratio).collect()}
    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    cells = {}
    m = (1 << 64) - 1
    for r in docs.collect():
        h = [hash_bytes(w.encode()) for w in WORD.findall(r["text"])]
        one = [(x * quality_rules.UNIGRAM & m) >> 50 for x in h]
        two = [((a * quality_rules.UNIGRAM + b * quality_rules.BIGRAM & m) * quality_rules.BIGRAM & m) >> 50 for a, b in zip(h, h[1:])]
        cells[r["doc_id"]] = one + two
        np.add.at(raw, one + two, 1)
        if r["doc_id"] in set(trusted):
            np.add.at(target, one + two, 1)
        want = base_rules(r["text"])
        assert tuple(got[r["doc_id"]])[1:7] == want
    expect = np.log((target + 1) / (target.sum() + len(raw))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    assert np.allclose(ratio, expect)
    for i, c in cells.items():
        score = float(expect[c].mean()) if c else 0.0
        assert got[i]["score"] == pytest.approx(score, abs=1e-7)
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["score"] >= quality_rules.THRESHOLD)
    good = [r["doc_id"] for r in labels.where("quality = 1").collect()]
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in good)
    assert quality_rules.judge(odd, ratio).count() == len(ODD)
    assert quality_rules.keep_good(odd, ratio).columns == odd.columns
    empty = docs.where("false")
    assert quality_rules.judge(empty, quality_rules.fit_ratio(empty, [])).count() == 0


def test_cotraining(docs, labels, odd):
    scored = cotraining.classify(docs, labels)
    assert scored.count() == docs.count()
    seen = labels.join(scored, "doc_id")
    right = seen.where("kept = (quality = 1)").count() / seen.count()
    assert right > 0.95
    rows = odd.select("doc_id", "text", "lang", "source")
    assert cotraining.classify(rows, labels).count() == len(ODD)
    assert cotraining.classify(rows, labels.where("false")).where("score <> 0.5").count() == 0


def test_cotraining_holds_out():
    rng = np.random.default_rng(0)
    y = (np.arange(600) % 2).astype(float)
    x = [np.column_stack((y + rng.normal(0, 0.4, 600), rng.normal(0, 1, 600))).astype(np.float32) for _ in (0, 1)]
    check = np.arange(600) % 3 == 2
    model = cotraining.cotrain([v[:300] for v in x], y[:300], check[:300], cotraining.among([v[300:] for v in x]))
    z = sum(cotraining.calibrated(model, tuple(v[300:] for v in x)))
    assert ((z > 0) == (y[300:] > 0)).mean() > 0.9


def test_cotraining_over_a_table_equals_the_one_in_memory(docs, labels, spark, tmp_path):
    """The same model, from all documents, repeated ones and ones without id included."""
    extra = docs.limit(30).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    cotraining.features(docs.union(extra)).write.parquet(f"{tmp_path}/x")
    table = spark.read.parquet(f"{tmp_path}/x")
    model = cotraining.fit(table, labels, seed_rows=90, growth=20)
    rows = table.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", cotraining._place("doc_id").alias("place"), "x").toArrow()
    ids, place, x = np.asarray(rows["doc_id"]), np.asarray(rows["place"]), cotraining._sides(rows["x"].combine_chunks())
    y = {r["doc_id"]: float(r["quality"]) for r in labels.collect()}
    order = np.lexsort((ids, place))
    seeds = [i for i in order if ids[i] in y][:90]
    others = [i for i in order if i not in set(seeds)]
    want = cotraining.cotrain([v[seeds] for v in x], np.array([y[ids[i]] for i in seeds]), np.arange(90) % 3 == 2, cotraining.among([v[others] for v in x], ids[others], place[others], 20))
    for (w, ab), (v, cd) in zip(model, want):
        assert np.allclose(w, v, atol=1e-4) and np.allclose(ab, cd, atol=1e-3)
    # held out: labelled documents that were not among the seeds
    scored = {r["doc_id"]: r["kept"] for r in cotraining.score(table, model).collect()}
    rest = [i for i in y if i not in set(ids[seeds].tolist()) and i in scored]
    assert len(rest) > 20 and np.mean([scored[i] == (y[i] == 1) for i in rest]) > 0.9
    none = table.where("false")
    assert cotraining.score(none, cotraining.fit(none, labels)).count() == 0


def test_decontamination(docs, spark, odd):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    indexes = decontamination.build(benchmark)
    items = benchmark.collect()
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, indexes).collect()}
    want = {(r["doc_id"], i["item_id"]) for r in docs.collect() for i in items if i["text"] in r["text"]}
    assert found == want and want
    assert decontamination.drop_leaks(docs, indexes).count() == docs.count() - len({d for d, _ in want})
    assert decontamination.leaks(odd, indexes).count() == 0
    nothing = decontamination.build(benchmark.where("false"))
    assert decontamination.leaks(docs, nothing).count() == 0


def test_decontamination_verifies_long_items_whole(spark):
    rng = np.random.default_rng(4)
    some = lambda n: [f"z{x}" for x in rng.integers(0, 10**6, n)]
    items = {1: [*some(299), "fin?", *some(100)], 2: [*some(128), "the"], 3: some(700)}
    benchmark = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    clean = [["the", *some(50)], some(900), ["the"], items[1][:128], items[1][100:300], items[1][:300], items[1][300:], items[3][128:256], items[3][:400]]
    leaked = [(k, [*some(at), *v, *some(at)]) for k, v in items.items() for at in (0, 77, 400)]
    texts = [" ".join(x) for x in clean] + [" ".join(x) for _, x in leaked]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    indexes = decontamination.build(benchmark)
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, indexes).collect()}
    assert found == {(len(clean) + i, k) for i, (k, _) in enumerate(leaked)}
    assert {r["doc_id"] for r in decontamination.drop_leaks(docs, indexes).collect()} == set(range(len(clean)))


def bm25(items, passage):
    """Every item's score for a passage's words, by the definition, segment by segment."""
    pieces = [(i, x) for i, words in items for x in decontamination.segments(words)]
    mean = sum(len(x) for _, x in pieces) / len(pieces)
    holding = Counter(t for _, x in pieces for t in set(x))
    best = {}
    for i, x in pieces:
        norm = decontamination.K1 * (1 - decontamination.B + decontamination.B * len(x) / mean)
        worth = {t: math.log1p((len(pieces) - holding[t] + 0.5) / (holding[t] + 0.5)) * n * (decontamination.K1 + 1) / (n + norm) for t, n in Counter(x).items()}
        best[i] = max(best.get(i, 0.0), sum(v for t, v in worth.items() if t in passage) / sum(worth.values()))
    return best


def test_decontamination_in_shards_equals_brute_force(spark, monkeypatch):
    """Long, repeated, null and short items in one shard and in many, against all pairs."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"q{x}" for x in rng.zipf(1.3, n) % 5000]
    items = [(i, [*words(int(rng.integers(12, 60))), "donde?", *words(int(rng.integers(6, 20)))]) for i in range(40)]
    items += [(40, words(300)), (41, words(150)), (42, items[0][1]), (0, items[0][1]), (None, words(30))]
    rows = [(i, " ".join(w)) for i, w in items] + [(50, None), (51, "")]
    texts = []
    for k in range(60):
        part = items[int(rng.integers(len(items)))][1]
        cut = part[: int(rng.integers(len(part) // 2, len(part) + 1))] if k % 2 else part
        texts.append(" ".join([*words(int(rng.integers(0, 200))), *cut, *words(int(rng.integers(0, 200)))]))
    texts += [None, "", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    once = sorted(map(tuple, decontamination.leaks(docs, decontamination.build(benchmark)).collect()), key=str)
    monkeypatch.setattr(decontamination, "SHARD_ITEMS", 9)
    shards = decontamination.build(benchmark)
    assert len(shards) > 3
    many = sorted(map(tuple, decontamination.leaks(docs, shards).collect()), key=str)
    assert once == many
    want = {(d, i) for d, t in enumerate(texts) for i, w in items if t and " " + " ".join(w) + " " in f" {t} "}
    assert want <= {(d, i) for d, i, *_ in once}
    hashed = [(n, [hash_bytes(w.encode().replace(b"?", b"")) for w in x]) for n, (_, x) in enumerate(items)]
    for d, i, score, *sides in once:
        # a window holds part of the document, so its score is the whole document's at most
        scores = bm25(hashed, {hash_bytes(w) for w in decontamination.words_of(texts[d])})
        assert decontamination.TAU <= score <= max(scores[n] for n, (j, _) in enumerate(items) if j == i) + 1e-6
        assert min(sides) >= decontamination.OVERLAP


def test_block_max_retrieval_equals_scoring_all():
    rng = np.random.default_rng(1)
    words = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(words, 20))) for i in range(150)]
    index = decontamination.Index(items, tau=0.3)
    for _ in range(50):
        passage = np.array([hash_bytes(w.encode()) for w in rng.choice(words, 40)], np.uint64)
        terms = np.unique(index.lookup(passage))
        score = np.zeros(len(items))
        for t in terms:
            a, b = index.pointer[t], index.pointer[t + 1]
            score[index.item[a:b]] += index.impact[a:b]
        got, values = index.retrieve(terms)
        assert got.tolist() == np.flatnonzero(score >= 0.3).tolist() and np.allclose(values, score[got])


def test_token_counts(docs, odd):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.vocabulary(token_counts.default_path())
    unknown = next(i for i, (p, _) in enumerate(pieces) if p == "<unk>")
    whole = Tokenizer(models.Unigram(pieces, unknown, True))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 200").collect()} | {-i: t for i, t in enumerate(["a  b", " x", "\n\t", "東京 x", "▁a▁", "naïve\U0001f600"], 1)}
    counter = token_counts.Counter(pieces)
    for t in texts.values():
        assert counter.count(t) == len(whole.encode(t, add_special_tokens=False).ids), t[:80]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(odd).collect()}
    assert got[1] == got[2] == 0 and len(got) == len({r[0] for r in ODD})
    long = "ñandú🙂x" * 3000
    assert counter.count(long) == len(whole.encode(long, add_special_tokens=False).ids) and long not in counter.cache
    assert token_counts.count_tokens(docs.where("false")).count() == 0


def test_ngram_join(docs, odd):
    assert differences(ngram_join.join(docs), queries.ORACLE_SQL["op5_ngram_join"], SF) == ""
    rows = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(odd).collect()), key=str)
    assert len(rows) == len(ODD) and (1, 0, 1) in rows and (3, 1, 3) in rows
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert ngram_join.join(docs.where("false")).count() == 0


def test_keep_first_of_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a + " fin"), (None, b), (None, b), (None, "uno"), (5, a), (7, c), (7, d), (7, d + " fin"), (9, c), (3, "dos"), (3, "tres"), (3, "tres"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_first(docs).collect()), key=str)
    fixed = [(None, b), (None, "uno"), (5, a), (7, c), (3, "dos"), (3, "tres"), (4, None)]
    assert set(fixed) <= set(kept) and len(kept) == 8
    assert (set(kept) - set(fixed)) <= {(7, d), (7, d + " fin")}


def test_ngram_join_over_many_leaves(spark, monkeypatch):
    """Texts that share most of a long passage, in many sizes, and several leaves a key."""
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(400)]
    rows = []
    for i in range(140):
        words = passage[: int(rng.integers(150, 400))] + [f"t{i}x{j}" for j in range(int(rng.integers(0, 90)))]
        for at in rng.integers(0, len(words), int(rng.integers(0, 6))):
            words[at] = f"e{i}y{at}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    least = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while any(least[i] != least[j] for i, j in links):
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    numbered = []
    whole = ngram_join._survivors
    few = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    monkeypatch.setattr(ngram_join, "HOT", 5)
    monkeypatch.setattr(ngram_join, "_survivors", lambda *a: numbered.append(1) or whole(*a))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == few == dict(enumerate(least)) and numbered and len(set(least)) > 1


def test_ngram_join_of_texts_with_a_common_line(spark, monkeypatch):
    """Short texts of a licence and few words of their own, some of them near copies: the
    licence's segments are hot, and routing by rarity leaves few to compare."""
    rng = np.random.default_rng(11)
    licence = [f"lic{i}" for i in range(24)]
    rows = []
    for i in range(500):
        own = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(16, 24)))]
        rows.append(licence + own)
        if i % 10 == 0:
            rows.append([*licence, *own, "fin"])
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in rows]
    least = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                least[i] = least[j] = min(least[i], least[j])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    compared = []
    whole = ngram_join._close
    monkeypatch.setattr(ngram_join, "_close", lambda label, members, *a: compared.append(sum(r["count"] ** 2 for r in members.groupBy("key").count().collect())) or whole(label, members, *a))
    for hot in (10**9, 20):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(df).collect()} == dict(enumerate(least))
    assert compared[0] > 10_000 and compared[1] < compared[0] / 10


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 80), st.integers(0, 80), st.integers(0, 1 << 30))
def test_linked_sets_share_a_key(common, a, b, seed):
    rng = np.random.default_rng(seed)
    draw = np.unique(rng.integers(0, 1 << 63, common + a + b).astype(np.uint64))
    x, y = np.sort(draw[: common + a]), np.sort(np.concatenate((draw[:common], draw[common + a :])))
    if ngram_join.linked(common, len(x), len(y)):
        assert set(ngram_join.routing_keys(x).tolist()) & set(ngram_join.routing_keys(y).tolist())
        assert 9 * ngram_join.overlap_bounds(ngram_join.point_of(x)[None], ngram_join.point_of(y)[None])[0] >= 4 * (len(x) + len(y))


def test_ngram_join_tells_sets_of_one_print_apart(spark, monkeypatch):
    """All sets get one of three first prints; their second prints keep classes apart."""
    whole = ngram_join.prints_of
    monkeypatch.setattr(ngram_join, "prints_of", lambda s: (whole(s)[1] % 3, whole(s)[1]))
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in "abcdefgh"]
    texts += [t + " fin" for t in texts[:4]] + texts[2:6] + ["uno", ""]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if i < 8 or i > 15 else i - 8 if i < 12 else i - 10 for i in range(len(texts))}


def test_rtree_search_is_complete():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(50, 90, 300))
    points = np.stack([np.bincount(rng.integers(0, 64, n), minlength=64) for n in sizes]).astype(np.uint16)
    points[150:] = points[:150]
    sizes = points.sum(1)
    order = np.argsort(sizes, kind="stable")
    tree = ngram_join.RTree(points[order], sizes[order])
    for i in range(0, 300, 7):
        at, bound = tree.search(points[i], int(sizes[i]))
        every = np.minimum(points[order], points[i]).sum(1)
        want = np.flatnonzero((9 * every >= 4 * (sizes[i] + sizes[order])) & (5 * sizes[order] >= 4 * sizes[i]) & (5 * sizes[i] >= 4 * sizes[order]))
        assert set(want.tolist()) <= set(at.tolist()) and (bound == every[at]).all()


def secrets_of(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secret_scan(docs, odd, spark):
    for rows in (docs, odd):
        got = secret_scan.digest(secret_scan.scan(rows)).collect()
        texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
        for r in got:
            want = secrets_of(texts[r["doc_id"]])
            joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
            assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 48)) for _ in range(20)]
    plain = ["articulo_numero_uno_de_2024_sobre_el_canal", "https://x.com/a", "ungeheitkeitlicheinungschaft"]
    df = spark.createDataFrame([(i, f"é {t} fin") for i, t in enumerate(noise + plain)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.digest(secret_scan.scan(df)).collect()}
    assert sum("random:2:50" in spans[i] for i in range(20)) >= 17
    assert all("random" not in spans[i] for i in range(20, 23))
    red = {r["doc_id"]: r["text"] for r in secret_scan.redact(odd).collect()}
    assert "[SECRET]" in red[7] and red[5] == LONG and red[1] is None
    assert secret_scan.scan(docs.where("false")).count() == 0


def test_secret_scan_finds_secrets_joined_to_names_and_paths(spark):
    rng = np.random.default_rng(5)
    plain, marked = (list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + x) for x in ("", "+/"))
    forms = [("AWS_SECRET_ACCESS_KEY=", marked, ""), ("client_key=", marked, "="), ("a=b&SIG=", plain, ""), ("https://x.com/api-v1/", plain, ""), ("/api-v1/reset_link/", plain, "")]
    made = [(head, "".join(rng.choice(letters, 40)) + tail) for head, letters, tail in forms for _ in range(8)]
    df = spark.createDataFrame([(i, f"antes {head}{secret} fin") for i, (head, secret) in enumerate(made)], "doc_id long, text string")
    red = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    for form in range(len(forms)):
        assert sum(made[i][1] not in red[i] and "[SECRET]" in red[i] for i in range(8 * form, 8 * form + 8)) >= 7, forms[form][0]
    assert sum(red[i] == "antes AWS_SECRET_ACCESS_KEY=[SECRET] fin" for i in range(8)) >= 6
    names = spark.createDataFrame([(0, "/static-v2/articulo_numero_uno_de_2024/el_canal=ver-todo/2024")], "doc_id long, text string")
    assert secret_scan.redact(names).first()["text"] == "/static-v2/articulo_numero_uno_de_2024/el_canal=ver-todo/2024"


def test_secret_scan_controls_false_discoveries(spark):
    """Spans against Benjamini-Hochberg by its definition over all candidates of a length."""
    rng = np.random.default_rng(6)
    noise = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    names = "canal puerto lluvia informe mesa Panama norte Azuero costa Servicio".split()
    texts = []
    for i in range(400):
        made = "".join(rng.choice(noise, int(rng.integers(16, 70)))) if i % 3 else "".join(rng.choice(names, int(rng.integers(3, 9)))) + str(rng.integers(10, 3000))
        texts.append(f"un {made} fin")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.digest(secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    found = []
    for i, t in enumerate(texts):
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not secrets_of(t):
                logs = secret_scan.battery(np.frombuffer(m[0].encode(), np.uint8))
                found.append((sum(len(m[0]) >= x for x in secret_scan.STRATA), 10.0 ** secret_scan.combined(logs), i, f"random:{m.start()}:{m.end()}"))
    want = {}
    for stratum in {f[0] for f in found}:
        p = np.array([f[1] for f in found if f[0] == stratum])
        kept = [x for x in p if x <= secret_scan.FDR * (p <= x).sum() / len(p)]
        want |= {f[2]: f[3] for f in found if f[0] == stratum and kept and f[1] <= max(kept)}
    assert {i: x for i, x in got.items() if "random" in x} == want
    assert sum(i % 3 > 0 for i in want) > 150 and sum(i % 3 == 0 for i in want) <= 1


def test_tests_of_randomness_know_natural_names():
    rng = np.random.default_rng(2)
    draw = lambda n, p: sum(rng.random(n) < p)
    tails = [10 ** secret_scan.log10_binomial_tail(30, k, 0.2) for k in range(31)]
    seen = np.array([draw(30, 0.2) for _ in range(4000)])
    assert all(abs((seen >= k).mean() - tails[k]) < 0.03 for k in range(31))
    shifted = rng.noncentral_chisquare(7, 20, 20_000)
    for x in (8.0, 15.0, 25.0, 40.0):
        assert abs((shifted < x).mean() - 10 ** secret_scan.log10_uniformity(x, 7, 20.0)) < 0.02
    assert secret_scan._log10_normal_below(-29.9) == pytest.approx(secret_scan._log10_normal_below(-30.1), abs=3)
    assert secret_scan.combined((0.0, 0.0, 0.0)) == 0.0 and secret_scan.combined((-3.0, -3.0, -3.0)) == pytest.approx(math.log10(math.e) - 3)


def test_packing(docs, odd):
    for rows in (docs, odd):
        got = packing.pack(rows).collect()
        bpe, want = _bpe.load(_bpe.default_path()), Counter()
        for r in rows.collect():
            ids = np.array(bpe.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
            want.update((r["doc_id"], k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids))))
        assert Counter(tuple(r)[:5] for r in got) == want
        by = {}
        for r in got:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in by.values():
            places.sort()
            assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
            assert sum(n for _, n in places) <= packing.CAPACITY
        bound = -(-sum(r["length"] for r in got) // packing.CAPACITY)
        assert len(by) <= bound + max(2, bound // 100)
    assert packing.pack(docs.where("false")).count() == 0


def test_pricing_is_an_exact_knapsack():
    rng = np.random.default_rng(4)
    for _ in range(20):
        prices = np.concatenate(([0.0], rng.random(12)))
        best = [0.0] * 13
        for c in range(1, 13):
            best[c] = max([best[c - 1]] + [prices[n] + best[c - n] for n in range(1, c + 1)])
        worth, last = packing.price_out(prices, 12)
        assert worth == pytest.approx(best)
        for head in range(1, 13):
            found = packing.configuration(last, head, 12)
            assert sum(n * k for n, k in found.items()) <= 12 and found[head]
            assert sum(prices[n] * k for n, k in found.items()) == pytest.approx(prices[head] + best[12 - head])


def _histograms():
    rng = np.random.default_rng(9)
    for kind in range(4):
        counts = np.zeros(packing.CAPACITY + 1, np.int64)
        if kind == 0:  # nearly all lengths
            counts[rng.choice(np.arange(1, packing.CAPACITY), 2004, replace=False)] = rng.integers(0, 50, 2004)
        elif kind == 1:  # few pieces of most lengths
            np.add.at(counts, np.exp(rng.normal(6, 0.8, 900)).astype(int) % packing.CAPACITY + 1, 1)
        elif kind == 2:  # millions
            np.add.at(counts, np.exp(rng.normal(6, 1, 300_000)).astype(int) % packing.CAPACITY + 1, 10)
        else:  # around a third and a half of a sequence
            np.add.at(counts, rng.integers(660, 1100, 400), rng.integers(1, 99, 400))
        counts[packing.CAPACITY] = 0
        yield counts


def test_the_linear_program_covers_every_length():
    sizes = np.arange(packing.CAPACITY + 1)
    for counts in _histograms():
        uses, bound = packing.solve_lp(counts)
        covered = np.zeros(len(counts))
        for config, use in uses:
            assert use > 0 and sum(n * k for n, k in config.items()) <= packing.CAPACITY
            for n, k in config.items():
                covered[n] += use * k
        assert np.allclose(covered, counts)
        plan = packing.make_plan(counts)
        packed = np.zeros(len(counts), np.int64)
        for config, times in plan:
            assert sum(n * k for n, k in config) <= packing.CAPACITY
            for n, k in config:
                packed[n] += k * times
        assert (packed == counts).all()
        n = sum(times for _, times in plan)
        assert np.ceil((counts * sizes).sum() / packing.CAPACITY) <= np.ceil(bound - 1e-6) <= n
        assert n <= sum(times for _, times in packing.best_fit(counts)) and n <= 1.06 * bound
    assert packing.solve_lp(np.zeros(packing.CAPACITY + 1, np.int64)) == ([], 0.0)


def test_plans_against_the_optimum():
    """Exhaustive search over small histograms of a capacity of 12."""
    rng = np.random.default_rng(3)

    def optimum(pieces, rooms):
        if not pieces:
            return len(rooms)
        best, tried = len(rooms) + len(pieces), set()
        for i, room in enumerate(rooms):
            if room >= pieces[0] and room not in tried:
                tried.add(room)
                best = min(best, optimum(pieces[1:], rooms[:i] + [room - pieces[0]] + rooms[i + 1 :]))
        return min(best, optimum(pieces[1:], [*rooms, 12 - pieces[0]])) if len(rooms) < best else best

    over = 0
    for _ in range(25):
        pieces = sorted(rng.integers(1, 12, 8).tolist(), reverse=True)
        counts = np.bincount(pieces, minlength=13)
        least = optimum(pieces, [])
        n = sum(times for _, times in packing.make_plan(counts, 12))
        assert packing.solve_lp(counts, 12)[1] <= least + 1e-9 and least <= n <= least + 1
        over += n - least
    assert over <= 2


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=0x27F, exclude_categories=["Cs"]), max_size=40))
def test_rank_table_ids_are_the_tokenizers(text):
    bpe = _bpe.load(_bpe.default_path())
    assert bpe.encode(text.encode()).tolist() == bpe.tokenizer.encode(text, add_special_tokens=False).ids


def test_url_filter(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    extra = spark.createDataFrame([(-1, None, None), (-2, "no scheme", ""), (-3, "HTTP://A.Example.COM/en/7?x", "<a href='//z.org/q'>"), (-4, "x://example.com", None)], "page_id long, url string, html string")
    rows = pages.select("page_id", "url", "html").unionByName(extra)
    got = {r["page_id"]: r for r in url_filter.judge(rows).collect()}
    for r in rows.collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (m[1].translate(FOLD), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        g = got[r["page_id"]]
        assert (g["host"], g["path"], g["rule"]) == (host, path, max(fits)[1] if fits else None)
        if fits:
            assert g["verdict"] == max(fits)[2]
    assert got[-1]["verdict"] == "allow"


def test_page_rank(spark):
    from signalbase.llm._spark import Scratch

    edges = [("a", "b"), ("b", "c"), ("d", "c"), ("c", "a"), ("e", "d")]
    seeds = [("a", "trust"), ("c", "distrust")]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "host string, kind string"), Scratch(spark, "t"), converged=1e-6).collect()}
    for kind, way, seed in (("trust", edges, "a"), ("distrust", [(b, a) for a, b in edges], "c")):
        rank = page_rank(way, [seed])
        assert sum(rank.values()) == pytest.approx(1.0)
        for h in rank.keys() | got.keys():
            assert got.get(h, (0.0, 0.0))[kind == "distrust"] == pytest.approx(rank.get(h, 0.0), abs=1e-5)


def page_rank(way, seeds, damping=0.85):
    """Personalised PageRank by the definition, on dicts; dangling rank goes to the seeds."""
    rank = {s: 1 / len(seeds) for s in seeds}
    onward = Counter(u for u, _ in way)
    for _ in range(300):
        after = Counter()
        for u, v in way:
            after[v] += damping * rank.get(u, 0) / onward[u]
        back = sum(r * ((1 - damping) if onward[h] else 1.0) for h, r in rank.items())
        for s in seeds:
            after[s] += back / len(seeds)
        rank = after
    return rank


def test_url_verdicts_against_brute_force(spark):
    """Pages that link to others, rows twice and clashing columns; and an empty table."""
    rng = np.random.default_rng(7)
    hosts = [f"{a}.{b}" for a in ("a.example", "b", "c.d", "example", "news", "x") for b in ("com", "net", "org", "info", "dev")]
    paths = ["/en/1", "/en/7", "/de/1", "/de/8x", "/es/2", "/", "", "/a?b"]
    rows = []
    for i in range(300):
        links = "".join(f"<a href='//{hosts[j]}/q'>" for j in rng.integers(0, len(hosts), int(rng.integers(0, 3))))
        host = hosts[int(rng.integers(len(hosts)))]
        usual = {"com": "/en/1", "org": "/es/2", "net": "/de/1"}.get(host.rpartition(".")[2]) if rng.random() < 0.8 else None
        rows.append((i, f"https://{host}{usual or paths[int(rng.integers(len(paths)))]}", links))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("z"), "kind": F.lit(1), "trust": F.lit(2), "rank": F.lit(3)})
    got = Counter(tuple(r) for r in url_filter.judge(df).collect())
    parsed = []
    for i, url, html in rows:
        m = re.match(r".*?://([^/?#]*)([^?#]*)", url)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (m[1] == h or m[1].endswith("." + h)) and m[2].startswith(p)]
        parsed.append((i, m[1], m[2], *(max(fits)[1:] if fits else (None, None)), re.findall(r"//([^/]+)/q", html)))
    seen = {h for _, h, *_ in parsed}
    edges = {(h, to) for _, h, _, _, _, out in parsed for to in out}
    edges |= {e for h in seen if h.partition(".")[2] in seen for e in ((h, h.partition(".")[2]), (h.partition(".")[2], h))}
    edges = sorted(e for e in edges if e[0] != e[1])
    votes = {h: Counter(v for _, x, _, _, v, _ in parsed if x == h) for h in seen}
    bad = [h for h, c in votes.items() if 2 * c["block"] >= sum(c.values())]
    good = [h for h, c in votes.items() if h not in bad and c["allow"] > c["block"]]
    assert bad and good
    trust, distrust = page_rank(edges, good), page_rank([(b, a) for a, b in edges], bad)
    of = {h: "block" if distrust.get(h, 0) >= url_filter.THRESHOLD * (trust.get(h, 0) + distrust.get(h, 0)) > 0 else "allow" for h in seen}
    want = Counter((i, h, p, rule, v or of[h]) for i, h, p, rule, v, _ in parsed)
    assert got == want and len({v for *_, rule, v in want if rule is None}) == 2
    assert url_filter.judge(df.where("false")).count() == 0


def test_chat_format(spark, monkeypatch):
    assert differences(queries.op9_chat_format(spark, SF), queries.ORACLE_SQL["op9_chat_format"], SF) == ""
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx <\\| ñ\U0001f600 "), (1, 1, "assistant", ""), (2, 0, None, "<"), (None, 0, "a\nb\\", "x"), (3, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    made = chat_format.format_conversations(df.withColumns({"ids": F.lit(1), "block": F.lit(2)}))
    again = {r["conv_id"]: tuple(r) for r in chat_format.read_back(made, in_order=True).collect()}
    assert again == {k: tuple(r) for k, r in got.items()}
    assert chat_format.read_back(chat_format.format_conversations(df.where("false"))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<\\|im_end>x\n"), max_size=30))
def test_escape_is_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert "<|" not in chat_format.escape(text)


def test_blocks_encode_as_the_whole():
    tokenizer = chat_format._tokenizer(_bpe.default_path())
    parts = [chat_format.render([("user", "hola "), ("assistant", " qué\n\n")])[0], chat_format.render([("user", "<|im_start|>\n")])[0]]
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    assert ids(parts[0]) + ids(parts[1]) == ids("".join(parts))


def brute_ppm(train, text, order):
    counts = [dict() for _ in range(order + 1)]
    fold = lambda t: b"\0" * order + bytes(t.translate(FOLD).encode()) + b"\0"
    for t in train:
        raw = fold(t)
        for i in range(order, len(raw)):
            for j in range(order + 1):
                counts[j].setdefault(raw[i - j : i], Counter())[raw[i]] += 1
    raw, total = fold(text), 0.0
    for i in range(order, len(raw)):
        out = set()
        for j in range(order, -1, -1):
            seen = counts[j].get(raw[i - j : i])
            if seen is None:
                continue
            left = {s: n for s, n in seen.items() if s not in out}
            if not left:
                continue
            size = sum(left.values()) + len(left)
            if raw[i] in left:
                total += math.log10(left[raw[i]] / size)
                break
            total += math.log10(len(left) / size)
            out |= set(seen)
        else:
            total -= math.log10(256 - len(out))
    return total


def test_ppm(spark, odd):
    texts = ["abracadabra", "Abra CADABRA abra", "la casa de la abuela", "", None, "zzz", "la abuela ñ", "casa casa casa", "abra la casa", "qué"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ppm.score(df).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    train = [t or "" for i, t in enumerate(texts) if not held[i]]
    words = Counter(w for t in train for w in [*WORD.findall(t.translate(FOLD)), None])
    n, v = sum(words.values()), len(words)
    for i, t in enumerate(texts):
        mine = [*WORD.findall((t or "").translate(FOLD)), None]
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held[i], len(mine), sum(w in words for w in mine), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in mine))
        assert got[i]["score"] == pytest.approx(brute_ppm(train, t or "", ppm.MAX_ORDER))
    assert ppm.score(odd).count() == len(ODD)
    assert ppm.score(df.where("false")).count() == 0


def test_ppm_scores_follow_neither_blocks_nor_buckets(docs, monkeypatch):
    few = docs.where("doc_id < 60").repartition(3)
    texts = {r["doc_id"]: r["text"] for r in few.collect()}
    whole = {r["doc_id"]: r["score"] for r in ppm.score(few).collect()}
    monkeypatch.setattr(ppm, "BLOCK", 3000)
    monkeypatch.setattr(ppm, "BUCKET_GRAMS", 200)
    cut = {r["doc_id"]: r["score"] for r in ppm.score(few).collect()}
    assert whole.keys() == cut.keys() == texts.keys()
    assert all(cut[i] == pytest.approx(whole[i]) for i in whole)
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    for i in [min(texts, key=lambda i: len(texts[i])), *(i for i in sorted(texts) if zlib.crc32(str(i).encode()) % 5 == 1)][:3]:
        assert cut[i] == pytest.approx(brute_ppm(train, texts[i], ppm.MAX_ORDER))


def test_rare_words_join_as_frequent_ones(docs, monkeypatch):
    few = docs.where("doc_id < 100")
    a = {r["doc_id"]: r for r in ppm.score(few).collect()}
    whole = ppm.frequent_words
    monkeypatch.setattr(ppm, "frequent_words", lambda words: whole(words, 50))
    for r in ppm.score(few).collect():
        assert r["n_known"] == a[r["doc_id"]]["n_known"] and r["base_score"] == pytest.approx(a[r["doc_id"]]["base_score"])


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[:2] == ["doc_id", "piece"]
    kept = {r["doc_id"] for r in rows.select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not any(base_rules(texts[i])[5] or any(t in texts[i] for t in items) for i in kept)
    parts = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
    assert len({parts[i] for i in kept}) == len(kept)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.where("false"), SF).columns == docs.columns
    assert corpus_pipeline.pack(spark, docs.where("false"), SF).count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows and clashing ids go through all stages."""
    import corpus_pipeline

    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id", "left_semi").limit(6).collect()
    rows = [tuple(r) for r in good] + [tuple(good[0])] * 3 + [(None, *tuple(good[1])[1:]), (None, good[1]["text"] + " fin", "es", "s", 1), (good[2]["doc_id"], good[3]["text"][::-1], "es", "s", 1), (900001, None, None, None, None), (900002, "", "es", "s", 0), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert packed and all(r["length"] <= packing.CAPACITY for r in packed)
    assert {r["doc_id"] for r in packed} <= {r["doc_id"] for r in good} | {None}
