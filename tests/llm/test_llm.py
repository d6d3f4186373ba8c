"""The problems of the llm package against brute force, round trips and held-out accuracy."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.llm import language, mixing, nearest, packing, percentiles, tokens

TOKENIZER = tokens.DEFAULT_FILE


# ---- 1: nearest in time


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**7), max_size=300), st.lists(st.integers(-(10**6), 10**7 + 10**6), min_size=1, max_size=50), st.integers(0, 8))
def test_learned_index_is_exact(keys, queries, error):
    k = np.unique(np.array(keys, dtype=np.int64))
    q = np.array(queries, dtype=np.int64)
    index = nearest.LearnedIndex(k, error)
    assert (index.lower_bound(q) == np.searchsorted(k, q)).all()
    if len(k):
        near = index.nearest(q)
        assert (np.abs(k[near] - q) == np.abs(k[None, :] - q[:, None]).min(axis=1)).all()
        x = (k - k[0]).astype(float)
        assert np.abs(np.interp(x, index.x, index.y) - np.arange(len(k))).max() <= error + 1e-6


def test_learned_index_needs_few_segments():
    t = np.cumsum(np.random.default_rng(1).integers(900, 1100, 50_000))
    assert nearest.LearnedIndex(t, 64).segments < 200


@pytest.mark.parametrize("shard_seconds", [60, 43_200])
def test_match_nearest(spark, readings, at, shard_seconds):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b"]), float(rng.randrange(0, 2000)), 1.0) for k in range(300)]
    rows += [rows[0], (900, None, 5.0, 1.0), (901, "a", None, 1.0), (None, "a", 100.25, 1.0)]
    checks = [(k, rng.choice(["a", "b", "none", None]), at(rng.randrange(0, 4000) / 2), 1.5) for k in range(200)]
    checks += [(1000, "a", None, 1.0), checks[0]]
    left = spark.createDataFrame(checks, "check_id long, endpoint_name string, checked timestamp_ntz, delta_us double")
    out = nearest.match_nearest(left, readings(rows), ("endpoint_name", "checked"), ("endpoint_name", "timestamp"), "reading_id", 5_000_000, shard_seconds).collect()
    assert len(out) == len(checks)
    for r in out:
        q = None if r["checked"] is None else (r["checked"] - at(0)).total_seconds()
        near = [] if q is None else [(abs(t - q), t, i) for i, e, t, _ in rows if e == r["endpoint_name"] and e and t is not None and i is not None and abs(t - q) <= 5]
        assert r["reading_id"] == (min(near)[2] if near else None), r
        assert r["delta_us"] in (1.5, 1.0)
    for words in (1, 64):  # a bitmap that fills up lets more through and loses nothing
        full = nearest.match_nearest(left, readings(rows), ("endpoint_name", "checked"), ("endpoint_name", "timestamp"), "reading_id", 5_000_000, shard_seconds, filter_words=words)
        assert sorted(full.collect(), key=str) == sorted(out, key=str)
    empty = readings([])
    assert nearest.match_nearest(left, empty, ("endpoint_name", "checked"), ("endpoint_name", "timestamp"), "reading_id", 5_000_000).where("reading_id is null").count() == len(checks)
    assert nearest.match_nearest(left.where("false"), readings(rows), ("endpoint_name", "checked"), ("endpoint_name", "timestamp"), "reading_id", 5_000_000).count() == 0


def test_spellings(spark):
    names = [" degC_A\t", "DEGC.A.LYRA", "degc_a", "K.A", "k.a.lyra", "nothing", None]
    entries = spark.createDataFrame([(1, "K.A.LYRA", "degC_A"), (2, "K.A.LYRA", "degC_A"), (3, "K.A.LYRA", "odd"), (4, None, "x")], "entry_id long, sensor_name string, endpoint_name string")
    ends = spark.createDataFrame([("degC_A",), (None,)], "endpoint_name string")
    table = {r["spelling"]: r["endpoint"] for r in nearest.endpoint_names(entries, ends, "LYRA").collect()}
    df = spark.createDataFrame([(n,) for n in names], "n string").select(nearest.spelling(F.col("n"), "LYRA").alias("s"))
    assert [table.get(r["s"]) for r in df.collect()] == ["degC_A"] * 5 + [None, None]


# ---- 4: percentiles


def rank_error(sorted_values, value, q):
    n = len(sorted_values)
    low, high = np.searchsorted(sorted_values, value, "left") + 1, np.searchsorted(sorted_values, value, "right")
    want = max(1, int(np.ceil(q * n - 1e-9)))
    return max(0, low - want, want - high) / n


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 4000), st.integers(0, 5), st.integers(1, 9))
def test_summary_keeps_its_bound(n, kind, parts):
    rng = np.random.default_rng(n)
    v = [rng.normal(size=n), rng.integers(0, 5, n).astype(float), np.arange(n, dtype=float), -np.arange(n, dtype=float), np.zeros(n), rng.exponential(size=n) ** 6][kind]
    whole = percentiles.Summary(16, 4)
    for part in np.array_split(v, parts):
        s = percentiles.Summary(16, 4).add(part)
        row = s.row()
        whole.merge(percentiles.Summary.of(row, 16, 4))
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found, bound = whole.quantiles(qs)
    ordered = np.sort(v)
    assert whole.n == n and whole.least == ordered[0] and whole.most == ordered[-1]
    assert sum(w * len(b) for w, bs in whole.levels.items() for b in [np.concatenate(bs)]) + len(whole.rest) == n
    for q, x in zip(qs, found):
        assert rank_error(ordered, x, q) <= bound + 1e-12


def test_bound_stays_small():
    s = percentiles.Summary()
    for _ in range(20):
        s.add(np.random.default_rng(1).normal(size=50_000))
    assert s.quantiles([0.5])[1] < 0.005
    assert percentiles.Summary().quantiles([0.5]) == ([None], None)


def test_percentiles_of_days(spark, readings):
    rng = np.random.default_rng(2)
    rows = [(k, "a", float(k * 30), float(x)) for k, x in enumerate(rng.normal(size=6000))]
    rows += rows[:50] + [(9001, "a", 1.0, None), (9002, "a", 2.0, float("nan")), (9003, None, 3.0, 1.0), (9004, "a", None, 1.0), (9005, "b", 4.0, 3.0), (None, "b", 5.0, 5.0), (None, "b", 5.0, 5.0)]
    df = readings(rows).withColumns({"n": F.lit(1), "g": F.lit("x"), "day": F.lit(3)})
    days = percentiles.summarise(df, "endpoint_name", "timestamp", "value_raw", "reading_id", k=64, fan_in=8)
    # hot slices are salted, in one and in several levels of merging
    for bound in (500, 20):
        salted = percentiles.summarise(df, "endpoint_name", "timestamp", "value_raw", "reading_id", k=64, fan_in=8, rows_per_group=bound)
        both = [{(r["endpoint_name"], r["day"]): r for r in percentiles.percentiles(x, ["endpoint_name", "day"], [0.5], 64, 8).collect()} for x in (days, salted)]
        assert {k: (r["n"], r["least"], r["most"]) for k, r in both[0].items()} == {k: (r["n"], r["least"], r["most"]) for k, r in both[1].items()}
        assert max(r["rank_error"] for r in both[1].values()) < 0.1
    daily = percentiles.percentiles(days, ["endpoint_name", "day"], [0.5], 64, 8).collect()
    assert sum(r["n"] for r in daily if r["endpoint_name"] == "a") == 6000
    overall = {r["endpoint_name"]: r for r in percentiles.percentiles(percentiles.over_days(days, "endpoint_name", 64, 8, 1), ["endpoint_name"], [0.1, 0.5, 0.999], 64, 8).collect()}
    ordered = np.sort([r[3] for r in rows[:6000]])
    a = overall["a"]
    assert a["n"] == 6000 and a["least"] == ordered[0]
    for name, q in (("p10", 0.1), ("p50", 0.5), ("p99_9", 0.999)):
        assert rank_error(ordered, a[name], q) <= a["rank_error"] < 0.05
    assert (overall["b"]["n"], overall["b"]["p50"], overall["b"]["rank_error"]) == (3, 5.0, 0.0)
    assert percentiles.over_days(percentiles.summarise(df.where("false"), "endpoint_name", "timestamp", "value_raw", "reading_id"), "endpoint_name").count() == 0


# ---- 7: containers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_best_two_fit_packs_everything_once(sizes):
    bins = packing.best_two_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == [i for i, s in enumerate(sizes) if s]
    assert all(0 < sum(sizes[i] for i in b) <= 50 for b in bins)
    assert bins == packing.best_two_fit(sizes, 50)
    loose = [b for b in bins if sum(sizes[i] for i in b) <= 25]
    assert len(loose) <= 1


def test_two_replace_the_smallest():
    # greedy: 60 + 30 leaves 10; 30 is replaced by 21 + 19
    assert [sorted(sizes) for sizes in ([[60, 30, 21, 19][i] for i in b] for b in packing.best_two_fit([60, 30, 21, 19], 100))] == [[19, 21, 60], [30]]


def test_packing_round_trip(spark):
    rng = random.Random(1)
    words = "the harbour office repairs broken umbrellas Übung 水の深さ <|endoftext|> \n\n".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 20, 100, 900]))) for _ in range(120)]
    texts += [None, "", "   ", "long " * 60_000, "a" * 30_000]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, "no id", "x", 1)], "doc_id long, text string, shard string, n int")
    capacity = 256
    rows = packing.pack(df, capacity, TOKENIZER, items_per_shard=40).collect()
    pieces = {}
    for r in rows:
        assert r["n_tokens"] == sum(r["lengths"]) == len(r["token_ids"]) <= capacity and r["n_items"] == len(r["doc_ids"])
        at = 0
        for doc, piece, start, n in zip(r["doc_ids"], r["pieces"], r["starts"], r["lengths"]):
            assert (doc, piece) not in pieces
            pieces[doc, piece] = (start, r["token_ids"][at : at + n])
            at += n
    assert len({r["container_id"] for r in rows}) == len(rows)
    for k, t in enumerate(texts):
        ids = tokens.encode(t, TOKENIZER).tolist()
        mine = sorted((p, v) for (d, p), v in pieces.items() if d == k)
        assert [x for _, (_, part) in mine for x in part] == ids
        assert len(mine) == -(-len(ids) // capacity)  # split only if longer than a container
        assert all(start == p * capacity for p, (start, _) in mine)
    used = packing.fill(spark.createDataFrame(rows), capacity).first()
    assert used["used"] > 0.95
    assert packing.pack(df.where("false"), capacity, TOKENIZER).count() == 0


def test_blocks_bound_the_packer():
    """100 texts of 100 pieces and many rests: never more than a block of items waits, full pieces pass through."""
    import pyarrow as pa

    blob = lambda n: b"s" + np.zeros(n, dtype="<u2").tobytes()
    rows = [(d, p, p * 64, 64, blob(64)) for d in range(100) for p in range(100)] + [(d, 100, 6400, 1 + d % 63, blob(1 + d % 63)) for d in range(1000)]
    random.Random(1).shuffle(rows)
    batch = pa.RecordBatch.from_arrays([pa.array([3] * len(rows)), *(pa.array(c, type=f.type) for c, f in zip(zip(*rows), packing._PIECE_FIELDS))], names=["part", *packing._PIECE_FIELDS.names])
    p, most, out = packing._Packer(64, 50), 0, []
    for c in p.containers(iter([batch])):
        most = max(most, len(p.waiting))
        out.append(c)
    assert most <= 50 and len(out) == len({c[0] for c in out})
    assert sorted((d, x) for c in out for d, x in zip(c[3], c[4])) == sorted((r[0], r[1]) for r in rows)
    assert sum(c[1] for c in out if c[2] > 1) / (64 * sum(c[2] > 1 for c in out)) > 0.97
    # nothing fits together: the items carried over stay bounded, too
    p, same = packing._Packer(64, 50), [(d, 0, 0, 40, blob(40)) for d in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 500), *(pa.array(c, type=f.type) for c, f in zip(zip(*same), packing._PIECE_FIELDS))], names=["part", *packing._PIECE_FIELDS.names])
    assert len(list(p.containers(iter([batch])))) == 500


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokenizers(name):
    path = TOKENIZER.rsplit("/", 1)[0] + "/" + name
    assert len(tokens.encode("The harbour office.", path)) > 2 and len(tokens.encode(None, path)) == 0
    if name.endswith("50k.json"):
        assert tokens.encode("The harbour <|endoftext|>\n\n x", path).tolist() == tokens.encode("The harbour <|endoftext|>\n\n x", TOKENIZER).tolist()


def test_long_texts_encode_as_a_whole():
    text = "\n\n".join("Every autumn, 水の深さ  the\tlibrary's 1999 roof …" for _ in range(600))
    assert tokens.encode(text, TOKENIZER, block=500).tolist() == tokens.encode(text, TOKENIZER, block=10**9).tolist()


# ---- 8: mixing


def best_below(lengths, counts, budget):
    reach = 1
    for n, c in zip(lengths, counts):
        for _ in range(c):
            reach |= reach << n
    return (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 400))
def test_subset_comes_close(hist, budget):
    lengths, counts = np.array(sorted(hist)), np.array([hist[k] for k in sorted(hist)])
    taken = mixing.fit_subset(lengths, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    total = int((taken * lengths).sum())
    assert total <= max(budget, 0) or budget >= int((lengths * counts).sum())
    assert total <= best_below(lengths.tolist(), counts.tolist(), budget)
    # the even part fixes some documents; what is left to the knapsack comes out exactly
    even = (counts * (budget / (lengths * counts).sum())).astype(int).clip(max=counts)
    rest = best_below(lengths.tolist(), (counts - even).tolist(), max(0, budget - int((even * lengths).sum())))
    if budget < int((lengths * counts).sum()):
        assert total == int((even * lengths).sum()) + rest


def test_large_gap_is_closed():
    lengths = np.arange(1, 3000)
    counts = np.full(len(lengths), 7)
    budget = 12_345_678
    assert int((mixing.fit_subset(lengths, counts, budget, 5_000) * lengths).sum()) == budget


def test_mix(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["News", " news", "NEWS\t", "shop", "rare", "other", None]), rng.randrange(0, 400)) for k in range(3000)]
    rows += [(None, "news", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("source", mixing.source_key()).withColumns({"copies": F.lit(1), "docs": F.lit(2), "salt__": F.lit(3)}).select("doc_id", "source", "n_tokens")
    targets = spark.createDataFrame([("news", 0.5, 1), ("Shop", 0.3, 2), ("rare", 0.15, 3), ("museum", 0.05, 3), (None, 0.1, 1), ("zero", 0.0, 1), ("nul", None, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(df, targets).collect()
    n = {r[0]: r[2] for r in rows if r[0] is not None}
    assert len({r["doc_id"] for r in out}) == len(out)
    most = {"news": 1, "shop": 2, "rare": 3}
    assert all(1 <= r["copies"] <= most[r["source"]] and r["n_tokens"] == n[r["doc_id"]] for r in out)
    got = {s: sum(r["copies"] * r["n_tokens"] for r in out if r["source"] == s) for s in most}
    for s, share in (("news", 0.5), ("shop", 0.3), ("rare", 0.15)):
        assert got[s] / sum(got.values()) == pytest.approx(share / 0.95, abs=1e-4)
        assert next(r["reached_share"] for r in out if r["source"] == s) == pytest.approx(got[s] / sum(got.values()))
    again = mixing.mix(df, targets, docs_per_salt=200).collect()
    assert {s: sum(r["copies"] * r["n_tokens"] for r in again if r["source"] == s) for s in most} == got
    small = mixing.mix(df, targets, total=1000).collect()
    assert abs(sum(r["copies"] * r["n_tokens"] for r in small) - 950) <= 3
    assert mixing.mix(df.where("false"), targets).count() == 0 and mixing.mix(df, targets.where("false")).count() == 0


def test_count_tokens(spark):
    df = spark.createDataFrame([(1, "The harbour", " A "), (2, None, None), (3, "", "b")], "doc_id int, text string, source string").withColumn("n_tokens", F.lit("x"))
    assert [tuple(r) for r in mixing.count_tokens(df, TOKENIZER).orderBy("doc_id").collect()] == [(1, "a", len(tokens.encode("The harbour", TOKENIZER))), (2, None, 0), (3, "b", 0)]


# ---- 9: language

EN = "The library of {} measures the depth of the water behind the market hall. A retired ferryman sells fresh bread to visitors on rainy days. "
DE = "Die Bücherei von {} misst hinter der Markthalle die Tiefe des Wassers. Ein früherer Fährmann verkauft den Gästen an Regentagen frisches Brot. "
FR = "La bibliothèque de {} mesure la profondeur de l'eau derrière la halle du marché. Un ancien passeur vend du pain frais aux visiteurs. "
JA = "{}の図書館は市場の裏で水の深さを測っています。引退した船頭は雨の日に焼きたてのパンを売ります。"


def sample():
    rng = random.Random(0)
    name = lambda: "".join(rng.choice(["kol", "bran", "tar", "hel", "mor"]) for _ in range(2)).title()
    return [(lang, text.format(name())) for _ in range(12) for lang, text in (("en", EN), ("de", DE), ("fr", FR), ("ja", JA))]


@pytest.fixture(scope="module")
def lang_model():
    return language.fit(sample())


def test_fit_is_sparse_and_calibrated(lang_model):
    assert lang_model.languages == ["de", "en", "fr", "ja"] and lang_model.temperature > 0
    assert 0 < (lang_model.vectors == 0).mean() < 1
    s = language.Segmenter(lang_model, language.Rules())
    for lang, text in (("en", EN), ("de", DE), ("fr", FR), ("ja", JA)):
        for v in (text, text.upper(), *language.variants(text, 0, 2)):
            own, sums, counts = s.sentences([v])[0]
            assert lang_model.languages[s.path(sums, counts, np.array([True] * len(own)))[0]] == lang, v


def test_held_out_accuracy(spark):
    import os

    path = "/root/testdata/sf0.01/lang_sample.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(path).orderBy("sample_id").collect()]
    m = language.fit([x for i, x in enumerate(rows) if i % 4])
    held = [x for i, x in enumerate(rows) if i % 4 == 0]
    right = sum(m.languages[int(language._score(m, t).argmax())] == lang for lang, t in held)
    assert right / len(held) >= 0.98
    # confidence keeps to accuracy on short fragments
    parts = [(lang, f) for lang, t in held for f in language._fragments(t)]
    p = np.exp(language.log_softmax(np.array([language._score(m, f) for _, f in parts])))
    hit = np.array([m.languages[int(x.argmax())] == lang for x, (lang, _) in zip(p, parts)])
    assert abs(p.max(axis=1).mean() - hit.mean()) < 0.08


def test_documents(spark, lang_model):
    en, de, fr = EN.format("Kol") * 2, DE.format("Kol") * 2, FR.format("Kol") * 2
    menu = "Startseite | Kontakt | Suche\n\n"
    texts = {
        1: en, 2: menu + en, 3: en + de, 4: en + "\n\n" + de + fr, 5: en + "Ein alter Fährmann verkauft Brot. " + en, 6: EN.format("Kol")[:60], 7: None, 8: "", 9: " \n", 10: "12 + 13 = 25", 11: en * 300, 12: JA.format("Kol") * 6, 13: en,
    }
    labels = {1: " EN ", 2: "en-GB", 3: "en", 4: "en,de,fr", 5: "English", 6: "de", 10: "x", 11: None, 12: "日本語", 13: ""}
    df = spark.createDataFrame([(k, t, labels.get(k), k) for k, t in texts.items()] + [(None, en, "en", 1)], "doc_id int, text string, lang string, label int").withColumn("languages", F.lit(1))
    found = {}
    for r in language.document_languages(df, lang_model).collect():
        assert 0 <= r["confidence"] <= 1
        found.setdefault(r["doc_id"], set()).add(r["lang"])
    assert {k: v for k, v in found.items() if k != 10} == {1: {"en"}, 2: {"en"}, 3: {"en", "de"}, 4: {"en", "de", "fr"}, 5: {"en"}, 6: {"en"}, 11: {"en"}, 12: {"ja"}, 13: {"en"}}
    wrong = {(r["doc_id"], r["lang"]) for r in language.relabelled(df, lang_model).collect() if r["doc_id"] != 10}
    assert wrong == {(3, "en"), (3, "de"), (4, "en"), (4, "de"), (4, "fr"), (6, "en"), (11, "en"), (13, "en")}
    parts = [r for r in language.segments(df, lang_model).orderBy("doc_id", "segment").collect() if r["doc_id"] == 4]
    assert [r["lang"] for r in parts] == ["en", "de", "fr"] and texts[4][parts[1]["start"] : parts[1]["stop"]].strip() == de.strip()
    assert language.document_languages(df.where("false"), lang_model).count() == 0


def test_labels(spark):
    spelt = {"EN": "en", " de_AT ": "de", "pt-BR": "pt", "Français": "fr", "ger": "de", "zh": None, "en,fr": None, "mul": None, "und": None, "": None, " ": None, "English (US)": "en", "日本語": "ja", "en_US": "en", "xx": None, "UK": "uk", "uk-UA": "uk", None: None, "português": "pt"}
    df = spark.createDataFrame([(k,) for k in spelt], "l string")
    assert [r[0] for r in df.select(language.label_language("l")).collect()] == list(spelt.values())


def test_repeated_lines(spark):
    rows = [(k, "Alles accepteren\n\nx", "nl") for k in range(5)] + [(9, "Alles accepteren", "en"), (10, "Only once", "en"), (11, None, "en"), (12, "Alles accepteren", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.repeated_lines(df) == [("nl", "Alles accepteren")]
    assert language.repeated_lines(df.where("false")) == []
    assert language.train(spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(sample())], "sample_id int, lang string, text string"), df).languages == ["de", "en", "fr", "ja"]


def test_queries_are_registered():
    from tidegauge.llm import queries

    assert {f"p{n}" for n in (1, 4, 7, 8, 9)} <= {q.split("_")[0] for q in queries.QUERIES}
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert dt.datetime(2021, 1, 5)


def test_operators_from_another_folder(elsewhere):
    """Each operator that runs Python on the executors brings the package along."""
    elsewhere("""
from tidegauge.llm import language, mixing, nearest, packing, percentiles
docs = spark.createDataFrame([(k, "The harbour office repairs umbrellas. " * (k + 1), "en", "s") for k in range(20)], "doc_id long, text string, lang string, source string")
assert packing.pack(docs, 64).agg(F.sum("n_items")).first()[0] >= 20
assert mixing.mix(mixing.count_tokens(docs), spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")).count() == 20
found = nearest.match_nearest(readings.withColumnRenamed("reading_id", "check_id"), readings, ("endpoint_name", "timestamp"), ("endpoint_name", "timestamp"), "reading_id", 1)
assert found.where("check_id = reading_id").count() == 200
days = percentiles.summarise(readings, "endpoint_name", "timestamp", "value_raw", "reading_id")
assert percentiles.percentiles(percentiles.over_days(days, "endpoint_name"), ["endpoint_name"], [0.5]).first()["n"] == 200
sample = spark.createDataFrame([(k, lang, t) for k in range(6) for lang, t in (("en", "The harbour office repairs umbrellas."), ("de", "Das Hafenamt repariert Schirme."))], "sample_id int, lang string, text string")
assert language.document_languages(docs, language.train(sample)).where("lang = 'en'").count() == 20
""")
