"""The queries without SQL against plain versions, and constants that must not change a result."""

import csv
import hashlib
import importlib.util
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import common, components, decontaminate, language_id, license_scan, license_texts, ngram_join, queries, sharding, url_filter, warc_zip

R = random.Random(21)
WORDS = "the of and to in is it for on with as at by from this that river stone light house".split()
prose = lambda n: " ".join(R.choice(WORDS) + R.choice(("", str(R.randint(0, 30)))) for _ in range(n))
TEXTS = [None, "", "  \n", "one", "Ünïcode 漢字 'tis 12\t\n  x", "<|endoftext|> in text", prose(80), prose(80), prose(3000), "x" * 5000, prose(200), "same line \u0085", "a  "]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of every kind of row, with columns that share names with those that operators add."""
    d = str(tmp_path_factory.mktemp("brute"))
    rows = [(n if n % 9 else None, t, ("en", "fr", None)[n % 3], n, "mine", True) for n, t in enumerate([*TEXTS, *TEXTS])]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, size int, shard string, kept boolean").write.parquet(f"{d}/documents.parquet")
    urls = ["https://www.example.org/es/x", "http://casino-bonus.example.net/win", "https://library.example.edu/books?x=1", None, "no url", "HTTP://EXAMPLE.COM/fr/1", "https://a.org/" + "z" * 9000, "http://x.com/de/1#t", "http://x.com/de/1#t", "://", "http://sub.example.org/en/12"]
    spark.createDataFrame([(n, u, "<p>" * (n * 200), "mine", 0.5) for n, u in enumerate(urls)], "page_id bigint, url string, html string, verdict string, block_score double").write.parquet(f"{d}/pages.parquet")
    return d


def test_token_digests(spark, folder):
    if importlib.util.find_spec("tokenizers") is None:
        pytest.skip("the reference tokenizer isn't here")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.vocabulary_path())
    own.no_truncation()
    own.no_padding()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, queries.op2_bpe_automaton(spark, folder).collect()), key=repr) == sorted(want, key=repr)


def test_license_passages(spark):
    """Whole license texts in prose: rewrapped, commented, with other words, without a telling word, twice."""
    scanner, r = license_scan.Scanner(), random.Random(4)
    for name, text in license_texts.TEXTS.items():
        for wrapped in (text, " ".join(text.split()), text.replace("\n", "\n * "), text.upper()):
            body = f"{prose(40)} {wrapped}\n{prose(40)}"
            (start, end, found, _, missing, added), = scanner.passage_blocks(body)
            assert (found, missing, added) == (name, [], []) and body[start:end].split()[:3] == wrapped.split()[:3]
        words = text.split()
        telling = license_scan.Passage(name, text, 3).strict
        others = [i for i, w in enumerate(words) if not set(license_scan.wording(w)) & telling]
        for i in r.sample(others, len(words) // 10):
            words[i] = "otherwise"
        (_, _, found, _, missing, added), = scanner.passage_blocks(f"{prose(30)} {' '.join(words)} {prose(30)}")
        assert found == name and missing and "otherwise" in added
        for word in telling:
            changed = text.lower().replace(word, "zzz")
            assert not [b for b in scanner.passage_blocks(changed) if b[2] == name]
        assert scanner.passage_blocks(" ".join(text.split()[:len(text.split()) // 2])) == []
    docs = [(1, "Intro.\n\n" + license_texts.TEXTS["ISC"] + "\n\n" + license_texts.TEXTS["ISC"]), (2, None), (3, ""), (4, prose(20_000) + " Released under the MIT\nLicense. " + prose(500)), (5, "mit der und released the"), (5, "mit der und released the")]
    table = spark.createDataFrame([(i, t, "mine") for i, t in docs], "doc_id bigint, text string, license string")
    got = sorted((r["doc_id"], r["line_no"], r["license"], r["exact"]) for r in license_scan.scan_licenses(table).collect())
    assert got == [(1, 3, "ISC", True), (1, 7, "ISC", True), (4, 1, "MIT", True)]


def test_languages_by_an_own_loop(spark, folder):
    """Predictions and scores from compressors built here, and samples that no other language crowds out."""
    import zstandard as zstd

    rows = [(i, prose(30) if lang == "en" else " ".join(R.choice("le la les des et maison rivière pierre".split()) for _ in range(30)), lang) for i, lang in enumerate(["en"] * 900 + ["fr"] * 25 + [None] * 5)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = language_id.learn_dictionaries(table, sample_docs=40)
    held = {k: set(v.decode().split("\n")) for k, v in learned.items()}
    assert held["fr"] == {t for _, t, lang in rows if lang == "fr"} and len(held["en"]) == 40
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 300).alias("lang"))
    assert len(language_id.learn_dictionaries(many)) == 300
    made = {}
    for k, v in learned.items():
        d = zstd.ZstdCompressionDict(v.decode().lower().encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        made[k] = zstd.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for r in language_id.identify_language(docs, learned).collect():
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sizes = {k: len(c.compress(r["text"].lower().encode())) for k, c in made.items()}
        best = min(sorted(sizes), key=sizes.get)
        assert r["lang_pred"] == best and math.isclose(r["score"], 1 / sum(2.0 ** -min(60, n - sizes[best]) for n in sizes.values()))
        assert r["lang_accepted"] == (r["score"] >= language_id.LEAST_SCORE) and r["shard"] == "mine"


def test_one_automaton_or_many(spark, folder):
    item = TEXTS[6]
    items = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate([item, prose(40), None, "", "one", item])] + [(None, "one")], "item_id string, text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("items", F.lit("mine")).withColumn("_hit0", F.lit(1))
    one, many = (sorted(map(repr, decontaminate.find_contamination(docs, items, most=m).collect())) for m in (decontaminate.AUTOMATON_BYTES, 1))
    assert one == many and any("q5" in r for r in one)
    assert decontaminate.find_contamination(docs, items.where("false")).where("n_hit > 0").count() == 0


def test_slots(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id is null")).unionByName(spark.range(2000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("hot").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("size"), F.lit("x").alias("shard"), F.lit(False).alias("kept")))
    placed, path = sharding.shard_documents(docs, shards=5, slots=64)
    rows = placed.collect()
    assert len(rows) == docs.count()
    versions = {v: {r["slot"]: r["shard"] for r in sharding.load_map(spark, path, v).collect()} for v in (0, 1)}
    assert versions[0] == {s: s % 5 for s in range(64)} and len(versions[1]) == 64
    load, of = {}, {}
    for r in rows:
        assert r["shard"] == versions[1][r["virtual_slot"]] and of.setdefault(r["doc_id"], r["virtual_slot"]) == r["virtual_slot"]
        load.setdefault(r["shard"], []).append(r["slot"])
    for places in load.values():
        assert sorted(places) == list(range(len(places)))
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == want
    # a stored map is loaded, edited and stored as its next version
    held = {s: 10 + s for s in range(64)}
    version, edited = sharding.rebalance_stored(spark, path, held, 6)
    assert version == 2 and set(edited) == set(range(6))
    assert {r["slot"]: r["shard"] for r in sharding.load_map(spark, path).collect()} == dict(enumerate(edited))
    sums = [sum(held[s] for s in range(64) if edited[s] == k) for k in range(6)]
    assert max(sums) - min(sums) <= max(held.values())
    assert sharding.rebalance_stored(spark, path, held, 6) == (2, edited)


def test_url_model(spark, folder):
    """Training, scores and verdicts recomputed with numpy over the same hashed n-grams, and accuracy on URLs not seen."""
    labelled = url_filter.labelled_urls(spark)
    with open(url_filter.LABELLED, encoding="utf-8") as f:
        assert labelled.count() == sum(1 for _ in csv.DictReader(f))
    cells = lambda df: [r["f"] for r in df.select(url_filter.gram_buckets(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("f")).collect()]
    x = np.zeros((labelled.count(), url_filter.BUCKETS))
    for i, f in enumerate(cells(labelled)):
        x[i, f] = 1 / math.sqrt(len(f))
    y = np.array([r["label"] for r in labelled.collect()], float)
    w, b = np.zeros(url_filter.BUCKETS), 0.0
    for _ in range(url_filter.STEPS):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w * (1 - url_filter.RATE * url_filter.DECAY) - url_filter.RATE * 8 * (x.T @ e) / len(y), b - url_filter.RATE * e.sum() / len(y)
    weights, bias = url_filter.train(labelled)
    assert np.allclose(weights, w) and math.isclose(bias, b)
    pages = spark.read.parquet(f"{folder}/pages.parquet").orderBy("page_id")
    got = url_filter.judge_urls(pages, weights, bias).orderBy("page_id").collect()
    for r, f in zip(got, cells(pages), strict=True):
        score = 1 / (1 + math.exp(-(w[f].sum() / math.sqrt(len(f)) + b)))
        assert math.isclose(r["block_score"], score, rel_tol=1e-9)
        url = r["url"] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = rest[:min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
        path = rest[len(host):][:min((rest[len(host):].find(c) for c in "?#" if c in rest[len(host):]), default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        assert (r["host"], r["path"]) == (host, path)
        fits = [(v, t) for v, t in url_filter.RULES if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
        best = max(fits, key=lambda x: len(x[1]), default=(None, None))
        assert r["rule"] == best[1] and r["verdict"] == (best[0] or ("block" if score >= url_filter.CUTOFF else "allow"))
    assert url_filter.judge_urls(pages.where("false"), weights, bias).count() == 0
    assert url_filter.held_out_accuracy(labelled) >= 0.85


def test_archives_by_either_join(spark, monkeypatch):
    page, other = "<p>" + "x" * 1500, "<q>" + "y" * 3000
    rows = [(1, "http://a", page, "mine"), (2, "http://b", page, "mine"), (None, "n", page, "m"), (None, "n", other, "m"), (4, "u", "", "m"), (5, None, None, "m"), (9, "u", page, "m"), (9, "u", page, "m"), (10, "v", "z" * 300_000, "m")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")
    got = []
    for most in (warc_zip.BROADCAST_DIGESTS, -1):
        monkeypatch.setattr(warc_zip, "BROADCAST_DIGESTS", most)
        got.append(sorted((tuple(r) for r in warc_zip.through_archives(table).collect()), key=repr))
    assert got[0] == got[1] and len(got[0]) == len(rows)
    by = {(r[0], r[4]): r for r in got[0]}
    assert by[1, 1503][2:4] == ("revisit", 9) and by[None, 1503][2:4] == ("revisit", 9) and by[9, 1503][2:4] == ("response", None) and by[None, 3003][2:4] == ("response", None)


def test_bounds_don_t_change_components(spark, monkeypatch):
    edges = spark.createDataFrame([(R.randrange(300), R.randrange(300)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(90)] + [(1000, 1001 + i) for i in range(300)], "a bigint, b bigint")
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 6) * 40 + k + (k == 20) * (i % 6)}" for k in range(40))) for i in range(60)] + [(100 + i, "common words of a passage here " * 3 + f"and {i % 5}") for i in range(40)], "doc_id bigint, text string")
    got = []
    for edges_most, rows_most, ids_most in ((components.BROADCAST_EDGES, ngram_join.LIST_ROWS, ngram_join.BROADCAST_IDS), (-1, 8, -1)):
        monkeypatch.setattr(components, "BROADCAST_EDGES", edges_most)
        monkeypatch.setattr(ngram_join, "LIST_ROWS", rows_most)
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", ids_most)
        monkeypatch.setattr(ngram_join, "SLICE", 64 if ids_most < 0 else ngram_join.SLICE)
        got.append((sorted(map(tuple, components.components(edges).collect())), sorted(map(tuple, ngram_join.jaccard_components(docs).collect()))))
    assert got[0] == got[1]


def test_worker_state_and_folders(spark):
    made = []
    assert common.held("a", lambda: made.append(1) or "x") == "x" == common.held("a", lambda: made.append(1) or "y") and len(made) == 1
    common.held("b", lambda: "z")
    assert common.held("a", lambda: "new") == "new"
    common.release()
    assert common.digest_of(b"a", b"bc") != common.digest_of(b"ab", b"c")

    class Away:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "yarn"}.get(key, default)

    with pytest.raises(ValueError):
        common.shared_dir(Away())
