"""Repeated ids and rows, clashing names, odd types and links, against brute force."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dirgauge.llm import chat_format, embedding_dedup, minhash, mixing, packing, quality, simhash, token_counts, url_filter

rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]


def words(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def changed(text, at):
    out = text.split()
    out[at] = "changed"
    return " ".join(out)


def test_search(spark):
    prints = [rng.getrandbits(128) for _ in range(40)]
    for base in prints[:15]:
        for flips in (1, 3, 4):
            prints.append(base ^ sum(1 << k for k in rng.sample(range(128), flips)))
    prints += prints[:3] + [0]
    row = lambda k, x: (k, np.frombuffer(x.to_bytes(16, "little"), dtype=np.int64).tolist())
    df = spark.createDataFrame([*(row(k, x) for k, x in enumerate(prints)), (999, None)], "k int, fingerprint array<bigint>")
    back = lambda f: int.from_bytes(np.array(f, dtype=np.int64).tobytes(), "little")
    for blocks in (4, 5):
        got = {(back(r["query"]), back(r.found)): r.distance for r in simhash.search(df.where("k % 2 = 0"), df, radius=3, blocks=blocks).collect()}
        want = {(a, b): (a ^ b).bit_count() for a in prints[::2] for b in prints if a != b and (a ^ b).bit_count() <= 3}
        assert got == want and len(want) > 15
    with pytest.raises(ValueError):
        simhash.search(df, df, radius=3, blocks=3)


def test_simhash_query(spark, tmp_path):
    base = words(120)
    texts = [None, "", base, base, "ab", "é ü \U0001f600 z", *[words(rng.randint(1, 90)) for _ in range(36)], base]
    spark.createDataFrame([(2 * k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in simhash.op2_simhash(spark, str(tmp_path)).collect()}
    prints = {k: int(r.fingerprint, 16) for k, r in got.items()}
    for k, t in enumerate(texts):
        t, after = t or "", texts[k - 1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = got[2 * k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == 1 - (prints[2 * k] ^ prints[2 * ((k - 1) % len(texts))]).bit_count() / 128
        assert r.near_edited == 1 - (prints[2 * k] ^ int(r.edited_fingerprint, 16)).bit_count() / 128
        assert r.n_near == (sum((prints[2 * k] ^ f).bit_count() <= 3 for f in prints.values()) - 1 if 2 * k % 20 == 0 else None)
    clash = spark.createDataFrame([(1, "x", 2, 3, 4)], "doc_id int, text string, print int, _part int, _at int")
    assert simhash.with_next(simhash.with_fingerprint(clash, "text", "f"), "doc_id", ["_at"], ["after"]).first().after == 4


def test_minhash_repeated_ids(spark):
    a, b = words(200), words(200)
    shorter = " ".join(b.split()[:-1])
    rows = [(1, a), (1, b), (2, changed(a, 100)), (3, changed(b, 90)), (4, changed(a, 5)), (4, shorter), (5, a), (None, a), (6, ""), (6, None), (7, b), (7, b)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for deviations in (6.0, None):
        got = minhash.near_duplicates(docs, words=3, percent=85, deviations=deviations, detail=True).collect()
        assert collections.Counter((r.doc_id, r.component_id, r.kept) for r in got) == collections.Counter([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (4, 1, False), (5, 1, False), (None, None, True), (6, 6, True), (6, 6, True), (7, 1, False), (7, 1, False)])
        groups = collections.defaultdict(set)
        for r in got:
            groups[r.group].add(r.doc_id)
        assert sorted(map(sorted, (g for k, g in groups.items() if k is not None))) == [[1, 2, 4, 5], [1, 3, 4, 7]]


def test_mixing_repeated_rows(spark):
    for extra in ((7000, 7000, 6900, 6800, 6500), (9000, 100, 50, 3, 2)):
        rows = [(1, "a", " ".join(["w"] * 100))] * 400 + [(k, "b", " ".join(["v"] * n)) for k, n in enumerate(extra, 10)]
        docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("row_hash", F.lit("own"))
        mixed = mixing.mix(docs).cache()
        per = {r.source: r for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()}
        assert abs(per["a"].taken - per["a"].target) <= 100 and abs(per["b"].taken - per["b"].target) <= max(extra)
        assert all(p.over <= 0 for p in per.values())
    again = mixing.mix(docs.repartition(3))
    assert collections.Counter(map(tuple, again.drop("row_hash").collect())) == collections.Counter(map(tuple, mixed.drop("row_hash").collect()))
    taken = mixing.apply_copies(docs, mixed)
    assert taken.columns == docs.columns and taken.count() == mixed.agg(F.sum("copies")).first()[0]


def test_balance_of_overlapping_constraints(spark):
    r = np.random.default_rng(2)
    n, m = 6, 4
    size = r.integers(50, 400, (n, m)).astype(float)
    want = size * np.exp(r.normal(0, 0.4, n)[:, None] + r.normal(0, 0.3, m)[None, :])  # so that targets can be met together
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", float(size[i, j])) for i in range(n) for j in range(m)], "s string, l string, size double")
    targets = {"s": spark.createDataFrame([(f"s{i}", float(want[i].sum())) for i in range(n)], "s string, target double"), "l": spark.createDataFrame([(f"l{j}", float(want[:, j].sum())) for j in range(m)], "l string, target double")}
    got = {(x.s, x.l): x.rate for x in mixing.balance(cells, targets, 100.0).collect()}
    # a dense Newton on the same dual
    z, goal = np.zeros(n + m), np.concatenate([want.sum(axis=1), want.sum(axis=0)])
    for _ in range(60):
        mass = size * np.exp(z[:n, None] + z[None, n:])
        curve = np.block([[np.diag(mass.sum(axis=1)), mass], [mass.T, np.diag(mass.sum(axis=0))]])
        z += np.clip(np.linalg.lstsq(curve, goal - np.concatenate([mass.sum(axis=1), mass.sum(axis=0)]), rcond=None)[0], -1, 1)
    for i, j in itertools.product(range(n), range(m)):
        assert got[f"s{i}", f"l{j}"] == pytest.approx(np.exp(z[i] + z[n + j]), rel=1e-6)
    assert len({round(v, 6) for (s, _), v in got.items() if s == "s0"}) == m


def test_mixing_by_two_columns(spark):
    rows = [(k, f"s{k % 3}", f"l{k % 2}", words(rng.randint(20, 60))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    total = sum(len(t.split()) for *_, t in rows)
    also = {"lang": spark.createDataFrame([("l0", 0.4 * total), ("l1", 0.6 * total)], "lang string, target double")}
    got = mixing.mix(docs, also=also).cache()
    for c, want in (("source", None), ("lang", {"l0": 0.4 * total, "l1": 0.6 * total})):
        for r in got.join(docs.select("doc_id", "lang"), "doc_id").groupBy(c).agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
            assert r.taken == pytest.approx(want[r[c]] if want else r.target, rel=0.02)


def test_packing_strings_that_are_tokens(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|>y z", "plain words", "<|endoftext", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in packing.pack_byte_bpe(docs).collect():
        ids = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.length, r.doc_tokens, r.ids_crc32) == (0, len(ids), len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        assert (50256 in ids) == ("<|endoftext|>" in (texts[r.doc_id] or ""))


def test_least_squares():
    r = np.random.default_rng(1)
    a, x = r.random((12, 30)), np.maximum(0, r.normal(size=30))
    got = packing.nnls(a, a @ x, 200)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6


def judged(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    return {r.page_id: r.verdict for r in url_filter.judge(df, url_filter.RULES, **more).collect()}


def test_url_links(spark):
    canonical = '<link rel="canonical" href="%s">'
    rows = [
        (1, "http://a.com/en/x?p=2&r=1", ""), (2, "http://u.io/2", canonical % "http://a.com/en/x?p=2&amp;r=1"),
        (3, "http://b.io/d/e/f", canonical % "../g"), (4, "http://b.io/d/g", canonical % "https://x.net/de/1"),
        (5, "http://c.io/p?q=1", canonical % "?q=2"), (6, "http://c.io/p?q=2", "<LINK href='//y.org/es/' REL='alternate canonical'>"),
        (7, "http://d.io/", '<link rel=canonical href="http://d.io/self"><link rel=canonical href=http://z.com/en/>'),
        (8, "http://e.io/x", '<meta http-equiv="refresh" content="0; URL=\'y?a=1&amp;b=2\'">'), (9, "http://e.io/y?a=1&b=2", canonical % "http://e.com/en/"),
        (10, "http://f.io/x", canonical % "mailto:a@b.com"), (11, "http://g.io/x", canonical % "#top"), (12, "http://h.io", canonical % "http://h.com/en/"), (13, "https://h.io/", None),
        (14, "http://i.io/1", canonical % "http://www.example.com/en/7"), (15, "http://i.io/2", '<link rel="canonicals" href="http://a.com/en/x">'),
        (16, "http://j.io/a/b", canonical % "./../c/."), (17, "http://j.io/c/", canonical % "http://j.net/de/"), (18, None, canonical % "http://a.com/en/"),
    ]
    got = judged(spark, rows)
    assert {k for k, v in got.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 16, 17}


def test_url_rules_of_the_contract(spark):
    assert [f"{action} {host}{prefix}" for action, host, prefix in url_filter.RULES] == ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]
    rows = [(1, "http://a.net/de/1", None), (2, "http://example.net/de/81", None), (3, "http://www.example.net/de/7", '<link rel="canonical" href="http://a.com/en/">'), (4, "http://b.io/", '<link rel="canonical" href="http://net/de/">'), (5, "http://anet/de/1", None)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id int, url string, html string"), url_filter.RULES).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("net/de/", "allow"), 4: (None, "allow"), 5: (None, "allow")}


def test_url_redirects_in_a_chain(spark):
    rows = [(k, f"http://n{k}.io/", None) for k in range(30)] + [(99, "http://end.com/en/", None), (50, "http://k1.io/", ""), (51, "http://k2.org/es/", ""), (52, "http://example.com/en/7", "")]
    hops = [(f"http://n{k}.io/", f"http://n{k + 1}.io/") for k in range(29)] + [("http://n29.io/", "https://end.com/en/")]
    hops += [("http://k1.io/", "http://k2.org/es/"), ("http://k2.org/es/", "http://example.com/en/7"), (None, "http://n1.io/"), ("http://n1.io/", "nonsense"), ("http://n2.io/", "http://n2.io/")]
    got = judged(spark, rows, redirects=spark.createDataFrame(hops, "a string, b string"))
    assert all(got[k] == "block" for k in [*range(30), 99, 51]) and got[50] == got[52] == "allow"
    clash = spark.createDataFrame([("http://a.com/en/", 1, 2)], "url string, host int, _dg_key int")
    row = url_filter.judge(clash, url_filter.RULES, html=None).first()
    assert (row.host, row._dg_key, row.verdict) == ("a.com", 2, "block")
    assert judged(spark, []) == {}


def test_chat_parts_of_other_types(spark):
    turns = [(1, 0, "assistant", [("video", "a <caption>", "v.mp4", 7), ("text", "x", None, None), (None, "y", None, None), ("od<d>", None, "r", None), ("image", None, "i.png", None)])]
    row = chat_format.format_conversations(spark.createDataFrame(turns, f"conv_id int, turn int, role string, parts {chat_format.PARTS_TYPE}"), parts="parts").first()
    assert "<video 1/>xy<od\\<d\\> 2/><image 3/>" in row.formatted
    assert [(a.number, a.type, a.ref, a.text, a.tokens) for a in row.attachments] == [(1, "video", "v.mp4", "a <caption>", 7), (2, "od<d>", "r", None, 1), (3, "image", "i.png", None, 256)]
    assert row.attachment_tokens == 264
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_of_either_type_and_length(spark, kind):
    read = lambda rows: {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")).collect()}
    assert read([(5, [2.0]), (3, [0.5]), (9, [-1.0]), (8, [-3.0]), (1, [0.0])]) == {5: (1, 3, False), 3: (1, 3, True), 9: (1, 8, False), 8: (1, 8, True), 1: (0, 1, True)}
    assert read([]) == {} and read([(1, None)]) == {1: (0, 1, True)}
    big = 1e30 if kind == "float" else 1e300
    assert read([(1, [big, 0.0, 0.0]), (2, [big, big / 100, 0.0]), (3, [0.0, big, 0.0]), (3, [0.0, big, 1.0])]) == {1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True)}


def test_quality_columns_equal_the_model(spark):
    texts = [None, "", *[words(rng.randint(1, 120)) for _ in range(80)], *[words(30).upper() + "!!! |" for _ in range(40)]]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, "another text of five")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < 82)) for k in range(len(texts))], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    assert model.rules
    stats = quality.statistics(F.col("text"))
    for r in quality.score(docs.withColumns({k: c for k, c in stats.items()}), model).collect():
        x = np.array([[r[k] for k in stats]])
        assert r.score == pytest.approx(float(model.predict(x)[0]), rel=1e-9)


def pipeline_tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _row_key int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_pipeline_on_odd_tables(spark, tmp_path):
    block = "\n".join(words(20) for _ in range(4))
    base = words(150)
    texts = [base, base, changed(base, 70), f"{words(30)}\n{block}", f"{words(25)}\n{block}\n{words(9)}", None, "", words(4000), "one", *[words(rng.randint(30, 90)) for _ in range(40)]]
    rows = [(k, t, "en", None if k % 5 == 0 else f"s{k % 2}", len(t or ""), k) for k, t in enumerate(texts)]
    rows += [rows[9]] * 3 + [(10, words(40), "en", "s1", 1, 1), (None, words(33), None, None, None, None)]
    rows += [(100 + k, f"{words(12).upper()} !!! ### $$$", "en", "s1", 1, 1) for k in range(40)]
    out = pipeline_tables(spark, tmp_path, rows, [(k, int(k < 100), 0) for k in [*range(9, 49), *range(100, 140)]]).collect()
    docs, folder = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept = collections.Counter(r.doc_id for r in docs.collect())
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row_key"]
        assert {0, 3, 7, 9, 10, None} <= kept.keys() and sum(kept[k] for k in range(100, 140)) < 8
        assert {"quality": kept[9] == 4 and kept[2] == 1, "line_dedup": kept[2] == 1, "near_duplicates": kept[9] == 1 and not kept.keys() & {1, 2}}[name]
    assert {r.doc_id for r in out} <= kept.keys()
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 2048 and [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] for v in by.values())


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert pipeline_tables(spark, tmp_path, [], []).count() == 0


def test_near_duplicate_stage_keeps_one_of_each(spark):
    base = words(100)
    rows = [(1, base), (1, base), (1, changed(base, 50)), (2, base), (3, words(60)), (4, ""), (4, ""), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "4", "None"]


def test_tries_by_level_equal_the_walk():
    v = token_counts.Vocabulary(P.path("piece_bpe_32k.model"))
    some = {"", "a", "a\0", "é" * 5, "\U0001f600x", "▁", "x" * 62, "x" * 63, "x" * 64, "y" * 3000, *VOCAB, *(a + b for a, b in zip(VOCAB, VOCAB[7:])), *(w.title() + "," for w in VOCAB), "the", "The", "there", "interesting", "международный"}
    level, walk = token_counts.TrieCounter(v), token_counts.TrieCounter(v)
    level.add(some)
    walk._walk(sorted(some))
    assert level.counts == walk.counts and len(level.counts) == len(some)
    level.add(set())
    assert len(level.counts) == len(some)


@pytest.mark.parametrize("rows, part", [(700, 7), (700, 1), (5, 1000), (300, 100)])
def test_next_row_over_many_parts(spark, monkeypatch, rows, part):
    monkeypatch.setattr(simhash, "PART_ROWS", part)
    monkeypatch.setattr(simhash, "FAN", 4)
    ids = rng.sample(range(-(10**12), 10**12), rows)
    after = {r.doc_id: r.nxt for r in simhash.with_next(spark.createDataFrame([(k,) for k in ids], "doc_id bigint"), "doc_id", ["doc_id"], ["nxt"]).collect()}
    ordered = sorted(ids, reverse=True)
    assert after == dict(zip(ordered, [*ordered[1:], ordered[0]]))


def test_next_row_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 2)
    chain = lambda rows: [(r.doc_id, r.text, r.nxt) for r in simhash.with_next(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", ["text"], ["nxt"]).collect()]
    for rows in ([(5, "a"), (5, "b"), (4, "c"), (3, "d"), (3, "e"), (None, "f"), (None, "g"), (1, "h")], [(None, "a"), (None, "b"), (None, "c")], [(7, "a")]):
        got = chain(rows)
        follow = {t: n for _, t, n in got}
        seen, at = [], max(got, key=lambda r: (r[0] is not None, r[0] or 0))[1]
        for _ in rows:
            seen.append(at)
            at = follow[at]
        assert len(got) == len(rows) and sorted(seen) == sorted(t for _, t in rows)
    assert chain([]) == []


def test_traversal_visits_cells_in_order():
    r = np.random.default_rng(9)
    for _ in range(200):
        d1, d2 = r.random(r.integers(1, 9)).round(1), r.random(r.integers(1, 9)).round(1)
        reach, least = float(r.choice([0, 0.1, 0.35, 2])), int(r.integers(1, 6))
        sums = np.add.outer(d1 - d1.min(), d2 - d2.min()).ravel()
        order = np.lexsort((np.arange(len(sums)), sums))
        want = order[: max(least, int((sums <= reach).sum()))]
        assert embedding_dedup.traverse(d1, d2, reach, least).tolist() == want.tolist()
