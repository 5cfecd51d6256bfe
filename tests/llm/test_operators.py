"""The training-data operators on small fixtures with every odd case, against brute force."""

import collections
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from dirgauge.llm import chat_format, components, embedding_dedup, line_dedup, minhash, mixing, packing, quality, simhash, textkeys, token_counts, url_filter

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, rep string, uid int"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]


def words(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = words(200)
    near = base.split()
    near[7] = "changed"
    block = "\n".join(words(20) for _ in range(4))
    out = [base, base, " ".join(near), "", None, "one", "two words", f"{words(30)}\n{block}\n{words(5)}", f"{words(12)}\n{block}", "  odd \t white\n\n space ", "é ü " + words(60), words(5000)]
    return out + [words(rng.randint(1, 300)) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", None, "x", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def union(pairs, ids):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (None, 1), (3, 1), *((100, k) for k in range(101, 140))]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = union([e for e in edges if None not in e], {x for e in edges for x in e if x})
    assert got == {k: v for k, v in want.items() if k != 9}


def test_minhash(docs, none, texts):
    got = by_id(minhash.near_duplicates(docs, words=3, percent=85))
    sets = {}
    for k, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = union(links, sets)
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), want[k], want[k] == k) for k in sets}
    assert minhash.near_duplicates(none).count() == 0


def test_line_dedup(docs, none, texts):
    got = by_id(line_dedup.dedup_lines(docs))
    assert got[1].text == "" and got[0].text == texts[0]
    assert got[8].text == texts[8].split("\n")[0] and got[8].n_removed == 4 and got[7].text == texts[7]
    assert got[4].text is None and got[3].text == "" and sum(r.n_removed for r in got.values()) == 5
    assert line_dedup.dedup_lines(none).count() == 0


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert line_dedup.patience([], [1]) == []


def test_packing(docs, none, texts):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack_byte_bpe(docs).collect()
    for k, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == k)
        assert own[0][0] == 0 and sum(o[1] for o in own) == len(ids) == own[0][3]
        for (start, length, crc, _), after in itertools.zip_longest(own, own[1:]):
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc and (after is None or after[0] == start + length)
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_byte_bpe(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    per = {}
    for r in rows:
        p = per.setdefault(r.source, [0, 0, r.target])
        p[0] += r["size"]
        p[1] += r.taken
        assert r.taken <= 3 * r["size"]
    total, weights = sum(p[0] for p in per.values()), dict(zip(sorted(per, key=lambda s: (s is None, s or "")), itertools.cycle((1, 2, 3))))
    want, capped = {}, set()
    while True:
        rest = total - sum(3 * per[s][0] for s in capped)
        want = {s: 3 * per[s][0] if s in capped else rest * weights[s] / sum(w for x, w in weights.items() if x not in capped) for s in per}
        over = {s for s in per if s not in capped and want[s] > 3 * per[s][0]}
        if not over:
            break
        capped |= over
    for s, (_, taken, target) in per.items():
        assert target == pytest.approx(want[s]) and abs(taken - target) <= 0.05 * target
    assert mixing.mix(none).count() == 0


def test_simhash(spark, docs, none):
    same = simhash.with_fingerprint(docs.select("doc_id", "text"), "text", "f")
    got = by_id(same)
    assert got[0].f == got[1].f and got[3].f == got[4].f
    assert simhash.with_fingerprint(none.select("doc_id", "text"), "text", "f").count() == 0
    follow = {r.doc_id: r.nxt for r in simhash.with_next(docs.select("doc_id"), "doc_id", ["doc_id"], ["nxt"]).collect()}
    n = docs.count()
    assert follow == {k: (k - 1) % n for k in range(n)}


def test_simhash_votes(texts):
    def brute(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        hashes, _ = textkeys.words(data, np.array([0, len(data)]), fold=False)
        runs = [(hashes, n, w, 0) for n, w in simhash.TERM_WEIGHTS.items()]
        if len(data) <= simhash.SHORT:
            runs += [(textkeys.BYTE_VALUES[False][data], n, w, 64) for n, w in simhash.BYTE_WEIGHTS.items()]
        votes = [0] * simhash.BITS
        for values, n, weight, kind in runs:
            terms = textkeys.mix(textkeys.shingles(values, n) + np.uint64(n + kind)) if len(values) >= n else []
            for term, times in collections.Counter(int(t) % (1 << simhash.HASH_BITS) for t in terms).items():
                spread = b"".join(textkeys.mix(np.array([term + 64 * k + 1], dtype=np.uint64)).tobytes() for k in range(2))
                for i in range(simhash.BITS):
                    votes[i] += weight * times.bit_length() * (1 if spread[i // 8] >> i % 8 & 1 else -1)
        return sum((v > 0) << i for i, v in enumerate(votes)).to_bytes(16, "little")

    rows = [None, "", "a", "a a a a", "same same", " \n", *[t for t in texts if t][:5], words(700), "again " * 600]
    got = simhash.fingerprints(pa.array(rows)).to_pylist()
    assert [np.array(f, dtype=np.int64).tobytes() for f in got] == [brute(t or "") for t in rows]


def test_token_counts(docs, none, texts):
    v = token_counts.Vocabulary(P.path("piece_bpe_32k.model"))

    def brute(word):
        text, best = token_counts.MARK + word, [(0.0, 0)]
        for end in range(1, len(text) + 1):
            nb = len(text[end - 1].encode())
            options = [(best[end - 1][0] + nb * v.byte_score, -(-best[end - 1][1] + nb))]
            options += [(best[i][0] + v.scores[text[i:end]], best[i][1] - 1) for i in range(max(0, end - v.longest), end) if text[i:end] in v.scores]
            best.append(max(options))
        return -best[-1][1]

    got = by_id(token_counts.count_tokens(docs, P.path("piece_bpe_32k.model")))
    for k, t in enumerate(texts):
        assert got[k].n_tokens == sum(map(brute, (t or "").split()))
    assert token_counts.count_tokens(none, P.path("piece_bpe_32k.model")).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 16))
    x[50:100] = x[:50] + r.normal(size=(50, 16)) * 0.05
    x[100] = x[0]
    rows = [(k, [float(v) for v in row.astype(np.float32)]) for k, row in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [])]
    got = by_id(embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")), "vec_id")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(u @ u.T >= 0.9)) if a < b]
    want = union(links, range(305))
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(got[k].n_links == sum(k in p for p in links) for k in range(305))


def test_chat(spark):
    rows = [(1, 0, "user", "a <b> \\ c"), (1, 1, "assistant", "x\n</turn>\ny"), (1, 2, None, None), (2, 0, 'q">\n', "\\<"), (None, None, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = chat_format.format_conversations(turns)
    back = {r.conv_id: ([(t.role, t.text) for t in r.b], r.loss) for r in out.select("conv_id", chat_format.read_turns(out.formatted).alias("b"), chat_format.read_loss(out.formatted, out.loss_spans).alias("loss")).collect()}
    assert back == {1: ([("user", "a <b> \\ c"), ("assistant", "x\n</turn>\ny"), ("", "")], "x\n</turn>\ny"), 2: ([('q">\n', "\\<")], ""), None: ([("assistant", "")], "")}
    parts = [(1, 0, "user", [("text", "see <", None, None), ("image", None, "i.png", 2), ("audio", None, "a.wav", None), None])]
    row = chat_format.format_conversations(spark.createDataFrame(parts, f"conv_id int, turn int, role string, parts {chat_format.PARTS_TYPE}"), parts="parts").first()
    assert "see \\<<image 1/><audio 2/>" in row.formatted and row.attachment_tokens == 2 * 256 + 25 and row.attachments[0].ref == "i.png"


def test_urls(spark):
    rows = [(1, "http://a.com/en/1", '<link rel="canonical" href="https://b.org/x">'), (2, "https://B.org/x#t", ""), (3, "http://example.com/en/70", None), (4, None, None), (5, "nonsense", ""), (6, "http://c.org/", '<meta http-equiv="refresh" content="0; url=http://a.com/en/1">')]
    got = by_id(url_filter.judge(spark.createDataFrame(rows, "page_id int, url string, html string"), url_filter.RULES), "page_id")
    assert {k: r.verdict for k, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}
    assert got[3].rule == "example.com/en/7" and got[4].host == "" and got[2].host == "b.org"


def test_quality(spark, docs, none):
    loud = [(1000 + k, " ".join(f"{w.upper()}!!" for w in words(40).split()), "en", "s", None, "x", 1) for k in range(60)]
    both = docs.union(spark.createDataFrame(loud, DOC))
    labels = spark.createDataFrame([(k, 1 if k < 1000 else 0) for k in [*range(12, 72), *range(1000, 1060)]] + [(None, 1)], "doc_id bigint, quality int")
    model = quality.train(both, labels)
    got = by_id(quality.score(both, model))
    assert all(0 <= r.score <= 1 for r in got.values()) and all(got[1000 + k].predicted == 0 for k in range(60))
    assert sum(got[k].predicted for k in range(12, 72)) >= 57
    assert quality.score(none, model).count() == 0
    assert quality.train(both, labels.where("false")).rules == ()




def test_line_dedup_against_all_pairs(spark):
    r = random.Random(8)
    line = ["", *(f"l{k} " + " ".join(f"w{r.randrange(99)}" for _ in range(n - 1)) for k, n in enumerate([1, 3, 10, 15, 20, 20, 20, 25, 49, 50, 60]))]
    x, y = line[7], line[8]
    passage, other, much = line[3:7], line[5:8], line[4:8]
    held = [
        ["head", *passage, "mid", *passage, "foot"], ["start", *passage, "end"],  # twice in the first
        ["start", *passage, "between", *passage, "end"],  # twice in the later one
        ["aa", *much, "bb", *other, x, x, "cc"], ["dd", *other, x, x, "ee", *much, "ff"],  # in opposite order
        [*passage[:2], y, *passage[2:]], [line[10], line[3]], [line[10]], [line[10], line[3], "new"],
        *([r.choice(line) for _ in range(r.randint(1, 12))] for _ in range(60)),
    ]
    count = lambda lines: sum(len(t.split()) for t in lines)
    runs = [{tuple(d[i:j]) for i in range(len(d)) for j in range(i + 1, len(d) + 1) if count(d[i:j]) >= 50} for d in held]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(list(enumerate("\n".join(d) for d in held)), "doc_id bigint, text string")))
    for k, d in enumerate(held):
        gone = {p for i in range(len(d)) for j in range(i + 1, len(d) + 1) if any(tuple(d[i:j]) in s for s in runs[:k]) for p in range(i, j)}
        assert (got[k].n_removed, got[k].text) == (len(gone), "\n".join(t for p, t in enumerate(d) if p not in gone))


def test_line_dedup_passage_of_lines_first_held_elsewhere(spark):
    line = [" ".join(f"{c}{k}" for k in range(20)) for c in "abcde"]
    texts = ["\n".join([*line[:2], line[4], *line[2:4]]), "\n".join(line[:4]), "\n".join(line[:4])]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    assert [got[k].text for k in range(3)] == [*texts[:2], ""]


def test_common_blocks_without_anchors():
    assert line_dedup.common_blocks([7, 1, 2, 3, 8, 1, 2, 3, 9], [5, 1, 2, 3, 6], [20] * 5, 50) == [1, 2, 3]
    assert line_dedup.common_blocks([7, 1, 2, 3, 9], [1, 2, 3, 5, 1, 2, 3, 6], [20] * 8, 50) == [0, 1, 2, 4, 5, 6]
    assert line_dedup.common_blocks([1, 2, 3, 4, 5, 6, 7], [5, 6, 7, 8, 1, 2, 3, 4], [20] * 8, 50) == [0, 1, 2, 4, 5, 6, 7]


def test_embeddings_with_few_links(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = r.normal(size=(40, 64))
    away -= (away * x[:40]).sum(axis=1, keepdims=True) * x[:40]
    x[40:80] = 0.902 * x[:40] + (1 - 0.902**2) ** 0.5 * away / np.linalg.norm(away, axis=1, keepdims=True)
    rows = [(k, v) for k, v in enumerate(x.astype(np.float32).tolist())]
    got = by_id(embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")), "vec_id")
    assert [k for k in range(40) if got[k + 40].component_id != k] == []
    assert sum(row.n_links for row in got.values()) == 80


def test_simhash_across_short():
    r = random.Random(6)
    for size in (simhash.SHORT, simhash.LONG):
        texts = []
        for _ in range(30):
            text = " ".join(r.choice(VOCAB) for _ in range(300))[: size - 2].rstrip() + "."
            texts += [text, f"{text} another"]
        assert all(len(a) <= size < len(b) for a, b in zip(texts[::2], texts[1::2], strict=True))
        bits = [int.from_bytes(np.array(f, dtype=np.int64).tobytes(), "little") for f in simhash.fingerprints(pa.array(texts)).to_pylist()]
        like = [1 - (a ^ b).bit_count() / simhash.BITS for a, b in zip(bits[::2], bits[1::2], strict=True)]
        assert min(like) > 0.85
