"""Each operator against a brute-force version on a small fixture, and its edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinmark.llm import exact_dedup, line_dedup, lm_scoring, near_dedup, packing, pieces, quality_rules, shared, suffix_dedup, url_filters, warc
from twinmark.llm.graphs import components

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra="kept string, words string, crc string"):
    """Rows with columns whose names operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in texts]
    return spark.createDataFrame(rows, f"{DOCS}, {extra}").repartition(3)


def odd_texts():
    """Null, empty and white-space texts, ties, repeated rows, a null id, and a long text."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (6, "a b"), (6, "a b"), (None, "null id here"), (None, None), (7, long), (8, long + " x"), (9, "é▁漢 🙂\x00 q\r\n")]
    base = [rng.choice(words) for _ in range(90)]
    for i in range(20):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append((100 + i, " ".join(own)))
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd_texts())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- 1 ---
def covered(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append(mask)
    return out


def spans_of(mask):
    return int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())


def expected_cut(rows, masks):
    raw = [(t or "").encode() for _, t in rows]
    return sorted((str(i), len(b), int(m.sum()), spans_of(m), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest()) for (i, _), b, m in zip(rows, raw, masks))


def cut(spark, rows, length, words=False):
    got = suffix_dedup.cut_repeats(frame(spark, rows), length, words).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((str(r[0]), *tuple(r)[1:]) for r in got)


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (40, False, hot))
    monkeypatch.setattr(shared, "SPREAD_ROWS", 10)
    monkeypatch.setattr(suffix_dedup, "SHARD", 5)
    rng = random.Random(5)
    base = "".join(rng.choice("abcd é") for _ in range(400))
    texts = [None, "", "x" * 90, "ab" * 70, base, base[50:89], base[50:90], base[50:88], "\0" * 45, "\0" * 39]
    texts += ["".join(rng.choice("xyz") for _ in range(9)) + base[a : a + rng.randint(35, 60)] + rng.choice("xyz\0") * 5 for a in range(0, 300, 7)]
    # one passage with the same core in many contexts
    texts += ["".join(rng.choice("ab") for _ in range(30)) + "the core of a very common passage" + "".join(rng.choice("ab") for _ in range(30)) for _ in range(40)]
    texts += ["once " * 3] * 2 + [base[:45]] * 2
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, base[300:360]), (7, base[300:360]), (None, base[200:270])]
    assert cut(spark, rows, 40) == expected_cut(rows, covered([(t or "").encode() for _, t in rows], 40))


def covered_words(texts, length):
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", t)] for t in texts]
    strings = [[tuple(t[s:e] for s, e in p[i : i + length]) for i in range(len(p) - length + 1)] for t, p in zip(texts, places)]
    seen, out = Counter(x for s in strings for x in s), []
    for t, p, s in zip(texts, places, strings):
        mask = np.zeros(len(t), bool)
        for i, x in enumerate(s):
            if seen[x] > 1:
                mask[p[i][0] : p[i + length - 1][1]] = True
        out.append(mask)
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup_of_words(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (11, True, hot))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 400)
    rng = random.Random(6)
    base = [rng.choice(["a", "bé", "ccc", "Dd"]) for _ in range(300)]
    texts = [None, "", " \t", "a " * 30, " ".join(base), "\n".join(base[20:31]), "\n".join(base[20:30])]
    for a in range(0, 250, 5):
        own = [rng.choice("xyz") for _ in range(rng.randrange(6))] + base[a : a + rng.randint(7, 20)] + [rng.choice("xyz") for _ in range(rng.randrange(6))]
        texts.append("".join(w + rng.choice([" ", "  ", "\n"]) for w in own))
    texts += [" ".join([*(rng.choice("xyz") for _ in range(8)), *base[40:50], *(rng.choice("xyz") for _ in range(8))]) for _ in range(30)]
    rows = [*enumerate(texts), (7, "q w e " * 4), (None, " ".join(base[100:140]))]
    masks = covered_words([(t or "").encode() for _, t in rows], 11)
    assert cut(spark, rows, 11, True) == expected_cut(rows, masks)
    both = suffix_dedup.cut_repeats(frame(spark, rows), 2000, passage_words=11)
    assert sorted((str(r.doc["doc_id"]), r.n_removed, r.n_passage_bytes) for r in both.collect()) == sorted((str(i), 0, int(m.sum())) for (i, _), m in zip(rows, masks))


def test_suffix_dedup_of_long_texts(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    rows = [(1, long[:1_048_500]), (2, long[1_048_000:1_500_000] + long[1_200_000:1_200_500] * 2), (3, "short " + long[700_000:700_450]), (4, "é" * 200)]
    raw = [t.encode() for _, t in rows]
    marked = [np.zeros(len(t), bool) for t in raw]
    marked[0][1_048_000:] = marked[0][700_000:700_450] = marked[1][:500] = marked[2][6:] = True
    marked[1][152_000:152_500] = marked[1][452_000:] = True
    assert cut(spark, rows, 400) == expected_cut(rows, marked)


def test_drop_repeats(spark, empty):
    df = frame(spark, [(1, "é" * 300 + "tail"), (2, "head" + "é" * 300), (3, None)])
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.drop_repeats(df).collect()}
    assert got == {1: ("tail", 4), 2: ("head", 4), 3: (None, 0)}
    assert suffix_dedup.drop_repeats(df).columns == df.columns and suffix_dedup.drop_repeats(empty).count() == 0


# --- 2 ---
def statistics(t):
    w = WORD.findall(t or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, hit = Counter(grams), [False] * len(w)
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit[i : i + 3] = [True] * 3
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), sum(hit)


def test_quality_statistics(spark, docs, empty):
    texts = odd_texts() + [(50, "a b c " * 30), (51, "l one\nl one\n \nl one\n# $"), (52, "x y z x y z q"), (53, "p p p p"), (54, "p p p")]
    got = sorted((str(r.doc["doc_id"]), *(r[c] for c in quality_rules.BASE), r.base_failed, r.kept) for r in quality_rules.judge(frame(spark, texts), []).collect())
    exp = []
    for i, t in texts:
        s = statistics(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        exp.append((str(i), *s, failed, not failed))
    assert got == sorted(exp) and quality_rules.judge(empty, []).count() == 0


def test_rules_learn():
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.3
        row = dict.fromkeys(quality_rules.FEATURES, 0) | {"bad": int(bad), "upper_pm": rng.randrange(300, 700) if bad and i % 2 else rng.randrange(100), "symbols_pm": rng.randrange(400, 900) if bad and not i % 2 else rng.randrange(200)}
        rows.append(row)
    rules = quality_rules.learn(rows)
    said = [any(quality_rules.covers(r, row) for r in rules) for row in rows]
    assert len(rules) == 2 and sum(s == bool(r["bad"]) for s, r in zip(said, rows)) > 0.98 * len(rows)
    assert quality_rules.learn([]) == [] and quality_rules.learn([r | {"bad": 0} for r in rows]) == []


def test_rules_learn_conjunctions():
    """Bad is what has much of two things: neither alone tells."""
    rng, rows = random.Random(4), []
    for _ in range(3000):
        upper, shouts = rng.randrange(1000), rng.randrange(1000)
        rows.append(dict.fromkeys(quality_rules.FEATURES, 0) | {"upper_pm": upper, "shouts_pm": shouts, "bad": int(upper > 600 and shouts > 500)})
    rules = quality_rules.learn(rows)
    said = [any(quality_rules.covers(r, row) for r in rules) for row in rows]
    assert any(len({t.feature for t in r}) > 1 for r in rules) and sum(s == bool(r["bad"]) for s, r in zip(said, rows)) > 0.98 * len(rows)


def test_rules_fit(spark, docs):
    labels = spark.createDataFrame([(i, q, 0) for i, q in ((100, 1), (101, 0), (101, 1), (None, 0), (102, None))], "doc_id long, quality int, toxic int")
    assert quality_rules.fit(docs, labels) == [] and quality_rules.fit(docs, labels.limit(0)) == []


# --- 3 ---
def test_names():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(9))).encode() for _ in range(300)]
    for block in (1, 2, 3, 100):
        names = exact_dedup.name_texts(texts, block)
        assert len(set(zip(texts, names))) == len(set(texts)) == len(set(names))
    assert exact_dedup.name_texts([]) == []


def test_exact_dedup(spark, docs, empty):
    rows = odd_texts()
    key = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append((-len(t or ""), i is None, i))
    exp = []
    for i, t in rows:
        g = groups[key(t)]
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        exp.append((str(i), str(keep), len(g), i == keep, hashlib.sha256(key(t).encode()).hexdigest()))
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == sorted(exp) and exact_dedup.exact_dedup(empty).count() == 0
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(i for i, _, _, kept, _ in exp if kept)


# --- 4 ---
def slow_path(p, vocabulary, text):
    """Best (score, -pieces) by trying all pieces at all places."""
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        steps = [(best[end - n][0] + vocabulary[text[end - n : end]], best[end - n][1] - 1) for n in range(1, min(end, 20) + 1) if text[end - n : end] in vocabulary]
        best[end] = max(steps) if steps else (best[end - 1][0] + p.least, best[end - 1][1] - 1)
    return best[-1]


def test_pieces(spark, docs, empty):
    vocabulary = {"▁": -2.0, "▁a": -1.0, "a": -2.0, "b": -2.0, "ab": -2.5, "aba": -4.0, "ba": -2.4, "bab": -5.0, "▁ba": -2.2}
    p = pieces.Pieces([*vocabulary.items(), *((f"<{b}>", None) for b in range(256))], [len(vocabulary) + b for b in range(256)])
    rng, listed = random.Random(1), list(vocabulary.items())
    for _ in range(400):
        text = "".join(rng.choice("ab▁ab▁c") for _ in range(rng.randrange(12)))
        ids = p.best_path(text)
        known = [i for i in ids if i < len(listed)]
        score = sum(listed[i][1] for i in known) + p.least * text.count("c")
        assert (score, -len(known) - text.count("c")) == pytest.approx(slow_path(p, vocabulary, text))


def odd_pieces():
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "漢", "🙂", "▁", "the", " qu", "ing", "\x00", "\t", "1", "!!", "aaaa", "    ", "<s>", "<0x0A>", "Zürich"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(2000)] + ["The quick brown fox jumps over the lazy dog", "a" * 99, " " * 40, "word " * 500]


def test_pieces_are_the_models_own(spark, docs, empty):
    import sentencepiece

    model = pieces.default_model()
    theirs = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [*odd_texts(), *enumerate(odd_pieces())]
    out = pieces.encode_texts(frame(spark, texts), model)
    shown = lambda t: (t or "").replace("▁", " ")
    want = sorted((str(i), theirs.encode(t or ""), hashlib.sha256(shown(t).encode()).hexdigest()) for i, t in texts)
    assert sorted((str(r.doc_id), r.ids, r.decoded_sha256) for r in out.collect()) == want
    assert Counter((i, shown(t)) for i, t in texts) == Counter((r.doc_id, r.text) for r in pieces.decode_ids(out, model).collect())
    assert pieces.encode_texts(empty, model).count() == 0


def test_pieces_of_whole_table(spark):
    """The ids of every document of the smallest table, and the round trip."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    given = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = {r.doc_id: r for r in pieces.op4_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    assert out.keys() == given.keys()
    for i, t in given.items():
        assert out[i].ids == theirs.encode(t) and out[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


# --- 5 ---
def test_loser_tree():
    rng = random.Random(1)
    for k in list(range(9)) * 4:
        lists = [sorted(rng.randrange(40) for _ in range(rng.choice([0, 1, 9]))) for _ in range(k)]
        assert list(warc.LoserTree(lists, lambda x: x)) == sorted(x for r in lists for x in r)


def test_warc_of_long_payloads(spark, tmp_path, monkeypatch):
    """Long payloads have archives of few records, and all come back."""
    import os

    monkeypatch.setattr(warc, "ARCHIVES", ((10, 100), (1000, 3), (None, 1)))
    sizes = [5] * 30 + [500] * 9 + [5000] * 4
    df = spark.createDataFrame([(i, f"http://h.org/{i}", chr(97 + i % 26) * n + str(i)) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"))
    found = sorted((tmp_path / "w" / f).read_bytes().count(b"WARC/1.1") for f in os.listdir(tmp_path / "w") if f.startswith("part-"))
    assert found == [1] * 4 + [3] * 3 + [30]
    assert {r.page_id: r.payload_bytes for r in warc.capture_history(spark, str(tmp_path / "w")).collect()} == {i: n + len(str(i)) for i, n in enumerate(sizes)}


def test_warc(spark):
    import base64

    rows = [(1, "http://b.org/x", "p"), (2, "http://a.org/\r\ny", "p"), (3, None, None), (4, "", ""), (5, "http://a.org/", "é\r\n\r\nWARC/1.1\r\n"), (5, "http://a.org/", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "p")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string").repartition(3)
    out = warc.archive(df).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    exp = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "revisit" if i is not None and i > first[h or ""] else "response", first[h or ""] if i is not None and i > first[h or ""] else None) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == exp
    keys = [(r.url_key, r.stamp) for r in out]
    assert keys == sorted(keys) and warc.archive(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab"))


# --- 6 ---
def shingles(t):
    w = WORD.findall(fold(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_dedup(spark, docs, empty):
    rows = odd_texts()
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    exp = sorted((str(i), len(shingles(t)), None if i is None else find(i), i is None or find(i) == i) for i, t in rows)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(docs).collect())
    assert got == exp and near_dedup.near_dedup(empty).count() == 0
    assert len({find(i) for i in range(100, 120)}) < 20


def test_near_dedup_at_the_threshold(spark):
    """1,200 pairs with similarities about 0.75, each found exactly if it reaches it."""
    rng, rows, near = random.Random(12), [], 0
    for k in range(1200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        n = rng.randint(11, 18)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:-n] + [f"v{rng.randrange(10**6)}" for _ in range(n)]))]
    out = {r.doc_id: r.component_id for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    for (i, a), (j, b) in zip(rows[::2], rows[1::2]):
        x, y = shingles(a), shingles(b)
        like = 100 * len(x & y) >= 75 * len(x | y)
        near += like
        assert out[i] == i and out[j] == (i if like else j)
    assert 600 < near < 1200


def test_dedup_stages_keep_clashing_columns(spark):
    rows = [(1, "a b c d e f", 7, "x", "y", "z"), (2, "a b c d e f", 8, "x", "y", "z"), (3, "other", 9, "x", "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _sha string, id string, doc string").withColumn("sha", F.lit(1))
    for drop in (exact_dedup.drop_exact_duplicates, near_dedup.drop_near_duplicates, suffix_dedup.drop_repeats):
        out = drop(df)
        kept = {r.doc_id: tuple(r) for r in out.collect()}
        assert out.columns == df.columns and kept == {r[0]: (*r, 1) for r in rows if r[0] in kept} and kept.keys() >= {1, 3}


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    sets = [np.concatenate([both, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]) for _ in range(2)] + [rng.integers(0, 1 << 63, 1000, dtype=np.uint64)]
    _, odd = near_dedup.sketches(np.concatenate(sets), np.array([1000] * 3))
    z = lambda i, j: int(np.bitwise_count(odd[i].view(np.uint64) ^ odd[j].view(np.uint64)).sum())
    assert z(0, 1) < near_dedup.most_bits() < z(0, 2)


def test_block_links():
    """Classes of a bucket in several blocks: links join exactly the components that similar pairs give."""
    rng = random.Random(4)
    sets = []
    for _ in range(40):
        base = rng.sample(range(10_000), 60)
        sets += [np.array(sorted(set(base) - set(rng.sample(base, k)) | set(rng.sample(range(10_000), k))), np.uint64) for k in range(0, 12, 2)]
    flat, sizes = near_dedup.mix(np.concatenate(sets)), np.array([len(s) for s in sets])
    _, odd = near_dedup.sketches(flat, sizes)
    hashed = [np.sort(x) for x in np.split(flat, np.cumsum(sizes)[:-1])]
    rows = [(0, 0, 0, 0, i, i, odd[i].tolist(), hashed[i].tobytes()) for i in range(len(sets))]
    groups = near_dedup._Groups(list(range(len(sets))))
    for a, b in near_dedup._links(rows, near_dedup.most_bits(), 75):
        groups.up[groups.find(a)] = groups.find(b)
    want = near_dedup._Groups(list(range(len(sets))))
    for i in range(len(sets)):
        for j in range(i):
            n = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                want.up[want.find(i)] = want.find(j)
    same = lambda g: [[g.find(i) == g.find(j) for j in range(i)] for i in range(len(sets))]
    assert same(groups) == same(want)


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    up = {x: x for e in links for x in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for e in links if e[0] != e[1] for x in e}


# --- 7 ---
def test_packer():
    rng = random.Random(1)
    for bins in (1, 3, 50):
        p, used = packing.Packer(16, bins), {}
        for _ in range(2000):
            n = rng.randint(1, 16)
            seq, at = p.place(n)
            assert used.get(seq, 0) == at and at + n <= 16
            used[seq] = at + n
            assert p.open <= bins
        assert p.count == len(used)


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    t = Tokenizer.from_file(path)
    rows = odd_texts() + [(200, "a  b\n c <|endoftext|> don't\x1c \xa0x"), (201, "x" * 5000)]
    out = packing.pack(frame(spark, rows), path, ids=True, added_tokens=True).collect()
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.pieces_of(len(ids))):
            raw = np.array(ids[s : s + n], "<u4").tobytes()
            want[(i, k, s, n, zlib.crc32(raw), raw)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in out) == want
    filled = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1024 and len(filled) <= -(-sum(r.length for r in out) // 1024) + 3
    many = packing.pack(frame(spark, [(i, "word " * (i % 700)) for i in range(900)]).repartition(150), path)
    assert many.select("sequence_id").distinct().count() <= -(-many.agg(F.sum("length")).first()[0] // 1024) / 0.995
    assert packing.pieces_of(1024) == [(0, 1024)] and packing.pieces_of(2050) == [(0, 2), (2, 1024), (1026, 1024)]
    assert packing.pack(empty, path).count() == 0


def test_encoder_forgets():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    t = Tokenizer.from_file(packing.default_tokenizer())
    parts = [" ", "  ", "\n", "\t", "a", "b", "'s", "'t", "É", "1", "!", "<|endoftext|>", "\x1c", "\xa0", "word", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500)]
    e, got = packing.Encoder(packing.default_tokenizer(), 40, added_tokens=True), []
    for i in range(0, len(texts), 7):
        got += e(texts[i : i + 7])
    assert got == [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    t = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "a", "'s", "É", "1", "<|endoftext|>", "<|endoftext", "|>", "<|", "word", "\xa0"]
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "", None, "x <|endoftext|>" * 2000] + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(500)]
    assert t.encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    frame(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.pieces_of(len(ids))):
            want[(i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))] += 1
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for out in (packing.op7_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out.collect()) == want


# --- 8 ---
def lm_model(rows, held):
    """Counts of training texts' n-grams, and the probability of a word after a history."""
    tokens = lambda t: [*WORD.findall(fold(t)), None]
    uni, bi, tri = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = [None, *tokens(t)]
            uni.update(w[1:])
            bi.update(zip(w, w[1:]))
            tri.update(zip(w, w[1:], w[2:]))
    n, v = sum(uni.values()), len(uni)

    def p(history, x):
        out = (uni[x] + 1) / (n + v + 1)
        if uni[history[-1]]:
            out = (bi[history[-1], x] + lm_scoring.WEIGHTS[0] * out) / (uni[history[-1]] + lm_scoring.WEIGHTS[0])
        if len(history) > 1 and bi[history[-2], history[-1]]:
            out = (tri[history[-2], history[-1], x] + lm_scoring.WEIGHTS[1] * out) / (bi[history[-2], history[-1]] + lm_scoring.WEIGHTS[1])
        return out

    return tokens, uni, n, v, p


def held_by_id(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


@pytest.mark.parametrize("sizes", [(8 << 20, 4 << 20), (300, 100)])
def test_lm(spark, docs, empty, sizes):
    rows = [*odd_texts(), *((300 + i, " ".join("abcde"[(i * i + j * (j + i) // 3) % 5] for j in range(i * 9))) for i in range(40))]
    tokens, uni, n, v, p = lm_model(rows, held_by_id)
    exp = Counter()
    for i, t in rows:
        w = tokens(t)
        score = sum(np.log10(p([None, *w[:k]], x)) for k, x in enumerate(w))
        base = sum(np.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        exp[(i, held_by_id(i), len(w), sum(uni[x] > 0 for x in w), n, round(base, 5), round(score, 5))] += 1
    # in another order at each scan
    shuffled = frame(spark, rows).orderBy(F.rand())
    got = lm_scoring.lm_scores(shuffled, lm_scoring.held_out(F.col("doc_id")), block_bytes=sizes[0], range_bytes=sizes[1]).collect()
    assert Counter((*tuple(r)[:5], round(r.base_score, 5), round(r.score, 5)) for r in got) == exp
    assert lm_scoring.lm_scores(empty, lm_scoring.held_out(F.col("doc_id"))).count() == 0
    assert lm_scoring.lm_scores(docs, F.lit(True)).filter("n_known > 0").count() == 0


def test_lm_fails_twice():
    """In the state of two words, a word that was seen after neither: two failure arcs, then the root's arc."""
    words, pairs, triples = np.array([4, 3, 2, 1, 5]), (np.array([0, 1]), np.array([1, 2]), np.array([2, 1])), (np.array([0]), np.array([2]), np.array([1]))
    a = lm_scoring.Automaton(words, pairs, triples, 4, (15, 5))
    state = np.array([1 + 5 + 0])  # after the words 0 and 1
    after, weight = a.step(state, np.array([3]))
    assert after.tolist() == [1 + 3] and weight[0] == pytest.approx(np.log10(4 / (2 + 4)) + np.log10(16 / (3 + 16)) + np.log10(2 / 21))
    after, weight = a.step(state, np.array([2]))
    two = (1 + 16 * 3 / 21) / (3 + 16)
    assert after.tolist() == [1 + 5 + 1] and weight[0] == pytest.approx(np.log10((1 + 4 * two) / (2 + 4)))


def test_lm_lanes(monkeypatch):
    """Long texts in lanes get the scores of one traversal."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(40))) for _ in range(60)]
    tokens, _, n, v, p = lm_model(list(enumerate(texts)), lambda i: i % 3 == 0)
    flat, sizes = lm_scoring._block_tokens(texts)
    keys = lm_scoring.ngram_keys(flat, np.cumsum(sizes) - sizes)
    train = np.repeat(np.arange(60) % 3 > 0, sizes)
    inner = np.ones(len(flat), bool)
    inner[np.cumsum(sizes) - sizes] = False
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(at, weights=np.concatenate([train, train, train[inner]])).astype(np.int64)
    want = [sum(np.log10(p([None, *w[:k]], x)) for k, x in enumerate(w)) for w in map(tokens, texts)]
    for lane in (2, 5, 256):
        monkeypatch.setattr(lm_scoring, "LANE", lane)
        assert lm_scoring.score_block(texts, totals, (n, v), lm_scoring.WEIGHTS)[3] == pytest.approx(want)


# --- 9 ---
def test_urls(spark):
    urls = [None, "", "no scheme", "http://Example.NET/en/x?utm_source=a", "http://a.example.net/en", "http://x.net", "http://x.net/#f", "http://net/a", "http://é.ORG/fr/?q=://z", "http://a.com/p?utm_source=1", "http://a.com/p#z", "http://a.com/q", "http://notexample.com/de/", "http://w.example.com/de/x", "x?y=http://h.com/k"]
    urls += [f"http://h{i}.com/{i % 97}" + ("?utm_source=x" if i % 3 == 0 else "") for i in range(400)]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*urls, *urls[:5]])], "page_id long, url string, key string, verdict string")
    listed = {}
    for u in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        key = (m and (fold(m[1]), m[2])) or ("", "")
        listed[key] = listed.get(key, False) or "utm_source=" in (u or "")
    for limit in (1 << 20, 60):  # one cascade, and several shards
        for r in url_filters.filter_urls(df, F.col("url").rlike(url_filters.TRACKED), max_bytes=limit).collect():
            fits = [(len(h + p), h + p, says) for says, h, p in url_filters.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
            rule, verdict = max(fits)[1:] if fits else (None, "block" if listed[r.host, r.path] else "allow")
            assert (r.rule, r.verdict) == (rule, verdict), r
    assert url_filters.filter_urls(df.limit(0), F.lit(True)).count() == 0


# --- 10 ---
def test_lines(spark):
    rows = [(i, f"http://h{i % 2}.com/{i}", f"<p>menu</p><p>own {i}</p><div>menu</div>" + ("<b>half</b><br>" if i % 4 < 2 else "")) for i in range(20)] + [(90, None, None), (91, "http://solo.com/", "<p>menu</p>"), (91, "http://solo.com/", "<p>menu</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, lines string")
    for limit in (1 << 20, 0):
        got = {r.page["page_id"]: (r["lines"], r.kept_lines) for r in line_dedup.site_line_dedup(df, line_dedup.html_lines(F.col("html")), url_filters.host_of(F.col("url")), 0.6, 3, limit).collect()}
        assert got[0] == (["menu", "own 0", "menu", "half"], ["own 0", "half"]) and got[90] == ([], []) and got[91] == (["menu"], ["menu"])
    assert line_dedup.site_line_dedup(df.limit(0), line_dedup.html_lines(F.col("html")), F.lit("h")).count() == 0
