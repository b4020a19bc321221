"""The training-data operators against brute force and on odd input."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from graincart.llm import components, decontaminate, embeddings, langid, lmscore, packing, quality, sharding, simhash, toxicity, urls
from graincart.llm.common import TOKENIZER

SF = "/root/testdata/sf0.001"
TEXTS = [(1, "Alpha beta gamma delta."), (2, None), (3, ""), (4, "alpha beta gamma delta."), (4, "alpha beta gamma delta."), (None, "one two"), (7, "x " * 6000), (8, " \n\t")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("score", F.lit("clash"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# --- 1 language identification


def _bits(model, lang, data):
    """Code length byte by byte, from the counts alone."""
    counts = {}
    for k, n, g, c in zip(model.lang, model.n, model.gram, model.count, strict=True):
        if model.langs[k] == lang:
            gram = int(g).to_bytes(int(n), "big")
            counts.setdefault(gram[:-1], Counter())[gram[-1]] += int(c)
    everywhere = {(int(g) >> 8).to_bytes(int(n) - 1, "big") for n, g in zip(model.n, model.gram, strict=True)}

    def p(context, byte):
        seen = counts.get(context)
        if seen:
            total, kinds = sum(seen.values()), len(seen)
            if seen[byte]:
                return seen[byte] / (total + kinds)
            return kinds / (total + kinds) * (p(context[1:], byte) if context else 1 / 256)
        return p(context[1:], byte) if context else 1 / 256

    assert everywhere
    return sum(-math.log2(p(data[max(0, i - model.order) : i], b)) for i, b in enumerate(data))


def test_code_lengths_are_exact(docs):
    model = langid.train(docs, F.lit(False), sample_bytes=20_000)
    for text in ("the and of", "der die das und", "zqxj 99", "ñandú"):
        got = model.code_lengths([text.encode()])[0]
        assert got == pytest.approx([_bits(model, lang, text.encode()) for lang in model.langs], rel=1e-4)


def test_language_accuracy_and_odd_rows(spark, docs, odd):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.train(docs, held)
    judged = langid.identify(docs.where(held & F.col("lang").isNotNull()), model).where("lang_pred != 'und'")
    assert judged.where("lang = lang_pred").count() >= 0.9 * judged.count()
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(TEXTS)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if not (r.text or "").strip())
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(odd.limit(0), model).count() == 0
    strange = langid.identify(odd.select("doc_id", "text", F.lit(1).alias("row"), F.lit(2).alias("found"), F.lit(3).alias("a.b"), F.lit(4).alias("lang_pred")), model)
    assert strange.columns == ["doc_id", "text", "row", "found", "a.b", "lang_pred", "score"] and strange.count() == len(TEXTS)
    alone = {t: model.predict([t])[1][0] for _, t in TEXTS if t}
    assert all(r.score == alone[r.text] for r in rows if r.text)  # no score depends on its neighbours
    untrained = langid.train(docs.limit(0), F.lit(False))
    assert {r.lang_pred for r in langid.identify(odd, untrained).collect()} == {"und"}


# --- 2 packing


def test_packing_round_trip(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(TOKENIZER)))
    for table in (docs, odd.drop("score")):
        rows = packing.pack(packing.pieces(table, TOKENIZER)).collect()
        want = Counter()
        for r in table.collect():
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
            for k, at in enumerate(range(0, len(ids), 4096)):
                part = ids[at : at + 4096]
                want[(r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        sequences = {}
        for r in rows:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 4096
        least = -(-sum(r.length for r in rows) // 4096)
        assert len(sequences) <= 1.05 * least + 1
    assert packing.pack(packing.pieces(odd.limit(0), TOKENIZER)).count() == 0


def _fewest(lengths, capacity):
    """The least number of bins, by trying every place for each piece."""
    best = len(lengths)

    def place(k, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if k == len(lengths):
            best = len(loads)
            return
        for i in range(len(loads)):
            if loads[i] + lengths[k] <= capacity and loads[i] not in loads[:i]:
                place(k + 1, [*loads[:i], loads[i] + lengths[k], *loads[i + 1 :]])
        place(k + 1, [*loads, lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_small_sets_against_the_optimum():
    rng, over = np.random.default_rng(4), []
    for trial in range(30):
        lengths = rng.integers(10, 60, 11).tolist()
        best = packing.evolve(lengths, capacity=100, seed=trial)
        assert sorted(i for b in best.bins for i in b) == list(range(11)) and max(best.loads) <= 100
        over.append(len(best.bins) - _fewest(lengths, 100))
    assert max(over) <= 1 and sum(over) <= 3, over


def _best_fit(lengths):
    one = packing.Packing(lengths, packing.CAPACITY)
    one.insert(sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)))
    return one


def test_crossover_beats_best_fit_where_that_is_not_optimal():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1100, 1600, (2, 400)).tolist()
    lengths = [x for p, q in zip(a, b, strict=True) for x in (p, q, packing.CAPACITY - p - q)]  # 400 full bins exist
    history: list[str] = []
    best = packing.evolve(lengths, seed=3, history=history)
    assert sorted(i for b in best.bins for i in b) == list(range(1200)) and max(best.loads) <= packing.CAPACITY
    assert history.count("crossover") > 20 and history.count("better") >= 3
    assert len(best.bins) <= len(_best_fit(lengths).bins) - 5


def test_migrants_are_injected_and_help():
    rng = np.random.default_rng(2)
    a, b = rng.integers(1100, 1600, (2, 200)).tolist()
    bins = [(p, q, packing.CAPACITY - p - q) for p, q in zip(a, b, strict=True)]
    history: list[str] = []
    helped = packing.evolve([x for t in bins for x in t], None, bins, seed=3, generations=1, history=history)
    assert history[0] == "migrants" and len(helped.bins) <= 202  # a perfect packing settles, but for what mutation dissolves
    alone = packing.evolve([x for t in bins for x in t], seed=3, generations=1)
    assert len(alone.bins) >= len(helped.bins) + 8


def test_merging_leaves_few_part_filled_bins(spark):
    lengths = np.random.default_rng(3).integers(1, 1200, 6000).tolist()
    table = spark.createDataFrame([(n, n, f"t{i}") for i, n in enumerate(lengths)], "length int, offset int, `row.x` string")
    rows = packing.pack(table, island=100).collect()  # 60 islands
    assert sorted((r.length, r["row.x"]) for r in rows) == sorted((n, f"t{i}") for i, n in enumerate(lengths))
    loads = Counter()
    for r in rows:
        loads[r.sequence_id] += r.length
    assert max(loads.values()) <= packing.CAPACITY and len(loads) <= -(-sum(lengths) // packing.CAPACITY) * 1.01 + 1
    tiny = packing.pack(spark.createDataFrame([(1,)] * 5000, "length int"), island=100).groupBy("sequence_id").count().collect()
    assert sorted(r["count"] for r in tiny) == [904, 4096]


def test_encoder_remembers_and_forgets():
    import public_tokenizers

    path = str(public_tokenizers.path(TOKENIZER))
    texts = [" ".join(f"word{i} x{j}" for i in range(j, j + 9)) for j in range(30)]
    small = packing.Encoder(path, remembered=25)
    assert [small.encode([t])[0] for t in texts * 2] == packing.Encoder(path).encode(texts * 2)
    assert len(small.young) <= 25 or not small.old
    from tokenizers import Tokenizer

    whole, encoder, rng = Tokenizer.from_file(path), packing.Encoder(path), np.random.default_rng(6)
    strange = ["<|ENDOFTEXT|> a<|endoftext|>b \u00c9", "J\u030c a\x1c\x1db\x85c\xa0d \u0130 \u03a3\u0391\u03a3", "it's 12\u00b3 \u00aa\u00ba \u00b5 \xad\x00\x7f </w>"]
    strange += ["".join(map(chr, rng.integers(1, top, 80))) for top in (128, 256, 0x340, 0x2100) for _ in range(50)]
    assert encoder.bare is not None
    assert encoder.encode(strange) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in strange]


# --- 3 sharding


def test_sharding_is_even_and_complete(spark, docs, odd):
    for table in (docs, odd, odd.limit(0)):
        rows = sharding.shard_documents(table.select("doc_id", "text")).collect()
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in table.collect())
        counts = Counter(r.shard for r in rows)
        sizes = [counts[s] for s in range(24)]
        assert max(sizes) - min(sizes) <= 1 and {r.law for r in rows} <= {"rows"}
        for s in counts:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


# --- 4 scoring


def _brute_lm(texts, order):
    """(words, score) of each text: each word by the counts of all its other occurrences."""
    split = [[b""] * (order - 1) + (t or "").encode().lower().split() for t in texts]
    gram = Counter()
    for ws in split:
        gram.update(tuple(ws[i - k + 1 : i + 1]) for i in range(order - 1, len(ws)) for k in range(1, order + 1))
    every = sum(len(ws) - order + 1 for ws in split)
    full = sum(len(ws) >= order for ws in split)

    def score(ws, i, k):
        if k == 0:
            return math.log10(1 / every)
        seen = gram[tuple(ws[i - k + 1 : i + 1])] - 1
        if not seen:
            return math.log10(0.4) + score(ws, i, k - 1)
        under = every if k == 1 else full if i == order - 1 else gram[tuple(ws[i - k + 1 : i])]
        return math.log10(seen / (under - 1))

    for ws in split:
        scores = [score(ws, i, order) for i in range(order - 1, len(ws))]
        yield len(scores), sum(scores) / len(scores) if scores else None


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores_against_brute_force(spark, odd, docs, order):
    # (words of a block, entries of a range, bits of a step): one step, and several with several merged runs
    for table, sizes in ((odd, (3, 2_000, 10)), (docs, (20_000, 30_000, 10)), (docs, (4_000, 500, 2))):
        rows = table.select("doc_id", "text").collect()
        expected = sorted((str(r.doc_id), n, s or 0) for r, (n, s) in zip(rows, _brute_lm([r.text for r in rows], order), strict=True))
        scored = lmscore.score_documents(table, order=order, block_words=sizes[0], range_entries=sizes[1], step_bits=sizes[2])
        got = sorted((str(r.doc_id), r.n_words, r.score or 0) for r in scored.collect())
        assert [g[:2] for g in got] == [e[:2] for e in expected]
        assert [g[2] for g in got] == pytest.approx([e[2] for e in expected])
    assert lmscore.score_documents(odd.limit(0)).count() == 0


# --- 5 URL filters


def test_url_rules_against_brute_force(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "com", "/de/")]
    pages = [None, "", "no scheme/x", "http://Example.ORG/es/1", "http://a.example.org/en/12?q", "http://notexample.org/es/", "https://x.com/de/", "https://com/de/?a://b", "ftp://x.net", "http://org", "a://b.com/de/#x"]
    table = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(pages)], "page_id int, url string, rule string")
    for r in urls.judge(table, spark.createDataFrame(rules, "verdict string, host string, path string")).collect():
        host = path = ""
        if r.url and "://" in r.url:
            rest = r.url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])
    none = urls.judge(table, spark.createDataFrame([], "verdict string, host string, path string"))
    assert {r.verdict for r in none.collect()} == {"allow"}


# --- 6 and 9 classifiers


@pytest.mark.parametrize(("op", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, odd, op, label):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = op.train(docs, labels, held)
    rows = op.score(docs.join(labels.where(held), "doc_id"), model).collect()
    good = sorted(((r.score, r[label]) for r in rows), key=lambda x: x[0])
    ones = sum(y for _, y in good)
    rank = sum(i for i, (_, y) in enumerate(good) if y) - ones * (ones - 1) / 2
    assert rank / (ones * (len(good) - ones)) > 0.8
    scored = op.score(odd, model).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r.score <= 1 for r in scored)
    assert op.score(odd.limit(0), model).count() == 0


def test_disguised_terms_and_exceptions():
    matcher = toxicity.Matcher({"grob": 2.0}, ["grob cut"])
    assert matcher.density("You gr0b") > 0 and matcher.density("you grоb") > 0  # a digit, a Cyrillic letter
    assert matcher.density("a grob cut") == 0 and matcher.density("grobian") == 0 and matcher.density(None) == 0


# --- 7 SimHash


def _fingerprint(text):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_brute_force(spark, odd):
    for r in simhash.near_duplicates(odd).collect():
        assert int(r.fingerprint, 16) in {_fingerprint(t) for i, t in TEXTS if i == r.doc_id}


@pytest.mark.parametrize("limit", [4096, 3])
def test_fingerprint_groups_against_brute_force(spark, limit):
    rng = np.random.default_rng(5)
    words = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    for _ in range(150):
        w = words[int(rng.integers(len(words)))]
        for bit in rng.integers(0, 64, int(rng.integers(1, 4))):
            w ^= 1 << int(bit)
        words.append(w)
    words = sorted({w - (1 << 64) if w >> 63 else w for w in words})
    links = simhash.link_fingerprints(spark.createDataFrame([(w,) for w in words], "fp long"), limit)
    found = {r.node: r.component for r in components.connected_components(links).collect()}
    parent = {w: w for w in words}

    def root(w):
        while parent[w] != w:
            w = parent[w]
        return w

    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert all(found.get(w, w) == root(w) for w in words)


def test_deduplicate_keeps_one_of_each_group(spark, odd):
    kept = simhash.deduplicate(odd)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 7] and kept.columns == odd.columns
    assert simhash.deduplicate(odd.limit(0)).count() == 0
    # one id with several texts: each is judged in its own group
    texts = [(1, "one two three four five six"), (1, "six five four three two one"), (2, "one two three four five six"), (3, "all other words in this text"), (3, "all other words in this text"), (None, None), (None, None)]
    strange = spark.createDataFrame([(*t, 1, 2, 3) for t in texts], "doc_id long, text string, _key int, root int, `_id.x` int")
    kept = simhash.deduplicate(strange)
    assert kept.columns == strange.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, [texts[0], texts[1], texts[3], texts[5]]))


# --- 8 embeddings


def _brute_links(rows):
    """{id: links} and {id: smallest id reachable} by all pairs in double precision."""
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and any(v)]
    unit = []
    for _, v in good:
        v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
        unit.append(v / np.linalg.norm(v))
    links, parent = {i: set() for i, _ in good}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, _) in enumerate(good):
        for m in range(k):
            if len(unit[k]) == len(unit[m]) and unit[k] @ unit[m] >= 0.95:
                j = good[m][0]
                links[i].add(j)
                links[j].add(i)
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: len(links.get(i, ())) for i, _ in rows}, {i: root(i) for i, _ in rows}


def _near(rng, vector, cosine):
    """A vector at the given cosine to another."""
    v = np.array(vector, float)
    other = rng.standard_normal(len(v))
    other -= v * (other @ v) / (v @ v)
    return (cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine * cosine) * other / np.linalg.norm(other)).tolist()


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_links_against_brute_force(spark, block):
    rng = np.random.default_rng(12)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    size, top = len(rows[0][1]), max(i for i, _ in rows) + 1
    for _ in range(400):  # near pairs on both sides of the threshold
        rows.append((top, _near(rng, rows[int(rng.integers(len(rows)))][1], float(rng.uniform(0.94, 0.97)))))
        top += 1
    middle = rng.standard_normal(size)  # a crowd of near copies
    rows += [(top + k, (middle + 0.2 * rng.standard_normal(size)).tolist()) for k in range(60)]
    top += 60
    odd_ones = [None, [], [0.0] * size, [float("nan")] * size, [1.0, None], [float("inf"), 1.0], rows[0][1], [1e200, 1e200], [1e200, 1.0000001e200], [1e-310, 1e-310], [3.0], [2.0]]
    rows += [(top + k, v) for k, v in enumerate(odd_ones)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(table, block=block).collect()}
    links, roots = _brute_links(rows)
    assert len(got) == len(rows) and sum(links.values()) > 1500
    assert all(got[i].n_links <= n for i, n in links.items())
    recall = sum(r.n_links for r in got.values()) / sum(links.values())
    assert recall >= 0.97, recall
    assert sum(got[i].component_id == c for i, c in roots.items()) >= 0.97 * len(rows)
    assert got[top + 7].n_links == 2 and got[top + 10].n_links == 1 and got[top + 6].n_links >= 1
    assert all((got[top + k].n_links, got[top + k].component_id, got[top + k].kept) == (0, top + k, True) for k in range(6))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings_on_odd_tables(spark):
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (None, [5.0, -1.0])], "vec_id long, embedding array<float>")
    rows = sorted(embeddings.near_duplicates(twice).collect(), key=str)
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in rows] == [(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, False), (None, 2, 1, False)]
    assert embeddings.near_duplicates(twice.limit(0)).count() == 0
    assert embeddings.near_duplicates(twice.where("vec_id = 0").unionByName(spark.createDataFrame([(4, None)], "vec_id long, embedding array<float>"))).count() == 1


# --- 10 decontamination


def _greedy(item, doc, size):
    """Greedy tiling by its definition: every pair of places, again for each tile."""
    item_free, doc_free, out = [True] * len(item), [d != 0 for d in doc], []
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item_free[a + n] and doc_free[b + n] and item[a + n] == doc[b + n]:
                    n += 1
                if n >= size and (best is None or n > best[2]):
                    best = a, b, n
        if best is None:
            return out
        out.append(best)
        a, b, n = best
        item_free[a : a + n], doc_free[b : b + n] = [False] * n, [False] * n


def test_tiling_against_its_definition():
    rng = np.random.default_rng(8)
    for _ in range(200):
        kinds = int(rng.integers(2, 6))
        item, doc, size = rng.integers(1, kinds, int(rng.integers(1, 25))), rng.integers(0, kinds, int(rng.integers(0, 40))), int(rng.integers(1, 6))
        assert decontaminate.tiles(item.astype(np.uint64), doc.astype(np.uint64), size) == _greedy(item.tolist(), doc.tolist(), size)


def test_repeated_words_cost_no_more():
    import time

    begin = time.perf_counter()
    assert decontaminate.tiles(np.full(2_000, 7, np.uint64), np.full(20_000, 7, np.uint64)) == [(0, 0, 2_000)]
    assert time.perf_counter() - begin < 1


def test_verdicts_against_brute_force(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    items = [(int(i) if i else None, " ".join(rng.choice(words, int(n)))) for i, n in zip([7, 3, 3, 0, 5, 9, 8], [30, 12, 12, 9, 2, 40, 1], strict=True)]
    texts = []
    for k in range(120):
        parts = [list(rng.choice(words, int(rng.integers(0, 30))))]
        for _ in range(int(rng.integers(0, 4))):
            source = items[int(rng.integers(len(items)))][1].split()
            a = int(rng.integers(len(source)))
            parts.append(source[a : a + int(rng.integers(1, 25))] + list(rng.choice(words, 3)))
        texts.append((k, " ".join(w for i in rng.permutation(len(parts)) for w in parts[i])))
    texts += [(200, texts[0][1]), (201, "W7 " * 5000 + items[0][1])]  # a copy, a long one
    number = lambda t: np.array([decontaminate.word_hash(w) for w in decontaminate.words_of(t)], np.uint64)
    rows = decontaminate.judge(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        best = (0.0, None)
        for i, t in items:
            item = number(t)
            if i is not None:
                doc = number(r.text)
                got = decontaminate.tiles(item, doc, min(5, len(item))) if r.doc_id == 201 else _greedy(item.tolist(), doc.tolist(), min(5, len(item)))
                best = max(best, (sum(n for *_, n in got) / len(item), -i if got else None), key=lambda x: (x[0], x[1] if x[1] is not None else -99))
        assert r.coverage == pytest.approx(best[0]) and r.item_id == (None if best[1] is None else -best[1]), r
        assert r.contaminated == (best[0] >= 0.5 - 1e-9)
        split = decontaminate.words_of(r.text)
        assert any(all(split[t.doc_word : t.doc_word + t.words] == decontaminate.words_of(x)[t.item_word : t.item_word + t.words] for t in r.tiles) for i, x in items if i == r.item_id or not r.tiles)


def test_reordered_passages_are_found(spark, odd):
    item = "the quick brown fox jumps over one lazy dog while seven old owls watch from their dark tree"
    words = item.split()
    texts = [(1, "so " * 50 + item), (2, " ".join(words[9:] + ["and"] + words[:9])), (3, " ".join(words[:6])), (4, None), (5, " ".join(sorted(words))), (6, "only two words here"), (7, "")]
    table = spark.createDataFrame([(*t, "clash", "kept") for t in texts], "doc_id long, text string, item_id string, `a.b` string")
    bench = spark.createDataFrame([(9, item), (10, None), (11, "two words"), (None, item)], "item_id long, text string")
    found = decontaminate.judge(table, bench)
    rows = {r.doc_id: r for r in found.collect()}
    assert sorted(found.columns) == sorted(["doc_id", "text", "a.b", "item_id", "coverage", "contaminated", "tiles"])
    assert {i for i, r in rows.items() if r.contaminated} == {1, 2, 6} and rows[1].coverage == 1 and rows[3].coverage == pytest.approx(6 / 18)
    assert rows[1].item_id == 9 and rows[4].item_id is None and rows[6].item_id == 11 and rows[4].tiles == []
    assert decontaminate.judge(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.judge(odd.limit(0), bench).count() == 0


# --- components


@pytest.mark.parametrize("one_task", [0, 100_000])
def test_components_against_brute_force(spark, one_task):
    rng = np.random.default_rng(14)
    edges = [(int(a), int(b)) for a, b in rng.integers(-40, 40, (45, 2))] + [(k, k + 1) for k in range(100, 130)] + [(500, 500), (7, 8), (8, 7), (7, 8)]
    rows = [*edges, (None, 3), (4, None), (None, None)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        first, second = sorted((root(x), root(y)))
        parent[second] = first
    table = spark.createDataFrame(rows, "a long, b long")
    found = {r.node: r.component for r in components.connected_components(table, one_task=one_task).collect()}
    assert found == {x: root(x) for e in edges for x in e if e[0] != e[1]}
    assert components.connected_components(table.limit(0), one_task=one_task).count() == 0


# --- the pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.toPandas(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count()
    assert 0 < last == docs.count()
