import html
import itertools
import math
import random
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from motifspark.llm import common, components, decontaminate, exact_topk, hilbert_shards, html_extract, language_id, mixing, quality, queries, simhash_dedup, token_store, toxicity
from motifspark.llm.page_grammar import PageGrammar

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORDS = "ka lo mi ren tas vu shi pol der an est qui or bla zen fu".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(60)]
    texts += [texts[0]] * 5 + [None, "", "   ", "one", "two words", texts[3] + "x", prose(rng, 5000)]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), None, 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(out + [out[0]], DOCS)  # and a repeated row


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert simhash_dedup.deduplicated(none).count() == 0
    assert mixing.drawn_words(none).count() == 0 and mixing.mixed(none).count() == 0
    assert hilbert_shards.sharded(none).count() == 0
    assert token_store.tokenised(none).count() == 0
    model = language_id.train(none)
    assert language_id.identified(docs, model).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identified(none, model).count() == quality.scored(none, None).count() == toxicity.scored(none, toxicity.ToxicModel()).count() == 0
    assert toxicity.filtered(none, toxicity.ToxicModel()).count() == 0 and toxicity.train(none.withColumn("toxic", F.lit(1))).weights.tolist() == toxicity.PRIOR.tolist()
    assert quality.train(none.withColumn("quality", F.lit(1))) is None
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(docs, bench).count() == 0 == decontaminate.overlaps(none, bench).count()
    assert decontaminate.clean(docs, bench).count() == docs.count() and decontaminate.clean(none, bench).count() == 0
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert exact_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True), 3).count() == 0


def brute_topk(rows, asked, k=10):
    """query_id, rank, vec_id, score by rows: every row but the query's own is a candidate."""
    good = [(i, [math.floor(1024 * c) for c in v]) for i, v, *_ in rows if v and i is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for r, (q, x) in enumerate(good):
        if asked(q):
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), i) for s, (i, y) in enumerate(good) if s != r and len(x) == len(y))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)).round(2)
    x[50:120] = x[50]  # ties
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    rows += [(400, None, 1), (401, [float("nan")] * 6, 1), (402, [1.0, None] + [0.0] * 4, 1), (403, [1.0, 2.0], 1), (404, [], 1), (None, rows[3][1], 1)]
    rows += [rows[7], rows[100], (100, rows[5][1], 1), (2**53 + 1, rows[9][1], 1)]  # repeated rows, an id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = exact_topk.top_k(df, F.col("vec_id") % 100 == 0, 10, shard_rows=64, block=2).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("shard_rows", [8192, 16])
def test_topk_sql_agrees_on_repeated_rows(spark, tmp_path, shard_rows):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(40, 4)).round(2))]
    rows += 9 * [rows[0]] + 2 * [rows[5]] + [(0, rows[8][1]), (5, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk.top_k(df, F.col("vec_id") % 100 == 0, 10, shard_rows=shard_rows, block=2).collect()
    df.toPandas().to_parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op1_exact_topk"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) == brute_topk(rows, lambda i: i % 100 == 0)


def test_topk_of_large_vectors(spark):
    rows = [(0, [3e8, 1.0]), (1, [3e8, 1.0]), (2, [3e8, 2.0]), (3, [9e15, 1.0]), (4, [-1e20, 5.0]), (5, [1e20, 1.0])]
    df = spark.createDataFrame([(i, [c / 1024 for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = exact_topk.top_k(df, F.col("vec_id") < 5, 3).collect()
    cut = [(i, [max(-(2.0**63), min(2.0**63, c)) / 1024 for c in v]) for i, v in rows]
    assert sorted(map(tuple, got)) == brute_topk(cut, lambda i: i < 5, 3) and max(r["score"] for r in got) == 2**63 - 1


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union_find(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_equals_brute_force(docs):
    got = simhash_dedup.near_duplicates(docs).collect()
    rows = docs.collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    ids = [r["doc_id"] for r in rows]
    root = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(i, least.get(r, i))
    assert sorted(tuple(r) for r in got) == sorted((i, f"{f:016x}", least[r]) for i, f, r in zip(ids, fps, root))
    assert sorted(r["doc_id"] for r in simhash_dedup.deduplicated(docs).collect()) == sorted(set(least.values()))


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 40) for _ in range(4))
    rows = [(1, a), (1, b), (2, a), (3, b), (3, b), (None, c), (None, c), (None, d), (4, d), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, simhash_dedup.deduplicated(docs).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (None, c), (4, d)], key=str)


@pytest.mark.parametrize("node_rows", [30, 200, 100_000])
def test_gray_index_finds_all_components(spark, node_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.array([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5), dtype=np.uint64)) for b in base for _ in range(8)], np.uint64)
    tight = np.arange(300, dtype=np.uint64) << np.uint64(20)  # one large near group: 9 free bits
    fps = np.unique(np.concatenate([base, near, tight]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r["node"]: r["root"] for r in components.components(simhash_dedup.links(df, 3, node_rows)).collect()}
    want = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3)])
    groups = {}
    for x, r in zip(fps.view(np.int64).tolist(), want):
        groups.setdefault(r, set()).add(found.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("n, m", [(1, 1), (40, 3), (700, 700), (500, 90)])
def test_trees_find_all_links(n, m):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 2**63, n + m, dtype=np.uint64)
    fps[n // 2 :] = fps[rng.integers(0, max(1, n // 2), n + m - n // 2)] ^ (np.uint64(1) << rng.integers(0, 64, n + m - n // 2, dtype=np.uint64))
    fps = np.unique(fps)
    rng.shuffle(fps)
    own, other = (x[np.argsort(simhash_dedup.gray_rank(x))] for x in (fps[:n], fps[n:]))
    pairs = lambda a, b: [(int(x), int(y)) for p, q in simhash_dedup.tree_links(a, b, 3) for x, y in zip(a.fps[p], b.fps[q])]
    one = simhash_dedup.GrayTree(own)
    got = pairs(one, one)
    assert sorted(map(sorted, got)) == sorted(sorted((int(a), int(b))) for a, b in itertools.combinations(own, 2) if (int(a) ^ int(b)).bit_count() <= 3)
    if len(other):
        got = pairs(one, simhash_dedup.GrayTree(other))
        assert sorted(got) == sorted((int(a), int(b)) for a in own for b in other if (int(a) ^ int(b)).bit_count() <= 3)


def test_mixing_meets_targets(docs):
    rows = mixing.drawn_words(docs).collect()
    again = mixing.drawn_words(docs.repartition(3)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    size = {}
    for r in docs.collect():
        n = len((r["text"] or "").split())
        size[r["source"]] = size.get(r["source"], 0) + n
    total, left, target = 1.5 * sum(size.values()), None, {}
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s)), (5, 2, 1)))
    open_ = dict(weights)
    while True:
        level = (total - sum(target.values())) / sum(open_.values())
        over = [s for s, w in open_.items() if level * w > 2 * size[s]]
        if not over:
            target |= {s: level * w for s, w in open_.items()}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            del open_[s]
    by = {(r["source_size"]): r["target"] for r in rows}
    assert by == pytest.approx({size[s]: t for s, t in target.items()})
    taken = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
    assert all(abs(taken[size[s]] - t) <= 0.5 for s, t in target.items())


def xx(values, seed=42):
    """Spark's xxhash64 of a row: each value hashed with the hash before as its seed."""
    for v, kind in values:
        if v is not None:
            data = v.encode() if kind == "s" else int(v).to_bytes(4 if kind == "i" else 8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def redrawn(source, blocks, k, epoch):
    """The permutation, in Python."""
    key = [(xx([(0, "i"), (source, "s")]), "l"), (epoch, "l")]
    for r in range(1, mixing.ROUNDS + 1):
        other = xx([(r, "i"), (blocks, "l"), *key]) % blocks - k
        other += blocks * (other < 0)
        if xx([(max(k, other), "l"), (r, "i"), *key]) & 1:
            k = other
    return k


def test_draws_equal_a_redraw(spark, docs):
    sizes = mixing._sizes(docs)
    plan = mixing.sources_plan(sizes, block=64).cache()
    counts, shards = {}, 5
    for p in plan.collect():
        for slot in range(p["slots"]):
            shard = xx([(1, "i"), (p["source"], "s"), (slot, "l")]) % shards
            counts[p["source"], shard] = counts.get((p["source"], shard), 0) + 1
    assert {(r["source"], r["shard"]): r["n"] for r in mixing.counts(plan, shards).collect()} == counts
    want = set()
    for p in plan.collect():
        slot = 0
        for shard in range(shards):
            for slot in range(slot, slot + counts.get((p["source"], shard), 0)):
                epoch = slot // p["blocks"]
                want.add((shard, p["source"], slot, redrawn(p["source"], p["blocks"], slot % p["blocks"], epoch), epoch, p["cut"] if slot == p["slots"] - 1 else 0))
            slot += bool(counts.get((p["source"], shard)))
    assert {tuple(r) for r in mixing.slots(plan, shards).collect()} == want
    # The words of all draws make up the targets, and no word is drawn twice in a pass.
    drawn = mixing.draws(sizes, plan, shards, block=64).collect()
    got = {}
    for r in drawn:
        got[r["source"]] = got.get(r["source"], 0) + r["n"]
    assert got == {p["source"]: round(p["target"]) for p in plan.collect() if p["target"]}
    seen = [(r["source"], r["doc_id"], r["row"], r["epoch"], r["first"] + i) for r in drawn for i in range(r["n"])]
    repeats = docs.count() - docs.distinct().count()
    assert repeats == 1 and len(seen) - len(set(seen)) <= 2 * len((docs.first()["text"] or "").split())
    plan.unpersist()


def test_mixed_documents_hold_the_words_taken(docs):
    one = docs.dropDuplicates(["doc_id"])
    taken = {r["doc_id"]: r["taken"] for r in mixing.drawn_words(one).collect()}
    words = {}
    for r in mixing.mixed(one).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"]) and r["score"] == 1.0
    assert words == {i: n for i, n in taken.items() if n}


def test_permutation_is_one(spark):
    for n in (1, 2, 37, 256):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9)).alias("x"))
        assert sorted(r["x"] for r in df.collect()) == list(range(n))
        back = spark.range(n).select(mixing.permuted(mixing.place_of(F.col("id"), F.lit(n).cast("long"), F.lit(9)), F.lit(n).cast("long"), F.lit(9)).alias("x"))
        assert [r["x"] for r in back.collect()] == list(range(n))


def test_hilbert_curve_visits_neighbours(spark):
    df = spark.createDataFrame([(a, b, c) for a in range(8) for b in range(8) for c in range(8)], "a int, b int, c int")
    rows = df.withColumn("h", hilbert_shards.curve([F.col(x) for x in "abc"], 3)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(512))
    assert all(sum(abs(x[k] - y[k]) for k in "abc") == 1 for x, y in zip(rows, rows[1:]))


def test_shards_follow_the_law(docs):
    rows = hilbert_shards.sharded(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    counts = [len(by.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and len(rows) == docs.count()
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    order = [r["cell"] for s in sorted(by) for r in sorted(by[s], key=lambda r: r["slot"])]
    assert order == sorted(order)
    crcs = [r["text_crc32"] for s in sorted(by) for r in sorted(by[s], key=lambda r: r["slot"])]
    assert len([k for k, _ in itertools.groupby(crcs)]) == len(set(crcs))  # equal texts lie together
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in rows)


def hilbert_index(point, bits=4):
    """The curve's index of a point, by a walk down from the whole cube."""
    n, entry, turn, index = len(point), 0, 0, 0
    rot = lambda x, k: (x << k % n | x >> (n - k % n)) & (1 << n) - 1
    for level in reversed(range(bits)):
        corner = sum((c >> level & 1) << j for j, c in enumerate(point))
        seen = rot(corner ^ entry, n - (turn + 1) % n)
        w = next(i for i in range(1 << n) if i ^ i >> 1 == seen)
        index = index << n | w
        low = 0 if w == 0 else 2 * ((w - 1) // 2)
        entry ^= rot(low ^ low >> 1, turn + 1)
        odd = 0 if w == 0 else w if w % 2 else w - 1
        turn = (turn + (len(bin(odd)) - len(bin(odd).rstrip("1"))) % n + 1) % n
    return index


def test_shards_equal_a_recomputation(docs):
    rows = docs.collect()
    text = [r["text"] or "" for r in rows]
    least = {}
    for r, t in zip(rows, text):
        least[t] = min(least.get(t, (r["doc_id"], r)), (r["doc_id"], r), key=lambda x: x[0])
    low, high = min(r["doc_id"] for r in rows), max(r["doc_id"] for r in rows)
    keys = []
    for r, t in zip(rows, text):
        first, size = least[t][1], len(t.encode()) + 8
        place = min(15, int((first["doc_id"] - low) / (high - low + 1) * 16))
        point = (min(15, max(0, int(math.log2(size)) - 3)), xx([(first["lang"], "s")]) % 16, xx([(first["source"], "s")]) % 16, place)
        keys.append((hilbert_index(point), xx([(t, "s")]), size, xx([(17, "i"), (r["doc_id"], "l"), (r["lang"], "s"), (r["source"], "s")]), r["doc_id"], zlib.crc32(t.encode())))
    keys.sort()
    n = len(keys)
    want = [(k[4], k[2], k[5], i * 24 // n, i - -(-(i * 24 // n) * n // 24), k[0]) for i, k in enumerate(keys)]
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"], r["cell"]) for r in hilbert_shards.sharded(docs).collect()]
    assert sorted(got) == sorted(want)


def test_tokens_round_trip(spark, docs):
    from tokenizers import Tokenizer

    odd = ["a  b", " x ", "don't I'll", "é è", "a\nb\n\nc \n d", "x\t y", "<|endoftext|> hi", "½ Ⅳ", "日本 語", "c'd.. e's", ".", "a b"]
    more = spark.createDataFrame([(1000 + i, t, None, None, None, 0.0) for i, t in enumerate(odd)], DOCS)
    tok = Tokenizer.from_file(token_store.vocabulary())
    rows = sorted(docs.union(more).collect(), key=lambda r: r["doc_id"])
    want, start = [], 0
    for r in rows:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_store.tokenised(docs.union(more)).collect()) == want


def test_tokens_follow_the_file(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_store.vocabulary())
    rows = [(7, "a"), (7, "b b"), (7, "c c c"), (7, "d d d d"), (7, "a"), (None, "x y"), (None, None), (2**53 + 1, "z"), (-3, "w w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = token_store.new_path(spark, "tokens")
    token_store.write_tokens(docs, path, token_store.vocabulary(), file_rows=3)
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows}
    got = sorted(token_store.token_digest(token_store.read_tokens(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, -3, 7, 7, 7, 7, 7, 2**53 + 1]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or 0, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in rows)
    some = token_store.documents_of(spark, path, [7, 2**53 + 1, 5])
    assert sorted(map(str, some.collect())) == sorted(map(str, [(spark.createDataFrame([(i, ids[t])], "doc_id long, ids array<int>").first()) for i, t in rows if i in (7, 2**53 + 1)]))
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()


def test_other_tokenizers_encode_whole_texts():
    store = token_store.PieceStore(token_store.vocabulary())
    settings = token_store.json.loads(store.tok.to_str())
    assert store.cuts and token_store.cuts_at_spaces(settings)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"type": "Unigram"}}, {"added_tokens": [{"content": "[PAD]"}]}):
        assert not token_store.cuts_at_spaces(settings | change)
    rng = random.Random(11)
    texts = ["one two  three", "", " a b", "x" * 50, " ", "a\nb", "\na b.\n"] + ["".join(rng.choice("ab Zé.,!?'-#½Ⅳ日\t\n 1279  ßñ<|\x85") for _ in range(rng.randrange(14))) for _ in range(3000)]
    want = [e.ids + [2] for e in store.tok.encode_batch(texts, add_special_tokens=False)]
    for most in (store.most, 40):  # a store that is emptied again and again gives the same
        store.most = most
        assert [x for k in range(0, len(texts), 100) for x in store.encode(token_store.pa.array(texts[k : k + 100]), 2).to_pylist()] == want
    store.cuts = False
    assert store.encode(token_store.pa.array(texts), 2).to_pylist() == want
    assert store.encode(token_store.pa.array([None, "a"]), 2).to_pylist()[0] == [2]


def test_overlaps_tolerate_substitutions(spark):
    rng = random.Random(5)
    items = [prose(rng, n).split() for n in (40, 25, 12, 8, 3)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None)], "item_id long, text string")
    swapped = [w if i % 9 else "zz" for i, w in enumerate(items[0])]
    texts = [" ".join(prose(rng, 20).split() + items[1] + prose(rng, 9).split()), "A " + " ".join(swapped).upper(), " ".join(items[3]), " ".join(items[4] * 9), prose(rng, 300), None, "", " ".join(items[0][:9])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit(5))
    for each in (1_000_000, 45):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(df.drop("item_id"), bench, words_each=each).collect()}
        assert got == {(0, 1), (1, 0), (2, 3)}
        assert sorted(r["doc_id"] for r in decontaminate.clean(df, bench, each).collect()) == [3, 4, 5, 6, 7]
    assert sorted(r["doc_id"] for r in decontaminate.clean(df, bench).collect()) == [3, 4, 5, 6, 7]


def brute_overlaps(items, texts):
    """The items that each text overlaps, by every diagonal."""
    out = set()
    for i, ref in enumerate(items):
        for d, own in enumerate(texts):
            if len(ref) < decontaminate.SHORT:
                if own == ref:
                    out.add((d, i))
                continue
            for o in range(1 - len(ref), len(own)):
                same = np.array([0 <= o + k < len(own) and own[o + k] == w for k, w in enumerate(ref)])
                n = same.sum() if len(ref) <= 16 else decontaminate.best_segment(same)[2]
                if n >= min(13, -(-len(ref) * 4 // 5)):
                    out.add((d, i))
    return out


def test_changed_words_are_found_at_any_place():
    rng = random.Random(6)
    items = [[f"i{n}w{k}" for k in range(n)] for n in (2, 4, *range(5, 22))]
    texts = []
    for ref in items:
        for changes in range(4):
            for _ in range(12):
                own = list(ref)
                for k in rng.sample(range(len(own)), min(changes, len(own))):
                    own[k] = "zz"
                texts.append(prose(rng, rng.choice([0, 4])).split() + own + prose(rng, rng.choice([0, 4])).split())
        texts += [ref[k:] for k in range(1, 4)] + [ref[:-k] for k in range(1, 4)]
        texts.append([w if k not in (5, 10) else "zz" for k, w in enumerate(ref)])
    index = decontaminate.SeedIndex(list(enumerate(items)))
    got = decontaminate.overlaps_of(index, [" ".join(t) for t in texts])
    assert {x[:2] for x in got} == brute_overlaps(items, texts) and len({x[:2] for x in got}) == len(got)
    assert all(0 <= s and s + n <= len(texts[d]) and (e >= 0.8 * n) for d, _, s, n, e in got)
    eight = [" ".join(items[5][:k] + ["zz"] + items[5][k + 1 :]) for k in range(8)]
    assert len(items[5]) == 8 and {x[:2] for x in decontaminate.overlaps_of(index, eight)} == {(k, 5) for k in range(8)}


def test_slices_are_bounded_and_hold_every_item(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i % 30, prose(rng, rng.choice([0, 3, 20, 60]))) for i in range(60)] + [(77, prose(rng, 900)), (78, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "LAP", 20)
    for each in (100, 10_000_000):
        parts = list(decontaminate.slices(bench, each))
        assert all(sum(len(w) for w in p.words) <= each for p in parts) and (len(parts) == 1) == (each > 100)
        assert sorted(i for p in parts for i in p.ids if i != 77) == sorted(i for i, t in items if t and i != 77)
        long = sorted((w for p in parts for i, w in zip(p.ids, p.words) if i == 77), key=len)
        assert sum(map(len, long)) - 20 * (len(long) - 1) == 900


def test_samples_are_bounded(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 100 == 0).cast("int").alias("y"), F.lit("own").alias("_n"))
    got = common.bounded(rows, "y", 250).collect()
    n = {0: 29_700, 1: 300}
    assert {r["doc_id"] for r in got} == {i for i in range(30_000) if xx([(7, "i"), (i, "l")]) % (1 << 40) < int((1 << 40) * 250 / n[i % 100 == 0])}
    assert all(180 < sum(r["y"] == y for r in got) < 320 for y in (0, 1)) and all(r["_n"] == "own" for r in got)
    assert common.bounded(rows.limit(0), "y", 5).count() == 0 and common.bounded(rows.filter("doc_id < 3"), "y", 5).count() == 3
    hot = spark.range(9000).select(F.lit(4).cast("long").alias("doc_id"), F.lit(1).alias("y"))  # all rows of one id, taken or not
    assert common.bounded(hot.union(rows.filter("doc_id < 100").select("doc_id", "y")), "y", 20).count() <= 80


def test_ties_of_languages_go_by_code_point():
    model = language_id.LanguageModel(["de", "en"], ["▁", "a"])
    z = model.word_values(["a", "aaa"])
    assert (z[:, 0] == z[:, 1]).all()


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁", "a", "b", "ab", "ba"]
    model = language_id.LanguageModel(["x"], pieces, np.array([[0.3], [0.1], [0.2], [0.1], [0.2], [0.1], [0]]))
    p = dict(zip(pieces, (0.3, 0.1, 0.2, 0.1, 0.2, 0.1)))

    def total(w):
        return 1.0 if not w else sum(p[w[:k]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in p)

    words = ["a", "ab", "aba", "abbaab", "ab" * 20, "a" * 15 + "b" * 7, "b"]
    from functools import lru_cache

    total = lru_cache(None)(total)
    want = [math.log(total("▁" + w)) for w in words]
    assert model.word_values(words)[:, 0] == pytest.approx(want)
    long = model.word_values(["ab" * 10_000, "ab" * 10_001])[:, 0]  # over blocks, where a plain product would underflow
    step = np.diff(model.word_values(["ab" * n for n in (200, 201)])[:, 0])
    assert np.isfinite(long).all() and np.diff(long) == pytest.approx(step)


def test_words_of_all_lengths_teach():
    model = language_id.LanguageModel(["x"], ["▁", "a", "b", "aaaa"]).fit([language_id.Counter({"a" * 40: 5, "b": 1})])
    p = dict(zip(("▁", "a", "b", "aaaa"), model.probs[:, 0]))
    assert p["aaaa"] > p["b"] and sum(p.values()) == pytest.approx(1)


def test_letters_are_letters():
    texts = ["½ 12 ²", "Ⅳ①", "a²b c_d 1e", "été ½x", "", None, "日本"]
    assert [bool(language_id.letters_of(t)) for t in texts] == [any(c.isalpha() for c in t or "") for t in texts]
    assert language_id.letters_of("a²b c_d 1e") == ["a", "b", "c", "d", "e"]


def test_language_id_on_small_sample(spark):
    rng = random.Random(2)
    a, b = "the of and to in that is".split(), "der und ist ein das nicht von".split()
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(20)), "en" if i % 2 else "de") for i in range(80)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(train)
    test = spark.createDataFrame([(1, "the of that", "x"), (2, "und nicht " + "q" * 5000, "x"), (3, None, "x"), (4, "12 ½ ² Ⅳ!", "x"), (5, "", "x")], "doc_id long, text string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identified(test, model).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "de", "und", "und", "und"] and all(0 <= s <= 1 for _, s in got.values())


def test_quality_learns_junk(spark):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        t = prose(rng, 40)
        y = i % 4 != 0
        rows.append((i, t if y else " ".join(w + "###" for w in t.split()), int(y)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df.filter("doc_id < 120"))
    test = df.union(spark.createDataFrame([(500, None, 1), (501, "", 1), (502, "x" * 1000, 1)], df.schema))
    got = {r["doc_id"]: r["score"] for r in quality.scored(test, model).collect()}
    assert len(got) == 163 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, _, y in rows if i >= 120]) >= 0.95


def test_toxic_grammar_kinds():
    model = toxicity.ToxicModel()

    def kinds(text):
        toks = toxicity.tokens_of(text)
        v = model.lexicon.values(toks) if toks else np.zeros((0, 2))
        return {k for k, x in zip(toxicity.KINDS, model.matches(v[:, 0], v[:, 1])) if x}

    assert kinds("what an idiot") == {"plain"}
    assert kinds("you are an idiot") == {"targeted"} == kinds("idiot, that is you")
    assert kinds("you are not an idiot") == {"negated"}
    assert kinds("the paper said idiot") == {"reported"}
    assert kinds("i will kill you") == {"threat"} and kinds("kill the process") == set()
    assert kinds("you. an idiot") == {"plain"} and kinds("") == set()


def test_target_negation_and_report_turn_predictions():
    model = toxicity.ToxicModel()

    def toxic(text):
        toks = toxicity.tokens_of(text)
        v = model.lexicon.values(toks) if toks else np.zeros((0, 2))
        return model.score(model.matches(v[:, 0], v[:, 1]))[0] >= 0.5

    for _ in range(2):
        assert toxic("you are an idiot") and not toxic("you are not an idiot") and not toxic("the paper said you are an idiot")
        assert toxic("i will kill you") and not toxic("kill the process") and not toxic("i will not kill you")
        assert toxic("An idiot. A moron.") and not toxic("you. he. not.")
        model.weights = toxicity.ToxicModel().fit(["you are an idiot", "idiot. moron.", "fine words", "good day"] * 20, np.array([1, 1, 0, 0] * 20)).weights
    assert not toxicity.ToxicModel().score(np.array([1.0, 0, 0, 0, 0]))[0] >= 0.5 <= toxicity.ToxicModel().score(np.array([0, 1.0, 0, 0, 0]))[0]


def test_ids_pass_unharmed(spark):
    """A null id beside one that a float cannot hold, repeated rows, and clashing names, through every operator that runs Python."""
    big = 2**53 + 1
    rng = random.Random(9)
    passage = prose(rng, 30)
    rows = [(None, passage), (big, passage), (big, passage), (big + 1, None), (-big, ""), (None, None), (5, "½")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("own")).withColumn("_text", F.lit(1)).withColumn("score", F.lit(2))
    ids = sorted(str(i) for i, _ in rows)
    of = lambda df, c="doc_id": sorted(str(r[c]) for r in df.collect())
    model = language_id.LanguageModel(["x"], ["▁", "a"])
    assert of(language_id.identified(docs, model)) == of(quality.scored(docs, quality.QualityModel())) == of(toxicity.scored(docs, toxicity.ToxicModel())) == ids
    near = simhash_dedup.near_duplicates(docs)
    assert of(near) == ids and {r["component_id"] for r in near.collect() if r["doc_id"] == big} == {big}
    assert of(simhash_dedup.deduplicated(docs)) == sorted(map(str, (big, -big, 5)))
    bench = spark.createDataFrame([(big, passage), (None, passage), (big, passage)], "item_id long, text string")
    found = decontaminate.overlaps(docs, bench, "fp")
    assert of(found) == sorted(str(i) for i in (None, big, big) for _ in range(3)) and of(found, "item_id") == sorted(str(i) for i in (None, big, big) for _ in range(3))
    assert of(decontaminate.clean(docs, bench)) == sorted(str(i) for i, t in rows if t != passage) and of(toxicity.filtered(docs, toxicity.ToxicModel())) == ids
    assert toxicity.scored(docs, toxicity.ToxicModel(), "fp", "_text").filter("fp = 'own' and _text = 1").count() == len(rows)
    pages = spark.createDataFrame([(i, "u", f"<p>{t}") for i, t in rows], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert of(html_extract.extracted(pages), "page_id") == ids
    store = token_store.tokenised(docs)
    assert of(store) == ids == of(hilbert_shards.sharded(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")))) == of(mixing.drawn_words(docs.withColumn("source", F.lit("y"))))


def test_languages_equal_brute_force(spark):
    pieces = ["▁", "a", "b", "ab", "▁b"]
    probs = np.array([[0.3, 0.2], [0.2, 0.1], [0.1, 0.4], [0.3, 0.1], [0.1, 0.2], [0, 0]])
    model = language_id.LanguageModel(["xx", "yy"], pieces, probs.copy())

    def total(w, j):
        return 1.0 if not w else sum(probs[pieces.index(w[:k]), j] * total(w[k:], j) for k in range(1, len(w) + 1) if w[:k] in pieces)

    texts = ["ab", "b b", "aab ba, bab!", "A B", "", None, "12"]
    rows = spark.createDataFrame([*enumerate(texts), (0, "ab")], "doc_id long, text string")
    for r in language_id.identified(rows, model).collect():
        words = [w.strip(",!") for w in (texts[r["doc_id"]] or "").lower().split()]
        words = [w for w in words if w.isalpha()]
        p = [math.prod(total("▁" + w, j) for w in words) for j in (0, 1)]
        best = int(p[1] > p[0])
        want = (["xx", "yy"][best], p[best] / sum(p)) if words else ("und", 0.0)
        assert r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1])


def test_quality_equals_brute_force(spark):
    model = quality.QualityModel()
    rng = np.random.default_rng(2)
    model.out, model.bias = rng.normal(size=model.out.shape) * 40, np.array([0.1, -0.2])
    texts = ["one two two three", "x" * 95, "", None, "a\tb\nb b", "été ½"]
    rows = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    for r in quality.scored(rows, model).collect():
        words = [w[k : k + quality.LONGEST] for w in (texts[r["doc_id"]] or "").split() for k in range(0, len(w), quality.LONGEST)]
        vectors = []
        for i, w in enumerate(words):
            buckets, n = quality.features([w])
            vectors.append(model.vectors[buckets[0]].sum(axis=0) / n[0])
            if i and words[i - 1] == w:
                vectors.append(model.vectors[quality.REPEAT])
        z = (np.mean(vectors, axis=0) if vectors else np.zeros(quality.DIM)) @ model.out + model.bias
        assert r["score"] == pytest.approx(np.exp(z[1]) / np.exp(z).sum())


def test_toxic_clauses_equal_brute_force(spark):
    """The composed machine against plain rules, read off each clause."""
    rng = random.Random(13)
    lexicon = {w: k for k, ws in toxicity.LEXICON.items() for w in ws.split()}
    model = toxicity.ToxicModel()
    some = ["you", "he", "not", "never", "said", "kill", "idiot", "moron", "word", "other", ".", ";", "one", "two"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randrange(25))) for _ in range(300)]
    got = {r["doc_id"]: r for r in toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for d, text in enumerate(texts):
        found = np.zeros(len(toxicity.KINDS))
        for clause in toxicity.re.split("[.;]", text):
            kinds = set()
            words = [lexicon.get(w) for w in clause.split()]
            reach = 0  # words that the last negation still reaches
            for i, w in enumerate(words):
                hit = w in (toxicity.INSULT, toxicity.THREAT)
                negated = hit and reach > 0
                reach = 3 if w == toxicity.NEGATION else 0 if negated else max(0, reach - 1)
                if hit and (w == toxicity.INSULT or toxicity.TARGET in words):
                    kinds.add("negated" if negated else "reported" if toxicity.REPORT in words[:i] else "threat" if w == toxicity.THREAT else "targeted" if toxicity.TARGET in words else "plain")
            for k in kinds:
                found[toxicity.KINDS.index(k)] += 1
        assert [got[d][k] for k in toxicity.KINDS] == found.tolist(), text
        assert got[d]["score"] == pytest.approx(1 / (1 + math.exp(-(toxicity.PRIOR[0] + found @ toxicity.PRIOR[1:]))))


def test_very_long_texts(spark):
    rng = random.Random(10)
    text = prose(rng, 150_000)
    passage = prose(rng, 30)
    docs = spark.createDataFrame([(1, text + " " + passage + ". you are an idiot."), (2, "x" * 300_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(3, passage)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.overlaps(docs, bench).collect()] == [1]
    assert {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.scored(docs, toxicity.ToxicModel()).collect()} == {1: True, 2: False}
    got = {r["doc_id"]: r["fingerprint"] for r in simhash_dedup.near_duplicates(docs).collect()}
    assert got == {r["doc_id"]: f"{brute_fingerprint(r['text']):016x}" for r in docs.collect()}
    assert quality.scored(docs, quality.QualityModel()).count() == 2 == language_id.identified(docs, language_id.LanguageModel(["x"], ["▁", "x"])).filter("lang_pred = 'x'").count()
    page = "<p>" + "</p><p>".join(text.split()[:3000]) + "</p>"
    assert html_extract.extracted(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).count() == 1


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        w = prose(rng, 40).split()
        if i % 5 == 0:
            for _ in range(4):
                w[rng.randrange(40)] = rng.choice(["grumpf", "xylo" + rng.choice(WORDS)])
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.filter("doc_id < 150"))
    test = df.union(spark.createDataFrame([(900, None, 0), (901, "", 0)], df.schema)).withColumn("plain", F.lit(1))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(test, model).collect()}
    assert got[900] < 0.5 and got[901] < 0.5
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 150]) >= 0.95
    kept = toxicity.filtered(test, model)
    assert kept.columns == test.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_html_extraction(spark):
    pages = [
        '<html><head><title>t</title><script>var a="<p>x</p>"</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>'
        "<article><h1>Big  news</h1><p>One &amp; two\n three.<p>Four <b>five</b>six.</p></article><footer>&copy; all rights reserved</footer></body></html>",
        None, "", "<nav><a href='/'>menu</a></nav>", "<nav><a href='/'>menu</a></nav><article><h1>Some title of it</h1><p>Words of a story that go on for a while.</p><p>More words of it, then cut off here &lt;b and <a hr",
    ]
    df = spark.createDataFrame([(i, "u", h, 1) for i, h in enumerate(pages)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_extract.extracted(df).collect()}
    assert got[0]["text"] == html.unescape("Big news One &amp; two three. Four fivesix.")
    assert [got[i]["text"] for i in (1, 2, 3)] == ["", "", ""]
    assert got[4]["text"].endswith("cut off here <b and") and all(r["n_chars"] == len(r["text"]) for r in got.values())


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>t</title><meta x><body><p>One.</p><p>Two.</p>", ["One.", "Two."]),
    ("<html><head><title>t</title><p>One.<p>Two.", ["One.", "Two."]),
    ("<head><title>t</title>One <b>two</b><p>Three", ["One two", "Three"]),
    ("<head><title>t<body><p>One", ["One"]),
    ("<head><noscript><img src=x></noscript><title>t</title></head><p>One", ["One"]),
    ("<p>One</p><datalist id=d><option value=a>A<option value=b>B</datalist><p>Two</p>", ["One", "Two"]),
    ("<select><option>A<option>B</select><p>One", ["One"]),
    ("<select><option>A<option>B</option><p>One", ["One"]),
    ("<p>One <svg viewBox='0 0'/> two</p><p>Three</p>", ["One two", "Three"]),
    ("<p>One <svg><g><svg></svg><text>x</text></g></svg>two <math/>three</p>", ["One two three"]),
    ("<p>One <a><svg><path d='m'></a> two</p><p>Three</p>", ["One two", "Three"]),
    ("<article><p>One</p><button>Share<p>Two</p><p>Three</p></article>", ["One", "Two", "Three"]),
    ("<article><div>One <button>Share</div><p>Two</p></article><button>x</button>Three", ["One", "Two", "Three"]),
    ("<div><iframe src=x>no</div><p>One</p><object>no<div>no</div>", ["One"]),
    ("<div><object>no<p>no</p></div><p>One</p>", ["One"]),
    ("<p>One</p><script>if (a) { <p>x", ["One"]), ("<p>One</p><textarea>x<p>y", ["One"]), ("<p>One</p><!-- x <p>y", ["One"]),
    ("<button-group>One</button-group><header>Two</header>", ["One", "Two"]),
    ("<p>One</p><noscript><p>x</div></noscript><template><b>y</b></template><p>Two", ["One", "Two"]),
])
def test_dropped_elements_end_where_html_ends_them(page, want):
    assert [b.text for b in html_extract.blocks_of(page)] == want


def test_deep_pages_keep_their_paths():
    shallow, deep = html_extract.blocks_of("<article><p>One"), html_extract.blocks_of("<article>" + "<div>" * 3000 + "<p>One</p>" + "</div>" * 3000 + "<p>Two")
    parts = [sorted(b.path.all()) for b in (*shallow, *deep)]
    assert parts[0] == parts[2] and len(parts[1]) == 3002 and set(parts[0]) < set(parts[1])


def test_labeller_on_unseen_pages():
    grammar = PageGrammar(77)
    pages = [b for b in (html_extract.blocks_of(grammar.page(), marks=True) for _ in range(80)) if b]
    got = html_extract.trained().label(pages)
    want = [np.array([x.role == "\2" for x in b]) for b in pages]
    assert np.mean(np.concatenate(got) == np.concatenate(want)) >= 0.97


def test_all_words_of_a_block_count():
    (block,) = html_extract.blocks_of("<p>" + " ".join(f"w{k}" for k in range(50)))
    _, words, _ = html_extract.inputs([block])
    assert words == [[html_extract._word(f"w{k}") for k in range(50)]]


def test_labels_of_long_pages_do_not_depend_on_runs(monkeypatch):
    grammar, model = PageGrammar(78), html_extract.trained()
    pages = [html_extract.blocks_of("".join(grammar.page() for _ in range(k))) for k in (1, 3, 8)]
    whole = model.label(pages)
    z = [model.logits([html_extract.inputs(p)])[0][:, 0] for p in pages]
    for run in (7, 50):
        monkeypatch.setattr(html_extract, "RUN", run)
        assert all((a == b).all() for a, b in zip(model.label(pages), whole))
        for p, want in zip(pages, z):
            assert np.allclose(model.long_logits(p), want, atol=1e-4)


def test_columns_with_clashing_names(spark, docs, tmp_path):
    names = ["_key", "_row", "_id", "epoch", "runs", "whole", "_text", "_h", "_doc", "_k", "_crc", "shard", "slot", "size", "row", "fp", "item_id", "component_id", "target"]
    more = docs.dropDuplicates(["doc_id"]).select("*", *(F.lit(f"own {n}").alias(n) for n in names), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    bench = spark.createDataFrame([(1, "nothing that any of these documents would say to anyone at all in all its words")], "item_id long, text string")

    def own(df):
        assert set(more.columns) <= set(df.columns)
        assert df.filter(" OR ".join(f"{n} IS NULL OR {n} <> 'own {n}'" for n in names)).count() == 0
        return df.count()

    n = more.count()
    assert own(mixing.mixed(more)) > 0 and own(simhash_dedup.deduplicated(more)) > 0
    assert own(decontaminate.clean(more, bench)) == n == own(toxicity.filtered(more, toxicity.ToxicModel()))
    hilbert_shards.write_shards(more, f"{tmp_path}/shards")
    got = spark.read.parquet(f"{tmp_path}/shards")
    assert own(got) == n and got.select("shard_").distinct().count() == 24
    for q in (simhash_dedup.near_duplicates, mixing.drawn_words, hilbert_shards.sharded, token_store.tokenised):
        assert q(more).count() == n


def test_toxic_fit_counts_contexts_by_word_and_stays_small():
    rng = random.Random(6)
    toks = [np.array([rng.randrange(5) for _ in range(rng.randrange(9))], np.int32) for _ in range(40)]
    wanted = np.array([True, False, True, True, False])
    brute = {(w, t[i - 1] if i else -1, t[i + 1] if i + 1 < len(t) else -1) for t in (x.tolist() for x in toks) for i, w in enumerate(t)}
    assert toxicity.contexts(toks, wanted).tolist() == [sum(w == k for w, _, _ in brute) if wanted[k] else 0 for k in range(5)]
    assert toxicity.contexts([], wanted).tolist() == [0] * 5
    word = lambda start: start + "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word("zork") if i % 2 else word("fine") for _ in range(300)) for i in range(200)]
    tracemalloc.start()
    model = toxicity.ToxicModel().fit(texts, np.arange(200) % 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.lexicon.read("zorkzzz")[0] == toxicity.INSULT and model.lexicon.read("finezzz")[0] == toxicity.OTHER
    assert peak < 15e6, peak  # sets of contexts for every beginning took 24 MB
