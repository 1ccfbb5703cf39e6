"""Each corpus operator against a plain version of itself, with nulls, empty and long texts, ties and clashing columns."""

import collections
import hashlib
import math
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import exact_dedup, language, mixing, near_dedup, packing, quality, search, sharding, substring_dedup, toxicity
from tensorloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, size long, bucket long, component string, row long, n long"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def rows(n=60, seed=3):
    """Texts with copies, near copies, ties, nulls, empty and very long ones."""
    r = np.random.RandomState(seed)
    out = []
    for i in range(n):
        text = " ".join(r.choice(WORDS, r.randint(1, 60)))
        if i % 7 == 3:
            text = out[i - 3][1]
        if i % 11 == 5 and out[i - 2][1]:
            text = out[i - 2][1] + " tail"
        out.append((i, text, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None))
    return [*out, (n, None, "en", "s1"), (n + 1, "", "fr", None), (n + 2, " \t\n", None, "s2"), (n + 3, "wort " * 30_000, "de", "s0"), (n + 4, "ÄÖ é <|endoftext|> ABC abc", "de", "s0")]


def table(spark, data):
    """The data with columns whose names the operators use inside."""
    return spark.createDataFrame([(*x, 1, "k", 2, 3, 4, "c", 5, 6) for x in data], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, []).cache()


def words(text):
    return (text or "").encode().lower().split()


def test_exact_dedup(docs, none):
    by = collections.defaultdict(list)
    for i, text, *_ in rows():
        by[text or ""].append(i)
    for bits in (64, 3):
        got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs, hash_bits=bits, capacity=2).collect()}
        assert len(got) == len(rows())
        for text, ids in by.items():
            for i in ids:
                assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
                assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.kept_documents(docs)
    assert kept.count() == len(by) and kept.columns == docs.columns


def test_exact_dedup_null_and_repeated_ids(spark):
    got = exact_dedup.exact_groups(table(spark, [(None, "a", None, None), (None, "a", None, None), (1, "b", None, None), (1, "b", None, None)])).collect()
    assert len(got) == 4 and all(r["kept"] and r["group_size"] == 2 for r in got)


def test_exact_dedup_of_hot_groups(spark):
    """Groups that are looked up where the rows are, beside small ones and single rows."""
    data = [(i, "hot" if i % 2 else None if i % 4 else f"t{i % 12}" if i % 8 else f"own{i}", None, None) for i in range(400)]
    by = collections.defaultdict(list)
    for i, text, *_ in data:
        by[text or ""].append(i)
    assert len(by["hot"]) > 400 // (exact_dedup.HOT_SHARE * 4) and len(by["own8"]) == 1
    for bits in (64, 2):
        got = exact_dedup.exact_groups(table(spark, data).repartition(3), hash_bits=bits).collect()
        want = {(i, max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest()) for text, ids in by.items() for i in ids}
        assert len(got) == 400 and {tuple(r) for r in got} == want


def brute_components(data, width, percent):
    sets = {}
    for i, text, *_ in data:
        w = words(text)
        sets[i] = set() if not w else {tuple(w)} if len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_rows():
    """A base with many variants: some similar to the base alone, some to nothing."""
    r = np.random.RandomState(5)
    base = [f"w{k}" for k in range(120)]
    out = [(500, " ".join(base), "en", "s")]
    for i in range(150):
        w = list(base)
        for k in r.choice(120, r.randint(1, 8), replace=False):
            w[k] = f"x{r.randint(10_000)}"
        out.append((i, " ".join(w), "en", "s"))
    return out + [(1000 + i, "same short text", "en", "s") for i in range(3)] + [(2000, None, None, None), (2001, "", None, None), (2002, "One", None, None), (2003, "one", None, None)]


@pytest.mark.parametrize("at_once", [1000, 3])
def test_near_duplicates(spark, monkeypatch, at_once):
    monkeypatch.setattr(near_dedup, "ALL_AT_ONCE", at_once)
    monkeypatch.setattr(near_dedup, "CHUNK", 20)
    data = near_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table(spark, data), 4, 80).collect()}
    assert got == brute_components(data, 4, 80)


def test_near_duplicates_edges(docs, none, spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components(rows(), 5, 80)
    assert near_dedup.near_duplicates(none).count() == 0
    odd = near_dedup.near_duplicates(table(spark, [(None, "a b c", None, None), (1, "a b c", None, None), (1, "a b c", None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in odd) == [(0, 0, True), (1, 1, True), (1, 1, True)]


def test_near_duplicates_at_lower_thresholds(spark):
    """Bands and slack follow the threshold: pairs on it are found, at 50 percent too."""
    assert near_dedup.band_shape(80) == (32, 5) and near_dedup.slack(0.8) == near_dedup.SLACK
    for percent in (1, 20, 50, 65, 80, 99):
        bands, long = near_dedup.band_shape(percent)
        assert (1 - (percent / 100) ** long) ** bands <= near_dedup.MISSES
    for percent in (0, -1, 101):
        with pytest.raises(ValueError):
            near_dedup.band_shape(percent)
    data = []
    for k in range(60):  # for even k a pair has 20 of 40 words in common, for odd k 30 of 70
        own = [f"p{k}w{j}" for j in range(40)]
        data += [(2 * k, " ".join(own), "en", "s"), (2 * k + 1, " ".join(own[:30] + [f"q{k}w{j}" for j in range(30)]), "en", "s") if k % 2 else (2 * k + 1, " ".join(own[:20]), "en", "s")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table(spark, data), 1, 50).collect()}
    assert got == brute_components(data, 1, 50) and sum(i != c for i, (_, c) in got.items()) == 30


def test_signatures_estimate_similarity():
    r = np.random.RandomState(2)
    x = r.randint(0, 2**62, 2000).astype(np.uint64)
    a, b = np.unique(x[:1800]), np.unique(np.concatenate([x[200:1800], x[1800:]]))
    sign = near_dedup.packed(near_dedup.minima([a, b], near_dedup._OF_SIGNATURES)).view(np.uint64)
    got = 1 - np.bitwise_count(sign[0] ^ sign[1]).sum() * 2.0 / near_dedup.MINIMA
    want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(got - want) < near_dedup.SLACK


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[229] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    data = rows()
    assert sorted(r["doc_id"] for r in got) == [x[0] for x in data]
    size = {i: len(words(t)) for i, t, *_ in data}
    by = collections.defaultdict(list)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    total = sum(size.values())
    for own in by.values():
        target = own[0]["target"]
        assert sum(r["taken"] for r in own) == math.floor(target + 1e-9) and target <= 2 * own[0]["source_size"] + 1e-9
    assert sum(own[0]["target"] for own in by.values()) == pytest.approx(min(1.5 * total, 2 * total))
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    assert mixing.mix(none).count() == 0
    copies = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert all(copies[r["doc_id"]] == (-(-r["taken"] // r["size"])) for r in got if r["size"])
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_packing(docs, none):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, 64).collect()
    by, fill = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text, *_ in rows():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 64))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 64 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]])
    for x in fill.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 64
    assert len(fill) <= 1.05 * sum(r["length"] for r in got) / 64 + 1
    assert packing.pack(none).count() == 0


def test_packing_finds_added_tokens(spark):
    """Ids are those of the tokenizer as it is loaded, which knows its added token inside a text."""
    from tokenizers import Tokenizer

    import public_tokenizers

    t, end = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), "<|endoftext|>"
    r = np.random.RandomState(7)
    bits = [end, end, "<|endoftext", "|>", " ", "  ", "\n", "\t ", "é", "it's", " 12", "word", " word", "日本", "\u00a0"]
    texts = [f"hello {end} world", end, end * 3, f" {end} ", f"a  {end}  b", *("".join(r.choice(bits, r.randint(1, 30))) for _ in range(300))]
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 10**6, "byte_bpe_50k.json", "doc_id", "text").collect()
    assert t.encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    assert len(got) == len(texts)
    for x in got:
        ids = np.array([*t.encode(texts[x["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert (x["piece"], x["start"], x["length"], x["ids_crc32"]) == (0, 0, len(ids), zlib.crc32(ids))


def best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k in range(len(bins)) if bins[k] >= n]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= n
        else:
            bins.append(size - n)
    return len(bins)


def test_plan_is_best_fit():
    r = np.random.RandomState(4)
    for _ in range(20):
        lengths = r.randint(1, 65, 300).tolist()
        plan = packing.plan_sequences(collections.Counter(lengths), 64)
        assert max(s + b for _, _, b, _, s, _ in plan) == best_fit(lengths, 64)


def test_sharding(docs, none):
    for block, fan in ((20_000, 200), (5, 2)):
        got = sharding.shard(docs, 6, block=block, fan_in=fan).collect()
        text = {i: t for i, t, *_ in rows()}
        place, load, slots = collections.defaultdict(set), collections.Counter(), collections.defaultdict(list)
        for r in got:
            body = (text[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 8, zlib.crc32(body), "bytes", None)
            place[text[r["doc_id"]]].add(r["shard"])
            load[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert len(got) == len(text) and all(len(p) == 1 for p in place.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        rest = sorted(load.values())[:-1]  # one text outweighs all others
        assert max(rest) - min(rest) <= 600
    assert sharding.shard(none).count() == 0


def test_differencing_is_tight():
    r = np.random.RandomState(0)
    sizes = r.randint(1, 10_000, 2000)
    slots = [x[0] for x in sharding.difference([[int(s), *[0] * 23] for s in sizes], 24)]
    load = np.bincount(slots, sizes, 24)
    assert load.max() - load.min() <= 5


def test_repeats(spark, none):
    def plain(data, least):
        seen = collections.Counter()
        for _, t in data:
            b = (t or "").encode()
            seen.update(b[i : i + least] for i in range(len(b) - least + 1))
        out = []
        for d, t in data:
            b = (t or "").encode()
            gone = bytearray(len(b))
            for i in range(len(b) - least + 1):
                if seen[b[i : i + least]] > 1:
                    gone[i : i + least] = b"\1" * least
            kept = bytes(x for x, g in zip(b, gone) if not g)
            runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
            out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
        return out

    r = np.random.RandomState(6)
    data = [(i, "".join(r.choice(list("ab é"), r.randint(0, 60)))) for i in range(80)] + [(200, None), (201, ""), (202, "ab" * 50), (203, "a" * 100)]
    passage = "".join(r.choice(list("abcdefgh é"), 90))
    data += [(300 + i, "".join(r.choice(list("abcdefgh"), 40)) + passage + "".join(r.choice(list("abcdefgh"), 40))) for i in range(12)]
    data += [(None, "null id " + passage), (None, passage + " null id"), (7, "same row " * 9), (7, "same row " * 9), (8, "same id " * 7), (400, "\0" * 70), (401, "x" + "\0" * 60), (402, r.bytes(300).decode("latin-1"))]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in data], "doc_id long, text string, anchor long, count long").repartition(5)
    known = lambda found: sorted(found, key=str)
    for least, together in ((8, 1 << 19), (8, 30), (8, 100), (13, 0), (50, 1 << 19), (50, 300), (50, 1000), (71, 0)):
        assert known(map(tuple, substring_dedup.remove_repeats(df, least, together=together).collect())) == known(plain(data, least)), (least, together)
    assert substring_dedup.remove_repeats(none).count() == 0
    kept = {x["doc_id"]: x["kept_text"] for x in substring_dedup.remove_repeats(df, 50, with_text=True).collect()}
    assert passage not in kept[300] and kept[200] == ""


def test_merged_transforms_order_suffixes():
    r = np.random.RandomState(1)
    seqs = [r.randint(0, 3, r.randint(0, 12)) for _ in range(30)]
    cuts, n = [0, 7, 8, 20, 30], len(seqs)
    arrays, transforms, base = [], [], 0
    flat = [(d, i) for d, s in enumerate(seqs) for i in range(len(s) + 1)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = np.concatenate([np.append(s + (b - a), k) for k, s in enumerate(seqs[a:b])])
        order, bwt = substring_dedup.transform(own)
        arrays.append(order + base)
        transforms.append(np.where(bwt < b - a, bwt + a, bwt - (b - a) + n))
        base += len(own)
    full = [tuple(x + n for x in seqs[d][i:]) + (d,) for d, i in flat]
    for depth in (1, 3, 5, 14):
        order, common = substring_dedup.interleave(transforms, depth)
        merged = [full[k][:depth] for k in np.concatenate(arrays)[order]]
        assert merged == sorted(merged)
        for k in range(1, len(merged)):
            x, y = merged[k - 1], merged[k]
            assert common[k] == next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))


def test_transforms_decide(spark, monkeypatch):
    """Without what neighbours have in common, nothing repeats."""
    r = np.random.RandomState(2)
    bodies = [bytes(r.randint(97, 100, 60, dtype=np.uint8)) for _ in range(3)]
    bodies = [b"x" * 20 + bodies[0], b"y" * 20 + bodies[0], bodies[1] + b"z" * 20]
    size = substring_dedup.Lengths.of(40)
    shards = [{"offset": [20], "count": [41], "copies": [1]} | substring_dedup.shard_transform([b], np.array([20]), np.array([41]), size) for b in bodies]
    assert [x.tolist() for x in substring_dedup.repeated_windows(shards, size)] == [[0, 1], [20, 20], [41, 41]]
    real = substring_dedup.interleave
    monkeypatch.setattr(substring_dedup, "interleave", lambda t, depth: (real(t, depth)[0], real(t, depth)[1] * 0))
    assert not len(substring_dedup.repeated_windows(shards, size)[0])


SETTINGS = {"plain": {}, "small": {"SHARD": 7, "BLOCK": 2, "PAGE": 3}, "pruned": {"SHARD": 9, "BLOCK": 2, "COMMON": 1, "DENSE": 1, "QUERY_BYTES": 900, "GROUP": 4}, "rows": {"SHARD": 20, "BLOCK": 4, "COMMON": 2, "DENSE": 3, "GROUP": 1, "LEAD": 1, "STEP": 2, "GAP": 0}}


@pytest.mark.parametrize("setting", SETTINGS)
def test_search(docs, none, monkeypatch, setting):
    data = rows()
    for name, value in SETTINGS[setting].items():
        monkeypatch.setattr(search, name, value)
    got = collections.defaultdict(list)
    for r in search.search(docs, docs.where("doc_id % 5 = 0"), 4).collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    tok = {i: collections.Counter(words(t)) for i, t, *_ in data}
    mean = sum(sum(c.values()) for c in tok.values()) / len(tok)
    df = collections.Counter(w for c in tok.values() for w in c)
    for q in (i for i in tok if i % 5 == 0):
        score = {d: sum(math.log(1 + (len(tok) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in tok[q] if w in c) for d, c in tok.items()}
        want = sorted((-round(s, 9), d) for d, s in score.items() if s > 0)[:4]
        assert [(pytest.approx(-s), d) for _, d, s in sorted(got[q])] == want
    assert search.search(docs, none).count() == 0 and search.search(none, docs).count() == 0


def test_search_repeated_and_null_ids(spark):
    df = table(spark, [(1, "alpha beta", None, None), (1, "gamma alpha", None, None), (2, "beta beta", None, None), (None, "alpha", None, None), (3, None, None, None)])
    got = [tuple(r) for r in search.search(df, df, 5).orderBy("query_id", "rank").collect()]
    assert [(q, d) for q, _, d, _ in got] == [(1, 1), (1, 1), (1, 2), (2, 2), (2, 1)] and [r[1] for r in got] == [1, 2, 3, 1, 2]
    assert sorted(map(tuple, search.search(df.repartition(5), df.orderBy(F.desc("text")), 5).collect())) == sorted(got)


def search_shard(texts, mean=40.0):
    """A shard of texts of term numbers, the weights of its terms, and their names."""
    found = [np.unique(t, return_counts=True) for t in texts]
    term, doc, tf = np.concatenate([f[0] for f in found]), np.repeat(np.arange(len(texts)), [len(f[0]) for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(term, kind="stable")
    names, df = np.unique(term, return_counts=True)
    row = {"docs": np.arange(len(texts)).astype("<i8").tobytes(), "lengths": np.array([len(t) for t in texts], "<i4").tobytes(), "terms": names.astype(np.int64), "df": df, "postings": doc[order].astype("<u2").tobytes(), "tf": tf[order].astype("<i4").tobytes()}
    shard, weights = search.Shard(row, mean), search.idf(len(texts), df)
    shard.places(names.astype(np.uint64), weights)
    return shard, weights, names


@pytest.mark.parametrize("size,dense,common,block", [(300, 10, 64, 32), (300, 10_000, 64, 32), (70, 2, 64, 32), (300, 10, 1, 4), (300, 10_000, 1, 1)])
def test_search_shard_prunes_exactly(monkeypatch, size, dense, common, block):
    """Random shards, with thresholds of earlier ones: the same as scoring all documents."""
    r = np.random.RandomState(4)
    for name, value in (("DENSE", dense), ("COMMON", common), ("BLOCK", block), ("STEP", 8)):
        monkeypatch.setattr(search, name, value)
    shard, weights, names = search_shard([np.minimum(r.zipf(1.3, r.randint(1, 80)), 400) for _ in range(size)])
    queries = [np.unique(r.randint(0, len(names), 30)) for _ in range(40)]
    for threshold in (0.0, 0.8):
        want, bests = [], []
        for q in queries:
            shard.asked[q] = weights[q]
            every = sorted(zip((-shard.exact(np.arange(size))).tolist(), range(size), strict=True))
            shard.asked[q] = 0
            bests.append([(threshold * every[0][0], -1 - i) for i in range(5)] if threshold else [])
            want.append(sorted([*bests[-1], *(x for x in every if x[0] < 0)])[:5])
        assert shard.search(queries, 5, bests) == want


def test_search_shard_is_decoded_piecewise(monkeypatch):
    """A shard takes little memory besides its own arrays, and pieces change nothing."""
    r = np.random.RandomState(6)
    texts = [np.unique(r.zipf(1.2, 400) % 20_000) for _ in range(3000)]
    whole, *_ = search_shard(texts)
    monkeypatch.setattr(search, "DECODED", 1 << 12)
    real, peaks = search.Shard.__init__, []

    def traced(self, *args):
        tracemalloc.start()
        real(self, *args)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()

    monkeypatch.setattr(search.Shard, "__init__", traced)
    pieces, *_ = search_shard(texts)
    for name, value in vars(whole).items():
        assert np.array_equal(value, getattr(pieces, name)), name
    assert peaks[0] < 1.3 * sum(v.nbytes for v in vars(pieces).values() if isinstance(v, np.ndarray))


def test_search_counts_of_any_width(spark):
    """Frequencies in a text of one, two and four bytes."""
    counts = {1: 3, 2: 300, 3: 70_000}
    for some in ([1], [1, 2], [1, 2, 3]):
        df = table(spark, [(i, "alpha " * counts[i] + "beta", None, None) for i in some])
        mean = sum(counts[i] + 1 for i in some) / len(some)
        score = lambda i, n, mean=mean: n * 2.2 / (n + 1.2 * (0.25 + 0.75 * (counts[i] + 1) / mean))
        got = {r["doc_id"]: r["score"] for r in search.search(df, df.where("doc_id = 1"), 3).collect()}
        assert got == {i: pytest.approx(math.log(1 + 0.5 / (len(some) + 0.5)) * (score(i, counts[i]) + score(i, 1))) for i in some}


def test_search_skips_blocks_by_default():
    """Two languages with some words in common: with the settings as they are, the blocks of the other one are never read."""
    r = np.random.RandomState(5)
    shared = np.arange(1000, 1040)
    texts = [np.concatenate([r.randint(0, 300, 60) + (300 if d >= 4000 else 0), r.choice(shared, 3)]) for d in range(8000)]
    shard, weights, names = search_shard(texts, 63.0)
    queries = [np.searchsorted(names, np.unique(texts[d])) for d in range(0, 8000, 200)]
    found = shard.search(queries, 10, [[]] * len(queries))
    assert all(f[0][1] == d for f, d in zip(found, range(0, 8000, 200), strict=True))
    assert shard.whole - shard.read > 10_000


def labelled(spark):
    r = np.random.RandomState(8)
    english, french = ["the", "and", "of", "thing", "shore", "with"], ["le", "de", "été", "que", "leçon", "pour"]
    data, labels = [], []
    for i in range(300):
        fr, bad, junk = i % 3 == 0, i % 4 == 1, i % 10 == 7
        w = list(r.choice(french if fr else english, 40))
        if bad:
            w[3], w[20] = "worthl3ss", "SCUM!!"
        text = "spam " * 60 if junk else " ".join(w)
        data.append((i, text, None if i == 50 else "fr" if fr else "en", f"s{i % 4}"))
        labels.append((i, 0 if junk else 1, 1 if bad and not junk else 0))
    return table(spark, [*data, *[(x[0] + 1000, *x[1:]) for x in rows()]]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_language(spark, none):
    docs, _ = labelled(spark)
    got = {r["doc_id"]: r for r in language.identify(docs.where("doc_id < 300")).collect()}
    assert all(got[i]["lang_pred"] == ("fr" if i % 3 == 0 else "en") for i in range(300) if i % 10 != 7)
    model = language.train(docs.where("doc_id < 300"), "doc_id", "text", "lang")
    mixed = spark.createDataFrame([(1, "the thing with the shore and of the thing le leçon pour que été de le que"), (2, None), (3, ""), (4, "12 !!"), (5, "the " * 40_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.label(mixed, model, switch=3.0).collect()}
    assert [(s["start"], s["end"], s["lang"]) for s in got[1]["spans"]] == [(0, 9, "en"), (9, 17, "fr")]
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (2, 3, 4))
    assert (got[5]["lang_pred"], got[5]["score"]) == ("en", 1.0)
    assert language.identify(none).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_scores_by_hand(spark):
    """Scores of seen and unseen words against the formula, with more languages than words have entries."""
    texts = {"aa": "one two two", "bb": "two three", "cc": "vier"}
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    model = language.train(docs, "doc_id", "text", "lang")
    words_of = {lang: collections.Counter(t.split()) for lang, t in texts.items()}
    grams_of = {lang: sum((collections.Counter({g: n for g in language.grams(w)}) for w, n in own.items()), collections.Counter()) for lang, own in words_of.items()}

    def log_rate(of, item, lang, prior):
        kinds = len(set().union(*of.values()))
        return math.log((of[lang][item] + prior) / (sum(of[lang].values()) + prior * (kinds + 1)))

    langs = sorted(texts)
    for word in ("two", "one", "vier", "twin"):
        if any(own[word] for own in words_of.values()):
            want = np.array([log_rate(words_of, word, x, 0.05) for x in langs])
        else:
            want = np.array([sum(log_rate(grams_of, g, x, 0.5) for g in language.grams(word)) for x in langs])
        assert np.allclose(model.scores([word])[0], np.maximum(want - want.max(), -language.FLOOR))
    assert len(model.words.items) == 4 and len(model.words.langs) == 5  # no word is left out, and no cell is held for none


def test_viterbi_is_exact():
    r = np.random.RandomState(3)
    scores = -r.random_sample((20, 3)) * 4
    lengths = np.array([5, 0, 1, 7])
    starts = np.array([0, 5, 5, 6])
    ids = r.randint(0, 20, 13)
    got = language.viterbi(scores, ids, starts, lengths, 2.0)
    value = lambda seq, lab: sum(scores[i, x] for i, x in zip(seq, lab)) - 2.0 * sum(x != y for x, y in zip(lab, lab[1:]))
    for s, n in zip(starts, lengths):
        seq = ids[s : s + n]
        best = max((value(seq, lab) for lab in np.ndindex(*[3] * n)), default=0)
        assert value(seq, got[s : s + n].tolist()) == pytest.approx(best)


def test_toxicity(spark, none):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == (i % 4 == 1) for i in range(300) if i % 10 != 7)
    assert toxicity.toxicity(none, labels).count() == 0
    assert {round(r["score"], 6) for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} != {0.5}
    assert toxicity.folded("ЅСUМ  1d10t$$$, ok") == " scum idiot ok "


def test_exception_phrases():
    lexicon = toxicity.Lexicon({" clown": 2.0}, frozenset({"class clown"}))
    count = lambda t: len(toxicity.matches(lexicon.automaton(), lexicon, toxicity.folded(t)))
    assert (count("a clown"), count("the class clown left"), count("class clown and clown")) == (1, 0, 1)


def test_quality(spark, none):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(got[i]["kept"] == (i % 10 != 7) for i in range(300))
    host = {r["host_posterior"] for r in got.values()}
    assert max(host) - min(host) < 0.5
    assert quality.quality(none, labels).count() == 0
    assert {r["doc_score"] for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_posteriors_by_hand(spark):
    """Shrunken means with the row left out, worked out one by one; a path of one row has its host's."""
    docs, labels = labelled(spark)
    site = F.when(F.col("doc_id") == 3, "alone").otherwise(F.concat(F.lit("h"), F.col("doc_id") % 3))
    docs = docs.withColumn("source", site).withColumn("lang", F.when(F.col("doc_id") % 50 == 1, F.lit(None)).otherwise((F.col("doc_id") % 4).cast("string")))
    sites = {r["doc_id"]: (r["source"], r["lang"]) for r in docs.select("doc_id", "source", "lang").collect()}
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    p = {i: r["doc_score"] for i, r in got.items()}
    top = sum(p.values()) / len(p)

    def groups(key):
        by = collections.defaultdict(list)
        for i in p:
            by[key(i)].append(p[i])
        return by

    def strength(by, prior):
        n, means = len(p), {g: sum(x) / len(x) for g, x in by.items()}
        within = max(sum((v - means[g]) ** 2 for g, x in by.items() for v in x) / max(1, n - len(by)), 1e-9)
        between = max(sum(len(x) * (means[g] - prior(g)) ** 2 for g, x in by.items()) / n - within * len(by) / n, 1e-6)
        return min(max(within / between, 1.0), 1e5)

    hosts, paths = groups(lambda i: sites[i][0]), groups(lambda i: sites[i])
    k = strength(hosts, lambda g: top)
    host = {g: (sum(x) + k * top) / (len(x) + k) for g, x in hosts.items()}
    m = strength(paths, lambda g: host[g[0]])
    logit = lambda x: math.log(x / (1 - x))
    clip = lambda x: max(1e-6, min(x, 1 - 1e-6))
    for i, r in got.items():
        h, x = hosts[sites[i][0]], paths[sites[i]]
        assert r["host_posterior"] == pytest.approx(host[sites[i][0]], abs=1e-9)
        assert r["path_posterior"] == pytest.approx((sum(x) + m * host[sites[i][0]]) / (len(x) + m), abs=1e-9)
        others = (sum(h) - p[i] + k * top) / (len(h) - 1 + k)
        others = (sum(x) - p[i] + m * others) / (len(x) - 1 + m)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(logit(clip(p[i])) + logit(clip(others)) - logit(top)))), abs=1e-7)


def test_toxicity_matches_are_all_found():
    """The automaton against a search for every term at every place."""
    r = np.random.RandomState(5)
    letters = list("abc")
    word = lambda n: "".join(r.choice(letters, n))
    terms = {" " + word(r.randint(2, 4)): float(r.randint(1, 5)) for _ in range(8)} | {f" {word(2)} ": 2.5, f" {word(1)} ": 7.0}
    lexicon = toxicity.Lexicon(terms, frozenset({"ab abc", "abc a"}))
    for _ in range(50):
        text = toxicity.folded(" ".join(word(r.randint(1, 6)) for _ in range(30)))
        want = {}
        for at in range(len(text)):
            own = [w for t, w in terms.items() if text.startswith(t, at)]
            if own and not toxicity.phrases(text, at) & lexicon.exceptions:
                want[at] = max(own)
        assert dict(toxicity.matches(lexicon.automaton(), lexicon, text)) == want


def test_viterbi_over_strides_and_many_languages(monkeypatch):
    r = np.random.RandomState(8)
    scores = -r.random_sample((50, 300)) * 9
    lengths, ids = np.array([70, 3, 41]), r.randint(0, 50, 114)
    starts = np.array([0, 70, 73])
    whole = language.viterbi(scores, ids, starts, lengths, 3.0)
    monkeypatch.setattr(language, "STRIDE", 7)
    assert (language.viterbi(scores, ids, starts, lengths, 3.0) == whole).all() and whole.max() > 255


def test_differencing_by_hand():
    """Two sets: the largest numbers are replaced by their difference until one is left."""
    r = np.random.RandomState(9)
    for _ in range(20):
        numbers = r.randint(1, 1000, 25).tolist()
        left = sorted(numbers)
        while len(left) > 1:
            a, b = left.pop(), left.pop()
            left = sorted([*left, a - b])
        slots = [x[0] for x in sharding.difference([[n, 0] for n in numbers], 2)]
        sums = [sum(n for n, s in zip(numbers, slots, strict=True) if s == k) for k in (0, 1)]
        assert abs(sums[0] - sums[1]) == left[0]
