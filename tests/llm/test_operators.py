"""Each operator against a plain version of itself, on a table of hard cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from arkivel.llm import exact_dedup, fingerprints, language_model, line_dedup, mixing, near_dedup, packing, sharding, suffix_dedup

PATH = public_tokenizers.path("byte_bpe_50k.json")


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(sets, percent):
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = root(a), root(b)
                up[max(u, v)] = min(u, v)
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, rows, percent):
    got = near_dedup.near_duplicates(docs, percent).toPandas()
    assert len(got) == len(rows)
    want = components({d: shingles(t) for d, t, *_ in rows if d is not None}, percent)
    for r in got[got.doc_id.notna()].itertuples():
        assert r.component_id == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
    sizes = {d: len(shingles(t)) for d, t, *_ in rows}
    assert all(r.n_shingles == sizes[int(r.doc_id)] for r in got[got.doc_id.notna()].itertuples())


def test_fingerprint_classes(docs, rows):
    got = fingerprints.near(docs, 80).toPandas()
    want = components({d: shingles(t) for d, t, *_ in rows if d is not None}, 80)
    assert all(r.class_id == want[r.doc_id] for r in got[got.doc_id.notna()].itertuples())


def test_shuffle_files_go_with_the_written_step(spark):
    import time

    from arkivel.llm.common import SHUFFLES_GO, materialize

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {b for b in disk.getAllBlocks().mkString(",").split(",") if b.startswith("shuffle_")}
    before, was = shuffled(), spark.conf.get(SHUFFLES_GO)
    made = materialize(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "test")
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get(SHUFFLES_GO) == was and made.count() == 100


def test_fingerprint_query_has_classes(docs, rows, tmp_path):
    from arkivel.llm.queries import op7_fingerprints

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_fingerprints(docs.sparkSession, str(tmp_path)).toPandas()
    want = components({d: shingles(t) for d, t, *_ in rows if d is not None}, 80)
    assert len(got) == len(rows) and all(r.class_id == want[r.doc_id] for r in got[got.doc_id.notna()].itertuples())


def test_links_within_a_bucket_are_never_lost(spark):
    """A chain in which the smallest document is like its neighbour only."""
    words = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(words[20 * i : 20 * i + 250])) for i in range(7)]
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 80).toPandas()
    want = components({d: shingles(t) for d, t in texts}, 80)
    assert got.set_index("doc_id").component_id.to_dict() == want


@pytest.mark.parametrize("spans", [[(900, 950), (0, 400), (30, 430), (60, 460)], [(0, 300), (60, 400), (60, 420)]])
@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_members_stay_in_their_bucket(spark, monkeypatch, spans, limit):
    """Texts of one bucket: B is linked to A alone, which is in the centre's component by another bucket; or B is too large for the centre, A apart from it."""
    bands = F.when(F.col("doc_id").isin(1, 2) & F.lit(len(spans) > 3), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).cast("array<long>")
    sketched = lambda docs, *_: docs.select("doc_id", (F.size(F.split("text", " ")) - 4).cast("long").alias("n_shingles"), F.md5("text").cast("binary").alias("digest"), bands.alias("bands"))
    monkeypatch.setattr(near_dedup, "sketches", sketched)
    monkeypatch.setattr(near_dedup, "TASK_SHINGLES", limit)
    texts = [(i, " ".join(f"w{k}" for k in range(*s))) for i, s in enumerate(spans)]
    want = components({d: shingles(t) for d, t in texts}, 85)
    assert len(set(want.values())) == 2 and want[len(spans) - 1] == want[len(spans) - 2] == 1
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 85).toPandas()
    assert got.set_index("doc_id").component_id.to_dict() == want


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_members_always_share_a_key(percent):
    """Families of hundreds of edited sets: each link of which one member is not linked to the centre has a key in common."""
    rng, met = np.random.default_rng(2), 0
    for edits in (0.05, 0.1, 0.14):
        core = rng.integers(0, 1 << 63, 200, np.uint64)
        edited = lambda s, part: np.unique(np.r_[s[rng.random(len(s)) > part], rng.integers(0, 1 << 63, round(len(s) * part), np.uint64)])
        first = [edited(core, edits) for _ in range(60)]
        sets = sorted(first + [edited(first[rng.integers(60)], 0.06) for _ in range(140)], key=len)
        alike = lambda a, b: 100 * (n := len(np.intersect1d(a, b))) >= percent * (len(a) + len(b) - n)
        linked = [alike(sets[0], s) for s in sets]
        keys = [near_dedup.prefix_keys(7, np.setdiff1d(s, sets[0]), len(s), percent) for s in sets]
        for i, j in ((i, j) for i in range(1, 200) for j in range(1, i)):
            if not (linked[i] and linked[j]) and alike(sets[i], sets[j]):
                assert len(np.intersect1d(keys[i], keys[j]))
                met += 1
    assert met > 100


def test_signature_is_unbiased():
    rng = np.random.default_rng(1)
    off = []
    for n in (3, 20, 400):
        for _ in range(40):
            x = rng.integers(0, 1 << 63, 2 * n, np.uint64) * np.uint64(2)
            a, b = np.unique(x[: int(1.5 * n)]), np.unique(x[n // 2 :])
            off.append((near_dedup.signature(a, 336) == near_dedup.signature(b, 336)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(off)) < 0.03


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates(docs, rows, keep):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").encode().lower()].append(d)
    got = exact_dedup.exact_duplicates(docs, keep, fan=4, levels=3).toPandas()
    assert len(got) == len(rows)
    by_text = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    for r in got.itertuples():
        ids = by_text[r.text_sha256]
        known = [i for i in ids if i is not None]
        want = (max if keep == "largest" else min)(known) if known else None
        assert r.group_size == len(ids)
        assert (None if math.isnan(r.keep_id) else r.keep_id) == want


def test_mixing(docs, rows):
    got = mixing.mixed(docs, chunk=4).toPandas()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: weight[s] * level for s in open_}
    for s in order:
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert own.target.iloc[0] == pytest.approx(target[s]) and own.source_size.iloc[0] == sizes[s]
        assert abs(own.taken.sum() - target[s]) <= own["size"].max() / 2 + 1e-6
        assert (own.taken <= 2 * own["size"]).all() and (own.taken == own.copies * own["size"]).all()
    again = mixing.mixed(docs.repartition(5), chunk=4).toPandas()
    key = ["doc_id", "nth", "size"]
    assert got.sort_values(key).taken.tolist() == again.sort_values(key).taken.tolist()


def test_rounding_keeps_expectations(spark):
    """Over many documents of one size the copies are close to the expectation of each half."""
    docs = spark.range(4000).selectExpr("id as doc_id", "'a b c' as text", "if(id < 2000, 'x', 'y') as source")
    got = mixing.mixed(docs, weights=(1, 1), share=0.4).toPandas()
    assert abs(got[got.doc_id % 2 == 0].copies.mean() - 0.4) < 0.04


def test_sharding(docs, rows):
    got = sharding.sharded(docs, sharding.tree(8), sharding.tree(9)).toPandas()
    texts = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert Counter(zip(got["size"], got.text_crc32, strict=True)) == texts
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert set(got[got["shard"] != got.grown_shard].grown_shard) <= {8}


def test_tree_follows_weights(spark):
    node = sharding.Node("root", (sharding.Node("a", (sharding.Node("a0", shard=0), sharding.Node("a1", shard=1, weight=3.0))), sharding.Node("b", shard=2, weight=4.0)))
    counts = {r.s: r["count"] for r in spark.range(20_000).select(sharding.placed(F.col("id"), node).alias("s")).groupBy("s").count().collect()}
    assert abs(counts[2] / 20_000 - 0.5) < 0.02 and abs(counts[1] / counts[0] - 3) < 0.3


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    ids = defaultdict(list)
    for d, t, *_ in rows:
        ids[d].append([*plain.encode(t or "", add_special_tokens=False).ids, 0])
    got = packing.packed(docs.withColumn("nth", F.lit("not a number")).withColumn("start", F.lit("x")), PATH, 256).toPandas()
    for d, own in ids.items():
        part = got[got.doc_id.isna()] if d is None else got[got.doc_id == d]
        assert part.length.sum() == sum(map(len, own))
        for r in part.itertuples():
            assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in own)
            assert r.length == 256 or r.piece == 0
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 2
    whole = packing.pieces(docs.where("doc_id = 145"), PATH, 256).orderBy("piece").toPandas()
    assert np.frombuffer(b"".join(whole.ids), "<u4").tolist() == ids[145][0]


@pytest.mark.parametrize("text", ["", " a", "a  b", "a \n b", "<|endoftext|> x", " x y z", "it's  they'll 1234 5", "x" * 200 + " y", "漢字 漢字 é", " ", "\n", "a\x1cb c\x1d d"])
def test_encoder_is_the_tokenizer(text):
    enc = packing.encoder(PATH)
    want = enc.slow.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc(text), "<u4").tolist() == want
    assert np.frombuffer(enc(text), "<u4").tolist() == want  # from what is kept


def test_plan_fills_bins():
    rng = np.random.default_rng(2)
    for _ in range(20):
        hist = Counter(rng.integers(1, 101, 300).tolist())
        made = packing.plan(dict(hist), 100)
        used = Counter()
        for times, combined in made:
            assert sum(n * k for n, k in combined) <= 100
            for n, k in combined:
                used[n] += times * k
        assert used == hist
        assert sum(t for t, _ in made) <= 1.06 * sum(n * c for n, c in hist.items()) / 100 + 2  # half of the lengths fit in no bin together


def test_line_dedup(spark, docs, rows):
    got = line_dedup.without_repeats(docs)
    assert {"digest", "rep", "slice", "p", "key"} <= set(got.columns)  # other columns stay
    got = got.toPandas()
    digest = lambda b: hashlib.md5(b).hexdigest()
    chunks = set()
    for place, (d, t, *_) in enumerate(rows):
        for salt in line_dedup.SALTS if t is not None else ():
            lines, hs, start = t.split("\n"), [digest(x.encode()) for x in t.split("\n")], 0
            for i in range(len(lines)):
                if i == len(lines) - 1 or int(digest((salt + "".join(hs[max(0, i - 1) : i + 1])).encode())[:4], 16) % line_dedup.MEAN == 0:
                    chunks.add((place, d, start, "\n".join(lines[start : i + 1]), i + 1 - start))
                    start = i + 1
    first, gone = {}, defaultdict(set)
    for c in sorted(chunks, key=lambda c: (c[1] is None, c[1] or 0, c[2])):
        first.setdefault((c[3], c[4]), (c[1], c[2]))
    for place, d, s, body, n in chunks:
        if n >= 2 and first[body, n] != (d, s):
            gone[place].update(range(s, s + n))
    kept = {i: [x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]] for i, (_, t, *_) in enumerate(rows)}
    assert {x for _, t, *_ in rows if t for x in t.split("\n")} <= {x for v in kept.values() for x in v}  # no line is lost everywhere
    want = Counter((d, "\n".join(kept[i]) if t is not None else None) for i, (d, t, *_) in enumerate(rows))
    have = Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.text) for r in got.itertuples())
    assert have == want
    assert sum(got.lines_removed) > 0


def stripped(rows, length, passage=None):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, n_passage]) by counting all strings."""
    texts = [(t or "").encode() for _, t, *_ in rows]
    out = []
    covers = []
    for n in (length, passage or length):
        seen = Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
        covers.append([])
        for b in texts:
            gone = np.zeros(len(b), bool)
            for i in range(len(b) - n + 1):
                if seen[b[i : i + n]] > 1:
                    gone[i : i + n] = True
            covers[-1].append(gone)
    for (d, *_), b, gone, shorter in zip(rows, texts, *covers, strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), *[int(shorter.sum())] * bool(passage)))
    return Counter(out)


def have_stripped(got):
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_passage"] if "n_passage" in got else [])]
    return Counter((None if math.isnan(r.doc_id) else int(r.doc_id), *(getattr(r, c) for c in own)) for r in got.itertuples())


@pytest.mark.parametrize("hot", [1, 4096])  # 1: every anchor is dealt anew, down to single strings
def test_suffix_dedup(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert have_stripped(suffix_dedup.without_repeats(docs, 60, 16).toPandas()) == stripped(rows, 60)
    assert have_stripped(suffix_dedup.without_repeats(docs, 60, 16, passage=40).toPandas()) == stripped(rows, 60, 40)


@pytest.mark.parametrize("hot", [3, 4096])
def test_one_passage_in_many_surroundings(spark, monkeypatch, hot):
    """One anchor in very many stretches, which differ left and right of the passage."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage = word(75)
    rows = [(i, word(int(rng.integers(50, 90))) + passage[int(rng.integers(0, 3)) :] + word(70)) for i in range(60)]
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 70, 16, passage=50).toPandas()
    assert have_stripped(got) == stripped(rows, 70, 50)
    assert (got.n_removed > 0).any() and (got.n_passage > 0).all()


@pytest.mark.parametrize("piece", [64, 97])
def test_long_texts_in_pieces(monkeypatch, piece):
    """Runs found piece by piece cover the same starts with the same anchors."""
    rng = np.random.default_rng(4)
    data = rng.integers(97, 101, 1000).astype(np.uint8)
    flat = lambda r: {int(s) + k: (int(a), int(s) + int(lead)) for a, _, _, s, n, _, lead in zip(*r, strict=True) for k in range(int(n))}
    whole = flat(suffix_dedup.runs(data, 40, 8))
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    assert flat(suffix_dedup.runs(data, 40, 8)) == whole and set(whole) == set(range(961))


def test_fingerprints(docs, rows):
    got = fingerprints.compared(docs).toPandas()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by_id = {d: t or "" for d, t, *_ in order}
    ids = [d for d, *_ in order]
    for k, d in enumerate(ids):
        t, nxt = by_id[d], by_id[ids[(k + 1) % len(ids)]]
        if d == 146 and ids[(k + 1) % len(ids)] == 146:
            continue
        n = len(t) // 4
        changed = t[: len(t) - n] + nxt[:n]
        own = got[got.doc_id.isna()] if d is None else got[got.doc_id == d]
        assert hashlib.sha256(changed.encode()).hexdigest() in set(own.edited_sha256)
        a, b = shingles(t), shingles(changed)
        true = len(a & b) / len(a | b) if a | b else 1.0
        if hashlib.sha256(changed.encode()).hexdigest() == own.edited_sha256.iloc[0]:
            assert abs(own.near_edited.iloc[0] - true) < 0.25
    same = got.groupby("fingerprint").doc_id.apply(set)
    assert any({100, 121} <= s for s in same)  # case is not seen


def test_language_model(docs, rows):
    learns = F.col("doc_id") % 3 != 0
    got = language_model.scored(docs, learns, block_bytes=4000).toPandas()
    train = Counter()
    tokens = []
    for d, t, *_ in rows:
        w = [*(t or "").encode().lower().split(), None]
        tokens.append((d, w))
        if d is not None and d % 3:
            train.update(w)
    n, v = sum(train.values()), len(train)
    want = Counter((d, len(w), sum(train[x] > 0 for x in w), round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 6)) for d, w in tokens)
    have = Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got.itertuples())
    assert have == want and set(got.train_tokens) == {n}
    assert (got.score < 0).all() and got.score.sum() > got.base_score.sum()


def test_mixture_weights_fit_held_out_counts():
    bucket, n = np.array([4, 4]), np.array([900, 100])
    good = language_model.weights(bucket, np.array([80, -9999]), np.array([8, 8]), n)
    assert good[4, 0] > 0.8 and np.allclose(good.sum(axis=1), 1)


@pytest.mark.parametrize("name", ["near", "exact", "mix", "shard", "pack", "lines", "suffix", "prints", "lm"])
def test_empty_table(none, name):
    made = {
        "near": lambda: near_dedup.near_duplicates(none), "exact": lambda: exact_dedup.exact_duplicates(none), "mix": lambda: mixing.mixed(none),
        "shard": lambda: sharding.sharded(none, sharding.tree(8), sharding.tree(9)), "pack": lambda: packing.packed(none, PATH), "lines": lambda: line_dedup.without_repeats(none),
        "suffix": lambda: suffix_dedup.without_repeats(none), "prints": lambda: fingerprints.compared(none), "lm": lambda: language_model.scored(none, F.lit(True)),
    }[name]()
    assert made.count() == 0
