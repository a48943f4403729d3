import random
from math import ceil

import numpy as np
import pytest
from brute import components, schedule
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import chat_format, hilbert_ann, mixing, ngram_join, ngram_sets, registry, secret_scan, sharding
from marginalia.llm.components import components as connected
from marginalia.llm.store import new_path, read, table


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, small, name):
    assert spark_rows(registry.queries()[name](spark, small)) == duck_rows(registry.oracle_sql()[name], small)


# -- sharding -----------------------------------------------------------------
def test_compaction(spark, odd_documents):
    store = sharding.ShardStore(spark, new_path(spark, "store"), target_bytes=1 << 30)
    assert store.read() is None and store.version() == 0
    for _ in range(5):
        store.append(odd_documents)
    assert store.manifest().select("run").distinct().count() == 5
    store.compact()
    assert store.manifest().select("run").distinct().count() == 1
    assert store.read().count() == 75 and store.read(2).count() == 30 and store.read().columns == odd_documents.columns
    version = store.version()
    assert store.compact() == version
    store.vacuum(keep=1, grace=0)
    assert store.read().count() == 75
    store.append(odd_documents.limit(0))
    assert store.read().count() == 75


def test_second_writer_loses(spark, odd_documents):
    store = sharding.ShardStore(spark, new_path(spark, "store"))
    store.append(odd_documents)
    live = store.manifest()
    with pytest.raises(sharding.Conflict):
        store._commit(0, live)
    assert store.version() == 1


def test_vacuum_spares_what_another_writer_has_not_committed(spark, odd_documents):
    store, other = (sharding.ShardStore(spark, p) for p in [new_path(spark, "store")] * 2)
    store.append(odd_documents)
    run = other._write_run(odd_documents)
    store.vacuum()
    other._change([run])
    assert store.read().count() == 30
    run = other._write_run(odd_documents)
    store.vacuum(grace=0)
    with pytest.raises(sharding.Conflict):
        other._change([run])
    assert store.read().count() == 30


def test_second_writer_tries_again(spark, odd_documents, monkeypatch):
    store, other = (sharding.ShardStore(spark, p) for p in [new_path(spark, "store")] * 2)
    for _ in range(4):
        store.append(odd_documents)
    was = store.version
    seen = []

    def late():
        v = was()
        if not seen:
            seen.append(other.append(odd_documents))
        return v

    monkeypatch.setattr(store, "version", late)
    assert store.append(odd_documents) == 6 and store.read().count() == 90
    # a merge whose runs are gone leaves nothing behind
    due = store._due(store.manifest().collect())[0]
    other.compact()
    with pytest.raises(sharding.Conflict):
        store._change([store._write_run(odd_documents)], frozenset(r["run"] for r in due))
    assert store.read().count() == 90


def test_runs_of_other_columns(spark, odd_documents):
    store = sharding.ShardStore(spark, new_path(spark, "store"))
    store.append(odd_documents.select("doc_id"))
    store.append(odd_documents.select("doc_id", "text"))
    assert sorted(store.read().columns) == ["doc_id", "text"]
    assert store.read().count() == 30
    store.append(odd_documents.selectExpr("cast(doc_id as string) as doc_id"))
    with pytest.raises(ValueError):
        store.read()


def test_arrivals_are_whole(odd_documents):
    parts = sharding.arrivals(odd_documents, "doc_id", 4)
    assert sum(p.count() for p in parts) == 15
    assert sum(p.count() for p in sharding.arrivals(odd_documents.limit(0), "doc_id", 4)) == 0


# -- n-gram join ----------------------------------------------------------------
@pytest.mark.parametrize("n,percent,group", [(3, 90, 512), (3, 90, 3), (5, 80, 512), (5, 80, 3)])
def test_ngram_join(spark, small, monkeypatch, n, percent, group):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    docs = read(spark, small, "documents")
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, n, percent).collect()}
    assert rows == components([(r.doc_id, r.text) for r in docs.collect()], n, percent)


@pytest.mark.parametrize("n,percent,group", [(3, 90, 512), (3, 90, 4), (5, 80, 4)])
def test_ngram_join_of_chains(spark, monkeypatch, n, percent, group):
    """Families of edited copies, many near the threshold, some linked only through others."""
    monkeypatch.setattr(ngram_join, "GROUP", group)
    rng = random.Random(n * percent)
    docs = []
    for family in range(6):
        words = [f"w{family}x{k}" for k in range(rng.choice([6, 9, 10, 12, 40, 120]))]
        for _ in range(14):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            docs.append((len(docs), " ".join(copy)))
            words = copy if rng.random() < 0.5 else words
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), n, percent).collect()}
    assert rows == components(docs, n, percent)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_linked_sets_share_the_signatures_they_need(n, percent):
    shape, rng, tried = ngram_join.Shape(n, percent), np.random.default_rng(percent), 0
    for _ in range(4000):
        size = int(rng.choice([4, 5, 8, 9, 10, 12, 19, 20, 25, 40, 80, 200]))
        less, more = int(rng.integers(0, size // 4 + 1)), int(rng.integers(0, size // 4 + 1))
        if not (less or more) or 100 * (size - less) < percent * (size + more):
            continue
        tried += 1
        whole = rng.integers(0, 2**63, size + more, dtype=np.uint64) * np.uint64(2)
        (a, need_a), (b, need_b) = (shape.signatures(np.sort(x)) for x in (whole[:size], whole[less:]))
        shared = np.intersect1d(a, b)
        need = [dict(zip(sig.tolist(), least.tolist(), strict=True)) for sig, least in ((a, need_a), (b, need_b))]
        bands = [[x for x in shared.tolist() if x & 63 == band] for band in {x & 63 for x in shared.tolist()}]
        assert any(all(len(band) >= max(d[x] for x in band) for d in need) for band in bands)
    assert tried > 300


def test_ngram_join_odd(spark, odd_documents):
    rows = ngram_join.near_duplicates(odd_documents, 3, 90)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in rows.collect()}
    assert rows.count() == 15 and {(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (5, 1, 5), (6, 1, 5), (11, 2, 11), (12, 2, 11), (None, 2, 11)} <= got
    kept = ngram_join.first_of_each(odd_documents, 3, 90)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 7, 9, 10, 11]
    assert kept.columns == odd_documents.columns and ngram_join.near_duplicates(odd_documents.limit(0), 3, 90).count() == 0
    twice = odd_documents.where("doc_id = 4").union(odd_documents.where("doc_id = 4"))
    assert ngram_join.first_of_each(twice, 3, 90).count() == 1


def test_clouds_of_near_copies(spark, monkeypatch):
    """Two families around one text each with a passage in common, many sets about the threshold: inside and outside sets meet."""
    rng, texts = random.Random(5), []
    for f in range(2):
        base = [f"f{f}_{rng.randrange(400)}" for _ in range(90)] + [f"lic{j}" for j in range(30)]
        for _ in range(150):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append((len(texts), " ".join(w)))
    monkeypatch.setattr(ngram_join, "GROUP", 16)
    across, seen = ngram_join.across, []
    monkeypatch.setattr(ngram_join, "across", lambda *a: seen.append(across(*a)) or seen[-1])
    rows = ngram_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows.collect()} == components(texts, 5, 80)
    assert seen


def test_templates_are_met_in_proportion(spark, monkeypatch):
    """Texts of one template are alike and hardly linked: the copies that meet grow as the texts do, not as their square."""
    dealt, met = ngram_join.dealt, []

    def counted(rows):
        out = dealt(rows)
        met.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "dealt", counted)
    for n in (3000, 6000):
        rng, texts = random.Random(1), []
        for k in range(n):
            w = [f"t{j}" for j in range(40)]
            for slot in range(4):
                w[5 + 10 * slot] = f"s{slot}_{rng.randrange(25)}"
            texts.append((k, " ".join(w)))
        rows = ngram_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 5, 80)
        assert {r.doc_id: r.component_id for r in rows.collect()} == {i: c for i, (_, c) in linked_by_slots(texts).items()}
    assert met[1] <= 2.2 * met[0] and met[1] <= 10 * 6000


def linked_by_slots(texts):
    """Components of the template's texts: a slot is in five of 36 shingles, so only equal texts and none with another value are linked."""
    first = {}
    return {i: (36, first.setdefault(t, i)) for i, t in texts}


def test_a_common_token_is_sent_twice_a_flush():
    sender = ngram_sets.Sender(4)
    token = np.full(1500, 1 << 63, np.uint64)
    token[:1000:2] = np.arange(1, 501)  # every other token of the first 500 sets is theirs alone
    own = np.r_[np.repeat(np.arange(500), 2), np.arange(500, 1000)]
    rows = [*sender.add(token, own, np.arange(1000), np.full(1000, 2), np.full(1000, 2)), *sender.flush()]
    sent = [r for r in rows if r[1] is not None]
    assert sum(len(r[1]) // 4 for r in sent) == 502
    assert sum(np.frombuffer(r[3], np.uint32).sum() for r in rows if r[1] is None) == 998


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.comp for r in connected(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# -- neighbours -------------------------------------------------------------------
def test_hilbert_curve_is_one():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert_ann.hilbert_index(cells, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def nearest(rows, k):
    out = {}
    ids, v = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    for i, q in enumerate(ids):
        cos = v @ v[i]
        out[q] = sorted(((-round(c, 12), x) for x, c in zip(ids, cos, strict=True) if x != q))[:k]
    return out


def test_recall_and_scores(spark, small):
    rows = read(spark, small, "embeddings")
    found = registry.op5_hilbert_ann(spark, small).collect()
    brute = nearest([(r.vec_id, r.embedding) for r in rows.collect()], 5)
    asked = {r.query_id for r in found}
    assert asked == {q for q in brute if q % 50 == 0}
    hits = sum((-round(r.score, 12), r.vec_id) in brute[r.query_id] for r in found)
    assert hits / (5 * len(asked)) >= 0.9


def vectors(spark, v):
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")


def recall(found, v, queries, k=5):
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = {q: set(np.argsort(-(unit @ unit[q]), kind="stable")[1 : k + 1].tolist()) for q in queries}
    return sum(r.vec_id in near[r.query_id] for r in found) / (k * len(near))


def test_small_windows_find(spark, monkeypatch):
    """Vectors that gather round centres: all curves together visit less than a tenth of the table."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(250, 64))[rng.integers(0, 250, 6000)] + 0.2 * rng.normal(size=(6000, 64))
    monkeypatch.setattr(hilbert_ann, "BLOCK", (1, 65536))
    reach, seen = hilbert_ann.reach_of, []
    monkeypatch.setattr(hilbert_ann, "reach_of", lambda *a: seen.append(reach(*a)) or seen[-1])
    found = hilbert_ann.search(vectors(spark, v), F.col("id") % 50 == 0, curves=8).collect()
    assert recall(found, v, range(0, 6000, 50)) >= 0.9
    assert 8 * 3 * seen[0] < 600  # three blocks of a curve at most


def test_reach_follows_the_table(spark, monkeypatch):
    """Isotropic vectors, of which a fixed window finds too few."""
    v = np.random.default_rng(4).normal(size=(4000, 64))
    monkeypatch.setattr(hilbert_ann, "BLOCK", (16, 65536))
    query = F.col("id") % 50 == 0
    assert recall(hilbert_ann.search(vectors(spark, v), query, reach=16).collect(), v, range(0, 4000, 50)) < 0.9
    assert recall(hilbert_ann.search(vectors(spark, v), query).collect(), v, range(0, 4000, 50)) >= 0.9


def test_scaled_copies_tie(spark):
    """Vectors of one direction are equally near: the smaller id comes first, whatever the length."""
    rng = np.random.default_rng(9)
    one = rng.normal(size=64)
    v = np.stack([one * s for s in rng.uniform(0.1, 30, 60)] + list(rng.normal(size=(200, 64))))
    found = hilbert_ann.search(vectors(spark, v), F.col("id").isin(0, 20)).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in found] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]
    assert {r.score for r in found} == {1.0}


def test_vectors_with_other_columns_and_equal_ids(spark):
    rows = [(k // 2, [float(k % 7), 1.0, float(k)], "x", 1, 2.0) for k in range(20)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, curve string, point int, v double")
    found = hilbert_ann.search(data, F.col("id") == 3).collect()
    assert len(found) == 10 and all(r.vec_id != 3 for r in found)  # both rows of the id ask
    assert found[0].asDict().keys() == {"query_id", "rank", "vec_id", "score"}


def test_vectors_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [2.0, 0.0]), (None, [1.0, 1.0])] + [(k, [0.0, 1.0]) for k in range(10, 30)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {q: [r.vec_id for r in sorted(g, key=lambda r: r.rank)] for q, g in ((q, [r for r in hilbert_ann.search(data, F.col("id").isin(0, 12, 4)).collect() if r.query_id == q]) for q in (0, 12, 4))}
    assert got == {0: [7, 10, 11, 12, 13], 12: [10, 11, 13, 14, 15], 4: []}
    assert hilbert_ann.search(data.limit(0), F.lit(True)).count() == 0


# -- chat -------------------------------------------------------------------------
def test_any_conversation_comes_back(spark):
    rng = random.Random(3)
    bits = ["[INST]", "[/INST]", " ", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "<<ROLE:41>>", "<</ROLE>>", "\\", "a", "é😀", "\n", "[", "<", "]", ">"]
    rows, source = [], {}
    for conv in range(150):
        for turn in range(rng.randint(1, 5)):
            text = "".join(rng.choices(bits, k=rng.randint(0, 7))) if rng.random() > 0.1 else None
            role = rng.choice(["user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn, role, text))
            source.setdefault(conv, []).append((role or "", text or ""))
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat_format.format_conversations(data).collect():
        assert [(t.role, t.text) for t in r.turns] == source[r.conv_id]
        assert sum(t.chars for t in r.turns) == len(r.formatted)
    assert chat_format.format_conversations(data.limit(0)).count() == 0


def test_chat_odd(spark):
    """Ties of turn, repeated rows, a null conversation, very long texts and other columns."""
    long = "</s>[INST] " * 20_000
    rows = [(None, 0, "user", "a"), (None, None, "assistant", long), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "assistant", "b"), (2, 5, "assistant", None), (2, 5, None, "")]
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, turns int")
    found = {r.conv_id: r for r in chat_format.format_conversations(data).collect()}
    assert [(t.role, t.text) for t in found[None].turns] == [("assistant", long), ("user", "a")]
    assert [(t.role, t.text) for t in found[1].turns] == [("assistant", "b"), ("user", "b"), ("user", "b")]
    assert [(t.role, t.text) for t in found[2].turns] == [("", ""), ("assistant", "")]
    for r in found.values():
        shown = [r.formatted[m.start : m.end] for m in r.loss_mask]
        said = [t.text for t in r.turns if t.role == "assistant"]
        assert len(shown) == len(said)
        assert all(a == b for a, b in zip(shown, said, strict=True) if "[" not in b)
    row = chat_format.digests(chat_format.format_conversations(data.where("conv_id is null"))).first()
    assert row.loss_chars == len(long)


# -- mixing -----------------------------------------------------------------------
def test_schedule_is_pfair():
    rng = random.Random(2)
    for _ in range(20):
        weights = {f"s{k}": rng.random() ** 3 + 0.001 for k in range(rng.randint(1, 25))}
        share = mixing.shares(weights)
        at = mixing.earliest_deadline_first(share)
        assert sorted(x for v in at.values() for x in v) == list(range(mixing.SLOTS))
        for s, slots in at.items():
            done = np.cumsum(np.isin(np.arange(mixing.SLOTS), slots))
            assert (np.abs(done - share[s] * np.arange(1, mixing.SLOTS + 1) / mixing.SLOTS) < 1).all()
        blocks = {s: rng.randint(0, 3000) for s in weights}
        used = sorted(p.start + j // p.share * mixing.SLOTS + p.at[j % p.share] for p in mixing.phases(weights, blocks) for j in range(p.blocks))
        assert used == list(range(sum(blocks.values())))
    with pytest.raises(ValueError):
        mixing.shares({str(k): 1.0 for k in range(11)}, 10)


def test_mixture_is_whole(spark, small):
    docs = read(spark, small, "documents")
    rows = registry.op8_mixing(spark, small).toPandas()
    assert sorted(rows.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert not rows.duplicated(["mix_slot", "mix_within"]).any()
    assert rows.groupby("mix_slot").mix_stream.nunique().max() == 1
    counts = rows.groupby("mix_stream").size()
    assert rows.mix_slot.max() + 1 == sum(ceil(n / mixing.BLOCK) for n in counts)


def test_mixture_is_the_schedule_slot_by_slot(spark, small):
    weights = {"src0": 0.5, "src1": 0.2, "src2": 0.2}
    rows = mixing.mix(read(spark, small, "documents").select("doc_id", "source"), weights, block=3, slots=50).collect()
    streams = {s: sum(r.mix_stream == s for r in rows) for s in (*weights, mixing.OTHER)}
    want = schedule({mixing.OTHER: 0.01 * sum(weights.values())} | weights, {s: ceil(n / 3) for s, n in streams.items()}, mixing.shares, 50)
    got = {r.mix_slot: r.mix_stream for r in rows}
    assert [got[k] for k in range(len(got))] == want
    # within a stream rows go by the hash of their id, three a block
    keys = {r.doc_id: r.k & ((1 << 64) - 1) for r in read(spark, small, "documents").select("doc_id", F.xxhash64("doc_id", F.lit(11)).alias("k")).collect()}
    for s in streams:
        mine = sorted((r for r in rows if r.mix_stream == s), key=lambda r: (r.mix_slot, r.mix_within))
        assert [keys[r.doc_id] >> 1 for r in mine] == sorted(keys[r.doc_id] >> 1 for r in mine)
        assert [r.mix_within for r in mine] == [k % 3 for k in range(len(mine))]


def test_mixing_odd(spark, odd_documents):
    rows = mixing.mix(odd_documents, {"src0": 2.0, "gone": 1.0}, block=2)
    assert rows.count() == 15 and {r.mix_stream for r in rows.collect()} == {"src0", mixing.OTHER}
    assert mixing.in_order(rows).count() == 15 and mixing.mix(odd_documents.limit(0), {"src0": 1.0}).count() == 0


# -- pipeline ---------------------------------------------------------------------
def test_order_of_the_mixture_survives(spark, small, monkeypatch):
    """The last two stages and run() over many files of unlike sizes, which Spark does not read by name."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    put = {"spark.sql.files.maxRecordsPerFile": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        rows = corpus_pipeline.run(spark, small).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    mixed = {r.doc_id: (r.mix_slot, r.mix_within) for r in registry.op8_mixing(spark, small).collect()}
    assert [r.doc_id for r in rows] == sorted(mixed, key=mixed.get)
    assert [(r.mix_slot, r.mix_within) for r in rows] == sorted(mixed.values())


def test_pipeline_odd(spark, small, odd_documents):
    """Every stage on nulls, empty and long texts, repeated rows and clashing columns, and on no rows."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_documents, small)
        assert stage(spark, odd_documents.limit(0), small).count() == 0
        if name != "byte_bpe":
            assert out.columns == odd_documents.columns
        rows = out.collect()
        if name in ("secret_scan", "mixing", "byte_bpe"):
            assert len(rows) == odd_documents.count()
        if name == "mixing":
            assert sorted(map(repr, rows)) == sorted(map(repr, odd_documents.collect()))
        if name == "ngram_join":
            assert len(rows) < odd_documents.count() and sum(r.doc_id is None for r in rows) == 1


def test_pipeline(spark, small):
    docs = read(spark, small, "documents")
    seen, n = {}, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, table(stage(spark, docs, small), "stage")
        seen[name] = docs.count()
        if name != "byte_bpe":
            assert docs.columns == before.columns
        if name == "quality_classifier":
            predicted = registry.op3_quality_classifier(spark, small).where("predicted = 1")
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in predicted.collect())
        if name == "ngram_join":
            want = components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
        if name == "secret_scan":
            assert secret_scan.scan(docs).where(F.size("base") > 0).count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "mixing":
            texts = {r.doc_id: r.text for r in docs.collect()}
    assert seen["ngram_join"] == seen["secret_scan"] == seen["mixing"] == seen["byte_bpe"] < seen["quality_classifier"] < n
    import hashlib

    assert {r.doc_id: r.decoded_sha256 for r in docs.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
