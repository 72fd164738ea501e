"""Operators that put documents together: packing, order fingerprints, token rollups, the pipeline."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers
from reviewlens.llm import ordermin, packing, pieces, queries, rollup, secrets
from reviewlens.llm.minhash import shingle_sets
from reviewlens.session import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("config", [packing.PackingConfig(sizes=(8, 16, 64), shard_tokens=300), packing.PackingConfig()])
def test_packing(spark, config):
    random.seed(3)
    rows = [(i, random.choice([0, 1, 3, 7, 8, 20, 64, 200, 9000])) for i in range(400)] + [(5, 7), (None, 3), (6, None)]
    counts = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, n_tokens bigint, bin_id string")
    got = packing.pack(counts, config).collect()
    total, bins = defaultdict(int), defaultdict(list)
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
        if r["bin_id"] is None:
            assert r["n_tokens"] == 0
        else:
            bins[r["bin_id"]].append(r)
    want = defaultdict(int)
    for i, n in rows:
        want[i] += n or 0
    assert total == want
    for content in bins.values():
        content.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in content:  # no gaps, no overlaps
            assert r["bin_offset"] == at and r["n_tokens"] >= 1
            at += r["n_tokens"]
        size = content[0]["bin_size"]
        assert at <= size and size == min((s for s in config.sizes if s >= at), key=config.cost)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["start"], r["n_tokens"]))
    assert all(n == max(config.sizes) for i, x in by_doc.items() if i not in (5, 6, None) for _, n in sorted(x)[:-1])


def test_packing_is_best_fit():
    config = packing.PackingConfig(sizes=(4, 10), per_token_pair=0.0)
    bins, offsets, sizes = packing.best_fit(np.array([7, 6, 4, 3, 2, 2]), config)
    assert sorted(sizes.tolist()) == [4, 10, 10] and np.bincount(bins).max() == 2
    assert packing.best_fit(np.zeros(0, np.int64), config)[0].size == 0


def test_packing_opens_larger_bins_where_they_are_cheaper():
    config = packing.PackingConfig()
    lengths = np.array([350] * 400 + [40] * 3)
    bins, offsets, sizes = packing.best_fit(lengths, config)
    assert np.bincount(bins, lengths).max() <= 4096 and (sizes[bins] >= offsets + lengths).all()
    smallest = 400 * config.cost(512)
    assert sum(map(config.cost, sizes.tolist())) < 0.9 * smallest and max(sizes) > 512
    # A longer piece opens the size it needs and doesn't keep the others from theirs.
    longer = packing.best_fit(np.concatenate(([4096, 4096], lengths)), config)[2].tolist()
    assert sum(map(config.cost, longer)) <= 2 * config.cost(4096) + sum(map(config.cost, sizes.tolist()))
    random.seed(11)
    for _ in range(20):
        lengths = np.array(sorted((random.randint(1, 4096) for _ in range(60)), reverse=True))
        rooms, used = [], []
        for n in lengths.tolist():  # best fit with the smallest size that holds the piece
            fits = [i for i, room in enumerate(rooms) if room >= n]
            at = min(fits, key=rooms.__getitem__) if fits else len(rooms)
            if not fits:
                rooms.append(min(s for s in config.sizes if s >= n))
                used.append(0)
            rooms[at] -= n
            used[at] += n
        plain = sum(config.cost(min(s for s in config.sizes if s >= n)) for n in used)
        assert sum(map(config.cost, packing.best_fit(lengths, config)[2].tolist())) <= plain


def cheapest(lengths, config):
    """The least cost of any packing, by trying each piece in each bin."""
    best = float("inf")

    def put(at, used):
        nonlocal best
        if at == len(lengths):
            best = min(best, sum(min(config.cost(s) for s in config.sizes if s >= n) for n in used))
            return
        for i in range(len(used) + 1):
            if i == len(used):
                put(at + 1, [*used, lengths[at]])
            elif used[i] + lengths[at] <= max(config.sizes):
                put(at + 1, [*used[:i], used[i] + lengths[at], *used[i + 1:]])

    put(0, [])
    return best


@pytest.mark.parametrize("config", [packing.PackingConfig(sizes=(4, 8, 16), per_token_pair=0.05), packing.PackingConfig(sizes=(5, 12), per_token_pair=0.0)])
def test_packing_next_to_all_packings(config):
    random.seed(6)
    ratios = []
    for _ in range(40):
        lengths = sorted((random.randint(1, max(config.sizes)) for _ in range(random.randint(1, 7))), reverse=True)
        own = sum(map(config.cost, packing.best_fit(np.array(lengths), config)[2].tolist()))
        ratios.append(own / cheapest(lengths, config))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) <= 1.35 and np.mean(ratios) <= 1.05


def test_rows_without_an_id_share_no_shard(spark):
    rows = [(None, 50)] * 600 + [(i, 50) for i in range(600)]
    counts = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").repartition(4)
    config = packing.PackingConfig(sizes=(128, 256), shard_tokens=2000)
    plan = packing.pack(counts, config)._jdf.queryExecution().executedPlan().toString()
    got = packing.pack(counts, config).collect()
    assert len(got) == 1200 and len({r["bin_id"] for r in got}) >= 240 and plan.count("Exchange") == 1  # the test's own
    used = defaultdict(int)
    for r in got:
        used[r["bin_id"]] += r["n_tokens"]
    assert max(used.values()) <= 256


def test_packing_carries_token_ids(spark):
    rows = [(1, "0123456789abcdef" * 900), (2, "two words"), (3, None), (4, ""), (None, "no id"), (2, "again\n\n two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    config = packing.PackingConfig(sizes=(4, 16))
    packed = packing.pack(packing.token_parts(docs, model, config), config, "parts").collect()
    bins = defaultdict(dict)
    for r in packed:
        assert r["n_tokens"] == len(r["content"] or []) <= 16
        if r["bin_id"] is not None:
            bins[r["bin_id"], r["bin_size"]][r["bin_offset"]] = r["content"]
    for (_, size), held in bins.items():
        assert sum(map(len, held.values())) <= size
    long = sorted((r for r in packed if r["doc_id"] == 1), key=lambda r: r["piece"])
    own = pieces.codec(model)
    assert len(long) > 1 and [i for r in long for i in r["content"]] == own.encode(rows[0][1])
    encoded = sorted(own.encode(t or "") for i, t in rows if i != 1)
    short = packing.token_parts(docs.where("doc_id IS NULL OR doc_id <> 1"), model)
    assert sorted(r["content"] or [] for r in packing.pack(short, parts="parts").collect()) == encoded
    together = packing.pack_tokens(docs, model, config)
    assert together.columns == [*packing.pack(short).columns, "content"]
    assert sorted((r["content"] or [] for r in together.collect())) == sorted((r["content"] or [] for r in packed))
    table = queries.op6_best_fit_packing(spark, SF)
    assert table.columns == [*packing.pack(table).columns, "ids"] and table.where("n_tokens <> coalesce(size(ids), 0)").isEmpty()


def test_packing_carries_texts(spark):
    rows = [(1, "  a b\tc\n\nd é f "), (2, ""), (3, None), (4, " \n"), (5, "x"), (6, "1 2 3 4"), (7, " 1 2 3 4 5")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    config = packing.PackingConfig(sizes=(1, 2))
    packed = packing.pack(packing.word_parts(docs, config), config, "parts").orderBy("doc_id", "piece").collect()
    texts = defaultdict(str)
    for r in packed:
        assert len((r["content"] or "").split()) == r["n_tokens"]
        texts[r["doc_id"]] += r["content"] or ""
    assert texts == {i: t if t and t.strip() else "" for i, t in rows}


def test_packing_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0
    docs = spark.createDataFrame([(1, None), (2, " a\tb ")], "doc_id bigint, text string")
    assert sorted(map(tuple, packing.word_counts(docs).collect())) == [(1, 0), (2, 2)]




@pytest.mark.parametrize("config", [ordermin.OrderMinConfig(range_rows=7), ordermin.OrderMinConfig(k=3, take=3, size=8)])
def test_order_fingerprints(spark, config):
    random.seed(4)
    rows = [(i * 3, "".join(random.choices("abcé 日😀", k=random.randrange(0, 90)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "a"), (203, "x" * 3000), (205, rows[4][1]), (204, rows[4][1]), (210, "zz"), (210, "yy")]
    docs = spark.createDataFrame([(*r, 1) for r in [*rows, (None, "lonely text")]], "doc_id bigint, text string, near_next int")
    got = ordermin.fingerprint_documents(docs.repartition(4), config).collect()
    assert len(got) == len(rows) + 1
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in got)
    ring = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    sketch, want = ordermin.OrderMinHash(config), []
    for (i, text), (_, other) in [*zip(ring, ring[1:] + ring[:1]), ((-1, "lonely text"), (None, "lonely text"))]:
        third = len(text) // 3
        changed = text[: len(text) - third] + other[:third]
        a, b, c = map(sketch.components, (text, changed, other))
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), ordermin.written(a), ordermin.written(b),
                     ordermin.likeness(a, b), ordermin.likeness(a, c)))
    assert found == sorted(want)


def test_order_components_by_definition():
    config = ordermin.OrderMinConfig(k=2, take=2, size=6)
    sketch = ordermin.OrderMinHash(config)
    runs = sketch.numbered_runs(np.frombuffer("ababab".encode("utf-32-le"), np.uint32))
    assert len(set(runs.tolist())) == 5  # ab, ba, ab', ba', ab''
    again = sketch.numbered_runs(np.frombuffer("abab".encode("utf-32-le"), np.uint32))
    assert again.tolist() == runs[:3].tolist()
    for f in range(config.size):
        keys = ((runs ^ sketch.flips[f]) * sketch.factors[f]).tolist()
        assert len(set(keys)) == len(keys)
    alike = ordermin.likeness(sketch.components("the quick brown fox"), sketch.components("fox brown quick the"))
    assert alike < 1.0 == ordermin.likeness(sketch.components("same"), sketch.components("same"))


def test_order_fingerprints_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert ordermin.fingerprint_documents(empty).count() == 0
    one = ordermin.fingerprint_documents(spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")).first()
    assert one["near_next"] == 1.0 and one["near_edited"] < 1.0


def totals_of(state):
    out = defaultdict(lambda: [0, 0])
    for (_, version), (source, lang, tokens) in state.items():
        out[source, lang, version][0] += 1
        out[source, lang, version][1] += tokens
    return sorted(((*map(str, k), *v) for k, v in out.items()))


def test_rollup_follows_changes(spark):
    random.seed(7)
    table = rollup.TokenRollup(spark, scratch_path(spark, "rollup"))
    assert table.totals().count() == 0
    state, schema = {}, "doc_id bigint, version string, source string, lang string, tokens bigint"
    for batch in range(4):
        changes = {}
        for _ in range(30):
            key = (random.randrange(25), random.choice(["v1", "v2"]))
            gone = random.random() < 0.3
            changes[key] = (random.choice(["s", "t", None]), random.choice(["en", None]), None if gone else random.randrange(9))
        rows = [(*k, *v) for k, v in changes.items()] + [(None, "v1", "s", "en", 5), (3, None, "s", "en", 5)]
        frame = spark.createDataFrame(rows, schema)
        assert table.commit(batch, frame) and not table.commit(batch, frame)
        for key, value in changes.items():
            if value[2] is None:
                state.pop(key, None)
            else:
                state[key] = value
        got = sorted((str(r["source"]), str(r["lang"]), r["version"], r["documents"], r["tokens"]) for r in table.totals().collect())
        assert got == totals_of(state)


def test_rollup_ignores_what_was_not_committed(spark):
    folder = scratch_path(spark, "rollup")
    table = rollup.TokenRollup(spark, folder)
    schema = "doc_id bigint, version string, source string, lang string, tokens bigint"
    one = spark.createDataFrame([(1, "v", "s", "en", 4)], schema)
    one.selectExpr("doc_id", "version", "source", "lang", "tokens", "9L AS batch").write.parquet(f"{folder}/ledger/batch=9/dead")
    assert table.commit(9, one) and table.totals().first()["tokens"] == 4


CHANGES = "doc_id bigint, version string, source string, lang string, tokens bigint"


def test_batches_that_come_late_count_as_later_changes(spark):
    table = rollup.TokenRollup(spark, scratch_path(spark, "rollup"))
    for batch, tokens in ((5, 10), (3, 7), (6, 1)):
        assert table.commit(batch, spark.createDataFrame([(1, "v", "s", "en", tokens)], CHANGES))
        assert table.totals().first()["tokens"] == tokens == table.ledger().first()["tokens"]
    assert not table.commit(3, spark.createDataFrame([(1, "v", "s", "en", 99)], CHANGES))
    assert [c["batch"] for c in table.commits()] == [5, 3, 6]


def test_two_jobs_at_once(spark, monkeypatch):
    """Between one job's reading of the ledger and its commit another job commits."""
    folder = scratch_path(spark, "rollup")
    one, other = rollup.TokenRollup(spark, folder), rollup.TokenRollup(spark, folder)
    assert one.commit(1, spark.createDataFrame([(1, "v", "s", "en", 4), (2, "v", "s", "en", 5)], CHANGES))
    own = rollup.TokenRollup._commit

    def late(self, number, **content):
        if self is one:
            monkeypatch.setattr(rollup.TokenRollup, "_commit", own)
            assert other.commit(2, spark.createDataFrame([(1, "v", "s", "en", 40)], CHANGES))
        return own(self, number, **content)

    monkeypatch.setattr(rollup.TokenRollup, "_commit", late)
    assert one.commit(3, spark.createDataFrame([(1, "v", "s", "en", 7)], CHANGES))
    assert [c["batch"] for c in one.commits()] == [1, 2, 3]
    assert one.totals().first()["tokens"] == 12 and other.totals().first()["tokens"] == 12

    def twice(self, number, **content):
        if self is one:
            monkeypatch.setattr(rollup.TokenRollup, "_commit", own)
            assert other.commit(4, spark.createDataFrame([(2, "v", "s", "en", 6)], CHANGES))
        return own(self, number, **content)

    monkeypatch.setattr(rollup.TokenRollup, "_commit", twice)
    assert not one.commit(4, spark.createDataFrame([(2, "v", "s", "en", 6)], CHANGES))
    assert one.totals().first()["tokens"] == 13 and len(one.commits()) == 4


def test_rollup_counts_every_row(spark):
    table = rollup.TokenRollup(spark, scratch_path(spark, "rollup"))
    rows = [(1, "v", "s", "en", 4), (1, "v", "s", "en", 4), (1, "v", "t", None, 2), (None, "v", "s", "en", 9), (1, "v", "s", "en", None)]
    assert table.commit(1, spark.createDataFrame(rows, CHANGES), add_unnamed=True)
    got = {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in table.totals().collect()}
    assert got == {("s", "en"): (3, 17), ("t", None): (1, 2)}
    assert table.commit(2, spark.createDataFrame([(1, "v", "s", "en", None)], CHANGES))
    assert [tuple(r) for r in table.totals().collect()] == [("s", "en", "v", 1, 9)]
    assert table.ledger().count() == 0


def test_a_compacted_rollup_goes_on(spark):
    table = rollup.TokenRollup(spark, scratch_path(spark, "rollup"))
    assert not table.compact()
    for batch in range(3):
        rows = [(i, "v", "s", "en", i + batch) for i in range(batch, 6)]
        table.commit(batch, spark.createDataFrame(rows, CHANGES))
    before = sorted(map(tuple, table.totals().collect()))
    assert table.compact() and sorted(map(tuple, table.totals().collect())) == before
    assert not table.commit(2, spark.createDataFrame([(1, "v", "s", "en", 50)], CHANGES))
    assert table.commit(9, spark.createDataFrame([(5, "v", "s", "en", None)], CHANGES))
    assert table.totals().first()["tokens"] == before[0][4] - 7 and table.totals().first()["documents"] == 5


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = scratch_path(spark, "stage")
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == before.columns
        kept[name] = docs
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in kept.items()}
    assert ids["toxicity"] < ids["documents"] and ids["near_dedup"] < ids["toxicity"]
    assert ids["substring_dedup"] <= ids["near_dedup"] and ids["secrets"] == ids["substring_dedup"] == ids["packing"]
    import pyarrow as pa
    rows = kept["near_dedup"].orderBy("doc_id").collect()
    sets = list(shingle_sets(pa.array([r["text"] for r in rows]), 5))
    for i, a in enumerate(sets):
        for b in sets[:i]:
            shared = len(np.intersect1d(a, b, assume_unique=True))
            assert not len(a) or not len(b) or 100 * shared < 80 * (len(a) + len(b) - shared)
    assert secrets.scan_documents(kept["secrets"], ()).where("n_hex + n_access > 0").count() == 0
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in kept["secrets"].collect()}
    packed = defaultdict(int)
    for r in docs.collect():
        packed[r["doc_id"]] += r["n_tokens"]
    assert packed == words
    assert all(r["n_chars"] == len(r["text"]) for r in kept["secrets"].collect())


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 13


def test_no_plan_of_bin_sizes_is_filled_twice(monkeypatch):
    """The search goes round the length classes until nothing is cheaper; what it priced before, it skips."""
    config, filled, fill = packing.PackingConfig(), [], packing.fill

    def counted(lengths, classes, plan, judged, config):
        filled.append((None if plan is None else tuple(plan), tuple(judged)))
        return fill(lengths, classes, plan, judged, config)

    monkeypatch.setattr(packing, "fill", counted)
    for largest, seed in ((4097, 1), (365, 0), (2000, 0)):
        filled.clear()
        packing.best_fit(np.sort(np.random.default_rng(seed).integers(1, largest, 800))[::-1], config)
        plans = [plan for plan, _ in filled if plan is not None]
        assert len(plans) == len(set(plans))
