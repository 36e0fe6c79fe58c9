import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidra.llm import pfair_mix
from evidra.llm.pfair_mix import edf_pattern, in_order, mix_sources, shares


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.01, 100), min_size=1, max_size=30))
def test_every_prefix_is_within_one_block_of_its_share(weights):
    period = 256
    share = shares({str(i): w for i, w in enumerate(weights)}, period)
    assert sum(share.values()) == period and min(share.values()) >= 1
    slots = {}
    for k, offsets in edf_pattern(share, period).items():
        slots |= dict.fromkeys(offsets, k)
    assert len(slots) == period
    had = dict.fromkeys(share, 0)
    for t in range(period):
        had[slots[t]] += 1
        assert all(abs(had[k] - q * (t + 1) / period) < 1 for k, q in share.items())


def rows(sizes):
    return [(i * 1000 + j, f"text {i} {j}", s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]


def test_mix_keeps_all_rows_and_interleaves(spark, monkeypatch):
    monkeypatch.setattr(pfair_mix, "BUCKET_ROWS", 40)
    data = rows({"a": 300, "b": 100, None: 100})
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = mix_sources(df, weights={"a": 0.5, "b": 0.25, pfair_mix.NULL_KEY: 0.25}, block_rows=5, period=16).collect()
    assert sorted((r.doc_id, r.text, r.source) for r in out) == sorted(data)
    assert len({(r.mix_slot, r.mix_index) for r in out}) == len(data)
    order = [r.source for r in sorted(out, key=lambda r: (r.mix_slot, r.mix_index))]
    for n in range(5, 400, 5):  # until the small sources run out
        for s, w in (("a", 0.5), ("b", 0.25), (None, 0.25)):
            assert abs(order[:n].count(s) - w * n) < 5 + 1e-9, (n, s)


def twin(sizes, weights, block_rows, period):
    """Slot of each block of each source, by scanning all blocks for each slot; for sources that are all worth a slot."""
    whole = sum(weights.values())
    exact = {s: weights[s] * period / whole for s in sizes}
    share = {s: int(x) for s, x in exact.items()}
    for s in sorted(sizes, key=lambda s: (share[s] - exact[s], s))[: period - sum(share.values())]:
        share[s] += 1
    blocks = {s: 1 for s in sizes}
    out, slot = {}, 0
    need = {s: -(-n // block_rows) for s, n in sizes.items()}
    while any(blocks[s] <= need[s] for s in sizes):
        ready = [(-(-blocks[s] * period // q), s) for s, q in share.items() if (blocks[s] - 1) * period // q <= slot]
        s = min(ready)[1]
        if blocks[s] <= need[s]:
            out[s, blocks[s] - 1] = slot
        blocks[s] += 1
        slot += 1
    return out


def test_mix_equals_brute_force(spark):
    sizes = {f"s{i}": 20 + 37 * i % 90 for i in range(12)}
    weights = {s: 1.0 + i * 0.7 for i, s in enumerate(sizes)}
    out = mix_sources(spark.createDataFrame(rows(sizes), "doc_id long, text string, source string"), weights=weights, block_rows=5, period=200).collect()
    got, index = {}, {}
    for r in sorted(out, key=lambda r: (r.mix_slot, r.mix_index)):
        at = index.setdefault(r.source, [])
        got.setdefault((r.source, len(at) // 5), set()).add(r.mix_slot)
        assert r.mix_index == len(at) % 5
        at.append(r.doc_id)
    assert got == {k: {v} for k, v in twin(sizes, weights, 5, 200).items()}


@pytest.mark.parametrize("explicit", [False, True])
def test_small_sources_keep_their_shares(spark, monkeypatch, explicit):
    monkeypatch.setattr(pfair_mix, "BUCKET_ROWS", 40)
    sizes = {f"s{i:02}": 100 if i > 2 else 400 for i in range(40)} | {None: 90}
    weights = {s or pfair_mix.NULL_KEY: 1.0 + (i % 5) for i, s in enumerate(sizes)} if explicit else None
    data = rows(sizes)
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    target = {s: weights[s or pfair_mix.NULL_KEY] if explicit else n**0.5 for s, n in sizes.items()}
    whole = sum(target.values())
    for period in (28, 32, 4096):  # most sources are small, some, none
        out = mix_sources(df, weights=weights, block_rows=1, period=period).collect()
        assert sorted((r.doc_id, r.text, r.source) for r in out) == sorted(data)
        slots = {r.mix_slot: r.source for r in out}
        assert len(slots) == len(data)
        had = dict.fromkeys(sizes, 0)
        for t in range(1200 if period == 4096 else period):  # before any source runs out, and before shares of a short period drift
            had[slots[t]] += 1
            assert all(abs(had[s] - w / whole * (t + 1)) < (2 if period == 4096 else 3.5) for s, w in target.items()), (period, t)


def test_tiny_weights_and_many_sources_are_honoured(spark):
    sizes = {"big": 3000} | {f"t{i:03}": 1 for i in range(300)}
    df = spark.createDataFrame(rows(sizes), "doc_id long, text string, source string")
    out = mix_sources(df, weights={"big": 1e6} | {f"t{i:03}": 1e-6 for i in range(300)}, block_rows=1).collect()
    order = [r.source for r in sorted(out, key=lambda r: (r.mix_slot, r.mix_index))]
    assert len(order) == 3300 and order[:3000] == ["big"] * 3000  # their share of 3,000 rows is far below one

    sizes = {f"s{i:04}": 1 + i % 3 for i in range(5000)}
    weights = {s: 1.0 + i % 7 for i, s in enumerate(sizes)}
    df = spark.createDataFrame(rows(sizes), "doc_id long, text string, source string")
    whole = sum(weights.values())
    for period in (pfair_mix.PERIOD, 4096):  # all planned; all small but those of more than a slot
        out = mix_sources(df, weights=weights, block_rows=1, period=period).select("mix_slot", "source", "doc_id").collect()
        assert len({r.mix_slot for r in out}) == len(out) == sum(sizes.values())
        for r in out:
            had = 1  # a source of one row has had its share when its only block is due
            if sizes[r.source] == 1:
                assert abs(had - weights[r.source] / whole * (r.mix_slot + 1)) < 3.5, r


def test_empty_repeats_and_clashing_columns(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    data = [(1, "x", "a", 9, "k")] * 4 + [(None, None, "a", 9, "k"), (2, "", None, 9, "k")]
    out = mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string, mix_slot int, bits string"))
    assert out.columns == ["doc_id", "text", "source", "bits", "mix_slot", "mix_index"] and out.count() == 6


def test_in_order_lays_rows_out(spark):
    df = spark.createDataFrame(rows({"a": 200, "b": 50}), "doc_id long, text string, source string")
    mixed = mix_sources(df, block_rows=4)
    want = [r.doc_id for r in sorted(mixed.collect(), key=lambda r: (r.mix_slot, r.mix_index))]
    assert [r.doc_id for r in in_order(mixed, slots_each=7).collect()] == want
    sparse = mixed.withColumn("mix_slot", mixed.mix_slot * 10**12)
    assert [r.doc_id for r in in_order(sparse, slots_each=7).collect()] == want


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame(rows({"a": 20}), "doc_id long, text string, source string")
    plan = mix_sources(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
