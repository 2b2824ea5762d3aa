import pytest
from edge import docs, none

from reelsift.llm import mixing
from reelsift.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_targets_by_hand():
    # 150 % of 400 words: 600, shared 5 : 2 : 1 gives 375, 150, 75; a is full at 200, the other 400
    # go 2 : 1, b is full at 200, and c takes the last 200
    assert mixing.targets({"a": 100, "b": 100, None: 200}) == {"a": 200.0, "b": 200.0, None: 200.0}
    assert mixing.targets({"a": 1000, "b": 1000}) == {"a": 2000.0, "b": 1000.0}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}
    got = mixing.targets({"B": 500, "a": 500, "é": 500, "z": 700})
    # by code point, null last: weights 5, 2, 1, 5, and none reaches twice its size
    assert mixing.targets({"é": 100, "a": 100, "B": 100, None: 100}, cap=99) == {"B": 600 * 5 / 13, "a": 600 * 2 / 13, "é": 600 / 13, None: 600 * 5 / 13}
    assert sum(got.values()) == pytest.approx(1.5 * 2200) and all(got[k] <= 2 * v for k, v in {"B": 500, "a": 500, "é": 500, "z": 700}.items())


def brute_cost(patterns, due, repeats):
    """Least cost of the largest flow, over all ways to give whole words (tiny cases)."""
    from itertools import product

    best = None
    names = list(due)
    ranges = [range(repeats * size + 1) for own, size in patterns for _ in own]
    for flows in product(*ranges):
        at, given, got = 0, [], dict.fromkeys(names, 0)
        for own, _ in patterns:
            given.append(sum(flows[at:at + len(own)]))
            for s, f in zip(own, flows[at:at + len(own)], strict=True):
                got[s] += f
            at += len(own)
        if any(g > repeats * size for g, (_, size) in zip(given, patterns, strict=True)) or any(got[s] > due[s] for s in names):
            continue
        cost = sum(r * max(0, min(size, g - r * size)) for g, (_, size) in zip(given, patterns, strict=True) for r in range(repeats))
        key = (-sum(given), cost)
        best = key if best is None or key < best else best
    return best


@pytest.mark.parametrize(("patterns", "due"), [
    ([(["a"], 3), (["a", "b"], 2), (["b"], 2)], {"a": 5, "b": 3}),
    ([(["a", "b"], 4), (["b"], 1)], {"a": 3, "b": 6}),
    ([(["a"], 2), (["a", "b"], 3)], {"a": 1, "b": 5})])
def test_flow_is_largest_and_cheapest(patterns, due):
    given = mixing.route(patterns, due, 2)
    cost = sum(r * max(0, min(size, g - r * size)) for g, (_, size) in zip(given, patterns, strict=True) for r in range(2))
    assert (-sum(given), cost) == brute_cost(patterns, due, 2)


def test_fill_swaps_towards_the_rest():
    assert sum([5, 9, 30][i] for i in mixing.fill([5, 9, 30], 9)) == 9
    assert mixing.fill([], 5) == [] and mixing.fill([0, 7], 0) == [0]
    sizes = [400, 310, 299, 520, 77]
    assert abs(sum(sizes[i] for i in mixing.fill(sizes, 700)) - 700) <= 10


def test_each_source_comes_near_its_target(spark):
    rows = QUERIES["op4_mixing"](spark, SF).collect()
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    by = {}
    for r in rows:
        assert r.size == len((truth[r.doc_id].text or "").encode().split())
        assert r.taken in (0, r.size, 2 * r.size)
        by.setdefault(truth[r.doc_id].source, []).append(r)
    due = mixing.targets({s: sum(r.size for r in x) for s, x in by.items()})
    for s, x in by.items():
        assert {(r.source_size, r.target) for r in x} == {(sum(r.size for r in x), due[s])}
        assert abs(sum(r.taken for r in x) - due[s]) <= 0.005 * due[s] + 5
    again = QUERIES["op4_mixing"](spark, SF).collect()
    assert sorted(rows) == sorted(again)


def test_large_sources_are_cut_by_parts_of_the_hash_range(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 5)
    rows = [(i, "w " * (1 + i % 7), "en", "hot" if i % 3 else None) for i in range(900)]
    sized = mixing.sized(docs(spark, rows))
    mix = mixing.plan_mix(sized)
    due = {s: t for s, _, t in mix.sources.collect()}
    for s, total in {r.source: r.t for r in mixing.copies(sized, mix).selectExpr("source", "copies * size as x").groupBy("source").agg({"x": "sum"}).toDF("source", "t").collect()}.items():
        assert abs(total - due[s]) <= 7


def test_overlapping_sources_and_edges(spark):
    from pyspark.sql import functions as F

    df = docs(spark, extra=("copies", "pattern", "size"))
    out = mixing.mix_documents(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "size"]  # working columns replace those of their names
    assert out.filter("text is null or trim(text) = ''").count() == 0
    many = docs(spark, [(i, "a b c", "en", "") for i in range(40)]).withColumn("source", F.when(F.col("doc_id") < 10, F.array(F.lit("x"), F.lit("y")))
                                                                               .when(F.col("doc_id") < 20, F.array(F.lit("y"))).otherwise(F.array(F.lit("x"))))
    taken = mixing.mix_documents(many)
    assert 0 < taken.count() <= 80 and taken.groupBy("doc_id").count().filter("count > 2").count() == 0
    assert mixing.mix_documents(none(spark)).count() == 0


def near_targets(spark, rows, mix, slack):
    due = {s: t for s, _, t in mix.sources.collect()}
    taken = mixing.copies(rows, mix).selectExpr("source", "copies * size as x").groupBy("source").agg({"x": "sum"}).collect()
    for s, total in taken:
        assert abs(total - due[s]) <= slack, (s, total, due[s])
    return due


def test_every_pattern_goes_through_the_flow(spark, monkeypatch):
    """Also lone sources, in the query itself; each component is solved once."""
    calls, patterns = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def spy(found, due, repeats):
        calls.add(1)
        patterns.add(len(found))
        return mixing.route(found, due, repeats)

    real = mixing.plan_mix
    monkeypatch.setattr(mixing, "plan_mix", lambda rows, **how: real(rows, flow=spy, **how))
    got = QUERIES["op4_mixing"](spark, SF)
    sources = spark.read.parquet(f"{SF}/documents.parquet").select("source").distinct().count()
    assert got.count() and calls.value == patterns.value == sources


def test_many_sources(spark, monkeypatch):
    """Targets and flows of 20,000 sources in many tasks agree with the plain version."""
    from pyspark.sql import functions as F

    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 20_000).alias("source"),
                                    F.repeat(F.lit("word "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    rows = mixing.sized(df)
    mix = mixing.plan_mix(rows)
    sources = mix.sources.collect()
    want = mixing.targets({r.source: r.source_size for r in sources})
    assert {r.source: r.target for r in sources} == want and len(want) == 20_000
    near_targets(spark, rows, mix, 7)


def test_overlapping_components_against_one_network(spark):
    """Patterns of several sources in two components and lone sources: the same totals as one flow over all."""
    groups = [["a"], ["a", "b"], ["b"], ["c", "d"], ["d"], ["e"], [None], [None, "e2"], ["f"]]
    rows = [(i, "w " * (1 + i % 5), groups[i % len(groups)]) for i in range(900)]
    table = mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"))
    mix = mixing.plan_mix(table)
    sources = {r.source: (r.source_size, r.target) for r in mix.sources.collect()}
    assert {s: t for s, (_, t) in sources.items()} == mixing.targets({s: n for s, (n, _) in sources.items()})
    sizes = {}
    for i, t, g in rows:
        sizes[tuple(g)] = sizes.get(tuple(g), 0) + 1 + i % 5
    order = sorted(sizes, key=str)
    want = dict(zip(order, mixing.route([(list(p), sizes[p]) for p in order], {s: t for s, (_, t) in sources.items()}, 2)))
    got = {}
    for r in mixing.copies(table, mix).collect():
        assert 0 <= r.copies <= 2
        got[tuple(r.source)] = got.get(tuple(r.source), 0) + r.copies * r.size
    for parts in ([("a",), ("a", "b"), ("b",)], [("c", "d"), ("d",)], [("e",)], [("f",)]):
        assert abs(sum(got[p] for p in parts) - sum(want[p] for p in parts)) <= 5 * len(parts)


def test_rows_that_repeat_are_drawn_one_by_one(spark):
    rows = [(1, "w " * 100, "en", "s")] * 50 + [(i, "w " * 10, "en", "t") for i in range(10, 50)]
    table = mixing.sized(docs(spark, rows))
    mix = mixing.plan_mix(table)
    due = near_targets(spark, table, mix, 60)
    assert due["s"] == 7300
    out = mixing.mix_documents(docs(spark, rows)).collect()
    assert abs(100 * sum(r.source == "s" for r in out) - 7300) <= 60
