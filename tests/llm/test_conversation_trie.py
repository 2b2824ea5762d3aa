"""The trie against one built from the rebuilt texts."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from reelsift.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 4
        s = tuple(conv.get(c - int(math.fmod(c, 20)), [])[:h] + conv[c][h:])  # as in SQL for ids below 0
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for s in members:
        if s:
            kids[s[:-1]] += 1
    for s in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += kids[s] == 0
            saved[s[:d]] += (len(members[s]) - 1) * words
    return sorted(((min(members[s]), len(s), min(members[s[:-1]]) if s else None, len(members[s]), kids[s], leaves[s], saved[s],
                    hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()) for s in members), key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in ct.conversation_trie(df).select(*COLUMNS).collect()), key=str)
    assert got == plain(rows)
    return got


def made(seed, convs=90, texts=3):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "assistant"]), draw.choice([" ".join(["hi"] * n) for n in range(texts)]))
            for c in draw.sample(range(200), convs) for t in range(draw.randrange(1, 7))]


def test_random(spark):
    assert len(check(spark, made(1))) > 50
    check(spark, made(2, texts=2))


def test_edges(spark):
    rows = [(20, None, "user", "first"), (20, 0, "user", "second"), (20, 1, None, None), (21, 0, "user", "first"), (21, 0, "user", "first"),
            (22, 5, "user", "x" * 50_000), (23, 0, "", ""), (23, 1, None, None), (None, 0, "user", "lost"), (45, 0, "user", "no base here"),
            (1005, 0, "user", "a"), (-7, 0, "user", "below"), (-20, 0, "user", "below"), (20, 1, None, None)]
    check(spark, rows)
    assert ct.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("ref", F.lit("y")).withColumn("pos", F.lit(1))
    assert ct.conversation_trie(clash).columns == [*COLUMNS, "ref"]


def test_turnless_members(spark):
    """A conversation whose own turns all lie in its head, without a base: it ends at the root."""
    c = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 >= 2)
    got = check(spark, [(c, 0, "user", "gone"), (c, 1, "user", "gone too")])
    assert len(got) == 1 and got[0][1] == 0 and got[0][5] == 1


def test_hot_conversations(spark, monkeypatch):
    """One long conversation in many blocks, one common conversation, ids hashed in many blocks."""
    monkeypatch.setattr(ct, "BLOCK", 3)
    monkeypatch.setattr(ct, "IDS", 4)
    rows = [(40, t, "user", f"t {t % 7}") for t in range(300)] + [(c, t, "user", f"t {t % 7}") for c in range(400, 460) for t in range(4)]
    check(spark, rows + made(3, 30))


def test_collision_takes_other_bases(spark, monkeypatch):
    """Bases under which all turns of a depth look alike are found out and replaced."""
    real = ct._terms

    def weak(seed):
        if seed:
            return real(seed)

        def go(batches):
            import pyarrow as pa
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, *[b["pos"]] * ct.BASES], [*b.schema.names, *[f"t{i}" for i in range(ct.BASES)]])
        return go
    monkeypatch.setattr(ct, "_terms", weak)
    check(spark, made(4, 40))
