import hashlib
import re

from edge import docs, none

from reelsift.llm.exact_dedup import exact_dedup

SMOKE = "/root/testdata/sf0.001"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        ids = [j for (j, _), m in zip(rows, norm, strict=True) if m == n]
        known = [j for j in ids if j is not None]
        out.append((i, min(known) if known else None, len(ids), hashlib.sha256(n.encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_edges_match_brute_force_and_clashing_columns_give_way(spark):
    df = docs(spark, extra=("kept", "keep_id", "_norm", "group_size"))
    got = exact_dedup(df).collect()
    want = brute([(r.doc_id, r.text) for r in docs(spark).collect()])
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})  # one of each group, also among repeated rows
    assert got[0].lang is not None or "lang" in got[0].asDict()


def test_white_space_only_counts_as_one_space(spark):
    got = {r.doc_id: r for r in exact_dedup(docs(spark, [(1, "a  b", "", ""), (2, "a\t\nb", "", ""), (3, "a b", "", ""), (4, "ab", "", "")])).collect()}
    assert got[2].keep_id == 1 and not got[2].kept and got[3].kept and got[4].kept


def test_a_full_filter_changes_nothing(spark):
    rows = [(i, f"text {i % 40}", "", "") for i in range(120)]
    few, many = exact_dedup(docs(spark, rows), bits_per_row=1), exact_dedup(docs(spark, rows))
    assert sorted(few.collect()) == sorted(many.collect())


def test_empty_table(spark):
    assert exact_dedup(none(spark)).count() == 0
