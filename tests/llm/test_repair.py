import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from momentlake.llm import queries, repair

COSTS = [repair.Costs(), repair.Costs(insert=1, delete=3, truncated=2), repair.Costs(rerole=2, delete=9, insert=2, truncated=0)]


def plain(rows, costs=repair.Costs()):  # noqa: B008
    """Counts, cost, audit and repaired lines of (turn, role, text), over all edit sequences (of at most three insertions in a row)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    memo = {}

    def best(i, q, more=3):
        if (i, q, more) not in memo:
            out = []
            if i == len(rows) and q in ("", "a"):
                out.append((0, "", ()))
            to = "a" if q == "u" else "u"
            name = {"a": "assistant", "u": "user"}[to]
            if more:
                out.append((costs.insert, "I", (f"{name}:",), best(i, to, more - 1)))
            if i < len(rows):
                _, role, text = rows[i]
                out.append((costs.delete, "D", (), best(i + 1, q)))
                if faults[i] not in ("b", "d"):
                    extra = costs.truncated if faults[i] else 0
                    out.append((costs.rerole + extra, "R", (f"{name}:{text}",), best(i + 1, to)))
                    if role[:1] in step[q]:
                        out.append((extra, "K", (f"{role}:{text}",), best(i + 1, step[q][role[:1]])))
            done = [(x[0] + x[3][0], x[1] + x[3][1], x[2] + x[3][2]) if len(x) > 3 else x for x in out if len(x) < 4 or x[3]]
            memo[i, q, more] = min(done, default=None)
        return memo[i, q, more]

    cost, audit, lines = best(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def random_rows(rng, n):
    return [(rng.choice([None, *range(12)]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "No!", "cut", "", " \n", None, "é", "So? \t"])) for _ in range(n)]


def row(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


@pytest.mark.parametrize("costs", COSTS)
def test_tables_give_the_least_audit(costs):
    t, rng = repair.Tables(costs), random.Random(2)
    for _ in range(400):
        rows = random_rows(rng, rng.randrange(1, 11))
        want = plain(rows, costs)
        rows = sorted(((t_, r if r is not None else " ", x if x is not None else " ") for t_, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, symbols = set(), []
        for _, role, text in rows:
            s = repair.symbol(role, text)
            symbols.append(repair.GONE if (role, text) in seen else s)
            seen.add((role, text))
        edits, q = t.trace(np.array(symbols), 0, repair.START)
        assert "".join(edits) + t.closing(q) == want[6]
        head, blocks = t.codes(np.array(symbols))
        first, cost = t.back(head, blocks, 0)
        assert cost + t.vectors[first[0]][repair.START] == want[5]


@pytest.mark.parametrize("chunk_rows", [2, 3, 1024])
def test_conversations(spark, chunk_rows):
    rng = random.Random(7)
    rows = [(c, *r) for c in [None, *range(40)] for r in random_rows(rng, rng.randrange(1, 14))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as chunk", "2 as seen").repartition(5)
    got = {r.conv_id: row(r) for r in repair.repair(df, chunk_rows=chunk_rows).collect()}
    for c in [None, *range(40)]:
        assert got[c] == plain([r[1:] for r in rows if r[0] == c]), c
    assert repair.repair(df.limit(0)).count() == 0


def test_one_conversation_in_many_chunks_and_many_equal_rows(spark):
    rng = random.Random(8)
    rows = [(5, i // 2, rng.choice(["user", "assistant", "system"]), f"t{rng.randrange(400)}{rng.choice('.. x')}") for i in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same = spark.range(30_000).selectExpr("6L as conv_id", "1L as turn", "'user' as role", "'same.' as text").unionByName(spark.createDataFrame([(6, 2, "assistant", "one.")], df.schema))
    got = {r.conv_id: row(r) for r in repair.repair(df.unionByName(same), chunk_rows=16).collect()}
    import sys

    sys.setrecursionlimit(20_000)
    assert got[5] == plain([r[1:] for r in rows])
    assert got[6][1:7] == (0, 29_999, 0, 29_999, 2 * 29_999, "K" + "D" * 29_999 + "K")


def test_long_texts(spark):
    rows = [(1, 0, "user", " " * 3_000_000), (1, 1, "user", "x" * 2_000_000 + "." + "\n" * 500_000), (1, 2, "assistant", "y.")]
    got = row(repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first())
    assert got == plain([r[1:] for r in rows]) and got[6] == "DKK"


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    df = queries.op12_repair(spark, sf)
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(names)} from ({queries.SQL['op12_repair']})").fetchall()
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(want)
