import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import oracle
from motifloom.llm import chat, mixing, queries, rules

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    a, b, here, there = oracle.differences(spark, SF, queries.queries()[name], queries.oracle_sql()[name])
    assert a == b and not here and not there, (list(here)[:3], list(there)[:3])


@pytest.mark.parametrize("name", ["op6_mixing", "op8_rules", "op9_chat"])
def test_no_python_in_the_plan(spark, name):
    df = queries.queries()[name](spark, SF)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def slow_measures(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(runs)
    cover = {k for i, r in enumerate(runs) if n[r] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_rules_on_odd_texts(spark):
    one = "a b c d e f g h i j "
    texts = [None, "", " \n", one, one * 2, one * 3 + "z", "x " * 17, "é É\n" * 9, "a\nb\na\n \n \nb", "| # $ % " * 9, "w x y z", ("q r s t u v w x y " * 3 + "\n") * 2, "lo " * 30_000, " ".join(f"w{i}" for i in range(30_000))]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, "a", "k"), (3, one, "k")], "doc_id long, text string, kept string")
    got = rules.apply_rules(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            n = slow_measures(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, r
            assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)
    by = {r.doc_id: r.kept for r in got}
    assert by[len(texts) - 1] and not by[9] and not by[len(texts) - 2]
    assert rules.apply_rules(df.where("false")).count() == 0


def test_cascade_order(spark):
    df = rules.measures(spark.createDataFrame([(i, "word " * 3 + "| " * (i % 2) * 5) for i in range(50)], "doc_id long, text string")).cache()
    order = rules.plan(df, rules.costlier())
    assert sorted(order) == sorted(rules.costlier()) and order[0] in ("symbols", "stutter")
    kept = [df.select(rules.cascade(rules.costlier(), o).alias("k")).where("k").count() for o in (order, order[::-1])]
    assert kept[0] == kept[1]


def test_mix(spark):
    text = lambda n: " ".join(["w"] * n)
    rows = [(i, text(i % 7), s, 0) for i, s in enumerate(["a", "b", "c", None, "é"] * 30)] + [(500, None, "a", 0), (501, text(3), "", 0), (501, text(3), "", 0), (None, text(2), "b", 0)]
    rows += [(1000 + i, text(40), "a", 0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, open_ = 1.5 * sum(sizes.values()), set(names)
    target = {}
    while True:
        level = (total - sum(2 * sizes[s] for s in target)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix(df.where("false")).count() == 0
    assert {r.target for r in mixing.mix(df.where("doc_id = 500")).collect()} == {0.0}


def test_chat(spark):
    call = lambda i, n, a: {"id": i, "name": n, "arguments": a}
    say = json.dumps
    rows = [
        (1, 0, "user", 'hi "you"\n{'),
        (1, 3, "assistant", say({"content": "see", "tool_calls": [call("c1", "search", {"query": "é", "limit": 2}), call("c2", "calculate", {"expression": 5})]})),
        (1, 2, "tool", say({"tool_call_id": "c1", "content": "found"})),
        (1, 5, "tool", say({"tool_call_id": "zz", "content": "lost"})),
        (2, 0, "assistant", say({"tool_calls": [call("c1", "search", {"limit": 1, "query": "b", "extra": {"z": 1, "a": [1, 2]}})]})),
        (2, 1, "assistant", "{not json"),
        (3, 0, None, None), (3, 0, "user", ""), (3, 0, "user", ""), (None, 0, "user", "x"),
        (4, 0, "assistant", say({"tool_calls": [call("d", "search", {"query": "q"})]})), (4, 1, "tool", say({"tool_call_id": "d", "content": None})),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, line string")
    got = chat.format_chat(df).collect()
    assert len(got) == len(rows)
    one = [r for r in got if r.conv_id == 1]
    assert [(r.turn, r.order_turn, r.phase) for r in one] == [(0, 0, 0), (3, 3, 0), (2, 3, 1), (5, 5, 1)]
    assert [r.linked for r in one] == [None, False, True, False] and [r.valid for r in one] == [None, False, None, None]
    for r in got:
        m = json.loads(r.line)
        assert list(m) == sorted(m) and r.line == json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(one[0].line)["content"] == 'hi "you"\n{'
    two = [r for r in got if r.conv_id == 2]
    assert two[0].valid is False and two[0].linked is False and json.loads(two[0].line)["tool_calls"][0]["arguments"]["extra"] == {"a": [1, 2], "z": 1}
    assert json.loads(two[1].line)["content"] == "{not json"
    four = [r for r in got if r.conv_id == 4]
    assert four[0].valid is True and four[0].linked is True and json.loads(four[1].line)["content"] is None
    assert chat.format_chat(df.where("false")).count() == 0


@pytest.mark.parametrize(("arguments", "good"), [('{"query":"a"}', True), ('{"query":1}', False), ("{}", False), ("[1]", False), ("{", False), (None, False), ('{"query":"a","limit":1.5}', False), ('{"query":"a","other":1}', False)])
def test_arguments(spark, arguments, good):
    df = spark.createDataFrame([("search", arguments)], "n string, a string")
    assert df.select(chat.valid_arguments(F.col("n"), F.col("a"))).first()[0] is good


def plain_chat(rows):
    """(order_turn, phase, linked) of each message by following links one at a time; rows: conv, turn, text."""
    seen = {}
    for conv, turn, text in rows:
        m = json.loads(text)
        seen[conv, turn, text] = (conv, turn, m.get("tool_call_id"), [c["id"] for c in m.get("tool_calls", [])])
    out = {}
    for me, (conv, turn, result, ids) in seen.items():
        up, path, top, depth, cycle = me, {me}, turn, 0, False
        while True:
            c, _, r, _ = seen[up]
            makers = sorted(((seen[k][1], k) for k in seen if c is not None and seen[k][0] == c and r is not None and r in seen[k][3]), key=lambda t: t[0])
            if not makers or makers[0][1] == up:
                break
            up = makers[0][1]
            depth, top = depth + 1, max(top, seen[up][1])
            if up in path:
                cycle = True
                break
            path.add(up)
        made = [k for k in seen if conv is not None and seen[k][0] == conv and result in seen[k][3]]
        own = result is None or bool(made) and min(made, key=lambda k: seen[k][1]) != me
        answered = all(any(conv is not None and k != me and seen[k][0] == conv and seen[k][2] == i for k in seen) for i in ids)
        out[me] = ((turn, 1) if cycle else (top, max(depth, int(result is not None)))) + (own and answered,)
    return out


def test_chat_chains_and_cycles(spark):
    call = lambda *ids: [{"id": i, "name": "search", "arguments": {"query": "q"}} for i in ids]
    both = lambda result, *ids: json.dumps({"tool_call_id": result, "tool_calls": call(*ids)} if ids else {"tool_call_id": result})
    calls = lambda *ids: json.dumps({"tool_calls": call(*ids)})
    rows = [(1, 9, calls("a")), (1, 5, both("a", "b", "c")), (1, 4, both("b", "d")), (1, 3, both("d")), (1, 12, both("c"))]
    rows += [(2, 1, both("x", "y")), (2, 2, both("y", "x")), (2, 3, both("x")), (2, 4, calls("z", "w")), (2, 5, both("z"))]  # a cycle, one below it, a call without result
    rows += [(3, 6, calls("k")), (3, 2, calls("k")), (3, 1, both("k")), (3, 7, both("s", "s")), (3, 8, both("gone")), (None, 1, calls("k")), (None, 2, both("k"))]
    rows += [(4, 100 - i, both(f"n{i}", f"n{i + 1}")) for i in range(1, 40)] + [(4, 100, calls("n1")), (4, 0, both("n40"))]
    rng = __import__("random").Random(3)
    for conv in range(10, 40):
        for turn in range(8):
            ids = rng.sample("abcdef", rng.randint(0, 2))
            rows.append((conv, turn, both(rng.choice("abcdef"), *ids) if rng.random() < 0.7 else calls(*(ids or ["a"]))))
    df = spark.createDataFrame([(c, t, "tool", x) for c, t, x in rows + rows[:3]], "conv_id long, turn long, role string, text string")
    got = chat.format_chat(df).collect()
    want = plain_chat(rows)
    assert len(got) == len(rows) + 3
    by_line = {}
    for (conv, turn, text), value in want.items():
        by_line.setdefault((conv, turn), []).append(value)
    for r in got:
        assert (r.order_turn, r.phase, r.linked) in by_line[r.conv_id, r.turn], (r, by_line[r.conv_id, r.turn])
    assert {(r.turn, r.order_turn, r.phase) for r in got if r.conv_id == 1} == {(9, 9, 0), (5, 9, 1), (4, 9, 2), (3, 9, 3), (12, 12, 2)}
    assert all(r.order_turn == 100 for r in got if r.conv_id == 4) and [r.phase for r in got if r.conv_id == 4] == list(range(41))


def test_mixing_of_rows_without_ids(spark):
    """Null ids are ordered by text, so they are dealt to many buckets; DuckDB gives the same."""
    import duckdb
    import pandas as pd

    rows = [(None if i % 3 else i, "w " * (i % 11) + f"t{i % 40}", "a" if i % 4 else "b") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    con.execute("CREATE VIEW documents AS SELECT * FROM given")
    want = con.execute(f"SELECT source, size, taken, round(coalesce(position, -1), 4) FROM ({mixing.SQL}) ORDER BY ALL").fetchall()
    here = sorted((r.source, r.size, r.taken, round(-1 if r.position is None else r.position, 4)) for r in got.collect())
    assert [x[:3] for x in here] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 2e-4 for a, b in zip(here, want))
