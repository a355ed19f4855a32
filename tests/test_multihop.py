"""Neighbours against a queue that is worked off one edge at a time, contexts against a loop, paths of hubs."""

import random

import pytest

from strandline.operators import multihop


def queue(edges, start, depth, most, per_node=10):
    out, visited, frontier = [], {start}, [(start, 0)]
    while frontier and len(out) < most:
        node, hop = frontier.pop(0)
        if hop >= depth:
            continue
        for src, dst, rel, _ in [e for e in edges if node in e[:2]][:per_node]:
            other = dst if src == node else src
            out.append((src, dst, rel))
            if other not in visited:
                visited.add(other)
                frontier.append((other, hop + 1))
    return out[:most]


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(6)
    names = [f"n{k}" for k in range(40)]
    edges = [(r.choice(names), r.choice(names), r.choice(["a", "b"]), k) for k in range(160)]
    edges += [("hub", r.choice(names), "h", 200 + k) for k in range(60)] + [("n1", "n1", "self", 500), ("n2", "*_gone", "cites", 501)]
    return edges, spark.createDataFrame(edges, "src string, dst string, rel string, eid long")


@pytest.mark.parametrize("depth, most", [(1, 4), (2, 20), (3, 1000)])
def test_neighbours_are_those_of_the_queue(spark, graph, depth, most):
    edges, df = graph
    starts = ["n1", "n2", "n7", "hub", "alone"]
    got = {}
    for r in multihop.neighbours(df, spark.createDataFrame([(s,) for s in starts], "start string"), depth, most).orderBy("start", "pos").collect():
        got.setdefault(r.start, []).append((r.src, r.dst, r.rel))
    assert got == {s: q for s in starts if (q := queue(edges, s, depth, most))}


def test_context_is_that_of_the_loop(spark, graph):
    edges, df = graph
    nodes = {f"n{k}": (None if k == 3 else f"n{k - 1}" if k % 9 == 5 else f"title {k % 12}", "" if k % 4 == 0 else f"text of {k} " * 80) for k in range(40)} | {"hub": ("Hub", None)}
    starts = [(q, rank, n) for q, ns in enumerate([["n1", "n2", "n3"], ["hub", "n6", "n5", "n13", "n14", "n4"], ["n39"]]) for rank, n in enumerate(ns, 1)]
    want = {}
    for q, _, n in starts:
        seen, parts = want.setdefault(q, (set(), []))
        if n in seen:
            continue
        seen.add(n)
        title, text = nodes[n]
        parts.append(f"[{n if title is None else title}]\n{(text or '')[:600]}")
        for _, dst, rel in queue(edges, n, 2, 5)[:3]:
            t, c = nodes.get(dst, ("", ""))
            t, c = t or "", (c or "")[:500][:300]
            if c and t not in seen:
                seen.add(t)
                parts.append(f"  → [{t}] ({rel}):\n  {c}")
    frame = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "id string, title string, content string")
    got = multihop.context(spark.createDataFrame(starts, "query_id long, rank int, id string"), frame, df)
    assert {r.query_id: r.context for r in got.collect()} == {q: "\n\n".join(p) for q, (_, p) in want.items()}


def test_paths_once_a_query_and_cut(spark, graph):
    _, df = graph
    nodes = spark.createDataFrame([(f"n{k}", f"name {k % 3}", "K", f"s{k}") for k in range(40)], "id string, name string, kind string, summary string")
    starts = spark.createDataFrame([(0, 1, "n1"), (0, 2, "n4"), (1, 1, "hub"), (1, 2, "n9")], "query_id long, rank int, id string")
    for k in (1, 2, 6):
        for r in multihop.path_context(starts, nodes, df, k).collect():
            parts = r.context.split("\n\n")
            keys = [p.split("\nEvidence")[0] for p in parts if p.startswith("Path")]
            assert len(keys) == len(set(keys)) and 1 <= len(parts) <= 5 * k
            assert parts[0].startswith("[Start: name" if r.query_id == 0 else "[Start: ") or r.query_id == 1
    found = multihop.paths(df, spark.createDataFrame([("n1",), ("hub",)], "start string"), nodes, 7).collect()
    assert {r.start for r in found} == {"n1", "hub"} and all(r.end != r.start and len(r.names) == len(r.rels) + 1 for r in found)
    assert max(r.pos for r in found) == 7
