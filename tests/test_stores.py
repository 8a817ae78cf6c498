"""Session stores and shards against plain walks; the folder tree against a plain tree."""

import json
import random

from runloom.plans import groups
from runloom.sources import stores


def store(seed, n=60):
    rnd = random.Random(seed)
    ids = [f"s{i:02d}" for i in range(n)]
    parent = {s: rnd.choice([None, "", rnd.choice(ids[: i + 1] or ids), "gone"]) if rnd.random() < 0.8 else None for i, s in enumerate(ids)}
    parent |= {"s50": "s52", "s51": "s50", "s52": "s51", "s53": "s52", "s10": "s10"}  # a circle with a tail, and a session that is its own parent
    messages, parts = [], []
    for s in ids:
        for k in range(rnd.randrange(4)):
            m = f"m{len(messages):03d}"
            own = rnd.choice([None, 1000 + rnd.randrange(50)])
            messages.append((m, s, rnd.choice([None, 1000 + rnd.randrange(50)]), json.dumps({"role": "user", **({"time": {"created": own}} if own else {})})))
            for _ in range(rnd.randrange(3)):
                child = rnd.choice([*ids, "absent", s])
                tool, status = rnd.choice(["task", "Agent", "bash"]), rnd.choice(["completed", "error"])
                parts.append((f"p{len(parts):03d}", m, rnd.randrange(9), json.dumps({"type": rnd.choice(["tool", "text"]), "tool": tool, "text": "x", "state": {"status": status, "metadata": {rnd.choice(["sessionId", "session_id"]): child}}})))
    return ids, parent, messages, parts


def walk(root, ids, parent, messages, parts, most):
    home = {m: s for m, s, _, _ in messages}
    named = {}
    for _, m, _, data in parts:
        p = json.loads(data)
        child = next(iter(p["state"]["metadata"].values()))
        if p["type"] == "tool" and p["tool"].lower() in ("task", "agent") and child != home[m]:
            named.setdefault(home[m], set()).add(child)
    seen, queue, lost = {}, [(root, 0, None, "root")], set()
    while queue:
        s, depth, via, how = queue.pop(0)
        if s in seen:
            continue
        if s not in ids or (most is not None and depth > most):
            lost.add((via, s))
            continue
        seen[s] = (depth, how, via)
        own = {c for c in ids if parent[c] == s}
        for c in sorted(own | named.get(s, set())):
            if c not in seen:
                queue.append((c, depth + 1, s, "parent_id+tool_metadata" if c in own & named.get(s, set()) else "parent_id" if c in own else "tool_metadata"))
    return seen, lost


def test_assembly_of_a_store(spark):
    for seed, most in ((1, None), (2, 1)):
        ids, parent, messages, parts = store(seed)
        sessions = spark.createDataFrame([(s, parent[s], f"t {s}") for s in ids], "session_id string, parent_id string, title string")
        m = spark.createDataFrame(messages, "message_id string, session_id string, time_created long, data string")
        p = spark.createDataFrame(parts, "part_id string, message_id string, time_created long, data string")
        start = stores.roots(sessions)
        tops = {r[0] for r in start.collect()}
        expected = {s for s in ids if not parent[s] or parent[s] not in ids}
        for s in ids:
            path = [s]
            while parent[path[-1]] in ids and parent[path[-1]] and parent[path[-1]] not in path:
                path.append(parent[path[-1]])
            if parent[path[-1]] in path:
                expected.add(min(path[path.index(parent[path[-1]]) :]))
        assert tops == expected
        found, missing = stores.descendants(start, stores.edges(sessions, m, p), sessions, most)
        got, lost = {}, {}
        for r in found.collect():
            got.setdefault(r["root"], {})[r["session_id"]] = (r["depth"], r["discovered_by"], r["traversal_parent_id"])
        for r in missing.collect():
            lost.setdefault(r["root"], set()).add((r["parent"], r["child"]))
        for root in tops:
            seen, gone = walk(root, ids, parent, messages, parts, most)
            assert got[root] == seen and lost.get(root, set()) <= gone and {c for _, c in lost.get(root, set())} == {c for _, c in gone} - set(seen)
        rows = stores.assemble(found, sessions, m, p).collect()
        counts = {(r["root"], r["session_id"]): r["message_count"] for r in stores.manifest(found, m).collect()}
        for root, seen in got.items():
            mine = sorted((r for r in rows if r["root"] == root), key=lambda r: r["step_idx"])
            keyed = []
            for s in seen:
                own = sorted((x for x in messages if x[1] == s), key=lambda x: (x[2] or 0, x[0]))
                assert counts[root, s] == len(own)
                for i, x in enumerate(own):
                    told = json.loads(x[3]).get("time", {}).get("created")
                    keyed.append((x[2] if x[2] is not None else told or 0, i, x[0], told if told is not None else x[2], s))
            keyed.sort(key=lambda x: x[:3])
            assert [(r["message_id"], r["created"], r["session_id"]) for r in mine] == [x[2:] for x in keyed]
            for r in mine:
                assert [json.loads(t) for t in r["parts"]] == [json.loads(x[3]) for x in sorted((x for x in parts if x[1] == r["message_id"]), key=lambda x: (x[2], x[0]))]
                assert r["is_sub_agent"] == (r["session_id"] != root)
                assert r["parent_session_id"] == ((parent[r["session_id"]] or seen[r["session_id"]][2]) if r["is_sub_agent"] else None)


def test_missing_references_take_no_join_a_level(spark, monkeypatch):
    cut, joins = stores.cut_lineage, []

    def counted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return cut(df)

    monkeypatch.setattr(stores, "cut_lineage", counted)
    sessions = spark.createDataFrame([(f"s{i}",) for i in range(6)], "session_id string")
    named = [(f"s{i - 1}", f"s{i}", "parent_id") for i in range(1, 6)] + [("s0", "gone", "parent_id"), ("s4", "gone", "tool_metadata"), ("s5", "s2", "parent_id")]
    links = spark.createDataFrame(named, "parent string, child string, relation string")
    start = spark.createDataFrame([("s0",)], "session_id string")
    found, missing = stores.descendants(start, links, sessions)
    assert max(joins) <= 4 and found.count() == 6
    assert sorted(missing.collect()) == [("s0", "s0", "gone", 1, "absent"), ("s0", "s4", "gone", 5, "absent")]
    found, missing = stores.descendants(start, links, sessions, max_depth=2)
    assert found.count() == 3
    assert sorted(missing.collect()) == [("s0", "s0", "gone", 1, "absent"), ("s0", "s2", "s3", 3, "too deep")]


def test_shards_in_the_order_of_their_numbers(spark):
    rnd = random.Random(1)
    held = {k: {n: [json.dumps({"m": f"{k}.{n}.{i}"}) for i in range(rnd.randrange(4))] for n in rnd.sample(range(30), 12)} for k in range(3)}
    rows = [(k, f"messages_{n}.json", "[" + ", ".join(v) + "]") for k, shards in held.items() for n, v in shards.items()]
    rows += [(9, "messages_0.json", "[1]"), (9, "Messages_00.json", "[2]")]
    messages, gaps = stores.merge_shards(spark.createDataFrame(rows, "traj_id long, file string, text string"))
    got = {}
    for r in messages.collect():
        got.setdefault(r["traj_id"], {})[r["position"]] = json.loads(r["message"])
    absent = {}
    for r in gaps.collect():
        absent.setdefault(r["traj_id"], set()).update(range(r["first"], r["last"] + 1))
    assert set(got) == {0, 1, 2}
    for k, shards in held.items():
        whole = [json.loads(m) for n in sorted(shards) for m in shards[n]]
        assert [got[k][i] for i in sorted(got[k])] == whole and sorted(got[k]) == list(range(len(whole)))
        assert absent.get(k, set()) == set(range(max(shards))) - set(shards)


def test_folder_tree(spark):
    rnd = random.Random(4)
    names = ["/home/ann/proj/src/a/x.py", "/home/ann/proj/src/a/y.py", "src/a/z.py", "src/q.py", "/mnt/c/Users/bob/work/lib/l.py", "lib/deep/m.py", "/mnt/d/data/t.csv", "data/u.csv", "data/sub/u.csv", "docs/r.md", "top.md", "./src/../w.py", "/home/ann/other/util/u.py", "util/v.py"]
    both = [*names, "/home/ann/other/src/b.py"]  # in the second group src has two parents
    cells, members = [], [(g, 10 * g + r, r) for g in (0, 1) for r in range(3)]
    for g, run, _ in members:
        for path in names if g == 0 else both:
            if rnd.random() < 0.7:
                cells.append((g, run, path, rnd.randrange(3), rnd.randrange(2)))
    df = spark.createDataFrame(cells, "group_id long, traj_id long, path string, reads long, writes long")
    runs = spark.createDataFrame(members, "group_id long, traj_id long, run_pos long")
    want, alone = {}, {}
    for g in (0, 1):
        mine = [c for c in cells if c[0] == g]
        split = {c[2]: [x for x in c[2].split("/") if x not in ("", ".")] for c in mine}
        home = lambda p: 2 if p[0] in ("home", "Users") and len(p) > 2 else 4 if p[0] == "mnt" and len(p) > 4 and p[2] in ("Users", "home") else 2 if p[0] == "mnt" and len(p) > 2 else 0
        parents = {}
        for p in split.values():
            rel = p[home(p) :]
            for i, folder in enumerate(rel[:-1]):
                if home(p):
                    parents.setdefault(folder, set()).add(tuple(rel[:i]))
        for path, p in split.items():
            rel = p[home(p) :]
            if not home(p) and len(rel) > 1 and len(parents.get(rel[0], ())) == 1:
                rel = [*next(iter(parents[rel[0]])), *rel]
            readers = {c[1] for c in mine if c[2] == path and c[3]}
            for i in range(1, len(rel)):
                key = (g, "/".join(rel[:i]))
                cell = want.setdefault(key, [0] * 6)
                for k, v in enumerate((1, sum(c[3] for c in mine if c[2] == path), sum(c[4] for c in mine if c[2] == path), len(readers) == 3, len(readers) == 1, len(readers) in (0, 2))):
                    cell[k] += v
                if len(readers) == 1:
                    alone[(*key, min(readers))] = alone.get((*key, min(readers)), 0) + 1
    got = {(r["group_id"], r["folder"]): [r[c] for c in ("files", "reads", "writes", "all_runs", "one_run", "other")] for r in groups.folder_tree(df, runs).collect()}
    assert got == want and any("proj/src/a" in k[1] for k in got)
    assert {(r["group_id"], r["folder"], r["traj_id"]): r["files"] for r in groups.folder_readers(df, runs).collect()} == alone
