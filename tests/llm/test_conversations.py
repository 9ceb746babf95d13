"""Operators over conversations against plain versions, and the defined edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from vulnlake.llm import structure, trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, n long, gone string, base string"


def conversations(spark, rows):
    """Rows beside extra columns with names that operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, "g", "b") for r in rows], SCHEMA)


def nulls_first(value):
    return (value is not None, value)


# --- Prefix trie -----------------------------------------------------------------------


def mark(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain_trie(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs.setdefault(conv_id, []).append((turn, role or "", text or ""))
    for turns in convs.values():
        turns.sort(key=lambda t: (nulls_first(t[0]), mark(*t[1:])))
    whole = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = [t[1:] for t in convs.get(c - c % 100, [])[:h] + turns[h:]]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(m[:-1] == n for m in members if m) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = sorted(c for c in ids if len(whole[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(children), leaves, saved, digest))
    return sorted(out, key=str)


def test_totals_are_read_in_as_many_scans_however_deep_the_trie(spark):
    def totals(depth):
        rows = [(bytes([k]), bytes([k - 1]) if k else None, k, 1, k) for k in range(depth)]
        nodes = spark.createDataFrame(rows, "node binary, parent binary, depth long, n_leaves long, saved_tokens long")
        return trie.subtree_totals(nodes, ["n_leaves", "saved_tokens"])

    shallow, deep = totals(5), totals(60)
    found = {r.node[0]: (r.n_leaves, r.saved_tokens) for r in deep.collect()}
    assert found == {k: (60 - k, sum(range(k, 60))) for k in range(60)}
    scans = [df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for df in (shallow, deep)]
    assert scans[0] == scans[1] <= 2


def random_conversations(seed, n, most=6, texts=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), n):
        for turn in range(rng.randint(1, most)):
            turn = rng.choice([turn, turn, turn, None])
            rows.append((c, turn, rng.choice(["user", "assistant", "é", None]), rng.choice(["", "né", "abc", None][: texts + 1])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_a_plain_version(spark, seed):
    rows = random_conversations(seed, 60) + [(None, 1, "user", "of none")]
    rows += rows[:9]  # repeated rows
    got = sorted((tuple(r) for r in trie.prefix_trie(conversations(spark, rows)).collect()), key=str)
    assert got == plain_trie(rows)


def test_trie_of_long_chains_and_segments(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 4)
    monkeypatch.setattr(trie, "PACKED", 2)
    long = [(c, t, "user", str(t if t < cut else (t, c))) for c, cut in ((100, 99), (101, 17), (102, 17), (103, 20)) for t in range(23)]
    copies = [(200 + k, 0, "user", "same") for k in range(9)]
    rows = long + copies
    got = sorted((tuple(r) for r in trie.prefix_trie(conversations(spark, rows)).collect()), key=str)
    assert got == plain_trie(rows)


def test_trie_of_no_conversations(spark):
    assert trie.prefix_trie(conversations(spark, [])).collect() == []


# --- Structure repair ------------------------------------------------------------------


def plain_repair(rows):
    """The cheapest audit by trying all of them; two inserts at one place never pay."""
    best = None

    def go(k, last, cost, audit, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(rows) and last in ("", "a"):
            best = min(best or (cost, audit), (cost, audit))
        following = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if inserts < 3:
            for q in following.replace("s", ""):
                go(k, q, cost + 2, audit + "I", inserts + 1)
        if k < len(rows):
            initial, must_go, truncated = rows[k]
            go(k + 1, last, cost + 3, audit + "D", 0)
            for q in "" if must_go else following:
                if q == initial:
                    go(k + 1, q, cost + truncated, audit + "K", 0)
                if q != "s":
                    go(k + 1, q, cost + 2 + truncated, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def test_repair_matches_trying_all_edits():
    rng = random.Random(5)
    for _ in range(500):
        rows = []
        for _ in range(rng.randint(0, 6)):
            must_go = rng.random() < 0.2
            rows.append((rng.choice("uauast") if rng.random() < 0.9 else "", must_go, not must_go and rng.random() < 0.3))
        for segment in (512, 1, 2, 3):
            cost, edits = structure.repair(rows, segment)
            assert (cost, "".join(e[0] for e in edits)) == plain_repair(rows)
            assert re.fullmatch("(s?(ua)+)?", "".join(q for letter, _, q in edits if letter != "D"))


def plain_rows(rows):
    """Damaged rows by conversation, in order."""
    convs = {}
    for conv_id, turn, role, text in rows:
        kept = convs.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return {c: sorted(kept, key=lambda r: (nulls_first(r[0]), r[1:])) for c, kept in convs.items()}


def plain_structure(rows):
    out = []
    for c, kept in plain_rows(rows).items():
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        flags, seen = [], set()
        for _, role, text in kept:
            signs = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not signs else 1 if (role, text) in seen else 2 if signs[-1] not in ".!?" else 3
            flags.append(fault)
            seen.add((role, text))
        shape = [(role[:1], f < 2, f == 2) for (_, role, _), f in zip(kept, flags)]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(shape))
        cost, audit = plain_repair(shape)
        lines, k, last = [], 0, ""
        for letter in audit:
            _, role, text = kept[k] if letter != "I" else (None, "", "")
            k += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((c, gaps, *(flags.count(f) for f in range(3)), illegal, cost, audit, digest))
    return sorted(out, key=str)


def repair_cases():
    rng = random.Random(11)
    texts = ["Hello there.", "Why?", "no stop", "", " \n", None, "Ends\v", "é!", "Again."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = [(c, rng.choice([t, t, t + 3, None]), rng.choice(roles), rng.choice(texts)) for c in range(150) for t in range(rng.randint(1, 6))]
    return rows + [(None, 1, "user", "Whose?"), (None, None, None, None), (7, 1, "user", "x" * 60_000)]


def test_repair_of_rows_matches_a_plain_version(spark):
    rows = repair_cases()
    damaged = structure.damaged(conversations(spark, rows))
    got = sorted((tuple(r) for r in structure.repair_conversations(damaged).collect()), key=str)
    assert got == plain_structure(rows)
    read_twice = structure.repair_conversations(damaged, held=10)
    assert sorted((tuple(r) for r in read_twice.collect()), key=str) == got


def test_repair_of_no_rows(spark):
    assert structure.repair_conversations(structure.damaged(conversations(spark, []))).collect() == []
    dropped = next(t for t in itertools.count() if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (row,) = structure.repair_conversations(structure.damaged(conversations(spark, [(5, dropped, "user", "x")]))).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_of_a_long_conversation_is_in_proportion():
    rng = random.Random(2)
    rows = [(rng.choice("uas"), rng.random() < 0.1, False) for _ in range(5000)]
    cost, edits = structure.repair(rows)
    assert cost == structure.costs_after(rows)[0][""]
    assert sum(letter != "I" for letter, _, _ in edits) == len(rows)


def test_trie_query_matches_its_sql(spark):
    connection = duckdb.connect()
    connection.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    expected = connection.execute(trie.ORACLE)
    names = [d[0] for d in expected.description]
    got = trie.op11_prefix_trie(spark, "/root/testdata/sf0.001").select(*names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected.fetchall(), key=str)
