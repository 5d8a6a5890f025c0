"""Chosen-path join, periodic runs and conversation repair against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import chosen_path, conversations, periodic, queries

AZ = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, node long, c string, _text int, key string, n int, periodic int"


def _sorted(found):
    return sorted(map(tuple, found), key=repr)


# ---- chosen-path join


def _set(text):
    w = WORD.findall((text or "").translate(AZ))
    return frozenset(" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def _components(rows):
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    out = []
    for i, (k, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else k
        out.append((k, len(sets[i]), c, k is not None and k == c))
    return out


def _edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"x{rnd.randrange(999)}"
    return words


def _near_rows():
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size, copies, edits in ((120, 40, 2), (90, 30, 4), (60, 12, 1), (200, 25, 8)):  # the second and last lie about the limit
        base = rnd.choices(vocabulary, k=size)
        texts += [" ".join(_edited(rnd, base, rnd.randint(0, edits))) for _ in range(copies)]
    notice = " ".join(rnd.choices(vocabulary, k=12))
    texts += [notice + " " + " ".join(rnd.choices(vocabulary, k=rnd.randint(5, 60))) for _ in range(40)]
    chain = rnd.choices(vocabulary, k=100)
    for i in range(12):  # neighbours link, ends don't
        chain = _edited(rnd, chain, 2)
        texts.append(" ".join(chain))
    texts += [texts[0], texts[0].upper(), None, "", " \n ", "one", "ONE", "one two", "one two three", "ÀÉ one", "àé one", "again " * 30_000, "again again again"]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    return rows + [rows[3], (None, texts[1]), (None, texts[70]), (None, "lonely text without an id at all"), (None, None)]


@pytest.mark.parametrize("small,part", [(256, 512), (6, 5)])
def test_chosen_path_join(spark, small, part):
    rows = _near_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2, "k", 3, 4) for r in rows], DOCS).repartition(3)
    assert _sorted(chosen_path.near_duplicates(df, small=small, part=part).collect()) == _sorted(_components(rows))


def test_chosen_path_join_of_nothing(spark):
    assert chosen_path.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    alone = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert _sorted(chosen_path.near_duplicates(alone).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_all_parts_are_compared(spark):
    """What never becomes small is compared in pairs of parts."""
    rows = [(i, " ".join(f"w{(i % 7) * 50 + j}" for j in range(40)) + f" end{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = df.select("doc_id", F.lit(b"").alias("key"), "text").mapInArrow(
        lambda b: chosen_path._signatures(b, 3), "doc_id long, key binary, c binary, n long, tokens array<long>, sketch binary")
    looks = signed.select("c", "n", "sketch")
    nodes = signed.select(F.lit(1).cast("long").alias("node"), "c", F.lit(None).cast("binary").alias("grp"), F.lit(60).alias("m"))
    names = {r["c"]: r["doc_id"] for r in signed.select("c", "doc_id").collect()}
    pairs = chosen_path._parts(nodes, looks, 85, 8).collect()
    got = [(names[bytes(r["a"])] % 7, names[bytes(r["b"])] % 7) for r in pairs]
    assert got and all(a == b for a, b in got)
    found = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in pairs}
    label = {c: c for c in names}
    for a, b in map(tuple, found):
        x, y = label[a], label[b]
        label = {k: (x if v == y else v) for k, v in label.items()}
    assert len(set(label.values())) == 7


def test_shared_shingles_are_counted(monkeypatch):
    import numpy as np

    monkeypatch.setattr(chosen_path, "COLUMNS", 8)
    rnd = random.Random(3)
    sets = [np.unique(np.array(rnd.choices(range(60), k=rnd.randint(1, 40)), np.uint64)) for _ in range(30)]
    got = chosen_path._shared(sets)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert i == j or got[i][j] == len(set(x.tolist()) & set(y.tolist()))


# ---- periodic runs


def _runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            start = i - q
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - start >= max(6, 4 * q):
                found.setdefault((start, i), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


@pytest.mark.parametrize("step", [1, 5, 1 << 14])
def test_runs_are_those_of_brute_force(step):
    rnd = random.Random(step)
    for _ in range(1500):
        n, k = rnd.randint(0, 80), rnd.choice([1, 2, 2, 3, 6])
        w = [b"%d" % rnd.randrange(k) for _ in range(n)]
        if rnd.random() < 0.6 and n > 10:
            a = rnd.randrange(n)
            p = rnd.randint(1, max(1, (n - a) // 3))
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        if rnd.random() < 0.3:
            w += w[-rnd.randint(1, 4) :] * rnd.randint(3, 9) + w[:7]
        assert periodic.find_runs(w, step=step) == _runs(w)


def test_long_texts_take_n_log_n():
    import time

    began = time.time()
    assert periodic.find_runs([b"again"] * 300_000) == [(0, 300_000, 1)]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 50_000:
        a, b = b, b + a
    assert periodic.find_runs(b) == []  # Fibonacci words have squares everywhere, and no fourth power
    assert time.time() - began < 60


def _op12(k, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(k).encode()) if k is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = _runs(w)
    keep = [True] * n
    for s, length, q in runs:
        keep[s + q : s + length] = [False] * (length - q)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (k, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(x for x, y in zip(w, keep) if y)))


def test_periodic_query(spark, tmp_path):
    rnd = random.Random(2)
    words = "a b c d É f".split()
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 120)))) for i in range(300)]
    rows += [(300 + i, t) for i, t in enumerate([None, "", " \n\t", "a " * 5, "a " * 6, "A a " * 40, "x y\x1cz " * 9])]
    rows += [rows[7], (None, "ab " * 50), (None, None), (10_000, "s t u " * 4000)]
    spark.createDataFrame([(*r, 1, "x", 2, "k", 3, 4) for r in rows], DOCS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic(spark, str(tmp_path)).collect()
    assert _sorted(got) == _sorted(_op12(*r) for r in rows)
    assert sum(r["n_runs"] > 0 for r in got) > 20


def test_periodic_keeps_other_columns(spark):
    df = spark.createDataFrame([], DOCS)
    found, name = periodic.periodic_runs(df)
    assert found.count() == 0 and name == "periodic_" and found.columns == [*df.columns, name]


# ---- conversation repair

CONV = "conv_id long, turn long, role string, text string, conv string, n int, digest int"
NEXT, ENDS = {"": "u", "s": "u", "u": "a", "a": "u"}, ("", "a")


def _cheapest(rows):
    """(cost, audit, repaired) by trying edits over whole prefixes; rows are (role, text, fault)."""

    def inserted(layer):
        todo = list(layer)
        while todo:
            p = todo.pop()
            q, (cost, audit, made) = NEXT[p], layer[p]
            new = (cost + 2, audit + "I", made + [({"u": "user", "a": "assistant"}[q], "")])
            if q not in layer or new[:2] < layer[q][:2]:
                layer[q] = new
                todo.append(q)
        return layer

    layer = {"": (0, "", [])}
    for role, text, fault in rows:
        new = {}

        def put(q, x, new=new):
            if q not in new or x[:2] < new[q][:2]:
                new[q] = x

        for p, (cost, audit, made) in inserted(layer).items():
            put(p, (cost + 3, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            cost += fault == "truncated"
            first = role[:1]
            if first == NEXT[p] or (first, p) == ("s", ""):
                put(first, (cost, audit + "K", made + [(role, text)]))
            put(NEXT[p], (cost + 2, audit + "R", made + [({"u": "user", "a": "assistant"}[NEXT[p]], text)]))
        layer = new
    return min((x for p, x in inserted(layer).items() if p in ENDS), key=lambda x: x[:2])


def _report(conv, rows):
    """``rows`` (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, made = _cheapest([(r[1], r[2], f) for r, f in zip(rows, faults)])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{a}:{b}" for a, b in made)
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def _chats():
    rnd = random.Random(4)
    texts = ["Yes.", "No!", "Well", "", " \n", "What?", "And so on", "yes. ", "É.", None]
    roles = ["user", "assistant", "system", "usher", "tool", "", None]
    rows = []
    for conv in range(80):
        for turn in range(rnd.randint(1, 12)):
            role = rnd.choice(roles) if rnd.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn if rnd.random() < 0.9 else rnd.choice([None, 40]), role, f"{turn}." if rnd.random() < 0.5 else rnd.choice(texts)))
    rows += [(200, i, ("user", "assistant")[i % 2] if i % 5 else "system", f"{i % 37}" + ".!,"[i % 3]) for i in range(300)]
    rows += [(300, 1, "user", "same.")] * 70 + [(400, None, "system", "only.")]
    rows += [(500 + i, 1, "user", "ends.") for i in range(60)]  # some lose their only row
    rows += [(None, i, "user", "a.") for i in range(3)] + [rows[5]] * 2
    rnd.shuffle(rows)
    return rows


def _fault_in(row):
    conv, turn, role, text = (" " if x is None else x for x in row)
    h = zlib.crc32(f"{conv}:{turn}".encode()) % 20
    role = "user" if h == 4 else role
    text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
    return [] if h == 0 else [(row[1], role, text)] * (2 if h == 3 else 1)


def _by_conversation(rows, made):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).extend(made(r))
    return out


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_repair(spark, block):
    rows = _chats()
    want = [_report(k, v) for k, v in _by_conversation(rows, lambda r: [(r[1], *(" " if x is None else x for x in r[2:]))]).items()]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], CONV).repartition(3)
    repair = conversations.Repair(df, block=block)
    assert _sorted(repair.report().collect()) == _sorted(want)
    made = {}
    for r in sorted(repair.turns().collect(), key=lambda r: r["place"]):
        made.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in made.items()} == {w[0]: w[-1] for w in want if w[0] in made}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in v)) for v in made.values())


def test_conversation_query(spark, tmp_path):
    rows = _chats()
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    want = [_report(k, v) for k, v in _by_conversation(rows, _fault_in).items()]
    assert any(not w[7] for w in want)
    assert _sorted(queries.op13_conversations(spark, str(tmp_path)).collect()) == _sorted(want)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], CONV)
    assert conversations.Repair(none).report().count() == 0
    assert conversations.Repair(none).turns().count() == 0


def test_hirschberg_over_long_sequences():
    """Blocks of any size give one answer, and it is that of the forward search."""
    rnd = random.Random(9)
    valid = [k + f for k in range(4) for f in (0, 4, 8, 12)]
    faults = {0: None, 4: "blank", 8: "duplicate", 12: "truncated"}
    for n in (0, 1, 2, 33, 200, 3000):
        codes = bytes(rnd.choice(valid) for _ in range(n))
        found = set()
        for block in (1, 7, 64, 4096):
            parts = [codes[i : i + block] for i in range(0, n, block)]
            if not parts:
                continue
            states, cost = conversations.cross_blocks([conversations.matrix(p) for p in parts])
            audit = "".join(conversations.solve(p, states[i], states[i + 1]) for i, p in enumerate(parts))
            found.add((cost, audit + conversations._END[states[-1]][1]))
        want = _cheapest([("?sua"[c % 4], "", faults[c - c % 4]) for c in codes])
        assert found == ({want[:2]} if n else set())


def test_parts_tell_a_group_once(spark):
    """One large group of near copies: the pairs told grow with its classes, not with its pairs of parts."""
    rows = [(i, " ".join(f"w{j}" for j in range(60)) + f" end{i}") for i in range(96)]
    signed = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.lit(b"").alias("key"), "text").mapInArrow(
        lambda b: chosen_path._signatures(b, 3), "doc_id long, key binary, c binary, n long, tokens array<long>, sketch binary")
    pairs = chosen_path.search(signed.select("c", "n", "tokens", "sketch"), 85, 8).collect()
    # a tree's parts are one forest each, and up to one node a tree is told by its parts
    assert len({bytes(c) for p in pairs for c in p}) == 96 and len(pairs) <= 2 * chosen_path.TREES * 96
